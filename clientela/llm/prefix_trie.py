"""The trie of all prefixes of conversations, with figures over every subtree.

A prefix is known by the sum of the hashes of its turns, each salted with its position, so that
running sums give the digests of all prefixes, also where one conversation is spread over many
tasks. Distinct digests are the nodes.

Subtrees are added up in node tables: shards of whole subtrees, in each a minimal perfect hash that
gives every digest a slot (checked against the digest stored there), flat arrays of counts, and
an array of parent slots through which the counts are passed up in order of depth. Nodes
above the shards, the crown, follow in a table of their own. A node with one member is the tail of
that conversation, whose figures need no table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.operators.ordering import running_totals, with_rank
from clientela.session import settle

from .shipping import ship

FAMILY = 5  # conversations that share the head of the first of them
HEADS = 9  # so many lengths of heads, from 0
LANES = 4  # of 32 bits each; their sums over 2**31 turns fit into a long
SPAN = 4096  # consecutive positions, or ids, that are handled as one
LEAST_REACH, SHARES = 256, 16_384  # a shard's subtree has so many turns, or this share of all
SALTS = 64  # over which the rows of a crown node are spread
ROOT = hashlib.md5(b"0" + b",0" * LANES).digest()
GROUND = ["node", "parent", "conv", "depth", "n_convs", "n_children"]


def _digest(depth: Column, sums: list[Column]) -> Column:
    parts = [c.cast("string") for c in (depth, *sums)]
    return F.unhex(F.md5(F.concat_ws(",", *parts)))


def rebuilt(df: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (``conv, depth, said, bytes, length``), and one row
    for each conversation (``conv, length``), also for those without any turn left."""
    roles, texts = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    said = F.sha2(F.concat(F.octet_length(roles).cast("string"), F.lit(":"), roles, texts), 256)
    turns = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(said).alias("said"),
        F.octet_length(texts).cast("bigint").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("said")]
    placed = settle(with_rank(turns, order, "pos", ["conv"]).drop("turn", "pos_total"))
    sizes = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    own = sizes.select(
        "conv",
        "n",
        (F.col("conv") - F.col("conv") % FAMILY).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"),
    )
    heads = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    shared = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = settle(
        own.join(heads, "base", "left")
        .withColumn("shared", shared)
        .withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .drop("base_n")
    )
    first = placed.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)).select(
        F.col("conv").alias("base"), F.col("pos").alias("depth"), "said", "bytes"
    )
    result = ["conv", "depth", "said", "bytes", "length"]
    from_base = plan.join(first, "base").where(F.col("depth") <= F.col("h")).select(result)
    # A long conversation meets its plan in spans, each with a row of the plan.
    spans = plan.select(
        "conv", "h", "shared", "length",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / SPAN))).alias("span"),
    )
    kept = (
        placed.withColumn("span", F.floor(F.col("pos") / SPAN))
        .join(spans, ["conv", "span"])
        .where(F.col("pos") > F.col("h"))
        .withColumn("depth", F.col("pos") - F.col("h") + F.col("shared"))
        .select(result)
    )
    return from_base.unionByName(kept), plan.select("conv", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, node, parent, bytes, length``: each turn with the digests of its prefix and of
    the one before."""
    salted = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.col("said")), 256)
    own = {f"own{i}": F.conv(F.substring("salted", 8 * i + 1, 8), 16, 10).cast("bigint")
           for i in range(LANES)}
    totals = {f"sum{i}": F.col(f"own{i}") for i in range(LANES)}
    summed = running_totals(
        turns.withColumn("salted", salted).withColumns(own).drop("salted", "said"),
        [F.col("depth")], totals, ["conv"],
    )
    upto = [F.col(f"sum{i}") for i in range(LANES)]
    before = [F.col(f"sum{i}") - F.col(f"own{i}") for i in range(LANES)]
    return summed.select(
        "conv",
        "depth",
        _digest(F.col("depth"), upto).alias("node"),
        _digest(F.col("depth") - 1, before).alias("parent"),
        "bytes",
        "length",
    )


class SlotTable:
    """A minimal perfect hash: n distinct digests get the slots 0 to n-1.

    On every level the digests that are left are hashed into twice as many places; those alone in
    theirs get the next slots in order of place, the others go on. Asked for a digest, it answers
    only if that very digest is in the slot, else -1.
    """

    def __init__(self, digests: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, given = np.arange(len(digests)), 0
        while left.size:
            if len(self.levels) > 64:
                raise ValueError("a digest occurs twice")
            place = self._places(digests[left], 2 * left.size + 1)
            alone = np.bincount(place, minlength=2 * left.size + 1) == 1
            self.levels.append((alone, given + np.cumsum(alone) - 1))
            given += int(alone.sum())
            left = left[~alone[place]]
        self.digests = np.zeros_like(digests)
        self.digests[self._slots(digests)] = digests

    def _places(self, digests: np.ndarray, size: int) -> np.ndarray:
        return self._mixed(digests, len(self.levels)) % np.uint64(size)

    @staticmethod
    def _mixed(digests: np.ndarray, level: int) -> np.ndarray:
        x = digests[:, 0] ^ (digests[:, 1] * np.uint64(2 * level + 0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def _slots(self, digests: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(digests), -1), np.arange(len(digests))
        for level, (alone, slot) in enumerate(self.levels):
            place = self._mixed(digests[left], level) % np.uint64(len(alone))
            hit = alone[place]
            slots[left[hit]] = slot[place[hit]]
            left = left[~hit]
        return slots

    def find(self, digests: np.ndarray) -> np.ndarray:
        slots = self._slots(digests)
        wrong = (slots >= 0) & (self.digests[slots] != digests).any(axis=1)
        slots[wrong] = -1
        return slots


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2).copy()


def add_up(frame: pd.DataFrame) -> pd.DataFrame:
    """``leaves`` and ``saved`` of every node with those of all nodes below it in ``frame``."""
    digests = _words(frame["node"])
    table = SlotTable(digests)
    slot = table.find(digests)
    parent, depth = (np.empty(len(frame), dtype=np.int64) for _ in range(2))
    parent[slot] = table.find(_words(frame["parent"]))
    depth[slot] = frame["depth"]
    totals = {c: np.empty(len(frame), dtype=np.int64) for c in ("leaves", "saved")}
    for name, values in totals.items():
        values[slot] = frame[name]
    by_depth = np.argsort(-depth, kind="stable")
    for nodes in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        nodes = nodes[parent[nodes] >= 0]
        for values in totals.values():
            np.add.at(values, parent[nodes], values[nodes])
    return frame.assign(**{name: values[slot] for name, values in totals.items()})


def _added_up(nodes: DataFrame, by: Column) -> DataFrame:
    schema = nodes.schema
    return nodes.withColumn("__shard", by).groupBy("__shard").applyInPandas(
        lambda frame: add_up(frame.drop(columns="__shard")), schema
    )


def _salted(row: str) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(SALTS)).alias("salt")


def _with_salts(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the joined ``ids`` of consecutive rows of the same node."""
    node, sha = None, hashlib.sha256()
    for frame in frames:
        done = []
        for at, ids in zip(frame["node"], frame["ids"], strict=True):
            at = bytes(at)
            if at == node:
                sha.update(b",")
            else:
                if node is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = at, hashlib.sha256()
            sha.update(ids.encode())
        yield pd.DataFrame(done, columns=["node", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])


def ends(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """``node, ends_sha256``: of the ids that end there, in order. Ids are joined in spans first, and
    a task reads the spans of a node one after the other."""
    last = paths.where(F.col("depth") == F.col("length")).select("node", "conv")
    turnless = plan.where("length = 0").select(F.lit(ROOT).alias("node"), "conv")
    joined = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    return (
        last.unionByName(turnless)
        .groupBy("node", F.floor(F.col("conv") / SPAN).alias("span"))
        .agg(F.array_join(joined, ",").alias("ids"))  # SPAN ids at most
        .repartition("node")
        .sortWithinPartitions("node", "span")
        .select("node", "ids")
        .mapInPandas(_hashed, "node binary, ends_sha256 string")
    )


def prefix_trie(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    Conversation c is rebuilt from the first h turns of conversation c - c % 5 (h from the checksum
    of its number) and its own turns after the first h. ``conv_id`` (least member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.

    Null roles and texts count as empty, null turns come first, and turns of equal number follow
    in the order of their digests. Rows without a conversation are left out, as they belong to
    none; other columns are ignored. Without any conversation there is no node, not even the root.
    """
    ship(df.sparkSession)
    turns, plan = rebuilt(df, conv, turn, role, text)
    paths = settle(prefixes(turns))
    members = [
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv").alias("conv"),
        F.min("length").alias("length"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("reach"),
    ]
    # Parent, depth and bytes follow from the node.
    nodes = settle(paths.groupBy("node", "parent", "depth", "bytes").agg(*members))
    root = plan.agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv").alias("conv"),
        F.min("length").alias("length"),
        F.sum(F.col("length") + 1).alias("reach"),
    ).where("n_convs > 0").select(
        F.lit(ROOT).alias("node"), F.lit(b"\0" * 16).alias("parent"),
        F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("bytes"),
        "n_convs", "conv", "length", "reach",
    )
    children = nodes.groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("tails")
    )
    inner = settle(
        nodes.where("n_convs > 1")
        .unionByName(root)
        .join(children, "node", "left")
        .fillna(0, ["n_children", "tails"])
        .withColumn("leaves", F.col("tails") + (F.col("n_children") == 0).cast("bigint"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    )
    whole = inner.where("depth = 0").select("reach").first()
    reach = max(LEAST_REACH, (whole["reach"] if whole else 0) // SHARES)
    shards = 1 + (whole["reach"] if whole else 0) // (4 * reach)
    in_crown = (F.col("depth") == 0) | (F.col("reach") > reach)
    crown = inner.where(in_crown)

    # Below the crown, each node goes to the shard of the highest node above it on its path.
    marked = paths.select("conv", "depth", "node", _salted("conv")).join(
        _with_salts(crown.select("node", F.lit(1).alias("crowned"))), ["node", "salt"], "left"
    )
    tops = (
        marked.where("crowned is null")
        .groupBy("conv")
        .agg(F.min(F.struct("depth", "node")).alias("top"))
        .select("conv", F.col("top.depth").alias("top_depth"), F.col("top.node").alias("top"))
    )
    work = [*GROUND, "leaves", "saved"]
    below = inner.where(~in_crown).join(tops, "conv")
    lower = settle(
        _added_up(
            below.select(*work, (F.col("depth") == F.col("top_depth")).alias("is_top"), "top"),
            F.pmod(F.xxhash64("top"), F.lit(shards)),
        )
    )
    handed = lower.where("is_top").groupBy(F.col("parent").alias("node")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )
    upper = _added_up(
        crown.join(handed, "node", "left")
        .withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0)))
        .withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        .select(work),
        F.lit(0),
    )
    none = F.sha2(F.lit(b""), 256)
    shared = (
        lower.select(work)
        .unionByName(upper)
        .join(ends(paths, plan), "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    )
    is_end = F.col("depth") == F.col("length")
    tails = nodes.where("n_convs = 1").select(
        "node", "parent", "conv", "depth", "n_convs",
        (~is_end).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("leaves"),
        F.lit(0).cast("bigint").alias("saved"),
        F.when(is_end, F.sha2(F.col("conv").cast("string").cast("binary"), 256))
        .otherwise(none).alias("ends_sha256"),
    )
    # The least member of the parent: of a node of the crown, of another inner one, else the same.
    found = (
        shared.unionByName(tails)
        .withColumn("salt", _salted("node"))
        .join(
            _with_salts(crown.select(F.col("node").alias("parent"), F.col("conv").alias("high"))),
            ["parent", "salt"], "left",
        )
        .withColumn("asked", F.when(F.col("high").isNull(), F.col("parent")).otherwise(F.col("node")))
        .join(inner.select(F.col("node").alias("asked"), F.col("conv").alias("low")), "asked", "left")
    )
    return found.select(
        F.col("conv").alias("conv_id"),
        F.col("depth"),
        F.when(F.col("depth") > 0, F.coalesce("high", "low", "conv")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )
