"""Best-fit-decreasing packing of documents into sequences of bounded length.

Documents are cut into full windows first; what is left over of each, and the full windows, are
pieces. Pieces are dealt by a hash into shards of bounded size, and each shard is packed on its
own: pieces in decreasing length go to the open sequence with the least room that still fits.
"""

from __future__ import annotations

import functools
import math
from array import array

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.session import settle

from .automaton import vocabulary_everywhere
from .pieces import WORDS, Packed, packed_ids, vocabulary

SHARD_PIECES = 16_384  # a shard leaves a few sequences partly filled, whatever its size


class OpenSequences:
    """A segment tree over the room left, 0 to ``capacity``: which rooms have open sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = room + self.leaves
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (room, sequence) with the least room of at least ``length``."""
        node = length + self.leaves
        if not self.filled[node]:
            while True:  # up to the first ancestor with something to its right, then down
                if node == 1:
                    return None
                if not node & 1 and self.filled[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        room = node - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            self.filled[node] = 0
            node >>= 1
            while node and not (self.filled[2 * node] or self.filled[2 * node + 1]):
                self.filled[node] = 0
                node >>= 1
        return room, sequence


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; lengths in decreasing order, none above ``capacity``."""
    rooms, count, out = OpenSequences(capacity), 0, []
    for length in lengths:
        found = rooms.take(length)
        if found is None:
            found = (capacity, count)
            count += 1
        room, sequence = found
        out.append((sequence, capacity - room))
        if room > length:
            rooms.add(room - length, sequence)
    return out


@functools.lru_cache(maxsize=2)
def word_ids(content: bytes) -> tuple[Packed, dict[str, int]]:
    ids, _, special = vocabulary(content)
    encoding = tiktoken.Encoding(
        "byte_bpe", pat_str=WORDS.pattern, mergeable_ranks=ids, special_tokens={}
    )
    return Packed(lambda w: array("I", encoding.encode_ordinary(w)).tobytes()), special


def token_pieces(
    df: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of every document: ``id_col``, start, length, doc_tokens, ids (packed, 32 bits each).

    A document is the ids of its whole text and then ``end_id``; a null or empty text is that one
    id. Every row gives its own pieces, repeated and null ids included. Full windows come first,
    the rest (if any) last.
    """
    content = vocabulary_everywhere(df, path)
    step, end = 4 * window, end_id.to_bytes(4, "little")

    def batches(frames):
        import pandas as pd

        cache, special = word_ids(content.value)
        for frame in frames:
            rows = []
            for key, text in zip(frame["key"], frame["text"]):
                ids = packed_ids(text, cache, special) + end
                rows.extend(
                    (key, at // 4, len(ids[at : at + step]) // 4, len(ids) // 4, ids[at : at + step])
                    for at in range(0, len(ids), step)
                )
            out = pd.DataFrame(rows, columns=["key", "start", "length", "doc_tokens", "ids"])
            yield out.astype({"key": object})

    kind = df.schema[id_col].dataType.simpleString()
    return (
        df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
        .mapInPandas(batches, f"key {kind}, start long, length long, doc_tokens long, ids binary")
        .withColumnRenamed("key", id_col)
    )


def pack(pieces: DataFrame, window: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``start`` and ``length`` up to ``window``.

    All other columns are kept. ``pieces`` is read twice (to size the shards, then to pack): hand
    in a settled table. Ties go by id (null first), then start. Sequence ids are unique over all
    shards and gapless within one. An empty table gives an empty table.
    """
    shards = max(1, math.ceil(pieces.count() / SHARD_PIECES))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    columns = list(kinds)
    shard = F.pmod(F.xxhash64(F.col(id_col), "start"), F.lit(shards))

    def packed(frame):
        frame = frame.sort_values(
            ["length", id_col, "start"], ascending=[False, True, True], na_position="first"
        )
        texts = frame.select_dtypes(exclude="number").columns
        frame = frame.astype({c: object for c in texts})
        placed = best_fit(frame["length"].tolist(), window)
        base = int(frame["__shard"].iloc[0]) << 32
        frame["sequence_id"] = [base + s for s, _ in placed]
        frame["offset"] = [o for _, o in placed]
        return frame[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return (
        pieces.withColumn("__shard", shard)
        .groupBy("__shard")
        .applyInPandas(packed, f"{schema}, sequence_id long, offset long")
    )


def pack_documents(df: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places and the checksum of their ids."""
    pieces = token_pieces(df, path, window, end_id)
    return pack(settle(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")), window)
