"""Self join of documents on the Jaccard similarity of their n-gram sets, by vertical partitioning.

All n-grams have one global order, rare ones first, which is cut into fragments. A document's set is
cut with it; overlaps are counted fragment by fragment and summed for each pair. Two sets that are
similar enough must share one of their first n-grams, and the first that they share must leave enough
n-grams after it in both. Pairs to count come from these alone, less those that marks of a few bits
rule out.

What is asked for is which documents hang together. A gram that many documents start with therefore
does not make all pairs of them: each is compared with a pivot of the gram, and what is not yet
known to hang together goes on to the next round with more pivots. Of two similar sets the smaller one
has the gram so early that it can be a pivot. Every pair that may be similar is either compared or
already connected in the end, so that no link between components is lost.
"""

from __future__ import annotations

import functools
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientela.session import settle

from .shipping import ship

COUNTERS = 1 << 20  # of the sketch of frequencies: 4 MB, whatever the corpus
BLOCK = 1 << 14
BITS = 1 << 24  # of the filter for documents that need full sets: 2 MB
FRAGMENTS = 8
MARK = 512  # bits
KNOWN_WORDS = 200_000
FEW_DOCS, FEW_PAIRS = 500_000, 250_000  # that may be broadcast: 4 MB of ids, 6 MB of pairs
HOT_GRAMS = 10_000  # listed at most, if seen so often in one document of so many:
HOT_SEEN, HOT_SHARE = 32, 64
FIRST_PIVOTS, MORE_PIVOTS = 4, 4
STEP = 1_000  # rows worked on at a time


def _steps(frames):
    for frame in frames:
        for at in range(0, len(frame), STEP):
            yield frame.iloc[at : at + STEP]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


@functools.lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def words(text: str | None) -> list[bytes]:
    """ASCII lower case, cut at blanks and the control characters from tab to return."""
    return (text or "").encode().lower().split()


def gram_hashes(found: list[bytes], width: int):
    """Distinct 64-bit hashes of the n-grams; all words as one if there are fewer."""
    import numpy as np

    if not found:
        return np.empty(0, np.uint64)
    known = np.fromiter(map(_word_hashes().__getitem__, found), np.uint64, len(found))
    width = min(width, len(known))
    out = np.zeros(len(known) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ known[k : len(known) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def _slots(grams):
    import numpy as np

    return (grams & np.uint64(COUNTERS - 1)).astype(np.int64)


def facts_and_frequencies(df: DataFrame, width: int) -> DataFrame:
    """Rows (doc, n, text key, parity marks) of all documents, and rows (block, counters) of the
    sketch. A mark has a bit for each class of grams: whether the set has an odd number of them."""

    def batches(frames):
        import numpy as np
        import pandas as pd
        import xxhash

        counters, names = np.zeros(COUNTERS, np.int64), ["doc", "n", "key", "mark", "block", "counters"]
        for frame in _steps(frames):
            rows, slots = [], []
            for doc, text in zip(frame["doc"], frame["text"]):
                found = words(text)
                grams = gram_hashes(found, width)
                slots.append(_slots(grams))
                odd = np.bincount((grams >> np.uint64(32)).astype(np.int64) % MARK, minlength=MARK) & 1
                mark = np.packbits(odd.astype(np.uint8)).view(np.int64)
                rows.append((doc, len(grams), xxhash.xxh3_128_digest(b" ".join(found)), mark, -1, None))
            counters += np.bincount(np.concatenate(slots), minlength=COUNTERS)
            yield pd.DataFrame(rows, columns=names)
        rows = [
            (-1, 0, b"", None, b, zlib.compress(counters[b * BLOCK : (b + 1) * BLOCK].tobytes(), 1))
            for b in range(COUNTERS // BLOCK)
            if counters[b * BLOCK : (b + 1) * BLOCK].any()
        ]
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(
        batches, "doc long, n long, key binary, mark array<long>, block int, counters binary"
    )


def frequencies(rows: DataFrame):
    """The sketch as one array: how many grams of all documents fall on each counter."""
    import numpy as np

    def added(frame):
        import pandas as pd

        total = np.zeros(BLOCK, np.int64)
        for packed in frame["counters"]:
            total += np.frombuffer(zlib.decompress(packed), np.int64)
        out = np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "counters": [out]})

    out = np.zeros(COUNTERS, np.int32)
    parts = rows.where("block >= 0").groupBy("block").applyInPandas(
        added, "block int, counters binary"
    )
    for row in parts.collect():  # at most COUNTERS numbers
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(
            row["counters"], np.int32
        )
    return out


def prefix_length(n: int, percent: int) -> int:
    """How many of the first grams hold one that any similar set shares."""
    return n - -(-percent * n // 100) + 1


def first_grams(df: DataFrame, width: int, percent: int, order) -> DataFrame:
    """``gram``, ``doc``, ``n``, ``rest``: the first grams of every document in the global order, and
    how many of its grams come no earlier than this one."""

    def batches(frames):
        import numpy as np
        import pandas as pd

        counts = order.value
        for frame in _steps(frames):
            rows = []
            for doc, text in zip(frame["doc"], frame["text"]):
                grams = gram_hashes(words(text), width)
                if len(grams):
                    # Grams that tie on the upper bits of their hash are all taken.
                    rank = counts[_slots(grams)].astype(np.uint64) << np.uint64(32)
                    rank |= grams >> np.uint64(32)
                    last = prefix_length(len(grams), percent) - 1
                    first = rank <= np.partition(rank, last)[last]
                    chosen, rank = grams[first], rank[first]
                    rest = len(grams) - np.searchsorted(np.sort(rank), rank, "left")
                    rows.append((doc, len(grams), chosen.view(np.int64), rest))
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "n", "grams", "rest"])

    found = df.mapInPandas(batches, "doc long, n int, grams array<long>, rest array<int>")
    return found.select("doc", "n", F.explode(F.arrays_zip("grams", "rest")).alias("at")).select(
        F.col("at.grams").alias("gram"), "doc", "n", F.col("at.rest").alias("rest")
    )


def may_lead(percent: int):
    """Whether the gram comes early enough to be the first one shared with a set as large or larger."""
    return (100 + percent) * F.col("rest") >= 2 * percent * F.col("n")


def with_partners(postings: DataFrame, percent: int, more: str = "true") -> DataFrame:
    """Without grams that no two sets can share first (or that fail ``more``, on the gram's rows) and
    without sets too large for the smallest one that may lead."""
    grams = postings.groupBy("gram").agg(
        F.count("*").alias("m"), F.min(F.when(may_lead(percent), F.col("n"))).alias("least"),
        F.expr(more).alias("more"),
    )
    grams = grams.where("m > 1 and least is not null and more").select("gram", "least")
    return postings.join(grams, "gram").where(_reachable(percent)).drop("least")


def _reachable(percent: int):
    enough = (100 + percent) * F.col("rest") >= percent * (F.col("n") + F.col("least"))
    return may_lead(percent) | enough


def in_one_shuffle(postings: DataFrame, percent: int) -> DataFrame:
    """As ``with_partners``, with most rows shuffled once and none twice.

    Grams that are frequent among a share of the documents are counted before the shuffle and their
    counts broadcast (a list of bounded length); the others have few rows each and are counted in a
    window. Which way a gram goes does not change the result.
    """
    sample = postings.where(F.pmod(F.xxhash64("doc"), F.lit(HOT_SHARE)) == 0)
    seen = sample.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") >= HOT_SEEN)
    hot = settle(seen.orderBy(F.desc("m"), "gram").limit(HOT_GRAMS).select("gram"))
    often = postings.join(F.broadcast(hot), "gram")
    own = Window.partitionBy("gram")
    seldom = (
        postings.join(F.broadcast(hot), "gram", "left_anti")
        .withColumn("m", F.count("*").over(own))
        .withColumn("least", F.min(F.when(may_lead(percent), F.col("n"))).over(own))
        .where("m > 1 and least is not null").where(_reachable(percent))
        .drop("m", "least")
    )
    return with_partners(often, percent).unionByName(seldom)


def fragments(df: DataFrame, width: int, order, wanted) -> DataFrame:
    """``doc``, ``fragment``, ``grams``: the sets of the documents that the filter lets pass, cut at
    the same places of the global order."""

    def batches(frames):
        import numpy as np
        import pandas as pd

        counts, bits = order.value, wanted.value
        shares = np.bincount(np.minimum(counts, 1 << 16), weights=counts.astype(float))
        upto = np.cumsum(shares) / max(shares.sum(), 1)
        edges = np.unique(np.searchsorted(upto, np.arange(1, FRAGMENTS) / FRAGMENTS))
        for frame in _steps(frames):
            docs = frame["doc"].to_numpy(np.int64)
            slots = _bit_slots(docs)
            keep = (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
            rows = []
            for doc, text in zip(docs[keep], frame["text"].array[keep]):
                grams = gram_hashes(words(text), width)
                place = np.searchsorted(edges, np.minimum(counts[_slots(grams)], 1 << 16), "left")
                for fragment in np.unique(place):
                    rows.append((doc, fragment, grams[place == fragment].view(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "fragment", "grams"])

    return df.mapInPandas(batches, "doc long, fragment int, grams array<long>")


def _bit_slots(docs):
    import numpy as np

    mixed = docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64)  # 24 bits


def passing_filter(docs: DataFrame):
    """A bitmap of fixed size with the slots of ``docs``; others may share a slot and pass too."""
    import numpy as np

    def batches(frames):
        import pandas as pd

        for frame in frames:
            slots = np.unique(_bit_slots(frame["doc"].to_numpy(np.int64)))
            yield pd.DataFrame({"word": slots >> 6, "bit": slots & 63})

    found = docs.mapInPandas(batches, "word int, bit int")
    mask = F.expr("bit_or(shiftleft(cast(1 as bigint), bit))").alias("mask")
    packed = found.groupBy("word").agg(mask)
    out = np.zeros(BITS // 64, np.int64)
    for frame in packed.select("word", "mask").toLocalIterator():  # at most BITS / 64 numbers
        out[frame["word"]] = frame["mask"]
    return out.view(np.uint8)


def may_be_similar(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Without pairs whose marks already differ in more bits than similar sets have grams apart."""
    left = marks.select(F.col("doc").alias("a"), F.col("mark").alias("mine"))
    right = marks.select(F.col("doc").alias("b"), F.col("mark").alias("other"))
    differing = F.aggregate(
        F.zip_with("mine", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, n: total + n,
    )
    # |A| + |B| - 2 |A and B| is least when the similarity is.
    apart = (100 - percent) * (F.col("na") + F.col("nb"))
    return (
        pairs.join(left, "a").join(right, "b").where((100 + percent) * differing <= apart)
        .select("a", "b", "na", "nb")
    )


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those that are similar: overlaps are counted in each fragment apart and
    summed."""
    left = sets.select(F.col("doc").alias("a"), "fragment", F.col("grams").alias("mine"))
    right = sets.select(F.col("doc").alias("b"), "fragment", F.col("grams").alias("other"))
    partial = (
        pairs.join(left, "a")
        .join(right, ["b", "fragment"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("mine", "other")).alias("common"))
    )
    common = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    union = F.col("na") + F.col("nb") - F.col("common")
    return common.where(100 * F.col("common") >= percent * union).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``doc``, ``label``: the least document that each one with an edge is connected with."""
    both = settle(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    )
    label = settle(
        both.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("b"))
        .select("doc", F.least("doc", "b").alias("label"))
    )
    while True:
        near = (
            both.join(label.withColumnsRenamed({"doc": "b"}), "b")
            .groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("near"))
        )
        step = label.join(near, "doc").select(
            "doc", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        ahead = label.select(F.col("doc").alias("label"), F.col("label").alias("jump"))
        after = settle(
            step.join(ahead, "label").select("doc", "old", F.least("label", "jump").alias("label"))
        )
        changed = after.where("old <> label").limit(1).count()
        label = after.select("doc", "label")
        if not changed:
            return label


def similar_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
    percent: int = 85,
) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``.

    Two documents are linked if their sets of distinct word n-grams have a Jaccard similarity of at
    least ``percent`` / 100; the component is named by its least id. A text with fewer words is one
    n-gram of all its words; one without words (null too) has none and is linked with nothing. Ids
    are unique integers; rows without one come back alone, with a null component.
    """
    spark = df.sparkSession
    ship(spark)
    texts = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(
        "doc is not null"
    )
    facts = settle(facts_and_frequencies(texts, width))
    order = spark.sparkContext.broadcast(frequencies(facts))
    known = facts.where("block < 0").select("doc", "n", "key")
    # Equal word sequences are one class; its least document stands for it.
    classes = settle(
        known.where("n > 0").groupBy("key").agg(F.min("doc").alias("node"), F.max("n").alias("n"))
    )
    postings = settle(first_grams(texts, width, percent, order))
    nodes = classes.select(F.col("node").alias("doc"))
    # Settled first: the semi join would be pushed below, and shuffle all postings by document.
    shared = settle(in_one_shuffle(postings, percent))
    live = settle(shared.join(nodes, "doc", "left_semi"))
    marks = facts.where("block < 0").select("doc", "mark").join(nodes, "doc", "left_semi")
    marks = settle(marks.dropDuplicates(["doc"]))

    label = spark.createDataFrame([], "doc long, label long")
    edges, pivots = None, FIRST_PIVOTS
    while True:
        named = live.join(label, "doc", "left").select(
            "gram", "doc", "n", "rest", F.coalesce("label", "doc").alias("label")
        )
        still = settle(with_partners(named, percent, "min(label) < max(label)"))
        if not still.limit(1).count():
            break
        part = F.pmod(F.xxhash64("doc", F.lit(pivots)), F.lit(pivots))
        chosen = (
            still.where(may_lead(percent))
            .groupBy("gram", part.alias("part"))
            .agg(F.min(F.struct("doc", "n", "rest", "label")).alias("pivot"))
            .select("gram", "pivot")
        )
        x, y = F.col("pivot"), F.struct("doc", "n", "rest", "label")
        # As many can be shared as come from the first shared gram on, in the smaller rest.
        enough = (100 + percent) * F.least(x["rest"], "rest") >= percent * (x["n"] + F.col("n"))
        pairs = (
            still.join(chosen, "gram")
            .where(x["label"] != F.col("label"))
            .where(enough)
            .select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
            .select(
                F.col("u.doc").alias("a"), F.col("v.doc").alias("b"), F.col("u.n").alias("na"),
                F.col("v.n").alias("nb"),
            )
            .distinct()
        )
        likely = settle(may_be_similar(pairs, marks, percent))
        if not likely.isEmpty():
            named_in = settle(likely.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
            wanted = spark.sparkContext.broadcast(passing_filter(named_in))
            few = named_in.count() <= FEW_DOCS  # else the filter alone has to do
            asked = texts.join(F.broadcast(named_in), "doc", "left_semi") if few else texts
            if likely.count() <= FEW_PAIRS:
                likely = F.broadcast(likely)
            found = settle(links(likely, settle(fragments(asked, width, order, wanted)), percent))
            if not found.isEmpty():
                edges = found if edges is None else edges.union(found)
                label = components(edges)
        # A pivot has met all documents of its gram.
        met = chosen.select("gram", F.col("pivot.doc").alias("doc"))
        live = settle(still.select("gram", "doc", "n", "rest").join(met, ["gram", "doc"], "left_anti"))
        pivots *= MORE_PIVOTS
    class_of = known.where("n > 0").select("doc", "key").distinct().join(
        classes.select("key", "node"), "key"
    )
    grouped = class_of.join(label.withColumnsRenamed({"doc": "node"}), "node", "left").select(
        "doc", F.coalesce("label", "node").alias("class")
    ).groupBy("doc").agg(F.min("class").alias("class"))
    out = known.join(grouped, "doc", "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("class", "doc").alias("component_id"),
    )
    nameless = df.where(F.col(id_col).isNull()).select(F.col(text_col).alias("text"))
    return out if nameless.isEmpty() else out.unionByName(_without_id(nameless, id_col, width))


def _without_id(texts: DataFrame, id_col: str, width: int) -> DataFrame:
    def batches(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"n": [len(gram_hashes(words(t), width)) for t in frame["text"]]})

    none = F.lit(None).cast("long")
    return texts.mapInPandas(batches, "n long").select(
        none.alias(id_col), F.col("n").alias("n_shingles"), none.alias("component_id")
    )
