"""SimHash fingerprints of texts, and the search for all fingerprints within a Hamming radius."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.operators.ordering import with_rank
from clientela.session import settle

from .expressions import bind, hashes_of, windows, words_of

SHINGLE_WORDS = 5
# Near duplicates have a Jaccard similarity of 0.8, for equal sizes a cosine of 0.89: 19 of 128 bits
# differ on average, with a standard deviation of 4. The radius is two of these further.
NEAR_RADIUS = 28
LOOKUP = 10  # work of a lookup, in comparisons of two fingerprints
MOST_PROBES = 20_000  # values looked up for a block of a query
HOT_VALUE = 4096  # fingerprints with the same value in a block that one task compares
WORDS64 = ("f0", "f1")  # a fingerprint is two longs, 128 bits
LANES = 0x0000000100000001  # bits i and i + 32 of a hash are counted in the halves of one long


def term_hashes(text: Column) -> Column:
    """Hashes of all shingles, one for each place, so that a term weighs as often as it occurs.

    A text of fewer words is one shingle; a text without words has none.
    """

    def of_words(words: Column) -> Column:
        return F.when(
            F.size(words).between(1, SHINGLE_WORDS - 1), F.array(F.xxhash64(words))
        ).otherwise(bind(hashes_of(words), lambda h: windows(h, SHINGLE_WORDS)))

    return bind(words_of(text), of_words)


def _votes(word: int) -> list[Column]:
    term = F.col("__term") if word == 0 else F.xxhash64("__term", F.lit(word))
    return [
        F.sum(F.shiftrightunsigned(term, i).bitwiseAND(F.lit(LANES))).alias(f"__v{word}_{i}")
        for i in range(32)
    ]


def _bits(word: int) -> Column:
    """Bit i is set if more than half of the weight votes for it."""
    out = F.lit(0).cast("long")
    for i in range(32):
        votes = F.col(f"__v{word}_{i}")
        low, high = votes.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(votes, 32)
        for bit, count in ((i, low), (i + 32, high)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            chosen = F.when(2 * count > F.col("__n"), F.lit(value).cast("long"))
            out = out.bitwiseOR(F.coalesce(chosen, F.lit(0).cast("long")))
    return out


def fingerprint(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys``, ``f0``, ``f1``: the fingerprint of ``text``, votes added up over equal keys.

    A text without words has all bits zero, as has any bit on which the votes are even.
    """
    return (
        df.select(*keys, F.explode_outer(term_hashes(text)).alias("__term"))
        .groupBy(*keys)
        .agg(F.count("__term").alias("__n"), *_votes(0), *_votes(1))
        .select(*keys, *[_bits(i).alias(name) for i, name in enumerate(WORDS64)])
    )


def distance_of(left0: str, left1: str, right0: str, right1: str) -> Column:
    """Differing bits of two fingerprints, given by their columns."""
    return F.bit_count(F.col(left0).bitwiseXOR(F.col(right0))) + F.bit_count(
        F.col(left1).bitwiseXOR(F.col(right1))
    )


def distance(left: str, right: str) -> Column:
    """Differing bits of two fingerprints, given by the prefixes of their columns."""
    return distance_of(*[f"{side}{name}" for side in (left, right) for name in WORDS64])


def widths(blocks: int) -> list[tuple[str, int, int]]:
    """Word, first bit and width of each block; half of the blocks lie in either word."""
    per_word = blocks // 2
    ends = [64 * i // per_word for i in range(per_word + 1)]
    return [(w, a, b - a) for w in WORDS64 for a, b in zip(ends, ends[1:])]


def probes_of(width: int, errors: int) -> int:
    return sum(math.comb(width, k) for k in range(errors + 1))


def choose_blocks(size: int, radius: int) -> int:
    """The number of blocks with the least work for each query over ``size`` fingerprints.

    Of m blocks one has at most ``radius // m`` differing bits, so a query looks up all values with
    so few bits changed. Wide blocks mean many lookups, narrow ones many fingerprints for
    each. The choice has no influence on what is found.
    """

    def work(blocks: int) -> float:
        errors = radius // blocks
        return sum(
            probes_of(w, errors) * (LOOKUP + size / 2**w) for _, _, w in widths(blocks)
        )

    possible = [
        m for m in range(2, 65, 2)
        if max(probes_of(w, radius // m) for _, _, w in widths(m)) <= MOST_PROBES
    ]
    return min(possible, key=work)


def _masks(width: int, errors: int) -> list[int]:
    return [
        sum(1 << i for i in bits)
        for k in range(errors + 1)
        for bits in itertools.combinations(range(width), k)
    ]


def _block_values(blocks: int) -> Column:
    """For every block its number and its bits: the leading bits of a permuted fingerprint."""
    parts = []
    for i, (word, first, width) in enumerate(widths(blocks)):
        value = F.shiftrightunsigned(F.col(word), first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        parts.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
    return F.array(*parts)


def _changed(blocks: int, errors: int) -> Column:
    """The values that each block of a query may have in a fingerprint within the radius."""
    masks: dict[int, Column] = {}
    for _, _, width in widths(blocks):
        if width not in masks:
            listed = [F.lit(m).cast("long") for m in _masks(width, errors)]
            masks[width] = F.array(*listed)
    values = _block_values(blocks)

    def with_masks(block: Column, width: int) -> Column:
        return F.transform(
            masks[width],
            lambda m: F.struct(
                block["block"].alias("block"), block["value"].bitwiseXOR(m).alias("value")
            ),
        )

    return F.flatten(
        F.array(*[with_masks(F.get(values, F.lit(i)), w) for i, (_, _, w) in enumerate(widths(blocks))])
    )


def _first_block(blocks: int, errors: int) -> Column:
    """The first block in which two fingerprints differ by ``errors`` bits at most: a pair is found in
    several blocks, and counts there."""
    found = F.lit(None).cast("int")
    for i, (word, first, width) in reversed(list(enumerate(widths(blocks)))):
        bits = F.shiftrightunsigned(F.col(f"q{word}").bitwiseXOR(F.col(word)), first)
        if width < 64:
            bits = bits.bitwiseAND(F.lit((1 << width) - 1))
        found = F.when(F.bit_count(bits) <= errors, F.lit(i)).otherwise(found)
    return found


def within_radius(all_prints: DataFrame, queries: DataFrame, radius: int = 6) -> DataFrame:
    """All pairs (``q0 q1``, ``f0 f1``, ``distance``) of distinct fingerprints within ``radius``.

    Every block of bits has a table of all fingerprints by its value, and a query looks up there
    whatever value a fingerprint within the radius must have in one of the blocks at least; what is
    found is compared in full. So nothing is missed at any radius. The values of a block that
    very many fingerprints share are split over tasks.
    """
    left = settle(all_prints.select(*WORDS64).distinct())
    right = queries.select(F.col("f0").alias("qf0"), F.col("f1").alias("qf1")).distinct()
    blocks = choose_blocks(max(left.count(), 1), radius)
    key = ["block", "value"]
    tables = left.select(*WORDS64, F.explode(_block_values(blocks)).alias("__b")).select(
        *WORDS64, "__b.block", "__b.value"
    )
    lookups = right.select(
        F.col("qf0").alias("f0"), F.col("qf1").alias("f1")
    ).select(*WORDS64, F.explode(_changed(blocks, radius // blocks)).alias("__b")).select(
        F.col("f0").alias("qf0"), F.col("f1").alias("qf1"), "__b.block", "__b.value"
    )
    parts = F.ceil(F.col("n") / HOT_VALUE).cast("int")
    hot = settle(  # few: each stands for HOT_VALUE fingerprints
        tables.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_VALUE)
        .select(*key, parts.alias("parts"))
    )
    of_parts = F.coalesce("parts", F.lit(1))
    spread = tables.join(hot, key, "left").select(
        *key, *WORDS64, F.pmod(F.xxhash64(*WORDS64), of_parts).cast("int").alias("part")
    )
    asked = lookups.join(hot, key, "left").select(
        *key, "qf0", "qf1", F.explode(F.sequence(F.lit(0), of_parts - 1)).alias("part")
    )
    same = [spread[c] == asked[c] for c in (*key, "part")]
    near = functools.reduce(Column.__and__, same) & (distance("q", "") <= radius)
    first = _first_block(blocks, radius // blocks) == spread["block"]
    # Sizes are guessed from before the lookups are listed, so the join is told to shuffle.
    return spread.hint("merge").join(asked.hint("merge"), near & first).select(
        F.col("qf0").alias("q0"),
        F.col("qf1").alias("q1"),
        *WORDS64,
        distance("q", "").alias("distance"),
    )


# Rows are brought together by a struct that holds their id, as structs of nulls are equal. The
# tables below are partitioned by it once, and what follows keeps that partitioning.
KEY = "__key"


def following(rows: DataFrame) -> DataFrame:
    """``__key``, ``__next``, ``__half``: each key, the next larger one (after the last the first)
    and how many characters of that one its texts want at most. Null is the smallest id."""
    half = F.floor(F.length("text") / 2).cast("int")
    keys = settle(rows.groupBy(KEY).agg(F.max(half).alias("__half")))
    ranked = settle(with_rank(keys, [F.col(KEY).asc()]))
    after = ranked.select(F.col(KEY).alias("__next"), F.col("rank").alias("__rank"))
    wanted = (F.col("rank") % F.col("rank_total")) + 1
    return settle(
        ranked.withColumn("__rank", wanted).join(after, "__rank").select(KEY, "__next", "__half")
    )


def edited_texts(rows: DataFrame, follows: DataFrame) -> DataFrame:
    """Adds ``edited`` and ``__next`` to rows with ``__key`` and ``text``.

    The last ``floor(n / 2)`` code points give way to the first as many of the document that
    ``follows`` names (or all, if it is shorter). Where rows share an id, the text with the least
    digest stands for it as the next one; each row has its own edited text.
    """
    wanted = follows.select(F.col("__next").alias(KEY), F.col(KEY).alias("__of"), "__half")
    head = F.struct(
        F.sha2("text", 256).alias("sha256"),
        F.substring("text", F.lit(1), F.col("__half")).alias("head"),
    )
    heads = (
        rows.join(wanted, KEY)
        .groupBy(F.col("__of").alias(KEY), F.col(KEY).alias("__next"))
        .agg(F.min(head)["head"].alias("__head"))
    )
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - half),
        F.substring("__head", F.lit(1), half),
    )
    return rows.join(heads, KEY).withColumn("edited", edited)


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars``, ``edited_sha256``, both fingerprints (``f0 f1`` and
    ``e0 e1``), ``near_edited`` and ``near_next``.

    Likeness is the share of equal bits. Null text is empty; repeated rows are compared each.
    """
    rows = df.select(
        F.struct(F.col(id_col).alias("id")).alias(KEY),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    keys = [KEY, "__next", "__row", "n_chars", "sha256", "edited_sha256"]
    both = (
        edited_texts(rows, following(rows))
        .withColumns(
            {
                "__row": F.monotonically_increasing_id(),
                "n_chars": F.length("text").cast("long"),
                "sha256": F.sha2("text", 256),
                "edited_sha256": F.sha2("edited", 256),
            }
        )
        .select(*keys, F.posexplode(F.array("text", "edited")).alias("__which", "text"))
    )
    prints = fingerprint(both, [*keys, "__which"], F.col("text"))
    sides = [
        F.max(F.when(F.col("__which") == side, F.col(name))).alias(f"{to}{name}")
        for side, to in ((0, ""), (1, "e"))
        for name in WORDS64
    ]
    known = settle(prints.groupBy(*keys).agg(*sides))
    of_next = known.groupBy(F.col(KEY).alias("__next")).agg(
        F.min(F.struct("sha256", *WORDS64)).alias("__first")
    )
    of_next = of_next.select(
        "__next", *[F.col(f"__first.{name}").alias(f"n{name}") for name in WORDS64]
    )
    bits = 64 * len(WORDS64)
    return (
        known.join(of_next, "__next")
        .withColumn("near_edited", 1 - distance("", "e") / F.lit(bits))
        .withColumn("near_next", 1 - distance("", "n") / F.lit(bits))
        .select(F.col(f"{KEY}.id").alias(id_col), "n_chars", "edited_sha256", *WORDS64,
                *[F.col(f"e{name}").alias(f"e{name[1]}") for name in WORDS64],
                "near_edited", "near_next")
    )


def as_text(first: str, second: str) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.col(c))), 16, "0") for c in (first, second)])


def near_counts(
    known: DataFrame, id_col: str = "doc_id", every: int = 100, radius: int = NEAR_RADIUS
) -> DataFrame:
    """``f0``, ``f1``, ``n_near``: for the fingerprints of ids divisible by ``every``, the number
    of documents within ``radius``, the document itself included."""
    counted = known.groupBy(*WORDS64).agg(F.count("*").alias("__n"))
    queries = known.where(F.col(id_col) % every == 0)
    return (
        within_radius(counted, queries, radius)
        .join(counted, list(WORDS64))
        .groupBy(F.col("q0").alias("f0"), F.col("q1").alias("f1"))
        .agg(F.sum("__n").alias("n_near"))
    )
