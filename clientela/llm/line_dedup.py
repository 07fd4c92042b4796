"""Removes later copies of passages, wherever they start: seeds chosen by the hashes of words.

Each run of ``RUN_WORDS`` words belongs to one of the ``WINDOW_WORDS`` words that it begins with: the first
whose hash is very low, without one the first whose hash is low, and else the first of all. So equal runs
belong to the same of their words, and the ``GRAM_WORDS`` words from it on, a seed, are within them. The
runs of a seed lie side by side; one hash of all their words, the span, tells whether two places
of a seed agree as far as these runs reach. Where a span comes again, all its runs are cut at once. Only
where one seed has several spans, the runs of each span's first place are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.session import settle, settle_by

from .expressions import bind, free_name

RUN_WORDS = 36
WINDOW_WORDS = 27
GRAM_WORDS = RUN_WORDS - WINDOW_WORDS + 1
# Hashes below are low (one of 5) and very low (one of 14).
LOW = -(1 << 63) + (1 << 64) // 5
VERY_LOW = -(1 << 63) + (1 << 64) // 14
COPY_SALTS = 64  # over which the copies of a text are spread
WHOLE = 1 << 30  # as the last word of a run: the whole text
# A word of over 20 characters counts as several, and a character of a script without blanks as one.
WIDE = r"\x{2E80}-\x{FFEF}\x{20000}-\x{3FFFF}"
# All but white space and those; the usual ones come first, as this is the quicker form.
NARROW = r"[\x21-\x{2E7F}\x00-\x08\x0E-\x1F\x{FFF0}-\x{1FFFF}\x{40000}-\x{10FFFF}]"
WORD = rf"(?:{NARROW}{{1,19}}+(?!{NARROW})|{NARROW}{{6}}|[{WIDE}])"


def _split(text: Column, found: Column, pattern: str) -> Column:
    """What ``pattern`` finds in ``text``, given its stretches without white space, ``found``. These are
    words but for those that are long or of a script without blanks; only such are split further."""

    def exact(wide: Column) -> Column:
        def other(i: Column) -> Column:
            word = F.element_at(found, i)
            # A character of such a script takes three bytes or more.
            foreign = F.octet_length(word) > F.length(word) + 1
            return (F.octet_length(word) >= 20) | (wide & foreign)

        def stretch(ends: Column, j: Column) -> Column:
            """The words behind one end and before the next, and the words of that."""
            start, end = F.get(ends, j - 1), F.get(ends, j)
            # Nothing comes behind the last word.
            word = F.coalesce(F.get(found, end - 1), F.lit(""))
            parts = F.regexp_extract_all(word, F.lit(pattern), F.lit(0))
            return F.concat(F.slice(found, start + 1, end - start - 1), parts)

        ends = F.concat(
            F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size(found)), other),
            F.array(F.size(found) + 1),
        )
        return bind(ends, lambda x: F.flatten(
            F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda j: stretch(x, j))))

    def words(wide: Column) -> Column:
        odd = wide | F.exists(found, lambda w: F.octet_length(w) >= 20)
        return F.when(odd, exact(wide)).otherwise(found)

    wide = (F.octet_length(text) > F.length(text)) & text.rlike(f"[{WIDE}]")
    # The empty text has no words.
    return F.when(text == "", F.array().cast("array<string>")).otherwise(bind(wide, words))


def words_with_space(text: Column) -> Column:
    """Words with the white space behind them; joined they are the text again."""
    found = F.regexp_extract_all(text, F.lit(r"^\s+|\S+\s*"), F.lit(0))
    return bind(found, lambda x: _split(text, x, rf"^\s+|{WORD}\s*"))


def word_hashes(text: Column) -> Column:
    """A hash for each of ``words_with_space``; white space does not count."""

    def ended(found: Column) -> Column:
        # White space at the start counts as a word, at the end it does not.
        blank = (F.size(found) > 1) & (F.element_at(found, -1) == "")
        return F.when(blank, F.slice(found, 1, F.size(found) - 1)).otherwise(found)

    found = bind(F.split(text, r"[ \t\n\x0B\f\r]+"), ended)
    return F.transform(bind(found, lambda x: _split(text, x, WORD)), lambda x: F.xxhash64(x))


def later_copies(texts: DataFrame) -> DataFrame:
    """``id``: of documents with the very text, by its digest ``key``, of an earlier one. An id with several
    rows is none."""
    keys = texts.select("id", "key")
    first = (
        keys.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))).alias("salt"))
    )
    salt = F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int").alias("salt")
    later = (
        keys.select("id", "key", salt).join(first, ["key", "salt"]).where("id > first").select("id")
    )
    single = keys.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    return later.join(single, "id", "left_semi")


def _seeds(hashes: Column) -> Column:
    """Structs ``at`` (word, from 1), ``after``, ``until``: the seeds of a text. The runs of a seed start after
    the one word, up to the other, and have the seed within their first words."""
    places = "array<struct<at:int,after:int,until:int>>"
    last = F.size(hashes) - (RUN_WORDS - 1)

    def seed(at: Column, after: Column, until: Column) -> Column:
        return F.struct(at.alias("at"), after.alias("after"), until.alias("until"))

    def among(count: Column) -> Column:
        return F.sequence(F.lit(1), count - 1)

    def of(low: Column, very_low: Column) -> Column:
        """``low``: words, ``very_low``: indexes of those; each with one before and one behind all windows."""

        def end(j: Column) -> Column:
            return F.get(low, F.get(very_low, j))

        def lows(j: Column) -> Column:
            return F.transform(
                F.sequence(F.get(very_low, j - 1) + 1, F.get(very_low, j) - 1),
                lambda i: seed(F.get(low, i), F.get(low, i - 1), end(j) - WINDOW_WORDS),
            )

        def bare(i: Column) -> Column:
            starts = F.sequence(F.get(low, i - 1) + 1, F.get(low, i) - WINDOW_WORDS)
            return F.transform(starts, lambda at: seed(at, at - 1, at))

        free = F.filter(
            among(F.size(very_low)),
            lambda j: (end(j) - end(j - 1) > WINDOW_WORDS)
            & (F.get(very_low, j) - F.get(very_low, j - 1) > 1),
        )
        empty = F.filter(
            among(F.size(low)), lambda i: F.get(low, i) - F.get(low, i - 1) > WINDOW_WORDS
        )
        return F.concat(
            F.transform(among(F.size(very_low)), lambda j: seed(end(j), end(j - 1), last)),
            F.flatten(F.transform(free, lows)),
            F.flatten(F.transform(empty, bare)),
        )

    behind = last + WINDOW_WORDS
    low = F.filter(F.sequence(F.lit(1), behind - 1), lambda at: F.element_at(hashes, at) < F.lit(LOW))

    def chosen(x: Column) -> Column:
        # Word 0, and the one behind, have no hash.
        inner = F.filter(
            among(F.size(x)), lambda i: F.get(hashes, F.get(x, i) - 1) < F.lit(VERY_LOW)
        )
        return F.array_distinct(F.concat(F.array(F.lit(0)), inner, F.array(F.size(x) - 1)))

    found = bind(
        F.concat(F.array(F.lit(0)), low, F.array(behind)),
        lambda x: bind(chosen(x), lambda y: of(x, y)),
    )
    return F.when(last > 0, found).otherwise(F.array().cast(places))


def _each(df: DataFrame, items: Column) -> DataFrame:
    """``id``, ``__h`` and an item as ``__x`` for each of ``items``. As rows, not within a lambda, they are worked
    on by generated code."""
    # The outer form spares the check that there are any, which would work the items out twice.
    rows = df.select("id", "__h", items.alias("__x")).select("id", "__h", F.explode_outer("__x").alias("__x"))
    return rows.where(F.col("__x").isNotNull())


def fingerprints(df: DataFrame) -> DataFrame:
    """``gram``, ``id``, ``at`` (word, from 1): the seeds of each document. The runs that belong
    to a seed start at the words ``first`` to ``end``; ``span`` is the hash of all their words and
    of the seed's place in them."""
    hashed = df.select("id", word_hashes(F.col("text")).alias("__h"))
    at = F.col("__x.at")
    seeds = _each(hashed, _seeds(F.col("__h"))).select(
        "id", "__h", at,
        F.greatest(F.col("__x.after") + 1, at - (WINDOW_WORDS - 1)).alias("first"),
        F.least(at, F.col("__x.until")).alias("end"),
    ).where("first <= end")
    words = F.slice("__h", F.col("first"), F.col("end") - F.col("first") + RUN_WORDS)
    return seeds.select(
        F.xxhash64(F.slice("__h", F.col("at"), GRAM_WORDS)).alias("gram"), "id", "at", "first", "end",
        F.xxhash64(words, F.col("at") - F.col("first")).alias("span"),
    )


def shared_spans(seeds: DataFrame) -> DataFrame:
    """``id``, ``first``, ``end``, ``single``: runs of seeds that occur more than once. Those of a span
    that came earlier are to be cut; those that are ``single`` are to be compared one by one."""
    gram = Window.partitionBy("gram")
    span = Window.partitionBy("gram", "span")
    several = seeds.select(
        "*", F.count("*").over(gram).alias("n"),
        (F.min("span").over(gram) < F.max("span").over(gram)).alias("mixed"),
    ).where("n > 1")
    known = several.withColumn("first_id", F.min("id").over(span)).withColumn(
        "first_at", F.min(F.when(F.col("id") == F.col("first_id"), F.col("at"))).over(span)
    )
    here = F.col("id") == F.col("first_id")
    # Within a document a run must not reach into its own first place.
    apart = F.col("at") - F.col("first_at")
    clear = F.when(here, F.greatest(RUN_WORDS - apart, F.lit(0))).otherwise(0)
    single = F.col("mixed") & here
    return known.where(single | ~here | (apart > 0)).select(
        "id", (F.col("first") + F.when(single, 0).otherwise(clear)).alias("first"), "end",
        single.alias("single"),
    )


def _place(order: Column) -> Column:
    """Document and word as one number, for a minimum that is kept in place."""
    return order.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("at")


def _runs_in(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``gram``, ``id``, ``at``: all runs of ``RUN_WORDS`` words that start from ``first`` to ``end``."""
    places = spans.groupBy("id").agg(F.collect_list(F.struct("first", "end")).alias("spans"))

    def starts(x: Column) -> Column:
        end = F.least(x["end"], F.size("__h") - (RUN_WORDS - 1))
        return F.when(x["first"] <= end, F.sequence(x["first"], end)).otherwise(
            F.array().cast("array<int>")
        )

    hashed = texts.join(places.hint("shuffle_hash"), "id").select(
        "id", "spans", word_hashes(F.col("text")).alias("__h")
    )
    found = _each(hashed, F.flatten(F.transform("spans", starts)))
    return found.select(
        F.xxhash64(F.slice("__h", F.col("__x"), RUN_WORDS)).alias("gram"), "id", F.col("__x").alias("at")
    )


def repeated_runs(texts: DataFrame) -> DataFrame:
    """``id``, ``cut``: for documents with later copies of passages, the runs of words to cut, as
    sorted and separate structs (``first``, ``last``), words from 1. Where the whole text is a later
    copy, the run ends at ``WHOLE``. ``texts`` has ``id``, ``text`` and the digest of this, ``key``."""
    # All runs of a later copy are in the first one, so they need not be compared.
    later = settle(later_copies(texts))
    compared = texts.join(later.hint("shuffle_hash"), "id", "left_anti")
    shared = settle(shared_spans(fingerprints(compared)))
    # Dealt by gram once, for the first places as for all.
    found = _runs_in(texts, shared.where("single")).repartition("gram")
    first = (
        found.groupBy("gram")
        .agg(F.min(_place(F.col("id"))).alias("__first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("gram", "__first")
    )
    ahead = F.col("__first") + RUN_WORDS - _place(F.col("id"))
    # Within a document a run must not reach into its own first place.
    clear = F.col("at") + F.when(ahead.between(1, RUN_WORDS), ahead.cast("int")).otherwise(0)
    runs = (
        found.join(first.hint("shuffle_hash"), "gram")
        .where(_place(F.col("id")) > F.col("__first"))
        .select("id", clear.alias("first"), (F.col("at") + (RUN_WORDS - 1)).alias("last"))
        .where("first <= last")
        .unionByName(shared.where("not single").select(
            "id", "first", (F.col("end") + (RUN_WORDS - 1)).alias("last")))
    )
    whole = later.select("id", F.array(F.struct(F.lit(1).alias("first"), F.lit(WHOLE).alias("last"))).alias("cut"))
    so_far = Window.partitionBy("id").orderBy("first", "last")
    earlier = F.max("last").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("first") > F.coalesce(earlier + 1, F.lit(-1))).cast("int")
    islands = (
        runs.withColumn("apart", apart)
        .withColumn("island", F.sum("apart").over(so_far))
        .groupBy("id", "island")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cut"))
    )
    return islands.unionByName(whole)


def without_runs(text: Column, cut: Column) -> Column:
    """The text without the given runs of words."""

    def joined(words: Column) -> Column:
        def stretch(k: Column) -> Column:
            start = F.coalesce(F.get(cut, k - 1)["last"] + 1, F.lit(1))
            end = F.coalesce(F.get(cut, k)["first"] - 1, F.size(words))
            return F.slice(words, start, F.greatest(end - start + 1, F.lit(0)))

        kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), stretch))
        # A whole copy of fewer words than a run stays.
        short = whole & (F.size(words) < RUN_WORDS)
        return F.when(short, text).otherwise(F.array_join(kept, ""))

    whole = F.get(cut, F.lit(0))["last"] == WHOLE
    # Stretches without white space have a word each, at the least; the last may be empty.
    enough = F.size(F.split(text, r"\s+", RUN_WORDS + 2)) > RUN_WORDS + 1
    return F.when(cut.isNull(), text).when(whole & enough, "").otherwise(
        bind(words_with_space(text), joined)
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, later copies of passages cut from ``text_col``; adds ``n_cut``, the
    characters cut.

    A passage is ``RUN_WORDS`` words or more, wherever it starts and ends. Documents come in the
    order of their integer ids, words in the order of the text; a passage stays where it first
    occurs, in another document or the same. Texts without such a copy are unchanged, null texts
    too. Rows without an id are not cut, nor are others cut for them. Rows that share an id count
    as one place: they are cut where any of them would be, if their text has these words. An empty
    table gives an empty table.
    """
    key, cut, new, digest = (free_name(df, c) for c in ("__id", "__cut", "__new", "__digest"))
    text = F.col(text_col)
    # Stored by id, the texts need no shuffle in any of the joins.
    df = settle_by(df.withColumn(digest, F.unhex(F.md5(text.cast("binary")))), id_col)
    texts = df.where(F.col(digest).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), text.alias("text"), F.col(digest).alias("key")
    )
    df = df.drop(digest)
    runs = repeated_runs(texts).withColumnsRenamed({"id": key, "cut": cut})
    with_id = df.where(F.col(id_col).isNotNull())
    return (
        with_id.join(runs.hint("shuffle_hash"), F.col(id_col) == F.col(key), "left")
        .withColumn(new, without_runs(text, F.col(cut)))
        .withColumn("n_cut", (F.length(text) - F.length(new)).cast("long"))
        .withColumn(text_col, F.col(new))
        .drop(key, cut, new)
        .unionAll(df.where(F.col(id_col).isNull()).withColumn("n_cut", (F.length(text) * 0).cast("long")))
    )
