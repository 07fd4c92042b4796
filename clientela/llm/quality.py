"""Quality rules whose cutoffs keep the false rejection of good documents under a stated risk.

Each rule compares one figure of a document with a cutoff. In every stratum, cutoffs are tried from
the mildest to the strictest against labelled good documents: a cutoff stands if so few of them
lie beyond it that, were the true rate of rejection above the rule's share of the risk, this few
would be seen with a probability of at most the test's share of the error. That is the exact
binomial test. Shares are corrected for the number of rules and strata; within a sequence, testing
stops at the first cutoff that fails, which needs no correction.

Where a stratum has too few labelled documents for any rule to stand by its share, the rules are
tested together along one sequence: rule after rule, from mild to strict, each step with the
cutoffs before it in force. What all of them reject is held against the whole risk, and the error
is shared by the strata only. Which of the two applies depends on the number of labels alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.session import settle

from .expressions import bind, hashes_of, windows, words_of

SYMBOLS = "[#*$%&|<>]"
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Rejects where ``figure`` is above (or below) a cutoff; cutoffs from mild to strict."""

    name: str
    figure: str
    cutoffs: tuple[float, ...]
    above: bool = True


# Grids are fixed beforehand, so that the labelled documents serve for the test alone.
RULES = (
    Rule("symbols", "try_divide(n_symbols, n_words)", (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    Rule("long_words", "try_divide(word_chars, n_words)", (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0)),
    Rule("short_words", "try_divide(word_chars, n_words)", (1.5, 2.0, 2.5, 3.0, 3.5, 4.0), above=False),
    Rule("lines", "try_divide(n_dup_lines, n_lines)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("repeats", "try_divide(n_repeat_words, n_words)", (0.28, 0.25, 0.2, 0.15, 0.1)),
)


def repeated_positions(hashes: Column) -> Column:
    """How many places (of ``REPEAT_WINDOW`` each) hold a run that occurs more than once."""
    runs = windows(hashes, REPEAT_WINDOW)

    def covered(found: Column) -> Column:
        placed = F.array_sort(
            F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        )

        def several(order: Column) -> Column:
            def same(x: Column, other: Column) -> Column:
                return F.coalesce(F.get(order, other)["h"] == x["h"], F.lit(False))

            kept = F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(kept, lambda x: x["at"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        return F.aggregate(
            bind(placed, several),
            start,
            lambda acc, at: F.struct(
                (at + REPEAT_WINDOW).alias("end"),
                (acc["total"] + at + REPEAT_WINDOW - F.greatest(acc["end"], at)).alias("total"),
            ),
            lambda acc: acc["total"],
        )

    return bind(
        runs,
        lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(
            covered(found)
        ),
    )


def figures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long each).

    Words are maximal runs without separators. A null or empty text has none of anything. Columns
    of these names that are already there are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            bind(hashes_of(words), repeated_positions).cast("long").alias("n_repeat_words"),
        )

    def of_lines(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        )

    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    found = {
        "__words": bind(words_of(F.col(text_col)), of_words),
        "__lines": bind(lines, of_lines),
        "n_symbols": symbols.cast("long"),
    }
    return df.withColumns(found).withColumns(
        {
            "n_words": F.col("__words.n_words"),
            "word_chars": F.col("__words.word_chars"),
            "n_lines": F.col("__lines.n_lines"),
            "n_dup_lines": F.col("__lines.n_dup_lines"),
            "n_repeat_words": F.col("__words.n_repeat_words"),
        }
    ).drop("__words", "__lines")


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def lower_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial X, summed term by term in logarithms; k up to n * p."""
    step = math.log(p) - math.log1p(-p)
    start = F.struct(
        (n * F.lit(math.log1p(-p))).alias("term"), F.lit(float("-inf")).alias("total")
    )

    def add(acc: Column, j: Column) -> Column:
        larger = F.greatest(acc["total"], acc["term"])
        smaller = F.least(acc["total"], acc["term"])
        return F.struct(
            (acc["term"] + F.log((n - j) / (j + 1)) + F.lit(step)).alias("term"),
            (larger + F.log1p(F.exp(smaller - larger))).alias("total"),
        )

    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, add, lambda a: F.exp(a["total"]))


def _beyond(rule: Rule, cutoff: Column) -> Column:
    figure = F.expr(rule.figure)
    return (figure > cutoff) if rule.above else (figure < cutoff)


def cutoffs(
    holdout: DataFrame, strata: Column, rules: tuple[Rule, ...] = RULES, risk: float = 0.02,
    error: float = 0.05,
) -> DataFrame:
    """The strictest cutoff that stands, for each stratum and rule: stratum, rule, cutoff.

    ``holdout``: figures of labelled good documents that pass the base rules. ``risk`` bounds the
    rate at which all rules together reject good documents of a stratum, with probability
    ``1 - error`` over all strata. A rule without a cutoff that stands has no row. The result has
    one row for each stratum and rule.

    Two tests are made in every stratum, whatever its size, each with half of the error. One adds
    the cutoffs of all rules in one fixed order and bounds what they reject together; it ends at
    the first that fails. The other gives each rule an equal share of the risk, and ends for each
    by itself. Both hold at once, so the one under which more rules stand is taken (the first
    if equal). No cutoff stands in a stratum of fewer than
    ``log(error / 2 / strata) / log(1 - risk)`` documents.
    """
    steps, before = [], F.lit(False)
    for at, rule in enumerate(rules):
        for i, cutoff in enumerate(rule.cutoffs):
            alone = F.coalesce(_beyond(rule, F.lit(cutoff)), F.lit(False))
            steps.append(
                F.struct(
                    F.lit(rule.name).alias("rule"),
                    F.lit(at).alias("at"),
                    F.lit(i).alias("strictness"),
                    F.lit(cutoff).alias("cutoff"),
                    alone.cast("long").alias("rejected"),
                    (before | alone).cast("long").alias("rejected_by_all"),
                )
            )
        before = before | alone  # a rule's strictest cutoff rejects what the others do
    counts = (
        holdout.select(strata.alias("stratum"), F.explode(F.array(*steps)).alias("t"))
        .groupBy("stratum", "t.rule", "t.at", "t.strictness", "t.cutoff")
        .agg(
            F.count("*").alias("n"),
            F.sum("t.rejected").alias("k"),
            F.sum("t.rejected_by_all").alias("k_all"),
        )
    )
    share = risk / len(rules)
    number = max(holdout.select(strata.alias("stratum")).distinct().count(), 1)
    level = error / 2 / len(rules) / number

    def stands(k: Column, rate: float, at_most: float) -> Column:
        likely = k <= F.col("n") * rate
        return likely & (F.when(likely, lower_tail(F.col("n"), k, rate)) <= at_most)

    in_order = Window.partitionBy("stratum").orderBy("at", "strictness")
    in_rule = Window.partitionBy("stratum", "at").orderBy("strictness")
    in_stratum = Window.partitionBy("stratum")  # a row for each rule and cutoff
    tests = {
        "together": F.min(stands(F.col("k_all"), risk, error / 2 / number)).over(in_order),
        "apart": F.min(stands(F.col("k"), share, level)).over(in_rule),
    }
    tested = counts.withColumns(tests)
    standing = {
        name: F.sum((F.col(name) & (F.col("strictness") == 0)).cast("int")).over(in_stratum)
        for name in tests
    }
    better = standing["apart"] > standing["together"]
    return (
        tested.withColumn("passes", F.when(better, F.col("apart")).otherwise(F.col("together")))
        .groupBy("stratum", "rule")
        .agg(
            F.collect_list(F.struct("strictness", "cutoff", "passes")).alias("tried"),
        )
        .select(
            "stratum",
            "rule",
            F.aggregate(
                F.array_sort("tried"),
                F.struct(F.lit(True).alias("on"), F.lit(None).cast("double").alias("cutoff")),
                lambda acc, t: F.struct(
                    (acc["on"] & t["passes"]).alias("on"),
                    F.when(acc["on"] & t["passes"], t["cutoff"])
                    .otherwise(acc["cutoff"])
                    .alias("cutoff"),
                ),
                lambda acc: acc["cutoff"],
            ).alias("cutoff"),
        )
        .where("cutoff is not null")
    )


def judge(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    stratum_col: str = "lang", rules: tuple[Rule, ...] = RULES, risk: float = 0.02,
    error: float = 0.05,
) -> DataFrame:
    """One row per document: id, the figures, base_failed and kept.

    Good documents are those with any label of quality 1; labels without id or quality, and
    labels of unknown documents, count for nothing. A null stratum is a stratum of its own. Without
    enough labelled documents no cutoff stands, and only the base rules reject. Rows with repeated
    or null ids are judged one by one. Figures are settled once and read three times.
    """
    columns = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("__stratum")
    known = settle(
        figures(df.select(id_col, F.col(text_col).alias("__text"), stratum), "__text")
        .select(id_col, "__stratum", *columns)
        .withColumn("base_failed", base_failed())
    )
    good = labels.where("quality = 1").select(F.col("doc_id").alias(id_col)).distinct()
    holdout = known.where("not base_failed").join(good, id_col, "left_semi")
    standing = cutoffs(holdout, F.col("__stratum"), rules, risk, error).groupBy(
        F.col("stratum").alias("__stratum")
    )
    wide = standing.agg(
        *[
            F.max(F.when(F.col("rule") == rule.name, F.col("cutoff"))).alias(f"__{rule.name}")
            for rule in rules
        ]
    )
    # One row for each stratum; as a stored table its size is known, and documents of a common
    # stratum need not meet in one task.
    wide = settle(wide)
    rejected = F.lit(False)
    for rule in rules:
        rejected = rejected | F.coalesce(_beyond(rule, F.col(f"__{rule.name}")), F.lit(False))
    return (
        known.join(wide, "__stratum", "left")
        .withColumn("kept", ~F.col("base_failed") & ~rejected)
        .drop("__stratum", *[f"__{rule.name}" for rule in rules])
    )
