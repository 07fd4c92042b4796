"""Preference pairs as prompt and masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.operators.ordering import with_rank
from clientela.session import settle

# The markers of the chat template.
START, END = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<role:string,text:string>>"


def _clean(text: Column) -> Column:
    """Text in which no marker of the template can occur."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def segments(turns: Column) -> Column:
    """Rendered turns as (text, trained) in order: only what an assistant says, and the marker that
    ends it, is trained on."""

    def of_turn(turn: Column) -> Column:
        role = F.coalesce(turn["role"], F.lit("user"))
        head = F.concat(F.lit(START), _clean(role), F.lit("\n"))
        said = F.concat(_clean(turn["text"]), F.lit(END))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("trained")),
            F.struct(said.alias("text"), (role == "assistant").alias("trained")),
            F.struct(F.lit("\n").alias("text"), F.lit(False).alias("trained")),
        )

    return F.flatten(F.transform(turns, of_turn))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(segments(turns), lambda s: s["text"]), "")


def common_turns(left: Column, right: Column) -> Column:
    """Number of turns at the start that both conversations share, role and text alike."""
    same = F.zip_with(left, right, lambda a, b: a.eqNullSafe(b))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("long")


def format_pairs(
    df: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected"
) -> DataFrame:
    """Replaces ``chosen`` and ``rejected`` (arrays of role and text) by what training reads.

    Added: ``prompt_turns``, ``prompt`` (the longest common prefix of turns, rendered once),
    ``chosen`` and ``rejected`` (the rest of each as segments with ``trained``; the segments'
    texts joined are the completion). A null conversation has no turns; null roles are users,
    null texts are empty, and null and empty texts are still different turns. Of equal
    conversations both completions are empty; if one starts the other, its own is. Other columns
    are kept; those with the names of added ones are replaced.
    """
    none = F.array().cast(TURN)
    both = df.withColumns(
        {
            "__chosen": F.coalesce(F.col(chosen_col).cast(TURN), none),
            "__rejected": F.coalesce(F.col(rejected_col).cast(TURN), none),
        }
    ).drop(chosen_col, rejected_col)
    shared = both.withColumn("prompt_turns", common_turns(F.col("__chosen"), F.col("__rejected")))

    def rest(name: str) -> Column:
        turns = F.col(name)
        start = F.col("prompt_turns") + 1
        left = F.greatest(F.size(turns) - F.col("prompt_turns"), F.lit(0))
        return segments(F.slice(turns, start.cast("int"), left.cast("int")))

    return shared.withColumns(
        {
            "prompt": rendered(F.slice("__chosen", F.lit(1), F.col("prompt_turns").cast("int"))),
            "chosen": rest("__chosen"),
            "rejected": rest("__rejected"),
        }
    ).drop("__chosen", "__rejected")


def answer_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``chosen``, ``rejected`` from a table of turns (conv_id, turn, role, text).

    Chosen is a conversation up to its last answer of an assistant. Rejected has the last answer of
    the conversation with the next larger id instead (after the last comes the first; ids without
    an answer are passed over). Rows without a conv_id are left out; of turns with equal numbers
    the order is by role, then text. A conversation is one row, however long.
    """
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = (
        turns.where("conv_id is not null")
        .groupBy("conv_id")
        .agg(said.alias("turns"))
        .withColumn(
            "last",
            F.aggregate(
                F.transform(
                    "turns", lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0)
                ),
                F.lit(0),
                lambda a, b: F.greatest(a, b),
            ),
        )
        .where("last > 0")
    )
    plain = F.transform(
        F.slice("turns", F.lit(1), F.col("last")), lambda t: F.struct(t["role"], t["text"])
    ).cast(TURN)
    kept = settle(whole.select("conv_id", plain.alias("chosen")))
    ranked = settle(with_rank(kept.select("conv_id"), [F.col("conv_id").asc()]))
    following = ranked.select(F.col("conv_id").alias("__next"), F.col("rank").alias("__rank"))
    order = ranked.select(
        "conv_id", (F.col("rank") % F.col("rank_total") + 1).alias("__rank")
    ).join(following, "__rank")
    answers = kept.select(
        F.col("conv_id").alias("__next"), F.element_at("chosen", -1).alias("__answer")
    ).join(order, "__next").select("conv_id", "__answer")
    before = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    return kept.join(answers, "conv_id").select(
        "conv_id", "chosen", F.concat(before, F.array("__answer")).alias("rejected")
    )


def parted_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``chosen``, ``rejected`` for every conversation of a table of turns.

    Chosen is the whole conversation. Rejected goes the same way for the first ``conv_id % (n + 1)``
    of its n turns, and on with the turns behind as many of the conversation with the next larger
    id (after the last comes the first). So the two part anywhere, and either may end first.
    Rows without a conv_id are left out; null turns come first, and of turns with equal numbers the
    order is by role, then text. A conversation is one row, as its rendered text is.
    """
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = turns.where("conv_id is not null").groupBy("conv_id").agg(said.alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"], t["text"])).cast(TURN)
    kept = settle(whole.select("conv_id", plain.alias("chosen")))
    ranked = settle(with_rank(kept.select("conv_id"), [F.col("conv_id").asc()]))
    following = ranked.select(F.col("conv_id").alias("__next"), F.col("rank").alias("__rank"))
    order = ranked.select(
        "conv_id", (F.col("rank") % F.col("rank_total") + 1).alias("__rank")
    ).join(following, "__rank").select("conv_id", "__next")
    others = kept.select(F.col("conv_id").alias("__next"), F.col("chosen").alias("__other"))
    size = F.size("chosen")
    same = F.pmod(F.col("conv_id"), size + 1).cast("int")
    rest = F.slice("__other", same + 1, F.greatest(F.size("__other") - same, F.lit(0)))
    return kept.join(order, "conv_id").join(others, "__next").select(
        "conv_id", "chosen", F.concat(F.slice("chosen", F.lit(1), same), rest).alias("rejected")
    )
