"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (same role and text, in the same place) is
rendered once as the prompt; what follows on either side is rendered as that
side's completion.  A mask has one character per character of its completion:
``1`` where loss is taken (an assistant's text and its end mark), else ``0``.

Everything is a DataFrame expression.  A null role or text is rendered as
empty; two nulls are equal.  Equal conversations give a prompt and two empty
completions.  A null list of turns counts as no turns.  Extra columns are left
out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.tables import written
from wardlight.operators.ordering import with_previous

#: Fixed marks of the chat format.
START, STOP, BREAK = "<|im_start|>", "<|im_end|>", "\n"
TURNS = "array<struct<role:string,text:string>>"


def _opened(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit(BREAK))


def _closed(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(STOP))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_opened(t), _closed(t), F.lit(BREAK))), "")


def _mask(turns: Column) -> Column:
    def marks(t: Column) -> Column:
        own = F.when(t["role"] == "assistant", F.lit("1")).otherwise(F.lit("0"))
        return F.concat(F.repeat(F.lit("0"), F.length(_opened(t))), F.repeat(own, F.length(_closed(t))), F.lit("0"))

    return F.array_join(F.transform(turns, marks), "")


def format_pairs(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_common, prompt, completions and masks) of ``chosen`` and ``rejected`` turns."""
    none = F.array().cast(TURNS)
    sides = pairs.select(key, *[F.coalesce(F.col(c).cast(TURNS), none).alias(c) for c in ("chosen", "rejected")])
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, F.lit(False))
    counted = sides.withColumn("n_common", F.when(first > 0, first - 1).otherwise(F.size("chosen")).cast("int"))
    rest = {c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0))) for c in ("chosen", "rejected")}
    return counted.withColumns({f"{c}_rest": r for c, r in rest.items()}).select(
        key,
        "n_common",
        _text(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        *[f(F.col(f"{c}_rest")).alias(f"{c}_{n}") for c in ("chosen", "rejected") for n, f in (("completion", _text), ("mask", _mask))],
    )


def pairs_by_opening(conversations: DataFrame) -> DataFrame:
    """One pair for every conversation: (conv_id, chosen, rejected).

    Rejected is the conversation with the next lower id among those that open
    with the same user text.  Where there is none, it is the conversation itself
    with the words of its last assistant turn reversed, or, without such a
    turn, just itself.  So many conversations with one opening give a chain of
    pairs, not all pairs.  Turns are ordered by (turn, role, text); turns without
    a ``conv_id`` belong to no conversation and are left out.
    """
    order = F.struct("turn", "role", "text")
    turns = conversations.where("conv_id is not null").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen"),
        F.min(F.when(F.col("role") == "user", order)).alias("first"),
    )
    held = written(turns.select("conv_id", "chosen", F.sha2(F.coalesce("first.text", F.when(F.col("first").isNotNull(), F.lit(""))), 256).alias("opening")), "turns")
    light = held.where("opening is not null").select("conv_id", "opening")
    earlier = with_previous(light, ["opening"], ["conv_id"], "conv_id", "earlier").where("earlier is not null")
    other = held.select(F.col("conv_id").alias("earlier"), F.col("chosen").alias("rejected"))
    linked = earlier.select("conv_id", "earlier").join(other, "earlier").select("conv_id", "rejected")
    size = F.size("chosen")
    last = F.array_max(F.transform("chosen", lambda t, i: F.when(t["role"] == "assistant", i)))

    def reversed_at(t: Column, i: Column) -> Column:
        words = F.array_join(F.reverse(F.split(t["text"], " ")), " ")
        return F.struct(t["role"].alias("role"), F.when(i == last, words).otherwise(t["text"]).alias("text"))

    own = F.when(size > 0, F.transform("chosen", reversed_at))
    return held.join(linked, "conv_id", "left").select("conv_id", "chosen", F.coalesce("rejected", own).alias("rejected"))
