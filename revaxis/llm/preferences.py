"""Preference formatting: one prompt, and a masked completion for each of two conversations.

Conversations are turns ``(pair_id, turn, role, text)``. The turns that the chosen and the
rejected conversation share from their start are rendered once, as prompt; what follows on
each side is its completion. In completions the text of the assistant and its end mark
are trained on; headers and other roles are masked.

Turns are matched by pair and turn and stay rows, with one row for each rendered turn, so that
a conversation of any length is spread like others; only the first difference of each
pair is an aggregate by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The marks of the chat markup.
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
NO_ROLE = "unknown"


def turns(df: DataFrame, pair_id: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each pair and turn.

    Rows without a pair go; a null turn stands before all others. Of several rows for one turn
    the one of the smallest role and text counts, nulls first.
    """
    said = F.struct(F.col(role).isNotNull().alias("a"), F.col(role).alias("role"), F.col(text).isNotNull().alias("b"), F.col(text).alias("text"))
    rows = df.where(F.col(pair_id).isNotNull()).select(
        F.col(pair_id).alias("pair_id"), F.coalesce(F.col(turn).cast("long"), F.lit(-1 << 62)).alias("turn"), said.alias("said"))
    return rows.groupBy("pair_id", "turn").agg(F.min("said").alias("said")).select("pair_id", "turn", "said.role", "said.text")


def header(role: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit(NO_ROLE)), F.lit("\n"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(header(role), F.coalesce(text, F.lit("")), F.lit(END))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(pair_id, part, turn, segment, train_from, train_to)``, ordered by ``turn`` within a part.

    ``part`` is prompt, chosen or rejected; ``train_from`` and ``train_to`` bound the characters of
    ``segment`` that are trained on and are null where none are. A pair found on one side only
    has no prompt; equal conversations are a prompt without completions. Inputs are as
    ``turns`` gives them.
    """
    left = chosen.select("pair_id", "turn", F.struct("role", "text").alias("c"))
    right = rejected.select("pair_id", "turn", F.struct("role", "text").alias("r"))
    both = written(left.join(right, ["pair_id", "turn"], "full_outer"), "matched")
    same = F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("c.role").eqNullSafe(F.col("r.role")) & F.col("c.text").eqNullSafe(F.col("r.text"))
    first = both.where(~same).groupBy("pair_id").agg(F.min("turn").alias("differs"))
    # A turn that both share after the first difference is said by each of them.
    placed = both.join(first, "pair_id", "left")
    shared = F.col("differs").isNull() | (F.col("turn") < F.col("differs"))
    each = F.array(
        F.struct(F.lit("chosen").alias("part"), F.col("c").alias("said")), F.struct(F.lit("rejected").alias("part"), F.col("r").alias("said")))
    once = F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("said")))
    rows = placed.select("pair_id", "turn", F.explode(F.when(shared, once).otherwise(each)).alias("s")).where("s.said is not null").select(
        "pair_id", F.col("s.part").alias("part"), "turn", F.col("s.said.role").alias("role"), F.col("s.said.text").alias("text"))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)
    segment = rendered(F.col("role"), F.col("text"))
    return rows.select(
        "pair_id", "part", "turn", segment.alias("segment"),
        F.when(trained, F.length(header(F.col("role")))).cast("long").alias("train_from"),
        F.when(trained, F.length(segment)).cast("long").alias("train_to"),
    )


def whole_rows(segments: DataFrame) -> DataFrame:
    """``(pair_id, prompt, chosen, rejected)`` texts, for conversations that fit a row each."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "segment")))
    texts = segments.groupBy("pair_id", "part").agg(F.array_join(F.transform(ordered, lambda s: s["segment"]), "").alias("t"))
    parts = ("prompt", "chosen", "rejected")
    return texts.groupBy("pair_id").pivot("part", list(parts)).agg(F.first("t")).select(
        "pair_id", *(F.coalesce(p, F.lit("")).alias(p) for p in parts))


def swapped_replies(conversations: DataFrame, conv_id: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from one table.

    Chosen is a conversation up to its last assistant turn; in rejected that turn holds the last
    reply of the neighbouring conversation (ids 2i and 2i + 1), or is missing when that has none.
    Conversations without an assistant turn are the same on both sides.
    """
    # Written once: all that follows reads the turns, some of it several times.
    said = written(turns(conversations, conv_id), "turns")
    last = said.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id").agg(F.max("turn").alias("last"))
    kept = said.join(last, "pair_id", "left").where(F.col("last").isNull() | (F.col("turn") <= F.col("last")))
    replies = kept.where("turn = last").select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("text").alias("reply"))
    chosen = kept.select("pair_id", "turn", "role", "text")
    before = kept.where("last is null or turn < last").select("pair_id", "turn", "role", "text")
    answered = kept.where("turn = last").join(replies, "pair_id").select("pair_id", "turn", "role", F.col("reply").alias("text"))
    return chosen, before.unionByName(answered)
