"""Preference pairs of conversations as training text.

The turns that a chosen and a rejected conversation share from the start are the prompt, rendered once. What follows is
the completion of each side, with the spans to learn from: what the assistant says, and the mark that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
LEARN_FROM = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn.role, F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t.text, F.lit(END), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """Spans (start, end) of the rendered turns to learn from, in code points, end exclusive."""
    kind = "struct<at: bigint, spans: array<struct<start: bigint, end: bigint>>>"
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().alias("spans")).cast(kind)

    def add(acc, t):
        start = acc.at + F.length(_head(t))
        end = start + F.length(t.text) + len(END)
        own = F.when(t.role == LEARN_FROM, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))
        return F.struct((end + 1).alias("at"), F.concat(acc.spans, own).alias("spans"))

    return F.aggregate(turns, nothing, add, lambda acc: acc.spans)


def format_preferences(chosen: DataFrame, rejected: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """One row for each ``id_col``: n_chosen, n_rejected, n_prefix (turns), prompt, chosen, chosen_mask, rejected, rejected_mask.

    ``chosen`` and ``rejected`` have ``id_col``, turn, role, text; other columns are ignored. Turns are put in order by
    turn, then role, then text, a NULL turn first; a NULL role or text is empty; rows that repeat are one turn. Rows with
    a NULL ``id_col`` belong to no pair. A side without turns, or that ends where the other goes on, has an empty
    completion; if both are equal all is prompt. Empty tables give no rows. A conversation is one row of the result, so
    it must fit a task, as a text does.
    """
    def side(df, mark):
        return df.filter(F.col(id_col).isNotNull()).select(
            F.col(id_col).alias("pair_id"), F.lit(mark).alias("chosen"), F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    both = side(chosen, True).unionByName(side(rejected, False)).groupBy("pair_id").agg(
        F.array_sort(F.collect_set(F.struct("turn", "role", "text", "chosen"))).alias("turns"))
    sides = both.select("pair_id", F.filter("turns", lambda t: t.chosen).alias("c"), F.filter("turns", lambda t: ~t.chosen).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a.role == b.role) & (a.text == b.text), F.lit(False)))
    differ = sides.withColumn("same", same).withColumn("n_prefix", F.when(F.forall("same", lambda x: x), F.size("same")).otherwise(
        F.array_position("same", False) - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.size(c))
    parts = differ.select("pair_id", F.size("c").alias("n_chosen"), F.size("r").alias("n_rejected"), "n_prefix",
                          F.slice("c", F.lit(1), F.col("n_prefix")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select(
        F.col("pair_id").alias(id_col), "n_chosen", "n_rejected", "n_prefix", render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"),
        render(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"))


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs out of plain conversations (conv_id, turn, role, text).

    The conversation itself is chosen; in the rejected one its last answer is replaced by the last answer of the
    conversation numbered one less. Conversations without an answer, or after one without, make no pair.
    """
    answer = F.max(F.when(F.col("role") == LEARN_FROM, F.struct("turn", "text"))).alias("answer")
    last = turns.groupBy("conv_id").agg(answer).filter("answer is not null and answer.text is not null and answer.turn is not null")
    other = last.select((F.col("conv_id") + 1).alias("conv_id"), F.col("answer.text").alias("other"))
    swap = last.select("conv_id", F.col("answer.turn").alias("at")).join(other, "conv_id")
    own = turns.select("conv_id", "turn", "role", "text").join(swap, "conv_id")
    here = (F.col("turn") == F.col("at")) & (F.col("role") == LEARN_FROM)
    return own.drop("at", "other"), own.withColumn("text", F.when(here, F.col("other")).otherwise(F.col("text"))).drop("at", "other")


def digests(pairs: DataFrame, id_col: str) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",")
    return pairs.select(id_col, "n_chosen", "n_rejected", "n_prefix", *[F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")],
                        spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))
