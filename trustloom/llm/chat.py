"""Preference examples from pairs of conversations: the shared turns once as prompt, the rest as two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What stands around a turn, and the role whose words are learned.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED = "assistant"


def gathered(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``conv, turns`` per conversation: its turns as structs (turn, role, text) in order of turn, then role, then text."""
    return turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def shared(a: str, b: str) -> Column:
    """How many turns two arrays of turns have in common from the start (same role and text; the numbers do not count)."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"])
                      & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("long")


def _role(t):
    return F.coalesce(t["role"], F.lit(""))


def _head(t):
    return F.concat(F.lit(OPEN), _role(t), F.lit(BREAK))


def _body(t):
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def masked(turns: Column) -> Column:
    """Per turn, how many characters carry no loss and how many that follow do: what the learned role says and its end."""
    return F.transform(turns, lambda t: F.struct(
        F.when(_role(t) == LEARNED, F.length(_head(t))).otherwise(F.length(_head(t)) + F.length(_body(t))).alias("skip"),
        F.when(_role(t) == LEARNED, F.length(_body(t))).otherwise(0).alias("learn")))


def preferences(turns: DataFrame, pairs: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask`` per row of ``pairs``.

    ``turns`` has the columns turn, role and text besides the id; ``pairs`` has ``chosen_id`` and ``rejected_id``. The prompt
    is the longest common prefix of the two conversations, the completions are what follows (empty if nothing does). Masks
    hold (skip, learn) per turn of a completion. A null role or text is rendered as empty. Turns with equal numbers are
    ordered by role and text; repeated rows are turns of their own. Rows without a conversation id belong to no pair. An id
    without turns (or null) gives null for its completion and mask, and an empty prompt.
    """
    convs = gathered(turns, id_col)
    left = convs.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("a"))
    right = convs.select(F.col("conv").alias("rejected_id"), F.col("turns").alias("b"))
    both = pairs.select("chosen_id", "rejected_id").join(left, "chosen_id", "left").join(right, "rejected_id", "left")
    both = both.withColumn("n", F.when(F.col("a").isNull() | F.col("b").isNull(), 0).otherwise(shared("a", "b")).cast("long"))
    rest_a, rest_b = (F.slice(x, F.col("n").cast("int") + 1, F.greatest(F.size(x) - F.col("n").cast("int"), F.lit(0))) for x in "ab")
    start = F.slice("a", F.lit(1), F.col("n").cast("int"))
    return both.select(
        "chosen_id", "rejected_id", F.col("n").alias("n_prompt_turns"), F.coalesce(rendered(start), F.lit("")).alias("prompt"),
        rendered(rest_a).alias("chosen"), rendered(rest_b).alias("rejected"), masked(rest_a).alias("chosen_mask"),
        masked(rest_b).alias("rejected_mask"))


def neighbour_pairs(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs for data without given preferences: conversation 2k is chosen, 2k + 1 rejected; one may be missing."""
    ids = turns.where(F.col(id_col).isNotNull()).groupBy(F.floor(F.col(id_col) / 2).alias("pair")).agg(
        F.max(F.when(F.pmod(F.col(id_col), F.lit(2)) == 0, F.col(id_col))).alias("chosen_id"),
        F.max(F.when(F.pmod(F.col(id_col), F.lit(2)) == 1, F.col(id_col))).alias("rejected_id"))
    return ids.select("chosen_id", "rejected_id")


def mask_text(mask: str) -> Column:
    """A mask as text: ``skip+learn`` per turn, joined by commas."""
    return F.array_join(F.transform(mask, lambda m: F.concat(m["skip"].cast("string"), F.lit("+"), m["learn"].cast("string"))), ",")
