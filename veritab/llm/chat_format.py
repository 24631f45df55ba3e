"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (equal role and text) is rendered once as
the prompt; what follows it in either conversation is rendered as that side's
completion, with the character ranges to train on: the assistant's texts and
their end marks. Everything is DataFrame operations; a conversation's turns are
the only rows that meet.

Edge cases: a null role or text is empty; a null turn comes last; turns with
equal numbers are ordered by role and text, so repeated turns stay; a pair of
which one side is missing has an empty prompt and an empty completion there;
equal conversations are all prompt with two empty completions; turns without a
pair id belong to no conversation and are left out, in either function; no rows
give no pairs; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def _conversations(turns: DataFrame, name: str) -> DataFrame:
    turn = F.struct(
        F.coalesce(F.col("turn").cast("bigint"), F.lit(2**63 - 1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return turns.filter("pair_id is not null").select("pair_id", turn.alias("t")).groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias(name))


def _trained(turns: Column) -> Column:
    """Ranges [start, end) of the assistant's content in the rendered turns, as 'start-end' joined by ';'."""
    step = lambda acc, t: F.struct(
        (acc["at"] + F.char_length(_rendered(t))).alias("at"),
        F.when(
            t["role"] == "assistant",
            F.concat(
                acc["ranges"], F.when(acc["ranges"] == "", "").otherwise(";"),
                (acc["at"] + F.char_length(t["role"]) + 5).cast("string"), F.lit("-"), (acc["at"] + F.char_length(_rendered(t))).cast("string"),
            ),
        ).otherwise(acc["ranges"]).alias("ranges"),
    )
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("ranges")), step, lambda acc: acc["ranges"])


def preference_rows(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each pair_id of the two tables of turns (pair_id, turn, role, text).

    Returns pair_id, prompt_turns, prompt, and for either side its completion
    and its trained ranges (offsets in the completion).
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    left = _conversations(chosen, "chosen").withColumnRenamed("pair_id", "left_id")
    right = _conversations(rejected, "rejected").withColumnRenamed("pair_id", "right_id")
    both = left.join(right, F.col("left_id") == F.col("right_id"), "full").select(
        F.coalesce("left_id", "right_id").alias("pair_id"), F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected")
    )
    same = F.zip_with("chosen", "rejected", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    counted = both.withColumn("same", same).withColumn(
        "prompt_turns", F.when(F.array_contains("same", False), F.array_position("same", False) - 1).otherwise(F.size("same").cast("bigint"))
    )
    after = lambda side: F.slice(F.col(side), F.col("prompt_turns").cast("int") + 1, F.greatest(F.size(side), F.lit(1)))
    text = lambda turns: F.array_join(F.transform(turns, _rendered), "")
    return counted.select(
        "pair_id", "prompt_turns", text(F.slice(F.col("chosen"), F.lit(1), F.col("prompt_turns").cast("int"))).alias("prompt"),
        text(after("chosen")).alias("chosen_completion"), text(after("rejected")).alias("rejected_completion"),
        _trained(after("chosen")).alias("chosen_trained"), _trained(after("rejected")).alias("rejected_trained"),
    )


def borrowed_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns out of one table of conversations (conv_id, turn, role, text).

    A conversation is chosen as it is; turns with a null conv_id are left out. Rejected is the same up to its last
    assistant turn, and from there the turns that the conversation with the next
    id has from its own last assistant turn on. Without an assistant turn all
    turns count as before it.
    """
    base = turns.select(F.col("conv_id").cast("bigint").alias("pair_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").filter("pair_id is not null")
    last = base.filter("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last"))
    marked = base.join(last, "pair_id", "left")
    head = marked.filter("last is null or turn is null or turn < last").drop("last")
    tail = marked.filter("turn >= last").select((F.col("pair_id") - 1).alias("pair_id"), "turn", "role", "text")
    owners = base.select("pair_id").distinct()
    # borrowed turns come after the conversation's own, whatever their numbers
    tail = tail.join(owners, "pair_id", "left_semi").withColumn("turn", F.col("turn") + 2**40)
    return base, head.unionByName(tail)
