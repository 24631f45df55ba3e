"""Joins on word overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions import text as T
from veritab.sources.tables import written

#: Words of the expected side, each with an id and a count, that may be sent to every task.
BROADCAST_WORDS = 500_000


def _sets(rows: DataFrame, key: str) -> DataFrame:
    """key and the distinct words of the text, normalized twice; rows without words are left out."""
    words = rows.select(key, T.tokens(T.normalize_again(T.normalize(F.col("text")))).alias("words"))
    return words.withColumn("n", F.size("words"))


def overlap_join(
    expected: DataFrame, texts: DataFrame, least: float = 0.5, expected_id: str = "item_id", text_id: str = "doc_id", broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """Pairs (expected_id, text_id, shared, overlap) whose text has at least the share `least` of expected's words.

    Exact, without a cross join, and both ways give the same rows. Word sets are
    stored once, dealt by text. While all of expected's words are few (they are
    counted first) they go to every task, and what a text shares with each item
    is counted where the text's words are. Beyond that bound words meet in a
    shuffle: a pair that reaches the share must have one of expected's rarest
    words in common, so only those are joined on, and whole sets are compared
    for the candidates alone. Ids are unique on either side.
    """
    left = written(_sets(expected, expected_id).filter("n > 0"), "overlap-items")
    right = _sets(texts, text_id)
    asked = left.select(expected_id, "n", F.explode("words").alias("word"))
    if asked.count() <= broadcast_words:
        # dealt by text before words are taken apart: the counts need no further shuffle
        each = right.repartition(F.col(text_id)).select(text_id, F.explode("words").alias("word"))
        counted = each.join(F.broadcast(asked), "word").groupBy(text_id, expected_id).agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"))
        return counted.select(expected_id, text_id, "shared", (F.col("shared") / F.col("n")).alias("overlap")).filter(F.col("overlap") >= least)
    right = written(right.filter("n > 0"), "overlap-texts")
    words = right.select(text_id, F.explode("words").alias("word"))
    frequency = words.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = asked.join(frequency, "word", "left").groupBy(expected_id, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("w"))
    rare = ranked.select(expected_id, F.explode(F.slice("w", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("x")).select(expected_id, F.col("x.word").alias("word"))
    candidates = words.join(rare, "word").select(expected_id, text_id).distinct()
    both = candidates.join(left.select(expected_id, F.col("words").alias("a")), expected_id).join(right.select(text_id, F.col("words").alias("b")), text_id)
    shared = F.size(F.array_intersect("a", "b"))
    return both.select(expected_id, text_id, shared.cast("bigint").alias("shared"), (shared / F.size("a")).alias("overlap")).filter(F.col("overlap") >= least)
