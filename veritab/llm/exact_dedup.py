"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of the
text, one row per digest. A batch is reduced to one row per digest by a
map-side-combined aggregate, anti-joined to the index by sort-merge on the
buckets, and what is new is appended. Only digests, ids and counts are
shuffled, never texts (but those of rows that repeat id and text). Everything is
DataFrame operations.

Every row of the index names the batch that brought it. A batch that is run
again under its name, after a failure anywhere behind the append, gets the
verdicts of its first run and leaves the index as it is.

Edge cases: a null text counts as empty; an empty text is a text like any
other; of equal texts the largest id stays; in the verdicts, rows that repeat id
and text share theirs, and keep_first_copies() keeps one of them; a null id never
wins against an id, and a group that has only null ids has keep_id null (one of
its rows is kept); an id that comes with several texts is judged with each; an
empty batch gives an empty result and leaves the index as it was; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import shared

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"
#: Rows (a digest and an id) that may be broadcast: 16 MB.
BROADCAST_ROWS = 400_000


class DigestIndex:
    """A table of digests seen so far, in `buckets` buckets below `location`."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64, table: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.table = table or shared.new_table("digest-index")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({INDEX_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        (
            fresh.select("digest", "keep_id", "group_size", "batch")
            .repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").insertInto(self.table)
        )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _digest(F.col(text_col)).alias("digest"))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Verdicts for every row of docs; digests that are new go into the index.

    batch names the rows, so that they can be given again (without one, each
    call is a batch of its own). Returns doc_id, keep_id (the row that stays:
    that of the index where another batch has brought the text), group_size
    (rows of this batch with that text), kept, digest.
    """
    batch = batch or uuid.uuid4().hex
    rows = digests(docs, id_col, text_col)
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("batch_id"), F.count(F.lit(1)).alias("group_size"))
    known = index.rows().filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("is_known"))
    # what the index says now; written before the append changes it
    verdicts = shared.materialize(
        groups.join(known.hint("merge"), "digest", "left").select(
            "digest", "group_size", F.coalesce("is_known", F.lit(False)).alias("is_known"),
            F.when(F.col("is_known"), F.col("known_id")).otherwise(F.col("batch_id")).alias("keep_id"),
        ),
        "exact-verdicts",
    )
    fresh = verdicts.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")).join(
        index.rows().select("digest").hint("merge"), "digest", "left_anti"
    )
    index.append(fresh)
    return rows.join(verdicts.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size",
        (~F.col("is_known") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest",
    )


def keep_first_copies(docs: DataFrame, index: DigestIndex, batch: str | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """docs, its columns unchanged, with one row of each text that no other batch has brought.

    The verdict is a row's, found by digest and id: rows that share an id and
    differ in text do not touch each other. Of rows that repeat id and text the
    one with the least hash of all its columns stays. What goes is broadcast
    only below a checked count.
    """
    verdicts = deduplicate(docs, index, batch=batch)
    each = verdicts.groupBy("digest", "doc_id", "kept").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1 or not kept")
    each = shared.materialize(each.select(F.col("digest").alias("__digest"), F.col("doc_id").alias("__id"), F.col("kept").alias("__kept")), "exact-dropped")
    keyed = docs.withColumns({"__digest": _digest(F.col("text")), "__id": F.col("doc_id").cast("bigint")})

    def among(found: DataFrame, how: str) -> DataFrame:
        found = found.select(F.col("__digest").alias("__d"), F.col("__id").alias("__i"))
        same = (F.col("__digest") == F.col("__d")) & F.col("__id").eqNullSafe(F.col("__i"))
        return keyed.join(F.broadcast(found) if found.count() <= bound else found.hint("merge"), same, how)

    out = among(each, "left_anti").select(*docs.columns)
    repeated = each.filter("__kept")
    if repeated.isEmpty():
        return out
    return out.unionByName(shared.one_of_each(among(repeated, "left_semi"), ["__digest"], docs.columns))
