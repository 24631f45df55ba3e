"""Where intermediate tables go, and small helpers that several operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.sources.tables import delete_path, mark, new_path, new_table, shared_dir, sweep  # noqa: F401


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veritab_path = path
    return out


def materialize_bucketed(df: DataFrame, label: str, partition_by: str, bucket_by: str, buckets: int) -> DataFrame:
    """As materialize(), but rows with equal `bucket_by` need no shuffle to meet others that are dealt by it."""
    spark = df.sparkSession
    table = new_table(label)
    writer = df.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, label))
    writer.partitionBy(partition_by).bucketBy(buckets, bucket_by).saveAsTable(table)
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote; only for tables that no later plan reads."""
    delete_path(df.sparkSession, df._veritab_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch to or from Python; a longer row is a batch of its own.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches, so that whole texts of any length pass in bounded memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Ids that may be broadcast: 16 MB of longs. Beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000


def without_ids(df: DataFrame, ids: DataFrame, column: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """The rows of df whose column is not in ids (one column of that name).

    ids is counted first and broadcast only while it has at most `bound` rows;
    beyond that the anti-join is a sort-merge join. Rows with a null stay.
    """
    small = ids.count() <= bound
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), column, "left_anti")


def with_ids(df: DataFrame, ids: DataFrame, column: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """The rows of df whose column is in ids; broadcast behind the same check."""
    small = ids.count() <= bound
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), column, "left_semi")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return _has_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))


def one_of_each(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of the rows with equal keys the one with the least hash of its columns (maps left out), as `columns`."""
    hashed = [F.col(c) for c in columns if not _has_map(df.schema[c].dataType)]
    row = F.struct(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.xxhash64(*hashed)).alias("__row")).select("__row.*")
