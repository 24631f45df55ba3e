"""Verification of a stream: stateless, so any micro-batch size gives the batch result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veritab.operators.verify import evaluate, flat

REQUEST = "label_id bigint, brand_name string, alcohol_content string, net_contents string, text string"


def requests(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of requests below path."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def verify(stream: DataFrame) -> DataFrame:
    return flat(evaluate(stream), ["label_id"])


def start(stream: DataFrame, target: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Verify what has arrived and stop. The checkpoint makes a restart resume.

    Each batch is its own folder, overwritten if the batch is run again, so a
    retried batch leaves no row twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return verify(stream).writeStream.foreachBatch(sink or write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
