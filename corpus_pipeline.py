"""The corpus pipeline: stages that each take what their predecessor kept.

Every verdict is a row's: rows that share an id, or have none, are judged by
their own texts, and of rows that repeat id and text one stays. A null text
counts as empty; empty texts are equal texts, so one of them stays, and link
with nothing. Null labels and ids without a text teach nothing; a null source is
a source of its own. Further columns pass through, whatever their names; an
empty table gives no rows. A stage that is run again on the same rows gives the
same rows: the exact stage's index is its own. run() deletes what a stage has
left behind once the stage's rows are written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veritab.llm import exact_dedup, near_dedup, packing, shared, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field rejects go; all others stay."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts stays."""
    return exact_dedup.keep_first_copies(docs, exact_dedup.DigestIndex(spark, shared.new_path(spark, "digest-index")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (a similarity of 0.8 or more over five words) stays."""
    return near_dedup.keep_representatives(docs, threshold=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row that is left, in bins of tokens."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(packing.token_rows(docs, vocabulary, public_tokenizers.PATTERN))


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]
#: Toxicity is a trained model and near-duplicate search a randomised one: SQL cannot express the stages' rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = shared.mark()
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        shared.sweep(spark, before, keep=(docs._veritab_path,))
    return STAGES[-1][1](spark, docs, sf_dir)
