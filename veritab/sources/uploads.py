"""Uploaded files and the form that came with them, as rows to verify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions import text as T
from veritab.operators.attempts import engine_or_default


#: A request as a JSON document; members that are missing are null, others are ignored.
REQUEST = "request_id bigint, brand_name string, alcohol_content string, net_contents string, gov_warning_expected string, debug string, engine string"


def parsed(documents: DataFrame, column: str = "value") -> DataFrame:
    """Forms out of JSON documents, one a row; what is no JSON document has only nulls."""
    return documents.select(F.from_json(column, REQUEST).alias("r")).select("r.*")


def forms(raw: DataFrame) -> DataFrame:
    """Forms (request_id and text fields, any of them null) with trimmed values, flags and a known engine."""
    value = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    flag = lambda c: F.coalesce(F.col(c) == "true", F.lit(False)).alias(c)
    return raw.select(
        "request_id", *[value(c).alias(c) for c in ("brand_name", "alcohol_content", "net_contents")], flag("gov_warning_expected"), flag("debug"),
        engine_or_default(F.col("engine")).alias("engine"),
    )


def requests(raw_forms: DataFrame, uploads: DataFrame) -> DataFrame:
    """One row an accepted file: the form's values, filename, suffix and content.

    uploads: request_id, file_no, filename, content_type, content. Files of other
    types are left out, as are files without a form.
    """
    accepted = uploads.filter(T.is_upload_type(F.col("content_type")))
    return accepted.join(forms(raw_forms), "request_id").withColumn("suffix", T.file_suffix(F.col("filename")))
