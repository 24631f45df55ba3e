"""The text and matching functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veritab.functions import constants as C


def register(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions; they are expressions, so they are inlined and optimized. Returns their names."""
    body = "lower(coalesce(s, ''))"
    for found, instead in C.REPLACEMENTS:
        body = f"replace({body}, '{found}', '{instead}')"
    body = f"trim(regexp_replace(regexp_replace({body}, r'{C.DROPPED}', ' '), r'\\s+', ' '))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(s STRING) RETURNS STRING RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION token_overlap(a STRING, b STRING) RETURNS DOUBLE RETURN "
        "CASE WHEN normalize_text(a) = '' OR normalize_text(b) = '' THEN 0.0D ELSE "
        "size(array_intersect(split(normalize_text(a), ' '), split(normalize_text(b), ' '))) / size(array_distinct(split(normalize_text(a), ' '))) END"
    )
    groups = " + ".join(
        "CASE WHEN " + " OR ".join(f"contains(normalize_text(s), '{w}')" for w in words) + " THEN 1 ELSE 0 END" for _, words in C.WARNING_GROUPS
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION warning_groups(s STRING) RETURNS INT RETURN {groups}")
    return ["normalize_text", "token_overlap", "warning_groups"]
