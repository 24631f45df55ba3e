"""Evaluation of expected values against text: one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.functions import match as M
from veritab.functions import text as T


def evaluate(rows: DataFrame, text: str = "text", required: Column | None = None) -> DataFrame:
    """rows with the expected values and `text`, plus normalized_text, a verdict struct for each field,
    government_warning, warnings and needs_fallback.

    Every stage is a projection of its own whose columns the next one needs more
    than once, so Catalyst keeps them apart and a verdict is computed once.
    """
    out = rows.withColumn("normalized_text", T.normalize(F.col(text)))
    out = out.withColumns({f"{n}_verdict": M.MATCHERS[n](F.col(n), F.col("normalized_text")) for n in C.FIELDS} | {"government_warning": M.detect_warning(F.col("normalized_text"))})
    verdicts, warning = {n: F.col(f"{n}_verdict") for n in C.FIELDS}, F.col("government_warning")
    return out.withColumns({
        "warnings": M.warnings_list(verdicts, warning, F.lit(True) if required is None else required),
        "needs_fallback": M.needs_fallback(verdicts, warning),
    })


def missing_image(rows: DataFrame, confidence: float | None = None) -> DataFrame:
    """The same columns for rows without a readable image: nothing found, one warning.

    confidence is null where a service answers and 0.0 in batch evaluation.
    """
    empty = M._verdict(None, None, None, None, confidence, "missing")
    return rows.withColumns(
        {"normalized_text": F.lit("")} | {f"{n}_verdict": empty for n in C.FIELDS}
        | {"government_warning": M.detect_warning(F.lit("")), "warnings": F.array(F.lit("image_not_found")), "needs_fallback": F.lit(False)}
    )


def flat(evaluated: DataFrame, keep: list[str]) -> DataFrame:
    """keep, then status, confidence, value and raw value of each field, the warning's, and joined codes."""
    cols = [F.col(k) for k in keep]
    for n in C.FIELDS:
        v = F.col(f"{n}_verdict")
        cols += [v["status"].alias(f"{n}_status"), v["confidence"].alias(f"{n}_confidence"), F.coalesce(v["value"], v["value_num"].cast("string")).alias(f"{n}_expected"), v["raw_value"].alias(f"{n}_found")]
    g = F.col("government_warning")
    return evaluated.select(
        *cols, g["status"].alias("government_warning_status"), g["confidence"].alias("government_warning_confidence"),
        F.array_join(g["matched_anchors"], "; ").alias("government_warning_matched_anchors"), F.array_join("warnings", "; ").alias("warnings"),
    )
