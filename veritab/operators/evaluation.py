"""Batch evaluation: counts, rates, timings, variants, warnings, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.operators.associate import long_fields
from veritab.sources import files

STATUSES = ("found", "partial", "missing")


def rate(count: Column, total: Column, places: int = 4) -> Column:
    return F.when(total > 0, F.bround(count / total, places)).otherwise(0.0)


def _counts(status: Column) -> list[Column]:
    total = F.count(F.lit(1))
    each = {s: F.count_if(F.coalesce(status, F.lit("missing")) == s) for s in STATUSES}
    return [total.alias("total"), *[c.alias(s) for s, c in each.items()], rate(each["found"], total).alias("accuracy"), rate(each["partial"], total).alias("partial_rate")]


def field_status(evaluated: DataFrame, key: str = "label_id") -> DataFrame:
    """Counts and rates of found, partial and missing by field."""
    return long_fields(evaluated, key).groupBy("field").agg(*_counts(F.col("status")))


def warning_status(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(*_counts(F.col("government_warning.status")))


def timing(results: DataFrame, columns: tuple[str, ...] = ("total_ms", "ocr_ms")) -> DataFrame:
    """Mean, median, least and largest of each column; 0 without rows."""
    out = []
    for c in columns:
        for name, f in (("avg", F.avg(c)), ("median", F.median(c)), ("min", F.min(c)), ("max", F.max(c))):
            out.append(F.coalesce(F.bround(f, 2), F.lit(0.0)).alias(f"{name}_{c}"))
    return results.agg(F.count(F.lit(1)).alias("total_records"), *out)


def by_variant(evaluated: DataFrame, variant: str = "variant_type", columns: tuple[str, ...] = ("total_ms", "ocr_ms")) -> DataFrame:
    """Count, rates of each field and of the warning, and mean times, by variant; an empty variant is 'unknown'."""
    total = F.count(F.lit(1))
    aggregates = [total.alias("records")]
    named = {n: F.col(f"{n}_verdict.status") for n in C.FIELDS} | {"government_warning": F.col("government_warning.status")}
    for name, status in named.items():
        aggregates += [rate(F.count_if(status == s), total).alias(f"{name}_{s}_rate") for s in ("found", "partial")]
    aggregates += [F.coalesce(F.bround(F.avg(c), 2), F.lit(0.0)).alias(f"avg_{c}") for c in columns]
    return evaluated.groupBy(F.coalesce(F.nullif(F.col(variant), F.lit("")), F.lit("unknown")).alias("variant")).agg(*aggregates)


def variant_rollup(evaluated: DataFrame, variant: str = "variant_type") -> DataFrame:
    """Overall and by-variant counts of labels whose fields are all found, in one pass."""
    all_found = F.lit(True)
    for n in C.FIELDS:
        all_found = all_found & (F.col(f"{n}_verdict.status") == "found")
    rows = evaluated.select(F.coalesce(F.nullif(F.col(variant), F.lit("")), F.lit("unknown")).alias("variant"), all_found.alias("ok"))
    return rows.rollup("variant").agg(F.count(F.lit(1)).alias("records"), F.count_if("ok").alias("all_found"), F.grouping("variant").cast("int").alias("is_total"))


def top_warnings(evaluated: DataFrame, order: str = "label_id", most: int = 20) -> DataFrame:
    """The most frequent warnings; ties go to the one met first."""
    # outer: a plain one would put a filter below the projections that evaluates all verdicts once more
    each = evaluated.select(order, F.posexplode_outer("warnings").alias("at", "warning")).filter("warning is not null")
    counted = each.groupBy("warning").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(F.col(order), "at")).alias("first"))
    return counted.orderBy(F.desc("count"), "first").limit(most).select("warning", "count")


def image_errors(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error") != "").alias("image_errors"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most frequent first; nulls are left out."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def observed(results: DataFrame, name: str = "evaluation") -> tuple[DataFrame, Observation]:
    """results, and counts that are known once they have been written: records, errors, and found by field. No extra pass."""
    counts = Observation(name)
    found = [F.count_if(F.col(f"{n}_verdict.status") == "found").alias(f"{n}_found") for n in C.FIELDS]
    return results.observe(counts, F.count(F.lit(1)).alias("records"), F.count_if(F.col("error") != "").alias("errors"), *found), counts


DETAIL = ["ttb_id", "image_path", "variant_type", "error", "ocr_engine", "ocr_time_ms", "total_time_ms", "ocr_text", "normalized_ocr_text", "ocr_angle_0", "ocr_angle_90", "ocr_angle_270"]


def detail(results: DataFrame) -> DataFrame:
    """29 flat columns: DETAIL, four of each field, the warning's, and joined warnings.

    results has the evaluated columns and key, image_path, variant_type, error,
    engine, ocr_ms, total_ms, text and ocr_by_angle (map of int to text).
    """
    angle = lambda a: F.coalesce(F.try_element_at("ocr_by_angle", F.lit(a)), F.lit("")).alias(f"ocr_angle_{a}")
    cols = [
        F.col("label_id").alias("ttb_id"), "image_path", "variant_type", F.coalesce("error", F.lit("")).alias("error"), F.col("engine").alias("ocr_engine"),
        F.col("ocr_ms").alias("ocr_time_ms"), F.col("total_ms").alias("total_time_ms"), F.col("text").alias("ocr_text"), F.col("normalized_text").alias("normalized_ocr_text"),
        angle(0), angle(90), angle(270),
    ]
    for n in C.FIELDS:
        v = F.col(f"{n}_verdict")
        cols += [v["status"].alias(f"{n}_status"), v["confidence"].alias(f"{n}_confidence"), v["normalized_value"].alias(f"{n}_expected"), v["raw_value"].alias(f"{n}_found")]
    g = F.col("government_warning")
    return results.select(
        *cols, g["status"].alias("government_warning_status"), g["confidence"].alias("government_warning_confidence"),
        F.array_join(g["matched_anchors"], "; ").alias("government_warning_matched_anchors"),
        F.to_json(g["matched_groups"], {"ignoreNullFields": "false"}).alias("government_warning_matched_groups"), F.array_join("warnings", "; ").alias("warnings"),
    )


def write_detail(results: DataFrame, path: str) -> None:
    files.write_records(detail(results), path)


def write_records(results: DataFrame, path: str) -> None:
    """Whole nested records, one JSON document a line."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def summary(evaluated: DataFrame, results: DataFrame, engine: str) -> DataFrame:
    """One row: totals, field, warning, timing and variant statistics, top warnings. All parts are small."""
    packed = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    out = packed(field_status(evaluated), "field_stats").crossJoin(packed(warning_status(evaluated), "government_warning_stats"))
    out = out.crossJoin(packed(timing(results), "timing_stats")).crossJoin(packed(by_variant(results), "variant_stats"))
    return out.crossJoin(packed(top_warnings(evaluated), "top_warnings")).crossJoin(image_errors(results)).withColumn("engine", F.lit(engine))


def write_summary(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report(row: DataFrame) -> str:
    """The summary as text; collects the one row."""
    s = row.first().asDict(recursive=True)
    lines = [f"engine: {s['engine']}   image errors: {s['image_errors']}"]
    for f in s["field_stats"]:
        lines.append(f"{f['field']:<18} found {f['found']:>7} ({f['accuracy']:.2%})  partial {f['partial']:>7} ({f['partial_rate']:.2%})  missing {f['missing']:>7}")
    w = s["government_warning_stats"][0]
    lines.append(f"{'warning':<18} found {w['found']:>7} ({w['accuracy']:.2%})  partial {w['partial']:>7} ({w['partial_rate']:.2%})  missing {w['missing']:>7}")
    lines += [f"{k}: {v}" for k, v in s["timing_stats"][0].items()]
    lines += [f"variant {v['variant']}: {v['records']} records" for v in s["variant_stats"]]
    lines += [f"{x['count']:>7}  {x['warning']}" for x in s["top_warnings"]]
    return "\n".join(lines)
