"""The registered queries over the reference operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.functions import match as M
from veritab.functions import text as T
from veritab.operators import associate, attempts, dataset, evaluation, html, image, overlap, words
from veritab.operators.verify import evaluate, flat
from veritab.plans import evidence as E
from veritab.plans import interfaces
from veritab.plans.oracle import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every application with the text of all its attempts."""
    return E.apps(spark, sf_dir).join(attempts.merge_attempts(E.attempts(spark, sf_dir)), "label_id")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(_whole(spark, sf_dir))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts.prefix_plan(E.apps(spark, sf_dir), E.attempts(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.lines(E.words(spark, sf_dir), ["label_id", "attempt_no"])


def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the attempts whose coordinates are the image's; other attempts are dropped before the aggregate."""
    return words.lines(attempts.primary(E.words(spark, sf_dir)), ["label_id", "attempt_no"])


def _corners(bbox: str = "bbox") -> list:
    return [F.col(bbox)[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]


@query
def alcohol_status_by_brand(spark, sf_dir):
    rows = _whole(spark, sf_dir).withColumn("t", T.normalize(F.col("text")))
    return rows.select("part_brand", M.match_alcohol(F.col("alcohol_content"), F.col("t"))["status"].alias("status")).groupBy("part_brand", "status").agg(F.count(F.lit(1)).alias("labels"))


@query
def normalize_documents(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("n"))
    return rows.select("doc_id", F.md5("n").alias("digest"), F.char_length("n").cast("bigint").alias("chars"))


@query
def normalize_label_text(spark, sf_dir):
    return E.attempts(spark, sf_dir).select("label_id", "attempt_no", T.normalize(F.col("text")).alias("normalized"))


@query
def canonical_net_contents(spark, sf_dir):
    net = F.col("net_contents")
    return E.apps(spark, sf_dir).select("label_id", T.expected_net(net).alias("canonical"), T.page_net_contents(net).alias("page_form"))


@query
def expected_alcohol_value(spark, sf_dir):
    value = F.col("alcohol_content")
    return E.apps(spark, sf_dir).select("label_id", T.expected_alcohol(value).alias("expected"), T.page_alcohol(value).alias("page_form"))


def _one(spark, sf_dir, field):
    rows = _whole(spark, sf_dir).withColumn("t", T.normalize(F.col("text"))).select("label_id", M.MATCHERS[field](F.col(field), F.col("t")).alias("v"))
    return rows.select("label_id", "v.status", "v.confidence", F.coalesce("v.value", F.col("v.value_num").cast("string")).alias("value"), "v.raw_value")


@query
def alcohol_match(spark, sf_dir):
    return _one(spark, sf_dir, "alcohol_content")


@query
def net_contents_match(spark, sf_dir):
    return _one(spark, sf_dir, "net_contents")


@query
def brand_match(spark, sf_dir):
    return _one(spark, sf_dir, "brand_name")


@query
def generic_text_match(spark, sf_dir):
    rows = _whole(spark, sf_dir).withColumn("t", T.normalize(F.col("text"))).select("label_id", M.match_text(F.col("brand_name"), F.col("t")).alias("v"))
    return rows.select("label_id", "v.status", "v.confidence")


@query
def token_overlap_join(spark, sf_dir):
    return overlap.overlap_join(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


@query
def warning_signals(spark, sf_dir):
    rows = _whole(spark, sf_dir).withColumn("t", T.normalize(F.col("text"))).select("label_id", M.detect_warning(F.col("t")).alias("w"))
    return rows.select("label_id", "w.status", "w.confidence", F.col("w.groups_hit").cast("bigint").alias("groups_hit"), F.array_join("w.matched_anchors", "; ").alias("anchors"))


@query
def warning_signals_documents(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("t")).select("doc_id", M.detect_warning(F.col("t")).alias("w"))
    return rows.select("doc_id", "w.status", F.col("w.groups_hit").cast("bigint").alias("groups_hit"))


@query
def warnings_list(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("label_id", F.array_join("warnings", "; ").alias("warnings"))


@query
def evaluate_labels(spark, sf_dir):
    return flat(_evaluated(spark, sf_dir), ["label_id"])


@query
def words_to_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("label_id", "attempt_no", "line_no", "text", *_corners(), "confidence")


@query
def polygon_boxes(spark, sf_dir):
    """Each line's corners as a polygon of a half-size image, and back."""
    b = F.col("bbox").cast("array<double>")
    polygon = F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3]))
    each = _lines(spark, sf_dir).select("label_id", "attempt_no", F.struct("line_no", "text", polygon.alias("p"), "confidence").alias("l"))
    arrays = each.groupBy("label_id", "attempt_no").agg(F.array_sort(F.transform(F.collect_list("l"), lambda x: F.struct(x["line_no"].alias("n"), x["text"].alias("t"), x["p"].alias("p"), x["confidence"].alias("c")))).alias("a"))
    detections = arrays.select("label_id", "attempt_no", F.col("a.t").alias("rec_texts"), F.col("a.p").alias("dt_polys"), F.col("a.c").alias("rec_scores"))
    return words.polygon_boxes(detections, ["label_id", "attempt_no"], F.lit(0.5)).select("label_id", "attempt_no", "line_no", "text", *_corners(), "confidence")


@query
def merge_attempts(spark, sf_dir):
    return attempts.merge_attempts(E.attempts(spark, sf_dir))


@query
def text_by_angle(spark, sf_dir):
    return attempts.text_by_angle(E.attempts(spark, sf_dir))


@query
def fallback_prefix_choice(spark, sf_dir):
    chosen = _chosen(spark, sf_dir).withColumn("digest", F.md5("normalized_text"))
    return flat(chosen, ["label_id", "attempt_no", "ocr_ms", "digest"])


@query
def primary_boxes(spark, sf_dir):
    return _primary(spark, sf_dir).select("label_id", "attempt_no", "line_no", "text", "confidence")


@query
def associate_boxes(spark, sf_dir):
    return associate.associate(_evaluated(spark, sf_dir), _primary(spark, sf_dir)).select("label_id", "field", "rank", "score", "attempt_no", "line_no")


@query
def warning_boxes(spark, sf_dir):
    return associate.warning_boxes(_evaluated(spark, sf_dir), _primary(spark, sf_dir)).select("label_id", "attempt_no", "line_no")


@query
def overall_confidence(spark, sf_dir):
    verdicts = [F.col(f"{n}_verdict") for n in C.FIELDS]
    return _evaluated(spark, sf_dir).select("label_id", associate.overall_confidence(verdicts, F.col("government_warning")).alias("overall_confidence"))


@query
def api_projection(spark, sf_dir):
    entry = associate.answer(_evaluated(spark, sf_dir))
    cols = []
    for n in C.FIELDS:
        cols += [F.col(f"entry.fields.{n}.match_status").alias(f"{n}_match"), F.col(f"entry.fields.{n}.confidence").alias(f"{n}_confidence")]
    return entry.select("label_id", *cols, F.col("entry.fields.gov_warning.match_status").alias("gov_warning_match"), F.col("entry.fields.gov_warning.extracted").alias("gov_warning_extracted"))


@query
def field_status_summary(spark, sf_dir):
    return evaluation.field_status(_evaluated(spark, sf_dir))


@query
def warning_status_summary(spark, sf_dir):
    return evaluation.warning_status(_evaluated(spark, sf_dir))


@query
def timing_summary(spark, sf_dir):
    each = E.attempts(spark, sf_dir).groupBy("label_id").agg(F.sum("elapsed_ms").alias("ocr_ms"), (F.sum("elapsed_ms") + F.count(F.lit(1))).alias("total_ms"))
    return evaluation.timing(each)


@query
def variant_summary(spark, sf_dir):
    return evaluation.by_variant(_chosen(spark, sf_dir).withColumn("total_ms", F.col("ocr_ms") + 1))


@query
def variant_rollup(spark, sf_dir):
    return evaluation.variant_rollup(_evaluated(spark, sf_dir))


@query
def top_warnings(spark, sf_dir):
    return evaluation.top_warnings(_evaluated(spark, sf_dir))


@query
def status_value_counts(spark, sf_dir):
    return evaluation.value_counts(E.derive(spark, sf_dir, E.PRIOR), "fetch_status")


@query
def curated_records(spark, sf_dir):
    return dataset.curate(E.derive(spark, sf_dir, E.PRIOR)).select("id", "row_no")


@query
def dedup_last_wins(spark, sf_dir):
    return dataset.last_per_id(E.derive(spark, sf_dir, E.PRIOR)).select("id", "row_no", "first_row", "fetch_status")


@query
def pending_records(spark, sf_dir):
    return dataset.pending(E.derive(spark, sf_dir, E.RECORDS), E.derive(spark, sf_dir, E.PRIOR)).select("id", "row_no", "name")


@query
def kept_records(spark, sf_dir):
    prior = E.derive(spark, sf_dir, E.PRIOR)
    return dataset.kept(prior, dataset.pending(E.derive(spark, sf_dir, E.RECORDS), prior)).select("id", "row_no", "fetch_status")


@query
def merged_metadata(spark, sf_dir):
    fetched = E.derive(spark, sf_dir, E.FETCHED).select("id", "brand_name_detail", "fanciful_name_detail")
    out = dataset.merge_metadata(E.derive(spark, sf_dir, E.RECORDS), E.derive(spark, sf_dir, E.PRIOR), fetched)
    return out.select("id", "row_no", "name", "brand_name_detail", "fanciful_name_detail")


@query
def master_with_variants(spark, sf_dir):
    columns = ["id", "row_no", "fetch_status", "image_path", "variant_type"]
    rows = E.derive(spark, sf_dir, E.PRIOR).select(*columns).withColumn("base_image", F.lit(""))
    last = dataset.last_per_id(rows).drop("first_row")
    made = dataset.eligible(last).select("id", F.concat(F.lit("images/"), "id", F.lit("_dist.jpg")).alias("image_path"), F.lit("noise_s5").alias("variant_type"), F.col("image_path").alias("base_image"))
    return dataset.master(last, rows, made).select(*columns, "base_image")


@query
def exact_size_sample(spark, sf_dir):
    order = [(F.col("row_no") * 7919) % 10007, F.col("row_no")]
    return dataset.exact_sample(dataset.eligible(E.derive(spark, sf_dir, E.PRIOR)), 0.5, order).select("row_no")


@query
def fetch_status_classified(spark, sf_dir):
    rows = E.derive(spark, sf_dir, E.FETCHED).withColumns({"net_contents": T.page_net_contents(F.col("net_text")), "alcohol_content": T.page_alcohol(F.col("alcohol_text"))})
    core = [F.col(c) for c in ("brand_name_detail", "fanciful_name_detail", "net_contents", "alcohol_content")]
    return rows.select("id", "net_contents", "alcohol_content", dataset.fetch_status(F.col("error"), F.col("captcha"), F.col("images"), F.col("image_error"), core).alias("fetch_status"))


@query
def detail_flat(spark, sf_dir):
    angles = attempts.angle_map(E.attempts(spark, sf_dir))
    results = _chosen(spark, sf_dir).join(angles, "label_id").withColumns({"image_path": F.lit(""), "error": F.lit(None).cast("string"), "engine": F.lit("recorded"), "total_ms": F.col("ocr_ms")})
    return evaluation.detail(results).select(
        "ttb_id", "variant_type", "ocr_time_ms", "normalized_ocr_text", "ocr_angle_0", "ocr_angle_90", "ocr_angle_270", "brand_name_status", "brand_name_found",
        "alcohol_content_status", "alcohol_content_found", "net_contents_status", "net_contents_found", "government_warning_matched_anchors", "warnings",
    )


@query
def page_titles(spark, sf_dir):
    page = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", html.page_title(page).alias("title"), F.size(html.links(page)).cast("bigint").alias("links"))


@query
def page_captcha(spark, sf_dir):
    page = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", T.is_captcha(page).alias("captcha"), F.size(html.attachments(page)).cast("bigint").alias("attachments"))


@query
def stack_layout(spark, sf_dir):
    parts = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("part_no"), (F.col("o_orderkey") % 50 + 100).alias("height"), (F.col("o_orderkey") % 30 + 200).alias("width"))
    return image.stack_layout(parts)


@query
def label_quality_by_source(spark, sf_dir):
    joined = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    good = F.count_if(F.col("quality") == 1)
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("labelled"), good.alias("good"), F.bround(good / F.count(F.lit(1)), 4).alias("good_rate"))


def queries() -> dict[str, Query]:
    return _QUERIES | interfaces.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | interfaces.ORACLES
