"""Verdicts to boxes, overall confidence and the service's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import constants as C


def box_score(raw: Column, box: Column, field: Column) -> Column:
    """How well a box's text matches a raw value: containment either way, or shared words."""
    compact = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    numeric = field.isin("alcohol_content", "net_contents")
    either = F.contains(compact(box), compact(raw)) | F.contains(compact(raw), compact(box))
    coverage = F.char_length(box) / F.char_length(raw)
    words = lambda x: F.array_distinct(F.filter(F.split(x, r"\s+"), lambda t: t != ""))
    recall = F.try_divide(F.size(F.array_intersect(words(raw), words(box))).cast("double"), F.size(words(raw)).cast("double"))
    return (
        F.when(raw.isNull() | box.isNull() | (raw == "") | (box == ""), 0.0)
        .when(F.contains(box, raw), 1.0)
        .when(numeric & either, C.BOX_COMPACT)
        .when((F.char_length(box) > 2) & F.contains(raw, box) & (coverage >= C.BOX_COVERAGE), coverage * C.BOX_COVERAGE_WEIGHT)
        .when(recall >= C.BOX_RECALL, recall * C.BOX_RECALL_WEIGHT)
        .otherwise(0.0)
    )


def long_fields(evaluated: DataFrame, key: str = "label_id") -> DataFrame:
    """One row a field: key, field, status, confidence, raw_value, value, value_num, normalized_value."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{n}_verdict").alias("v")) for n in C.FIELDS])
    return evaluated.select(key, F.explode(each).alias("e")).select(key, "e.field", "e.v.*")


def associate(evaluated: DataFrame, boxes: DataFrame, key: str = "label_id", order: tuple[str, ...] = ("attempt_no", "line_no")) -> DataFrame:
    """For each field that is not missing its best boxes: within 60 % of the best score, two at most.

    boxes has key, text, bbox, confidence and the columns of `order`. The join
    is by key, the comparison of fields with boxes stays inside an image.
    """
    fields = long_fields(evaluated, key).filter("status <> 'missing' AND raw_value <> ''").select(key, "field", F.lower(F.trim("raw_value")).alias("raw"))
    scored = fields.join(boxes, key).withColumn("score", box_score(F.col("raw"), F.lower(F.trim("text")), F.col("field"))).filter("score > 0")
    group = Window.partitionBy(key, "field")
    ranked = scored.withColumns({"best": F.max("score").over(group), "rank": F.row_number().over(group.orderBy(F.desc("score"), *order))})
    return ranked.filter((F.col("score") >= F.col("best") * C.BOX_KEEP) & (F.col("rank") <= C.BOX_CAP)).select(key, "field", "rank", "score", *order, "text", "bbox", "confidence")


def warning_boxes(evaluated: DataFrame, boxes: DataFrame, key: str = "label_id") -> DataFrame:
    """All boxes with a warning word, of images whose warning is not missing."""
    present = evaluated.filter("government_warning.status <> 'missing'").select(key)
    own = F.arrays_overlap(F.split(F.lower("text"), r"\s+"), F.array(*map(F.lit, C.WARNING_BOX_WORDS)))
    return boxes.filter(own).join(present, key, "left_semi")


def overall_confidence(verdicts: list[Column], warning: Column) -> Column:
    """The mean of the confidences that there are, to three places; 0 without any."""
    known = F.array_compact(F.array(*[v["confidence"] for v in verdicts], warning["confidence"]))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.when(F.size(known) > 0, F.bround(mean, 3)).otherwise(0.0)


def match_status(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in C.MATCH_STATUS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, status), F.lit("not_found"))


def translate_field(verdict: Column) -> Column:
    return F.struct(
        F.coalesce(verdict["value"], verdict["value_num"].cast("string")).alias("expected"), verdict["raw_value"].alias("extracted"),
        F.coalesce(verdict["confidence"], F.lit(0.0)).alias("confidence"), match_status(verdict["status"]).alias("match_status"),
    )


def translate_warning(warning: Column, expected: Column) -> Column:
    return F.struct(
        expected.alias("expected"), (warning["status"] == "found").alias("extracted"),
        F.coalesce(warning["confidence"], F.lit(0.0)).alias("confidence"), match_status(warning["status"]).alias("match_status"),
    )


def answer(evaluated: DataFrame, key: str = "label_id", expected_warning: Column | None = None, debug: Column | None = None) -> DataFrame:
    """key and the service's entry as a struct: fields, overall confidence, summary, warnings, and debug where asked."""
    warning = translate_warning(F.col("government_warning"), F.lit(True) if expected_warning is None else expected_warning)
    fields = {n: translate_field(F.col(f"{n}_verdict")) for n in C.FIELDS} | {"gov_warning": warning}
    summary = F.struct(*[v["match_status"].alias(n) for n, v in fields.items()])
    shown = F.struct("normalized_text", F.col("government_warning.matched_groups").alias("matched_groups"))
    entry = F.struct(
        F.struct(*[v.alias(n) for n, v in fields.items()]).alias("fields"),
        overall_confidence([F.col(f"{n}_verdict") for n in C.FIELDS], F.col("government_warning")).alias("overall_confidence"),
        summary.alias("summary"), "warnings", F.when(F.lit(False) if debug is None else debug, shown).alias("debug"),
    )
    return evaluated.select(key, entry.alias("entry"))


def answers_json(entries: DataFrame) -> DataFrame:
    """One JSON document an entry; a batch's entries are the rows."""
    return entries.select(*[c for c in entries.columns if c != "entry"], F.to_json("entry").alias("json"))


def card_class(statuses: Column) -> Column:
    """Of a result's statuses: match if all match, mismatch if any mismatches, else partial."""
    return F.when(F.forall(statuses, lambda s: s == "match"), "match").when(F.exists(statuses, lambda s: s == "mismatch"), "mismatch").otherwise("partial")


def shown_value(value: Column) -> Column:
    return F.coalesce(F.when(value.cast("string") == "true", "Yes").when(value.cast("string") == "false", "No").otherwise(value.cast("string")), F.lit("—"))


def shown_percent(confidence: Column) -> Column:
    return F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))


def preview(text: Column, most: int = 80) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def box_percent(bbox: Column, width: Column, height: Column) -> Column:
    """left, top, width and height of a box in percent of its image."""
    return F.struct(
        (bbox[0] / width * 100).alias("left"), (bbox[1] / height * 100).alias("top"),
        ((bbox[2] - bbox[0]) / width * 100).alias("width"), ((bbox[3] - bbox[1]) / height * 100).alias("height"),
    )


def with_files(entries: DataFrame, files: DataFrame, name: str = "filename", order: str = "file_no") -> DataFrame:
    """entries with the first file (by `order`) of the same name; its other columns as a struct `file`, null without one."""
    others = [c for c in files.columns if c != name]
    first = files.groupBy(name).agg(F.min_by(F.struct(*others), order).alias("file"))
    return entries.join(first, name, "left")
