"""Recognised words and polygons to lines, boxes and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import constants as C


def words_from_arrays(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays to one row a word, numbered from 0."""
    return rows.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("word_no", "w")).select(*keys, "word_no", "w.*")


def lines(words: DataFrame, keys: list[str], scale: Column | None = None, least: int = C.WORD_CONFIDENCE) -> DataFrame:
    """One row a line (block_num, par_num, line_num) of confident words, in the order of first appearance.

    Returns keys, line_no (from 0), text, bbox (x0, y0, x1, y1 in the unscaled image), confidence.
    """
    inverse = F.lit(1.0) if scale is None else F.lit(1.0) / scale
    good = words.filter((F.col("conf") >= least) & (F.trim("text") != "")).withColumn("inverse", inverse)
    line = good.groupBy(*keys, "block_num", "par_num", "line_num").agg(
        F.min("word_no").alias("first_word"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", F.trim("text").alias("t")))), lambda w: w["t"]), " ").alias("text"),
        F.array(*[(f * F.first("inverse")).cast("int") for f in (F.min("left"), F.min("top"), F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height")))]).alias("bbox"),
        F.bround(F.avg("conf") / 100.0, 3).alias("confidence"),
    )
    ordered = line.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first_word", "text", "bbox", "confidence"))).alias("l"))
    return ordered.select(*keys, F.posexplode("l").alias("line_no", "b")).select(*keys, "line_no", "b.text", "b.bbox", "b.confidence")


def polygon_boxes(detections: DataFrame, keys: list[str], scale: Column | None = None) -> DataFrame:
    """Polygons (rec_texts, dt_polys, rec_scores) to boxes.

    A blank text gives no row, a missing polygon no box (null bbox), a missing score 0.
    """
    inverse = F.lit(1.0) if scale is None else F.lit(1.0) / scale
    rows = detections.select(
        *keys, inverse.alias("inverse"), F.col("dt_polys"), F.col("rec_scores"), F.posexplode("rec_texts").alias("line_no", "text")
    ).filter(F.trim("text") != "")
    polygon, score = F.get("dt_polys", F.col("line_no")), F.get("rec_scores", F.col("line_no"))
    axis = lambda k: F.transform(polygon, lambda p: p[k])
    bounds = [(f(axis(k)) * F.col("inverse")).cast("int") for f, k in ((F.array_min, 0), (F.array_min, 1), (F.array_max, 0), (F.array_max, 1))]
    return rows.select(
        *keys, "line_no", F.trim("text").alias("text"), F.when(F.size(polygon) > 0, F.array(*bounds)).alias("bbox"),
        F.bround(F.coalesce(score.cast("double"), F.lit(0.0)), 3).alias("confidence"),
    )


def text_of_lines(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the lines' text in order, blanks collapsed."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda b: b["text"]), " ")
    return boxes.groupBy(*keys).agg(F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))
