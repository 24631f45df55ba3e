"""Tables of text records, images and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import text as T

#: What a data frame library reads as missing in the evaluator's input.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def records(spark: SparkSession, path: str, missing: list[str] | None = None) -> DataFrame:
    """A CSV table whose cells are all text: quoted cells may hold line breaks and doubled quotes, empty ones are ''.

    missing: cell texts that count as empty too (MISSING for the evaluator's input).
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, inferSchema=False)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns]).na.fill("")
    if missing:
        rows = rows.select(*[F.when(F.col(f"`{c}`").isin(*missing), "").otherwise(F.col(f"`{c}`")).alias(c) for c in rows.columns])
    return rows


def export(spark: SparkSession, path: str, key: str = "TTB ID") -> DataFrame:
    """As records(), with the id stripped of blanks and quotes."""
    return records(spark, path).withColumn(key, T.clean_id(F.col(f"`{key}`")))


def images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path and pixels of every image; those that cannot be decoded have a null height."""
    read = spark.read.format("image").option("recursiveFileLookup", str(recursive).lower()).load(path)
    read = read.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    bad = F.col("height") < 0
    return read.select("path", *[F.when(~bad, F.col(c)).alias(c) for c in ("height", "width", "nChannels", "data")])


def listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Paths and sizes of files, sorted; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length").orderBy("path")


def relative(path: Column) -> Column:
    """A relative path in one spelling: slashes only, no '.' parts, none doubled."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(parts, "/")


def below(path: Column, root: str) -> Column:
    """What of a file's path or URI follows the folder root; null for files elsewhere."""
    plain = lambda x: relative(F.regexp_replace(F.regexp_replace(x, "^[A-Za-z][A-Za-z0-9+.-]*:", ""), "%20", " "))
    start = F.concat(plain(F.lit(root)), F.lit("/"))
    return F.when(plain(path).startswith(start), F.substring(plain(path), F.char_length(start) + 1, F.char_length(plain(path))))


def with_existence(rows: DataFrame, files: DataFrame, root: str, path: str = "image_path") -> DataFrame:
    """rows with image_exists: whether files (column path) has the row's path, which is relative to root."""
    known = files.select(below(F.col("path"), root).alias("__path")).filter("__path is not null").distinct().withColumn("image_exists", F.lit(True))
    joined = rows.withColumn("__path", relative(F.trim(F.coalesce(path, F.lit(""))))).join(known, "__path", "left").drop("__path")
    return joined.withColumn("image_exists", F.coalesce("image_exists", F.lit(False)))


def write_records(rows: DataFrame, path: str) -> None:
    """As records() reads it; blanks around a value stay."""
    rows.write.mode("overwrite").options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, header=True)
