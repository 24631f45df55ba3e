"""The evaluator as a job: records and recorded attempts, or images, in; detail, documents and summary out.

    python -m veritab.plans.job --records filtered.csv --attempts attempts.parquet --out results --engine tesseract
    python -m veritab.plans.job --records filtered.csv --images dataset --out results --engine paddleocr
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.operators import attempts as A
from veritab.operators import evaluation
from veritab.operators.verify import missing_image
from veritab.sources import engines, files
from veritab.sources.tables import written


def applications(records: DataFrame) -> DataFrame:
    """Records of the evaluator's CSV as applications; cells that are '' are missing, blanks are kept."""
    value = lambda c: F.nullif(F.col(f"`{c}`"), F.lit(""))
    return records.select(
        F.trim("`TTB ID`").alias("label_id"), F.trim("image_path").alias("image_path"), value("Brand Name").alias("brand_name"),
        value("alcohol_content").alias("alcohol_content"), value("net_contents").alias("net_contents"), F.col("variant_type").alias("variant_type"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.concat_ws("|", "label_id", "image_path"))


def own_attempts(attempts: DataFrame, engine: str) -> DataFrame:
    """The recorded attempts that are an engine's own, numbered as the engine makes them.

    An attempt is the engine's if region, angle, preprocessing and page mode are
    those of one of its specs, whatever number it was recorded under.
    """
    wanted = A.specs(attempts.sparkSession, engine)  # at most eight rows
    how = ["region", "angle", "preprocess_mode", "psm"]
    return attempts.drop("attempt_no").join(F.broadcast(wanted), how)


def _complete(found: DataFrame, keyed: DataFrame, engine: str) -> DataFrame:
    """found, and the rows of keyed that it lacks as images that were not found."""
    lost = keyed.join(found.select("key"), "key", "left_anti").withColumns({"text": F.lit(""), "attempt_no": F.lit(None).cast("int"), "ocr_ms": F.lit(0.0)})
    lost = missing_image(lost, 0.0).withColumns({"error": F.lit("image_not_found"), "ocr_by_angle": F.lit(None).cast("map<int,string>")})
    whole = found.withColumn("error", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)
    return whole.withColumns({"engine": F.lit(engine), "total_ms": F.col("ocr_ms")}).drop("key")


def results(apps: DataFrame, attempts: DataFrame, engine: str) -> DataFrame:
    """Evaluated rows of all applications by image path; those without a recorded attempt of the engine count as images that were not found."""
    keyed = _keyed(apps)
    of = _keyed(own_attempts(attempts, engine)).select("key", "attempt_no", "region", "angle", "text", "elapsed_ms")
    found = A.prefix_plan(keyed, of, "key").join(A.angle_map(of, "key"), "key")
    return _complete(found, keyed, engine)


def live_results(apps: DataFrame, images: DataFrame, root: str, engine: str, store: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """As results(), from images (path and pixels) below root, by a registered engine: an attempt is made only for images that still need it.

    An image that is there and cannot be decoded has no text; an application
    whose path names no image counts as an image that was not found.
    """
    keyed = _keyed(apps)
    pixels = images.withColumn("image_path", files.below(F.col("path"), root)).drop("path")
    own = keyed.withColumn("__path", files.relative(F.col("image_path"))).join(pixels.withColumnRenamed("image_path", "__path"), "__path").drop("__path")
    pixels = own.select("key", "height", "width", "nChannels", "data")
    run, texts = engines.live(pixels, engine, "key"), []

    def recognise(pending: DataFrame, spec: tuple) -> DataFrame:
        made = store(run(pending, spec).withColumns({"attempt_no": F.lit(spec[0]), "region": F.lit(spec[1]), "angle": F.lit(spec[2])}))
        texts.append(made.select("key", "attempt_no", "region", "angle", "text"))
        return made

    found = A.wave_plan(own.select(*keyed.columns), engine, recognise, "key", store=store)
    every = texts[0]
    for more in texts[1:]:
        every = every.unionByName(more)
    return _complete(found.join(A.angle_map(every, "key"), "key"), keyed, engine)


def main(arguments: list[str] | None = None) -> str:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("--records", required=True)
    source = options.add_mutually_exclusive_group(required=True)
    source.add_argument("--attempts", help="a table of recorded attempts")
    source.add_argument("--images", help="the folder that image paths are relative to; needs a registered engine")
    options.add_argument("--out", required=True)
    options.add_argument("--engine", choices=C.ENGINES, default=C.ENGINES[0])
    given = options.parse_args(arguments)
    spark = SparkSession.builder.appName("evaluate").getOrCreate()
    apps = applications(files.records(spark, given.records, files.MISSING))
    if given.attempts:
        evaluated = results(apps, spark.read.parquet(given.attempts), given.engine)
    else:
        evaluated = live_results(apps, files.images(spark, given.images, recursive=True), given.images, given.engine)
    evaluated = evaluated.cache()
    watched, counts = evaluation.observed(evaluated)
    evaluation.write_records(watched, f"{given.out}/records")
    evaluation.write_detail(evaluated, f"{given.out}/detail")
    row = evaluation.summary(evaluated, evaluated, given.engine)
    evaluation.write_summary(row, f"{given.out}/summary")
    text = f"{counts.get['records']} records\n{evaluation.report(row)}"
    evaluated.unpersist()
    return text


if __name__ == "__main__":
    print(main())
