"""Repeated recognition attempts: merging, and stopping once all is found.

Two plans give the same rows. The prefix plan folds over an image's recorded
attempts and stops judging where all is found; the wave plan runs an attempt
only for images that still need it, for engines that are costly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.functions import match as M
from veritab.functions import text as T
from veritab.operators.verify import evaluate
from veritab.sources.tables import written

SPEC = "attempt_no int, region string, angle int, preprocess_mode string, psm int"


def specs(spark: SparkSession, engine: str, fallbacks: bool = True) -> DataFrame:
    """The attempts of an engine in order; at most eight rows."""
    if engine not in C.FALLBACKS:
        raise ValueError(f"unknown engine: {engine}")
    return spark.createDataFrame([C.FIRST_ATTEMPT, *(C.FALLBACKS[engine] if fallbacks else [])], SPEC)


def engine_or_default(engine: Column) -> Column:
    """An engine's name as a request gives it; what is unknown becomes the first engine."""
    return F.when(engine.isin(*C.ENGINES), engine).otherwise(C.ENGINES[0])


def merged(texts: Column) -> Column:
    """An array of texts in order to one text: blank ones dropped, blanks collapsed."""
    kept = F.filter(texts, lambda t: F.trim(t) != "")
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))


def merge_attempts(attempts: DataFrame, key: str = "label_id") -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("attempt_no", "text"))), lambda a: a["text"])
    return attempts.groupBy(key).agg(merged(ordered).alias("text"), F.count(F.lit(1)).alias("attempts"))


def text_by_angle(attempts: DataFrame, key: str = "label_id") -> DataFrame:
    """For each angle the text of the first attempt on the full image."""
    return attempts.filter("region = 'full'").groupBy(key, "angle").agg(F.min_by("text", "attempt_no").alias("text"))


def angle_map(attempts: DataFrame, key: str = "label_id") -> DataFrame:
    return text_by_angle(attempts, key).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("angle", "text")))).alias("ocr_by_angle"))


def primary(attempts: DataFrame) -> DataFrame:
    """Attempts whose boxes need no change of coordinates."""
    return attempts.filter("region = 'full' AND angle = 0")


def _needs_more(application: Column, text: Column) -> Column:
    """needs_fallback of an application's fields against a text, without anything else of a verdict."""
    def judged(normalized: Column) -> Column:
        return M.needs_fallback({n: M.MATCHERS[n](application[n], normalized) for n in C.FIELDS}, M.detect_warning(normalized))

    return T.let(T.normalize(text), judged)


def prefix_plan(applications: DataFrame, attempts: DataFrame, key: str = "label_id", required: Column | None = None) -> DataFrame:
    """Each application evaluated at the first prefix of attempts that needs no further one, else at the last.

    The attempts of a key meet in one map-side-combined aggregate; a fold goes
    through them in order, judges the text so far and takes no further one once
    all is found. Only the chosen text is evaluated in full. Returns the
    evaluated row with text, attempt_no (the last attempt used) and ocr_ms.
    """
    tries = attempts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("attempt_no", F.col("text"), F.col("elapsed_ms").cast("double").alias("ms")))).alias("__tries"))
    number = attempts.schema["attempt_no"].dataType
    start = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("ocr_ms"), F.lit(None).cast(number).alias("attempt_no"), F.lit(True).alias("more"))
    application = F.struct(*[F.col(n) for n in C.FIELDS])

    def take(so_far: Column, attempt: Column) -> Column:
        return T.let(merged(F.array(so_far["text"], attempt["text"])), lambda text: F.struct(
            text.alias("text"), (so_far["ocr_ms"] + F.coalesce(attempt["ms"], F.lit(0.0))).alias("ocr_ms"),
            attempt["attempt_no"].alias("attempt_no"), _needs_more(application, text).alias("more"),
        ))

    fold = F.aggregate("__tries", start, lambda so_far, attempt: F.when(so_far["more"], take(so_far, attempt)).otherwise(so_far))
    chosen = applications.join(tries, key).withColumn("__chosen", fold)
    chosen = chosen.select(*applications.columns, *[F.col(f"__chosen.{c}").alias(c) for c in ("text", "ocr_ms", "attempt_no")])
    return evaluate(chosen, "text", required)


def wave_plan(
    applications: DataFrame, engine: str, run_attempt: Callable[[DataFrame, tuple], DataFrame], key: str = "label_id", required: Column | None = None,
    store: Callable[[DataFrame], DataFrame] = written, fallbacks: bool = True,
) -> DataFrame:
    """The same rows with an engine that is called for pending images only.

    run_attempt(pending, spec) gets the pending applications and a spec
    (attempt_no, region, angle, preprocess_mode, psm), and returns key, text and
    elapsed_ms. `store` keeps what a wave has found as a table, so that no image
    is recognised twice and plans stay short.
    """
    done = None
    columns = applications.columns
    pending = applications.withColumns({"so_far": F.array().cast("array<string>"), "ocr_ms": F.lit(0.0)})
    for spec in [C.FIRST_ATTEMPT, *(C.FALLBACKS[engine] if fallbacks else [])]:
        found = run_attempt(pending.select(*columns), spec).select(key, F.col("text").alias("t"), F.col("elapsed_ms").alias("ms"))
        now = pending.join(found, key).withColumns({"so_far": F.array_append("so_far", F.col("t")), "ocr_ms": F.col("ocr_ms") + F.col("ms")}).drop("t", "ms")
        now = store(evaluate(now.withColumn("text", merged(F.col("so_far"))), "text", required).withColumn("attempt_no", F.lit(spec[0])))
        settled = now.filter("NOT needs_fallback").drop("so_far")
        done = settled if done is None else done.unionByName(settled)
        last, pending = now, now.filter("needs_fallback").select(*columns, "so_far", "ocr_ms")
        if pending.isEmpty():
            break
    return done.unionByName(last.filter("needs_fallback").drop("so_far"))
