"""The three calls that most programs need: text of images, verdicts on texts, verdicts on images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from veritab.operators import associate, attempts
from veritab.operators.verify import evaluate
from veritab.sources import engines


def read_images(images: DataFrame, engine: str, key: str = "label_id") -> DataFrame:
    """key and text of every image (key and pixels), by a registered engine."""
    return engines.text_only(images, engine, key)


def evaluate_texts(rows: DataFrame, key: str = "label_id", expected_warning: Column | None = None, debug: Column | None = None) -> DataFrame:
    """key and the service's entry for rows that hold expected values and `text`."""
    return associate.answer(evaluate(rows, required=expected_warning), key, expected_warning, debug)


def evaluate_images(applications: DataFrame, images: DataFrame, engine: str, key: str = "label_id", expected_warning: Column | None = None, debug: Column | None = None) -> DataFrame:
    """As evaluate_texts(), from images: further attempts are made where a field is not found. Applications without an image have no row."""
    found = attempts.wave_plan(applications.join(images.select(key), key, "left_semi"), engine, engines.live(images, engine, key), key, expected_warning)
    return associate.answer(found, key, expected_warning, debug)
