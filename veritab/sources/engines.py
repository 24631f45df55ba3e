"""Recognition engines, by name.

An engine takes a batch of images and returns text and boxes. None is bundled
but `recorded`, which reads attempts from a table; others register a callable
that workers import lazily, one instance for each worker.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.operators import image as I

#: name: a factory that returns a function from (pixels, preprocessing, page mode) to (text, boxes)
_REGISTRY: dict[str, Callable] = {}
FOUND = "text string, boxes array<struct<text:string,bbox:array<int>,confidence:double>>, elapsed_ms double"


def register(name: str, factory: Callable) -> None:
    _REGISTRY[name] = factory


def get(name: str) -> Callable:
    if name not in _REGISTRY:
        raise ValueError(f"unknown engine: {name}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def recorded(attempts: DataFrame, key: str = "label_id") -> Callable[[DataFrame, tuple], DataFrame]:
    """An attempt runner that looks up recorded texts."""
    def run(pending: DataFrame, spec: tuple) -> DataFrame:
        return attempts.filter(F.col("attempt_no") == spec[0]).join(pending.select(key), key, "left_semi").select(key, "text", "elapsed_ms")

    return run


def live(images: DataFrame, name: str, key: str = "label_id") -> Callable[[DataFrame, tuple], DataFrame]:
    """An attempt runner that cuts, turns and recognises images (key and pixels) of pending rows."""
    factory = get(name)
    kind = images.schema[key].dataType.simpleString()

    def run(pending: DataFrame, spec: tuple) -> DataFrame:
        _, part, angle, mode, psm = spec

        def recognise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            engine = factory()
            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    began = time.perf_counter()
                    img = I.from_row(r.height, r.width, r.nChannels, r.data)
                    text, boxes = ("", []) if img is None else engine(I.rotate(I.region(img, part), angle), mode, psm)
                    out.append({key: getattr(r, key), "text": text, "boxes": boxes, "elapsed_ms": round((time.perf_counter() - began) * 1000, 2)})
                yield pd.DataFrame(out, columns=[key, "text", "boxes", "elapsed_ms"])

        return images.join(pending.select(key), key, "left_semi").select(key, "height", "width", "nChannels", "data").mapInPandas(recognise, f"{key} {kind}, {FOUND}")

    return run


def text_only(images: DataFrame, name: str, key: str = "label_id") -> DataFrame:
    """key and text of one pass over whole images."""
    return live(images, name, key)(images.select(key), C.FIRST_ATTEMPT).select(key, "text")
