"""Adapters of the two known engines: what they return, as text and boxes.

The libraries are imported by the worker that needs them, when it makes its
first instance; nothing here is needed to read recorded attempts. install()
puts both under their names into the registry.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from veritab.functions import constants as C
from veritab.operators import image as I
from veritab.sources import engines

Found = tuple[str, list[dict]]


def _corners(left: list, top: list, right: list, bottom: list, inverse: float) -> list[int]:
    return [int(min(left) * inverse), int(min(top) * inverse), int(max(right) * inverse), int(max(bottom) * inverse)]


def from_words(data: dict[str, list], scale: float, least: int = C.WORD_CONFIDENCE) -> Found:
    """A word table (parallel lists) to lines in the order of their first word."""
    lines: dict[tuple, list[int]] = {}
    for i, (text, confidence) in enumerate(zip(data["text"], data["conf"], strict=True)):
        if text.strip() and int(confidence) >= least:
            lines.setdefault((data["block_num"][i], data["par_num"][i], data["line_num"][i]), []).append(i)
    boxes = []
    for own in lines.values():
        left, top = [data["left"][i] for i in own], [data["top"][i] for i in own]
        right, bottom = [data["left"][i] + data["width"][i] for i in own], [data["top"][i] + data["height"][i] for i in own]
        mean = sum(int(data["conf"][i]) for i in own) / len(own) / 100.0
        boxes.append({"text": " ".join(data["text"][i].strip() for i in own), "bbox": _corners(left, top, right, bottom, 1.0 / scale), "confidence": round(mean, 3)})
    return " ".join(" ".join(b["text"] for b in boxes).split()), boxes


def from_polygons(results: list, scale: float) -> Found:
    """Detections (rec_texts, dt_polys, rec_scores) to lines; a blank text gives none, a missing polygon no box."""
    lines, boxes = [], []
    for found in results:
        inner = found if isinstance(found, dict) else getattr(found, "res", None)
        texts, polygons, scores = ((inner.get(k) if isinstance(inner, dict) else getattr(found, k, None)) for k in ("rec_texts", "dt_polys", "rec_scores"))
        texts, polygons, scores = ([] if x is None else x for x in (texts, polygons, scores))
        for i, text in enumerate(texts):
            if not text.strip():
                continue
            lines.append(text.strip())
            if i < len(polygons) and polygons[i] is not None:
                xs, ys = [p[0] for p in polygons[i]], [p[1] for p in polygons[i]]
                boxes.append({"text": text.strip(), "bbox": _corners(xs, ys, xs, ys, 1.0 / scale), "confidence": round(float(scores[i]), 3) if i < len(scores) else 0.0})
    return " ".join(lines), boxes


def word_engine(recognise: Callable[[np.ndarray, int], dict] | None = None) -> Callable:
    """An engine that is asked for a word table of a prepared gray picture."""
    if recognise is None:
        import pytesseract

        def recognise(gray: np.ndarray, psm: int) -> dict:
            return pytesseract.image_to_data(gray, config=C.WORD_ENGINE_OPTIONS.format(psm=psm), output_type=pytesseract.Output.DICT)

    def run(img: np.ndarray, mode: str, psm: int) -> Found:
        gray, scale = I.preprocess(img, mode)
        return from_words(recognise(gray, psm), scale)

    return run


def polygon_engine(recognise: Callable[[np.ndarray], list] | None = None) -> Callable:
    """An engine that is asked for text polygons of a picture of bounded size."""
    if recognise is None:
        from paddleocr import PaddleOCR

        recognise = PaddleOCR(**C.POLYGON_ENGINE_OPTIONS).predict

    def run(img: np.ndarray, mode: str, psm: int) -> Found:
        small, scale = I.shrink_for_polygons(img)
        return from_polygons(recognise(small), scale)

    return run


def install() -> None:
    engines.register("tesseract", word_engine)
    engines.register("paddleocr", polygon_engine)
