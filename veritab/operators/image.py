"""Pixel kernels over NumPy arrays (height x width x 3, blue green red), and their Arrow wrappers.

Rotation, cropping and stacking are exact. Kernels that interpolate or filter
follow the usual definitions; they are tested by tolerance, not bit by bit.
Randomness comes from a generator seeded by a hash of the row's id, so a
variant does not depend on partitions or on the order of rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions import constants as C

LARGEST, SMALLEST, POLYGON_LARGEST = 1500, 600, 1600
BLOCK_SIZE, BLOCK_OFFSET = 31, 11
IMAGE = "height int, width int, nChannels int, data binary"


def from_row(height: int, width: int, channels: int, data: bytes | None) -> np.ndarray | None:
    """The pixels of an image row as three channels; None where it could not be decoded."""
    if data is None or height is None or not height > 0 or not width > 0:  # nulls may arrive as NaN
        return None
    height, width, channels = int(height), int(width), int(channels)
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, :3]


def rotate(img: np.ndarray, angle: int) -> np.ndarray:
    """By 0, 90, 180 or 270 degrees clockwise."""
    if angle not in (0, 90, 180, 270):
        raise ValueError(f"unsupported angle: {angle}")
    return np.rot90(img, -angle // 90)


def region(img: np.ndarray, name: str, fraction: float = C.STRIP_FRACTION) -> np.ndarray:
    """full, right_strip or bottom_strip."""
    h, w = img.shape[:2]
    if name == "full":
        return img
    if name == "right_strip":
        return img[:, max(0, int(w * (1.0 - fraction))) :]
    if name == "bottom_strip":
        return img[max(0, int(h * (1.0 - fraction))) :]
    raise ValueError(f"unsupported region: {name}")


def gray(img: np.ndarray) -> np.ndarray:
    return np.floor(img.astype(np.float64) @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8)


def _weights(size: int, out: int, cubic: bool) -> np.ndarray:
    """A row of weights over the source for each output place."""
    step = size / out
    w = np.zeros((out, size))
    for i in range(out):
        if cubic:
            at = (i + 0.5) * step - 0.5
            base = int(np.floor(at))
            for k in range(base - 1, base + 3):
                x = abs(at - k)
                v = (1.25 * x - 2.25) * x * x + 1 if x <= 1 else ((-0.75 * x + 3.75) * x - 6) * x + 3 if x < 2 else 0.0
                w[i, min(max(k, 0), size - 1)] += v
        else:
            a, b = i * step, (i + 1) * step
            for k in range(int(a), min(size, int(np.ceil(b)))):
                w[i, k] = min(b, k + 1) - max(a, k)
    return w / w.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, scale: float) -> np.ndarray:
    """Mean of areas when it shrinks, cubic when it grows."""
    h, w = img.shape[:2]
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    rows, cols = _weights(h, nh, scale > 1), _weights(w, nw, scale > 1)
    out = np.tensordot(rows, img.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(cols, np.moveaxis(out, 1, 0), (1, 0)), 0, 1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def _padded(img: np.ndarray, n: int, mode: str = "reflect") -> np.ndarray:
    pad = ((n, n), (n, n)) + ((0, 0),) * (img.ndim - 2)
    return np.pad(img, pad, mode if min(img.shape[:2]) > n else "edge")


def _gauss(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    return g / g.sum()


def blur(img: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    """Gaussian of odd size, as floats."""
    g, n = _gauss(size), size // 2
    out = _padded(img.astype(np.float64), n, mode)
    h, w = img.shape[:2]
    out = sum(g[k] * out[k : k + h] for k in range(size))
    return sum(g[k] * out[:, k : k + w] for k in range(size))


def median(img: np.ndarray) -> np.ndarray:
    p, (h, w) = _padded(img, 1, "edge"), img.shape[:2]
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def bilateral(img: np.ndarray, size: int = 5, colour: float = 50.0, space: float = 50.0) -> np.ndarray:
    n, (h, w) = size // 2, img.shape[:2]
    p, own = _padded(img.astype(np.float64), n), img.astype(np.float64)
    total, weight = np.zeros_like(own), np.zeros_like(own)
    for i in range(-n, n + 1):
        for j in range(-n, n + 1):
            if i * i + j * j <= n * n:
                near = p[n + i : n + i + h, n + j : n + j + w]
                k = np.exp(-(i * i + j * j) / (2 * space**2) - (near - own) ** 2 / (2 * colour**2))
                total, weight = total + k * near, weight + k
    return np.clip(np.floor(total / weight + 0.5), 0, 255).astype(np.uint8)


def adaptive(img: np.ndarray) -> np.ndarray:
    """255 where a pixel exceeds its surrounding's Gaussian mean less an offset, else 0."""
    mean = np.floor(blur(img, BLOCK_SIZE, "edge") + 0.5)
    return np.where(img.astype(np.float64) > mean - BLOCK_OFFSET, 255, 0).astype(np.uint8)


def preprocess(img: np.ndarray, mode: str = "basic") -> tuple[np.ndarray, float]:
    """Gray, scaled so that the longest edge is within bounds, then filtered; and the scale."""
    out = gray(img)
    longest = max(out.shape)
    scale = LARGEST / longest if longest > LARGEST else SMALLEST / longest if longest < SMALLEST else 1.0
    if scale != 1.0:
        out = resize(out, scale)
    modes = {"basic": lambda x: x, "median": median, "bilateral": bilateral, "adaptive": adaptive}
    if mode not in modes:
        raise ValueError(f"unsupported preprocessing: {mode}")
    return modes[mode](out), out.shape[1] / img.shape[1]


def shrink_for_polygons(img: np.ndarray) -> tuple[np.ndarray, float]:
    longest = max(img.shape[:2])
    scale = POLYGON_LARGEST / longest if longest > POLYGON_LARGEST else 1.0
    return (resize(img, scale) if scale != 1.0 else img), scale


def _sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear, with mirrored borders."""
    h, w = img.shape[:2]
    mirror = lambda v, n: np.zeros_like(v) if n == 1 else np.where((m := np.abs(v) % (2 * n - 2)) > n - 1, 2 * n - 2 - m, m)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    at = lambda i, j: img[mirror(i, h), mirror(j, w)].astype(np.float64)
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def _warp(img: np.ndarray, to_source: np.ndarray) -> np.ndarray:
    h, w = img.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    u = np.tensordot(to_source, np.stack([x, y, np.ones_like(x)]).astype(np.float64), (1, 0))
    return _sample(img, u[0] / u[2], u[1] / u[2])


def tilt(img: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise about the centre."""
    h, w = img.shape[:2]
    a, cx, cy = np.deg2rad(degrees), w / 2, h / 2
    c, s = np.cos(a), np.sin(a)
    return _warp(img, np.array([[c, -s, cx - c * cx + s * cy], [s, c, cy - s * cx - c * cy], [0, 0, 1]]))


def brightness(img: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(img.astype(np.float64) * factor, 0, 255).astype(np.uint8)


def noise(img: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    return np.clip(img.astype(np.float64) + rng.normal(0, sigma, img.shape), 0, 255).astype(np.uint8)


def homography(source: list, target: list) -> np.ndarray:
    """The 3 x 3 map that takes four source points to four target points."""
    rows, values = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(values, float)), 1).reshape(3, 3)


def perspective(img: np.ndarray, corners: list) -> np.ndarray:
    """The image's corners (from the top left, clockwise) moved to `corners`."""
    h, w = img.shape[:2]
    return _warp(img, homography(corners, [(0, 0), (w, 0), (w, h), (0, h)]))


def generator(key: object, seed: int, part: int = 0) -> np.random.Generator:
    digest = hashlib.blake2b(f"{key}|{seed}|{part}".encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64)))


def _random_blur(img, rng):
    size = int(rng.choice([3, 5]))
    return np.clip(np.floor(blur(img, size) + 0.5), 0, 255).astype(np.uint8), f"blur_k{size}"


def _random_tilt(img, rng):
    degrees = float(rng.uniform(1, 3) * rng.choice([-1, 1]))
    return tilt(img, degrees), f"rotation_{degrees:+.1f}deg"


def _random_brightness(img, rng):
    factor = round(float(rng.uniform(0.8, 1.2)), 2)
    return brightness(img, factor), f"bright_{factor}"


def _random_noise(img, rng):
    sigma = int(rng.integers(5, 16))
    return noise(img, sigma, rng), f"noise_s{sigma}"


def _random_perspective(img, rng):
    h, w = img.shape[:2]
    offset = int(rng.integers(5, 16))
    move = rng.integers(0, offset + 1, 8).tolist()
    corners = [(move[0], move[1]), (w - move[2], move[3]), (w - move[4], h - move[5]), (move[6], h - move[7])]
    return perspective(img, corners), f"persp_{offset}px"


DISTORTIONS = (_random_blur, _random_tilt, _random_brightness, _random_noise, _random_perspective)


def distort(img: np.ndarray, key: object, seed: int = 42, variants: int = 2) -> list[tuple[str, np.ndarray]]:
    """(label, pixels) of each variant: one distortion with probability 0.7, else two different ones."""
    out = []
    for k in range(variants):
        rng = generator(key, seed, k)
        chosen = rng.choice(len(DISTORTIONS), 1 if rng.random() < 0.7 else 2, replace=False)
        pixels, labels = img, []
        for i in chosen.tolist():
            pixels, label = DISTORTIONS[i](pixels, rng)
            labels.append(label)
        out.append(("+".join(labels), pixels))
    return out


def stack(images: list[np.ndarray]) -> np.ndarray:
    """One below the other on white, as wide as the widest; a single image as it is."""
    if len(images) == 1:
        return images[0]
    out = np.full((sum(i.shape[0] for i in images), max(i.shape[1] for i in images), 3), 255, np.uint8)
    y = 0
    for i in images:
        out[y : y + i.shape[0], : i.shape[1]] = i
        y += i.shape[0]
    return out


def encode_png(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), img[:, :, ::-1].reshape(h, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def _row(img: np.ndarray) -> dict:
    return {"height": img.shape[0], "width": img.shape[1], "nChannels": img.shape[2], "data": np.ascontiguousarray(img).tobytes()}


def transform(images: DataFrame, spec: DataFrame, key: str = "image_id") -> DataFrame:
    """Every image (key and IMAGE columns) cut to a region and turned, for each row of spec (small: it is broadcast)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                img = from_row(r.height, r.width, r.nChannels, r.data)
                if img is not None:
                    out.append({key: getattr(r, key), "attempt_no": r.attempt_no} | _row(rotate(region(img, r.region), r.angle)))
            if out:
                yield pd.DataFrame(out)

    kind = images.schema[key].dataType.simpleString()
    each = images.select(key, "height", "width", "nChannels", "data").crossJoin(F.broadcast(spec.select("attempt_no", "region", "angle")))
    return each.mapInPandas(run, f"{key} {kind}, attempt_no int, {IMAGE}")


def distorted(images: DataFrame, key: str = "image_id", seed: int = 42, variants: int = 2) -> DataFrame:
    """key, variant_no, variant_type and pixels of each variant; undecodable images have none."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                img = from_row(r.height, r.width, r.nChannels, r.data)
                if img is not None:
                    out += [{key: getattr(r, key), "variant_no": k, "variant_type": label} | _row(pixels) for k, (label, pixels) in enumerate(distort(img, getattr(r, key), seed, variants))]
            if out:
                yield pd.DataFrame(out)

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "nChannels", "data").mapInPandas(run, f"{key} {kind}, variant_no int, variant_type string, {IMAGE}")


def stacked(parts: DataFrame, key: str = "record_id", order: str = "part_no") -> DataFrame:
    """One composite for each key of its images in order; a record's attachments are few."""
    kind = parts.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        images = [i for i in (from_row(r.height, r.width, r.nChannels, r.data) for r in frame.itertuples(index=False)) if i is not None]
        return pd.DataFrame([{key: frame[key].iloc[0], "image_count": len(images)} | _row(stack(images))] if images else [], columns=[key, "image_count", "height", "width", "nChannels", "data"])

    return parts.select(key, order, "height", "width", "nChannels", "data").groupBy(key).applyInPandas(run, f"{key} {kind}, image_count int, {IMAGE}")


def stack_layout(parts: DataFrame, key: str = "record_id", order: str = "part_no") -> DataFrame:
    """Where each part goes in its composite: y_offset, and the composite's size. No pixels are read."""
    from pyspark.sql import Window

    group = Window.partitionBy(key)
    running = group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.select(
        key, order, (F.sum("height").over(running) - F.col("height")).alias("y_offset"),
        F.sum("height").over(group).alias("total_height"), F.max("width").over(group).alias("max_width"),
    )


def write_pngs(images: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Write one PNG for each row below folder (a URI that executors share); returns name, path and bytes when evaluated."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                img = from_row(r.height, r.width, r.nChannels, r.data)
                if img is None:
                    continue
                data = encode_png(img)
                with files.open_output_stream(f"{root}/{getattr(r, name)}.png", compression=None) as sink:
                    sink.write(data)
                out.append({"name": getattr(r, name), "path": f"{folder}/{getattr(r, name)}.png", "bytes": len(data)})
            if out:
                yield pd.DataFrame(out)

    return images.select(name, "height", "width", "nChannels", "data").mapInPandas(run, "name string, path string, bytes bigint")
