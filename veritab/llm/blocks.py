"""Compressed runs of numbers and words, as operators that work by blocks exchange them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
#: Bytes of text that a block holds, and that a bucket answers for, about; buckets at least; buckets of a table at most.
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS, MOST_TABLE_BUCKETS = 8 << 20, 8 << 20, 8, 100_000


def release() -> None:
    """Give memory that is free in this process back to the system: idle workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pack(numbers: np.ndarray, width: int = 8) -> bytes:
    """Unsigned integers of 4 or 8 bytes, compressed byte plane by byte plane."""
    plain = np.ascontiguousarray(numbers.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
    return zstandard.compress(bytes([width]) + np.ascontiguousarray(plain.T).tobytes(), LEVEL)


def unpack(payload: bytes) -> np.ndarray:
    raw = zstandard.decompress(payload)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel()


def pack_pairs(left: np.ndarray, right: np.ndarray) -> bytes:
    """Two equally long arrays of unsigned 64-bit integers."""
    first = pack(left)
    return len(first).to_bytes(4, "little") + first + pack(right)


def unpack_pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(payload[:4], "little")
    return unpack(payload[4:cut]), unpack(payload[cut:])


def pack_floats(numbers: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(numbers, np.float64).view(np.uint64).ravel())


def unpack_floats(payload: bytes) -> np.ndarray:
    return unpack(payload).view(np.float64)


def pack_words(words: list[bytes]) -> bytes:
    head = np.array([len(words), *map(len, words)], "<u4").tobytes()
    return zstandard.compress(head + b"".join(words), LEVEL)


def unpack_words(payload: bytes) -> list[bytes]:
    raw = zstandard.decompress(payload)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (4 * (n + 1) + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends[:-1]], ends, strict=True)]


class Numbered(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def runs(labels: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values."""
    if not len(labels):
        return []
    edges = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
    return list(zip(edges, edges[1:], strict=False))


def bucket_count(docs: DataFrame, text_col: str, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets in proportion to the counted bytes of text, so that a bucket's share does not grow with the input."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")) + F.lit(1))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // bucket_bytes))


def spark_hash(numbers: np.ndarray) -> np.ndarray:
    """hash() of bigints: 32-bit Murmur3 with seed 42, by which Spark deals rows to a table's buckets."""
    x = numbers.astype(np.uint64)
    h = np.full(len(x), 42, np.uint32)
    u = np.uint32
    for half in (x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)):
        k = half.astype(np.uint32) * u(0xCC9E2D51)
        h ^= ((k << u(15)) | (k >> u(17))) * u(0x1B873593)
        h = ((h << u(13)) | (h >> u(19))) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def block_numbers(task: int, buckets: int) -> Iterator[int]:
    """Numbers of a task's blocks that all fall into one bucket, so that the task writes one file for each kind of row."""
    step = max(64, 4 * buckets)
    for first in count(0, step):
        some = (task << 32) + first + np.arange(step)
        yield from some[spark_hash(some) % buckets == task % buckets].tolist()
