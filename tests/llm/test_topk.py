import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, score int"


def brute(rows, k):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, list(v)) for i, v in {(i, tuple(v)) for i, v in good}]
    out = {}
    for q, v in good:
        if q % 3 == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)]
            out.setdefault(q, []).extend(found)
    return {(q, r + 1, i, -s) for q, f in out.items() for r, (s, i) in enumerate(sorted(f)[:k])}


@pytest.mark.parametrize("shard_rows", [20, 64, 8192])
def test_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "QUERY_ROWS", 30)
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * (1 + 3 * (i % 5 == 0))).round(1).tolist()) for i in range(200)]
    rows += [(i, [1.0] * 6) for i in range(300, 330)] + [(330, [1.0] * 6)] * 3
    rows += [(400, None), (401, [1.0, None] + [0.0] * 4), (402, [float("nan")] + [0.0] * 5), (403, [float("inf")] + [0.0] * 5), (None, [9.0] * 6), (405, [1.0, 2.0]), (408, [2.0, 1.0]), (411, [])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, k=5, shard_rows=shard_rows).collect()}
    assert got == brute(rows, 5)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(df, F.col("vec_id") % 3 == 0).count() == 0


def test_bounds_cut_leaves_and_thresholds_are_shared():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 100
    vectors = (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8))).astype(np.int64)
    ids = np.arange(4000)
    tree = topk.build_tree(vectors, 32)
    queries = vectors[:50]
    low = np.full(50, -(2**63))
    q, found, score, visited = topk.search(tree, vectors, ids, queries, ids[:50], low, 10)
    assert visited < 0.5 * 50 * int(tree["leaf"].sum())
    kth = np.array([score[q == i].min() for i in range(50)])
    *again, fewer = topk.search(tree, vectors, ids, queries, ids[:50], kth, 10)
    assert fewer <= visited and np.array_equal(again[1], found)
