"""Exact top-k search by inner product: a ball tree for each shard.

Shards are hashes of the id, of bounded size; each gets a ball tree. A batch
of queries searches a tree by branch and bound: a node's bound is the least
upper bound <q, centre> + |q| * radius on its path, leaves are visited in
descending order of bound, and a query stops at the first leaf whose bound is
below its k-th score. The k-th scores are shared: every query first searches
its own shard, and what it finds there is the threshold that it starts with in
all others. (A query batch, shard) pair is the unit of work; queries are dealt
to batches of bounded size, so no task holds all queries or all vectors.

Components become floor(64 * x); scores are exact integers. Ties go to the
smaller id.

Edge cases: vectors that are null or hold a null or a non-finite component,
and rows without an id, take no part; vectors of different lengths do not meet;
empty vectors score 0 with each other; exact repeats of a row count once; an id
with several vectors is a query for each of them, ranked together, and never
its own partner; a table with fewer than k partners returns all; an empty
table returns no rows; further columns are ignored. Scores must fit a long.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm import shared

SHARD_ROWS = 8192
QUERY_ROWS = 1024
LEAF_ROWS = 128
EXACT = 2.0**53
FOUND = "query_id bigint, vec_id bigint, score bigint, home int"


def quantized(vector: str = "embedding") -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 64))


def usable(vector: str = "embedding") -> Column:
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def build_tree(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict:
    """Arrays of a ball tree over integer vectors; children follow their parent."""
    n, d = vectors.shape
    points = vectors.astype(np.float64)
    order = np.arange(n)
    nodes, todo = [], [(0, n, -1)]
    while todo:
        a, b, parent = todo.pop()
        own = points[order[a:b]]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        me = len(nodes)
        leaf = b - a <= leaf_rows or away.max() == 0
        nodes.append((centre, away.max(), parent, a, b, leaf))
        if not leaf:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            middle = (b - a) // 2
            along = np.argpartition(own @ (other - one), middle)
            order[a:b] = order[a:b][along]
            todo += [(a, a + middle, me), (a + middle, b, me)]
    centre, radius, parent, start, end, leaf = zip(*nodes, strict=True)
    return {"centre": np.array(centre, np.float64).reshape(len(nodes), d), "radius": np.array(radius), "parent": np.array(parent), "start": np.array(start), "end": np.array(end), "leaf": np.array(leaf), "order": order}


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if largest < EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each query: higher score, then smaller id."""
    by = np.lexsort((ids, -score, q))
    first = np.flatnonzero(np.diff(q[by], prepend=-1))
    place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return by[place < k]


def search(tree: dict, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query number, id, score) of the k best partners that reach kth, and the leaves visited."""
    m = len(queries)
    as_float = queries.astype(np.float64)
    bound = as_float @ tree["centre"].T + np.sqrt((as_float**2).sum(axis=1))[:, None] * tree["radius"]
    bound += np.abs(bound) * 1e-9 + 1e-6  # rounding never cuts a partner
    for node in range(1, len(tree["parent"])):  # parents come first
        np.minimum(bound[:, node], bound[:, tree["parent"][node]], out=bound[:, node])
    leaves = np.flatnonzero(tree["leaf"])
    ranked = np.argsort(-bound[:, leaves], axis=1, kind="stable")
    kth = kth.astype(np.float64).copy()
    q, found, score, visited = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    active = np.arange(m)
    for turn in range(len(leaves)):
        nodes = leaves[ranked[active, turn]]
        going = bound[active, nodes] >= kth[active]
        active, nodes = active[going], nodes[going]
        if not len(active):
            break
        visited += len(active)
        by = np.argsort(nodes, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(nodes[by], prepend=-1)), len(by))
        more = [(q, found, score)]
        for a, b in zip(edges, edges[1:], strict=False):
            node, who = nodes[by[a]], active[by[a:b]]
            rows = tree["order"][tree["start"][node] : tree["end"][node]]
            got = _products(queries[who], vectors[rows])
            fits = (got >= kth[who][:, None]) & (ids[rows][None, :] != own[who][:, None])
            i, j = np.nonzero(fits)
            more.append((who[i], ids[rows][j], got[i, j]))
        q, found, score = (np.concatenate(x) for x in zip(*more, strict=True))
        keep = _best(q, score, found, k)
        q, found, score = q[keep], found[keep], score[keep]
        counts = np.bincount(q, minlength=m)
        last = np.flatnonzero(np.diff(q, append=-1))
        full = last[counts[q[last]] >= k]
        kth[q[full]] = np.maximum(kth[q[full]], score[full])
    return q, found, score, visited


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), width)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best partners of each query row."""
    base = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("vec_id"), quantized(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    base = base.withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"])
    base = shared.materialize(base, "topk-vectors")
    # one row for each length of vector
    sizes = base.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("m")).select(
        "dim", F.ceil(F.col("n") / shard_rows).alias("shards"), F.greatest(F.ceil(F.col("m") / QUERY_ROWS), F.lit(1)).alias("chunks")
    )
    sizes = base.sparkSession.createDataFrame(sizes.collect(), "dim int, shards bigint, chunks bigint")
    placed = base.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")))

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        dim, shard, chunks = (x.as_py() for x in key)
        held = _matrix(table.column("v"), dim)
        small = held.astype(np.int32) if np.abs(held).max(initial=0) < 2**31 else held
        blob = pickle.dumps((build_tree(held), small, table.column("vec_id").to_numpy()), protocol=5)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": [shard], "chunks": [chunks], "tree": pa.array([blob], pa.binary())})

    trees = shared.materialize(
        placed.select("dim", "shard", "chunks", "vec_id", "v").groupBy("dim", "shard", "chunks").applyInArrow(grow, "dim int, shard bigint, chunks bigint, tree binary"),
        "topk-trees",
    )
    each_tree = trees.select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "tree")
    lowest = F.lit(-(2**63)).cast("bigint")
    asked = placed.filter("asks").select("dim", "shards", "shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("chunks")).alias("chunk"), F.col("vec_id").alias("query_id"), "v")

    def meet(wanted: DataFrame, home: int) -> DataFrame:
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            names = [x.split()[0] for x in FOUND.split(", ")]
            if not left.num_rows or not right.num_rows:
                return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.int32())], names=names)
            tree, held, ids = pickle.loads(right.column("tree")[0].as_py())
            own = left.column("query_id").to_numpy()
            q, found, score, _ = search(tree, held.astype(np.int64), ids, _matrix(left.column("v"), key[0].as_py()), own, left.column("kth").to_numpy(), k)
            return pa.table([pa.array(own[q]), pa.array(found), pa.array(score), pa.array(np.full(len(q), home), pa.int32())], names=names)

        keys = ("dim", "shard", "chunk")
        return wanted.select(*keys, "query_id", "v", "kth").groupBy(*keys).cogroup(each_tree.groupBy(*keys)).applyInArrow(run, FOUND)

    at_home = shared.materialize(meet(asked.withColumn("kth", lowest), 1), "topk-home")
    reached = at_home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    elsewhere = (
        asked.join(reached, "query_id", "left")
        .withColumn("kth", F.coalesce("kth", lowest)).withColumnRenamed("shard", "own_shard")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
        .filter("shard <> own_shard")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        at_home.unionByName(meet(elsewhere, 0))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
