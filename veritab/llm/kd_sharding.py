"""Sharding by a k-d tree over metadata.

Distinct texts are points that weigh the bytes of all their copies. Their
dimensions are source and language (each value at a hashed place) and the
logarithm of the size, all scaled to [0, 1] over all points. A node is split at
its weighted median along its widest dimension until it weighs no more than a
leaf's target; only points that agree in all metadata are told apart by a
digest. Leaves are taken in the tree's order, and a shard is a run of them: a
region of the metadata, not a sample of it.

Medians come from weighted histograms that are combined map-side, so no node's
rows ever meet in one task. A point's node is a column of the level's table;
the driver holds the splits of one level and the leaves' weights, which are
bounded by total weight over target, never the points.

Law: `bytes`. Copies of one text stay in one shard unless they alone exceed a
shard's fair share; then they are divided by a hash of their ids into points.
A text that weighs more than 1 / HEAVY of a fair share, and not a whole one, is no
point: such texts, fewer than HEAVY * shards, go to the lightest shard, heaviest
first, and the runs of leaves fill what they leave of each shard.

Edge cases: a null text has size 1 (no bytes, plus 1) and groups with empty
texts; a null source or language is a value of its own (that of ''); repeated
rows and ids are rows of their own; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm import shared

METADATA = ("by_source", "by_lang", "by_length")
DIMENSIONS = (*METADATA, "by_digest")
BINS = 256
HEAVY = 32
#: Rows of a shard that are numbered in one task, about.
SLOT_ROWS = 50_000
DEEPEST = 60


def _place(column: Column) -> Column:
    return F.crc32(column) / F.lit(float(2**32))


def _scaled(points: DataFrame) -> DataFrame:
    """The metadata dimensions, each from 0 to 1 over all points."""
    ends = points.agg(*[f(d).alias(f"{k}_{d}") for d in METADATA for k, f in (("lo", F.min), ("hi", F.max))]).first()
    lo, width = ({d: ends[f"lo_{d}"] or 0.0 for d in METADATA}, {d: (ends[f"hi_{d}"] or 0.0) - (ends[f"lo_{d}"] or 0.0) for d in METADATA})
    return points.withColumns({d: (F.col(d) - lo[d]) / width[d] if width[d] else F.lit(0.0) for d in METADATA})


def _along(dim: Column) -> Column:
    return F.element_at(F.array(*DIMENSIONS), dim + 1)


def _cuts(placed: DataFrame, todo: list[tuple]) -> DataFrame:
    """node, dim and cut of every node of todo (node, dim, lo, step, total): the place nearest to half its weight with points on both sides."""
    ask = F.broadcast(placed.sparkSession.createDataFrame(todo, "node bigint, dim int, lo double, step double, total double"))  # bounded as the tree is
    bins = (
        placed.join(ask, "node")
        .withColumn("bin", F.least(F.floor((_along(F.col("dim")) - F.col("lo")) / F.col("step")), F.lit(BINS - 1)).cast("int"))
        .groupBy("node", "dim", "total", "bin").agg(F.sum("weight").cast("double").alias("weight"), F.min(_along(F.col("dim"))).alias("from_value"))
    )
    one = bins.groupBy("node", "dim", "total").agg(F.array_sort(F.collect_list(F.struct("bin", "weight", "from_value"))).alias("bins"))  # at most BINS of a node
    nothing = F.struct(F.lit(0.0).alias("left"), F.lit(math.inf).alias("gap"), F.lit(0.0).alias("cut"))

    def nearer(best: Column, b: Column) -> Column:
        gap = F.abs(best["left"] - F.col("total") / 2)
        better = (best["left"] > 0) & (gap < best["gap"])
        return F.struct((best["left"] + b["weight"]).alias("left"), F.when(better, gap).otherwise(best["gap"]).alias("gap"), F.when(better, b["from_value"]).otherwise(best["cut"]).alias("cut"))

    return one.select("node", "dim", F.aggregate("bins", nothing, nearer, lambda best: best["cut"]).alias("cut"))


def grow(points: DataFrame, target: float) -> tuple[DataFrame, dict[int, int]]:
    """The points with their leaf as column `node`, and the leaves' weights; the children of k are 2k and 2k + 1."""
    placed, leaves = shared.materialize(points.withColumn("node", F.lit(1).cast("bigint")), "kd-level"), {}
    for level in range(DEEPEST):
        newest = placed.filter(F.col("node") >= 2**level)
        spans = [f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max))]
        todo = []
        for s in newest.groupBy("node").agg(F.sum("weight").alias("weight"), *spans).collect():
            width = {d: s[f"hi_{d}"] - s[f"lo_{d}"] for d in DIMENSIONS}
            dim = max(METADATA, key=lambda d: width[d])
            if not width[dim]:
                dim = "by_digest"
            if s["weight"] <= target or not width[dim]:
                leaves[s["node"]] = s["weight"]
            else:
                todo.append((s["node"], DIMENSIONS.index(dim), float(s[f"lo_{dim}"]), width[dim] / BINS, float(s["weight"])))
        if not todo:
            return placed, leaves
        cuts = placed.sparkSession.createDataFrame(_cuts(newest, todo).collect(), "node bigint, dim int, cut double")
        side = (_along(F.col("dim")) >= F.col("cut")).cast("bigint")
        after = placed.join(F.broadcast(cuts), "node", "left").withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + side))
        after = shared.materialize(after.select(*placed.columns), "kd-level")
        shared.discard(placed)
        placed = after
    raise RuntimeError("the tree is too deep")


def in_order(leaves: dict[int, int]) -> list[int]:
    """The leaves from the leftmost to the rightmost."""
    return sorted(leaves, key=lambda node: node << (64 - node.bit_length()))


def deal_runs(leaves: dict[int, int], room: list[float]) -> dict[int, int]:
    """Leaf to shard: in the tree's order, a shard takes leaves in proportion to its room."""
    out, total, done, shard, filled = {}, sum(leaves.values()), 0, 0, 0.0
    scale = total / sum(room) if sum(room) > 0 else 0.0
    ends = []
    for r in room:
        filled += r * scale
        ends.append(filled)
    for node in in_order(leaves):
        middle = done + leaves[node] / 2
        while shard < len(room) - 1 and middle >= ends[shard]:
            shard += 1
        out[node] = shard
        done += leaves[node]
    return out


def deal_heavy(weights: dict[bytes, int], shards: int) -> tuple[dict[bytes, int], list[int]]:
    """The heaviest text that is left goes to the lightest shard; and the shards' loads."""
    heap, out, load = [(0, s) for s in range(shards)], {}, [0] * shards
    for digest, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        _, shard = heapq.heappop(heap)
        out[digest] = shard
        load[shard] += weight
        heapq.heappush(heap, (load[shard], shard))
    return out, load


def kd_shards(docs: DataFrame, shards: int = 8, leaves_per_shard: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), leaf (null for heavy texts).

    docs needs doc_id, text, lang and source. slot numbers the rows of a shard
    without gaps: they are counted in parts of about SLOT_ROWS rows, and each
    part is numbered from the sum of those before it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    label = lambda c: _place(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    rows = shared.materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"), label("source").alias("by_source"), label("lang").alias("by_lang"),
        ),
        "kd-rows",
    )
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).first()
    total = counted["bytes"] or 0
    fair = max(1, math.ceil(total / shards))
    target = max(1, math.ceil(fair / leaves_per_shard))
    # fewer than HEAVY * shards texts
    heavy = {bytes(r["digest"]): r["w"] for r in rows.groupBy("digest").agg(F.sum("size").alias("w")).filter(F.col("w") * HEAVY > fair).collect()}
    own, load = deal_heavy({d: w for d, w in heavy.items() if w <= fair}, shards)
    known = spark.createDataFrame([(bytearray(d), math.ceil(2 * w / target), own.get(d)) for d, w in heavy.items()], "digest binary, pieces bigint, own int")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "size"), F.col("pieces")), F.lit(0).cast("bigint"))
    rows = rows.join(F.broadcast(known), "digest", "left").withColumn("part", part)
    light = rows.filter("own is null")
    points = light.groupBy("digest", "part").agg(
        F.sum("size").alias("weight"), F.min("by_source").alias("by_source"), F.min("by_lang").alias("by_lang"),
        F.log2(F.max("size").cast("double")).alias("by_length"),
    ).withColumn("by_digest", _place(F.concat(F.col("digest"), F.col("part").cast("string").cast("binary"))))
    placed, leaves = grow(_scaled(shared.materialize(points, "kd-points")), target)
    to_shard = deal_runs(leaves, [max(0, fair - x) for x in load])
    table = F.broadcast(spark.createDataFrame([(int(k), int(v)) for k, v in to_shard.items()], "leaf bigint, shard int"))  # bounded as the tree is
    routed = placed.select("digest", "part", F.col("node").alias("leaf")).join(table, "leaf")
    shown = ["doc_id", "size", "text_crc32", "digest", "shard", "leaf"]
    dealt = light.join(routed.hint("merge"), ["digest", "part"]).select(*shown)
    dealt = dealt.unionByName(rows.filter("own is not null").withColumns({"shard": F.col("own"), "leaf": F.lit(None).cast("bigint")}).select(*shown))
    buckets = max(8, math.ceil(counted["rows"] / shards / SLOT_ROWS))
    dealt = shared.materialize(dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets))).drop("digest"), "kd-placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # a row for SLOT_ROWS
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "leaf",
        )
    )
