"""Near-duplicate components by an LSH forest over minhash signatures.

Texts with equal shingle sets are one class and are represented by the class's
smallest id. A representative's signature is cut into TREES runs of DEPTH
values; sorted by such a run, neighbours with a long common prefix are
candidates. The depth adapts to the region: a prefix of depths()[0] values that
at most REGION representatives share is a region whose pairs are all
candidates; a larger region is cut by longer prefixes. Members of a region
that is too large are also compared to its pivot, the member that most other
members resemble (the largest sum of deepest regions over all trees), and at
the full depth to their neighbours in order of set size. So these candidates
grow in proportion to the rows, and a group of near copies of any size hangs
together by its pivots.

Every link is confirmed on full sets. First come pairs with pivots and with the
smallest member of a small region; then every other candidate whose ends are
not yet in one component. Last, in every large region of depths()[0] values that
still holds more than one component, all pairs of members of different
components are compared, two blocks of members in a task: first by signatures,
then what may link to something by full sets. That work grows with the square
of what a region holds besides its largest components. Components come from
alternating large-star and small-star rounds whose tables go to the shared
folder.

Edge cases: a null text, or one without words, has no shingles, links with
nothing and is its own component; fewer words than a shingle are one shingle;
rows without an id link with nothing, have no component and are kept; rows that
share an id are one node (keep_representatives() tells them apart); repeated
texts link as equal sets; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm import shared
from veritab.llm.blocks import release
from veritab.operators.dataset import numbered

#: Trees of the forest; signature values of a tree's order; members up to which a region's pairs are all candidates.
TREES, DEPTH, REGION = 16, 8, 8
SLOTS = TREES * DEPTH
#: Rows of a run in order of set size, at the full depth.
CHAIN = 64
#: Members and shingles of a block of a crowded region, about: what one task compares with another block.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Pairs that have a shingle in common, beyond which it is counted by matrices; columns of one.
DENSE, COLUMNS = 2048, 2048
CACHED_WORDS = 200_000
SKETCH = "doc_id bigint, n bigint, set_key binary, signature binary"

_STEP = 2048
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)
_PLACES = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashed(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 5, cache: dict | None = None) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; A-Z are lower-cased, words end at ASCII blanks."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    cache = _Hashed() if cache is None else cache
    hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    used = min(width, n)
    total = np.full(n - used + 1, used, np.uint64)
    for k in range(used):
        total += _mix(hashes[k : n - used + 1 + k]) * _PLACES[k]
    return np.unique(_mix(total))


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """SLOTS minima of 32 bits."""
    low = np.full(SLOTS, 2**32 - 1, np.uint32)
    for at in range(0, len(shingle_set), _STEP):
        hashed = (shingle_set[at : at + _STEP, None] * _FACTORS + _OFFSETS) >> np.uint64(32)
        np.minimum(low, hashed.min(axis=0).astype(np.uint32), out=low)
    return low


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n (set size), set_key (equal for equal sets) and signature of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashed()
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), width, cache)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found).astype(">u4").tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n", "set_key", "signature"])
        del cache
        release()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def depths(threshold: int) -> tuple[int, int, int]:
    """Prefix lengths of the forest: a pair at the threshold (percent) shares the first in no tree with a probability of at most 2e-5."""
    if not 50 <= threshold <= 100:
        raise ValueError("threshold is a percentage from 50 to 100")
    first = max(d for d in range(1, DEPTH - 3) if (1 - (threshold / 100) ** d) ** TREES <= 2e-5)
    return first, first + 2, first + 4


def agreeing_slots(threshold: int) -> int:
    """Agreeing slots of SLOTS below which a pair is not looked at: 4.65 standard deviations under the threshold."""
    p = threshold / 100
    return int(SLOTS * p - 4.65 * (SLOTS * p * (1 - p)) ** 0.5)


def candidates(classes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First and further candidate pairs (a < b) among (node, n, signature), and the members of crowded regions.

    The third table has region, node and n for regions of the first depth with
    more than REGION members.
    """
    lengths = depths(threshold)
    at = lambda d: F.xxhash64("tree", F.expr(f"substring(signature, tree * {4 * DEPTH} + 1, {4 * d})"))
    trees = classes.select("node", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trees = trees.select("node", "n", *[at(d).alias(f"k{d}") for d in lengths])

    def counted(df: DataFrame, d: int) -> DataFrame:
        sizes = df.groupBy(f"k{d}").agg(F.count(F.lit(1)).alias(f"c{d}")).filter(F.col(f"c{d}") > 1)
        return df.join(sizes.hint("merge"), f"k{d}")

    # rows that share at least the shortest prefix with another
    first = shared.materialize(counted(trees, lengths[0]), "forest-first")
    large = first.filter(F.col(f"c{lengths[0]}") > REGION)
    deep = shared.materialize(
        large.join(large.groupBy(f"k{lengths[1]}").agg(F.count(F.lit(1)).alias(f"c{lengths[1]}")).hint("merge"), f"k{lengths[1]}")
        .join(large.groupBy(f"k{lengths[2]}").agg(F.count(F.lit(1)).alias(f"c{lengths[2]}")).hint("merge"), f"k{lengths[2]}"),
        "forest-deep",
    )
    central = deep.groupBy("node").agg(F.sum(f"c{lengths[2]}").alias("central"))
    ranked = deep.join(central.hint("merge"), "node")
    small, stars = [first.filter(F.col(f"c{lengths[0]}") <= REGION).select(F.col(f"k{lengths[0]}").alias("region"), "node", "n")], []
    before = lengths[0]
    for d in lengths:
        if d != lengths[0]:
            inside = deep.filter((F.col(f"c{before}") > REGION) & (F.col(f"c{d}") > 1) & (F.col(f"c{d}") <= REGION))
            small.append(inside.select(F.col(f"k{d}").alias("region"), "node", "n"))
        crowd = ranked.filter(F.col(f"c{d}") > REGION).select(F.col(f"k{d}").alias("region"), "node", "n", "central")
        pivots = crowd.groupBy("region").agg(F.max(F.struct("central", -F.col("node"), "n")).alias("p")).select("region", (-F.col("p.col2")).alias("pivot"), F.col("p.n").alias("pivot_n"))
        with_pivot = crowd.join(pivots.hint("merge"), "region")
        stars.append(with_pivot.filter("node <> pivot").select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("pivot").alias("b"), F.col("pivot_n").alias("bn")))
        before = d
    # at full depth, neighbours in order of set size, in runs of about CHAIN rows
    last = f"{lengths[-1]}"
    crowd = deep.filter(F.col(f"c{last}") > REGION).withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col(f"c{last}") / CHAIN)))
    order = Window.partitionBy(f"k{last}", "salt").orderBy("n", "node")
    chain = crowd.select("node", "n", F.lag("node").over(order).alias("b"), F.lag("n").over(order).alias("bn")).filter("b is not null").select(F.col("node").alias("a"), F.col("n").alias("an"), "b", "bn")
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    rows = shared.materialize(rows, "forest-regions")
    heads = rows.groupBy("region").agg(F.min(F.struct("node", "n")).alias("h")).select("region", F.col("h.node").alias("b"), F.col("h.n").alias("bn"))
    starts = rows.join(heads.hint("merge"), "region").filter("node <> b").select(F.col("node").alias("a"), F.col("n").alias("an"), "b", "bn")
    other = rows.select("region", F.col("node").alias("b"), F.col("n").alias("bn"))
    within = rows.join(other.hint("merge"), "region").filter("node < b").select(F.col("node").alias("a"), F.col("n").alias("an"), "b", "bn")

    one = chain.unionByName(starts)
    for star in stars:
        one = one.unionByName(star)
    return _pairs(one, threshold), _pairs(within, threshold), large.select(F.col(f"k{lengths[0]}").alias("region"), "node", "n")


def _pairs(df: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs (a < b) of nodes whose set sizes can reach the threshold (percent of their union)."""
    return df.filter((100 * F.least("an", "bn") >= threshold * F.greatest("an", "bn"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            whole = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, SLOTS, 4)
            short = np.ascontiguousarray(whole[:, :, 3])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in short], pa.binary())], names=["node", "short"])


def _agreeing(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose signatures agree often enough, judged by a byte of each slot."""
    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SLOTS) for k in (2, 3))
                yield batch.select(["a", "b", "first"]).filter(pa.array((left == right).sum(axis=1) >= agreeing_slots(threshold)))

    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    short = shared.materialize(shared.with_ids(classes.select("node", "signature"), involved, "node").mapInArrow(_low_bytes, "node bigint, short binary"), "forest-short")
    left = pairs.join(short.select(F.col("node").alias("a"), F.col("short").alias("left")).hint("merge"), "a")
    both = left.join(short.select(F.col("node").alias("b"), F.col("short").alias("right")).hint("merge"), "b")
    return both.select("a", "b", "left", "right", "first").mapInArrow(agree, "a bigint, b bigint, first boolean")


def _shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """node and its full set, for the ids (column doc_id); several rows of one id give their union's first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashed()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), width, cache).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "shingles"])

    rows = shared.with_ids(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), ids, "doc_id")
    return rows.mapInArrow(run, "node bigint, shingles binary")


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= threshold * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")).hint("merge"), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and component (its smallest node) of every end of an edge (a, b).

    Alternates large-star and small-star; each round's edges are a table in the
    shared folder. Both stars read the least neighbour by a map-side-combined
    minimum, so a node with many neighbours is no group in one task.
    """
    edges = shared.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = shared.materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = shared.materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "small-star")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        shared.discard(edges)
        shared.discard(large)
        edges = after
        if tuple(seen) == before:
            break
        before = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def extended(group: DataFrame, links: DataFrame) -> DataFrame:
    """group (node, component) after further links (a, b); only components that a link joins are gone through again."""
    end = lambda e: group.select(F.col("node").alias(e), F.col("component").alias(f"{e}_in")).hint("merge")
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    between = shared.materialize(between.filter("a <> b").distinct(), "links-between")
    if between.isEmpty():
        return group
    over = shared.materialize(components(between), "components-over")
    moved = group.join(over.select(F.col("node").alias("component"), F.col("component").alias("now")).hint("merge"), "component", "left")
    moved = moved.select("node", F.coalesce("now", "component").alias("component"))
    return shared.materialize(moved.unionByName(over.join(group.select("node").hint("merge"), "node", "left_anti")), "components")


def _in_blocks(crowd: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run() over every two blocks of a region that can hold two components.

    crowd has region, node, n, component and payload; run's table has side (0
    or 1; only 0 where a block meets itself) and all of these but the region.
    Members of a component that fills a block are dealt to blocks of their own,
    which meet others only; so a group of near copies is not compared to itself.
    """
    full = crowd.groupBy("region", "component").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= BLOCK).select("region", "component", F.lit(True).alias("alone"))
    placed = crowd.join(full.hint("merge"), ["region", "component"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    placed = placed.withColumn("own", F.when(F.col("alone"), F.col("component")).otherwise(F.lit(0)))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("bigint")
    sizes = placed.groupBy("region", "alone", "own").agg(blocks.alias("blocks"))
    each = sizes.withColumn("at", F.explode(F.sequence(F.lit(1).cast("bigint"), "blocks"))).select("region", F.struct("alone", "own", "at").alias("x"))
    met = each.join(each.withColumnRenamed("x", "y").hint("merge"), "region").filter("x <= y and not (x.alone and y.alone and x.own = y.own)")
    met = met.select("region", F.xxhash64("x", "y").alias("met"), "x", "y")
    sides = met.select("region", "met", "x", F.lit(0).alias("side")).unionByName(met.filter("x <> y").select("region", "met", F.col("y").alias("x"), F.lit(1).alias("side")))
    at = F.pmod(F.xxhash64("node"), F.col("blocks")) + 1
    rows = placed.join(sizes.hint("merge"), ["region", "alone", "own"]).withColumn("x", F.struct("alone", "own", at.alias("at")))
    rows = rows.join(sides.hint("merge"), ["region", "x"])
    return rows.select("region", "met", "side", "node", "n", "component", "payload").groupBy("region", "met").applyInArrow(run, schema)


def _apart(table: pa.Table, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both sides that have a partner, and which pairs (rows x columns) may link: other components, sizes near enough."""
    side, n, component = (table.column(c).to_numpy() for c in ("side", "n", "component"))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    x, y = n[left][:, None], n[right][None, :]
    may = (component[left][:, None] != component[right]) & (100 * np.minimum(x, y) >= threshold * np.maximum(x, y))
    rows, columns = may.any(axis=1), may.any(axis=0)
    return left[rows], right[columns], may[rows][:, columns]


def _likely_members(table: pa.Table, threshold: int) -> pa.Table:
    """region and node of the members whose signatures (a byte a slot) agree often enough with one of another component."""
    left, right, may = _apart(table, threshold)
    found = np.zeros(0, np.int64)
    if may.size:
        short = np.frombuffer(b"".join(table.column("payload").to_pylist()), np.uint8).reshape(-1, SLOTS)
        x, y = short[left], short[right]
        agree = np.zeros(may.shape, np.uint8)
        for k in range(SLOTS):
            agree += x[:, k, None] == y[None, :, k]
        may &= agree >= agreeing_slots(threshold)
        found = np.unique(np.concatenate([left[may.any(axis=1)], right[may.any(axis=0)]]))
    return table.select(["region", "node"]).take(pa.array(found))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of left with every set of right."""
    out = np.zeros((len(left), len(right)), np.int64)
    tokens, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(map(len, left))
    rows, columns = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    u, v = at[:cut], at[cut:]
    pairs = np.bincount(u, minlength=len(tokens)) * np.bincount(v, minlength=len(tokens))
    dense = np.flatnonzero(pairs > DENSE)
    for k in range(0, len(dense), COLUMNS):
        place = np.full(len(tokens), -1)
        place[dense[k : k + COLUMNS]] = np.arange(len(dense[k : k + COLUMNS]))
        x, y = (np.zeros((len(s), COLUMNS), np.float32) for s in (left, right))
        for m, where, t in ((x, rows, u), (y, columns, v)):
            inside = place[t] >= 0
            m[where[inside], place[t[inside]]] = 1
        out += (x @ y.T).astype(np.int64)
    few = (pairs > 0) & (pairs <= DENSE)
    p, q = np.flatnonzero(few[u]), np.flatnonzero(few[v])
    p, q = p[np.argsort(u[p], kind="stable")], q[np.argsort(v[q], kind="stable")]
    first, count = np.searchsorted(v[q], u[p]), np.bincount(v[q], minlength=len(tokens))[u[p]]
    for k in range(0, len(p), COLUMNS):
        c = count[k : k + COLUMNS]
        inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        np.add.at(out, (np.repeat(rows[p[k : k + COLUMNS]], c), columns[q[np.repeat(first[k : k + COLUMNS], c) + inner]]), 1)
    return out


def _joining_links(table: pa.Table, threshold: int) -> pa.Table:
    """Links (a, b) by full sets that join the components of two blocks: as few as join whatever any pair joins."""
    left, right, may = _apart(table, threshold)
    a, b = [], []
    if may.size:
        sets, node = table.column("payload"), table.column("node").to_pylist()
        x, y = ([np.frombuffer(sets[int(i)].as_py(), np.uint64) for i in s] for s in (left, right))
        common = _common(x, y)
        total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
        may &= 100 * common >= threshold * (total - common)
        component, parent = table.column("component").to_pylist(), {}

        def find(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        for i, j in np.argwhere(may).tolist():
            p, q = find(component[left[i]]), find(component[right[j]])
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(node[left[i]])
                b.append(node[right[j]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _settle_crowds(docs: DataFrame, classes: DataFrame, crowded: DataFrame, found: DataFrame, width: int, threshold: int) -> DataFrame:
    """The components `found`, after what members of crowded regions still hide from their pivots."""
    members = crowded.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = members.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("region")
    members = shared.materialize(members.join(mixed.hint("merge"), "region", "left_semi").select("region", "node", "n", "component"), "crowd-members")
    if members.isEmpty():
        return found
    involved = members.select("node").distinct()
    short = shared.with_ids(classes.select("node", "signature"), involved, "node").mapInArrow(_low_bytes, "node bigint, short binary").withColumnRenamed("short", "payload")
    likely = _in_blocks(members.join(short.hint("merge"), "node"), lambda t: _likely_members(t, threshold), "region bigint, node bigint").distinct()
    likely = shared.materialize(members.join(likely.hint("merge"), ["region", "node"], "left_semi"), "crowd-likely")
    if likely.isEmpty():
        return found
    involved = likely.select(F.col("node").alias("doc_id")).distinct()
    sets = shared.materialize(_shingle_sets(docs, involved, width), "crowd-sets").withColumnRenamed("shingles", "payload")
    more = shared.materialize(_in_blocks(likely.join(sets.hint("merge"), "node"), lambda t: _joining_links(t, threshold), "a bigint, b bigint"), "crowd-links")
    return extended(found, more)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Texts link whose sets have at least `threshold` percent of their union in common.
    """
    shared.bound_batches(docs.sparkSession)
    rows = shared.materialize(sketches(docs, width), "sketches")
    nodes = rows.filter("set_key is not null and doc_id is not null")
    classes = shared.materialize(
        nodes.groupBy("set_key").agg(F.min("doc_id").alias("node"))
        .join(nodes.select("set_key", "n", "signature", "doc_id").hint("merge"), "set_key").filter("doc_id = node")
        .select("set_key", "node", "n", "signature").dropDuplicates(["set_key"]),
        "classes",
    )
    one, more, crowded = candidates(classes, threshold)
    pairs = one.withColumn("first", F.lit(True)).unionByName(more.withColumn("first", F.lit(False))).groupBy("a", "b").agg(F.max("first").alias("first"))
    pairs = shared.materialize(pairs, "pairs")
    likely = shared.materialize(_agreeing(pairs, classes, threshold), "likely-pairs")
    involved = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    sets = shared.materialize(_shingle_sets(docs, involved, width), "sets")
    links = shared.materialize(_confirm(likely.filter("first").select("a", "b"), sets, threshold), "links")
    group = shared.materialize(components(links), "first-components")
    of = lambda end: group.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")).hint("merge")
    apart = (
        likely.filter("not first").select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
        .filter(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")
    )
    found = extended(group, shared.materialize(_confirm(apart, sets, threshold), "further-links"))
    found = _settle_crowds(docs, classes, crowded, found, width, threshold)
    of_class = classes.select("set_key", "node").join(found.hint("merge"), "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    linked = rows.filter("set_key is not null and doc_id is not null").select("doc_id", "n", "set_key").join(of_class.hint("merge"), "set_key").select("doc_id", "n", "component")
    alone = rows.filter("set_key is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept")
    )


def keep_representatives(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """docs, all columns, with one row of each component of near duplicates at the threshold (percent).

    Where ids are unique and not null they are the nodes, and the smallest id of
    a component stays. Else every distinct pair of id and text is a node, in
    that order and nulls last, so rows that share an id, or have none, are
    judged by their own texts; of rows that repeat id and text one stays.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("id"))
    if ids.filter("id is null").isEmpty() and ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return shared.without_ids(docs, near_duplicates(docs, threshold=threshold).filter("not kept").select("doc_id"), "doc_id")
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("bigint"), "__digest": digest})
    pairs = keyed.groupBy("__id", "__digest").agg(F.count(F.lit(1)).alias("__copies"))
    pairs = numbered(pairs, F.col("__id").asc_nulls_last(), "__digest").select(F.col("__id").alias("__i"), F.col("__digest").alias("__d"), "__copies", F.col("record_no").alias("__node"))
    nodes = shared.materialize(keyed.join(pairs.hint("merge"), (F.col("__digest") == F.col("__d")) & F.col("__id").eqNullSafe(F.col("__i"))).drop("__i", "__d"), "near-nodes")
    once = nodes.groupBy("__node").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumnRenamed("__node", "doc_id")
    dropped = near_duplicates(once, threshold=threshold).filter("not kept").select(F.col("doc_id").alias("__node"))
    left = shared.without_ids(nodes, dropped, "__node")
    single, repeated = left.filter("__copies = 1").select(*docs.columns), left.filter("__copies > 1")
    return single.unionByName(shared.one_of_each(repeated, ["__node"], docs.columns))
