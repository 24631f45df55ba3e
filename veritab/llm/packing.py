"""Conflict-constrained best-fit packing.

Rows are dealt by a hash of their id to groups of about `group_rows` rows; the
group is the unit of one task, so its memory and its successor searches are
bounded at any input size, and a hot source or cluster is spread over all
groups. Within a group, pieces are placed largest first. Open bins are ordered
by residual; each carries a bitmap of the sources that have reached their quota
in it and a bitmap of the duplicate clusters that it holds. The search starts
at the smallest residual that fits and goes on to the successor until a bin is
compatible: the tightest compatible bin. If none is, a bin is opened.

A row longer than a bin is cut into pieces of a bin's capacity and a rest, so
nothing is dropped; its pieces belong to one cluster and so to different bins.

Sizes are token counts of the byte-level BPE operator, so a piece is a token
range of its row and a bin is a training sequence.

Edge cases: a null or empty text has size 1 (its separator); a null source is
a source of its own; a null cluster conflicts with nothing; a null id is dealt
by its size; repeated rows are packed apart if they share a cluster; rows of
equal size are placed by id, cluster and source, so the result does not depend
on the order of arrival; ties go to the older bin; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm import bpe, shared

SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, bin_id bigint, bin_offset bigint, bin_used bigint"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, quota: int) -> list[int]:
    """The bin of each piece, placed in the given order.

    sources and clusters are small indices (-1: no constraint). Bins are kept
    as (residual, bin) in ascending order.
    """
    order: list[tuple[int, int]] = []
    full: list[int] = []  # bitmap of sources at their quota, by bin
    held: list[int] = []  # bitmap of clusters, by bin
    seen: list[Counter] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s_bit = 1 << source if source >= 0 else 0
        c_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (size, -1))
        while at < len(order) and (full[order[at][1]] & s_bit or held[order[at][1]] & c_bit):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(full)
            full.append(0)
            held.append(0)
            seen.append(Counter())
        held[b] |= c_bit
        if s_bit:
            seen[b][source] += 1
            if seen[b][source] >= quota:
                full[b] |= s_bit
        if residual > size:
            insort(order, (residual - size, b))
        out.append(b)
    return out


def pack(rows: DataFrame, capacity: int = 4096, source_quota: int = 4, group_rows: int = 2048) -> DataFrame:
    """Pack rows of (doc_id, size, source, cluster) into bins of `capacity`.

    Returns one row for each piece: doc_id, piece, start, length (the piece in
    its row), bin_id, bin_offset (its place in the bin), bin_used.
    """
    groups = max(1, -(-rows.count() // group_rows))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["grp"].iloc[0])
        pdf = pdf.sort_values(["size", "no_id", "doc_id", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
        pieces = []
        copies = Counter(pdf["cluster"].dropna())
        names: dict = {}
        sources: dict = {}
        ids = [None if gone else doc for doc, gone in zip(pdf["doc_id"], pdf["no_id"], strict=True)]
        for i, (doc, size, source, cluster) in enumerate(zip(ids, pdf["size"], pdf["source"], pdf["cluster"], strict=True)):
            long = size > capacity
            key = cluster if cluster is not None and copies[cluster] > 1 else ("row", i) if long else None
            c = -1 if key is None else names.setdefault(key, len(names))
            s = sources.setdefault(source, len(sources))
            pieces += [(doc, k, at, min(capacity, size - at), s, c) for k, at in enumerate(range(0, size, capacity))]
        pieces.sort(key=lambda p: -p[3])
        bins = best_fit([p[3] for p in pieces], [p[4] for p in pieces], [p[5] for p in pieces], capacity, source_quota)
        used: Counter = Counter()
        out = []
        for p, b in zip(pieces, bins, strict=True):
            out.append([p[0], p[1], p[2], p[3], (group << 24) + b, used[b]])
            used[b] += p[3]
        frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "bin_id", "bin_offset"])
        frame["bin_used"] = [used[b] for b in bins]
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    keyed = rows.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        F.col("size").cast("bigint"), F.col("source").cast("string"), F.col("cluster").cast("string"),
        F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("size")).otherwise(F.xxhash64("doc_id")), F.lit(groups)).alias("grp"),
    )
    return keyed.groupBy("grp").applyInPandas(place, SCHEMA)


def token_rows(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, size (tokens and a separator), source, cluster (digest of the text), as a table: pack() reads it twice."""
    marked = docs.withColumn("__cluster", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    encoded = bpe.encode(marked, vocabulary, pattern, carry=("source", "__cluster"))
    sizes = encoded.select("doc_id", (F.size("ids") + F.lit(1)).alias("size"), F.col("carried")[0].alias("source"), F.col("carried")[1].alias("cluster"))
    return shared.materialize(sizes, "packing-rows")
