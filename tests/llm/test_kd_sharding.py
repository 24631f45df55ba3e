import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from veritab.llm import kd_sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, size int, shard string"


def shards(spark, rows, **more):
    df = spark.createDataFrame([(i, t, lang, s, 1, "z") for i, t, lang, s in rows], SCHEMA).repartition(3)
    return kd_sharding.kd_shards(df, **more).collect()


def check(rows, got, n):
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    slots = defaultdict(list)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return Counter({s: sum(r["size"] for r in got if r["shard"] == s) for s in range(n)})


def test_sizes_are_near_equal_and_copies_stay_together(spark):
    rows = [(i, f"text é {i} " * (1 + i * i % 97), ["en", "de", None][i % 3], f"s{i % 7}" if i % 2 else "hot") for i in range(1200)]
    rows += [(5000 + i, "the same text " * 20, "en", f"s{i}") for i in range(60)]
    got = shards(spark, rows)
    sizes = check(rows, got, 8)
    assert max(sizes.values()) <= 1.03 * min(sizes.values())
    assert len({r["shard"] for r in got if r["doc_id"] >= 5000}) == 1


def test_a_group_beyond_a_fair_share_is_divided(spark):
    rows = [(i, "copy " * 50, "en", "a") for i in range(900)] + [(1000 + i, f"other {i} " * 30, "en", "b") for i in range(300)]
    sizes = check(rows, shards(spark, rows), 8)
    assert max(sizes.values()) <= 1.05 * min(sizes.values())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "a", "x", "y")] * 5, [(None, "", "x", "y"), (2, "b" * 300_000, "x", "y")]])
def test_small_tables(spark, rows):
    check(rows, shards(spark, rows), 8)


def brute(rows, shards, leaves_per_shard):
    """The shard of each text, by a plain recursion over lists; for tables without heavy texts."""
    place = lambda raw: zlib.crc32(raw) / 2**32
    points = {}
    for _, t, lang, source in rows:
        raw = (t or "").encode()
        p = points.setdefault(raw, [0, [], [], math.log(len(raw) + 1) / math.log(2), place(hashlib.sha256(raw).digest() + b"0")])
        p[0] += len(raw) + 1
        p[1].append(place((source or "").encode()))
        p[2].append(place((lang or "").encode()))
    points = {k: (w, min(a), min(b), c, d) for k, (w, a, b, c, d) in points.items()}
    ends = [(min(p[k] for p in points.values()), max(p[k] for p in points.values())) for k in (1, 2, 3)]
    points = {k: (p[0], *[(p[j] - lo) / (hi - lo) if hi > lo else 0.0 for j, (lo, hi) in zip((1, 2, 3), ends)], p[4]) for k, p in points.items()}
    total = sum(p[0] for p in points.values())
    target = math.ceil(math.ceil(total / shards) / leaves_per_shard)
    leaves = []

    def split(keys):
        span = lambda j: max(points[k][j] for k in keys) - min(points[k][j] for k in keys)
        widths = [span(j) for j in (1, 2, 3)]
        j = 1 + widths.index(max(widths)) if max(widths) else 4
        weight = sum(points[k][0] for k in keys)
        if weight <= target or not span(j):
            leaves.append((keys, weight))
            return
        lo, step = min(points[k][j] for k in keys), span(j) / kd_sharding.BINS
        bins = defaultdict(list)
        for k in keys:
            bins[min(int((points[k][j] - lo) / step), kd_sharding.BINS - 1)].append(k)
        left, best = 0, None
        for b in sorted(bins):
            if left and (best is None or abs(left - weight / 2) < best[0]):
                best = abs(left - weight / 2), min(points[k][j] for k in bins[b])
            left += sum(points[k][0] for k in bins[b])
        split([k for k in keys if points[k][j] < best[1]])
        split([k for k in keys if points[k][j] >= best[1]])

    split(list(points))
    out, done = {}, 0
    for keys, weight in leaves:
        out |= dict.fromkeys(keys, min(shards - 1, int((done + weight / 2) * shards / total)))
        done += weight
    return out


def table(n=2500, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"{i} " + "x" * rng.randrange(40, 160), rng.choice(["en", "de", "fr", None]), rng.choice(["hot", *(f"s{k}" for k in range(20))]) if i % 3 else "hot") for i in range(n)]
    rows += [(n + i, rows[i * 7][1], "en", "copied") for i in range(100)]
    return rows + [(2 * n + i, f"{i:08d}" * 10, "en", "hot") for i in range(400)]  # equal in all metadata


@pytest.mark.parametrize("leaves", [4, 32])
def test_shards_equal_a_plain_tree(spark, leaves):
    rows = table()
    got = shards(spark, rows, leaves_per_shard=leaves)
    want = brute(rows, 8, leaves)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["shard"] == want[text[r["doc_id"]]] for r in got)


def test_shards_are_regions_of_the_metadata(spark):
    rows = table()
    got = shards(spark, rows)
    sizes = check(rows, got, 8)
    assert max(sizes.values()) <= 1.03 * min(sizes.values())
    source = {r[0]: r[3] for r in rows}
    held = [len({source[r["doc_id"]] for r in got if r["shard"] == s}) for s in range(8)]
    assert len(set(source.values())) == 22 and sum(held) <= 0.6 * 8 * 22  # all 22 in every shard if rows were dealt by a hash


def test_law_in_sql(spark):
    rows = table() + [(9000 + i, None, None, None) for i in range(3)] + [(5, "an id twice", "en", "s1")]
    got = shards(spark, rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE g (doc_id BIGINT, size BIGINT, shard INT, slot BIGINT)")
    con.executemany("INSERT INTO g VALUES (?, ?, ?, ?)", [(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got])
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", [(r[0], r[1]) for r in rows])
    assert con.execute("SELECT count(*) FROM (SELECT doc_id, strlen(coalesce(text, '')) + 1 FROM d EXCEPT ALL SELECT doc_id, size FROM g)").fetchone()[0] == 0
    spread, gaps = con.execute("SELECT max(b) / min(b), count(*) FILTER (WHERE hi <> n - 1 OR lo <> 0 OR n <> m) FROM (SELECT shard, sum(size) b, max(slot) hi, min(slot) lo, count(*) n, count(DISTINCT slot) m FROM g GROUP BY shard)").fetchone()
    assert spread < 1.03 and gaps == 0
