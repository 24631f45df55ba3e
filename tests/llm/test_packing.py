import random
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veritab.llm import bpe, packing


def brute(sizes, sources, clusters, capacity, quota):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [
            (capacity - sum(x[0] for x in b) - size, k) for k, b in enumerate(bins)
            if sum(x[0] for x in b) + size <= capacity and (cluster < 0 or all(x[2] != cluster for x in b)) and (source < 0 or sum(x[1] == source for x in b) < quota)
        ]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append([])
        bins[k].append((size, source, cluster))
        out.append(k)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(-1, 3), st.integers(-1, 4)), max_size=40), st.integers(1, 3))
def test_tightest_compatible_bin(items, quota):
    sizes, sources, clusters = ([x[k] for x in items] for k in range(3))
    assert packing.best_fit(sizes, sources, clusters, 20, quota) == brute(sizes, sources, clusters, 20, quota)


SCHEMA = "doc_id bigint, size bigint, source string, cluster string, bin_id string, grp int"


def test_nothing_is_lost_and_no_conflict(spark):
    rows = [(i if i % 50 else None, 1 + i * 37 % 900, None if i % 9 == 0 else f"s{i % 3}", f"c{i % 40}" if i % 2 else None, "x", 1) for i in range(1500)]
    rows += [(9000, 2600, "s0", None, "x", 1), (9001, 1000, "s1", "c1", "x", 1), (9002, 0, "s1", "c1", "x", 1)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=1000, source_quota=2, group_rows=500).collect()
    whole = Counter()
    for r in got:
        whole[r["doc_id"]] += r["length"]
    want = Counter()
    for r in rows:
        want[r[0]] += r[1]
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in whole.items() if v}
    pieces = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == 9000)
    assert pieces == [(0, 1000), (1000, 1000), (2000, 600)]
    source, cluster = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        assert sum(r["length"] for r in own) == own[0]["bin_used"] <= 1000
        assert all(a["bin_offset"] + a["length"] == b["bin_offset"] for a, b in zip(own, own[1:]))
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        held = Counter(cluster[i] for i in ids if cluster[i])
        assert all(v == 1 for v in held.values())
        assert all(v <= 2 for v in Counter(source[i] for i in ids).values())


def test_empty_and_texts(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, None, None, 1), (2, "", "a", 1), (3, "é" * 40_000, "a", 1), (4, "two words", "b", 1), (4, "two words", "b", 1)], "doc_id bigint, text string, source string, size int")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = packing.pack(packing.token_rows(docs, path, public_tokenizers.PATTERN)).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == {1: 1, 2: 1, 3: len(encoder.encode_ordinary("é" * 40_000)) + 1, 4: 6}
    assert len({r["bin_id"] for r in got if r["doc_id"] == 4}) == 2  # copies are packed apart
    assert packing.pack(packing.token_rows(docs.limit(0), path, public_tokenizers.PATTERN)).count() == 0


def test_pack_equals_brute_force_in_one_group(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(1, 400), f"s{rng.randrange(3)}", f"c{rng.randrange(30)}", "x", 1) for i in range(400)]
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    copies = Counter(r[3] for r in rows)
    names = {}
    clusters = [names.setdefault(r[3], len(names)) if copies[r[3]] > 1 else -1 for r in order]
    bins = brute([r[1] for r in order], [int(r[2][1:]) for r in order], clusters, 1000, 2)
    want = {r[0]: b for r, b in zip(order, bins)}
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for given_ in (rows, shuffled):
        got = packing.pack(spark.createDataFrame(given_, SCHEMA).repartition(4), capacity=1000, source_quota=2, group_rows=10_000).collect()
        assert {r["doc_id"]: r["bin_id"] & (1 << 24) - 1 for r in got} == want
