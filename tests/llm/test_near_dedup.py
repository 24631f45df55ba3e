import random
import re

import pytest

from veritab.llm import near_dedup

SCHEMA = "doc_id bigint, text string, node int, n string, component string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[ \t-\r]+", lower) if w]


def sets(rows):
    out = {}
    for i, t in rows:
        w = words(t)
        out.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    s = sets(rows)
    parent = {i: i for i in s}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i), find(i) == i) for i in ids}


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}


def corpus(seed, families=25, most=12, star=60):
    rng = random.Random(seed)
    text = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n)]
    rows, common = [], text(55)
    for f in range(families):
        base = text(rng.randint(5, 200)) + (common if f % 3 == 0 else [])
        copy = base
        for k in range(rng.randint(1, most)):
            if k:
                copy = list(copy if f % 2 else base)
                for _ in range(rng.randint(0, 2)):
                    copy[rng.randrange(len(copy))] = f"E{rng.randrange(99)}"
            rows.append(" ".join(copy))
    base = text(150)  # a large group: each differs from the base in a word or two
    for _ in range(star):
        copy = list(base)
        for _ in range(rng.randint(1, 2)):
            copy[rng.randrange(150)] = f"S{rng.randrange(9999)}"
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One TWO"), (9004, "one two"), (9005, "É One"), (9006, "é one"), (9007, "a b c d"), (9008, "a b c d e"), (9009, "w " * 50_000)]
    assert run(spark, rows) == brute(rows)


def test_null_ids_and_empty(spark):
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f", 1, "x", "y"), (1, "a b c d e f", 1, "x", "y")], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == [(0, None, True), (1, 1, True)]
    assert run(spark, []) == {}


def test_long_path_of_links(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in near_dedup.components(rows).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def shared_passage(docs, pairs, tail, alike, seed=5):
    """Texts of one passage of 540 words and a tail; of the first `pairs` pairs, two tails start with `alike` equal words."""
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(540))
    tails = [[f"t{i}x{rng.randrange(10**6)}" for _ in range(tail)] for i in range(docs)]
    for k in range(pairs):
        tails[docs - 1 - k][:alike] = tails[k][:alike]
    return [(i, f"{passage} {' '.join(t)}") for i, t in enumerate(tails)]


def test_pairs_inside_a_crowded_region(spark):
    docs, pairs = 2500, 100
    rows = shared_passage(docs, pairs, 50, 6)  # others 536 of 636 shingles in common (0.843), pairs 542 of 630 (0.860)
    got = run(spark, rows)
    assert {i: c for i, (_, c, _) in got.items()} == {i: docs - 1 - i if i >= docs - pairs else i for i in range(docs)}


def test_components_do_not_depend_on_partitions(spark):
    rows = shared_passage(300, 20, 50, 6, seed=8) + [(1000 + i, t) for i, t in corpus(3, families=10)]
    key, before, found = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "211"):
            spark.conf.set(key, n)
            found.append(run(spark, rows))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] == brute(rows)


def test_representatives_are_rows(spark):
    text = lambda mark: " ".join(f"{mark}{k}" for k in range(40))
    rows = [
        (1, text("a"), "p"), (1, text("b"), "p"), (2, text("a") + " more", "p"), (None, text("b") + " more", "p"), (None, text("c"), "p"), (None, text("c"), "p"),
        (5, None, "p"), (5, "", "p"), (6, text("d"), "p"), (6, text("d"), "q"), (0, text("e"), "p"), (1, text("e") + " more", "p"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    got = near_dedup.keep_representatives(docs)
    assert got.columns == docs.columns
    kept = sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "")[:2]) for r in got.collect())
    assert kept == [(-1, "c0"), (0, "e0"), (1, "a0"), (1, "b0"), (5, ""), (6, "d0")]
    assert near_dedup.keep_representatives(docs.limit(0)).count() == 0
