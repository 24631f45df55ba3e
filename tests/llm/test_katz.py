import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veritab.llm import katz

SCHEMA = "doc_id bigint, text string, train string, block int"


def brute(rows, k=katz.K, normalised=None):
    train = [katz.tokens(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    uni, big, hist = Counter(), Counter(), Counter()
    for words in train:
        uni.update(words)
        for h, w in zip([None, *words], words):
            big[h, w] += 1
            hist[h] += 1
    n, v = sum(uni.values()), len(uni)
    of = lambda c: [sum(1 for x in c.values() if x == r) for r in range(k + 2)]
    d1, d2 = katz.discounts(of(uni)), katz.discounts(of(big))
    p1 = {w: d1[min(c, k + 1)] * c / n for w, c in uni.items()}
    left = 1 - sum(p1.values())
    if left < 1e-12:
        p1 = {w: p * n / (n + 1) for w, p in p1.items()}
        left = 1 / (n + 1)
    after = defaultdict(list)
    for (h, w), c in big.items():
        after[h].append((w, c))
    alpha, seen = {}, {}
    for h, ws in after.items():
        div = hist[h] + (not any(c <= k for _, c in ws))
        for w, c in ws:
            seen[h, w] = d2[min(c, k + 1)] * c / div
        alpha[h] = (1 - sum(seen[h, w] for w, _ in ws)) / (1 - sum(p1[w] for w, _ in ws))
    low = lambda w: p1.get(w, left)
    prob = lambda h, w: seen[h, w] if (h, w) in seen else alpha.get(h, 1.0) * low(w)
    for h in list(alpha)[:normalised]:
        assert math.isclose(sum(prob(h, w) for w in [*uni, b"?never?"]), 1.0, rel_tol=1e-9)
    out = {}
    for i, t in rows:
        words = katz.tokens(t)
        out[i] = (len(words), sum(uni[w] > 0 for w in words), sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in words), sum(math.log10(prob(h, w)) for h, w in zip([None, *words], words)), n)
    return out


def score(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], SCHEMA).repartition(3)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return {r["doc_id"]: r for r in katz.katz_scores(df, train).collect()}


def compare(spark, rows):
    got, want = score(spark, rows), brute(rows)
    assert set(got) == set(want)
    for i, (n, known, base, value, total) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(value, rel=1e-8)


@pytest.mark.parametrize("block_bytes", [200, 8 << 20])
def test_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(katz, "BLOCK_BYTES", block_bytes)
    words = "the The of and cat dog é x runs sat\ton mat".split(" ")
    rows = [(i, " ".join(words[(i * j * 7 + j * j) % len(words)] for j in range(i % 23)) + (f" w{i}" if i % 3 else "")) for i in range(120)]
    compare(spark, rows + [(1000, None), (1001, ""), (1002, " \n "), (1003, "the " * 3000), (1004, "the of " * 500)])


def test_null_id_is_scored_not_learnt(spark):
    rows = [(1, "a b c"), (2, "a b"), (None, "zz a")]
    got = score(spark, rows)
    assert got[None]["n_tokens"] == 3 and got[None]["train_tokens"] == got[1]["train_tokens"]
    assert got[None]["n_known"] == 2


def test_without_training_rows_and_without_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA)
    row = katz.katz_scores(df, F.lit(False)).first()
    assert (row["score"], row["base_score"], row["train_tokens"], row["n_known"]) == (0.0, 0.0, 0, 0)
    assert katz.katz_scores(df.limit(0), F.lit(True)).count() == 0
