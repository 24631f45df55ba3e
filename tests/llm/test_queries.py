"""The registered queries over the smallest tables: against SQL, the library, or brute force."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm import test_katz
from tests.test_catalogue import SF, TABLES, rows
from veritab.llm import bpe, katz, oracles, queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    assert rows(df.select(*columns).collect()) == rows([[r[names.index(c)] for c in columns] for r in cursor.fetchall()])


def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def test_op3(spark, duck):
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = set()
    for i, t in texts(duck):
        ids = encoder.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = queries.op3_byte_bpe(spark, SF)
    assert {tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_op4(spark, duck):
    raw = {i: (t or "").encode() for i, t in texts(duck)}
    got = queries.op4_kd_shards(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(raw) and len(got) == len(raw)
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw[r["doc_id"]]) + 1, zlib.crc32(raw[r["doc_id"]]), "bytes", None)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_op5(spark, duck):
    got = {r["doc_id"]: r for r in queries.op5_toxic_spans(spark, SF).collect()}
    assert set(got) == {i for i, _ in texts(duck)}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op8(spark, duck):
    want = test_katz.brute(texts(duck), normalised=5)
    duck.execute("CREATE TABLE scored (doc_id BIGINT, text VARCHAR, train BOOLEAN)")
    duck.executemany("INSERT INTO scored VALUES (?, ?, ?)", [(i, t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in texts(duck)])
    in_sql = {r[0]: r[1:] for r in duck.execute(oracles.KATZ).fetchall()}
    assert set(in_sql) == set(want)
    for i, (n, known, base, score, total) in want.items():
        assert in_sql[i][:3] == (n, known, total) and in_sql[i][3:] == pytest.approx((base, score), rel=1e-8)
    got = queries.op8_katz_backoff(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        n, known, base, score, total = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-8)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert katz.K == 5


def test_op10(spark, duck):
    got = queries.op10_best_fit_packing(spark, SF).collect()
    whole = Counter()
    for r in got:
        whole[r["doc_id"]] += r["length"]
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert whole == {i: len(encoder.encode_ordinary(t or "")) + 1 for i, t in texts(duck)}
    assert all(r["bin_used"] <= 4096 for r in got)


def test_pipeline_runs(spark):
    assert queries.queries()["pipeline"](spark, SF).count() > 0
