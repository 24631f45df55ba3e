import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veritab.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENCODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
SPLIT = bpe.splitter(public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=255), st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from("  \n\t's'll  ²½ªº"))))
def test_pieces_encode_as_the_library_encodes_the_text(text):
    assert [i for w in SPLIT(text) for i in ENCODER._encode_single_piece(w)] == ENCODER.encode_ordinary(text)


@pytest.mark.parametrize("block_bytes", [40, 16 << 20])
def test_round_trip(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block_bytes)
    texts = [None, "", "  a  b", "it's", "x" * 5000, "日本語 text", "a\x00b\x1c c", "the the the"] * 4
    docs = spark.createDataFrame([(i if i != 5 else None, t, -1, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, block int, kind string").repartition(3)
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN, carry=("block", "kind"))
    assert {tuple(r["carried"]) for r in encoded.collect()} == {("-1", "k")}
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert ids == {(i if i != 5 else None): ENCODER.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(encoded, PATH).collect()}
    assert back == {(i if i != 5 else None): (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.round_trip_digests(encoded, PATH).collect():
        text = texts[r["doc_id"] if r["doc_id"] is not None else 5] or ""
        want = ENCODER.encode_ordinary(text)
        assert r["n_tokens"] == len(want) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_unknown_id_is_an_error():
    table = bpe.byte_table(PATH)
    with pytest.raises(ValueError):
        bpe.decode_ids(np.array([60000]), table)


def test_blocks_of_a_task_share_a_bucket(spark):
    from itertools import islice

    from pyspark.sql import functions as F

    from veritab.llm.blocks import block_numbers, spark_hash

    numbers = [0, 1, -1, 2**31, 2**40 + 7, 5 << 32]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n bigint").select(F.hash("n")).collect()]
    assert spark_hash(np.array(numbers)).tolist() == got
    for task, buckets in ((0, 8), (13, 5), (70_000, 100_000)):
        some = list(islice(block_numbers(task, buckets), 5))
        assert len(set(some)) == 5 and {n >> 32 for n in some} == {task}
        assert {int(h) % buckets for h in spark_hash(np.array(some))} == {task % buckets}
