import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_dedup import brute
from veritab.llm import bpe, near_dedup, packing, shared, toxicity
from veritab.sources import tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    text = lambda i, n=60: " ".join(f"w{(i * 7919 + k * k * 31 + k) % 5000}x" for k in range(n))
    rows = [(i, text(i), "en", f"s{i % 3}") for i in range(300)]
    rows += [(300 + i, text(i), "en", "s9") for i in range(20)]
    rows += [(400 + i, text(i) + " changed", "en", "s9") for i in range(20)]
    rows += [(500 + i, text(900 + i) + f" horridthing vileness {i}", "en", "s9") for i in range(60)]
    rows += [(600, None, None, None), (601, "", "en", "s1"), (602, "a" * 50_000, "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(500 <= i < 560)) for i in [*range(0, 300), *range(500, 560)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "packing"]
    model = toxicity.fit_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left, kept = docs, {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, folder)
        assert left.columns == docs.columns
        ids = {r["doc_id"] for r in left.collect()}
        if name == "toxicity":
            want = {i for i, r in kept.items() if toxicity.score_texts(model, [r["text"] or ""])[0][0] < 0.5}
            assert want == {i for i in kept if not 500 <= i < 560}
        elif name == "exact_dedup":
            want = {max(i for i, r in kept.items() if (r["text"] or "") == t) for t in {r["text"] or "" for r in kept.values()}}
        else:
            want = {i for i, v in brute([(i, r["text"]) for i, r in kept.items()]).items() if v[2]}
        assert ids == want, name
        kept = {i: kept[i] for i in ids}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    total = sum(len(encoder.encode_ordinary(r["text"] or "")) + 1 for r in kept.values())
    packed = corpus_pipeline.run(spark, folder)
    assert packed.agg(F.sum("length")).first()[0] == total
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept)


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_stage_links_from_four_fifths(spark):
    base = [f"b{k}" for k in range(100)]  # 96 shingles
    copy = lambda more, mark: " ".join([*(f"{w}{mark}" for w in base), *(f"{mark}{k}" for k in range(more))])
    rows = [(1, copy(0, "x")), (2, copy(21, "x")), (3, copy(0, "y")), (4, copy(27, "y"))]  # 96 of 117 (0.82), 96 of 123 (0.78)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == {1, 3, 4}
    assert (near_dedup.depths(85), near_dedup.agreeing_slots(85)) == ((4, 6, 8), 90)


def test_stages_judge_rows_not_ids(spark):
    text = lambda mark: " ".join(f"{mark}{k}" for k in range(40))
    rows = [(1, text("u")), (1, text("x")), (5, text("x")), (7, text("y")), (7, text("y")), (None, text("z")), (None, text("z") + " more"), (9, None), (9, ""), (5, text("y") + " more")]
    docs = spark.createDataFrame([(i, t, f"clash{k}", k, None) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, digest string, kept int, node string")
    once = corpus_pipeline.exact_stage(spark, docs, "")
    again = corpus_pipeline.exact_stage(spark, docs, "")
    show = lambda df: sorted((r["doc_id"] or -1, (r["text"] or "")[:2]) for r in df.collect())
    assert show(once) == show(again) == [(-1, "z0"), (-1, "z0"), (1, "u0"), (5, "x0"), (5, "y0"), (7, "y0"), (9, "")]
    near = corpus_pipeline.near_stage(spark, once, "")
    assert near.columns == docs.columns and show(near) == [(-1, "z0"), (1, "u0"), (5, "x0"), (5, "y0"), (9, "")]
    packed = corpus_pipeline.packing_stage(spark, near.withColumn("source", F.lit(None).cast("string")), "")
    assert packed.select("doc_id").distinct().count() == 4


def test_nothing_is_left_behind(spark, folder):
    before = shared.mark()
    corpus_pipeline.run(spark, folder).count()
    left = [name for _, name in tables._LEFT[before:]]
    assert len(left) <= 8  # the last stage's input and what its plan still reads
    shared.sweep(spark, before)
    assert shared.mark() == before
