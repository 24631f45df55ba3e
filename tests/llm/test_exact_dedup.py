import hashlib
from collections import defaultdict

from veritab.llm import exact_dedup, shared

SCHEMA = "doc_id bigint, text string, digest string, keep_id int"  # columns that clash with the operator's own


def verdicts(spark, rows, index):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return {(r["doc_id"], bytes(r["digest"])): r for r in exact_dedup.deduplicate(df, index).collect()}


def new_index(spark):
    return exact_dedup.DigestIndex(spark, shared.new_path(spark, "test-index"), buckets=4)


def key(i, t):
    return i, hashlib.sha256((t or "").encode()).digest()


def test_batch_then_batch(spark):
    index = new_index(spark)
    rows = [(1, "a"), (5, "a"), (3, None), (4, ""), (9, "A"), (7, "x" * 100_000), (2, "a"), (None, "a"), (None, "only")]
    got = verdicts(spark, rows, index)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        r = got[key(i, t)]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), i == keep)
    again = verdicts(spark, [(100, "a"), (101, "new"), (102, "new")], index)
    assert (again[key(100, "a")]["keep_id"], again[key(100, "a")]["kept"]) == (5, False)
    assert again[key(102, "new")]["kept"] and not again[key(101, "new")]["kept"]
    assert index.rows().count() == 6
    reopened = exact_dedup.DigestIndex(spark, "unused", buckets=4, table=index.table)
    assert not verdicts(spark, [(200, "new")], reopened)[key(200, "new")]["kept"]


def test_empty_and_repeated_rows(spark):
    index = new_index(spark)
    assert verdicts(spark, [], index) == {} and index.rows().count() == 0
    got = verdicts(spark, [(1, "a"), (1, "a")], index)
    assert got[key(1, "a")]["group_size"] == 2 and got[key(1, "a")]["kept"]


def test_index_side_is_not_shuffled(spark):
    index = new_index(spark)
    verdicts(spark, [(1, "a")], index)
    batch = exact_dedup.digests(spark.createDataFrame([(2, "b")], "doc_id bigint, text string")).groupBy("digest").count()
    plan = batch.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_kept_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (3, "b", None, None)], SCHEMA)
    out = exact_dedup.keep_first_copies(df, new_index(spark))
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3]


def test_a_batch_that_is_run_again_keeps_its_verdicts(spark):
    index = new_index(spark)
    df = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "x", 1), (3, "b", "x", 1)], SCHEMA)
    show = lambda batch: sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(df, index, batch=batch).collect())
    first = show("monday")
    assert first == [(1, 2, False), (2, 2, True), (3, 3, True)] == show("monday")
    assert index.rows().count() == 2
    assert [x[2] for x in show("tuesday")] == [False] * 3 and show("monday") == first
    kept = lambda batch: sorted(r["doc_id"] for r in exact_dedup.keep_first_copies(df, index, batch=batch).collect())
    assert kept("monday") == [2, 3] and kept("wednesday") == []


def test_rows_are_judged_by_id_and_text(spark):
    rows = [(1, "u", "p", 1), (1, "x", "p", 1), (5, "x", "p", 1), (7, "y", "p", 1), (7, "y", "q", 2), (None, "z", "p", 1), (None, "z", "p", 1), (None, "x", "p", 1), (8, None, "p", 1), (9, "", "p", 1)]
    for bound in (0, 1000):
        out = exact_dedup.keep_first_copies(spark.createDataFrame(rows, SCHEMA), new_index(spark), bound=bound)
        assert out.columns == ["doc_id", "text", "digest", "keep_id"]
        assert sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect())) == [(0, "z"), (1, "u"), (5, "x"), (7, "y"), (9, "")]
