import re

import duckdb
import pytest

import __spark_entry__ as entry
from veritab.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(values):
    clean = lambda v: None if v is None else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted([tuple(map(clean, r)) for r in values], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [[r[names.index(c)] for c in columns] for r in cursor.fetchall()]
    assert sorted(names) == columns
    assert rows(df.select(*columns).collect()) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown_and_joins(spark):
    plan = lambda n: catalogue.queries()[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan("label_quality_by_source")
    for name in catalogue._QUERIES:
        assert "CartesianProduct" not in plan(name), name
    assert "TakeOrderedAndProject" in plan("top_warnings") and "Python" not in plan("evaluate_labels")


def test_detail_pages_are_not_joined_to_themselves(spark, tmp_path):
    """Pages are many times larger than Spark reckons from the parts: a join of them is broadcast, which the driver cannot hold at 1 GB."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE p_partkey // 2 END AS p_partkey, p_name, p_brand FROM '{SF}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    df = catalogue.queries()["page_details"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and "RoundRobinPartitioning" in plan
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()['page_details']})").fetchall()
    assert rows(df.collect()) == rows(want)  # keys that repeat or are null keep their rows


@pytest.mark.parametrize("name,most", [("evaluate_labels", 10), ("top_warnings", 10), ("associate_boxes", 12), ("fallback_prefix_choice", 20), ("variant_summary", 20)])
def test_expressions_are_not_copied(spark, name, most):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_|RLIKE", plan)) <= most and plan.count("replace(") <= 9 * most
