import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.operators import associate, attempts, evaluation, overlap, words
from veritab.operators.verify import evaluate
from veritab.plans import evidence as E
from veritab.sources import adapters, engines, uploads

SF = "/root/testdata/sf0.001"
WORD = "id int, word_no int, text string, conf int, block_num int, par_num int, line_num int, left int, top int, width int, height int"


def test_words_to_lines(spark):
    rows = [(1, 0, "CASCADE", 90, 1, 1, 1, 10, 10, 50, 20), (1, 1, "WINERY", 80, 1, 1, 1, 70, 12, 40, 20), (1, 2, "x", 29, 1, 1, 1, 0, 0, 1, 1), (1, 3, "", -1, 1, 1, 1, 0, 0, 1, 1), (1, 4, "late", 30, 1, 1, 0, 0, 90, 5, 5)]
    got = words.lines(spark.createDataFrame(rows, WORD), ["id"], F.lit(0.5)).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"], r["bbox"], r["confidence"]) for r in got] == [(0, "CASCADE WINERY", [20, 20, 220, 64], 0.85), (1, "late", [0, 180, 10, 190], 0.3)]
    assert words.text_of_lines(words.lines(spark.createDataFrame(rows, WORD), ["id"]), ["id"]).first()["text"] == "CASCADE WINERY late"


def test_parallel_arrays_and_polygons(spark):
    arrays = spark.createDataFrame([(1, ["a", "b"], [5, 6])], "id int, text array<string>, conf array<int>")
    assert [tuple(r) for r in words.words_from_arrays(arrays, ["id"], ["text", "conf"]).collect()] == [(1, 0, "a", 5), (1, 1, "b", 6)]
    rows = [(1, [" a ", "  ", "c", "d"], [[[1.0, 2.0], [5.0, 1.0], [4.9, 9.0]], [[0.0, 0.0]], None], [0.12345])]
    df = spark.createDataFrame(rows, "id int, rec_texts array<string>, dt_polys array<array<array<double>>>, rec_scores array<double>")
    got = words.polygon_boxes(df, ["id"], F.lit(0.5)).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"], r["bbox"], r["confidence"]) for r in got] == [(0, "a", [2, 2, 10, 18], 0.123), (2, "c", None, 0.0), (3, "d", None, 0.0)]


def test_merge_and_angles(spark):
    rows = [(1, 0, "a  b", "full", 0), (1, 1, "  ", "full", 90), (1, 2, "c", "full", 0), (1, 3, "w", "right_strip", 270), (2, 0, " ", "full", 0)]
    df = spark.createDataFrame(rows, "label_id int, attempt_no int, text string, region string, angle int")
    assert {r["label_id"]: r["text"] for r in attempts.merge_attempts(df).collect()} == {1: "a b c w", 2: ""}
    assert attempts.angle_map(df.filter("label_id = 1")).first()["ocr_by_angle"] == {0: "a  b", 90: "  "}


def test_specs_and_engine_names(spark):
    assert attempts.specs(spark, "tesseract").count() == 8 and attempts.specs(spark, "paddleocr").count() == 4
    with pytest.raises(ValueError):
        attempts.specs(spark, "other")
    df = spark.createDataFrame([("paddleocr",), ("other",), (None,)], "e string")
    assert [r[0] for r in df.select(attempts.engine_or_default(F.col("e"))).collect()] == ["paddleocr", "tesseract", "tesseract"]
    with pytest.raises(ValueError):
        engines.get("other")


def test_wave_plan_equals_prefix_plan(spark):
    apps, tries = E.apps(spark, SF).cache(), E.attempts(spark, SF).cache()
    a = attempts.prefix_plan(apps, tries).select("label_id", "attempt_no", "text", "warnings", "ocr_ms").collect()
    b = attempts.wave_plan(apps, "tesseract", engines.recorded(tries)).select("label_id", "attempt_no", "text", "warnings", "ocr_ms").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len({r["attempt_no"] for r in a}) > 2


SCORES = [
    ("cascade winery", "the cascade winery", "brand_name", 1.0), ("750ml", "750 ml", "net_contents", 0.95), ("750 ml", "7", "net_contents", 0.95),
    ("cascade winery", "cascade", "brand_name", 0.45), ("cascade hill winery", "winery by cascade", "brand_name", 2 / 3 * 0.7), ("cascade winery estates", "red", "brand_name", 0.0), ("", "x", "brand_name", 0.0),
]


@pytest.mark.parametrize("raw,box,field,want", SCORES)
def test_box_score(spark, raw, box, field, want):
    got = spark.createDataFrame([(raw, box, field)], "r string, b string, f string").select(associate.box_score(F.col("r"), F.col("b"), F.col("f"))).first()[0]
    assert got == pytest.approx(want)


def one(spark, text):
    return evaluate(spark.createDataFrame([(1, "Cascade Winery", "13.5", None, text)], "label_id int, brand_name string, alcohol_content string, net_contents string, text string"))


def test_association(spark):
    box = "label_id int, attempt_no int, line_no int, text string, bbox array<int>, confidence double"
    rows = [(1, 0, 0, "Cascade", [0], 1.0), (1, 0, 1, "the CASCADE WINERY", [0], 1.0), (1, 0, 2, "cascade winery", [0], 1.0), (1, 3, 0, "cascade winery x", [0], 1.0), (1, 0, 3, "WARNING", [0], 1.0), (1, 0, 4, "warning:", [0], 1.0)]
    evaluated = one(spark, "the cascade winery 13.5% alc warning surgeon")
    got = associate.associate(evaluated, spark.createDataFrame(rows, box)).orderBy("field", "rank").collect()
    assert [(r["field"], r["rank"], r["line_no"], r["score"]) for r in got] == [("brand_name", 1, 1, 1.0), ("brand_name", 2, 2, 1.0)]
    assert [r["line_no"] for r in associate.warning_boxes(evaluated, spark.createDataFrame(rows, box)).collect()] == [3]


def test_confidence_and_answer(spark):
    row = one(spark, "cascade winery 13.5% warning general drink").select(associate.overall_confidence([F.col(f"{n}_verdict") for n in C.FIELDS], F.col("government_warning"))).first()[0]
    assert row == pytest.approx(0.86)
    entry = associate.answer(one(spark, "cascade winery"), debug=F.lit(True)).first()["entry"]
    assert entry["fields"]["brand_name"]["match_status"] == "match" and entry["fields"]["net_contents"]["confidence"] == 0.0
    assert entry["summary"]["gov_warning"] == "not_found" and entry["debug"]["normalized_text"] == "cascade winery"
    assert '"overall_confidence"' in associate.answers_json(associate.answer(one(spark, "x"))).first()["json"]


def test_display(spark):
    df = spark.createDataFrame([(["match", "match"], True, 0.985, "x" * 90, [10, 20, 30, 60])], "s array<string>, b boolean, c double, t string, x array<int>")
    r = df.select(associate.card_class(F.col("s")).alias("k"), associate.shown_value(F.col("b")).alias("v"), associate.shown_percent(F.col("c")).alias("p"), associate.preview(F.col("t")).alias("t"), associate.box_percent(F.col("x"), F.lit(100), F.lit(200)).alias("g")).first()
    assert (r["k"], r["v"], r["p"], len(r["t"])) == ("match", "Yes", "99%", 81) and tuple(r["g"]) == (10.0, 10.0, 20.0, 20.0)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["cascade winery", "13.5%", "warning", "general", "drink", ""]), max_size=5))
def test_counts_add_up(spark, parts):
    evaluated = one(spark, " ".join(parts))
    for r in evaluation.field_status(evaluated).collect():
        assert r["found"] + r["partial"] + r["missing"] == r["total"] == 1


def test_summary_report_and_sinks(spark, tmp_path):
    results = attempts.prefix_plan(E.apps(spark, SF), E.attempts(spark, SF)).withColumns({"total_ms": F.col("ocr_ms"), "error": F.lit(None).cast("string"), "image_path": F.lit("p"), "engine": F.lit("recorded")})
    results = results.join(attempts.angle_map(E.attempts(spark, SF)), "label_id").cache()
    row = evaluation.summary(results, results, "recorded")
    text = evaluation.report(row)
    assert "brand_name" in text and "variant original" in text and "avg_total_ms" in text
    evaluation.write_summary(row, f"{tmp_path}/summary")
    evaluation.write_detail(results, f"{tmp_path}/detail")
    evaluation.write_records(results, f"{tmp_path}/records")
    assert len(spark.read.csv(f"{tmp_path}/detail", header=True).columns) == 29
    assert spark.read.json(f"{tmp_path}/records").count() == 200
    assert evaluation.timing(results.limit(0)).first()["avg_total_ms"] == 0.0


def test_both_ways_of_the_overlap_join(spark):
    items = spark.createDataFrame([(1, "a b c d"), (2, "x"), (3, ""), (4, "the the a")], "item_id int, text string")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "the a x", "", None, "d c b a q", "Q", "the cat"])], "doc_id int, text string")
    a, b = (sorted(tuple(r) for r in overlap.overlap_join(items, texts, broadcast_words=n).collect()) for n in (1000, 0))
    assert a == b == [(1, 0, 2, 0.5), (1, 4, 4, 1.0), (2, 1, 1, 1.0), (4, 0, 1, 0.5), (4, 1, 2, 1.0), (4, 4, 1, 0.5), (4, 6, 1, 0.5)]
    assert overlap.overlap_join(items.limit(0), texts).count() == 0


def test_adapters(spark):
    words_ = {"text": ["CASCADE", " WINERY ", "x", "", "late"], "conf": ["90", 80, 29, -1, 30], "block_num": [1] * 5, "par_num": [1] * 5, "line_num": [1, 1, 1, 1, 0],
              "left": [10, 70, 0, 0, 0], "top": [10, 12, 0, 0, 90], "width": [50, 40, 1, 1, 5], "height": [20, 20, 1, 1, 5]}
    text, boxes = adapters.word_engine(lambda gray, psm: words_)(np.full((300, 300, 3), 255, np.uint8), "basic", 6)
    assert text == "CASCADE WINERY late" and [b["bbox"] for b in boxes] == [[5, 5, 55, 16], [0, 45, 2, 47]] and [b["confidence"] for b in boxes] == [0.85, 0.3]
    polygons = {"rec_texts": [" a ", "  ", "c", "d"], "dt_polys": [[[1.0, 2.0], [5.0, 1.0], [4.9, 9.0]], [[0.0, 0.0]], None], "rec_scores": [0.12345]}
    shapes = [polygons, type("R", (), {"res": polygons})(), type("R", (), polygons)()]
    for shape in shapes:
        text, boxes = adapters.polygon_engine(lambda img, shape=shape: [shape])(np.zeros((3200, 10, 3), np.uint8), "basic", 11)
        assert text == "a c d" and boxes == [{"text": "a", "bbox": [2, 2, 10, 18], "confidence": 0.123}]
    adapters.install()
    assert engines.get("tesseract") is adapters.word_engine and engines.get("paddleocr") is adapters.polygon_engine


def test_uploads(spark):
    forms = spark.createDataFrame([("r1", " Foo ", None, "750 ml", "true", "false", "other"), ("r2", "B", "5", "1 l", None, None, "paddleocr")], "request_id string, brand_name string, alcohol_content string, net_contents string, gov_warning_expected string, debug string, engine string")
    files_ = spark.createDataFrame([("r1", 0, "a.PNG", "image/png", b"1"), ("r1", 1, "b", "image/jpeg", b"2"), ("r1", 2, "c.gif", "image/gif", b"3"), ("r2", 0, "d", None, b"4"), ("r3", 0, "e.png", "image/png", b"5")], "request_id string, file_no int, filename string, content_type string, content binary")
    got = uploads.requests(forms, files_).orderBy("file_no").collect()
    assert [(r["filename"], r["suffix"], r["brand_name"], r["alcohol_content"], r["gov_warning_expected"], r["engine"]) for r in got] == [("a.PNG", ".PNG", "Foo", "", True, "tesseract"), ("b", ".jpg", "Foo", "", True, "tesseract")]
