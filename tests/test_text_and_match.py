import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.functions import match as M
from veritab.functions import sql
from veritab.functions import text as T
from veritab.operators.verify import evaluate, missing_image


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


NORMALIZED = {
    None: "", "": "", "ALC. 13.5% ALC/ VOL": "alc. 13.5% alc/vol", "12 FL. OZ.": "12 fl oz", "12 fluid ounces": "12 fl oz",
    "ALC / VOL": "alc/vol", "5% ALC BY VOL.": "5% alc by vol", "Brand#2  blue\tbolt": "brand 2 blue bolt", "Château É": "ch teau", "★": "", "alc# /vol": "alc /vol",
}


def test_normalize(spark):
    assert column(spark, NORMALIZED, T.normalize) == list(NORMALIZED.values())
    assert column(spark, ["alc# /vol"], lambda c: T.normalize(T.normalize(c))) == ["alc/vol"]


def test_quantities(spark):
    rows = [("750", "ml", "750ml"), ("750.0", "ml", "750ml"), ("1.50", "l", "1.5l"), ("0750", "ml", "750ml"), ("12", "fl oz", "12oz"), ("75", "cl", "75cl"), ("750", "millliters", "750l"), ("12345678.5", "l", "12345678.5l"), ("0.0001", "l", "0.0001l")]
    df = spark.createDataFrame(rows, "q string, u string, want string")
    for r in df.select("want", T.canonical_quantity(F.col("q"), F.col("u")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_expected_values(spark):
    assert column(spark, ["13.5", "Alc. 12 - 14%", "table wine", None], T.expected_alcohol) == [13.5, 12.0, None, None]
    assert column(spark, ["750 ML", "12 fl. oz.", "12 fl.  oz", "1 gallon", None], T.expected_net) == ["750ml", "12oz", "12 fl. oz", "1 gallon", None]


def test_page_normalizers_and_cleanups(spark):
    assert column(spark, ["750 MILLILITERS", "12 FL. OZ", "12 oz", "75 cl", "5 GALLONS", None], T.page_net_contents) == ["750ml", "12oz", "12 oz", "75 cl", "5 GALLONS", ""]
    assert column(spark, ["13.5%", " table wine ", None], T.page_alcohol) == ["13.5", "table wine", ""]
    assert column(spark, ["6. BRAND NAME (Required)", "8a.  Net   contents (x) (y)", "(only)"], T.clean_label) == ["BRAND NAME", "NET CONTENTS", ""]
    assert column(spark, [" '123\" ", "''9", "a'b"], T.clean_id) == ["123", "9", "a'b"]
    assert column(spark, ["a/b.PNG", "noext", "x.tar.gz"], T.file_suffix) == [".PNG", ".jpg", ".gz"]
    assert column(spark, ["/x y.jpg", "http://o/z", "p?q=1 2"], lambda c: T.attachment_url("https://h", c)) == ["https://h/x%20y.jpg", "http://o/z", "https://h/p?q=1%202"]
    rows = spark.createDataFrame([("image/PNG; q=1", "u"), ("text/html", "http://h/a.GIF?x=.b"), (None, "http://h/a")], "k string, u string")
    assert [r[0] for r in rows.select(T.attachment_extension(F.col("k"), F.col("u"))).collect()] == [".png", ".gif", ".jpg"]
    assert column(spark, ["What code is in the image", "what code is in the image", "ARE YOU A HUMAN", None], T.is_captcha) == [True, False, True, False]
    assert column(spark, ["image/png", "image/webp", "image/gif", "IMAGE/PNG", None], T.is_upload_type) == [True, True, False, False, False]
    assert column(spark, ["a<b & c>"], T.escape_html) == ["a&lt;b &amp; c&gt;"]


def verdict(spark, f, expected, text):
    df = spark.createDataFrame([(expected, text)], "e string, t string")
    r = df.select(f(F.col("e"), F.col("t")).alias("v")).select("v.*").first()
    return r["status"], r["confidence"], r["value_num"] if r["value_num"] is not None else r["value"], r["raw_value"]


ALCOHOL = [
    ("13.5", "13.5% alc/vol", ("found", 0.99, 13.5, "13.5% alc/vol")), ("13.5", "13.5% red", ("found", 0.99, 13.5, "13.5% ")),
    ("13.5", "12% alc/vol", ("missing", 0.0, 12.0, "12% alc/vol")), ("13.5", "12% abv 13.505% vol", ("found", 0.99, 13.505, "13.505% ")),
    ("13.5", "no number", ("missing", 0.0, 13.5, None)), ("table wine", "5%", ("missing", 0.0, "table wine", None)), (None, "5%", ("missing", None, None, None)),
]
NET = [
    ("750 mL", "net 750 ml", ("found", 0.99, "750ml", "750 ml")), ("750 mL", "75 cl", ("missing", 0.0, "75cl", "75 cl")),
    ("750 mL", "vintage 2014 clear 750ml", ("found", 0.99, "750ml", "750ml")), ("750 mL", "1,750 ml", ("found", 0.99, "750ml", "750 ml")),
    ("5 L", "5 loaves", ("found", 0.99, "5l", "5 l")), ("12 oz", "12 ounces", ("missing", 0.0, "12oz", None)), (None, "5 l", ("missing", None, None, None)),
]
BRAND = [
    ("Cascade Winery", "the cascade winery of", "found", 0.99), ("Cascade Ridge Estate Old Winery", "cascade ridge estate old", "partial", 0.8),
    ("Cascade Winery", "cascade hills", "missing", 0.0), ("Red", "hundred proof", "missing", 0.0), ("Red", "red wine", "found", 0.99),
    ("Redox", "hundredoxen", "found", 0.99), ("(ab)", "x (ab) y", "partial", 1.0), ("★", "anything", "found", 0.99), (" ", "anything", "found", 0.99), (None, "x", "missing", None), ("a a", "banana b a", "partial", 1.0), ("a a", "banana a", "found", 0.99),
]


@pytest.mark.parametrize("expected,text,want", ALCOHOL)
def test_alcohol(spark, expected, text, want):
    assert verdict(spark, M.match_alcohol, expected, text) == want


@pytest.mark.parametrize("expected,text,want", NET)
def test_net(spark, expected, text, want):
    assert verdict(spark, M.match_net, expected, text) == want


@pytest.mark.parametrize("expected,text,status,confidence", BRAND)
def test_brand(spark, expected, text, status, confidence):
    assert verdict(spark, M.match_brand, expected, text)[:2] == (status, confidence)


def test_generic_text(spark):
    assert verdict(spark, M.match_text, "a b", "b c")[:2] == ("partial", 0.5)
    assert verdict(spark, M.match_text, "a b c", "c d")[:2] == ("missing", 0.0)


WARNINGS = [
    ("", "missing", 0.0, ""), ("government warning", "missing", 0.2, "government; warning; govern; warn"), ("govemment waming", "missing", 0.0, ""),
    ("surgeon general women birth", "partial", 0.4, "surgeon; general; women; birth"), ("warning general drink", "found", 0.6, "warning; warn; general; drink"),
    ("government warning surgeon general pregnan impair health problem", "found", 1.0, "government; warning; govern; warn; surgeon; general; pregnan; impair; health; problem"),
]


@pytest.mark.parametrize("text,status,confidence,anchors", WARNINGS)
def test_warning(spark, text, status, confidence, anchors):
    w = spark.createDataFrame([(text,)], "t string").select(M.detect_warning(F.col("t")).alias("w")).first()["w"]
    assert (w["status"], w["confidence"], "; ".join(w["matched_anchors"])) == (status, confidence, anchors)
    assert set(w["matched_groups"]) == (set() if not text else {"header", "authority", "pregnancy", "impairment", "health"})


def test_warnings_list_and_default_rows(spark):
    df = spark.createDataFrame([("Cascade Ridge Estate Old Winery", "13.5", "750 mL", "cascade ridge estate old 750ml surgeon drink")], "brand_name string, alcohol_content string, net_contents string, text string")
    want = ["brand_name_partial_match", "alcohol_content_missing", "government_warning_partial"]
    assert evaluate(df).first()["warnings"] == want and evaluate(df, required=F.lit(False)).first()["warnings"] == want[:2]
    row = missing_image(df).first()
    assert row["warnings"] == ["image_not_found"] and row["brand_name_verdict"]["confidence"] is None
    assert missing_image(df, 0.0).first()["brand_name_verdict"]["confidence"] == 0.0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB #/.%é\t, alcvol")), min_size=1, max_size=30))
def test_normalized_text_is_in_the_alphabet(spark, texts):
    got = column(spark, texts, T.normalize)
    assert all(set(g) <= set("abcdefghijklmnopqrstuvwxyz0123456789% ./()-,:;") and g == g.strip() and "  " not in g for g in got)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=6), st.lists(st.sampled_from("abcdefg"), max_size=8))
def test_overlap(spark, a, b):
    r = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").select(T.token_overlap(F.col("a"), F.col("b"))).first()[0]
    assert r == (len(set(a) & set(b)) / len(set(a)) if a and b else 0.0)


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT normalize_text('12 FL. OZ. ALC/ VOL') a, token_overlap('a b', 'B c') b, warning_groups('Government general') c").first()
    assert tuple(row) == ("12 fl oz alc/vol", 0.5, 2)
    for text, want in NORMALIZED.items():
        assert spark.createDataFrame([(text,)], "v string").selectExpr("normalize_text(v)").first()[0] == want
