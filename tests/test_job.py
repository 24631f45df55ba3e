from pyspark.sql import functions as F

from veritab.operators import associate, dataset, image
from veritab.plans import evidence as E
from veritab.plans import api, job
from veritab.sources import engines

SF = "/root/testdata/sf0.001"


def test_job(spark, tmp_path):
    apps = E.apps(spark, SF).withColumn("image_path", F.concat(F.lit("images/"), F.col("label_id").cast("string"), F.lit(".jpg")))
    apps.select(F.col("label_id").alias("TTB ID"), "image_path", F.col("brand_name").alias("Brand Name"), "alcohol_content", "net_contents", "variant_type").coalesce(1).write.csv(f"{tmp_path}/records", header=True, escape='"')
    tries = E.attempts(spark, SF).join(apps.select("label_id", "image_path"), "label_id").filter("label_id % 10 <> 0")
    tries.write.parquet(f"{tmp_path}/attempts")
    text = job.main(["--records", f"{tmp_path}/records", "--attempts", f"{tmp_path}/attempts", "--out", f"{tmp_path}/out", "--engine", "paddleocr"])
    assert text.startswith("200 records") and "image errors: 20" in text
    detail = spark.read.csv(f"{tmp_path}/out/detail", header=True)
    assert len(detail.columns) == 29 and detail.count() == 200 and detail.filter("error = 'image_not_found'").count() == 20
    assert {r["ocr_engine"] for r in detail.select("ocr_engine").distinct().collect()} == {"paddleocr"}
    assert spark.read.json(f"{tmp_path}/out/summary").count() == 1


def test_numbered(spark):
    rows = spark.range(1000).repartition(7).withColumn("x", 1000 - F.col("id"))
    got = dataset.numbered(rows, "x").collect()
    assert all(r["record_no"] == r["x"] and r["records"] == 1000 for r in got) and len(got) == 1000
    assert dataset.numbered(rows.limit(0), "x").count() == 0


def test_with_files(spark):
    entries = spark.createDataFrame([("a", 1), ("b", 2)], "filename string, e int")
    files = spark.createDataFrame([("a", 2, 20), ("a", 1, 10)], "filename string, file_no int, size int")
    got = {r["filename"]: r["file"] for r in associate.with_files(entries, files).collect()}
    assert got["a"]["size"] == 10 and got["b"] is None


def test_attempts_are_found_by_their_whole_spec(spark):
    rows = [(1, "p", 3, "full", 0, "bilateral", 6, "of the other engine"), (1, "p", 6, "bottom_strip", 0, "basic", 11, "strip"), (1, "p", 9, "full", 0, "basic", 6, "first")]
    tries = spark.createDataFrame([(*r, 1.0) for r in rows], "label_id int, image_path string, attempt_no int, region string, angle int, preprocess_mode string, psm int, text string, elapsed_ms double")
    of = lambda engine: sorted((r["attempt_no"], r["text"]) for r in job.own_attempts(tries, engine).collect())
    assert of("paddleocr") == [(0, "first"), (3, "strip")] and of("tesseract") == [(0, "first"), (3, "of the other engine")]


def test_job_from_images(spark, tmp_path):
    folder = tmp_path / "dataset"
    made = spark.createDataFrame([(f"images/p{k}", 40, 60, 3, bytes([20 * k]) * 7200) for k in range(3)], "name string, height int, width int, nChannels int, data binary")
    (folder / "images").mkdir(parents=True)
    image.write_pngs(made, f"file://{folder}").collect()
    (folder / "images" / "bad.png").write_bytes(b"no image")
    records = [(str(k), p, "Red", "5%", "", "original") for k, p in enumerate(["images/p0.png", "images/p1.png", "images/bad.png", "images/raw/p1.png", ""])]
    spark.createDataFrame(records, "`TTB ID` string, image_path string, `Brand Name` string, alcohol_content string, net_contents string, variant_type string").coalesce(1).write.csv(f"{tmp_path}/records", header=True, escape='"')
    engines.register("paddleocr", lambda: lambda img, mode, psm: (f"red 5% {img.shape[0]} {psm}", []))
    try:
        text = job.main(["--records", f"{tmp_path}/records", "--images", str(folder), "--out", f"{tmp_path}/out", "--engine", "paddleocr"])
    finally:
        engines._REGISTRY.pop("paddleocr")
    assert text.startswith("5 records") and "image errors: 2" in text
    got = {r["ttb_id"]: r for r in spark.read.csv(f"{tmp_path}/out/detail", header=True).collect()}
    assert got["0"]["brand_name_status"] == "found" and got["0"]["ocr_angle_90"] == "red 5% 60 11" and got["2"]["ocr_text"] is None and got["3"]["error"] == "image_not_found"


def test_calls_of_the_api(spark):
    engines.register("paddleocr", lambda: lambda img, mode, psm: (f"red {'750 ml' if psm == 11 else ''}", []))
    pixels = spark.createDataFrame([(k, 40, 60, 3, bytes(7200)) for k in range(2)], "label_id int, height int, width int, nChannels int, data binary")
    apps = spark.createDataFrame([(0, "Red", None, "750 ml"), (9, "Red", None, None)], "label_id int, brand_name string, alcohol_content string, net_contents string")
    try:
        assert {r["label_id"]: r["text"] for r in api.read_images(pixels, "paddleocr").collect()} == {0: "red ", 1: "red "}
        (row,) = api.evaluate_images(apps, pixels, "paddleocr").collect()
    finally:
        engines._REGISTRY.pop("paddleocr")
    assert row["label_id"] == 0 and row["entry"]["summary"]["net_contents"] == "match" and row["entry"]["summary"]["gov_warning"] == "not_found"
