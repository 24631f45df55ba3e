import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.operators import dataset, html
from veritab.operators import image as I
from veritab.plans import evidence as E
from veritab.sources import engines, files
from veritab.streaming import verify

PAGE = """<html><body><table><tr><td><div class="boldlabel">6. BRAND NAME (Required)</div><div class="data"> Foo &amp; <b>Co</b> </div></td>
<td><div class="label">8a. Net contents</div><div class="data"> </div><div class="data">750 MILLILITERS</div></td>
<td><div class="data">13.5%</div><p><div class="mylabel">ALCOHOL  CONTENT</div></p></td>
<td><div class="label">EMPTY</div></td><td><div class="label">brand name</div><div class="data">Bar</div></td></tr></table>
<img src="/x/publicViewAttachment.do?f=a b"><img src="/logo.png"><script>var s = '<div class="label">no</div>';</script></body></html>"""


def test_page_fields(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<div class=label>x")], "page_id long, html string")
    got = {r["page_id"]: r for r in html.page_fields(pages).collect()}
    assert got[1]["fields"] == {"BRAND NAME": "Bar", "NET CONTENTS": "750 MILLILITERS", "ALCOHOL CONTENT": "13.5%"}
    assert got[1]["image_urls"] == ["/x/publicViewAttachment.do?f=a b"] and got[2]["fields"] == {} == got[3]["fields"]
    detail = dataset.details_from_pages(html.page_fields(pages).join(pages, "page_id")).filter("page_id = 1").first()
    assert (detail["brand_name_detail"], detail["fanciful_name_detail"], detail["net_contents"], detail["alcohol_content"], detail["image_count"]) == ("Bar", "", "750ml", "13.5", 1)


def test_csv_records(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes('﻿TTB ID , Brand Name,note\n" \'12\' ","a ""b""\nc",NA\n7,,x\n'.encode())
    rows = files.export(spark, str(path)).orderBy("TTB ID").collect()
    assert [tuple(r) for r in rows] == [("12", 'a "b"\nc', "NA"), ("7", "", "x")]
    assert files.records(spark, str(path), files.MISSING).filter("note = ''").count() == 1
    files.write_records(files.export(spark, str(path)), f"{tmp_path}/out")
    assert sorted(map(tuple, files.records(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, rows))


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(0)
    made = {f"p{k}": rng.integers(0, 256, (40 + k, 60, 3), dtype=np.uint8) for k in range(3)}
    rows = [(n, *img.shape, img.tobytes()) for n, img in made.items()]
    df = spark.createDataFrame(rows, "name string, height int, width int, nChannels int, data binary")
    written = I.write_pngs(df, f"file://{folder}").collect()
    (folder / "bad.png").write_bytes(b"no image")
    return str(folder), made, written


def test_images_listing_existence(spark, pictures):
    folder, made, written = pictures
    assert sorted(r["name"] for r in written) == sorted(made)
    read = {r["path"].rsplit("/", 1)[1]: r for r in files.images(spark, folder).collect()}
    assert read["bad.png"]["height"] is None
    for n, img in made.items():
        r = read[f"{n}.png"]
        assert np.array_equal(I.from_row(r["height"], r["width"], r["nChannels"], bytes(r["data"])), img)
    names = [r["path"].rsplit("/", 1)[1] for r in files.listing(spark, folder).collect()]
    assert names == sorted(names) and len(names) == 4
    rows = spark.createDataFrame([("./p0.png ",), ("raw/p0.png",), ("none.png",), (None,)], "image_path string")
    found = {r["image_path"]: r["image_exists"] for r in files.with_existence(rows, files.listing(spark, folder), folder).collect()}
    assert found == {"./p0.png ": True, "raw/p0.png": False, "none.png": False, None: False}
    other = spark.createDataFrame([("file:/d/other/x.jpg",), ("hdfs://h/d/images/raw/y.jpg",)], "path string")
    rows = spark.createDataFrame([("images/raw/x.jpg",), ("images\\raw/y.jpg",)], "image_path string")
    found = {r["image_path"]: r["image_exists"] for r in files.with_existence(rows, other, "/d").collect()}
    assert found == {"images/raw/x.jpg": False, "images\\raw/y.jpg": False}  # the second is another store's /h/d


def test_transform_distort_stack(spark, pictures):
    folder, made, _ = pictures
    images = files.images(spark, folder).withColumn("image_id", F.regexp_extract("path", r"([^/]+)\.png$", 1))
    spec = spark.createDataFrame([(0, "full", 0), (4, "right_strip", 90), (6, "bottom_strip", 270)], "attempt_no int, region string, angle int")
    got = {(r["image_id"], r["attempt_no"]): r for r in I.transform(images, spec).collect()}
    assert len(got) == 9
    r = got["p1", 4]
    assert np.array_equal(I.from_row(r["height"], r["width"], 3, bytes(r["data"])), np.rot90(made["p1"][:, 43:], -1))
    a, b = ([tuple(r) for r in I.distorted(df).orderBy("image_id", "variant_no").collect()] for df in (images, images.repartition(3)))
    assert a == b and len(a) == 6
    parts = images.filter("height is not null").select(F.lit(1).alias("record_id"), F.substring("image_id", 2, 1).cast("int").alias("part_no"), "height", "width", "nChannels", "data")
    whole = I.stacked(parts).first()
    assert (whole["height"], whole["width"], whole["image_count"]) == (123, 60, 3)
    assert [r["y_offset"] for r in I.stack_layout(parts).orderBy("part_no").collect()] == [0, 40, 81]


def test_kernels():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (50, 70, 3), dtype=np.uint8)
    assert np.array_equal(I.rotate(I.rotate(I.rotate(I.rotate(img, 90), 90), 90), 90), img) and np.array_equal(I.rotate(img, 90), I.rotate(img, 270)[::-1, ::-1])
    with pytest.raises(ValueError):
        I.rotate(img, 45)
    with pytest.raises(ValueError):
        I.region(img, "left")
    with pytest.raises(ValueError):
        I.preprocess(img, "other")
    flat = np.full((50, 70, 3), 100, np.uint8)
    for mode in ("basic", "median", "bilateral"):
        out, scale = I.preprocess(flat, mode)
        assert out.shape == (429, 600) and abs(scale - 600 / 70) < 1e-9 and np.all(out == 100)
    assert set(np.unique(I.preprocess(img, "adaptive")[0])) <= {0, 255}
    assert I.shrink_for_polygons(np.zeros((3200, 10, 3), np.uint8))[0].shape == (1600, 5, 3)
    assert np.all(np.abs(I.resize(flat, 0.37).astype(int) - 100) <= 1)
    assert np.allclose(I.blur(flat, 5), 100) and np.all(I.tilt(flat, 2.5) == 100)
    assert np.array_equal(I.tilt(img, 0.0), img) and np.array_equal(I.perspective(img, [(0, 0), (70, 0), (70, 50), (0, 50)]), img)
    assert np.all(I.brightness(flat, 1.2) == 120) and 4 < I.noise(flat, 5, I.generator("a", 1)).std() < 6
    h = I.homography([(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 1), (3, 1), (4, 4), (0, 3)])
    p = h @ np.array([1, 1, 1.0])
    assert np.allclose(p[:2] / p[2], (4, 4))
    labels = {kind for k in range(60) for label, _ in I.distort(img, k) for kind in re.findall("([a-z]+)_", label)}
    assert labels == {"blur", "rotation", "bright", "noise", "persp"}
    assert I.stack([img, flat[:, :30]]).shape == (100, 70, 3) and np.all(I.stack([img, flat[:, :30]])[50:, 30:] == 255)


def test_live_engine(spark, pictures):
    folder, made, _ = pictures
    engines.register("mean", lambda: lambda img, mode, psm: (f"{mode} {psm} {img.shape[0]}", [{"text": "t", "bbox": [0, 0, 1, 1], "confidence": 0.5}]))
    images = files.images(spark, folder).withColumn("label_id", F.regexp_extract("path", r"([^/]+)\.png$", 1))
    got = {r["label_id"]: r["text"] for r in engines.text_only(images, "mean").collect()}
    assert got == {"p0": "basic 6 40", "p1": "basic 6 41", "p2": "basic 6 42", "bad": ""}


ROWS = "id string, row_no int, fetch_status string, image_path string, brand string"


def test_resume_and_merge(spark):
    prior = spark.createDataFrame([("a", 0, "captcha", "", "x"), ("b", 1, "ok", "p", "y"), ("a", 2, "ok", "p", "z"), ("c", 3, "no_image", "", "w"), ("gone", 4, "no_image", "", "g")], ROWS)
    records = spark.createDataFrame([("a", 0, "A"), ("b", 1, "B"), ("c", 2, "C"), ("d", 3, "D")], "id string, row_no int, brand string")
    last = {r["id"]: (r["brand"], r["first_row"]) for r in dataset.last_per_id(prior).collect()}
    assert last == {"a": ("z", 0), "b": ("y", 1), "c": ("w", 3), "gone": ("g", 4)}
    todo = dataset.pending(records, prior)
    assert sorted(r["id"] for r in todo.collect()) == ["c", "d"]
    assert sorted(r["id"] for r in dataset.pending(records, prior, overwrite=records.filter("id = 'b'")).collect()) == ["b", "c", "d"]
    assert sorted(r["id"] for r in dataset.kept(prior, todo).collect()) == ["a", "b", "gone"]
    fetched = spark.createDataFrame([("c", "", "ok")], "id string, brand string, fetch_status string")
    merged = {r["id"]: (r["brand"], r["fetch_status"]) for r in dataset.merge_metadata(records, prior, fetched).collect()}
    assert merged == {"a": ("z", "ok"), "b": ("y", "ok"), "gone": ("g", "no_image"), "c": ("", "ok"), "d": ("D", None)}
    reused, rest = dataset.reuse(todo, prior, spark.createDataFrame([("c",), ("d",)], "id string"))
    assert [(r["id"], r["brand"]) for r in reused.collect()] == [("c", "w")] and [r["id"] for r in rest.collect()] == ["d"]
    assert "image_count" in dataset.with_extra_columns(records).columns


def test_curation_sampling_master(spark):
    rows = [("a", 0, "ok", "images/a.jpg", "x"), ("b", 1, "ok_partial", " p ", "x"), ("c", 2, "ok", " ", "x"), ("d", 3, "ok", "images/d.jpg", "x")]
    df = spark.createDataFrame(rows, ROWS)
    assert sorted(r["id"] for r in dataset.eligible(df).collect()) == ["a", "d"]
    assert dataset.exact_sample(dataset.eligible(df), 0.5, dataset.seeded("id")).count() == 1
    assert dataset.exact_sample(df.limit(0), 0.5, dataset.seeded("id")).count() == 0
    variants = spark.createDataFrame([("a", "images/a_v.jpg", "blur_k3", "images/a.jpg"), ("d", "images/d_v.jpg", "blur_k5", "images/d.jpg")], "id string, image_path string, variant_type string, base_image string")
    existing = spark.createDataFrame([("a", "images/a_old.jpg", "noise_s5", "images/a.jpg"), ("b", "p", None, "")], "id string, image_path string, variant_type string, base_image string")
    got = sorted((r["id"], r["variant_type"]) for r in dataset.master(df, existing, variants).collect())
    assert got == [("a", "noise_s5"), ("a", "original"), ("b", "original"), ("d", "blur_k5"), ("d", "original")]
    assert dataset.lookup(df, "id", "b", "fetch_status") == "ok_partial" and dataset.lookup(df, "id", "zz", "brand") is None
    assert [r["id"] for r in dataset.prefix(df, 2).orderBy("row_no").collect()] == ["a", "b"] and dataset.prefix(df, None) is df


def test_status(spark):
    rows = [("e", False, 1, None, "x"), (None, True, 1, None, "x"), (None, False, 0, None, "x"), (None, False, 1, "bad", "x"), (None, False, 1, None, "x"), (None, False, 1, None, "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e string, c boolean, n int, x string, core string").orderBy("i")
    f = lambda **k: [r[0] for r in df.select(dataset.fetch_status(F.col("e"), F.col("c"), F.col("n"), F.col("x"), [F.col("core")], **k)).collect()]
    assert f() == ["error: e", "captcha", "no_image", "image_error: bad", "ok", "ok_partial"]
    assert f(skip_partials=True)[-1] == "ok_partial"


def test_stream_equals_batch(spark, tmp_path):
    from veritab.operators.attempts import merge_attempts

    sf = "/root/testdata/sf0.001"
    whole = E.apps(spark, sf).join(merge_attempts(E.attempts(spark, sf)), "label_id").select("label_id", "brand_name", "alcohol_content", "net_contents", "text")
    source, target, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for part in range(2):
        whole.filter(F.col("label_id") % 2 == part).repartition(3).write.mode("append").parquet(source)
        verify.start(verify.requests(spark, source, files_per_batch=2), target, state).awaitTermination()
    got = spark.read.parquet(target).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, verify.verify(whole).select(*got.columns).collect()))


def test_replace_swaps_a_table(spark, tmp_path):
    path = f"{tmp_path}/metadata"
    dataset.replace(spark.createDataFrame([("a", "1"), ("b", "2")], "id string, v string"), path)
    dataset.replace(files.records(spark, path).filter("id = 'b'"), path)  # reads the table that it replaces
    assert [tuple(r) for r in files.records(spark, path).collect()] == [("b", "2")]

    def fails(rows, where):
        raise OSError("disk")

    with pytest.raises(OSError, match="disk"):
        dataset.replace(files.records(spark, path).limit(0), path, fails)
    assert files.records(spark, path).count() == 1
