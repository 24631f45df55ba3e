import base64
import gzip
import hashlib
import io

import pytest

from veritab.llm import shared, warc

SCHEMA = "page_id bigint, url string, html string, sha1 string, bytes int"


def pages(spark, rows, parts=3):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA).repartition(parts)


ROWS = [(1, "http://a", "same"), (7, "http://b", "same"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "é\r\n\r\nWARC/1.1" * 3), (6, "u", "long " * 400_000), (None, "n", "same")]


@pytest.mark.parametrize("range_bytes", [64, 1000, 8 << 20])
def test_round_trip(spark, range_bytes):
    manifest = warc.write_warc(pages(spark, ROWS), shared.new_path(spark, "warc"))
    assert sum(r["records"] for r in manifest.collect()) == len(ROWS)
    got = {r["page_id"]: r for r in warc.read_warc(manifest, range_bytes).collect()}
    assert len(got) == len(ROWS)
    for i, url, html in ROWS:
        raw, r = (html or "").encode(), got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        original = {"same": 7, "": 4}.get(html or "")
        revisit = i is not None and original not in (None, i)
        assert (r["record_type"], r["refers_to"]) == (("revisit", original) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == raw
    assert got[4]["url"] == "http://c%0D%0AX: y"


def test_smaller_payloads_are_responses(spark):
    manifest = warc.write_warc(pages(spark, ROWS), shared.new_path(spark, "warc"), revisit_from=5)
    assert {r["record_type"] for r in warc.read_warc(manifest).collect()} == {"response"}


def test_members_are_plain_gzip_and_damage_is_skipped(spark):
    data = b"".join(warc.record(i, "u", f"page {i}".encode() * 50, None, 6) for i in range(20))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 20
    whole = [(o, h["warc-record-id"]) for o, h, _ in warc.records_in_range(io.BytesIO(data), 0, len(data))]
    assert len(whole) == 20
    for cut in range(1, len(data), 97):
        parts = [x for a, b in ((0, cut), (cut, len(data))) for x in warc.records_in_range(io.BytesIO(data), a, b)]
        assert [(o, h["warc-record-id"]) for o, h, _ in parts] == whole
    broken = bytearray(data)
    at = whole[5][0]
    broken[at + 30 : at + 40] = b"\x1f\x8b\x08" + b"\xff" * 7
    left = [h["warc-record-id"] for _, h, _ in warc.records_in_range(io.BytesIO(bytes(broken)), 0, len(data))]
    assert [r for _, r in whole if r not in left] == [whole[5][1]]


def test_empty(spark):
    manifest = warc.write_warc(pages(spark, []), shared.new_path(spark, "warc"))
    assert warc.read_warc(manifest).count() == 0


def test_long_header_and_counts(spark):
    url = "data:," + base64.b64encode(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(3000))).decode()  # compresses badly
    data = warc.record(1, url, b"a", None, 1)
    assert [h["warc-target-uri"] for _, h, _ in warc.records_in_range(io.BytesIO(data), 0, len(data))] == [url]
    manifest = warc.write_warc(pages(spark, [(1, url, "a"), (2, "u", "b")], 1).coalesce(1), shared.new_path(spark, "warc"))
    records = warc.read_warc(manifest)
    assert {r["page_id"]: r["url"] for r in records.collect()} == {1: url, 2: "u"}
    warc.require_whole(records, manifest)
    with pytest.raises(ValueError, match="records read"):
        warc.require_whole(records.filter("page_id = 1"), manifest)


def test_rows_that_repeat_a_page_id(spark):
    rows = [(5, "u", "a"), (5, "v", "a"), (5, "u", "b"), (3, "u", "a"), (3, "u", "a")]
    got = warc.read_warc(warc.write_warc(pages(spark, rows), shared.new_path(spark, "warc"))).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, r["payload_digest"] == warc.base32_sha1(b"a")) for r in got) == [
        (3, "revisit", 5, True), (3, "revisit", 5, True), (5, "response", 0, False), (5, "response", 0, True), (5, "response", 0, True),
    ]
