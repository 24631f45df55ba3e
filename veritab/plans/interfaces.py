"""Queries over sources, sinks, pages, pixels and what a client is shown, and their SQL twins.

A sink is checked by reading back what it has written; everything that is
written goes to the shared folder of the session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.functions import text as T
from veritab.operators import associate, attempts, dataset, evaluation, html, image
from veritab.operators.verify import evaluate, flat, missing_image
from veritab.plans import api, job
from veritab.plans import evidence as E
from veritab.plans import oracle as O
from veritab.sources import engines, files, uploads
from veritab.sources.tables import new_path
from veritab.streaming import verify as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _cte(name: str, statement: str) -> str:
    return f"{name} AS ({E.duckdb(statement)})"


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.apps(spark, sf_dir).join(attempts.merge_attempts(E.attempts(spark, sf_dir)), "label_id")


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attempts.prefix_plan(E.apps(spark, sf_dir), E.attempts(spark, sf_dir)).join(attempts.angle_map(E.attempts(spark, sf_dir)), "label_id")
    return found.withColumns({"image_path": F.lit(""), "error": F.lit(None).cast("string"), "engine": F.lit("recorded"), "total_ms": F.col("ocr_ms") + 1})


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    return files.records(spark, path)


# ---- detail pages

PAGES = _cte("dp", E.DETAIL_PAGES)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.derive(spark, sf_dir, E.DETAIL_PAGES, spread=True).select("page_id", "html")


@query(f"""WITH {PAGES}, l AS (
  SELECT page_id, html, unnest(['BRAND NAME', 'NET CONTENTS', 'ALCOHOL CONTENT', 'FANCIFUL NAME']) AS label, unnest([brand_shown, net_shown, alcohol_shown, fanciful_shown]) AS value FROM dp)
  SELECT page_id, label, value FROM l WHERE value <> '' AND html IS NOT NULL""")
def page_fields(spark, sf_dir):
    """Every label and value of the detail pages."""
    return html.page_fields(_pages(spark, sf_dir)).select("page_id", F.explode("fields").alias("label", "value"))


@query(f"""WITH {PAGES} SELECT page_id, CASE WHEN html IS NULL THEN '' ELSE brand_shown END AS brand_name_detail, CASE WHEN html IS NULL THEN '' ELSE fanciful_shown END AS fanciful_name_detail,
  CASE WHEN html IS NULL THEN '' ELSE {O._page_net('net_shown')} END AS net_contents, CASE WHEN html IS NULL THEN '' ELSE {O._page_alcohol('alcohol_shown')} END AS alcohol_content,
  CASE WHEN html IS NULL THEN 0 ELSE page_id % 3 END::INT AS image_count, html IS NOT NULL AND page_id % 13 = 0 AS captcha FROM dp""")
def page_details(spark, sf_dir):
    """The detail pages as rows of the record table."""
    pages = _pages(spark, sf_dir).withColumn("captcha", T.is_captcha(F.col("html")))
    return dataset.details_from_pages(html.page_fields(pages, carried=["captcha"]), captcha=F.col("captcha"))


# ---- texts

_CLEANUPS = "SELECT c_custkey AS id, CAST(c_custkey % 20 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE '' END || '.  ' || c_name || '  (Hint ' || CAST(c_custkey AS STRING) || ') ' || c_mktsegment AS label, ' \"''' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '''x' ELSE '' END || '\" ' AS quoted, c_name || CASE c_custkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '' ELSE '.tar.gz' END AS filename, CASE c_custkey % 4 WHEN 0 THEN '/x/y ' || CAST(c_custkey AS STRING) WHEN 1 THEN 'https://o/z' WHEN 2 THEN '//cdn/i j' ELSE 'p?q=1 2' END AS src, CASE c_custkey % 4 WHEN 0 THEN 'image/PNG; q=1' WHEN 1 THEN 'text/html' WHEN 2 THEN 'image/webp' ELSE NULL END AS content_type, CASE WHEN c_custkey % 3 = 0 THEN 'http://h/a.GIF?x=.b' ELSE 'http://h/a' END AS url, '<' || c_name || ' & \"x\">' AS raw FROM {customer}"
_CLEAN = r"""trim(upper(regexp_replace(trim(regexp_replace(trim(regexp_replace(label, '^\d+[a-z]?\.\s*', '')), '\s*\(.*?\)\s*', ' ', 'g')), '\s+', ' ', 'g')))"""


@query(f"""WITH {_cte('c', _CLEANUPS)} SELECT id, {_CLEAN} AS label, replace(replace(split_part(quoted, '"''', 2), '" ', ''), '''"', '') AS cleaned_id,
  CASE id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '.gz' END AS suffix,
  CASE id % 4 WHEN 0 THEN 'https://host/x/y%20' || id WHEN 1 THEN 'https://o/z' WHEN 2 THEN 'https://cdn/i%20j' ELSE 'https://host/p?q=1%202' END AS url,
  CASE WHEN id % 4 = 0 THEN '.png' WHEN id % 4 = 2 THEN '.webp' WHEN id % 3 = 0 THEN '.gif' ELSE '.jpg' END AS extension,
  replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM c""")
def text_cleanups(spark, sf_dir):
    """Labels, ids, suffixes, attachment URLs and extensions, and escaped texts."""
    c = F.col
    return E.derive(spark, sf_dir, _CLEANUPS).select(
        "id", T.clean_label(c("label")).alias("label"), T.clean_id(c("quoted")).alias("cleaned_id"), T.file_suffix(c("filename")).alias("suffix"),
        T.attachment_url("https://host", c("src")).alias("url"), T.attachment_extension(c("content_type"), c("url")).alias("extension"), T.escape_html(c("raw")).alias("escaped"),
    )


# ---- records


_LASTP = f"{O.PRIOR}, {O.LAST}"


@query(f"WITH {O.PRIOR} SELECT row_no, id, row_number() OVER (ORDER BY row_no) AS record_no, count(*) OVER () AS records FROM prior")
def numbered_records(spark, sf_dir):
    return dataset.numbered(E.derive(spark, sf_dir, E.PRIOR), "row_no").select("row_no", "id", "record_no", "records")


@query(f"WITH {O.PRIOR} SELECT id, row_no FROM prior WHERE row_no < 5000")
def record_prefix(spark, sf_dir):
    return dataset.prefix(E.derive(spark, sf_dir, E.PRIOR), 5000).select("id", "row_no")


@query(f"""WITH {O.PRIOR}, {O.RECORDS}, {O.DONE}, {O.LAST}, {O.PENDING}, r AS (SELECT p.id, p.row_no, l.id IS NOT NULL AND substr(p.id, 2)::BIGINT % 3 = 0 AS reused, l.brand_name_detail AS b, p.brand_name_detail AS own FROM pending p LEFT JOIN lastp l USING (id))
  SELECT id, row_no, reused, CASE WHEN reused THEN b ELSE own END AS brand_name_detail FROM r""")
def reused_records(spark, sf_dir):
    """Pending records: what is taken from the prior table because its image is there, and what is still to fetch."""
    prior, records = E.derive(spark, sf_dir, E.PRIOR), E.derive(spark, sf_dir, E.RECORDS)
    images = records.filter("CAST(substring(id, 2) AS BIGINT) % 3 = 0").select("id")
    reused, rest = dataset.reuse(dataset.pending(records, prior), prior, images)
    columns = ["id", "row_no", "reused", "brand_name_detail"]
    return reused.withColumn("reused", F.lit(True)).select(*columns).unionByName(rest.withColumn("reused", F.lit(False)).select(*columns))


@query(f"WITH {O.FETCHED} SELECT count(*) FILTER (WHERE error <> '') AS image_errors FROM fetched")
def image_error_count(spark, sf_dir):
    return evaluation.image_errors(E.derive(spark, sf_dir, E.FETCHED))


_ROUND = "SELECT o_orderkey AS row_no, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' two  blanks ' WHEN 2 THEN 'a \"quoted\" one' WHEN 3 THEN 'line' || chr(10) || 'break, comma' ELSE 'back\\\\slash' END AS note, CASE o_orderkey % 3 WHEN 0 THEN 'NA' WHEN 1 THEN 'nan' ELSE 'é ' END AS mark, ' ''' || CAST(o_custkey AS STRING) || '\" ' AS tag FROM {orders}"


@query(f"WITH {_cte('r', _ROUND.replace(chr(92) * 2, chr(92)))} SELECT row_no::VARCHAR AS row_no, coalesce(note, '') AS note, CASE WHEN row_no % 3 = 2 THEN mark ELSE '' END AS mark, tag FROM r")
def csv_round_trip(spark, sf_dir):
    """Records written as CSV and read as the evaluator reads them."""
    path = new_path(spark, "csv")
    files.write_records(E.derive(spark, sf_dir, _ROUND), path)
    return files.records(spark, path, files.MISSING)


@query(f"WITH {_cte('r', _ROUND.replace(chr(92) * 2, chr(92)))} SELECT row_no::VARCHAR AS row_no, replace(replace(trim(tag), '''', ''), '\"', '') AS tag FROM r")
def export_round_trip(spark, sf_dir):
    """Ids of an export, without blanks and quotes."""
    path = new_path(spark, "csv")
    files.write_records(E.derive(spark, sf_dir, _ROUND).select("row_no", "tag"), path)
    return files.export(spark, path, "tag")


@query(O.ORACLES["merged_metadata"].replace("SELECT id, row_no, NULL AS name, brand_name_detail, NULL AS fanciful_name_detail FROM kept", "SELECT id, row_no::VARCHAR AS row_no, '' AS name, brand_name_detail, '' AS fanciful_name_detail FROM kept").replace(
    "SELECT p.id, p.row_no, p.name,", "SELECT p.id, p.row_no::VARCHAR, p.name,").replace("f.fanciful_name_detail FROM", "coalesce(f.fanciful_name_detail, '') FROM"))
def metadata_replaced(spark, sf_dir):
    """A resumed run: the prior table read from a file, merged, and swapped in for itself."""
    path = new_path(spark, "metadata")
    dataset.replace(E.derive(spark, sf_dir, E.PRIOR), path)
    prior = files.records(spark, path).withColumn("row_no", F.col("row_no").cast("bigint"))
    fetched = E.derive(spark, sf_dir, E.FETCHED).select("id", "brand_name_detail", "fanciful_name_detail")
    dataset.replace(dataset.merge_metadata(E.derive(spark, sf_dir, E.RECORDS), prior, fetched), path)
    return files.records(spark, path).select("id", "row_no", "name", "brand_name_detail", "fanciful_name_detail")


# ---- files and uploads

_IMAGE_ROWS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN './images/raw/' || CAST(c_custkey AS STRING) || '.jpg' WHEN 1 THEN 'images//' || CAST(c_custkey AS STRING) || '.jpg' WHEN 2 THEN '' ELSE NULL END AS image_path FROM {customer}"
_IMAGE_FILES = "SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN 'file:///data/images/raw/' WHEN 1 THEN 'file:/data/images/' ELSE 'file:/other/images/raw/' END || CAST(o_custkey AS STRING) || '.jpg' AS path FROM {orders}"


@query(f"""WITH {_cte('r', _IMAGE_ROWS)}, {_cte('f', _IMAGE_FILES)} SELECT id, coalesce((id % 4 = 0 AND 'file:///data/images/raw/' || id || '.jpg' IN (SELECT path FROM f)) OR (id % 4 = 1 AND 'file:/data/images/' || id || '.jpg' IN (SELECT path FROM f)), false) AS image_exists FROM r""")
def existing_images(spark, sf_dir):
    """Which records' images are below the root, by their whole relative paths."""
    return files.with_existence(E.derive(spark, sf_dir, _IMAGE_ROWS), E.derive(spark, sf_dir, _IMAGE_FILES), "/data").select("id", "image_exists")


_FORMS = "SELECT c_custkey AS request_id, ' ' || c_name || ' ' AS brand_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '12.5' END AS alcohol_content, '750 ml ' AS net_contents, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE NULL END AS gov_warning_expected, CASE WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'yes' END AS debug, CASE c_custkey % 3 WHEN 0 THEN 'paddleocr' WHEN 1 THEN 'other' ELSE NULL END AS engine FROM {customer}"
_UPLOADS = "SELECT o_custkey AS request_id, o_orderkey AS file_no, 'f' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '.png' ELSE '' END AS filename, CASE o_orderkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' ELSE NULL END AS content_type FROM {orders}"


@query(f"""WITH {_cte('f', _FORMS)}, {_cte('u', _UPLOADS)} SELECT request_id, file_no, filename, CASE WHEN file_no % 2 = 0 THEN '.png' ELSE '.jpg' END AS suffix, trim(brand_name) AS brand_name, coalesce(alcohol_content, '') AS alcohol_content, '750 ml' AS net_contents,
  gov_warning_expected IS NOT NULL AS gov_warning_expected, debug = 'true' AS debug, CASE WHEN engine = 'paddleocr' THEN engine ELSE 'tesseract' END AS engine FROM u JOIN f USING (request_id) WHERE content_type IN ('image/jpeg', 'image/png', 'image/webp')""")
def upload_requests(spark, sf_dir):
    """Accepted uploads with their forms' values."""
    return uploads.requests(E.derive(spark, sf_dir, _FORMS), E.derive(spark, sf_dir, _UPLOADS)).drop("content_type")


@query(f"""WITH {_cte('f', _FORMS)} SELECT request_id, trim(brand_name) AS brand_name, coalesce(alcohol_content, '') AS alcohol_content, '750 ml' AS net_contents,
  gov_warning_expected IS NOT NULL AS gov_warning_expected, debug = 'true' AS debug, CASE WHEN engine = 'paddleocr' THEN engine ELSE 'tesseract' END AS engine FROM f""")
def json_requests(spark, sf_dir):
    """Requests as JSON documents, read with their schema."""
    documents = E.derive(spark, sf_dir, _FORMS).select(F.to_json(F.struct("*")).alias("value"))
    return uploads.forms(uploads.parsed(documents))


_ENTRIES = "SELECT c_custkey AS id, 'f' || CAST(c_custkey % 200 AS STRING) AS filename FROM {customer}"
_FILES = "SELECT 'f' || CAST(o_custkey % 150 AS STRING) AS filename, o_orderkey AS file_no, o_orderkey * 7 AS bytes FROM {orders}"


@query(f"WITH {_cte('e', _ENTRIES)}, {_cte('f', _FILES)}, g AS (SELECT filename, min(file_no) AS file_no, min_by(bytes, file_no) AS bytes FROM f GROUP BY filename) SELECT id, filename, file_no, bytes FROM e LEFT JOIN g USING (filename)")
def first_file_of_name(spark, sf_dir):
    """Each entry with the first uploaded file of its name."""
    return associate.with_files(E.derive(spark, sf_dir, _ENTRIES), E.derive(spark, sf_dir, _FILES)).select("id", "filename", "file.file_no", "file.bytes")


# ---- attempts and engines

_SPECS = ", ".join(f"('{e}', {n}, '{region}', {angle}, '{mode}', {psm})" for e in C.ENGINES for n, region, angle, mode, psm in [C.FIRST_ATTEMPT, *C.FALLBACKS[e]])


@query(f"""WITH {O.ATTEMPTS}, p AS (SELECT label_id, attempt_no AS recorded_no, region, angle, preprocess_mode, CASE WHEN label_id % 2 = 0 AND attempt_no IN (1, 6) THEN 11 ELSE psm END AS psm FROM attempts)
  SELECT label_id, engine, attempt_no, recorded_no FROM p JOIN (VALUES {_SPECS}) AS s(engine, attempt_no, region, angle, preprocess_mode, psm) USING (region, angle, preprocess_mode, psm)""")
def attempts_by_engine(spark, sf_dir):
    """Recorded attempts that are an engine's own, by region, angle, preprocessing and page mode."""
    tries = E.attempts(spark, sf_dir).withColumn("recorded_no", F.col("attempt_no")).withColumn("psm", F.when((F.col("label_id") % 2 == 0) & F.col("attempt_no").isin(1, 6), 11).otherwise(F.col("psm")))
    of = [job.own_attempts(tries, e).select("label_id", F.lit(e).alias("engine"), "attempt_no", "recorded_no") for e in C.ENGINES]
    return of[0].unionByName(of[1])


@query(O.ORACLES["fallback_prefix_choice"])
def wave_plan_choice(spark, sf_dir):
    """The choice of fallback_prefix_choice, by waves of attempts over what is still pending."""
    chosen = attempts.wave_plan(E.apps(spark, sf_dir), C.ENGINES[0], engines.recorded(E.attempts(spark, sf_dir))).withColumn("digest", F.md5("normalized_text"))
    return flat(chosen, ["label_id", "attempt_no", "ocr_ms", "digest"])


@query(O.ORACLES["evaluate_labels"])
def stream_verified(spark, sf_dir):
    """evaluate_labels by a stream of request files."""
    source, target, state = (new_path(spark, f"stream-{n}") for n in ("in", "out", "state"))
    _whole(spark, sf_dir).select("label_id", "brand_name", "alcohol_content", "net_contents", "text").write.parquet(source)
    stream.start(stream.requests(spark, source), target, state).awaitTermination()
    return spark.read.parquet(target).drop("batch")


@query(f"WITH {O.APPS} SELECT label_id, {', '.join(f'''{chr(39)}missing{chr(39)} AS {n}_status, 0.0::DOUBLE AS {n}_confidence''' for n in C.FIELDS)}, 'missing' AS government_warning_status, 'image_not_found' AS warnings FROM apps")
def missing_image_rows(spark, sf_dir):
    """What applications without a readable image give in batch evaluation."""
    rows = flat(missing_image(E.apps(spark, sf_dir), 0.0), ["label_id"])
    return rows.select("label_id", *[f"{n}_{k}" for n in C.FIELDS for k in ("status", "confidence")], "government_warning_status", "warnings")


# ---- answers, reports and what a client is shown

_OVERALL = "[brand_name_confidence, alcohol_content_confidence, net_contents_confidence, government_warning_confidence]"
_KNOWN = f"list_filter({_OVERALL}, lambda x: x IS NOT NULL)"
_SHOWN = ", ".join(f"{O.STATUS.format(s=n + '_status')} AS {n}" for n in (*C.FIELDS, "government_warning"))


@query(f"""{O.WHOLE} SELECT label_id, round_even(list_sum({_KNOWN}) / len({_KNOWN}), 3) AS overall_confidence, {_SHOWN.replace('AS government_warning', 'AS gov_warning')}, warnings,
  CASE WHEN label_id % 2 = 0 THEN t END AS normalized_text FROM ev""")
def service_answers(spark, sf_dir):
    """The service's entries: overall confidence, summary, warnings, and the debug part where asked."""
    entries = api.evaluate_texts(_whole(spark, sf_dir), debug=F.col("label_id") % 2 == 0)
    return entries.select("label_id", "entry.overall_confidence", "entry.summary.*", F.array_join("entry.warnings", "; ").alias("warnings"), "entry.debug.normalized_text")


@query(f"""{O.WHOLE} SELECT label_id, brand_name AS brand_expected, {O.STATUS.format(s='net_contents_status')} AS net_status, coalesce(alcohol_content_confidence, 0.0)::DOUBLE AS alcohol_confidence, warnings FROM ev""")
def answer_json_round_trip(spark, sf_dir):
    """Entries as JSON, read back."""
    read = associate.answers_json(api.evaluate_texts(_whole(spark, sf_dir))).select("label_id", F.from_json("json", "fields struct<brand_name:struct<expected:string>,alcohol_content:struct<confidence:double>,net_contents:struct<match_status:string>>, warnings array<string>").alias("e"))
    return read.select("label_id", F.col("e.fields.brand_name.expected").alias("brand_expected"), F.col("e.fields.net_contents.match_status").alias("net_status"), F.col("e.fields.alcohol_content.confidence").alias("alcohol_confidence"), F.array_join("e.warnings", "; ").alias("warnings"))


@query(f"""{O.WHOLE} SELECT label_id, CASE WHEN brand_name_status = 'found' AND alcohol_content_status = 'found' AND net_contents_status = 'found' AND government_warning_status = 'found' THEN 'match' ELSE 'partial' END AS card,
  CASE WHEN government_warning_status = 'found' THEN 'Yes' ELSE 'No' END AS warning_shown, coalesce(brand_name, '—') AS brand_shown,
  floor(government_warning_confidence * 100 + 0.5)::BIGINT || '%' AS percent, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS preview FROM ev""")
def display_cards(spark, sf_dir):
    """What the client shows of each answer."""
    rows, warning = evaluate(_whole(spark, sf_dir)), F.col("government_warning")
    statuses = F.array(*[associate.match_status(F.col(f"{n}_verdict.status")) for n in C.FIELDS], associate.match_status(warning["status"]))
    return rows.select(
        "label_id", associate.card_class(statuses).alias("card"), associate.shown_value(warning["status"] == "found").alias("warning_shown"), associate.shown_value(F.col("brand_name")).alias("brand_shown"),
        associate.shown_percent(warning["confidence"]).alias("percent"), associate.preview(F.col("normalized_text")).alias("preview"),
    )


@query(f"""WITH {O.ATTEMPTS}, {O.LINES}, {O.BOXES} SELECT label_id, attempt_no, line_no::INT AS line_no, x0 / 400 * 100 AS "left", y0 / 300 * 100 AS top, (x1 - x0) / 400 * 100 AS width, (y1 - y0) / 300 * 100 AS height FROM boxes""")
def box_geometry(spark, sf_dir):
    """Boxes in percent of their image."""
    from veritab.operators import words

    lines = words.lines(attempts.primary(E.words(spark, sf_dir)), ["label_id", "attempt_no"])
    return lines.select("label_id", "attempt_no", "line_no", associate.box_percent(F.col("bbox"), F.lit(400), F.lit(300)).alias("g")).select("label_id", "attempt_no", "line_no", "g.*")


def _group_json(name: str, words: list[str]) -> str:
    hits = "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(t, w))"
    return f"""'"{name}":{{"hits":[' || array_to_string(list_transform({hits}, lambda w: '"' || w || '"'), ',') || '],"score":' || round_even(len({hits}) / {len(words)}::DOUBLE, 3)::VARCHAR || '}}'"""


_GROUPS = "'{' || " + " || ',' || ".join(_group_json(n, w) for n, w in C.WARNING_GROUPS) + " || '}'"
_TEXT = ", ".join(
    f"{n}_status, coalesce({n}_confidence::VARCHAR, '') AS {n}_confidence, coalesce({x}, '') AS {n}_expected, coalesce({n}_found, '') AS {n}_found"
    for n, x in (("brand_name", "CASE WHEN brand_name IS NOT NULL THEN bw END"), ("alcohol_content", "CASE WHEN aw IS NOT NULL THEN alcohol_content_expected END"), ("net_contents", "net_contents_expected"))
)


@query(f"""{O.CHOSEN}, a AS (SELECT label_id, {", ".join(f"coalesce(min_by(text, attempt_no) FILTER (WHERE region = 'full' AND angle = {x}), '') AS ocr_angle_{x}" for x in (0, 90, 270))} FROM attempts GROUP BY label_id)
  SELECT label_id::VARCHAR AS ttb_id, '' AS image_path, variant_type, '' AS error, 'recorded' AS ocr_engine, ocr_ms::VARCHAR AS ocr_time_ms, (ocr_ms + 1)::VARCHAR AS total_time_ms, text AS ocr_text, t AS normalized_ocr_text, ocr_angle_0, ocr_angle_90, ocr_angle_270,
  {_TEXT}, government_warning_status, government_warning_confidence::VARCHAR AS government_warning_confidence, government_warning_matched_anchors, CASE WHEN t = '' THEN '{{}}' ELSE {_GROUPS} END AS government_warning_matched_groups, warnings FROM ch JOIN a USING (label_id)""")
def detail_csv_round_trip(spark, sf_dir):
    """All 29 columns of the detail file, written and read back."""
    path = new_path(spark, "detail")
    evaluation.write_detail(_chosen(spark, sf_dir), path)
    return _read_csv(spark, path)


@query(f"{O.CHOSEN} SELECT label_id, attempt_no, brand_name_status, net_contents_found, government_warning_matched_anchors AS anchors, warnings FROM ch")
def records_json_round_trip(spark, sf_dir):
    """Whole nested records as JSON lines, read back."""
    path = new_path(spark, "records")
    evaluation.write_records(_chosen(spark, sf_dir), path)
    read = spark.read.schema(
        "label_id bigint, attempt_no int, brand_name_verdict struct<status:string>, net_contents_verdict struct<raw_value:string>, government_warning struct<matched_anchors:array<string>>, warnings array<string>"
    ).json(path)
    return read.select("label_id", "attempt_no", F.col("brand_name_verdict.status").alias("brand_name_status"), F.col("net_contents_verdict.raw_value").alias("net_contents_found"), F.array_join("government_warning.matched_anchors", "; ").alias("anchors"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"""{O.CHOSEN}, {O.LONG.replace('FROM ev', 'FROM ch')}, s AS (SELECT field, {O.COUNTS.format(s='status')} FROM long GROUP BY field), w AS (SELECT {O.COUNTS.format(s='government_warning_status')} FROM ch)
  SELECT 'recorded' AS engine, s.field, s.total, s.found, s.missing, s.accuracy, w.found AS warnings_found, w.partial_rate AS warning_partial_rate, (SELECT count(*) FROM ch) AS total_records, 0::BIGINT AS image_errors FROM s, w""")
def summary_document(spark, sf_dir):
    """The summary as one JSON document, read back."""
    from veritab.sources.tables import written

    rows, path = written(_chosen(spark, sf_dir), "results"), new_path(spark, "summary")
    evaluation.write_summary(evaluation.summary(rows, rows, "recorded"), path)
    read = spark.read.json(path)
    g, t = F.col("government_warning_stats")[0], F.col("timing_stats")[0]
    return read.select("engine", F.explode("field_stats").alias("f"), g["found"].alias("warnings_found"), g["partial_rate"].alias("warning_partial_rate"), t["total_records"].alias("total_records"), "image_errors").select(
        "engine", "f.field", "f.total", "f.found", "f.missing", "f.accuracy", "warnings_found", "warning_partial_rate", "total_records", "image_errors"
    )


# ---- pixels

_PICTURES = "SELECT s_suppkey AS image_id, s_nationkey AS nation, 9 + CAST(s_suppkey % 3 AS INT) AS height, 12 + CAST(s_suppkey % 4 AS INT) AS width FROM {supplier}"
_PIXEL = "(7 * x + 13 * y + 29 * c + image_id) % 256"
_PIXELS = "px AS (SELECT image_id, nation, height, width, y, x, c, (7 * x + 13 * y + 29 * c + image_id) % 256 AS v FROM p, range(0, 11) AS a(y), range(0, 15) AS b(x), range(0, 3) AS d(c) WHERE y < height AND x < width)"
_MD5 = "md5(unhex(string_agg(printf('%02x', v), '' ORDER BY y, x, c))) AS digest"


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.derive(spark, sf_dir, _PICTURES)
    hexed = "array_join(transform(sequence(0, height * width * 3 - 1), k -> lpad(lower(hex((7 * ((k div 3) % width) + 13 * (k div 3 div width) + 29 * (k % 3) + image_id) % 256)), 2, '0')), '')"
    return rows.withColumns({"nChannels": F.lit(3), "data": F.expr(f"unhex({hexed})")})


@query(f"WITH {_cte('p', _PICTURES)}, {_PIXELS} SELECT image_id::VARCHAR AS name, any_value(height) AS height, any_value(width) AS width, {_MD5} FROM px GROUP BY image_id")
def image_files_round_trip(spark, sf_dir):
    """Pictures written as files, and decoded by the image source."""
    folder = new_path(spark, "pictures")
    image.write_pngs(_pictures(spark, sf_dir).withColumn("name", F.col("image_id").cast("string")), folder).write.format("noop").mode("overwrite").save()
    return files.images(spark, folder).select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name"), "height", "width", F.md5("data").alias("digest"))


@query(f"WITH {_cte('p', _PICTURES)} SELECT image_id || '.png' AS name, row_number() OVER (ORDER BY image_id || '.png') AS place FROM p")
def image_listing(spark, sf_dir):
    """The files of a folder in the order of their paths."""
    folder = new_path(spark, "pictures")
    image.write_pngs(_pictures(spark, sf_dir).withColumn("name", F.col("image_id").cast("string")), folder).write.format("noop").mode("overwrite").save()
    listed = dataset.numbered(files.listing(spark, folder), "path")
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("record_no").alias("place"))


_CUTS = [(0, "full", 0), (1, "full", 90), (2, "full", 180), (3, "full", 270), (4, "right_strip", 90), (5, "right_strip", 270), (6, "bottom_strip", 0)]


@query(f"""WITH {_cte('p', _PICTURES)}, {_PIXELS}, cut AS (
    SELECT image_id, attempt_no, angle, c, v, y - y0 AS y, x - x0 AS x, height - y0 AS h, width - x0 AS w
    FROM (SELECT px.*, attempt_no, angle, CASE WHEN region = 'right_strip' THEN floor(width * (1.0::DOUBLE - 0.28::DOUBLE))::INT ELSE 0 END AS x0, CASE WHEN region = 'bottom_strip' THEN floor(height * (1.0::DOUBLE - 0.28::DOUBLE))::INT ELSE 0 END AS y0
      FROM px, (VALUES {', '.join(map(str, _CUTS))}) AS s(attempt_no, region, angle)) WHERE x >= x0 AND y >= y0),
  turned AS (SELECT image_id, attempt_no, c, v, CASE angle WHEN 0 THEN y WHEN 90 THEN x WHEN 180 THEN h - 1 - y ELSE w - 1 - x END AS y, CASE angle WHEN 0 THEN x WHEN 90 THEN h - 1 - y WHEN 180 THEN w - 1 - x ELSE y END AS x,
    CASE WHEN angle IN (0, 180) THEN h ELSE w END AS height, CASE WHEN angle IN (0, 180) THEN w ELSE h END AS width FROM cut)
  SELECT image_id, attempt_no, any_value(height)::INT AS height, any_value(width)::INT AS width, {_MD5} FROM turned GROUP BY image_id, attempt_no""")
def image_cuts(spark, sf_dir):
    """Regions of every picture, turned."""
    spec = spark.createDataFrame(_CUTS, "attempt_no int, region string, angle int")
    return image.transform(_pictures(spark, sf_dir), spec).select("image_id", "attempt_no", "height", "width", F.md5("data").alias("digest"))


@query(f"""WITH {_cte('p', _PICTURES)}, {_PIXELS}, o AS (SELECT *, sum(height) OVER (PARTITION BY nation ORDER BY image_id) - height AS y0, max(width) OVER (PARTITION BY nation) AS whole FROM p),
  f AS (SELECT o.nation, o.y0 + y AS y, x, c, CASE WHEN x < width THEN (7 * x + 13 * y + 29 * c + image_id) % 256 ELSE 255 END AS v FROM o, range(0, 11) AS a(y), range(0, 15) AS b(x), range(0, 3) AS d(c) WHERE y < height AND x < whole)
  SELECT nation, (SELECT count(*) FROM p WHERE p.nation = f.nation)::INT AS image_count, (max(y) + 1)::INT AS height, (max(x) + 1)::INT AS width, {_MD5} FROM f GROUP BY nation""")
def image_composites(spark, sf_dir):
    """Pictures of each nation stacked on white."""
    return image.stacked(_pictures(spark, sf_dir), "nation", "image_id").select("nation", "image_count", "height", "width", F.md5("data").alias("digest"))
