"""DuckDB SQL for the catalogue's queries, written apart from the operators."""

from __future__ import annotations

from veritab.functions import constants as C
from veritab.plans import evidence as E


def norm(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for found, instead in C.REPLACEMENTS:
        out = f"replace({out}, '{found}', '{instead}')"
    return f"trim(regexp_replace(regexp_replace({out}, '{C.DROPPED}', ' ', 'g'), '\\s+', ' ', 'g'))"


def number(x: str) -> str:
    d = f"TRY_CAST({x} AS DOUBLE)"
    return f"CASE WHEN {d} = floor({d}) THEN CAST(CAST({d} AS DECIMAL(38,0)) AS VARCHAR) ELSE CAST({d} AS VARCHAR) END"


def quantity(q: str, u: str) -> str:
    n = norm(u)
    return (
        f"({number(q)}) || CASE WHEN contains({n}, 'millil') OR {n} = 'ml' THEN 'ml' WHEN contains({n}, 'liter') OR {n} = 'l' THEN 'l' "
        f"WHEN {n} = 'cl' THEN 'cl' ELSE 'oz' END"
    )


def expected_net(x: str) -> str:
    n = norm(x)
    q, u = f"regexp_extract({n}, '{C.NET_EXPECTED}', 1)", f"regexp_extract({n}, '{C.NET_EXPECTED}', 2)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {q} = '' THEN {n} ELSE {quantity(q, u)} END"


def overlap(a: str, b: str) -> str:
    x, y = norm(a), norm(b)
    left = f"list_distinct(string_split({x}, ' '))"
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0.0::DOUBLE ELSE len(list_intersect({left}, string_split({y}, ' ')))::DOUBLE / len({left}) END"


def evaluated(source: str) -> str:
    """CTEs that end in `ev`: the source's rows with columns of every verdict. source has t, the normalized text."""
    groups = " + ".join("(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")::INT" for _, words in C.WARNING_GROUPS)
    anchors = ", ".join(f"'{w}'" for _, words in C.WARNING_GROUPS for w in words)
    alcohol, net = C.ALCOHOL_IN_TEXT, C.NET_IN_TEXT
    codes = ", ".join(f"CASE {n}_status WHEN 'missing' THEN '{n}_missing' WHEN 'partial' THEN '{n}_partial_match' END" for n in C.FIELDS)
    return f"""
x1 AS (SELECT *, {norm('brand_name')} AS bw, TRY_CAST(NULLIF(regexp_extract(alcohol_content, '{C.NUMBER}', 1), '') AS DOUBLE) AS aw, {expected_net('net_contents')} AS nw,
  regexp_extract_all(t, '{alcohol}', 0) AS ar, list_transform(regexp_extract_all(t, '{alcohol}', 1), lambda x: CAST(x AS DOUBLE)) AS an,
  regexp_extract_all(t, '{net}', 0) AS nr, regexp_extract_all(t, '{net}', 1) AS nq, regexp_extract_all(t, '{net}', 2) AS nu FROM {source}),
x2 AS (SELECT *, coalesce(list_position(list_transform(an, lambda x: abs(x - aw) < 0.01), true), 0) AS ai,
  list_transform(range(1, len(nr) + 1), lambda i: {quantity('nq[i]', 'nu[i]')}) AS nf, {overlap('bw', 't')} AS bo, {groups} AS gh FROM x1),
x3 AS (SELECT *, coalesce(list_position(nf, nw), 0) AS ni,
  CASE WHEN bw <> '' AND NOT contains(bw, ' ') AND length(bw) < 5 THEN regexp_matches(t, '\\b\\Q' || bw || '\\E\\b') ELSE contains(t, bw) END AS bf FROM x2),
x4 AS (SELECT *,
  CASE WHEN brand_name IS NULL THEN 'missing' WHEN bf THEN 'found' WHEN bo >= 0.8 THEN 'partial' ELSE 'missing' END AS brand_name_status,
  CASE WHEN brand_name IS NULL THEN NULL WHEN bf THEN 0.99 WHEN bo >= 0.8 THEN round_even(bo, 3) ELSE 0.0 END::DOUBLE AS brand_name_confidence,
  brand_name AS brand_name_expected, CASE WHEN bf OR bo >= 0.8 THEN brand_name END AS brand_name_found,
  CASE WHEN ai > 0 THEN 'found' ELSE 'missing' END AS alcohol_content_status,
  CASE WHEN alcohol_content IS NULL THEN NULL WHEN ai > 0 THEN 0.99 ELSE 0.0 END::DOUBLE AS alcohol_content_confidence,
  CASE WHEN alcohol_content IS NULL THEN NULL WHEN aw IS NULL THEN alcohol_content WHEN ai > 0 THEN CAST(an[ai] AS VARCHAR) WHEN len(an) > 0 THEN CAST(an[1] AS VARCHAR) ELSE CAST(aw AS VARCHAR) END AS alcohol_content_expected,
  CASE WHEN aw IS NULL THEN NULL WHEN ai > 0 THEN ar[ai] ELSE ar[1] END AS alcohol_content_found,
  CASE WHEN ni > 0 THEN 'found' ELSE 'missing' END AS net_contents_status,
  CASE WHEN net_contents IS NULL THEN NULL WHEN ni > 0 THEN 0.99 ELSE 0.0 END::DOUBLE AS net_contents_confidence,
  CASE WHEN net_contents IS NULL THEN NULL WHEN ni > 0 THEN nf[ni] WHEN len(nf) > 0 THEN nf[1] ELSE nw END AS net_contents_expected,
  CASE WHEN net_contents IS NULL THEN NULL WHEN ni > 0 THEN nr[ni] ELSE nr[1] END AS net_contents_found,
  CASE WHEN gh >= 3 THEN 'found' WHEN gh >= 2 THEN 'partial' ELSE 'missing' END AS government_warning_status,
  round_even(gh / 5.0::DOUBLE, 3) AS government_warning_confidence,
  array_to_string(list_filter([{anchors}], lambda w: contains(t, w)), '; ') AS government_warning_matched_anchors FROM x3),
ev AS (SELECT *,
  array_to_string(list_filter([{codes}, CASE government_warning_status WHEN 'missing' THEN 'government_warning_missing' WHEN 'partial' THEN 'government_warning_partial' END], lambda w: w IS NOT NULL), '; ') AS warnings,
  brand_name_status <> 'found' OR alcohol_content_status <> 'found' OR net_contents_status <> 'found' OR government_warning_status = 'missing' AS needs_fallback FROM x4)"""


APPS = f"apps AS ({E.duckdb(E.APPS)})"
ATTEMPTS = f"attempts AS ({E.duckdb(E.ATTEMPTS)})"
WORDS = f"words AS ({E.WORDS_SQL})"
BLANK = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
MERGED = f"""merged AS (SELECT label_id, {BLANK.format("coalesce(string_agg(text, ' ' ORDER BY attempt_no) FILTER (WHERE trim(text) <> ''), '')")} AS text, count(*) AS attempts FROM attempts GROUP BY label_id)"""
WHOLE = f"WITH {APPS}, {ATTEMPTS}, {MERGED}, src AS (SELECT apps.*, {norm('text')} AS t, text FROM apps JOIN merged USING (label_id)), {evaluated('src')}"
PREFIXES = f"""prefixes AS (SELECT label_id, attempt_no, {BLANK.format("coalesce(string_agg(text, ' ') FILTER (WHERE trim(text) <> '') OVER (PARTITION BY label_id ORDER BY attempt_no), '')")} AS text,
  sum(elapsed_ms) OVER (PARTITION BY label_id ORDER BY attempt_no) AS ocr_ms FROM attempts)"""
CHOSEN = f"""WITH {APPS}, {ATTEMPTS}, {PREFIXES}, src AS (SELECT apps.*, attempt_no, ocr_ms, text, {norm('text')} AS t FROM prefixes JOIN apps USING (label_id)), {evaluated('src')},
ch AS (SELECT * FROM (SELECT *, coalesce(min(attempt_no) FILTER (WHERE NOT needs_fallback) OVER (PARTITION BY label_id), max(attempt_no) OVER (PARTITION BY label_id)) AS stop FROM ev) WHERE attempt_no = stop)"""
VERDICTS = ", ".join(f"{n}_{c}" for n in C.FIELDS for c in ("status", "confidence", "expected", "found")) + ", government_warning_status, government_warning_confidence, government_warning_matched_anchors, warnings"
LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT label_id, variant_type, '{n}' AS field, {n}_status AS status, {n}_confidence AS confidence, {n}_found AS raw FROM ev" for n in C.FIELDS) + ")"
COUNTS = """count(*) AS total, count(*) FILTER (WHERE {s} = 'found') AS found, count(*) FILTER (WHERE {s} = 'partial') AS "partial", count(*) FILTER (WHERE {s} = 'missing') AS missing,
  round_even(count(*) FILTER (WHERE {s} = 'found') / count(*), 4) AS accuracy, round_even(count(*) FILTER (WHERE {s} = 'partial') / count(*), 4) AS partial_rate"""
LINES = f"""{WORDS}, lines AS (SELECT label_id, attempt_no, line_num, string_agg(trim(text), ' ' ORDER BY word_no) AS text, min("left")::INT AS x0, min(top)::INT AS y0, max("left" + width)::INT AS x1, max(top + height)::INT AS y1,
  round_even(avg(conf) / 100.0::DOUBLE, 3) AS confidence, row_number() OVER (PARTITION BY label_id, attempt_no ORDER BY min(word_no)) - 1 AS line_no
  FROM words WHERE conf >= 30 AND trim(text) <> '' GROUP BY label_id, attempt_no, line_num)"""
BOXES = "boxes AS (SELECT lines.* FROM lines JOIN attempts USING (label_id, attempt_no) WHERE region = 'full' AND angle = 0)"
PRIOR, RECORDS, FETCHED = (f"{n} AS ({E.duckdb(s)})" for n, s in (("prior", E.PRIOR), ("records", E.RECORDS), ("fetched", E.FETCHED)))
LAST = "lastp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no DESC) AS rn, min(row_no) OVER (PARTITION BY id) AS first_row FROM prior) WHERE rn = 1)"
DONE = "done AS (SELECT DISTINCT id FROM prior WHERE fetch_status = 'ok')"
PENDING = "pending AS (SELECT * FROM records WHERE id NOT IN (SELECT id FROM done))"
KEPT = "kept AS (SELECT * FROM lastp WHERE id NOT IN (SELECT id FROM pending))"


def _page_net(x: str) -> str:
    low = f"lower(trim({x}))"
    q, u = f"regexp_extract({low}, '{C.NET_ON_PAGE}', 1)", f"regexp_extract({low}, '{C.NET_ON_PAGE}', 2)"
    return f"""CASE WHEN {x} IS NULL THEN '' WHEN {q} = '' THEN trim({x}) WHEN contains({u}, 'millil') OR {u} = 'ml' THEN {q} || 'ml' WHEN contains({u}, 'liter') OR {u} = 'l' THEN {q} || 'l'
      WHEN contains({u}, 'oz') OR contains({u}, 'ounce') THEN {q} || 'oz' ELSE trim({x}) END"""


def _page_alcohol(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' WHEN regexp_extract({x}, '{C.NUMBER}', 1) <> '' THEN regexp_extract({x}, '{C.NUMBER}', 1) ELSE trim({x}) END"


def _score() -> str:
    compact = lambda x: f"replace({x}, ' ', '')"
    words = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda y: y <> ''))"
    return f"""CASE WHEN contains(box, raw) THEN 1.0 WHEN field <> 'brand_name' AND (contains({compact('box')}, {compact('raw')}) OR contains({compact('raw')}, {compact('box')})) THEN 0.95
      WHEN length(box) > 2 AND contains(raw, box) AND length(box)::DOUBLE / length(raw) >= 0.4 THEN length(box)::DOUBLE / length(raw) * 0.9
      WHEN len(list_intersect({words('raw')}, {words('box')}))::DOUBLE / len({words('raw')}) >= 0.5 THEN len(list_intersect({words('raw')}, {words('box')}))::DOUBLE / len({words('raw')}) * 0.7
      ELSE 0.0 END::DOUBLE"""


STATUS = "CASE {s} WHEN 'found' THEN 'match' WHEN 'partial' THEN 'partial_match' ELSE 'not_found' END"

ORACLES: dict[str, str] = {
    "alcohol_status_by_brand": f"{WHOLE} SELECT part_brand, alcohol_content_status AS status, count(*) AS labels FROM ev GROUP BY ALL",
    "normalize_documents": f"SELECT doc_id, md5({norm('text')}) AS digest, length({norm('text')})::BIGINT AS chars FROM documents",
    "normalize_label_text": f"WITH {ATTEMPTS} SELECT label_id, attempt_no, {norm('text')} AS normalized FROM attempts",
    "canonical_net_contents": f"WITH {APPS} SELECT label_id, {expected_net('net_contents')} AS canonical, {_page_net('net_contents')} AS page_form FROM apps",
    "expected_alcohol_value": f"WITH {APPS} SELECT label_id, TRY_CAST(NULLIF(regexp_extract(alcohol_content, '{C.NUMBER}', 1), '') AS DOUBLE) AS expected, {_page_alcohol('alcohol_content')} AS page_form FROM apps",
    "alcohol_match": f"{WHOLE} SELECT label_id, alcohol_content_status AS status, alcohol_content_confidence AS confidence, alcohol_content_expected AS value, alcohol_content_found AS raw_value FROM ev",
    "net_contents_match": f"{WHOLE} SELECT label_id, net_contents_status AS status, net_contents_confidence AS confidence, net_contents_expected AS value, net_contents_found AS raw_value FROM ev",
    "brand_match": f"{WHOLE} SELECT label_id, brand_name_status AS status, brand_name_confidence AS confidence, brand_name_expected AS value, brand_name_found AS raw_value FROM ev",
    "generic_text_match": f"""{WHOLE} SELECT label_id, CASE WHEN brand_name IS NULL THEN 'missing' WHEN contains(t, bw) THEN 'found' WHEN bo >= 0.5 THEN 'partial' ELSE 'missing' END AS status,
      CASE WHEN brand_name IS NULL THEN NULL WHEN contains(t, bw) THEN 0.99 WHEN bo >= 0.5 THEN round_even(bo, 3) ELSE 0.0 END::DOUBLE AS confidence FROM ev""",
    "token_overlap_join": f"""WITH d AS (SELECT doc_id, list_distinct(string_split({norm(norm('text'))}, ' ')) AS w FROM documents WHERE {norm(norm('text'))} <> ''),
      b AS (SELECT item_id, list_distinct(string_split({norm(norm('text'))}, ' ')) AS w FROM benchmark WHERE {norm(norm('text'))} <> '')
      SELECT item_id, doc_id, len(list_intersect(b.w, d.w))::BIGINT AS shared, len(list_intersect(b.w, d.w))::DOUBLE / len(b.w) AS overlap FROM b, d WHERE len(list_intersect(b.w, d.w)) >= 0.5 * len(b.w)""",
    "warning_signals": f"{WHOLE} SELECT label_id, government_warning_status AS status, government_warning_confidence AS confidence, gh::BIGINT AS groups_hit, government_warning_matched_anchors AS anchors FROM ev",
    "warning_signals_documents": f"""WITH n AS (SELECT doc_id, {norm('text')} AS t FROM documents), g AS (SELECT doc_id, {" + ".join("(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")::INT" for _, words in C.WARNING_GROUPS)} AS gh FROM n)
      SELECT doc_id, CASE WHEN gh >= 3 THEN 'found' WHEN gh >= 2 THEN 'partial' ELSE 'missing' END AS status, gh::BIGINT AS groups_hit FROM g""",
    "warnings_list": f"{WHOLE} SELECT label_id, warnings FROM ev",
    "evaluate_labels": f"{WHOLE} SELECT label_id, {VERDICTS} FROM ev",
    "words_to_lines": f"WITH {ATTEMPTS}, {LINES} SELECT label_id, attempt_no, line_no::INT AS line_no, text, x0, y0, x1, y1, confidence FROM lines",
    "polygon_boxes": f"WITH {ATTEMPTS}, {LINES} SELECT label_id, attempt_no, line_no::INT AS line_no, text, (x0 * 2)::INT AS x0, (y0 * 2)::INT AS y0, (x1 * 2)::INT AS x1, (y1 * 2)::INT AS y1, confidence FROM lines",
    "merge_attempts": f"WITH {ATTEMPTS}, {MERGED} SELECT * FROM merged",
    "text_by_angle": f"WITH {ATTEMPTS} SELECT label_id, angle, min_by(text, attempt_no) AS text FROM attempts WHERE region = 'full' GROUP BY ALL",
    "fallback_prefix_choice": f"{CHOSEN} SELECT label_id, attempt_no, ocr_ms, md5(t) AS digest, {VERDICTS} FROM ch",
    "primary_boxes": f"WITH {ATTEMPTS}, {LINES}, {BOXES} SELECT label_id, attempt_no, line_no::INT AS line_no, text, confidence FROM boxes",
    "associate_boxes": f"""{WHOLE}, {LONG}, {LINES}, {BOXES},
      s AS (SELECT label_id, field, attempt_no, line_no, raw, box, {_score()} AS score FROM (SELECT long.label_id, field, lower(trim(raw)) AS raw, attempt_no, line_no, lower(trim(text)) AS box FROM long JOIN boxes USING (label_id) WHERE status <> 'missing' AND raw <> '')),
      r AS (SELECT *, max(score) OVER (PARTITION BY label_id, field) AS best, row_number() OVER (PARTITION BY label_id, field ORDER BY score DESC, attempt_no, line_no) AS rank FROM s WHERE score > 0)
      SELECT label_id, field, rank::INT AS rank, score, attempt_no, line_no::INT AS line_no FROM r WHERE score >= best * 0.6 AND rank <= 2""",
    "warning_boxes": f"""{WHOLE}, {LINES}, {BOXES} SELECT label_id, attempt_no, line_no::INT AS line_no FROM boxes WHERE label_id IN (SELECT label_id FROM ev WHERE government_warning_status <> 'missing')
      AND len(list_intersect(string_split(lower(text), ' '), [{", ".join(f"'{w}'" for w in C.WARNING_BOX_WORDS)}])) > 0""",
    "overall_confidence": f"""{WHOLE} SELECT label_id, round_even(list_sum(list_filter([brand_name_confidence, alcohol_content_confidence, net_contents_confidence, government_warning_confidence], lambda x: x IS NOT NULL))
      / len(list_filter([brand_name_confidence, alcohol_content_confidence, net_contents_confidence, government_warning_confidence], lambda x: x IS NOT NULL)), 3) AS overall_confidence FROM ev""",
    "api_projection": f"""{WHOLE} SELECT label_id, {", ".join(f"{STATUS.format(s=n + '_status')} AS {n}_match, coalesce({n}_confidence, 0.0) AS {n}_confidence" for n in C.FIELDS)},
      {STATUS.format(s='government_warning_status')} AS gov_warning_match, government_warning_status = 'found' AS gov_warning_extracted FROM ev""",
    "field_status_summary": f"{WHOLE}, {LONG} SELECT field, {COUNTS.format(s='status')} FROM long GROUP BY field",
    "warning_status_summary": f"{WHOLE} SELECT {COUNTS.format(s='government_warning_status')} FROM ev",
    "timing_summary": f"""WITH {ATTEMPTS}, l AS (SELECT label_id, sum(elapsed_ms) AS ocr_ms, sum(elapsed_ms) + count(*) AS total_ms FROM attempts GROUP BY label_id)
      SELECT count(*) AS total_records, {", ".join(f"coalesce(round_even({f}({c}), 2), 0.0) AS {n}_{c}" for c in ("total_ms", "ocr_ms") for n, f in (("avg", "avg"), ("median", "median"), ("min", "min"), ("max", "max")))} FROM l""",
    "variant_summary": f"""{CHOSEN} SELECT coalesce(nullif(variant_type, ''), 'unknown') AS variant, count(*) AS records,
      {", ".join(f"round_even(count(*) FILTER (WHERE {n}_status = '{s}') / count(*), 4) AS {n}_{s}_rate" for n in (*C.FIELDS, "government_warning") for s in ("found", "partial"))},
      round_even(avg(ocr_ms + 1), 2) AS avg_total_ms, round_even(avg(ocr_ms), 2) AS avg_ocr_ms FROM ch GROUP BY 1""",
    "variant_rollup": f"""{WHOLE}, v AS (SELECT coalesce(nullif(variant_type, ''), 'unknown') AS variant, brand_name_status = 'found' AND alcohol_content_status = 'found' AND net_contents_status = 'found' AS ok FROM ev)
      SELECT variant, count(*) AS records, count(*) FILTER (WHERE ok) AS all_found, grouping(variant)::INT AS is_total FROM v GROUP BY ROLLUP (variant)""",
    "top_warnings": f"""{WHOLE}, w AS (SELECT label_id, unnest(string_split(warnings, '; ')) AS warning FROM ev WHERE warnings <> '') SELECT warning, count(*) AS count FROM w GROUP BY warning ORDER BY count(*) DESC, min(label_id) LIMIT 20""",
    "status_value_counts": f"WITH {PRIOR} SELECT fetch_status, count(*) AS count FROM prior WHERE fetch_status IS NOT NULL GROUP BY 1",
    "curated_records": f"""WITH {PRIOR} SELECT id, row_no FROM prior WHERE net_contents IS NOT NULL AND alcohol_content IS NOT NULL AND trim(net_contents) <> '' AND trim(alcohol_content) <> ''
      AND trim(brand_name_detail) <> '' AND trim(image_path) <> '' AND fetch_status = 'ok' AND variant_type = 'original'""",
    "dedup_last_wins": f"WITH {PRIOR}, {LAST} SELECT id, row_no, first_row, fetch_status FROM lastp",
    "pending_records": f"WITH {PRIOR}, {RECORDS}, {DONE}, {PENDING} SELECT id, row_no, name FROM pending",
    "kept_records": f"WITH {PRIOR}, {RECORDS}, {DONE}, {LAST}, {PENDING}, {KEPT} SELECT id, row_no, fetch_status FROM kept",
    "merged_metadata": f"""WITH {PRIOR}, {RECORDS}, {FETCHED}, {DONE}, {LAST}, {PENDING}, {KEPT}
      SELECT id, row_no, NULL AS name, brand_name_detail, NULL AS fanciful_name_detail FROM kept
      UNION ALL SELECT p.id, p.row_no, p.name, CASE WHEN f.id IS NOT NULL THEN f.brand_name_detail ELSE p.brand_name_detail END, f.fanciful_name_detail FROM pending p LEFT JOIN fetched f USING (id)""",
    "master_with_variants": f"""WITH {PRIOR}, {LAST}, had AS (SELECT id, row_no, fetch_status, image_path, variant_type, '' AS base_image FROM prior WHERE coalesce(variant_type, 'original') <> 'original'),
      originals AS (SELECT id, row_no, fetch_status, image_path, 'original' AS variant_type, '' AS base_image FROM lastp WHERE fetch_status IN ('ok', 'ok_partial') AND trim(image_path) <> ''),
      new AS (SELECT id, row_no, fetch_status, 'images/' || id || '_dist.jpg' AS image_path, 'noise_s5' AS variant_type, image_path AS base_image FROM lastp WHERE fetch_status = 'ok' AND trim(image_path) <> '' AND id NOT IN (SELECT id FROM had))
      SELECT * FROM originals UNION ALL SELECT * FROM had UNION ALL SELECT * FROM new""",
    "exact_size_sample": f"""WITH {PRIOR}, e AS (SELECT row_no, row_number() OVER (ORDER BY (row_no * 7919) % 10007, row_no) AS i, count(*) OVER () AS n FROM prior WHERE fetch_status = 'ok' AND trim(image_path) <> '')
      SELECT row_no FROM e WHERE i <= greatest(1, floor(n * 0.5))""",
    "fetch_status_classified": f"""WITH {FETCHED}, d AS (SELECT *, {_page_net('net_text')} AS net_contents, {_page_alcohol('alcohol_text')} AS alcohol_content FROM fetched),
      c AS (SELECT *, brand_name_detail <> '' AND fanciful_name_detail <> '' AND net_contents <> '' AND alcohol_content <> '' AS complete FROM d)
      SELECT id, net_contents, alcohol_content, CASE WHEN error IS NOT NULL THEN 'error: ' || error WHEN captcha THEN 'captcha' WHEN images = 0 THEN 'no_image' WHEN image_error IS NOT NULL THEN 'image_error: ' || image_error WHEN complete THEN 'ok' ELSE 'ok_partial' END AS fetch_status FROM c""",
    "detail_flat": f"""{CHOSEN}, a AS (SELECT label_id, {", ".join(f"coalesce(min_by(text, attempt_no) FILTER (WHERE region = 'full' AND angle = {x}), '') AS ocr_angle_{x}" for x in (0, 90, 270))} FROM attempts GROUP BY label_id)
      SELECT label_id AS ttb_id, variant_type, ocr_ms AS ocr_time_ms, t AS normalized_ocr_text, ocr_angle_0, ocr_angle_90, ocr_angle_270, brand_name_status, brand_name_found, alcohol_content_status, alcohol_content_found, net_contents_status, net_contents_found,
      government_warning_matched_anchors, warnings FROM ch JOIN a USING (label_id)""",
    "page_titles": "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1))::BIGINT AS links FROM pages",
    "page_captcha": "SELECT page_id, contains(html, 'What code is in the image') OR contains(lower(html), 'are you a human') AS captcha, len(list_filter(regexp_extract_all(html, '<img [^>]*src=\"([^\"]*)\"', 1), lambda s: contains(s, 'publicViewAttachment')))::BIGINT AS attachments FROM pages",
    "stack_layout": "SELECT o_custkey AS record_id, o_orderkey AS part_no, sum(100 + o_orderkey % 50) OVER w - (100 + o_orderkey % 50) AS y_offset, sum(100 + o_orderkey % 50) OVER (PARTITION BY o_custkey) AS total_height, max(200 + o_orderkey % 30) OVER (PARTITION BY o_custkey) AS max_width FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)",
    "label_quality_by_source": "SELECT source, count(*) AS labelled, count(*) FILTER (WHERE quality = 1) AS good, round_even(count(*) FILTER (WHERE quality = 1) / count(*), 4) AS good_rate FROM documents JOIN labels USING (doc_id) GROUP BY source",
}
