"""Label evidence derived from the relational tables by integer arithmetic.

The driver's tables hold no label texts. These statements derive applications,
recognition attempts and record tables from whole tables; they are written in
the common subset of both dialects, so queries and their SQL twins read the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ALCOHOL = "CAST(5 + p_partkey % 40 AS STRING) || CASE WHEN p_partkey % 2 = 1 THEN '.5' ELSE '' END"
_QUANTITY = "CASE p_partkey % 4 WHEN 0 THEN '187' WHEN 1 THEN '375.0' WHEN 2 THEN '750' ELSE '1.50' END"
_UNIT = "CASE p_partkey % 5 WHEN 0 THEN ' ML' WHEN 1 THEN ' mL' WHEN 2 THEN ' cl' WHEN 3 THEN ' fl. oz.' ELSE ' L' END"

APPS = f"""
SELECT p_partkey AS label_id,
  CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN '★' WHEN p_partkey % 43 = 0 THEN '(ab)'
       WHEN p_partkey % 17 = 0 THEN 'Red' ELSE p_brand || ' ' || p_name END AS brand_name,
  CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN 'table wine'
       WHEN p_partkey % 23 = 0 THEN 'Alc. ' || {_ALCOHOL} || ' - 14% by vol' ELSE {_ALCOHOL} || '%' END AS alcohol_content,
  CASE WHEN p_partkey % 47 = 0 THEN NULL WHEN p_partkey % 53 = 0 THEN '1 gallon' ELSE {_QUANTITY} || {_UNIT} END AS net_contents,
  CASE p_partkey % 5 WHEN 0 THEN 'original' WHEN 1 THEN 'blur_k3' WHEN 2 THEN 'rotation_+1.5deg' WHEN 3 THEN 'bright_0.9' ELSE '' END AS variant_type,
  p_brand AS part_brand
FROM {{part}}
"""

ATTEMPTS = f"""
SELECT p_partkey AS label_id, attempt_no, region, angle, preprocess_mode, psm,
  CAST((p_partkey * 7 + attempt_no * 13) % 900 AS DOUBLE) / 4 + 1 AS elapsed_ms,
  CASE WHEN (p_partkey + attempt_no) % 6 = 0 THEN '  ' ELSE
    'Lot  ' || CAST(p_partkey AS STRING)
    || CASE WHEN attempt_no <> p_partkey % 3 THEN '' WHEN p_partkey % 43 = 0 THEN ' x (ab) y' WHEN p_partkey % 34 = 0 THEN ' RED wine'
            WHEN p_partkey % 17 = 0 THEN ' hundred proof' WHEN p_partkey % 19 = 0 THEN ' ' || upper(p_name) || ' by ' || p_brand ELSE ' ' || upper(p_brand) || '  ' || p_name END
    || CASE WHEN attempt_no <> p_partkey % 4 THEN '' ELSE ' ' || CASE WHEN p_partkey % 13 = 0 THEN '3' ELSE '' END || {_ALCOHOL}
            || CASE p_partkey % 3 WHEN 0 THEN '% ALC/ VOL' WHEN 1 THEN ' % alcohol by volume' ELSE '%' END END
    || CASE WHEN attempt_no <> p_partkey % 5 THEN '' WHEN p_partkey % 11 = 0 THEN ' ' || {_QUANTITY} || ' loaves' ELSE ' NET ' || {_QUANTITY} || {_UNIT} END
    || CASE WHEN attempt_no <> p_partkey % 9 THEN '' ELSE
         CASE WHEN p_partkey % 2 >= 1 THEN ' GOVERNMENT WARNING:' ELSE '' END || CASE WHEN p_partkey % 4 >= 2 THEN ' the Surgeon General' ELSE '' END
         || CASE WHEN p_partkey % 8 >= 4 THEN ' women should not drink' ELSE '' END || CASE WHEN p_partkey % 16 >= 8 THEN ' impairs your ability to drive' ELSE '' END
         || CASE WHEN p_partkey % 32 >= 16 THEN ' health problems' ELSE '' END END
  END AS text
FROM {{part}} CROSS JOIN (VALUES (0, 'full', 0, 'basic', 6), (1, 'full', 90, 'basic', 6), (2, 'full', 270, 'basic', 6), (3, 'full', 0, 'bilateral', 6),
  (4, 'right_strip', 90, 'basic', 6), (5, 'right_strip', 270, 'basic', 6), (6, 'bottom_strip', 0, 'basic', 6), (7, 'bottom_strip', 0, 'adaptive', 6))
  AS s(attempt_no, region, angle, preprocess_mode, psm)
"""

PRIOR = """
SELECT 'A' || CAST(o_custkey AS STRING) AS id, o_orderkey AS row_no,
  CASE o_orderkey % 7 WHEN 0 THEN 'no_image' WHEN 1 THEN 'captcha' WHEN 2 THEN 'error: 500' WHEN 3 THEN 'ok_partial' WHEN 4 THEN NULL ELSE 'ok' END AS fetch_status,
  CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'images/A' || CAST(o_custkey AS STRING) || '.jpg' END AS image_path,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Brand ' || CAST(o_orderkey % 100 AS STRING) END AS brand_name_detail,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 9 * 100 AS STRING) || 'ml' END AS net_contents,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_orderkey % 20 AS STRING) END AS alcohol_content,
  CASE WHEN o_orderkey % 3 = 0 THEN 'blur_k3' WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'original' END AS variant_type
FROM {orders}
"""

RECORDS = "SELECT 'A' || CAST(c_custkey AS STRING) AS id, c_custkey AS row_no, c_name AS name, '' AS brand_name_detail FROM {customer}"

FETCHED = """
SELECT 'A' || CAST(c_custkey AS STRING) AS id,
  CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'Detail ' || c_mktsegment END AS brand_name_detail,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Fancy' END AS fanciful_name_detail,
  CASE c_custkey % 5 WHEN 0 THEN '750 MILLILITERS' WHEN 1 THEN '12 FL. OZ' WHEN 2 THEN '5 GALLONS' WHEN 3 THEN '75 cl' ELSE NULL END AS net_text,
  CASE c_custkey % 4 WHEN 0 THEN '13.5%' WHEN 1 THEN 'table wine' WHEN 2 THEN ' 12 by vol' ELSE NULL END AS alcohol_text,
  CASE WHEN c_custkey % 19 = 0 THEN 'timeout' ELSE NULL END AS error,
  c_custkey % 23 = 0 AS captcha, CAST(c_custkey % 3 AS INT) AS images,
  CASE WHEN c_custkey % 29 = 0 THEN 'bad pixels' ELSE NULL END AS image_error
FROM {customer}
"""


# Detail pages, and what is to be found on them (the shown columns).
DETAIL_PAGES = f"""
SELECT page_id, brand_shown, net_shown, alcohol_shown, fanciful_shown, CASE WHEN page_id % 37 = 0 THEN NULL ELSE
  '<html><head><title>Detail</title></head><body><table><tr><td><div class="boldlabel">6. BRAND  NAME (Required)</div><div class="data"> '
  || CASE WHEN page_id % 11 = 0 THEN '' ELSE part_brand || ' &amp; <b>Co</b>' END || ' </div></td><td><div class="label">8a. Net contents</div><div class="data"> </div><div class="data">'
  || net_shown || '</div></td><td><div class="data">' || alcohol_shown || '</div><p><div class="mylabel">ALCOHOL  CONTENT</div></p></td>'
  || CASE WHEN page_id % 5 = 0 THEN '<td><div class="label">fanciful name</div><div class="data">' || fanciful_shown || '</div></td>' ELSE '' END
  || CASE WHEN page_id % 7 = 0 THEN '<td><div class="label">brand name</div><div class="data">Later</div></td>' ELSE '<td><div class="label">EMPTY</div></td>' END || '</tr></table>'
  || repeat('<img src="/x/publicViewAttachment.do?f=a b">', CAST(page_id % 3 AS INT)) || '<img src="/logo.png">' || CASE WHEN page_id % 13 = 0 THEN '<p>Are you a HUMAN?</p>' ELSE '' END || '</body></html>' END AS html
FROM (SELECT p_partkey AS page_id, p_brand AS part_brand, {_QUANTITY} || {_UNIT} AS net_shown, {_ALCOHOL} || '%' AS alcohol_shown,
  CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '' END AS fanciful_shown,
  CASE WHEN p_partkey % 7 = 0 THEN 'Later' WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand || ' & Co' END AS brand_shown FROM {{part}}) AS d
"""

_TABLES = ("part", "orders", "customer", "supplier")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, statement: str, spread: bool = False) -> DataFrame:
    """spread: deal the tables' rows out first; for a few bytes a row that become much work, a scan has too few partitions."""
    names = [n for n in _TABLES if "{" + n + "}" in statement]
    tables = {n: _table(spark, sf_dir, n) for n in names}
    if spread:
        tables = {n: t.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) for n, t in tables.items()}
    return spark.sql(statement, **tables)


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, APPS)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, ATTEMPTS)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words of every attempt: four to a line, confidences from -1 to 99."""
    each = attempts(spark, sf_dir).select("label_id", "attempt_no", "region", "angle", F.posexplode(F.split("text", " ")).alias("word_no", "text"))
    n = F.col("word_no")
    return each.withColumns({
        "block_num": F.lit(1), "par_num": F.lit(1), "line_num": F.floor(n / 4).cast("int"),
        "left": (n % 4) * 50 + 7, "top": F.floor(n / 4).cast("int") * 30 + 3, "width": F.char_length("text") * 9 + 1, "height": F.lit(20) + n % 3,
        "conf": ((F.col("label_id") * 31 + n * 17) % 101).cast("int") - 1,
    })


def duckdb(statement: str) -> str:
    for n in _TABLES:
        statement = statement.replace("{" + n + "}", n)
    return statement


WORDS_SQL = """
SELECT label_id, attempt_no, region, angle, i - 1 AS word_no, w[i] AS text, 1 AS block_num, 1 AS par_num, (i - 1) // 4 AS line_num,
  ((i - 1) % 4) * 50 + 7 AS "left", ((i - 1) // 4) * 30 + 3 AS top, length(w[i]) * 9 + 1 AS width, 20 + (i - 1) % 3 AS height,
  (label_id * 31 + (i - 1) * 17) % 101 - 1 AS conf
FROM (SELECT *, string_split(text, ' ') AS w FROM attempts) a, unnest(range(1, len(w) + 1)) AS u(i)
"""
