"""The frames that every query reads, derived from the star tables: businesses, contacts, suppression, ledger, archive, events.

The same text makes them in Spark and in the SQL that checks a query; only integer division is spelled differently.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


COUNTS = "SELECT c.n, p.n_part, g.n_pages FROM (SELECT count(*) AS n FROM customer) c, (SELECT count(*) AS n_part FROM part) p, (SELECT count(*) AS n_pages FROM pages) g"


def _ctes(div: str, counts: str = COUNTS) -> str:
    def d(a: str, b: str) -> str:
        return f"(({a}) {div} ({b}))"

    return f"""
consts AS ({counts}),
order_counts AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY o_custkey),
placed AS (
  SELECT c_custkey AS k, c_mktsegment, c_nationkey, consts.*, c_custkey % {d("n", "25")} AS m, {d("c_custkey", d("n", "25"))} AS j FROM customer, consts),
businesses AS (
  SELECT k AS business_id, CAST(n_regionkey AS BIGINT) AS run_id,
    concat(p_name, CASE WHEN j % 3 = 0 THEN ' men' WHEN j % 3 = 1 THEN ' women' ELSE ' house' END) AS name,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'food' WHEN 'FURNITURE' THEN 'salon' WHEN 'BUILDING' THEN 'real_estate' WHEN 'AUTOMOBILE' THEN 'car_services' ELSE 'fashion' END AS category,
    CASE k % 8 WHEN 0 THEN 'cafe' WHEN 1 THEN 'Café' WHEN 2 THEN 'Bakery' WHEN 3 THEN 'Restaurant' WHEN 4 THEN 'Steak house' WHEN 5 THEN 'Pizza' WHEN 6 THEN NULL ELSE 'Bar' END AS subcategory,
    n_name AS city, r_name AS area, CASE WHEN k % 17 <> 0 THEN concat('Street ', CAST(k % 50 AS VARCHAR(20))) END AS address,
    CASE WHEN k % 7 <> 0 THEN CAST(31.40 AS DOUBLE) + CAST(m AS DOUBLE) * 0.01 + CAST(j % 5 AS DOUBLE) * 0.0004 END AS lat,
    CASE WHEN k % 7 <> 0 THEN CAST(74.20 AS DOUBLE) + CAST((k * 7) % {d("n", "25")} AS DOUBLE) * 0.01 + CAST(j % 4 AS DOUBLE) * 0.0004 END AS lng,
    CASE WHEN k % 13 <> 0 THEN concat('p', CAST(k % {d("n * 9", "10")} AS VARCHAR(20))) END AS place_id,
    CASE WHEN k % 3 = 0 THEN g.url WHEN k % 3 = 1 THEN '' END AS website,
    CASE WHEN k % 11 <> 0 THEN CAST(30 + k % 21 AS DOUBLE) / 10.0 END AS rating,
    CASE WHEN k % 5 <> 0 THEN coalesce(n_orders, 0) * 25 END AS review_count,
    k AS arrival
  FROM placed JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    JOIN part ON p_partkey = (m * 2 + j % 2) % n_part LEFT JOIN pages g ON g.page_id = k % n_pages LEFT JOIN order_counts ON o_custkey = k),
contacts AS (
  SELECT o_orderkey AS contact_id, o_custkey AS business_id, CASE WHEN o_orderkey % 10 = 0 THEN 'email' ELSE 'phone' END AS kind,
    CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'mobile' WHEN '2' THEN 'landline' WHEN '3' THEN 'uan' WHEN '4' THEN 'toll_free' ELSE 'unknown' END AS line_type,
    CASE o_orderstatus WHEN 'F' THEN 'google_maps' WHEN 'O' THEN 'business_website' ELSE 'businesslist_pk' END AS source,
    CASE WHEN o_orderkey % 10 = 0 THEN concat('Mail', CAST(o_orderkey % 700 AS VARCHAR(20)), '@Example.com') ELSE concat('0', CAST(o_orderkey AS VARCHAR(20))) END AS value_raw,
    CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 19 <> 0 THEN concat('+92', CAST(3000000000 + ((CASE WHEN o_orderkey % 6 = 1 THEN o_orderkey - 1 ELSE o_orderkey END) * 7919) % 500000000 AS VARCHAR(20))) END AS value_e164,
    CASE WHEN o_custkey % 6 = 0 OR o_orderkey % 10 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CASE (o_orderkey % 13) % 6 WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.75 WHEN 4 THEN 0.6 ELSE 0.0 END END AS wa_evidence,
    CAST(60 + (o_orderkey % 8) * 5 AS DOUBLE) / 100.0 AS confidence,
    CASE WHEN o_orderkey % 23 = 0 THEN concat('P', CAST(o_orderkey AS VARCHAR(20))) END AS person_name,
    CASE o_orderkey % 4 WHEN 0 THEN 'business' WHEN 1 THEN CASE WHEN o_orderkey % 23 = 0 THEN 'owner' END WHEN 2 THEN 'business' END AS belongs_to,
    concat('https://example.com/', CAST(o_orderkey % 40 AS VARCHAR(20))) AS source_url, o_orderdate AS scraped_at
  FROM orders),
suppressed_numbers AS (SELECT DISTINCT value_e164 FROM contacts WHERE contact_id % 97 = 0 AND value_e164 IS NOT NULL),
suppressed_emails AS (SELECT DISTINCT lower(trim(value_raw)) AS email FROM contacts WHERE contact_id % 970 = 0 AND kind = 'email'),
ledger AS (SELECT business_id FROM businesses WHERE business_id % 9 = 0)"""


#: WITH text for DuckDB.
SQL = "WITH RECURSIVE" + _ctes("//")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=64)
def _counted(session: SparkSession, sf_dir: str) -> str:
    """The three sizes that the spine goes by, counted from the files' footers once instead of with every frame."""
    n, parts, pages = (table(session, sf_dir, t).count() for t in ("customer", "part", "pages"))
    return f"SELECT CAST({n} AS BIGINT) AS n, CAST({parts} AS BIGINT) AS n_part, CAST({pages} AS BIGINT) AS n_pages"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One frame of the spine by name; Catalyst drops what it doesn't need of the others."""
    used = {t: table(spark, sf_dir, t) for t in ("customer", "part", "pages", "orders", "nation", "region")}
    text = _ctes("div", _counted(spark, sf_dir))
    for t in used:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})").replace(f"FROM {t},", f"FROM {{{t}}},").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(f"WITH {text.lstrip()} SELECT * FROM {name}", **used)
