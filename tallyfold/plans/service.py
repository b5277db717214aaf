"""Queries of the ledger, of requests and pages, of duplicates as groups, and of runs and their health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators import dedupe, health, ledger, requests, results, score
from tallyfold.operators.results import ResultQuery
from tallyfold.plans.registry import PAIRS, VIEW, Data, query

# --- the ledger ---------------------------------------------------------------------------------

_BOOK = "book AS (SELECT l.business_id, run_id, CASE WHEN l.business_id % 18 = 0 THEN 'no-whatsapp' END AS batch, concat('p', l.business_id % 4) AS batch_id, TIMESTAMP '2024-03-01 00:00:00' + to_hours(CAST(l.business_id % 100 AS INTEGER)) AS extracted_at FROM ledger l JOIN businesses b ON b.business_id = l.business_id)"


def book(d: Data) -> DataFrame:
    b = F.col("business_id")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 00:00:00").cast("timestamp")) + (b % 100) * 3600)
    return d.ledger.join(d.businesses.select("business_id", "run_id"), "business_id").select(b.alias("business_id"), "run_id", F.when(b % 18 == 0, "no-whatsapp").alias("batch"), F.concat(F.lit("p"), (b % 4).cast("string")).alias("batch_id"), at.cast("timestamp_ntz").alias("extracted_at"))


@query("extracted_mark", "SELECT business_id, business_id IN (SELECT business_id FROM ledger) AS extracted FROM collapsed", ctes=VIEW)
def extracted_mark(d: Data) -> DataFrame:
    return ledger.marked(results.collapsed(d.view), d.ledger).select("business_id", "extracted")


_TOP = "top50 AS (SELECT c.*, coalesce(s.sendable, []) AS sendable FROM (SELECT * FROM collapsed WHERE business_id NOT IN (SELECT business_id FROM ledger) ORDER BY lead_score DESC NULLS LAST, business_id LIMIT 50) c LEFT JOIN (SELECT business_id, list(number ORDER BY rank) AS sendable FROM held WHERE label IN ('confirmed', 'likely') GROUP BY 1) s USING (business_id))"


@query("pull_metrics", "SELECT count(*) AS marked, (SELECT count(*) FROM collapsed WHERE business_id IN (SELECT business_id FROM ledger)) AS skipped, count_if(len(sendable) = 0) AS without_numbers, (SELECT count(DISTINCT n) FROM (SELECT unnest(sendable) AS n FROM top50)) AS numbers, (SELECT count(*) FROM collapsed WHERE business_id NOT IN (SELECT business_id FROM ledger)) - count(*) AS remaining, count(*) < 50 AS ran_dry FROM top50", ctes=f"{VIEW},{_TOP}")
def pull_metrics(d: Data) -> DataFrame:
    return ledger.pull_metrics(results.collapsed(d.view), d.ledger, 50)


@query("pull_entries", "SELECT business_id, run_id, 'p9' AS batch_id, 50 AS batch_size, batch, array_to_string(list_distinct_ordered, '|') AS numbers FROM (SELECT *, list_filter(sendable, lambda x, i: list_position(sendable, x) = i) AS list_distinct_ordered FROM top50)", ctes=f"{VIEW},{_TOP}")
def pull_entries(d: Data) -> DataFrame:
    rows = ledger.entries(ledger.pulled(results.collapsed(d.view), d.ledger, 50), "p9", 50, F.current_timestamp())
    return rows.select("business_id", "run_id", "batch_id", "batch_size", "batch", F.array_join("numbers", "|").alias("numbers"))


@query("clipboard", "SELECT string_agg(n, chr(10) ORDER BY s DESC, b, p) AS clipboard FROM (SELECT n, first(lead_score ORDER BY lead_score DESC, business_id, p) AS s, first(business_id ORDER BY lead_score DESC, business_id, p) AS b, first(p ORDER BY lead_score DESC, business_id, p) AS p FROM (SELECT lead_score, business_id, unnest(sendable) AS n, unnest(range(len(sendable))) AS p FROM top50) GROUP BY n)", ctes=f"{VIEW},{_TOP}")
def clipboard(d: Data) -> DataFrame:
    return ledger.clipboard(ledger.pulled(results.collapsed(d.view), d.ledger, 50))


_RUN = "(SELECT CAST(n_nationkey AS BIGINT) AS run_id, concat('city', n_regionkey % 3) AS run_city, CASE WHEN n_nationkey % 2 = 0 THEN 'food' ELSE 'salon' END AS run_category FROM nation)"


@query("ledger_list", f"SELECT business_id, k.batch, current_batch, name AS business_name, run_city, run_category, lead_score FROM book k LEFT JOIN businesses b USING (business_id) LEFT JOIN (SELECT business_id, batch AS current_batch, lead_score FROM batched) USING (business_id) LEFT JOIN {_RUN} r ON r.run_id = k.run_id WHERE k.run_id IN (1, 2, 3) AND coalesce(k.batch, current_batch) IN ('no-whatsapp', 'unbatched') ORDER BY extracted_at DESC, business_id DESC LIMIT 40", ctes=f"{VIEW},{_BOOK}")
def ledger_list(d: Data) -> DataFrame:
    rows = ledger.listed(book(d), d.businesses, d.view, d.runs, (1, 2, 3), ("no-whatsapp", "unbatched"), 40)
    return rows.select("business_id", "batch", "current_batch", "business_name", "run_city", "run_category", "lead_score")


@query("ledger_clear_listed", "SELECT business_id FROM book WHERE business_id NOT IN (SELECT business_id FROM book k LEFT JOIN (SELECT business_id, batch AS current_batch FROM batched) USING (business_id) WHERE coalesce(k.batch, current_batch) = 'no-whatsapp')", ctes=f"{VIEW},{_BOOK}")
def ledger_clear_listed(d: Data) -> DataFrame:
    rows = book(d)
    return ledger.clear(rows, ledger.listed(rows, d.businesses, d.view, d.runs, batches=("no-whatsapp",))).select("business_id")


@query("ledger_counts_recorded", "SELECT coalesce(k.batch, c.batch) AS batch, count(*) AS n FROM book k JOIN batched c USING (business_id) GROUP BY 1", ctes=f"{VIEW},{_BOOK}")
def ledger_counts_recorded(d: Data) -> DataFrame:
    return ledger.counts(book(d).withColumnRenamed("batch", "recorded"), d.view)


# --- requests -----------------------------------------------------------------------------------


@query("batch_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{b.id}', '{b.slug}', '{b.name}', {'NULL' if b.priority is None else b.priority}, {'false' if b.priority is None else 'true'})" for b in requests.CATALOGUE) + ") t(id, slug, name, send_priority, sendable)")
def batch_catalogue(d: Data) -> DataFrame:
    return requests.catalogue(d.spark)


@query("request_parsed", "SELECT business_id FROM batched WHERE coalesce(website, '') <> '' AND lead_score >= 30 AND list_has_any(line_types, ['mobile', 'uan']) AND batch IN ('no-whatsapp', 'unbatched')", ctes=VIEW)
def request_parsed(d: Data) -> DataFrame:
    q = requests.parse({"has_website": "true", "min_score": "30", "line_type": "mobile, uan", "batch": "b00,Unbatched", "sort": "no_such", "order": "asc"})
    return results.view(d.view, q).select("business_id")


@query("facet_values", "SELECT facet, CAST(row_number() OVER (PARTITION BY facet ORDER BY s DESC, b) - 1 AS INTEGER) AS place, value FROM (SELECT facet, value, first(lead_score ORDER BY lead_score DESC, business_id) AS s, first(business_id ORDER BY lead_score DESC, business_id) AS b FROM (SELECT lead_score, business_id, unnest(['category', 'subcategory', 'area', 'city']) AS facet, unnest([category, subcategory, area, city]) AS value FROM collapsed) WHERE coalesce(value, '') <> '' GROUP BY 1, 2)", ctes=VIEW)
def facet_values(d: Data) -> DataFrame:
    return requests.facet_values(results.collapsed(d.view))


@query("view_counters", "SELECT (SELECT count(*) FROM batched) AS matched, (SELECT count(*) FROM batched) - (SELECT count(*) FROM collapsed) AS collapsed, (SELECT count(*) FROM collapsed WHERE batch = 'unbatched') AS total", ctes=VIEW)
def view_counters(d: Data) -> DataFrame:
    return requests.counters(d.view, ResultQuery(batches=("unbatched",)))


@query("results_page_json", "SELECT business_id, CAST(row_number() OVER (ORDER BY rating DESC NULLS LAST, business_id) AS INTEGER) AS n, (SELECT count(*) FROM collapsed) AS total FROM (SELECT * FROM collapsed ORDER BY rating DESC NULLS LAST, business_id LIMIT 20 OFFSET 5)", ctes=VIEW)
def results_page_json(d: Data) -> DataFrame:
    """The page as JSON, read back."""
    page = requests.results_page(d.view, ResultQuery(sort="rating", offset=5, limit=20))
    read = page.select(F.from_json("json", "total bigint, rows array<struct<business_id:bigint>>").alias("p"))
    return read.select(F.posexplode("p.rows").alias("at", "row"), "p.total").select("row.business_id", (F.col("at") + 1).alias("n"), "total")


@query("score_ceiling", "SELECT 100 AS every, 85 AS without_person, 60 AS without_two")
def score_ceiling(d: Data) -> DataFrame:
    given = [score.ceiling(x) for x in ((), ("person_attribution",), ("whatsapp_evidence", "source_agreement"))]
    return d.spark.range(1).select(*(F.lit(x).alias(n) for x, n in zip(given, ("every", "without_person", "without_two"), strict=True)))


# --- duplicates as groups -----------------------------------------------------------------------

_CHAIN = """
chained AS (SELECT a, b FROM cand WHERE tier IN ('place_id', 'exact_phone') UNION ALL SELECT b, a FROM cand WHERE tier IN ('place_id', 'exact_phone')),
reach AS (SELECT a AS node, b AS other FROM chained UNION SELECT node, b FROM reach JOIN chained ON a = other)"""


@query("dedupe_chains", "SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node", ctes=f"{PAIRS},{_CHAIN}")
def dedupe_chains(d: Data) -> DataFrame:
    """Components over shared phones and places: chains of several steps, each pair of which shares something else."""
    pairs = dedupe.candidates(d.businesses, d.contacts).where("tier IN ('place_id', 'exact_phone')")
    return dedupe.components(pairs.select("a", "b"))


@query("dedupe_groups", why="no token-set similarity in SQL; tested against the components of all candidates")
def dedupe_groups(d: Data) -> DataFrame:
    pairs = dedupe.verdicts(dedupe.merge_candidates(d.businesses, d.contacts), d.businesses)
    return dedupe.components(pairs.where("verdict = 'merge'").select("a", "b"))


@query("merge_candidates", "SELECT run_id, a, b, arg_min(tier, list_position(['exact_phone', 'domain', 'fuzzy_name_geo'], tier)) AS tier FROM proposed JOIN (SELECT run_id, a, b FROM proposed WHERE tier = 'fuzzy_name_geo') USING (run_id, a, b) WHERE tier <> 'place_id' GROUP BY 1, 2, 3 UNION ALL SELECT run_id, a, b, 'place_id' FROM (SELECT run_id, min(business_id) OVER (PARTITION BY run_id, place_id) AS a, business_id AS b FROM businesses WHERE place_id IS NOT NULL) WHERE a < b", ctes=PAIRS)
def merge_candidates(d: Data) -> DataFrame:
    return dedupe.merge_candidates(d.businesses, d.contacts)


# --- runs and their health ----------------------------------------------------------------------


@query("refusal_streaks", "SELECT source, min(place) AS at FROM (SELECT *, row_number() OVER (PARTITION BY source, cleared ORDER BY place) AS n FROM (SELECT *, sum(CASE WHEN NOT refused AND pages > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY place) AS cleared FROM (SELECT user_id % 7 AS source, event_id AS place, event_type IN ('error', 'view') AS refused, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS pages FROM events)) WHERE refused) WHERE n = 3 GROUP BY 1")
def refusal_streaks(d: Data) -> DataFrame:
    visits = d.events.select((F.col("user_id") % 7).alias("source"), F.col("event_id").alias("place"), F.col("event_type").isin("error", "view").alias("refused"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("pages"))
    return health.refused_from(visits, 3)


_REPORT = "SELECT r.run_id, s.stage, (r.run_id * 7) % 40 AS ok, (r.run_id * 3) % 30 AS failed, CASE WHEN r.run_id % 3 = 0 THEN 0 ELSE r.run_id END AS phones, CASE WHEN r.run_id % 5 = 0 THEN 1 ELSE 0 END AS refused, CASE WHEN r.run_id % 7 = 0 THEN 2 ELSE 0 END AS blocked, 4 AS asked, r.run_id % 4 AS answered, r.run_id AS listings, r.run_id % 2 AS with_phone FROM (SELECT n_nationkey AS run_id FROM nation) r, (SELECT unnest(['contact_enrichment', 'social_enrichment', 'directories']) AS stage) s"


@query("degradation", f"SELECT run_id, stage, CASE stage WHEN 'contact_enrichment' THEN CASE WHEN ok >= 20 AND phones = 0 THEN 'zero_yield' WHEN blocked > 0 THEN 'blocked' END WHEN 'social_enrichment' THEN CASE WHEN ok >= 15 AND phones = 0 THEN 'zero_yield' WHEN ok + failed >= 15 AND ok = 0 THEN 'nothing_rendered' WHEN refused > 0 THEN 'refused' WHEN blocked > 0 THEN 'blocked' END ELSE CASE WHEN blocked > 0 THEN 'blocked' WHEN refused > 0 THEN 'refused' WHEN asked > 0 AND answered = 0 THEN 'no_answer' WHEN listings > 0 AND with_phone = 0 THEN 'zero_phone_yield' END END AS reason FROM ({_REPORT})")
def degradation(d: Data) -> DataFrame:
    n = F.col("n_nationkey")
    none = lambda when, value: F.when(when, value).otherwise(0)
    report = d.nation.select(n.alias("run_id"), F.explode(F.array(*map(F.lit, ("contact_enrichment", "social_enrichment", "directories")))).alias("stage"), (n * 7 % 40).alias("ok"), (n * 3 % 30).alias("failed"), F.when(n % 3 == 0, 0).otherwise(n).alias("phones"), none(n % 5 == 0, 1).alias("refused"), none(n % 7 == 0, 2).alias("blocked"), F.lit(4).alias("asked"), (n % 4).alias("answered"), n.alias("listings"), (n % 2).alias("with_phone"))
    return health.degraded(report).select("run_id", "stage", "reason")


@query("stage_progress", "SELECT run_id, stage, CASE WHEN reported AND run_id % 11 = 3 THEN 'failed' WHEN place = run_id % 9 THEN 'running' WHEN reported THEN 'done' WHEN planned THEN 'pending' ELSE 'skipped' END AS state FROM (SELECT *, place < run_id % 6 AS reported, CASE place WHEN 0 THEN run_id % 2 = 0 WHEN 1 THEN true WHEN 2 THEN run_id % 3 = 0 WHEN 3 THEN false ELSE true END AS planned FROM (SELECT n_nationkey AS run_id, unnest(['discovery', 'contact_enrichment', 'social_enrichment', 'person_attribution', 'normalise_score', 'dedupe_export']) AS stage, unnest(range(6)) AS place FROM nation))")
def stage_progress(d: Data) -> DataFrame:
    n = F.col("n_nationkey")
    flags = F.create_map(F.lit("google_maps"), n % 2 == 0, F.lit("facebook"), n % 3 == 0)
    stages = F.array(*map(F.lit, health.STAGES))
    runs = d.nation.select(n.alias("run_id"), flags.alias("sources"), F.get(stages, n % 9).alias("current"))
    reports = d.nation.select(n.alias("run_id"), F.posexplode(stages).alias("place", "stage")).where("place < run_id % 6").select("run_id", "stage", (F.col("run_id") % 11 == 3).alias("failed"), F.lit(1).alias("processed"), F.lit(1).alias("produced"), F.lit(1.0).alias("elapsed"))
    return health.progress(runs, reports).select("run_id", "stage", "state")


@query("stage_sums", "SELECT run_id, stage, processed, produced, skipped, failed, note FROM (SELECT n_regionkey AS run_id, concat('s', n_nationkey % 2) AS stage, sum(n_nationkey) AS processed, sum(n_nationkey % 5) AS produced, sum(1) AS skipped, sum(n_nationkey % 2) AS failed, arg_max(n_name, n_nationkey) AS note FROM nation GROUP BY 1, 2)")
def stage_sums(d: Data) -> DataFrame:
    n = F.col("n_nationkey")
    parts = d.nation.select(F.col("n_regionkey").alias("run_id"), F.concat(F.lit("s"), (n % 2).cast("string")).alias("stage"), n.alias("place"), n.alias("processed"), (n % 5).alias("produced"), F.lit(1).alias("skipped"), (n % 2).alias("failed"), F.lit("x").alias("note"), F.col("n_name").alias("value"))
    return health.stage_sums(parts).withColumn("note", F.element_at("notes", "x")).drop("notes")


@query("prior_ranges", "SELECT concat('city', n_regionkey % 3) AS city, CASE WHEN n_nationkey % 2 = 0 THEN 'food' ELSE 'salon' END AS category, count(*) AS runs, min(b) FILTER (b > 0) AS low, max(b) FILTER (b > 0) AS high, min(q) FILTER (n_nationkey % 4 = 0) AS qualified_low, max(q) FILTER (n_nationkey % 4 = 0) AS qualified_high FROM (SELECT *, n_nationkey * 13 % 50 AS b, n_nationkey % 6 AS q FROM nation) WHERE n_nationkey % 5 <> 1 GROUP BY 1, 2")
def prior_ranges(d: Data) -> DataFrame:
    n = F.col("n_nationkey")
    runs = d.nation.select(F.concat(F.lit("city"), (F.col("n_regionkey") % 3).cast("string")).alias("city"), F.when(n % 2 == 0, "food").otherwise("salon").alias("category"), F.when(n % 5 == 1, "running").otherwise("done").alias("status"), (n * 13 % 50).alias("businesses"), (n % 6).alias("qualified"), (n % 4 == 0).alias("enriched"))
    return health.prior_ranges(runs)


@query("rate_spread", "SELECT n_regionkey, CASE WHEN count_if(v > 0) < 2 THEN 1.0 ELSE max(v) FILTER (v > 0) / min(v) FILTER (v > 0) END AS spread, avg(v) AS mean FROM (SELECT n_regionkey, CAST(n_nationkey % 4 AS DOUBLE) AS v FROM nation) GROUP BY 1")
def rate_spread(d: Data) -> DataFrame:
    v = d.nation.select("n_regionkey", (F.col("n_nationkey") % 4).cast("double").alias("v"))
    return v.groupBy("n_regionkey").agg(health.spread(F.col("v")).alias("spread"), F.avg("v").alias("mean"))


@query("run_states", "SELECT run_id, CASE WHEN bool_or(s = 'cancelled') THEN 'cancelled' WHEN bool_or(s = 'running') THEN 'running' WHEN bool_and(s = 'queued') THEN 'queued' WHEN bool_or(s = 'queued') THEN 'running' WHEN bool_and(s = 'failed') THEN 'failed' WHEN bool_or(s IN ('failed', 'partial')) THEN 'partial' ELSE 'done' END AS status FROM (SELECT o_custkey AS run_id, list_extract(['queued', 'done', 'done', 'failed', 'partial', 'done', 'running', 'done', 'done', 'cancelled', 'done'], (o_orderkey * 7 + o_custkey) % 97 % 11 + 1) AS s FROM orders) GROUP BY 1")
def run_states(d: Data) -> DataFrame:
    names = F.array(*map(F.lit, ("queued", "done", "done", "failed", "partial", "done", "running", "done", "done", "cancelled", "done")))
    return health.run_status(d.orders.select(F.col("o_custkey").alias("run_id"), F.get(names, ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 97 % 11).cast("int")).alias("state")))


@query("query_provenance", "SELECT query, tile, word FROM (SELECT concat(word, ' in ', n_name, ', ', r_name) AS query, n_name AS tile, word, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS t FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['salon', 'spa']) AS word)) WHERE t <= 4")
def query_provenance(d: Data) -> DataFrame:
    """The first two tiles of each city with the first two words, and each query's text joined back to where it came from."""
    tiles = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("city"), F.col("n_name").alias("tile"))
    first = tiles.withColumn("_n", F.row_number().over(Window.partitionBy("city").orderBy("tile"))).where("_n <= 2").drop("_n")
    plan = health.query_plan(first, d.spark.sql("SELECT explode(array('salon', 'spa')) AS word"))
    return plan.select("query").join(plan, "query").select("query", "tile", "word")
