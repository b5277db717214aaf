"""Every query of the engine beside its SQL. A query cannot be added without SQL or a stated reason for having none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.functions import phones as ph
from tallyfold.functions import text as tx
from tallyfold.functions import web
from tallyfold.functions.geo import haversine
from tallyfold.operators import dedupe, evidence, export, health, ledger, results
from tallyfold.operators.rank import ranked, wa_label
from tallyfold.operators.results import ResultQuery
from tallyfold.operators.score import order_statistics, report, scored, terms
from tallyfold.sources import payload, spine, taxonomy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WITHOUT_SQL: dict[str, str] = {}


class Data:
    """Frames of one directory, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in spine.TABLES:
            return spine.table(self.spark, self.sf_dir, name)
        return spine.frame(self.spark, self.sf_dir, name)

    @property
    def domains(self) -> DataFrame:
        return self.pages.where("page_id % 41 = 0").select(tx.registrable_domain(F.col("url")).alias("domain")).where("domain IS NOT NULL").distinct()

    @property
    def scores(self) -> DataFrame:
        return scored(self.businesses, self.contacts)

    @property
    def visible(self) -> DataFrame:
        return results.visible_contacts(self.contacts, self.suppressed_numbers, self.suppressed_emails)

    def phones(self, preference: str = "owner_first") -> DataFrame:
        return ranked(self.contacts, preference).join(self.visible.select("contact_id"), "contact_id", "left_semi")

    @property
    def view(self) -> DataFrame:
        return results.visible_view(self.businesses, self.contacts, self.suppressed_numbers, self.suppressed_emails, self.domains)

    @property
    def listings(self) -> DataFrame:
        """Directory listings from suppliers: named and placed like businesses, every third one without coordinates but with a phone."""
        b = self.businesses.select("business_id", "name", "lat", "lng")
        s = self.supplier.select(F.col("s_suppkey").alias("listing_id"))
        far = F.col("listing_id") % 3 == 0
        joined = s.join(b, s.listing_id * 3 == b.business_id)
        number = F.concat(F.lit("+92"), (F.lit(3000000000) + (F.col("listing_id") * 11 * 7919) % 500000000).cast("string"))
        return joined.select("listing_id", "name", F.when(~far, F.col("lat") + 0.0002).alias("lat"), F.when(~far, F.col("lng")).alias("lng"), number.alias("phone"))

    @property
    def breaker_events(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "empty").otherwise("success")
        return self.events.select((F.col("user_id") % 7).alias("source"), "event_id", "ts", kind.alias("kind"))

    @property
    def runs(self) -> DataFrame:
        """Run statistics from nations: one run each."""
        return self.nation.select(F.col("n_nationkey").cast("bigint").alias("run_id"), F.concat(F.lit("city"), (F.col("n_regionkey") % 3).cast("string")).alias("city"), F.when(F.col("n_nationkey") % 2 == 0, "food").otherwise("salon").alias("category"), (F.col("n_nationkey") % 9).cast("bigint").alias("queries"), ((F.col("n_nationkey") * 37) % 200).cast("double").alias("elapsed"), (F.col("n_nationkey") % 4 * 10).cast("bigint").alias("crawled"), (F.col("n_nationkey") % 7).cast("bigint").alias("confirmed"))


def query(name: str, sql: str | None = None, why: str = "", ctes: str = "") -> Callable:
    def add(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql is None:
            WITHOUT_SQL[name] = why
        else:
            SQL[name] = f"{spine.SQL}{',' + ctes if ctes else ''}\n{sql}"
        return f

    return add


# --- SQL that several queries share -------------------------------------------------------------

DOMAIN = "nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower({0}), '^(?:[^/?#]*?//|)([^/?#]*)', 1), '^.*@', ''), ':.*$', ''), '^www\\.', ''), '')"
LABEL = "CASE WHEN {0} >= 0.9 THEN 'confirmed' WHEN {0} >= 0.6 THEN 'likely' ELSE 'no' END"

SCORES = f"""
sig AS (
  SELECT business_id, max(CASE WHEN kind = 'phone' THEN wa_evidence END) AS wa, max(CASE WHEN kind = 'phone' THEN confidence END) AS conf,
    max(CASE WHEN kind = 'phone' AND person_name IS NOT NULL THEN confidence END) AS person, count(DISTINCT source) AS n_sources,
    bool_or(kind = 'email') AS has_email, count(DISTINCT CASE WHEN kind = 'phone' THEN value_e164 END) >= 2 AS second, bool_or(kind = 'phone' AND line_type = 'mobile') AS mobile, bool_or(kind = 'phone') AS phone
  FROM contacts GROUP BY 1),
term AS (
  SELECT b.*, coalesce(wa, 0.0) AS wa, coalesce(conf, 0.0) AS conf, coalesce(person, 0.0) AS person, coalesce(n_sources, 0) AS n_sources, coalesce(mobile, false) AS has_mobile, coalesce(phone, false) AS has_phone,
    CASE WHEN coalesce(n_sources, 0) >= 2 THEN 1.0 ELSE 0.0 END AS agreement,
    greatest(0.0, least(1.0, (rating - 1.0) / 4.0)) AS r, CASE WHEN review_count <= 0 THEN 0.0 ELSE least(1.0, log10(1.0 + review_count) / log10(201.0)) END AS v,
    (CASE WHEN address IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(website, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(has_email, false) THEN 1 ELSE 0 END + CASE WHEN coalesce(second, false) THEN 1 ELSE 0 END) / 4.0 AS complete
  FROM businesses b LEFT JOIN sig USING (business_id)),
signal AS (
  SELECT *, CASE WHEN rating IS NOT NULL AND review_count IS NOT NULL THEN 0.5 * r + 0.5 * v WHEN rating IS NOT NULL THEN r WHEN review_count IS NOT NULL THEN v END AS sv,
    CASE WHEN rating IS NOT NULL AND review_count IS NOT NULL THEN 1.0 WHEN rating IS NOT NULL OR review_count IS NOT NULL THEN 0.5 ELSE 0.0 END AS share,
    CASE WHEN rating IS NOT NULL AND review_count IS NOT NULL THEN 'rating_and_reviews' WHEN rating IS NOT NULL THEN 'rating_only' WHEN review_count IS NOT NULL THEN 'reviews_only' ELSE 'none' END AS basis
  FROM term),
scored AS (
  SELECT *, CAST(round_even(round(100.0 * CAST(30 * wa + 25 * conf + 15 * person + 10 * agreement + 10 * share * coalesce(sv, 0.0) + 10 * complete AS DOUBLE) / CAST(90.0 + 10 * share AS DOUBLE), 9), 0) AS INTEGER) AS lead_score FROM signal),
leads AS (SELECT *, lead_score >= 60 AND has_mobile AS qualified FROM scored)"""


def _rank_sql(name: str, preference: str) -> str:
    label = LABEL.format("wa_evidence")
    tier = {
        "owner_first": f"CASE WHEN person_name IS NOT NULL THEN 0 WHEN line_type = 'mobile' AND {label} = 'confirmed' THEN 1 WHEN line_type = 'mobile' THEN 2 ELSE 3 END",
        "business_first": f"CASE WHEN coalesce(belongs_to, 'business') = 'business' AND (line_type = 'uan' OR source = 'google_maps') THEN 0 WHEN line_type = 'mobile' AND {label} = 'confirmed' THEN 1 WHEN person_name IS NOT NULL THEN 2 ELSE 3 END",
        "whatsapp_only": "0",
    }[preference]
    able = "wa_evidence > 0" if preference == "whatsapp_only" else "true"
    order = "tier, wa_evidence DESC, confidence DESC, list_position(['mobile','uan','landline','toll_free','unknown'], line_type), coalesce(value_e164, ''), contact_id"
    return f"""
{name}_t AS (SELECT *, {tier} AS tier FROM contacts WHERE kind = 'phone' AND {able}),
{name}_d AS (SELECT *, value_e164 IS NULL OR row_number() OVER (PARTITION BY business_id, value_e164 ORDER BY {order}) = 1 AS keeps FROM {name}_t),
{name}_k AS (SELECT contact_id, CAST(row_number() OVER (PARTITION BY business_id ORDER BY {order}) AS INTEGER) AS rank FROM {name}_d WHERE keeps),
{name} AS (SELECT c.*, rank FROM contacts c LEFT JOIN {name}_k USING (contact_id) WHERE kind = 'phone')"""


VISIBLE = f"""
domains AS (SELECT DISTINCT {DOMAIN.format("url")} AS domain FROM pages WHERE page_id % 41 = 0),
visible AS (
  SELECT * FROM contacts WHERE (value_e164 IS NULL OR value_e164 NOT IN (SELECT value_e164 FROM suppressed_numbers))
    AND NOT (kind = 'email' AND lower(trim(value_raw)) IN (SELECT email FROM suppressed_emails))),
shown AS (
  SELECT * FROM businesses b WHERE ({DOMAIN.format("coalesce(website, '')")} IS NULL OR {DOMAIN.format("website")} NOT IN (SELECT domain FROM domains WHERE domain IS NOT NULL))
    AND (NOT EXISTS (SELECT 1 FROM contacts c WHERE c.business_id = b.business_id AND kind = 'phone') OR EXISTS (SELECT 1 FROM visible c WHERE c.business_id = b.business_id AND kind = 'phone')))"""

VIEW = f"""{SCORES},{_rank_sql("allranked", "owner_first")},{VISIBLE},
ranked AS (SELECT * FROM allranked WHERE contact_id IN (SELECT contact_id FROM visible)),
held AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY rank) AS slot, coalesce(value_e164, value_raw) AS number, {LABEL.format("wa_evidence")} AS label FROM ranked WHERE rank IS NOT NULL),
able AS (
  SELECT business_id, label, rank, CASE WHEN length(regexp_replace(coalesce(value_e164, value_raw), '[^0-9+]', '', 'g')) >= 10 THEN regexp_replace(coalesce(value_e164, value_raw), '[^0-9+]', '', 'g') END AS n,
    CASE WHEN label = 'confirmed' THEN 2 ELSE 1 END + CASE WHEN line_type = 'mobile' THEN 1 ELSE 0 END + CASE WHEN belongs_to = 'business' THEN 1 ELSE 0 END AS s
  FROM held WHERE label IN ('confirmed', 'likely')),
pick AS (SELECT business_id, n AS wa_number, label AS wa_confidence FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY s DESC, rank) AS o FROM able WHERE n IS NOT NULL) WHERE o = 1),
per AS (
  SELECT business_id, count(DISTINCT number) AS phone_count, arg_min(number, rank) AS phone_1, arg_min(person_name, rank) FILTER (person_name IS NOT NULL) AS contact_person, list(number ORDER BY rank) AS numbers, list(DISTINCT label) AS labels, list(DISTINCT line_type) AS line_types
  FROM held GROUP BY 1),
latest AS (SELECT business_id, max(scraped_at) AS scraped_at FROM visible GROUP BY 1),
rowsof AS (
  SELECT l.*, name AS business_name, coalesce(phone_count, 0) AS phone_count, phone_1, contact_person, numbers, labels, line_types, scraped_at, wa_number, wa_confidence,
    strip_accents(lower(coalesce(subcategory, ''))) IN ({", ".join(f"'{x}'" for x in results.DINE_IN)}) AS dine, trim(coalesce(website, '')) <> '' AS site
  FROM leads l JOIN (SELECT business_id FROM shown) USING (business_id) LEFT JOIN per USING (business_id) LEFT JOIN pick USING (business_id) LEFT JOIN latest USING (business_id)),
batched AS (
  SELECT *, CASE WHEN category <> 'food' THEN 'unbatched' WHEN wa_number IS NULL THEN 'no-whatsapp' WHEN review_count IS NULL OR review_count < 200 THEN 'early-stage' WHEN rating < 4.0 THEN 'reputation'
    WHEN dine AND site THEN 'cafe-site' WHEN dine THEN 'cafe-nosite' WHEN site THEN 'delivery-site' ELSE 'delivery-nosite' END AS batch FROM rowsof),
collapsed AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY CASE WHEN coalesce(lead_score, 0) = 0 THEN -1 ELSE lead_score END DESC, phone_count DESC, scraped_at DESC NULLS LAST, business_id) AS o FROM batched) WHERE place_id IS NULL OR o = 1)"""

# --- scores and ranks ---------------------------------------------------------------------------


@query("top_leads", "SELECT business_id, business_name, lead_score, phone_1 FROM batched WHERE qualified ORDER BY lead_score DESC, business_id LIMIT 100", ctes=VIEW)
def top_leads(d: Data) -> DataFrame:
    return d.view.where("qualified").orderBy(F.desc("lead_score"), "business_id").limit(100).select("business_id", "business_name", "lead_score", "phone_1")


@query("lead_score", "SELECT business_id, lead_score, qualified, basis FROM leads", ctes=SCORES)
def lead_score(d: Data) -> DataFrame:
    return d.scores.select("business_id", "lead_score", "qualified", "basis")


@query("score_terms", "SELECT business_id, round(wa, 6) AS t_whatsapp, round(conf, 6) AS t_confidence, round(person, 6) AS t_person, CAST(agreement AS DOUBLE) AS t_agreement, round(CAST(sv AS DOUBLE), 6) AS t_signal, CAST(share AS DOUBLE) AS signal_share, CAST(complete AS DOUBLE) AS t_completeness FROM signal", ctes=SCORES)
def score_terms(d: Data) -> DataFrame:
    t = d.scores
    return t.select("business_id", *(F.round(c, 6).alias(c) for c in ("t_whatsapp", "t_confidence", "t_person")), "t_agreement", F.round("t_signal", 6).alias("t_signal"), "signal_share", "t_completeness")


@query("qualified_leads", "SELECT business_id, lead_score FROM leads WHERE qualified", ctes=SCORES)
def qualified_leads(d: Data) -> DataFrame:
    return d.scores.where("qualified").select("business_id", "lead_score")


@query("score_report", "SELECT basis, count(*) AS businesses, count_if(qualified) AS qualified, count_if(has_phone) AS with_phone, count_if(has_mobile) AS with_mobile, count_if(n_sources >= 2) AS agreeing, count_if(person > 0) AS with_person FROM leads GROUP BY basis", ctes=SCORES)
def score_report(d: Data) -> DataFrame:
    return report(d.scores)


@query("score_order_stats", "SELECT round(avg(lead_score), 1) AS mean, l[CAST(floor(len(l) * 0.1) AS BIGINT) + 1] AS p10, l[len(l) // 2 + 1] AS median, l[least(len(l) - 1, CAST(floor(len(l) * 0.9) AS BIGINT)) + 1] AS p90, l[len(l)] AS max FROM (SELECT list(lead_score ORDER BY lead_score) AS l FROM leads), leads GROUP BY l", ctes=SCORES)
def score_order_stats(d: Data) -> DataFrame:
    return order_statistics(d.scores)


for _preference in ("owner_first", "business_first", "whatsapp_only"):
    query(f"rank_{_preference}", "SELECT contact_id, business_id, rank FROM r", ctes=_rank_sql("r", _preference))(lambda d, p=_preference: ranked(d.contacts, p).select("contact_id", "business_id", "rank"))

# --- the read path ------------------------------------------------------------------------------


@query("suppression_contacts", "SELECT contact_id FROM visible", ctes=VISIBLE)
def suppression_contacts(d: Data) -> DataFrame:
    return d.visible.select("contact_id")


@query("suppression_businesses", "SELECT business_id FROM shown", ctes=VISIBLE)
def suppression_businesses(d: Data) -> DataFrame:
    return results.visible_businesses(d.businesses, d.contacts, d.visible, d.domains).select("business_id")


@query("suppression_counts", "SELECT (SELECT count(*) FROM contacts) - (SELECT count(*) FROM visible) AS contacts_hidden, (SELECT count(*) FROM businesses) - (SELECT count(*) FROM shown) AS businesses_hidden", ctes=VISIBLE)
def suppression_counts(d: Data) -> DataFrame:
    contacts = d.contacts.agg(F.count("*").alias("c")).crossJoin(d.visible.agg(F.count("*").alias("v")))
    kept = results.visible_businesses(d.businesses, d.contacts, d.visible, d.domains)
    both = contacts.crossJoin(d.businesses.agg(F.count("*").alias("b"))).crossJoin(kept.agg(F.count("*").alias("k")))
    return both.select((F.col("c") - F.col("v")).alias("contacts_hidden"), (F.col("b") - F.col("k")).alias("businesses_hidden"))


_SHOWN = "business_id, business_name, category, lead_score, phone_count, phone_1, contact_person, batch"


@query("results_default", f"SELECT {_SHOWN} FROM collapsed", ctes=VIEW)
def results_default(d: Data) -> DataFrame:
    return results.view(d.view, ResultQuery()).select(*_SHOWN.split(", "))


@query("results_filtered", f"SELECT {_SHOWN} FROM batched WHERE run_id IN (1, 2, 3) AND coalesce(website, '') <> '' AND lead_score >= 40 AND list_has_any(labels, ['confirmed', 'likely']) AND list_has_any(line_types, ['mobile'])", ctes=VIEW)
def results_filtered(d: Data) -> DataFrame:
    q = ResultQuery(runs=(1, 2, 3), has_website=True, min_score=40, labels=("confirmed", "likely"), line_types=("mobile",), collapse=False)
    return results.view(d.view, q).select(*_SHOWN.split(", "))


@query("results_source_person", f"SELECT {_SHOWN} FROM batched WHERE contact_person IS NOT NULL AND business_id IN (SELECT business_id FROM contacts WHERE source = 'google_maps')", ctes=VIEW)
def results_source_person(d: Data) -> DataFrame:
    return results.view(d.view, ResultQuery(sources=("google_maps",), has_person=True, collapse=False)).select(*_SHOWN.split(", "))


@query("results_search", f"SELECT {_SHOWN} FROM batched WHERE contains(lower(concat_ws(chr(1), business_name, address, area, city, website, contact_person)), '7919') OR len(list_filter(coalesce(numbers, []), lambda x: contains(x, '7919'))) > 0", ctes=VIEW)
def results_search(d: Data) -> DataFrame:
    return results.view(d.view, ResultQuery(search="7919", collapse=False)).select(*_SHOWN.split(", "))


@query("results_page", f"SELECT {_SHOWN} FROM collapsed ORDER BY rating DESC NULLS LAST, business_id LIMIT 50 OFFSET 25", ctes=VIEW)
def results_page(d: Data) -> DataFrame:
    return results.page(d.view, ResultQuery(sort="rating", offset=25, limit=50)).select(*_SHOWN.split(", "))


@query("results_batches", f"SELECT {_SHOWN} FROM collapsed WHERE batch IN ('cafe-site', 'cafe-nosite')", ctes=VIEW)
def results_batches(d: Data) -> DataFrame:
    return results.view(d.view, ResultQuery(batches=("cafe-site", "cafe-nosite"))).select(*_SHOWN.split(", "))


@query("collapse_place_id", "SELECT business_id, place_id FROM collapsed", ctes=VIEW)
def collapse_place_id(d: Data) -> DataFrame:
    return results.collapsed(d.view).select("business_id", "place_id")


@query("wa_pick", "SELECT business_id, wa_number, wa_confidence FROM pick", ctes=VIEW)
def wa_pick(d: Data) -> DataFrame:
    return results.wa_pick(d.phones())


@query("batch_counts", f"SELECT b.batch, count(c.batch) AS n FROM (SELECT unnest([{', '.join(f"'{b}'" for b in results.BATCHES)}]) AS batch) b LEFT JOIN collapsed c ON b.batch = c.batch GROUP BY 1", ctes=VIEW)
def batch_counts(d: Data) -> DataFrame:
    return results.batch_counts(results.collapsed(d.view))


@query("send_rank", "SELECT business_id, batch, CASE WHEN batch <> 'unbatched' THEN CAST(row_number() OVER (PARTITION BY batch ORDER BY review_count DESC NULLS LAST, lead_score DESC NULLS LAST, business_id) AS INTEGER) END AS send_rank FROM collapsed", ctes=VIEW)
def send_rank(d: Data) -> DataFrame:
    return results.send_ranks(results.collapsed(d.view)).select("business_id", "batch", "send_rank")


@query("facets", "SELECT 'area' AS facet, area AS value, count(*) AS n FROM collapsed GROUP BY 2 UNION ALL SELECT 'subcategory', subcategory, count(*) FROM collapsed GROUP BY 2", ctes=VIEW)
def facets(d: Data) -> DataFrame:
    shown = results.collapsed(d.view)
    return shown.select(F.explode(F.array(F.struct(F.lit("area").alias("facet"), F.col("area").alias("value")), F.struct(F.lit("subcategory").alias("facet"), F.col("subcategory").alias("value")))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("sendable_share", "SELECT batch, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM collapsed WHERE batch NOT IN ('unbatched', 'no-whatsapp') GROUP BY batch", ctes=VIEW)
def sendable_share(d: Data) -> DataFrame:
    n = results.collapsed(d.view).where("batch NOT IN ('unbatched', 'no-whatsapp')").groupBy("batch").agg(F.count("*").alias("n"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a batch
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 2))


# --- export and ledger --------------------------------------------------------------------------

_SLOTS_SQL = ", ".join(f"max(CASE WHEN slot = {s} THEN {a} END) AS phone_{s}{x}" for s in range(1, 5) for x, a in export.ATTRIBUTES.items())


@query("phone_pivot", f"SELECT business_id, {_SLOTS_SQL} FROM held GROUP BY 1", ctes=VIEW)
def phone_pivot(d: Data) -> DataFrame:
    return export.phone_pivot(d.phones())


_PIPES = "SELECT business_id, string_agg(v, '|' ORDER BY o) AS {0} FROM (SELECT business_id, {1} AS v, min(contact_id) AS o FROM visible GROUP BY 1, 2) GROUP BY 1"


@query("sources_pipe", _PIPES.format("sources", "source"), ctes=VISIBLE)
def sources_pipe(d: Data) -> DataFrame:
    return d.visible.groupBy("business_id").agg(export.pipe(["source"], "contact_id").alias("sources"))


_EXPORTED = ", ".join(["c.business_id", *(x for x in export.COLUMNS if x not in ("sources", "evidence_urls", "email", "maps_url", "contact_role", "attribution", "facebook_url", "instagram_url", "phone_1")), "p.phone_1", "sources", "evidence_urls", "email", "CASE WHEN place_id IS NOT NULL THEN concat('https://www.google.com/maps/place/?q=place_id:', place_id) END AS maps_url", *(f"CAST(NULL AS VARCHAR) AS {x}" for x in ("contact_role", "attribution", "facebook_url", "instagram_url"))])


@query("export_rows_41", f"SELECT {_EXPORTED} FROM collapsed c LEFT JOIN (SELECT business_id, {_SLOTS_SQL} FROM held GROUP BY 1) p USING (business_id) LEFT JOIN ({_PIPES.format('sources', 'source')}) USING (business_id) LEFT JOIN ({_PIPES.format('evidence_urls', 'source_url')}) USING (business_id) LEFT JOIN (SELECT business_id, arg_min(value_raw, contact_id) AS email FROM visible WHERE kind = 'email' GROUP BY 1) USING (business_id)", ctes=VIEW)
def export_rows_41(d: Data) -> DataFrame:
    return export.export_rows(results.collapsed(d.view))


_PULLED = "SELECT n.business_id, lead_score, batch, coalesce(numbers, '') AS numbers FROM ({0}) n LEFT JOIN (SELECT business_id, string_agg(number, '|' ORDER BY rank) AS numbers FROM held WHERE label IN ('confirmed', 'likely') GROUP BY 1) USING (business_id)"
_NEW = "SELECT business_id, lead_score, batch FROM collapsed WHERE business_id NOT IN (SELECT business_id FROM ledger)"


@query("extract_top30", _PULLED.format(_NEW + " ORDER BY lead_score DESC NULLS LAST, business_id LIMIT 30"), ctes=VIEW)
def extract_top30(d: Data) -> DataFrame:
    return ledger.extract(results.collapsed(d.view), d.ledger, 30)


@query("extract_all", _PULLED.format(_NEW), ctes=VIEW)
def extract_all(d: Data) -> DataFrame:
    return ledger.extract(results.collapsed(d.view), d.ledger, None)


@query("extractable_numbers", "SELECT business_id, string_agg(number, '|' ORDER BY rank) AS numbers FROM held WHERE label IN ('confirmed', 'likely') GROUP BY 1", ctes=VIEW)
def extractable_numbers(d: Data) -> DataFrame:
    return ledger.extractable_numbers(d.phones()).select("business_id", F.array_join("numbers", "|").alias("numbers"))


@query("ledger_append", "SELECT business_id FROM ledger UNION SELECT business_id FROM collapsed", ctes=VIEW)
def ledger_append(d: Data) -> DataFrame:
    return ledger.append(d.ledger, results.collapsed(d.view).select("business_id"))


@query("ledger_clear", "SELECT business_id FROM ledger WHERE business_id NOT IN (SELECT business_id FROM collapsed WHERE batch = 'unbatched')", ctes=VIEW)
def ledger_clear(d: Data) -> DataFrame:
    return ledger.clear(d.ledger, results.view(d.view, ResultQuery(batches=("unbatched",))))


@query("ledger_counts", "SELECT batch, count(*) AS n FROM ledger JOIN batched USING (business_id) GROUP BY 1", ctes=VIEW)
def ledger_counts(d: Data) -> DataFrame:
    return ledger.counts(d.ledger, d.view)


@query("bulk_suppress", f"SELECT DISTINCT 'number' AS kind, value_e164 AS key FROM contacts WHERE business_id IN (SELECT business_id FROM batched WHERE batch = 'early-stage') AND kind = 'phone' AND value_e164 IS NOT NULL AND value_e164 NOT IN (SELECT value_e164 FROM suppressed_numbers) UNION SELECT 'domain', {DOMAIN.format('website')} FROM batched WHERE batch = 'early-stage' AND {DOMAIN.format('website')} IS NOT NULL", ctes=VIEW)
def bulk_suppress(d: Data) -> DataFrame:
    known = d.suppressed_numbers.select(F.lit("number").alias("kind"), F.col("value_e164").alias("key"))
    chosen = d.view.where("batch = 'early-stage'").select("business_id", "website")
    return ledger.bulk_suppress(chosen, d.contacts, known)


# --- duplicates and matches ---------------------------------------------------------------------

_NEAR = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"
PAIRS = f"""
keyed AS (
  SELECT 'exact_phone' AS tier, run_id, business_id, value_e164 AS key FROM contacts JOIN businesses USING (business_id) WHERE kind = 'phone' AND value_e164 IS NOT NULL
  UNION ALL SELECT 'place_id', run_id, business_id, place_id FROM businesses WHERE place_id IS NOT NULL
  UNION ALL SELECT 'domain', run_id, business_id, {DOMAIN.format("website")} FROM businesses WHERE coalesce(website, '') <> ''),
proposed AS (
  SELECT a.run_id, a.business_id AS a, b.business_id AS b, a.tier FROM keyed a JOIN keyed b ON a.tier = b.tier AND a.run_id = b.run_id AND a.key = b.key AND a.business_id < b.business_id
  UNION ALL SELECT a.run_id, a.business_id, b.business_id, 'fuzzy_name_geo' FROM businesses a JOIN businesses b ON a.run_id = b.run_id AND a.business_id < b.business_id AND {_NEAR} < 150),
cand AS (SELECT run_id, a, b, arg_min(tier, list_position(['place_id', 'exact_phone', 'domain', 'fuzzy_name_geo'], tier)) AS tier FROM proposed GROUP BY 1, 2, 3)"""


@query("geo_pairs", "SELECT run_id, a, b FROM proposed WHERE tier = 'fuzzy_name_geo'", ctes=PAIRS)
def geo_pairs(d: Data) -> DataFrame:
    return dedupe.near_pairs(d.businesses).select("run_id", "a", "b")


@query("dedupe_candidates", "SELECT run_id, a, b, tier FROM cand", ctes=PAIRS)
def dedupe_candidates(d: Data) -> DataFrame:
    return dedupe.candidates(d.businesses, d.contacts)


@query("dedupe_tier_counts", "SELECT tier, count(*) AS n FROM proposed GROUP BY 1", ctes=PAIRS)
def dedupe_tier_counts(d: Data) -> DataFrame:
    return dedupe.proposals(d.businesses, d.contacts).groupBy("tier").agg(F.count("*").alias("n"))


@query("segment_conflicts", "SELECT a, b FROM cand JOIN businesses x ON x.business_id = a JOIN businesses y ON y.business_id = b WHERE (x.name LIKE '% men' AND y.name LIKE '% women') OR (x.name LIKE '% women' AND y.name LIKE '% men')", ctes=PAIRS)
def segment_conflicts(d: Data) -> DataFrame:
    n = d.businesses.select("business_id", tx.normalise_name(F.col("name")).alias("n"))
    pairs = dedupe.candidates(d.businesses, d.contacts).join(n.select(F.col("business_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("business_id").alias("b"), F.col("n").alias("nb")), "b")
    return pairs.where(tx.conflicting(F.col("na"), F.col("nb"))).select("a", "b")


@query("dedupe_verdicts", why="no token-set similarity in SQL; tested against its definition")
def dedupe_verdicts(d: Data) -> DataFrame:
    return dedupe.verdicts(dedupe.candidates(d.businesses, d.contacts), d.businesses)


@query("dedupe_report", why="no token-set similarity in SQL")
def dedupe_report(d: Data) -> DataFrame:
    return dedupe_verdicts(d).groupBy("tier", "verdict").agg(F.count("*").alias("n"))


_PLACED = "SELECT DISTINCT place_id AS p, min(business_id) OVER (PARTITION BY place_id) AS component, business_id AS node, count(*) OVER (PARTITION BY place_id) AS c FROM businesses WHERE place_id IS NOT NULL"


@query("dedupe_components", f"SELECT node, component FROM ({_PLACED}) WHERE c > 1")
def dedupe_components(d: Data) -> DataFrame:
    places = d.businesses.where("place_id IS NOT NULL").select("business_id", "place_id")
    least = places.groupBy("place_id").agg(F.min("business_id").alias("a"))
    return dedupe.components(places.join(least, "place_id").where("a < business_id").select("a", F.col("business_id").alias("b")))


_GROUPED = f"""
grouped AS (SELECT node, component FROM ({_PLACED}) WHERE c > 1),
richest AS (
  SELECT b.*, component, row_number() OVER (PARTITION BY component ORDER BY coalesce(n, 0) DESC, {" + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in ("lat", "lng", "place_id", "website", "rating", "review_count", "area", "address"))} DESC, arrival, business_id DESC) AS place
  FROM grouped JOIN businesses b ON business_id = node LEFT JOIN (SELECT business_id AS i, count(*) AS n FROM contacts GROUP BY 1) ON i = node)"""
_KEPT = ", ".join(f"arg_min({c}, place) FILTER ({c} IS NOT NULL) AS {c}" for c in dedupe.GAPS if c not in ("facebook_url", "instagram_url"))


@query("dedupe_survivors", f"SELECT component, arg_min(business_id, place) AS survivor, arg_min(name, place) AS name, {_KEPT}, string_agg(CAST(business_id AS VARCHAR), ',' ORDER BY place) FILTER (place > 1) AS merged_from FROM richest GROUP BY component", ctes=_GROUPED)
def dedupe_survivors(d: Data) -> DataFrame:
    kept = dedupe.survivors(d.businesses, d.contacts, dedupe_components(d))
    return kept.withColumn("merged_from", F.array_join(F.transform("merged_from", lambda x: x.cast("string")), ","))


@query("dedupe_moved_contacts", "SELECT contact_id, coalesce(survivor, business_id) AS business_id FROM contacts LEFT JOIN (SELECT node, survivor FROM grouped JOIN (SELECT component, arg_min(business_id, place) AS survivor FROM richest GROUP BY 1) USING (component)) ON node = business_id", ctes=_GROUPED)
def dedupe_moved_contacts(d: Data) -> DataFrame:
    groups = dedupe_components(d)
    return dedupe.moved_contacts(d.contacts, groups, dedupe.survivors(d.businesses, d.contacts, groups)).select("contact_id", "business_id")


_LISTED = "SELECT s_suppkey AS listing_id, name, concat('+92', CAST(3000000000 + (s_suppkey * 11 * 7919) % 500000000 AS VARCHAR)) AS phone FROM supplier JOIN businesses ON business_id = s_suppkey * 3"


@query("directory_match_unlocated", f"SELECT listing_id, min(c.business_id) AS business_id FROM ({_LISTED}) JOIN contacts c ON kind = 'phone' AND value_e164 = phone JOIN businesses b ON b.business_id = listing_id * 3 WHERE listing_id % 3 = 0 OR lat IS NULL GROUP BY 1 HAVING count(DISTINCT c.business_id) = 1")
def directory_match_unlocated(d: Data) -> DataFrame:
    return dedupe.match_unlocated(d.listings, d.contacts)


@query("directory_match_located", why="no token-set similarity in SQL")
def directory_match_located(d: Data) -> DataFrame:
    return dedupe.match_located(d.listings, d.businesses, d.contacts).where("business_id IS NOT NULL").select("listing_id", "business_id")


@query("haversine", f"SELECT a.business_id, round({_NEAR}, 4) AS metres FROM businesses a JOIN businesses b ON b.business_id = a.business_id + 1 WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL")
def haversine_query(d: Data) -> DataFrame:
    a = d.businesses.where("lat IS NOT NULL").select("business_id", "lat", "lng")
    b = a.select((F.col("business_id") - 1).alias("business_id"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return a.join(b, "business_id").select("business_id", F.round(haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 4).alias("metres"))


# --- text, addresses, pages, numbers ------------------------------------------------------------


_NAMES = ("Škoda Žižkov Straße (Pvt.) Ltd", "Café  Déjà-Vu & Sons and Co", "ＦＵＬＬ Width_™ 42 inc", "İstanbul ﬁne Œuvre", "Co", "A.B.C. Company, LLC")
_NAMED = f"list_extract([{', '.join(repr(n) for n in _NAMES)}], c_custkey % {len(_NAMES)} + 1) || ' ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' Ltd. CO' ELSE '' END"
#: What the accents, compatibility forms and cases of these names come to, spelled out, since DuckDB only strips accents.
_PLAIN = "lower(strip_accents(" + "replace(" * 11 + "{0}" + "".join(f", '{x}', '{y}')" for x, y in (("ß", "ss"), ("Ｆ", "F"), ("Ｕ", "U"), ("Ｌ", "L"), ("™", "TM"), ("ﬁ", "fi"), ("İ", "I"), ("Œ", "œ"), ("Ž", "Z"), ("ž", "z"), ("Š", "S"))) + "))"


@query("name_norm", r"SELECT c_custkey, regexp_replace(trim(regexp_replace(" + _PLAIN.format(_NAMED) + r", '[^\p{L}\p{N}_]+', ' ', 'g')), '( (pvt ltd|private limited|pvt limited|ltd|limited|llc|inc|co|company|and sons|and co))+$', '') AS name_norm FROM customer")
def name_norm(d: Data) -> DataFrame:
    name = F.concat_ws(" ", F.get(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % len(_NAMES)).cast("int")), "c_name", F.when(F.col("c_custkey") % 2 == 0, "Ltd. CO"))
    return d.customer.select("c_custkey", tx.normalise_name(name).alias("name_norm"))


@query("registrable_domain", f"SELECT page_id, {DOMAIN.format('url')} AS domain FROM pages")
def registrable_domain(d: Data) -> DataFrame:
    return d.pages.select("page_id", tx.registrable_domain(F.col("url")).alias("domain"))


_ROUTED = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://www.instagram.com/u', page_id) WHEN 1 THEN concat('HTTP://M.Facebook.com:80/', page_id) WHEN 2 THEN url END AS u FROM pages"
_KIND = f"CASE WHEN {DOMAIN.format('u')} IN ('instagram.com', 'instagr.am') THEN 'i' WHEN {DOMAIN.format('u')} IN ('facebook.com', 'fb.com', 'fb.me', 'm.facebook.com') THEN 'f' WHEN u IS NOT NULL THEN 'w' END"


@query("site_url_split", f"SELECT page_id, CASE WHEN k = 'w' THEN u END AS website, CASE WHEN k = 'f' THEN u END AS facebook_url, CASE WHEN k = 'i' THEN u END AS instagram_url FROM (SELECT *, {_KIND} AS k FROM ({_ROUTED}))")
def site_url_split(d: Data) -> DataFrame:
    n, text = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = F.when(n == 0, F.concat(F.lit("https://www.instagram.com/u"), text)).when(n == 1, F.concat(F.lit("HTTP://M.Facebook.com:80/"), text)).when(n == 2, F.col("url"))
    return d.pages.select("page_id", *(c.alias(name) for name, c in tx.site_columns(url).items()))


_SPELLED = "CASE page_id % 6 WHEN 0 THEN concat('HTTP://WWW.', {0}, ':80/') WHEN 1 THEN concat('https://', {0}, ':443?UTM_Source=x&b=2&a=1%202&a=1') WHEN 2 THEN concat('http://', {0}, ':443/p//?q=%C3%A9+*~&gclid=7&z#frag?x=1') WHEN 3 THEN concat('https://', {0}, '/A/B/?k==&&_ga=1') ELSE url END"
_URL = rf"""
url_given AS (SELECT page_id, regexp_replace({_SPELLED.format(DOMAIN.format("url"))}, '#.*$', '') AS u FROM pages),
url_parts AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?]*)', 1)), '^www\.', '') AS host, regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '') AS params FROM url_given),
url_pairs AS (SELECT *, list_sort(list_filter(list_transform(params, lambda p: [url_decode(replace(split_part(p, '=', 1), '+', ' ')), url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))]), lambda x: NOT regexp_matches(lower(x[1]), '^(utm_|fbclid|gclid|mc_|_ga)'))) AS kept FROM url_parts),
urls AS (
  SELECT page_id, concat(scheme, '://', CASE scheme WHEN 'https' THEN regexp_replace(host, ':443$', '') WHEN 'http' THEN regexp_replace(host, ':80$', '') ELSE host END, CASE WHEN path = '' THEN '/' ELSE path END,
    CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(list_transform(kept, lambda x: concat(replace(url_encode(x[1]), '%20', '+'), '=', replace(url_encode(x[2]), '%20', '+'))), '&')) ELSE '' END) AS url_norm FROM url_pairs)"""


def spelled(d: Data) -> DataFrame:
    """Page addresses, four of six spelled anew: ports, cases, parameters that track, escapes and fragments."""
    host, k = tx.registrable_domain(F.col("url")), F.col("page_id") % 6
    say = lambda front, back: F.concat(F.lit(front), host, F.lit(back))
    url = F.when(k == 0, say("HTTP://WWW.", ":80/")).when(k == 1, say("https://", ":443?UTM_Source=x&b=2&a=1%202&a=1")).when(k == 2, say("http://", ":443/p//?q=%C3%A9+*~&gclid=7&z#frag?x=1")).when(k == 3, say("https://", "/A/B/?k==&&_ga=1")).otherwise(F.col("url"))
    return d.pages.select("page_id", url.alias("url"))


@query("url_normalise", "SELECT page_id, url_norm FROM urls", ctes=_URL)
def url_normalise(d: Data) -> DataFrame:
    return spelled(d).select("page_id", tx.normalise_url(F.col("url")).alias("url_norm"))


@query("url_hash", "SELECT page_id, sha256(url_norm) AS url_hash FROM urls", ctes=_URL)
def url_hash(d: Data) -> DataFrame:
    return spelled(d).select("page_id", tx.url_hash(F.col("url")).alias("url_hash"))


@query("distinct_on_url", "SELECT url_norm, min(page_id) AS page_id FROM urls GROUP BY 1", ctes=_URL)
def distinct_on_url(d: Data) -> DataFrame:
    return url_normalise(d).groupBy("url_norm").agg(F.min("page_id").alias("page_id"))


@query("page_links", r"""SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages""")
def page_links(d: Data) -> DataFrame:
    return d.pages.select("page_id", F.explode(web.links(F.col("html"))).alias("href"))


@query("visible_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\f\r\x0b]+', ' ', 'g'))) AS digest FROM pages")
def visible_text(d: Data) -> DataFrame:
    return d.pages.select("page_id", F.md5(web.visible_text(F.col("html"))).alias("digest"))


@query("email_extract", r"SELECT DISTINCT doc_id, lower(x) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS x FROM documents) WHERE split_part(lower(x), '@', 2) NOT IN (" + ", ".join(f"'{x}'" for x in web.NOISE_DOMAINS) + ")")
def email_extract(d: Data) -> DataFrame:
    return d.documents.select("doc_id", F.explode(web.emails(F.col("text"))).alias("email"))


@query("phones_in_text", why="overlapping spans and look-behind; tested on literal cases")
def phones_in_text(d: Data) -> DataFrame:
    return d.documents.select("doc_id", F.explode(ph.extract_phones("text")).alias("p")).select("doc_id", "p.*")


@query("page_evidence", why="a parser with ancestry; tested on inline pages")
def page_evidence(d: Data) -> DataFrame:
    return d.pages.select("page_id", web.parse_page("url", "html").alias("p")).select("page_id", F.md5("p.text").alias("digest"), F.size("p.targets").alias("n_targets"), F.size("p.numbers").alias("n_numbers"), F.size("p.emails").alias("n_emails"))


@query("phone_classify", "SELECT contact_id, CASE WHEN n LIKE '800%' THEN 'toll_free' WHEN (substring(n, 3, 3) = '111' AND length(n) = 11) OR (substring(n, 4, 3) = '111' AND length(n) = 12) THEN 'uan' WHEN n LIKE '3%' AND length(n) = 10 THEN 'mobile' WHEN substring(n, 1, 2) IN (" + ", ".join(f"'{x}'" for x in ph.CITIES) + ") THEN 'landline' ELSE 'unknown' END AS line_type FROM (SELECT contact_id, CASE contact_id % 4 WHEN 0 THEN concat('42111', 100000 + contact_id % 800000) WHEN 1 THEN concat('3', 100000000 + contact_id) WHEN 2 THEN concat('800', 10000 + contact_id % 80000) ELSE concat(10 + contact_id % 89, 1000000 + contact_id % 8000000) END AS n FROM contacts)")
def phone_classify(d: Data) -> DataFrame:
    c = F.col("contact_id")
    text = lambda x: x.cast("string")
    n = F.when(c % 4 == 0, F.concat(F.lit("42111"), text(100000 + c % 800000))).when(c % 4 == 1, F.concat(F.lit("3"), text(100000000 + c))).when(c % 4 == 2, F.concat(F.lit("800"), text(10000 + c % 80000))).otherwise(F.concat(text(10 + c % 89), text(1000000 + c % 8000000)))
    return d.contacts.select("contact_id", ph.line_type(n).alias("line_type"))


@query("e164_national", "SELECT contact_id, CASE WHEN n LIKE '92%' THEN substring(n, 3) WHEN n LIKE '0%' THEN substring(n, 2) ELSE n END AS national FROM (SELECT contact_id, regexp_replace(coalesce(value_e164, value_raw), '[^0-9]', '', 'g') AS n FROM contacts WHERE kind = 'phone')")
def e164_national(d: Data) -> DataFrame:
    return d.contacts.where("kind = 'phone'").select("contact_id", tx.national_digits(F.coalesce("value_e164", "value_raw")).alias("national"))


# --- evidence, archive, health, plans -----------------------------------------------------------


@query("evidence_label", f"SELECT contact_id, {LABEL.format('wa_evidence')} AS label FROM contacts WHERE kind = 'phone'")
def evidence_label(d: Data) -> DataFrame:
    return d.contacts.where("kind = 'phone'").select("contact_id", wa_label(F.col("wa_evidence")).alias("label"))


@query("best_evidence", f"SELECT value_e164, max(wa_evidence) AS wa_evidence, max(confidence) AS confidence, first(source_url ORDER BY wa_evidence DESC, contact_id) AS evidence_url, arg_min(source_url, contact_id) AS source_url, {LABEL.format('max(wa_evidence)')} AS label FROM contacts WHERE kind = 'phone' AND value_e164 IS NOT NULL GROUP BY 1")
def best_evidence(d: Data) -> DataFrame:
    return evidence.best_evidence(d.contacts)


@query("contact_upgrade", "SELECT business_id, value_e164, max(wa_evidence) AS wa_evidence, max(confidence) AS confidence, coalesce(min(source) FILTER (source = 'google_maps'), min(source)) AS source FROM contacts WHERE kind = 'phone' AND value_e164 IS NOT NULL GROUP BY 1, 2")
def contact_upgrade(d: Data) -> DataFrame:
    seen = d.contacts.where("kind = 'phone' AND value_e164 IS NOT NULL")
    return evidence.upgraded(seen.where("source = 'google_maps'"), seen.where("source <> 'google_maps'"))


@query("ingest_fold", "SELECT run_id, place_id, " + ", ".join(f"arg_min({c}, arrival) FILTER ({c} IS NOT NULL) AS {c}" for c in ("address", "website", "rating", "review_count")) + ", count(*) AS n_arrivals FROM businesses WHERE place_id IS NOT NULL GROUP BY 1, 2")
def ingest_fold(d: Data) -> DataFrame:
    return evidence.ingest_fold(d.businesses.where("place_id IS NOT NULL"), ["run_id", "place_id"], ["address", "website", "rating", "review_count"])


@query("capped_contacts", "SELECT contact_id FROM (SELECT contact_id, row_number() OVER (PARTITION BY business_id ORDER BY wa_evidence DESC, confidence DESC, contact_id) AS o FROM contacts) WHERE o <= 8")
def capped_contacts(d: Data) -> DataFrame:
    return evidence.capped(d.contacts, "business_id", 8, F.desc("wa_evidence"), F.desc("confidence"), "contact_id").select("contact_id")


@query("multi_source_businesses", "SELECT business_id, count(DISTINCT source) AS n FROM contacts GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def multi_source_businesses(d: Data) -> DataFrame:
    return d.contacts.groupBy("business_id").agg(F.countDistinct("source").alias("n")).where("n >= 2")


@query("with_confirmed", "SELECT run_id, count(DISTINCT business_id) AS n FROM contacts JOIN businesses USING (business_id) WHERE wa_evidence >= 0.9 GROUP BY 1")
def with_confirmed(d: Data) -> DataFrame:
    return d.contacts.where("wa_evidence >= 0.9").join(d.businesses.select("business_id", "run_id"), "business_id").groupBy("run_id").agg(F.countDistinct("business_id").alias("n"))


def _archive(d: Data) -> DataFrame:
    return d.events.select("event_id", F.when(F.col("event_id") % 2 == 0, "listing").otherwise("detail").alias("kind"), F.col("ts").alias("fetched_at"), F.length("props").alias("bytes"))


@query("cache_fresh", "SELECT event_id FROM events WHERE ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END > TIMESTAMP '2024-01-30 00:00:00'")
def cache_fresh(d: Data) -> DataFrame:
    return payload.fresh(_archive(d), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("cache_stats", "SELECT count(*) AS entries, CAST(coalesce(sum(length(props)), 0) AS BIGINT) AS bytes FROM events")
def cache_stats(d: Data) -> DataFrame:
    return _archive(d).agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


@query("breaker_streaks", "SELECT source, min(ts) AS first_ts, count(*) AS length FROM (SELECT *, user_id % 7 AS source, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS island FROM events) WHERE event_type = 'error' GROUP BY source, island HAVING count(*) >= 3")
def breaker_streaks(d: Data) -> DataFrame:
    return health.streaks(d.events.withColumn("source", F.col("user_id") % 7), "source", F.col("event_type") == "error")


@query("breaker", why="sequential state with pauses; tested against a plain loop")
def breaker(d: Data) -> DataFrame:
    return health.breaker(d.breaker_events)


_REPORTS = "SELECT user_id % 7 AS source, count_if(event_type = 'error' AND value > 90) AS blocked, count_if(event_type = 'error' AND value < 1) AS refused, count_if(event_type = 'error') AS failed, count_if(event_type <> 'error') AS ok FROM events GROUP BY 1"


@query("source_health", f"SELECT *, CASE WHEN blocked > 0 THEN 'blocked' WHEN refused > 0 AND ok = 0 THEN 'circuit_open' WHEN failed > 0 THEN 'throttled' ELSE 'ok' END AS status FROM ({_REPORTS})")
def source_health(d: Data) -> DataFrame:
    bad = F.col("event_type") == "error"
    return health.source_health(d.events.groupBy((F.col("user_id") % 7).alias("source")).agg(F.count_if(bad & (F.col("value") > 90)).alias("blocked"), F.count_if(bad & (F.col("value") < 1)).alias("refused"), F.count_if(bad).alias("failed"), F.count_if(~bad).alias("ok")))


@query("run_status", "SELECT run_id, CASE WHEN count_if(state = 'running') > 0 THEN 'running' WHEN count_if(state = 'failed') = count(*) THEN 'failed' WHEN count_if(state = 'failed') > 0 THEN 'partial' ELSE 'done' END AS status FROM (SELECT o_custkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE CASE WHEN o_orderkey % 40 = 0 THEN 'running' ELSE 'done' END END AS state FROM orders) GROUP BY 1")
def run_status(d: Data) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderkey") % 40 == 0, "running").otherwise("done")
    return health.run_status(d.orders.select(F.col("o_custkey").alias("run_id"), state.alias("state")))


@query("query_plan", "SELECT r_name AS city, n_name AS tile, word, concat(word, ' in ', n_name, ', ', r_name) AS query FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['salon', 'barber', 'spa']) AS word)")
def query_plan(d: Data) -> DataFrame:
    tiles = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("city"), F.col("n_name").alias("tile"))
    return health.query_plan(tiles, d.spark.sql("SELECT explode(array('salon', 'barber', 'spa')) AS word"))


@query("route_lookup", "SELECT category, strength, volume, count(*) AS n FROM businesses JOIN (VALUES " + ", ".join(f"('{c}', '{s}', '{'|'.join(v)}')" for c, (_, s, v) in taxonomy.ROUTES.items()) + ") r(category, strength, volume) USING (category) GROUP BY 1, 2, 3")
def route_lookup(d: Data) -> DataFrame:
    found = d.businesses.join(F.broadcast(taxonomy.routes(d.spark)), "category")  # one row a category
    return found.groupBy("category", "strength", F.array_join("volume", "|").alias("volume")).agg(F.count("*").alias("n"))


_RUNS = "SELECT CAST(n_nationkey AS BIGINT) AS run_id, concat('city', n_regionkey % 3) AS city, CASE WHEN n_nationkey % 2 = 0 THEN 'food' ELSE 'salon' END AS category, n_nationkey % 9 AS queries, CAST((n_nationkey * 37) % 200 AS DOUBLE) AS elapsed, n_nationkey % 4 * 10 AS crawled, n_nationkey % 7 AS confirmed FROM nation"
_RANGE = f"SELECT CASE WHEN count(*) = 0 THEN 9.6 WHEN count(*) = 1 THEN min(s) * 0.7 ELSE min(s) END AS low, CASE WHEN count(*) = 0 THEN 15.0 WHEN count(*) = 1 THEN max(s) * 1.5 ELSE max(s) END AS high, CASE WHEN count(*) = 0 THEN 'doc_projection' WHEN count(*) = 1 THEN 'measured_single_run' ELSE 'measured' END AS basis FROM (SELECT elapsed / queries AS s FROM ({_RUNS}) WHERE queries >= 2 AND elapsed > 1)"


@query("seconds_per_query", _RANGE)
def seconds_per_query(d: Data) -> DataFrame:
    return health.seconds_per_query(d.runs)


@query("runtime_estimate", f"SELECT round(low * 60 + 700 * 6.92 * 0.6, 4) AS low, round(high * 60 + 700 * 6.92 * 1.4, 4) AS high FROM ({_RANGE})")
def runtime_estimate(d: Data) -> DataFrame:
    return health.runtime(seconds_per_query(d), 60, 700).select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("confirmation_rates", f"SELECT city, category, arg_min(round(CAST(confirmed AS DOUBLE) / crawled, 3), run_id) AS rate FROM ({_RUNS}) WHERE crawled > 0 GROUP BY 1, 2")
def confirmation_rates(d: Data) -> DataFrame:
    return health.confirmation_rates(d.runs)


from tallyfold.plans import enrichment, landing, service  # noqa: E402, F401 (registers its queries)
