"""Queries of the folds of evidence onto businesses: sites, profiles, directories, and the backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import phones as ph
from tallyfold.operators import dedupe, sites
from tallyfold.plans.registry import _NEAR, Data, query

ORIGIN = "CASE contact_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'tel' WHEN 2 THEN 'jsonld' WHEN 3 THEN 'widget' ELSE 'wa_link' END"
_NUMBERS = "kind = 'phone' AND value_e164 IS NOT NULL"

SITE = f"""
offers AS (SELECT source_url AS site, contact_id % 4 AS page, contact_id AS pos, concat(source_url, '/p', contact_id % 4) AS url, value_e164 AS e164, value_raw AS raw, line_type, {ORIGIN} AS origin, wa_evidence AS score, person_name AS name FROM contacts WHERE {_NUMBERS}),
shaped AS (SELECT *, list_position(['wa_link', 'widget', 'jsonld', 'tel', 'text'], origin) AS shape FROM offers),
site_numbers AS (
  SELECT site, e164, first(raw ORDER BY page, shape, pos) AS raw, first(line_type ORDER BY page, shape, pos) AS line_type, first(url ORDER BY page, shape, pos) AS source_url,
    list_extract([0.95, 0.95, 0.9, 0.85, 0.6], min(shape)) AS confidence, max(score) AS score, first(url ORDER BY score DESC, page) AS url, first(name ORDER BY page, pos) FILTER (name IS NOT NULL) AS person_name
  FROM shaped GROUP BY 1, 2),
homes AS (SELECT site, arg_min(url, page) AS home FROM offers GROUP BY 1),
site_told AS (SELECT n.*, CASE WHEN line_type = 'mobile' THEN 0.6 ELSE 0.0 END AS low, home FROM site_numbers n JOIN homes USING (site)),
site_found AS (
  SELECT site, e164, raw, line_type, greatest(low, score) AS wa_evidence, confidence, CASE WHEN score > low THEN url ELSE home END AS evidence_url, source_url, person_name
  FROM site_told QUALIFY row_number() OVER (PARTITION BY site ORDER BY greatest(low, score) DESC, confidence DESC, e164) <= 12)"""


def site_offers(d: Data) -> DataFrame:
    n = F.col("contact_id")
    origin = F.when(n % 5 == 0, "text").when(n % 5 == 1, "tel").when(n % 5 == 2, "jsonld").when(n % 5 == 3, "widget").otherwise("wa_link")
    return d.contacts.where(_NUMBERS).select(F.col("source_url").alias("site"), (n % 4).alias("page"), n.alias("pos"), F.concat("source_url", F.lit("/p"), (n % 4).cast("string")).alias("url"), F.col("value_e164").alias("e164"), F.col("value_raw").alias("raw"), "line_type", F.lit(None).cast("string").alias("operator"), origin.alias("origin"), F.col("wa_evidence").alias("score"), F.col("person_name").alias("name"))


def site_findings_of(d: Data) -> DataFrame:
    o = site_offers(d)
    return sites.site_findings(o, o.select("site", "page", "url", "e164", "score"), o.select("site", "page", "url"), o.where("name IS NOT NULL").select("site", "page", "pos", "e164", "name"))


@query("site_findings", "SELECT site, e164, raw, line_type, CAST(wa_evidence AS DOUBLE) AS wa_evidence, CAST(confidence AS DOUBLE) AS confidence, evidence_url, source_url, person_name FROM site_found", ctes=SITE)
def site_findings(d: Data) -> DataFrame:
    return site_findings_of(d).drop("place", "operator")


@query("site_mails", "SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY page, pos) AS INTEGER) AS place, email FROM (SELECT source_url AS site, lower(value_raw) AS email, min(contact_id % 4) AS page, arg_min(contact_id, (contact_id % 4) * 100000000 + contact_id) AS pos FROM contacts WHERE kind = 'email' GROUP BY 1, 2)")
def site_mails(d: Data) -> DataFrame:
    mails = d.contacts.where("kind = 'email'").select(F.col("source_url").alias("site"), (F.col("contact_id") % 4).alias("page"), F.col("contact_id").alias("pos"), F.lower("value_raw").alias("email"))
    return sites.site_mails(mails)


@query("site_profiles", "SELECT source_url AS site, arg_min(concat('f', contact_id % 4), contact_id % 4) FILTER (contact_id % 4 % 2 = 1) AS facebook, arg_min(concat('i', contact_id % 4), contact_id % 4) FILTER (contact_id % 4 > 1) AS instagram FROM contacts GROUP BY 1")
def site_profiles(d: Data) -> DataFrame:
    page = F.col("contact_id") % 4
    named = lambda letter, when: F.when(when, F.concat(F.lit(letter), page.cast("string")))
    return sites.site_profiles(d.contacts.select(F.col("source_url").alias("site"), page.alias("page"), named("f", page % 2 == 1).alias("facebook"), named("i", page > 1).alias("instagram")))


@query("shared_sites", "SELECT business_id, concat('https://', h, '.pk/') AS site, n FROM (SELECT business_id, concat('s', business_id % 20) AS h FROM businesses WHERE business_id % 3 = 0) JOIN (SELECT concat('https://s', business_id % 20, '.pk/') AS site, count(*) AS n FROM businesses GROUP BY 1) ON site = concat('https://', h, '.pk/')")
def shared_sites(d: Data) -> DataFrame:
    """One crawl a domain, whatever the spelling of the businesses that name it."""
    host = F.concat(F.lit("s"), (F.col("business_id") % 20).cast("string"), F.lit(".pk"))
    named = d.businesses.withColumn("website", F.when(F.col("business_id") % 3 != 0, F.lit("")).when(F.col("business_id") % 2 == 0, host).otherwise(F.concat(F.lit("https://"), host, F.lit("/#x"))))
    found = d.businesses.groupBy(F.concat(F.lit("https://"), host, F.lit("/")).alias("site")).agg(F.count("*").alias("n"))
    return sites.on_businesses(found, named).select("business_id", "site", "n")


MERGE = f"""
fnd AS (SELECT business_id + contact_id % 2 AS business_id, value_e164 AS e164, max(value_raw) AS raw, max(CASE WHEN contact_id % 4 = 0 THEN NULL ELSE line_type END) AS line_type, max(CAST(contact_id % 5 AS DOUBLE) / 4) AS wa_evidence, max(CAST(contact_id % 7 AS DOUBLE) / 8) AS confidence, max(person_name) AS person_name FROM contacts WHERE {_NUMBERS} AND contact_id % 3 = 0 GROUP BY 1, 2),
own AS (SELECT *, CASE WHEN {_NUMBERS} AND contact_id = max(CASE WHEN {_NUMBERS} THEN contact_id END) OVER (PARTITION BY business_id, value_e164) THEN value_e164 END AS k FROM (SELECT * REPLACE (CASE WHEN contact_id % 6 = 0 THEN NULL WHEN contact_id % 6 = 1 THEN 'unknown' ELSE line_type END AS line_type) FROM contacts)),
met AS (
  SELECT coalesce(o.business_id, f.business_id) AS business_id, contact_id, coalesce(value_e164, e164) AS value_e164, contact_id IS NOT NULL AS old, f.e164 IS NOT NULL AS found, o.wa_evidence AS w, o.confidence AS c, o.line_type AS l, o.person_name AS p, o.belongs_to AS bt, o.source AS s, f.*  EXCLUDE (business_id, e164)
  FROM own o FULL OUTER JOIN fnd f ON o.business_id = f.business_id AND k = e164)"""


def merge_findings(d: Data) -> DataFrame:
    n = F.col("contact_id")
    null = F.lit(None).cast("string")
    found = d.contacts.where(_NUMBERS + " AND contact_id % 3 = 0").groupBy((F.col("business_id") + n % 2).alias("business_id"), F.col("value_e164").alias("e164"))
    return found.agg(F.max("value_raw").alias("raw"), F.max(F.when(n % 4 == 0, null).otherwise(F.col("line_type"))).alias("line_type"), F.max((n % 5) / 4).alias("wa_evidence"), F.max((n % 7) / 8).alias("confidence"), F.max("person_name").alias("person_name")).withColumns({"operator": null, "evidence_url": null, "source_url": null})


def gapped(d: Data) -> DataFrame:
    n = F.col("contact_id")
    return d.contacts.withColumn("line_type", F.when(n % 6 == 1, "unknown").when(n % 6 != 0, F.col("line_type")))


_MERGED = "SELECT business_id, contact_id, value_e164, CASE WHEN NOT old THEN round({wa}, 2) WHEN found AND {wa} > coalesce(w, 0) THEN round({wa}, 2) ELSE w END AS wa_evidence, CASE WHEN NOT old OR (found AND confidence > coalesce(c, 0)) THEN round(confidence, 2) ELSE c END AS confidence, CASE WHEN NOT old THEN line_type WHEN {typed} THEN line_type ELSE l END AS line_type, CASE WHEN NOT old THEN person_name WHEN found AND coalesce(person_name, '') <> '' AND coalesce(p, '') = '' THEN person_name ELSE p END AS person_name, CASE WHEN NOT old THEN CASE WHEN person_name IS NOT NULL THEN 'owner' ELSE 'business' END WHEN found AND coalesce(person_name, '') <> '' AND coalesce(p, '') = '' AND coalesce(bt, 'business') = 'business' THEN 'owner' ELSE bt END AS belongs_to, coalesce(s, '{source}') AS source, CASE WHEN NOT old THEN 'added' WHEN found AND ({wa} > coalesce(w, 0) OR confidence > coalesce(c, 0) OR {typed} OR (coalesce(person_name, '') <> '' AND coalesce(p, '') = '')) THEN 'upgraded' ELSE 'kept' END AS change FROM met"
_TYPED = {False: "(found AND l IS NULL AND line_type IS NOT NULL)", True: "(found AND (l IS NULL OR l = 'unknown') AND line_type IS NOT NULL AND line_type <> 'unknown')"}
_SHOWN = ("business_id", "contact_id", "value_e164", "wa_evidence", "confidence", "line_type", "person_name", "belongs_to", "source", "change")


@query("site_merge", _MERGED.format(wa="wa_evidence", typed=_TYPED[False], source="business_website"), ctes=MERGE)
def site_merge(d: Data) -> DataFrame:
    return sites.merged_phones(gapped(d), merge_findings(d), "business_website").select(*_SHOWN)


@query("social_merge", _MERGED.format(wa="wa_evidence", typed=_TYPED[True], source="facebook"), ctes=MERGE)
def social_merge(d: Data) -> DataFrame:
    return sites.merged_phones(gapped(d), merge_findings(d), "facebook", unknown_is_gap=True).select(*_SHOWN)


@query("enrichment_counters", "SELECT count_if(change = 'added') AS added, count_if(change = 'upgraded') AS upgraded, count_if(linked) AS people_linked FROM (SELECT *, CASE WHEN old THEN found AND coalesce(person_name, '') <> '' AND coalesce(p, '') = '' ELSE person_name IS NOT NULL END AS linked, CASE WHEN NOT old THEN 'added' WHEN found AND (wa_evidence > coalesce(w, 0) OR confidence > coalesce(c, 0) OR " + _TYPED[False] + " OR (coalesce(person_name, '') <> '' AND coalesce(p, '') = '')) THEN 'upgraded' ELSE 'kept' END AS change FROM met)", ctes=MERGE)
def enrichment_counters(d: Data) -> DataFrame:
    merged = sites.merged_phones(gapped(d), merge_findings(d), "business_website")
    return merged.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "upgraded").alias("upgraded"), F.count_if("linked").alias("people_linked"))


@query("mail_merge", "SELECT business_id, email AS value_raw FROM (SELECT b.business_id, m.email, m.place FROM (SELECT business_id, business_id % 40 AS s FROM businesses) b JOIN (SELECT CAST(regexp_extract(source_url, '([0-9]+)$', 1) AS BIGINT) AS s, lower(value_raw) AS email, row_number() OVER (PARTITION BY source_url ORDER BY min(contact_id)) AS place FROM contacts WHERE kind = 'email' GROUP BY source_url, lower(value_raw)) m USING (s)) x LEFT JOIN (SELECT business_id, list(DISTINCT lower(value_raw)) AS have FROM contacts WHERE kind = 'email' GROUP BY 1) h USING (business_id) WHERE place <= 3 - coalesce(len(have), 0) AND NOT coalesce(list_contains(have, email), false)")
def mail_merge(d: Data) -> DataFrame:
    mails = sites.site_mails(d.contacts.where("kind = 'email'").select(F.col("source_url").alias("site"), F.lit(0).alias("page"), F.col("contact_id").alias("pos"), F.lower("value_raw").alias("email")))
    named = d.businesses.select("business_id", F.concat(F.lit("https://example.com/"), (F.col("business_id") % 40).cast("string")).alias("site"))
    return sites.merged_mails(d.contacts, mails.join(named, "site")).select("business_id", "value_raw")


@query("gap_fill", "SELECT business_id, coalesce(b.address, f.address) AS address, coalesce(b.rating, f.rating) AS rating, coalesce(b.review_count, f.review_count) AS review_count, CASE WHEN b.address IS NULL AND f.address IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN b.rating IS NULL AND f.rating IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN b.review_count IS NULL AND f.review_count IS NOT NULL THEN 1 ELSE 0 END AS n_filled FROM businesses b LEFT JOIN (SELECT business_id - 1 AS business_id, address, rating, review_count FROM businesses WHERE business_id % 2 = 0) f USING (business_id)")
def gap_fill(d: Data) -> DataFrame:
    found = d.businesses.where("business_id % 2 = 0").select((F.col("business_id") - 1).alias("business_id"), F.lit(0).alias("place"), "address", "rating", "review_count")
    return sites.filled(d.businesses, found, ["address", "rating", "review_count"]).select("business_id", "address", "rating", "review_count", "n_filled")


@query("profile_targets", "SELECT business_id, CASE WHEN business_id % 2 = 0 THEN 'facebook' ELSE 'instagram' END AS platform FROM businesses WHERE business_id % 2 = 0 OR business_id % 3 = 0")
def profile_targets(d: Data) -> DataFrame:
    url = lambda host: F.concat(F.lit(f"https://{host}.com/"), F.col("business_id").cast("string"))
    b = d.businesses.withColumns({"facebook_url": F.when(F.col("business_id") % 2 == 0, url("facebook")), "instagram_url": F.when(F.col("business_id") % 3 == 0, url("instagram"))})
    return sites.profile_targets(b).select("business_id", "platform")


@query("profile_findings", "SELECT url, e164, CAST(wa_evidence AS DOUBLE) AS wa_evidence, CAST(confidence AS DOUBLE) AS confidence, line_type FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY wa_evidence DESC, confidence DESC, e164) AS o FROM (SELECT concat('u', business_id) AS url, e164, CASE WHEN button THEN 0.9 WHEN near THEN 0.75 WHEN line_type = 'mobile' THEN 0.6 ELSE 0.0 END AS wa_evidence, CASE WHEN button THEN 0.9 ELSE 0.6 END AS confidence, line_type FROM (SELECT business_id, concat('+92300', lpad(CAST(business_id AS VARCHAR), 7, '0')) AS e164, business_id % 2 = 0 AS button, business_id % 3 = 0 AS near, 'mobile' AS line_type FROM businesses UNION ALL SELECT business_id, '+924235772057', business_id % 5 = 0, false, 'landline' FROM businesses))) WHERE o <= 8")
def profile_findings(d: Data) -> DataFrame:
    """Bios with a mobile and a landline; one or the other may stand behind a button too, and a chat's name before the mobile."""
    b = F.col("business_id")
    n = F.lpad(b.cast("string"), 7, "0")
    gap = F.lit(" " + "·" * 60 + " ")
    bio = F.concat(F.when(b % 3 == 0, "WhatsApp ").otherwise("Call "), F.lit("0300 "), n, gap, F.lit("office (042) 35772057"))
    buttons = F.filter(F.array(F.when(b % 2 == 0, F.concat(F.lit("+92300"), n)), F.when(b % 5 == 0, "+924235772057")), lambda x: x.isNotNull())
    profiles = d.businesses.select(F.concat(F.lit("u"), b.cast("string")).alias("url"), F.lit("facebook").alias("platform"), bio.alias("bio"), buttons.alias("buttons")).withColumn("bio_phones", ph.extract_phones("bio"))
    return sites.profile_findings(profiles).select("url", "e164", "wa_evidence", "confidence", "line_type")


_DIR = "dl AS (SELECT s_suppkey AS listing_id, s_suppkey * 3 AS business_id, concat('+92', CAST(3000000000 + (s_suppkey * 11 * 7919) % 500000000 AS VARCHAR)) AS e164 FROM supplier JOIN businesses ON business_id = s_suppkey * 3)"


@query("directory_merge", "SELECT business_id, value_e164, max(wa_evidence) AS wa_evidence, 1 AS n FROM (SELECT c.business_id, value_e164, CASE WHEN e164 IS NOT NULL AND contact_id = last THEN greatest(coalesce(wa_evidence, 0), 0.6) ELSE wa_evidence END AS wa_evidence FROM (SELECT *, max(contact_id) OVER (PARTITION BY business_id, value_e164) AS last FROM contacts WHERE kind = 'phone' AND value_e164 IS NOT NULL) c LEFT JOIN dl ON c.business_id = dl.business_id AND value_e164 = e164 UNION ALL SELECT business_id, e164, 0.6 FROM dl WHERE (business_id, e164) NOT IN (SELECT (business_id, value_e164) FROM contacts WHERE kind = 'phone' AND value_e164 IS NOT NULL)) GROUP BY 1, 2", ctes=_DIR)
def directory_merge(d: Data) -> DataFrame:
    phone = F.struct(F.col("phone").alias("e164"), F.col("phone").alias("raw"), F.lit("mobile").alias("line_type"), F.lit(None).cast("string").alias("operator"))
    listed = d.listings.select("listing_id", F.lit("x").alias("link"), F.array(phone).alias("phones"))
    found = sites.directory_findings(d.listings.select("listing_id", (F.col("listing_id") * 3).alias("business_id")), listed)
    merged = sites.merged_phones(d.contacts, found, "businesslist_pk", confidence_rises=False)
    return merged.where("kind = 'phone' AND value_e164 IS NOT NULL").groupBy("business_id", "value_e164").agg(F.max("wa_evidence").alias("wa_evidence"), F.lit(1).alias("n"))


@query("directory_inserted", "SELECT concat('listing-', s_suppkey) AS key, name, address FROM supplier JOIN businesses ON business_id = s_suppkey * 3 WHERE s_suppkey % 4 <> 0")
def directory_inserted(d: Data) -> DataFrame:
    listed = d.supplier.join(d.businesses, F.col("s_suppkey") * 3 == F.col("business_id")).select(F.col("s_suppkey").alias("listing_id"), "name", "address", "lat", "lng", "rating", "review_count")
    return sites.inserted(listed, listed.where("listing_id % 4 = 0").select("listing_id"), 1, "Lahore", "food").select("key", "name", "address")


@query("backfill", "SELECT contact_id, CASE WHEN kind = 'phone' THEN coalesce(value_e164, '+92' || n) ELSE value_e164 END AS value_e164, line_type, CASE WHEN kind = 'phone' THEN CASE WHEN contact_id % 2 = 0 THEN wa_evidence WHEN line_type IS NULL THEN NULL WHEN line_type = 'mobile' THEN 0.6 ELSE 0.0 END ELSE wa_evidence END AS wa_evidence FROM (SELECT contact_id, kind, value_e164, wa_evidence, n, CASE WHEN kind = 'phone' AND contact_id % 3 = 0 THEN CASE WHEN value_e164 IS NOT NULL OR n IS NOT NULL THEN 'mobile' END ELSE line_type END AS line_type FROM (SELECT *, CASE WHEN kind = 'phone' AND value_e164 IS NULL AND contact_id % 4 <> 0 THEN concat('300', lpad(CAST(contact_id AS VARCHAR), 7, '0')) END AS n FROM (SELECT * REPLACE (CASE WHEN kind = 'email' THEN NULL ELSE value_e164 END AS value_e164) FROM contacts)))")
def backfill(d: Data) -> DataFrame:
    n = F.col("contact_id")
    raw = F.when(n % 4 == 0, "no number").otherwise(F.concat(F.lit("0300-"), F.lpad(n.cast("string"), 7, "0")))
    gaps = d.contacts.withColumns({"value_raw": F.when(F.col("kind") == "phone", raw).otherwise(F.col("value_raw")), "line_type": F.when((F.col("kind") == "phone") & (n % 3 == 0), F.lit(None)).otherwise(F.col("line_type")), "wa_evidence": F.when((F.col("kind") == "phone") & (n % 2 == 1), F.lit(None)).otherwise(F.col("wa_evidence"))})
    return sites.backfilled(gaps).select("contact_id", "value_e164", "line_type", "wa_evidence")


@query("directory_located_near", f"SELECT s_suppkey AS listing_id, count(DISTINCT b.business_id) AS n FROM supplier JOIN businesses a ON a.business_id = s_suppkey * 3 JOIN businesses b ON {_NEAR.replace('a.lat', '(a.lat + 0.0002)')} < 150 WHERE s_suppkey % 3 <> 0 GROUP BY 1")
def directory_located_near(d: Data) -> DataFrame:
    return dedupe.listing_neighbours(d.listings, d.businesses).groupBy("listing_id").agg(F.countDistinct("business_id").alias("n"))


@query("directory_verdicts", why="no token-set similarity in SQL; every outcome is tested on a fixture")
def directory_verdicts(d: Data) -> DataFrame:
    return dedupe.match_listings(d.listings, d.businesses, d.contacts)


@query("shared_profiles", "SELECT b.business_id, c.url FROM (SELECT business_id, concat('https://facebook.com/p', business_id % 12) AS url FROM businesses WHERE business_id % 2 = 0) b JOIN (SELECT DISTINCT concat('https://facebook.com/p', business_id % 9) AS url FROM businesses) c USING (url)")
def shared_profiles(d: Data) -> DataFrame:
    """A profile is read once and serves every business that names it."""
    url = lambda n: F.concat(F.lit("https://facebook.com/p"), (F.col("business_id") % n).cast("string"))
    targets = sites.profile_targets(d.businesses.withColumns({"facebook_url": F.when(F.col("business_id") % 2 == 0, url(12)), "instagram_url": F.lit(None).cast("string")}))
    return sites.on_targets(d.businesses.select(url(9).alias("url")).distinct(), targets).select("business_id", "url")
