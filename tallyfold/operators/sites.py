"""Evidence of sites, profiles and directories folded onto businesses and their contacts. Evidence only rises, other fields only fill gaps, nothing is discarded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.phones import national_of
from tallyfold.functions.phones import line_type as line_type_of
from tallyfold.functions.phones import operator as operator_of
from tallyfold.functions.social import destination, near_whatsapp
from tallyfold.functions.text import canonical_website, site_kind
from tallyfold.functions.web import SIGNAL_SCORES
from tallyfold.operators.rank import wa_label

#: How sure a number is by the shape that gave it, strongest first, and how many of what a source may give.
ORIGINS = {"wa_link": 0.95, "widget": 0.95, "jsonld": 0.90, "tel": 0.85, "text": 0.60}
PER_SITE, PER_PROFILE, MAILS = 12, 8, 3
MAIL_CONFIDENCE, BUTTON_CONFIDENCE, BIO_CONFIDENCE, DIRECTORY_CONFIDENCE, PERSON_CONFIDENCE = 0.80, 0.90, 0.60, 0.75, 0.70
FINDING = ("e164", "raw", "line_type", "operator", "wa_evidence", "confidence", "evidence_url", "source_url", "person_name")


def baseline(line_type: Column) -> Column:
    """Evidence of a number that nothing speaks for."""
    return F.when(line_type == "mobile", SIGNAL_SCORES["mobile_only"]).otherwise(SIGNAL_SCORES["none"])


# --- sites --------------------------------------------------------------------------------------


def crawl_order(pages: DataFrame, most: int = 4) -> DataFrame:
    """Of landed pages (site, place, key, confirmed, mails), in the order in which a crawl meets them, those that it reads: no page twice, `most` a
    site, and none after a confirmed number and a mail have been seen."""
    once = pages.withColumn("_n", F.row_number().over(Window.partitionBy("site", "key").orderBy("place"))).where("_n = 1").drop("_n")
    order = Window.partitionBy("site").orderBy("place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.bool_or(c).over(before), F.lit(False))
    told = once.withColumns({"_n": F.row_number().over(order), "_done": seen("confirmed") & seen("mails")})
    return told.where((F.col("_n") <= most) & ~F.col("_done")).drop("_n", "_done")


def site_findings(offers: DataFrame, signals: DataFrame, pages: DataFrame, owners: DataFrame) -> DataFrame:
    """(site, place and FINDING) of the numbers of each site, PER_SITE at the most, strongest first.

    offers has (site, page, pos, url, e164, raw, line_type, operator, origin), a row as often as a shape of a page gives the number; signals
    (site, page, url, e164, score); pages (site, page, url); owners (site, page, pos, e164, name). A number keeps where it was seen first, the
    surest of its origins, and the page of its strongest signal; one that nothing speaks for goes by its line type, at the site's first page.
    """
    rank = F.element_at(F.create_map(*(F.lit(x) for i, o in enumerate(ORIGINS) for x in (o, i))), F.col("origin"))
    sure = F.element_at(F.create_map(*(F.lit(x) for pair in ORIGINS.items() for x in pair)), F.min_by("origin", rank))
    seen = F.struct("page", rank.alias("shape"), "pos")
    first = lambda c: F.min_by(c, seen).alias(c)
    numbers = offers.groupBy("site", "e164").agg(first("raw"), first("line_type"), first("operator"), F.min_by("url", seen).alias("source_url"), sure.alias("confidence"))
    best = signals.groupBy("site", "e164").agg(F.max("score").alias("score"), F.min_by("url", F.struct(-F.col("score"), "page")).alias("url"))
    home = pages.groupBy("site").agg(F.min_by("url", "page").alias("home"))
    person = owners.groupBy("site", "e164").agg(F.min_by("name", F.struct("page", "pos")).alias("person_name"))
    told = numbers.join(home, "site").join(best, ["site", "e164"], "left").join(person, ["site", "e164"], "left")
    low = baseline(F.col("line_type"))
    told = told.withColumns({"wa_evidence": F.greatest(low, F.coalesce("score", F.lit(0.0))), "evidence_url": F.when(F.col("score") > low, F.col("url")).otherwise(F.col("home"))})
    return _strongest(told, "site", PER_SITE)


def _strongest(findings: DataFrame, group: str, most: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc("wa_evidence"), F.desc("confidence"), "e164")
    gaps = {c: F.lit(None).cast("string") for c in FINDING if c not in findings.columns}
    return findings.withColumns({**gaps, "place": F.row_number().over(order)}).where(F.col("place") <= most).select(group, "place", *FINDING)


def site_pages(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """offers, signals, pages and owners of parsed pages (site, page, url, p)."""
    base = parsed.select("site", "page", "url", "p")
    offers = base.select("site", "page", "url", F.posexplode("p.offers").alias("pos", "o")).select("site", "page", "pos", "url", "o.*")
    signals = base.select("site", "page", "url", F.explode("p.numbers").alias("n")).select("site", "page", "url", "n.e164", "n.score")
    owners = base.select("site", "page", F.posexplode("p.owners").alias("pos", "o")).select("site", "page", "pos", "o.*")
    return offers, signals, base.select("site", "page", "url"), owners


def site_mails(mails: DataFrame) -> DataFrame:
    """(site, place, email): each mail of (site, page, pos, email) once, in order of first sight."""
    first = mails.groupBy("site", "email").agg(F.min(F.struct("page", "pos")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("at"))).select("site", "place", "email")


def site_profiles(pages: DataFrame) -> DataFrame:
    """(site, facebook, instagram): the first of each over the pages of a site (site, page, facebook, instagram)."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page"))).alias(c)
    return pages.groupBy("site").agg(first("facebook"), first("instagram"))


def on_businesses(found: DataFrame, businesses: DataFrame) -> DataFrame:
    """What a site (site) gave, for every business whose website it is: one crawl serves all that name it."""
    named = businesses.select("business_id", canonical_website(F.col("website")).alias("site")).where("site IS NOT NULL")
    return found.join(named, "site")


# --- the merge ----------------------------------------------------------------------------------


def merged_phones(contacts: DataFrame, findings: DataFrame, source: str | Column, confidence_rises: bool = True, unknown_is_gap: bool = False) -> DataFrame:
    """Contacts after findings (business_id and FINDING): each number of a business that is there already rises to stronger evidence and
    fills its gaps, a new one comes in. `change` says kept, upgraded or added; `confirmed` and `linked` whether that is what changed.

    A number that stands in several contacts of a business is upgraded in the one with the greatest contact_id. Sources stay as they were.
    """
    source = F.lit(source) if isinstance(source, str) else source
    gaps = {c: F.lit(None).cast("string") for c in ("operator", "person_role", "attribution", "wa_evidence_url") if c not in contacts.columns}
    own = contacts.withColumns(gaps)
    phone = (F.col("kind") == "phone") & F.coalesce(F.col("value_e164") != "", F.lit(False))
    last = F.max(F.when(phone, F.col("contact_id"))).over(Window.partitionBy("business_id", "value_e164"))
    own = own.withColumn("_key", F.when(phone & (F.col("contact_id") == last), F.col("value_e164")))
    new = findings.select("business_id", F.col("e164").alias("_key"), F.struct(*(c for c in FINDING[1:]), source.alias("source")).alias("f"), F.lit(True).alias("_found"))
    both = own.join(new, ["business_id", "_key"], "full_outer")
    old, f = F.col("contact_id").isNotNull(), F.col("f")
    risen = F.coalesce(f.wa_evidence > F.coalesce("wa_evidence", F.lit(0.0)), F.lit(False))
    surer = F.coalesce(f.confidence > F.coalesce("confidence", F.lit(0.0)), F.lit(False)) if confidence_rises else F.lit(False)
    gap = F.col("line_type").isNull() | (F.col("line_type") == "unknown") if unknown_is_gap else F.col("line_type").isNull()
    typed = F.coalesce(gap & f.line_type.isNotNull() & (f.line_type != "unknown" if unknown_is_gap else F.lit(True)), F.lit(False))
    named = F.coalesce((f.person_name != "") & (F.coalesce("person_name", F.lit("")) == ""), F.lit(False))
    owner = F.when(f.person_name.isNotNull(), "owner").otherwise("business")
    up = lambda when, value, c: F.when(~old, value).when(when, value).otherwise(F.col(c)).alias(c)
    changed = {
        "kind": F.coalesce("kind", F.lit("phone")), "value_e164": F.coalesce("value_e164", "_key"), "value_raw": F.coalesce("value_raw", f.raw),
        "wa_evidence": up(risen, F.round(f.wa_evidence, 2), "wa_evidence"), "wa_evidence_url": up(risen, f.evidence_url, "wa_evidence_url"), "confidence": up(surer, F.round(f.confidence, 2), "confidence"),
        "line_type": up(typed, f.line_type, "line_type"), "operator": F.when(~old, f.operator).when(typed, F.coalesce("operator", f.operator) if unknown_is_gap else f.operator).otherwise(F.col("operator")),
        "person_name": up(named, f.person_name, "person_name"), "person_role": up(named, F.when(f.person_name.isNotNull(), "owner"), "person_role"), "attribution": up(named, F.when(f.person_name.isNotNull(), "linked"), "attribution"),
        "belongs_to": F.when(~old, owner).when(named & F.coalesce(F.col("belongs_to") == "business", F.lit(True)), "owner").otherwise(F.col("belongs_to")),
        "source": F.coalesce("source", f.source), "source_url": F.coalesce("source_url", f.source_url),
    }
    confirmed = F.coalesce(f.wa_evidence >= 0.9, F.lit(False))
    marks = {
        "change": F.when(~old, "added").when(F.col("_found") & (risen | surer | typed | named), "upgraded").otherwise("kept"),
        "confirmed": confirmed & (~old | (risen & (wa_label(F.coalesce("wa_evidence", F.lit(0.0))) != "confirmed"))), "linked": F.when(old, named).otherwise(f.person_name.isNotNull()),
    }
    return both.withColumns(changed | marks).drop("_key", "_found", "f")


def merged_mails(contacts: DataFrame, mails: DataFrame, source: str = "business_website") -> DataFrame:
    """Mails (business_id, value_raw, source, confidence, belongs_to, source_url) that come in: of a site's first (business_id, place, email, site), as many as a
    business has room for up to MAILS, those that it has already."""
    have = contacts.where("kind = 'email'").groupBy("business_id").agg(F.collect_set(F.lower("value_raw")).alias("have"))
    room = MAILS - F.coalesce(F.size("have"), F.lit(0))
    new = mails.join(have, "business_id", "left").where((F.col("place") <= room) & ~F.coalesce(F.array_contains("have", F.col("email")), F.lit(False)))
    return new.select("business_id", F.col("email").alias("value_raw"), F.lit(source).alias("source"), F.lit(MAIL_CONFIDENCE).alias("confidence"), F.lit("business").alias("belongs_to"), F.col("site").alias("source_url"))


def filled(businesses: DataFrame, found: DataFrame, fields: list[str], order: str = "place") -> DataFrame:
    """Businesses whose gaps in `fields` are filled from found (business_id, order and the fields): the first value that there is. n_filled counts them."""
    first = found.groupBy("business_id").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in fields))
    wide = businesses.join(first, "business_id", "left")
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    n = sum(((empty(c) & F.col(f"_{c}").isNotNull()).cast("int") for c in fields), F.lit(0))
    return wide.withColumn("n_filled", n).withColumns({c: F.when(empty(c) & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}).drop(*(f"_{c}" for c in fields))


# --- profiles -----------------------------------------------------------------------------------


def profile_targets(businesses: DataFrame, budget: int = 1) -> DataFrame:
    """(business_id, platform, url, place) of the profiles that are read: facebook before instagram, `budget` a business."""
    one = lambda c, name, i: businesses.where(F.coalesce(F.col(c) != "", F.lit(False))).select("business_id", F.lit(name).alias("platform"), F.col(c).alias("url"), F.lit(i).alias("place"))
    every = one("facebook_url", "facebook", 0).unionByName(one("instagram_url", "instagram", 1))
    return every.withColumn("_n", F.row_number().over(Window.partitionBy("business_id").orderBy("place"))).where(F.col("_n") <= budget).drop("_n")


def on_targets(found: DataFrame, targets: DataFrame) -> DataFrame:
    """What a profile (url) gave, for every business whose target it is: one read serves all that name it."""
    return found.join(targets.select("business_id", "platform", "url"), "url")


def profile_findings(profiles: DataFrame) -> DataFrame:
    """(url, place and FINDING) of profiles (url, platform, bio, buttons, bio_phones): buttons before numbers in the bio, each number once, PER_PROFILE at the most."""
    kind = "array<struct<e164:string,raw:string,line_type:string,operator:string,wa_evidence:double,confidence:double>>"
    bio = F.col("bio_phones")
    national = lambda e: national_of(e)

    def button(e: Column) -> Column:
        own = F.get(F.filter(bio, lambda p: p.e164 == e), F.lit(0))
        kind_of = F.coalesce(own.line_type, line_type_of(national(e)), F.lit("unknown"))
        return F.struct(e.alias("e164"), F.coalesce(own.raw, e).alias("raw"), kind_of.alias("line_type"), F.coalesce(own.operator, operator_of(national(e))).alias("operator"), F.lit(SIGNAL_SCORES["platform_button"]).alias("wa_evidence"), F.lit(BUTTON_CONFIDENCE).alias("confidence"))

    def printed(p: Column) -> Column:
        near = near_whatsapp(F.col("bio"), p.start, p.end)
        return F.struct(p.e164.alias("e164"), p.raw.alias("raw"), p.line_type.alias("line_type"), p.operator.alias("operator"), F.when(near, SIGNAL_SCORES["text_proximity"]).otherwise(baseline(p.line_type)).alias("wa_evidence"), F.lit(BIO_CONFIDENCE).alias("confidence"))

    buttons = F.transform(F.array_distinct("buttons"), button)
    rest = F.transform(F.filter(F.slice(bio, 1, PER_PROFILE), lambda p: ~F.array_contains("buttons", p.e164)), printed)
    every = F.concat(F.coalesce(buttons, F.array().cast(kind)), F.coalesce(rest, F.array().cast(kind)))
    found = profiles.select("url", "platform", F.explode(every).alias("x")).select("url", "x.*").withColumns({"evidence_url": F.col("url"), "source_url": F.col("url")})
    return _strongest(found, "url", PER_PROFILE)


def bio_routes(profiles: DataFrame) -> DataFrame:
    """(url, website, facebook_url, instagram_url, destination): the link of each bio in the column that it belongs to."""
    kind, link = site_kind(F.col("bio_link")), F.col("bio_link")
    return profiles.where("bio_link IS NOT NULL").select("url", F.when(kind == "website", canonical_website(link)).alias("website"), F.when(kind == "facebook", link).alias("facebook_url"), F.when(kind == "instagram", link).alias("instagram_url"), destination(link).alias("destination"))


# --- directories --------------------------------------------------------------------------------


def directory_findings(matches: DataFrame, listings: DataFrame) -> DataFrame:
    """(business_id and FINDING) of the phones (array of e164, raw, line_type, operator) of matched listings; of several listings of a business the first by id counts."""
    one = matches.join(listings, "listing_id").select("business_id", "listing_id", F.col("link").alias("source_url"), F.posexplode("phones").alias("pos", "p"))
    first = one.withColumn("_n", F.row_number().over(Window.partitionBy("business_id", "p.e164").orderBy("listing_id", "pos"))).where("_n = 1")
    null = F.lit(None).cast("string")
    return first.select("business_id", "p.e164", "p.raw", "p.line_type", "p.operator", baseline(F.col("p.line_type")).alias("wa_evidence"), F.lit(DIRECTORY_CONFIDENCE).alias("confidence"), null.alias("evidence_url"), "source_url", null.alias("person_name"))


def inserted(listings: DataFrame, matches: DataFrame, run_id: int, city: str, category: str) -> DataFrame:
    """Listings that match no business as businesses of a run, for the runs that want them."""
    rest = listings.join(matches.select("listing_id"), "listing_id", "left_anti")
    return rest.select(F.concat(F.lit("listing-"), "listing_id").alias("key"), F.lit(run_id).cast("bigint").alias("run_id"), "name", F.lit(category).alias("category"), F.lit(city).alias("city"), "address", "lat", "lng", "rating", "review_count")


# --- the later stages ---------------------------------------------------------------------------


def backfilled(contacts: DataFrame) -> DataFrame:
    """Contacts with what their own number tells: number, line type, operator and the floor of evidence, each only where it is missing."""
    if "operator" not in contacts.columns:
        contacts = contacts.withColumn("operator", F.lit(None).cast("string"))
    phone = F.col("kind") == "phone"
    read = F.when(phone & F.col("value_e164").isNull(), national_of(F.col("value_raw")))
    national = F.coalesce(read, F.when(phone, F.regexp_replace("value_e164", r"^\+92", "")))
    fresh = F.when(F.col("line_type").isNull(), F.when(read.isNotNull() & (line_type_of(national) == "unknown"), "landline").otherwise(line_type_of(national)))
    kind = F.coalesce("line_type", fresh)
    return contacts.withColumns({
        "value_e164": F.coalesce("value_e164", F.concat(F.lit("+92"), read)), "line_type": kind, "operator": F.coalesce("operator", F.when(read.isNotNull() | F.col("line_type").isNull(), operator_of(national))),
        "wa_evidence": F.when(phone, F.coalesce("wa_evidence", F.when(kind.isNotNull(), baseline(kind)))).otherwise(F.col("wa_evidence")),
    })
