"""The one read path: suppression, contacts of a row, filters, collapse over runs, batches, sort and page. Every sink takes its output."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import fold, national_digits, registrable_domain
from tallyfold.operators import export
from tallyfold.operators.rank import ranked_beside, wa_label
from tallyfold.operators.score import contact_signals, with_score

#: Fixed values.
BATCHES = ("delivery-nosite", "delivery-site", "cafe-nosite", "cafe-site", "reputation", "early-stage", "no-whatsapp", "unbatched")
DINE_IN = ("art cafe", "bakery", "bar", "buffet restaurant", "cafe", "coffee shop", "dessert restaurant", "dessert shop", "hookah bar", "ice cream shop", "steak house")
SORTABLE = ("lead_score", "business_name", "rating", "review_count", "phone_count", "area", "category", "scraped_at")


@dataclass(frozen=True)
class ResultQuery:
    """What a reader asks for; empty means all."""

    runs: tuple[int, ...] = ()
    has_website: bool | None = None
    min_score: int | None = None
    labels: tuple[str, ...] = ()
    line_types: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    has_person: bool | None = None
    search: str = ""
    batches: tuple[str, ...] = ()
    sort: str = "lead_score"
    descending: bool = True
    collapse: bool = True
    offset: int = 0
    limit: int | None = None
    unknown_batches: tuple[str, ...] = field(default=())


def visible_contacts(contacts: DataFrame, numbers: DataFrame, emails: DataFrame) -> DataFrame:
    """Contacts without suppressed numbers and mails. The lists stay joins, so they may be of any size."""
    mail = F.when(F.col("kind") == "email", F.lower(F.trim("value_raw")))
    left = contacts.join(numbers.select("value_e164"), "value_e164", "left_anti").withColumn("email", mail)
    return left.join(emails.select("email"), "email", "left_anti").drop("email")


def visible_businesses(businesses: DataFrame, contacts: DataFrame, visible: DataFrame, domains: DataFrame) -> DataFrame:
    """Businesses of no suppressed domain, but for those that had phones and lost them all; one that never had a phone stays."""
    had = contacts.where("kind = 'phone'").select("business_id").distinct().withColumn("had", F.lit(True))
    has = visible.where("kind = 'phone'").select("business_id").distinct().withColumn("has", F.lit(True))
    kept = businesses.withColumn("domain", registrable_domain(F.col("website"))).join(domains.select("domain"), "domain", "left_anti").drop("domain")
    return kept.join(had, "business_id", "left").join(has, "business_id", "left").where("had IS NULL OR has").drop("had", "has")


def clean_number(number: Column) -> Column:
    digits = F.regexp_replace(number, "[^0-9+]", "")
    return F.when(F.length(digits) >= 10, digits)


def wa_pick(phones: DataFrame) -> DataFrame:
    """(business_id, wa_number, wa_confidence): the best ranked number to message; ties go to the better rank."""
    label = wa_label(F.col("wa_evidence"))
    number = F.coalesce(clean_number(F.col("value_e164")), clean_number(F.col("value_raw")))
    score = F.when(label == "confirmed", 2).otherwise(1) + F.coalesce(F.col("line_type") == "mobile", F.lit(False)).cast("int") + F.coalesce(F.col("belongs_to") == "business", F.lit(False)).cast("int")
    able = phones.where(F.col("rank").isNotNull() & label.isin("confirmed", "likely")).withColumns({"n": number, "l": label, "s": score}).where("n IS NOT NULL")
    best = able.groupBy("business_id").agg(F.max_by(F.struct("n", "l"), F.struct("s", -F.col("rank"))).alias("b"))
    return best.select("business_id", F.col("b.n").alias("wa_number"), F.col("b.l").alias("wa_confidence"))


def batch() -> Column:
    """First match wins. A null review count is low volume; a null rating is no bad one."""
    site = F.coalesce(F.trim("website") != "", F.lit(False))
    dine = F.coalesce(fold(F.col("subcategory")).isin(*DINE_IN), F.lit(False))
    return (
        F.when(F.coalesce(fold(F.col("category")) != "food", F.lit(True)), "unbatched").when(F.col("wa_number").isNull(), "no-whatsapp")
        .when(F.col("review_count").isNull() | (F.col("review_count") < 200), "early-stage").when(F.col("rating") < 4.0, "reputation")
        .when(dine & site, "cafe-site").when(dine, "cafe-nosite").when(site, "delivery-site").otherwise("delivery-nosite")
    )


def marked(contacts: DataFrame, numbers: DataFrame, emails: DataFrame) -> DataFrame:
    """Contacts with `hidden`, true for suppressed numbers and mails. The lists are joined once, so they may be of any size."""
    mail = F.when(F.col("kind") == "email", F.lower(F.trim("value_raw")))
    flagged = lambda df, c: df.select(F.col(c).alias(f"_{c}"), F.lit(True).alias(f"_hit_{c}")).distinct()
    out = contacts.withColumn("email", mail)
    out = out.join(flagged(numbers, "value_e164"), F.col("value_e164") == F.col("_value_e164"), "left").join(flagged(emails, "email"), F.col("email") == F.col("_email"), "left")
    return out.withColumn("hidden", F.coalesce("_hit_value_e164", "_hit_email", F.lit(False))).drop("email", "_email", "_value_e164", "_hit_email", "_hit_value_e164")


def facts(contacts: DataFrame, preference: str = "owner_first") -> DataFrame:
    """One row a business with all that reads its contacts (of marked()): what its score needs, whether phones are left, and of the visible
    ones the slots, the number to message, pipes and sets. One exchange: ranks and groups go by business_id."""
    phone, seen = F.col("kind") == "phone", ~F.col("hidden")
    table = ranked_beside(contacts, preference).withColumns({"number": F.coalesce("value_e164", "value_raw"), "label": wa_label(F.col("wa_evidence")), "clean": F.coalesce(clean_number(F.col("value_e164")), clean_number(F.col("value_raw")))})
    urls = [c for c in ("source_url", "wa_evidence_url") if c in contacts.columns]
    per = table.groupBy("business_id").agg(
        *contact_signals(), F.collect_set("source").alias("any_sources"), F.bool_or(phone).alias("had"), F.bool_or(phone & seen).alias("has"),
        export.held(table.columns, seen).alias("held"), F.max(F.when(seen, F.col("scraped_at"))).alias("scraped_at"),
        F.array_sort(F.collect_set(F.when(seen, F.col("source")))).alias("sources"), export.pipe(["source"], "contact_id", seen).alias("sources_pipe"), export.pipe(urls, "contact_id", seen).alias("evidence_urls"),
        F.min_by("value_raw", F.when(seen & (F.col("kind") == "email"), F.col("contact_id"))).alias("email"),
    )
    of = lambda field: F.transform("held", lambda x: x[field])
    able = F.filter("held", lambda x: x.label.isin("confirmed", "likely"))
    score = lambda x: F.when(x.label == "confirmed", 2).otherwise(1) + F.coalesce(x.line_type == "mobile", F.lit(False)).cast("int") + F.coalesce(x.belongs_to == "business", F.lit(False)).cast("int")
    best = F.array_max(F.transform(F.filter(able, lambda x: x.clean.isNotNull()), lambda x: F.struct(score(x).alias("s"), (-x["rank"]).alias("r"), x.clean.alias("n"), x.label.alias("l"))))
    person = F.get(F.filter("held", lambda x: x.person_name != ""), F.lit(0))
    named = {"person_name": "contact_person", "person_role": "contact_role", "attribution": "attribution"}
    return per.withColumns({
        **export.slots("held"), "numbers": of("number"), "sendable": F.array_distinct(F.transform(able, lambda x: x.number)), "labels": F.array_distinct(of("label")), "line_types": F.array_distinct(of("line_type")),
        "phone_count": F.size(F.array_distinct(of("number"))).cast("bigint"), "wa_number": best["n"], "wa_confidence": best["l"], **{to: person[c] for c, to in named.items() if c in contacts.columns},
    }).drop("held")


def matches(query: ResultQuery) -> Column:
    """Filters that read the row. A null score fails a bound."""
    ok = F.lit(True)
    if query.runs:
        ok &= F.col("run_id").isin(*query.runs)
    if query.has_website is not None:
        blank = F.coalesce(F.col("website") == "", F.lit(True))
        ok &= ~blank if query.has_website else blank
    if query.min_score is not None:
        ok &= F.coalesce(F.col("lead_score") >= query.min_score, F.lit(False))
    for column, wanted in (("labels", query.labels), ("line_types", query.line_types), ("any_sources", query.sources)):
        if wanted:
            ok &= F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, wanted))), F.lit(False))
    if query.has_person is not None:
        ok &= F.col("contact_person").isNotNull() == query.has_person
    if needle := query.search.strip().lower():
        texts = F.array("business_name", "address", "area", "city", "website", "contact_person")
        found = F.exists(F.concat(texts, F.coalesce("numbers", F.array().cast("array<string>"))), lambda x: F.coalesce(F.contains(F.lower(x), F.lit(needle)), F.lit(False)))
        digits = "".join(c for c in needle if c.isdigit())
        if len(digits) >= 4:
            bare = digits[2:] if digits.startswith("92") else digits.removeprefix("0")
            found |= F.coalesce(F.exists("numbers", lambda x: F.contains(national_digits(x), F.lit(bare))), F.lit(False))
        ok &= found
    return ok


def collapsed(table: DataFrame) -> DataFrame:
    """One row of each place over all runs: best score, then most phones, then latest; rows without a place all stay, each as a place of its own."""
    order = [F.when(F.coalesce("lead_score", F.lit(0)) == 0, -1).otherwise(F.col("lead_score")).desc(), F.desc("phone_count"), F.desc_nulls_last("scraped_at"), F.col("business_id")]
    place = F.struct(F.col("place_id").alias("place"), F.when(F.col("place_id").isNull(), F.col("business_id")).alias("row"))
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(place).orderBy(*order))).where("_n = 1").drop("_n")


def sort_order(query: ResultQuery) -> list[Column]:
    key = query.sort if query.sort in SORTABLE else "lead_score"
    column = F.lower(key) if key in ("business_name", "area", "category") else F.col(key)
    return [column.desc_nulls_last() if query.descending else column.asc_nulls_last(), F.col("business_id").asc()]


def view(table: DataFrame, query: ResultQuery) -> DataFrame:
    """Rows of the query before its page: filtered, collapsed, of the batches asked for. An unknown batch gives no row, never all."""
    out = table.where(matches(query))
    out = collapsed(out) if query.collapse else out
    if query.batches or query.unknown_batches:
        out = out.where(F.col("batch").isin(*query.batches) if query.batches else F.lit(False))
    return out


def page(table: DataFrame, query: ResultQuery) -> DataFrame:
    out = view(table, query).orderBy(*sort_order(query)).offset(query.offset)
    return out if query.limit is None else out.limit(query.limit)


def batch_counts(table: DataFrame) -> DataFrame:
    """All batches, also those with no row."""
    spark = table.sparkSession
    every = spark.createDataFrame([(b,) for b in BATCHES], "batch string")
    return every.join(table.groupBy("batch").agg(F.count("*").alias("n")), "batch", "left").select("batch", F.coalesce("n", F.lit(0)).alias("n"))


def send_ranks(table: DataFrame) -> DataFrame:
    """Place of a row in its batch by reviews, then score, then id; rows outside the batches have none.

    No task sorts a batch: rows of equal reviews and score are numbered among themselves, after all that counts say lie before.
    """
    level = ["batch", "review_count", "lead_score"]
    sent = F.col("batch") != "unbatched"
    down = Window.partitionBy("batch").orderBy(F.desc_nulls_last("review_count"), F.desc_nulls_last("lead_score")).rowsBetween(Window.unboundedPreceding, -1)
    before = table.where(sent).groupBy(*level).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0))).select(*(F.col(c).alias(f"_{c}") for c in level), "before")
    alone = F.when(~sent, F.col("business_id"))  # rows without a place don't meet in one task
    own = F.row_number().over(Window.partitionBy(*level, alone).orderBy("business_id"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in level]
    return table.withColumn("_own", own).join(before, same, "left").select(*table.columns, F.when(sent, F.col("before") + F.col("_own")).cast("int").alias("send_rank"))


def visible_view(businesses: DataFrame, contacts: DataFrame, numbers: DataFrame, emails: DataFrame, domains: DataFrame, preference: str = "owner_first") -> DataFrame:
    """One row a business that is shown, with its score (over all contacts), its visible phones and its batch. Businesses, contacts and each list are read once."""
    kept = businesses.withColumn("domain", registrable_domain(F.col("website"))).join(domains.select("domain"), "domain", "left_anti").drop("domain")
    wide = with_score(kept.join(facts(marked(contacts, numbers, emails), preference), "business_id", "left"))
    wide = wide.where("had IS NULL OR NOT had OR has").drop("had", "has").withColumnRenamed("name", "business_name")
    return wide.withColumns({"phone_count": F.coalesce("phone_count", F.lit(0)), "sendable": F.coalesce("sendable", F.array().cast("array<string>"))}).withColumn("batch", batch())
