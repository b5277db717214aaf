"""The extraction ledger: what was handed out, and to suppress what must not be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import registrable_domain
from tallyfold.operators.rank import wa_label


#: How many businesses a pull may take; None takes all.
SIZES = (30, 50, 100)


def extractable_numbers(phones: DataFrame) -> DataFrame:
    """(business_id, numbers): ranked messageable numbers in order of rank, each once."""
    able = phones.where(F.col("rank").isNotNull() & wa_label(F.col("wa_evidence")).isin("confirmed", "likely"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("value_e164", "value_raw").alias("n")))), lambda x: x.n)
    return able.groupBy("business_id").agg(F.array_distinct(ordered).alias("numbers"))


def marked(view: DataFrame, ledger: DataFrame) -> DataFrame:
    """The view with `extracted`: whether the ledger has the row's business."""
    return view.join(ledger.select("business_id").distinct().withColumn("extracted", F.lit(True)), "business_id", "left").withColumn("extracted", F.coalesce("extracted", F.lit(False)))


def pulled(view: DataFrame, ledger: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` rows of the view that the ledger doesn't have, by score, with what they are to be sent; also those without a number."""
    if limit is not None and limit not in SIZES:
        raise ValueError(f"a pull takes {', '.join(map(str, SIZES))} businesses or all, not {limit}")
    new = marked(view, ledger).where("NOT extracted").drop("extracted")
    return new if limit is None else new.orderBy(F.desc_nulls_last("lead_score"), F.asc("business_id")).limit(limit)


def extract(view: DataFrame, ledger: DataFrame, limit: int | None) -> DataFrame:
    """What a pull hands out: (business_id, lead_score, batch, numbers joined by |)."""
    return pulled(view, ledger, limit).select("business_id", "lead_score", "batch", F.array_join("sendable", "|").alias("numbers"))


def entries(pull: DataFrame, pull_id: str, limit: int | None, at: Column) -> DataFrame:
    """Ledger rows of a pull: every business of it, with its batch and numbers as sent; a pull of all has no size."""
    size = F.lit(limit).cast("int")
    return pull.select("business_id", "run_id", F.lit(pull_id).alias("batch_id"), size.alias("batch_size"), "batch", F.col("sendable").alias("numbers"), at.alias("extracted_at"))


def pull_metrics(view: DataFrame, ledger: DataFrame, limit: int | None) -> DataFrame:
    """One row: marked, skipped (on the ledger already), without_numbers, numbers (distinct ones), remaining, and whether the view ran dry."""
    taken = pulled(view, ledger, limit)
    sums = taken.agg(F.count("*").alias("marked"), F.count_if(F.size("sendable") == 0).alias("without_numbers"))
    numbers = taken.select(F.explode("sendable").alias("n")).agg(F.countDistinct("n").alias("numbers"))
    seen = marked(view, ledger).agg(F.count_if("extracted").alias("skipped"), F.count_if(~F.col("extracted")).alias("open"))
    one = sums.join(numbers).join(seen)  # a row each
    dry = F.col("marked") == 0 if limit is None else F.col("marked") < limit
    return one.select("marked", "skipped", "without_numbers", "numbers", (F.col("open") - F.col("marked")).alias("remaining"), dry.alias("ran_dry"))


def clipboard(pull: DataFrame) -> DataFrame:
    """One row: the distinct numbers of a pull, one a line, in the order in which they were met. It is for one reader, so it is one text."""
    each = pull.select((-F.coalesce("lead_score", F.lit(-1))).alias("s"), "business_id", F.posexplode("sendable").alias("pos", "n"))
    first = each.groupBy("n").agg(F.min(F.struct("s", "business_id", "pos")).alias("at"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x.n), "\n").alias("clipboard"))


def append(ledger: DataFrame, pull: DataFrame) -> DataFrame:
    """The ledger with a pull; a business stands in it once, however often it is pulled."""
    return ledger.unionByName(pull.join(ledger.select("business_id"), "business_id", "left_anti"), allowMissingColumns=True)


def listed(ledger: DataFrame, businesses: DataFrame, view: DataFrame, runs: DataFrame, run_ids: tuple[int, ...] = (), batches: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Ledger rows as they are shown, latest first: with their business, their run, and the batch that it has now. Batches are told by the
    recorded one, else by that; the limit counts what the filters leave."""
    entry = ledger if not run_ids else ledger.where(F.col("run_id").isin(*run_ids))
    now = view.select("business_id", F.col("batch").alias("current_batch"), "lead_score")
    wide = entry.join(businesses.select("business_id", F.col("name").alias("business_name"), "city", "category", "website"), "business_id", "left").join(now, "business_id", "left")
    wide = wide.join(runs.select("run_id", F.col("city").alias("run_city"), F.col("category").alias("run_category")), "run_id", "left")
    if batches:
        wide = wide.where(F.coalesce("batch", "current_batch").isin(*batches))
    wide = wide.orderBy(F.desc("extracted_at"), F.desc("business_id"))
    return wide if limit is None else wide.limit(limit)


def clear(ledger: DataFrame, shown: DataFrame) -> DataFrame:
    """The ledger without what is shown: a filtered list clears what it lists and nothing else."""
    return ledger.join(shown.select("business_id"), "business_id", "left_anti")


def suppression_added(known: DataFrame, value_e164: str | None = None, email: str | None = None, domain: str | None = None, reason: str = "") -> DataFrame:
    """The suppression list with one more entry, which needs a key; one that is there already changes nothing."""
    keys = {"value_e164": value_e164, "email": (email or "").strip().lower() or None, "domain": (domain or "").strip().lower() or None}
    if not any(keys.values()):
        raise ValueError("a number, a mail or a domain")
    row = known.sparkSession.createDataFrame([(*keys.values(), reason)], "value_e164 string, email string, domain string, reason string")
    again = row.join(known, [row[k].eqNullSafe(known[k]) for k in keys], "left_anti")
    return known.unionByName(again)


def suppression_removed(known: DataFrame, **keys: str) -> DataFrame:
    hit = F.lit(True)
    for k, v in keys.items():
        hit &= F.coalesce(F.col(k) == v, F.lit(False))
    return known.where(~hit)


def bulk_suppress(chosen: DataFrame, contacts: DataFrame, known: DataFrame) -> DataFrame:
    """New suppression keys of chosen businesses: their numbers and domains that aren't suppressed yet."""
    numbers = contacts.where("kind = 'phone' AND value_e164 <> ''").join(chosen.select("business_id"), "business_id", "left_semi").select(F.lit("number").alias("kind"), F.col("value_e164").alias("key"))
    domains = chosen.select(F.lit("domain").alias("kind"), registrable_domain(F.col("website")).alias("key")).where("key IS NOT NULL")
    return numbers.unionByName(domains).distinct().join(known.select("kind", "key"), ["kind", "key"], "left_anti")


def counts(ledger: DataFrame, view: DataFrame) -> DataFrame:
    """Ledger rows by batch as recorded, else as it is now."""
    recorded = F.col("recorded") if "recorded" in ledger.columns else F.lit(None).cast("string")
    return ledger.withColumn("recorded", recorded).join(view.select("business_id", "batch"), "business_id").groupBy(F.coalesce("recorded", "batch").alias("batch")).agg(F.count("*").alias("n"))
