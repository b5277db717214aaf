"""Evidence folds: it only rises, other fields only fill gaps, and the order of arrival is a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.rank import wa_label


def best_evidence(contacts: DataFrame) -> DataFrame:
    """Per number the strongest evidence, where it was seen first, and its label."""
    seen = contacts.where("kind = 'phone' AND value_e164 IS NOT NULL")
    best = seen.groupBy("value_e164").agg(F.max("wa_evidence").alias("wa_evidence"), F.max("confidence").alias("confidence"), F.min_by("source_url", F.struct(-F.col("wa_evidence"), "contact_id")).alias("evidence_url"), F.min_by("source_url", "contact_id").alias("source_url"))
    return best.withColumn("label", wa_label(F.col("wa_evidence")))


def upgraded(existing: DataFrame, findings: DataFrame) -> DataFrame:
    """Contacts (business_id, value_e164, wa_evidence, confidence, source) after findings: evidence and confidence rise, the source stays, new numbers come in."""
    on = ["business_id", "value_e164"]
    new = findings.groupBy(*on).agg(F.max("wa_evidence").alias("new_wa"), F.max("confidence").alias("new_conf"), F.min("source").alias("new_source"))
    old = existing.groupBy(*on).agg(F.max("wa_evidence").alias("wa"), F.max("confidence").alias("conf"), F.min("source").alias("source"))
    both = old.join(new, on, "full_outer")
    return both.select(*on, F.greatest("wa", "new_wa").alias("wa_evidence"), F.greatest("conf", "new_conf").alias("confidence"), F.coalesce("source", "new_source").alias("source"))


def ingest_fold(arrivals: DataFrame, key: list[str], fields: list[str], order: str = "arrival") -> DataFrame:
    """One row a key: of each field the first value that isn't null, in order of arrival."""
    return arrivals.groupBy(*key).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields), F.count("*").alias("n_arrivals"))


def capped(findings: DataFrame, group: str, cap: int, *order) -> DataFrame:
    """The first `cap` findings of each group: 12 numbers a site, 8 a profile, 3 mails a business, 4 pages a domain."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
