"""Contact ranking per business by preference. A row without rank is kept but holds no slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wa_label(evidence: Column) -> Column:
    return F.when(evidence >= 0.9, "confirmed").when(evidence >= 0.6, "likely").otherwise("no")


def _tier(preference: str) -> Column:
    mobile, named = F.coalesce(F.col("line_type") == "mobile", F.lit(False)), F.coalesce(F.col("person_name") != "", F.lit(False))
    confirmed = mobile & (wa_label(F.coalesce("wa_evidence", F.lit(0.0))) == "confirmed")
    if preference == "owner_first":
        return F.when(named, 0).when(confirmed, 1).when(mobile, 2).otherwise(3)
    if preference == "business_first":
        main = F.coalesce(F.col("belongs_to") == "business", F.lit(True)) & ((F.col("line_type") == "uan") | (F.col("source") == "google_maps"))
        return F.when(main, 0).when(confirmed, 1).when(named, 2).otherwise(3)
    return F.lit(0)


def ranked(contacts: DataFrame, preference: str = "owner_first") -> DataFrame:
    """Phones with `rank`: dense over kept rows, one for each number; whatsapp_only leaves out numbers without evidence."""
    return ranked_beside(contacts.where("kind = 'phone'"), preference)


def ranked_beside(contacts: DataFrame, preference: str = "owner_first") -> DataFrame:
    """All contacts with `rank` as in ranked(); other kinds than phones have none."""
    phone = F.col("kind") == "phone"
    phones = contacts.withColumn("tier", _tier(preference))
    in_slot = phone if preference != "whatsapp_only" else phone & F.coalesce(F.col("wa_evidence") > 0, F.lit(False))
    line = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(("mobile", "uan", "landline", "toll_free", "unknown")) for x in (k, i))), F.col("line_type")), F.lit(9))
    order = [F.col("tier"), F.coalesce("wa_evidence", F.lit(0.0)).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), line, F.coalesce("value_e164", F.lit("")), F.col("contact_id")]
    number = F.when(F.coalesce("value_e164", F.lit("")) != "", F.col("value_e164"))
    marked = phones.withColumn("in_slot", in_slot).repartition("business_id")  # once for both windows and for what is grouped afterwards
    again = F.row_number().over(Window.partitionBy("business_id", "in_slot", number).orderBy(*order)) > 1
    marked = marked.withColumn("keeps", F.col("in_slot") & ~(number.isNotNull() & again))
    place = F.row_number().over(Window.partitionBy("business_id", "keeps").orderBy(*order))
    return marked.withColumn("rank", F.when(F.col("keeps"), place)).drop("keeps", "in_slot", "tier")
