"""Lead scores: null-aware weights over what a business's contacts show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
WEIGHTS = {"whatsapp_evidence": 30, "contact_confidence": 25, "person_attribution": 15, "source_agreement": 10, "business_signal": 10, "completeness": 10}
QUALIFIED = 60
REVIEW_SATURATION = 200


def ceiling(unavailable: tuple[str, ...]) -> int:
    """The most that a score can be while some terms have no source."""
    return sum(w for term, w in WEIGHTS.items() if term not in unavailable)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def contact_signals() -> list[Column]:
    """What the score reads of a business's contacts, as aggregates. Sets of a business's sources and numbers are small."""
    phone = F.col("kind") == "phone"
    return [
        F.max(F.when(phone, F.coalesce("wa_evidence", F.lit(0.0)))).alias("wa"),
        F.max(F.when(phone, F.coalesce("confidence", F.lit(0.0)))).alias("conf"),
        F.max(F.when(phone & (F.col("person_name") != ""), F.coalesce("confidence", F.lit(0.0)))).alias("person"),
        F.size(F.collect_set("source")).cast("bigint").alias("n_sources"),
        F.bool_or(~phone).alias("has_email"),
        (F.size(F.collect_set(F.when(phone & (F.col("value_e164") != ""), F.col("value_e164")))) >= 2).alias("has_second_phone"),
        F.bool_or(phone & (F.col("line_type") == "mobile")).alias("has_mobile"),
        F.bool_or(phone).alias("has_phone"),
    ]


def signals(businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """Each business with maxima and counts over its contacts; one without contacts keeps its row."""
    return businesses.join(contacts.groupBy("business_id").agg(*contact_signals()), "business_id", "left")


def terms(table: DataFrame) -> DataFrame:
    """Adds the six terms, the share of its weight that the business signal carries, and its basis. Missing inputs leave the weight out."""
    table = table.fillna({"wa": 0.0, "conf": 0.0, "person": 0.0, "n_sources": 0, "has_email": False, "has_second_phone": False, "has_mobile": False, "has_phone": False})
    rating = clamp((F.col("rating") - 1.0) / 4.0)
    reviews = F.when(F.col("review_count") <= 0, 0.0).otherwise(clamp(F.log10(1.0 + F.col("review_count")) / F.log10(F.lit(1.0 + REVIEW_SATURATION))))
    has_r, has_n = F.col("rating").isNotNull(), F.col("review_count").isNotNull()
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    present = sum((c.cast("int") for c in (filled("website"), F.col("has_email"), F.col("has_second_phone"))), filled("address").cast("int"))
    return table.withColumns(
        {
            "t_whatsapp": clamp(F.col("wa")), "t_confidence": clamp(F.col("conf")), "t_person": clamp(F.col("person")),
            "t_agreement": F.when(F.col("n_sources") >= 2, 1.0).otherwise(0.0),
            "t_signal": F.when(has_r & has_n, 0.5 * rating + 0.5 * reviews).when(has_r, rating).when(has_n, reviews),
            "signal_share": F.when(has_r & has_n, 1.0).when(has_r | has_n, 0.5).otherwise(0.0),
            "basis": F.when(has_r & has_n, "rating_and_reviews").when(has_r, "rating_only").when(has_n, "reviews_only").otherwise("none"),
            "t_completeness": present / F.lit(4.0),
        }
    )


def scored(businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """Adds lead_score (0 to 100, halves to even) and qualified."""
    return with_score(signals(businesses, contacts))


def with_score(table: DataFrame) -> DataFrame:
    """scored() of a table that has the aggregates of contact_signals() already."""
    w = WEIGHTS
    t = terms(table)
    applied = F.lit(float(sum(w.values()) - w["business_signal"])) + w["business_signal"] * F.col("signal_share")
    earned = (
        w["whatsapp_evidence"] * F.col("t_whatsapp") + w["contact_confidence"] * F.col("t_confidence") + w["person_attribution"] * F.col("t_person")
        + w["source_agreement"] * F.col("t_agreement") + w["business_signal"] * F.col("signal_share") * F.coalesce("t_signal", F.lit(0.0)) + w["completeness"] * F.col("t_completeness")
    )
    out = t.withColumn("lead_score", F.bround(F.round(100.0 * earned / applied, 9)).cast("int"))
    return out.withColumn("qualified", (F.col("lead_score") >= QUALIFIED) & F.col("has_mobile"))


def report(scores: DataFrame) -> DataFrame:
    """Counts of a scored frame, one row a basis."""
    one = lambda c: F.count_if(c)
    return scores.groupBy("basis").agg(F.count("*").alias("businesses"), one(F.col("qualified")).alias("qualified"), one(F.col("has_phone")).alias("with_phone"), one(F.col("has_mobile")).alias("with_mobile"), one(F.col("n_sources") >= 2).alias("agreeing"), one(F.col("person") > 0).alias("with_person"))


def order_statistics(scores: DataFrame) -> DataFrame:
    """Mean to one place, and the order statistics at positions int(n * share), from counts of the at most 101 different scores."""
    from pyspark.sql import Window

    levels = scores.groupBy("lead_score").agg(F.count("*").alias("c"))  # 101 rows at the most
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = levels.withColumns({"upto": F.sum("c").over(Window.orderBy("lead_score")), "n": F.sum("c").over(whole)})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("lead_score")))
    n = F.col("n")
    return run.agg(
        F.round(F.sum(F.col("lead_score") * F.col("c")) / F.sum("c"), 1).alias("mean"), at(F.floor(n * 0.1)).alias("p10"), at(F.floor(n / 2)).alias("median"),
        at(F.least(n - 1, F.floor(n * 0.9))).alias("p90"), F.max("lead_score").alias("max"),
    )
