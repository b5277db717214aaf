"""Duplicates: blocked pairs, verdicts, components, survivors; and the match of directory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.fuzzy import similarity
from tallyfold.functions.geo import cell, haversine, is_near
from tallyfold.functions.text import conflicting, normalise_name, registrable_domain

#: Which tier a pair keeps when several propose it.
TIERS = ("place_id", "exact_phone", "domain", "fuzzy_name_geo")


def _pairs(keys: DataFrame, tier: str) -> DataFrame:
    """Pairs of businesses of one run that share a key."""
    a, b = keys.alias("a"), keys.alias("b")
    on = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.business_id") < F.col("b.business_id"))
    return a.join(b, on).select(F.col("a.run_id").alias("run_id"), F.col("a.business_id").alias("a"), F.col("b.business_id").alias("b"), F.lit(tier).alias("tier"))


def near_pairs(businesses: DataFrame) -> DataFrame:
    """Pairs of one run nearer than 150 m: the right side stands in nine cells, so equal cells find every pair once."""
    at = businesses.where("lat IS NOT NULL AND lng IS NOT NULL").select("run_id", "business_id", "lat", "lng", cell(F.col("lat")).alias("x"), cell(F.col("lng")).alias("y"))
    around = at.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    around = around.withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})
    a, b = at.alias("a"), around.alias("b")
    on = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.business_id") < F.col("b.business_id"))
    near = is_near(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    return a.join(b, on & near).select(F.col("a.run_id").alias("run_id"), F.col("a.business_id").alias("a"), F.col("b.business_id").alias("b"), F.lit("fuzzy_name_geo").alias("tier"))


def proposals(businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """All proposed pairs of all tiers, a pair as often as it is proposed."""
    runs = businesses.select("business_id", "run_id")
    phones = contacts.where("kind = 'phone' AND value_e164 <> ''").select("business_id", F.col("value_e164").alias("key")).join(runs, "business_id")
    places = businesses.where("place_id <> ''").select("business_id", "run_id", F.col("place_id").alias("key"))
    domains = businesses.where("website <> ''").select("business_id", "run_id", registrable_domain(F.col("website")).alias("key")).where("key IS NOT NULL")
    return _pairs(phones, "exact_phone").unionAll(_pairs(places, "place_id")).unionAll(_pairs(domains, "domain")).unionAll(near_pairs(businesses))


def candidates(businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """Each pair once with its strongest tier."""
    order = F.create_map(*(F.lit(x) for i, t in enumerate(TIERS) for x in (t, i)))
    return proposals(businesses, contacts).groupBy("run_id", "a", "b").agg(F.min_by("tier", F.element_at(order, F.col("tier"))).alias("tier"))


def merge_candidates(businesses: DataFrame, contacts: DataFrame) -> DataFrame:
    """The pairs of candidates() that can be merged, without those that distance rejects anyway, so a chain of branches with one phone makes no pairs of
    all its branches. Places are tied to their least business: whoever shares a place ends in one group all the same."""
    places = businesses.where("place_id <> ''").select("run_id", "place_id", "business_id")
    least = places.groupBy("run_id", "place_id").agg(F.min("business_id").alias("a"))
    stars = places.join(least, ["run_id", "place_id"]).where("a < business_id").select("run_id", "a", F.col("business_id").alias("b"), F.lit("place_id").alias("tier"))
    near = near_pairs(businesses).drop("tier")
    phones = contacts.where("kind = 'phone' AND value_e164 <> ''").select("business_id", "value_e164").distinct()
    side = lambda s: phones.select(F.col("business_id").alias(s), "value_e164")
    shared = near.join(side("a"), "a").join(side("b"), ["b", "value_e164"]).select("run_id", "a", "b").distinct().withColumn("phone", F.lit(True))
    site = lambda s: businesses.select(F.col("business_id").alias(s), registrable_domain(F.col("website")).alias(f"{s}_domain"))
    wide = near.join(shared, ["run_id", "a", "b"], "left").join(site("a"), "a").join(site("b"), "b")
    tier = F.when(F.col("phone"), "exact_phone").when(F.col("a_domain") == F.col("b_domain"), "domain").otherwise("fuzzy_name_geo")
    return stars.unionByName(wide.select("run_id", "a", "b", tier.alias("tier")))


def verdicts(pairs: DataFrame, businesses: DataFrame, fuzzy: int = 88, corroborated: int = 75) -> DataFrame:
    """Pairs with their verdict. Names go to the similarity only where place and segment let a pair through; the pairs are read once."""
    side = lambda s: businesses.select(F.col("business_id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("lat", "lng")), normalise_name(F.col("name")).alias(f"{s}_name"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b")
    early = F.when(F.col("tier") == "place_id", "merge").when(~is_near(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")), "rejected_distance").when(conflicting(F.col("a_name"), F.col("b_name")), "rejected_segment")
    wide = wide.withColumn("early", early)
    asked = [F.when(F.col("early").isNull(), F.col(f"{s}_name")) for s in "ab"]  # others are given as null and cost nothing
    bar = F.when(F.col("tier").isin("exact_phone", "domain"), corroborated).otherwise(fuzzy)
    named = F.when(similarity(*asked) >= bar, "merge").otherwise("rejected_name")
    return wide.select("run_id", "a", "b", "tier", F.coalesce("early", named).alias("verdict"))


def components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, component) over edges (a, b): each node takes the least label around it and that label's own label, until none changes.
    Labels jump, so a chain needs rounds in the order of its logarithm; after `rounds` an error says that labels aren't final."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = _cut(both)
    labels = _cut(both.select(F.col("a").alias("node")).distinct().withColumns({"component": F.col("node"), "changed": F.lit(True)}))
    for _ in range(rounds):
        if labels.where("changed").isEmpty():
            return labels.drop("changed")
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(around, labels.node == around.a).select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        least = F.least(F.coalesce("next", "component"), "component")
        labels = _cut(lower.join(jump, "component", "left").select("node", least.alias("component"), (least != F.col("old")).alias("changed")))
    raise RuntimeError(f"components not final after {rounds} rounds")


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of the session; a temporary one only where none is set and the master is local."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp())
    return df.checkpoint()


GAPS = ("address", "area", "city", "category", "subcategory", "lat", "lng", "place_id", "website", "facebook_url", "instagram_url", "rating", "review_count")


def survivors(businesses: DataFrame, contacts: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a group: the richest member, its gaps filled from the others in order of richness, and whom it took in."""
    count = contacts.groupBy("business_id").agg(F.count("*").alias("n_contacts"))
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("lat", "lng", "place_id", "website", "rating", "review_count", "area")), F.col("address").isNotNull().cast("int"))
    table = groups.join(businesses, groups.node == businesses.business_id).join(count, "business_id", "left").withColumn("filled", filled)
    order = [F.coalesce("n_contacts", F.lit(0)).desc(), F.desc("filled"), F.col("arrival"), F.col("business_id").desc()]
    best = table.withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy(*order)))
    gap = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in GAPS if c in businesses.columns]
    lost = F.array_sort(F.collect_list(F.when(F.col("place") > 1, F.struct("place", "business_id"))))
    out = best.groupBy("component").agg(F.min_by("business_id", "place").alias("survivor"), F.min_by("name", "place").alias("name"), *gap, F.transform(lost, lambda x: x.business_id).alias("merged_from"))
    return out


def moved_contacts(contacts: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """All contacts, those of absorbed businesses under the survivor; none is lost."""
    to = groups.join(kept.select("component", "survivor"), "component").select(F.col("node").alias("business_id"), "survivor")
    return contacts.join(to, "business_id", "left").withColumn("business_id", F.coalesce("survivor", "business_id")).drop("survivor")


def match_unlocated(listings: DataFrame, contacts: DataFrame) -> DataFrame:
    """Listings without coordinates whose phone belongs to exactly one business."""
    met = listings.where("lat IS NULL").join(contacts.where("kind = 'phone'").select("business_id", F.col("value_e164").alias("phone")).distinct(), "phone")
    return met.groupBy("listing_id").agg(F.countDistinct("business_id").alias("n"), F.min("business_id").alias("business_id")).where("n = 1").select("listing_id", "business_id")


def listing_neighbours(listings: DataFrame, businesses: DataFrame) -> DataFrame:
    """Listings with coordinates beside each business nearer than 150 m, found by equal cells of a grid; b_name and name are normalised."""
    three = F.array(*map(F.lit, (-1, 0, 1)))
    at = businesses.where("lat IS NOT NULL AND lng IS NOT NULL").select("business_id", normalise_name(F.col("name")).alias("b_name"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), cell(F.col("lat")).alias("x"), cell(F.col("lng")).alias("y"))
    around = listings.where("lat IS NOT NULL AND lng IS NOT NULL").select("listing_id", normalise_name(F.col("name")).alias("name"), "lat", "lng").withColumn("dx", F.explode(three)).withColumn("dy", F.explode(three))
    around = around.withColumns({"x": cell(F.col("lat")) + F.col("dx"), "y": cell(F.col("lng")) + F.col("dy")})
    return around.join(at, ["x", "y"]).where(haversine(F.col("lat"), F.col("lng"), F.col("b_lat"), F.col("b_lng")) < 150.0).select("listing_id", "business_id", "name", "b_name")


def match_located(listings: DataFrame, businesses: DataFrame, contacts: DataFrame, fuzzy: int = 88, corroborated: int = 75) -> DataFrame:
    """(listing_id, business_id, tier, refusal) of each listing with coordinates: the business of the most similar name within 150 m; a shared
    phone lowers the bar. Of equals the first business counts. Without a match, why."""
    shares = listings.join(contacts.where("kind = 'phone'").select("business_id", F.col("value_e164").alias("phone")).distinct(), "phone").select("listing_id", "business_id").distinct().withColumn("shares", F.lit(True))
    near = listing_neighbours(listings, businesses).join(shares, ["listing_id", "business_id"], "left").withColumns({"shares": F.coalesce("shares", F.lit(False)), "conflict": conflicting(F.col("name"), F.col("b_name"))})
    asked = [F.when(~F.col("conflict"), F.col(c)) for c in ("name", "b_name")]
    rated = near.withColumn("ratio", similarity(*asked))
    enough = ~F.col("conflict") & (F.col("ratio") >= F.when(F.col("shares"), corroborated).otherwise(fuzzy))
    per = rated.groupBy("listing_id").agg(F.max_by(F.struct("business_id", "shares"), F.when(enough, F.struct("ratio", -F.col("business_id")))).alias("m"), F.bool_or("conflict").alias("conflict"))
    every = listings.where("lat IS NOT NULL AND lng IS NOT NULL").select("listing_id").join(per, "listing_id", "left")
    tier = F.when(F.col("m").isNotNull(), F.when(F.col("m.shares"), "corroborated_geo").otherwise("fuzzy_name_geo"))
    refusal = F.when(F.col("m").isNull(), F.when(F.col("conflict").isNull(), "rejected_distance").when(F.col("conflict"), "rejected_segment").otherwise("rejected_name"))
    return every.select("listing_id", "m.business_id", tier.alias("tier"), refusal.alias("refusal"))


def match_listings(listings: DataFrame, businesses: DataFrame, contacts: DataFrame, fuzzy: int = 88, corroborated: int = 75) -> DataFrame:
    """(listing_id, business_id, tier, refusal) of every listing (listing_id, name, lat, lng, phone): by place and name, or, without
    coordinates, by a phone that one business alone has."""
    met = listings.where("lat IS NULL OR lng IS NULL").select("listing_id", "phone").join(contacts.where("kind = 'phone'").select("business_id", F.col("value_e164").alias("phone")).distinct(), "phone", "left")
    per = met.groupBy("listing_id").agg(F.countDistinct("business_id").alias("n"), F.min("business_id").alias("b"))
    one = F.col("n") == 1
    lone = per.select("listing_id", F.when(one, F.col("b")).alias("business_id"), F.when(one, "phone_unlocated").alias("tier"), F.when(F.col("n") == 0, "no_candidate").when(~one, "ambiguous").alias("refusal"))
    return match_located(listings, businesses, contacts, fuzzy, corroborated).unionByName(lone)
