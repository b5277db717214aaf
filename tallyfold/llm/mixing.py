"""Mixing sources to target weights by Pareto order sampling (Rosen 1997)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.scratch import drop, settle

BINS = 1 << 12
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(seed: int, *columns: str) -> Column:
    """A number strictly between 0 and 1 from a hash of the columns: the same on each run and however rows are dealt."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources take the weights in turn, by code point, null last, and share `share` times all sizes by weight. A target stops
    at `most` times its source's size; the rest is shared again among the others, until none is above. Sources are filled
    in the order in which they reach that bound, so one pass over a running sum finds all of them.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    order = Window.orderBy("ratio", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.withColumn("bound", most * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    placed = placed.withColumns({"left": share * F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)), "weights": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    placed = placed.withColumn("level", F.col("left") / F.col("weights")).withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(every)
    return placed.withColumn("free", level).select("source", "source_size", F.when(F.col("full"), F.col("bound")).otherwise(F.col("weight") * F.col("free")).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("tie"), uniform(seed, "doc_id").alias("u"))


def _odds(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with whole copies, and as q the random odds over the odds of inclusion in one copy more; a document of no words has no q."""
    joined = docs.join(plan.withColumnRenamed("source", "of"), _same("source", "of"), "left").drop("of")
    p = F.least(F.col("scale") * F.pow("size", F.lit(0.5)), F.lit(1 - 1e-9))
    q = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.col("u") / (1 - F.col("u")) / (p / (1 - p)))
    return joined.withColumn("q", q).withColumn("at", F.col("q") / (1 + F.col("q")))


def plan(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Per source: source_size, target, copies that each document has for certain, and the last (q, tie) that gets one copy more.

    Inclusion probabilities are scaled to the square root of the size, so that their expected words are what the whole
    copies leave of the target. The words wanted are taken in the order of q. Where the running sum reaches them is found
    by histograms of q, twice refined, so no task sorts a source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.floor(F.pow("size", F.lit(1.5)))).alias("powers"))
    aims = targets(sums.select("source", "source_size"), weights, share, most)
    aims = aims.join(sums.select(F.col("source").alias("of"), "powers"), _same("source", "of")).drop("of")
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(most))).otherwise(0)
    aims = aims.withColumn("copies", copies.cast("bigint")).withColumn("rest", F.when(F.col("copies") >= most, F.lit(0.0)).otherwise(F.col("target") - F.col("copies") * F.col("source_size")))
    aims = settle(aims.withColumn("scale", F.when(F.col("powers") > 0, F.col("rest") / F.col("powers"))))
    ranked = _odds(sized, aims).where("q IS NOT NULL")
    low, width, found = F.lit(0.0), 1.0, aims.select("source", "rest", F.lit(0.0).alias("low"), F.lit(0.0).alias("below"))
    for _ in range(2):  # the bin in which the running sum passes the words wanted
        width /= BINS
        inside = ranked.select("source", "size", "at").join(found.withColumnRenamed("source", "of"), _same("source", "of") & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("low") + width * BINS))
        bins = inside.groupBy("source", "low", "below", "rest", F.least(F.floor((F.col("at") - F.col("low")) / width), F.lit(BINS - 1)).alias("bin")).agg(F.sum("size").alias("words"))
        up = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("after", F.col("below") + F.sum("words").over(up)).where(F.col("after") >= F.col("rest"))
        first = bins.groupBy("source").agg(F.min_by(F.struct("rest", (F.col("low") + F.col("bin") * width).alias("low"), (F.col("after") - F.col("words")).cast("double").alias("below")), "bin").alias("x"))
        found = settle(first.select("source", "x.rest", "x.low", "x.below"))
    inside = ranked.select("source", "size", "at", "q", "tie", "doc_id").join(found.withColumnRenamed("source", "of"), _same("source", "of") & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("low") + width))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("q", "tie").rowsBetween(Window.unboundedPreceding, 0))
    # The document at which the sum passes the target is taken if that comes nearer to it.
    fits = F.col("below") + F.col("run") - F.col("size") / 2 <= F.col("rest")
    last = inside.withColumn("run", run).where(fits).groupBy("source").agg(F.max(F.struct("q", "tie")).alias("last"))
    cut = found.select(F.col("source").alias("of"), "low").join(last, _same("of", "source"), "left").select("of", F.coalesce(F.col("last.q"), F.col("low") / (1 - F.col("low"))).alias("last_q"), F.coalesce(F.col("last.tie"), F.lit(-(1 << 63))).alias("last_tie"), F.lit(True).alias("cut"))
    out = settle(aims.join(cut, _same("source", "of"), "left").drop("of"))
    drop(aims, found)
    return out


def _taken(docs: DataFrame, aims: DataFrame) -> DataFrame:
    ranked = _odds(docs, aims)
    before = F.struct("q", "tie") <= F.struct(F.col("last_q").alias("q"), F.col("last_tie").alias("tie"))
    more = F.when(F.col("q").isNotNull() & (F.col("cut").isNull() | before), 1).otherwise(0)
    return ranked.withColumn("n_copies", F.coalesce(F.col("copies"), F.lit(0)) + more)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, seed: int = 8) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source).

    taken is 0, 1 or 2 times the size in words. Null and empty texts have size 0 and take 0; a null source is a source of
    its own; repeated rows are ranked alike and so taken alike; an empty table gives an empty one; other columns are
    ignored. Sources are ranked in one task: one row a source, whatever the documents. A source's taken words differ from its
    target by half a document at most, however long, unless copies of one row meet there.
    """
    sized = settle(_sized(docs, seed))
    aims = plan(sized, weights, share)
    return _taken(sized, aims).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, seed: int = 8) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs, whatever their names. Texts are not shuffled.

    Null and empty texts are taken never, a null doc_id is ranked as an id of its own, repeated rows are taken alike, and an
    empty table gives an empty one. Very long texts count whole: one that meets the cut of its source may miss the target by
    half its size.
    """
    sized = settle(_sized(docs, seed))
    aims = plan(sized, weights, share)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    chosen = _taken(rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), size_of(F.col("row.text")).alias("size"), F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.col("row.text")).alias("tie"), (F.pmod(F.xxhash64(F.lit(seed), F.col("row.doc_id")), F.lit(1 << 52)).cast("double") + 0.5).alias("u0")).withColumn("u", F.col("u0") / float(1 << 52)), aims)
    drop(sized)
    return chosen.where("n_copies > 0").select(F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy"), "row").select("row.*")
