"""Breakers, source health, run states, estimates and plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(events: DataFrame, group: str, failed: Column, least: int = 3, slot: str = "1 hour") -> DataFrame:
    """Runs of at least `least` failures in a row of each group, as islands between other events.

    How many other events lie before an event is counted slot by slot of time and within its slot, so no task sorts a whole group.
    """
    marked = events.withColumns({"bad": failed, "slot": F.window("ts", slot).start})
    other = F.when(~F.col("bad"), 1).otherwise(0)
    slots = marked.groupBy(group, "slot").agg(F.sum(other).alias("n"))  # a row a slot
    before = slots.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.sum(other).over(Window.partitionBy(group, "slot").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    islands = marked.withColumn("within", within).where("bad").join(before, [group, "slot"]).withColumn("island", F.col("before") + F.col("within"))
    return islands.groupBy(group, "island").agg(F.count("*").alias("length"), F.min("ts").alias("first_ts")).where(F.col("length") >= least).select(group, "first_ts", "length")


def refused_from(visits: DataFrame, most: int = 10) -> DataFrame:
    """(source, at): when a source is given up, at the `most`-th refusal in a row of visits (source, place, refused, pages); a page clears the row,
    a visit that is neither leaves it."""
    order = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    marked = visits.withColumn("cleared", F.sum(F.when(~F.col("refused") & (F.col("pages") > 0), 1).otherwise(0)).over(order))
    row = marked.where("refused").withColumn("n", F.row_number().over(Window.partitionBy("source", "cleared").orderBy("place")))
    return row.where(F.col("n") == most).groupBy("source").agg(F.min("place").alias("at"))


#: Successes in a row without yield that open a source's breaker, where it isn't the usual number.
EMPTIES = {"business_website": 25}


class Breaker:
    """Three failures in a row, five successes in a row without yield, or any block open it for half an hour; attempts meanwhile are not made."""

    def __init__(self, failures: int = 3, empties: int = 5, pause: float = 1800.0, state: tuple = (0, 0, None)) -> None:
        self.limits, self.pause = (failures, empties), pause
        self.failed, self.empty, self.until = state

    def see(self, at: float, kind: str) -> str:
        if self.until is not None and at < self.until:
            return "skipped"
        if kind == "failure":
            self.failed += 1
        elif kind != "blocked":
            self.failed, self.empty = 0, self.empty + 1 if kind == "empty" else 0
        if kind == "blocked" or kind == "failure" and self.failed >= self.limits[0] or kind == "empty" and self.empty >= self.limits[1]:
            self.until = at + self.pause
            return "tripped"
        return "throttled" if self.failed else "ok"

    def status(self, at: float, spent: int = 0, budget: int | None = None) -> str:
        """What the source is now: open for its pause, out of budget, throttled after a failure, or ok."""
        if self.until is not None and at < self.until:
            return "circuit_open"
        if budget is not None and spent >= budget:
            return "blocked"
        return "throttled" if self.failed else "ok"

    @property
    def state(self) -> tuple:
        return self.failed, self.empty, self.until


def breaker(events: DataFrame) -> DataFrame:
    """(source, event_id, ts, outcome) of events (source, event_id, ts, kind), in order of time within a source.

    Events go through in sorted batches and a source's state is all that is kept; a source's own events are a sequence, so one task takes them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, source = None, None
        for frame in frames:
            out = []
            for s, t, kind in zip(frame.source, frame.ts, frame.kind, strict=True):
                if own is None or s != source:
                    own, source = Breaker(empties=EMPTIES.get(s, 5)), s
                out.append(own.see(t.timestamp(), kind))
            yield frame.assign(outcome=out)[["source", "event_id", "ts", "outcome"]]

    kind = events.schema["source"].dataType.simpleString()
    dealt = events.select("source", "event_id", "ts", "kind").repartition("source").sortWithinPartitions("source", "ts", "event_id")
    return dealt.mapInPandas(run, f"source {kind}, event_id bigint, ts timestamp, outcome string")


def source_health(reports: DataFrame) -> DataFrame:
    """blocked before refused before failed before ok."""
    state = F.when(F.col("blocked") > 0, "blocked").when((F.col("refused") > 0) & (F.col("ok") == 0), "circuit_open").when(F.col("failed") > 0, "throttled").otherwise("ok")
    return reports.withColumn("status", state)


def run_status(stages: DataFrame) -> DataFrame:
    """State of each run from its stages: cancelled if one was, running while one is, queued before any has begun; failed if all failed, partial
    if some did or fell short, else done."""
    has = lambda *states: F.count_if(F.col("state").isin(*states))
    per = stages.groupBy("run_id").agg(F.count("*").alias("n"), has("failed").alias("bad"), has("failed", "partial").alias("short"), has("running").alias("open"), has("queued").alias("queued"), has("cancelled").alias("cancelled"))
    left = F.col("n") - F.col("queued")
    return per.select("run_id", F.when(F.col("cancelled") > 0, "cancelled").when(F.col("open") > 0, "running").when(left == 0, "queued").when(F.col("queued") > 0, "running").when(F.col("bad") == F.col("n"), "failed").when(F.col("short") > 0, "partial").otherwise("done").alias("status"))


#: Stages in order, and from how many sites and profiles on nothing found means that something broke.
STAGES = ("discovery", "contact_enrichment", "social_enrichment", "person_attribution", "normalise_score", "dedupe_export")
FLOORS = {"sites": 20, "profiles": 15}


def degraded(report: DataFrame) -> DataFrame:
    """Reports (stage, ok, failed, phones, refused, blocked, asked, answered, listings, with_phone) with `reason`, null for a stage that did its work."""
    c = F.col
    web, social, directory = (c("stage") == s for s in ("contact_enrichment", "social_enrichment", "directories"))
    reason = (
        F.when(web & (c("ok") >= FLOORS["sites"]) & (c("phones") == 0), "zero_yield").when(web & (c("blocked") > 0), "blocked")
        .when(social & (c("ok") >= FLOORS["profiles"]) & (c("phones") == 0), "zero_yield").when(social & (c("ok") + c("failed") >= FLOORS["profiles"]) & (c("ok") == 0), "nothing_rendered")
        .when(social & (c("refused") > 0), "refused").when(social & (c("blocked") > 0), "blocked")
        .when(directory & (c("blocked") > 0), "blocked").when(directory & (c("refused") > 0), "refused").when(directory & (c("asked") > 0) & (c("answered") == 0), "no_answer").when(directory & (c("listings") > 0) & (c("with_phone") == 0), "zero_phone_yield")
    )
    return report.withColumn("reason", reason)


def planned_stages(flags: Column) -> Column:
    """Stages that a run goes through by its map of sources: discovery and websites unless switched off, profiles only where asked for."""
    on = lambda name, usual: F.coalesce(F.try_element_at(flags, F.lit(name)), F.lit(usual))
    chosen = F.array(F.when(on("google_maps", True), "discovery"), F.when(on("business_website", True) | on("directories", False), "contact_enrichment"), F.when(on("facebook", False) | on("instagram", False), "social_enrichment"), F.lit("normalise_score"), F.lit("dedupe_export"))
    return F.filter(chosen, lambda s: s.isNotNull())


def progress(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """(run_id, stage, state, processed, produced, elapsed) of every stage of runs (run_id, sources, current): failed, running, done, pending or skipped."""
    stages = F.posexplode(F.array(*map(F.lit, STAGES))).alias("place", "stage")
    every = runs.select("run_id", "current", planned_stages(F.col("sources")).alias("planned"), stages).join(reports, ["run_id", "stage"], "left")
    state = F.when(F.col("failed"), "failed").when(F.col("current") == F.col("stage"), "running").when(F.col("processed").isNotNull(), "done").when(F.array_contains("planned", F.col("stage")), "pending").otherwise("skipped")
    return every.select("run_id", "place", "stage", state.alias("state"), "processed", "produced", "elapsed")


def stage_sums(results: DataFrame) -> DataFrame:
    """One row a run and stage: the sums of what its inputs report, and their notes together; a later input's note replaces an earlier one's."""
    sums = [F.sum(c).alias(c) for c in ("processed", "produced", "skipped", "failed")]
    notes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("note", "value"))))
    last = results.withColumn("_last", F.row_number().over(Window.partitionBy("run_id", "stage", "note").orderBy(F.desc("place"))))
    kept = last.where("_last = 1 AND note IS NOT NULL").groupBy("run_id", "stage").agg(notes.alias("notes"))
    return results.groupBy("run_id", "stage").agg(*sums).join(kept, ["run_id", "stage"], "left")


def prior_ranges(runs: DataFrame) -> DataFrame:
    """Per (city, category) what earlier runs (status, businesses, qualified, enriched) found: the range of businesses, and of qualified ones over enriched
    runs alone, since others have none by their nature. Runs that aren't over don't count."""
    over = runs.where(~F.col("status").isin("queued", "running"))
    some = lambda f, c, when: f(F.when(when, F.col(c)))
    has, rich = F.col("businesses") > 0, F.col("enriched")
    return over.groupBy("city", "category").agg(F.count("*").alias("runs"), some(F.min, "businesses", has).alias("low"), some(F.max, "businesses", has).alias("high"), some(F.min, "qualified", rich).alias("qualified_low"), some(F.max, "qualified", rich).alias("qualified_high"))


def spread(value: Column) -> Column:
    """Greatest over least of the positive values, 1 if there are fewer than two, as an aggregate."""
    positive = F.when(value > 0, value)
    return F.when(F.count(positive) < 2, 1.0).otherwise(F.max(positive) / F.min(positive))


def query_plan(tiles: DataFrame, words: DataFrame) -> DataFrame:
    """Every search word in every tile of a city: a product of two configuration tables."""
    return tiles.join(words, F.lit(True)).select("city", "tile", "word", F.concat("word", F.lit(" in "), "tile", F.lit(", "), "city").alias("query"))


def seconds_per_query(runs: DataFrame) -> DataFrame:
    """Range of measured runs of two queries or more; one run is widened, none gives the documented figure."""
    ok = runs.where("queries >= 2 AND elapsed > 1").select((F.col("elapsed") / F.col("queries")).alias("s"))
    a = ok.agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
    return a.select(F.when(F.col("n") == 0, 12 * 0.8).when(F.col("n") == 1, F.col("low") * 0.7).otherwise(F.col("low")).alias("low"), F.when(F.col("n") == 0, 12 * 1.25).when(F.col("n") == 1, F.col("high") * 1.5).otherwise(F.col("high")).alias("high"), F.when(F.col("n") == 0, "doc_projection").when(F.col("n") == 1, "measured_single_run").otherwise("measured").alias("basis"))


def runtime(per_query: DataFrame, queries: int, businesses: int) -> DataFrame:
    """Seconds of a run: its queries, and 32 % of businesses with a site at 5 s and 28 % with a profile at 19 s, these give or take 40 %."""
    more = businesses * (0.32 * 5 + 0.28 * 19)
    return per_query.select((F.col("low") * queries + more * 0.6).alias("low"), (F.col("high") * queries + more * 1.4).alias("high"))


def confirmation_rates(runs: DataFrame) -> DataFrame:
    """Share of crawled sites with a confirmed number per city and category, of the first run that has one."""
    ok = runs.where("crawled > 0")
    return ok.groupBy("city", "category").agg(F.min_by(F.round(F.col("confirmed") / F.col("crawled"), 3), "run_id").alias("rate"))
