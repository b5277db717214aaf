"""What a reader asks for, from the text of a request to a page of the view: batches by name, queries, totals, facets, and an export with its name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import export
from tallyfold.operators.results import SORTABLE, ResultQuery, collapsed, matches, sort_order, view


class Batch(NamedTuple):
    id: str
    slug: str
    name: str
    priority: int | None


#: The batches in the order in which they are worked, by which tokens they go, and what stands outside.
CATALOGUE = (
    Batch("B01", "delivery-nosite", "Commission Escape", 1), Batch("B02", "delivery-site", "Ordering Layer", 2), Batch("B03", "cafe-nosite", "Café First Presence", 3),
    Batch("B04", "cafe-site", "Café Content & Booking", 4), Batch("B06", "reputation", "Feedback Loop", 5), Batch("B05", "early-stage", "Starter Setup", 6), Batch("B00", "no-whatsapp", "Unreachable — Email/Visit", None),
)
UNBATCHED = "unbatched"
_TOKENS = {token: b.slug for b in CATALOGUE for token in (b.slug, b.id.lower())} | {UNBATCHED: UNBATCHED}
FACETS = ("category", "subcategory", "area", "city")


def catalogue(spark: SparkSession) -> DataFrame:
    """(id, slug, name, send_priority, sendable)"""
    return spark.createDataFrame([(*b, b.priority is not None) for b in CATALOGUE], "id string, slug string, name string, send_priority int, sendable boolean")


def batch_of(token: str) -> str | None:
    """The slug that a token means: a slug, an id as B01, or unbatched, in any case."""
    return _TOKENS.get(token.strip().lower())


def listed(text: str | None) -> tuple[str, ...]:
    return tuple(part for raw in (text or "").split(",") if (part := raw.strip()))


def parse(params: Mapping[str, str | Sequence[str]]) -> ResultQuery:
    """The query that request parameters mean. Unknown batches are an error, since taking them for none or for all would show another
    view; an unknown sort column means the usual one."""
    one = lambda key: params[key] if isinstance(params.get(key), str) else None
    flag = lambda key: {"true": True, "1": True, "false": False, "0": False}.get((one(key) or "").lower())
    number = lambda key, least, most: None if one(key) is None else _bounded(key, int(one(key)), least, most)
    tokens = {t: batch_of(t) for t in listed(one("batch"))}
    if unknown := [t for t, slug in tokens.items() if slug is None]:
        raise ValueError(f"unknown batches: {', '.join(unknown)}; known: {', '.join([*(b.slug for b in CATALOGUE), UNBATCHED])}")
    runs = params.get("run") or ()
    return ResultQuery(
        runs=tuple(int(r) for r in ([runs] if isinstance(runs, str) else runs)), has_website=flag("has_website"), min_score=number("min_score", 0, 100), labels=listed(one("whatsapp")), line_types=listed(one("line_type")),
        sources=listed(one("source")), has_person=flag("has_owner_name"), search=one("q") or "", batches=tuple(dict.fromkeys(tokens.values())), sort=one("sort") if one("sort") in SORTABLE else "lead_score",
        descending=(one("order") or "desc") == "desc", collapse=bool(flag("collapse")), offset=number("offset", 0, 1 << 31) or 0, limit=number("limit", 1, 1000),
    )


def _bounded(key: str, value: int, least: int, most: int) -> int:
    if not least <= value <= most:
        raise ValueError(f"{key} is {value}, not from {least} to {most}")
    return value


def facet_values(shown: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, place, value): the distinct values of each facet in the order in which the view, by score, meets them."""
    met = F.struct((-F.coalesce("lead_score", F.lit(-1))).alias("s"), F.col("business_id").alias("b"))
    each = shown.select(met.alias("at"), F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets))).alias("x")).where("x.value <> ''")
    first = each.groupBy("x.facet", "x.value").agg(F.min("at").alias("at"))
    values = first.groupBy("facet").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x.value).alias("values"))
    return values.select("facet", F.posexplode("values").alias("place", "value"))


def counters(table: DataFrame, query: ResultQuery) -> DataFrame:
    """One row: rows that match, rows that collapsing hides, rows left in the batches asked for."""
    found = table.where(matches(query))
    shown = collapsed(found) if query.collapse else found
    wanted = F.col("batch").isin(*query.batches) if query.batches else F.lit(True)
    a = found.agg(F.count("*").alias("matched"))
    b = shown.agg(F.count("*").alias("shown"), F.count_if(wanted).alias("total"))
    return a.join(b).select("matched", (F.col("matched") - F.col("shown")).alias("collapsed"), "total")  # a row each


def results_page(table: DataFrame, query: ResultQuery, columns: tuple[str, ...] = tuple(export.COMPACT)) -> DataFrame:
    """One row (json): a page of the view as {rows, total, facets}. A page has a limit, so its rows fit one text."""
    if query.limit is None:
        raise ValueError("a page has a limit")
    order = sort_order(query)
    table = table.withColumns({c: F.lit(None).cast("string") for c in columns if c not in table.columns})
    page = view(table, query).orderBy(*order).offset(query.offset).limit(query.limit)
    numbered = page.withColumn("_at", F.monotonically_increasing_id())  # a limited result is one sorted partition
    rows = numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct("business_id", *columns).alias("row")))), lambda x: x.row).alias("rows"))
    facets = facet_values(view(table, query)).groupBy("facet").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x.value).alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("facet", "v")))).alias("facets"))
    return rows.join(counters(table, query).select("total")).join(facets).select(F.to_json(F.struct("total", "facets", "rows")).alias("json"))


def exported(table: DataFrame, query: ResultQuery, folder: str, day: str, city: str | None = None, category: str | None = None) -> tuple[str, int]:
    """Writes the 41 columns of a view as CSV parts in a folder named after it; the count is known before anything is written."""
    shown = view(table, query)
    n = shown.count()
    path = f"{folder}/{export.file_name(city, category, day, n)}"
    export.write_csv(export.export_rows(shown), path)
    return path, n
