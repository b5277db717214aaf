"""The wide export: four phone slots of five attributes, pipes of values, CSV."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.rank import wa_label

SLOTS = 4
FORMULAS = {f"phone_{s}" for s in range(1, SLOTS + 1)}
ATTRIBUTES = {"": "number", "_type": "line_type", "_whatsapp": "label", "_belongs_to": "belongs_to", "_source": "source"}


def slot_columns(slot: int) -> list[str]:
    return [f"phone_{slot}{suffix}" for suffix in ATTRIBUTES]


#: The columns and their order.
COLUMNS = [
    "business_name", "category", "subcategory", "city", "area", "address", "contact_person", "contact_role", "attribution", "phone_count",
    *(c for s in range(1, SLOTS + 1) for c in slot_columns(s)),
    "email", "website", "facebook_url", "instagram_url", "maps_url", "rating", "review_count", "lead_score", "sources", "evidence_urls", "scraped_at",
]
COMPACT = ["business_name", "area", "contact_person", "contact_role", "phone_1", "phone_1_whatsapp", "phone_2", "phone_count", "website", "rating", "lead_score", "sources"]


def held(columns: list[str], seen: Column) -> Column:
    """The ranked ones of the phones that `seen` marks, in order, as an aggregate over a frame with rank, number and label."""
    fields = [c for c in ("rank", "number", "line_type", "label", "belongs_to", "source", "clean", "person_name", "person_role", "attribution") if c in columns]
    return F.array_sort(F.collect_list(F.when(seen & F.col("rank").isNotNull(), F.struct(*fields))))


def slots(phones: str) -> dict[str, Column]:
    """The first four of an array of held phones side by side: a slot is a place among them, whatever their ranks."""
    return {f"phone_{s}{suffix}": F.get(phones, F.lit(s - 1))[a] for s in range(1, SLOTS + 1) for suffix, a in ATTRIBUTES.items()}


def phone_pivot(phones: DataFrame) -> DataFrame:
    """One row a business with its first four ranked phones side by side."""
    table = phones.where("rank IS NOT NULL").withColumns({"number": F.coalesce("value_e164", "value_raw"), "label": wa_label(F.col("wa_evidence"))})
    return table.groupBy("business_id").agg(held(table.columns, F.lit(True)).alias("held")).withColumns(slots("held")).drop("held")


def pipe(columns: list[str], order: str, seen: Column | None = None) -> Column:
    """Distinct non-blank values in order of first sight, joined by |; null if there are none. `seen` tells which rows count."""
    row = F.struct(order, F.array(*columns).alias("x"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(row if seen is None else F.when(seen, row))), lambda r: r.x))
    return F.nullif(F.array_join(F.array_distinct(F.filter(ordered, lambda v: v.isNotNull() & (v != ""))), "|"), F.lit(""))


def export_rows(view: DataFrame) -> DataFrame:
    """The 41 columns of each row of a result view."""
    place = F.when(F.col("place_id").isNotNull(), F.concat(F.lit("https://www.google.com/maps/place/?q=place_id:"), "place_id"))
    wide = view.withColumns({"sources": F.col("sources_pipe"), "maps_url": place})
    gaps = {c: F.lit(None).cast("string") for c in ("contact_role", "attribution", "facebook_url", "instagram_url") if c not in view.columns}
    return wide.withColumns(gaps).select("business_id", *COLUMNS)


def cells(rows: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """Each column as the text of its cell: phone numbers as formulas that keep them text, instants in ISO form, null as nothing."""
    kinds = dict(rows.dtypes)
    shapes = {"timestamp": "yyyy-MM-dd'T'HH:mm:ssXXX", "timestamp_ntz": "yyyy-MM-dd'T'HH:mm:ss"}

    def cell(name: str) -> Column:
        text = F.date_format(name, shapes[kinds[name]]) if kinds[name] in shapes else F.col(name).cast("string")
        return F.format_string('="%s"', text) if name in FORMULAS else text

    return rows.select(*(F.coalesce(F.when(F.col(c).isNotNull(), cell(c)), F.lit("")).alias(c) for c in columns))


def lines(rows: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """(line) of each row, as CSV without its end: a cell is quoted if it holds a quote, a comma or an end of line."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return cells(rows, columns).select(F.concat_ws(",", *(quoted(c) for c in columns)).alias("line"))


def write_csv(rows: DataFrame, path: str, columns: list[str] = COLUMNS) -> None:
    """A folder of CSV parts, written where the rows are. Each part begins with the byte-order mark and the header; lines end with CRLF."""
    head = f"\ufeff{','.join(columns)}"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["line"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("line")], names=["line"])

    lines(rows, columns).mapInArrow(part, "line string").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def csv_text(rows: DataFrame, columns: list[str] = COLUMNS) -> Iterator[str]:
    """The same as one text for a reader that takes a page: for views with a limit, since rows pass through the driver."""
    yield f"\ufeff{','.join(columns)}\r\n"
    for row in lines(rows, columns).toLocalIterator():
        yield row.line + "\r\n"


def file_name(city: str | None, category: str | None, day: str, n: int) -> str:
    slug = lambda x: "".join(c if c.isalnum() else "_" for c in (x or "all").lower()).strip("_")
    return f"{slug(city)}_{slug(category)}_{day}_{n}leads.csv"
