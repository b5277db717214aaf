"""Landed captures: concatenated and wrapped JSON payloads, directory pages, and the archive with its time to live."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.phones import extract_phones
from tallyfold.functions.text import normalise_name, url_hash

#: Where a record holds its fields, and where a payload holds its records.
CP1252 = "".join(map(chr, range(0x80, 0xA0))), bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
PATHS = {"name": "$[11]", "place_id": "$[78]", "address": "$[39]", "lat": "$[9][2]", "lng": "$[9][3]", "phone_raw": "$[178][0][0]", "website": "$[7][0]", "rating": "$[4][7]", "review_text": "$[4][3][1]", "price_range": "$[4][2]", "category": "$[13][0]"}
RESULTS = 64
#: Characters of records after which the reader hands on what it has.
BATCH = 4 << 20


DEEPEST = 4
_READ = json.JSONDecoder().raw_decode
_BLANKS = re.compile(r"[ \t\n\r]*")
_GUARD = re.compile(r"\)\]\}'")
_BETWEEN = re.compile(r"(?:\s|/\*.*?\*/)*", re.S)


def _opened(raw: str, read: Callable[[str, int], tuple[Any, int]]) -> Iterator[Any]:
    """Documents of a body as `read` gives them (with the place where one ends): guards, blanks and comments between them skipped, texts under "d"
    opened up to four deep; a bad one ends the text that holds it. What is still to be read lies on a pile, the innermost text on top."""
    pile = [(_GUARD.sub("", raw).strip(), 0)]
    while pile:
        text, at = pile.pop()
        at = _BETWEEN.match(text, at).end()
        if at >= len(text):
            continue
        try:
            node, at = read(text, at)
        except ValueError:
            continue
        pile.append((text, at))
        inner = node.get("d") if isinstance(node, dict) else None
        if not isinstance(inner, str):
            yield node
        elif len(pile) <= DEEPEST:
            pile.append((_GUARD.sub("", inner).strip(), 0))


def documents(raw: str) -> list[str]:
    """JSON documents of a body."""
    return [json.dumps(node) for node in _opened(raw, _READ)]


def _walk(text: str, at: int, each: Callable[[int, int], int]) -> int:
    """Reads the array that begins at `at` and says where it ends: `each` gets the number and the place of an element and says where that ends."""
    skip, n = lambda at: _BLANKS.match(text, at).end(), 0
    at = skip(at + 1)
    if text.startswith("]", at):
        return at + 1
    while True:
        at = skip(each(n, at))
        if text.startswith("]", at):
            return at + 1
        if not text.startswith(",", at):
            raise ValueError(f"neither comma nor end at {at}")
        n, at = n + 1, skip(at + 1)


def _results(text: str, at: int) -> tuple[Any, int]:
    """A document and where it ends; of an array only its records (pos, JSON), of which one at a time is more than text."""
    if not text.startswith("[", at):
        return _READ(text, at)
    found = []

    def wrapper(pos: int, at: int) -> int:
        node, end = _READ(text, at)
        if isinstance(node, list) and len(node) > 1:
            found.append((pos, json.dumps(node[1])))
        return end

    end = _walk(text, at, lambda n, at: _walk(text, at, wrapper) if n == RESULTS and text.startswith("[", at) else _READ(text, at)[1])
    return found, end


def records(raw: str) -> Iterator[tuple[int, int, str]]:
    """(doc, pos, JSON) of the records of a body, those of a bad document left out."""
    for doc, found in enumerate(_opened(raw, _results)):
        if isinstance(found, list):
            yield from ((doc, pos, r) for pos, r in found)


def _read_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["arrival", "page", "doc", "pos", "record"]
    for batch in batches:
        arrival, page, body = (batch.column(c) for c in ("arrival", "page", "body"))
        rows, size = [], 0

        def full() -> pa.RecordBatch:
            of, doc, pos, r = zip(*rows)
            of = pa.array(of, pa.int64())
            return pa.RecordBatch.from_arrays([arrival.take(of), page.take(of), pa.array(doc, pa.int32()), pa.array(pos, pa.int32()), pa.array(r, pa.string())], names)

        for i in range(len(batch)):
            for doc, pos, r in records(body[i].as_py() or ""):
                rows.append((i, doc, pos, r))
                size += len(r)
                if size >= BATCH:
                    yield full()
                    rows, size = [], 0
        if rows:
            yield full()


def search_results(bodies: DataFrame) -> DataFrame:
    """Records of payloads (body, arrival, and page where an arrival has several), each place once an arrival, the first wins. Drift gives nulls,
    never an error. Records leave the reader one by one: neither a document's size nor an arrival's is bounded by what Variant or a task holds."""
    page = (F.col("page") if "page" in bodies.columns else F.lit(0)).cast("bigint").alias("page")
    schema = T.StructType([bodies.schema["arrival"], *(T.StructField(n, k) for n, k in (("page", T.LongType()), ("doc", T.IntegerType()), ("pos", T.IntegerType()), ("record", T.StringType())))])
    items = bodies.select("arrival", page, "body").mapInArrow(_read_bodies, schema).select("arrival", "page", "doc", "pos", F.try_parse_json("record").alias("r"))
    kinds = {"lat": "double", "lng": "double", "rating": "double"}
    table = items.select("arrival", "page", "doc", "pos", *(F.try_variant_get("r", path, kinds.get(n, "string")).alias(n) for n, path in PATHS.items()))
    table = table.where("name IS NOT NULL OR place_id IS NOT NULL").withColumn("review_count", F.regexp_replace(F.regexp_extract("review_text", r"([\d,]+)", 1), ",", "").try_cast("int")).drop("review_text")
    key = F.coalesce("place_id", F.concat_ws("|", "name", "address"))
    first = F.row_number().over(Window.partitionBy("arrival", key).orderBy("page", "doc", "pos"))
    return table.withColumn("_n", first).where("_n = 1").drop("_n", "page")


def merged_results(results: DataFrame) -> DataFrame:
    """One record a place over all bodies: the one with most filled fields, the earliest of equals."""
    fields = [c for c in results.columns if c not in ("arrival", "doc", "pos")]
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields[1:]), F.col(fields[0]).isNotNull().cast("int"))
    key = F.coalesce("place_id", F.concat_ws("|", "name", "address"))
    order = Window.partitionBy(key).orderBy(filled.desc(), "arrival", "doc", "pos")
    return results.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def is_search_payload(url: Column) -> Column:
    return F.contains(url, F.lit("tbm=map"))


def search_url(query: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps/search/"), F.replace(F.replace(F.url_encode(query), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def listings(pages: DataFrame) -> DataFrame:
    """Companies of directory pages (url, html): directory_id, name, link, address, phones, coordinates (both or none; 0, 0 is none), rating
    and review_count. A block without a linked name is no company."""
    block = F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<div [^>]*class=\"company[ \"].*?(?=<div [^>]*class=\"company[ \"]|</body>|$)"), F.lit(0)))
    b = pages.select("url", block.alias("b"))
    get = lambda p, of="b": F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(of, p, 1), "<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    cell = F.get(F.filter(F.split("b", "<div "), lambda c: c.rlike(r"(?is)^class=\"s\".*?<i[^>]*aria-label=\"[^\"]*phone")), F.lit(0))
    out = b.withColumn("cell", F.regexp_replace(F.regexp_extract(cell, "(?s)^[^>]*>(.*)$", 1), "<[^>]*>", " ")).select(
        "url", get(r"^<div [^>]*data-cmpid=\"([^\"]*)\"").alias("directory_id"), get(r"(?s)<h3[^>]*>\s*<a[^>]*>(.*?)</a>").alias("name"), get(r"(?s)<h3[^>]*>\s*<a[^>]*?href=\"([^\"]+)\"").alias("link"),
        get(r"(?s)<div class=\"address\"[^>]*>(.*?)</div>").alias("address"), extract_phones("cell").alias("phones"),
        get(r"data-ltd=\"([^\"]+)\"").try_cast("double").alias("lat"), get(r"data-lng=\"([^\"]+)\"").try_cast("double").alias("lng"),
        get(r"(?s)<div class=\"rate\"[^>]*>(.*?)</div>").try_cast("double").alias("rating"), F.replace(get(r"(\d[\d,]*)\s+Review"), F.lit(","), F.lit("")).try_cast("int").alias("review_count"),
    )
    real = F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~((F.col("lat") == 0) & (F.col("lng") == 0))
    return out.where("name IS NOT NULL").withColumns({"lat": F.when(real, F.col("lat")), "lng": F.when(real, F.col("lng"))})


def listing_pages(pages: DataFrame) -> DataFrame:
    """(url, next_url, total_found) of directory pages (url, html): where the category goes on, and how many listings it claims."""
    link = F.coalesce(F.nullif(F.regexp_extract("html", r"(?i)<link[^>]*rel=\"next\"[^>]*href=\"([^\"]+)\"", 1), F.lit("")), F.nullif(F.regexp_extract("html", r"(?i)<link[^>]*href=\"([^\"]+)\"[^>]*rel=\"next\"", 1), F.lit("")))
    root = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    whole = F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.regexp_replace("url", "[^/]*$", ""), link))
    total = F.replace(F.regexp_extract("html", r"(?i)We found\s*<strong>\s*([\d,]+)\s*</strong>\s*listings", 1), F.lit(","), F.lit("")).try_cast("int")
    return pages.select("url", F.when(link.isNotNull(), whole).alias("next_url"), total.alias("total_found"))


def walked(starts: DataFrame, links: DataFrame, most: int = 10) -> DataFrame:
    """(slug, step, url) of the pages that a walk reads: from each of starts (slug, place, url) along links (url, next_url), at most `most` pages a
    start, no page twice. Where walks meet, the page belongs to the start with the least place, and the later walk ends there."""
    step = starts.select("slug", "place", F.lit(0).alias("step"), "url").join(links.select("url").distinct(), "url", "left_semi")
    every = step
    for n in range(1, most):  # a chain of pages is followed side by side
        onward = step.join(links.where("next_url IS NOT NULL"), "url").select("slug", "place", F.lit(n).alias("step"), F.col("next_url").alias("url"))
        step = onward.join(links.select("url").distinct(), "url", "left_semi")
        every = every.unionByName(step)
    first = Window.partitionBy("url").orderBy("place", "step")
    owned = every.withColumn("_first", F.row_number().over(first)).withColumn("cut", F.min(F.when(F.col("_first") > 1, F.col("step"))).over(Window.partitionBy("slug", "place")))
    return owned.where("cut IS NULL OR step < cut").select("slug", "step", "url")


def distinct_listings(found: DataFrame) -> DataFrame:
    """Each company once over all pages (place, pos): by its id, without one by its name; the first wins."""
    key = F.coalesce(F.concat(F.lit("id "), "directory_id"), F.concat(F.lit("name "), normalise_name(F.col("name"))))
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("place", "pos"))).where("_n = 1").drop("_n")


#: The slugs of a directory that hold a category's businesses.
SLUGS = {
    "food": ("restaurants", "fast-food", "cafes", "catering"),
    "salon": ("beauty-salons", "hairdressers", "beauty-professionals"),
    "fashion": ("clothing-and-accessories", "fashion", "tailors-and-alterations"),
    "car_services": ("auto-repair", "auto-services", "car-wash", "auto-parts-newused"),
    "real_estate": ("estate-agents", "property-consultants"),
    "ecommerce": ("mobile-phone-shops", "online-shopping", "general-shopping"),
    "entertainment": ("leisure", "sports", "fitness", "pubs-and-clubs"),
}


def category_urls(wanted: DataFrame, base: str = "https://www.businesslist.pk") -> DataFrame:
    """(city, category, slug, url): the pages to begin with for each (city, category)."""
    slugs = F.element_at(F.create_map(*(x for k, v in SLUGS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("category"))
    place = F.replace(F.lower(F.trim("city")), F.lit(" "), F.lit("-"))
    return wanted.select("city", "category", F.explode(slugs).alias("slug")).withColumn("url", F.concat(F.lit(f"{base}/category/"), "slug", F.lit("/city:"), place))


def url_slug(url: Column) -> Column:
    found = F.regexp_extract(url, "/category/([^/]+)", 1)
    return F.when(found != "", found).otherwise(url)


def decoded(body: Column, content_type: Column) -> Column:
    """Text of a body by the charset of its header, else by the one that its first bytes name, else as UTF-8; one that can't be is passed over."""
    head = F.nullif(F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*([A-Za-z0-9_-]+)", 1)), F.lit(""))
    meta = F.nullif(F.lower(F.regexp_extract(F.decode(F.substring(body, 1, 4096), "ISO-8859-1"), r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_-]+)", 1)), F.lit(""))

    def of(named: Column) -> Column:
        latin = F.decode(body, "ISO-8859-1")
        return F.when(named.isin("utf-8", "utf8"), F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))).when(named.isin("iso-8859-1", "latin-1", "latin1"), latin).when(named.isin("windows-1252", "cp1252"), F.translate(latin, *CP1252)).when(named.isin("us-ascii", "ascii"), F.when(~latin.rlike("[^\\x00-\\x7f]"), latin)).when(named == "utf-16", F.decode(body, "UTF-16"))

    return F.coalesce(of(head), of(meta), F.make_valid_utf8(body.cast("string")))


def fresh(archive: DataFrame, now: Column, ignore_ttl: bool = False) -> DataFrame:
    """Archived bodies still within seven days for listings and thirty for details."""
    days = F.when(F.col("kind") == "listing", F.expr("INTERVAL 7 DAYS")).otherwise(F.expr("INTERVAL 30 DAYS"))
    return archive if ignore_ttl else archive.where(F.col("fetched_at") + days > now)


def archive_rows(fetches: DataFrame) -> DataFrame:
    """stored() with what finds a body again: the hash of its address, by whose first two digits the archive is parted."""
    key = url_hash(F.col("url"))
    return fetches.withColumns({"url_hash": key, "shard": F.substring(key, 1, 2)})


def write_archive(rows: DataFrame, path: str) -> None:
    """Adds rows to the archive. Spark's writer renames finished files only, so a body is there as a whole or not."""
    archive_rows(rows).write.mode("append").partitionBy("shard").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive; files that can't be read are as if they weren't there."""
    return spark.read.option("ignoreCorruptFiles", "true").parquet(path)


def looked_up(wanted: DataFrame, archive: DataFrame, now: Column, ignore_ttl: bool = False) -> DataFrame:
    """Wanted addresses (url) with the latest body that the archive has for them and that is still fresh; `hit` tells whether there is one."""
    asked = wanted.withColumn("url_hash", url_hash(F.col("url")))
    fields = [c for c in archive.columns if c not in ("url", "url_hash", "shard")]
    latest = fresh(archive, now, ignore_ttl).groupBy("url_hash").agg(F.max_by(F.struct(*fields), "fetched_at").alias("found"))
    return asked.join(latest, "url_hash", "left").select("url", F.col("found").isNotNull().alias("hit"), *(F.col(f"found.{c}").alias(c) for c in fields))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def walk_strings(document: pa.Array) -> pa.Array:
    """Every string of a JSON document with the path of indices and keys that leads to it, in the order of the document; none of a bad one."""

    def walked(text: str | None) -> list[dict]:
        try:
            pile, out = [("$", json.loads(text or "null"))], []
        except ValueError:
            return []
        while pile:
            path, node = pile.pop()
            if isinstance(node, str):
                out.append({"path": path, "value": node})
            inner = enumerate(node) if isinstance(node, list) else node.items() if isinstance(node, dict) else ()
            pile += [(f"{path}[{k}]", x) for k, x in inner][::-1]
        return out

    return pa.array([walked(x) for x in document.to_pylist()], pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])))


def stored(fetches: DataFrame) -> DataFrame:
    """Archive rows of fetches (url, final_url, status, content_type, body): under both addresses, but nothing of a server's error."""
    return fetches.where("status < 500").select(F.explode(F.array_distinct(F.array("url", F.coalesce("final_url", "url")))).alias("url"), "status", "content_type", "body")


def crawlable(fetches: DataFrame) -> DataFrame:
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    html = (kind == "") | kind.rlike("^(text/html|application/xhtml|text/plain)")
    return fetches.where((F.col("status") == 200) & (F.length("body") > 0) & html & (F.length("body") <= 4 << 20))
