"""Configuration as tables: cities with their tiles, search words by category, the sources that serve a category, and the plan of queries from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Per category the sources of its own trade, how good they are, and those that bring its volume; sources that are out, and why.
ROUTES = {
    "food": (("foodpanda",), "strong", ("google_maps", "foodpanda")),
    "real_estate": (("zameen",), "strong", ("zameen",)),
    "entertainment": (("pakplay", "turfy"), "strong", ("pakplay", "google_maps")),
    "salon": ((), "none", ("google_maps",)),
    "car_services": ((), "weak", ("google_maps",)),
    "fashion": ((), "none", ("google_maps", "facebook", "instagram")),
    "ecommerce": ((), "none", ("google_maps", "facebook", "instagram")),
}
EXCLUDED = {
    "linkedin": "next to no phones", "tiktok": "next to no phones", "khelpoint": "placeholder listings", "cheetay": "closed", "apollo": "no coverage", "zoominfo": "no coverage", "hunter_io": "no coverage",
    "lusha": "no coverage", "daraz": "sellers without phones", "priceoye": "sellers without phones", "google_places_api": "priced a request", "urdupoint": "landlines only", "businessbook_pk": "unstable", "yellowpage_pk": "duplicates", "listing_com_pk": "access control",
}


def routes(spark: SparkSession) -> DataFrame:
    """(category, vertical, strength, volume)"""
    return spark.createDataFrame([(c, list(v), s, list(d)) for c, (v, s, d) in ROUTES.items()], "category string, vertical array<string>, strength string, volume array<string>")


def excluded(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXCLUDED.items()), "source string, reason string")


def _scalar(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def read_config(text: str) -> dict:
    """The part of YAML that the configuration is written in: mappings by indentation, lists by dashes or in brackets over several lines, plain or
    quoted texts, comments. Values are texts."""
    kept = (re.sub(r"(^|\s)#.*$", "", line).rstrip() for line in text.splitlines())
    lines: list[str] = []
    for line in filter(str.strip, kept):  # a bracket that is still open goes on in the next line
        if lines and lines[-1].count("[") > lines[-1].count("]"):
            lines[-1] += f" {line.strip()}"
        else:
            lines.append(line)

    def block(at: int, depth: int) -> tuple[dict | list, int]:
        out: dict | list = [] if lines[at].lstrip().startswith("- ") else {}
        while at < len(lines) and len(lines[at]) - len(lines[at].lstrip()) == depth:
            line = lines[at].strip()
            at += 1
            if isinstance(out, list):
                out.append(_scalar(line[2:]))
                continue
            key, _, value = line.partition(":")
            if value.strip().startswith("["):
                out[_scalar(key)] = [_scalar(x) for x in value.strip()[1:-1].split(",") if x.strip()]
            elif value.strip():
                out[_scalar(key)] = _scalar(value)
            elif at < len(lines) and (deeper := len(lines[at]) - len(lines[at].lstrip())) >= depth and (deeper > depth or lines[at].lstrip().startswith("- ")):
                out[_scalar(key)], at = block(at, deeper)
            else:
                out[_scalar(key)] = []
        return out, at

    return block(0, len(lines[0]) - len(lines[0].lstrip()))[0] if lines else {}


def _file(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def cities(spark: SparkSession, path: str) -> DataFrame:
    """(city, tier, area_code, place, tile), a row a tile; a city without tiles has one row without."""

    def rows() -> Iterator[tuple]:
        for city, data in read_config(_file(spark, path)).items():
            for place, tile in enumerate(data.get("tiles") or [None]):
                yield city, int(data.get("tier", 3)), data.get("area_code", ""), place, tile

    return spark.createDataFrame(list(rows()), "city string, tier int, area_code string, place int, tile string")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(category, place, word)"""
    rows = [(c, i, w) for c, words in read_config(_file(spark, path)).items() for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "category string, place int, word string")


def query_plan(tiles: DataFrame, words: DataFrame, tile_limit: int | None = None, word_limit: int | None = None) -> DataFrame:
    """(city, category, tile, word, query) of every tile of a city with every word of a category, where wanted only the first tiles and words: a
    product of two configuration tables."""
    first = lambda df, n: df if n is None else df.where(F.col("place") < n)
    both = first(tiles.where("tile IS NOT NULL"), tile_limit).select("city", "tile").join(first(words, word_limit).select("category", "word"), F.lit(True))
    return both.withColumn("query", F.concat("word", F.lit(" in "), "tile", F.lit(", "), "city"))


def query_counts(tiles: DataFrame, words: DataFrame) -> DataFrame:
    """(city, category, queries), without making the queries."""
    t = tiles.where("tile IS NOT NULL").groupBy("city").agg(F.count("*").alias("t"))
    return t.join(words.groupBy("category").agg(F.count("*").alias("w")), F.lit(True)).select("city", "category", (F.col("t") * F.col("w")).alias("queries"))


def sampled(table: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """One row of each key, the first by business_id, and of these n by a hash of seed and key: the same at each run."""
    once = table.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("business_id"))).where("_n = 1").drop("_n")
    return once.orderBy(F.md5(F.concat(F.lit(f"{seed} "), key)), key).limit(n)
