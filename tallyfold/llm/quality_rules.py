"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.scratch import unlike

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "a al and are as at avec be by con das de del den der des die du ein el en er es est et for from für have he her his ich il im in is ist it la las le les los "
    "mit nicht of on or par para por pour qu que qui se sich sie sind su sur that the they this to un una une und von was were which with you zu"
).split()


class Rule(NamedTuple):
    """Kept while low * of <= 100 * metric <= high * of; None leaves a side open. `of` is a metric or a number."""

    metric: str
    of: str | int
    low: int | None
    high: int | None


RULES = (
    Rule("n_words", 1, 5_000, None),
    Rule("n_repeat_words", "n_words", None, 50),
    Rule("word_chars", "n_words", 250, 1_200),
    Rule("n_symbols", "n_words", None, 25),
    Rule("n_shouts", "n_words", None, 40),
    Rule("n_stop_words", "n_words", 3, None),
    Rule("n_dup_lines", "n_lines", None, 45),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: a plain column would be computed anew in each step of a lambda."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, characters: str) -> Column:
    for x in characters:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def spaced(text: Column) -> Column:
    """Text with each white-space character of the word pattern as a blank."""
    for x in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(x), F.lit(" "))
    return text


def words(text: Column) -> Column:
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")


def _repeated(ws: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(places: Column) -> Column:  # in order: a window adds what lies beyond the one before
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a.n)

    def twice(s: Column) -> Column:
        again = F.transform(s, lambda x, i: F.when((x.h == F.get(s, i + 1).h) | ((i > 0) & (x.h == F.get(s, i - 1).h)), x.i))
        return covered(F.sort_array(F.filter(again, lambda p: p.isNotNull())))

    def windows(h: Column) -> Column:
        n = F.size(h) - 2
        pair = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))
        three = F.zip_with(pair, F.slice(h, 3, n), lambda a, b: F.xxhash64(a, b))
        return let(three, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice)))

    return F.when(F.size(ws) < 4, F.lit(0).cast("bigint")).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), windows))


def metrics(text: Column) -> dict[str, Column]:
    """Counts of a text; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))
    solid = _without(text, " \t\n\x0b\x0c\r")
    parts = let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            _repeated(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        ),
    )
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.trim(spaced(x)) != ""), lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return {
        "word_chars": F.length(solid).cast("bigint"),
        "n_symbols": (F.length(solid) - F.length(_without(solid, "#*$%&|<>"))).cast("bigint"),
        "n_shouts": (F.length(solid) - F.length(_without(solid, "!"))).cast("bigint"),
        "parts": parts,
        "lines": lines,
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one condition over the metric columns."""
    out = F.lit(True)
    for r in rules:
        of = F.col(r.of) if isinstance(r.of, str) else F.lit(r.of)
        if r.low is not None:
            out &= 100 * F.col(r.metric) >= r.low * of
        if r.high is not None:
            out &= 100 * F.col(r.metric) <= r.high * of
    return out


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_stop_words", "base_failed", "kept")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of every row of docs (text string), its counts, base_failed and kept.

    One projection without shuffle. Null and empty texts count zero words and are not kept; repeated rows come back
    repeated; extra columns are left out unless named in `keep`; an empty table gives an empty one. Windows of words are
    compared by 64-bit hashes within a text. A kept column with the name of a result is a ValueError.
    """
    unlike(keep, OUT)
    counted = docs.select(*(F.col(c) for c in keep), *(x.alias(f"_{name}") for name, x in metrics(F.col("text")).items()))
    flat = counted.select(
        *keep, F.col("_parts.n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"), F.col("_n_symbols").alias("n_symbols"), F.col("_lines.n_dup_lines").alias("n_dup_lines"),
        F.col("_parts.n_repeat_words").alias("n_repeat_words"), F.col("_lines.n_lines").alias("n_lines"), F.col("_n_shouts").alias("n_shouts"), F.col("_parts.n_stop_words").alias("n_stop_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def _sql_rule(r: Rule) -> list[str]:
    return [f"100 * {r.metric} {op} {x} * {r.of}" for op, x in ((">=", r.low), ("<=", r.high)) if x is not None]


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: DuckDB SQL for quality_rules over a view `docs_in`; kept apart so that the pipeline can use it.
RULES_SQL = rf"""
q_words AS (SELECT row_number() OVER () AS q_row, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM docs_in),
q_windows AS (SELECT q_row, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT q_row, ws, unnest(range(1, len(ws) - 1)) AS i FROM q_words)),
q_twice AS (SELECT q_row, i FROM (SELECT q_row, i, count(*) OVER (PARTITION BY q_row, tri) AS c FROM q_windows) WHERE c > 1),
q_covered AS (SELECT q_row, count(DISTINCT i + j) AS n_repeat_words FROM q_twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY q_row),
q_lines AS (SELECT q_row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM q_words),
q_counts AS (
  SELECT doc_id, w.q_row, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_shouts,
    CAST(len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(x)))) AS BIGINT) AS n_stop_words
  FROM q_words w JOIN q_lines USING (q_row) LEFT JOIN q_covered USING (q_row)),
q_failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q_counts),
q_rules AS (SELECT *, NOT base_failed AND {" AND ".join(x for r in RULES for x in _sql_rule(r))} AS kept FROM q_failed)"""
SQL = f"WITH docs_in AS (SELECT * FROM documents),{RULES_SQL}\nSELECT * EXCLUDE (q_row) FROM q_rules"
