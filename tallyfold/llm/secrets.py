"""Secret scans: candidates by pattern, false positives removed by a random forest that runs as SQL expressions."""

from __future__ import annotations

import base64
import random
import re
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.quality_rules import let, spaced
from tallyfold.llm.scratch import unlike

#: Openings of well-known key formats; words that announce a secret or something that only looks like one; common letter groups
#: of plain words, also of those that no dictionary has.
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_.-]+)"
ANNOUNCE = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
DENY = r"(?i)(?:sha\d*|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|version|isbn|order|invoice|example|card|iban)"
GROUPS = "tion ment ness able ing the and ent her for con pro res ver ers est ati der ein ich sch und que ado ent ion eau eur aux par los las lib usr bin src home user data file image index page http www com org net".split()
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
VALUE = r"[A-Za-z0-9][A-Za-z0-9_+/=.~-]{14,}[A-Za-z0-9=]"
NAMED = rf"{ANNOUNCE}[\"']?\s*[:=]\s*[\"']?"
ASSIGNED = rf"{NAMED}([^\s\"'<>]{{8,}}[^\s\"'<>.,;#*&%$])"
#: What parts an assigned value from the next announced name; runs without = inside; known formats wherever they begin.
PARTS = rf"[,;&|](?=[\"']?[\w.-]*?{NAMED})"
PIECE = r"[A-Za-z0-9][A-Za-z0-9_+/.~-]{14,}[A-Za-z0-9]={0,2}"
KNOWN_IN = rf"(?<![A-Za-z0-9]){KNOWN[1:]}(?<![.])"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
NAMES = ("length", "transitions", "distinct", "digits", "upper", "hex", "known", "coverage", "groups", "path", "dots", "announced", "denied", "numeric", "quoted", "assigned")


class Model(NamedTuple):
    """Trees of the forest, and the dictionary: for each first letter its words, each between blanks."""

    forest: list
    words: tuple[str, ...]


def dictionary(*paths: str, most: int = 4000) -> tuple[str, ...]:
    """The `most` most frequent plain words of four letters and more in each of the rank files, which list tokens in that order: those
    that begin with a blank."""
    found = set()
    for path in paths:
        with open(path, "rb") as f:
            tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
            own = [t[1:].decode() for t in tokens if re.fullmatch(rb" [a-z]{4,}", t)]
        found |= set(own[:most])
    return tuple(" " + "".join(f"{w} " for w in sorted(found) if w[0] == c) for c in LOWER)


def covered(value: Column, words: tuple[str, ...]) -> Column:
    """Letters of `value` that lie in words of the dictionary, or in two of them written as one."""
    runs = F.transform(F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0)), F.lower)

    def of(listed: Column) -> Column:
        has = lambda r: F.contains(F.get(listed, F.ascii(r) - 97), F.concat(F.lit(" "), r, F.lit(" ")))
        two = lambda r: F.exists(F.sequence(F.lit(4), F.least(F.length(r), F.lit(40)) - 4), lambda i: has(F.substring(r, F.lit(1), i)) & has(F.substring(r, i + 1, F.length(r))))
        plain = F.filter(runs, lambda r: F.when(has(r), True).when(F.length(r) >= 8, two(r)).otherwise(False))
        return F.aggregate(plain, F.lit(0), lambda n, r: n + F.length(r))

    return let(F.array(*(F.lit(w) for w in words)), of)


def features(value: Column, word: Column, before: Column, words: tuple[str, ...]) -> dict[str, Column]:
    """Numbers that the forest sees: of the candidate itself, of the word that holds it and of the three words before."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    kinds = F.translate(value, LOWER + UPPER + DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
    around = F.concat(before, F.lit(" "), word)
    flag = lambda c: c.cast("int").cast("double")
    return {
        "length": n,
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "digits": F.length(F.regexp_replace(value, "[^0-9]", "")) / n,
        "upper": F.length(F.regexp_replace(value, "[^A-Z]", "")) / n,
        "hex": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "known": flag(value.rlike(KNOWN)),
        "coverage": covered(value, words) / n,
        "groups": 1 - F.length(F.regexp_replace(F.lower(value), "|".join(sorted(GROUPS, key=len, reverse=True)), "")) / n,
        "path": (F.length(value) - F.length(F.replace(value, F.lit("/"), F.lit("")))) / n + flag(word.rlike(r"://|^www\.|^[./~]*/|@|\.(?:com|org|net|html?|py|jpg|png|txt|pdf)\b")),
        "dots": (F.length(value) - F.length(F.regexp_replace(value, "[._-]", ""))) / n,
        "announced": flag(around.rlike(ANNOUNCE)),
        "denied": flag(around.rlike(DENY)),
        "numeric": flag(value.rlike(r"^[0-9./:_T+Z-]+$")),
        "quoted": flag(word.rlike(r"[\"']")),
        "assigned": flag(around.rlike(r"[:=]\s*[\"']?\S*$")),
    }


def labelled_findings(words: tuple[str, ...], n: int = 1800, seed: int = 10) -> list[tuple[str, str, str, int]]:
    """(value, word, before, label): made-up findings as a reviewer would mark them, the plain ones of words of the dictionary or of
    letter groups. The sample is bounded by n."""
    rng = random.Random(seed)
    listed = "".join(words).split()
    pick = lambda chars, low, high=None: "".join(rng.choices(chars, k=rng.randint(low, high or low)))
    made = lambda: "".join(rng.choices(GROUPS, k=rng.randint(1, 3)))
    prose = lambda k: " ".join(rng.choice(listed) if listed and rng.random() < 0.5 else made() for _ in range(k))
    hexa, base62 = "0123456789abcdef", LOWER + UPPER + DIGITS
    out = []
    for i in range(n):
        secret = [pick(hexa, 32), pick(hexa, 40), pick(hexa, 64), pick(base62, 20, 48), "ghp_" + pick(base62, 36), "AKIA" + pick(UPPER + DIGITS, 16), "sk_live_" + pick(base62, 24), pick(base62 + "!?-_", 10, 16), pick(base62 + "+/", 40, 64) + "=", "eyJ" + pick(base62, 20, 30) + "." + pick(base62, 30, 60)]
        if i % 2:
            value = rng.choice(secret)
            name = rng.choice(["token", "secret", "password", "api_key", "API-KEY", "access_key", "auth_token", "passwd", "Bearer"])
            form = rng.choice([('"{}"', "{} ="), ("{}", "{}:"), ("'{}'", "{} ="), ('{1}="{0}"', ""), ("{1}={0}", "")]) if not value.startswith(("ghp_", "AKIA", "sk_live_", "eyJ")) or rng.random() < 0.5 else ("{}", "")
            out.append((value, form[0].format(value, name) + rng.choice(["", "", ".", ",", "###", "***"]), (prose(3) + " " + form[1].format(name)).strip(), 1))
        else:
            plain = rng.choice(
                [
                    ("/".join(["usr", rng.choice(["lib", "src", "home"]), *prose(3).split()]) + pick(DIGITS, 1, 2) + ".py", ""),
                    ("".join(rng.choices(GROUPS, k=5)) + pick(DIGITS, 1, 4), ""),
                    ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), rng.choice(["uuid", "id", "guid:"])),
                    (pick(hexa, 40), rng.choice(["commit", "sha1", "revision", "hash:", "etag"])),
                    (pick(hexa, 64), rng.choice(["sha256:", "checksum", "digest"])),
                    (pick(hexa, 32), rng.choice(["md5", "md5sum:", "ETag:", ""])),
                    (pick(DIGITS, 16, 22), rng.choice(["card", "order", "number", ""])),
                    ("2024-0" + pick("123456789", 1) + "-1" + pick(DIGITS, 1) + "T" + pick("01", 2) + ":00:00", ""),
                    ("www." + prose(1) + ".com/" + prose(2).replace(" ", "/") + "?id=" + pick(DIGITS, 3, 6), ""),
                    (prose(1) + "." + pick(DIGITS, 2) + "@" + prose(1) + pick(DIGITS, 1) + ".example.com", ""),
                    ("_".join(prose(3).split()) + "_" + pick(DIGITS, 1, 3), rng.choice(["", "token_count =", "key:", "the secret"])),
                    ("-".join(prose(4).split()) + pick(DIGITS, 2), ""),
                    ("".join(x.capitalize() for x in prose(3).split()) + pick(DIGITS, 0, 2), ""),
                ]
            )
            if rng.random() < 0.3:  # what follows a secret is not one
                plain = (plain[0], f'{rng.choice(["token", "password"])} = "{pick(hexa, 40)}"')
            out.append((plain[0], plain[0] + rng.choice(["", ",", ".", "###"]), (prose(3) + " " + plain[1]).strip(), 0))
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> float | tuple:
    share = float(y.mean())
    if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
        return round(share, 4)
    best = (1e-6, None, None)
    for j in rng.choice(x.shape[1], 5, replace=False):
        levels = np.unique(x[:, j])
        for cut in (levels[1:] + levels[:-1])[:: max(1, len(levels) // 16)] / 2:
            left = x[:, j] <= cut
            a, b = y[left], y[~left]
            gain = share * (1 - share) - (len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())) / len(y)
            if gain > best[0]:
                best = (gain, int(j), float(cut))
    _, j, cut = best
    if j is None:
        return round(share, 4)
    left = x[:, j] <= cut
    return j, round(cut, 6), _grow(x[left], y[left], rng, depth - 1), _grow(x[~left], y[~left], rng, depth - 1)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, seed: int = 1) -> list:
    """Trees as nested (feature, cut, left, right) or the share of label 1, each grown on rows drawn with replacement, five features a split."""
    rng = np.random.default_rng(seed)
    return [_grow(x[rows], y[rows], rng, depth) for rows in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def _tree(node: float | tuple, get) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    j, cut, left, right = node
    return F.when(get(NAMES[j]) <= cut, _tree(left, get)).otherwise(_tree(right, get))


def forest_score(forest: list, get) -> Column:
    """Mean of the trees as one expression; get(name) is a feature."""
    return reduce(lambda a, b: a + b, (_tree(t, get) for t in forest)) / len(forest)


def train(spark: SparkSession, words: tuple[str, ...], findings: list[tuple[str, str, str, int]] | None = None) -> Model:
    """A forest from labelled findings (made-up ones if none are given) and the dictionary that it goes by. The features come from the same expressions as at the scan."""
    findings = labelled_findings(words) if findings is None else findings
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({i}, {quote(v)}, {quote(w)}, {quote(b)}, {y})" for i, (v, w, b, y) in enumerate(findings))
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(i, value, word, before, label)")
    got = table.select("i", *(c.alias(n) for n, c in features(F.col("value"), F.col("word"), F.col("before"), words).items()), "label").collect()
    got = np.array(sorted(map(tuple, got)), float)
    return Model(fit_forest(got[:, 1:-1], got[:, -1]), words)


def _candidates(text: Column) -> Column:
    """Per word the values in it that may be secrets, with what stands around them and the three words before: each long run of key
    characters with a digit, and with or without one all that is assigned to announced names or has a known prefix. They may lie in each other: a run in an assigned value,
    or a known key in a run; the forest sees them all. In a word with several, each is seen in its own field of the word."""

    def of(ws: Column) -> Column:
        def look(w: Column, i: Column) -> Column:
            before = F.array_join(F.slice(ws, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ")
            every = lambda s, pattern, group=0: F.regexp_extract_all(s, F.lit(pattern), F.lit(group))
            told = (F.length(w) >= 8) & F.get(ws, i - 1).rlike(r"[:=]$") & F.concat_ws(" ", F.get(ws, i - 2), F.get(ws, i - 1)).rlike(ANNOUNCE)

            def values(cut: Column) -> Column:  # < is in no value
                named = F.when(w.rlike("[:=]"), every(cut, ASSIGNED, 1)).otherwise(F.array().cast("array<string>"))
                first = F.array(F.regexp_extract(cut, r"^[\"']?([^\s\"'<>]{7,}[^\s\"'<>.,;#*&%$])", 1))
                rest = F.regexp_replace(cut, NAMED, "<")
                bare = F.filter(F.concat(every(rest, VALUE), every(rest, PIECE)), lambda v: v.rlike("[0-9]"))
                return let(named, lambda n: F.array_distinct(F.concat(n, F.when(told & (F.size(n) == 0), first).otherwise(F.array().cast("array<string>")), bare, every(w, KNOWN_IN))))

            def placed(v: Column, several: Column) -> Column:
                field = lambda at: F.concat(F.element_at(F.split(F.substring(w, F.greatest(at - 64, F.lit(1)), F.least(at - 1, F.lit(64))), r"[,;&{}|?]"), -1), F.substring(w, at, F.length(v) + 3))
                return F.struct(v.alias("value"), F.when(several, let(F.instr(w, v), field)).otherwise(w).alias("word"), before.alias("before"))

            found = let(let(F.regexp_replace(w, PARTS, "<"), values), lambda vs: F.transform(F.filter(vs, lambda v: F.length(v) >= 8), lambda v: placed(v, F.size(vs) > 1)))
            return F.when((F.length(w) >= 8) & ((F.length(w) >= 16) | told | w.rlike("[:=]")), found)

        return F.filter(F.transform(ws, look), lambda x: x.isNotNull() & (F.size(x) > 0))

    return let(F.split(spaced(text), " +"), of)


def secret_scan(docs: DataFrame, model: Model, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of each row of docs (text string), n_candidates, n_secrets, secrets and redacted.

    secrets has (start, length, score) of each found value in order of place, start counting characters from 1, once for
    each different value at its first place; redacted is the text with every place of them replaced by [SECRET]. A word
    may hold several candidates; a found value inside a longer found value of its word isn't counted beside it. Private
    key blocks count as found without the forest. One projection without shuffle. A null text has no candidates and stays
    null; very long texts are scanned whole; repeated rows come back repeated; an empty table gives an empty one; other
    columns are left out unless named in `keep`, where a name of the result is a ValueError.
    """
    unlike(keep, ("n_candidates", "n_secrets", "secrets", "redacted", "text", "_found", "_blocks", "_secrets", "_shown"))
    text = F.coalesce(F.col("text"), F.lit(""))

    def judged(found: Column) -> Column:
        def score(c: Column) -> Column:
            parts = features(c.value, c.word, c.before, model.words)
            return let(F.struct(*(x.alias(n) for n, x in parts.items())), lambda f: F.struct(c.value.alias("value"), forest_score(model.forest, lambda name: f[name]).alias("score")))

        def word(scored: Column) -> Column:
            holds = lambda x: F.exists(scored, lambda y: (y.score >= threshold) & (F.length(y.value) > F.length(x.value)) & F.contains(y.value, x.value))
            return F.transform(scored, lambda x: F.struct(x.value.alias("value"), x.score.alias("score"), F.when(x.score >= threshold, holds(x)).otherwise(False).alias("inner")))

        return F.flatten(F.transform(found, lambda cs: let(F.transform(cs, score), word)))

    none = F.array().cast("array<struct<value:string,score:double,inner:boolean>>")
    blocks = F.when(F.contains(text, F.lit("PRIVATE KEY-----")), F.transform(F.regexp_extract_all(text, F.lit(PEM), F.lit(0)), lambda v: F.struct(v.alias("value"), F.lit(1.0).alias("score"), F.lit(False).alias("inner")))).otherwise(none)
    scanned = docs.select(*(F.col(c) for c in dict.fromkeys([*keep, "text"])), F.when(text.rlike(rf"[0-9]|{KNOWN_IN}|{ANNOUNCE}"), judged(_candidates(text))).otherwise(none).alias("_found"), blocks.alias("_blocks"))
    # Longer values first, so that one that holds another is replaced whole.
    order = lambda a, b: F.when(F.length(a.value) > F.length(b.value), -1).when(F.length(a.value) < F.length(b.value), 1).when(a.value < b.value, -1).when(a.value > b.value, 1).otherwise(F.when(a.score > b.score, -1).when(a.score < b.score, 1).otherwise(0))
    secrets = F.array_sort(F.array_distinct(F.concat(F.col("_blocks"), F.filter("_found", lambda x: x.score >= threshold))), order)
    found = scanned.withColumn("_secrets", secrets)
    shown = let(F.filter("_secrets", lambda x: ~x.inner), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1).value != x.value)))
    found = found.withColumn("_shown", shown)
    spans = F.array_sort(F.transform("_shown", lambda x: F.struct(F.instr(F.col("text"), x.value).alias("start"), F.length(x.value).alias("length"), x.score.alias("score"))))
    redacted = F.aggregate("_secrets", F.col("text"), lambda t, x: F.replace(t, x.value, F.lit("[SECRET]")))
    return found.select(*keep, (F.size("_found") + F.size("_blocks")).cast("bigint").alias("n_candidates"), F.size("_shown").cast("bigint").alias("n_secrets"), spans.alias("secrets"), redacted.alias("redacted"))
