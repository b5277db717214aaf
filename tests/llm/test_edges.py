"""Every registered query and the pipeline on tables with nulls in every column, empty and very long texts, ties, repeated rows and columns whose
names the operators use themselves; and on empty tables."""

import random
import re

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyfold.llm import jaccard_join, mixing, quality_rules, registry, scratch, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept boolean, n_secrets int, copy string, row string, sig long, name long, _nth int, size int, taken int, score double, spans string, ids binary, rank int"
VECTORS = "vec_id long, embedding array<float>, label int, rank int, query_id long"
LABELS = "doc_id long, quality int, toxic int, text string"
TALK = "conv_id long, turn long, role string, text string, depth int, kind string"
WORDS = {"en": "the cat and then of it is with there river over green house".split(), "de": "der und nicht ist ein mit haus über grün fluss dann auch".split()}


def documents():
    rng = random.Random(12)
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        body = " ".join(rng.choices(WORDS[lang], k=rng.choice([60, 90, 150])) + [f"n{rng.randrange(10**6)}" for _ in range(20)])
        rows.append((i, body, lang, f"s{i % 3}"))
    rows += [rows[3], rows[3], (3, rows[5][1], "en", "s0"), (70, rows[7][1], None, None), (71, rows[7][1] + " more", "en", "s1")]
    rows += [(None, rows[9][1], "en", "s1"), (None, None, None, None), (80, None, None, "s1"), (81, "", "en", "s1"), (82, " \n\t ", "de", None), (83, "!!! 12", "en", "")]
    rows += [(90, " ".join(rng.choices(WORDS["en"], k=30_000)), "en", "s2"), (91, "日本語" * 9_000, "ja", "s2"), (92, "token=" + "a1B2" * 10 + " " + " ".join(rng.choices(WORDS["en"], k=90) + [f"m{i}" for i in range(30)]), "en", "s1")]
    return [(*r, None if r[1] is None else len(r[1])) + tuple(None if i % 2 else x for x in (7, True, 9, "c", "r", 5, 6, 1, 3, 4, 0.5, "sp", b"i", 2)) for i, r in enumerate(rows)]


def tables(spark, where, empty):
    rng = np.random.default_rng(3)
    v = [[float(x) for x in rng.normal(size=4)] for _ in range(120)]
    vectors = [(i, x, i % 3, 1, 1) for i, x in enumerate(v)] + [(50, v[0], 0, 1, 1), (7, v[7], None, None, None), (200, None, 0, 1, 1), (201, [], 0, 1, 1), (202, [1.0, None, 0.0, 0.0], 0, 1, 1), (203, [float("nan")] * 4, 0, 1, 1), (204, [1.0, 2.0], 0, 1, 1), (None, v[1], 0, 1, 1)]
    labels = [(i, i % 2, 0, "x") for i in range(0, 60)] + [(3, 1, None, None), (None, 1, 0, None), (5, None, 0, None)]
    talk = [(c, t, "user" if t % 2 == 0 else "assistant", f"words {t}") for c in range(6) for t in range(6)] + [(0, 0, "user", "words 0"), (None, 1, "user", "x"), (1, None, "assistant", None), (2, 9, None, "{"), (3, 9, "tool", "x" * 200_000), (None, None, None, None)]
    for name, rows, schema in (("documents", documents(), DOCS), ("embeddings", vectors, VECTORS), ("labels", labels, LABELS), ("conversations", [(*r, 1, "k") for r in talk], TALK)):
        spark.createDataFrame([] if empty else rows, schema).write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("none"), True)


QUERIES = registry.QUERIES | {"pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, odd, none, name):
    got = QUERIES[name](spark, odd)
    rows = got.collect()
    empty = QUERIES[name](spark, none)
    assert empty.columns == got.columns and empty.count() == 0
    if name in ("op1_ngram_jaccard_join", "op2_language_id", "op3_quality_rules", "op5_quality_classifier", "op7_byte_bpe", "op8_source_mixing", "op10_secret_scan"):
        assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((x[0] is None, x[0]) for x in documents())
    if name == "op9_tool_call_linking":
        assert len(rows) == 42 and sum("no result" in r.faults for r in rows) >= 1
    if name == "op2_language_id":
        assert all((r.lang_pred == "und") == (r.doc_id in (80, 81, 82, 83) or r.doc_id is None and r.score == 0) for r in rows)
    if name in ("op2_language_id", "op5_quality_classifier"):
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "pipeline":
        assert rows and all(r.ids_sha256 and r.n_tokens == len(r.ids) // 4 for r in rows)


def test_topk_over_odd_vectors(spark, odd):
    """Against the SQL; the repeated query counts by its least vector."""
    table = spark.read.parquet(f"{odd}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{odd}/embeddings.parquet/*.parquet' WHERE vec_id <> 50 OR embedding = (SELECT min(embedding) FROM '{odd}/embeddings.parquet/*.parquet' WHERE vec_id = 50)")
    want = [r for r in con.execute(registry.TOPK_SQL).fetchall() if r[0] == 50]
    got = [tuple(r) for r in registry.QUERIES["op4_exact_topk"](spark, odd).collect() if r.query_id == 50]
    both = {r[3] for r in table.where("vec_id = 50").collect()}
    assert len(got) == 5 and {g[3] for g in got} >= {w[3] for w in want if w[2] != 50} - both


def test_kept_columns_must_not_clash(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    with pytest.raises(ValueError):
        quality_rules.quality_rules(docs, keep=("doc_id", "n_words"))
    with pytest.raises(ValueError):
        secrets.secret_scan(docs, secrets.Model([0.0], registry.plain_words()), keep=("n_secrets",))


def test_shared_folder_is_asked_for(monkeypatch):
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError):
        scratch.folder(Session)


def test_stages_one_by_one(spark, odd):
    """Each stage against a plain version of it over what the stage before gave, all columns in place."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    plain = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    stage = dict(corpus_pipeline.STAGES)
    # Quality rules, by their SQL.
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    good = con.execute(quality_rules.SQL.replace("SELECT * EXCLUDE (q_row) FROM q_rules", "SELECT text FROM q_rules JOIN q_words USING (q_row) WHERE kept")).fetchall()
    kept = scratch.settle(stage["quality rules"](spark, docs, odd))
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted(t for (t,) in good) and kept.count() > 40
    # One of each group of near copies, by brute force over the sets.
    rows = kept.collect()
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for r in rows for w in [re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())]]
    label = [r.doc_id for r in rows]
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if None not in (label[i], label[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    least = {i for i, r in zip(label, rows, strict=True) if i is not None and any(x.doc_id == i and c == i for x, c in zip(rows, label, strict=True))}
    want = {(r.doc_id, r.text) for r in rows if r.doc_id in least} | {(None, r.text) for r in rows if r.doc_id is None}
    once = scratch.settle(stage["n-gram Jaccard join"](spark, kept, odd))
    assert once.columns == docs.columns and {(r.doc_id, r.text) for r in once.collect()} == want and once.count() == len(want) < len(rows)
    # Secrets: the planted one goes, nothing else changes.
    clean = scratch.settle(stage["secret scans"](spark, once, odd))
    before, after = ({r.doc_id: r for r in df.collect()} for df in (once, clean))
    assert clean.columns == docs.columns and after[92].text == before[92].text.replace("a1B2" * 10, "[SECRET]") and after[92].n_chars == len(after[92].text)
    assert plain(clean.where("doc_id <> 92")) == plain(once.where("doc_id <> 92"))
    # The mix: rows as often as mix_sources says.
    mixed = scratch.settle(stage["mixing sources to target weights"](spark, clean, odd))
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(clean).collect() if r.size}
    assert mixed.columns == docs.columns and plain(mixed) == sorted(tuple(map(str, r)) for r in clean.collect() for _ in range(taken.get(r.doc_id, 0)))
    # Tokens, as the library gives them.
    own = {base: rank for base, rank in secrets_ranks().items()}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    texts = sorted(np.array(other.encode_ordinary(r.text), "<u4").tobytes() for r in mixed.collect())
    assert sorted(bytes(r.ids) for r in stage["byte-level BPE encoding and decoding"](spark, mixed, odd).collect()) == texts


def secrets_ranks():
    import base64

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_hot_group_is_cut_into_blocks(spark, monkeypatch):
    """A third of all rows in one group of near copies, tied twice and counted in blocks."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base) if i % 3 == 0 else [f"x{i}y{j}" for j in range(60)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    link = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {i: sum(link(sets[i], sets[j]) for j in range(90) if j != i) for i in range(90)}
    monkeypatch.setattr(jaccard_join, "PART", (5, 1 << 19))
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == want and max(want.values()) > 20
    assert len({r.component_id for r in got if r.doc_id % 3 == 0}) == 1
