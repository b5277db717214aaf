"""Queries against DuckDB on the smallest tables, and literal cases of the parsers."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import phones, web
from tallyfold.functions.fuzzy import token_set_ratio
from tallyfold.functions.text import normalise_name, normalise_url
from tallyfold.operators import dedupe, health
from tallyfold.plans import landing, registry
from tallyfold.sources import payload

DIR = "/root/testdata/sf0.001"
SOME = ["lead_score", "score_order_stats", "rank_owner_first", "rank_whatsapp_only", "results_default", "results_page", "batch_counts", "export_rows_41", "extract_top30", "dedupe_candidates", "url_normalise", "name_norm", "breaker_streaks", "ingest_fold", "payload_records", "directory_listings", "directory_walk", "decoded_bodies", "phones_in_notes", "social_links", "site_findings", "site_merge", "social_merge", "mail_merge", "directory_merge", "backfill", "pull_metrics", "clipboard", "ledger_list", "facet_values", "results_page_json", "dedupe_chains", "merge_candidates", "dedupe_survivors", "degradation", "run_states"]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    found = duck.execute(registry.SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in row) for row in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want


def test_every_query_has_sql_or_a_reason():
    assert set(registry.QUERIES) == set(registry.SQL) | set(registry.WITHOUT_SQL)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("0300-1234567", [("+923001234567", "mobile")]), ("(92 42) 35772057", [("+924235772057", "landline")]), ("042 111 117 638", [("+9242111117638", "uan")]),
        ("0300-1234567 0321-7654321", [("+923001234567", "mobile"), ("+923217654321", "mobile")]), ("35202-1234567-1", []), ("Rs 0300123456", []),
        ("Plot No 042 111 117 638", []), ("NTN 1234567-8, mobile +92 321 4567890", [("+923214567890", "mobile")]), ("+1 415 555 2671", []),
    ],
)
def test_phones(text, want):
    assert [(p.e164, p.line_type) for p in phones.extract(text)] == want


def test_similarity():
    assert token_set_ratio("bombay biryani", "bombay biryani restaurant") == 100
    assert token_set_ratio("", "x") == 0
    assert round(token_set_ratio("lavish women salon dha branch", "lavish men s salon dha branch"), 1) == 93.1


def test_page():
    html = '<html><body><script>var x="0300-1111111"</script><a href="https://wa.me/923001234567">chat</a><a href="tel:042-35772057">call</a><div class="whatsapp-chat" data-phone="03217654321"></div><a href="mailto:Info@Salon.pk?x=1">m</a><a href="/contact-us">Contact</a><a href="https://facebook.com/salon">f</a><p>WhatsApp 0333-1234567</p><script type="application/ld+json">{"@type":"LocalBusiness","name":"A","telephone":"0312-1234567","founder":{"name":"Sana"}}</script></body></html>'
    p = web.read_page("https://www.salon.pk/", html)
    assert p["chat"] == ["+923001234567"] and p["tel"] == ["+924235772057"] and p["widget"] == ["+923217654321"]
    assert p["emails"] == ["info@salon.pk"] and p["targets"] == ["https://www.salon.pk/contact-us"] and p["people"] == ["Sana"] and p["facebook"] == "https://facebook.com/salon"
    assert {n["e164"]: n["signal"] for n in p["numbers"]}["+923331234567"] == "text_proximity" and "0300-1111111" not in p["text"]


def test_payload(spark):
    record = [None] * 179
    record[11], record[78], record[9], record[4] = "Salon", "p1", [None, None, 31.5, 74.3], [None, None, None, [None, "1,435 reviews"], None, None, None, 4.7]
    body = [None] * 65
    body[64] = [[None, record], [None, record]]
    wrapped = json.dumps({"c": 0, "d": ")]}'\n" + json.dumps(body)}) + '/*""*/' + json.dumps({"c": 1})
    rows = payload.search_results(spark.createDataFrame([(1, wrapped), (2, "broken")], "arrival int, body string")).collect()
    assert [(r.name, r.place_id, r.lat, r.rating, r.review_count) for r in rows] == [("Salon", "p1", 31.5, 4.7, 1435)]


def capture(*names):
    body = [None] * 65
    body[64] = [[None, [None] * 11 + [n] + [None] * 66 + [f"p {n}"]] for n in names]
    return json.dumps(body)


def test_payload_pages_of_an_arrival(spark):
    """A place stands once an arrival, as the page with the least number has it."""
    page = lambda name: capture(name).replace(f"p {name}", "p1")
    rows = spark.createDataFrame([(1, 3, page("c")), (1, 2, page("b")), (1, 1, "broken"), (2, 9, page("d"))], "arrival int, page long, body string").repartition(3)
    assert sorted((r.arrival, r.name) for r in payload.search_results(rows).collect()) == [(1, "b"), (2, "d")]


def test_payload_bodies_do_not_grow_with_the_table(spark):
    longest = [landing.payload_bodies(registry.Data(spark, d)).agg(F.max(F.length("body"))).first()[0] for d in (DIR, "/root/testdata/sf0.01")]
    assert longest[1] < 2 * longest[0]


def test_payload_document_of_more_than_a_variant_holds(spark):
    """Variant holds 128 MiB; a document of more gave no records and no error."""
    head, tail = capture("a", "b").split("null", 1)
    body = F.concat(F.lit(head + '"'), F.repeat(F.lit("x" * 1000), 140_000), F.lit('"' + tail))
    rows = payload.search_results(spark.range(1).select(F.col("id").alias("arrival"), body.alias("body"))).select("name").collect()
    assert sorted(r.name for r in rows) == ["a", "b"]


def test_payload_records_are_those_of_whole_documents():
    """Read record by record, a body has the records that its documents have as a whole, wherever it is cut or spoilt."""

    def whole(raw):
        docs = [json.loads(x) for x in payload.documents(raw)]
        results = [(i, d[64]) for i, d in enumerate(docs) if isinstance(d, list) and len(d) > 64 and isinstance(d[64], list)]
        return [(i, pos, json.dumps(w[1])) for i, found in results for pos, w in enumerate(found) if isinstance(w, list) and len(w) > 1]

    short = "[" + "0 , " * 64 + '[[1, ["a", {"b": [2.50, "]"]}]], null, [], [ 1 ], [null, null], {"x": 1}, [3, "é\\ud800"] ] , 7 ]'
    raw = ")]}'\n" + short + '/* x */ 5 {"c":0,"d":' + json.dumps(")]}'" + short + " " + json.dumps({"d": short})) + '}/*""*/[] [1] ' + short
    assert len(whole(raw)) == 12 == len(list(payload.records(raw)))
    for cut in range(len(raw)):
        for spoilt in (raw[:cut], raw[:cut] + raw[cut + 1 :], raw[:cut] + "," + raw[cut:], raw[:cut] + "]" + raw[cut:]):
            assert list(payload.records(spoilt)) == whole(spoilt)


def test_names_and_addresses(spark):
    rows = spark.createDataFrame([("Café  Déjà-Vu (Pvt) Ltd", "HTTP://WWW.Example.com:80/A/?b=2&utm_source=x&a=1#top")], "n string, u string")
    assert tuple(rows.select(normalise_name(F.col("n")), normalise_url(F.col("u"))).first()) == ("cafe deja vu", "http://example.com/A?a=1&b=2")
    names = spark.createDataFrame([("Škoda Žižkov Straße",), ("ﬁne Ⅷ ½ Co.",)], "n string").select(normalise_name(F.col("n")).alias("n")).collect()
    assert [r.n for r in names] == ["skoda zizkov strasse", "fine viii 1 2"]


def test_masked_mail(spark):
    masked = "5a" + "".join(f"{b ^ 0x5A:02x}" for b in b"info@salon.pk")
    assert spark.createDataFrame([(masked,)], "t string").select(web.decode_cfemail(F.col("t"))).first()[0] == "info@salon.pk"
    assert web.read_page("https://x.pk", f'<a data-cfemail="{masked}">x</a>')["emails"] == ["info@salon.pk"]


def test_breaker():
    b = health.Breaker()
    assert [b.see(t, k) for t, k in ((0, "failure"), (1, "failure"), (2, "failure"), (3, "success"), (2000, "success"))] == ["throttled", "throttled", "tripped", "skipped", "ok"]


def test_components(spark):
    groups = dedupe.components(spark.createDataFrame([(1, 2), (2, 3), (5, 9)], "a long, b long"))
    assert {(r.node, r.component) for r in groups.collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 5)}


def test_groups_need_no_far_pairs(spark):
    """The groups of the pairs that can be merged are those of all candidates."""
    d = registry.Data(spark, DIR)
    every = dedupe.verdicts(dedupe.candidates(d.businesses, d.contacts), d.businesses).where("verdict = 'merge'")
    want = dedupe.components(every.select("a", "b")).collect()
    assert sorted(map(tuple, registry.QUERIES["dedupe_groups"](spark, DIR).collect())) == sorted(map(tuple, want)) and len(want) > 20
