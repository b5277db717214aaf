"""Operators without SQL on small fixtures: survivors of a merge, contacts that move, and the two stream functions."""

import csv
import datetime as dt
import glob
import io
import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import social, web
from tallyfold.operators import dedupe, export, health, ledger, requests, sites
from tallyfold.sources import payload, taxonomy
from tallyfold.streaming import breaker

BUSINESS = "business_id long, run_id int, name string, arrival int, address string, area string, city string, category string, subcategory string, lat double, lng double, place_id string, website string, rating double, review_count int"


def business(i, arrival=0, **given):
    row = {c.split()[0]: None for c in BUSINESS.split(", ")} | {"business_id": i, "run_id": 1, "name": f"b{i}", "arrival": arrival} | given
    return tuple(row.values())


def merged(spark):
    rows = [business(1, address="a1"), business(2, arrival=1, city="c2"), business(3, area="x3", city="c3", rating=4.0), business(4), business(5, arrival=1, area="x5"), business(6, area="x6"), business(7)]
    contacts = [(1, "p1"), (3, "p3"), (3, "p3b"), (2, "p2"), (9, "p9"), (7, "p7")]
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)], "node long, component long")
    found = spark.createDataFrame(contacts, "business_id long, value string")
    return found, groups, dedupe.survivors(spark.createDataFrame(rows, BUSINESS), found, groups)


def test_survivors_fill_gaps_in_order_of_richness(spark):
    got = {r.component: r for r in merged(spark)[2].collect()}
    assert set(got) == {1, 5}
    # 3 has most contacts; 1 and 2 have one each and 1 has more fields.
    assert (got[1].survivor, got[1].name, got[1].merged_from) == (3, "b3", [1, 2])
    assert (got[1].address, got[1].area, got[1].city, got[1].rating, got[1].website) == ("a1", "x3", "c3", 4.0, None)
    # Equal in contacts and fields: the earlier arrival stays.
    assert (got[5].survivor, got[5].area, got[5].merged_from) == (6, "x6", [5])


def test_moved_contacts_lose_none(spark):
    contacts, groups, kept = merged(spark)
    moved = dedupe.moved_contacts(contacts, groups, kept)
    assert moved.columns == contacts.columns
    assert sorted(tuple(r) for r in moved.collect()) == [(3, "p1"), (3, "p2"), (3, "p3"), (3, "p3b"), (7, "p7"), (9, "p9")]


def test_breaker_stream_keeps_state_between_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    kinds = ["failure", "failure", "success", "failure", "failure", "failure", "success", "failure", "success"]
    rows = [(s, 100 * s + i, start + dt.timedelta(seconds=(10 if i < 7 else 4000) * i), k) for s in (1, 2) for i, k in enumerate(kinds[s - 1 :])]
    schema = "source long, event_id long, ts timestamp, kind string"
    source = str(tmp_path / "in")
    for late in (False, True):
        part = [r for r in rows if (r[1] % 100 >= 4) == late]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        out = breaker.breaker_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        out.awaitTermination()
    want = []
    for s in (1, 2):
        own = health.Breaker()
        want += [(i, own.see(t.replace(tzinfo=dt.UTC).timestamp(), k)) for x, i, t, k in rows if x == s]
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.event_id, r.outcome) for r in got) == sorted(want)
    assert {"tripped", "ok"} <= {o for _, o in want}


def test_ingest_stream_equals_one_fold_of_all_arrivals(spark, tmp_path):
    schema = "run_id int, key string, n int"
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    fold = lambda batch: batch.groupBy("run_id", "key").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    parts = [(1, "a", 1), (1, "a", 2), (2, "b", 5)], [(2, "c", 7), (2, "b", 1), (None, "d", 1)], [(3, "a", 4), (None, "d", 2)]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = breaker.ingest_stream(stream, fold, path, str(tmp_path / "state"))
        query.processAllAvailable()
        query.stop()
    got = {(r.run_id, r.key, r.n) for r in spark.read.parquet(path).collect()}
    assert got == {(r.run_id, r.key, r.n) for r in fold(spark.createDataFrame(sum(parts, []), schema)).collect()}


def test_verdicts_and_match_by_place(spark):
    at = "business_id long, name string, lat double, lng double"
    places = spark.createDataFrame([(1, "Paragon Salon", 33.7, 73.0), (2, "Paragon Salon", 33.7005, 73.0), (3, "Burger Hut", 33.7, 73.0), (4, "Paragon Salon", 33.8, 73.0), (5, "Nowhere", None, None)], at)
    pairs = spark.createDataFrame([(1, 1, 2, "fuzzy_name_geo"), (1, 1, 3, "exact_phone"), (1, 1, 4, "domain"), (1, 4, 5, "place_id")], "run_id int, a long, b long, tier string")
    got = {(r.a, r.b): r.verdict for r in dedupe.verdicts(pairs, places).collect()}
    assert got == {(1, 2): "merge", (1, 3): "rejected_name", (1, 4): "rejected_distance", (4, 5): "merge"}
    listed = [
        (10, "Paragon Salon", 33.7001, 73.0, None), (11, "Burger Hut", 33.9, 73.0, None), (12, "Tailor", 33.7, 73.0, None), (13, "Paragon Salon", None, None, "+921"),
        (14, "Burger Hut Express DHA", 33.7, 73.0, None), (15, "Burger House", 33.7, 73.0, "+922"), (16, "Paragon Men Salon", 33.8, 73.0, None), (17, "x", None, None, "+923"), (18, "x", None, None, "+924"),
    ]
    listings = spark.createDataFrame(listed, "listing_id long, name string, lat double, lng double, phone string")
    contacts = spark.createDataFrame([(1, "phone", "+921"), (3, "phone", "+922"), (1, "phone", "+923"), (3, "phone", "+923")], "business_id long, kind string, value_e164 string")
    got = {r.listing_id: (r.business_id, r.tier, r.refusal) for r in dedupe.match_listings(listings, places.replace({"Paragon Salon": "Paragon Women Salon"}, subset="name").where("business_id = 4").unionByName(places.where("business_id <> 4")), contacts).collect()}
    assert got[10] == (1, "fuzzy_name_geo", None) and got[11] == (None, None, "rejected_distance") and got[12] == (None, None, "rejected_name")
    assert got[13] == (1, "phone_unlocated", None) and got[17] == (None, None, "ambiguous") and got[18] == (None, None, "no_candidate")
    assert got[14][0] == 3 and got[15] == (3, "corroborated_geo", None) and got[16] == (None, None, "rejected_segment")


def test_requests():
    q = requests.parse({"batch": "B01, unbatched,delivery-nosite", "sort": "nope", "order": "asc", "min_score": "7", "run": ["1", "2"], "has_website": "false", "limit": "10"})
    assert q.batches == ("delivery-nosite", "unbatched") and q.sort == "lead_score" and not q.descending and q.min_score == 7 and q.runs == (1, 2) and q.has_website is False and q.limit == 10
    assert requests.parse({}) == requests.ResultQuery(collapse=False)
    for bad in ({"batch": "b99"}, {"min_score": "101"}, {"limit": "0"}):
        with pytest.raises(ValueError):
            requests.parse(bad)
    assert requests.batch_of(" b06 ") == "reputation" and requests.batch_of("x") is None


def test_export_in_parts(spark, tmp_path):
    columns = {c: None for c in export.COLUMNS}
    rows = [columns | {"business_name": 'A "b", c', "phone_1": "+92300", "rating": 4.5, "scraped_at": dt.datetime(2024, 3, 1, 12, 0), "review_count": 0}, columns | {"business_name": "Straße\nx"}]
    kinds = {"rating": "double", "review_count": "int", "scraped_at": "timestamp"}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in export.COLUMNS))
    path = str(tmp_path / "csv")
    export.write_csv(df.coalesce(1), path)
    (part,) = glob.glob(f"{path}/part-*")
    text = open(part, encoding="utf-8", newline="").read()
    assert text.startswith("\ufeffbusiness_name,category,") and text.count("\r\n") == 3 and text == "".join(export.csv_text(df.coalesce(1)))
    view = df.select(F.lit(1).alias("business_id"), F.lit(None).cast("string").alias("place_id"), F.lit(70).alias("lead_score_"), *(c for c in df.columns if c != "maps_url")).withColumnRenamed("sources", "sources_pipe").withColumns({"lead_score": F.lit(70), "batch": F.lit("unbatched")})
    into, n = requests.exported(view, requests.ResultQuery(collapse=False), str(tmp_path), "20240301", "Lahore", "food")
    assert n == 2 and into.endswith("/lahore_food_20240301_2leads.csv") and len(glob.glob(f"{into}/part-*")) >= 1
    got = list(csv.DictReader(io.StringIO(text.removeprefix("\ufeff"))))
    assert got[0]["business_name"] == 'A "b", c' and got[0]["phone_1"] == '="+92300"' and got[0]["rating"] == "4.5" and got[0]["scraped_at"].startswith("2024-03-01T12:00:00") and got[0]["review_count"] == "0" and got[0]["area"] == ""
    assert got[1]["business_name"] == "Straße\nx" and export.file_name("Lahore City", None, "20240301", 2) == "lahore_city_all_20240301_2leads.csv"
    assert export.COLUMNS[9] == "phone_count" and export.COLUMNS[10] == "phone_1" and export.COLUMNS[30] == "email" and export.COLUMNS[-1] == "scraped_at" and len(export.COLUMNS) == 41


def test_suppression_list(spark):
    known = spark.createDataFrame([("+921", None, None, "")], "value_e164 string, email string, domain string, reason string")
    more = ledger.suppression_added(known, email=" A@B.pk ", reason="asked")
    assert sorted((r.value_e164, r.email) for r in more.collect() if r.email) == [(None, "a@b.pk")] and ledger.suppression_added(more, value_e164="+921").count() == 2
    assert ledger.suppression_removed(more, email="a@b.pk").count() == 1
    with pytest.raises(ValueError):
        ledger.suppression_added(known)


def test_breaker_over_batches(spark):
    """Events of several sources in one partition and small batches, against one loop a source."""
    start, rng = dt.datetime(2024, 1, 1), random.Random(3)
    rows = [(f"s{i % 5}" if i % 5 else "business_website", i, start + dt.timedelta(seconds=37 * i), rng.choice(["failure", "empty", "empty", "empty", "success", "blocked"] if i % 7 else ["empty"])) for i in range(600)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r.event_id: r.outcome for r in health.breaker(spark.createDataFrame(rows[::-1], "source string, event_id long, ts timestamp, kind string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    own = {s: health.Breaker(empties=health.EMPTIES.get(s, 5)) for s, *_ in rows}
    assert got == {i: own[s].see(t.timestamp(), k) for s, i, t, k in rows} and {"tripped", "skipped", "ok"} <= set(got.values())


def test_breaker_status():
    b = health.Breaker(empties=25)
    for t in range(24):
        assert b.see(t, "empty") == "ok"
    assert b.see(25, "empty") == "tripped" and b.status(30) == "circuit_open" and b.status(99_999) == "ok" and b.status(99_999, 5, 5) == "blocked"


def test_social_profile(spark):
    html = '<meta property="og:title" content="Salon X"><meta name="description" content="WhatsApp 0300-1234567 or 042-35772057"><a href="https:\\/\\/api.whatsapp.com\\/send?phone=923217654321">x</a> https:\\/\\/l.facebook.com\\/l.php?u=https\\u00253A\\u00252F\\u00252Fwww.salonx.pk\\u00252F&amp;h=2 \\ud83d\\ude00'.replace("\\\\", "\\")
    df = spark.createDataFrame([("https://facebook.com/x", html, "facebook"), ("https://facebook.com/y", "<p>shell</p>", "facebook")], "url string, html string, platform string")
    read = df.select("url", "platform", *(c.alias(n) for n, c in social.read_profile(F.col("url"), F.col("html"), F.col("platform")).items()))
    x, y = sorted(read.collect(), key=lambda r: r.url)
    assert x.rendered and x.buttons == ["+923217654321"] and x.bio_link == "https://www.salonx.pk/" and not y.rendered and y.bio_link is None
    assert df.select(social.unescaped(F.col("html")).alias("u")).first().u.endswith("😀")
    found = [(r.e164, r.wa_evidence, r.confidence, r.line_type) for r in sites.profile_findings(read).orderBy("place").collect()]
    assert found == [("+923217654321", 0.9, 0.9, "mobile"), ("+923001234567", 0.75, 0.6, "mobile"), ("+924235772057", 0.75, 0.6, "landline")]
    assert sites.bio_routes(read).collect()[0].website == "https://www.salonx.pk/"


def test_site_of_parsed_pages(spark):
    home = '<body><a href="tel:0300-1234567">c</a> 042-35772057 <a href="/x">Contact us</a><a href="/y">x</a><a href="/team">t</a><div class="ht-ctc"><p><b data-telephone="0321-7654321"></b></p></div></body>'
    contact = '<a href="https://wa.me/923001234567">w</a> mail a@salon.pk <script type="application/ld+json">{"@graph":[{"@type":"HairSalon","telephone":["042-35772057"],"founder":{"name":" Sana "}}]}</script>'
    rows = [("https://salon.pk/", 0, "https://salon.pk/", home), ("https://salon.pk/", 1, "https://salon.pk/x", contact)]
    pages = spark.createDataFrame(rows, "site string, page int, url string, html string").select("site", "page", "url", web.parse_page("url", "html").alias("p"))
    got = {r.e164: r for r in sites.site_findings(*sites.site_pages(pages)).collect()}
    a, b, c = got["+923001234567"], got["+924235772057"], got["+923217654321"]
    assert (a.confidence, a.wa_evidence, a.evidence_url, a.source_url) == (0.95, 1.0, "https://salon.pk/x", "https://salon.pk/") and (b.confidence, b.wa_evidence, b.person_name, b.evidence_url) == (0.9, 0.0, "Sana", "https://salon.pk/")
    assert (c.confidence, c.wa_evidence) == (0.95, 0.95) and pages.where("page = 0").select("p.targets").first().targets == ["https://salon.pk/x", "https://salon.pk/team"]


def test_entry_without_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tallyfold", tmp_path / "tallyfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, with_sql, pipeline = said.stdout.split()
    assert int(n) > int(with_sql) > 120 and pipeline == "False"


def test_config(spark, tmp_path):
    (tmp_path / "cities.yaml").write_text("# places\nLahore:\n  tier: 1\n  area_code: '042'\n  tiles: [DHA, Model Town,  # the south\n          F-7]\n\nQuetta:\n  area_code: \"081\"\n")
    (tmp_path / "words.yaml").write_text("salon:\n  - hair salon\n  - 'beauty parlour'\nfood: [karahi, bbq]\nnone:\n")
    tiles, words = taxonomy.cities(spark, str(tmp_path / "cities.yaml")), taxonomy.synonyms(spark, str(tmp_path / "words.yaml"))
    assert [tuple(r) for r in tiles.collect()] == [("Lahore", 1, "042", 0, "DHA"), ("Lahore", 1, "042", 1, "Model Town"), ("Lahore", 1, "042", 2, "F-7"), ("Quetta", 3, "081", 0, None)]
    assert [tuple(r) for r in words.collect()] == [("salon", 0, "hair salon"), ("salon", 1, "beauty parlour"), ("food", 0, "karahi"), ("food", 1, "bbq")]
    assert {r.query for r in taxonomy.query_plan(tiles, words, 2, 1).collect()} == {f"{w} in {t}, Lahore" for w in ("hair salon", "karahi") for t in ("DHA", "Model Town")}
    assert taxonomy.read_config("") == {}


def test_archive(spark, tmp_path):
    path, at = str(tmp_path / "archive"), dt.datetime(2024, 1, 1)
    schema = "url string, status int, body string, kind string, fetched_at timestamp"
    payload.write_archive(spark.createDataFrame([("http://a.pk/x", 200, "old", "detail", at), ("http://b.pk", 404, "gone", "listing", at)], schema), path)
    payload.write_archive(spark.createDataFrame([("http://a.pk/x?utm_source=y", 200, "new", "detail", at + dt.timedelta(days=3))], schema), path)
    broken = sorted(glob.glob(f"{path}/shard=*/part-*.parquet"))
    wanted = spark.createDataFrame([("http://www.a.pk/x/",), ("http://b.pk/",), ("http://c.pk/",)], "url string")
    now = F.lit(at + dt.timedelta(days=10))
    read = lambda **more: {r.url: (r.hit, r.body) for r in payload.looked_up(wanted, payload.read_archive(spark, path), now, **more).collect()}
    assert read() == {"http://www.a.pk/x/": (True, "new"), "http://b.pk/": (False, None), "http://c.pk/": (False, None)} and read(ignore_ttl=True)["http://b.pk/"] == (True, "gone")
    victim = next(b for b in broken if spark.read.parquet(b).where("body = 'new'").count())
    open(victim, "r+b").truncate(20)
    assert read()["http://www.a.pk/x/"] == (True, "old")
