"""Queries over landed captures: bodies, pages and directories made from the tables, read back by the parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import phones as ph
from tallyfold.functions import social
from tallyfold.functions import text as tx
from tallyfold.functions import web
from tallyfold.operators import sites
from tallyfold.plans.registry import DOMAIN, Data, query
from tallyfold.sources import payload, taxonomy

# --- payloads -----------------------------------------------------------------------------------


def payload_bodies(d: Data) -> DataFrame:
    """The captures of a run, numbered by page: a hundred ids of businesses go into one body, of which about twenty are of the run (as many as a
    captured page of results holds); odd runs wrap theirs as text under "d" and put another document behind it, some records stand twice."""
    null = F.lit("null")
    js = lambda c: F.coalesce(F.expr(f"substring(to_json(struct({c} AS x)), 6, length(to_json(struct({c} AS x))) - 6)"), null)
    gap = lambda n: F.lit(",".join(["null"] * n))
    value = lambda c: F.when(F.col(c).isNull(), null).otherwise(js(c))
    reviews = F.when(F.col("review_count").isNull(), null).otherwise(F.concat(F.lit('"'), F.format_number("review_count", 0), F.lit(' reviews"')))
    meta = F.concat(F.lit("[null,null,null,[null,"), reviews, F.lit("],null,null,null,"), value("rating"), F.lit("]"))
    record = F.concat(
        F.lit("["), gap(4), F.lit(","), meta, F.lit(",null,null,["), value("website"), F.lit("],null,[null,null,"), value("lat"), F.lit(","), value("lng"), F.lit("],null,"), value("name"),
        F.lit(",null,["), value("subcategory"), F.lit("],"), gap(25), F.lit(","), value("address"), F.lit(","), gap(38), F.lit(","), value("place_id"), F.lit("]"),
    )
    wrapped = F.concat(F.lit("[null,"), record, F.lit("]"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("business_id", wrapped.alias("r")))), lambda x: x.r)
    twice = d.businesses.withColumn("again", F.explode(F.when(F.col("business_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    per = twice.groupBy("run_id", F.expr("business_id div 100").alias("page")).agg(F.array_join(items, ",").alias("items"))
    doc = F.concat(F.lit(")]}'\n["), gap(64), F.lit(",["), F.col("items"), F.lit("]]"))
    nested = F.concat(F.expr("concat('{\"c\":0,', substring(to_json(named_struct('d', doc)), 2))"), F.lit('/*""*/{"c":1}'))
    return per.withColumn("doc", doc).select(F.col("run_id").alias("arrival"), "page", F.when(F.col("run_id") % 2 == 1, nested).otherwise(F.col("doc")).alias("body"))


_LANDED = "SELECT run_id AS arrival, name, place_id, address, lat, lng, website, rating, CAST(review_count AS INTEGER) AS review_count, subcategory AS category, row_number() OVER (PARTITION BY run_id, coalesce(place_id, concat_ws('|', name, address)) ORDER BY business_id) AS o FROM businesses"


@query("payload_records", f"SELECT * EXCLUDE (o) FROM ({_LANDED}) WHERE o = 1")
def payload_records(d: Data) -> DataFrame:
    return payload.search_results(payload_bodies(d)).select("arrival", "name", "place_id", "address", "lat", "lng", "website", "rating", "review_count", "category")


@query("payload_merged", "SELECT place_id, arrival, business_id FROM (SELECT place_id, run_id AS arrival, business_id, row_number() OVER (PARTITION BY place_id ORDER BY (CASE WHEN address IS NULL THEN 0 ELSE 1 END + CASE WHEN lat IS NULL THEN 0 ELSE 2 END + CASE WHEN website IS NULL THEN 0 ELSE 1 END + CASE WHEN rating IS NULL THEN 0 ELSE 1 END + CASE WHEN review_count IS NULL THEN 0 ELSE 1 END + CASE WHEN subcategory IS NULL THEN 0 ELSE 1 END) DESC, run_id, business_id) AS o FROM businesses WHERE place_id IS NOT NULL) WHERE o = 1")
def payload_merged(d: Data) -> DataFrame:
    fields = d.businesses.where("place_id IS NOT NULL").select(F.col("run_id").alias("arrival"), F.lit(0).alias("doc"), F.col("business_id").alias("pos"), "name", "place_id", "address", "lat", "lng", "website", "rating", "review_count", F.col("subcategory").alias("category"))
    return payload.merged_results(fields).select("place_id", "arrival", F.col("pos").alias("business_id"))


@query("search_urls", "SELECT n_nationkey, concat('https://www.google.com/maps/search/', replace(url_encode(concat('hair & nails in ', n_name, ', ', r_name)), '%20', '+')) AS url, n_nationkey % 2 = 0 AS is_search FROM nation JOIN region ON n_regionkey = r_regionkey")
def search_urls(d: Data) -> DataFrame:
    table = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey"))
    at = F.concat(F.lit("https://x/search?"), F.when(F.col("n_nationkey") % 2 == 0, "a=1&tbm=map").otherwise("tbm=isch"))
    return table.select("n_nationkey", payload.search_url(F.concat(F.lit("hair & nails in "), "n_name", F.lit(", "), "r_name")).alias("url"), payload.is_search_payload(at).alias("is_search"))


# --- directories --------------------------------------------------------------------------------


def directory_pages(d: Data) -> DataFrame:
    """Directory pages of ten suppliers each, with a promotion card among them, linked to the next page."""
    b = d.businesses.select("business_id", "name", "address", "lat", "lng", "rating", "review_count")
    s = d.supplier.select("s_suppkey").join(b, F.col("s_suppkey") * 3 == F.col("business_id"))
    part = lambda c, text: F.when(F.col(c).isNull(), "").otherwise(text)
    marker = F.when(F.col("lat").isNull(), F.when(F.col("s_suppkey") % 2 == 0, '<div class="mapmarker" data-ltd="0" data-lng="0"></div>').otherwise("")).otherwise(F.concat(F.lit('<div class="mapmarker" data-ltd="'), F.col("lat").cast("string"), F.lit('" data-lng="'), F.col("lng").cast("string"), F.lit('"></div>')))
    number = F.concat(F.lit("042 3577"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"))
    block = F.concat(
        F.lit('<div class="company" data-cmpid="'), F.col("s_suppkey").cast("string"), F.lit('"><h3><a href="/company/'), F.col("s_suppkey").cast("string"), F.lit('">'), F.col("name"), F.lit("</a></h3>"),
        part("address", F.concat(F.lit('<div class="address">\n '), F.col("address"), F.lit("\n</div>"))), F.lit('<div class="s"><i aria-label="E-mail"></i> x@y.pk</div>'),
        F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit('<div class="s"><i aria-label="Phone number"></i> <span>'), number, F.lit("</span></div>"))), marker,
        part("review_count", F.concat(F.lit('<div class="company_reviews"><div class="rate">'), F.coalesce(F.col("rating").cast("string"), F.lit("-")), F.lit("</div> "), F.format_number("review_count", 0), F.lit(" Reviews</div>"))), F.lit("</div>\n"),
    )
    page = F.floor(F.col("s_suppkey") / 10)
    per = s.groupBy(page.alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", block.alias("h")))), lambda x: x.h), "").alias("blocks"))
    url = lambda p: F.concat(F.lit("https://dir.example.pk/category/cafes/city:lahore/"), p.cast("string"))
    head = F.concat(F.lit('<html><head><link rel="next" href="/category/cafes/city:lahore/'), (F.col("page") + 1).cast("string"), F.lit('"></head><body>We found <strong>1,234</strong> listings'))
    return per.select(url(F.col("page")).alias("url"), F.concat(head, F.lit('<div class="company promo"><p>Add yours</p></div>'), "blocks", F.lit("</body></html>")).alias("html"))


@query("directory_listings", "SELECT concat('https://dir.example.pk/category/cafes/city:lahore/', s_suppkey // 10) AS url, CAST(s_suppkey AS VARCHAR) AS directory_id, name, concat('/company/', s_suppkey) AS link, address, CASE WHEN s_suppkey % 4 <> 0 THEN concat('+92423577', lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0')) END AS phone, lat, lng, CASE WHEN review_count IS NOT NULL THEN rating END AS rating, CAST(review_count AS INTEGER) AS review_count FROM supplier JOIN businesses ON business_id = s_suppkey * 3")
def directory_listings(d: Data) -> DataFrame:
    return payload.listings(directory_pages(d)).select("url", "directory_id", "name", "link", "address", F.get("phones", F.lit(0)).e164.alias("phone"), "lat", "lng", "rating", "review_count")


@query("directory_pagination", "SELECT DISTINCT concat('https://dir.example.pk/category/cafes/city:lahore/', s_suppkey // 10) AS url, concat('https://dir.example.pk/category/cafes/city:lahore/', s_suppkey // 10 + 1) AS next_url, 1234 AS total_found FROM supplier JOIN businesses ON business_id = s_suppkey * 3")
def directory_pagination(d: Data) -> DataFrame:
    return payload.listing_pages(directory_pages(d))


_WALK = """
walk_pages AS (SELECT page_id AS url, CASE WHEN page_id % 17 <> 16 THEN page_id + 1 END AS next_url FROM pages),
walk AS (
  SELECT url AS slug, url AS place, 0 AS step, url FROM walk_pages WHERE url % 7 = 0
  UNION ALL SELECT slug, place, step + 1, n.url FROM walk w JOIN walk_pages p ON p.url = w.url JOIN walk_pages n ON n.url = p.next_url WHERE step < 9),
walk_cut AS (SELECT *, min(CASE WHEN o > 1 THEN step END) OVER (PARTITION BY slug) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY place, step) AS o FROM walk))"""


@query("directory_walk", "SELECT slug, step, url FROM walk_cut WHERE cut IS NULL OR step < cut", ctes=_WALK)
def directory_walk(d: Data) -> DataFrame:
    p = F.col("page_id")
    links = d.pages.select(p.alias("url"), F.when(p % 17 != 16, p + 1).alias("next_url"))
    starts = links.where("url % 7 = 0").select(F.col("url").alias("slug"), F.col("url").alias("place"), "url")
    return payload.walked(starts, links)


@query("category_urls", "SELECT DISTINCT city, category, slug, concat('https://www.businesslist.pk/category/', slug, '/city:', replace(lower(trim(city)), ' ', '-')) AS url FROM businesses JOIN (VALUES " + ", ".join(f"('{k}', '{s}')" for k, v in payload.SLUGS.items() for s in v) + ") t(category, slug) USING (category)")
def category_urls(d: Data) -> DataFrame:
    return payload.category_urls(d.businesses.select("city", "category").distinct())


@query("distinct_listings", "SELECT listing_id FROM (SELECT s_suppkey AS listing_id, row_number() OVER (PARTITION BY CASE WHEN s_suppkey % 5 = 0 THEN name ELSE CAST(s_suppkey % 30 AS VARCHAR) END, s_suppkey % 5 = 0 ORDER BY s_suppkey) AS o FROM supplier JOIN businesses ON business_id = s_suppkey * 3) WHERE o = 1")
def distinct_listings(d: Data) -> DataFrame:
    found = d.supplier.join(d.businesses, F.col("s_suppkey") * 3 == F.col("business_id")).select(F.col("s_suppkey").alias("listing_id"), "name", F.when(F.col("s_suppkey") % 5 != 0, (F.col("s_suppkey") % 30).cast("string")).alias("directory_id"), F.lit(0).alias("place"), F.col("s_suppkey").alias("pos"))
    return payload.distinct_listings(found).select("listing_id")


# --- the archive --------------------------------------------------------------------------------


def _fetches(d: Data) -> DataFrame:
    n = F.col("event_id")
    status = F.when(n % 7 == 0, 404).when(n % 11 == 0, 503).otherwise(200)
    kind = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, "text/html; charset=utf-8").when(n % 5 == 2, "Application/XHTML+xml").when(n % 5 == 3, "image/png").otherwise("text/plain")
    url = F.concat(F.lit("http://h"), (n % 40).cast("string"), F.lit(".pk/"), n.cast("string"))
    return d.events.select("event_id", url.alias("url"), F.when(n % 3 == 0, F.regexp_replace(url, "^http:", "https:")).alias("final_url"), status.alias("status"), kind.alias("content_type"), F.when(n % 13 == 0, "").otherwise(F.col("props")).alias("body"))


_FETCHES = "fetches AS (SELECT event_id, concat('http://h', event_id % 40, '.pk/', event_id) AS url, CASE WHEN event_id % 3 = 0 THEN concat('https://h', event_id % 40, '.pk/', event_id) END AS final_url, CASE WHEN event_id % 7 = 0 THEN 404 WHEN event_id % 11 = 0 THEN 503 ELSE 200 END AS status, event_id % 5 AS k, CASE WHEN event_id % 13 = 0 THEN '' ELSE props END AS body FROM events)"


@query("archive_stored", "SELECT url, status, md5(body) AS digest FROM (SELECT unnest(list_distinct([url, coalesce(final_url, url)])) AS url, status, body FROM fetches WHERE status < 500)", ctes=_FETCHES)
def archive_stored(d: Data) -> DataFrame:
    return payload.stored(_fetches(d)).select("url", "status", F.md5("body").alias("digest"))


@query("crawl_gate", "SELECT event_id FROM fetches WHERE status = 200 AND length(body) > 0 AND k <> 3", ctes=_FETCHES)
def crawl_gate(d: Data) -> DataFrame:
    return payload.crawlable(_fetches(d)).select("event_id")


@query("decoded_bodies", "SELECT event_id, md5(CASE WHEN event_id % 4 = 1 THEN concat('<meta charset=\"latin-1\">café ', event_id) ELSE concat('café ', event_id) END) AS digest FROM events")
def decoded_bodies(d: Data) -> DataFrame:
    n = F.col("event_id")
    text = F.concat(F.lit("café "), n.cast("string"))
    body = F.when(n % 4 == 0, F.encode(text, "ISO-8859-1")).when(n % 4 == 1, F.encode(F.concat(F.lit('<meta charset="latin-1">'), text), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    header = F.when(n % 4 == 0, "text/html; charset=ISO-8859-1").when(n % 4 == 2, "text/html; charset=no-such").when(n % 4 == 3, "text/html; charset=UTF-8")
    return d.events.select("event_id", F.md5(payload.decoded(body, header)).alias("digest"))


@query("crawl_keys", r"SELECT page_id, concat(regexp_replace(lower(regexp_extract(rest, '^([^?]*)', 1)), '/+$', ''), CASE WHEN contains(rest, '?') THEN regexp_extract(rest, '(\?.*)$', 1) ELSE '' END) AS crawl_key FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages)")
def crawl_keys(d: Data) -> DataFrame:
    return d.pages.select("page_id", tx.crawl_key(F.col("url")).alias("crawl_key"))


@query("canonical_websites", f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('https://', {DOMAIN.format('url')}, '/') WHEN 1 THEN concat('http://', {DOMAIN.format('url')}, '/a?b=1') END AS website FROM pages")
def canonical_websites(d: Data) -> DataFrame:
    host = tx.registrable_domain(F.col("url"))
    n = F.col("page_id") % 4
    given = F.when(n == 0, F.concat(F.lit(" "), host)).when(n == 1, F.concat(F.lit("HTTP://"), host, F.lit("/a?b=1#c"))).when(n == 2, F.concat(F.lit("ftp://"), host)).otherwise("javascript:void(0)")
    return d.pages.select("page_id", tx.canonical_website(given).alias("website"))


@query("crawl_order", "SELECT contact_id FROM (SELECT *, row_number() OVER w AS n, bool_or(wa_evidence >= 0.9) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AND bool_or(kind = 'email') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM (SELECT * FROM contacts QUALIFY row_number() OVER (PARTITION BY business_id, source_url ORDER BY contact_id) = 1) WINDOW w AS (PARTITION BY business_id ORDER BY contact_id)) WHERE n <= 4 AND NOT coalesce(done, false)")
def crawl_order(d: Data) -> DataFrame:
    pages = d.contacts.select("contact_id", F.col("business_id").alias("site"), F.col("contact_id").alias("place"), F.col("source_url").alias("key"), (F.col("wa_evidence") >= 0.9).alias("confirmed"), (F.col("kind") == "email").alias("mails"))
    return sites.crawl_order(pages).select("contact_id")


# --- numbers and profiles -----------------------------------------------------------------------


@query("phones_in_notes", "SELECT contact_id, unnest(CASE contact_id % 6 WHEN 0 THEN [concat('+923', digits)] WHEN 1 THEN [concat('+923', digits), '+924235772057'] WHEN 2 THEN [] WHEN 3 THEN ['+9242111117638'] WHEN 4 THEN [] ELSE [concat('+923', digits)] END) AS e164 FROM (SELECT contact_id, concat('00', lpad(CAST(contact_id % 10000000 AS VARCHAR), 7, '1')) AS digits FROM contacts)")
def phones_in_notes(d: Data) -> DataFrame:
    """Numbers in sentences: mobiles, a landline in brackets, a UAN, a price, a national id, one written twice."""
    n = F.lpad((F.col("contact_id") % 10000000).cast("string"), 7, "1")
    k = F.col("contact_id") % 6
    note = F.when(k == 0, F.concat(F.lit("call 0300-"), n)).when(k == 1, F.concat(F.lit("+92 300 "), n, F.lit(" or (042) 35772057"))).when(k == 2, F.concat(F.lit("Rs 0300"), n)).when(k == 3, "UAN 042 111 117 638").when(k == 4, F.concat(F.lit("id 35202-"), n, F.lit("-1"))).otherwise(F.concat(F.lit("0300"), n, F.lit(", again 0092300"), n))
    return d.contacts.select("contact_id", F.explode(ph.extract_phones(note)).alias("p")).select("contact_id", "p.e164")


@query("social_links", "SELECT contact_id, CASE contact_id % 5 WHEN 0 THEN 'https://shop.example.pk/a b?x=1' WHEN 1 THEN 'https://linktr.ee/x' WHEN 2 THEN NULL WHEN 3 THEN 'https://wa.me/923001234567' ELSE 'https://www.foodpanda.pk/r' END AS bio_link, CASE contact_id % 5 WHEN 0 THEN 'store' WHEN 1 THEN 'bio_hub' WHEN 2 THEN 'none' WHEN 3 THEN 'wa.me' ELSE 'aggregator' END AS destination FROM contacts")
def social_links(d: Data) -> DataFrame:
    shim = lambda target: F.lit(f'<a href="https:\\/\\/l.facebook.com\\/l.php?u={target}&amp;h=1">')
    k = F.col("contact_id") % 5
    html = F.when(k == 0, shim(r"https%3A%2F%2Fshop.example.pk%2Fa%20b%3Fx%3D1")).when(k == 1, F.lit(r'{"external_url":"https:\/\/linktr.ee\/x"}')).when(k == 2, shim("https")).when(k == 3, shim("https%3A%2F%2Fwa.me%2F923001234567")).otherwise(shim(r"https%3A%2F%2Fwww.foodpanda.pk%2Fr"))
    link = social.bio_link(social.unescaped(html), F.when(k == 1, "instagram").otherwise("facebook"))
    return d.contacts.select("contact_id", link.alias("bio_link")).withColumn("destination", social.destination(F.col("bio_link")))


@query("profile_urls", "SELECT contact_id, concat('https://www.instagram.com/u', contact_id, CASE WHEN contact_id % 3 = 1 THEN '?x=1' ELSE '' END) AS url, concat('https://www.instagram.com/u', contact_id, CASE WHEN contact_id % 3 = 1 THEN '?x=1&__render=1' ELSE '?__render=1' END) AS archived FROM contacts")
def profile_urls(d: Data) -> DataFrame:
    n = F.col("contact_id")
    given = F.concat(F.lit("https://www.instagram.com/u"), n.cast("string"), F.when(n % 3 == 0, "/profilecard/?igsh=1").when(n % 3 == 1, "?x=1").otherwise(""))
    own = social.profile_url(given, F.lit("instagram"))
    return d.contacts.select("contact_id", own.alias("url"), social.render_key(own).alias("archived"))


@query("page_contacts", why="a parser with ancestry; tested on inline pages")
def page_contacts(d: Data) -> DataFrame:
    return d.pages.select("page_id", web.parse_page("url", "html").alias("p")).select("page_id", web.has_any_contact(F.col("p")).alias("any"), F.size("p.offers").alias("n_offers"), F.size("p.owners").alias("n_owners"))


@query("archive_lookup", "SELECT url, found.event_id IS NOT NULL AS hit, found.event_id FROM (SELECT concat('https://h.pk/', page_id % 30) AS url, page_id % 30 AS k FROM pages) LEFT JOIN (SELECT event_id % 25 AS k, max({'ts': ts, 'event_id': event_id}) AS found FROM events WHERE ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END > TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1) USING (k)")
def archive_lookup(d: Data) -> DataFrame:
    """Wanted pages against archived bodies, found by the hash of their address whatever its spelling."""
    n = F.col("event_id")
    rows = d.events.select(F.concat(F.lit("HTTPS://WWW.h.pk:443/"), (n % 25).cast("string"), F.lit("/?utm_source=x")).alias("url"), "event_id", F.when(n % 2 == 0, "listing").otherwise("detail").alias("kind"), F.col("ts").alias("fetched_at"))
    wanted = d.pages.select(F.concat(F.lit("https://h.pk/"), (F.col("page_id") % 30).cast("string")).alias("url"))
    return payload.looked_up(wanted, payload.archive_rows(rows), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select("url", "hit", "event_id")


@query("payload_strings", "SELECT n_nationkey, path, value FROM (SELECT n_nationkey, unnest(['$[0]', '$[1][1][name]', '$[1][2][0]']) AS path, unnest([n_name, r_name, 'x']) AS value FROM nation JOIN region ON n_regionkey = r_regionkey)")
def payload_strings(d: Data) -> DataFrame:
    table = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey"))
    doc = F.format_string('["%s", [1, {"name": "%s", "n": null}, ["x"]]]', F.col("n_name"), F.col("r_name"))
    return table.select("n_nationkey", F.explode(payload.walk_strings(doc)).alias("s")).select("n_nationkey", "s.path", "s.value")


@query("url_slugs", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'cafes' ELSE url END AS slug FROM pages")
def url_slugs(d: Data) -> DataFrame:
    url = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/category/cafes/city:x"))).otherwise(F.col("url"))
    return d.pages.select("page_id", payload.url_slug(url).alias("slug"))


@query("distinct_sample", "SELECT business_id, website FROM businesses WHERE website <> '' QUALIFY row_number() OVER (PARTITION BY website ORDER BY business_id) = 1 ORDER BY md5(concat('7 ', website)), website LIMIT 20")
def distinct_sample(d: Data) -> DataFrame:
    return taxonomy.sampled(d.businesses.where("website <> ''"), "website", 20, 7).select("business_id", "website")


@query("query_counts", "SELECT r_name AS city, 'salon' AS category, count(*) * 3 AS queries FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def query_counts(d: Data) -> DataFrame:
    tiles = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("city"), F.col("n_name").alias("tile"))
    words = d.spark.sql("SELECT 'salon' AS category, explode(array('salon', 'barber', 'spa')) AS word")
    return taxonomy.query_counts(tiles, words)


@query("excluded_sources", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in taxonomy.EXCLUDED.items()) + ") t(source, reason)")
def excluded_sources(d: Data) -> DataFrame:
    return taxonomy.excluded(d.spark)
