"""Extraction, joins, discovery, storage and history over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.columns import HOST, sql_clean, sql_entities
from queries.registry import query, spread, table
from sitelens import catalogue
from sitelens.functions import elements as P
from sitelens.functions import text as X
from sitelens.functions import urls as U
from sitelens.limits import INTERACTIVE
from sitelens.operators import context as A
from sitelens.operators import discovery as D
from sitelens.operators import findings as Fi
from sitelens.operators import rules as R
from sitelens.operators import trackers as T
from sitelens.operators.page_facts import page_facts
from sitelens.plans.audit import stage_facts
from sitelens.sources import store
from sitelens.sources.crawl import parse_robots, parse_sitemaps, sitemap_urls
from sitelens.sources.leads import INDUSTRIES, normalize_leads
from sitelens.sources.leads import normalize_leads, read_leads
from sitelens.sources.staging import staged, work_dir

c = F.col
_facts: dict = {}


def page_table(spark, sf):
    """Facts of the plain pages, written once per session and scale."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _facts:
        _facts[key] = stage_facts(spread(spark, sf, "pages"), work_dir(spark))
    return _facts[key]


def vals(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def by_mod(rows, key, names):
    """Column that picks a row of fixed values by key modulo their number."""
    arr = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return F.get(arr, (c(key) % len(rows)).cast("int"))


# ---- leads ----------------------------------------------------------------------------
@query("s02_normalize_leads", """
SELECT c_custkey::VARCHAR AS site_id, CASE WHEN c_custkey % 5 = 1 THEN '' ELSE c_name END AS company_name, 'site' || c_custkey || '.ru' AS site_url,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'недвижимость' WHEN 'MACHINERY' THEN 'IT/SaaS' ELSE 'auto' END AS industry,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'a@b.ru' END AS email FROM customer WHERE c_custkey % 7 <> 0""")
def s02(spark, sf):
    k = c("c_custkey")
    url = F.concat(F.lit(" site"), k, F.lit(".ru "))
    raw = table(spark, sf, "customer").select(
        k.alias("site_id"), F.when(k % 5 == 1, "NaN").otherwise(c("c_name")).alias("company_name"),
        F.when(k % 7 == 0, "nan").when(k % 2 == 0, url).alias("site_url"), F.when((k % 2 == 1) & (k % 7 != 0), url).alias("url"),
        F.when(c("c_mktsegment") == "BUILDING", " недвижимость ").when(c("c_mktsegment") == "MACHINERY", "IT/SaaS").otherwise(c("c_mktsegment")).alias("industry"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(" a@b.ru").alias("email"))
    return normalize_leads(raw).select("site_id", "company_name", "site_url", "industry", "email")


# ---- robots and sitemaps --------------------------------------------------------------
@query("s05_parse_robots", """
SELECT page_id, page_id % 6 <> 5 AS found, CASE WHEN page_id % 6 = 5 THEN '' ELSE 'https://h' || page_id || '.ru/map.xml|https://cdn.ru/s' || page_id || '.xml' END AS sitemaps,
  CASE WHEN page_id % 6 = 5 THEN '' ELSE '/admin|/x' || page_id END AS disallow FROM pages""")
def s05(spark, sf):
    n = c("page_id").cast("string")
    body = F.concat(F.lit("# robots\nUser-agent: *\r\nDISALLOW: /admin # no\nDisallow:\nDisallow: /x"), n,
                    F.lit("\nSitemap: /map.xml\nsitemap : https://cdn.ru/s"), n, F.lit(".xml\nDisallow: /admin\nnonsense"))
    df = table(spark, sf, "pages").select(
        c("page_id").alias("site_id"), F.concat(F.lit("https://h"), n, F.lit(".ru")).alias("base_url"),
        F.when(c("page_id") % 6 == 5, 404).otherwise(200).alias("status_code"), body.alias("body"))
    return parse_robots(df).select(c("site_id").alias("page_id"), c("robots_txt_found").alias("found"),
                                   F.array_join("sitemaps", "|").alias("sitemaps"), F.array_join("disallow", "|").alias("disallow"))


@query("s06_s07_sitemaps", """
WITH h AS (SELECT page_id, page_id % 4 AS k, 'https://h' || page_id || '.ru' AS b FROM pages)
SELECT page_id, b || '/p' || i AS url FROM h, (SELECT unnest(range(0, 5)) AS i) WHERE k = 0
UNION ALL SELECT page_id, b || '/c' || j || '/p' || i FROM h, (SELECT unnest(range(0, 3)) AS j), (SELECT unnest(range(0, 5)) AS i) WHERE k = 1""")
def s06(spark, sf):
    k, base = c("page_id") % 4, F.concat(F.lit("https://h"), c("page_id").cast("string"), F.lit(".ru"))
    h = table(spark, sf, "pages").select(c("page_id").alias("site_id"), k.alias("k"), base.alias("base_url"))

    def urlset(prefix):
        locs = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(
            F.lit("<url><loc> "), prefix, F.lit("/p"), i.cast("string"), F.lit(" </loc></url>"))))
        return F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), locs, F.lit("</urlset>"))

    kids = F.sequence(F.lit(0), F.lit(4))
    index = F.concat(F.lit("<sitemapindex>"), F.concat_ws("", F.transform(kids, lambda j: F.concat(
        F.lit("<sitemap><loc>"), c("base_url"), F.lit("/c"), j.cast("string"), F.lit(".xml</loc></sitemap>")))), F.lit("</sitemapindex>"))
    own = h.select(F.concat("base_url", F.lit("/sitemap.xml")).alias("url"), F.when(c("k") == 0, urlset(c("base_url"))).when(
        c("k") == 1, index).when(c("k") == 2, F.concat(F.lit("<!DOCTYPE x>"), urlset(c("base_url")))).otherwise("<urlset><broken>").alias("body"))
    children = h.where("k = 1").select("base_url", F.explode(kids).alias("j")).select(
        F.concat("base_url", F.lit("/c"), "j", F.lit(".xml")).alias("url"), urlset(F.concat("base_url", F.lit("/c"), "j")).alias("body"))
    robots = spark.createDataFrame([], "site_id bigint, sitemaps array<string>")
    return sitemap_urls(h, robots, parse_sitemaps(own.unionByName(children)), INTERACTIVE).select(c("site_id").alias("page_id"), "url")


# ---- element extraction ---------------------------------------------------------------
@query("h01_page_facts", f"""
SELECT page_id, length(html) AS html_length, {sql_clean(sql_entities("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS title, 0 AS n_forms, 0 AS n_trackers FROM pages""")
def h01(spark, sf):
    return page_table(spark, sf).select("page_id", "html_length", "title", F.size("forms").alias("n_forms"), F.size("trackers").alias("n_trackers"))


@query("h02_h03_anchors", f"""
WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages),
e AS (SELECT page_id, url, unnest(h) AS href, unnest(t) AS text, unnest(range(0, len(h))) AS pos FROM a)
SELECT page_id, pos, href, {sql_clean('text')} AS text, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href AS abs_url FROM e""")
def h02(spark, sf):
    return page_table(spark, sf).select("page_id", F.posexplode("anchors").alias("pos", "a")).select(
        "page_id", "pos", "a.href", "a.text", c("a.url").alias("abs_url"))


@query("g01_h03_distinct_links", """
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h FROM pages)
SELECT page_id, len(list_distinct(h)) AS n, array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), '|') AS hrefs FROM a""")
def h03(spark, sf):
    rel = F.transform("links", lambda u: F.regexp_replace(u, "^[a-z]+://[^/]+", ""))
    return page_table(spark, sf).select("page_id", F.size("links").alias("n"), F.array_join(rel, "|").alias("hrefs"))


@query("h05_set_cookie", """
SELECT page_id, name, value, domain FROM (
  SELECT page_id, 'sid' AS name, page_id::VARCHAR || '=x' AS value, 'shop' || page_id || '.ru' AS domain FROM pages
  UNION ALL SELECT page_id, '_ga', 'GA1', %s FROM pages)""" % HOST)
def h05(spark, sf):
    n = c("page_id").cast("string")
    header = F.concat(F.lit("sid="), n, F.lit("=x; Path=/; Domain=.shop"), n, F.lit(".ru; Secure\n _ga=GA1; HttpOnly\nbroken\n"))
    return table(spark, sf, "pages").select("page_id", F.explode(T.parse_set_cookie(header, c("url"))).alias("k")).select("page_id", "k.*")


# ---- joins against catalogues ---------------------------------------------------------
COOKIES = [("_ga_ABC", "analytics", "Google Analytics"), ("x_ym_uid", "analytics", "Яндекс.Метрика"), ("_roistat_visit", "marketing", "Roistat"),
           ("session", "unknown", ""), ("TMR_lvid", "marketing", "Top.Mail.ru / VK"), ("_hjSessionUser", "analytics", "Hotjar")]


@query("j03_classify_cookies", f"""
SELECT event_id, name, category, provider, category IN ('analytics', 'marketing') AS is_tracking
FROM (SELECT event_id, (event_id % {len(COOKIES)})::INT AS k FROM events) JOIN (SELECT row_number() OVER () - 1 AS k, * FROM {vals(COOKIES)} t(name, category, provider)) v USING (k)""")
def j03(spark, sf):
    ck = F.array(F.struct(by_mod([(x[0],) for x in COOKIES], "event_id", ["name"])["name"].alias("name"), F.lit("v").alias("value"), F.lit("d").alias("domain")))
    return spread(spark, sf, "events").select("event_id", F.explode(T.classify_cookies(ck)).alias("k")).select(
        "event_id", "k.name", "k.category", "k.provider", "k.is_tracking")


HITS = [("https://mc.yandex.ru/x", "", "", "", "Яндекс.Метрика", "mc.yandex.ru", "script"), ("", "https://JIVO.ru/w", "", "", "Jivo (JivoSite)", "jivo.ru", "iframe"),
        ("", "", "https://js.stripe.com/v3", "", "Stripe", "stripe.com", "network"), ("", "", "", "fbq(1)", "Meta Pixel (Facebook)", "", "html"),
        ("https://a.ru/fs.js", "", "https://fullstory.com/s", "", "FullStory", "fs.js", "script"), ("", "", "", "", "", "", "")]


@query("j01_j02_tracker_hits", f"""
SELECT event_id, provider_name, matched_domain, matched_on FROM (SELECT event_id, (event_id % {len(HITS)})::INT AS k FROM events)
JOIN (SELECT row_number() OVER () - 1 AS k, provider_name, matched_domain, matched_on FROM {vals(HITS)} t(a, b, c, d, provider_name, matched_domain, matched_on)) v USING (k)
WHERE provider_name <> ''""")
def j01(spark, sf):
    r = by_mod([x[:4] for x in HITS], "event_id", ["s", "i", "n", "h"])
    df = spread(spark, sf, "events").withColumn("r", r)
    hits = T.tracker_hits(F.array("r.s"), F.array("r.i"), F.array("r.n"), F.lower("r.h"))
    return df.select("event_id", F.explode(hits).alias("t")).select("event_id", "t.provider_name", "t.matched_domain", "t.matched_on")


NETS = [("https://x.akamaihd.net/a", "Akamai", ""), ("https://cdnjs.cloudflare.com/gtag/js", "Cloudflare", "Google Analytics"),
        ("https://b-cdn.net/hotjar.com", "BunnyCDN", "Hotjar"), ("https://own.ru/", "", "")]


@query("j04_j05_requests_cdn", f"""
SELECT event_id, cdn, risky FROM (SELECT event_id, (event_id % {len(NETS)})::INT AS k FROM events)
JOIN (SELECT row_number() OVER () - 1 AS k, cdn, risky FROM {vals(NETS)} t(u, cdn, risky)) v USING (k)""")
def j04(spark, sf):
    u = F.array(F.lit("https://first.ru"), by_mod([(x[0],) for x in NETS], "event_id", ["u"])["u"])
    return spread(spark, sf, "events").select(
        "event_id", F.coalesce(T.cdn(u), F.lit("")).alias("cdn"), F.array_join(T.risk_requests(u), "|").alias("risky"))


@query("j09_server_country", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE n_name END AS country,
  CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 80 END AS confidence
FROM (SELECT c.*, CASE WHEN c_custkey % 5 = 3 THEN 'V6 ' || n_name WHEN c_custkey % 5 = 4 AND c_custkey % 256 >= 192 THEN 'WIDE' ELSE n_name END AS n_name FROM customer c JOIN nation ON c_nationkey = n_nationkey)""")
def j09(spark, sf):
    """/8 ranges of nations, a small range inside each (the wide one begins first and counts), one that
    overlaps the end of each and ends in the next /8, and IPv6 ranges over several groups."""
    block = 16777216
    n, top = table(spark, sf, "nation"), (c("n_nationkey") + 60) * block

    def dotted(x):
        return F.concat_ws(".", *(F.shiftright(x.cast("long"), s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))

    def rows(lo, hi, name):
        return n.select(lo.alias("first_ip"), hi.alias("last_ip"), name.alias("country"))

    group = F.lower(F.hex(c("n_nationkey") + 4096))
    ranges = (rows(dotted(top), dotted(top + block * 3 / 4 - 1), c("n_name"))
              .union(rows(dotted(top + 256), dotted(top + 511), F.lit("inside")))
              .union(rows(dotted(top + block / 2), dotted(top + block - 1), F.lit("WIDE")))
              .union(rows(F.concat(F.lit("2a00:"), group, F.lit("::")), F.concat(F.lit("2a00:"), group, F.lit(":ffff:ffff:ffff:ffff:ffff:ffff")), F.concat(F.lit("V6 "), "n_name"))))
    second = (c("c_custkey") % 256).cast("string")
    v4 = F.concat((c("c_nationkey") + 60).cast("string"), F.lit("."), second, F.lit(".1.1"))
    v6 = F.concat(F.lit("2A00:"), F.hex(c("c_nationkey") + 4096), F.lit(":0:1::"), second)
    low = F.concat((c("c_nationkey") + 60).cast("string"), F.lit("."), (c("c_custkey") % 192).cast("string"), F.lit(".1.1"))
    m = c("c_custkey") % 5
    ips = F.array(F.lit("10.0.0.1"), F.when(m == 0, "192.168.1.1").when(m == 3, v6).when(m == 4, F.concat(F.lit("::ffff:"), v4)).otherwise(low))
    sites = table(spark, sf, "customer").select(c("c_custkey").alias("site_id"), F.posexplode(ips).alias("ip_pos", "ip"))
    return A.server_country(sites, ranges).select(c("site_id").alias("c_custkey"), c("server_country").alias("country"), c("geoip_confidence").alias("confidence"))


@query("j14_a11_liability", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 0 ELSE (ARRAY[700000, 100000, 0])[c_custkey % 4 + 1] + 100000 END::BIGINT AS total,
  CASE c_custkey % 4 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS separate FROM customer""")
def j14(spark, sf):
    labels = {x["kind"]: x["label"] for x in catalogue.liability()}
    kinds = F.get(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in (
        (labels["consent"].upper(), labels["policy"]), (labels["policy"], labels["policy"]), (labels["cross_border"], labels["policy"]), ("", "прочее"))]),
        (c("c_custkey") % 4).cast("int"))
    f = table(spark, sf, "customer").select(c("c_custkey").alias("site_id"), F.posexplode(kinds).alias("rank", "liability_hint"))
    out = Fi.liability_summary(Fi.attach_liability(f, catalogue.load_liability(spark)))
    return out.select(c("site_id").alias("c_custkey"), c("liability_total").alias("total"), c("liability_separate").alias("separate"))


# ---- discovery on stored pages --------------------------------------------------------
def _homes(spark, sf):
    """Every stored page as the homepage of a site of its own."""
    return page_table(spark, sf).select(
        c("page_id").alias("site_id"), "url", "uid", U.base_from_url(c("url")).alias("base_url"), F.lit(True).alias("reachable"), F.lit(20).alias("max_pages"))


@query("d01_homepage_links", f"""
WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS b, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages),
e AS (SELECT page_id, b || unnest(h) AS url, unnest(t) AS text, unnest(range(0, len(h))) AS pos FROM a)
SELECT page_id, url, min(pos) AS pos, arg_min({sql_clean('text')}, pos) AS text FROM e GROUP BY page_id, url""")
def d01(spark, sf):
    homes = _homes(spark, sf).withColumnRenamed("uid", "home_uid")
    return D.homepage_links(homes, page_table(spark, sf)).select(c("site_id").alias("page_id"), "url", "pos", "text")


LINK_CASES = [("/legal/doc-42", "Политика обработки", 1), ("/privacy.pdf", "", 1), ("/a.jpg", "Политика", 1), ("/policy.css", "", 0), ("/contacts", "", 3),
              ("/zapis", "Запись на приём", 1), ("/uslugi", "Наши услуги", 3), ("/catalog/1", "Товар", 0), ("/terms", "", 1), ("/blog", "", 0)]


@query("d02_link_tier", f"""
SELECT event_id, tier FROM (SELECT event_id, (event_id % {len(LINK_CASES)})::INT AS k FROM events)
JOIN (SELECT row_number() OVER () - 1 AS k, tier FROM {vals(LINK_CASES)} t(u, x, tier)) v USING (k)""")
def d02(spark, sf):
    x = by_mod([r[:2] for r in LINK_CASES], "event_id", ["u", "x"])
    df = spread(spark, sf, "events").withColumn("x", x)
    return df.select("event_id", F.coalesce(D.link_tier(F.concat(F.lit("https://a.ru"), "x.u"), c("x.x")), F.lit(0)).alias("tier"))


@query("d03_plan_pages", """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderkey % 4 AS kind FROM orders),
l AS (SELECT o_custkey, 'https://s.ru/' || CASE kind WHEN 0 THEN 'privacy/' WHEN 1 THEN 'contact/' WHEN 2 THEN 'catalog/' ELSE 'terms/' END || o_orderkey AS url,
      CASE WHEN kind = 1 THEN 3 WHEN kind = 2 THEN NULL ELSE 1 END AS tier, pos FROM o),
g AS (SELECT c.o_custkey, 'https://s.ru' || p AS url, 4 AS tier, i AS pos FROM (SELECT DISTINCT o_custkey FROM orders) c,
      (SELECT unnest(['/contacts','/contact','/kontakty','/privacy','/privacy-policy','/policy','/personal-data','/personal-data-policy']) AS p, unnest(range(0, 8)) AS i)),
t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, tier ORDER BY pos) AS k FROM (SELECT * FROM l WHERE tier IS NOT NULL UNION ALL SELECT * FROM g)),
r AS (SELECT o_custkey, url, row_number() OVER (PARTITION BY o_custkey ORDER BY tier, pos) AS plan_pos FROM t WHERE tier = 1 OR (tier = 3 AND k <= 4) OR (tier = 4 AND k <= 8))
SELECT * FROM r WHERE plan_pos <= 12""")
def d03(spark, sf):
    kind = c("o_orderkey") % 4
    part = F.when(kind == 0, "privacy/").when(kind == 1, "contact/").when(kind == 2, "catalog/").otherwise("terms/")
    links = spread(spark, sf, "orders").select(
        c("o_custkey").alias("site_id"), c("o_orderkey").alias("pos"), F.lit("").alias("text"), F.concat(F.lit("https://s.ru/"), part, "o_orderkey").alias("url"))
    homes = links.select("site_id").distinct().withColumns({"base_url": F.lit("https://s.ru"), "reachable": F.lit(True), "max_pages": F.lit(20)})
    sitemap = spark.createDataFrame([], "site_id bigint, pos bigint, url string")
    return D.plan_pages(links, sitemap, homes, 12, INTERACTIVE).select(c("site_id").alias("o_custkey"), "url", "plan_pos")


DOC_PATHS = list(P.GUESS_PATHS.items())


@query("d04_d05_candidates", f"""
WITH g AS (SELECT row_number() OVER () - 1 AS i, * FROM {vals(DOC_PATHS)} t(path, doc_type))
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || path AS url, doc_type, 'priority_path' AS source, i + 1 AS cand_pos FROM pages, g""")
def d04(spark, sf):
    """Driver pages link no documents, so every site keeps exactly the usual paths."""
    facts = page_table(spark, sf)
    audit = facts.withColumns({"site_id": c("page_id"), "page_pos": F.lit(0)})
    sitemap = spark.createDataFrame([], "site_id bigint, pos bigint, url string")
    out = D.dedupe_candidates(D.doc_candidates(audit, sitemap, _homes(spark, sf)))
    return out.select(c("site_id").alias("page_id"), "url", "doc_type", "source", "cand_pos")


@query("d05_dedupe_candidates", """
WITH x AS (SELECT o_custkey, 'https://s.ru/d' || o_orderkey % 3 AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'other' ELSE 'offer' END AS doc_type,
  (['anchor','page_link','priority_path','sitemap'])[o_orderkey % 4 + 1] AS source, o_orderkey AS pos, o_orderkey % 4 + 1 AS src_pos FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, url ORDER BY doc_type = 'other', src_pos, pos) AS k,
  min((src_pos, pos)) OVER (PARTITION BY o_custkey, url) AS first_at FROM x)
SELECT o_custkey, url, doc_type, source, row_number() OVER (PARTITION BY o_custkey ORDER BY first_at) AS cand_pos FROM w WHERE k = 1""")
def d05(spark, sf):
    k = (c("o_orderkey") % 4).cast("int")
    cands = table(spark, sf, "orders").select(
        c("o_custkey").alias("site_id"), F.concat(F.lit("https://s.ru/d"), (c("o_orderkey") % 3).cast("string")).alias("url"),
        F.when(k == 0, "other").otherwise("offer").alias("doc_type"), F.get(F.array(*map(F.lit, D.SOURCE_RANK)), k).alias("source"),
        F.get(F.array(*map(F.lit, (1, 2, 3, 4))), k).alias("src_pos"), F.lit(0).alias("page_pos"), c("o_orderkey").alias("pos"),
        F.lit("").alias("anchor_text"), F.lit("").alias("title"), F.lit("").alias("page_url"))
    return D.dedupe_candidates(cands).select(c("site_id").alias("o_custkey"), "url", "doc_type", "source", "cand_pos")


@query("g02_g03_known_urls", """
SELECT DISTINCT page_id, 'https://s.ru/p' || page_id AS url, 'new' AS source FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)
UNION ALL SELECT doc_id, 'https://s.ru/p' || doc_id, 'known' FROM documents WHERE n_chars > 1000""")
def g02(spark, sf):
    known = table(spark, sf, "documents").where("n_chars > 1000").select(c("doc_id").alias("page_id"), F.concat(F.lit("https://s.ru/p"), "doc_id").alias("url"))
    new = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://s.ru/p"), "page_id", F.lit("/#x")).alias("url"))
    fresh = new.withColumn("k", U.url_key(c("url"))).join(known.select(U.url_key(c("url")).alias("k")), "k", "left_anti")
    return fresh.select("page_id", c("k").alias("url"), F.lit("new").alias("source")).unionByName(known.withColumn("source", F.lit("known")))


# ---- scores, history, storage ---------------------------------------------------------
def _scans(spark, sf):
    level = F.get(F.array(*map(F.lit, ("critical", "High", "medium", "low", "unknown"))), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return table(spark, sf, "orders").select(
        c("o_orderkey").cast("string").alias("scan_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.concat(F.lit("site"), "o_custkey", F.lit(".ru")).alias("site_url"), level.alias("risk_level"), (c("o_orderkey") % 151).cast("int").alias("risk_score"),
        F.lit("scanned").alias("status"))


SCANS = """scans AS (SELECT o_orderkey::VARCHAR AS scan_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, 'site' || o_custkey || '.ru' AS site_url,
  (['critical', 'High', 'medium', 'low', 'unknown'])[substr(o_orderpriority, 1, 1)::INT] AS risk_level, (o_orderkey % 151)::INT AS risk_score, 'scanned' AS status FROM orders)"""


@query("a08_a10_levels", """
SELECT o_orderkey, CASE WHEN s <= 20 THEN 'low' WHEN s <= 50 THEN 'medium' WHEN s <= 80 THEN 'high' ELSE 'critical' END AS level,
  CASE WHEN s >= 80 THEN 'critical' WHEN s >= 50 THEN 'high' WHEN s >= 25 THEN 'medium' ELSE 'low' END AS pd_level FROM (SELECT o_orderkey, o_orderkey % 120 AS s FROM orders)""")
def a08(spark, sf):
    s = c("o_orderkey") % 120
    return table(spark, sf, "orders").select("o_orderkey", R.score_level(s).alias("level"), Fi.commercial_level(s).alias("pd_level"))


@query("a07_w02_w03_rank_risks", """
WITH r AS (SELECT o_custkey, o_orderkey, (['critical', 'high', 'medium', 'low', 'unknown'])[substr(o_orderpriority, 1, 1)::INT] AS lvl, 5 - substr(o_orderpriority, 1, 1)::INT AS lr, (o_orderkey % 7 * 5)::INT AS score FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY lr DESC, score DESC, o_orderkey) AS k FROM r)
SELECT o_custkey, string_agg('t' || o_orderkey, '; ' ORDER BY k) FILTER (k <= 3) AS top_risks, least(150, sum(score))::INT AS score FROM w GROUP BY o_custkey""")
def a07(spark, sf):
    level = F.get(F.array(*map(F.lit, ("critical", "high", "medium", "low", "unknown"))), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    risks = R.rank_risks(table(spark, sf, "orders").select(
        c("o_custkey").alias("site_id"), c("o_orderkey").alias("rule_pos"), level.alias("risk_level"), (c("o_orderkey") % 7 * 5).cast("int").alias("score"),
        F.concat(F.lit("t"), "o_orderkey").alias("title")))
    total = risks.groupBy("site_id").agg(F.least(F.lit(150), F.sum("score")).cast("int").alias("score"))
    return R.top_titles(risks).join(total, "site_id").select(c("site_id").alias("o_custkey"), "top_risks", "score")


@query("a15_dashboard", f"""
WITH {SCANS}, l AS (SELECT * FROM scans ORDER BY created_at DESC, scan_id LIMIT 1000),
g AS (SELECT lower(risk_level) AS level, count(*) AS n FROM l GROUP BY 1)
SELECT sum(n)::BIGINT AS total, sum(n) FILTER (level IN ('high', 'critical'))::BIGINT AS high_critical, string_agg(level || '=' || n, ',' ORDER BY level) AS levels FROM g""")
def a15(spark, sf):
    pairs = F.transform(F.array_sort(F.map_entries("by_level")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return store.dashboard(_scans(spark, sf), 1000).select("total", "high_critical", F.array_join(pairs, ",").alias("levels"))


@query("w04_scan_history", f"WITH {SCANS} SELECT * FROM scans ORDER BY created_at DESC, scan_id LIMIT 500")
def w04(spark, sf):
    return store.scan_history(_scans(spark, sf), 500)


@query("w05_recent_scans", f"WITH {SCANS} SELECT * FROM scans ORDER BY created_at DESC, scan_id LIMIT 10")
def w05(spark, sf):
    return store.recent_scans(_scans(spark, sf))


@query("s12_s13_store_upsert", f"""
WITH {SCANS} SELECT scan_id, created_at, site_url, CASE WHEN scan_id::INT % 10 = 0 THEN 'low' ELSE risk_level END AS risk_level,
  CASE WHEN scan_id::INT % 10 = 0 THEN 0 ELSE risk_score END AS risk_score, status FROM scans
UNION ALL SELECT 'n' || scan_id, created_at, site_url, 'low', 0, status FROM scans WHERE scan_id::INT % 50 = 0""")
def s12(spark, sf):
    scans = _scans(spark, sf)
    path = f"{work_dir(spark)}/mart"
    store.write_scan_mart({"scans": scans}, path)
    changed = scans.where("scan_id % 10 = 0").withColumns({"risk_level": F.lit("low"), "risk_score": F.lit(0)})
    added = scans.where("scan_id % 50 = 0").withColumns({"scan_id": F.concat(F.lit("n"), "scan_id"), "risk_level": F.lit("low"), "risk_score": F.lit(0)})
    store.upsert_scans({"scans": changed.unionByName(added)}, path)
    return store.read_table(spark, path).drop("bucket")


@query("m07_update_status", f"""
WITH {SCANS} SELECT scan_id, CASE WHEN scan_id::INT % 3 = 0 THEN 'approved' ELSE status END AS status,
  CASE WHEN scan_id::INT % 3 = 0 THEN 'approved' ELSE status END AS json_status, risk_score AS json_score FROM scans""")
def m07(spark, sf):
    scans = store.to_scan_json(_scans(spark, sf))
    updates = scans.where("scan_id % 3 = 0").select("scan_id", F.lit("approved").alias("status")).unionByName(
        scans.where("scan_id % 3 = 1").select("scan_id", F.lit("bogus").alias("status")))
    j = F.from_json("raw_json", "status string, risk_score int")
    return store.update_status(scans, updates).select("scan_id", "status", j["status"].alias("json_status"), j["risk_score"].alias("json_score"))


@query("m08_delete_scans", f"WITH {SCANS} SELECT * FROM scans WHERE scan_id::INT % 4 <> 0")
def m08(spark, sf):
    scans = _scans(spark, sf)
    return store.delete_scans({"scans": scans}, scans.where("scan_id % 4 = 0"))["scans"]


@query("m09_s14_get_scan", f"WITH {SCANS} SELECT scan_id, created_at, site_url, risk_level, risk_score, status FROM scans WHERE scan_id = '7'")
def m09(spark, sf):
    one = store.get_scan(store.to_scan_json(_scans(spark, sf)).select("scan_id", "raw_json"), "7")
    return store.from_scan_json(one, "scan_id string, created_at string, site_url string, risk_level string, risk_score int, status string")


@query("s14_m09_nested_scan", """
SELECT l_orderkey::VARCHAR AS scan_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey) - 1)::INT AS pos, l_linenumber::INT AS line,
  l_quantity::DOUBLE AS quantity, l_partkey::BIGINT AS part, (count(*) OVER (PARTITION BY l_orderkey))::INT AS n_items, 'p' || min(l_partkey) OVER (PARTITION BY l_orderkey) AS first_tag, NULL::VARCHAR AS absent FROM lineitem""")
def s14(spark, sf):
    """Scans with nested items, written as one document each and read back by paths."""
    item = F.struct(c("l_linenumber").alias("line"), c("l_quantity").cast("double").alias("quantity"), F.struct(c("l_partkey").alias("key")).alias("part"))
    scans = table(spark, sf, "lineitem").groupBy(c("l_orderkey").cast("string").alias("scan_id")).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n"), F.array(F.concat(F.lit("p"), F.min("l_partkey"))).alias("tags"))
    docs = staged(store.to_scan_json(scans).select("scan_id", "raw_json"), work_dir(spark), "docs")
    whole = store.scan_values(docs, {"n_items": ("$.n", "int"), "first_tag": ("$.tags[0]", "string"), "absent": ("$.not.there", "string")})
    items = store.scan_items(docs, "$.items", {"line": "int", "quantity": "double", "part.key": "bigint"}).withColumnRenamed("part.key", "part")
    return items.join(whole, "scan_id")


@query("m10_report_register", "SELECT o_custkey::VARCHAR AS scan_id, arg_max('r' || o_orderkey || '.pdf', (strftime(o_orderdate, '%Y-%m-%d'), 'r' || o_orderkey || '.pdf')) AS pdf_path FROM orders GROUP BY o_custkey")
def m10(spark, sf):
    exports = table(spark, sf, "orders").select(
        c("o_custkey").cast("string").alias("scan_id"), F.concat(F.lit("r"), "o_orderkey", F.lit(".pdf")).alias("pdf_path"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    return store.report_register(exports)


@query("a12_g04_finding_groups", """
SELECT o_custkey, bool_or(o_orderkey % 3 = 0) AS papers, bool_or(o_orderkey % 3 = 1) AS services FROM orders GROUP BY o_custkey""")
def a12(spark, sf):
    ids = F.get(F.array(*map(F.lit, ("PD-01", "PD-12", "PD-99"))), (c("o_orderkey") % 3).cast("int"))
    f = table(spark, sf, "orders").select(c("o_custkey").alias("site_id"), ids.alias("finding_id"))
    return Fi.hidden_groups(f).select(c("site_id").alias("o_custkey"), F.array_contains("groups", "документы и реквизиты").alias("papers"),
                                      F.array_contains("groups", "cookies и сервисы").alias("services"))


@query("w06_a10_rank_findings", """
WITH f AS (SELECT o_custkey, 'PD-' || lpad((o_orderkey % 5)::VARCHAR, 2, '0') AS id, substr(o_orderpriority, 1, 1)::INT % 3 AS lr, (o_orderkey % 40)::INT AS score FROM orders),
b AS (SELECT o_custkey, id, max((lr, score)) AS m FROM f GROUP BY o_custkey, id)
SELECT o_custkey, id, m[1] + 1 AS lvl, m[2] AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY m[1] DESC, m[2] DESC, id DESC) AS rank FROM b""")
def w06(spark, sf):
    lr = (F.substring("o_orderpriority", 1, 1).cast("int") % 3)
    level = F.get(F.array(*map(F.lit, ("medium", "high", "critical"))), lr)
    f = table(spark, sf, "orders").select(
        c("o_custkey").alias("site_id"), F.concat(F.lit("PD-"), F.lpad((c("o_orderkey") % 5).cast("string"), 2, "0")).alias("finding_id"),
        level.alias("risk_level"), (c("o_orderkey") % 40).cast("int").alias("score"))
    return Fi.rank_findings(f).select(c("site_id").alias("o_custkey"), c("finding_id").alias("id"), X.level_rank(c("risk_level")).alias("lvl"), "score", "rank")


# ---- files in and out -------------------------------------------------------------------
@query("s01_read_leads", """
SELECT c_name AS company_name, 'https://site' || c_custkey || '.ru/a,"b"' AS site_url, CASE WHEN c_custkey % 3 = 0 THEN 'медицина' ELSE 'auto' END AS industry,
  c_mktsegment || chr(10) || 'line 2' AS comment, 7 AS max_pages, TRUE AS has_id FROM customer WHERE c_custkey % 11 <> 0""")
def s01(spark, sf):
    """Leads written as CSV with quotes, commas and line breaks, read back; some have only the url column, some no URL."""
    url = F.concat(F.lit("https://site"), "c_custkey", F.lit('.ru/a,"b"'))
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("  "), "c_name").alias("company_name"), F.when(c("c_custkey") % 7 != 0, F.when(c("c_custkey") % 11 != 0, url)).alias("site_url"),
        F.when(c("c_custkey") % 7 == 0, F.when(c("c_custkey") % 11 != 0, url).otherwise(" ")).alias("url"),
        F.when(c("c_custkey") % 3 == 0, "медицина").otherwise("космос").alias("industry"), F.concat("c_mktsegment", F.lit("\nline 2")).alias("comment"))
    path = f"{work_dir(spark)}/leads"
    rows.write.option("header", True).option("escape", "\"").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).csv(path)
    got = normalize_leads(read_leads(spark, path), 7)
    return got.select("company_name", "site_url", "industry", "comment", "max_pages", (F.length("site_id") == 12).alias("has_id"))


@query("s15_export", f"WITH {SCANS} SELECT scan_id, created_at, site_url, risk_level, risk_score::VARCHAR AS risk_score, status FROM scans")
def s15(spark, sf):
    path = f"{work_dir(spark)}/export"
    store.export_results(_scans(spark, sf), path)
    return spark.read.option("header", True).csv(path)
