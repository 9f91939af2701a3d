"""Nothing is left out by default: inputs longer than any limit of an interactive scan."""

import json

import pytest
from pyspark.sql import functions as F

from sitelens.functions import elements as P
from sitelens.functions import urls as U
from sitelens.limits import INTERACTIVE
from sitelens.operators import discovery as D
from sitelens.operators import trackers as T
from sitelens.operators.domains import host_domains, on_site, suffix_rules, with_domain, with_site_domain
from sitelens.operators.reduce import maybe_in
from sitelens.sources import store
from sitelens.sources.crawl import parse_sitemaps, sitemap_urls
from sitelens.sources.leads import normalize_leads
from sitelens.sources.staging import work_dir


def test_plan_of_many_links(spark):
    links = spark.range(1500).select(F.lit("s").alias("site_id"), F.col("id").alias("pos"), F.lit("").alias("text"),
                                     F.concat(F.lit("https://s.ru/privacy/"), "id").alias("url"))
    sitemap = spark.createDataFrame([], "site_id string, pos bigint, url string")
    homes = spark.createDataFrame([("s", "https://s.ru", True, None)], "site_id string, base_url string, reachable boolean, max_pages int")
    assert D.plan_pages(links, sitemap, homes).count() == 1500 + len(D.PLAN_GUESSES)
    assert D.plan_pages(links, sitemap, homes.withColumn("max_pages", F.lit(1400))).count() == 1400
    assert D.plan_pages(links, sitemap, homes, 30).count() == 30


def test_large_sitemaps(spark):
    def urlset(name, n):
        return "<urlset>" + "".join(f"<url><loc>https://s.ru/{name}/{i}</loc></url>" for i in range(n)) + "</urlset>"

    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://s.ru/c{i}.xml</loc></sitemap>" for i in range(6)) + "</sitemapindex>"
    maps = [("https://s.ru/m0.xml", urlset("m0", 500)), ("https://s.ru/m1.xml", index)] + [(f"https://s.ru/c{i}.xml", urlset(f"c{i}", 10)) for i in range(6)]
    maps += [(f"https://s.ru/m{i}.xml", urlset(f"m{i}", 5)) for i in range(2, 6)]
    sites = spark.createDataFrame([("s", "https://s.ru")], "site_id string, base_url string")
    robots = spark.createDataFrame([("s", [f"https://s.ru/m{i}.xml" for i in range(6)])], "site_id string, sitemaps array<string>")
    parsed = parse_sitemaps(spark.createDataFrame(maps, "url string, body string"))
    rows = sitemap_urls(sites, robots, parsed).orderBy("pos").collect()
    assert len({r.url for r in rows}) == len(rows) == 500 + 60 + 20 and [r.pos for r in rows] == list(range(1, 581))
    assert rows[499].url == "https://s.ru/m0/499" and rows[500].url == "https://s.ru/c0/0"
    assert sitemap_urls(sites, robots, parsed, INTERACTIVE).count() == 200 + 30 + 5


def test_all_scans_count(spark):
    scans = spark.range(1200).selectExpr("cast(id as string) scan_id", "concat('2024-', id) created_at", "'high' risk_level", "'{}' raw_json")
    assert store.dashboard(scans).first().total == 1200 and store.dashboard(scans, 1000).first().total == 1000
    history = store.scan_history(scans)
    assert history.count() == 1200 and "raw_json" not in history.columns


def test_keyword_far_behind(spark):
    df = spark.createDataFrame([("слово " * 3000 + "политика конфиденциальности",), ("слово " * 3000,)], "t string")
    hit = P.text_matches_doc_type(F.col("t"), F.lit("privacy_policy"), F.lit(""))
    assert [r[0] for r in df.select(hit).collect()] == [True, False]


def test_insecure_urls_of_a_site(spark):
    pages = spark.range(30).select(F.lit("s").alias("site_id"), F.col("id").alias("page_pos"), F.array(F.concat(F.lit("http://a.ru/"), "id")).alias("insecure"))
    assert T.mixed_content(pages).first().mixed_content_urls == [f"http://a.ru/{i}" for i in range(30)]
    assert len(T.mixed_content(pages, 20).first().mixed_content_urls) == 20


def test_status_of_the_scan_only(spark):
    scan = {"scan_id": "1", "status": "scanned", "items": [{"id": "a", "status": "found"}, {"id": "b", "status": "not_found"}],
            "deep": {"status": "x", "n": 1.5, "t": "ü \"q\" \\ \n"}, "none": None, "flag": True}
    rows = [("1", "scanned", json.dumps(scan)), ("2", "scanned", json.dumps(scan)), ("3", "scanned", "not json")]
    scans = spark.createDataFrame(rows, "scan_id string, status string, raw_json string")
    updates = spark.createDataFrame([("1", "sent"), ("3", "sent")], "scan_id string, status string")
    got = {r.scan_id: r for r in store.update_status(scans, updates).collect()}
    assert json.loads(got["1"].raw_json) == scan | {"status": "sent"} and got["1"].status == "sent"
    assert got["2"].raw_json == rows[1][2] and got["3"].raw_json == "not json" and got["3"].status == "sent"


def test_one_row_per_lead(spark):
    rows = [("A", "a.ru", 10, "full"), ("A", "a.ru", 20, None), ("B", "b.ru", None, "quick"), ("B", "b.ru", 5, "quick")]
    got = normalize_leads(spark.createDataFrame(rows, "company_name string, site_url string, max_pages int, scan_mode string")).orderBy("site_url").collect()
    assert [(r.site_url, r.max_pages, r.scan_mode) for r in got] == [("a.ru", 20, "full"), ("b.ru", None, "quick")]
    given = spark.createDataFrame([("x", "a.ru"), ("x", "b.ru"), ("y", "c.ru")], "site_id string, site_url string")
    assert [(r.site_id, r.site_url) for r in normalize_leads(given).orderBy("site_id").collect()] == [("x", "a.ru"), ("y", "c.ru")]


def test_public_suffixes(spark):
    hosts = {"shop.com.pl": "shop.com.pl", "a.co.id": "a.co.id", "b.a.com.sg": "a.com.sg", "www.shop.co.uk": "shop.co.uk", "a.b.ru": "b.ru",
             "co.de": "co.de", "www.a.de": "a.de", "127.0.0.1": "127.0.0.1", "[::1]": "[::1]", "a.kawasaki.jp": "kawasaki.jp"}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: r.domain for r in host_domains(df).collect()} == hosts
    own = suffix_rules(spark.createDataFrame([("// list\npl\n\n*.kawasaki.jp // note\n!city.kawasaki.jp\n// ===BEGIN PRIVATE DOMAINS===\nhosting.pl",)], "value string"))
    hosts = {"shop.com.pl": "com.pl", "a.x.city.kawasaki.jp": "city.kawasaki.jp", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "a.hosting.pl": "hosting.pl"}
    assert {r.host: r.domain for r in host_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), own).collect()} == hosts


def test_on_site_agrees_with_the_join(spark):
    """The row-wise test with the rules below a site's domain against both domains from the join."""
    from queries.columns import DOMAINS

    hosts = [h for h, _ in DOMAINS] + ["kawasaki.jp", "b.kawasaki.jp", "uk", "ck", "z.ck", "d.uk", "公司.cn", "cn"]
    df = spark.createDataFrame([(h,) for h in hosts], "base_url string")
    sites = with_site_domain(df)
    pairs = sites.crossJoin(df.withColumnRenamed("base_url", "u"))
    named = with_domain(pairs, F.col("u"), "other").select("base_url", "u", (F.col("other") == F.col("domain")).alias("want"), on_site(F.col("u"), F.col("domain"), F.col("below")).alias("got"))
    assert [tuple(r) for r in named.where("want <> got").collect()] == []


def test_rows_that_may_be_wanted(spark):
    wanted = spark.range(0, 4000, 40).select(F.col("id").alias("k"))
    rows = spark.range(20_000).select("id", F.concat(F.lit("x"), "id").alias("text"))
    got = {r.id for r in maybe_in(rows, "id", wanted).collect()}
    assert set(range(0, 4000, 40)) <= got and len(got) < 1500
    assert {r.id for r in maybe_in(rows, "id", wanted, max_blocks=1).collect()} >= set(range(0, 4000, 40))
    assert maybe_in(rows, "id", wanted.limit(0)).count() == 0


def test_texts_of_wanted_pages_alone_are_shuffled(spark):
    """Without automatic broadcasts no exchange carries texts or anchors that the Bloom filter has not seen."""
    from sitelens.operators import documents as W

    rows = [(i, f"https://s.ru/{i}", "t", 200, True, True, "text " * 50, "", [("h", f"https://s.ru/{i}", "x", "", True)], []) for i in range(50)]
    facts = spark.createDataFrame(rows, "uid long, url string, title string, status_code int, ok boolean, has_html boolean, doc_text string, html_head string, "
                                  "anchors array<struct<href: string, url: string, text: string, title: string, has_href: boolean>>, links array<string>").withColumns(
        {"final_url": F.col("url"), "html_length": F.lit(1), "text_length": F.lit(1), "site_id": F.lit("s"), "page_pos": F.lit(0), "stored": F.lit(True), "page_url": F.col("url")})
    homes = spark.createDataFrame([("s", "https://s.ru", True, 3)], "site_id string, base_url string, reachable boolean, home_uid long")
    cands = spark.createDataFrame([("s", 1, "https://s.ru/7", "https://s.ru/7", "offer", "", "", "anchor", "")],
                                  "site_id string, cand_pos int, key string, url string, doc_type string, anchor_text string, title string, source string, page_url string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = W.resolve_documents(cands, facts.limit(1), facts, homes)
        assert docs.count() == 1
        for df, wide in ((docs, "doc_text"), (D.homepage_links(homes, facts), "anchors")):
            lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
            depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
            carrying = 0
            for i, line in enumerate(lines):
                below = [x for j, x in enumerate(lines[i + 1:], i + 1) if all(d > depth[i] for d in depth[i + 1:j + 1])]
                if "Exchange hashpartitioning" in line and any("Scan" in x and wide in x for x in below):
                    carrying += 1
                    assert any("LeftSemi" in x and "_bits" in x for x in below), line
            assert carrying
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        work_dir(Session())


def test_network_from_headers(spark):
    from sitelens.operators.page_facts import page_facts

    rows = [("https://a.ru", "<p>x</p>", {"Server": "cloudflare", "CF-RAY": "1"}, True), ("https://b.ru", "<p>x</p>", {"server": "nginx"}, None),
            ("https://c.ru", "<p>x</p>", None, None), ("https://d.ru", "<p>x</p>", {"Via": "1.1 fastly", "VIA": "1.1 fastly"}, False)]
    got = {r.url: (r.cdn, r.has_screenshot) for r in page_facts(spark.createDataFrame(rows, "url string, html string, headers map<string,string>, has_screenshot boolean")).collect()}
    assert got == {"https://a.ru": ("Cloudflare", True), "https://b.ru": (None, False), "https://c.ru": (None, False), "https://d.ru": ("Fastly", False)}


def test_references_like_a_browser(spark):
    """Random references against the standard library, row by row."""
    import random
    from urllib.parse import urljoin

    rng = random.Random(3)
    bits = ["a", "b;p=1", ".", "..", "", "c.html", "é", "x y", "...", "..a"]
    bases = ["https://s.ru", "https://s.ru/", "http://u:p@s.ru:80/a/b/c?q=1#f", "https://s.ru/a//b/", "https://s.ru/a/b?x#", "HTTP://S.ru/q/w"]
    rows = []
    for _ in range(1500):
        path = rng.choice(["", "/"]) + "/".join(rng.choice(bits) for _ in range(rng.randrange(6)))
        ref = path + rng.choice(["", "", "?k=v", "?", "#z", "?a=/../b#c", "#"])
        if not ref.startswith("//"):
            rows.append((rng.choice(bases), ref))
    rows += [(b, r) for b in bases for r in ("//cdn.ru/x/../y?z", "https://o.ru/a/../b", "ftp://o.ru/x", "g:h", "https://[bad/x", "?", "", "//o.ru", "a\tb", "https://o.ru?x")]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", U.resolve(F.col("b"), F.col("r")).alias("u")).collect()

    def want(b, r):
        try:
            return urljoin(b, r)
        except ValueError:
            return ""

    bad = [(x.b, x.r, x.u, want(x.b, x.r)) for x in got if x.u != want(x.b, x.r)]
    assert bad[:8] == []


def test_labels_join_whole(spark):
    from sitelens.operators import findings as Fi

    long = "Штраф " + "очень длинный текст " * 12
    f = spark.createDataFrame([("s", 1, long), ("s", 2, " Короткий  ярлык "), ("s", 3, ""), ("s", 4, None)], "site_id string, rank int, liability_hint string")
    items = spark.createDataFrame([(long.upper(), "ст. 1", "1 000 ₽"), ("короткий ярлык", "", "5 руб")], "label string, basis string, amount string")
    assert [r.liability_amount for r in Fi.attach_liability(f, items).orderBy("rank").collect()] == [1000, 5, 0, 0]


def test_charsets(spark):
    from sitelens.sources.crawl import decode_bodies

    text = "Привет, мир"
    rows = [("a", text.encode("cp1251"), "text/html"), ("b", text.encode("koi8-r"), "text/html; charset=KOI8-R"), ("c", b" " * 9000 + b"<meta charset='cp866'>" + text.encode("cp866"), ""),
            ("d", text.encode("utf-16"), "text/html; charset=utf-16"), ("e", "日本".encode("shift_jis"), "text/plain; charset=shift_jis"), ("f", b"\x98\xff", "text/plain"), ("g", None, None),
            ("h", b"", "x"), ("i", b"%PDF", "application/pdf"), ("j", text.encode(), "text/html; charset=windows-1252x"), ("k", b"\x98" + text.encode("cp1251"), "charset=windows-1251")]
    df = spark.createDataFrame(rows, "url string, content binary, content_type string")
    got = {r.url: r.text for r in decode_bodies(df).collect()}
    assert got["a"] == got["b"] == got["d"] == got["j"] == text and got["c"].endswith("'cp866'>" + text) and got["e"] == "日本"
    assert got["f"] == "\x98ÿ" and (got["g"], got["h"], got["i"]) == ("", "", "") and got["k"][0] == "\x98"
    assert not {r.url: r.text for r in decode_bodies(df, INTERACTIVE).collect()}["c"].endswith(text)
