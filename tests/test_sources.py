import io
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sitelens import catalogue
from sitelens.functions import text as X
from sitelens.functions import urls as U
from sitelens.limits import INTERACTIVE
from sitelens.operators import discovery as D
from sitelens.sources import crawl, leads, store


def test_leads_from_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text('company_name,url,industry,extra\n"A, Inc",a.ru,медицина,1\nnan,,x,2\n  ,b.ru,космос,3\n', encoding="utf-8")
    rows = leads.normalize_leads(leads.read_leads(spark, str(tmp_path / "l.csv")), 20).orderBy("site_url").collect()
    assert [(r.company_name, r.site_url, r.industry, r.max_pages) for r in rows] == [("A, Inc", "a.ru", "медицина", 20), ("", "b.ru", "auto", 20)]
    assert len({r.site_id for r in rows}) == 2 and all(len(r.site_id) == 12 for r in rows)


def docx(paragraphs, cells):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def p(t):
        return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"

    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in cells) + "</w:tr></w:tbl>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p(paragraphs[0])}{table}{p(paragraphs[1])}</w:body></w:document>")
    return buf.getvalue()


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["Первый", "Второй"], ["Ячейка", ""]))
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.html").write_bytes("<meta charset=windows-1251><p>Привет<script>x</script>".encode("cp1251"))
    (tmp_path / "d.txt").write_bytes("Просто текст".encode())
    got = {r.url.rsplit("/", 1)[-1]: (r.format, r.text, r.error) for r in crawl.body_texts(crawl.read_documents(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": ("docx", "Первый\nВторой\nЯчейка", ""), "b.docx": ("docx", "", "text_extraction_failed"),
                   "c.html": ("html", "Привет", ""), "d.txt": ("html", "Просто текст", "")}
    assert crawl.docx_text(crawl.read_documents(spark, str(tmp_path)).where("url like '%a.docx'")).first().text.startswith("Первый")


def test_decode(spark):
    rows = [("a", "текст".encode("cp1251"), "text/html; charset=windows-1251"), ("b", "текст".encode(), None), ("c", b"\xff\xfe", "text/html"),
            ("d", b"x", "application/zip"), ("e", "я".encode(), "text/html; charset=nope")]
    df = spark.createDataFrame([(a, bytearray(b), c) for a, b, c in rows], "url string, content binary, content_type string")
    got = {r.url: r.text for r in crawl.decode_bodies(df).collect()}
    assert got == {"a": "текст", "b": "текст", "c": "яю", "d": "", "e": "я"}


def test_sitemap_guards(spark):
    bodies = [("ok", "junk<urlset xmlns='x'><url><loc> u1 </loc></url><url><loc/></url></urlset>"), ("dtd", "<!DOCTYPE a><urlset><url><loc>u</loc></url></urlset>"),
              ("bad", "<urlset><loc>u</loc>"), ("none", None)]
    got = {r.url: (r.kind, r.locs) for r in crawl.parse_sitemaps(spark.createDataFrame(bodies, "url string, body string")).collect()}
    assert got == {"ok": ("urlset", ["u1"]), "dtd": ("", []), "bad": ("", []), "none": ("", [])}


def test_sitemap_caps(spark):
    sites = spark.createDataFrame([("s", "https://s.ru")], "site_id string, base_url string")
    robots = spark.createDataFrame([("s", [f"m{i}" for i in range(5)])], "site_id string, sitemaps array<string>")
    maps = spark.createDataFrame([(f"m{i}", "urlset", [f"u{i}-{j}" for j in range(300)] + [f"u{i}-0"]) for i in range(5)], "url string, kind string, locs array<string>")
    rows = crawl.sitemap_urls(sites, robots, maps, INTERACTIVE).orderBy("pos").collect()
    assert [r.url for r in rows] == [f"u{i}-{j}" for i in range(3) for j in range(200)]


def test_targeted_plan(spark):
    """Twenty catalogue and twenty blog links, two documents, two form pages: only the last four are followed."""
    links = [(f"/catalog/{i}", "Товар") for i in range(20)] + [("/docs/1", "Политика"), ("/x", "Консультация"), ("/feedback", ""), ("/uslugi-2", "Услуги"),
                                                              ("/docs/1", "ещё раз")] + [(f"/blog/{i}", "Запасы") for i in range(20)]
    rows = [("s", i, "https://s.ru" + u, t) for i, (u, t) in enumerate(links)] + [("s", 99, "https://partner.ru/policy", "Политика")]
    df = D.first_links(spark.createDataFrame(rows, "site_id string, pos int, url string, text string"))
    homes = spark.createDataFrame([("s", "https://s.ru", True, 10)], "site_id string, base_url string, reachable boolean, max_pages int")
    sitemap = spark.createDataFrame([("s", 1, "https://s.ru/terms"), ("s", 2, "https://s.ru/goods")], "site_id string, pos int, url string")
    plan = [r.url.removeprefix("https://s.ru") for r in D.plan_pages(df, sitemap, homes).orderBy("plan_pos").collect()]
    assert plan[:5] == ["/docs/1", "/x", "/terms", "/feedback", "/uslugi-2"]
    assert plan[5:] == ["/contacts", "/contact", "/kontakty", "/privacy", "/privacy-policy"]
    many = spark.createDataFrame([("s", i, f"https://s.ru/contact/{i}", "") for i in range(6)], "site_id string, pos int, url string, text string")
    assert sum("/contact/" in r.url for r in D.plan_pages(many, sitemap.limit(0), homes, limits=INTERACTIVE).collect()) == 4


def test_broken_write_changes_nothing(spark, tmp_path, monkeypatch):
    """A job that dies between two tables, and one that another writer overtakes, leave the old scan whole."""
    path = str(tmp_path / "mart")
    scans = spark.range(8).select(F.col("id").cast("string").alias("scan_id"), F.lit("low").alias("risk_level"))
    risks = scans.select("scan_id", F.lit("R001").alias("risk_id"))
    store.write_scan_mart({"scans": scans, "risks": risks}, path)
    new = {"scans": scans.where("scan_id = '3'").withColumn("risk_level", F.lit("high")), "risks": risks.where("scan_id = '3'").withColumn("risk_id", F.lit("R002"))}
    write = store.Manifest.write

    def dies(self, name, *more):
        if name == "risks":
            raise OSError("executor lost")
        write(self, name, *more)

    def state():
        return (sorted(tuple(r) for r in store.read_table(spark, path).drop("bucket").collect()),
                sorted(tuple(r) for r in store.read_table(spark, path, "risks").drop("bucket").collect()))

    before = state()
    monkeypatch.setattr(store.Manifest, "write", dies)
    with pytest.raises(OSError):
        store.upsert_scans(new, path)
    assert state() == before
    monkeypatch.setattr(store.Manifest, "write", write)
    slow = store.Manifest(spark, path)
    slow.write("scans", new["scans"], store.BUCKETS)
    store.upsert_scans(new, path)
    after = state()
    assert ("3", "high") in after[0] and ("3", "R002") in after[1] and len(after[0]) == 8
    with pytest.raises(AnalysisException):
        slow.commit()
    assert state() == after
    store.delete_scans_in(spark, path, scans)
    assert state() == ([], []) and store.read_table(spark, path).columns == ["scan_id", "risk_level", "bucket"]


def test_nested_documents(spark):
    """Nested items come back typed; scans of another shape give NULL, not an error."""
    rows = [("1", '{"scan_id": "1", "score": 7, "pages": [{"url": "a", "forms": [{"n": 2}]}, {"url": "b"}]}'), ("2", '{"score": "x", "new": true}'), ("3", "{broken"), ("4", None)]
    df = spark.createDataFrame(rows, "scan_id string, raw_json string")
    got = {r.scan_id: tuple(r)[1:] for r in store.scan_values(df, {"score": ("$.score", "int"), "n": ("$.pages[0].forms[0].n", "int"), "new": ("$.new", "boolean")}).collect()}
    assert got == {"1": (7, 2, None), "2": (None, None, True), "3": (None, None, None), "4": (None, None, None)}
    assert [tuple(r) for r in store.scan_items(df, "$.pages", {"url": "string"}).orderBy("pos").collect()] == [("1", 0, "a"), ("1", 1, "b")]


def test_store(spark, tmp_path):
    path = str(tmp_path / "mart")
    scans = spark.range(40).select(F.col("id").cast("string").alias("scan_id"), F.lit("a").alias("created_at"), F.lit("low").alias("risk_level"))
    risks = scans.select("scan_id", F.lit("R001").alias("risk_id")).union(scans.select("scan_id", F.lit("R002")))
    store.write_scan_mart({"scans": scans, "risks": risks}, path)
    new = {"scans": scans.where("scan_id = '7'").withColumn("risk_level", F.lit("high")), "risks": risks.where("scan_id = '7' and risk_id = 'R001'")}
    store.upsert_scans(new, path)
    store.upsert_scans(new, path)  # the same again changes nothing
    assert store.read_table(spark, path).count() == 40 and store.read_table(spark, path, "risks").count() == 79
    assert store.get_scan(store.read_table(spark, path), "7").first().risk_level == "high"
    store.upsert_scans({"scans": new["scans"], "risks": risks.limit(0)}, path)  # no rule fires any more
    assert store.read_table(spark, path, "risks").where("scan_id = '7'").count() == 0
    store.delete_scans_in(spark, path, scans.where("scan_id < '2'"), ("scans", "risks"))
    left = {r.scan_id for r in store.read_table(spark, path).collect()}
    assert left == {str(i) for i in range(40) if not str(i) < "2"}
    assert store.read_table(spark, path, version=1).count() == 40 and store.Manifest(spark, path).version == 5
    stale = {r.path for r in store.unreferenced(spark, path).collect()}
    assert stale and store.read_table(spark, path).select(F.input_file_name().alias("f")).where(F.col("f").isin(*stale)).count() == 0
    store.export_results(scans, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 40


def test_status_update_keeps_json(spark):
    scans = store.to_scan_json(spark.createDataFrame([("1", "scanned", 'a "status" b'), ("2", "scanned", "")], "scan_id string, status string, comment string"))
    got = store.update_status(scans, spark.createDataFrame([("1", "sent"), ("2", "nope")], "scan_id string, status string")).orderBy("scan_id").collect()
    assert [r.status for r in got] == ["sent", "scanned"] and '"status":"sent"' in got[0].raw_json
    back = store.from_scan_json(spark.createDataFrame(got), "scan_id string, status string, comment string").orderBy("scan_id").first()
    assert back.comment == 'a "status" b'


def test_catalogues(spark, tmp_path):
    assert catalogue.load_rules(spark).count() == 27 and catalogue.load_trackers(spark).count() == 31 and catalogue.load_cookie_names(spark).count() == 19
    per_type = {t: len(x) for t, x in catalogue.checklists().items()}
    assert per_type["privacy_policy"] == 32 and per_type["consent"] == per_type["special_consent"] == 15 and per_type["user_agreement"] == 8
    assert (catalogue.load_liability(spark).count(), catalogue.load_packages(spark).count()) == (6, 3)
    (tmp_path / "r.yml").write_text("rules:\n  - {id: X1, risk_level: odd, score: 3}\n  - {id: X2, enabled: false}\n")
    assert [(r["rule_id"], r["risk_level"], r["title"]) for r in catalogue.rules(str(tmp_path / "r.yml"))] == [("X1", "medium", "X1")]
    (tmp_path / "c.yml").write_text("checklists:\n  offer:\n    - {id: O1, label: L, keywords: ['Ёж '], risk_if_missing: low, applies_when: always, special: s}\n")
    item = catalogue.checklists(str(tmp_path / "c.yml"))["offer"][0]
    assert (item["norm_keywords"], item["special"], item["risk_if_missing"]) == (["еж "], "s", "low")


def test_url_edges(spark):
    rows = ["Example.RU/Путь?x#y", "HTTPS://U:p@Пример.РФ:8080/a", "//cdn.ru/x", "1.2.3.4", "localhost", "a.b.co.uk", "mailto:x@y.z", ""]
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    got = df.select(U.normalize_url(F.col("u")).alias("n"), U.get_host(F.col("u")).alias("h"), U.last_two_labels(F.col("u")).alias("d"),
                    U.absolute_url(F.lit("https://s.ru/a/b?q"), F.col("u")).alias("a")).collect()
    assert [r.n for r in got[:2]] == ["https://Example.RU/Путь?x", "https://U:p@Пример.РФ:8080/a"]
    assert [r.h for r in got[:3]] == ["", "пример.рф", "cdn.ru"] and [r.d for r in got[1:6]] == ["пример.рф", "cdn.ru", "1.2.3.4", "localhost", "co.uk"]
    assert [got[i].a for i in (2, 6, 7)] == ["https://cdn.ru/x", "", ""]


def test_text_edges(spark):
    df = spark.createDataFrame([("ООО «Ромашка\xa0»  ИНН: 7701234567",)], "t string")
    r = df.select(X.clean_text(F.col("t")).alias("c"), X.find_placeholders(F.col("t")).alias("p"), X.find_inn(F.col("t")).alias("i"),
                  X.contains_any(F.col("t"), ["ромашка » инн"]).alias("k"), X.truncate(F.lit("абв гд"), 5).alias("x")).first()
    assert r.c == "ООО «Ромашка » ИНН: 7701234567" and r.p == ["«Ромашка"] and r.i == ["7701234567"] and r.k and r.x == "абв…"


def test_many_keywords_in_one_pass(spark):
    """Random keywords, prefixes and overlaps of each other among them, against a search for each."""
    import random

    rng = random.Random(12)
    words = list(dict.fromkeys("".join(rng.choice("abё c-.") for _ in range(rng.randrange(1, 6))).strip() for _ in range(60))) + ["aba", "abac", "bac", "(a", "[b", "a+"]
    words = [w for w in words if w.strip()]
    texts = ["".join(rng.choice("abеё  c-.([+") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    few = ["abё c", "cab", "b.b", "e", "zzz", "ё-"]
    norm = X.normalize_for_search(F.col("t"))
    for r in df.select("t", norm.alias("n"), X.find_all_matches(F.col("t"), words).alias("all"), X.has_any(norm, words[:9]).alias("has"), X.contains_any(F.col("t"), few).alias("few")).collect():
        assert r["all"] == [w for w in words if X.norm_keyword(w) in r.n]
        assert r.has == any(X.norm_keyword(w) in r.n for w in words[:9])
        assert r.few == any(X.norm_keyword(w) in r.n for w in few)
