import pytest
from pyspark.sql import functions as F

from sitelens.operators import checklist as C
from sitelens.operators import context as A
from sitelens.operators import rules as R
from sitelens.plans.audit import audit
from sitelens.plans import report
from sitelens.sources.crawl import body_texts
from sitelens.sources.leads import normalize_leads

NAV = "".join(f"<a href='/{p}'>{t}</a>" for p, t in (
    ("legal/doc-42", "Политика обработки персональных данных"), ("soglasie-na", "Согласие на обработку данных"), ("files/oferta.pdf", "Оферта"),
    ("contacts", "Контакты"), ("other", "Наши товары")))
LEAD_FORM = "<form><input name=fio><input type=tel name=p><button>Отправить заявку</button></form>"
POLICY = "<title>Политика</title><p>Политика обработки персональных данных. Оператор ООО «Дом», юридический адрес: Тверь. Почта: help@{}. Имя и телефон.</p>"
SHELL = "<title>Каталог</title><p>Товары для дома и сада.</p>" + LEAD_FORM


@pytest.fixture(scope="module")
def world(spark):
    pages = [
        ("https://full.ru/", "<title>Дом</title><script src='https://mc.yandex.ru/m.js'></script>" + LEAD_FORM + NAV, 200),
        ("https://full.ru/legal/doc-42", POLICY.format("mail.ru"), 200),
        ("https://full.ru/soglasie-na", "", 200),
        ("https://full.ru/contacts", "<title>К</title><div id=marquiz></div>", 200),
        ("https://full.ru/secret-policy", POLICY.format("full.ru"), 200),
        ("http://plain.ru/", "<title>П</title>" + LEAD_FORM + NAV, 200),
        ("http://plain.ru/legal/doc-42", POLICY.format("chuzhoy.com"), 200),
    ] + [(f"https://shell.ru{p}", SHELL, 200) for p in ("/", "/privacy", "/privacy-policy", "/policy", "/soglasie", "/contacts")]
    pages = spark.createDataFrame(pages, "url string, html string, status_code int")
    leads = normalize_leads(spark.createDataFrame(
        [("full", "full.ru", "e-commerce"), ("plain", "plain.ru", "финансы"), ("shell", "https://shell.ru", ""), ("dead", "dead.ru", "")],
        "site_id string, site_url string, industry string"))
    bodies = body_texts(spark.createDataFrame(
        [("https://full.ru/files/oferta.pdf", bytearray(b"%PDF"), "application/pdf", "Публичная оферта. ИНН 7701234567.")],
        "url string, content binary, content_type string, text string"))
    robots = spark.createDataFrame([("https://full.ru", 200, "Sitemap: https://full.ru/map.xml")], "base_url string, status_code int, body string")
    maps = spark.createDataFrame([("https://full.ru/map.xml", "<urlset><url><loc>https://full.ru/terms-of-sale</loc></url></urlset>")], "url string, body string")
    ips = spark.createDataFrame([("plain", 0, "10.0.0.1"), ("plain", 1, "81.2.3.4"), ("full", 0, "95.1.1.1")], "site_id string, ip_pos int, ip string")
    ranges = spark.createDataFrame([(81 * 2**24, 82 * 2**24 - 1, "DE"), (95 * 2**24, 96 * 2**24 - 1, "RU")], "range_start bigint, range_end bigint, country string")
    answer = ('Вот ответ: ```json {"missed_documents": [{"url": "https://full.ru/secret-policy", "doc_type": "privacy_policy"},'
              '{"url": "https://full.ru/contacts", "doc_type": "offer"}, {"url": "https://partner.ru/policy", "doc_type": "privacy_policy"},'
              '{"url": "https://full.ru/legal/doc-42#x", "doc_type": "privacy_policy"},]} ```')
    verdicts = spark.createDataFrame([("full", "https://full.ru/legal/doc-42",
        '{"checklist_results": [{"id": "PP_015", "status": "found", "evidence_quote": "срок три года", "confidence": 90},'
        '{"id": "PP_014", "status": "found", "evidence_quote": "ООО «ДОМ», юридический", "confidence": 90},'
        '{"id": "PP_007", "status": "unclear", "evidence_quote": "Оператор ООО"}],'
        '"conflicts": [{"type": "company_name", "risk": "critical"}, {"type": "tone", "risk": "odd"}]}')], "site_id string, doc_url string, answer string")
    return audit(leads, pages, robots, maps, bodies, ips, ranges, spark.createDataFrame([("full", answer)], "site_id string, answer string"), verdicts)


def rules_of(world, site):
    return [r.rule_id[:4] for r in world.risks.where(F.col("site_id") == site).orderBy("rank").collect()]


def test_documents(world):
    docs = {(r.site_id, r.url.split(".ru")[-1]): r for r in world.documents.collect()}
    assert docs["full", "/legal/doc-42"].present and docs["full", "/legal/doc-42"].discovered_by == "anchor"
    seen = docs["full", "/soglasie-na"]  # opened, no text: confirmed but not readable
    assert (seen.is_accessible, seen.link_confirmed, seen.present) == (False, True, True)
    assert docs["full", "/files/oferta.pdf"].format == "pdf" and docs["full", "/files/oferta.pdf"].is_accessible
    assert docs["full", "/secret-policy"].discovered_by == "agent"  # the only suggestion that holds
    assert ("full", "/contacts") not in docs
    # a catch-all shell: guessed paths open, none of them reads like a policy
    shell = [r for k, r in docs.items() if k[0] == "shell"]
    assert shell and not any(r.present for r in shell)


def test_rules_scores_and_confidence(world):
    assert "R001" in rules_of(world, "shell") and "R001" not in rules_of(world, "full")
    assert {"R016", "R017", "R026"} <= set(rules_of(world, "plain"))
    assert not {"R016", "R017", "R026"} & set(rules_of(world, "full"))
    rows = {r.site_id: r for r in world.scored.collect()}
    assert rows["dead"].risk_level == "unknown" and rows["dead"].risk_score == 0 and not rows["dead"].reachable
    for r in rows.values():
        if r.reachable:
            fired = world.risks.where(F.col("site_id") == r.site_id).collect()
            assert r.risk_score == min(150, sum(x.score for x in fired))
            expected = 50 + min(5 * r.n_docs_text, 20) + min(3 * len(fired), 12) + (5 if r.n_trackers else 0) + (3 if r.n_cookies else 0)
            expected += (5 if r.pages_checked >= 3 else 0) - min(6 * r.n_docs_failed, 18) - min(5 * r.n_unreachable, 20)
            expected -= (0 if r.site_id == "full" else 10) + (0 if r.site_id in ("full", "plain") else 5)
            expected -= 1  # the note that pages came without a browser
            assert r.confidence == max(0, expected)


def test_core_checks_are_complete(world):
    rows = world.core.collect()
    assert {r.site_id for r in rows} == {"full", "plain", "shell"} and len(rows) == 63
    got = {(r.site_id, r.id): r.status for r in rows}
    assert got["full", "PP_001"] == "ok" and got["shell", "PP_001"] == "risk"
    assert got["plain", "PP_032"] == "risk" and got["plain", "R017"] == "risk"


def test_outside_verdicts(world):
    rows = {r.item_id: r for r in world.checklist.where("site_id = 'full' and url like '%doc-42'").collect()}
    assert rows["PP_015"].source == "heuristic"  # the quote is not in the document
    assert (rows["PP_014"].status, rows["PP_014"].source) == ("found", "merged")
    assert rows["PP_007"].source == "heuristic"  # unclear says less than not_found
    kinds = {(r.type, r.risk, r.source) for r in world.conflicts.where("site_id = 'full' and url like '%doc-42'").collect()}
    assert ("tone", "medium", "llm") in kinds and not any(k[0] == "company_name" for k in kinds)


def test_technical(world):
    rows = {r.site_id: r for r in world.context.collect()}
    assert (rows["plain"].server_country, rows["plain"].geoip_confidence) == ("DE", 80)
    assert rows["plain"].ip_addresses == ["10.0.0.1", "81.2.3.4"]
    assert rows["full"].robots_txt_found and rows["full"].sitemap_found and not rows["plain"].robots_txt_found
    assert any(r.url.endswith("/terms-of-sale") for r in world.plan.collect())


def test_findings_against_brute_force(world):
    from sitelens import catalogue

    rank = {"unknown": -1, "low": 0, "medium": 1, "high": 2, "critical": 3}
    risks, core, ctx = world.risks.collect(), world.core.collect(), {r.site_id: r for r in world.context.collect()}
    want = {}
    for site in ("full", "plain", "shell"):
        for f in catalogue.findings()["findings"]:
            rs = [r for r in risks if r.site_id == site and r.rule_id[:4] in f.get("rules", [])]
            cs = [k for i in f.get("core", []) for k in core if k.site_id == site and k.id == i and k.status == "risk"][:1]
            if f.get("only_if_prechecked") and not ctx[site].form_prechecked:
                cs = []
            if not rs and not cs:
                continue
            best = max(rs, key=lambda r: (rank[r.risk_level], r.score), default=None)
            level = max([f.get("level") or best.risk_level] + [x.risk_level for x in rs[:0] + ([best] if best else []) + cs], key=rank.get)
            floor = {"critical": 30, "high": 20, "medium": 10}.get(cs[0].risk_level, 0) if cs else 0
            score = best.score if best and best.score > 0 else max(f["score"], floor)
            fid = "PD-12" if f["id"] == "PD-11" and ctx[site].transfer_denied else f["id"]
            want[site, fid] = (f.get("force") or level, score)
    assert want == {(r.site_id, r.finding_id): (r.risk_level, r.score) for r in world.findings.collect()}


def test_document_summaries_against_brute_force(world):
    items = world.checklist.collect()
    for d in world.analysis.collect():
        own = [i for i in items if (i.site_id, i.doc_pos) == (d.site_id, d.doc_pos) and i.status != "not_applicable"]
        found = [i for i in own if i.status == "found"]
        assert d.overall_completeness == round(100 * len(found) / max(1, len(own)))
        missing = [i.label for i in sorted(own, key=lambda i: i.item_pos) if i.status != "found" and i.risk_if_missing in ("high", "critical")]
        assert d.missing_high == missing[:3]
    opened = {(r.site_id, r.doc_pos): r.open_items for r in report.open_items(world.checklist).collect()}
    for key, labels in opened.items():
        own = sorted((i for i in items if (i.site_id, i.doc_pos) == key), key=lambda i: i.item_pos)
        want = [i.label for i in own if i.status == "not_found"] + [i.label for i in own if i.status == "unclear"]
        assert labels == want[:3]


def test_reports(world):
    text = {r.site_id: r.executive_summary for r in report.executive_summary(world.scored, world.risks).collect()}
    assert len(text) == 4 and "Признаков риска не выделено" in text["dead"]
    docs = report.unique_documents(world.documents, world.analysis, world.checklist).where("site_id = 'full'").orderBy("doc_pos").collect()
    assert [d.manual_only for d in docs].count(True) == 1
    table = report.documents_table(world.documents, world.analysis, world.checklist, world.conflicts).where("site_id = 'plain' and url like '%doc-42'").first()
    assert table.conflicts == ["company_conflict: Адрес на другом домене, уточнить юрлицо."]
    assert report.scan_header(world.scored, world.risks, "2024-01-01").count() == 4


def test_own_rule(world):
    R.RULES["R001_NO_PRIVACY_POLICY"] = lambda: F.when(F.col("site_id") == "full", C.X.evidence("", "own"))
    try:
        hit = R.apply_rules(world.context).where("rule_id = 'R001_NO_PRIVACY_POLICY'").collect()
        assert [(r.site_id, r.evidence.quote) for r in hit] == [("full", "own")]
    finally:
        R.RULES.clear()


def test_best_status_prefers_information(spark):
    rows = [("s", 1, 0, "PP_1", "not_found", "", ""), ("s", 2, 0, "PP_1", "unclear", "b", ""), ("s", 3, 0, "PP_1", "unclear", "c", ""),
            ("s", 1, 1, "PP_2", "not_applicable", "", "")]
    df = spark.createDataFrame(rows, "site_id string, doc_pos int, item_pos int, item_id string, status string, evidence_quote string, comment string")
    got = {r.item_id: r.best.quote for r in C.best_status(df).collect()}
    assert got == {"PP_1": "b", "PP_2": ""}


def test_country_of_first_public_address(spark):
    ips = spark.createDataFrame([("a", 0, "192.168.0.1"), ("a", 1, "5.5.5.5"), ("a", 2, "81.1.1.1"), ("b", 0, "::1")], "site_id string, ip_pos int, ip string")
    ranges = spark.createDataFrame([(81 * 2**24, 82 * 2**24 - 1, "DE")], "range_start bigint, range_end bigint, country string")
    got = {r.site_id: (r.server_country, r.geoip_confidence) for r in A.server_country(ips, ranges).collect()}
    assert got == {"a": ("DE", 80), "b": ("unknown", 0)}


def test_addresses_against_python(spark):
    """Overlapping, nested and very wide ranges of both families against a search of all ranges."""
    import ipaddress
    import random

    rng = random.Random(6)

    def some(version):
        n = rng.getrandbits(32) if version == 4 else (0x2A00 << 112) + rng.getrandbits(100)
        return n

    ranges, asked = [], []
    for version, bits in ((4, 32), (6, 128)):
        kind = ipaddress.IPv4Address if version == 4 else ipaddress.IPv6Address
        for i in range(120):
            lo = some(version)
            hi = min(lo + rng.getrandbits(rng.choice([3, 16, 26, bits - 6])), 2 ** bits - 1)
            ranges.append((kind(lo), kind(hi), f"C{version}-{i}"))
            asked += [kind(x) for x in (lo, hi, max(lo - 1, 0), min(hi + 1, 2 ** bits - 1), some(version))]
    want = {}
    for ip in asked:
        over = [(lo, -int(hi), c) for lo, hi, c in ranges if lo.version == ip.version and lo <= ip <= hi]
        if over and not (ip.version == 6 and ip.ipv4_mapped):
            want[str(ip)] = min(over)[2]
    got = A.address_country(spark.createDataFrame([(str(x),) for x in asked] + [("no address",), ("1::2::3",), ("1:2",), (None,)], "ip string"),
                            spark.createDataFrame([(str(a), str(b), c) for a, b, c in ranges] + [("5.5.5.5", "::1", "mixed"), ("x", "y", "broken"), ("1.1.1.1", "1.1.1.1", "")],
                                                  "first_ip string, last_ip string, country string"))
    assert {r.ip: r.country for r in got.collect()} == want


def test_keys_of_addresses(spark):
    from sitelens.functions import urls as U

    cases = {"1.2.3.4": "401020304", "::1": "6" + "0" * 31 + "1", "::": "6" + "0" * 32, "2A00::F:1": "62a00" + "0000" * 5 + "000f0001", "::ffff:1.2.3.4": "401020304",
             "1:2:3:4:5:6:7:8": "6" + "".join(f"000{i}" for i in range(1, 9)), "1:2:3:4:5:6:7": None, "1::2::3": None, "g::1": None, "1:2:3:4:5:6:7:8::": None, "": None, "::1.2.3": None,
             "64:ff9b::1.2.3.4": "60064ff9b" + "0000" * 4 + "01020304", "300.1.1.1": None}
    rows = spark.createDataFrame([(k,) for k in cases], "ip string").select("ip", U.ip_key(F.col("ip")).alias("k")).collect()
    assert {r.ip: r.k for r in rows if r.ip != "300.1.1.1"} == {k: v for k, v in cases.items() if k != "300.1.1.1"}
