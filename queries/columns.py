"""URL, text and predicate expressions over pages, documents, customer, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import query, spread, table
from sitelens.functions import elements as P
from sitelens.functions import text as X
from sitelens.functions import urls as U
from sitelens.operators.documents import relevant_documents
from sitelens.operators.domains import external_domains, on_site, with_domain, with_site_domain
from sitelens.operators.html_parse import parse_udfs
from sitelens.sources.crawl import decode_bodies, read_pages

c = F.col
HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#]*@)?([^:/?#]*)', 1))"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def joined(a):
    return F.array_join(a, "|")


# ---- URLs ------------------------------------------------------------------------------
@query("u01_normalize_url", """
SELECT page_id, rtrim(regexp_replace(url, '#.*$', ''), '?') AS full_url,
       'https://' || rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '#.*$', ''), '?') AS from_bare
FROM pages""")
def u01(spark, sf):
    bare = F.concat(F.lit("  "), F.regexp_replace("url", "^[a-z]+://", ""), F.lit(" "))
    return table(spark, sf, "pages").select("page_id", U.normalize_url(c("url")).alias("full_url"), U.normalize_url(bare).alias("from_bare"))


@query("u02_u03_u10_scheme_host_base", f"""
SELECT page_id, regexp_replace(url, '^[a-z]+://', 'http://') AS as_http, {HOST} AS host,
       regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS base FROM pages""")
def u02(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.to_http(c("url")).alias("as_http"), U.get_host(c("url")).alias("host"), U.base_from_url(c("url")).alias("base"))


#: hosts and their registered domains by the public suffix list: plain, wild and exception rules
DOMAINS = [("www.nic.ru", "nic.ru"), ("mail.me.ru", "me.ru"), ("www.co.ru", "co.ru"), ("shop.ltd.ru", "ltd.ru"), ("a.b.co.uk", "b.co.uk"),
           ("www.b.co.uk", "b.co.uk"), ("x.city.kawasaki.jp", "city.kawasaki.jp"), ("city.kawasaki.jp", "city.kawasaki.jp"),
           ("a.b.c.kawasaki.jp", "b.c.kawasaki.jp"), ("x.y.z.ck", "y.z.ck"), ("a.www.ck", "www.ck"), ("www.ck", "www.ck"),
           ("shop.com.pl", "shop.com.pl"), ("127.0.0.1", "127.0.0.1"), ("co.uk", "co.uk"), ("localhost", "localhost"),
           ("b.a.公司.cn", "a.公司.cn"), ("b.a.xn--55qx5d.cn", "a.xn--55qx5d.cn"), ("x.y.unlisted", "y.unlisted"), ("b.nic.ru", "nic.ru")]


@query("u04_u05_registered_domain", f"""
WITH h AS (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {", ".join(map(str, DOMAINS))}) t(host, domain)),
p AS (SELECT page_id, regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS own, page_id % {len(DOMAINS)} AS i, page_id // 7 % {len(DOMAINS)} AS j FROM pages)
SELECT page_id, own, a.domain, a.domain = b.domain AS same, a.domain <> b.domain AS external FROM p JOIN h a ON a.k = i JOIN h b ON b.k = j""")
def u04(spark, sf):
    n, hosts = len(DOMAINS), F.array(*[F.lit(h) for h, _ in DOMAINS])

    def host(k):
        return F.get(hosts, k.cast("int"))

    df = table(spark, sf, "pages").select("page_id", "url", F.concat(F.lit("https://"), host(c("page_id") % n), F.lit("/p?x=1")).alias("a"),
                                          F.concat(F.lit("http://"), host(F.floor(c("page_id") / 7) % n), F.lit("/")).alias("b"))
    sites = with_site_domain(df.select(c("b").alias("base_url")).distinct()).withColumnRenamed("domain", "base_domain")
    named = with_domain(with_domain(df, c("url"), "own"), c("a"), "domain").join(sites, c("b") == c("base_url"))
    same = on_site(c("a"), c("base_domain"), c("below"))
    return named.select("page_id", "own", "domain", same.alias("same"), (~same).alias("external"))


#: references against https://<host>/a/b/c?q=1#f, and what follows the host (None: the whole result is the second member)
REFERENCES = [("../../../up", "/up"), ("./x/./y/../z", "/a/b/x/z"), ("?n=2", "/a/b/c?n=2"), ("", ""), ("//other.org/p/../q", None), ("/r//s/../t/", "/r//t/"),
              ("d/", "/a/b/d/"), ("..", "/a/"), (".", "/a/b/"), ("/", "/"), ("x?y#z", "/a/b/x?y#z"), ("mailto:a@b.ru", ""), ("HTTPS://Other.org/A?b=1", None), ("tel:1", "")]
RESOLVED = {"//other.org/p/../q": "https://other.org/p/../q", "HTTPS://Other.org/A?b=1": "https://Other.org/A?b=1"}


@query("u06_absolute_url", f"""
SELECT page_id, CASE WHEN plain THEN rest WHEN rest = '' THEN '' ELSE 'https://' || {HOST} || rest END AS resolved
FROM pages JOIN (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {", ".join(f"('{RESOLVED.get(r, x)}', {x is None})" for r, x in REFERENCES)}) t(rest, plain)) v ON k = page_id % {len(REFERENCES)}""")
def u06(spark, sf):
    href = F.get(F.array(*[F.lit(r) for r, _ in REFERENCES]), (c("page_id") % len(REFERENCES)).cast("int"))
    base = F.concat(F.lit("https://"), U.get_host(c("url")), F.lit("/a/b/c?q=1#f"))
    return table(spark, sf, "pages").select("page_id", U.absolute_url(base, href).alias("resolved"))


@query("u07_u08_u09_u12_url_parts", f"""
SELECT page_id, rtrim(regexp_replace(url, '#.*$', ''), '?') AS no_fragment,
  NOT regexp_matches(split_part(lower(u), '?', 1), '\\.(jpg|jpeg|png|gif|svg|webp|ico|css|js|woff|woff2|ttf|mp4|mp3|zip|rar|xml|json)$') AS html_like,
  regexp_extract(lower({PATH}), '\\.([a-z0-9]{{1,5}})$', 1) AS ext,
  rtrim(rtrim(regexp_replace(url, '#.*$', ''), '?'), '/') AS key
FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN url ELSE split_part(split_part(url, '#', 1), '?', 1) || CASE page_id % 3 WHEN 1 THEN '.PNG?v=1' ELSE '.php' END END AS u FROM pages)""")
def u07(spark, sf):
    bare = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    u = F.when(c("page_id") % 3 == 0, c("url")).when(c("page_id") % 3 == 1, F.concat(bare, F.lit(".PNG?v=1"))).otherwise(F.concat(bare, F.lit(".php")))
    return table(spark, sf, "pages").select(
        "page_id", U.strip_fragment(c("url")).alias("no_fragment"), U.is_probably_html_url(u).alias("html_like"),
        U.url_extension(c("url")).alias("ext"), U.url_key(c("url")).alias("key"))


@query("u11_url_search_blob", f"""
SELECT page_id, u || ' ' || p || ' ' || regexp_replace(p, '[/_.\\-]+', ' ', 'g') AS blob FROM (
  SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/cookie-policy_%D0%BA%D1%83%D0%BA%D0%B8/a+b' || page_id AS u,
         '/cookie-policy_куки/a+b' || page_id AS p FROM pages)""")
def u11(spark, sf):
    u = F.concat(U.base_from_url(c("url")), F.lit("/cookie-policy_%D0%BA%D1%83%D0%BA%D0%B8/a+b"), c("page_id").cast("string"))
    return table(spark, sf, "pages").select("page_id", U.url_search_blob(u).alias("blob"))


@query("u13_external_domains", f"""
WITH p AS (SELECT page_id, {HOST} AS host FROM pages),
l AS (SELECT page_id, host, unnest(['https://cdn.' || host || '/x.js', 'https://a.partner' || (page_id % 5) || '.ru/', 'https://b.partner0.ru/y', '/local']) AS u,
             unnest([0, 1, 2, 3]) AS pos FROM p),
d AS (SELECT page_id, min(pos) AS pos, regexp_extract(regexp_extract(u, '://([^/]+)', 1), '([^.]+\\.[^.]+)$', 1) AS dom, any_value(host) AS host
      FROM l WHERE u LIKE '%://%' GROUP BY page_id, dom)
SELECT page_id, string_agg(dom, '|' ORDER BY pos) AS domains FROM d
WHERE dom <> regexp_extract(host, '([^.]+\\.[^.]+)$', 1) GROUP BY page_id""")
def u13(spark, sf):
    p = table(spark, sf, "pages").withColumn("host", U.get_host(c("url")))
    pages = p.select(
        c("page_id").alias("site_id"), F.lit(0).alias("page_pos"), "url",
        F.array(F.concat(F.lit("https://cdn."), "host", F.lit("/x.js")),
                F.concat(F.lit("https://a.partner"), (c("page_id") % 5).cast("string"), F.lit(".ru/"))).alias("links"),
        F.array(F.lit("https://b.partner0.ru/y"), F.lit("/local")).alias("external_resources"))
    return external_domains(pages, c("url")).select(c("site_id").alias("page_id"), joined("domains").alias("domains"))


@query("u14_private_ip", """
SELECT c_custkey, ip, CASE WHEN n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055
  THEN TRUE ELSE FALSE END AS private FROM (
  SELECT c_custkey, a || '.' || (c_custkey % 250 + 1) || '.' || (c_nationkey + 1) || '.7' AS ip,
         a * 16777216 + (c_custkey % 250 + 1) * 65536 + (c_nationkey + 1) * 256 + 7 AS n
  FROM (SELECT *, (CASE c_custkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 ELSE 77 END)::BIGINT AS a FROM customer))""")
def u14(spark, sf):
    a = F.when(c("c_custkey") % 4 == 0, "10").when(c("c_custkey") % 4 == 1, "172").when(c("c_custkey") % 4 == 2, "192").otherwise("77")
    ip = F.concat_ws(".", a, (c("c_custkey") % 250 + 1).cast("string"), (c("c_nationkey") + 1).cast("string"), F.lit("7"))
    return table(spark, sf, "customer").select("c_custkey", ip.alias("ip"), U.is_private_ip(ip).alias("private"))


@query("u15_display_name", """
WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name
  WHEN coalesce(title, '') <> '' AND length(title) <= 80 AND title NOT LIKE '%404%' THEN trim(split_part(split_part(title, '|', 1), ' - ', 1))
  ELSE 'Brand' || c_custkey || ' Shop' END AS name
FROM customer LEFT JOIN t ON c_custkey = page_id""")
def u15(spark, sf):
    sites = table(spark, sf, "customer").select(
        c("c_custkey").alias("site_id"), F.when(c("c_custkey") % 3 == 0, c("c_name")).otherwise("https://x.ru").alias("company_name"),
        F.concat(F.lit("https://www.brand"), "c_custkey", F.lit("shop.ru")).alias("site_url"))
    pages = table(spark, sf, "pages").select(
        c("page_id").alias("site_id"), F.lit(0).alias("page_pos"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return U.display_name(sites, pages).select(c("site_id").alias("c_custkey"), c("display_name").alias("name"))


@query("s03_read_pages", f"""
SELECT page_id, url, length(html) AS n, regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS site_domain FROM pages""")
def s03(spark, sf):
    return with_domain(read_pages(spark, f"{sf}/pages.parquet"), c("url"), "site_domain").select("page_id", "url", F.length("html").alias("n"), "site_domain")


# ---- text ------------------------------------------------------------------------------
WS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def sql_clean(x):
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ ', ''), ' $', '')"


def sql_norm(x):
    return f"regexp_replace(replace(lower({x}), 'ё', 'е'), '{WS}+', ' ', 'g')"


@query("x01_x02_x03_clean_truncate_normalize", f"""
SELECT doc_id, md5({sql_clean('text')}) AS clean, md5({sql_norm("'Ё  ' || text")}) AS norm,
  CASE WHEN length(s) <= 100 THEN s ELSE regexp_replace(substr(s, 1, 99), '{WS}+$', '') || '…' END AS head
FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '') AS s FROM documents)""")
def x01(spark, sf):
    return spread(spark, sf, "documents").select(
        "doc_id", F.md5(X.clean_text(c("text"))).alias("clean"),
        F.md5(X.normalize_for_search(F.concat(F.lit("Ё  "), c("text")))).alias("norm"), X.truncate(c("text"), 100).alias("head"))


WORDS = ("license", "email", "the of", "version", "für", "zzz")


@query("x04_x05_x06_keywords", f"""
WITH d AS (SELECT doc_id, {sql_norm('text')} AS n FROM documents),
m AS (SELECT doc_id, list_filter({list(WORDS)}, lambda k: contains(n, k)) AS found FROM d)
SELECT doc_id, len(found) > 0 AS any_found, found[1] AS first_found, array_to_string(found, '|') AS all_found FROM m""")
def x04(spark, sf):
    t = c("text")
    return spread(spark, sf, "documents").select(
        "doc_id", X.contains_any(t, WORDS).alias("any_found"), X.find_first(t, WORDS).alias("first_found"),
        joined(X.find_all_matches(t, WORDS)).alias("all_found"))


def first_of(lst):
    return f"array_to_string(list_filter({lst}, lambda x, i: list_position({lst}, x) = i), '|')"


@query("x07_x08_inn_ogrn", f"""
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' ИНН: 77' || lpad((doc_id % 1000)::VARCHAR, 8, '0') || ', ОГРН № 1' || lpad((doc_id % 1000)::VARCHAR, 12, '0')
  WHEN 1 THEN text || ' ' || (100000000000 + doc_id) || ' 1027700132195 ' WHEN 2 THEN text || ' ИНН 500100732259' ELSE text END AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, 'ИНН[\\s:№]*?(\\d{{10}}|\\d{{12}})', 1) AS li, regexp_extract_all(t, '\\b\\d{{12}}\\b|\\b\\d{{10}}\\b') AS bi,
  regexp_extract_all(t, 'ОГРН(?:ИП)?[\\s:№]*?(\\d{{13}}|\\d{{15}})', 1) AS lo, regexp_extract_all(t, '\\b\\d{{15}}\\b') || regexp_extract_all(t, '\\b\\d{{13}}\\b') AS bo FROM d)
SELECT doc_id, CASE WHEN len(li) > 0 THEN {first_of('li')} ELSE {first_of('bi')} END AS inn,
  CASE WHEN len(lo) > 0 THEN {first_of('lo')} ELSE {first_of('bo')} END AS ogrn FROM m""")
def x07(spark, sf):
    n, k = F.lpad((c("doc_id") % 1000).cast("string"), 8, "0"), F.lpad((c("doc_id") % 1000).cast("string"), 12, "0")
    m = c("doc_id") % 4
    t = (F.when(m == 0, F.concat(c("text"), F.lit(" ИНН: 77"), n, F.lit(", ОГРН № 1"), k))
         .when(m == 1, F.concat(c("text"), F.lit(" "), (c("doc_id") + F.lit(100000000000)).cast("string"), F.lit(" 1027700132195 ")))
         .when(m == 2, F.concat(c("text"), F.lit(" ИНН 500100732259"))).otherwise(c("text")))
    return spread(spark, sf, "documents").select("doc_id", joined(X.find_inn(t)).alias("inn"), joined(X.find_ogrn(t)).alias("ogrn"))


PHONE = "(?:\\+7|8|7)[\\s\\-]?\\(?\\d{3}\\)?[\\s\\-]?\\d{3}[\\s\\-]?\\d{2}[\\s\\-]?\\d{2}"
DATE = ("(?i)\\b\\d{1,2}[.\\-/]\\d{1,2}[.\\-/]\\d{2,4}\\b|\\b\\d{1,2}\\s+(?:январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр)"
        "[а-яёa-z0-9_]*\\s+\\d{4}|\\b\\d{4}[.\\-/]\\d{1,2}[.\\-/]\\d{1,2}\\b")


@query("x09_x10_x12_x13_contacts_dates", f"""
WITH d AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' +7 (495) 123-45-' || lpad((doc_id % 90 + 10)::VARCHAR, 2, '0') || ' от 5 марта 2024 г., версия ' || doc_id % 9 || '.1'
  WHEN 1 THEN ' 2024-01-0' || (doc_id % 9 + 1) || ' Редакция № 3' ELSE '' END AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}') AS e, regexp_extract_all(t, '{PHONE}') AS p, regexp_extract_all(t, '{DATE}') AS dt FROM d)
SELECT doc_id, {first_of('e')} AS emails, {first_of('p')} AS phones, {first_of('dt')} AS dates, coalesce(dt[1], '') AS first_date,
  regexp_extract(t, '(?i)(?:верси[яи]|version|редакци[яи]|ред\\.)\\s*[:№]?\\s*([0-9]+(?:\\.[0-9]+)*)', 1) AS version FROM m""")
def x09(spark, sf):
    m, i = c("doc_id") % 3, c("doc_id")
    t = F.concat(
        c("text"), F.when(m == 0, F.concat(F.lit(" +7 (495) 123-45-"), F.lpad((i % 90 + 10).cast("string"), 2, "0"),
                                           F.lit(" от 5 марта 2024 г., версия "), (i % 9).cast("string"), F.lit(".1")))
        .when(m == 1, F.concat(F.lit(" 2024-01-0"), (i % 9 + 1).cast("string"), F.lit(" Редакция № 3"))).otherwise(""))
    return spread(spark, sf, "documents").withColumn("t", t).select(
        "doc_id", joined(X.find_emails(c("t"))).alias("emails"), joined(X.find_phones(c("t"))).alias("phones"),
        joined(X.find_dates(c("t"))).alias("dates"), X.detect_date(c("t")).alias("first_date"), X.detect_version(c("t")).alias("version"))


@query("x11_placeholders", f"""
WITH d AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' [наименование] ООО «Ромашка» ' WHEN 1 THEN ' ____ {{{{company}}}} указать ' WHEN 2 THEN ' ВАША КОМПАНИЯ ' ELSE '' END AS t FROM documents),
m AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?i)\\[[^\\]]{{0,40}}\\]|\\{{\\{{[^}}]{{0,40}}\\}}\\}}|_{{3,}}|«?ромашк[а-яёa-z0-9_]*»?|наименовани[а-яёa-z0-9_]*\\s+оператора|адрес[а-яёa-z0-9_]*\\s+оператора|указать|вставить|ваш[аеиуый]*\\s+компани[яи]|пример[а-яёa-z0-9_]*\\s+ооо'), lambda x: trim(x)) AS f FROM d)
SELECT doc_id, {first_of('f')} AS found FROM m""")
def x11(spark, sf):
    m = c("doc_id") % 4
    t = F.concat(c("text"), F.when(m == 0, " [наименование] ООО «Ромашка» ").when(m == 1, " ____ {{company}} указать ")
                 .when(m == 2, " ВАША КОМПАНИЯ ").otherwise(""))
    return spread(spark, sf, "documents").select("doc_id", joined(X.find_placeholders(t)).alias("found"))


@query("x14_x15_operator_purposes", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ООО «Фирма ' || doc_id || '»' WHEN 1 THEN 'ООО Альфа' ELSE 'ИП Иванов Иван' END AS operator,
  CASE doc_id % 3 WHEN 0 THEN 'обратной связи|доставк' WHEN 1 THEN '' ELSE 'маркетинг' END AS purposes, doc_id % 3 = 2 AS retention FROM documents""")
def x14(spark, sf):
    m = c("doc_id") % 3
    t = (F.when(m == 0, F.concat(F.lit("Фирма ООО «Фирма "), "doc_id", F.lit("» для обратной связи и доставки. "), "text"))
         .when(m == 1, F.concat(F.lit("Оператором является ООО Альфа. "), "text"))
         .otherwise(F.concat(F.lit("ИП Иванов Иван, маркетинг, до отзыва. " + "- " * 70), "text")))
    return spread(spark, sf, "documents").withColumn("t", t).select(
        "doc_id", X.find_operator(c("t")).alias("operator"), joined(X.find_purposes(c("t"))).alias("purposes"),
        X.find_retention(c("t")).alias("retention"))


@query("x16_snippet_around", f"""
WITH d AS (SELECT doc_id, text, 'the' AS needle, {sql_norm('text')} AS n FROM documents),
m AS (SELECT *, instr(n, needle) - 1 AS idx FROM d), w AS (SELECT *, greatest(0, idx - 40) AS s, least(length(text), idx + 3 + 40) AS e FROM m)
SELECT doc_id, CASE WHEN idx < 0 THEN CASE WHEN length({sql_clean('text')}) <= 80 THEN {sql_clean('text')} ELSE regexp_replace(substr({sql_clean('text')}, 1, 79), ' +$', '') || '…' END
  ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || {sql_clean('substr(text, s + 1, greatest(0, e - s))')} || CASE WHEN e < length(text) THEN '…' ELSE '' END END AS snippet FROM w""")
def x16(spark, sf):
    return spread(spark, sf, "documents").select("doc_id", X.snippet_around(c("text"), F.lit("The"), 40).alias("snippet"))


def sql_untag(x, blocks):
    for b in blocks:
        x = f"regexp_replace({x}, '(?is)<{b}[^>]*>.*?</{b}>', ' ', 'g')"
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


@query("x17_first_snippet", f"""
SELECT page_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(substr(t, 1, 199), ' +$', '') || '…' END AS snippet
FROM (SELECT page_id, {sql_clean(sql_untag('html', ('script', 'style', 'noscript')))} AS t FROM pages)""")
def x17(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.first_snippet(c("html"), 200).alias("snippet"))


def sql_entities(x):
    for e, ch in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{e};?', '{ch}', 'g')"
    return x


X18 = sql_clean(sql_entities(sql_untag("regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')", ("script", "style", "noscript", "template"))))


@query("x18_html_to_text", f"SELECT page_id, length({X18}) AS n, md5({X18}) AS text_md5 FROM pages")
def x18(spark, sf):
    t = X.html_to_text_regex(c("html"))
    return table(spark, sf, "pages").select("page_id", F.length(t).alias("n"), F.md5(t).alias("text_md5"))


@query("x18_parsed_text", f"""
SELECT page_id, md5({X18}) AS text_md5 FROM pages""")
def x18_parsed(spark, sf):
    parse, _ = parse_udfs()
    p = table(spark, sf, "pages").withColumn("p", parse("html", "url"))
    return p.select("page_id", F.md5(F.coalesce("p.doc_text", "p.text")).alias("text_md5"))


@query("x21_detect_format", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' ELSE 'html' END AS format FROM pages""")
def x21(spark, sf):
    m = c("page_id") % 4
    bare = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    u = F.when(m == 0, F.concat(bare, F.lit("x.PDF?a=1"))).when(m == 1, F.concat(bare, F.lit("x.doc"))).otherwise(bare)
    ct = F.when(m == 2, "Application/PDF").otherwise("text/html; charset=utf-8")
    return table(spark, sf, "pages").select("page_id", X.detect_format(u, ct).alias("format"))


@query("x22_evidence", f"""
SELECT page_id, url AS page_url, CASE WHEN length(t) <= 500 THEN t ELSE regexp_replace(substr(t, 1, 499), ' +$', '') || '…' END AS quote,
  CASE WHEN length(html) <= 800 THEN html ELSE regexp_replace(substr(html, 1, 799), '{WS}+$', '') || '…' END AS snippet, page_id::VARCHAR AS extra
FROM (SELECT *, {sql_clean('html')} AS t FROM pages)""")
def x22(spark, sf):
    e = X.evidence(c("url"), c("html"), c("html"), {"id": c("page_id")})
    return table(spark, sf, "pages").withColumn("e", e).select(
        "page_id", "e.page_url", "e.quote", c("e.html_snippet").alias("snippet"), c("e.extra")["id"].alias("extra"))


@query("x23_x24_tone", """
SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' характер признака риска' WHEN 1 THEN ' риск, который следует оценить с юристом'
  ELSE ' признак риска и это требует проверки на соответствие требованиям' END AS softened,
  CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'штраф' ELSE 'незаконно' END AS forbidden FROM conversations""")
def x23(spark, sf):
    m = c("turn") % 3
    t = F.concat("text", F.when(m == 0, " характер нарушения признаки риска").when(m == 1, " ШТРАФ")
                 .otherwise(" нарушение нарушения и это незаконно"))
    return table(spark, sf, "conversations").withColumn("t", t).select(
        "conv_id", "turn", X.sanitize_tone(c("t")).alias("softened"), joined(X.forbidden_phrases(c("t"))).alias("forbidden"))


@query("x25_x26_amounts_scores", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS amount,
  least(100, greatest(0, (o_orderkey % 160)::INT - 20)) AS clamped,
  CASE WHEN (o_orderkey % 160)::INT - 20 > 100 THEN '100+' ELSE greatest(0, (o_orderkey % 160)::INT - 20)::VARCHAR END AS shown FROM orders""")
def x25(spark, sf):
    n = F.floor("o_totalprice").cast("string")
    text = F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("до "), n, F.lit(" ₽"))).when(
        c("o_orderkey") % 3 == 1, F.concat(n, F.lit(" РУБ."))).otherwise("отдельный состав 5")
    s = (c("o_orderkey") % 160).cast("int") - 20
    return table(spark, sf, "orders").select(
        "o_orderkey", X.amount_to_int(text).alias("amount"), X.clamp_score(s).alias("clamped"), X.score_display(s).alias("shown"))


@query("x27_lenient_json", """
SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN NULL ELSE doc_id::VARCHAR END AS id, CASE WHEN doc_id % 6 IN (4, 5) THEN NULL ELSE lang END AS lang FROM documents""")
def x27(spark, sf):
    m, i = c("doc_id") % 6, c("doc_id").cast("string")
    obj = F.concat(F.lit('{"id": "'), i, F.lit('", "lang": "'), "lang", F.lit('"'))
    answer = (F.when(m == 0, F.concat(obj, F.lit("}"))).when(m == 1, F.concat(F.lit("Ответ:\n```json\n"), obj, F.lit(",}\n```\nвсё")))
              .when(m == 2, F.concat(F.lit("Вот: "), F.translate(F.concat(obj, F.lit("}")), '"', "“"), F.lit(" конец")))
              .when(m == 3, F.concat(F.lit("```"), obj, F.lit(" , } ")))
              .when(m == 4, F.concat(F.lit('[{"id": "'), i, F.lit('"}]'))).otherwise("нет ответа { ]"))
    t = X.lenient_json(answer)
    return spread(spark, sf, "documents").withColumn("j", F.from_json(t, "id string, lang string, items array<struct<id: string>>")).select(
        "doc_id", F.coalesce("j.id", F.get("j.items", F.lit(0))["id"]).alias("id"), c("j.lang").alias("lang"))


@query("x28_element_labels", """
SELECT conv_id, turn, turn % 4 = 0 AS trigger, turn % 4 IN (1, 2) AS unsafe, turn % 4 = 3 AS form_html FROM conversations""")
def x28(spark, sf):
    m = c("turn") % 4
    t = F.when(m == 0, "Получить  РАСЧЁТ").when(m == 1, "Заказать и оплатить").when(m == 2, "Купить").otherwise("x")
    html = F.concat("text", F.when(m == 3, "<INPUT name=q>").otherwise("<p>"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", P.is_modal_trigger(t).alias("trigger"), P.is_unsafe_click(t).alias("unsafe"), P.looks_like_form_html(html).alias("form_html"))


@query("x29_labels", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'низкий' WHEN 1 THEN 'критический' WHEN 2 THEN 'не определён' ELSE 'странный' END AS level,
  CASE o_orderkey % 3 WHEN 0 THEN 'проверен' WHEN 1 THEN 'отказ' ELSE 'новый' END AS status,
  CASE o_orderkey % 2 WHEN 0 THEN 'Публичная оферта' ELSE 'Политика cookie' END AS doc, CASE o_orderkey % 2 WHEN 0 THEN 'не указана' ELSE 'туризм' END AS industry FROM orders""")
def x29(spark, sf):
    def pick(*xs):
        return F.get(F.array(*map(F.lit, xs)), (c("o_orderkey") % len(xs)).cast("int"))

    return table(spark, sf, "orders").select(
        "o_orderkey", X.label("level", pick("low", "critical", "unknown", "странный")).alias("level"),
        X.label("status", pick("scanned", "rejected", "new")).alias("status"), X.label("doc_type", pick("offer", "cookie_policy")).alias("doc"),
        X.label("industry", pick("auto", "туризм")).alias("industry"))


# ---- predicates -------------------------------------------------------------------------
FIELDS = [("user_email", "", "", "", "email"), ("x", "tel", "", "", "phone"), ("f", "file", "", "", "file"), ("d", "date", "Дата рождения", "", "birthdate"),
          ("d", "date", "Дата", "", "other"), ("ok", "checkbox", "Я согласен", "", "consent"), ("ok", "radio", "Да", "", "other"),
          ("q", "text", "Паспорт", "", "passport"), ("q", "text", "", "Ваше имя", "name"), ("comment", "textarea", "", "", "message"),
          ("inn", "text", "", "", "inn"), ("city", "text", "", "", "address"), ("q", "text", "", "", "unknown")]


@query("p01_classify_field", "SELECT event_id, (%s)[event_id %% %d + 1] AS category FROM events" % ([f[4] for f in FIELDS], len(FIELDS)))
def p01(spark, sf):
    f = F.get(F.array(*[F.struct(*map(F.lit, x[:4])) for x in FIELDS]), (c("event_id") % len(FIELDS)).cast("int"))
    return spread(spark, sf, "events").withColumn("f", f).select(
        "event_id", P.classify_field(*[c(f"f.col{i}") for i in (1, 2, 3, 4)]).alias("category"))


LINKS = [("Политика конфиденциальности", "/p", "privacy_policy"), ("", "/cookie-policy", "cookie_policy"), ("Согласие на рассылку", "/x", "ad_consent"),
         ("", "/publichnaya-oferta", "offer"), ("Даю согласие", "/s", "consent"), ("", "/user-agreement", "user_agreement"), ("Каталог", "/catalog", "other"),
         ("", "/%D0%BA%D1%83%D0%BA%D0%B8", "cookie_policy")]


@query("p09_p10_doc_type", "SELECT page_id, t AS doc_type, t <> 'other' AS looks FROM (SELECT page_id, (%s)[page_id %% %d + 1] AS t FROM pages)"
       % ([x[2] for x in LINKS], len(LINKS)))
def p09(spark, sf):
    x = F.get(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _ in LINKS]), (c("page_id") % len(LINKS)).cast("int"))
    df = table(spark, sf, "pages").withColumn("x", x).withColumn("u", F.concat(U.base_from_url(c("url")), "x.b"))
    return df.select("page_id", P.classify_doc_type(c("x.a"), c("u"), F.lit("")).alias("doc_type"),
                     P.looks_like_document(c("x.a"), c("u"), F.lit("")).alias("looks"))


@query("p11_p12_presence", """
SELECT doc_id, doc_id % 6 IN (0, 1) OR doc_id % 6 = 2 AS matches, doc_id % 6 IN (0, 2, 4) AS present FROM documents""")
def p11(spark, sf):
    m = c("doc_id") % 6
    text = F.when(m.isin(0, 1, 2), F.concat(F.lit("Политика конфиденциальности. "), "text")).otherwise(F.translate("text", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    src = F.when(m.isin(0, 1, 3), "guess").when(m == 2, "agent").otherwise("anchor")
    accessible, confirmed = m.isin(0, 2, 3), m == 4
    kind = F.lit("privacy_policy")
    return spread(spark, sf, "documents").withColumn("t", text).select(
        "doc_id", P.text_matches_doc_type(c("t"), kind, F.lit("")).alias("matches"),
        P.document_is_present(src, kind, accessible, confirmed, c("t"), F.lit("")).alias("present"))


@query("p13_link_confirmed", "SELECT page_id, page_id % 6 IN (0, 5) AS confirmed FROM pages")
def p13(spark, sf):
    m, base = c("page_id") % 6, U.base_from_url(c("url"))
    doc = F.concat(base, F.lit("/privacy"))
    final = (F.when(m == 1, F.lit("https://elsewhere.org/privacy")).when(m == 2, F.concat(base, F.lit("/"))).when(m == 5, F.lit("")).otherwise(doc))
    final = F.when(m == 5, F.concat(base, F.lit("/privacy-2"))).otherwise(final)
    status, ok = F.when(m == 3, 404).otherwise(200), m != 4
    sites = with_site_domain(table(spark, sf, "pages").select(base.alias("base_url")).distinct())
    pages = table(spark, sf, "pages").join(sites, base == c("base_url"))
    same = on_site(final, c("domain"), c("below"))
    return pages.select("page_id", P.link_confirmed(doc, final, status, ok, same).alias("confirmed"))


@query("p16_p17_https_country", """
SELECT n_nationkey, page_id, url LIKE 'https://%' AS https, NOT (n_name = 'RUSSIA') AS is_foreign
FROM pages JOIN nation ON n_nationkey = page_id % 25""")
def p16(spark, sf):
    n = table(spark, sf, "nation")
    return table(spark, sf, "pages").join(n, c("page_id") % 25 == c("n_nationkey")).select(
        "n_nationkey", "page_id", P.is_https(c("url")).alias("https"), P.country_is_foreign(c("n_name")).alias("is_foreign"))


@query("j17_relevant_documents", f"""
SELECT page_id, url FROM pages WHERE regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) = (['example.com', 'example.net', 'example.org'])[page_id % 3 + 1]""")
def j17(spark, sf):
    docs = table(spark, sf, "pages").select("page_id", (c("page_id") % 3).alias("site_id"), "url")
    sites = table(spark, sf, "pages").select((c("page_id") % 3).alias("site_id")).distinct().withColumn(
        "base_url", F.get(F.array(*map(F.lit, ("https://www.example.com", "http://example.net", "https://a.b.example.org"))), c("site_id").cast("int")))
    return relevant_documents(docs, sites).select("page_id", "url")


#: Cyrillic letters of the stored bodies, and the byte of each in two charsets as a Latin-1 character
CYRILLIC, ASCII = "абвгдежзийклмнопрстуфхцчшщъ", "abcdefghijklmnopqrstuvwxyz."
BODY = f"""translate(regexp_replace(lower(coalesce(text, '')), '[^\\x00-\\x7F]', '', 'g'), '{ASCII}', '{CYRILLIC}')"""


@query("x19_decode_bodies", f"""
SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 3 THEN repeat(' ', 5000) || '<meta charset=koi8-r>' || {BODY} ELSE {BODY} END) AS text_md5 FROM documents""")
def x19(spark, sf):
    """Bodies in UTF-8, windows-1251 (declared or not) and KOI8-R that only byte 5,000 and on declares."""
    k = c("doc_id") % 4
    plain = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\x00-\x7F]", ""), ASCII, CYRILLIC)

    def encoded(text, charset):
        return F.encode(F.translate(text, CYRILLIC, CYRILLIC.encode(charset).decode("latin-1")), "ISO-8859-1")

    declared = F.concat(F.repeat(F.lit(" "), 5000), F.lit("<meta charset=koi8-r>"), plain)
    body = F.when(k == 0, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).when(k == 3, encoded(declared, "koi8-r")).otherwise(encoded(plain, "cp1251"))
    kind = F.when(k == 0, "text/html; charset=UTF-8").when(k == 1, "text/html; charset=windows-1251").otherwise("text/html")
    stored = spread(spark, sf, "documents").select(c("doc_id").cast("string").alias("url"), body.alias("content"), kind.alias("content_type"))
    return decode_bodies(stored).select(c("url").cast("long").alias("doc_id"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))
