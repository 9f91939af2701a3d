"""A crawl derived from ``pages``: every stored page keeps its markup and gets one of twelve
fragments of our own (by ``page_id % 12``) at the start of its body, so that forms, services and
documents occur; the first page of a host becomes its homepage and links all others: the first page of
a template under its usual path, the rest below ``/archive``. A host with a page of the last template
also has an empty shell, a row of its own without page_id. Nothing of the crawl is left out or capped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.registry import table
from sitelens.functions import urls as U
from sitelens.plans.audit import AuditTables, audit, stage_facts
from sitelens.sources.leads import normalize_leads
from sitelens.sources.staging import sql_conf, work_dir

PATHS = ["/plain", "/contacts", "/order", "/callback", "/news", "/doctor", "/about", "/privacy-policy", "/legal/doc-8",
         "/form", "/gallery", "/shell"]
LINK_TEXTS = ["Договор", "Контакты", "Заявка", "Консультация", "Подписка", "Запись к врачу", "Cookies",
              "Политика конфиденциальности", "Пользовательское соглашение", "Заявка сейчас", "Контакты филиала",
              "Согласие на рассылку"]
POLICY = (
    "Политика обработки данных. Оператор ООО «Пример», ИНН 7701234567, юридический адрес: г. Москва. "
    "Цели: ответ на заявки пользователей. Перечень: имя, телефон, e-mail, сообщения. Основание: договор. "
    "Срок хранения один год. Отзыв согласия письмом. Третьи лица: хостинг. Метрика: Яндекс.Метрика, cookie. "
    "Меры защиты приняты. Версия 2.1 от 01.02.2024."
)
FRAGMENTS = [
    "<p>Добро пожаловать.</p>",
    '<form><label for="n">Ваше имя</label><input id="n" name="user_name"><input type="tel" name="t">'
    '<label><input type="checkbox" name="ok"> Согласен с <a href="/privacy-policy">политикой</a></label>'
    "<button>Отправить заявку</button></form>",
    '<form><input type="email" name="mail"><textarea name="message"></textarea>'
    '<label><input type="checkbox" name="ok" checked> Даю согласие и принимаю условия оферты</label>'
    '<input type="submit" value="Оформить"></form>',
    '<form><input type="tel" name="t"><button>Жду звонка</button><p>Нажимая кнопку, вы соглашаетесь с '
    '<a href="/privacy-policy">политикой</a></p></form>',
    '<div class="sub"><input type="email" name="mail"><button>Подписаться на новости</button></div>',
    '<form><h2>Запись на прием</h2><input name="user_name"><label>Жалобы <textarea name="c"></textarea></label>'
    '<input type="file" name="scan"><button>Записаться</button></form>',
    '<script src="https://www.googletagmanager.com/gtm.js?id=1"></script>'
    '<script src="https://mc.yandex.ru/metrika/tag.js"></script>'
    '<div class="cookie-banner">Мы используем cookie <button>Принять</button></div>',
    f"<p>{POLICY}</p>",
    "<p>Пользовательское соглашение компании [название]. Пишите: info@other-company.ru.</p>",
    '<div id="marquiz-quiz"></div>',
    '<img src="http://static.example.org/pic.png"><script src="https://static.hotjar.com/c/hotjar.js"></script>'
    '<iframe src="https://fastly.example.org/f"></iframe>',
    "",
]
NAV = "<ul>" + "".join(f'<li><a href="{p}">{t}</a></li>' for p, t in zip(PATHS, LINK_TEXTS))
ARCHIVED = "Контакты"  # planned for its forms, and no document by its words
INDUSTRIES = ("auto", "образование", "HR/рекрутинг")

# The same derivation in SQL: host, template, role and audited pages. Facts per template are
# written by hand from the fragments above. A banner needs a mention of cookies next to an accept
# word: templates 6 and 7 ("ок" inside "Срок" counts), and homepages (their menu says Cookies) with 1 or 2.
CTE = r"""
WITH base AS (
  SELECT page_id, html, page_id % 12 AS k, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host,
         regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM pages),
home AS (SELECT host, min(page_id) AS home_id FROM base GROUP BY host),
hosts AS (SELECT h.host, h.home_id, b.k AS home_k, b.scheme,
                 CASE length(h.host) % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'образование' ELSE 'HR/рекрутинг' END AS industry
          FROM home h JOIN base b ON b.page_id = h.home_id),
firsts AS (SELECT b.host, b.k, min(b.page_id) AS page_id FROM base b JOIN home h USING (host)
           WHERE b.page_id <> h.home_id GROUP BY b.host, b.k),
audited AS (
  SELECT b.host, b.k, b.page_id, b.page_id = h.home_id AS is_home, f.page_id IS NOT NULL AS is_first,
    CASE WHEN b.page_id = h.home_id THEN '/' WHEN f.page_id IS NULL OR b.k = 11 THEN '/archive/' || b.page_id
      ELSE (['/plain', '/contacts', '/order', '/callback', '/news', '/doctor', '/about', '/privacy-policy', '/legal/doc-8', '/form', '/gallery', '/shell'])[b.k + 1] END AS path
  FROM base b JOIN home h USING (host) LEFT JOIN firsts f USING (host, k, page_id)
  UNION ALL SELECT host, NULL, NULL, FALSE, FALSE, '/shell' FROM firsts WHERE k = 11),
site AS (
  SELECT h.host, h.scheme, h.industry, h.home_k, count(*) AS n_audited, count(*) FILTER (a.path LIKE '/archive/%') AS n_archived,
    bool_or(a.k = 1) AS k1, bool_or(a.k = 2) AS k2, bool_or(a.k = 3) AS k3, bool_or(a.k = 4) AS k4,
    bool_or(a.k = 5) AS k5, bool_or(a.k = 6) AS k6, bool_or(a.k = 9) AS k9, bool_or(a.k = 10) AS k10,
    bool_or(a.k = 6 AND NOT is_home) AS d6, bool_or(a.k = 7 AND NOT is_home) AS d7,
    bool_or(a.k = 8 AND NOT is_home) AS d8, coalesce(bool_or(a.k = 11 AND NOT is_home), FALSE) AS d11,
    bool_or(a.k IN (6, 7) OR (a.is_home AND a.k IN (1, 2))) AS banner,
    count(*) FILTER (a.k IN (1, 2, 3, 4, 5, 9)) AS n_pd,
    count(*) FILTER (a.k IN (1, 3)) AS n_linked,
    bool_or(alien AND a.k = 6) AS mail6, bool_or(alien AND a.k = 7) AS mail7, bool_or(alien) AS mail
  FROM hosts h JOIN audited a USING (host) LEFT JOIN (
    SELECT page_id, is_first AND a.k IN (6, 7) AND len(list_filter(
      regexp_extract_all(b.html, '[a-zA-Z0-9._%+\-]+@([a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})', 1),
      lambda x: regexp_extract(x, '([^.]+\.[^.]+)$', 1) <> regexp_extract(b.host, '([^.]+\.[^.]+)$', 1))) > 0 AS alien
    FROM base b JOIN audited a USING (page_id)) USING (page_id) GROUP BY ALL),
flags AS (SELECT *, TRUE AS linked, n_pd > 0 AS pd, (k6 OR k10) AS trackers, (k4 OR k6 OR k10) AS cookies, industry = 'образование' AS children,
                 industry = 'HR/рекрутинг' AS hr FROM site)
"""


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    base = pages.select("page_id", F.col("url").alias("src"), (F.col("page_id") % 12).cast("int").alias("k"), U.get_host(F.col("url")).alias("host"))
    home = base.groupBy("host").agg(
        F.min_by(F.struct("page_id", F.regexp_extract("src", "^([a-z]+):", 1).alias("scheme")), "page_id").alias("h"))
    keys = base.select("page_id", "host", "k").join(home, "host")  # the markup stays out of the joins by host
    firsts = keys.where("page_id <> h.page_id").groupBy("host", "k").agg(F.min("page_id").alias("first_id"))
    is_home = F.col("page_id") == F.col("h.page_id")
    paths, fragments = (F.array(*map(F.lit, x)) for x in (PATHS, FRAGMENTS))
    root = F.concat("h.scheme", F.lit("://"), "host")
    archived = ~is_home & (F.col("first_id").isNull() | (F.col("page_id") != F.col("first_id")) | (F.col("k") == 11))
    link = F.concat(F.lit('<li><a href="/archive/'), F.col("page_id").cast("string"), F.lit(f'">{ARCHIVED}</a></li>'))
    keys = keys.join(firsts, ["host", "k"], "left")
    # a list as long as its host goes to one row, the homepage; markup is dealt by page, once and without sorting
    links = keys.where(archived).groupBy("h.page_id").agg(F.array_join(F.array_sort(F.collect_list(link)), "").alias("links"))
    df = pages.select("page_id", "html").join(keys.join(links, "page_id", "left").hint("shuffle_hash"), "page_id")
    nav = F.concat(F.lit(NAV), F.coalesce("links", F.lit("")), F.lit("</ul>"))
    fragment = F.concat(F.lit("<body><main>"), F.get(fragments, F.col("k")), F.lit("</main>"), F.when(is_home, nav).otherwise(""))
    rows = df.select(
        "page_id", "k", "host",
        F.when(is_home, F.concat(root, F.lit("/"))).when(archived, F.concat(root, F.lit("/archive/"), F.col("page_id").cast("string")))
        .otherwise(F.concat(root, F.get(paths, F.col("k")))).alias("url"),
        F.replace(F.col("html"), F.lit("<body>"), fragment).alias("html"),
        F.when(F.col("k") == 4, "sid=1; Domain=.shop.ru\n_ga=GA1.2; Path=/").otherwise("").alias("set_cookie"))
    shells = firsts.where("k = 11").join(home, "host").select(
        F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("int").alias("k"), "host", F.concat(root, F.lit(PATHS[11])).alias("url"),
        F.lit("").alias("html"), F.lit("").alias("set_cookie"))
    return rows.unionByName(shells).withColumns({"status_code": F.lit(200), "ok": F.lit(True)})


def leads(spark: SparkSession, sf: str) -> DataFrame:
    host = U.get_host(F.col("url"))
    rows = table(spark, sf, "pages").select(host.alias("site_id")).distinct().select(
        "site_id", F.concat(F.lit("https://"), "site_id").alias("site_url"), F.lit("").alias("company_name"),
        F.get(F.array(*map(F.lit, INDUSTRIES)), (F.length("site_id") % 3)).alias("industry"))
    return normalize_leads(rows)


_facts: dict = {}
_audits: dict = {}


def _key(spark, sf):
    return (spark.sparkContext.applicationId, sf)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the derived crawl, written once per session and scale."""
    if _key(spark, sf) not in _facts:
        # shuffled small partitions would be merged into one task by default, and parsing is CPU-bound
        with sql_conf(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
            _facts[_key(spark, sf)] = stage_facts(crawl(spark, sf), work_dir(spark))
    return _facts[_key(spark, sf)]


def audited(spark: SparkSession, sf: str) -> AuditTables:
    if _key(spark, sf) not in _audits:
        _audits[_key(spark, sf)] = audit(leads(spark, sf), None, facts=facts(spark, sf))
    return _audits[_key(spark, sf)]
