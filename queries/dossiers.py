"""Dossiers derived from ``documents``: four rows in a row are the legal documents of one site. Each
keeps its whole text and gains some of PHRASES, chosen by its id, so that every checklist item, handler
and conflict occurs in several states; every eleventh document has no text. The facts of a site follow
from its number. The SQL matches keywords, addresses and numbers in the texts itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.columns import DATE, WS, sql_clean, sql_norm
from queries.registry import query, spread
from sitelens import catalogue
from sitelens.functions import text as X
from sitelens.operators import checklist as C
from sitelens.plans import report
from sitelens.sources.staging import sql_conf, staged, work_dir

c = F.col
TYPES = (("privacy_policy", "consent", "special_consent", "distribution_consent"), ("cookie_policy", "offer", "user_agreement", "ad_consent"))
PROVIDERS = ("Яндекс.Метрика", "Google Analytics", "Hotjar")
CATEGORIES = ("name", "phone", "email", "message", "file", "medical", "passport")
#: words for handlers and conflicts; the first keyword of every catalogue item is added below
SPECIAL = [
    "Оператор ООО «Пример», ИНН 7701234567.", "Заполните [название организации].", "Пишите на info@other-company.ru.", "Почта: shop@mail.ru, help@example.ru.",
    "Версия 2.1 от 01.02.2024.", "Утверждена дата ввода.", "Трансграничная передача не осуществляется.", "Передача за пределы Российской Федерации возможна.",
    "Настоящая оферта действует.", "Даю согласие на обработку.", "Счётчик Яндекс.Метрика.", "Файлы cookie.", "Hotjar записывает ход.", "Имя, телефон, сообщения.",
    "Электронная почта, файлы, сведения о здоровье.", "Паспорт не нужен.", "Хостинг и CRM третьих лиц."]
LISTS = catalogue.checklists(None)
PHRASES = SPECIAL + sorted({i["norm_keywords"][0] + "." for t in TYPES for d in t for i in LISTS[d] if i["norm_keywords"]})


#: facts of a site by its pair number (two sites make a pair), as SQL that Spark and DuckDB read alike
FLAGS = {flag: f"pair % {j + 2} <> 1" for j, flag in enumerate(C.APPLIES)} | {
    "n_pd_forms": "pair % 3", "n_pd_linked": "pair % 4", "pd_link": "pair % 4 = 2", "form_merged": "pair % 4 = 1", "form_prechecked": "pair % 5 = 1",
    "form_button_only": "pair % 3 = 1", "cookie_banner_found": "pair % 2 = 0", "marketing_before_consent": "pair % 7 < 3"}


def _has(phrase: int) -> str:
    return f"(doc_id * {5 * phrase % 12 + 1} + {phrase}) % 13 < 4"


def dossiers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents of all sites, and the facts of the sites."""
    number, place = F.expr("doc_id div 4"), F.expr("cast(doc_id % 4 as int)")
    types = F.when(number % 2 == 0, F.get(F.array(*map(F.lit, TYPES[0])), place)).otherwise(F.get(F.array(*map(F.lit, TYPES[1])), place))
    picked = F.array_join(F.array_compact(F.array(*[F.when(F.expr(_has(i)), F.lit(p)) for i, p in enumerate(PHRASES)])), " ")
    blank = c("doc_id") % 11 == 7
    docs = spread(spark, sf, "documents").where("doc_id is not null").select(
        number.alias("site_id"), place.alias("doc_pos"), types.alias("doc_type"), F.concat(F.lit("https://example.ru/d/"), "doc_id").alias("url"),
        F.concat(F.lit("Документ "), "doc_id").alias("title"), F.lit("html").alias("format"),
        F.when(blank, "").otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), picked)).alias("text"), blank.alias("text_extraction_failed"),
        (~blank).alias("is_accessible"), F.when(blank, "text_extraction_failed").otherwise("").alias("extraction_error"))
    docs = docs.withColumns({"date_detected": X.detect_date(c("text")), "version_detected": X.detect_version(c("text"))})

    def some(values, rule):
        return F.array_compact(F.array(*[F.when(rule(i), F.lit(v)) for i, v in enumerate(values)]))

    ctx = docs.select("site_id").distinct().withColumn("pair", F.expr("site_id div 2")).withColumns({k: F.expr(v) for k, v in FLAGS.items()}).withColumns({
        "pd_categories": some(CATEGORIES, lambda i: c("pair") % (i + 2) == 0), "providers": some(PROVIDERS, lambda i: c("pair") % (i + 3) != 0),
        "registered_domain": F.lit("example.ru"), "below": F.from_json(F.lit("[]"), "array<struct<key: string, kind: string, labels: int>>")})
    return docs, ctx


_checked: dict = {}


def checked(spark: SparkSession, sf: str):
    """Documents, item results, conflicts and summaries, written once per session and scale."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _checked:
        docs, ctx = dossiers(spark, sf)
        # partitions of texts are not merged: what is done to a text costs more than a task
        with sql_conf(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
            facts = staged(C.with_facts(docs, ctx).withColumn("placeholder", F.size("blanks") > 0), work_dir(spark), "dossiers")
        results = staged(C.run_checklist(facts), work_dir(spark), "dossier_items")
        conflicts = staged(C.detect_conflicts(facts), work_dir(spark), "dossier_conflicts")
        _checked[key] = facts, results, conflicts, C.doc_analysis(facts, results, conflicts)
    return _checked[key]


# ---- the same in SQL ---------------------------------------------------------------------
def _q(s):
    return "'" + str(s).replace("'", "''") + "'"


def _strings(values):
    return "([" + ", ".join(map(_q, values)) + "]::VARCHAR[])"


def _words(kind):
    return "CASE cat " + " ".join(f"WHEN {_q(k)} THEN {_strings(v)}" for k, v in C.CATEGORY_WORDS.items()) + " ELSE [cat] END"


def _any(words, text="norm"):
    return f"len(list_filter({_strings(words)}, lambda w: contains({text}, w))) > 0"


def _search(default):
    """First keyword of the item, or of the handler where the item has none."""
    return f"list_filter(CASE WHEN len(kws) > 0 THEN kws ELSE {_strings(default)} END, lambda w: contains(norm, w))"


HOLDER = ("(?i)\\[[^\\]]{0,40}\\]|\\{\\{[^}]{0,40}\\}\\}|_{3,}|«?ромашк[а-яёa-z0-9_]*»?|наименовани[а-яёa-z0-9_]*\\s+оператора|адрес[а-яёa-z0-9_]*\\s+оператора|"
          "указать|вставить|ваш[аеиуый]*\\s+компани[яи]|пример[а-яёa-z0-9_]*\\s+ооо")
VERSION = "(?i)(?:верси[яи]|version|редакци[яи]|ред\\.)\\s*[:№]?\\s*([0-9]+(?:\\.[0-9]+)*)"
#: handler: its verdict as (status, confidence), as a CASE without END
HANDLERS = {
    "doc_accessible": "WHEN text <> '' THEN ('found', 80) ELSE ('not_found', 60)",
    "policy_near_forms": "WHEN n_pd_forms = 0 THEN ('not_applicable', 0) WHEN n_pd_linked > 0 THEN ('found', 70) ELSE ('not_found', 60)",
    "inn_ogrn": "WHEN numbers THEN ('found', 80) ELSE ('not_found', 60)",
    "policy_matches_forms": "WHEN len(cats) = 0 THEN ('not_applicable', 0) WHEN text = '' THEN ('not_found', 40) WHEN len(covered) = len(cats) THEN ('found', 65) "
                            "WHEN len(covered) > 0 THEN ('unclear', 45) ELSE ('not_found', 50)",
    "third_parties": f"WHEN len({_search(C.THIRD_PARTY_WORDS)}) > 0 THEN ('found', 65) ELSE ('not_found', 55)",
    "cross_border": f"WHEN len({_search(C.BORDER_WORDS)}) > 0 THEN ('found', 65) WHEN foreign_trackers_present THEN ('not_found', 55) ELSE ('unclear', 40)",
    "cookie_providers": "WHEN len(providers) = 0 THEN ('not_applicable', 0) WHEN text = '' THEN ('not_found', 40) WHEN len(named) = len(providers) THEN ('found', 65) "
                        "WHEN len(named) > 0 THEN ('unclear', 45) ELSE ('not_found', 55)",
    "placeholders": "WHEN blanks THEN ('not_found', 65) ELSE ('found', 70)",
    "company_conflict": "WHEN len(foreign_mail) > 0 THEN ('not_found', 45) ELSE ('found', 55)",
    "doc_date": f"WHEN stamped THEN ('found', 75) WHEN len({_search(C.DATE_WORDS)}) > 0 THEN ('found', 55) ELSE ('not_found', 55)",
    "consent_separate": f"WHEN form_merged THEN ('not_found', 55) WHEN {_any(('настоящая оферта', 'публичная оферта', 'пользовательское соглашение'))} AND "
                        f"{_any(('согласие на обработку', 'даю согласие'))} THEN ('unclear', 45) ELSE ('found', 55)",
    "consent_prechecked": "WHEN form_prechecked THEN ('not_found', 65) ELSE ('found', 60)",
    "consent_link_clickable": "WHEN n_pd_forms = 0 THEN ('not_applicable', 0) WHEN pd_link THEN ('found', 55) ELSE ('not_found', 55)",
    "button_acceptance": "WHEN form_button_only THEN ('not_found', 60) ELSE ('found', 55)",
    "newsletter_present": "WHEN newsletter_form THEN ('found', 70) ELSE ('not_applicable', 0)",
    "cookie_banner": "WHEN NOT cookies_present THEN ('not_applicable', 0) WHEN cookie_banner_found THEN ('found', 70) ELSE ('not_found', 60)",
    "cookie_banner_notice": "WHEN NOT cookies_present THEN ('not_applicable', 0) WHEN cookie_banner_found THEN ('found', 55) ELSE ('not_found', 55)",
    "cookie_banner_action": "WHEN NOT cookies_present THEN ('not_applicable', 0) ELSE ('unclear', 40)",
    "cookie_banner_link": "WHEN NOT cookies_present THEN ('not_applicable', 0) ELSE ('unclear', 40)",
    "cookies_before_consent": "WHEN NOT cookies_present THEN ('not_applicable', 0) WHEN marketing_before_consent THEN ('not_found', 65) ELSE ('found', 55)",
    "cookie_banner_conflict": "WHEN TRUE THEN ('unclear', 40)",
    "needs_manual": "WHEN TRUE THEN ('unclear', 30)",
}
ROWS = ", ".join(
    f"({_q(d)}, {i['item_pos']}, {_q(i['item_id'])}, {_q(i['label'])}, {_q(i['applies_when'])}, {_q(i['special'])}, {_q(i['risk_if_missing'])}, {_strings(i['norm_keywords'])})"
    for t in TYPES for d in t for i in LISTS[d])


def _some(values, rule):
    return "list_filter([" + ", ".join(f"CASE WHEN {rule(i)} THEN {_q(v)} END" for i, v in enumerate(values)) + "], lambda x: x IS NOT NULL)"


CTE = f"""
WITH item(doc_type, item_pos, item_id, label, applies, special, risk, kws) AS (VALUES {ROWS}),
base AS (SELECT doc_id, doc_id // 4 AS site_id, doc_id // 8 AS pair, (doc_id % 4)::INT AS doc_pos,
    CASE WHEN doc_id // 4 % 2 = 0 THEN {_strings(TYPES[0])}[doc_id % 4 + 1] ELSE {_strings(TYPES[1])}[doc_id % 4 + 1] END AS doc_type,
    CASE WHEN doc_id % 11 = 7 THEN '' ELSE coalesce(text, '') || ' ' || array_to_string({_some(PHRASES, _has)}, ' ') END AS text
  FROM documents WHERE doc_id IS NOT NULL),
flags AS (SELECT *, {sql_norm('text')} AS norm, {', '.join(f'{v} AS {k}' for k, v in FLAGS.items())},
    {_some(CATEGORIES, lambda i: f'pair % {i + 2} = 0')} AS cats, {_some(PROVIDERS, lambda i: f'pair % {i + 3} <> 0')} AS providers,
    regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@([a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}})', 1) AS mail_hosts FROM base),
d AS (SELECT *, list_filter(cats, lambda cat: len(list_filter({_words('cat')}, lambda w: contains(norm, w))) > 0) AS covered,
    list_filter(providers, lambda p: contains(norm, lower(p))) AS named,
    list_filter(list_transform(mail_hosts, lambda h: lower(h)), lambda h: NOT list_contains({_strings(C.PUBLIC_MAIL)}, regexp_extract(h, '([^.]+\\.[^.]+)$', 1))
      AND h <> 'example.ru' AND NOT ends_with(h, '.example.ru')) AS foreign_mail,
    regexp_matches(text, '(?i)ИНН[\\s:№]*?(\\d{{10}}|\\d{{12}})|ОГРН(?:ИП)?[\\s:№]*?(\\d{{13}}|\\d{{15}})|\\b\\d{{12}}\\b|\\b\\d{{10}}\\b|\\b\\d{{13}}\\b|\\b\\d{{15}}\\b') AS numbers,
    regexp_matches(text, '{HOLDER}') AS blanks, regexp_matches(text, '{DATE}') OR regexp_matches(text, '{VERSION}') AS stamped FROM flags),
verdict AS (SELECT *, list_filter(kws, lambda w: contains(norm, w))[1] AS kw,
    CASE applies {' '.join(f"WHEN '{a}' THEN {a}" for a in C.APPLIES)} ELSE TRUE END AS applicable FROM d JOIN item USING (doc_type)),
judged AS (SELECT *, CASE WHEN NOT applicable THEN ('not_applicable', 0)
    WHEN special = '' THEN CASE WHEN text <> '' AND kw IS NOT NULL THEN ('found', 70) ELSE ('not_found', 55) END
    {' '.join(f"WHEN special = '{k}' THEN CASE {v} END" for k, v in HANDLERS.items())} END AS v FROM verdict),
results AS (SELECT *, v[1] AS status, v[2]::INT AS confidence, risk IN ('high', 'critical') AS heavy FROM judged),
told AS (SELECT site_id, doc_pos, doc_type, doc_id, x.pos - 1 AS pos, x.type, x.risk, x.fact FROM (SELECT *, unnest(list_transform(list_filter([
    CASE WHEN doc_type IN ('privacy_policy', 'cookie_policy', 'consent', 'user_agreement', 'other') AND trackers_present AND len(providers) > 0 AND len(named) = 0
      AND NOT {_any(C.TRACKING_WORDS)} THEN {{'type': 'tracker_not_disclosed', 'risk': 'high', 'fact': 'Сервисы сайта: ' || array_to_string(providers, ', ')}} END,
    CASE WHEN foreign_trackers_present AND (regexp_matches(norm, '{C.DENIAL}') OR (contains(norm, 'трансгранич') AND {_any(('не осуществляется', 'не осуществляем', 'не производится'))}))
      THEN {{'type': 'cross_border_denied', 'risk': 'high', 'fact': 'Есть зарубежные сервисы.'}} END,
    CASE WHEN cookies_present AND NOT {_any(('cookie', 'куки'))} THEN {{'type': 'cookies_not_disclosed', 'risk': 'medium', 'fact': 'Есть cookies.'}} END,
    CASE WHEN len(foreign_mail) > 0 THEN {{'type': 'company_conflict', 'risk': 'medium', 'fact': 'Домен сайта: example.ru'}} END], lambda x: x IS NOT NULL),
    lambda x, i: {{'pos': i, 'type': x.type, 'risk': x.risk, 'fact': x.fact}})) AS x FROM d WHERE text <> '')),
n_told AS (SELECT site_id, doc_pos, count(*) AS n FROM told GROUP BY ALL),
summed AS (SELECT site_id, doc_pos, any_value(doc_type) AS doc_type, any_value(text = '') AS failed,
    round_even(100 * count(*) FILTER (status = 'found') / greatest(1, count(*) FILTER (status <> 'not_applicable')), 0)::INT AS done,
    coalesce(list(label ORDER BY item_pos) FILTER (heavy AND status IN ('unclear', 'not_found')), []) AS missing,
    coalesce(list(label || ' (' || risk || ')' ORDER BY item_pos) FILTER (heavy AND status = 'not_found'), []) AS critical,
    coalesce(list(label ORDER BY (status <> 'not_found')::INT, item_pos) FILTER (status IN ('not_found', 'unclear')), []) AS unconfirmed FROM results GROUP BY site_id, doc_pos)
"""
#: the words around the first keyword, 180 characters to each side
QUOTE = f"""CASE WHEN special = '' AND status = 'found' THEN (CASE WHEN instr(norm, kw) > 181 THEN '…' ELSE '' END) ||
  {sql_clean("substr(text, greatest(0, instr(norm, kw) - 181) + 1, least(length(text), instr(norm, kw) - 1 + length(kw) + 180) - greatest(0, instr(norm, kw) - 181))")} ||
  (CASE WHEN instr(norm, kw) - 1 + length(kw) + 180 < length(text) THEN '…' ELSE '' END) END"""


@query("c01_c23_dossier_items", CTE + f"SELECT site_id, doc_pos, doc_type, item_id, status, confidence, risk AS risk_if_missing, {QUOTE} AS quote FROM results")
def items(spark, sf):
    """Every item of every document; quotes of the items that search keywords."""
    _, results, _, _ = checked(spark, sf)
    kinds = catalogue.literal([{"d": d, "i": i["item_id"]} for t in TYPES for d in t for i in LISTS[d] if i["special"] == ""], "d string, i string")
    plain = F.exists(kinds, lambda k: (k["d"] == c("doc_type")) & (k["i"] == c("item_id"))) & (c("status") == "found")
    return results.select("site_id", "doc_pos", "doc_type", "item_id", "status", "confidence", "risk_if_missing", F.when(plain, c("evidence_quote")).alias("quote"))


@query("k01_k04_dossier_conflicts", CTE + "SELECT site_id, doc_pos, doc_type, pos, type, risk, fact FROM told")
def conflicts(spark, sf):
    return checked(spark, sf)[2].select("site_id", "doc_pos", "doc_type", "pos", "type", "risk", c("detected_fact").alias("fact"))


@query("a03_best_status", CTE + """
, ranked AS (SELECT *, CASE status WHEN 'found' THEN 3 WHEN 'unclear' THEN 2 WHEN 'not_found' THEN 1 ELSE 0 END AS r FROM results)
SELECT site_id, item_id, status FROM ranked QUALIFY row_number() OVER (PARTITION BY site_id, item_id ORDER BY r DESC, doc_pos, item_pos) = 1""")
def best(spark, sf):
    """Through the map that rules read: items of several documents of a site meet in one entry."""
    found = C.status_map(checked(spark, sf)[1])
    return found.select("site_id", F.explode("items").alias("item_id", "best")).select("site_id", "item_id", c("best.status").alias("status"))


SUMMARY = "CASE doc_type " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in X.LABELS["doc_type"].items()) + """ ELSE doc_type END || ': раскрыто ' || done || '%.'
  || CASE WHEN failed THEN ' Текст извлечь не удалось.' ELSE '' END
  || CASE WHEN len(missing) > 0 THEN ' Не подтверждено: ' || array_to_string(missing[1:3], '; ') || '.' ELSE ' Важные пункты подтверждены.' END
  || CASE WHEN n > 0 THEN ' Расхождений с сайтом: ' || n || '.' ELSE '' END || ' Вывод предварительный.'"""


@query("a04_a05_a06_dossier_analysis", CTE + f"""
SELECT site_id, doc_pos, doc_type, done AS completeness, array_to_string(missing[1:3], '|') AS missing, coalesce(n, 0) AS n_conflicts, {SUMMARY} AS summary, TRUE AS manual
FROM (SELECT * FROM summed LEFT JOIN n_told USING (site_id, doc_pos))""")
def analysis(spark, sf):
    return checked(spark, sf)[3].select("site_id", "doc_pos", "doc_type", c("overall_completeness").alias("completeness"), F.array_join("missing_high", "|").alias("missing"),
                                        "n_conflicts", "summary", c("requires_manual_review").alias("manual"))


@query("m03_w07_w09_dossier_table", CTE + f"""
, phrase(type, comment) AS (VALUES ('tracker_not_disclosed', 'Сервисы не раскрыты.'), ('cross_border_denied', 'Отрицание расходится с сервисами.'),
  ('cookies_not_disclosed', 'Cookies не раскрыты.'), ('company_conflict', 'Адрес на другом домене, уточнить юрлицо.')),
lines AS (SELECT site_id, doc_pos, string_agg(type || ': ' || comment, '|' ORDER BY pos) AS conflicts FROM told JOIN phrase USING (type) GROUP BY ALL)
SELECT site_id, doc_pos, doc_type, 'Документ ' || (site_id * 4 + doc_pos) AS title, NOT failed AS is_accessible, CASE WHEN failed THEN 'text_extraction_failed' ELSE '' END AS extraction_error,
  blanks AS placeholder, done AS completeness, array_to_string(critical[1:12], '|') AS critical_missing, coalesce(conflicts, '') AS conflicts, array_to_string(unconfirmed[1:3], '|') AS open_items
FROM summed JOIN (SELECT site_id, doc_pos, blanks FROM d) USING (site_id, doc_pos) LEFT JOIN lines USING (site_id, doc_pos)""")
def documents_table(spark, sf):
    docs, results, told, summaries = checked(spark, sf)
    t = report.documents_table(docs, summaries, results, told).join(report.open_items(results), ["site_id", "doc_pos"], "left")

    def text(name):
        return F.coalesce(F.array_join(name, "|"), F.lit("")).alias(name)

    return t.select("site_id", "doc_pos", "doc_type", "title", "is_accessible", "extraction_error", "placeholder", c("overall_completeness").alias("completeness"),
                    text("critical_missing"), text("conflicts"), text("open_items"))
