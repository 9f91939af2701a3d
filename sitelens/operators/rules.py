"""Rules, scores and confidence (R001-R027, J13, A07-A09, A18, A19, W02, W03).

A rule is a Column on the wide site context that is an evidence struct when the rule fires
and NULL otherwise. All rules are evaluated in one projection; add one with ``RULES``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens import catalogue
from sitelens.functions import text as X

MAX_SCORE = 150
R016_HOME = ("", "unknown", "RU", "Russia", "Российская Федерация", "Россия")

c = F.col


def status(item_id: str) -> Column:
    return F.coalesce(F.try_element_at(c("items"), F.lit(item_id))["status"], F.lit("not_found"))


def found(item_id: str) -> Column:
    return status(item_id) == "found"


def _missing(*ids) -> Column:
    return F.filter(F.array(*[F.when(~found(i), F.lit(i)) for i in ids]), lambda x: x.isNotNull())


def _or(text: Column, fallback: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(fallback)


def _joined(arr: Column, k: int) -> Column:
    return F.array_join(F.slice(arr, 1, k), ", ")


def rule_columns() -> dict[str, Column]:
    def ev(cond, page, quote, html=None, **extra):
        return F.when(cond, X.evidence(page, quote if isinstance(quote, Column) else F.lit(quote), html, extra))

    first = c("first_page_url")
    final = F.when(F.coalesce("site_final_url", F.lit("")) != "", c("site_final_url")).otherwise(c("site_url"))
    policy_url = F.coalesce("d_policy.url", first)
    pd = c("has_pd_forms")

    def form_page(name):
        return F.coalesce(F.col(f"{name}.page_url"), first)

    abroad = ~c("server_country").isin(*R016_HOME) & (c("geoip_confidence") > 0)
    return {
        "R001": ev(pd & ~c("has_privacy_policy"), c("f_pd.page_url"), "Формы с данными есть, политика не найдена.",
                   pd_forms_count=c("n_pd_forms")),
        "R002": ev(c("f_unlinked").isNotNull(), c("f_unlinked.page_url"), _or(c("f_unlinked.text"), "Ссылки на политику у формы нет.")),
        "R003": ev(c("f_no_consent").isNotNull(), c("f_no_consent.page_url"), "Ни флажка, ни текста согласия у формы.",
                   c("f_no_consent.html")),
        "R004": ev(c("f_button").isNotNull(), c("f_button.page_url"), _or(c("f_button.text"), "Согласие только кнопкой.")),
        "R005": ev(c("f_prechecked").isNotNull(), c("f_prechecked.page_url"), "Флажок согласия стоит заранее.",
                   c("f_prechecked.html")),
        "R006": ev(c("f_merged").isNotNull(), c("f_merged.page_url"), _or(c("f_merged.text"), "Согласие слито с договором.")),
        "R007": ev(c("policy_readable") & (F.size(_missing("PP_003", "PP_005", "PP_006")) > 0), policy_url,
                   "Сведения об операторе неполны.", missing_items=_joined(_missing("PP_003", "PP_005", "PP_006"), 3)),
        "R008": ev(c("policy_readable") & (F.size(_missing("PP_009", "PP_010", "PP_011")) > 0), policy_url,
                   "Цели, данные или субъекты не описаны.", missing_items=_joined(_missing("PP_009", "PP_010", "PP_011"), 3)),
        "R009": ev(c("policy_readable") & status("PP_012").isin("not_found", "unclear"), policy_url,
                   "Поля форм в политике названы не все.", pp_012_status=status("PP_012")),
        "R010": ev(pd & ~found("PP_015") & ~found("PP_018") & ~found("Consent_008") & ~found("Consent_009"), first,
                   "Сроки и отзыв не описаны.", checked_items=F.lit("PP_015, PP_018, Consent_008, Consent_009")),
        "R011": ev((F.size("tracking_names") > 0) & ~c("cookie_banner_found"),
                   F.coalesce(F.when(c("t_tracking.page_url") != "", c("t_tracking.page_url")), first),
                   "Счётчики без баннера.", trackers=_joined(c("tracking_names"), 10)),
        "R012": ev(c("marketing_before_consent"), first, _or(c("before_consent_evidence"), "Слежение до согласия.")),
        "R013": ev(c("cookies_present") & ~c("has_cookie_policy") & ~found("PP_022"), first, "О cookies не рассказано."),
        "R014": ev(c("trackers_present") & c("has_privacy_policy") & ~found("PP_024"), first, "Сервисы не названы.",
                   trackers=_joined(c("tracker_names"), 10)),
        "R015": ev(c("foreign_trackers_present") & ~found("PP_020"), first, "Зарубежные сервисы без раскрытия передачи.",
                   foreign_trackers=_joined(c("foreign_names"), 10)),
        "R016": ev(pd & abroad, first, "Адрес сервера за границей.", server_country=c("server_country"),
                   geoip_confidence=c("geoip_confidence"), ip_addresses=_joined(c("ip_addresses"), 5)),
        "R017": ev(~c("https_enabled"), final, "Нет HTTPS."),
        "R018": ev(c("mixed_content_found"), final, "Ресурсы по HTTP.", mixed_content_urls=F.array_join("mixed_content_urls", ", ")),
        "R019": ev(c("newsletter_form") & ~c("has_ad_consent") & ~c("form_ad_consent"), form_page("f_newsletter"),
                   "Подписка без согласия на рекламу."),
        "R020": ev(c("medical") & ~(found("PP_027") & found("Consent_014")), form_page("f_medical"), "Возможны данные о здоровье."),
        "R021": ev(c("children") & ~found("PP_029"), form_page("f_children"), "Данные детей не раскрыты."),
        "R022": ev(c("file_upload") & ~found("Consent_015"), form_page("f_file"), "Файлы без раскрытия."),
        "R023": ev(c("hr") & ~(found("Consent_008") & found("PP_015")), form_page("f_hr"), "Резюме без целей и сроков.",
                   missing_items=_joined(_missing("Consent_008", "PP_015"), 2)),
        "R024": ev(c("ecommerce") & ~c("has_offer"), first, "Продажи без оферты."),
        "R025": ev(c("d_blank").isNotNull(), F.coalesce(F.when(c("d_blank.url") != "", c("d_blank.url")), first),
                   "Пустые места шаблона.", placeholders=_joined(c("d_blank.found"), 10), doc_type=c("d_blank.doc_type")),
        "R026": ev(c("k_company").isNotNull(), F.coalesce(F.when(c("k_company.url") != "", c("k_company.url")), first),
                   _or(c("k_company.comment"), "Адрес на чужом домене."), conflict_type=c("k_company.type"),
                   detected_fact=c("k_company.detected_fact"), document_statement=c("k_company.document_statement")),
        "R027": ev(pd, first, "Проверить уведомление регулятора."),
    }


# User rules: full rule id -> function that returns the evidence Column. A catalogue row is needed too.
RULES: dict[str, Callable[[], Column]] = {}


def rule_context(ctx: DataFrame, items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Site context plus the checklist map and the first company or domain conflict."""
    own = conflicts.where((F.lower("source") != "llm") & F.lower("type").rlike("company|domain"))
    first = own.groupBy("site_id").agg(F.min(F.struct(
        "doc_pos", "pos", "type", "detected_fact", "document_statement", "comment", "url")).alias("k_company"))
    denied = conflicts.groupBy("site_id").agg(
        F.coalesce(F.bool_or(F.col("type").contains("cross_border_denied")), F.lit(False)).alias("transfer_denied"))
    return (ctx.join(items, "site_id", "left").join(first, "site_id", "left").join(denied, "site_id", "left")
            .withColumn("transfer_denied", F.coalesce("transfer_denied", F.lit(False))))


def apply_rules(ctx: DataFrame, path=None) -> DataFrame:
    """Fired rules of every reachable site, ranked: level, score, then catalogue order."""
    columns = rule_columns()
    fired = []
    for r in catalogue.rules(path):
        custom = RULES.get(r["rule_id"])
        built_in = columns.get(r["rule_id"].split("_", 1)[0])
        column = custom() if custom else built_in
        if column is not None:
            fired.append(F.when(column.isNotNull(), F.struct(F.lit(r["rule_pos"]).alias("rule_pos"), column.alias("evidence"))))
    each = ctx.where("reachable").select(
        "site_id", F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("r")).select(
        "site_id", "r.rule_pos", "r.evidence")
    meta = catalogue.load_rules(ctx.sparkSession, path)
    return rank_risks(each.join(meta, "rule_pos").withColumn("page_url", F.col("evidence.page_url")))


def rank_risks(risks: DataFrame) -> DataFrame:
    order = Window.partitionBy("site_id").orderBy(F.desc(X.level_rank(F.col("risk_level"))), F.desc("score"), "rule_pos")
    return risks.withColumn("rank", F.row_number().over(order))


def top_risks(risks: DataFrame, n: int = 3) -> DataFrame:
    return risks.where(F.col("rank") <= n)


def top_titles(risks: DataFrame, n: int = 3) -> DataFrame:
    return top_risks(risks, n).groupBy("site_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), "; ").alias("top_risks"))


def legal_basis(ids: DataFrame, path=None) -> DataFrame:
    """Legal basis text per rule id, empty for an unknown id."""
    meta = catalogue.load_rules(ids.sparkSession, path).select("rule_id", "legal_basis")
    return ids.join(meta, "rule_id", "left").withColumn("legal_basis", F.coalesce("legal_basis", F.lit("")))


def score_level(score: Column) -> Column:
    return F.when(score <= 20, "low").when(score <= 50, "medium").when(score <= 80, "high").when(score > 80, "critical") \
        .otherwise("unknown")


def score_sites(ctx: DataFrame, risks: DataFrame) -> DataFrame:
    """Risk score, level, confidence and review flags of every lead; unreachable sites are unknown."""
    total = risks.groupBy("site_id").agg(
        F.sum("score").alias("raw_score"), F.count_if(F.col("evidence.quote") != "").alias("quotes"))
    df = ctx.join(total, "site_id", "left")
    score = F.least(F.lit(MAX_SCORE), F.greatest(F.lit(0), F.coalesce("raw_score", F.lit(0)))).cast("int")

    def pts(cond, n):
        return F.when(cond, n).otherwise(0)

    home_errors = F.concat(
        F.when(F.col("reachable") & (F.col("fetch_method") != "playwright"),
               F.array(F.lit("Страницы получены без браузера: часть ссылок могла не загрузиться.")))
        .otherwise(F.array().cast("array<string>")),
        F.coalesce("p_home.errors", F.array().cast("array<string>")))
    n_errors = F.size(home_errors)
    verdicts = F.col("has_verdicts") if "has_verdicts" in ctx.columns else F.lit(False)
    screenshot = F.col("has_screenshot") if "has_screenshot" in ctx.columns else F.lit(False)
    geo_unknown = F.col("server_country").isin("", "unknown") | (F.col("geoip_confidence") <= 0)
    conf = (
        50 + F.least(F.col("n_docs_text") * 5, F.lit(20)) + F.least(F.coalesce("quotes", F.lit(0)) * 3, F.lit(12))
        + pts(F.col("n_trackers") > 0, 5) + pts(F.col("n_cookies") > 0, 3) + pts(screenshot, 5)
        + pts(F.col("pages_checked") >= 3, 5) - F.least(F.col("n_docs_failed") * 6, F.lit(18))
        - F.least(F.col("n_unreachable") * 5, F.lit(20)) - pts(~verdicts, 10) - pts(geo_unknown, 5)
        - F.least(n_errors, F.lit(5))
    )
    conf = F.least(F.lit(100), F.greatest(F.lit(0), conf)).cast("int")
    up = F.col("reachable")
    return df.withColumns({
        "risk_score": F.when(up, score).otherwise(0), "risk_level": F.when(up, score_level(score)).otherwise("unknown"),
        "confidence": F.when(up, conf).otherwise(0),
    }).withColumns({
        "requires_manual_review": F.lit(True), "low_confidence": F.col("confidence") < 50,
        "errors": F.concat(
            home_errors, F.filter(F.array(
                F.when(~up, F.lit("Сайт недоступен: главная страница не получена.")),
                F.when(up & (F.col("confidence") < 50), F.lit("Низкая достоверность: данных мало, нужна проверка юриста."))),
                lambda x: x.isNotNull())),
    }).drop("raw_score", "quotes")
