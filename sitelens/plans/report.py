"""Report marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import text as X
from sitelens.operators import rules as R

YES = "да"
NO = "нет"


def _yes(cond):
    return F.when(cond, YES).otherwise(NO)


def summary(scored: DataFrame, risks: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Bulk summary, one row per lead; ``reports`` (site_id, pdf_path) gives the paths of exports."""
    df = _with_reports(scored.join(R.top_titles(risks), "site_id", "left"), reports)
    types = F.coalesce("accessible_types", F.array().cast("array<string>"))
    return df.select(
        "site_id", "company_name", "site_url", "industry", "scan_mode", "email", "risk_level",
        "risk_score", "confidence", F.coalesce("top_risks", F.lit("")).alias("top_risks"), F.col("n_forms").alias("forms_found"),
        F.array_contains(types, "privacy_policy").alias("privacy_policy_found"),
        F.array_contains(types, "consent").alias("consent_found"), "cookie_banner_found",
        F.col("n_trackers").alias("trackers_found"), F.col("foreign_trackers_present").alias("foreign_trackers_found"),
        "pdf_path", F.lit("scanned").alias("status"))


def _with_reports(df: DataFrame, reports: DataFrame | None) -> DataFrame:
    if reports is None:
        return df.withColumn("pdf_path", F.lit(""))
    latest = reports.groupBy("site_id").agg(F.max("pdf_path").alias("pdf_path"))
    return df.join(latest, "site_id", "left").withColumn("pdf_path", F.coalesce("pdf_path", F.lit("")))


def scan_header(scored: DataFrame, risks: DataFrame, created_at: str, reports: DataFrame | None = None) -> DataFrame:
    """Header row of the scan store."""
    df = _with_reports(scored, reports).join(R.top_titles(risks), "site_id", "left").join(executive_summary(scored, risks), "site_id", "left")
    return df.select(
        F.substring(F.sha2(F.concat_ws("|", "site_id", F.lit(created_at)), 256), 1, 12).alias("scan_id"), "site_id",
        F.lit(created_at).alias("created_at"), "company_name", "site_url", F.col("site_final_url").alias("final_url"),
        "industry", "email", "comment", "risk_score", "risk_level", "confidence", F.lit("scanned").alias("status"),
        "pdf_path", "executive_summary", F.coalesce("top_risks", F.lit("")).alias("top_risks"),
        "pages_checked", "cookie_banner_found", "marketing_before_consent",
        F.col("foreign_trackers_present").alias("foreign_trackers_found"), "fetch_method", "homepage_links", "errors",
        "requires_manual_review")


def forms_table(forms: DataFrame) -> DataFrame:
    pre = F.col("consent.checkbox_prechecked")
    return forms.select(
        "site_id", "page_pos", "form_pos", "page_url", "form_type",
        F.when(F.size("personal_data_fields") > 0, F.array_join("personal_data_fields", ", ")).otherwise("—").alias("fields"),
        _yes(F.col("consent.checkbox_found")).alias("checkbox"), _yes(F.col("consent.privacy_link_found")).alias("policy_link"),
        F.when(pre.isNull(), "?").otherwise(_yes(pre)).alias("prechecked"), _yes(F.col("personal")).alias("personal"))


def critical_missing(results: DataFrame, n: int = 12) -> DataFrame:
    """Important items that a document lacks, the first n in catalogue order. A document has at most
    one row per catalogue item."""
    bad = results.where("status = 'not_found' and risk_if_missing in ('high', 'critical')")
    return bad.groupBy("site_id", "doc_pos").agg(F.slice(F.transform(
        F.array_sort(F.collect_list(F.struct("item_pos", F.concat("label", F.lit(" ("), "risk_if_missing", F.lit(")")).alias("t")))),
        lambda x: x["t"]), 1, n).alias("critical_missing"))


def documents_table(docs: DataFrame, analysis: DataFrame, results: DataFrame, conflicts: DataFrame) -> DataFrame:
    told = conflicts.groupBy("site_id", "doc_pos").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(": ", "type", "comment").alias("t")))), lambda x: x["t"]).alias("conflicts"))
    key = ["site_id", "doc_pos"]
    return docs.select(*key, "doc_type", "url", "title", "format", "is_accessible", "placeholder", "extraction_error").join(
        analysis.select(*key, "overall_completeness", "summary"), key, "left").join(
        critical_missing(results), key, "left").join(told, key, "left")


def services_table(hits: DataFrame, cookies: DataFrame) -> DataFrame:
    a = hits.select("site_id", F.lit("tracker").alias("kind"), F.col("provider_name").alias("name"), "category", "country_hint",
                    "legal_risk", F.col("matched_domain").alias("domain"), F.lit(None).cast("boolean").alias("is_tracking"))
    b = cookies.select("site_id", F.lit("cookie").alias("kind"), "name", "category", F.lit("").alias("country_hint"),
                       F.lit("").alias("legal_risk"), "domain", "is_tracking")
    return a.unionByName(b)


def open_items(results: DataFrame, n: int = 3) -> DataFrame:
    """Unconfirmed items of a document: missing ones first, then unclear ones."""
    todo = results.where("status in ('not_found', 'unclear') and label <> ''")
    first = F.struct((F.col("status") != "not_found").alias("s"), "item_pos", "label")
    return todo.groupBy("site_id", "doc_pos").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["label"]), 1, n).alias("open_items"))


def unique_documents(docs: DataFrame, analysis: DataFrame, results: DataFrame) -> DataFrame:
    """Published documents, one per type and URL, in order of discovery."""
    real = docs.where("is_accessible or link_confirmed").groupBy("site_id", "doc_type", "url").agg(
        F.min(F.struct("doc_pos", "title", "format", "placeholder", "is_accessible", "link_confirmed")).alias("m")).select(
        "site_id", "m.doc_pos", "doc_type", X.label("doc_type", F.col("doc_type")).alias("type_label"), "url", "m.title",
        "m.format", "m.placeholder", (F.col("m.link_confirmed") & ~F.col("m.is_accessible")).alias("manual_only"))
    key = ["site_id", "doc_pos"]
    return real.join(analysis.select(*key, "overall_completeness"), key, "left").join(open_items(results), key, "left")


def tiles(scored: DataFrame, core: DataFrame) -> DataFrame:
    zones = core.groupBy("site_id").agg(F.count_if(F.col("status") == "risk").alias("risk_zones"))
    return scored.join(zones, "site_id", "left").select(
        "site_id", F.coalesce("risk_zones", F.lit(0)).alias("risk_zones"), "pages_checked", F.col("n_docs_found").alias("docs_found"),
        F.col("n_foreign").alias("foreign_services"))


def recommendations(risks: DataFrame) -> DataFrame:
    """Fired rules by urgency, in rank order; at most one entry per catalogue rule."""
    bucket = F.when(F.col("risk_level").isin("critical", "high"), "urgent").when(F.col("risk_level") == "medium", "soon") \
        .otherwise("optional")
    return risks.groupBy("site_id", bucket.alias("urgency")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "rule_id"))), lambda x: x["rule_id"]).alias("rule_ids"))


def risk_cards(risks: DataFrame, n: int = 3) -> DataFrame:
    phrase = F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in ("report_phrase", "explanation")], F.lit(""))
    return R.top_risks(risks, n).select("site_id", "rank", "title", phrase.alias("phrase"), F.col("risk_level").alias("level"),
                                        X.label("level", F.col("risk_level")).alias("level_label"))


def executive_summary(scored: DataFrame, risks: DataFrame) -> DataFrame:
    """Short text per site from its facts, with neutral wording."""
    why = F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in ("explanation", "report_phrase")], "title")
    line = F.concat(F.lit("• "), "title", F.lit(" (уровень: "), X.label("level", F.col("risk_level")), F.lit(")"),
                    F.when(why != F.col("title"), F.concat(F.lit(" — "), why)).otherwise(""))
    lines = R.top_risks(risks).withColumn("line", line).groupBy("site_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    name = F.when(F.col("company_name") != "", F.col("company_name")).otherwise("Клиент")

    def num(x):
        return F.col(x).cast("string")

    text = F.concat_ws(
        "\n", F.concat(F.lit("Автоматическая проверка сайта "), "site_url", F.lit(" («"), name, F.lit("»).")),
        F.concat(F.lit("Страниц: "), num("pages_checked"), F.lit("; форм: "), num("n_forms"), F.lit("; документов: "),
                 num("n_docs_accessible"), F.lit(".")),
        F.concat(F.lit("Сторонние сервисы "), F.when(F.col("n_trackers") > 0, "есть").otherwise("не замечены"), F.lit("; документы "),
                 F.when(F.col("n_docs_accessible") > 0, "найдены").otherwise("не найдены"), F.lit(".")),
        F.concat(F.lit("Оценка: "), X.label("level", F.col("risk_level")), F.lit(" (баллы "), num("risk_score"), F.lit(", достоверность "),
                 num("confidence"), F.lit("%).")),
        F.coalesce("lines", F.lit("• Признаков риска не выделено.")), F.lit("Вывод предварительный, решает юрист."))
    return scored.join(lines, "site_id", "left").select("site_id", X.sanitize_tone(text).alias("executive_summary"))


def text_facts(scored: DataFrame, docs: DataFrame, hits: DataFrame, risks: DataFrame, n: int = 5) -> DataFrame:
    """Facts for client texts as one struct per site."""
    found = docs.where("is_accessible").groupBy("site_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("doc_pos", X.label("doc_type", F.col("doc_type")).alias("t")))), lambda x: x["t"]).alias("documents_found"))
    why = F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in ("explanation", "report_phrase")], "title")
    top = R.top_risks(risks, n).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "title", X.label("level", F.col("risk_level")).alias("level"), why.alias("explanation")))).alias("top_risks"))
    df = scored.join(found, "site_id", "left").join(top, "site_id", "left")
    return df.select("site_id", F.struct(
        "company_name", "site_url", F.col("site_final_url").alias("final_url"), "industry",
        X.label("level", F.col("risk_level")).alias("risk_level"), "risk_score", "confidence", "pages_checked",
        F.col("n_forms").alias("forms_count"), F.coalesce("documents_found", F.array().cast("array<string>")).alias("documents_found"),
        F.col("tracker_names").alias("trackers"), F.col("foreign_trackers_present").alias("foreign_trackers"), "cookie_banner_found",
        F.col("pd_categories").alias("personal_data_categories"), "top_risks").alias("facts"))
