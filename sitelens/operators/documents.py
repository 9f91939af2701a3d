"""Legal documents of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import elements as P
from sitelens.functions import text as X
from sitelens.functions import urls as U
from sitelens.operators.discovery import url_winners
from sitelens.operators.domains import on_site, with_site_domain
from sitelens.operators.reduce import maybe_in
from sitelens.sources.staging import staged, work_dir

SUGGESTED_TYPES = tuple(X.LABELS["doc_type"])
BODIES_DDL = ("url string, final_url string, status_code int, ok boolean, content_type string, format string, "
              "text string, error string")


def resolve_documents(cands: DataFrame, audit: DataFrame, facts: DataFrame, sites: DataFrame, bodies: DataFrame | None = None,
                      winners: DataFrame | None = None) -> DataFrame:
    """Documents from candidates: an audited page under the same URL (its own or its final one),
    else a stored page, else a stored body. The texts of wanted pages alone are shuffled."""
    own = audit.where("stored").select("site_id", "page_pos", "uid", F.explode(F.array(
        F.struct(F.lit(0).alias("prio"), U.strip_fragment(F.col("url")).alias("key")),
        F.struct(F.lit(1).alias("prio"), U.strip_fragment(F.col("page_url")).alias("key")))).alias("k"))
    own = own.groupBy("site_id", "k.key").agg(F.min_by("uid", F.struct("k.prio", "page_pos")).alias("own_uid"))
    stored = (url_winners(facts) if winners is None else winners).withColumnRenamed("uid", "any_uid")
    page = facts.select(
        "uid", F.col("status_code").alias("p_status"), F.col("ok").alias("p_ok"), "has_html",
        F.coalesce("final_url", "url").alias("p_final"), F.col("title").alias("p_title"), "doc_text", "html_head")
    wanted = (cands.join(own, ["site_id", "key"], "left").join(stored, "key", "left")
              .withColumn("uid", F.coalesce("own_uid", "any_uid")).drop("own_uid", "any_uid")
              .join(with_site_domain(sites).select("site_id", "domain", "below"), "site_id", "left"))
    wanted = staged(wanted, work_dir(cands.sparkSession), "wanted")
    df = wanted.join(maybe_in(page, "uid", wanted.select("uid")), "uid", "left")
    if bodies is None:
        bodies = cands.sparkSession.createDataFrame([], BODIES_DDL)
    b = bodies.select(U.strip_fragment(F.col("url")).alias("key"), F.struct(
        "final_url", "status_code", "ok", "format", "text", "error").alias("b")).groupBy("key").agg(F.min("b").alias("b"))
    df = df.join(b, "key", "left")
    # a stored page without markup gives way to a stored body of the same URL
    is_page = F.col("p_status").isNotNull() & (F.coalesce("has_html", F.lit(False)) | F.col("b").isNull())
    text = F.when(is_page, F.col("doc_text")).otherwise(F.coalesce("b.text", F.lit("")))
    status = F.when(is_page, F.col("p_status")).otherwise(F.coalesce("b.status_code", "p_status", F.lit(0)))
    ok = F.when(is_page, F.col("p_ok")).otherwise(F.coalesce("b.ok", F.lit(False)))
    final = F.when(is_page, F.col("p_final")).otherwise(F.coalesce("b.final_url", F.lit("")))
    opened = is_page | F.col("b").isNotNull()
    return df.withColumns({"text": F.coalesce(text, F.lit("")), "status": status, "opened_ok": ok, "final": final}).select(
        "site_id", "cand_pos", "doc_type", "url", "key",
        F.when(F.col("title") != "", F.col("title")).otherwise(F.coalesce("p_title", F.lit(""))).alias("title"),
        F.when(is_page, "html").otherwise(F.coalesce("b.format", X.detect_format(F.col("url"), F.lit("")))).alias("format"),
        F.col("status").alias("status_code"),
        (F.col("opened_ok") & (F.length("text") > 0)).alias("is_accessible"),
        P.link_confirmed(F.col("url"), F.col("final"), F.col("status"), F.col("opened_ok"),
                         F.coalesce(on_site(F.col("final"), F.col("domain"), F.col("below")), F.lit(False))).alias("link_confirmed"),
        F.when(F.col("source") == "priority_path", "guess").otherwise(F.col("source")).alias("discovered_by"),
        "text", F.length("text").alias("text_length"), X.detect_date(F.col("text")).alias("date_detected"),
        X.detect_version(F.col("text")).alias("version_detected"),
        F.col("text").rlike(X.RE_PLACEHOLDER).alias("placeholder"),
        (opened & (F.length("text") == 0)).alias("text_extraction_failed"),
        F.when(F.length("text") > 0, "").when(~opened, "unreachable")
        .otherwise(F.coalesce(F.when(F.col("b.error") != "", F.col("b.error")), F.lit("text_extraction_failed")))
        .alias("extraction_error"),
        (F.length("text") == 0).alias("requires_manual_review"),
        X.evidence(F.when(F.col("final") != "", F.col("final")).otherwise(F.col("url")), F.col("text"),
                   F.when(is_page, F.col("html_head"))).alias("evidence"),
    ).withColumn("present", P.document_is_present(
        F.col("discovered_by"), F.col("doc_type"), F.col("is_accessible"), F.col("link_confirmed"), F.col("text"),
        F.col("title")))


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """Best document per URL; all readable ones, then at most one unreadable per type that has no
    readable document. A site has at most 40 candidates and 10 suggestions, so the windows are small."""
    at_url = Window.partitionBy("site_id", "key")
    best = docs.withColumns({
        "at": F.min("cand_pos").over(at_url),
        "k": F.row_number().over(at_url.orderBy(F.desc("is_accessible"), F.desc("text_length"), "cand_pos")),
    }).where("k = 1").drop("k")
    readable = F.col("is_accessible") & (F.col("text_length") > 0)
    of_type = Window.partitionBy("site_id", "doc_type")
    picked = best.withColumn("readable", readable).withColumns({
        "type_readable": F.max("readable").over(of_type),
        "type_at": F.min("at").over(of_type),
        "k": F.row_number().over(of_type.orderBy(
            F.desc("readable"), F.desc("link_confirmed"), F.desc(F.col("status_code") == 200), "at")),
    }).where("readable or (not type_readable and k = 1)")
    order = Window.partitionBy("site_id").orderBy(
        F.desc("readable"), F.when(F.col("readable"), F.col("at")).otherwise(F.col("type_at")))
    return picked.withColumn("doc_pos", F.row_number().over(order)).drop(
        "at", "k", "readable", "type_readable", "type_at")


def relevant_documents(docs: DataFrame, sites: DataFrame) -> DataFrame:
    """Documents on the registered domain of their site only."""
    return docs.join(with_site_domain(sites).select("site_id", "domain", "below"), "site_id").where(
        on_site(F.col("url"), F.col("domain"), F.col("below"))).drop("domain", "below")


def read_suggestions(answers: DataFrame, limit: int | None = None) -> DataFrame:
    """(site_id, answer) of an outside reviewer, answers in loose JSON, to suggested documents."""
    one = "struct<url: string, doc_type: string, reason: string>"
    parsed = F.from_json(X.lenient_json(F.col("answer")),
                         f"struct<missed_documents: array<{one}>, items: array<{one}>, notes: string>")
    listed = F.coalesce(F.col("a.missed_documents"), F.col("a.items"))
    return answers.withColumn("a", parsed).select(
        "site_id", F.posexplode(listed if limit is None else F.slice(listed, 1, limit)).alias("pos", "s")).select(
        "site_id", "pos", X.strip(F.coalesce("s.url", F.lit(""))).alias("url"),
        F.when(F.col("s.doc_type").isin(*SUGGESTED_TYPES), F.col("s.doc_type")).otherwise("other").alias("doc_type"),
        X.truncate(F.col("s.reason"), 200).alias("reason"))


def ground_suggestions(sugg: DataFrame, docs: DataFrame, sites: DataFrame, audit: DataFrame, facts: DataFrame,
                       bodies: DataFrame | None = None, winners: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Suggested documents that are on the site, not known yet, and read like their type."""
    known = docs.select("site_id", U.url_key(F.col("url")).alias("ukey")).distinct()
    new = (sugg.join(with_site_domain(sites).select("site_id", "domain", "below"), "site_id")
           .where(F.col("url").rlike("(?i)^https?://") & on_site(F.col("url"), F.col("domain"), F.col("below")))
           .withColumn("ukey", U.url_key(F.col("url"))).where("ukey <> ''")
           .join(known, ["site_id", "ukey"], "left_anti"))
    once = new.groupBy("site_id", "ukey").agg(F.min(F.struct("pos", "url", "doc_type", "reason")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("s.pos"))
    ranked = once.withColumn("k", rank)
    # suggestions stand behind all candidates
    cands = (ranked if limit is None else ranked.where(F.col("k") <= limit)).select(
        "site_id", (F.col("k") + (1 << 30)).cast("int").alias("cand_pos"), U.strip_fragment(F.col("s.url")).alias("key"), "s.url",
        "s.doc_type", F.col("s.reason").alias("anchor_text"), F.lit("").alias("title"), F.lit("agent").alias("source"),
        F.lit("").alias("page_url"))
    return resolve_documents(cands, audit, facts, sites, bodies, winners).where("present")
