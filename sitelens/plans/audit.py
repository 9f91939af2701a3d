"""The whole audit: leads and stored pages in, risk mart out.

One narrow pass reads the markup (``page_facts``) and writes small facts; the pages that a
site's budget selects are written once more with their order (``audit``). Everything else
reads these two tables with only the columns it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.limits import NONE, Limits
from sitelens.operators import checklist as C
from sitelens.operators import context as A
from sitelens.operators import core_checks as E
from sitelens.operators import discovery as D
from sitelens.operators import documents as W
from sitelens.operators import findings as P
from sitelens.operators import rules as R
from sitelens.operators import trackers as T
from sitelens.operators.domains import bundled_suffixes, with_site_domain
from sitelens.operators.page_facts import page_facts
from sitelens.sources.crawl import parse_robots, parse_sitemaps, sitemap_urls
from sitelens.sources.staging import sql_conf, staged, work_dir


@dataclass
class Catalogues:
    rules: str | None = None
    trackers: str | None = None
    checklists: str | None = None
    findings: str | None = None


@dataclass
class AuditTables:
    facts: DataFrame
    homes: DataFrame
    plan: DataFrame
    audit: DataFrame
    forms: DataFrame
    trackers: DataFrame
    cookies: DataFrame
    candidates: DataFrame
    documents: DataFrame
    checklist: DataFrame
    conflicts: DataFrame
    analysis: DataFrame
    context: DataFrame
    risks: DataFrame
    scored: DataFrame
    core: DataFrame
    findings: DataFrame


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def stage_facts(pages: DataFrame, folder: str, trackers=None, limits: Limits = NONE) -> DataFrame:
    """Page facts as a written table with a stable row id. Pages may be megabytes long, so Arrow
    batches hold few of them."""
    with sql_conf(pages.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "256"):
        return staged(page_facts(pages, trackers, limits).withColumn("uid", F.monotonically_increasing_id()), folder, "facts")


def audit(
    leads: DataFrame,
    pages: DataFrame | None,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    bodies: DataFrame | None = None,
    site_ips: DataFrame | None = None,
    ip_ranges: DataFrame | None = None,
    suggestions: DataFrame | None = None,
    verdict_answers: DataFrame | None = None,
    catalogues: Catalogues = Catalogues(),
    folder: str | None = None,
    facts: DataFrame | None = None,
    limits: Limits = NONE,
    suffixes: DataFrame | None = None,
) -> AuditTables:
    """Audit all leads. ``leads`` come from ``normalize_leads``; ``pages`` are raw crawl rows, or pass
    already staged ``facts``. Optional inputs: robots.txt and sitemap bodies (base_url, status_code,
    body / url, body), document bodies (from ``body_texts``), addresses with a country range table,
    suggested documents and outside verdicts (site_id, doc_url, answer). Nothing is capped but by a
    lead's own page budget, unless ``limits`` says so. ``suffixes``: a rule table
    (``operators.domains.read_suffixes``), by default the list that Spark brings along."""
    spark = leads.sparkSession
    folder = folder or work_dir(spark)
    facts = facts if facts is not None else stage_facts(pages, folder, catalogues.trackers, limits)
    suffixes = staged(bundled_suffixes(spark) if suffixes is None else suffixes, folder, "suffixes")
    homes = staged(with_site_domain(D.homepages(leads, facts), suffixes), folder, "homes")
    winners = staged(D.url_winners(facts), folder, "urls")

    robots = _empty(spark, "base_url string, status_code int, body string") if robots is None else robots
    robots = parse_robots(homes.select("site_id", "base_url").join(robots, "base_url"))
    maps = parse_sitemaps(_empty(spark, "url string, body string") if sitemaps is None else sitemaps)
    sitemap = staged(sitemap_urls(homes.where("reachable"), robots, maps, limits), folder, "sitemap")

    plan = D.plan_pages(D.homepage_links(homes, facts), sitemap, homes, limits=limits)
    pages_of_sites = staged(D.audit_set(homes, plan, facts, winners), folder, "audit")

    cands = staged(D.dedupe_candidates(D.doc_candidates(pages_of_sites, sitemap, homes), limits.candidates), folder, "candidates")
    docs = W.relevant_documents(W.dedupe_documents(W.resolve_documents(cands, pages_of_sites, facts, homes, bodies, winners)), homes)
    docs = staged(docs, folder, "documents")
    if suggestions is not None:
        extra = W.ground_suggestions(W.read_suggestions(suggestions, limits.read_suggestions), docs, homes, pages_of_sites, facts, bodies, winners, limits.suggestions)
        known = docs.withColumn("cand_pos", F.col("doc_pos")).drop("doc_pos")
        docs = staged(W.dedupe_documents(known.unionByName(extra)), folder, "documents_all")

    forms = A.site_forms(pages_of_sites)
    hits, cookies = T.site_trackers(pages_of_sites), T.site_cookies(pages_of_sites)
    countries = A.server_country(
        _empty(spark, "site_id string, ip_pos int, ip string") if site_ips is None else site_ips,
        _empty(spark, "range_start bigint, range_end bigint, country string") if ip_ranges is None else ip_ranges)
    tech = A.technical(homes, pages_of_sites, robots, sitemap, countries)
    ctx = A.site_context(homes, forms, hits, cookies, T.before_consent(pages_of_sites, cookies), docs, pages_of_sites, tech)
    ctx = staged(ctx, folder, "context")

    doc_facts = C.with_facts(docs, ctx)
    results = C.run_checklist(doc_facts, catalogues.checklists)
    conflicts = C.detect_conflicts(doc_facts, suffixes)
    verdict_docs = None
    if verdict_answers is not None:
        answers = verdict_answers.join(
            docs.select("site_id", F.col("url").alias("doc_url"), "url", "doc_type", "doc_pos"), ["site_id", "doc_url"])
        items, claimed = C.read_verdicts(answers)
        results = C.merge_verdicts(results, items, docs)
        conflicts = C.merge_conflicts(conflicts, claimed)
        verdict_docs = answers
        ctx = ctx.join(answers.select("site_id").distinct().withColumn("has_verdicts", F.lit(True)), "site_id", "left") \
            .withColumn("has_verdicts", F.coalesce("has_verdicts", F.lit(False)))
    results, conflicts = staged(results, folder, "checklist"), staged(conflicts, folder, "conflicts")
    analysis = C.doc_analysis(docs, results, conflicts, verdict_docs)

    ctx = staged(R.rule_context(ctx, C.status_map(results), conflicts), folder, "rule_context")
    risks = staged(R.apply_rules(ctx, catalogues.rules), folder, "risks")
    scored = R.score_sites(ctx, risks)
    core = staged(E.core_checks(ctx, risks), folder, "core")
    found = P.findings(ctx, risks, core, catalogues.findings)
    return AuditTables(facts, homes, plan, pages_of_sites, forms, hits, cookies, cands, docs, results, conflicts, analysis,
                       ctx, risks, scored, core, found)
