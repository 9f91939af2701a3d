"""One narrow pass from stored pages to page facts: a single Python stage, no shuffle.

Input columns: url and html are required; final_url, title, status_code, ok, visible_text,
links, script_srcs, iframe_srcs, external_resources, network_requests, cookies, set_cookie,
modal_htmls, content_type, fetch_method, errors are used when the crawl has them (a browser
crawl stores the link lists itself) and derived from the markup otherwise. The markup does
not leave this pass, so later stages read only small columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import elements as P
from sitelens.functions import text as X
from sitelens.functions import urls as U
from sitelens.limits import NONE, Limits
from sitelens.operators import forms, trackers
from sitelens.operators.html_parse import parse_udfs

STRINGS = ("final_url", "title", "visible_text", "content_type", "set_cookie")
ARRAYS = ("links", "script_srcs", "iframe_srcs", "external_resources", "network_requests", "modal_htmls", "errors")


def complete(pages: DataFrame) -> DataFrame:
    """Add the optional crawl columns that are missing."""
    have = set(pages.columns)
    add = {c: F.lit(None).cast("string") for c in STRINGS}
    add.update({c: F.lit(None).cast("array<string>") for c in ARRAYS})
    add["cookies"] = F.lit(None).cast("array<struct<name: string, value: string, domain: string>>")
    add["status_code"] = F.when(F.coalesce("html", F.lit("")) != "", 200).otherwise(0)
    add["ok"] = F.col("status_code").between(200, 399) if "status_code" in have else F.coalesce("html", F.lit("")) != ""
    add["fetch_method"] = F.lit("http")
    add["headers"] = F.lit(None).cast("map<string,string>")
    add["has_screenshot"] = F.lit(False)
    return pages.withColumns({k: v for k, v in add.items() if k not in have})


def page_facts(pages: DataFrame, trackers_path=None, limits: Limits = NONE) -> DataFrame:
    parse, parse_modals = parse_udfs()
    with_modals = "modal_htmls" in pages.columns
    raw = complete(pages)
    blank = F.array().cast("array<string>")
    raw = raw.withColumns({
        "html": F.coalesce("html", F.lit("")),
        "page_url": F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), "url"),
    }).withColumn("p", parse("html", "page_url"))

    derived = {c: F.coalesce(F.col(c), F.col(f"p.{c}"), blank)
               for c in ("script_srcs", "iframe_srcs", "external_resources")}
    anchors = F.col("p.anchors")
    links = F.array_distinct(F.transform(F.filter(anchors, lambda a: a["has_href"] & (a["url"] != "")), lambda a: a["url"]))
    df = raw.withColumns({
        **derived,
        "title": F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("p.title")),
        "text": F.coalesce("visible_text", "p.text"),
        "doc_text": F.coalesce("p.doc_text", "p.text"),
        "links": F.coalesce("links", links),
        "low": F.lower("html"),
        "errors": F.coalesce("errors", blank),
    })
    requests = F.coalesce("network_requests", F.array_distinct(F.concat("script_srcs", "iframe_srcs", "external_resources")))
    found = F.concat(forms.page_forms(F.col("p.nodes"), F.col("p.text"), "html", limits.containers),
                     forms.widget_forms(F.col("html"), F.col("low")))
    if with_modals:
        df = df.withColumn("m", parse_modals(F.coalesce("modal_htmls", blank)))
        bodies = F.filter(F.coalesce("modal_htmls", blank), lambda h: h != "")
        found = F.concat(
            found,
            F.flatten(F.transform(F.col("m"), lambda m: forms.page_forms(m["nodes"], m["text"], "modal", limits.containers))),
            F.flatten(F.transform(bodies, lambda h: forms.widget_forms(h, F.lower(h)))),
        )
    cookies = F.coalesce("cookies", trackers.parse_set_cookie(F.col("set_cookie"), F.col("page_url")))
    df = df.withColumn("network_requests", requests)
    s, i, r, n = (F.col(c) for c in ("script_srcs", "iframe_srcs", "external_resources", "network_requests"))
    return df.withColumn("banner", P.cookie_banner(F.col("html"), F.col("text"))).select(
        *[c for c in pages.columns if c in ("page_id", "site_id", "page_pos")],
        "url", "final_url", "page_url", "status_code", "ok", (F.col("html") != "").alias("has_html"), "title",
        F.length("html").alias("html_length"), F.length("text").alias("text_length"), "doc_text", "content_type",
        "fetch_method", "errors", anchors.alias("anchors"), "links", s, i, r, n,
        found.alias("forms"),
        trackers.tracker_hits(s, i, n, F.col("low"), trackers_path).alias("trackers"),
        trackers.classify_cookies(cookies, trackers_path).alias("cookies"),
        trackers.risk_requests(n, trackers_path).alias("risk_requests"),
        F.coalesce(trackers.cdn_from_headers(F.col("headers")), trackers.cdn(F.concat(r, n, s, i))).alias("cdn"),
        F.coalesce("has_screenshot", F.lit(False)).alias("has_screenshot"),
        trackers.insecure_resources(F.col("page_url"), r, n).alias("insecure"),
        F.col("banner.found").alias("banner_found"), F.col("banner.evidence").alias("banner_evidence"),
        F.substring("html", 1, 800).alias("html_head"),
    )
