"""Third-party services, cookies, CDN and mixed content of a page.

The catalogues are small constants and every test is "text contains a literal", so the
theta joins of page URLs against catalogue entries are evaluated inside the page row: the
URLs of one kind are joined with newlines (no catalogue entry contains one) and each entry
is looked up in that text. No row is multiplied and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import catalogue
from sitelens.functions import elements as P
from sitelens.functions import text as X
from sitelens.functions import urls as U


# Host fragments of content delivery networks, in order of preference.
CDN_MARKERS = [
    ("cloudflare", "Cloudflare"), ("cdnjs.cloudflare", "Cloudflare"), ("cloudflareinsights", "Cloudflare"),
    ("akamai", "Akamai"), ("akamaihd", "Akamai"), ("akamaized", "Akamai"), ("fastly", "Fastly"),
    ("fastlylb", "Fastly"), ("gcore", "Gcore"), ("gcdn", "Gcore"), ("selectel", "Selectel"),
    ("selcdn", "Selectel"), ("cloudfront", "Amazon CloudFront"), ("stackpath", "StackPath"),
    ("jsdelivr", "jsDelivr"), ("bunnycdn", "BunnyCDN"), ("b-cdn.net", "BunnyCDN"), ("cdn77", "CDN77"),
    ("ngenix", "NGENIX"), ("edgecast", "EdgeCast"), ("azureedge", "Azure CDN"),
]
HIT = ("struct<provider_pos: int, provider_name: string, category: string, country_hint: string, "
       "legal_risk: string, matched_domain: string, matched_on: string>")
COOKIE = "struct<name: string, domain: string, value_preview: string, category: string, provider: string, is_tracking: boolean>"


def _first(arr):
    return F.try_element_at(arr, F.lit(1))


def _lines(urls: Column) -> Column:
    return F.lower(F.array_join(urls, "\n"))


def tracker_hits(scripts: Column, iframes: Column, requests: Column, low_html: Column, path=None) -> Column:
    """array<hit>: per service the first domain found in scripts, iframes, requests (in this order),
    else an inline pattern in the markup."""
    rows = [dict(t, domains=[d.lower() for d in t["domains"]], patterns=[p.lower() for p in t["patterns"]],
                 shown=t["domains"]) for t in catalogue.trackers(path)]
    services = catalogue.literal(rows, catalogue.TRACKERS_DDL + ", shown array<string>")

    kinds = ("script", "iframe", "network")
    texts = F.struct(*[_lines(u).alias(k) for k, u in zip(kinds, (scripts, iframes, requests))], low_html.alias("html"))

    def find(t, p):
        def in_source(kind):
            at = F.filter(F.transform(p["domains"], lambda d, i: F.when(t[kind].contains(d), i)), lambda i: i.isNotNull())
            return F.struct(F.lit(kind).alias("kind"), _first(at).alias("at"))

        return F.struct(
            p.alias("p"), _first(F.filter(F.array(*map(in_source, kinds)), lambda s: s["at"].isNotNull())).alias("url"),
            F.exists(p["patterns"], lambda x: t["html"].contains(x)).alias("inline"))

    found = F.filter(X.let(texts, lambda t: F.transform(services, lambda p: find(t, p))), lambda h: h["url"].isNotNull() | h["inline"])
    return F.transform(found, lambda h: F.struct(
        h["p"]["provider_pos"], h["p"]["provider_name"], h["p"]["category"], h["p"]["country_hint"],
        h["p"]["legal_risk"],
        F.when(h["url"].isNotNull(), F.get(h["p"]["shown"], h["url"]["at"])).otherwise(""),
        F.when(h["url"].isNotNull(), h["url"]["kind"]).otherwise("html")).cast(HIT))


def risk_requests(requests: Column, path=None) -> Column:
    """Per request URL the first service whose use before consent is a risk; distinct, in order."""
    pairs = [{"domain": d.lower(), "provider": t["provider_name"]}
             for t in catalogue.trackers(path) if t["category"] in ("analytics", "marketing") or t["cookie_check"]
             for d in t["domains"]]
    known = catalogue.literal(pairs, "domain string, provider string")
    hits = F.transform(
        F.transform(requests, F.lower),
        lambda u: _first(F.filter(known, lambda k: u.contains(k["domain"])))["provider"])
    return F.array_distinct(F.filter(hits, lambda p: p.isNotNull()))


def cdn(pages_urls: Column) -> Column:
    """First delivery network met in the URL list of a page, NULL when there is none."""
    marks = catalogue.literal([{"marker": m, "name": n} for m, n in CDN_MARKERS], "marker string, name string")
    hits = F.transform(F.transform(pages_urls, F.lower),
                       lambda u: _first(F.filter(marks, lambda m: u.contains(m["marker"])))["name"])
    return _first(F.filter(hits, lambda n: n.isNotNull()))


def cdn_from_headers(headers: Column) -> Column:
    """The same from a map of response headers (server, via, x-cache, cf-ray)."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.lower(e["value"]).alias("value")))
    # of names that differ only in case the last one counts
    names = F.transform(pairs, lambda e: e["key"])
    low = F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(F.slice(names, i + 2, F.size(names)), e["key"]) == 0))

    def get(k):
        return F.coalesce(F.try_element_at(low, F.lit(k)), F.lit(""))

    blob = F.concat_ws(" ", get("server"), get("via"), get("x-cache"))
    return F.when(F.map_contains_key(low, "cf-ray"), "Cloudflare").otherwise(cdn(F.array(blob)))


def classify_cookies(cookies: Column, path=None) -> Column:
    """array<cookie> with the longest known name contained in each name; the first on ties."""
    known = catalogue.literal(
        [dict(c, low=c["name"].lower()) for c in catalogue.cookie_names(path)], catalogue.COOKIES_DDL + ", low string")

    def one(c):
        name = F.lower(c["name"])
        best = F.array_max(F.transform(
            F.filter(known, lambda k: name.contains(k["low"])),
            lambda k: F.struct(F.length(k["low"]).alias("n"), (-k["name_pos"]).alias("p"),
                               k["provider"].alias("provider"), k["category"].alias("category"))))
        category = F.coalesce(best["category"], F.lit("unknown"))
        return F.struct(
            F.coalesce(c["name"], F.lit("")), F.coalesce(c["domain"], F.lit("")), X.truncate(c["value"], 60), category,
            F.coalesce(best["provider"], F.lit("")), category.isin("analytics", "marketing")).cast(COOKIE)

    return F.transform(cookies, one)


def parse_set_cookie(headers: Column, url: Column) -> Column:
    """array<struct(name, value, domain)> from a stored Set-Cookie column, one cookie per line."""
    def one(line):
        first = X.strip(F.split_part(line, F.lit(";"), F.lit(1)))
        attrs = F.filter(F.transform(F.split(line, ";"), X.strip), lambda s: F.lower(s).startswith("domain="))
        domain = F.regexp_replace(X.strip(F.substr(F.element_at(attrs, -1), F.lit(8))), r"^\.+", "")
        return F.struct(
            X.strip(F.split_part(first, F.lit("="), F.lit(1))).alias("name"),
            X.strip(F.substr(first, F.instr(first, "=") + 1)).alias("value"),
            F.when(F.size(attrs) > 0, domain).otherwise(U.get_host(url)).alias("domain"), first.contains("=").alias("ok"))

    parsed = F.filter(F.transform(F.split(F.coalesce(headers, F.lit("")), "\n"), one),
                      lambda c: c["ok"] & (c["name"] != ""))
    return F.transform(parsed, lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value"),
                                                  c["domain"].alias("domain")))


def insecure_resources(url: Column, resources: Column, requests: Column) -> Column:
    """Resources an HTTPS page loads over plain HTTP, distinct, in order."""
    all_ = F.transform(F.concat(resources, requests), X.strip)
    bad = F.array_distinct(F.filter(all_, lambda r: F.lower(r).startswith("http://")))
    return F.when(P.is_https(url), bad).otherwise(F.array().cast("array<string>"))


# ---- per site ------------------------------------------------------------------------
def mixed_content(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct insecure URLs per site in page order; with ``cap`` the first ones."""
    each = pages.select("site_id", "page_pos", F.posexplode("insecure").alias("pos", "url"))
    first = each.groupBy("site_id", "url").agg(F.min(F.struct("page_pos", "pos")).alias("at"))
    return _take_first(first, "url", cap).withColumnRenamed("items", "mixed_content_urls")


def _take_first(df: DataFrame, value: str, cap: int | None) -> DataFrame:
    """Ordered list per site; with ``cap`` a rank limit is applied before the shuffle."""
    from pyspark.sql import Window

    if cap is not None:
        df = df.withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy("at"))).where(F.col("rank") <= cap)
    return df.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("items"))


def site_cdn(pages: DataFrame) -> DataFrame:
    return pages.where("cdn is not null").groupBy("site_id").agg(F.min_by("cdn", "page_pos").alias("cdn_detected"))


def site_trackers(pages: DataFrame) -> DataFrame:
    """One row per (service, domain) of a site: the earliest hit."""
    hits = pages.select("site_id", "page_pos", "page_url", F.posexplode("trackers").alias("pos", "h"))
    return (
        hits.groupBy("site_id", F.col("h.provider_name"), F.col("h.matched_domain"))
        .agg(F.min(F.struct("page_pos", "pos", "h", "page_url")).alias("m"))
        .select("site_id", "m.page_pos", "m.pos", "provider_name", "m.h.category", "m.h.country_hint", "m.h.legal_risk",
                "matched_domain", "m.h.matched_on", "m.page_url")
    )


def site_cookies(pages: DataFrame) -> DataFrame:
    """One row per (name, domain) of a site: the earliest."""
    each = pages.select("site_id", "page_pos", "page_url", F.posexplode("cookies").alias("pos", "c"))
    return (
        each.groupBy("site_id", F.col("c.name"), F.col("c.domain"))
        .agg(F.min(F.struct("page_pos", "pos", "c", "page_url")).alias("m"))
        .select("site_id", "m.page_pos", "m.pos", "name", "domain", "m.c.value_preview", "m.c.category", "m.c.provider",
                "m.c.is_tracking", "m.page_url")
    )


def before_consent(pages: DataFrame, cookies: DataFrame) -> DataFrame:
    """Tracking cookies and requests seen before any consent: items in order and the evidence text."""
    label = F.when(F.col("name") == "", "(cookie)").otherwise(F.col("name"))
    of_cookies = cookies.where("is_tracking").select(
        "site_id", F.lit(0).alias("kind"), "page_pos", "pos",
        F.concat(F.lit("cookie: "), label,
                 F.when(F.col("provider") != "", F.concat(F.lit(" ("), "provider", F.lit(")"))).otherwise("")).alias("item"))
    of_requests = pages.select("site_id", F.lit(1).alias("kind"), "page_pos",
                               F.posexplode("risk_requests").alias("pos", "p")).select(
        "site_id", "kind", "page_pos", "pos", F.concat(F.lit("запрос: "), "p").alias("item"))
    first = of_cookies.unionByName(of_requests).groupBy("site_id", "item").agg(
        F.min(F.struct("kind", "page_pos", "pos")).alias("at"))
    items = first.groupBy("site_id").agg(
        F.expr("transform(array_sort(collect_list(struct(at, item))), x -> x.item)").alias("before_consent_items"))
    text = F.concat(F.lit("До согласия уже замечено: "), F.array_join(F.slice("before_consent_items", 1, 8), "; "))
    return items.withColumn("before_consent_evidence", X.truncate(text, 480))
