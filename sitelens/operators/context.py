"""Wide site context, one row per site (A01-A03, A16-A20), built from per-child rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import elements as P
from sitelens.functions import text as X
from sitelens.functions import urls as U
from sitelens.operators import trackers as T
from sitelens.operators.domains import with_site_domain
from sitelens.sources.staging import staged, work_dir

# ---- fixed values -----------------------------------------------------------------
MEDICAL_TITLES = ("диагноз", "симптом", "запись к врачу", "клиник", "прием врача")
PEOPLE_TITLES = ("отзыв", "наши клиенты", "команда", "наши специалисты", "кейс")
DOC_TYPES = ("privacy_policy", "consent", "ad_consent", "cookie_policy", "offer", "user_agreement")


def site_forms(audit: DataFrame) -> DataFrame:
    """Form rows of all audited pages with their order in the site."""
    return audit.select("site_id", "page_pos", "page_url", F.posexplode("forms").alias("form_pos", "f")).select(
        "site_id", "page_pos", "form_pos", "page_url", "f.*")


def form_fields(forms: DataFrame) -> DataFrame:
    return forms.select("site_id", "page_pos", "form_pos", "form_id", F.posexplode("fields").alias("field_pos", "x")).select(
        "site_id", "page_pos", "form_pos", "form_id", "field_pos", "x.*")


def _first_page(cond, *more):
    """Earliest form that meets a condition, with the columns a rule quotes."""
    return F.min(F.when(cond, F.struct("page_pos", "form_pos", "page_url", *more)))


def form_rollup(forms: DataFrame) -> DataFrame:
    c = F.col("consent")
    pd = F.col("personal")
    text = c["evidence_text"].alias("text")
    html = c["evidence_html"].alias("html")
    no_mech = ~c["checkbox_found"] & ~c["consent_text_found"]
    box = pd & c["checkbox_found"]

    def any_(cond):
        return F.coalesce(F.bool_or(cond), F.lit(False))

    flags = forms.groupBy("site_id").agg(
        F.count("*").alias("n_forms"), F.count_if(pd).alias("n_pd_forms"),
        F.count_if(pd & c["privacy_link_found"]).alias("n_pd_linked"),
        F.count_if(box).alias("n_pd_boxes"),
        F.count_if(box & F.coalesce(~c["checkbox_prechecked"], F.lit(False))).alias("n_pd_unchecked"),
        any_(F.col("is_newsletter")).alias("newsletter_form"), any_(F.col("has_file_upload")).alias("file_upload"),
        any_(F.col("is_medical")).alias("form_medical"), any_(F.col("is_children_related")).alias("form_children"),
        any_(F.col("is_hr")).alias("form_hr"), any_(F.col("is_order")).alias("form_order"),
        any_(c["ad_consent_found"]).alias("form_ad_consent"), any_(c["merged_with_offer"]).alias("form_merged"),
        any_(c["checkbox_prechecked"]).alias("form_prechecked"),
        any_(c["button_acceptance_only"]).alias("form_button_only"),
        any_(pd & (c["privacy_link_found"] | (F.size(c["privacy_link_urls"]) > 0))).alias("pd_link"),
        _first_page(pd).alias("f_pd"), _first_page(pd & ~c["privacy_link_found"], text).alias("f_unlinked"),
        _first_page(pd & c["privacy_link_found"], text).alias("f_linked"),
        _first_page(pd & no_mech, html).alias("f_no_consent"),
        _first_page(c["button_acceptance_only"], text).alias("f_button"),
        _first_page(F.coalesce(c["checkbox_prechecked"], F.lit(False)), text, html).alias("f_prechecked"),
        _first_page(c["merged_with_offer"], text).alias("f_merged"),
        _first_page(F.col("is_newsletter")).alias("f_newsletter"), _first_page(F.col("is_medical")).alias("f_medical"),
        _first_page(F.col("is_children_related")).alias("f_children"), _first_page(F.col("has_file_upload")).alias("f_file"),
        _first_page(F.col("is_hr")).alias("f_hr"),
    )
    cats = forms.select("site_id", "page_pos", "form_pos", F.posexplode("personal_data_fields").alias("pos", "category"))
    first = cats.groupBy("site_id", "category").agg(F.min(F.struct("page_pos", "form_pos", "pos")).alias("at"))
    listed = first.groupBy("site_id").agg(
        F.expr("transform(array_sort(collect_list(struct(at, category))), x -> x.category)").alias("pd_categories"))
    return flags.join(listed, "site_id", "left")


def tracker_rollup(hits: DataFrame) -> DataFrame:
    """Services per site in order; at most one row per catalogue entry and page, so lists are small."""
    first = hits.groupBy("site_id", "provider_name").agg(F.min(F.struct("page_pos", "pos")).alias("at"))
    names = first.groupBy("site_id").agg(
        F.expr("transform(array_sort(collect_list(struct(at, provider_name))), x -> x.provider_name)").alias("providers"))
    tracking = F.col("category").isin("analytics", "marketing")
    at = F.struct("page_pos", "pos", "provider_name", "page_url")

    def listed(cond):
        return F.transform(F.array_sort(F.collect_list(F.when(cond, at))), lambda x: x["provider_name"])

    agg = hits.groupBy("site_id").agg(
        F.count("*").alias("n_trackers"), F.count_if(F.col("country_hint") == "foreign").alias("n_foreign"),
        F.count_if(F.col("category").isin("payment", "delivery")).alias("n_sales"),
        F.min(F.when(tracking, at)).alias("t_tracking"), listed(tracking).alias("tracking_names"),
        listed(F.lit(True)).alias("tracker_names"), listed(F.col("country_hint") == "foreign").alias("foreign_names"))
    return agg.join(names, "site_id", "left")


def document_rollup(docs: DataFrame) -> DataFrame:
    at = F.struct("doc_pos", "url")
    policy = F.col("doc_type") == "privacy_policy"
    has = {f"has_{t}": F.coalesce(F.bool_or((F.col("doc_type") == t) & F.col("present")), F.lit(False)) for t in DOC_TYPES}
    return docs.groupBy("site_id").agg(
        *[v.alias(k) for k, v in has.items()],
        F.count("*").alias("n_docs"), F.count_if("is_accessible").alias("n_docs_accessible"),
        F.count_if(F.col("is_accessible") | F.col("link_confirmed")).alias("n_docs_found"),
        F.count_if((F.col("url") != "") & (F.col("text_length") > 0)).alias("n_docs_text"),
        F.count_if("text_extraction_failed").alias("n_docs_failed"),
        F.coalesce(F.bool_or(policy & F.col("is_accessible") & (F.col("text_length") > 0)), F.lit(False)).alias("policy_readable"),
        F.min(F.when(policy & F.col("present"), at)).alias("d_policy"),
        F.min(F.when(policy & F.col("present") & F.col("is_accessible"), at)).alias("d_policy_ok"),
        F.min(F.when(policy & F.col("present") & F.col("link_confirmed") & ~F.col("is_accessible"), at)).alias("d_policy_link"),
        F.min(F.when(F.col("placeholder"), F.struct(
            "doc_pos", "url", "doc_type", F.slice(X.find_placeholders(F.col("text")), 1, 10).alias("found")))).alias("d_blank"),
        F.array_sort(F.collect_set(F.when(F.col("is_accessible"), F.col("doc_type")))).alias("accessible_types"),
    )


def page_rollup(audit: DataFrame) -> DataFrame:
    ordered = F.expr("array_sort(collect_list(struct(page_pos, title)))")
    bad = (F.col("status_code") >= 400) | ((F.col("status_code") == 0) & (F.col("text_length") == 0))
    log = F.expr("flatten(transform(array_sort(collect_list(struct(page_pos, errors))), x -> x.errors))")
    return audit.groupBy("site_id").agg(
        F.coalesce(F.bool_or("has_screenshot"), F.lit(False)).alias("has_screenshot"), F.count("*").alias("pages_checked"), F.count_if(bad).alias("n_unreachable"),
        F.coalesce(F.bool_or("banner_found"), F.lit(False)).alias("cookie_banner_found"),
        F.min(F.when(F.col("page_url") != "", F.struct("page_pos", "page_url"))).alias("p_first"),
        F.array_join(F.transform(ordered, lambda x: x["title"]), " ").alias("titles"),
        F.min(F.when(F.col("page_pos") == 0, F.struct("page_pos", "errors"))).alias("p_home"), log.alias("page_errors"))


def technical(homes: DataFrame, audit: DataFrame, robots: DataFrame, sitemap: DataFrame, countries: DataFrame) -> DataFrame:
    """HTTPS, mixed content, delivery network, server country, robots and sitemap flags."""
    found = sitemap.select("site_id").distinct().withColumn("sitemap_found", F.lit(True))
    final = F.coalesce(F.when(F.col("site_final_url") != "", F.col("site_final_url")), "base_url")
    df = (homes.select("site_id", "base_url", final.alias("final"))
          .join(T.mixed_content(audit), "site_id", "left").join(T.site_cdn(audit), "site_id", "left")
          .join(robots.select("site_id", "robots_txt_found"), "site_id", "left").join(found, "site_id", "left")
          .join(countries, "site_id", "left"))
    urls = F.coalesce("mixed_content_urls", F.array().cast("array<string>"))
    return df.select(
        "site_id", P.is_https(F.col("final")).alias("https_enabled"), P.is_https(F.col("base_url")).alias("http_to_https_redirect"),
        (F.size(urls) > 0).alias("mixed_content_found"), urls.alias("mixed_content_urls"),
        F.coalesce("ip_addresses", F.array().cast("array<string>")).alias("ip_addresses"),
        F.coalesce("server_country", F.lit("unknown")).alias("server_country"),
        F.coalesce("geoip_confidence", F.lit(0)).alias("geoip_confidence"), F.coalesce("cdn_detected", F.lit("")).alias("cdn_detected"),
        F.coalesce("robots_txt_found", F.lit(False)).alias("robots_txt_found"),
        F.coalesce("sitemap_found", F.lit(False)).alias("sitemap_found"))


def address_ranges(ranges: DataFrame) -> DataFrame:
    """lo, hi (as ``ip_key``) and country of ranges given as IPv4 numbers (range_start, range_end) or as
    addresses of either family (first_ip, last_ip). Ranges without a country and broken ones are left out."""
    if "first_ip" in ranges.columns:
        ends = U.ip_key(F.col("first_ip")), U.ip_key(F.col("last_ip"))
    else:
        ends = tuple(F.concat(F.lit("4"), F.lpad(F.lower(F.hex(c)), 8, "0")) for c in ("range_start", "range_end"))
    keyed = ranges.where(F.col("country") != "").select(ends[0].alias("lo"), ends[1].alias("hi"), "country")
    return keyed.where((F.col("lo") <= F.col("hi")) & (F.substring("lo", 1, 1) == F.substring("hi", 1, 1)))


def _carried(parts: DataFrame, *names: str) -> DataFrame:
    """Per bucket the last values of all earlier buckets (or the largest, where there is one column):
    a window over one row a bucket."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    if len(names) == 1:
        return parts.select("bucket", F.max(names[0]).over(before).alias(f"carried_{names[0]}"))
    return parts.select("bucket", *(F.last(n, True).over(before).alias(f"carried_{n}") for n in names))


def address_country(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """ip, country of every distinct address (column ip) inside a range; of overlapping ranges the one that
    begins first counts. An as-of join: ranges and addresses are sorted together, and each address takes
    the last range before it. The sort is dealt by the leading digits of the address (a /8 of IPv4, a /16
    of IPv6); what reaches over a bucket's end is carried by a window over one row a bucket, so wide ranges
    are not split and neither side is broadcast."""
    bucket = F.substring("key", 1, F.when(F.col("key").startswith("4"), 3).otherwise(5))
    # both sides are written with their keys: the plans below read a key often, and it costs much to make
    folder = work_dir(ranges.sparkSession)
    known = staged(address_ranges(ranges), folder, "ranges").withColumn("key", F.col("lo")).withColumn("bucket", bucket)
    # what an earlier range covers is its own: each range keeps what lies behind all ends before it
    reach = _carried(known.groupBy("bucket").agg(F.max("hi").alias("hi")), "hi")
    earlier = Window.partitionBy("bucket").orderBy("lo", F.desc("hi"), "country").rowsBetween(Window.unboundedPreceding, -1)
    inside = known.withColumn("before", F.max("hi").over(earlier)).join(reach, "bucket", "left").withColumn(
        "before", F.greatest("before", "carried_hi")).where("before is null or hi > before")
    # "~" sorts behind a key and before the next one
    segments = staged(inside.select(F.when(F.col("before") >= F.col("lo"), F.concat("before", F.lit("~"))).otherwise(F.col("lo")).alias("key"), "hi", "country"), folder, "segments")
    asked = staged(ips.select("ip").distinct().select(U.ip_key(F.col("ip")).alias("key"), "ip"), folder, "addresses").where("key is not null")
    both = segments.withColumn("ip", F.lit(None).cast("string")).unionByName(
        asked.withColumns({"hi": F.lit(None).cast("string"), "country": F.lit(None).cast("string")})).withColumn("bucket", bucket)
    last = _carried(both.groupBy("bucket").agg(
        F.max_by("hi", F.when(F.col("hi").isNotNull(), F.col("key"))).alias("hi"), F.max_by("country", F.when(F.col("hi").isNotNull(), F.col("key"))).alias("country")), "hi", "country")
    upto = Window.partitionBy("bucket").orderBy("key", F.col("ip").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("bucket", "key", "ip", F.last("hi", True).over(upto).alias("at_hi"), F.last("country", True).over(upto).alias("at_country")).where("ip is not null")
    return found.join(last, "bucket", "left").withColumns({
        "country": F.when(F.col("at_hi").isNotNull(), F.col("at_country")).otherwise(F.col("carried_country")),
        "at_hi": F.coalesce("at_hi", "carried_hi")}).where("at_hi >= key").select("ip", "country")


def server_country(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """(site_id, ip_pos, ip) and ranges (see address_ranges): country of the first public address inside
    a range, confidence 80. An address is resolved once, however many sites share it."""
    resolved = address_country(ips.where(~U.is_private_ip(F.col("ip"))), ranges)
    hit = ips.join(resolved, "ip").groupBy("site_id").agg(F.min_by("country", F.struct("ip_pos", "ip")).alias("server_country"))
    all_ips = ips.groupBy("site_id").agg(
        F.expr("transform(array_sort(collect_list(struct(ip_pos, ip))), x -> x.ip)").alias("ip_addresses"))
    return all_ips.join(hit, "site_id", "left").select(
        "site_id", "ip_addresses", F.coalesce("server_country", F.lit("unknown")).alias("server_country"),
        F.when(F.col("server_country").isNotNull(), 80).otherwise(0).alias("geoip_confidence"))


def site_context(homes, forms, hits, cookies, consent, docs, audit, tech) -> DataFrame:
    """Everything a rule may look at, one row per lead; sites without pages keep their row."""
    n_cookies = cookies.groupBy("site_id").agg(F.count("*").alias("n_cookies"))
    df = with_site_domain(homes)
    for part in (form_rollup(forms), tracker_rollup(hits), n_cookies, consent, document_rollup(docs), page_rollup(audit), tech):
        df = df.join(part, "site_id", "left")
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c, t in df.dtypes if t == "boolean"})
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c, t in df.dtypes if t in ("int", "bigint") and c != "home_uid"})
    df = df.withColumns({c: F.coalesce(F.col(c), F.array().cast(t)) for c, t in df.dtypes if t.startswith("array")})
    industry = F.lower("industry")
    titles = F.coalesce("titles", F.lit(""))
    first = F.coalesce("p_first.page_url", F.when(F.col("site_final_url") != "", F.col("site_final_url")), "site_url")
    return df.withColumns({
        "registered_domain": F.col("domain"),
        "first_page_url": first,
        "has_forms": F.col("n_forms") > 0, "has_pd_forms": F.col("n_pd_forms") > 0,
        "medical": industry.startswith("медиц") | F.col("form_medical") | X.contains_any(titles, MEDICAL_TITLES),
        "children": industry.contains("образован") | F.col("form_children"),
        "hr": industry.contains("hr") | industry.contains("рекрут") | F.col("form_hr"),
        "ecommerce": industry.contains("commerce") | F.col("form_order") | (F.col("n_sales") > 0),
        "finance": industry.startswith("финанс"),
        "publishes_people": X.contains_any(titles, PEOPLE_TITLES),
        "trackers_present": F.col("n_trackers") > 0, "foreign_trackers_present": F.col("n_foreign") > 0,
        "cookies_present": (F.col("n_trackers") > 0) | (F.col("n_cookies") > 0),
        "marketing_before_consent": F.size("before_consent_items") > 0,
        "before_consent_evidence": F.coalesce("before_consent_evidence", F.lit("")),
    })
