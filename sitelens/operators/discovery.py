"""Homepages, page plan, audit set and document candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import elements as P
from sitelens.functions import text as X
from sitelens.functions import urls as U
from sitelens.limits import NONE, Limits
from sitelens.operators.domains import on_site, with_site_domain
from sitelens.operators.reduce import maybe_in

# ---- fixed values -----------------------------------------------------------------
LINK_WORDS = ("политика", "конфиденциальность", "персональные данные", "privacy", "policy", "согласие", "consent",
              "cookie", "cookies", "оферта", "oferta", "offer", "договор", "agreement", "terms",
              "пользовательское соглашение", "контакты", "заявка", "запись", "консультация", "рассылка", "подписка")
FORM_PAGE_WORDS = ("контакт", "contact", "kontakty", "запис", "заявк", "консультац", "услуг", "service",
                   "обратная связь", "feedback", "звонок", "callback", "подписк", "бронир", "заказать")
PLAN_GUESSES = ("/contacts", "/contact", "/kontakty", "/privacy", "/privacy-policy", "/policy", "/personal-data",
                "/personal-data-policy", "/politika", "/politika-konfidentsialnosti", "/privacy.html", "/soglasie",
                "/consent", "/agreement", "/user-agreement", "/terms", "/oferta", "/offer", "/publichnaya-oferta",
                "/cookie", "/cookies", "/cookie-policy", "/obrabotka-personalnyh-dannyh")
SOURCE_RANK = {"anchor": 4, "page_link": 3, "priority_path": 2, "sitemap": 1}

MAP_TIER, FORM_TIER, GUESS_TIER = 2, 3, 4
FOUND_TIERS = (1, MAP_TIER, FORM_TIER)


def url_winners(facts: DataFrame) -> DataFrame:
    """One stored page per fragment-less URL; of several copies the one that comes first by content."""
    content = F.struct(F.xxhash64("url", "status_code", "title", "html_length", "text_length").alias("hash"), "uid")
    return facts.select(U.strip_fragment(F.col("url")).alias("key"), "uid", content.alias("at")).groupBy("key").agg(F.min_by("uid", "at").alias("uid"))


def homepages(leads: DataFrame, facts: DataFrame) -> DataFrame:
    """Homepage per lead: its URL, else the http twin, else a stub; with base URL and reachability."""
    asked = leads.withColumn("normalized", U.normalize_url(F.col("site_url")))
    tries = asked.select(
        "site_id", F.posexplode(F.array_distinct(F.array("normalized", U.to_http(F.col("normalized"))))).alias("try", "u")
    ).withColumn("key", U.url_key(F.col("u")))
    pages = facts.select(
        U.url_key(F.col("url")).alias("key"), "uid", "url", "final_url", "ok", "has_html", "fetch_method", "errors",
        F.size("links").alias("homepage_links"))
    good = F.col("ok") | F.col("has_html")
    best = tries.join(maybe_in(pages, "key", tries.select("key")), "key").groupBy("site_id").agg(
        F.min_by(F.struct("uid", "url", "final_url", "ok", "has_html", "fetch_method", "errors", "homepage_links"),
                 F.struct(~good, "try", "uid")).alias("h"))
    final = F.coalesce(F.when(F.col("h.final_url") != "", F.col("h.final_url")), "h.url", "normalized")
    base = U.base_from_url(final)
    base = F.coalesce(F.when(base != "", base), F.when(U.base_from_url(F.col("normalized")) != "",
                                                       U.base_from_url(F.col("normalized"))), "normalized")
    return asked.join(best, "site_id", "left").select(
        *leads.columns, base.alias("base_url"), F.col("h.uid").alias("home_uid"),
        F.coalesce("h.url", "normalized").alias("home_url"), F.coalesce("h.final_url", base).alias("site_final_url"),
        F.coalesce(F.col("h.ok") | F.col("h.has_html"), F.lit(False)).alias("reachable"),
        F.coalesce("h.fetch_method", F.lit("")).alias("fetch_method"),
        F.coalesce("h.homepage_links", F.lit(0)).alias("homepage_links"))


def first_links(links: DataFrame) -> DataFrame:
    """(site_id, pos, url, text) distinct by fragment-less URL, text of the first occurrence."""
    return (
        links.withColumn("url", U.strip_fragment(F.col("url"))).where("url <> ''")
        .groupBy("site_id", "url").agg(F.min(F.struct("pos", "text")).alias("m"))
        .select("site_id", "url", "m.pos", "m.text")
    )


def homepage_links(homes: DataFrame, facts: DataFrame) -> DataFrame:
    home = homes.where("reachable").select("site_id", F.col("home_uid").alias("uid"))
    page = home.join(maybe_in(facts.select("uid", "anchors", "links"), "uid", home.select("uid")), "uid")
    real = F.filter("anchors", lambda a: a["has_href"] & (a["url"] != ""))
    pairs = F.concat(
        F.transform(real, lambda a: F.struct(a["url"].alias("url"), a["text"].alias("text"))),
        F.transform("links", lambda u: F.struct(u.alias("url"), F.lit("").alias("text"))))
    return first_links(page.select("site_id", F.posexplode(pairs).alias("pos", "a")).select(
        "site_id", "pos", "a.url", "a.text"))


def link_tier(url, text):
    """1 document link, 3 form page, NULL for links that are not followed."""
    by_text = (text != "") & X.contains_any(text, LINK_WORDS)
    blob = F.concat_ws(" ", url, text)
    return F.when(by_text | (U.is_probably_html_url(url) & X.contains_any(blob, LINK_WORDS)), 1).when(
        U.is_probably_html_url(url) & X.contains_any(blob, FORM_PAGE_WORDS), FORM_TIER)


def plan_pages(links: DataFrame, sitemap: DataFrame, homes: DataFrame, max_pages: int | None = None, limits: Limits = NONE) -> DataFrame:
    """(site_id, plan_pos, url): document links, sitemap pages, form pages, guessed paths; of a site at
    most max_pages, else its own budget (no budget: all). No other limit holds unless ``limits`` sets it."""
    sites = with_site_domain(homes).where("reachable").select(
        "site_id", "base_url", "domain", "below",
        (F.lit(max_pages) if max_pages else F.when(F.col("max_pages").isNotNull(), F.greatest("max_pages", F.lit(1)))).cast("int").alias("budget"))
    # exploding the 0 or 1 tiers of a link evaluates the keyword tests once, a filter would repeat them
    linked = links.select("site_id", "pos", "url", F.explode(F.array_compact(F.array(link_tier(F.col("url"), F.col("text"))))).alias("tier"))
    mapped = sitemap.where(X.contains_any(F.col("url"), LINK_WORDS)).select("site_id", "pos", "url", F.lit(MAP_TIER).alias("tier"))
    paths = F.array(*map(F.lit, PLAN_GUESSES))
    own_base = ~F.col("base_url").contains("#")  # else a guess would be the homepage itself
    found = linked.unionByName(mapped).join(sites, "site_id").where(
        (F.col("tier") == MAP_TIER) | on_site(F.col("url"), F.col("domain"), F.col("below"))
    ).withColumn("url", U.strip_fragment(F.col("url"))).where(
        (F.col("url") != "") & (U.url_key(F.col("url")) != U.url_key(F.col("base_url")))
    ).select("site_id", "budget", "tier", "pos", "url", F.when(
        own_base & F.startswith("url", "base_url"), F.array_position(paths, F.substr("url", F.length("base_url") + 1))).otherwise(0).alias("guess"))
    # least positions by tier are plain numbers: the aggregate hashes, where a least struct would be sorted
    least = [F.min(F.when(F.col("tier") == t, F.col("pos"))).alias(f"p{t}") for t in FOUND_TIERS]
    once = found.groupBy("site_id", "budget", "url", "guess").agg(*least).select(
        "site_id", "budget", "url", "guess", F.coalesce(*[F.when(F.col(f"p{t}").isNotNull(), t) for t in FOUND_TIERS]).alias("tier"),
        F.coalesce(*[f"p{t}" for t in FOUND_TIERS]).cast("long").alias("pos"))
    # guesses come last in a site's plan: one row a site, which knows what was found, becomes them after all sorting
    seeds = sites.select("site_id", "budget", F.when(own_base, F.col("base_url")).alias("url"), F.lit(0).cast("long").alias("guess"),
                         F.lit(GUESS_TIER).alias("tier"), F.lit(0).cast("long").alias("pos"))
    by_tier = Window.partitionBy("site_id", "tier").orderBy("pos")
    so_far = Window.partitionBy("site_id").orderBy("tier", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = F.lit(True)
    pool = once.unionByName(seeds)
    if limits.form_pages is not None:
        pool = pool.withColumn("k", F.row_number().over(by_tier))
        kept = (F.col("tier") != FORM_TIER) | (F.col("k") <= limits.form_pages)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("guess").cast("int"))
    ranked = pool.withColumns({
        "kept": kept, "plan_pos": F.sum(kept.cast("int")).over(so_far).cast("int"), "taken": F.bit_or(bit).over(so_far),
    }).where("kept and (budget is null or plan_pos <= budget)")
    left = F.filter(F.transform(paths, lambda p, i: F.when(F.col("taken").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i + 1)) == 0, p)),
                    lambda p: p.isNotNull())
    room = F.least(F.lit(len(PLAN_GUESSES) if limits.guesses is None else limits.guesses), F.col("budget") - F.col("plan_pos") + 1)
    guesses = F.transform(F.slice(left, F.lit(1), room), lambda p, i: F.struct((F.col("plan_pos") + i).alias("plan_pos"), F.concat("url", p).alias("url")))
    rows = F.when(F.col("tier") != GUESS_TIER, F.array(F.struct("plan_pos", "url"))).when(F.col("url").isNotNull(), guesses)
    return ranked.select("site_id", F.inline(rows))


def audit_set(homes: DataFrame, plan: DataFrame, facts: DataFrame, winners: DataFrame | None = None) -> DataFrame:
    """Facts of the audited pages with page_pos; a planned URL without a stored page is an error row.
    Page texts stay behind: only documents need them, and they fetch their own."""
    facts = facts.drop("doc_text", "html_head")
    home = homes.where("reachable").select(
        "site_id", F.lit(0).alias("page_pos"), F.col("home_url").alias("want"), F.col("home_uid").alias("uid"))
    budget = homes.select("site_id", F.when(F.col("max_pages").isNotNull(), F.greatest("max_pages", F.lit(1))).alias("budget"))
    rest = plan.join(url_winners(facts) if winners is None else winners, F.col("url") == F.col("key"), "left").select(
        "site_id", F.col("plan_pos").alias("page_pos"), F.col("url").alias("want"), "uid")
    chosen = home.unionByName(rest).join(budget, "site_id").where("budget is null or page_pos < budget").drop("budget")
    joined = chosen.join(maybe_in(facts, "uid", chosen.select("uid")), "uid", "left")
    blank = {c: F.coalesce(F.col(c), F.array().cast(t)) for c, t in facts.dtypes if t.startswith("array")}
    missing = F.array(F.concat(F.lit("not stored: "), "want"))
    return joined.withColumns({
        **blank,
        "stored": F.col("html_length").isNotNull(),
        "url": F.coalesce("url", "want"), "page_url": F.coalesce("page_url", "want"),
        "status_code": F.coalesce("status_code", F.lit(0)), "ok": F.coalesce("ok", F.lit(False)),
        "has_html": F.coalesce("has_html", F.lit(False)), "title": F.coalesce("title", F.lit("")),
        "text_length": F.coalesce("text_length", F.lit(0)), "html_length": F.coalesce("html_length", F.lit(0)),
        "banner_found": F.coalesce("banner_found", F.lit(False)),
        "errors": F.when(F.col("html_length").isNull(), missing).otherwise(F.coalesce("errors", blank["errors"])),
    }).drop("want")


# ---- document candidates --------------------------------------------------------------
def doc_candidates(audit: DataFrame, sitemap: DataFrame, homes: DataFrame) -> DataFrame:
    """All candidates of a site from anchors, page links, usual paths and sitemaps, with their order."""
    sites = with_site_domain(homes).where("reachable").select("site_id", "base_url", "domain", "below")
    empty = F.lit("")
    anchors = audit.select("site_id", "page_pos", "page_url", F.posexplode("anchors").alias("pos", "a")).where(
        "a.href <> '' and a.url <> ''").select(
        "site_id", F.lit("anchor").alias("source"), F.lit(1).alias("src_pos"), "page_pos", "pos", "page_url",
        F.col("a.url").alias("url"), F.col("a.text").alias("anchor_text"), F.col("a.title").alias("title"))
    links = audit.select("site_id", "page_pos", "page_url", F.posexplode("links").alias("pos", "url")).select(
        "site_id", F.lit("page_link").alias("source"), F.lit(2).alias("src_pos"), "page_pos", "pos", "page_url", "url",
        empty.alias("anchor_text"), empty.alias("title"))
    mapped = sitemap.join(sites, "site_id").select(
        "site_id", F.lit("sitemap").alias("source"), F.lit(4).alias("src_pos"), F.lit(0).alias("page_pos"), "pos",
        F.col("base_url").alias("page_url"), "url", empty.alias("anchor_text"), empty.alias("title"))
    # a link looks like a document exactly when its words give it a type
    kind = X.let(P.link_blob(F.col("anchor_text"), F.col("url"), F.col("title")),
                 lambda b: F.nullif(P.doc_type_of_blob(b), F.lit("other")))
    seen = anchors.unionByName(links).unionByName(mapped).join(sites, "site_id").where(
        on_site(F.col("url"), F.col("domain"), F.col("below"))
    ).select("*", F.explode(F.array_compact(F.array(kind))).alias("doc_type")).drop("base_url", "domain", "below")
    paths = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("doc_type")) for p, t in P.GUESS_PATHS.items()])
    # a small table of sites would be merged into few partitions: dealt by number, its many rows are sorted in all tasks
    dealt = sites.select("site_id", "base_url").repartition(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")), "site_id")
    guesses = dealt.select("site_id", "base_url", F.posexplode(paths).alias("pos", "g")).select(
        "site_id", F.lit("priority_path").alias("source"), F.lit(3).alias("src_pos"), F.lit(0).alias("page_pos"), "pos",
        F.col("base_url").alias("page_url"), F.concat("base_url", "g.path").alias("url"), empty.alias("anchor_text"),
        empty.alias("title"), "g.doc_type")
    return seen.unionByName(guesses)


def dedupe_candidates(cands: DataFrame, cap: int | None = None) -> DataFrame:
    """One candidate per URL: a specific type beats ``other``, then the stronger source, then the
    earlier; the first-seen position decides the order and the cap."""
    rank = F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])
    at = F.struct("src_pos", "page_pos", "pos")
    strength = F.struct((F.col("doc_type") == "other").alias("o"), (-rank[F.col("source")]).alias("r"), at.alias("at"))
    once = cands.withColumn("key", U.strip_fragment(F.col("url"))).where("key <> ''").groupBy("site_id", "key").agg(
        F.min_by(F.struct("url", "doc_type", "anchor_text", "title", "source", "page_url"), strength).alias("c"),
        F.min(at).alias("at"))
    pos = F.row_number().over(Window.partitionBy("site_id").orderBy("at"))
    ranked = once.withColumn("cand_pos", pos)
    return (ranked if cap is None else ranked.where(F.col("cand_pos") <= cap)).select(
        "site_id", "cand_pos", "key", "c.url", "c.doc_type", X.truncate(F.col("c.anchor_text"), 200).alias("anchor_text"),
        X.truncate(F.col("c.title"), 200).alias("title"), "c.source", "c.page_url")
