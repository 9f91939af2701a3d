"""Commercial findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens import catalogue
from sitelens.functions import text as X

DDL = ("finding_pos int, finding_id string, title string, level string, score int, force string, what string, "
       "advice string, kind string, liability_hint string, prechecked_only boolean, risk_only boolean")


def load_findings(spark, path=None) -> tuple[DataFrame, DataFrame]:
    """(finding texts, sources): one source row per rule prefix or core check of a finding."""
    labels = {x["kind"]: x["label"] for x in catalogue.liability()}
    texts, sources = [], []
    for pos, f in enumerate(catalogue.findings(path)["findings"]):
        texts.append({
            "finding_pos": pos, "finding_id": f["id"], "title": f["title"], "level": f.get("level", ""),
            "score": f.get("score", 10), "force": f.get("force", ""), "what": f.get("what", ""),
            "advice": f.get("advice", ""), "kind": f.get("kind", ""), "liability_hint": labels.get(f.get("kind"), ""),
            "prechecked_only": bool(f.get("only_if_prechecked", False)), "risk_only": not f.get("core"),
        })
        sources += [{"finding_pos": pos, "side": "rule", "ref": r, "pref": i} for i, r in enumerate(f.get("rules", []))]
        sources += [{"finding_pos": pos, "side": "core", "ref": r, "pref": i} for i, r in enumerate(f.get("core", []))]
    return (spark.createDataFrame(texts, DDL),
            spark.createDataFrame(sources, "finding_pos int, side string, ref string, pref int"))


def finding_sources(sources: DataFrame, risks: DataFrame, core: DataFrame) -> DataFrame:
    """Strongest fired rule and preferred core check in state risk per site and finding."""
    rules = sources.where("side = 'rule'")
    prefix = F.split_part("rule_id", F.lit("_"), F.lit(1))
    by_risk = risks.withColumn("ref", prefix).join(rules, "ref").groupBy("site_id", "finding_pos").agg(F.min_by(
        F.struct("rule_id", "risk_level", "score", "page_url", F.col("evidence.quote").alias("quote"), "report_phrase", "title",
                 "recommendation"),
        F.struct(-X.level_rank(F.col("risk_level")), -F.col("score"), F.col("rank"))).alias("r"))
    checks = sources.where("side = 'core'")
    by_core = core.where("status = 'risk'").withColumnRenamed("id", "ref").join(checks, "ref").groupBy(
        "site_id", "finding_pos").agg(F.min_by(
            F.struct(F.col("ref").alias("id"), "risk_level", "comment", "evidence"), "pref").alias("c"))
    return by_risk.join(by_core, ["site_id", "finding_pos"], "full_outer")


def findings(ctx: DataFrame, risks: DataFrame, core: DataFrame, path=None) -> DataFrame:
    """Ranked findings per site, one row per finding id."""
    texts, sources = load_findings(ctx.sparkSession, path)
    denied = catalogue.findings(path)["denied_transfer"]
    df = finding_sources(sources, risks, core).join(texts, "finding_pos").join(
        ctx.select("site_id", "form_prechecked", "transfer_denied"), "site_id")
    df = df.withColumn("c", F.when(~F.col("prechecked_only") | F.col("form_prechecked"), F.col("c"))).where(
        "r is not null or c is not null")
    rank = X.level_rank
    base = F.when(F.col("level") != "", F.col("level")).otherwise(F.col("r.risk_level"))
    by_rank = F.create_map(*[F.lit(x) for k, v in X.LEVEL_RANK.items() for x in (v, k)])
    best = by_rank[F.greatest(rank(base), F.coalesce(rank(F.col("r.risk_level")), F.lit(-1)),
                              F.coalesce(F.when(F.col("c").isNotNull(), rank(F.col("c.risk_level"))), F.lit(-1)))]
    floor = F.coalesce(F.when(F.col("c.risk_level") == "critical", 30).when(F.col("c.risk_level") == "high", 20)
                       .when(F.col("c.risk_level") == "medium", 10), F.lit(0))
    score = F.when(F.col("r.score") > 0, F.col("r.score")).otherwise(F.greatest("score", floor))
    denies = F.col("transfer_denied") & (F.col("finding_id") == denied["from"])
    quote = F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in (
        "r.quote", "r.report_phrase", "r.title", "c.evidence", "c.comment")], F.lit(""))
    what = F.coalesce(F.when(F.col("what") != "", F.col("what")), F.when(F.col("c.comment") != "", F.col("c.comment")), "title")
    out = df.select(
        "site_id", F.when(denies, denied["id"]).otherwise(F.col("finding_id")).alias("finding_id"),
        F.when(denies, denied["title"]).otherwise(F.col("title")).alias("title"),
        F.when(F.col("force") != "", F.col("force")).otherwise(best).alias("risk_level"), score.alias("score"),
        X.squeeze(what, 360).alias("what_found"),
        X.squeeze(F.coalesce(F.when(F.col("advice") != "", F.col("advice")), "r.recommendation", F.lit("")), 360).alias("recommendation"),
        X.squeeze(F.col("r.page_url"), 220).alias("evidence_url"), X.squeeze(quote, 260).alias("evidence_quote"), "liability_hint",
        F.array_distinct(F.array_compact(F.array("r.rule_id", "c.id"))).alias("source_ids"))
    return rank_findings(out)


def rank_findings(f: DataFrame) -> DataFrame:
    """The strongest row per finding id, then level, score and id, all descending."""
    strength = F.struct(X.level_rank(F.col("risk_level")), F.col("score"))
    once = f.groupBy("site_id", "finding_id").agg(
        F.max_by(F.struct(*[x for x in f.columns if x not in ("site_id", "finding_id")]), strength).alias("m")).select(
        "site_id", "finding_id", "m.*")
    order = Window.partitionBy("site_id").orderBy(
        F.desc(X.level_rank(F.col("risk_level"))), F.desc("score"), F.desc("finding_id"))
    return once.withColumn("rank", F.row_number().over(order))


def commercial_level(total: Column) -> Column:
    return F.when(total >= 80, "critical").when(total >= 50, "high").when(total >= 25, "medium").otherwise("low")


def commercial_score(f: DataFrame) -> DataFrame:
    """Capped score; the level comes from the uncapped total."""
    total = F.sum(F.greatest("score", F.lit(0)))
    return f.groupBy("site_id").agg(F.least(total, F.lit(150)).cast("int").alias("pd_score"), commercial_level(total).alias("pd_level"))


def attach_liability(f: DataFrame, liability: DataFrame) -> DataFrame:
    """Liability text, amount and the flag for "counted separately" per finding."""
    def key(label):
        return F.lower(X.clean_text(F.coalesce(label, F.lit(""))))

    item = liability.select(key(F.col("label")).alias("lkey"), F.col("label").alias("l_label"), "basis", "amount")
    df = f.withColumn("lkey", key(F.col("liability_hint"))).join(item, "lkey", "left")
    meta = F.concat_ws(" · ", F.when(F.col("basis") != "", F.col("basis")), F.when(F.col("amount") != "", F.col("amount")))
    known = F.col("l_label").isNotNull()
    text = F.when(F.col("lkey") == "", "уточняется юристом").when(
        known, F.concat_ws(": ", "l_label", F.when(meta != "", meta))).otherwise(F.col("liability_hint"))
    amount = F.when(known, X.amount_to_int(F.col("amount"))).otherwise(F.lit(0))
    return df.withColumns({"liability_text": text, "liability_amount": amount, "liability_separate": amount == 0}).drop(
        "lkey", "l_label", "basis", "amount")


def liability_summary(f: DataFrame) -> DataFrame:
    """Total amount, number of separate items, labels in order and the display text per site."""
    agg = f.groupBy("site_id").agg(
        F.sum("liability_amount").alias("liability_total"), F.count_if("liability_separate").alias("liability_separate"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "liability_text"))),
                                     lambda x: x["liability_text"])).alias("liability_labels"))
    money = F.replace(F.format_number("liability_total", 0), F.lit(","), F.lit(" "))
    shown = F.when((F.col("liability_total") <= 0) & (F.col("liability_separate") > 0), "требует расчёта").otherwise(
        F.concat(F.lit("до "), money, F.lit(" ₽"), F.when(F.col("liability_separate") > 0, "+").otherwise("")))
    return agg.withColumn("liability_display", shown)


def hidden_groups(f: DataFrame, path=None) -> DataFrame:
    """Names of the groups that the findings of a site touch."""
    groups = catalogue.findings(path)["groups"]
    ids = f.groupBy("site_id").agg(F.collect_set("finding_id").alias("ids"))
    tests = [F.when(F.arrays_overlap("ids", F.array(*map(F.lit, g["ids"]))), g["label"]) for g in groups]
    return ids.select("site_id", F.array_compact(F.array(*tests)).alias("groups"))


def fact_bundle(scored: DataFrame, docs: DataFrame, hits: DataFrame, f: DataFrame, top_n: int = 4, max_trackers: int = 10) -> DataFrame:
    """One compact struct per site: counts, documents, services, top findings; no full text."""
    seen = docs.where("is_accessible or link_confirmed").groupBy("site_id", "doc_type", "url").agg(
        F.min(F.struct("doc_pos", "text_length")).alias("m"))
    listed = seen.groupBy("site_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col("m.doc_pos").alias("p"), "doc_type", "url", F.col("m.text_length").alias("n")))),
        lambda d: F.struct(d["doc_type"].alias("type"), X.squeeze(d["url"], 220).alias("url"),
                           F.when(d["n"] > 0, "text_extracted").otherwise("found_needs_review").alias("status"))), 1, 12).alias("documents"))
    name = F.struct("page_pos", "pos", F.when(F.col("provider_name") != "", F.col("provider_name")).otherwise(F.col("matched_domain")).alias("n"))

    def names(cond):
        return F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(cond, name))), lambda x: x["n"])), 1, max_trackers)

    services = hits.groupBy("site_id").agg(names(F.lit(True)).alias("trackers"), names(F.col("country_hint") == "foreign").alias("foreign_trackers"))
    keep = F.struct("rank", "finding_id", "title", "risk_level", "score", "what_found", "recommendation", "evidence_url",
                    "evidence_quote", "liability_hint", "source_ids")
    top = f.groupBy("site_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") <= top_n, keep))).alias("top_findings"),
        F.greatest(F.lit(0), F.count("*") - top_n).alias("hidden_findings_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "finding_id"))), lambda x: x["finding_id"]).alias("all_finding_ids"))
    df = scored.join(listed, "site_id", "left").join(services, "site_id", "left").join(top, "site_id", "left").join(
        commercial_score(f), "site_id", "left")

    def arr(x):
        return F.coalesce(F.col(x), F.array().cast(dict(df.dtypes)[x])).alias(x)

    return df.select("site_id", F.struct(
        X.squeeze(F.col("company_name"), 160).alias("company_name"), X.squeeze(F.col("site_url"), 220).alias("site_url"),
        X.squeeze(F.col("site_final_url"), 220).alias("final_url"), X.squeeze(F.col("industry"), 80).alias("industry"),
        "pages_checked", F.col("n_forms").alias("forms_found"), F.col("n_pd_forms").alias("pd_forms_found"), arr("documents"),
        arr("trackers"), arr("foreign_trackers"), "cookie_banner_found", F.coalesce("pd_score", F.lit(0)).alias("risk_score"),
        F.coalesce("pd_level", F.lit("low")).alias("risk_level"), "confidence", arr("top_findings"),
        F.coalesce("hidden_findings_count", F.lit(0)).alias("hidden_findings_count"), arr("all_finding_ids")).alias("bundle"))
