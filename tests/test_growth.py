"""What must not grow faster than its input: rows between stages, checked on plans and against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitelens.functions import elements as P
from sitelens.limits import INTERACTIVE, NONE
from sitelens.operators import discovery as D


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def expected_plan(links, maps, sites, max_pages, limits):
    out = []
    for site, base, budget in sites:
        best = {}
        rows = [(1 if "privacy" in u else 3, p, u) for s, p, u in links if s == site and "s.ru" in u and ("privacy" in u or "contact" in u.lower())]
        rows += [(2, p, u) for s, p, u in maps if s == site and "policy" in u]
        rows += [(4, p, base + g) for p, g in enumerate(D.PLAN_GUESSES)] if "#" not in base else []
        for tier, p, u in rows:
            u = re.sub(r"\?$", "", u.split("#")[0])
            if u.rstrip("/") != base.rstrip("/"):
                best[u] = min(best.get(u, (9, 0)), (tier, p))
        seen, ranked = {}, []
        for at, u in sorted((at, u) for u, at in best.items()):
            seen[at[0]] = seen.get(at[0], 0) + 1
            cap = {3: limits.form_pages, 4: limits.guesses}.get(at[0])
            if cap is None or seen[at[0]] <= cap:
                ranked.append(u)
        most = max_pages or budget or 10**9
        out += [(site, k, u) for k, u in enumerate(ranked, 1) if k <= most]
    return sorted(out)


@pytest.mark.parametrize("max_pages, limits", [(None, NONE), (12, INTERACTIVE), (30, NONE), (None, INTERACTIVE)])
def test_plan_is_that_of_plain_python(spark, max_pages, limits):
    rnd = random.Random(3)
    sites = [("a", "https://s.ru", None), ("b", "https://s.ru", 9), ("c", "https://s.ru", 27), ("d", "https://s.ru", None), ("e", "https://s.ru#x", 8)]
    tails = ["/contact", "/contacts", "/privacy", "/privacy-policy", "/privacy.html", "/contact?x=1", "/contact?", "/", "/other", "/Contact/us"]
    links = [(s, p, "https://" + rnd.choice(["s.ru", "s.ru", "www.s.ru", "t.ru"]) + rnd.choice(tails) + rnd.choice(["", "#top", f"/{p}"]))
             for s in "abc" for p in range(40)]
    links = [(s, p, u) for s, p, u in links if not u.startswith("https://t.ru")]
    maps = [(s, p, "https://s.ru" + rnd.choice(["/policy", "/privacy-policy", f"/policy/{p}", "/cats"])) for s in "abd" for p in range(12)]
    got = D.plan_pages(
        spark.createDataFrame([(*x, "") for x in links], "site_id string, pos int, url string, text string"),
        spark.createDataFrame(maps, "site_id string, pos int, url string"),
        spark.createDataFrame(sites, "site_id string, base_url string, max_pages int").withColumn("reachable", F.lit(True)), max_pages, limits)
    assert sorted(map(tuple, got.collect())) == expected_plan(links, maps, sites, max_pages, limits)


def test_guessed_pages_of_a_plan_are_made_after_all_sorting(spark):
    """They are 23 rows a site: sorted and grouped with the links they took most of a task's memory."""
    links = spark.range(9).select(F.col("id").alias("site_id"), F.lit(0).alias("pos"), F.lit("https://s.ru/privacy").alias("url"), F.lit("").alias("text"))
    homes = links.select("site_id", F.lit("https://s.ru").alias("base_url"), F.lit(True).alias("reachable"), F.lit(None).cast("int").alias("max_pages"))
    plan = plan_of(D.plan_pages(links, spark.createDataFrame([], "site_id bigint, pos bigint, url string"), homes)).split("\n")
    sorts = [i for i, line in enumerate(plan) if re.search(r"\b(Window|Aggregate|Join)\b", line)]
    guesses = [i for i, line in enumerate(plan) if "Generate" in line and "/politika-konfidentsialnosti" in line and "posexplode" in line]
    assert sorts and not [i for i in guesses if i > sorts[0]]
    assert any("Generate inline" in line for line in plan[:sorts[0]])


def test_usual_document_paths_are_made_in_all_partitions(spark):
    """They are twenty rows a site; the sites' table alone is so small that all were made and sorted in one task."""
    homes = spark.range(400).select(F.col("id").alias("site_id"), F.concat(F.lit("https://s"), "id", F.lit(".ru")).alias("base_url"), F.lit(True).alias("reachable"))
    audit = spark.createDataFrame([], "site_id bigint, page_pos int, page_url string, links array<string>, "
                                      "anchors array<struct<href: string, url: string, text: string, title: string>>")
    cands = D.doc_candidates(audit, spark.createDataFrame([], "site_id bigint, pos bigint, url string"), homes)
    rows = cands.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert sum(r["count"] for r in rows) == 400 * len(P.GUESS_PATHS)
    assert max(r["count"] for r in rows) < 400 * len(P.GUESS_PATHS) / 4


def test_link_lists_of_the_derived_crawl_meet_homepages_only(spark):
    """A host's list is as long as the host: joined to each of its pages it grew with the square, and dealt the markup by host."""
    from queries.crawl import crawl

    tree = spark_joins(crawl(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan())
    assert [keys for keys, columns in tree if "page_id" in keys and {"html", "links"} <= columns]
    assert not [keys for keys, columns in tree if "host" in keys and columns & {"html", "links"}]


def spark_joins(node):
    """(text of the condition, columns of the inputs) of every join of a plan."""
    kids = node.children()
    found = [x for i in range(kids.size()) for x in spark_joins(kids.apply(i))]
    if node.nodeName() == "Join":
        columns = {a.apply(j).name() for i in range(kids.size()) for a in [kids.apply(i).output()] for j in range(a.size())}
        found.append((node.condition().toString(), columns))
    return found
