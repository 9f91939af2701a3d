"""Registered domains by the public suffix list (U04, U05, U13): a join, not a list inside a plan.

A rule table has one row a rule: ``key`` (the suffix without its mark), ``labels`` of the key, and ``kind``:

* ``plain`` (``co.uk``): the key is a suffix,
* ``wild`` (``*.ck``): one label more than the key is a suffix,
* ``exception`` (``!www.ck``): the key is a registered domain, its suffix one label shorter.

``host_domains`` explodes each distinct host into its tails, joins them with the rules on the key and
takes the longest suffix (an exception goes first). Row-wise predicates need no join: a site carries its
domain and the rules at or below it (``with_site_domain``), nearly always none, and a link belongs to
the site when its host ends with the domain and no rule below makes its own domain longer.
"""

from __future__ import annotations

import os
import sys
import zipfile
from functools import lru_cache
from glob import glob

import pyarrow as pa
import pyspark
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitelens.functions import urls as U
from sitelens.functions.text import let

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES = "key string, labels int, kind string"
#: the list that Spark's own HTTP client brings along
JAR, LIST = "httpclient-*.jar", "mozilla/public-suffix-list.txt"
PRIVATE = "===BEGIN PRIVATE DOMAINS==="


@F.arrow_udf(StringType())
def _punycode(names: pa.Array) -> pa.Array:
    """The ASCII form of a name with other letters, label by label."""
    def one(label):
        return label if label.isascii() else "xn--" + label.encode("punycode").decode()

    return pa.array([None if n is None else ".".join(map(one, n.split("."))) for n in names.to_pylist()], pa.string())


def suffix_rules(text: DataFrame, private: bool = False) -> DataFrame:
    """Rules out of the text of a public suffix list (one row, column value). The section of private
    names (hosting services) counts only on request. Names in other letters are known in both forms."""
    body = F.col("value") if private else F.substring_index("value", PRIVATE, 1)
    lines = text.select(F.explode(F.split(body, r"\R")).alias("line")).select(
        F.lower(F.regexp_extract("line", r"^\s*(\S*)", 1)).alias("rule")).where("rule <> '' and rule not like '//%'")
    named = lines.select(
        F.regexp_replace("rule", r"^(!|\*\.)", "").alias("name"),
        F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wild").otherwise("plain").alias("kind"))
    both = named.select(F.explode(F.array_distinct(F.array("name", F.when(F.col("name").rlike(r"[^\x00-\x7F]"), _punycode("name")).otherwise(F.col("name"))))).alias("key"), "kind")
    # a suffix of one label changes nothing: any last label is a suffix
    return both.select("key", F.size(F.split("key", r"\.")).alias("labels"), "kind").where("labels > 1 or kind <> 'plain'").distinct()


def read_suffixes(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """Rules from a file in the public suffix list's format."""
    return suffix_rules(spark.read.text(path, wholetext=True), private)


def bundled_suffixes(spark: SparkSession) -> DataFrame:
    """Rules from the list inside Spark's own jars, a snapshot of the release's date: some 7,000 rows,
    parsed once a process."""
    return spark.createDataFrame(_bundled(), RULES)


@lru_cache(maxsize=1)
def _bundled() -> list:
    spark = SparkSession.active()
    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    found = [jar for home in homes if home for jar in sorted(glob(f"{home}/jars/{JAR}"))]
    if not found:
        raise FileNotFoundError("no public suffix list among Spark's jars: pass one, from read_suffixes")
    with zipfile.ZipFile(found[0]) as jar:
        text = jar.read(LIST).decode()
    return suffix_rules(spark.createDataFrame([(text,)], "value string")).collect()


def _rules(spark: SparkSession, suffixes: DataFrame | None) -> DataFrame:
    return bundled_suffixes(spark) if suffixes is None else suffixes.select("key", "labels", "kind")


def domain_of(host: Column, size: Column) -> Column:
    """The registered domain of a host whose suffix has ``size`` labels: one label more; of a host that
    is a suffix itself, the last two."""
    parts = F.split(host, r"\.")
    take = F.least(F.size(parts), F.when(F.size(parts) > size, size + 1).otherwise(2))
    return F.when(host.rlike(U.IPV4) | host.startswith("["), host).otherwise(F.array_join(F.slice(parts, -take, take), "."))


def host_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """host, domain of every distinct host of ``hosts`` (column host). A host has few tails, so the
    tails are few rows a host; only hosts, never their pages, are shuffled."""
    rules = _rules(hosts.sparkSession, suffixes)
    each = hosts.select("host").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    tails = each.select("host", F.size(parts).alias("n"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "."))).alias("key"))
    size = F.when(F.col("kind") == "exception", 100 + F.col("labels") - 1).when(F.col("kind") == "plain", F.col("labels")).when(
        F.col("n") > F.col("labels"), F.col("labels") + 1)
    known = tails.join(rules, "key").groupBy("host").agg(F.max(size).alias("size"))
    longest = F.coalesce(F.when(F.col("size") >= 100, F.col("size") - 100).otherwise(F.col("size")), F.lit(1))
    return each.join(known, "host", "left").select("host", domain_of(F.col("host"), longest).alias("domain"))


def with_domain(df: DataFrame, url: Column, name: str, suffixes: DataFrame | None = None) -> DataFrame:
    """df with the registered domain of a URL or bare host ('' without a host); joined on the host."""
    keyed = df.withColumn("_host", U.host_or_name(url))
    found = host_domains(keyed.select(F.col("_host").alias("host")), suffixes).select(F.col("host").alias("_host"), F.col("domain").alias(name))
    return keyed.join(found, "_host", "left").withColumn(name, F.coalesce(name, F.lit(""))).drop("_host")


def with_site_domain(sites: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """sites (base_url) with domain and below: the rules at or under that domain. Sites that have them stay as they are."""
    if "below" in sites.columns:
        return sites
    rules = _rules(sites.sparkSession, suffixes)
    parts = F.split("key", r"\.")
    under = rules.select(F.struct("key", "labels", "kind").alias("rule"), F.explode(F.transform(
        F.sequence(F.lit(1), F.col("labels")), lambda k: F.array_join(F.slice(parts, -k, k), "."))).alias("domain"))
    under = under.groupBy("domain").agg(F.collect_list("rule").alias("below"))
    # a wild rule right above a domain makes it a suffix: the site's host is a suffix itself
    above = rules.where("kind = 'wild'").select(F.col("key").alias("_parent"), F.array(F.struct("key", "labels", "kind")).alias("_above"))
    none = F.array().cast(f"array<struct<{RULES}>>")
    # all but the last join is on distinct hosts: many sites may share one
    keyed = sites.drop("domain").withColumn("_host", U.host_or_name(F.col("base_url")))
    named = host_domains(keyed.select(F.col("_host").alias("host")), suffixes).withColumn("_parent", F.regexp_replace("domain", r"^[^.]*\.?", ""))
    named = named.join(under, "domain", "left").join(above, "_parent", "left").select(
        F.col("host").alias("_host"), "domain", F.concat(F.coalesce("below", none), F.coalesce("_above", none)).alias("below"))
    return keyed.join(named, "_host", "left").withColumns({"domain": F.coalesce("domain", F.lit("")), "below": F.coalesce("below", none)}).drop("_host")


def on_site(url: Column, domain: Column, below: Column) -> Column:
    """Whether the URL's registered domain is that of the site."""
    def longest(host, n):
        def size(r):
            hit = (host == r["key"]) | host.endswith(F.concat(F.lit("."), r["key"]))
            return F.when(hit, F.when(r["kind"] == "exception", 100 + r["labels"] - 1).when(r["kind"] == "plain", r["labels"]).when(n > r["labels"], r["labels"] + 1))

        return F.array_max(F.transform(below, size))

    def inside(host):
        under = (domain != "") & ((host == domain) | host.endswith(F.concat(F.lit("."), domain)))
        found = longest(host, F.size(F.split(host, r"\.")))
        found = F.when(found >= 100, found - 100).otherwise(found)
        own = F.greatest(F.coalesce(found, F.lit(1)), F.size(F.split(domain, r"\.")) - 1)
        return F.when(under & (F.size(below) > 0), domain_of(host, own) == domain).when(domain.contains("."), under).otherwise(under & (host == domain))

    return let(U.host_or_name(url), inside)


def external_domains(pages: DataFrame, base: Column, suffixes: DataFrame | None = None) -> DataFrame:
    """Foreign registered domains of every page (site_id, page_pos, links, external_resources),
    distinct, in order of first use."""
    urls = pages.select("site_id", "page_pos", U.host_or_name(base).alias("_base"), F.posexplode(F.concat("links", "external_resources")).alias("pos", "u"))
    urls = urls.withColumn("_host", U.get_host(F.col("u"))).where("_host <> ''")
    domains = host_domains(urls.select(F.explode(F.array("_host", "_base")).alias("host")), suffixes)
    own = domains.withColumnsRenamed({"host": "_base", "domain": "own"})
    first = (urls.join(domains.withColumnRenamed("host", "_host"), "_host").join(own, "_base", "left")
             .where("own is null or domain <> own").groupBy("site_id", "page_pos", "domain").agg(F.min("pos").alias("pos")))
    return first.groupBy("site_id", "page_pos").agg(
        F.expr("transform(array_sort(collect_list(struct(pos, domain))), x -> x.domain)").alias("domains"))
