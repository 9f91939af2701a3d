"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op01_lm_scoring,
    op02_line_crf,
    op03_packing,
    op04_debruijn,
    op05_simhash,
    op06_secrets,
    op07_ranking,
    op08_mixing,
    op09_bwt,
    op10_minhash,
    op11_runs,
    op12_search,
    op13_bktree,
    oracles,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(oracles.SQL)


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


@query("op2_line_crf")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return op02_line_crf.label_lines(docs, op02_line_crf.train(docs, table(spark, sf_dir, "labels")))


@query("op7_bradley_terry")
def op7(spark, sf_dir):
    return op07_ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_best_fit_packing")
def op3(spark, sf_dir):
    return op03_packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op5_simhash")
def op5(spark, sf_dir):
    return op05_simhash.compare_and_search(table(spark, sf_dir, "documents"))


@query("op6_secret_ledger")
def op6(spark, sf_dir):
    return op06_secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op10_minhash")
def op10(spark, sf_dir):
    return op10_minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


@query("op1_cross_entropy_difference")
def op1(spark, sf_dir):
    return op01_lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))


#: target shares of tokens by domain
TARGETS = {"good": 0.9, "poor": 0.04, "toxic": 0.06}


@query("op8_soft_mixing")
def op8(spark, sf_dir):
    return op08_mixing.mix(table(spark, sf_dir, "documents"), op08_mixing.domain_labels(table(spark, sf_dir, "labels")), TARGETS)


@query("op4_de_bruijn")
def op4(spark, sf_dir):
    return op04_debruijn.digests(table(spark, sf_dir, "documents"))


@query("op9_merged_bwt")
def op9(spark, sf_dir):
    return op09_bwt.digests(table(spark, sf_dir, "documents"))


@query("op11_kruskal_runs")
def op11(spark, sf_dir):
    return op11_runs.digests(table(spark, sf_dir, "documents"))


@query("op12_term_pipeline")
def op12(spark, sf_dir):
    return op12_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_bk_tree")
def op13(spark, sf_dir):
    return op13_bktree.near_duplicates(table(spark, sf_dir, "documents"))
