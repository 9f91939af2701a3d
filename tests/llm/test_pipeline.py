import numpy as np

import corpus_pipeline
from sitelens.llm import op07_ranking, op08_mixing, op10_minhash
from sitelens.llm.common import staged, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF))
        sizes.append(out.count())
        if name != "packing":
            assert out.columns == columns
        if name == "near duplicates":
            assert op10_minhash.near_duplicates(out).where("not kept").count() == 0
        if name == "mixing":
            assert set(r.doc_id for r in docs.select("doc_id").collect()) == set(r.doc_id for r in out.select("doc_id").collect())
        docs = out
    assert before > sizes[0] > sizes[1] == sizes[2] <= sizes[3] <= sizes[4]


def test_quality_stage_keeps_clean_documents(spark):
    labels = table(spark, SF, "labels")
    kept = corpus_pipeline.quality(spark, table(spark, SF, "documents"), SF).select("doc_id").join(labels, "doc_id").toPandas()
    known = table(spark, SF, "documents").join(labels, "doc_id").toPandas()
    assert (kept.quality == 1).sum() >= 0.98 * (known.quality == 1).sum() and (kept.quality == 0).sum() <= 0.1 * (known.quality == 0).sum()


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
        assert docs.count() == 0
    assert op07_ranking.train(docs.selectExpr("doc_id", "'' AS text"), table(spark, SF, "labels")).threshold == 0.0


def test_odd_rows_pass_through(spark, odd, docs):
    """Nulls in every column, repeated rows and ids, further columns with clashing names."""
    for frame in (odd, docs):
        now, columns = frame, frame.columns
        for name, stage in corpus_pipeline.STAGES:
            now = staged(stage(spark, now, SF))
            if name != "packing":
                assert now.columns == columns
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(now.columns)
    each = {name: stage(spark, odd, SF).count() for name, stage in corpus_pipeline.STAGES if name != "quality"}
    # of seven rows one repeats another, one is a near copy of a smaller id
    assert each == {"near duplicates": 5, "secrets": 7, "mixing": each["mixing"], "packing": 7} and each["mixing"] >= 7


def test_mixing_reaches_its_shares(spark):
    """Every document stays, and what comes out has the target shares of tokens, as the classifier sees them."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), op08_mixing.domain_labels(table(spark, sf, "labels"))
    labels = labels.where("domain <> 'poor'")
    model = op08_mixing.train(docs, labels)
    out = corpus_pipeline.op08_mixing.mixed(docs, labels, corpus_pipeline.TARGETS, least=1)

    def shares(frame):
        got = op08_mixing.memberships(frame, model).toPandas()
        total = sum(n * np.array(p) for n, p in zip(got["n_tokens"], got["p"], strict=True))
        return dict(zip(model.domains, total / total.sum(), strict=True))

    before, after = shares(docs), shares(out)
    assert all(abs(after[d] - t) < 0.01 for d, t in corpus_pipeline.TARGETS.items()) and any(abs(before[d] - t) > 0.03 for d, t in corpus_pipeline.TARGETS.items())
    assert docs.select("doc_id").distinct().count() == out.select("doc_id").distinct().count()
