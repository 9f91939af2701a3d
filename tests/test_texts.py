"""Steps on whole texts that are cut or shared for speed give what the plain steps give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitelens.functions import text as X

PIECES = ["lorem ipsum dolor", "é", " ", "  ", "\n\n", " ", "\xa0", "a@b.com", "x@y.ru-z@w.org", "@", "12.03.2024", "1234567890", "ИНН 7701234567", "[имя]", "[" + "a" * 45 + "]",
          "{{x}}", "____", "Ромашка", "наименование оператора", "версия 2.1", "Version: 3", "verſion 4", "5 мая 2024", "ёЁ", "cookie", "152-фз", "ао ", "г. ", "прочее", "7", ". "]
WORDS = ["cookie", "152-фз", "ао ", "г. ", "ромашка", "дата", "e-mail", "прочее"]


def texts():
    rnd = random.Random(5)
    prose = " ".join(rnd.choice("alpha beta gamma the of naïve über".split()) for _ in range(400))
    out = ["", prose, prose + " 12.03.2024", "version " + prose + " version 7"]
    for _ in range(300):
        out.append("".join(rnd.choice([*PIECES, " ", " ", prose[:rnd.randint(60, 400)]]) for _ in range(rnd.randint(1, 14))))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "i int, t string").repartition(8).cache()


def test_addresses_are_found_in_the_words_around_at(rows):
    plain = F.array_distinct(F.regexp_extract_all("t", F.lit(X.RE_EMAIL), F.lit(0)))
    assert rows.where(F.size(plain) > 0).count() > 50
    assert rows.where(~X.find_emails(F.col("t")).eqNullSafe(plain)).count() == 0


def test_whitespace_words_and_heads(rows):
    got = rows.select("t", X.normalize_for_search(F.col("t")).alias("n"), X.clean_text(F.col("t")).alias("c"), X.squeeze(F.col("t"), 40).alias("s")).withColumn(
        "w", X.found_words(F.col("n"), WORDS)).collect()
    for r in got:
        clean = " ".join(r.t.split())
        assert r.c == clean and r.n == re.sub(r"\s+", " ", r.t.lower().replace("ё", "е"))
        assert r.s == (clean if len(clean) <= 40 else clean[:39].rstrip() + "…")
        assert sorted(r.w) == sorted(w for w in WORDS if w in r.n)


def test_a_verdict_searches_the_words_of_all_items_once(spark):
    """The search of keywords stands once in the plan, not in every item's verdict."""
    from queries.dossiers import dossiers
    from sitelens.operators import checklist as C

    docs, ctx = dossiers(spark, "/root/testdata/sf0.001")
    facts = C.with_facts(docs, ctx).withColumn("placeholder", F.lit(False))
    found = C.run_checklist(facts)._jdf.queryExecution().analyzed().toString()
    assert "_found" in found and "Contains(norm" not in found.split("Generate")[1].split("\n")[0]


def test_parsed_rows_are_built_in_parts(spark):
    """Of a batch only a few rows are Python objects at a time, and the array is the same as built at once."""
    import pyarrow as pa

    from sitelens.operators import html_parse as H

    class Row(dict):
        alive = most = 0

        def __init__(self, **kw):
            super().__init__(**kw)
            Row.alive += 1
            Row.most = max(Row.most, Row.alive)

        def __del__(self):
            Row.alive -= 1

    kind = pa.struct([("i", pa.int64())])
    got = H.arrow_rows((Row(i=i) for i in range(1000)), kind)
    assert got.to_pylist() == [{"i": i} for i in range(1000)] and Row.most <= 2 * H.ROWS + 1
    assert H.arrow_rows(iter(()), kind).type == kind
