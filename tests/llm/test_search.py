import math
import random
import re
from collections import Counter

import pytest

from sitelens.llm import op12_search

from .conftest import DDL, lower

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, items, k=20):
    docs = [(i, Counter(TERM.findall(lower(t or "")))) for i, t, *_ in rows if i is not None]
    docs = [d for d in docs if d[1]]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in TERM.findall(lower(text or "")) if c[t])
            if score > 0:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(1)
    names = ["ab", "CDE", "été", "foo!", "日本", "ne", "absent", "zz%", "edited"] + [f"w{i}" for i in range(60)]
    return [(i, rng.choice([" ", "-", "\n"]).join(rng.choice(names) for _ in range(rng.choice([1, 3, 30])))) for i in range(70)] + [(98, ""), (99, None), (97, "?!")]


def got(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_search(docs, rows, items, spark):
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, item string")
    want = brute(rows, items)
    assert got(op12_search.search(docs, asked)) == want
    assert got(op12_search.search(docs, asked, 3)) == [w for w in want if w[1] <= 3]
    assert got(op12_search.search(docs, asked, block_terms=300)) == want  # several blocks of items


def test_small_blocks_and_pruning(docs, rows, items, spark, monkeypatch):
    """Many shards, contributions in many pieces: the k-th score prunes in every stage."""
    for name, value in (("BLOCK", 3000), ("DOCS", 3), ("ADDED", 50), ("BUNDLE", 8)):
        monkeypatch.setattr(op12_search, name, value)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(op12_search.search(docs, asked, 2)) == brute(rows, items, 2)


def test_cases(odd, empty, spark):
    asked = spark.createDataFrame([(1, "t1 t2 other"), (1, "t1 t2 other"), (None, "end"), (2, None)], "item_id long, text string")
    assert op12_search.search(empty, asked).count() == 0
    assert op12_search.search(odd, asked.limit(0)).count() == 0
    found = [tuple(r) for r in op12_search.search(odd, asked).collect()]
    rows = [tuple(r) for r in odd.collect()]
    want = brute(rows, [(1, "t1 t2 other"), (1, "t1 t2 other"), (0, "end")])
    assert sorted((i or 0, *r) for i, *r in found) == want and len(want) == 9
    assert op12_search.search(spark.createDataFrame([(1, "!", "e", "s", 1)], DDL), asked).count() == 0


def test_very_long_text(spark):
    rows = [(1, "common " * 3_000_000 + "rare", "e", "s", 1), (2, "common rare", "e", "s", 1), (3, "common", "e", "s", 1)]
    asked = spark.createDataFrame([(5, "rare common")], "item_id long, text string")
    assert got(op12_search.search(spark.createDataFrame(rows, DDL), asked)) == brute(rows, [(5, "rare common")])
