import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitelens.llm import op13_bktree

from .conftest import DDL, WORD, lower


def fingerprint(text, k=4):
    w = WORD.findall(lower(text or ""))
    shingles = [w[i:i + k] for i in range(len(w) - k + 1)] or ([w] if w else [])
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, radius=4):
    """The least member of each value's component, by comparing all pairs."""
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {x: find(x) for x in parent}


def cloud(rng, n):
    """Tight and loose groups, chains and lonely values."""
    out = {rng.getrandbits(64) for _ in range(n // 10)} | {0, 1, (1 << 64) - 1}
    seeds = [rng.getrandbits(64) for _ in range(8)]
    while len(out) < n:
        x = rng.choice(seeds) if rng.random() < .6 else rng.choice(sorted(out))
        for _ in range(rng.choice([1, 2, 3, 5, 6, 9])):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return out


def signed(x):
    return x - (x >> 63 << 64)


@pytest.mark.parametrize("radius, tree, blocks", [(4, 4096, None), (4, 20, None), (4, 4096, (6, 2)), (2, 10, (5, 3))])
def test_components_of_fingerprints(spark, radius, tree, blocks):
    prints = cloud(random.Random(radius + tree), 700)
    df = spark.createDataFrame([(signed(x),) for x in prints], "f long").repartition(5)
    rows = op13_bktree.link_labels(df, radius, tree, blocks).collect()
    want, label = linked(prints, radius), {r.f & (1 << 64) - 1: r.label for r in rows}
    groups = {}
    for x, c in want.items():
        groups.setdefault(c, set()).add(x)
    assert set(label) == set().union(*(g for g in groups.values() if len(g) > 1))
    got = {}
    for x, c in label.items():
        got.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_trees_find_all_within_the_radius():
    rng = random.Random(4)
    values = np.array(sorted(cloud(rng, 400)), np.uint64)
    tree = np.array([rng.randrange(5) for _ in values])
    asked = np.array([int(rng.choice(values)) ^ 1 << rng.randrange(64) for _ in range(90)], np.uint64)
    of = np.array([rng.randrange(7) for _ in asked])
    got = set(zip(*(x.tolist() for x in op13_bktree.Trees(values, tree).near(asked, of, 4)), strict=True))
    assert got == {(i, j) for i, a in enumerate(asked.tolist()) for j, v in enumerate(values.tolist()) if of[i] == tree[j] and (a ^ v).bit_count() <= 4}


def test_near_duplicates(docs, rows):
    prints = {i: fingerprint(t) for i, t, *_ in rows}
    label = linked(set(prints.values()))
    least = {}
    for i, x in prints.items():
        least[label[x]] = min(i, least.get(label[x], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op13_bktree.near_duplicates(docs).collect()}
    assert got == {i: (f"{x:016x}", least[label[x]]) for i, x in prints.items()}


def test_hash_is_that_of_spark(spark):
    text = "Été  Foo bar, qux."
    r, = spark.createDataFrame([(1, text, None, None, None)], DDL).select(F.xxhash64(F.lit("Été foo bar, qux."))).collect()
    assert fingerprint(text) == r[0] & (1 << 64) - 1


def test_cases(odd, empty):
    assert op13_bktree.near_duplicates(empty).count() == 0
    got = op13_bktree.near_duplicates(odd).collect()
    assert len(got) == 7
    assert all(r.component_id is None for r in got if r.doc_id is None)
    zero = [r for r in got if r.doc_id == 2]
    assert (zero[0].fingerprint, zero[0].component_id) == ("0" * 16, 2)


def test_tables_keep_shards_small():
    assert op13_bktree.tables(10 ** 6, 4) == (5, 1) and op13_bktree.tables(10 ** 8, 4) == (6, 2)
    blocks, chosen = op13_bktree.tables(5 * 10 ** 10, 4)
    assert 5 * 10 ** 10 >> 64 * chosen // blocks <= 1000


def test_very_long_text(spark):
    words = [f"w{i % 1000}" for i in range(2_000_000)]
    rows = [(1, " ".join(words), None, None, None), (2, "\n".join(words) + " ", None, None, None), (3, " ".join(words[::-1]), None, None, None)]
    got = {r.doc_id: r for r in op13_bktree.near_duplicates(spark.createDataFrame(rows, DDL)).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint and got[2].component_id == 1
