import hashlib
import random
import zlib

import numpy as np
import pytest

from sitelens.llm import op11_runs

from .conftest import DDL, WORD


def brute(words, exponent=4, least=6):
    """Every maximal stretch of every period, longest first period wins for one stretch."""
    n, best = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(doc, words):
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc, text):
    words = periodic(doc, WORD.findall(text or ""))
    found = brute(words)
    best = max(found, key=lambda r: (1000000007 * r[1] // r[2], -r[0], -r[2]), default=None)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(collapse(words, found).encode()).hexdigest())


def repetitive(rng):
    """Words over few symbols, with powers inside powers and cut powers."""
    out = []
    for _ in range(rng.randrange(6)):
        part = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        out += (part * rng.randrange(1, 9))[:rng.randrange(1, 60)]
        out = (out * 4)[:200] if rng.random() < .15 else out
        out += [rng.choice("abcdefgh") for _ in range(rng.randrange(5))]
    return out


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 10)])
def test_runs_against_every_period(exponent, least):
    rng = random.Random(exponent)
    rows = [repetitive(rng) for _ in range(300)] + [[], ["a"], ["a"] * 50, list("ab") * 20]
    ids = np.array([ord(w) for r in rows for w in r], np.int64)
    bounds = np.cumsum([0, *map(len, rows)])
    got = [[] for _ in rows]
    for i, *r in zip(*(x.tolist() for x in op11_runs.runs_of(ids, bounds, exponent, least)), strict=True):
        got[i].append(tuple(r))
    assert got == [brute(r, exponent, least) for r in rows]


def test_digests(docs, rows):
    got = {r.doc_id: tuple(r)[1:] for r in op11_runs.digests(docs).collect()}
    assert got == {i: digest(i, t) for i, t, *_ in rows}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 and n[0] > 0 for i, n in got.items()) > 2


def test_digests_of_repetitive_texts(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(repetitive(rng)), None, None, None) for i in range(400)]
    got = {r.doc_id: tuple(r)[1:] for r in op11_runs.digests(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {i: digest(i, t) for i, t, *_ in rows}


def test_collapsed_text_and_spans(docs, rows):
    for r in op11_runs.periodic_runs(docs).collect():
        words = WORD.findall(next(t for i, t, *_ in rows if i == r.doc_id) or "")
        assert [tuple(x) for x in r.runs] == brute(words) and r.collapsed == collapse(words, brute(words)) and r.n_words == len(words)


def test_cases(odd, empty):
    assert op11_runs.digests(empty).count() == 0
    assert len(op11_runs.digests(odd).collect()) == 7


def test_very_long_text(spark):
    """Two million words with one run over all of the first half."""
    text = " ".join(["x", "y", "z"] * 333_333 + [f"w{i}" for i in range(1_000_000)])
    r, = op11_runs.periodic_runs(spark.createDataFrame([(1, text, None, None, None)], DDL)).collect()
    assert [tuple(x) for x in r.runs] == [(0, 999_999, 3)] and r.collapsed.startswith("x y z w0 w1 ")
