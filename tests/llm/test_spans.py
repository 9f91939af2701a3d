import hashlib
import random

import numpy as np
import pytest

from sitelens.llm import op04_debruijn, op09_bwt, windows

from .conftest import DDL, WORD


def brute(rows, width, split):
    owner, parts = {}, [(i, split(t or "")) for i, t, *_ in rows]
    for i, t in parts:
        for j in range(len(t) - width + 1):
            k = t[j:j + width] if isinstance(t, bytes) else tuple(t[j:j + width])
            owner[k] = min(owner.get(k, i), i)
    out = {}
    for i, t in parts:
        gone = [False] * len(t)
        for j in range(len(t) - width + 1):
            k = t[j:j + width] if isinstance(t, bytes) else tuple(t[j:j + width])
            if owner[k] < i:
                gone[j:j + width] = [True] * width
        out[i] = t, gone
    return out


def test_word_spans(docs, rows):
    got = {r.doc_id: r for r in op04_debruijn.digests(docs).collect()}
    want = brute(rows, 13, WORD.findall)
    assert sum(map(sum, (g for _, g in want.values()))) > 500
    for i, (words, gone) in want.items():
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_byte_spans(docs, rows):
    got = {r.doc_id: r for r in op09_bwt.digests(docs).collect()}
    for i, (data, gone) in brute(rows, 50, str.encode).items():
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_cleaned(docs):
    cut = {r.doc_id: r for r in op04_debruijn.cleaned(docs).collect()}
    for r in op04_debruijn.digests(docs).collect():
        assert hashlib.sha256(cut[r.doc_id].text.encode()).hexdigest() == r.kept_sha256
    cut = {r.doc_id: r for r in op09_bwt.cleaned(docs).collect()}
    for r in op09_bwt.digests(docs).collect():
        assert hashlib.sha256(cut[r.doc_id].kept).hexdigest() == r.kept_sha256


@pytest.mark.parametrize("op", [op04_debruijn, op09_bwt])
def test_cases(op, odd, empty):
    assert op.digests(empty).count() == 0
    got = sorted(((r.doc_id or 0), r[1], r.n_removed) for r in op.digests(odd).collect())
    assert len(got) == 7
    # equal ids are not smaller than each other, rows without id lose nothing, 3 repeats 1
    assert [x[2] > 0 for x in got] == [False] * 6 + [True]


def test_merged_order_is_the_suffix_order():
    rng = np.random.default_rng(1)
    parts = [np.append(rng.integers(97, 100, n), 255).astype(np.uint8) for n in (40, 80, 57)]
    text, at, shards = np.concatenate(parts), 0, []
    for p in parts:
        order, bwt = op09_bwt.transform(p)
        shards.append((order + at, bwt))
        at += len(p)
    merged = op09_bwt.merge(shards, 50)
    ring = np.concatenate([np.resize(p, 4 * len(p)) for p in parts])
    begin = {i: 4 * sum(len(q) for q in parts[:j]) + i - sum(len(q) for q in parts[:j]) for j, p in enumerate(parts)
             for i in range(sum(len(q) for q in parts[:j]), sum(len(q) for q in parts[:j + 1]))}
    keys = [ring[begin[int(i)]:begin[int(i)] + 50].tobytes() for i in merged]
    assert keys == sorted(keys) and sorted(merged.tolist()) == list(range(len(text)))


def test_contents_that_share_an_anchor_only_are_not_sent(spark):
    """Twenty-four bytes that all texts have give equal anchors, but no two windows are equal."""
    rng = random.Random(3)

    def letters(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))

    unit = letters(24)
    docs = spark.createDataFrame([(i, "".join(letters(40) + unit for _ in range(20)), "en", "s", 1) for i in range(20)], DDL)

    def resolve(*contents):
        raise ValueError(f"{len(contents[0])} contents were sent")

    got = windows.repeated_windows(docs, op09_bwt.symbols, np.uint8, 50, 16, resolve, op09_bwt._digest, op09_bwt.DIGEST).collect()
    assert [r.n_removed for r in got] == [0] * 20


def test_spans_of_just_a_window_among_chance_anchors(spark):
    """Texts of two letters, where most anchors meet by chance, with planted spans of 49 to 53 bytes."""
    rng = random.Random(8)
    rows, spans = [], ["".join(rng.choices("ab", k=n)) for n in (49, 50, 51, 53)]
    for i in range(60):
        text = "".join(rng.choices("ab", k=rng.randrange(400)))
        for span in rng.sample(spans, 2):
            text = text[:(at := rng.randrange(len(text) + 1))] + span + text[at:]
        rows.append((i, text, "en", "s", 1))
    got = {r.doc_id: r for r in op09_bwt.digests(spark.createDataFrame(rows, DDL)).collect()}
    want = brute(rows, 50, str.encode)
    assert sum(sum(gone) for _, gone in want.values()) > 1000
    for i, (data, gone) in want.items():
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
