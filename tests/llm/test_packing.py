import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitelens.llm import op03_packing as P

from .conftest import DDL


def sequences(counts, capacity):
    return P.solve(np.array(counts), capacity)[1]


def fewest(lengths, capacity):
    """Exhaustive: each length goes into an open sequence or a new one."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1:]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    """What the reduction fixes belongs to a best packing: fixed sets plus the best rest are the best."""
    rng = np.random.default_rng(4)
    for _ in range(150):
        capacity = int(rng.integers(8, 20))
        lengths = sorted(rng.integers(1, capacity + 1, int(rng.integers(1, 9))).tolist(), reverse=True)
        counts = np.bincount(lengths, minlength=capacity + 1)
        left = counts.copy()
        fixed = P.reduce(left, capacity)
        assert all(sum(s) <= capacity for s, _ in fixed)
        rest = list(itertools.chain.from_iterable([s] * int(left[s]) for s in range(capacity, 0, -1)))
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)
        assert sequences(counts, capacity) <= fewest(lengths, capacity) + 1


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["a  b", "a   b ", " x", "", "a\n b", "a\n \nb", "x <|endoftext|> y", "\n\n a\t b", "é  b   c  ", "one two, three's 12 34", "  x", "a  b", " ", "tab\tsep x"]


def test_ids_are_the_tokenizers(tokenizer, rows):
    enc = P.Encoder()
    for t in [*TEXTS, *(r[1] or "" for r in rows)]:
        for _ in range(2):
            assert np.frombuffer(enc.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_packed_documents(docs, rows, tokenizer):
    got = P.pack_documents(docs, capacity=64).collect()
    places, texts = {}, {i: t or "" for i, t, *_ in rows}
    for i, parts in itertools.groupby(sorted(got, key=lambda r: (r.doc_id, r.piece)), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(texts.pop(i), add_special_tokens=False).ids, 2]
        at = 0
        for n, r in enumerate(parts):
            assert (r.piece, r.start) == (n, at) and (r.length == 64 or n == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            at += r.length
        assert at == len(ids)
    assert not texts
    for p in places.values():
        ends = list(itertools.accumulate(n for _, n in sorted(p)))
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(places) <= -(-sum(r.length for r in got) // 64) * 1.05 + 1


def test_cases(odd, empty, spark):
    assert P.pack_documents(empty).count() == 0
    got = P.pack_documents(odd).collect()
    assert len(got) == 7 and sorted(r.length for r in got if r.doc_id == 2) == [1]
    equal = spark.createDataFrame([(1, "same", "en", "s", 1)] * 50, DDL)
    at = {(r.sequence_id, r.offset) for r in P.pack_documents(equal, capacity=8).collect()}
    assert len(at) == 50
