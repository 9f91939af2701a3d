"""Periodic runs of words: descending-LCP Kruskal over the suffixes of each text.

The suffixes of a text are sorted by prefix doubling, which also gives the common prefix of neighbours
(LCP). Taken by decreasing LCP, these neighbour pairs unite classes of suffixes; a class is an ordered
set of word positions, the smaller set moves into the larger one. When two positions at distance d
become neighbours in a set at common prefix l >= (exponent - 1) * d, the words from the first position
on repeat with smallest period d over l + d words. Of the seeds of one run only that at its left end
counts, so each run is found once, with its whole length. Pairs with a shorter common prefix than the
shortest run needs are not united: they seed nothing.

A run lies in one text, so the job is map-only and nothing is shuffled. Words are compared as words
(exact numbers from a dictionary), never by hash.

Cases: null and empty texts have no words, no runs and the hash of no bytes. A text of any length is
one block: a task holds about 60 bytes a word of it, and 4 more for each doubling up to its longest
repeat. Of runs with equal exponent the one with the smallest start, then period, is reported. Repeated
rows each get a row. Rows without doc_id are read like others (digests() leaves their words as they
are). Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_blocks, texts, word_spans, words

EXPONENT, LEAST = 4, 6
#: words that are joined at once
PIECE = 1 << 16


def shortest(exponent: int, least: int) -> int:
    """The least common prefix that a run of that exponent and length has at its first two periods."""
    return min(max((exponent - 1) * d, least - d) for d in range(1, least + 1))


def neighbours(ids: np.ndarray, row: np.ndarray, bounds: np.ndarray, least: int):
    """Neighbours in suffix order with a common prefix of at least that many words: two positions and
    the prefix length. Suffixes end with their row."""
    n = len(ids)
    end = np.repeat(bounds[1:], np.diff(bounds))
    key = row * (int(ids.max()) + 1 if n else 1) + ids
    pos = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int32)
    levels, h, some = [], 1, pos[:0]
    old = np.zeros(n, np.int64)
    while len(pos):
        key = key[pos] if not levels else key
        at = np.arange(len(pos))
        new = np.append(True, key[1:] != key[:-1])
        group = np.append(True, old[1:] != old[:-1])
        rank = rank.copy()
        rank[pos] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank)
        pos = pos[~(new & np.append(new[1:], True))]  # positions whose window occurs again
        if h <= least:
            some = pos
        to = pos + h
        second = np.where(to < end[pos], rank[np.minimum(to, n - 1)], -1).astype(np.int64)
        key = rank[pos].astype(np.int64) * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        old = rank[pos].astype(np.int64)
        h *= 2
    some = some[np.argsort(rank[some])]
    a, b, size = some[:-1].astype(np.int64), some[1:].astype(np.int64), np.zeros(max(len(some) - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + size, b + size
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        size += same.astype(np.int64) << k
    keep = size >= least
    return a[keep], b[keep], size[keep]


def kruskal(a: np.ndarray, b: np.ndarray, size: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """Seeds (position, distance, common prefix) of positions that become neighbours in a class."""
    order = np.argsort(-size, kind="stable")
    member: dict[int, list[int]] = {}
    seeds = []
    for x, y, l in zip(a[order].tolist(), b[order].tolist(), size[order].tolist(), strict=True):
        large, small = member.get(x) or [x], member.get(y) or [y]
        if len(large) < len(small):
            large, small = small, large
        last = len(small) - 1
        for j, p in enumerate(small):
            k = bisect(large, p)
            if k and (not j or small[j - 1] < large[k - 1]):
                d = p - large[k - 1]
                if (exponent - 1) * d <= l and l + d >= least:
                    seeds.append((large[k - 1], d, l))
            if k < len(large) and (j == last or large[k] < small[j + 1]):
                d = large[k] - p
                if (exponent - 1) * d <= l and l + d >= least:
                    seeds.append((p, d, l))
        if len(large) == 1:
            member[large[0]] = large
        for p in small:
            member[p] = large
            large.insert(bisect(large, p), p)
    return seeds


def runs_of(ids: np.ndarray, bounds: np.ndarray, exponent: int, least: int):
    """row, start (in the row), length, period of every run, by row, start and period. ids: the words
    of all rows as numbers; bounds: where each row's words begin (one more entry at the end)."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    seeds = kruskal(*neighbours(ids, row, bounds, shortest(exponent, least)), exponent, least)
    at, d, l = np.array(seeds, np.int64).reshape(-1, 3).T
    first = bounds[row[at]]
    left = (at == first) | (ids[np.maximum(at - 1, 0)] != ids[np.maximum(at - 1 + d, 0)])
    at, d, l, first = at[left], d[left], l[left], first[left]
    order = np.lexsort((d, at))
    at, d, l, first = at[order], d[order], l[order], first[order]
    return row[at], at - first, l + d, d


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    return word_spans(data, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> Iterator[bytes]:
    """The chosen words, joined by one space, in pieces."""
    for i in range(0, len(chosen), PIECE):
        part = chosen[i:i + PIECE]
        size = ends[part] - starts[part] + 1
        to = np.cumsum(size)
        at = np.repeat(starts[part] - (to - size), size) + np.arange(to[-1])
        out = data[np.minimum(at, len(data) - 1)]
        out[to - 1] = 32
        yield out[:-1 if i + PIECE >= len(chosen) else None].tobytes()


def dropped(n: int, first: np.ndarray, row, start, length, period) -> np.ndarray:
    """Words inside a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    at = first[row] + start
    np.add.at(edge, at + period, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period) and collapsed: the words
    without the repetitions of each run, joined by one space."""

    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch):
                starts, ends, first = words(data, off)
                row, start, length, period = runs_of(numbered(data, starts, ends), first, exponent, least)
                keep = ~dropped(len(starts), first, row, start, length, period)
                text = [b"".join(joined(data, starts, ends, first[i] + np.flatnonzero(keep[first[i]:first[i + 1]]))).decode() for i in range(b - a)]
                each = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                bounds = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(bounds), each), pa.array(text, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


# ---------------------------------------------------------------- digests over words made periodic

def planted(ids: list, first: np.ndarray) -> np.ndarray:
    """Which word stands at each place: in every tenth text the words from place a on repeat with period p."""
    at = np.arange(first[-1])
    for i, doc in enumerate(ids):
        n = int(first[i + 1] - first[i])
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[first[i] + a:first[i + 1]] = first[i] + a + np.arange(n - a) % p
    return at


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame) -> DataFrame:
    """Of each row: the number of runs, the run with the greatest length / period, and the SHA-256 of
    all runs and of the collapsed words, after every tenth text is made periodic."""

    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch):
                ids = batch.column("doc_id").slice(a, b - a)
                starts, ends, first = words(data, off)
                at = planted(ids.to_pylist(), first)
                row, start, length, period = runs_of(numbered(data, starts, ends)[at], first, EXPONENT, LEAST)
                keep = ~dropped(len(starts), first, row, start, length, period)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                top, listed, text = [], [], []
                for i in range(b - a):
                    found = [(int(start[j]), int(length[j]), int(period[j])) for j in range(bounds[i], bounds[i + 1])]
                    best = None
                    for r in found:
                        if best is None or r[1] * best[2] > best[1] * r[2]:
                            best = r
                    top.append((len(found), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None))
                    listed.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest())
                    sha = hashlib.sha256()
                    for piece in joined(data, starts, ends, at[first[i] + np.flatnonzero(keep[first[i]:first[i + 1]])]):
                        sha.update(piece)
                    text.append(sha.hexdigest())
                columns = [ids, *(pa.array(c, pa.int64()) for c in zip(*top, strict=True)), pa.array(listed), pa.array(text)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGESTS.split(", ")])

    return texts(docs).mapInArrow(run, DIGESTS)
