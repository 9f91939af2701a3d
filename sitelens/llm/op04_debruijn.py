"""Repeated word spans by a compacted de Bruijn graph.

Nodes are sequences of 12 words, edges are windows of 13. A run of edges with one anchor whose content
is the same wherever the anchor occurs has no branch: it is compacted and travels as one entry. Only
where the contents of an anchor differ, its distinct contents are cut into edges again, and each edge
gets its least document. The joins back carry anchor and content, which are recomputed at the source
coordinates of every text: a span is removed only where the text itself holds it.

Cases: null and empty texts, and texts of fewer than 13 words, lose nothing. Rows without doc_id are
kept whole and own nothing. Repeated rows and ids: equal ids are not smaller than each other, so such
rows lose only what a smaller id holds. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U, SpanHash, mix, per_row, word_windows, words
from .windows import groups, repeated_windows

WIDTH, ANCHOR_WORDS = 13, 4
WORD, EDGE = SpanHash(61), SpanHash(62)
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
CLEANED = "doc_id long, n_words long, n_removed long, text string"


def symbols(data: np.ndarray, off: np.ndarray):
    starts, ends, first = words(data, off)
    return WORD.of(WORD.prefix(data), starts, ends), first, (starts, ends)


def edge_owners(width: int):
    def resolve(h, first, n, place, sym, bounds):
        """The least document of every edge of the contents; an edge lies under one anchor."""
        at, row = word_windows(bounds, width)
        key = mix(EDGE.of(EDGE.prefix(sym), at, at + width) ^ mix(h[row]))
        order = np.argsort(key)
        begin = groups(key[order])
        size = np.diff(np.append(begin, len(key)))
        own = np.empty(len(key), np.int64)
        own[order] = np.repeat(np.minimum.reduceat(first[row[order]], begin), size)
        return own

    return resolve


def _kept(data, off, first, extra, gone):
    """Bytes of the kept words of each row, joined by one space, and the rows' bounds in them."""
    starts, ends = extra
    keep = np.flatnonzero(~gone)
    row = np.searchsorted(first, keep, side="right") - 1
    last = np.append(row[1:] != row[:-1], True) if len(keep) else np.zeros(0, bool)
    data = np.append(data, np.uint8(32))
    data[ends[keep[~last]]] = 32
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[keep]] += 1
    np.subtract.at(edge, ends[keep] + ~last, 1)
    mask = np.cumsum(edge, dtype=np.int8)[:len(data)] > 0
    return data[mask], np.append(0, np.cumsum(mask))[off]


def _counts(ids, first, gone):
    return [ids, pa.array(np.diff(first).astype(np.int64)), pa.array(per_row(gone, first))]


def _digest(ids, data, off, first, extra, gone):
    kept, at = _kept(data, off, first, extra, gone)
    sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*_counts(ids, first, gone), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cleaned(ids, data, off, first, extra, gone):
    kept, at = _kept(data, off, first, extra, gone)
    text = [kept[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*_counts(ids, first, gone), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def digests(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR_WORDS) -> DataFrame:
    return repeated_windows(docs, symbols, U, width, anchor, edge_owners(width), _digest, DIGEST)


def cleaned(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """The texts without their repeated spans."""
    return repeated_windows(docs, symbols, U, width, anchor, edge_owners(width), _cleaned, CLEANED)
