"""Repeated byte spans by merged Burrows-Wheeler transforms.

Windows are found by runs (windows.py); where the runs of an anchor have different contents, these
are laid out in shards of bounded size. Each shard has its own suffix order and transform. Transforms
are merged by refining their interleave: a stable pass over the merged symbols extends the order by
one symbol, and after 50 passes, or when nothing moves, all suffixes stand in the order of their
first 50 bytes, though none was sorted again. Neighbours with 50 bytes in common form the repeated
intervals; the least document of an interval owns its windows.

Bytes are those of the UTF-8 text, in which 0xFF never occurs; it ends each content.

Cases: null and empty texts, and texts of fewer than 50 bytes, lose nothing. Rows without doc_id are
kept whole and own nothing. Rows with equal ids lose only what a smaller id holds. Other columns are
not read. An empty table gives no rows. Removal may cut a character; the kept bytes are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U, SpanHash, blocks, mix, per_row
from .windows import groups, repeated_windows

WIDTH, ANCHOR_BYTES = 50, 16
END = 255
#: bytes of a shard of an anchor with many contents; bytes of contents of whole anchors, two shards that stay in the cache
SHARD, CHUNK = 512 << 10, 128 << 10
SIDE = SpanHash(71)
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a cyclic text by doubling from eight bytes on, and its transform."""
    n, length = len(text), 8
    ring, key = np.concatenate([text, np.resize(text, 8)]).astype(U), np.zeros(n, U)
    for j in range(8):
        key = key << U(8) | ring[j:j + n]
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        if rank[order[-1]] == n - 1 or length >= 2 * n:
            return order.astype(np.int32), text[order - 1]
        key = rank * n + np.roll(rank, -length % n)
        length *= 2


def interleave(a: np.ndarray, b: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which transform each place of the merged one comes from (False: a), and the merged transform."""
    z = np.zeros(len(a) + len(b), bool)
    z[len(a):] = True
    merged = np.empty(len(z), np.uint8)
    for _ in range(depth):
        merged[~z], merged[z] = a, b
        moved = z[np.argsort(merged, kind="stable")]
        if np.array_equal(moved, z):
            break
        z = moved
    merged[~z], merged[z] = a, b
    return z, merged


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """Suffix order, to the depth, of all shards: (suffix order in the whole text, transform) each."""
    while len(shards) > 1:
        pairs = []
        for i in range(0, len(shards) - 1, 2):
            (sa, a), (sb, b) = shards[i:i + 2]
            z, merged = interleave(a, b, depth)
            order = np.empty(len(z), np.int32)
            order[~z], order[z] = sa, sb
            pairs.append((order, merged))
        shards = pairs + shards[len(shards) - len(shards) % 2:]
    return shards[0][0]


def _owners(first, n, text, size, width):
    """Owners of the windows of some contents, in order. text: the contents, each ended; size: with
    their ends. An anchor that many documents share may have many contents: places are 32-bit numbers,
    and windows are compared some at a time."""
    ends = np.cumsum(size)
    begins = ends - size
    shards, a, shard = [], 0, min(SHARD, len(text) // 2 + 1)
    for b in [*np.flatnonzero(np.diff((ends - 1) // shard)) + 1, len(size)]:
        order, bwt = transform(text[begins[a]:ends[b - 1]])
        order += np.int32(begins[a])
        shards.append((order, bwt))
        a = b
    order = merge(shards, width)
    shards.clear()
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    at = np.arange(len(row)) + np.repeat(begins - (np.cumsum(n) - n), n)
    window = np.full(len(text), -1, np.int32)
    window[at] = np.arange(len(at), dtype=np.int32)
    order = order[window[order] >= 0]
    views, same = np.lib.stride_tricks.sliding_window_view(text, width), np.zeros(len(order), bool)
    for a in range(1, len(order), 1 << 15):
        part = views[order[a - 1:a + (1 << 15)]]
        same[a:a + len(part) - 1] = (part[1:] == part[:-1]).all(1)
    begin = np.flatnonzero(~same)
    which = window[order]
    least = np.minimum.reduceat(first[row[which]], begin)
    own = np.empty(len(at), np.int64)
    own[which] = np.repeat(least, np.diff(np.append(begin, len(order))))
    return own


def sharing(h: np.ndarray, place: np.ndarray, sym: np.ndarray, bounds: np.ndarray, width: int, k: int) -> np.ndarray:
    """Which contents can share a window with another of their anchor: of the width - k bytes of a
    window beside the anchor, half lie on one side of it, so equal windows agree in that many bytes
    there."""
    half = (width - k + 1) // 2
    sides = np.zeros((2, len(h)), U)
    for a, b in blocks(bounds):
        prefix, size = SIDE.prefix(sym[bounds[a]:bounds[b]]), np.diff(bounds[a:b + 1])
        anchor = bounds[a:b] - bounds[a] + place[a:b]
        for side, start, there in ((0, anchor - half, place[a:b] >= half), (1, anchor + k, place[a:b] + k + half <= size)):
            i = np.flatnonzero(there)
            sides[side, a + i] = mix(SIDE.of(prefix, start[i], start[i] + half) ^ mix(h[a + i])) | U(1)
    out = np.zeros(len(h), bool)
    for key in sides:
        i = np.flatnonzero(key)
        order = i[np.argsort(key[i])]
        same = key[order[1:]] == key[order[:-1]]
        out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def interval_owners(width: int, k: int):
    def resolve(h, first, n, place, sym, bounds):
        """Contents that cannot share a window own theirs. Of the others, anchors are independent:
        whole anchors go into chunks of CHUNK bytes, a larger anchor into a chunk of its own with
        as many shards as it needs."""
        begin, own = np.append(0, np.cumsum(n)), np.repeat(first, n)
        order = np.flatnonzero(sharing(h, place, sym, bounds, width, k))
        order = order[np.argsort(h[order], kind="stable")]
        cut = np.append(groups(h[order]), len(order))
        filled = np.append(0, np.cumsum(np.diff(bounds)[order]))
        a = 0
        while a < len(order):
            ends = cut[np.searchsorted(cut, a, side="right"):]
            b = int(ends[max(0, np.searchsorted(filled[ends], filled[a] + CHUNK, side="right") - 1)])
            ids = order[a:b]
            m, size = n[ids], np.diff(bounds)[ids] + 1
            text = np.full(size.sum(), END, np.uint8)
            for i, at in zip(ids.tolist(), (np.cumsum(size) - size).tolist(), strict=True):
                text[at:at + bounds[i + 1] - bounds[i]] = sym[bounds[i]:bounds[i + 1]]
            own[np.arange(m.sum()) + np.repeat(begin[ids] - (np.cumsum(m) - m), m)] = _owners(first[ids], m, text, size, width)
            a = b
        return own

    return resolve


def symbols(data: np.ndarray, off: np.ndarray):
    return data, off, None


def _counts(ids, off, gone):
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    inner = off[:-1][off[:-1] < len(gone)]
    head[inner] = gone[inner]
    return [ids, pa.array(np.diff(off)), pa.array(per_row(gone, off)), pa.array(per_row(head, off))]


def _digest(ids, data, off, first, extra, gone):
    kept, at = data[~gone], np.append(0, np.cumsum(~gone))[off]
    sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*_counts(ids, off, gone), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cleaned(ids, data, off, first, extra, gone):
    kept, at = data[~gone], np.append(0, np.cumsum(~gone))[off]
    rest = [kept[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*_counts(ids, off, gone), pa.array(rest, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def digests(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR_BYTES) -> DataFrame:
    return repeated_windows(docs, symbols, np.uint8, width, anchor, interval_owners(width, anchor), _digest, DIGEST)


def cleaned(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR_BYTES) -> DataFrame:
    """The bytes that are left of every text."""
    return repeated_windows(docs, symbols, np.uint8, width, anchor, interval_owners(width, anchor), _cleaned, CLEANED)
