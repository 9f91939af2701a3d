"""Windows of W symbols that also start in a document with a smaller id, for words and for bytes.

Two equal windows have the same least k-gram (their anchor). So the windows of a text fall into runs
that share an anchor, and a run, not a window, is what is shuffled: 13 words or 50 bytes of text cost
one entry of about 17 bytes, whatever the windows repeat.

Short anchors meet by chance, the more the larger the input, and most runs repeat nowhere. Of the
symbols of a window beside its anchor half lie on one side, so the runs of two equal windows agree in
the anchor and that half: their side key. Side keys of 40 bits, sorted and sent as differences of
about three bytes, first tell which runs can share a window at all; that keys may meet by chance
only lets a run pass for nothing.

1. group of documents: side keys of all runs, packed by bucket of the key.
2. bucket of the key: keys of several documents, for the groups that have them.
3. group of documents: runs with such a key as entries (anchor h, hash c of the run's content,
   document), combined and packed by bucket of h.
4. bucket of h: an anchor seen in one document only is dropped. If all runs of an anchor have one
   content, the run is decided as a whole: its owner is the least document. Otherwise one holder of
   each distinct content is asked for it.
5. group of documents: the holders send the contents asked for.
6. bucket of h: a resolver gives the least document of every window of the distinct contents.
7. group of documents: owners reach the texts by the name of (h, c), and windows with an owner below
   the text's own id are removed.

A hot window is combined per document group before each shuffle; what a bucket holds of it is at most
one entry for each content and group. Texts are shuffled once: the steps that read groups share the
exchange, as do the steps that read buckets of h.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, SpanHash, mix, text_blocks, texts, word_windows

ANCHOR, CONTENT, SIDE = SpanHash(51), SpanHash(52), SpanHash(53)
FIX = U(0x9E3779B97F4A7C15)
C_BITS = KEY_BITS = U(40)
BLOBS = "place int, blob binary"
#: bytes of text whose windows are held at once (their hashes are eight times as many: small blocks stay in the
#: processor's cache), and runs and side keys that are combined before they are sent
BLOCK, COMBINED, KEYS = 64 << 10, 1 << 18, 1 << 20


# ---------------------------------------------------------------- packed arrays

def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; integers by byte planes, which compress better."""
    parts = [(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()) for a in arrays]
    raw = pickle.dumps(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def load(blob: bytes) -> list[np.ndarray]:
    parts = pickle.loads(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))
    out = []
    for d, raw in parts:
        width = np.dtype(d).itemsize
        a = np.empty(len(raw) // width, d)
        a.view(np.uint8).reshape(-1, width)[:] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
        out.append(a)
    return out


def load_all(table: pa.Table, empty: list[np.ndarray]) -> list[np.ndarray]:
    got = [load(b) for b in table.column("blob").to_pylist()]
    return [np.concatenate([e, *(g[i] for g in got)]) for i, e in enumerate(empty)]


def sent(place: np.ndarray, arrays: list[np.ndarray]) -> pa.Table:
    """One blob a place; rows of the arrays go to their place."""
    order = np.argsort(place, kind="stable")
    place, arrays = place[order], [a[order] for a in arrays]
    cut = groups(place)
    ends = np.append(cut, len(place))[1:]
    return pa.table({"place": pa.array(place[cut].astype(np.int32)),
                     "blob": pa.array([dump(*(a[i:j] for a in arrays)) for i, j in zip(cut, ends, strict=True)], pa.binary())})


def sent_keys(place: np.ndarray, key: np.ndarray, *more: np.ndarray) -> pa.Table:
    """sent, of sorted keys, which travel as the differences within their place."""
    order = np.argsort(place, kind="stable")
    place, key = place[order], key[order]
    gap, cut = np.diff(key, prepend=U(0)), groups(place)
    gap[cut] = key[cut]
    return sent(place, [gap, *(a[order] for a in more)])


def load_keys(table: pa.Table, empty: list[np.ndarray]) -> list[np.ndarray]:
    got = [load(b) for b in table.column("blob").to_pylist()]
    return [np.concatenate([e, *(g[i] if i else np.cumsum(g[0], dtype=U) for g in got)]) for i, e in enumerate(empty)]


def groups(*keys: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))


# ---------------------------------------------------------------- runs

def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by doubling."""
    size, m = 1, x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:len(x) - w + 1], m[w - size:len(x) - size + 1]) if size < w else m


def runs(symbols: np.ndarray, first: np.ndarray, width: int, k: int):
    """Of each run of windows with one anchor: row, first window (place in symbols), windows, h, c, and
    the place of the anchor in the run."""
    at, row = word_windows(first, width)
    if not len(at):
        return row, at, at, at.astype(U), at.astype(U), at
    h = ANCHOR.every(ANCHOR.prefix(symbols), k)
    grams = np.arange(len(h))
    bits = U(len(symbols).bit_length())
    low = (U(1) << bits) - U(1)
    anchor = (window_minima((h & ~low) | grams.astype(U), width - k + 1)[at] & low).astype(np.int64)
    begin = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    n = np.diff(np.append(begin, len(at)))
    start = at[begin]
    c = CONTENT.of(CONTENT.prefix(symbols), start, start + n - 1 + width)
    return row[begin], start, n, h[anchor[begin]], c >> (U(64) - C_BITS), anchor[begin] - start


def side_keys(symbols: np.ndarray, start: np.ndarray, n: np.ndarray, place: np.ndarray, width: int, k: int) -> np.ndarray:
    """2 x runs: the keys of the anchor with the half before it, and with the half behind it; 0 where the
    run ends sooner."""
    half = (width - k + 1) // 2
    prefix, anchor = SIDE.prefix(symbols), start + place
    out = np.zeros((2, len(start)), U)
    for side, a, there in ((0, anchor - half, place >= half), (1, anchor, place + k + half <= n - 1 + width)):
        i = np.flatnonzero(there)
        out[side, i] = ((SIDE.of(prefix, a[i], a[i] + k + half) ^ U(side) * FIX) >> (U(64) - KEY_BITS)) | U(1)
    return out


Symbols = Callable[[np.ndarray, np.ndarray], tuple]
#: (symbols, their row bounds, and what the caller wants to find again)


def group_blocks(table: pa.Table, size: int = BLOCK):
    for batch in table.combine_chunks().to_batches():
        for a, b, data, off in text_blocks(batch, size=size):
            yield batch.column("doc_id").slice(a, b - a), data, off


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in the sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def name(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(c * FIX + U(1)))


Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: (h, document, windows, place of the anchor, symbols, bounds of each content in symbols) -> the least document of every window


def repeated_windows(docs: DataFrame, symbols: Symbols, dtype, width: int, k: int, resolve: Resolver, finish: Callable, schema: str,
                     buckets: int | None = None, doc_groups: int | None = None) -> DataFrame:
    """finish(ids, data, off, extra, removed symbols) -> a batch of result rows, called with every text.

    doc_groups and buckets default to once and three times the number of shuffle partitions: size
    these, as for any shuffle, so that a partition's texts fit a task. A task holds one group or bucket
    at a time."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    B, G = buckets or 3 * parts, doc_groups or parts
    base = texts(docs).withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(G)).cast("int"))
    none = [np.zeros(0, t) for t in (U, U, np.int64, np.int32, np.uint8)]
    nothing = sent(np.zeros(0, np.int32), [])

    def bucket(h):
        return ((h >> U(32)) * U(B) >> U(32)).astype(np.int32)

    def group_runs(own):
        """Runs of the rows with an id: ids, symbols, and row, start, n, h, c, place of each run."""
        for ids, data, off in group_blocks(own):
            sym, first, _ = symbols(data, off)
            found = runs(sym, first, width, k)
            known = ids.is_valid().to_numpy(zero_copy_only=False)[found[0]]
            yield ids.fill_null(0).to_numpy(), sym, [x[known] for x in found]

    def in_parts(got, most, pack):
        """What pack makes of the arrays, some rows at a time."""
        out, held, size = [nothing], [], 0
        for x in got:
            held.append(x)
            size += len(x[0])
            if size >= most:
                out.append(pack(*map(np.concatenate, zip(*held, strict=True))))
                held, size = [], 0
        if size:
            out.append(pack(*map(np.concatenate, zip(*held, strict=True))))
        return pa.concat_tables(out)

    def sides(key, own):
        """Side keys of the group, and whether several of its documents have them."""

        def found():
            for ids, sym, (row, start, n, _, _, place) in group_runs(own):
                both = side_keys(sym, start, n, place, width, k)
                for side in both:
                    i = np.flatnonzero(side)
                    yield side[i], ids[row[i]]

        def pack(side, doc):
            order = np.argsort(side)
            side, doc = side[order], doc[order]
            at = groups(side)
            if not len(at):
                return nothing
            several = (np.maximum.reduceat(doc, at) > np.minimum.reduceat(doc, at)).astype(np.uint8)
            side = side[at]
            return sent_keys(bucket(side << (U(64) - KEY_BITS)), side, several, np.full(len(at), key[0].as_py(), np.int32))

        return in_parts(found(), KEYS, pack)

    def repeated(table):
        """Side keys of several documents, for the groups that have them."""
        side, several, g = load_keys(table, [none[0], none[4], none[3]])
        order = np.argsort(side)
        side, several, g = side[order], several[order], g[order]
        at = groups(side)
        if not len(at):
            return nothing
        size = np.diff(np.append(at, len(side)))
        hit = np.repeat((size > 1) | (np.maximum.reduceat(several, at) > 0), size)
        return sent_keys(g[hit], side[hit])

    def entries(key, own, shared):
        """Runs of the group that can share a window with another document's."""
        known = np.unique(load_keys(shared, none[:1])[0])

        def found():
            for ids, sym, (row, start, n, h, c, place) in group_runs(own) if len(known) else ():
                keep = np.any([find(known, side)[1] for side in side_keys(sym, start, n, place, width, k)], axis=0)
                yield h[keep], c[keep], ids[row[keep]]

        def pack(h, c, doc):
            order = np.lexsort((doc, c, h))
            h, c, doc = h[order], c[order], doc[order]
            at = groups(h, c)
            if not len(at):
                return nothing
            most = doc[np.append(at, len(h))[1:] - 1]
            g = np.full(len(at), key[0].as_py(), np.int32)
            return sent(bucket(h[at]), [h[at], c[at], doc[at], g, (most > doc[at]).astype(np.uint8)])

        return in_parts(found(), COMBINED, pack)

    def seen(table):
        """Entries of anchors in several documents, sorted by (h, c), with begins of anchors, the least
        document by anchor, and whether the anchor has several contents."""
        h, c, doc, g, many = load_all(table, none)
        order = np.argsort(h, kind="stable")
        h, c, doc, g, many = h[order], c[order], doc[order], g[order], many[order]
        at = groups(h)
        if not len(at):
            return h, c, doc, g, many, doc, np.zeros(0, bool)
        size = np.diff(np.append(at, len(h)))
        lo = np.repeat(np.minimum.reduceat(doc, at), size)
        branch = np.repeat(np.minimum.reduceat(c, at) != np.maximum.reduceat(c, at), size)
        several = np.repeat((np.maximum.reduceat(doc, at) > lo[at]) | (np.maximum.reduceat(many, at) > 0), size)
        return tuple(x[several] for x in (h, c, doc, g, many, lo, branch))

    def whole(table):
        """Owners of anchors with one content, for the groups that hold a later document."""
        h, c, doc, g, many, lo, branch = seen(table)
        keep = ~branch & ((doc > lo) | (many > 0))
        key, g, lo = name(h[keep], c[keep]), g[keep], lo[keep]
        order = np.argsort(key)
        return sent(g[order], [key[order], np.zeros(len(key), np.uint8), lo[order]])

    def distinct(h, c, doc, g):
        order = np.lexsort((doc, c, h))
        h, c, doc, g = h[order], c[order], doc[order], g[order]
        at = groups(h, c)
        return h[at], c[at], doc[at], g[at]

    def asked(table):
        """For each distinct content of the other anchors: its least document, in its group, is asked."""
        h, c, doc, g, _, _, branch = seen(table)
        h, c, doc, g = distinct(*(x[branch] for x in (h, c, doc, g)))
        return sent(g, [h, c, doc])

    def contents(key, own, want):
        h, c, doc = load_all(want, none[:3])
        wanted = np.sort(name(h, c))
        out = []
        holders = own.filter(pc.is_in(own.column("doc_id"), value_set=pa.array(np.unique(doc), pa.int64())))
        for _, sym, (_, start, n, rh, rc, place) in group_runs(holders):
            at, hit = find(wanted, name(rh, rc))
            hit = np.flatnonzero(hit)
            hit = hit[np.unique(at[hit], return_index=True)[1]]
            for i in hit:
                out.append((rh[i], rc[i], n[i], place[i], sym[start[i]:start[i] + n[i] - 1 + width]))
            wanted = np.delete(wanted, at[hit])
            if not len(wanted):
                break
        if not out:
            return nothing
        h, c = np.array([x[0] for x in out], U), np.array([x[1] for x in out], U)
        place, rows = bucket(h), {}
        for i, p in enumerate(place.tolist()):
            rows.setdefault(p, []).append(i)
        return pa.table({"place": pa.array(list(rows), pa.int32()), "blob": pa.array(
            [dump(h[r], c[r], *(np.array([out[i][j] for i in r], np.uint8) for j in (2, 3)), np.concatenate([out[i][4] for i in r])) for r in rows.values()], pa.binary())})

    def owners(key, stored, table):
        """Least documents of the windows of all contents of the bucket, for the groups that hold them."""
        h, c, n, place, sym = load_all(stored, [*none[:2], np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, dtype)])
        if not len(h):
            return nothing
        eh, ec, edoc, eg, emany, _, branch = seen(table)
        eh, ec, edoc, eg, emany = (x[branch] for x in (eh, ec, edoc, eg, emany))
        bounds = np.append(0, np.cumsum(n.astype(np.int64) - 1 + width))
        order = np.argsort(name(h, c))
        first = np.full(len(h), np.iinfo(np.int64).max)
        at, hit = find(name(h, c)[order], name(eh, ec))
        at, eh, ec, edoc, eg, emany = order[at[hit]], *(x[hit] for x in (eh, ec, edoc, eg, emany))
        np.minimum.at(first, at, edoc)
        own = resolve(h, first, n.astype(np.int64), place.astype(np.int64), sym, bounds)
        begin = np.append(0, np.cumsum(n.astype(np.int64)))
        least = np.minimum.reduceat(own, begin[:-1])
        keep = (edoc > least[at]) | (emany > 0)
        at, key, eg = at[keep], name(eh, ec)[keep], eg[keep]
        order = np.lexsort((key, eg))
        at, key, eg = at[order], key[order], eg[order]
        cut = groups(eg)
        ends, blobs = np.append(cut, len(eg))[1:], []
        for i, j in zip(cut, ends, strict=True):
            m = n[at[i:j]].astype(np.int64)
            take = np.repeat(begin[at[i:j]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            blobs.append(dump(key[i:j], n[at[i:j]], own[take]))
        return pa.table({"place": pa.array(eg[cut].astype(np.int32)), "blob": pa.array(blobs, pa.binary())})

    def remove(key, own, answers):
        keys, n, who = load_all(answers, [none[0], none[4], none[2]])
        span = np.maximum(n.astype(np.int64), 1)
        begin = np.cumsum(span) - span
        order = np.argsort(keys)
        keys, begin, single = keys[order], begin[order], (n == 0)[order]
        out = []
        for ids, data, off in group_blocks(own):
            sym, first, extra = symbols(data, off)
            row, start, m, rh, rc, _ = runs(sym, first, width, k)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            mine = ids.fill_null(0).to_numpy()[row]
            at, hit = find(keys, name(rh, rc))
            r = np.flatnonzero(hit & known[row])
            at, count = at[r], m[r]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner = who[np.repeat(begin[at], count) + np.where(np.repeat(single[at], count), 0, inside)]
            lost = owner < np.repeat(mine[r], count)
            edge = np.zeros(len(sym) + 1, np.int64)
            place = (np.repeat(start[r], count) + inside)[lost]
            np.add.at(edge, place, 1)
            np.add.at(edge, place + width, -1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append(finish(ids, data, off, first, extra, gone))
        return pa.Table.from_batches(out)

    shared = base.groupBy("place").applyInArrow(sides, BLOBS).groupBy("place").applyInArrow(repeated, BLOBS)
    packed = base.groupBy("place").cogroup(shared.groupBy("place")).applyInArrow(entries, BLOBS)
    asks = packed.groupBy("place").applyInArrow(asked, BLOBS)
    held = base.groupBy("place").cogroup(asks.groupBy("place")).applyInArrow(contents, BLOBS)
    solved = held.groupBy("place").cogroup(packed.groupBy("place")).applyInArrow(owners, BLOBS)
    answers = packed.groupBy("place").applyInArrow(whole, BLOBS).union(solved)
    return base.groupBy("place").cogroup(answers.groupBy("place")).applyInArrow(remove, schema)
