"""Cross-entropy difference of two matched word bigram models.

The background model is counted on all texts, the target model on the texts of a target table. Both
have one vocabulary (every word of either), one order and one smoothing. A token's loss difference is
log p_background - log p_target; a text's score is its mean over its tokens: higher means closer to
the target.

No word and no pair is dropped. A token needs its pair's counts, its word's and its context's; these are
brought together without a model that one machine holds:

* words and pairs above a relative share (at most a few / share, whatever the corpus) are counted
  first and travel with the code, so no key is hot; a token whose pair is among them is scored at once;
* all other tokens are dealt out by word, or by pair where the word is a frequent one, so that a bucket
  holds every occurrence of its pairs and rare words, of all tables. It counts and scores them;
* a bucket's sums by text go back to the text.

The shares decide on the way only: scores are the same for any of them. Tokens travel in binary chunks
of a block and a bucket, frequent words as three bytes.

Cases: null and empty texts have no token and score 0. Repeated rows and ids count and are scored
each. Other columns are not read. An empty target or background is a uniform model.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, SpanHash, mix, staged, text_blocks, texts, words

#: words and pairs from these shares of tokens on are counted first
WORD_SHARE, PAIR_SHARE = 2e-6, 2e-6
#: only pairs of words from this share on are; no other pair can have a larger share
PAIR_WORD_SHARE = 1e-4
#: tokens that are dealt out together, and buckets a shuffle partition
FLUSH, BUCKETS = 1 << 20, 4
RARE = 0xFFFFFF
WORD, TEXT = SpanHash(41), SpanHash(42)
START = U(0x5851F42D4C957F2D)
FIX = U(0x9E3779B97F4A7C15)
#: tables that a token is counted or scored in
SCORED, BACKGROUND, TARGET = 1, 2, 4


def _tokens(data, off):
    """Words' hashes, their contexts (a text's first word follows the start mark), whether another word
    follows in the text, and the rows' bounds."""
    starts, ends, first = words(data, off)
    h = WORD.of(WORD.prefix(data), starts, ends)
    has = np.diff(first) > 0
    before, follows = np.empty_like(h), np.ones(len(h), bool)
    before[1:] = h[:-1]
    before[first[:-1][has]] = START
    follows[first[1:][has] - 1] = False
    return h, before, follows, first


def pair_key(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * FIX + mix(tokens))


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _tables(docs, target, background) -> list[tuple[DataFrame, int]]:
    if background is None:
        return [(docs, SCORED | BACKGROUND), (target, TARGET)]
    return [(docs, SCORED), (background, BACKGROUND), (target, TARGET)]


def _side_sums(counted: list[tuple[DataFrame, int]], keys: list[str], values: list[str]) -> DataFrame:
    """The values of each table side by side: n1 (scored), n2 (background), n4 (target), ..."""
    sides = (SCORED, BACKGROUND, TARGET)
    wide = [df.select(*keys, *(F.when(F.lit(bool(of & s)), F.col(x)).otherwise(0).alias(f"{x}{s}") for x in values for s in sides)) for df, of in counted]
    return reduce(DataFrame.unionByName, wide).groupBy(*keys).agg(*(F.sum(f"{x}{s}").alias(f"{x}{s}") for x in values for s in sides))


def count_words(docs: DataFrame) -> DataFrame:
    """h, n, m: how often each word occurs, and is followed by another; combined in batches."""

    def run(batches):
        for batch in batches:
            got = [_tokens(data, off) for _, _, data, off in text_blocks(batch)]
            h, inverse = np.unique(np.concatenate([np.zeros(0, U), *(g[0] for g in got)]), return_inverse=True)
            m = np.bincount(inverse, np.concatenate([np.zeros(0, bool), *(g[2] for g in got)]), len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(h)).astype(np.int64)), pa.array(m)], ["h", "n", "m"])

    return texts(docs).mapInArrow(run, "h long, n long, m long")


def count_pairs(docs: DataFrame, among: np.ndarray) -> DataFrame:
    """key, at, n: how often pairs of the given words (sorted hashes) and the start mark occur, and the
    second word's place."""

    def run(batches):
        known = np.sort(np.append(among, START))
        for batch in batches:
            keys, ats = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for _, _, data, off in text_blocks(batch):
                h, before, _, _ = _tokens(data, off)
                at, hot = _find(among, h)
                hot &= _find(known, before)[1]
                keys.append(pair_key(before[hot], h[hot])), ats.append(at[hot])
            key, first, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(ats)[first]), pa.array(n.astype(np.int64))], ["key", "at", "n"])

    return texts(docs).mapInArrow(run, "key long, at long, n long")


class Frequent:
    """Counts of frequent words and pairs, and the totals that all probabilities share.

    p(w | v) = (c(v, w) + weight p(w)) / (c(v) + weight), p(w) likewise from the uniform model. The
    background's counts are scaled to the target's size, so both models trust their counts alike."""

    def __init__(self, size: int, background: tuple[int, int], target: tuple[int, int], weight: float):
        """size: words of the vocabulary; of each table its tokens and its texts that have any."""
        self.size, self.weight = max(size, 1), weight
        (self.nb, starts_b), (self.nt, starts_t) = background, target
        self.scale = self.nt / self.nb if self.nb and self.nt else 1.0
        self.start = float(self.leave(np.array([starts_b]), np.array([starts_t]))[0])
        self.words = self.pairs = np.zeros(0, U)
        self.word_nb = self.word_nt = self.word_leave = self.pair_gain = np.zeros(0)

    def leave(self, cb: np.ndarray, ct: np.ndarray) -> np.ndarray:
        """What a context adds to each token after it."""
        return np.log(cb * self.scale + self.weight) - np.log(ct + self.weight)

    def gain(self, pair_b, pair_t, word_b, word_t) -> np.ndarray:
        """The rest of a token's loss difference."""
        p_t = (word_t + self.weight / self.size) / (self.nt + self.weight)
        p_b = (word_b * self.scale + self.weight / self.size) / (self.nb * self.scale + self.weight)
        return np.log(pair_t + self.weight * p_t) - np.log(pair_b * self.scale + self.weight * p_b)


def frequent(tables: list[tuple[DataFrame, int]], word_share: float, pair_share: float, pair_word_share: float, weight: float) -> Frequent:
    """What comes to the driver has at most 2 / share words and pairs."""
    counted = staged(_side_sums([(count_words(df), of) for df, of in tables], ["h"], ["n", "m"]))
    t = counted.agg(F.count_if(F.col("n2") + F.col("n4") > 0).alias("size"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns if c != "h")).first()
    model = Frequent(t["size"], (t["n2"], t["n2"] - t["m2"]), (t["n4"], t["n4"] - t["m4"]), weight)

    def hot(share):
        return ((F.col("n1") > 0) & (F.col("n1") >= share * t["n1"])) | ((F.col("n2") > 0) & (F.col("n2") >= share * t["n2"]))

    got = counted.where(hot(word_share)).toPandas()
    h = got["h"].to_numpy(np.int64).view(U)
    order = np.argsort(h)
    nb, nt, mb, mt = (got[c].to_numpy(float)[order] for c in ("n2", "n4", "m2", "m4"))
    model.words, model.word_nb, model.word_nt, model.word_leave = h[order], nb, nt, model.leave(mb, mt)
    n1, n2 = (got[c].to_numpy(float)[order] for c in ("n1", "n2"))
    often = np.flatnonzero((n1 >= max(1, pair_word_share * t["n1"])) | (n2 >= max(1, pair_word_share * t["n2"])))
    pairs = _side_sums([(count_pairs(df, model.words[often]), of) for df, of in tables], ["key", "at"], ["n"]).where(hot(pair_share)).toPandas()
    key, at = pairs["key"].to_numpy(np.int64).view(U), often[pairs["at"].to_numpy(np.int64)]
    order = np.argsort(key)
    gain = model.gain(pairs["n2"].to_numpy(float), pairs["n4"].to_numpy(float), nb[at], nt[at]) if len(at) else np.zeros(0)
    model.pairs, model.pair_gain = key[order], gain[order]
    return model


# ---------------------------------------------------------------- tokens on their way

DEALT = "bucket int, side int, rows binary, counts binary, before binary, word binary, follows binary, ids binary, null_ids binary, sizes binary, sums binary"
NAMES = [f.split()[0] for f in DEALT.split(", ")]


def _pack(rank: np.ndarray, h: np.ndarray) -> bytes:
    """Words: three bytes each, then the hashes of rare ones."""
    rank = rank.astype(np.uint32)
    return rank.astype(np.uint16).tobytes() + (rank >> 16).astype(np.uint8).tobytes() + h[rank == RARE].tobytes()


def _unpack(data: bytes, n: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank = np.frombuffer(data, np.uint16, n).astype(np.int64) | np.frombuffer(data, np.uint8, n, 2 * n).astype(np.int64) << 16
    out, rare = np.empty(n, U), rank == RARE
    out[rare] = np.frombuffer(data, np.uint8, offset=3 * n).view(U)
    out[~rare] = known[rank[~rare]]
    return rank, out


def _chunks(rows: list[list]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32()] + [pa.binary()] * (len(NAMES) - 2)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], NAMES)


def _cut(bucket: np.ndarray):
    """(bucket, places) of each bucket, in order of places."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges) if len(order) else ():
        yield int(bucket[part[0]]), part


def deal(docs: DataFrame, side: int, model: Frequent, buckets: int) -> DataFrame:
    """Chunks of tokens whose pair is not a frequent one, and of texts with what the others add up to.
    A text is known by its hash: copies have equal sums."""
    known = np.append(model.words, START)  # the start mark has the last rank

    def tokens(parts):
        row, v, w, v_rank, w_rank, follows, key = (np.concatenate(x) for x in zip(*parts))
        out = []
        for b, at in _cut((key % U(buckets)).astype(np.int32)):
            texts_, counts = _runs(row[at]) if side & SCORED else (row[:0], row[:0].astype(np.int64))
            out.append([b, side, texts_.tobytes(), counts.astype(np.uint32).tobytes(), _pack(v_rank[at], v[at]), _pack(w_rank[at], w[at]),
                        np.packbits(follows[at]).tobytes(), len(at).to_bytes(8, "little"), None, None, None])
        return _chunks(out) if out else None

    def run(batches):
        parts, waiting = [], 0
        for batch in batches:
            for a, b, data, off in text_blocks(batch):
                h, before, follows, first = _tokens(data, off)
                at, hot = _find(model.words, h)
                key = pair_key(before, h)
                p_at, scored = _find(model.pairs, key)
                text = TEXT.of(TEXT.prefix(data), off[:-1], off[1:])
                n = np.diff(first)
                if side & SCORED:
                    gains = np.zeros(len(h))
                    gains[scored] = model.pair_gain[p_at[scored]]
                    ends = hot & follows
                    gains[ends] += model.word_leave[at[ends]]
                    sums = np.diff(np.append(0, np.cumsum(gains))[first]) + np.where(n > 0, model.start, 0)
                    ids = batch.column("doc_id").slice(a, b - a)
                    null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy().astype(np.int64)
                    yield _chunks([[k, 0, text[x].tobytes(), None, None, None, None, ids[x].tobytes(), null[x].tobytes(), n[x].astype(np.int64).tobytes(), sums[x].tobytes()]
                                   for k, x in _cut((text % U(buckets)).astype(np.int32))])
                rest = ~scored
                rank = np.where(hot, at, RARE)
                v_rank = np.append(RARE, rank)[:len(h)]
                v_rank[before == START] = len(known) - 1
                parts.append((np.repeat(text, n)[rest], before[rest], h[rest], v_rank[rest], rank[rest], follows[rest], np.where(hot, key, mix(h))[rest]))
                waiting += len(parts[-1][0])
                if waiting >= FLUSH:
                    yield tokens(parts)
                    parts, waiting = [], 0
        if waiting:
            yield tokens(parts)

    return texts(docs).mapInArrow(run, DEALT)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[begin], np.diff(np.append(begin, len(x)))


def _by_bucket(batches):
    """The rows of each bucket; batches are sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["bucket"] != bucket:
                yield bucket, rows
                rows = []
            bucket = r["bucket"]
            rows.append(r)
    if rows:
        yield bucket, rows


def _sums(inverse, values, size):
    return np.bincount(inverse, values, size)


def count_and_score(dealt: DataFrame, model: Frequent, buckets: int) -> DataFrame:
    """Counts the tokens of each bucket and returns chunks of texts with their sums; those with ids pass."""
    known = np.append(model.words, START)

    def bucket_sums(rows):
        sizes = [int.from_bytes(r["ids"], "little") for r in rows]
        side = np.repeat([r["side"] for r in rows], sizes)
        v = np.concatenate([_unpack(r["before"], n, known)[1] for r, n in zip(rows, sizes)])
        rank, w = (np.concatenate(x) for x in zip(*(_unpack(r["word"], n, known) for r, n in zip(rows, sizes))))
        follows = np.concatenate([np.unpackbits(np.frombuffer(r["follows"], np.uint8), count=n) for r, n in zip(rows, sizes)])
        _, first, inverse = np.unique(pair_key(v, w), return_index=True, return_inverse=True)
        b, t, size = (side & BACKGROUND) > 0, (side & TARGET) > 0, len(first)
        # counts of the pairs' words: frequent ones are known, rare ones are all here
        rare = np.flatnonzero(rank == RARE)
        _, word = np.unique(w[rare], return_inverse=True)
        n_words = word.max(initial=-1) + 1
        leave = np.zeros(len(w))
        word_b, word_t = np.zeros(len(w)), np.zeros(len(w))
        hot = rank != RARE
        word_b[hot], word_t[hot] = model.word_nb[rank[hot]], model.word_nt[rank[hot]]
        word_b[rare], word_t[rare] = _sums(word, b[rare], n_words)[word], _sums(word, t[rare], n_words)[word]
        ends = follows[rare] > 0
        leave[rare] = model.leave(_sums(word, b[rare] & ends, n_words), _sums(word, t[rare] & ends, n_words))[word] * ends
        gain = model.gain(_sums(inverse, b, size), _sums(inverse, t, size), word_b[first], word_t[first])[inverse] + leave
        mine = (side & SCORED) > 0
        text = np.concatenate([np.repeat(np.frombuffer(r["rows"], U), np.frombuffer(r["counts"], np.uint32)) for r in rows])
        text, of = np.unique(text, return_inverse=True)
        return text, _sums(of, gain[mine], len(text))

    def merged(got):
        text, of = np.unique(np.concatenate([t for t, _ in got]), return_inverse=True)
        return text, _sums(of, np.concatenate([s for _, s in got]), len(text))

    def chunks(text, sums):
        return [[k, 1, text[x].tobytes(), None, None, None, None, None, None, None, sums[x].tobytes()] for k, x in _cut((text % U(buckets)).astype(np.int32))]

    def run(batches):
        got = []  # a text's sums in the buckets of this task become one
        for _, rows in _by_bucket(batches):
            docs, rows = [r for r in rows if not r["side"]], [r for r in rows if r["side"]]
            if docs:
                yield _chunks([[r[c] for c in NAMES] for r in docs])
            if rows:
                got.append(bucket_sums(rows))
            if sum(len(t) for t, _ in got) >= FLUSH:
                got = [merged(got)]
                if len(got[0][0]) >= FLUSH // 2:
                    yield _chunks(chunks(*got.pop()))
        if got and (out := chunks(*merged(got))):
            yield _chunks(out)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, DEALT)


def gathered(summed: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score of every text from the sums of all buckets."""

    def run(batches):
        for _, rows in _by_bucket(batches):
            text, inverse = np.unique(np.concatenate([np.frombuffer(r["rows"], U) for r in rows]), return_inverse=True)
            total = _sums(inverse, np.concatenate([np.frombuffer(r["sums"]) for r in rows]), len(text))
            docs = [r for r in rows if not r["side"]]
            ids, null, n, of = (np.concatenate([np.zeros(0, t), *(np.frombuffer(r[c], t) for r in docs)]) for c, t in
                                (("ids", np.int64), ("null_ids", bool), ("sizes", np.int64), ("rows", U)))
            at = np.searchsorted(text, of)
            copies = np.bincount(at, minlength=len(text))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(n), pa.array(total[at] / copies[at] / np.maximum(n, 1))], ["doc_id", "n_tokens", "score"])

    return summed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, n_tokens long, score double")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, word_share: float = WORD_SHARE,
                             pair_share: float = PAIR_SHARE, pair_word_share: float = PAIR_WORD_SHARE, weight: float = 8.0) -> DataFrame:
    """doc_id, n_tokens, score: the mean loss difference (background less target) of the text's tokens."""
    tables = _tables(docs, target, background)
    model = frequent(tables, word_share, pair_share, pair_word_share, weight)
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = reduce(DataFrame.unionByName, (deal(df, side, model, buckets) for df, side in tables))
    return gathered(count_and_score(dealt, model, buckets))
