"""SimHash fingerprints of 256 bits, and all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words (the first word also alone), weighted by their length; texts of
few words vote with their byte 4-grams as well, whose weight fades with the number of words. Each term's hash votes for or against every bit.

The search cuts fingerprints into radius + 2 blocks: of two within the radius at least two blocks are
equal. One permuted table a pair of blocks, keyed by both, finds all of them; the Hamming distance
then decides. Equal fingerprints count as one in the search, so groups of copies cost one row.

Cases: null and empty texts have no term and the fingerprint zero. Rows without doc_id have no place
in the order and no result. The next document of a row is the
next row by (doc_id, text), also among repeated ids; a single row is its own next. Other columns are
not read. An empty table gives no rows. A very long text is a block of its own, about 42 bytes a byte of
it. A bit that gets as many votes for as against is 0.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, SpanHash, blocks, mix, staged, texts, utf8, word_windows, words

BITS = 256
PARTS = [f"f{i}" for i in range(BITS // 64)]
#: texts of fewer words vote with byte 4-grams too: with weight 1 without words, with 0 from here on
FEW_WORDS = 64
#: weights are multiples of 1 / UNIT
UNIT = 32
BLOCK = 512 << 10
#: rows whose votes are counted at once
ROWS = 512
#: the bits of each byte value, highest first
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
#: of 3,000 texts (sf0.1) with one word added or taken out, the distance is at most 13 for three of four,
#: 12 for nine of ten between 256 and 512 words; unrelated texts have 101 at least
RADIUS = 12
#: ids that this divides are searched for
QUERY_EVERY = 20
WORD, TERM, GRAM = SpanHash(21), SpanHash(22), SpanHash(23)


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x 32 bytes, the fingerprints of whole texts."""
    rows = len(off) - 1
    out = np.zeros((rows, BITS // 8), np.uint8)
    for a, b in blocks(off, BLOCK):
        out[a:b] = _fingerprints(data[off[a]:off[b]], off[a:b + 1] - off[a])
    return out


def _fingerprints(data, off):
    rows = len(off) - 1
    starts, ends, first = words(data, off)
    n = np.diff(first)
    word = WORD.of(WORD.prefix(data), starts, ends)
    at, row = word_windows(first, 2)
    prefix, size = TERM.prefix(word), ends - starts
    lead = first[:-1][n > 0]
    short = np.flatnonzero(n < FEW_WORDS)
    g_off = np.concatenate([[0], np.cumsum(np.diff(off)[short])])
    g_data = np.concatenate([data[off[i]:off[i + 1]] for i in short]) if len(short) else data[:0]
    g_at, g_row = word_windows(g_off, 4)
    gram = GRAM.of(GRAM.prefix(g_data), g_at, g_at + 4)
    key = np.concatenate([TERM.of(prefix, at, at + 2), TERM.of(prefix, lead, lead + 1), gram])
    of = np.concatenate([row, np.flatnonzero(n > 0), short[g_row]])
    weight = np.concatenate([UNIT * np.minimum(1 + (size[at] + size[at + 1]) // 6, 4), UNIT * np.minimum(1 + size[lead] // 6, 4),
                             UNIT * (FEW_WORDS - n[short[g_row]]) // FEW_WORDS]).astype(np.uint8)
    if not len(key):
        return np.zeros((rows, BITS // 8), np.uint8)
    order = np.argsort(of, kind="stable")
    key, of, weight = key[order], of[order], weight[order]
    hashes = np.column_stack([mix(key ^ U(0xA5A5A5A5A5A5A5A5 * (i + 1) % 2 ** 64)) for i in range(len(PARTS))])
    hashes = hashes.view(np.uint8).reshape(len(key), BITS // 8)
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    at, bounds = of[begin], np.append(begin, len(key))
    out = np.zeros((rows, BITS // 8), np.uint8)
    for i in range(0, len(at), ROWS):
        j = min(i + ROWS, len(at))
        a, b = bounds[i], bounds[j]
        place = np.repeat(np.arange(j - i) * 256, np.diff(bounds[i:j + 1]))
        w = weight[a:b].astype(np.float64)
        against = np.add.reduceat(w, begin[i:j] - a)
        for k in range(BITS // 8):  # weights by value of the k-th byte, then by bit: sums of small integers, exact
            total = np.bincount(place + hashes[a:b, k], w, (j - i) * 256).reshape(j - i, 256) @ BITS_OF
            out[at[i:j], k] = np.packbits(2 * total > against[:, None], axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(1) / BITS


def _hex(a: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes().hex() for x in a], pa.string())


# ---------------------------------------------------------------- documents and their edits

def in_order(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, bucket, tail: buckets are ranges of doc_id, and each also ends with the row that
    follows it (tail), so that a task that reads a bucket in order sees every row's next one.
    Only the bucket bounds, a number of ids, come to the driver."""
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = docs.agg(F.min("doc_id").alias("least"),
                   F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], F.lit(100 * parts)).alias("cuts")).first()
    least = got["least"]
    cuts = sorted({c for c in got["cuts"] or [] if c is not None and c > least})
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("bucket long, follows boolean")
    def bucket(ids: pd.Series) -> pd.DataFrame:
        """The range, and whether the row begins it."""
        ids = ids.to_numpy()
        at = np.searchsorted(bounds, ids, side="right")
        return pd.DataFrame({"bucket": at, "follows": np.append(np.iinfo(np.int64).min, bounds)[at] == ids})

    own = texts(docs).where(F.col("doc_id").isNotNull()).withColumn("at", bucket("doc_id")).select("doc_id", "text", "at.*")
    tail = F.when(F.col("doc_id") == least, F.lit(len(cuts))).when(F.col("follows"), F.col("bucket") - 1)
    places = F.array(F.struct("bucket", F.lit(False).alias("tail")), F.struct(tail.alias("bucket"), F.lit(True).alias("tail")))
    return (own.select("doc_id", "text", F.explode(places).alias("p")).where(F.col("p.bucket").isNotNull())
            .select("doc_id", "text", "p.bucket", "p.tail").repartition(F.col("bucket"))
            .sortWithinPartitions("bucket", "tail", "doc_id", "text"))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Of each row: the fingerprint, that of the text whose last quarter the next row's beginning
    replaces, and both likenesses."""

    def run(batches):
        carry = None
        for batch in batches:
            if carry is not None:
                batch = pa.concat_batches([carry, batch])
            carry = batch.slice(batch.num_rows - 1)
            bucket, tail = batch.column("bucket").to_numpy(), batch.column("tail").to_numpy(zero_copy_only=False)
            _, off = utf8(batch.column("text"))
            for a, b in blocks(off[:-1]):  # rows that have a next one in the batch
                chosen = [i for i in range(a, b) if not tail[i] and bucket[i] == bucket[i + 1]]
                if not chosen:
                    continue
                own = batch.column("text").slice(a, b - a + 1).to_pylist()
                edited = []
                for i in chosen:
                    text, following = own[i - a], own[i - a + 1]
                    q = len(text) // 4
                    edited.append(text[:len(text) - q] + following[:q])
                part = fingerprints(*utf8(batch.column("text").slice(a, b - a + 1)))
                at = np.array(chosen) - a
                print_, next_, edit = part[at], part[at + 1], fingerprints(*utf8(pa.array(edited, pa.string())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(chosen)), pa.array([len(own[i - a]) for i in chosen], pa.int64()),
                     pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), _hex(print_), _hex(edit),
                     pa.array(likeness(print_, edit)), pa.array(likeness(print_, next_))],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return in_order(docs).mapInArrow(run, SCHEMA)


# ---------------------------------------------------------------- search

def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as numbers, of every text."""

    def run(batches):
        for batch in batches:
            f = fingerprints(*utf8(batch.column("text"))).view(">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in f.T)], ["doc_id", *PARTS])

    return texts(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{p} long" for p in PARTS)]))


def block_keys(radius: int) -> list[F.Column]:
    """One key for each pair of the radius + 2 blocks of bits of a fingerprint."""
    n = radius + 2
    edges = [round(BITS * i / n) for i in range(n + 1)]

    def block(i):
        out = []
        for j, part in enumerate(PARTS):  # bits 64 j .. 64 j + 63
            a, b = max(edges[i], 64 * j) - 64 * j, min(edges[i + 1], 64 * j + 64) - 64 * j
            if b > a:
                mask = ((1 << (b - a)) - 1) << a
                out.append(F.col(part).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        return out

    return [F.xxhash64(F.lit(t), *block(i), *block(j)) for t, (i, j) in enumerate(combinations(range(n), 2))]


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For each distinct fingerprint of queries, every distinct one of prints within the radius, with
    the distance: f0.., near_f0.., distance. Documents are joined back by their fingerprints. The tables
    carry 32 bits of the key and of the fingerprint; the distance is that of whole fingerprints.

    Spark takes a table of keys to be as small as the fingerprints it is made from, a row for each pair of
    blocks (91 at radius 12) too few, and would broadcast it through the driver: hence the merge join."""
    def bits32(c):
        return F.shiftright(F.shiftleft(c, 32), 32).cast("int")

    low = bits32(F.col(PARTS[0]))
    every = prints.select(*PARTS).distinct()
    keys = F.explode(F.transform(F.array(*block_keys(radius)), bits32))
    a = queries.select(*PARTS).distinct().select(*PARTS, keys.alias("key")).hint("merge")
    b = every.select(low.alias("low"), keys.alias("near_key"))
    some = a.join(b, (F.col("key") == F.col("near_key")) & (F.bit_count(low.bitwiseXOR(F.col("low")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) <= radius)).select(*PARTS, "low").distinct()
    whole = every.select(*(F.col(p).alias(f"near_{p}") for p in PARTS), low.alias("near_low"))
    distance = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"near_{p}"))) for p in PARTS), F.lit(0))
    found = some.join(whole, (F.col("low") == F.col("near_low")) & (distance <= radius))
    return found.select(*PARTS, *(f"near_{p}" for p in PARTS), distance.cast("int").alias("distance"))


def compare_and_search(docs: DataFrame, radius: int = RADIUS, every: int = QUERY_EVERY) -> DataFrame:
    """compare_edited, and for rows whose doc_id `every` divides: how many other rows lie within the
    radius (n_near) and the distance of the nearest (nearest). All rows with a fingerprint are searched."""
    def part(i):
        high, low = (F.conv(F.substring("fingerprint", 1 + 16 * i + j, 8), 16, 10).cast("long") for j in (0, 8))
        return F.shiftleft(high, 32).bitwiseOR(low)

    rows = staged(compare_edited(docs).select("*", *(part(i).alias(p) for i, p in enumerate(PARTS))), clean=True)
    asks = F.col("doc_id") % every == 0
    copies = rows.groupBy(*(F.col(p).alias(f"near_{p}") for p in PARTS)).agg(F.count("doc_id").alias("copies"))
    found = near_fingerprints(rows, rows.where(asks), radius).join(copies, [f"near_{p}" for p in PARTS])
    found = found.groupBy(*PARTS).agg((F.sum("copies") - 1).alias("n_near"), F.min(F.when((F.col("distance") > 0) | (F.col("copies") > 1), F.col("distance"))).alias("nearest"))
    got = rows.join(found, PARTS, "left")
    return got.select(*compare_names(), F.when(asks, F.col("n_near")).alias("n_near"), F.when(asks, F.col("nearest")).alias("nearest"))


def compare_names() -> list[str]:
    return [c.split()[0] for c in SCHEMA.split(", ")]


def stored_prints(docs: DataFrame) -> DataFrame:
    return staged(fingerprint_table(docs))
