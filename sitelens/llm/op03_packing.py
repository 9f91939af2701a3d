"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so an instance is a histogram of at most `capacity` counts,
whatever the number of documents. Only the histogram is solved at one place:

1. reduction: from the longest length down, a set of at most three lengths is fixed for good where it
   dominates every other set that could hold that length (nothing else fits; a pair fills the sequence
   or at most one more fits and this is the largest; at most two more fit and each is at least as
   large as what could take its place);
2. the remainder is packed best-fit decreasing, whole classes of equal sequences at a time.

The answer is a list of patterns with multiplicities. Pieces find their place by their rank among the
pieces of their length; ranks come from counts of (length, hash bucket) and row numbers inside these.

Cases: a null or empty text is the end token alone. Repeated rows and ids are packed once each (ranks
are by row). Other columns are not read. An empty table gives no pieces and no sequences.
"""

from __future__ import annotations

import base64
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, texts

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: words whose ids a Python worker keeps
CACHE = 400_000


class Encoder:
    """Token ids of texts as little-endian bytes, equal to those of the tokenizers library.

    No token crosses into a space that a word follows, so the parts between spaces are encoded once
    each and kept. Texts with runs of white space around a space, and texts that hold the special
    token's string, are encoded whole."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self.path = public_tokenizers.path(f"{name}.json")
        self.cache: dict[str, bytes | None] = {}
        self.special = None

    def _ids(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, parts) -> None:
        """Encodes new parts in one call and cuts the ids where the parts end. A part that is empty or
        starts with white space belongs to a run of white space and is kept as None."""
        good = []
        for p in parts:
            if not p or p[0].isspace():
                self.cache[p] = None
            else:
                good.append(p)
        if good:
            ids = np.array(self.plain.encode_ordinary(" " + " ".join(good)), "<u4")
            cut = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) + 1 for p in good])) + 1
            raw, a = ids.tobytes(), 0
            for p, b in zip(good, (4 * cut).tolist(), strict=True):
                self.cache[p] = raw[a:b]
                a = b

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.special is None:
                from tokenizers import Tokenizer

                self.special = Tokenizer.from_file(self.path)
            return np.array(self.special.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *parts = text.split(" ")
        if not head or head[-1].isspace():
            return self._ids(text)
        cache = self.cache
        try:
            return self._ids(head) + b"".join([cache[p] for p in parts])
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            self._learn(dict.fromkeys(p for p in parts if p not in cache))
        except TypeError:
            return self._ids(text)
        got = [cache[p] for p in parts]
        return self._ids(text) if None in got else self._ids(head) + b"".join(got)


def encoder(name: str) -> Encoder:
    """One encoder a Python worker, whatever the number of its tasks: this module travels by value, so
    what outlives a task is kept beside the worker's modules."""
    kept = sys.modules.setdefault("_sitelens_kept", types.ModuleType("_sitelens_kept")).__dict__
    if name not in kept:
        kept[name] = Encoder(name)
    return kept[name]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of every text; of a text longer than the capacity only the first may be shorter."""
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.encode(text.as_py()) + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    doc.append(i), piece.append(k), start.append(at), length.append(size)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- the instance, as a histogram

def reduce(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets and takes them off counts (by length): (lengths, how often)."""
    fixed = []

    def fix(*lengths):
        need = {s: lengths.count(s) for s in lengths}
        n = min(int(counts[s]) // k for s, k in need.items())
        for s, k in need.items():
            counts[s] -= k * n
        fixed.append((lengths, n))

    def largest(limit, taken=()):
        """The largest length of at most limit of which more are left than taken holds."""
        for s in np.flatnonzero(counts[:limit + 1])[::-1]:
            if counts[s] > taken.count(s):
                return int(s)
        return 0

    def smallest(k, taken):
        """Sum of the k smallest others; more than the capacity if there are fewer."""
        total, left = 0, k
        for s in np.flatnonzero(counts):
            n = min(left, int(counts[s]) - taken.count(s))
            total, left = total + n * int(s), left - n
            if not left:
                return total
        return capacity + 1

    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while counts[s]:
                room = capacity - s
                a = largest(room, (s,))
                if not a:
                    fix(s)
                elif a == room or smallest(2, (s,)) > room:
                    fix(s, a)
                elif smallest(3, (s,)) > room:
                    b = largest(room - a, (s, a))
                    if not b or b < largest(room // 2, (s, a)):
                        break
                    fix(s, a, b)
                else:
                    break
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing: (((length, how many), ...), number of such sequences)."""
    room: dict[int, list] = {}
    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            r = min((r for r in room if r >= s), default=0)
            if r:
                pattern, have = room[r].pop()
                if not room[r]:
                    del room[r]
            else:
                pattern, have, r = (), n, capacity
            q = min(r // s, n)
            m = min(have, n // q)
            n -= m * q
            room.setdefault(r - q * s, []).append(((*pattern, (s, q)), m))
            if pattern and have > m:
                room.setdefault(r, []).append((pattern, have - m))
    return [x for of in room.values() for x in of]


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Places by length and rank, as rows (length, first rank, first sequence, a sequence's share of
    this length, offset), in order; and the number of sequences."""
    left = counts.copy()
    patterns = [(tuple((s, lengths.count(s)) for s in dict.fromkeys(lengths)), n) for lengths, n in reduce(left, capacity)]
    patterns += best_fit(left, capacity)
    rank, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for pattern, n in patterns:
        offset = 0
        for s, q in pattern:
            rows.append((s, rank[s], sequence, q, offset))
            rank[s] += q * n
            offset += q * s
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def pack(parts: DataFrame, capacity: int = CAPACITY, buckets: int = 1024) -> DataFrame:
    """parts (a stored table with doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    part = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    cells = part.groupBy("length", "bucket").count()
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    places, _ = solve(counts, capacity)
    before = cells.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = part.withColumn("inside", inside).join(before, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).alias("rank"))
    span = int(counts.sum()) + 1
    keys = places[:, 0] * span + places[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = places[np.searchsorted(keys, length * span + rank, side="right") - 1]
            j = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(at[:, 2] + j // at[:, 3]), pa.array(at[:, 4] + j % at[:, 3] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts are encoded once; their pieces are stored, as they are read twice."""
    return pack(staged(pieces(docs, capacity, vocabulary)), capacity)
