"""Helpers of the corpus operators: whole-text kernels on Arrow buffers, staging, small Spark idioms.

Text kernels work on UTF-8 bytes. Every byte that separates words is ASCII, so words found in the
bytes are the words of the text. A batch is cut into blocks of half a megabyte (a longer text is a
block of its own), which bounds the arrays a task holds whatever the batch size is.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 512 << 10
#: whether Spark removes shuffle files at the end of each execution
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
U = np.uint64
#: the characters \x09-\x0D and \x20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


# ---------------------------------------------------------------- Spark side

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. A local session without that setting (tests) gets a
    temporary folder; on a cluster the setting is required, as a local folder would lose rows there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, clean: bool = False) -> DataFrame:
    """The rows of df, written once as Parquet: a lost executor rereads them, nothing is recomputed.
    clean: the write's shuffle files go with its end, not when the driver happens to collect its garbage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    old = spark.conf.get(CLEAN, None)
    if clean:
        spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEAN) if old is None else spark.conf.set(CLEAN, old)
    return spark.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null text: empty) and the named columns only: others cannot clash."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


# ---------------------------------------------------------------- bytes of a batch

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    width = np.int32 if pa.types.is_string(column.type) else np.int64
    off = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        yield a, b
        a = b


def text_blocks(batch: pa.RecordBatch, name: str = "text", size: int = BLOCK_BYTES):
    """(first row, last row + 1, bytes, offsets) of each block of the batch."""
    data, off = utf8(batch.column(name))
    for a, b in blocks(off, size):
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]


def runs(data: np.ndarray, off: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes without a stop, never over a row's end: starts, ends, and for each row
    the index of its first run (one more entry at the end)."""
    hit = stop[data]
    before, after = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    before[1:], after[:max(len(data) - 1, 0)] = hit, hit[1:]
    before[off] = True
    after[(off - 1)[off > 0]] = True
    starts = np.flatnonzero(~hit & before[:-1])
    ends = np.flatnonzero(~hit & after[:-1]) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray):
    return runs(data, off, SPACE)


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of bytes as values of one binary array."""
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=to[1:])
    held = data[covered(len(data), starts, ends - starts)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(held))])


# ---------------------------------------------------------------- hashes

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64 bits."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


class SpanHash:
    """64-bit hashes of any spans of an array of symbols, from one prefix sum of random values times
    powers of an odd multiplier (modulo 2**64)."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2 ** 63, 256, dtype=U)
        self.p = int(rng.integers(2 ** 61, 2 ** 62)) * 4 + 3 & (2 ** 64 - 1)
        self.power = self.inverse = np.ones(1, U)

    def __getstate__(self):
        """The powers are made again where the hash arrives."""
        return {"values": self.values, "p": self.p}

    def __setstate__(self, state):
        self.__dict__.update(state, power=np.ones(1, U), inverse=np.ones(1, U))

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            with np.errstate(over="ignore"):
                for name, p in (("power", self.p), ("inverse", pow(self.p, -1, 1 << 64))):
                    a = np.full(n, U(p))
                    a[0] = 1
                    setattr(self, name, np.cumprod(a))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: bytes, or words' hashes (uint64)."""
        self._grow(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, U)
        np.cumsum((self.values[symbols] if symbols.dtype == np.uint8 else symbols) * self.power[:len(symbols)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))

    def every(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """As of, of all spans of k symbols."""
        return mix((prefix[k:] - prefix[:-k]) * self.inverse[:len(prefix) - k] + U(k * 0xD6E8FEB86659FD93 % 2 ** 64))


def word_windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of k words inside a row, and the row of each. first: as from words()."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
    return at, row


def covered(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between neighbouring bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
