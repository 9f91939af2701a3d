"""MinHash near-duplicates: universal hash minima, banding, verification, components.

Texts with equal shingle sets are one class from the start. Classes that share a band of minima are
candidates. A bucket never emits all its pairs:

1. its members are compared with one pivot, the class with the smallest document id, and the verified
   links give components;
2. where the members around a pivot still form several components, those outside the largest one are
   compared with all members around it, in tiles of bounded size: a tile counts the intersections of
   its full sets through an index and returns a spanning forest of its links, never its pairs.

A pair is verified by its signatures first (a likeness far below the threshold ends it), then exactly
on the full shingle sets of both texts. With 32 bands of 4 minima a pair at similarity 0.8 shares no
band with probability 5e-8.

Cases: texts without words have no shingle and are linked with nothing, as are rows without doc_id.
Repeated rows and ids are linked through their texts; equal texts are one class. Other columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, SpanHash, blocks, mix, staged, text_blocks, texts, utf8, word_windows, words
from .components import components
from .stats import UPPER

WORDS, PERCENT = 5, 80
BANDS, ROWS = 32, 4
#: pairs whose signatures agree less are no links: six standard deviations below the threshold
SLACK = 0.2
#: classes on either side of a tile
TILE = 512
WORD, SHINGLE = SpanHash(31), SpanHash(32)
SCHEMA = "doc_id long, text_hash long, n_shingles long, key binary, bands array<long>, signature binary"


def shingles(data: np.ndarray, off: np.ndarray, k: int):
    """Sorted distinct shingle hashes of each row, and the rows' bounds in them."""
    data = data + UPPER[data].astype(np.uint8) * np.uint8(32)
    starts, ends, first = words(data, off)
    word = WORD.of(WORD.prefix(data), starts, ends)
    n = np.diff(first)
    at, row = word_windows(first, k)
    few = np.flatnonzero((n > 0) & (n < k))
    at, to = np.concatenate([at, first[few]]), np.concatenate([at + k, first[few + 1]])
    row, h = np.concatenate([row, few]), SHINGLE.of(SHINGLE.prefix(word), at, to)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(off)))


def keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits that name a set, whatever its order."""
    out = np.zeros((len(bounds) - 1, 2), U)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for i, c in enumerate((0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)):
            out[full, i] = np.add.reduceat(mix(h ^ U(c)), bounds[full])
    return out


def minima(h: np.ndarray, bounds: np.ndarray, seed: int = 33) -> np.ndarray:
    rng = np.random.default_rng(seed)
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS) if len(full) else ():
        a, b = U(int(rng.integers(1, 2 ** 62)) * 2 + 1), U(int(rng.integers(2 ** 62)))
        out[full, i] = np.minimum.reduceat(((h * a + b) >> U(32)).astype(np.uint32), bounds[full])
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch):
                h, bounds = shingles(data, off, k)
                m, n = minima(h, bounds), np.diff(bounds)
                wide = m.astype(U).reshape(b - a, BANDS, ROWS)
                band = np.zeros((b - a, BANDS), U)
                for r in range(ROWS):
                    band = mix(band * U(0x9E3779B97F4A7C15) + wide[:, :, r] + U(1))
                band = mix(band + np.arange(BANDS, dtype=U) * U(0xD6E8FEB86659FD93))
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                raw, name = m.astype("<u2").tobytes(), keys(h, bounds).tobytes()
                width = 2 * BANDS * ROWS
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a), pa.array(n.astype(np.int64)),
                    pa.array([name[16 * i:16 * i + 16] for i in range(b - a)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[n > 0].ravel().astype(np.int64))),
                    pa.array([raw[width * i:width * (i + 1)] for i in range(b - a)], pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "key", "bands", "signature"])

    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, SCHEMA)


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures (sig_a, sig_b) agree in at least that share."""
    names = [c for c in pairs.columns if not c.startswith("sig_")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(names).filter(pa.array((a == b).mean(1) >= least))

    return pairs.mapInArrow(run, pairs.select(names).schema)


def _links(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b with text_a, text_b) whose full sets are alike enough. Texts came by document id;
    with repeated ids a row may hold another text, whose key then differs, and is left out."""

    def run(batches):
        for whole in batches:
            sizes = np.zeros(whole.num_rows + 1, np.int64)
            np.cumsum(sum(pc.binary_length(whole.column(c)).to_numpy().astype(np.int64) for c in ("text_a", "text_b")), out=sizes[1:])
            for u, v in blocks(sizes):
                yield check(whole.slice(u, v - u))

    def check(batch):
        ka, kb = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        data, off = utf8(pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]))
        h, bounds = shingles(data, off, k)
        name, n = keys(h, bounds).tobytes(), batch.num_rows
        keep = []
        for i in range(n):
            x, y = h[bounds[i]:bounds[i + 1]], h[bounds[n + i]:bounds[n + i + 1]]
            ok = name[16 * i:16 * i + 16] == ka[i] and name[16 * (n + i):16 * (n + i) + 16] == kb[i]
            both = np.concatenate([x, y])
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            keep.append(ok and 100 * inter >= percent * (len(both) - inter))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a binary, b binary").distinct()


def _forest(tile: pa.Table, k: int, percent: int) -> pa.Table:
    """Links between classes of different labels in a tile, as few as connect what is linked."""
    tile = tile.combine_chunks()
    keys_of, label, asks = (tile.column(c).to_pylist() for c in ("key", "label", "asks"))
    parts = [shingles(data, off, k) for _, _, data, off in text_blocks(tile.to_batches()[0])]
    sets = [h[bo[i]:bo[i + 1]] for h, bo in parts for i in range(len(bo) - 1)]
    # with repeated ids a row may hold another text than the class's; its key differs then
    right = [n == key for n, key in zip((n for h, bo in parts for n in _names(h, bo)), keys_of, strict=True)]
    held = [i for i, a in enumerate(asks) if not a and right[i]]
    size = np.array([len(sets[i]) for i in held])
    owner = np.repeat(np.arange(len(held)), size)
    index = np.concatenate([sets[i] for i in held]) if held else np.zeros(0, U)
    order = np.argsort(index)
    index, owner = index[order], owner[order]
    parent = {x: x for x in label}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, a in enumerate(asks):
        if not a or not right[i]:
            continue
        lo, hi = np.searchsorted(index, sets[i], "left"), np.searchsorted(index, sets[i], "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        both = np.bincount(owner[at], minlength=len(held))
        for j in np.flatnonzero(100 * both >= percent * (len(sets[i]) + size - both)):
            x, y = find(label[i]), find(label[held[j]])
            if x != y:
                parent[x] = y
                out.append((keys_of[i], keys_of[held[j]]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})


def _names(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw = keys(h, bounds).tobytes()
    return [raw[i:i + 16] for i in range(0, len(raw), 16)]


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _near_duplicates(docs, k, percent).drop("text_hash")


def _near_duplicates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    rows = staged(signatures(docs, k))
    classes = staged(rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature")))
    places = classes.select("key", "rep", F.explode("bands").alias("band"))
    shared = places.groupBy("band").agg(F.min(F.struct("rep", "key")).alias("pivot"), F.max(F.struct("rep", "key")).alias("last")).where(
        F.col("pivot") < F.col("last")).select("band", F.col("pivot.key").alias("pivot"))
    members = places.select("key", "band").join(shared, "band").where(F.col("key") != F.col("pivot"))
    tested = staged(members.select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct())
    some = staged(tested.select(F.col("a").alias("key")).union(tested.select("b")).distinct())
    held = classes.join(some, "key", "left_semi").select("key", "rep", "signature")
    body = staged(texts(docs).join(held.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))

    def verified(pairs: DataFrame) -> DataFrame:
        sig_a = held.select(F.col("key").alias("a"), F.col("rep").alias("rep_a"), F.col("signature").alias("sig_a"))
        sig_b = held.select(F.col("key").alias("b"), F.col("rep").alias("rep_b"), F.col("signature").alias("sig_b"))
        likely = _alike(pairs.join(sig_a, "a").join(sig_b, "b"), percent / 100 - SLACK)
        full = (likely.join(body.withColumnsRenamed({"doc_id": "rep_a", "text": "text_a"}), "rep_a")
                .join(body.withColumnsRenamed({"doc_id": "rep_b", "text": "text_b"}), "rep_b").select("a", "b", "text_a", "text_b"))
        return staged(_links(full, k, percent))

    links = verified(tested)
    labels = components(links)
    # around a pivot: all classes that share one of its buckets, and itself
    around = tested.select(F.col("a").alias("pivot"), F.col("b").alias("key")).union(tested.select("a", "a").distinct())
    now = staged(around.join(labels.withColumnRenamed("node", "key"), "key", "left").select("pivot", "key", F.coalesce("label", "key").alias("label")))
    most = now.groupBy("pivot", "label").count().groupBy("pivot").agg(
        F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("n"), F.count("label").alias("labels")).where("labels > 1")
    open_ = now.join(most, "pivot").withColumn("asks", F.col("label") != F.col("m.label")).withColumn("h", F.xxhash64("key"))
    rows_of, asks_of = (F.ceil(n / TILE).cast("int") for n in (F.col("n"), F.col("n") - F.col("m.count")))
    held_side = open_.select("pivot", "key", "label", F.lit(False).alias("asks"), F.pmod("h", rows_of).alias("row"), F.explode(F.sequence(F.lit(0), asks_of - 1)).alias("col"))
    asks_side = open_.where("asks").select("pivot", "key", "label", "asks", F.explode(F.sequence(F.lit(0), rows_of - 1)).alias("row"), F.pmod("h", asks_of).alias("col"))
    tiles = held_side.unionByName(asks_side).join(held.select("key", "rep"), "key").join(body.withColumnRenamed("doc_id", "rep"), "rep")
    forest = tiles.select("pivot", "row", "col", "key", "label", "asks", "text").groupBy("pivot", "row", "col").applyInArrow(
        lambda tile: _forest(tile, k, percent), "a binary, b binary")
    labels = components(links.union(staged(forest)))
    least = classes.select("key", "rep").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    first = least.groupBy("label").agg(F.min("rep").alias("component"))
    of = least.join(first, "label").select("key", "component")
    out = rows.select("doc_id", "text_hash", "n_shingles", "key").join(of, "key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that represent their components, with all columns; of rows with equal id and
    text, one."""
    kept = _near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("own_id"),
                      F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("own_hash"))
    found = own.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left_semi")
    return found.dropDuplicates(["own_id", "own_hash"]).select("row.*")
