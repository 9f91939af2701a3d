"""SimHash near-duplicates by BK-trees: 64-bit fingerprints, links within a Hamming radius, components.

Two fingerprints within the radius agree in at least `blocks - radius` of the `blocks` that their bits
are cut into. Each choice of so many blocks is a table, the bits of its blocks are the shard: every link
lies inside a shard. A shard is searched by a BK-tree: children hang under their parent by their integer
distance to it, and a search follows only edges whose distance differs from its own by the radius at
most. Trees are arrays, searched level by level for many fingerprints at once.

The trees are not broadcast: together they are as large as all fingerprints, which would pass through
the driver. A tree is built in the task that holds its shard, next to the fingerprints that search it.

* Equal fingerprints are one from the start, so groups of copies cost one entry.
* A shard of more than TREE fingerprints is dealt to several trees. Fingerprints near the shard's least
  one are linked to it, and each tree links its own. What then is not in the shard's largest component
  asks all its trees, dealt out in blocks of TREE: all links between two components are seen, and a
  tight group of near copies does not ask at all.
* A task returns a spanning forest of its links, never its pairs.

Cases: null and empty texts and texts without words have fingerprint zero and are linked like any other.
Rows without doc_id get a fingerprint, no component, and link nothing. Repeated rows and ids are linked
through their fingerprints. A very long text is a block of its own, about 20 bytes a byte of it. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U, staged, text_blocks, texts, word_windows, words
from .components import components
from .stats import UPPER

WORDS, RADIUS = 4, 4
SEED = 42
#: fingerprints of a tree, entries of a task's group, and fingerprints whose search runs at once
TREE, GROUP, ASKED = 4096, 1 << 16, 256
BLOCK = 128 << 10
#: shingles whose bits are counted at once
VOTES = 1 << 14


# ---------------------------------------------------------------- fingerprints

def fingerprints(data: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of each row."""
    data = data + UPPER[data].astype(np.uint8) * np.uint8(32)
    starts, ends, first = words(data, off)
    size = ends - starts
    begin = np.zeros(len(size) + 1, np.int64)  # words, each followed by one space
    np.cumsum(size + 1, out=begin[1:])
    joined = np.full(begin[-1], 32, np.uint8)
    held = data[~SPACE[data]]
    joined[np.arange(len(held)) + np.repeat(np.arange(len(size)), size)] = held
    n = np.diff(first)
    at, row = word_windows(first, k)
    few = np.flatnonzero((n > 0) & (n < k))
    a, b = np.concatenate([at, first[few]]), np.concatenate([at + k, first[few + 1]])
    row = np.concatenate([row, few])
    order = np.argsort(row, kind="stable")
    row, a, b = row[order], begin[a[order]], begin[b[order]] - 1
    text, digest, votes = joined.tobytes(), xxhash.xxh64_intdigest, np.zeros((len(off) - 1, 64), np.int64)
    for i in range(0, len(row), VOTES):
        spans = zip(a[i:i + VOTES].tolist(), b[i:i + VOTES].tolist(), strict=True)
        h = np.fromiter((digest(text[x:y], SEED) for x, y in spans), ">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        of = row[i:i + VOTES]
        lead = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        votes[of[lead]] += np.add.reduceat(bits, lead, axis=0, dtype=np.int32)
    total = np.where(n >= k, n - k + 1, n > 0)
    return np.packbits(2 * votes > total[:, None], axis=1).view(">u8").ravel().astype(U)


def fingerprint_table(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id and the fingerprint (f) of every row."""

    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch, size=BLOCK):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(fingerprints(data, off, k).view(np.int64))], ["doc_id", "f"])

    return texts(docs).mapInArrow(run, "doc_id long, f long")


# ---------------------------------------------------------------- trees

class Trees:
    """BK-trees over values; tree[i] is the number of the tree that holds value i."""

    def __init__(self, value: np.ndarray, tree: np.ndarray):
        self.value, n = value, len(value)
        order = np.argsort(tree, kind="stable")
        lead = order[np.append(True, tree[order][1:] != tree[order][:-1])] if n else order
        self.root = np.full(int(tree.max(initial=-1)) + 1, -1, np.int64)
        self.root[tree[lead]] = lead
        under = self.root[tree]
        todo = np.setdiff1d(np.arange(n), lead)
        edges, children = [], []
        while len(todo):  # each level: the first value at a distance becomes the child, the others go below it
            edge = under[todo] * 65 + np.bitwise_count(value[todo] ^ value[under[todo]])
            order = np.argsort(edge, kind="stable")
            todo, edge = todo[order], edge[order]
            new = np.append(True, edge[1:] != edge[:-1])
            edges.append(edge[new])
            children.append(todo[new])
            under[todo] = todo[new][np.cumsum(new) - 1]
            todo = todo[~new]
        edges, children = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, children))
        order = np.argsort(edges, kind="stable")
        self.edge, self.child = edges[order], children[order]

    def near(self, value: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into value and into the trees' values of all pairs within the radius."""
        node = np.where(tree < len(self.root), self.root[np.minimum(tree, len(self.root) - 1)], -1) if len(self.root) else np.full(len(tree), -1)
        ask = np.flatnonzero(node >= 0)
        node, asks, nodes = node[ask], [], []
        while len(ask):
            d = np.bitwise_count(value[ask] ^ self.value[node]).astype(np.int64)
            hit = d <= radius
            asks.append(ask[hit])
            nodes.append(node[hit])
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), side="right") - low
            node = self.child[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            ask = np.repeat(ask, n)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (asks, nodes))


def forest(table: pa.Table, radius: int) -> pa.Table:
    """Links between different labels in a group of trees, as few as connect what is linked.
    Rows with held are in the trees, rows with asks search them."""
    f = table.column("f").to_numpy().view(U)
    keys = table.column("tree").to_numpy()
    tree = np.unique(keys, return_inverse=True)[1]
    _, lead, label = np.unique(table.column("label").to_numpy(), return_index=True, return_inverse=True)
    comp = lead[label]
    held = np.flatnonzero(table.column("held").to_numpy(zero_copy_only=False))
    asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
    trees, found = Trees(f[held], tree[held]), []
    for i in range(0, len(asks), ASKED):
        ask = asks[i:i + ASKED]
        a, b = trees.near(f[ask], tree[ask], radius)
        a, b = ask[a], held[b]
        apart = comp[a] != comp[b]
        a, b = a[apart], b[apart]
        if not len(a):
            continue
        pairs, at = np.unique(np.stack([comp[a], comp[b]], 1), axis=0, return_index=True)
        parent: dict[int, int] = {}

        def find(x):
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        for (x, y), j in zip(pairs.tolist(), at.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[x] = y
                found.append((a[j], b[j]))
        to = np.arange(len(f))
        to[list(parent)] = [find(x) for x in parent]
        comp = to[comp]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(f[a].view(np.int64)), "b": pa.array(f[b].view(np.int64))})


# ---------------------------------------------------------------- links between all fingerprints

def tables(count: int, radius: int) -> tuple[int, int]:
    """Blocks, and how many of them make a table's key, so that shards of evenly spread fingerprints
    stay below a thousand: the links are the same with any."""
    extra = 0
    while extra < 8 and count >> (64 * (extra + 1) // (radius + 1 + extra)) > 1000:
        extra += 1
    return radius + 1 + extra, extra + 1


def shard_keys(blocks: int, chosen: int) -> list[F.Column]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in some) for some in combinations(range(blocks), chosen)]
    return [F.xxhash64(F.lit(t), F.col("f").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for t, m in enumerate(masks)]


def _grouped(entries: DataFrame, radius: int) -> DataFrame:
    """The links of entries (f, label, tree, held, asks). Trees are dealt to groups of about GROUP rows."""
    entries = staged(entries)
    groups = entries.count() // GROUP + int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.withColumn("place", F.pmod(F.xxhash64("tree"), F.lit(groups)))
    return staged(dealt.groupBy("place").applyInArrow(lambda t: forest(t, radius), "a long, b long"))


def link_labels(prints: DataFrame, radius: int = RADIUS, tree: int = TREE, blocks: tuple[int, int] | None = None) -> DataFrame:
    """f, label of every distinct fingerprint (f) that is linked with another: equal labels where a
    chain of links within the radius connects them."""
    shards = blocks or tables(prints.count(), radius)
    entries = prints.select("f", F.explode(F.array(*shard_keys(*shards))).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("f").alias("n"), F.min("f").alias("pivot")).where("n > 1")
    members = staged(entries.join(sizes, "key").withColumn("trees", F.ceil(F.col("n") / tree).cast("int"))
                     .withColumn("part", F.pmod(F.xxhash64("f"), F.col("trees")).cast("int")))
    hot = members.where("trees > 1")
    star = hot.where((F.col("f") != F.col("pivot")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("pivot"))) <= radius)).select(F.col("pivot").alias("a"), F.col("f").alias("b"))
    one = members.select("f", F.col("f").alias("label"), F.xxhash64("key", "part").alias("tree"), F.lit(True).alias("held"), F.lit(True).alias("asks"))
    links = _grouped(one, radius).union(star)
    labels = components(links).withColumnsRenamed({"node": "f"})
    if hot.isEmpty():
        return labels
    now = staged(hot.join(labels, "f", "left").withColumn("label", F.coalesce("label", "f")))
    most = now.groupBy("key", "label").count().groupBy("key").agg(
        F.max(F.struct("count", "label")).alias("m"), F.count("label").alias("labels"), F.sum("count").alias("all")).where("labels > 1")
    open_ = now.join(most, "key").withColumn("rows", F.ceil((F.col("all") - F.col("m.count")) / tree).cast("int"))
    asks = open_.where(F.col("label") != F.col("m.label")).withColumn("row", F.pmod(F.xxhash64("f", F.lit(1)), F.col("rows")).cast("int"))
    held = open_.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    asks = asks.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    place = F.xxhash64("key", "part", "row").alias("tree")
    both = held.select("f", "label", place, F.lit(True).alias("held"), F.lit(False).alias("asks")).union(
        asks.select("f", "label", place, F.lit(False).alias("held"), F.lit(True).alias("asks")))
    return components(links.union(_grouped(both, radius))).withColumnsRenamed({"node": "f"})


def near_duplicates(docs: DataFrame, k: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id that links
    reach) of every row."""
    rows = staged(fingerprint_table(docs, k))
    nodes = staged(rows.where(F.col("doc_id").isNotNull()).groupBy("f").agg(F.min("doc_id").alias("rep")))
    labels = nodes.join(link_labels(nodes.select("f"), radius), "f", "left").withColumn("label", F.coalesce("label", "f"))
    labels = staged(labels)
    first = labels.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = labels.join(first, "label").select("f", "component_id")
    out = rows.join(of, "f", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
