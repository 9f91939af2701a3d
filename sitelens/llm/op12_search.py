"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners, rare terms to the first, common ones to the last. Items travel in bundles
through the owners one after another, as sparse accumulators of scores. A stage is a cogroup of the
bundles with the postings of one owner: it adds the integer contributions of that owner's terms to the
accumulators and passes them on; the last stage selects.

* Postings and accumulators are dealt by block of documents (one task's share of about BLOCK bytes of
  text, at most DOCS documents), so no group holds a term's postings or an item's accumulators of the
  whole corpus. Each posting is shuffled once, to the one stage that owns its term.
* An accumulator is dropped when its score and the most that the terms still to come can add lie below
  a score that the item's k-th best document has already reached: it cannot be selected any more, so
  the result is whole. The bound uses each term's largest contribution in the corpus.
* Items are searched in blocks of about `block_terms` terms, so what tasks know of the items has a
  bound; each block is a search of its own over all documents. The driver sees the terms of a block,
  their frequencies and one score an item.

Cases: null and empty texts have no terms, take no part in the statistics and are never found. Rows
without doc_id are no documents. Repeated rows and ids are documents of their own, each with a rank;
equal scores are ranked by doc_id, repeated ids among them in any order (their result rows differ in
rank only). Items without terms have no result; items with equal ids are searched each for itself. A
very long text is a block of its own. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, shared_dir, staged, text_blocks, texts, word_spans
from .stats import UPPER

TOP = 20
STAGES = 4
BLOCK, DOCS = 1 << 20, 4096
BLOCK_TERMS = 200_000
#: items of a bundle
BUNDLE = 64
#: contributions that are added at once
ADDED = 1 << 20
#: all ASCII characters but digits and letters
STOP = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
POSTINGS = ("shard long, n_docs long, n_terms long, doc_id array<long>, length array<long>, "
            "doc array<int>, term array<int>, tf array<long>")
OWNED = "owner int, shard long, doc_id array<long>, doc array<int>, term array<int>, impact array<long>"
BUNDLES = "shard long, bundle int, item array<int>, doc array<int>, score array<long>, best_item array<int>, best_score array<long>"
FOUND = "item int, doc_id long, score long"


def terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows, and the index of each row's first."""
    data = data + UPPER[data].astype(np.uint8) * np.uint8(32)
    starts, ends, first = runs(data, off, STOP)
    return word_spans(data, starts, ends), first


@dataclass
class Plan:
    """A block of items: item_of[ptr[t]:ptr[t + 1]] hold term t, times_of times each; owner, weight and
    rest[s, item] (the most that owners from s on can add to an item's score)."""

    n_items: int
    vocabulary: pa.Array
    ptr: np.ndarray
    item_of: np.ndarray
    times_of: np.ndarray
    weight: np.ndarray | None = None
    owner: np.ndarray | None = None
    rest: np.ndarray | None = None


# ---------------------------------------------------------------- items

def item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, terms, times of every item with a term. item numbers the rows."""

    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch):
                words, first = terms(data, off)
                for i in range(a, b):
                    found = words.slice(first[i - a], first[i - a + 1] - first[i - a]).value_counts()
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("item").slice(i, 1), batch.column("item_id").slice(i, 1),
                             pa.array([found.field("values").cast(pa.large_string()).to_pylist()], pa.list_(pa.string())),
                             pa.array([found.field("counts").to_pylist()], pa.list_(pa.int64()))], ["item", "item_id", "terms", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item long, item_id {kind}, terms array<string>, times array<long>")


def plan_of(rows: list) -> Plan:
    """rows: terms and times of the items of a block."""
    names = pa.array([t for r in rows for t in r.terms], pa.large_string()).cast(pa.large_binary())
    found = names.dictionary_encode()
    term = found.indices.to_numpy().astype(np.int64)
    item = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
    times = np.array([n for r in rows for n in r.times], np.int64)
    order = np.argsort(term, kind="stable")
    ptr = np.searchsorted(term[order], np.arange(len(found.dictionary) + 1))
    return Plan(len(rows), found.dictionary, ptr, item[order].astype(np.int32), times[order])


# ---------------------------------------------------------------- postings

def postings(docs: DataFrame, plan: Plan) -> DataFrame:
    """One row a block of documents: how often each document holds each term of the plan."""
    vocabulary = plan.vocabulary

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, off in text_blocks(batch, size=BLOCK):
                words, first = terms(data, off)
                known = pc.index_in(words, value_set=vocabulary)
                at = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
                row = np.searchsorted(first, at, side="right") - 1
                known = known.drop_null().to_numpy().astype(np.int64)
                for i in range(0, b - a, DOCS):
                    j = min(i + DOCS, b - a)
                    x, y = np.searchsorted(row, (i, j))
                    key, tf = np.unique((row[x:y] - i) * len(vocabulary) + known[x:y], return_counts=True)
                    n = np.diff(first[i:j + 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(task << 32) + made]), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
                         pa.ListArray.from_arrays([0, j - i], batch.column("doc_id").slice(a + i, j - i)), _list(n),
                         _list((key // len(vocabulary)).astype(np.int32)), _list((key % len(vocabulary)).astype(np.int32)), _list(tf)],
                        [c.split()[0] for c in POSTINGS.split(", ")])
                    made += 1

    return texts(docs.where(F.col("doc_id").isNotNull())).mapInArrow(run, POSTINGS)


def _list(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays([0, len(values)], pa.array(values))


def _values(batch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy()


def impacts(batch, i: int, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 25 + 25 * _values(batch, "length", i) * n_docs // n_terms
    tf = _values(batch, "tf", i)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m[_values(batch, "doc", i)])


def statistics(post: DataFrame, size: int, n_docs: int, n_terms: int) -> DataFrame:
    """df and the largest impact of each term: combined in each task, then over all."""

    def run(batches):
        df, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                term = _values(batch, "term", i)
                df += np.bincount(term, minlength=size)
                np.maximum.at(top, term, impacts(batch, i, n_docs, n_terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some]), pa.array(top[some])], ["term", "df", "top"])

    part = post.select("length", "doc", "term", "tf").mapInArrow(run, "term long, df long, top long")
    return part.groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"))


def assign(plan: Plan, stats: list, n_docs: int) -> Plan:
    """Weights, and owners by rising frequency: each owns twice the postings of the one before."""
    size = len(plan.vocabulary)
    df, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in stats:
        df[r.term], top[r.term] = r.df, r.top
    plan.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    order = np.argsort(df, kind="stable")
    share = np.cumsum(df[order]) / max(df.sum(), 1)
    plan.owner = np.zeros(size, np.int32)
    plan.owner[order] = np.searchsorted((2.0 ** np.arange(1, STAGES) - 1) / (2 ** STAGES - 1), share)
    plan.rest = np.zeros((STAGES + 1, plan.n_items), np.int64)
    most = np.repeat(plan.weight * top, np.diff(plan.ptr)) * plan.times_of
    owner = np.repeat(plan.owner, np.diff(plan.ptr))
    for s in range(STAGES):
        np.add.at(plan.rest[s], plan.item_of[owner >= s], most[owner >= s])
    return plan


def owned(post: DataFrame, plan: Plan, n_docs: int, n_terms: int) -> DataFrame:
    """Postings by owner and block, with their impact. The last owner knows the ids of the block."""
    owner = plan.owner

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, term, impact = _values(batch, "doc", i), _values(batch, "term", i), impacts(batch, i, n_docs, n_terms)
                of = owner[term]
                for s in range(STAGES):
                    mine, last = of == s, s == STAGES - 1
                    if last or mine.any():
                        ids = _values(batch, "doc_id", i)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([s], pa.int32()), batch.column("shard").slice(i, 1), _list(ids if last else ids[:0]), _list(doc[mine]), _list(term[mine]), _list(impact[mine])],
                            [c.split()[0] for c in OWNED.split(", ")])

    out = post.select("shard", "doc_id", "length", "doc", "term", "tf").mapInArrow(run, OWNED)
    path = shared_dir(post.sparkSession)
    out.write.partitionBy("owner").parquet(path)
    return post.sparkSession.read.schema(OWNED).parquet(path)


# ---------------------------------------------------------------- stages

def add(scores: np.ndarray, plan: Plan, low: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
    """The contributions of postings to the items from low on, as many as scores has columns."""
    n = plan.ptr[term + 1] - plan.ptr[term]
    gain, to = plan.weight[term] * impact, np.cumsum(n)
    a = 0
    while a < len(term):
        b = max(a + 1, int(np.searchsorted(to, (to[a - 1] if a else 0) + ADDED, side="right")))
        m = n[a:b]
        at = np.arange(m.sum()) + np.repeat(plan.ptr[term[a:b]] - (np.cumsum(m) - m), m)
        item = plan.item_of[at] - low
        mine = np.flatnonzero((item >= 0) & (item < scores.shape[1]))
        np.add.at(scores, (np.repeat(doc[a:b], m)[mine], item[mine]), np.repeat(gain[a:b], m)[mine] * plan.times_of[at[mine]])
        a = b


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column, 0 where there are fewer."""
    if len(scores) < k:
        return np.zeros(scores.shape[1], np.int64)
    return np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]


def stage(bundles: DataFrame, own: DataFrame, plan: Plan, s: int, reached: np.ndarray, k: int) -> DataFrame:
    """Bundles after owner s; after the last owner the best documents of each block."""
    last = s == STAGES - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {left.column("bundle")[i].as_py(): i for i in range(left.num_rows)}
        doc, term, impact = ((np.concatenate([_values(right, c, i) for i in range(right.num_rows)]) if right.num_rows else np.zeros(0, np.int64))
                             for c in ("doc", "term", "impact"))
        ids = np.concatenate([_values(right, "doc_id", i) for i in range(right.num_rows)]) if last else None
        n_docs = len(ids) if last else 1 + max([int(doc.max(initial=-1)), *(int(_values(left, "doc", i).max(initial=-1)) for i in held.values())])
        shard = (left if left.num_rows else right).column("shard")[0].as_py()
        rows = []
        for low in range(0, plan.n_items, BUNDLE):
            high = min(low + BUNDLE, plan.n_items)
            scores = np.zeros((n_docs, high - low), np.int64)
            if low // BUNDLE in held:
                i = held[low // BUNDLE]
                scores[_values(left, "doc", i), _values(left, "item", i) - low] = _values(left, "score", i)
            add(scores, plan, low, doc.astype(np.int64), term, impact)
            least = np.maximum(reached[low:high], kth(scores, k))
            stays = (scores > 0) & (scores + plan.rest[s + 1, low:high] >= least)
            at, item = np.nonzero(stays)
            score = scores[at, item]
            if not len(at):
                continue
            order = np.lexsort((ids[at] if last else at, -score, item))
            best = order[_place(item[order]) < k]
            best = best[score[best] >= reached[low:high][item[best]]]
            if last:
                rows.append(pa.table({"item": pa.array((item[best] + low).astype(np.int32)), "doc_id": pa.array(ids[at[best]]), "score": pa.array(score[best])}))
            else:
                rows.append(pa.table({"shard": pa.array([shard]), "bundle": pa.array([low // BUNDLE], pa.int32()), "item": _list((item + low).astype(np.int32)),
                                      "doc": _list(at.astype(np.int32)), "score": _list(score),
                                      "best_item": _list((item[best] + low).astype(np.int32)), "best_score": _list(score[best])}))
        return pa.concat_tables(rows) if rows else None

    schema = FOUND if last else BUNDLES
    empty = {c.split()[0]: [] for c in schema.split(", ")}

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        return out if out is not None else pa.table(empty, schema=_arrow(schema))

    return bundles.groupBy("shard").cogroup(own.where(F.col("owner") == s).drop("owner").groupBy("shard")).applyInArrow(group, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _place(item: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its item; equal items lie together."""
    return np.arange(len(item)) - np.searchsorted(item, item)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """item, score, rank of the k best scores of each item."""
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), *(["doc_id"] if "doc_id" in scores.columns else []))
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def thresholds(bundles: DataFrame, n_items: int, k: int) -> np.ndarray:
    """The k-th best score that each item has reached, 0 where it has fewer documents."""

    def run(batches):
        """The k best of each item in this task."""
        kept_item, kept = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                item, score = np.append(kept_item, _values(batch, "best_item", i)), np.append(kept, _values(batch, "best_score", i))
                order = np.lexsort((-score, item))
                order = order[_place(item[order]) < k]
                kept_item, kept = item[order], score[order]
        yield pa.RecordBatch.from_arrays([pa.array(kept_item), pa.array(kept)], ["item", "score"])

    best = bundles.select("best_item", "best_score").mapInArrow(run, "item int, score long")
    out = np.zeros(n_items, np.int64)
    for r in ranked(best, k).where(F.col("rank") == k).collect():
        out[r.item] = r.score
    return out


def _search(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    plan = plan_of(rows)
    post = staged(postings(docs, plan))
    n_docs, n_terms = post.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    if not n_terms:
        return None
    plan = assign(plan, statistics(post, len(plan.vocabulary), n_docs, n_terms).collect(), n_docs)
    own = owned(post, plan, n_docs, n_terms)
    bundles, reached = docs.sparkSession.createDataFrame([], BUNDLES), np.zeros(plan.n_items, np.int64)
    for s in range(STAGES):
        bundles = staged(stage(bundles, own, plan, s, reached, k))
        if s < STAGES - 1:
            reached = thresholds(bundles, plan.n_items, k)
    return ranked(bundles, k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    asked = staged(item_terms(items))
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first().n
    blocks, out = -(-total // block_terms), None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item").collect()
        found = _search(docs, rows, k) if rows else None
        if found is not None:
            kind = asked.schema["item_id"].dataType.simpleString()
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind}")
            part = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
            out = part if out is None else out.union(part)
    if out is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out
