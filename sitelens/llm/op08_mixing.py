"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives every text posteriors p over domains. Rates r >= 0
of documents minimise

    1/2 e' W e + mu/2 sum_d n_d / N (r_d - 1)^2,   e_k = sum_d n_d r_d p_dk / N - t_k

(n_d tokens of document d, N of all, t_k target shares) by accelerated projected gradient. W is the
inverse of the memberships' products, which makes the steps converge alike for large and small domains. A
gradient step needs of other documents only the domain totals: each iteration is one aggregate to K
numbers. A rate follows from its posteriors and the residuals so far, so no rates are stored or
shuffled between iterations.

Cases: a null or empty text has no token, its posteriors are the classifier's for no words. Repeated
rows and ids get a rate each. A document labelled twice has the first label by name. Other columns
are not read. Without labels, or with one domain, all rates are those of one domain with posterior 1.
An empty table gives no rows. Rows with equal posteriors get equal rates. A very long text is a block of
its own, about 27 bytes a byte of it. Targets of unknown domains are left out, and the rest is scaled to sum 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix as finish
from .common import staged, text_blocks, texts
from .stats import N_TEXT, Counts

#: labelled documents that training reads at most, and signal words of a domain
TRAIN_ROWS, SIGNALS = 20_000, 24
MU, STEPS, CLOSE = 1e-3, 40, 1e-3


class Classifier:
    """Softmax regression on the counts of a text and on the presence of signal words (hashes)."""

    def __init__(self, domains: list[str], signals: np.ndarray, center: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.domains, self.signals, self.center, self.scale, self.weights = domains, signals, center, scale, weights

    def posteriors(self, c: Counts) -> np.ndarray:
        z = (design(c, self.signals) - self.center) / self.scale @ self.weights[:-1] + self.weights[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def design(c: Counts, signals: np.ndarray) -> np.ndarray:
    """The features of a block of texts: counts, then which signal words (sorted hashes) occur."""
    there = np.zeros((len(c.n_words), len(signals)))
    if len(signals):
        at = np.minimum(np.searchsorted(signals, c.word_hash), len(signals) - 1)
        hit = signals[at] == c.word_hash
        there[np.repeat(np.arange(len(c.n_words)), c.n_words)[hit], at[hit]] = 1
    return np.column_stack([c.text_features(), there])


def fit(x: np.ndarray, y: np.ndarray, domains: list[str], signals: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> Classifier:
    n = N_TEXT + len(signals)
    center, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(n), np.ones(n))
    z = np.column_stack([(x - center) / scale, np.ones(len(x))])
    w, m, v = np.zeros((n + 1, len(domains))), 0.0, 0.0
    truth = np.eye(len(domains))[y]
    for i in range(1, steps + 1) if len(domains) > 1 else ():
        p = z @ w
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ (p - truth) / len(z) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
    return Classifier(domains, signals, center, scale, w)


def signal_words(known: DataFrame, sizes: dict[str, int], each: int = SIGNALS, least: int = 5) -> np.ndarray:
    """Hashes of the words whose presence speaks most for each domain: n log(share there / share)."""

    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch):
                c = Counts(data, off)
                row = np.repeat(np.arange(a, b), c.n_words)
                _, first = np.unique(mixed_hash(c.word_hash, row), return_index=True)
                yield pa.RecordBatch.from_arrays([batch.column("domain").take(pa.array(row[first])), pa.array(c.word_hash[first].view(np.int64))], ["domain", "h"])

    n = known.mapInArrow(run, "domain string, h long").groupBy("h", "domain").agg(F.count("domain").alias("n"))
    whole = n.groupBy("h").agg(F.sum("n").alias("all")).where(F.col("all") >= least)
    rated, out = staged(n.join(whole, "h")), []
    for d, size in sizes.items():
        gain = F.col("n") * F.log(F.col("n") / F.col("all") / (size / sum(sizes.values())))
        out += [r.h for r in rated.where((F.col("domain") == d) & (gain > 3)).orderBy(gain.desc(), "h").limit(each).select("h").collect()]
    return np.unique(np.array(out, np.int64).view(np.uint64))


def mixed_hash(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return finish(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Classifier:
    """labels: doc_id, domain. Only the max_rows labelled ids with the smallest hashes are used."""
    marked = labels.where(F.col("domain").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    part = F.broadcast(marked.orderBy(F.xxhash64("doc_id")).limit(max_rows))  # at most max_rows ids
    known = staged(texts(docs).join(part, "doc_id"))
    sizes = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("domain").alias("n")).orderBy("domain").collect()}
    signals = signal_words(known, sizes)
    width = N_TEXT + len(signals)

    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch):
                x = design(Counts(data, off), signals)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("domain").slice(a, b - a), pa.ListArray.from_arrays(
                    np.arange(0, x.size + 1, width, dtype=np.int32), pa.array(x.ravel()))], ["doc_id", "domain", "x"])

    found = known.mapInArrow(run, "doc_id long, domain string, x array<double>")
    got = found.groupBy("doc_id", "domain").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas()
    domains = sorted(sizes) or ["all"]
    x = np.stack(got["x"]) if len(got) else np.zeros((0, width))
    return fit(x, np.array([domains.index(d) for d in got["domain"]], np.int64), domains, signals)


def memberships(docs: DataFrame, model: Classifier, *more: str) -> DataFrame:
    """doc_id, n_tokens (words), p (posteriors in the order of model.domains) and the named columns."""
    extra = docs.select(*more).schema.fields if more else []
    schema = ", ".join(["doc_id long, n_tokens long, p array<double>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])
    k = len(model.domains)

    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch):
                c = Counts(data, off)
                p = model.posteriors(c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(c.n_words.astype(np.int64)),
                     pa.ListArray.from_arrays(np.arange(0, p.size + 1, k, dtype=np.int32), pa.array(p.ravel())), *(batch.column(f.name).slice(a, b - a) for f in extra)],
                    ["doc_id", "n_tokens", "p", *(f.name for f in extra)])

    return texts(docs, *more).mapInArrow(run, schema)


def descend(p: np.ndarray, history: list[np.ndarray], eta: float, mu: float, least: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rates of `least` or more after the steps of history (weighted residuals at each step's point), and
    the point at which the next residual is to be taken."""
    rate = point = np.ones(len(p))
    for t, residual in enumerate(history, 1):
        new = np.maximum(least, point - eta * (p @ residual + mu * (point - 1)))
        point = new + t / (t + 3) * (new - rate)
        rate = new
    return rate, point


def solve(members: DataFrame, targets: np.ndarray, mu: float = MU, steps: int = STEPS, close: float = CLOSE, least: float = 0) -> tuple[list[np.ndarray], float]:
    """The history of weighted residuals. members: n_tokens and p, stored. targets are shares of tokens;
    rates of `least` or more cannot go below least times the tokens there are, so the targets are scaled
    up until each domain's is in reach."""
    k = len(targets)

    def totals(history, eta):
        def run(batches):
            for batch in batches:
                n = batch.column("n_tokens").to_numpy().astype(float)
                p = batch.column("p").flatten().to_numpy().reshape(-1, k)
                rate, point = descend(p, history, eta, mu, least)
                if not history:  # the first pass also gathers the products of memberships
                    extra = ((p * n[:, None]).T @ p).ravel()
                else:
                    extra = np.zeros(0)
                out = np.concatenate([[n.sum()], (n * point) @ p, (n * rate) @ p, extra])
                yield pa.RecordBatch.from_arrays([pa.array([out])], ["s"])

        width = 1 + 2 * k + (0 if history else k * k)
        sums = members.select("n_tokens", "p").mapInArrow(run, "s array<double>").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width))).first()
        return np.array([x or 0.0 for x in sums])

    s = totals([], 0.0)
    n = s[0]
    if not n:
        return [], 0.0
    gram = s[1 + 2 * k:].reshape(k, k) / n
    sought = targets > 0
    targets = targets * max(1.0, float(np.max((least * s[1:1 + k] / n)[sought] / targets[sought], initial=0.0)))
    weight = np.linalg.inv(gram + np.eye(k) * 1e-4 * np.trace(gram) / k)
    eta = 1 / (np.linalg.eigvals(weight @ gram).real.max() + mu)
    history = [weight @ (s[1:1 + k] / n - targets)]
    while len(history) < steps:
        s = totals(history, eta)
        if np.abs(s[1 + k:1 + 2 * k] / n - targets).max() < close * targets.max():
            break
        history.append(weight @ (s[1:1 + k] / n - targets))
    return history, eta


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *more: str, mu: float = MU, steps: int = STEPS, least: int = 0) -> DataFrame:
    """doc_id, n_tokens, p, rate, copies (and the named columns of docs): copies is the rate rounded
    up or down by a hash of the id, so that expected tokens follow the rates, `least` or more."""
    model = train(docs, labels)
    wanted = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    wanted = wanted / wanted.sum() if wanted.sum() else np.full(len(wanted), 1 / len(wanted))
    members = staged(memberships(docs, model, *more))
    history, eta = solve(members, wanted, mu, steps, least=least)
    k, schema = len(wanted), members.schema

    def run(batches):
        for batch in batches:
            rate, _ = descend(batch.column("p").flatten().to_numpy().reshape(-1, k), history, eta, mu, least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rated = members.mapInArrow(run, f"{out}, rate double")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    return rated.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain: toxic, poor or good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], least: int = 0) -> DataFrame:
    """The rows of docs, each as often as its copies say and `least` times at least: the rates are fitted
    under that bound, so the shares of what is returned follow the targets."""
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"], docs["text"])
    rated = mix(whole, labels, targets, "row", least=least)
    return rated.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
