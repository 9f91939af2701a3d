"""Line labelling by a linear-chain conditional random field.

The lines of a text that have a word are a chain; Viterbi decoding marks each as content or
boilerplate, and a text is kept if its content lines hold enough of its words. The field is trained
here on weak labels: the lines of a bounded sample of labelled texts take their text's quality label.
Texts of any length are cut into chains of CHAIN lines for training, and the sample is one of chains.

Cases: a null or empty text has no line, content share 0, and fails the base rules. Repeated rows and
repeated ids give one result row each. Other columns are not read. Without a labelled row of each
kind (empty tables too) the field has zero weights and marks all lines as content. A very long text is
a block of its own, about 45 bytes a byte of it. Of two equally likely paths the one through state 0 is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_blocks, texts, utf8
from .stats import N_LINE, Counts

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_lines long, n_content_lines long, content_share double, base_failed boolean, kept boolean")
#: texts of each label that training reads at most, and chains of each label that it fits at most
TRAIN_TEXTS, TRAIN_CHAINS = 2000, 4000
#: a training text is cut into chains of this many lines
CHAIN = 64


class Field:
    """weights: state x feature (the last feature is the constant 1); moves: state x state.
    State 1 is content."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @staticmethod
    def neutral() -> Field:
        return Field(np.vstack([np.zeros(N_LINE + 1), np.append(np.zeros(N_LINE), 1.0)]), np.zeros((2, 2)))

    def emissions(self, lines: np.ndarray) -> np.ndarray:
        return lines @ self.weights[:, :-1].T + self.weights[:, -1]

    def decode(self, lines: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Viterbi states of all lines; row: ascending chain of each line. Chains advance together."""
        emit, states = self.emissions(lines), np.zeros(len(lines), np.int8)
        if not len(lines):
            return states
        length = np.bincount(row, minlength=rows)
        order = np.argsort(-length, kind="stable")
        length, first = length[order], (np.cumsum(np.bincount(row, minlength=rows)) - np.bincount(row, minlength=rows))[order]
        alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))]
        best, back = emit[first[:alive[0]]], []
        for t in range(1, int(length[0])):
            n = alive[t]
            reach = best[:n, :, None] + self.moves
            choice = reach.argmax(1).astype(np.int8)
            back.append(choice)
            best[:n] = np.take_along_axis(reach, choice[:, None, :].astype(np.int64), 1)[:, 0] + emit[first[:n] + t]
        state = best.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            n = alive[t]
            states[first[:n] + t] = state[:n]
            if t:
                state[:n] = back[t - 1][np.arange(n), state[:n]]
        return states


def fit(chains: list[np.ndarray], labels: list[int], steps: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam; all lines of a chain have the chain's label."""
    if len(set(labels)) < 2:
        return Field.neutral()
    n, most = len(chains), max(map(len, chains))
    x, mask = np.zeros((n, most, N_LINE + 1)), np.zeros((n, most), bool)
    for i, c in enumerate(chains):
        x[i, :len(c), :-1], x[i, :len(c), -1], mask[i, :len(c)] = c, 1, True
    y = np.asarray(labels)
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    size = (share[:, None] * mask).sum()
    weights, moves = np.zeros((2, N_LINE + 1)), np.zeros((2, 2))
    state = [np.zeros_like(a) for a in (weights, moves, weights, moves)]
    for step in range(1, steps + 1):
        emit = x @ weights.T
        alpha, norm = np.empty((n, most, 2)), np.ones((n, most))
        potential = np.exp(emit - emit.max(2, keepdims=True))
        hop = np.exp(moves)
        alpha[:, 0] = potential[:, 0]
        for t in range(most):
            if t:
                alpha[:, t] = (alpha[:, t - 1] @ hop) * potential[:, t]
            norm[:, t] = alpha[:, t].sum(1)
            alpha[:, t] /= norm[:, t, None]
        beta, pairs = np.ones((n, 2)), np.zeros((2, 2))
        gw = np.zeros_like(weights)
        for t in range(most - 1, -1, -1):
            # beyond its end a chain has no lines: beta starts where the mask does
            post = alpha[:, t] * beta
            post /= post.sum(1, keepdims=True)
            w = share * mask[:, t]
            truth = np.zeros((n, 2))
            truth[np.arange(n), y] = 1
            gw += ((truth - post) * w[:, None]).T @ x[:, t]
            if t:
                right = potential[:, t] * beta / norm[:, t, None]
                joint = alpha[:, t - 1, :, None] * hop * right[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                pairs += ((truth[:, :, None] * truth[:, None, :] - joint) * w[:, None, None]).sum(0)
                beta = np.where(mask[:, t, None], right @ hop.T, 1.0)
        for i, (a, g) in enumerate(((weights, gw / size - decay * weights), (moves, pairs / size - decay * moves))):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[2 + i] = 0.999 * state[2 + i] + 0.001 * g * g
            a += rate * (state[i] / (1 - 0.9 ** step)) / (np.sqrt(state[2 + i] / (1 - 0.999 ** step)) + 1e-8)
    return Field(weights, moves)


def train(docs: DataFrame, labels: DataFrame, max_texts: int = TRAIN_TEXTS, max_chains: int = TRAIN_CHAINS) -> Field:
    """A field from the labelled texts with the smallest id hashes, max_texts of each label at most. Tasks
    cut the whole texts, however long, into chains; of each label the max_chains chains with the smallest
    hashes are fitted. Only they come to the driver."""
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"))

    def least(rows, n, *order):
        a, b = (rows.where(F.col("y") == y).orderBy(*order).limit(n) for y in (0, 1))
        return a.union(b)

    def cut(batches):
        for batch in batches:
            for a, _, data, off in text_blocks(batch):
                c = Counts(data, off)
                lines, n = c.line_features().astype("<f4"), np.bincount(c.line_row, minlength=len(off) - 1)
                first = np.cumsum(n) - n
                row = np.repeat(np.arange(len(n)), -(-n // CHAIN))
                at = np.concatenate([np.arange(0, k, CHAIN) for k in n]) if len(row) else row
                taken = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(taken), batch.column("y").take(taken), pa.array(at, pa.int64()),
                     pa.array([lines[first[r] + i:first[r] + min(i + CHAIN, n[r])].tobytes() for r, i in zip(row, at)], pa.binary())],
                    ["doc_id", "y", "at", "lines"])

    sample = least(marked, max_texts, F.xxhash64("doc_id"))
    own = texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))
    chains = staged(own.mapInArrow(cut, "doc_id long, y int, at long, lines binary"))
    got = least(chains, max_chains, F.xxhash64("doc_id", "at"), "lines").toPandas()
    return fit([np.frombuffer(x, "<f4").reshape(-1, N_LINE).astype(np.float64) for x in got["lines"]], got["y"].tolist())


def label_lines(docs: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """One row a text: counts, content share and verdict. A text fails the base rules with fewer than
    50 words, or with more than half of its words in repeated 3-word windows."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, off in text_blocks(batch):
                c = Counts(data, off)
                state = field.decode(c.line_features(), c.line_row, b - a)
                held = np.bincount(c.line_row, state * (c.line_to - c.line_from), minlength=b - a)
                share = held / np.maximum(c.n_words, 1)
                failed = (c.n_words < 50) | (100 * c.n_repeat_words > 50 * c.n_words)
                out = (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.n_lines,
                       np.bincount(c.line_row, state, minlength=b - a).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), *(pa.array(x, pa.int64()) for x in out), pa.array(share), pa.array(failed),
                     pa.array(~failed & (share >= min_share))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                     "n_content_lines", "content_share", "base_failed", "kept"])

    return texts(docs).mapInArrow(run, SCHEMA)


def decode_text(text: str | None, field: Field) -> list[tuple[int, int, bool]]:
    """(start byte, end byte, is content) of the lines of one text."""
    data, off = utf8(pa.array([text], pa.string()))
    c = Counts(data, off)
    state = field.decode(c.line_features(), c.line_row, 1)
    return [(int(a), int(b), bool(s)) for a, b, s in zip(c.line_start, c.line_end, state, strict=True)]
