"""Counts of a text and of its lines, shared by the quality rules, the classifier and the mixer."""

from __future__ import annotations

import numpy as np

from .common import SPACE, U, SpanHash, covered, mix, per_row, runs, word_windows, words

#: the characters [#*$%&|<>]
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
CONTINUATION = np.zeros(256, bool)
CONTINUATION[128:192] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A"):ord("Z") + 1] = True
LOWER = np.zeros(256, bool)
LOWER[ord("a"):ord("z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0"):ord("9") + 1] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[ord(c) for c in "!\"'(),-./:;?@[]_{}~=+\\^`"]] = True

HASH, PAIR = SpanHash(11), SpanHash(12)


class Counts:
    """All counts of a block of rows, exact over whole texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        rows = len(off) - 1
        self.data, self.off = data, off
        self.starts, self.ends, self.first = words(data, off)
        self.n_words = np.diff(self.first)
        chars = ~CONTINUATION[data]
        self.n_chars = per_row(chars, off)
        self.word_chars = per_row(chars & ~SPACE[data], off)
        self.n_symbols = per_row(SYMBOL[data], off)
        prefix = HASH.prefix(data)
        self.word_hash = HASH.of(prefix, self.starts, self.ends)
        # words in 3-word windows that the text has twice or more
        at, row = word_windows(self.first, 3)
        key = mix(PAIR.of(PAIR.prefix(self.word_hash), at, at + 3) + row.astype(U) * U(0x9E3779B97F4A7C15))
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        self.repeated = covered(len(self.starts), at[count[where] > 1], 3)
        self.n_repeat_words = per_row(self.repeated, self.first)
        # lines that have a word
        s, e, line_first = runs(data, off, NEWLINE)
        wfrom, wto = np.searchsorted(self.starts, s), np.searchsorted(self.starts, e)
        keep = wto > wfrom
        self.line_row = np.searchsorted(off, s, side="right")[keep] - 1
        self.line_start, self.line_end, self.line_from, self.line_to = s[keep], e[keep], wfrom[keep], wto[keep]
        key = mix(HASH.of(prefix, self.line_start, self.line_end) + self.line_row.astype(U) * U(0x9E3779B97F4A7C15))
        self.line_dup = np.ones(len(key), bool)
        self.line_dup[np.unique(key, return_index=True)[1]] = False
        self.n_lines = np.bincount(self.line_row, minlength=rows)
        self.n_dup_lines = np.bincount(self.line_row, self.line_dup, minlength=rows).astype(np.int64)

    def shares(self, byte_at: np.ndarray, byte_to: np.ndarray, word_from: np.ndarray, word_to: np.ndarray) -> np.ndarray:
        """Features of spans, between 0 and about 1: shares of kinds of bytes and of repeated words."""
        size, n = np.maximum(byte_to - byte_at, 1), np.maximum(word_to - word_from, 1)

        def share(flags, a, b, by):
            total = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=total[1:])
            return (total[b] - total[a]) / by

        same = np.zeros(len(self.word_hash), bool)
        same[1:] = self.word_hash[1:] == self.word_hash[:-1]
        same[self.first[:-1][self.n_words > 0]] = False
        symbol = SYMBOL[self.data]
        last = symbol[self.ends - 1] if len(self.ends) else np.zeros(0, bool)
        bang = (self.data[self.ends - 1] == ord("!")) if len(self.ends) else np.zeros(0, bool)
        lower = share(LOWER[self.data] | CONTINUATION[self.data], byte_at, byte_to, size)
        upper = share(UPPER[self.data], byte_at, byte_to, size)
        return np.column_stack([
            np.sqrt(share(symbol, byte_at, byte_to, size)),
            share(last, word_from, word_to, n),
            share(bang, word_from, word_to, n),
            upper, upper > 0.3, lower,
            share(DIGIT[self.data], byte_at, byte_to, size),
            share(PUNCTUATION[self.data], byte_at, byte_to, size),
            share(same, word_from, word_to, n),
            share(self.repeated, word_from, word_to, n),
            np.log1p(n) / 10,
            np.minimum(size / n / 20, 2),
        ]).astype(np.float64)

    def text_features(self) -> np.ndarray:
        """One row a text: shares, distinct words, repeated lines."""
        base = self.shares(self.off[:-1], self.off[1:], self.first[:-1], self.first[1:])
        row = np.repeat(np.arange(len(self.n_words)), self.n_words)
        key = np.unique(mix(self.word_hash + row.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)[1]
        distinct = np.bincount(row[key], minlength=len(self.n_words)) if len(row) else np.zeros(len(self.n_words))
        return np.column_stack([base, distinct / np.sqrt(np.maximum(self.n_words, 1)) / 20, 1 - distinct / np.maximum(self.n_words, 1),
                                self.n_dup_lines / np.maximum(self.n_lines, 1), self.n_words < 5])

    def line_features(self) -> np.ndarray:
        """One row a line that has a word."""
        base = self.shares(self.line_start, self.line_end, self.line_from, self.line_to)
        return np.column_stack([base, self.line_dup, self.line_to - self.line_from < 4])


N_TEXT, N_LINE = 16, 14
