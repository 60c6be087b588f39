"""FM-index of a shard of documents, over words: numpy, used inside tasks."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks: set bits before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of symbols in the order of the suffixes that begin there, by prefix doubling over what is still tied."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(symbols.max() + 1).bit_length())
    h = min(n, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(h):
        key <<= bits
        key[: n - k] |= symbols[k:] + 1
    sa = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    slots, ordered = np.arange(n), key[sa]
    while True:
        first = np.ones(len(slots), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(slots)))
        rank[sa[slots]] = np.repeat(slots[starts], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return sa
        places = sa[slots]
        key = rank[places] * (n + 1) + rank[np.minimum(places + h, n)] + 1
        order = np.argsort(key)
        sa[slots], ordered = places[order], key[order]
        h *= 2


class FMIndex:
    """Of documents given as arrays of word numbers from 1 on.

    The text is the documents one after another, each closed by a separator. Separators are told apart while sorting, so
    a shared run ends with its document; the transform holds them all as 0, a word that no phrase has. Its ranks are kept in a wavelet matrix: a bit vector
    for each bit of the word numbers. Every `sample`-th place of the text is kept, and each document's first, so
    that a walk back to a kept place stays in its document.
    """

    def __init__(self, documents: list[np.ndarray], n_words: int, sample: int = 16):
        lengths = np.array([len(d) for d in documents], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        n = int(self.starts[-1])
        ends = self.starts[1:] - 1
        text = np.zeros(n, np.int64)
        for d, s in zip(documents, self.starts, strict=False):
            text[s : s + len(d)] = d
        unique = text + len(documents)
        unique[ends] = np.arange(len(documents))
        sa = suffix_array(unique)
        self.n = n
        self.less = np.zeros(n_words + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=n_words + 1), out=self.less[1:])
        last = text[sa - 1].astype(np.int32)
        self.levels = []
        for bit in range(max(1, n_words.bit_length()) - 1, -1, -1):
            ones = (last >> bit) & 1 != 0
            self.levels.append((bit, Bits(ones), n - int(np.count_nonzero(ones))))
            last = np.concatenate((last[~ones], last[ones]))
        kept = np.zeros(n, bool)
        kept[::sample] = True
        kept[self.starts[:-1]] = True
        in_order = kept[sa]
        self.kept, self.places = Bits(in_order), sa[in_order]

    def down(self, word: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """places of the transform, followed through the levels along word."""
        places = list(places)
        for bit, bits, zeros in self.levels:
            one = (word >> bit) & 1 != 0
            for k, p in enumerate(places):
                before = bits.rank(p)
                places[k] = np.where(one, zeros + before, p - before)
        return places

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases (rows of word numbers, all of one length): which occur, and their ranges of suffixes."""
        which = np.flatnonzero((phrases > 0).all(axis=1))
        word = phrases[which, -1]
        low, high = self.less[word], self.less[word + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            on = high > low
            which, low, high = which[on], low[on], high[on]
            word = phrases[which, k]
            begin, low, high = self.down(word, np.zeros_like(low), low, high)
            low, high = self.less[word] + low - begin, self.less[word] + high - begin
        on = high > low
        return which[on], low[on], high[on]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes, by walking back to kept places."""
        out = np.empty(len(rows), np.int64)
        at, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(at):
            done = self.kept.get(row)
            out[at[done]] = self.places[self.kept.rank(row[done])] + steps
            at, row = at[~done], row[~done]
            word, place, begin = np.zeros(len(row), np.int64), row, np.zeros(len(row), np.int64)
            for _, bits, zeros in self.levels:
                one = bits.get(place)
                word = word << 1 | one
                p, b = bits.rank(place), bits.rank(begin)
                place, begin = np.where(one, zeros + p, place - p), np.where(one, zeros + b, begin - b)
            row = self.less[word] + place - begin
            steps += 1
        return out
