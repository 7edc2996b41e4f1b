"""A run-length grammar of a sequence by recompression, and exact extensions on it, as numpy arrays.

Block compression turns every maximal repetition of one symbol into one symbol (base, power); pair compression then draws a side
for every symbol and joins each left symbol that is followed by a right one. Both are turned until no text has more than a few symbols.
Symbols are named by what they derive, so equal names at a level mean equal words, and equal words are parsed alike but for
their ends.

``Grammar.extend`` answers, for many pairs of places at once, how many words agree from there on (or before there): it climbs to the
highest level at which both places are symbol borders, steps over equal symbols, and once symbols differ only goes down. Two powers
of one base share the smaller power. Answers are exact; the number of steps is logarithmic in the answer, in expectation over the sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from funnelscope.llm.hashing import mixed

FEW_SYMBOLS = 4


def _named(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense names of pairs, and the pairs by name."""
    coded = pa.array((upper.astype(np.int64) << 32) | lower.astype(np.int64)).dictionary_encode()
    pairs = coded.dictionary.to_numpy()
    return coded.indices.to_numpy().astype(np.int64), pairs >> 32, pairs & 0xFFFFFFFF


class Grammar:
    """The grammar of ``words`` (names from 0 to ``n_names``), whose texts are parted by unique symbols at ``borders``.

    The first and the last place must be borders. Memory is about 60 bytes a word.
    """

    def __init__(self, words: np.ndarray, n_names: int, borders: np.ndarray):
        symbols, starts = words.astype(np.int64), np.arange(len(words))
        symbols[borders] = n_names + np.arange(len(borders))
        total, fixed = n_names + len(borders), n_names   # the borders' symbols are never joined
        size, base, power = [np.ones(total, np.int64)], [np.arange(total)], [np.ones(total, np.int64)]
        levels, turn = [(symbols, starts)], 0
        border = np.zeros(len(words), bool)
        border[borders] = True
        while np.diff(np.flatnonzero(border[starts])).max(initial=1) > FEW_SYMBOLS + 1:
            sizes = np.concatenate(size)
            first = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            if not first.all():
                at = np.flatnonzero(first)
                times = np.diff(np.append(at, len(symbols)))
                symbols, starts = symbols[at], starts[at]
                many = np.flatnonzero(times > 1)
                names, of, often = _named(symbols[many], times[many])
                symbols = symbols.copy()
                symbols[many] = total + names
                size.append(sizes[of] * often)
                base.append(of)
                power.append(often)
                total += len(of)
                levels.append((symbols, starts))
                sizes = np.concatenate(size)
            left = (mixed(symbols.astype(np.uint64) + (np.uint64(turn) << np.uint64(40))) & np.uint64(1)).astype(bool)
            plain = (symbols < fixed) | (symbols >= fixed + len(borders))
            at = np.flatnonzero(left[:-1] & ~left[1:] & plain[:-1] & plain[1:])
            turn += 1
            if len(at) == 0:
                continue
            names, of, then = _named(symbols[at], symbols[at + 1])
            symbols = symbols.copy()
            symbols[at] = total + names
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, starts = symbols[stays], starts[stays]
            size.append(sizes[of] + sizes[then])
            base.append(total + np.arange(len(of)))
            power.append(np.ones(len(of), np.int64))
            total += len(of)
            levels.append((symbols, starts))
        self.size, self.base, self.power = np.concatenate(size), np.concatenate(base), np.concatenate(power).astype(np.int64)
        # the highest level of every place, and for all its levels the symbol that begins and the one that ends there
        self.top = np.zeros(len(words), np.int16)
        for level, (_, starts) in enumerate(levels):
            self.top[starts] = level
        counts = self.top.astype(np.int64) + 1
        self.row = np.cumsum(counts) - counts
        self.after, self.before = np.empty(counts.sum(), np.int32), np.full(counts.sum(), -1, np.int32)
        for level, (symbols, starts) in enumerate(levels):
            self.after[self.row[starts] + level] = symbols
            self.before[self.row[starts[1:]] + level] = symbols[:-1]

    def extend(self, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
        """Number of equal words from places ``i`` and ``j`` on, or before them; the places differ and none is the first."""
        table, sign = (self.after, 1) if ahead else (self.before, -1)
        out, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
        i, j = i.copy(), j.copy()
        level, falling = np.minimum(self.top[i], self.top[j]).astype(np.int64), np.zeros(len(i), bool)
        while len(open_):
            a, b = table[self.row[i] + level], table[self.row[j] + level]
            same, root = a == b, self.base[a]
            shared = np.where(root == self.base[b], np.minimum(self.power[a], self.power[b]) * self.size[root], 0)
            step = np.where(same, self.size[a], shared)
            out[open_] += step
            i, j = i + sign * step, j + sign * step
            falling |= ~same
            most = np.where(same, np.where(falling, level, np.iinfo(np.int16).max), level - 1)
            goes = most >= 0
            if not goes.all():
                open_, i, j, most, falling = open_[goes], i[goes], j[goes], most[goes], falling[goes]
            level = np.minimum(most, np.minimum(self.top[i], self.top[j]))
        return out
