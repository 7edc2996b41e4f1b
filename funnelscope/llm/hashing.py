"""Words of whole Arrow batches and their hashes, as numpy arrays.

Texts stay in Arrow's UTF-8 buffer; no Python string is made. A word is a run of bytes outside
``\\x20 \\x09-\\x0D``, so bytes and code points give the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, text: int | str, most_bytes: int = 4 * BLOCK_BYTES):
    """The batch in pieces of about ``most_bytes`` of text; a longer text is a piece of its own."""
    ends, start = Texts(batch.column(text)).offsets, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most_bytes, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


class Texts:
    """Bytes of the texts of one Arrow column, one after another; null counts as empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        if n == 0:
            self.offsets, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        else:
            _, offsets, data = column.buffers()
            self.offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
            whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            self.data = whole[self.offsets[0]:self.offsets[-1]]
            self.offsets = self.offsets - self.offsets[0]
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            self.data = table[self.data]

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words:
    """Places and hashes of all words: ``starts``, ``ends`` (bytes), ``first`` (word index of each text, and the end)."""

    def __init__(self, texts: Texts):
        data, offsets = texts.data, texts.offsets
        solid = np.ones(256, bool)
        solid[[9, 10, 11, 12, 13, 32]] = False
        inside = solid[data]
        n = len(data)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.data = data

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word's bytes, spread by ``mixed``."""
        starts, ends, out = self.starts, self.ends, np.empty(len(self.starts), np.uint64)
        i, power, inverse = 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
            base, n = starts[i], int(ends[j - 1] - starts[i])
            if n > len(power):
                size = max(n, min(BLOCK_BYTES, len(self.data)))
                power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, BASE)]))
                inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, BASE_INVERSE)]))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data[base:base + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * inverse[starts[i:j] - base]
            i = j
        return mixed(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` successive word hashes (text ends are the caller's business); ``len(words) - k + 1`` of them.

    Built from halves: ``log2 k`` passes over the words instead of ``k``.
    """
    if len(words) < k:
        return np.zeros(0, np.uint64)
    have, width, powers = words, 1, []
    while width <= k:
        powers.append((have, width))
        if width * 2 > k:
            break
        have = mixed(have[:-width] * BASE + have[width:] + np.uint64(width))
        width *= 2
    out, at = None, 0
    for part, width in reversed(powers):
        while at + width <= k:
            piece = part[at:at + len(words) - k + 1]
            out = piece if out is None else mixed(out * BASE + piece + np.uint64(at))
            at += width
    return out
