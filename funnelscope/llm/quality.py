"""Quality by a factorisation machine over hashed words, structure statistics and the text's size.

``score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise part costs linear time, as
``half the sum over factors of (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2``. Features are the distinct words of a text
(lower-cased A-Z, hashed into ``2^WORD_BITS`` places, scaled to length one) and one place per statistic and bin: shares of
capitals, digits, marks, symbols, line ends and non-ASCII bytes, word lengths, repetition, and the size of the text as metadata.

Fitting takes at most ``most_rows`` labelled rows (a documented bound; those with the smallest hashed ids) and runs on
their features on the driver, in memory of that bound; scoring covers every text whole, in Arrow batches, without a shuffle.
Null and empty texts get the score of their (empty) features. Repeated rows get equal scores; other columns stay.
With one label only, or none, the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from funnelscope.llm import hashing
from funnelscope.llm.labelled import with_labels

WORD_BITS = 16
BINS = 12
STATISTICS = 12
PLACES = (1 << WORD_BITS) + STATISTICS * BINS
STATISTIC_WEIGHT = 0.35
FACTORS = 8
MOST_ROWS = 12_000
SLICE_BYTES = 1 << 20   # text whose features a task holds at once
LEAST_STEPS = 400    # of fitting: few labelled rows are gone over more often, so that scores leave the share of label 1
# Byte classes: 0 other letters and spaces, 1 capitals, 2 digits, 3 sentence marks, 4 symbols, 5 line ends, 6 non-ASCII, 7 table bars.
CLASS = np.zeros(256, np.int64)
CLASS[33:127] = 4
CLASS[65:91], CLASS[97:123] = 1, 0
CLASS[48:58] = 2
CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 3
CLASS[10] = 5
CLASS[128:] = 6
CLASS[ord("|")] = 7


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, place, value): places and values of text ``i`` are at ``first[i]:first[i + 1]``."""
    raw, n = hashing.Texts(column), len(column)
    size = np.diff(raw.offsets)
    seen = np.bincount(np.repeat(np.arange(n) * 8, size) + CLASS[raw.data], minlength=8 * n).reshape(n, 8)
    texts = hashing.Texts(column, lower=True)
    words = hashing.Words(texts)
    count = words.counts()
    of = np.repeat(np.arange(n), count)
    key, times = np.unique(of << WORD_BITS | (words.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    doc, place = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(doc, minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc, times)
    lengths = np.bincount(of, words.ends - words.starts, minlength=n)
    total, many = np.maximum(size, 1), np.maximum(count, 1)
    shares = [*(seen[:, c] / total for c in range(1, 8)), lengths / many / 16, distinct / many, most / many]
    scale = [np.minimum(s, 1) ** 0.5 for s in shares] + [np.log2(1 + size) / 24, np.log2(1 + seen[:, 5]) / 12]
    bins = np.stack([np.minimum((s * BINS).astype(np.int64), BINS - 1) for s in scale], 1)
    statistic = (1 << WORD_BITS) + np.arange(STATISTICS) * BINS + bins
    first = np.concatenate([[0], np.cumsum(distinct + STATISTICS)])
    places, values = np.empty(first[-1], np.int64), np.empty(first[-1], np.float32)
    at = np.arange(len(key)) + STATISTICS * doc
    places[at], values[at] = place, (1 / np.sqrt(np.maximum(distinct, 1)))[doc]
    at = (first[1:, None] - STATISTICS) + np.arange(STATISTICS)
    places[at], values[at] = statistic, STATISTIC_WEIGHT
    return first, places, values


class Machine:
    """A fitted factorisation machine: bias, weights (PLACES) and factors (PLACES x FACTORS)."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def margins(self, first: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        part = self.factors[places] * values[:, None]
        sums = np.add.reduceat(part, first[:-1])
        squares = np.add.reduceat(part * part, first[:-1])
        return self.bias + np.add.reduceat(self.weights[places] * values, first[:-1]) + 0.5 * (sums * sums - squares).sum(1)

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*features(column)).astype(np.float64), -30, 30)))


def fit(first: np.ndarray, places: np.ndarray, values: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 128,
        rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over batches in a seeded order. ``first`` holds at least one place per row."""
    random, n = np.random.default_rng(seed), len(labels)
    share = labels.mean() if n else 0.5
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    weights, factors = np.zeros(PLACES, np.float32), random.normal(0, 0.02, (PLACES, FACTORS)).astype(np.float32)
    if n == 0 or share in (0, 1):
        return Machine(bias, weights, factors * 0)
    weight_scale, factor_scale, bias_scale = np.full(PLACES, 1e-4, np.float32), np.full((PLACES, FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // n))):
        order = random.permutation(n)
        for start in range(0, n, batch):
            rows = order[start:start + batch]
            size = first[rows + 1] - first[rows]
            begin = np.concatenate([[0], np.cumsum(size)])
            pick = np.arange(begin[-1]) + np.repeat(first[rows] - begin[:-1], size)
            place, value = places[pick], values[pick]
            part = factors[place] * value[:, None]
            sums = np.add.reduceat(part, begin[:-1])
            margin = (bias + np.add.reduceat(weights[place] * value, begin[:-1])
                      + 0.5 * (sums * sums - np.add.reduceat(part * part, begin[:-1])).sum(1))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            pull = np.repeat(slope, size).astype(np.float32) * value
            by_place = np.argsort(place, kind="stable")
            used, edge = np.unique(place[by_place], return_index=True)
            step = np.add.reduceat(pull[by_place], edge) + decay * weights[used]
            weight_scale[used] += step * step
            weights[used] -= rate * step / np.sqrt(weight_scale[used])
            turn = pull[:, None] * (np.repeat(sums, size, 0) - part)
            step = np.add.reduceat(turn[by_place], edge) + decay * factors[used]
            factor_scale[used] += step * step
            factors[used] -= 0.5 * rate * step / np.sqrt(factor_scale[used])
            bias_scale += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(bias_scale)
    return Machine(float(bias), weights, factors)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in hashing.slices(batch, "text", SLICE_BYTES):
            first, places, values = features(part.column("text"))
            cut = lambda x: [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(cut(places.astype(np.int32)), pa.binary()),
                                              pa.array(cut(values), pa.binary())], ["label", "places", "value"])


def learned(documents: DataFrame, labels: DataFrame, label_col: str = "quality", learn: Column | None = None,
            most_rows: int = MOST_ROWS, doc_id: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on at most ``most_rows`` labelled rows; only their features reach the driver."""
    sample = with_labels(documents, labels, label_col, learn, most_rows, doc_id, text_col)
    rows = sample.select("text", "label").mapInArrow(_features_of, "label int, places binary, value binary").toArrow()
    rows = rows.take(np.argsort([hash_of(p) for p in rows.column("places").to_pylist()], kind="stable"))  # not by partition
    places = [np.frombuffer(x, np.int32) for x in rows.column("places").to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
    values = np.frombuffer(b"".join(rows.column("value").to_pylist()), np.float32)
    flat = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
    return fit(first, flat, values, np.array(rows.column("label").to_pylist(), np.float64))


def hash_of(packed: bytes) -> int:
    return int(np.frombuffer(packed, np.int32).astype(np.uint64).sum()) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def scorer(spark: SparkSession, machine: Machine):
    """A column function: text to its score. The model is broadcast: (PLACES x (FACTORS + 1)) floats, 2.4 MB, whatever the data."""
    shared = spark.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        task = Machine(*shared.value)
        for texts in batches:
            whole = pa.RecordBatch.from_arrays([texts], ["text"])
            parts = [task.scores(part.column("text")) for part in hashing.slices(whole, "text", SLICE_BYTES)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def score_texts(df: DataFrame, machine: Machine, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``df`` with the score of each text in ``out``."""
    return df.withColumn(out, scorer(df.sparkSession, machine)(F.col(text_col)))
