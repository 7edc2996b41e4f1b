"""Toxicity by two smoothed word models, one of toxic and one of ordinary text, that back off to counts they share.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``, lower-cased A-Z, without ASCII marks at its ends. For class ``c``, with
``n_c(w)`` occurrences of ``w`` and ``N_c`` of all words:

    P_c(w) = max(n_c(w) - D, 0) / N_c + sum over v of min(n_c(v), D) / N_c * P(w)
    P(w)   = (m(w) + 1) / (M + V + 1)        m: labelled documents with w, over both classes; M: their sum; V: distinct words

The lower level counts a word by the documents it stands in, not by how often (continuation counts, a document being the
context), and is shared, so a word that no class has more than ``D`` times says the same, whatever it is: such words need no row
in the models. A text's evidence is the log of the mean over its words of ``P_toxic / P_ordinary`` (and over ``PRIOR_WORDS`` words
of ratio one), which does not grow with length. The difference of the mean log-likelihoods ranks far worse: a few toxic words drown in the
noise of the ordinary ones, and so it does with the word before as context (figures in the README, from folds of the learning rows alone).

Counts are Spark tables over all labelled rows and grow with them. The curve ``sigmoid(offset + slope * evidence)`` is fitted to
at most ``CURVE_ROWS`` labelled rows, each judged by counts without its own. Up to ``BROADCAST_WORDS`` words the models are
broadcast; beyond that texts meet them by a join on the words. Both ways give the same scores.

Null, empty and blank texts have evidence 0. Texts of any length are read whole. Repeated rows get equal scores. With one label only, or
none, the score is the share of label 1 (0.5 without labels); an empty table gives an empty one. Other columns stay; an input
column with the name of the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from funnelscope.llm import hashing
from funnelscope.llm.labelled import with_labels
from funnelscope.llm.store import written

DISCOUNT = 1.0
PRIOR_WORDS = 8             # words of ratio one that every text is taken to have, so that one odd word does not decide a short text
CURVE_ROWS = 12_000
BROADCAST_WORDS = 8_000_000  # 16 bytes each
MARK = np.zeros(256, bool)
MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


class TextWords:
    """Hashes of the words of a column (``hashes``), the text each stands in (``of``) and the number of words of each text (``size``)."""

    def __init__(self, column: pa.Array):
        words = hashing.Words(hashing.Texts(column, lower=True))
        of, data = np.repeat(np.arange(len(column)), words.counts()), words.data
        starts, ends = words.starts.copy(), words.ends.copy()
        todo = np.arange(len(starts))
        while len(todo := todo[(starts[todo] < ends[todo]) & MARK[data[np.minimum(starts[todo], len(data) - 1)]]]):
            starts[todo] += 1
        todo = np.arange(len(starts))
        while len(todo := todo[(starts[todo] < ends[todo]) & MARK[data[ends[todo] - 1]]]):
            ends[todo] -= 1
        some = starts < ends
        words.starts, words.ends, self.of = starts[some], ends[some], of[some]
        self.hashes = words.hashes().view(np.int64)
        self.size = np.bincount(self.of, minlength=len(column))

    def by_text(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, times) of the distinct words of each text."""
        order = np.lexsort((self.hashes, self.of))
        of, word = self.of[order], self.hashes[order]
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (word[1:] != word[:-1])])) if len(of) else np.zeros(0, np.int64)
        return of[new], word[new], np.diff(np.append(new, len(of)))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in hashing.slices(batch, "text"):
            of, word, times = TextWords(part.column("text")).by_text()
            toxic = part.column("label").to_numpy(zero_copy_only=False)[of] == 1
            words, which = np.unique(word, return_inverse=True)
            sums = [np.bincount(which, x, len(words)).astype(np.int64) for x in (times * ~toxic, times * toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(words), *map(pa.array, sums), pa.array(np.bincount(which, minlength=len(words)))],
                                             ["word", "n0", "n1", "documents"])


def _row_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each row; a row without words has one row with none."""
    for batch in batches:
        for part in hashing.slices(batch, "text"):
            text = TextWords(part.column("text"))
            of, word, times = text.by_text()
            none = np.flatnonzero(text.size == 0)
            of, times = np.concatenate([of, none]), np.concatenate([times, np.zeros(len(none), np.int64)])
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(of)), pa.array(np.concatenate([word, none * 0])),
                                              pa.array(times), pa.array(text.size[of])], ["row", "word", "times", "size"])


class Judge:
    """``words``: (word, ratio) of the words that differ from ``rest``, the ratio of all others; and the curve."""

    def __init__(self, words: DataFrame | None, rest: float, offset: float, slope: float):
        self.words, self.rest, self.offset, self.slope = words, rest, offset, slope

    def score(self, evidence: Column) -> Column:
        return F.lit(1.0) / (1 + F.exp(-(F.lit(self.offset) + self.slope * evidence)))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n0, n1, documents): occurrences in each class and documents of both, over rows of (text, label)."""
    counts = rows.select("text", "label").mapInArrow(_class_counts, "word long, n0 long, n1 long, documents long")
    return counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "documents")])


def evidence_of(ratios: Column, words: Column) -> Column:
    """Log of the mean ratio over a text's words and the prior words, from the sum of its words' ratios."""
    return F.log((ratios + PRIOR_WORDS) / (words + PRIOR_WORDS))


def learned(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", learn: Column | None = None,
            doc_id: str = "doc_id", text_col: str = "text") -> Judge:
    """Count over the labelled rows that ``learn`` lets through, then fit the curve to at most ``CURVE_ROWS`` of them."""
    rows = with_labels(documents, labels, label_col, learn, None, doc_id, text_col)
    counts = written(word_counts(rows), "toxic-words")
    total = counts.agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "documents")], F.count("*").alias("distinct"),
                       *[F.sum(F.least(f"n{c}", F.lit(DISCOUNT))).alias(f"mass{c}") for c in (0, 1)]).first()
    sample = (with_labels(documents, labels, label_col, learn, CURVE_ROWS, doc_id, text_col)
              .select(F.monotonically_increasing_id().alias("row"), "label", "text"))
    sample = written(sample, "toxic-curve")
    if not total["n0"] or not total["n1"]:
        share = sample.agg(F.avg("label")).first()[0]
        share = min(max(0.5 if share is None else share, 1e-9), 1 - 1e-9)
        return Judge(None, 1.0, float(np.log(share / (1 - share))), 0.0)

    def ratio(n0: Column, n1: Column, seen: Column, size0=F.lit(0), size1=F.lit(0)) -> Column:
        shared = (seen + 1) / F.lit(float(total["documents"] + total["distinct"] + 1))
        p = [(F.greatest(n - DISCOUNT, F.lit(0.0)) + float(total[f"mass{c}"]) * shared) / F.greatest(F.lit(float(total[f"n{c}"])) - size, F.lit(1.0))
             for c, n, size in ((0, n0, size0), (1, n1, size1))]
        return p[1] / p[0]

    rest = total["mass1"] * total["n0"] / (total["mass0"] * total["n1"])
    # Each sampled row by the counts without its own.
    own = [F.when(F.col("label") == c, F.col("times")).otherwise(0) for c in (0, 1)]
    length = [F.when(F.col("label") == c, F.col("size")).otherwise(0) for c in (0, 1)]
    pairs = sample.select("row", "text").mapInArrow(_row_words, "row long, word long, times long, size long").join(sample.select("row", "label"), "row")
    judged = pairs.join(counts, "word", "left").select(
        "row", "label", "size", (F.col("times") * F.when(F.col("times") > 0, ratio(
            F.col("n0") - own[0], F.col("n1") - own[1], F.col("documents") - 1, *length)).otherwise(0.0)).alias("ratio"))
    fit = judged.groupBy("row", "label", "size").agg(F.sum("ratio").alias("ratio")).select("label", evidence_of(F.col("ratio"), F.col("size")).alias("x"))
    fit = fit.toPandas()
    offset, slope = fitted_curve(fit["x"].to_numpy(), fit["label"].to_numpy())
    words = counts.where((F.col("n0") > DISCOUNT) | (F.col("n1") > DISCOUNT)).select(
        "word", ratio(F.col("n0"), F.col("n1"), F.col("documents")).alias("ratio"))
    return Judge(written(words, "toxic-ratios"), float(rest), offset, slope)


def fitted_curve(x: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Offset and slope of the logistic curve through the rows (Newton, lightly regularised)."""
    order = np.lexsort((label, x))   # the same sums however the rows arrive
    x, label = x[order], label[order].astype(np.float64)
    if len(label) == 0 or label.min() == label.max():
        share = float(np.clip(label.mean() if len(label) else 0.5, 1e-9, 1 - 1e-9))
        return float(np.log(share / (1 - share))), 0.0
    beta, design = np.array([np.log(label.mean() / (1 - label.mean())), 1.0]), np.stack([np.ones_like(x), x], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (label - p) - 1e-3 * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1, 10 / max(np.abs(step).max(), 1e-12))
    return float(beta[0]), float(beta[1])


def _evidence_udf(judge: Judge):
    """A column function, text to evidence, over the broadcast models."""
    table = judge.words.toArrow()
    order = np.argsort(words := table.column("word").to_numpy())
    spark = judge.words.sparkSession
    shared, rest = spark.sparkContext.broadcast((words[order], table.column("ratio").to_numpy()[order])), judge.rest

    @F.arrow_udf(T.DoubleType())
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, ratios = shared.value
        for texts in batches:
            whole, out = pa.RecordBatch.from_arrays([texts], ["text"]), []
            for part in hashing.slices(whole, "text"):
                text = TextWords(part.column("text"))
                of, word, times = text.by_text()
                at = np.minimum(np.searchsorted(words, word), max(0, len(words) - 1))
                found = np.where(words[at] == word, ratios[at], rest) if len(words) else np.full(len(word), rest)
                total = np.bincount(of, times * found, len(text.size))
                out.append(np.log((total + PRIOR_WORDS) / (text.size + PRIOR_WORDS)))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return evidence


def score_texts(df: DataFrame, judge: Judge, text_col: str = "text", out: str = "toxicity_score", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``df`` with the score of each text in ``out``."""
    if judge.words is None:
        return df.withColumn(out, judge.score(F.lit(0.0)))
    if judge.words.count() <= broadcast_words:
        return df.withColumn(out, judge.score(_evidence_udf(judge)(F.col(text_col))))
    keyed = written(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("input"), F.col(text_col).alias("text"),
                              F.monotonically_increasing_id().alias("row")), "toxic-texts")
    pairs = keyed.select("row", "text").mapInArrow(_row_words, "row long, word long, times long, size long")
    ratios = pairs.join(judge.words, "word", "left").groupBy("row", "size").agg(
        F.sum(F.col("times") * F.coalesce("ratio", F.lit(judge.rest))).alias("ratio"))
    scored = keyed.join(ratios, "row").select("input", judge.score(evidence_of(F.col("ratio"), F.col("size"))).alias("score"))
    kept = [F.col("input")[c].alias(c) for c in df.columns if c != out]
    return scored.select(*kept, F.col("score").alias(out))
