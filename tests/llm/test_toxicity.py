"""The word models against a plain computation, both ways of scoring, odd rows."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from funnelscope.llm import toxicity

EDGE = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (x.strip(EDGE) for x in re.findall(r"[^\x20\x09-\x0D]+", lower)) if w]


def plain_evidence(learn, texts):
    n, seen = [Counter(), Counter()], Counter()
    for text, label in learn:
        n[label].update(words_of(text))
        seen.update(set(words_of(text)))
    size, mass = [sum(c.values()) for c in n], [sum(min(x, 1) for x in c.values()) for c in n]
    below = sum(seen.values()) + len(seen) + 1

    def p(c, w):
        return (max(n[c][w] - 1, 0) + mass[c] * (seen[w] + 1) / below) / size[c]

    out = []
    for text in texts:
        w = words_of(text)
        out.append(math.log((sum(p(1, x) / p(0, x) for x in w) + 8) / (len(w) + 8)))
    return out


@pytest.fixture(scope="module")
def learning(spark):
    rows = [(i, f"The cat {'sat' if i % 2 else 'ran'}, by tree{i % 7} and house{i}. " * (1 + i % 3) + ("You IDIOT! fool" if i % 4 == 0 else "a friend"), int(i % 4 == 0))
            for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return rows, toxicity.learned(docs, labels)


ODD = [(1, "you idiot"), (2, "the cat sat"), (3, None), (4, ""), (5, " \t!! --"), (6, "unseen words only é"), (7, "(IDIOT) fool " * 50_000),
       (1, "you idiot"), (None, "by tree3"), (8, "a friend ran to house5")]


def test_scores_against_a_plain_computation(spark, learning):
    rows, judge = learning
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as row", "2 as ratio", "3 as input", "9.0d as toxicity_score")
    expected = [1 / (1 + math.exp(-(judge.offset + judge.slope * e))) for e in plain_evidence([r[1:] for r in rows], [t for _, t in ODD])]
    assert judge.slope > 0
    for broadcast_words in (toxicity.BROADCAST_WORDS, 0):
        got = toxicity.score_texts(df, judge, broadcast_words=broadcast_words)
        assert set(got.columns) == set(df.columns) and got.where("word = 'x' and row = 1 and ratio = 2 and input = 3").count() == len(ODD)
        scores = Counter((r.doc_id, round(r.toxicity_score, 9)) for r in got.collect())
        assert scores == Counter((i, round(x, 9)) for (i, _), x in zip(ODD, expected))
        assert toxicity.score_texts(df.limit(0), judge, broadcast_words=broadcast_words).collect() == []


@pytest.mark.parametrize("labels,expected", [([], 0.5), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1), (2, 1)], 1.0), ([(1, None), (None, 1)], 0.5)])
def test_few_labels(spark, labels, expected):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (None, "e")], "doc_id long, text string")
    judge = toxicity.learned(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score_texts(docs, judge).agg(F.min("toxicity_score"), F.max("toxicity_score")).first()
    assert got[0] == got[1] == pytest.approx(expected, abs=1e-6)
