"""Held-out accuracy of the two classifiers, and their answers to odd rows."""

import zlib

import pytest

from funnelscope.llm import queries


def ranked(scores, labels):
    """Probability that a row of label 1 outscores one of label 0, ties half (by ranks)."""
    order = sorted(range(len(scores)), key=scores.__getitem__)
    ranks, i = [0.0] * len(scores), 0
    while i < len(order):
        j = i
        while j < len(order) and scores[order[j]] == scores[order[i]]:
            j += 1
        for at in order[i:j]:
            ranks[at] = (i + j + 1) / 2
        i = j
    ones = sum(labels)
    return (sum(r for r, x in zip(ranks, labels) if x) - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


@pytest.mark.parametrize("name,label,modulus,rest,threshold,least", [
    ("op6_toxicity", "toxic", 3, 1, 0.7, 0.9), ("op10_quality", "quality", 5, 0, 0.3, 0.9)])
def test_held_out(spark, larger_dir, name, label, modulus, rest, threshold, least):
    result = queries.QUERIES[name](spark, larger_dir)
    assert result.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in result.collect()}
    assert len(rows) == spark.read.parquet(f"{larger_dir}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    labels = [(r["doc_id"], r[label]) for r in spark.read.parquet(f"{larger_dir}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    auc = ranked([rows[i]["score"] for i, _ in labels], [x for _, x in labels])
    print(name, auc)
    assert auc >= least
