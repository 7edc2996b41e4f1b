"""Repeated passages against a count of all windows."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from funnelscope.llm import queries, repeats

PATTERN = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, window):
    """Sorted (id, words, removed, kept text)."""
    split = [(i, PATTERN.findall(text or "")) for i, text in rows]
    seen = Counter(tuple(w[j:j + window]) for _, w in split for j in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j:j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(i, n, r, hashlib.sha256(kept.encode()).hexdigest()) for i, n, r, kept in brute_force(rows, 35)]
    result = queries.op5_repeats(spark, sf_dir)
    assert result.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in result.collect()), key=str) == expected
    assert any(r for _, _, r, _ in expected)


def test_small_cases(spark):
    w = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(w[:100])), (2, "a " + " ".join(w[20:55]) + " b"), (3, "c " + " ".join(w[60:94]) + " d"),
            (4, "e\n" * 60), (5, None), (6, ""), (7, " \t"), (8, "\n".join(w[200:240])), (8, "\n".join(w[200:240])),
            (None, " ".join(w[300:340])), (None, "é " + " ".join(w[303:339])), (9, " ".join(w[5:9] * 40)), (10, "q " * 34), (11, " ".join(w[60:95]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as document", "3 as at", "'x' as starts")
    got = sorted((tuple(r) for r in repeats.without_repeats(df, 35).collect()), key=str)
    assert got == brute_force(rows, 35)


def test_every_alignment(spark):
    w = [f"v{i}" for i in range(35)]
    rows = [(i, " ".join([f"p{i}x{j}" for j in range(i)] + w + [f"q{i}"])) for i in range(14)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 35)
    assert got.where(F.col("n_removed") != 35).count() == 0


def test_empty(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_packets_and_buckets(spark):
    """A passage in every document, passages in two and in none, long and short texts, over many packets and buckets."""
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(i, f"{' '.join(f'x{i}y{j}' for j in range(i % 40))} {shared} {' '.join(f'p{i // 2}q{j}' for j in range(i % 2, 60))}") for i in range(60)]
    rows += [(100, " ".join(f"r{j % 900}" for j in range(3000))), (101, "short"), (102, None), (59, rows[59][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.without_repeats(df, 35, packet_bytes=2000, bucket_bytes=500)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows, 35)
