"""Periodic runs against a plain search, and the grammar's extensions against word-by-word comparison."""

import hashlib
import random
import re
import zlib

import numpy as np

from funnelscope.llm import queries, runs
from funnelscope.llm.grammar import Grammar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least_power=4, least_words=6):
    """Every run, by trying all periods from all places."""
    n, found = len(words), {}
    for q in range(1, n // least_power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_words, least_power * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(doc_id, words):
    found = plain_runs(words)
    lost = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for x in found:
        if best is None or x[1] * best[2] > best[1] * x[2]:
            best = x
    start, length, period = best or (None, None, None)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (doc_id, len(found), start, length, period, 1000 * length // period if best else None,
            digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(w for i, w in enumerate(words) if i not in lost)))


def plain_cycle(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def made_texts():
    draw = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x a b a b a b a b a y", "a " * 300, "a b b " * 40 + "a b",
             ("a b a b a b a b c " * 9).strip(), "é É é É é É é É", "a\x0ba\x0ca\ra\ta\na", "a a " * 7, "a  b " * 2000 + "c"]
    for _ in range(150):
        words = []
        while len(words) < draw.randrange(1, 160):
            part = [draw.choice("abc") for _ in range(draw.randrange(1, 9))]
            words += part * draw.randrange(1, 7)
        texts.append(" ".join(words))
    texts.append(" ".join(draw.choice("ab") for _ in range(4000)))
    texts.append(" ".join([f"w{i}" for i in range(700)] * 5))
    return texts


def test_extensions_are_exact():
    draw = np.random.default_rng(3)
    for names, n in [(1, 400), (2, 600), (3, 900), (40, 500)]:
        words = draw.integers(0, names, n)
        words[n // 2:n // 2 + 90] = np.tile(words[:9], 10)
        borders = np.array([0, n // 3, n - 1])
        words[borders] = 0
        grammar = Grammar(words, names, borders)
        symbols = words.copy()
        symbols[borders] = names + np.arange(3)
        inner = np.setdiff1d(np.arange(n), borders)
        i, j = draw.choice(inner, 500), draw.choice(inner, 500)
        i, j = i[i != j], j[i != j]
        ahead, back = grammar.extend(i, j, True), grammar.extend(i, j, False)
        for x, y, f, b in zip(i, j, ahead, back):
            k = 0
            while symbols[x + k] == symbols[y + k]:
                k += 1
            assert k == f
            k = 0
            while symbols[x - 1 - k] == symbols[y - 1 - k]:
                k += 1
            assert k == b


def test_small_cases(spark):
    rows = list(enumerate(made_texts())) + [(3, "a a a a a a"), (3, "a a a a a a"), (None, "b b b b b b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as n_words", "'x' as collapsed")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in runs.find_runs(df).collect()), key=str)
    expected = []
    for i, text in rows:
        words = WORD.findall(text or "")
        expected.append((i, len(words), plain_runs(words)))
    assert got == sorted(expected, key=str)
    assert any(len(f) > 1 for _, _, f in expected)


def test_other_limits(spark):
    rows = [(i, t) for i, t in enumerate(made_texts()) if t and len(t) < 700]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]]
           for r in runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string"), least_power=2, least_words=2).collect()}
    assert got == {i: plain_runs(WORD.findall(t), 2, 2) for i, t in rows}


def test_empty_table_and_string_ids(spark):
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert runs.find_runs(spark.createDataFrame([("k", "a a a a a a")], "doc_id string, text string")).first()["runs"][0]["length"] == 6


def test_cycles(spark):
    rows = [(i, t) for i in range(0, 400, 7) for t in made_texts()[:12]] + [(None, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F
    for r in df.select("doc_id", "text", runs.cycled(F.col("text"), F.col("doc_id")).alias("turned")).collect():
        assert WORD.findall(r["turned"] or "") == plain_cycle(r["doc_id"], r["text"])


def test_query(spark, sf_dir):
    result = queries.op11_periodic_runs(spark, sf_dir)
    assert result.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(plain_row(i, plain_cycle(i, text)) for i, text in rows)
    assert sorted(tuple(r) for r in result.collect()) == expected and any(r[1] for r in expected)
