"""Collocations against plain counts, and the index's intervals against every place of a phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from funnelscope.llm import phrases, queries

duckdb = pytest.importorskip("duckdb")


def plain_counts(rows, most_words=3):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    return counts, totals


def plain_collocations(rows, most_words=3, least_count=10, covered_percent=50, top=2000):
    counts, totals = plain_counts(rows, most_words)
    candidates = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least_count}
    covered = set()
    for (lang, words), f in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = (lang, words[i:i + size])
                if 100 * f >= covered_percent * counts[inner]:
                    covered.add(inner)
    out = []
    for lang in totals:
        found = []
        for (of, words), a in candidates.items():
            if of == lang and (of, words) not in covered:
                cuts = [(1_000_000 * a * a // (counts[of, words[:k]] * counts[of, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(words).encode(), counts[of, words[:k]], counts[of, words[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def made_rows():
    draw = random.Random(11)
    vocabulary = ["The", "the", "of", "New", "york", "York", "É", "é", "straße", "x", "don't", "a-b", "\x0bvt", "nb sp", "zz"]
    rows = [(None, "a b"), ("und", None), ("en", ""), ("de", " \t .,;"), ("en", "one two three " * 30), ("fr", "un deux, trois! " * 25), ("en", "b b " * 40), ("", "no name. " * 12)]
    for _ in range(260):
        words = [draw.choice(vocabulary[:draw.randrange(2, len(vocabulary) + 1)]) + draw.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(draw.randrange(0, 60))]
        rows.append((draw.choice(["en", "en", "de", None, "und"]), " ".join(words)))
    return rows


def test_intervals():
    draw = np.random.default_rng(2)
    symbols = draw.integers(0, 6, 900).astype(np.int32)
    symbols[0] = symbols[-1] = 0
    index = phrases.PhraseIndex(symbols, 4)
    whole = Counter(tuple(symbols[i:i + k].tolist()) for k in range(1, 5) for i in range(len(symbols) - k + 1) if symbols[i:i + k].all())
    for turns in ([True, True, True], [False, False, False], [True, False, True], [False, True, True]):
        nodes, length = index.words(), 1
        for right in [*turns, None]:
            seen = {}
            for ahead, back, count, place in zip(nodes.ahead, nodes.back, nodes.count, index.places(nodes)):
                phrase = tuple(symbols[place:place + length].tolist())
                for row in range(count):
                    at, end = index.ahead.order[ahead + row], len(symbols) - 1 - index.back.order[back + row]
                    assert tuple(symbols[at:at + length].tolist()) == phrase == tuple(symbols[end - length + 1:end + 1].tolist())
                seen[phrase] = count
            assert seen == {p: c for p, c in whole.items() if len(p) == length}
            if right is not None:
                nodes, length = index.extended(nodes, right), length + 1


@pytest.mark.parametrize("most_words,least_count,covered,top", [(3, 10, 50, 2000), (4, 3, 70, 25), (2, 2, 50, 3)])
def test_small_cases(spark, most_words, least_count, covered, top):
    rows = made_rows()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).selectExpr("*", "1 as phrase", "2 as words", "3 as a", "4 as rank", "5 as n")
    result = phrases.collocations(df, most_words, least_count, covered, top)
    assert result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(r) for r in result.collect())
    assert got == plain_collocations(rows, most_words, least_count, covered, top) and len(got) > 8


def test_several_shards():
    rows = made_rows()
    texts, langs = [t for _, t in rows], [x for x, _ in rows]
    import pyarrow as pa
    total = Counter()
    for at in range(0, len(rows), 50):
        shard = phrases.Shard(pa.array(texts[at:at + 50], pa.string()), pa.array(langs[at:at + 50], pa.string()))
        for nodes, places in phrases._lengths(phrases.PhraseIndex(shard.symbols, 3)):
            for lang, phrase, count in zip(*(x.to_pylist() for x in shard.phrases(places, nodes.length)), nodes.count):
                total[lang, tuple(phrase.split(" "))] += int(count)
    assert total == plain_counts(rows)[0]


def test_cells_bound_the_counts():
    import pyarrow as pa
    rows = made_rows()
    counts, shared = plain_counts(rows)[0], Counter()
    parts = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows[at:at + 90]], pa.string()), pa.array([t for _, t in rows[at:at + 90]], pa.string())], ["lang", "text"])
             for at in range(0, len(rows), 90)]
    sent = pa.Table.from_batches([b for part in parts for b in phrases._paged(3)(iter([part]))]).sort_by("page")
    for least in (1, 10):
        table = np.zeros(1 << phrases.FILTER_BITS - 3, np.uint8)
        pages = [p for b in phrases._frequent_cells(least)(iter(sent.to_batches(max_chunksize=7))) for p in zip(*(c.to_pylist() for c in b.columns))]
        assert [p for p, _ in pages] == sorted({p for p, _ in pages})
        width = 1 << phrases.FILTER_BITS - phrases.PAGE_BITS - 3
        for page, bits in pages:
            table[page * width:(page + 1) * width] = np.frombuffer(bits, np.uint8)
        whole = phrases.Shard(pa.array([t for _, t in rows], pa.string()), pa.array([x for x, _ in rows], pa.string()))
        for nodes, places in phrases._lengths(phrases.PhraseIndex(whole.symbols, 3)):
            bit = phrases._cells(whole, nodes, places) >> (phrases.PAGE_BITS + phrases.CELL_BITS - phrases.FILTER_BITS)
            is_set = (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            for lang, phrase, marked in zip(*(x.to_pylist() for x in whole.phrases(places, nodes.length)), is_set):
                times = counts[lang, tuple(phrase.split(" "))]
                assert marked or times < least
                shared[least, bool(marked and times < least)] += 1
    assert shared[10, True] < 5 and shared[10, False] > 100


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F
    a, l, r = 9_999_999_999_999, 99_999_999_999_999, 99_999_999_999_998
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(
        (phrases._exact(F.lit(1_000_000)).cast("decimal(7,0)") * phrases._exact(F.col("a")) * phrases._exact(F.col("a"))).alias("above"),
        (phrases._exact(F.col("l")) * phrases._exact(F.col("r"))).alias("below")).selectExpr("above div below as score").first()
    assert row["score"] == 1_000_000 * a * a // (l * r)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    got = sorted(tuple(r) for r in queries.op12_collocations(spark, sf_dir).collect())
    assert got == plain_collocations(rows) and got
    sql = queries.ORACLE["op12_collocations"].replace("from documents", f"from '{sf_dir}/documents.parquet'")
    assert sorted(duckdb.connect().sql(sql).fetchall()) == got
