"""Shared lines against a plain count."""

import hashlib
from collections import defaultdict

import pytest

from funnelscope.llm import lines, queries

duckdb = pytest.importorskip("duckdb")


def brute_force(rows, least_documents=2, least_chars=10):
    """Sorted (id, lines, dropped, kept text); no id counts as the smallest."""
    def key(line):
        bare = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)
    rank = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        whole = (text or "").split("\n")
        kept = [x for x in whole if len(key(x)) < least_chars or len(holders[key(x)]) < least_documents or i == min(holders[key(x)], key=rank)]
        out.append((i, len(whole), len(whole) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [(5, "A line of some length\nshort\n  a LINE of some length \t\nown line of five"), (3, "\n\na line of some length\n\n"), (4, "A line of some length"),
        (7, None), (8, ""), (9, "\n"), (1, "Ünïcode lîne ÀÉ\nünïcode lîne ÀÉ"), (2, "ünïcode lîne ÀÉ\nÜnïcode lîne ÀÉ\n\x0bÜNïcode lîne ÀÉ\r"), (6, "nine char\n nine char \nnine chars\nend"),
        (10, "nine char\nNINE CHARS\nend"), (11, "twice in one row here\ntwice in one row here"), (12, "same id same text\nsame id same text"), (12, "same id same text\nsame id same text"),
        (13, "same id other row"), (13, "same id other row\nsame id same text"), (None, "line without an id\nown"), (None, "line without an id\nA line of some length"), (14, "line without an id"),
        (15, "\n".join(f"long text of many lines {i % 700}" for i in range(3000))), (16, "\n".join(f"long text of many lines {i}" for i in range(0, 3000, 2)))]


@pytest.mark.parametrize("least_documents", [2, 3])
def test_small_cases(spark, least_documents):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as at", "'x' as lines", "map(1, 2) as lost", "0 as holder")
    got = sorted((tuple(r) for r in lines.without_shared_lines(df, least_documents).collect()), key=str)
    assert got == brute_force(ROWS, least_documents)


def test_empty(spark):
    assert lines.without_shared_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_string_ids(spark):
    rows = [("b", "the very same line"), ("a", "the very same line"), (None, "other line of text")]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.without_shared_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": 0, "b": 1, None: 0}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(i, n, r, hashlib.sha256(kept.encode()).hexdigest()) for i, n, r, kept in brute_force(rows)]
    result = queries.op13_line_dedup(spark, sf_dir)
    assert result.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    got = sorted(tuple(r) for r in result.collect())
    assert got == sorted(expected) and any(r for _, _, r, _ in expected)
    sql = queries.ORACLE["op13_line_dedup"].replace("from documents", f"from '{sf_dir}/documents.parquet'")
    assert sorted(duckdb.connect().sql(sql).fetchall()) == got


def test_plan_has_no_python(spark, sf_dir, capsys):
    queries.op13_line_dedup(spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
