"""Sequence numbers on a stream whose files come in wrong order."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from funnelscope.operators.runstate import event_sequence, failure_rate_window
from funnelscope.streaming import ordered, state

START = dt.datetime(2024, 5, 1)
SCHEMA = "audit_id long, event_id long, ts timestamp"


@pytest.fixture
def rocksdb(spark):
    key, value = ordered.ROCKSDB
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield
    spark.conf.set(key, before)


def run(spark, folder, files, make, schema=SCHEMA, **held):
    """Each file a micro-batch, in this order; the rows that have left so far and those still held."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in-{i}")
        part = next(p.path for p in os.scandir(f"{folder}/in-{i}") if p.name.endswith(".parquet"))
        os.utime(part, (1_000_000 + i, 1_000_000 + i))
    events = state.read_events(spark, f"{folder}/in-*", spark.createDataFrame([], schema).schema, 1)
    stream = make(events)
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(
        availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), ordered.waiting(spark, f"{folder}/progress", **held)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("audit_id", "event_id", "seq", "t").collect())


def test_shuffled_files_get_the_batch_numbers(spark, tmp_path, rocksdb):
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 1, 2, 3]), i, START + dt.timedelta(seconds=draw.randrange(0, 5000))) for i in range(300)]
    rows += rows[:7]                                   # delivered again
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=draw.randrange(0, 900)))   # up to 15 minutes out of order
    size = len(rows) // 5 + 1
    left, held = run(spark, tmp_path, [rows[i:i + size] for i in range(0, len(rows), size)], lambda e: ordered.numbered(e, "20 minutes"))
    assert 50 < left.count() < len(rows) and held.count() == len(rows) - left.count()
    expected = rows_of(event_sequence(spark.createDataFrame(rows, SCHEMA)))
    assert rows_of(ordered.closed(left, held)) == expected
    assert set(rows_of(left)) <= set(expected)


def test_odd_rows(spark, tmp_path, rocksdb):
    files = [[(1, 1, START), (None, 2, START), (1, 3, None), (1, None, START)], [(2, 4, START + dt.timedelta(hours=2))]]
    left, held = run(spark, tmp_path, files, ordered.numbered)
    assert rows_of(ordered.closed(left, held)) == [(1, 1, 0, 0.0), (2, 4, 0, 0.0)]


def test_failures_before_each_attempt(spark, tmp_path, rocksdb):
    draw = random.Random(5)
    schema = "client long, event_id long, ts timestamp, ok boolean"
    rows = [(draw.choice([7, 7, 7, 8]), i, START + dt.timedelta(seconds=10 * draw.randrange(0, 500)), draw.random() < 0.3) for i in range(300)]
    rows += rows[:9]
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=draw.randrange(0, 900)))
    size = len(rows) // 5 + 1
    left, held = run(spark, tmp_path, [rows[i:i + size] for i in range(0, len(rows), size)],
                     lambda a: ordered.failure_counts(a, 600, "20 minutes"), schema, key="client", fields=ordered.FailureCounts.FIELDS)
    assert 50 < left.count() < len(rows) and held.count() == len(rows) - left.count()
    names = ["client", "event_id", "ok", "recent_failures"]
    expected = sorted(tuple(r) for r in failure_rate_window(spark.createDataFrame(rows, schema), 600).select(*names).collect())
    got = sorted(tuple(r) for r in ordered.closed_counts(left, held, 600).select(*names).collect())
    assert got == expected and max(r[3] for r in got) > 5
    assert set(tuple(r) for r in left.select(*names).collect()) <= set(expected)


def test_keys_share_their_state(spark, tmp_path, rocksdb, monkeypatch):
    """Calls to the state store grow with groups: not an element a row, nor a list a key. Counts keep the keys of a group apart."""
    monkeypatch.setattr(ordered, "GROUPS", 2, raising=False)
    draw = random.Random(11)
    schema = "client long, event_id long, ts timestamp, ok boolean"
    rows = [(draw.randrange(40), i, START + dt.timedelta(seconds=10 * draw.randrange(0, 300)), draw.choice([True, False, False, None])) for i in range(600)]
    rows += rows[:5]
    rows.sort(key=lambda r: r[2])
    left, held = run(spark, tmp_path, [rows[:200], rows[200:400], rows[400:]], lambda a: ordered.failure_counts(a, 900, "25 minutes"), schema,
                     key="client", fields=ordered.FailureCounts.FIELDS)
    elements = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/progress").count()
    assert 0 < elements <= 2 * 3 < held.count() and left.count() > 200
    names = ["client", "event_id", "ok", "recent_failures"]
    in_full = lambda df: sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    assert in_full(ordered.closed_counts(left, held, 900)) == in_full(failure_rate_window(spark.createDataFrame(rows, schema), 900))
