"""Streams over several files in wrong order: nothing is lost, and what comes late is told apart and counted."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from funnelscope.operators import runstate
from funnelscope.operators.timeline import merged_starts
from funnelscope.streaming import late, merged, state

START = dt.datetime(2024, 5, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def edits(n=400):
    draw = random.Random(4)
    rows = [(draw.choice([1, 1, 1, 2]), str(draw.randrange(1, 6)), at(draw.randrange(0, 3000) / 2), i, f"text {i}") for i in range(n)]
    return rows + rows[:5]     # some come twice


def files(spark, folder, rows, schema, n=5):
    """The rows as ``n`` files whose order has nothing to do with time."""
    rows = rows[:]
    random.Random(9).shuffle(rows)
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.parquet(f"{folder}/in-{i}")
    return state.read_events(spark, f"{folder}/in-*", spark.createDataFrame([], schema).schema, 1)


def run(df, sink, folder):
    query = df.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


NOTES = "audit_id long, layer string, saved_at timestamp, event_id long, text string"
ATTEMPTS = "client long, event_id long, ts timestamp, ok boolean"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("compacted", [False, True])
def test_latest_note_wins_in_any_order(spark, tmp_path, compacted):
    rows = edits()
    table = merged.notes_table(spark, f"{tmp_path}/notes")

    def sink(batch, batch_id):
        table.write(batch, batch_id)
        if compacted:
            table.compact()
    run(files(spark, tmp_path, rows, NOTES), sink, tmp_path)
    expected = runstate.notes_upsert(spark.createDataFrame(rows, NOTES))
    columns = ["audit_id", "layer", "text", "saved_at"]
    assert rows_of(table.read(), *columns) == rows_of(expected, *columns)


def test_save_an_hour_late(spark, tmp_path):
    table = merged.notes_table(spark, f"{tmp_path}/notes")
    table.write(spark.createDataFrame([(1, "1", at(0), 1, "first"), (2, "1", at(100), 2, "far on")], NOTES), 0)
    table.write(spark.createDataFrame([(1, "1", at(40), 3, "an hour late, newest")], NOTES), 1)
    table.write(spark.createDataFrame([(2, "1", at(40), 4, "late and older"), (2, "9", at(400), 5, "no such layer")], NOTES), 2)
    assert rows_of(table.read(), "audit_id", "text") == [(1, "an hour late, newest"), (2, "far on")]


@pytest.mark.parametrize("compacted", [False, True])
def test_sessions_with_open_ones(spark, tmp_path, compacted):
    rows, gap = edits(), 20 * 60_000
    table = merged.sessions_table(spark, f"{tmp_path}/sessions", gap, 3_600_000_000)

    def sink(batch, batch_id):
        table.write(batch, batch_id)
        if compacted:
            table.compact()
    run(files(spark, tmp_path, rows, NOTES), sink, tmp_path)
    columns = ["audit_id", "layer", "session_start", "last_edit", "edits", "text"]
    expected = rows_of(runstate.edit_sessions(spark.createDataFrame(rows, NOTES), gap), *columns)
    assert rows_of(merged.sessions(table), *columns) == expected and len(expected) > 20
    now = at(1000)
    closed = rows_of(merged.closed_sessions(table, F.lit(now), gap), *columns)
    assert closed == [r for r in expected if r[3] + dt.timedelta(minutes=20) <= now] and closed != expected


def test_failure_windows_add_up(spark, tmp_path):
    draw = random.Random(6)
    rows = [(draw.choice([7, 7, 8]), i, at(draw.randrange(0, 600)), draw.random() < 0.3) for i in range(300)]
    table = merged.failure_windows_table(spark, f"{tmp_path}/failures", 3600, "30 minutes")
    run(files(spark, tmp_path, rows, ATTEMPTS), table.write, tmp_path)
    expected = {}
    for client, _, ts, ok in rows:
        if not ok:
            first = int((ts - START).total_seconds() // 1800) - 1
            for k in (first, first + 1):
                key = (client, START + dt.timedelta(seconds=k * 1800 + 3600))
                expected[key] = expected.get(key, 0) + 1
    assert rows_of(table.read(), "client", "until", "failures") == sorted((*k, n) for k, n in expected.items())


def test_batches_run_again_and_broken_compactions(spark, tmp_path):
    table = merged.failure_windows_table(spark, f"{tmp_path}/failures", 3600, "1 hour")
    assert table.read().collect() == []
    batch = spark.createDataFrame([(1, 1, at(5), False), (1, 2, at(6), False)], ATTEMPTS)
    table.write(batch, 0)
    table.write(batch, 0)
    table.write(batch, 1)
    assert [r["failures"] for r in table.read().collect()] == [4]
    os.makedirs(f"{tmp_path}/failures/upto=1")       # a compaction that was never committed
    assert [r["failures"] for r in table.read().collect()] == [4]
    table.compact()
    table.write(batch, 1)                             # the base holds it already
    table.write(batch, 2)
    assert [r["failures"] for r in table.read().collect()] == [6]
    table.compact()
    assert [r["failures"] for r in table.read().collect()] == [6]


def test_late_rows_are_counted(spark, tmp_path):
    schema = "event_id long, ts timestamp, text string"
    parts = [[(1, at(0), "a"), (2, at(60), "b")], [(3, at(30), "late"), (4, at(55), "within"), (5, at(90), "c"), (6, None, "no time")],
             [(7, at(79), "late"), (8, at(80), "edge"), (9, at(5), "late")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in-{i}")
        os.utime(next(p.path for p in os.scandir(f"{tmp_path}/in-{i}") if p.name.endswith(".parquet")), (1_000_000 + i, 1_000_000 + i))
    fields = spark.createDataFrame([], schema).schema
    run(late.tagged(state.read_events(spark, f"{tmp_path}/in-*", fields, 1), "ts"), late.split_late(f"{tmp_path}/out"), tmp_path)
    behind = rows_of(late.late_rows(spark, f"{tmp_path}/out", fields), "event_id", "text")
    main = late.main_rows(spark, f"{tmp_path}/out", fields)
    assert behind == [(3, "late"), (7, "late"), (9, "late")]
    assert sorted(r["event_id"] for r in main.collect()) == [1, 2, 4, 5, 6, 8]
    assert rows_of(late.late_counts(spark, f"{tmp_path}/out", fields), "late_rows") == [(1,), (2,)]


def test_chains_of_intervals(spark):
    draw = random.Random(8)
    rows = [(draw.choice("ab"), s, s + draw.randrange(0, 60)) for s in (10 * draw.randrange(0, 400) for _ in range(150))]
    rows += [(k, s, s) for k, s, _ in rows[:60]] + rows[:20]
    expected, reach, start = [], {}, {}
    for key, first, last in sorted(rows):
        if key not in reach or first - reach[key] >= 15:
            start[key] = first
        reach[key] = max(reach.get(key, last), last)
        expected.append((key, first, last, start[key]))
    df = spark.createDataFrame(rows, "k string, first long, last long")
    for width in (1, 37, 100_000):
        got = merged_starts(df, ["k"], "first", "last", lambda before, now: now - before >= 15, "start", width)
        assert rows_of(got, "k", "first", "last", "start") == sorted(expected)


def test_repeated_attempts_stay(spark):
    rows = [(1, 1, at(0), False), (1, 2, at(1), False), (1, 2, at(1), False), (1, 3, at(2), True), (1, 3, at(2), True), (1, 4, at(9), False)]
    got = runstate.failure_rate_window(spark.createDataFrame(rows, ATTEMPTS), 300, 60_000_000)
    assert rows_of(got, "event_id", "recent_failures") == [(1, 0), (2, 1), (2, 1), (3, 3), (3, 3), (4, 0)]


def test_progress_in_any_order(spark, tmp_path):
    draw = random.Random(12)
    schema = "audit_id long, event_id long, ts timestamp, type string, layer int, step int, status string"
    rows = []
    for i in range(260):
        kind = draw.choice(["layer", "layer", "layer", "step", "log"] + ["complete"] * (i % 9 == 0))
        rows.append((draw.randrange(1, 30), i, at(draw.randrange(0, 200)), kind, draw.randrange(1, 6) if kind == "layer" else None,
                     draw.randrange(1, 9) if kind == "step" else None, draw.choice(["running", "done", "failed", "pending", None]) if kind == "layer" else draw.choice(["error", None])))
    table = merged.progress_table(spark, f"{tmp_path}/progress")

    def sink(batch, batch_id):
        table.write(batch, batch_id)
        if batch_id == 2:
            table.compact()
    run(files(spark, tmp_path, rows, schema), sink, tmp_path)
    batch = spark.createDataFrame(rows, schema).withColumn("place", F.struct("ts", "event_id"))
    expected = rows_of(runstate.progress_percent(batch, "place"), "audit_id", "percent")
    assert rows_of(merged.progress(table), "audit_id", "percent") == expected and len({p for _, p in expected}) > 4
