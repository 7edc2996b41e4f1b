"""Ordered operators against brute force: hot keys, equal times, many bucket widths."""

import random

import pytest
from pyspark.sql import functions as F

from funnelscope.operators import runstate
from funnelscope.operators.timeline import last_before, running_sum


def made(seed, n=300, span=4000):
    rng = random.Random(seed)
    # one client holds most rows; times repeat
    return [(0 if rng.random() < 0.7 else rng.randint(1, 3), i, rng.randint(0, span), rng.random() < 0.3) for i in range(n)]


def attempts(spark, rows):
    df = spark.createDataFrame(rows, "client bigint, event_id bigint, s bigint, ok boolean")
    return df.withColumn("ts", F.timestamp_seconds("s"))


@pytest.mark.parametrize("width", [1, 50, 10**9])
def test_running_sum_and_last(spark, width):
    rows = made(1)
    df = spark.createDataFrame(rows, "client bigint, event_id bigint, s bigint, ok boolean")
    out = running_sum(df, ["client"], "s", ["event_id"], F.lit(1), "n", width)
    out = last_before(out, ["client"], "s", ["event_id"], F.when(F.col("ok"), F.col("event_id")), "held", False, width)
    got = {r["event_id"]: (r["n"], r["held"]) for r in out.collect()}
    for client in range(4):
        held = None
        for n, (_, i, _, ok) in enumerate(sorted((r for r in rows if r[0] == client), key=lambda r: (r[2], r[1])), 1):
            assert got[i] == (n, held)
            held = i if ok else held


def replay(rows, limit, window):
    """One attempt after the other, as a sign-in page would."""
    recorded, out = {}, {}
    for client, i, s, ok in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        kept = recorded.setdefault(client, [])
        kept[:] = [t for t in kept if t > s - window]
        if len(kept) >= limit:
            out[i] = "locked"
        elif ok:
            out[i] = "ok"
        else:
            kept.append(s)
            out[i] = "rejected"
    return out


@pytest.mark.parametrize("seed, window", [(2, 60), (3, 900), (4, 10), (5, 5000)])
def test_lockout_against_replay(spark, seed, window):
    rows = made(seed)
    got = {r["event_id"]: r["outcome"] for r in runstate.lockout_replay(attempts(spark, rows), 5, window, 100_000_000).collect()}
    assert got == replay(rows, 5, window)


def test_lockout_golden(spark):
    rows = [(1, i, s, False) for i, s in enumerate([0, 10, 20, 30, 40, 50, 905])]
    got = {r["event_id"]: r["outcome"] for r in runstate.lockout_replay(attempts(spark, rows)).collect()}
    assert got[5] == "locked" and got[6] == "rejected"


def test_fewer_failures_lock_nobody(spark):
    rows = [(1, i, i, i >= 4) for i in range(50)]
    assert runstate.lockout_replay(attempts(spark, rows)).filter("outcome = 'locked'").count() == 0


@pytest.mark.parametrize("window", [1, 37, 900])
def test_failure_rate(spark, window):
    rows = made(6)
    got = {r["event_id"]: r["recent_failures"] for r in runstate.failure_rate_window(attempts(spark, rows), window).collect()}
    for client, i, s, _ in rows:
        assert got[i] == sum(1 for c, j, t, ok in rows if c == client and not ok and t > s - window and (t, j) < (s, i))


def test_event_sequence_and_tail(spark):
    rows = [(r[0], r[1], r[2], "log") for r in made(7)]
    df = spark.createDataFrame(rows, "audit_id bigint, event_id bigint, s bigint, type string").withColumn("ts", F.timestamp_seconds("s"))
    seqs = runstate.event_sequence(df).groupBy("audit_id").agg(F.sort_array(F.collect_list("seq")).alias("q")).collect()
    assert all(r["q"] == list(range(len(r["q"]))) for r in seqs)
    kept = runstate.log_tail(df, keep=7).collect()
    for audit in range(4):
        mine = sorted((r[2], r[1]) for r in rows if r[0] == audit)[-7:]
        assert sorted((r["s"], r["event_id"]) for r in kept if r["audit_id"] == audit) == mine


def test_replay_after_id(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "audit_id int, seq bigint")
    assert [r["seq"] for r in runstate.events_replay(df, F.lit("0")).collect()] == [1, 2]
    assert [r["seq"] for r in runstate.events_replay(df, F.lit("x")).collect()] == [0, 1, 2]


def test_edit_sessions_boundary(spark):
    ms = [0, 500, 1200, 2000]
    df = spark.createDataFrame([(1, "1", i, m, str(i)) for i, m in enumerate(ms)], "audit_id bigint, layer string, event_id bigint, ms bigint, text string")
    df = df.withColumn("saved_at", F.timestamp_millis("ms"))
    got = sorted((r["edits"], r["text"]) for r in runstate.edit_sessions(df).collect())
    assert got == [(1, "2"), (1, "3"), (2, "1")]  # a pause of exactly the delay saves
