"""Streaming forms of the run-state operators. Event time is ``ts``. ``merged`` has the tables that take rows in any order, ``late`` tells
rows behind the watermark apart.

Stateless ones (``step_phase``, ``elapsed_clock``, ``events_replay`` without its sort) run on streams as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from funnelscope import fixed_values as fv

WATERMARK = "10 minutes"


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder of parquet files as a stream; its position lives in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def events_after(events: DataFrame, last_seq) -> DataFrame:
    return events.filter(F.col("seq") > F.coalesce(last_seq.try_cast("bigint"), F.lit(-1)))


def sequence_stream(events: DataFrame) -> DataFrame:
    """Adds ``seq`` per audit as events arrive; the state is one counter and the start time."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)

    def number(key, batches, state: GroupState):
        count, start = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        if start is None:
            start = int(rows["ts"].iloc[0].value // 1000)
        rows["seq"] = range(count, count + len(rows))
        rows["t"] = ((rows["ts"].astype("int64") // 1000 - start) / 1e6).round(1)
        state.update((count + len(rows), start))
        yield rows
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("audit_id").applyInPandasWithState(
        number, f"{fields}, seq bigint, t double", "n bigint, start bigint", "append", GroupStateTimeout.NoTimeout)


def layer_state_stream(events: DataFrame) -> DataFrame:
    """Update-mode aggregation: last status per (audit, layer). One row of state per layer."""
    return (events.filter(F.col("type") == "layer").groupBy("audit_id", "layer")
            .agg(F.max_by("status", F.struct("ts", "event_id")).alias("status")))


def lockout_stream(attempts: DataFrame, limit: int = fv.LOGIN_FAILURES, window_s: int = fv.LOGIN_WINDOW_SECONDS) -> DataFrame:
    """``outcome`` of each attempt as it arrives; state per client is at most ``limit`` times and expires with the window."""
    window_us = window_s * 1_000_000

    def judge(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        recorded = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        outcomes = []
        for us, ok in zip(rows["ts"].astype("int64") // 1000, rows["ok"]):
            recorded = [r for r in recorded if r > us - window_us]
            if len(recorded) >= limit:
                outcomes.append("locked")
            elif ok:
                outcomes.append("ok")
            else:
                recorded.append(int(us))
                outcomes.append("rejected")
        state.update((recorded,))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().value // 1_000_000) + window_s * 1000,
                                      state.getCurrentWatermarkMs() + 1))
        rows["outcome"] = outcomes
        yield rows[["client", "event_id", "ts", "ok", "outcome"]]
    return (attempts.select("client", "event_id", F.col("ts").cast("timestamp").alias("ts"), "ok")
            .withWatermark("ts", WATERMARK).groupBy("client").applyInPandasWithState(
                judge, "client bigint, event_id bigint, ts timestamp, ok boolean, outcome string",
                "recorded array<bigint>", "append", GroupStateTimeout.EventTimeTimeout))


def log_tail_stream(events: DataFrame, keep: int = fv.LOG_LINES) -> DataFrame:
    """After each batch, the log lines that batch brings into an audit's last ``keep``, numbered from its first.

    The state is the number of lines seen; readers keep rows with ``line > max(line) - keep``.
    """
    def tail(key, batches, state: GroupState):
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        rows["line"] = range(seen + 1, seen + 1 + len(rows))
        state.update((seen + len(rows),))
        yield rows[rows["line"] > seen + len(rows) - keep][["audit_id", "event_id", "line"]]
    return (events.filter(F.col("type") == "log").select("audit_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
            .groupBy("audit_id").applyInPandasWithState(
                tail, "audit_id bigint, event_id bigint, line bigint", "seen bigint", "append", GroupStateTimeout.NoTimeout))
