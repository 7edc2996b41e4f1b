"""Run state from the event log: sequence, progress, log tail, note saves, sign-in throttling."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from funnelscope import fixed_values as fv
from funnelscope.operators.timeline import DEFAULT_BUCKET_US, last_before, micros, running_sum, session_starts, trailing_count


def events_replay(events: DataFrame, last_seq: Column) -> DataFrame:
    """Events after the client's last id, in order; an id that is not a number replays from the start."""
    return events.filter(F.col("seq") > F.coalesce(last_seq.try_cast("bigint"), F.lit(-1))).orderBy("audit_id", "seq")


def event_sequence(events: DataFrame, started: str | None = None, width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Adds ``seq`` (dense from 0 per audit, by ``ts`` then ``event_id``) and ``t`` (seconds since start, 1 decimal).

    ``started`` names the start-time column; without it an audit starts at its first event.
    """
    first = {} if started else {"_started": (F.min("ts"), F.min)}
    rows = running_sum(events.withColumn("_us", micros(F.col("ts"))), ["audit_id"], "_us", ["event_id"], F.lit(1), "_n", width, first)
    if started:
        rows = rows.withColumn("_started", F.col(started))
    seconds = (F.col("_us") - micros(F.col("_started"))) / F.lit(1_000_000)
    return rows.withColumn("seq", F.col("_n") - 1).withColumn("t", F.bround(seconds, 1)).drop("_n", "_us", "_started")


def step_phase(step: Column) -> Column:
    return F.when(step <= 2, "prep").when(step == 8, "report").otherwise("layer")


def layer_state_latest(events: DataFrame, order: str = "seq") -> DataFrame:
    """Last status of each (audit, layer); layers never mentioned are pending and have no row."""
    return (events.filter(F.col("type") == "layer").groupBy("audit_id", "layer")
            .agg(F.max_by("status", order).alias("status")))


def progress_slots(events: DataFrame, order: Column) -> DataFrame:
    """What the progress bar needs of events: (audit_id, slot, latest, report, complete), a slot per layer and 0 for all other events.

    ``latest`` is the slot's last status with its place in ``order``. Slots of parts of the events merge by ``merged_slots``.
    """
    kind = F.col("type")
    layer = kind == "layer"
    return merged_slots(events.filter(kind.isin("layer", "step", "complete")).select(
        "audit_id", F.when(layer, F.col("layer")).otherwise(0).alias("slot"),
        F.when(layer, F.struct(order.alias("at"), F.col("status").alias("status"))).alias("latest"),
        ((kind == "step") & (step_phase(F.col("step")) == "report")).alias("report"),
        ((kind == "complete") & (F.coalesce("status", F.lit("")) != "error")).alias("complete")))


def merged_slots(slots: DataFrame) -> DataFrame:
    return slots.groupBy("audit_id", "slot").agg(F.max_by("latest", "latest.at").alias("latest"),
                                                 F.max("report").alias("report"), F.max("complete").alias("complete"))


def slots_percent(slots: DataFrame) -> DataFrame:
    """Progress bar per audit from merged slots."""
    is_layer, status = F.col("slot").between(1, 5), F.col("latest.status")
    points = F.when(is_layer & status.isin("done", "failed"), 17).when(is_layer & (status == "running"), 5).otherwise(0)
    summed = slots.groupBy("audit_id").agg(
        F.sum(points).alias("points"), F.bool_or(F.col("slot") > 0).alias("began"),
        F.bool_or("report").alias("report"), F.bool_or("complete").alias("complete"))
    bar = F.when(F.col("began"), 6).otherwise(2) + F.col("points")
    return summed.select("audit_id", F.when(F.col("complete"), 100).when(
        F.col("report"), F.greatest(bar, F.lit(93))).otherwise(bar).cast("int").alias("percent"))


def progress_percent(events: DataFrame, order: str = "seq") -> DataFrame:
    """Progress bar per audit: layer states folded with the report step and the completion."""
    return slots_percent(progress_slots(events, F.col(order)))


def elapsed_clock(seconds: Column) -> Column:
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600), two(F.floor(s % 3600 / 60))
    tail = F.concat(minutes, F.lit(":"), two(s % 60))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), tail)).otherwise(tail)


def run_duration(started: Column, finished: Column, now: Column | None = None) -> Column:
    """Whole seconds from start to finish, or to now while running."""
    end = F.coalesce(finished, now if now is not None else F.current_timestamp())
    return F.floor((micros(end) - micros(started)) / 1_000_000).cast("bigint")


def log_tail(events: DataFrame, keep: int = fv.LOG_LINES, width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """The last ``keep`` log lines of each audit (the cap is the feature), counted over its log lines only."""
    logs = events.filter(F.col("type") == "log").withColumn("_us", micros(F.col("ts")))
    numbered = running_sum(logs, ["audit_id"], "_us", ["event_id"], F.lit(1), "_n", width,
                           {"_lines": (F.count(F.lit(1)), F.sum)})
    return numbered.filter(F.col("_n") > F.col("_lines") - keep).drop("_n", "_lines", "_us")


def running_activity(events: DataFrame, width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Latest activity text of each layer, taken from log rows written while that layer ran (as-of)."""
    kind = F.col("type")
    rows = events.filter((kind == "layer") | ((kind == "log") & (F.col("level") == "activity"))).withColumn(
        "_us", micros(F.col("ts")))
    # 0 marks "no layer is running"
    state = F.when(kind == "layer", F.when(F.col("status") == "running", F.col("layer")).otherwise(0))
    held = last_before(rows, ["audit_id"], "_us", ["event_id"], state, "running_layer", True, width)
    return (held.filter((kind == "log") & (F.col("running_layer") > 0))
            .groupBy("audit_id", F.col("running_layer").alias("layer"))
            .agg(F.max_by(F.trim("text"), F.struct("_us", "event_id")).alias("activity")))


def valid_notes(notes: DataFrame) -> DataFrame:
    return notes.filter(F.col("layer").isin("1", "2", "3", "4", "5")).withColumn(
        "text", F.left(F.col("text"), F.lit(fv.ANALYST_NOTE_CHARS)))


def notes_upsert(notes: DataFrame) -> DataFrame:
    """Last saved text per (audit, layer); an empty text is a valid overwrite."""
    at = F.struct("saved_at", "event_id")
    return valid_notes(notes).groupBy("audit_id", "layer").agg(
        F.max_by("text", at).alias("text"), F.max("saved_at").alias("saved_at"))


def edit_sessions(edits: DataFrame, gap_ms: int = fv.NOTE_SAVE_DELAY_MS, width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """One save per burst of edits: a pause of ``gap_ms`` or more ends a burst, as a session window does."""
    keys = ["audit_id", "layer"]
    rows = session_starts(edits.withColumn("_us", micros(F.col("saved_at"))), keys, "_us", ["event_id"],
                          lambda before, now: now - before >= gap_ms * 1000, "_start", width)
    start = F.timestamp_micros("_start").cast(edits.schema["saved_at"].dataType)
    return rows.groupBy(*keys, start.alias("session_start")).agg(
        F.max("saved_at").alias("last_edit"), F.count(F.lit(1)).alias("edits"),
        F.max_by("text", F.struct("_us", "event_id")).alias("text"))


def failure_rate_window(attempts: DataFrame, window_s: int = fv.LOGIN_WINDOW_SECONDS,
                        width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Failed attempts of the client in the window before each attempt (checked first, then recorded)."""
    rows = attempts.withColumn("_us", micros(F.col("ts")))
    return trailing_count(rows, rows.filter(~F.col("ok")), ["client"], "_us", "event_id",
                          window_s * 1_000_000, "recent_failures", width).drop("_us")


def recorded_failures(attempts: DataFrame, limit: int = fv.LOGIN_FAILURES, window_s: int = fv.LOGIN_WINDOW_SECONDS,
                      width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Failures that are recorded: those that find fewer than ``limit`` recorded ones in the window.

    A failure more than a window after the one before it starts from a clean slate, so each client's
    failures are cut into independent stretches. Only failures come here, three numbers a row; Spark
    sorts each stretch and it is folded while it streams through the task. The fold holds ``limit`` times,
    never a stretch, and jumps over everything that a full window shuts out, so an unbroken attack costs
    a search per recorded failure (at most ``limit`` per window), not a step per attempt.
    """
    window_us = window_s * 1_000_000
    rows = attempts.filter(~F.col("ok")).select("client", "event_id", micros(F.col("ts")).alias("us"))
    rows = session_starts(rows, ["client"], "us", ["event_id"], lambda before, now: now - before >= window_us, "stretch", width)
    ordered = (rows.select("client", "stretch", "us", "event_id").repartition("client", "stretch")
               .sortWithinPartitions("client", "stretch", "us", "event_id"))

    def fold(batches):
        current, recorded = None, deque(maxlen=limit)
        for batch in batches:
            client, stretch, us = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero((client[1:] != client[:-1]) | (stretch[1:] != stretch[:-1])) + 1
            keep = []
            for start, end in zip([0, *edges], [*edges, batch.num_rows]):
                if start == end:
                    continue
                if (client[start], stretch[start]) != current:
                    current = (client[start], stretch[start])
                    recorded.clear()
                at = start
                while at < end:
                    if len(recorded) == limit:   # full until the oldest leaves the window: jump there
                        at = max(at, start + int(np.searchsorted(us[start:end], recorded[0] + window_us)))
                        if at >= end:
                            break
                    recorded.append(int(us[at]))
                    keep.append(at)
                    at += 1
            yield batch.take(pa.array(keep, pa.int64()))

    return ordered.mapInArrow(fold, ordered.schema)


def lockout_replay(attempts: DataFrame, limit: int = fv.LOGIN_FAILURES, window_s: int = fv.LOGIN_WINDOW_SECONDS,
                   width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """``outcome`` of every sign-in attempt: ok, rejected, or locked (even a right password).

    Locked attempts are not recorded, so a lock does not extend itself; a success clears nothing.
    """
    rows = attempts.withColumn("_us", micros(F.col("ts")))
    recorded = recorded_failures(attempts, limit, window_s, width).withColumnRenamed("us", "_us")
    counted = trailing_count(rows, recorded, ["client"], "_us", "event_id", window_s * 1_000_000, "recorded_failures", width)
    outcome = F.when(F.col("recorded_failures") >= limit, "locked").when(F.col("ok"), "ok").otherwise("rejected")
    return counted.drop("_us").withColumn("outcome", outcome)
