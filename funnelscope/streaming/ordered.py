"""Streams in event time: rows wait until the watermark has passed them and leave in order, whatever order the files came in.

``numbered`` gives sequence numbers per audit, ``failure_counts`` the exact number of failures in the window before each sign-in attempt. Both
give every row that leaves what the batch form gives it, and need the RocksDB state store (``ROCKSDB``, set on the session before the
query starts). Keys share their state in ``GROUPS`` groups, so that calls to the state store grow with groups and not with keys or rows. The
state of a group is the rows that still wait, at most those of the watermark's delay, and the next numbers or the
failures of one window. Rows behind the watermark do not take part: put ``late.tagged`` before, in a query of its own, to
keep and count them. What still waits when the input ends is read from the state by ``waiting``; ``closed`` and ``closed_counts`` add it.
Repeated rows are rows of their own, as in the batch forms. Rows without a time, a key or an event id have no place in the order and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from funnelscope import fixed_values as fv
from funnelscope.operators.runstate import event_sequence
from funnelscope.operators.timeline import micros, trailing_count
from funnelscope.session import materialize
from funnelscope.streaming.state import WATERMARK

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
GROUPS = 1024          # groups that keys are dealt over; a key is always in the same one
ROWS_AT_ONCE = 10_000  # rows in one element of a state list, and in one batch of output


class Packed:
    """A state list of rows, many in one element: an array a column."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, fields: str):
        self.columns = [f.split()[0] for f in fields.split(", ")]
        self.state = handle.getListState(name, ", ".join(f"{c} array<{t}>" for c, t in map(str.split, fields.split(", "))))

    def get(self) -> pd.DataFrame:
        parts = [pd.DataFrame(dict(zip(self.columns, element))) for element in self.state.get()] if self.state.exists() else []
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=self.columns)

    def append(self, rows: pd.DataFrame) -> None:
        self.state.appendList(self._elements(rows))

    def put(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.state.put(self._elements(rows))
        else:
            self.state.clear()

    def _elements(self, rows: pd.DataFrame) -> list[tuple]:
        lists = [rows[c].tolist() for c in self.columns]
        return [tuple(x[start:start + ROWS_AT_ONCE] for x in lists) for start in range(0, len(rows), ROWS_AT_ONCE)]


class InOrder(StatefulProcessor):
    """Rows of a group in order of (who, us, event_id): ``leave`` gets those that the watermark has passed and gives their output."""

    FIELDS, OUT = "us bigint, event_id bigint", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Packed(handle, "waiting", f"who bigint, {self.FIELDS}")
        self.alarm = handle.getValueState("alarm", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.waiting.append(batch)
            at = int(batch["us"].min())
            first = at if first is None else min(first, at)
        if first is not None:
            self.wake(first)
        yield pd.DataFrame(columns=[f.split()[0] for f in self.OUT.split(", ")])

    def wake(self, us: int) -> None:
        """The group's one timer, at its first row that waits."""
        ms, = self.alarm.get() if self.alarm.exists() else (None,)
        if ms is None or us // 1000 + 1 < ms:
            if ms is not None:
                self.handle.deleteTimer(ms)
            self.handle.registerTimer(us // 1000 + 1)
            self.alarm.update((us // 1000 + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.clear()
        rows = self.waiting.get()
        leaving = rows["us"] <= passed
        kept = rows[~leaving]
        self.waiting.put(kept)
        if len(kept):
            self.wake(int(kept["us"].min()))
        if leaving.any():
            out = self.leave(rows[leaving].sort_values(["who", "us", "event_id"], ignore_index=True), passed)
            for start in range(0, len(out), ROWS_AT_ONCE):
                yield out.iloc[start:start + ROWS_AT_ONCE]

    def leave(self, rows: pd.DataFrame, passed: int) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Numbering(InOrder):
    OUT = "audit_id bigint, event_id bigint, us bigint, seq bigint, t double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counters = handle.getMapState("counters", "who bigint", "next bigint, start bigint")

    def leave(self, rows: pd.DataFrame, passed: int) -> pd.DataFrame:
        of_key = rows.groupby("who", sort=False)["us"]
        before = []
        for who, size, earliest in zip(*of_key.agg(["size", "min"]).reset_index().to_numpy().T.tolist()):
            number, start = self.counters.getValue((who,)) if self.counters.containsKey((who,)) else (0, earliest)
            self.counters.updateValue((who,), (number + size, start))
            before.append((number, start))
        number, start = np.array(before, np.int64)[of_key.ngroup()].T
        rows = rows.assign(audit_id=rows["who"], seq=number + of_key.cumcount(), t=((rows["us"] - start) / 1e6).round(1))
        return rows[["audit_id", "event_id", "us", "seq", "t"]]


class FailureCounts(InOrder):
    """The failures that a later attempt may still count are kept; older ones go when their window is over."""

    FIELDS = "us bigint, event_id bigint, ok boolean"
    OUT = "client bigint, event_id bigint, us bigint, ok boolean, recent_failures bigint"

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = Packed(handle, "recent", "who bigint, us bigint, event_id bigint")

    def leave(self, rows: pd.DataFrame, passed: int) -> pd.DataFrame:
        failed = rows.loc[rows["ok"].eq(False), ["who", "us", "event_id"]]
        earlier = self.recent.get()
        failures = pd.concat([earlier, failed], ignore_index=True) if len(earlier) else failed
        who, us, event_id = (np.concatenate([rows[c], failures[c]]).astype(np.int64) for c in ("who", "us", "event_id"))
        hit = np.repeat([0, 1], [len(rows), len(failures)])
        edge = us - np.where(hit, 0, self.window_us)
        # an attempt sorts before its own failure, and after the failures at the edge of its window
        counts = _hits_before(hit, (hit, event_id, us, who)) - _hits_before(hit, (1 - hit, edge, who))
        self.recent.put(failures[failures["us"] > passed - self.window_us])
        rows = rows.assign(client=rows["who"], recent_failures=counts[:len(rows)])
        return rows[["client", "event_id", "us", "ok", "recent_failures"]]


def _hits_before(hit: np.ndarray, keys: tuple) -> np.ndarray:
    """For each place the hits up to it in order of ``keys``, the last one first."""
    order = np.lexsort(keys)
    counts = np.empty(len(hit), np.int64)
    counts[order] = np.cumsum(hit[order])
    return counts


def _timed(rows: DataFrame, delay: str, *columns: str) -> DataFrame:
    timed = rows.select(F.col(columns[0]).alias("who"), *columns[1:], F.col("ts").cast("timestamp").alias("ts")).dropna(subset=["who", "event_id", "ts"])
    dealt = timed.withColumn("dealt", F.pmod(F.xxhash64("who"), F.lit(GROUPS)).cast("int"))
    return dealt.withWatermark("ts", delay).withColumn("us", micros(F.col("ts")))


def numbered(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """``audit_id, event_id, us, seq, t`` of every event that the watermark has passed; append mode."""
    return _timed(events, delay, "audit_id", "event_id").groupBy("dealt").transformWithStateInPandas(
        Numbering(), Numbering.OUT, "append", "eventTime")


def failure_counts(attempts: DataFrame, window_s: int = fv.LOGIN_WINDOW_SECONDS, delay: str = WATERMARK) -> DataFrame:
    """``client, event_id, us, ok, recent_failures`` of every attempt that the watermark has passed; append mode."""
    return _timed(attempts, delay, "client", "event_id", "ok").groupBy("dealt").transformWithStateInPandas(
        FailureCounts(window_s * 1_000_000), FailureCounts.OUT, "append", "eventTime")


def waiting(spark: SparkSession, checkpoint: str, key: str = "audit_id", fields: str = InOrder.FIELDS) -> DataFrame:
    """``key`` and the fields of the rows that the query of this checkpoint still holds, written once: each read opens every state store."""
    names = [f.split()[0] for f in fields.split(", ")]
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    rows = held.select(F.inline(F.arrays_zip(*[F.col("list_element")[c] for c in ["who", *names]]))).toDF(key, *names)
    return materialize(rows, "waiting")


def closed(left: DataFrame, held: DataFrame) -> DataFrame:
    """The rows that have left and, numbered after them, those that are still held: the batch form's result."""
    so_far = left.groupBy("audit_id").agg(F.count("*").alias("before"), F.min("us").alias("start"))
    rest = event_sequence(held.withColumn("ts", F.timestamp_micros("us"))).join(so_far, "audit_id", "left")
    since = F.bround((F.col("us") - F.col("start")) / F.lit(1_000_000), 1)
    rest = rest.withColumn("seq", F.col("seq") + F.coalesce("before", F.lit(0))).withColumn("t", F.coalesce(since, "t"))
    return left.unionByName(rest.select(*left.columns))


def closed_counts(left: DataFrame, held: DataFrame, window_s: int = fv.LOGIN_WINDOW_SECONDS) -> DataFrame:
    """The attempts that have left and those that are still held, which also count the failures of their window that have left."""
    window_us = window_s * 1_000_000
    since = held.groupBy("client").agg((F.min("us") - window_us).alias("since"))
    near = left.join(since, "client").where("us > since and not ok").select(*held.columns)
    counted = trailing_count(held, held.where("not ok").unionByName(near), ["client"], "us", "event_id", window_us, "recent_failures")
    return left.unionByName(counted.select(*left.columns))
