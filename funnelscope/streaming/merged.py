"""Tables that micro-batches add to and that lose nothing, whatever the order of the rows.

Every micro-batch becomes a delta of its own, named by its id, so a batch that runs again replaces what it wrote. ``combine`` turns
rows of any number of deltas into the merged rows, and must give the same whether it merges them at once or step by step. A
compaction merges all deltas up to an id into a base; readers see a base only once Spark has committed it whole, and skip the deltas it
holds. Until then they read the former base and the deltas, so a compaction that fails changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from funnelscope import fixed_values as fv
from funnelscope.operators.runstate import merged_slots, progress_slots, slots_percent, valid_notes
from funnelscope.operators.timeline import DEFAULT_BUCKET_US, merged_starts, micros

DELTA, BASE, COMMITTED = "batch=", "upto=", "_SUCCESS"


class MergedTable:
    """The table in ``folder``: ``prepare`` makes a batch's rows ready, ``combine`` merges ready rows with any others."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, combine: Callable[[DataFrame], DataFrame],
                 prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.spark, self.folder, self.schema, self.combine, self.prepare = spark, folder, schema, combine, prepare

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        self.combine(self.prepare(batch)).write.mode("overwrite").parquet(f"{self.folder}/{DELTA}{batch_id}")

    def _committed(self, prefix: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix)
                      and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/{COMMITTED}")))

    def _paths(self) -> tuple[list[str], int]:
        bases, deltas = self._committed(BASE), self._committed(DELTA)
        upto = bases[-1] if bases else -1
        paths = [f"{self.folder}/{BASE}{upto}"] if bases else []
        return paths + [f"{self.folder}/{DELTA}{i}" for i in deltas if i > upto], max([upto, *deltas])

    def read(self) -> DataFrame:
        """The merged rows."""
        paths, _ = self._paths()
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return self.combine(rows).select(*rows.columns)

    def compact(self) -> None:
        """All that is there becomes one base; call it between batches, now and then."""
        paths, upto = self._paths()
        if len(paths) > 1:
            self.read().write.mode("overwrite").parquet(f"{self.folder}/{BASE}{upto}")


def notes_table(spark: SparkSession, folder: str) -> MergedTable:
    """Latest note of every (audit, layer). A save that comes late still wins where it is the newest."""
    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("audit_id", "layer").agg(
            F.max(F.struct("saved_at", "event_id", "text")).alias("last")).select("audit_id", "layer", "last.*")
    return MergedTable(spark, folder, "audit_id bigint, layer string, saved_at timestamp, event_id bigint, text string", latest, valid_notes)


def sessions_table(spark: SparkSession, folder: str, gap_ms: int = fv.NOTE_SAVE_DELAY_MS, width: int = DEFAULT_BUCKET_US) -> MergedTable:
    """Bursts of note edits, open ones included: pieces of a session that lie less than ``gap_ms`` apart become one.

    Redelivered edits count as often as they come, as in the batch form.
    """
    keys = ["audit_id", "layer"]

    def pieces(edits: DataFrame) -> DataFrame:
        us = micros(F.col("saved_at"))
        return edits.select(*keys, us.alias("first_us"), us.alias("last_us"), F.lit(1).cast("bigint").alias("edits"),
                            F.struct(us.alias("us"), "event_id", "text").alias("latest"))

    def joined(rows: DataFrame) -> DataFrame:
        started = merged_starts(rows, keys, "first_us", "last_us", lambda before, now: now - before >= gap_ms * 1000, "_start", width)
        return started.groupBy(*keys, F.col("_start").alias("first_us")).agg(
            F.max("last_us").alias("last_us"), F.sum("edits").alias("edits"), F.max("latest").alias("latest"))
    schema = "audit_id bigint, layer string, first_us bigint, last_us bigint, edits bigint, latest struct<us: bigint, event_id: bigint, text: string>"
    return MergedTable(spark, folder, schema, joined, pieces)


def sessions(table: MergedTable) -> DataFrame:
    """``audit_id, layer, session_start, last_edit, edits, text`` of every session so far."""
    return table.read().select("audit_id", "layer", F.timestamp_micros("first_us").alias("session_start"),
                               F.timestamp_micros("last_us").alias("last_edit"), "edits", F.col("latest.text").alias("text"))


def closed_sessions(table: MergedTable, now, gap_ms: int = fv.NOTE_SAVE_DELAY_MS) -> DataFrame:
    """Sessions that no edit at ``now`` or later can reach."""
    return sessions(table).where(micros(F.col("last_edit")) + gap_ms * 1000 <= micros(now))


def failure_windows_table(spark: SparkSession, folder: str, window_s: int = fv.LOGIN_WINDOW_SECONDS, slide: str = "1 minute") -> MergedTable:
    """Failures per client and sliding window, open windows included; counts of batches add up."""
    def pieces(attempts: DataFrame) -> DataFrame:
        seen = attempts.where(~F.col("ok")).select("client", F.col("ts").cast("timestamp").alias("ts"))
        return seen.select("client", F.window("ts", f"{window_s} seconds", slide).alias("w"), F.lit(1).cast("bigint").alias("failures")).select(
            "client", F.col("w.end").alias("until"), "failures")

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("client", "until").agg(F.sum("failures").alias("failures"))
    return MergedTable(spark, folder, "client bigint, until timestamp, failures bigint", summed, pieces)


def progress_table(spark: SparkSession, folder: str) -> MergedTable:
    """Last status of each layer, report step and completion of each audit; ``progress`` reads the bar off them.

    A layer's newer status takes the place of its former one, whichever comes first.
    """
    def pieces(events: DataFrame) -> DataFrame:
        return progress_slots(events, F.struct(micros(F.col("ts")).alias("us"), F.col("event_id").cast("bigint").alias("event_id")))
    schema = ("audit_id bigint, slot int, latest struct<at: struct<us: bigint, event_id: bigint>, status: string>, report boolean, complete boolean")
    return MergedTable(spark, folder, schema, merged_slots, pieces)


def progress(table: MergedTable) -> DataFrame:
    """``audit_id, percent`` as of the batches written so far."""
    return slots_percent(table.read())
