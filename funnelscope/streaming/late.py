"""Rows behind the watermark, told apart and counted instead of dropped.

``tagged`` marks each row that is older than the watermark of its micro-batch. ``split_late`` writes marked rows and the rest as two
tables, a sub-folder per batch in each, so a batch that runs again replaces its own. Main and late rows together are all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"
SPREAD = 256     # groups that rows are dealt over; they hold no state


def tagged(events: DataFrame, ts: str, delay: str = WATERMARK, spread_by: str = "event_id") -> DataFrame:
    """``events`` with ``late``: true where ``ts`` (a timestamp) lies before the watermark. Null times are never late."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)

    def mark(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        edge = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for rows in batches:
            yield rows.drop(columns="_group").assign(late=(rows[ts] < edge).fillna(False).astype(bool))
    dealt = events.withWatermark(ts, delay).withColumn("_group", F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)))
    return dealt.groupBy("_group").applyInPandasWithState(
        mark, f"{fields}, late boolean", "unused int", "append", GroupStateTimeout.NoTimeout)


def split_late(folder: str, main: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` over tagged rows: late ones to ``late``, the others to ``main`` or, without one, to a table of that name."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()      # the batch's rows are tagged once
        try:
            kept.where("late").drop("late").write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
            rest = kept.where("not late").drop("late")
            if main is None:
                rest.write.mode("overwrite").parquet(f"{folder}/main/batch={batch_id}")
            else:
                main(rest, batch_id)
        finally:
            kept.unpersist()
    return write


def _rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, batch bigint").parquet(folder)


def main_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Every row in time, with the ``batch`` it came in."""
    return _rows(spark, f"{folder}/main", schema)


def late_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Every late row, with the ``batch`` it came in."""
    return _rows(spark, f"{folder}/late", schema)


def late_counts(spark: SparkSession, folder: str, schema) -> DataFrame:
    """``batch, late_rows``, batches without late rows left out."""
    return late_rows(spark, folder, schema).groupBy("batch").agg(F.count(F.lit(1)).alias("late_rows"))
