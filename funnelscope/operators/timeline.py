"""Ordered computations over (key, time) that do not put a whole key into one task.

Each works in two levels. Rows are grouped by (key, time bucket), so even a key with a third of all
rows spreads over its buckets; what a bucket needs from earlier ones is one small row per bucket,
carried along the key by a window over those bucket rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DEFAULT_BUCKET_US = 60_000_000


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def _with_bucket(df: DataFrame, us: str, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(us) / F.lit(width)).cast("bigint"))


def _carry(df: DataFrame, keys: list[str], per_bucket: list[Column], carried: list[Column]) -> DataFrame:
    """Rows joined with the values carried into their (key, bucket)."""
    totals = df.groupBy(*keys, "_bucket").agg(*per_bucket)
    offsets = totals.select(*keys, "_bucket", *carried)
    return df.join(offsets, [*keys, "_bucket"])


def _before(keys: list[str]) -> W:
    return W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: list[str], us: str, ties: list[str], value: Column, name: str,
                width: int = DEFAULT_BUCKET_US, whole_key: dict | None = None) -> DataFrame:
    """``name`` = sum of ``value`` over the key's earlier rows and this one, in (us, ties) order.

    ``whole_key`` adds figures of the entire key, as ``{name: (aggregate per bucket, function combining
    buckets)}``; they ride along with the bucket rows, where a join on the key alone would gather a hot key.
    """
    whole_key = whole_key or {}
    rows = _with_bucket(df.withColumn("_v", value.cast("bigint")), us, width)
    staged = _carry(rows, keys, [F.sum("_v").alias("_total"), *[agg.alias(n) for n, (agg, _) in whole_key.items()]],
                    [F.coalesce(F.sum("_total").over(_before(keys)), F.lit(0)).alias("_offset"),
                     *[combine(n).over(W.partitionBy(*keys)).alias(n) for n, (_, combine) in whole_key.items()]])
    here = W.partitionBy(*keys, "_bucket").orderBy(us, *ties).rowsBetween(W.unboundedPreceding, 0)
    return staged.withColumn(name, F.col("_offset") + F.sum("_v").over(here)).drop("_v", "_bucket", "_offset")


def last_before(df: DataFrame, keys: list[str], us: str, ties: list[str], value: Column, name: str,
                include_current: bool, width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """``name`` = the latest non-null ``value`` among the key's earlier rows (and this one if asked)."""
    rows = _with_bucket(df.withColumn("_v", value), us, width)
    order = F.struct(us, *ties)
    latest = F.max_by("_v", F.when(F.col("_v").isNotNull(), order))
    staged = _carry(rows, keys, [latest.alias("_last")],
                    [F.last("_last", ignorenulls=True).over(_before(keys)).alias("_carried")])
    here = W.partitionBy(*keys, "_bucket").orderBy(us, *ties).rowsBetween(
        W.unboundedPreceding, 0 if include_current else -1)
    return staged.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(here), "_carried")).drop(
        "_v", "_bucket", "_carried")


def session_starts(df: DataFrame, keys: list[str], us: str, ties: list[str], is_break, name: str,
                   width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """``name`` = the time at which the row's stretch began; ``is_break(previous, current)`` tells where one begins.

    Breaks inside a bucket show in the bucket itself. Whether its first row begins a stretch depends
    only on the last time before the bucket, so one row per bucket (first, last, last inner break) is
    all that has to be carried along the key.
    """
    bucket = W.partitionBy(*keys, "_bucket").orderBy(us, *ties)
    rows = (_with_bucket(df, us, width).withColumn("_prev", F.lag(us).over(bucket))
            .withColumn("_inner", F.when(F.col("_prev").isNotNull() & is_break(F.col("_prev"), F.col(us)), F.col(us))))
    totals = rows.groupBy(*keys, "_bucket").agg(
        F.min(us).alias("_first"), F.max(us).alias("_last"), F.max("_inner").alias("_last_inner"))
    before = _before(keys)
    earlier = F.max("_last").over(before)
    opens = totals.withColumn("_earlier", earlier).withColumn("_opening", F.when(
        F.col("_earlier").isNull() | is_break(F.col("_earlier"), F.col("_first")), F.col("_first")))
    carried = opens.select(*keys, "_bucket", F.coalesce("_opening", F.last(
        F.coalesce("_last_inner", "_opening"), ignorenulls=True).over(before)).alias("_carried_start"))
    running = F.max("_inner").over(bucket.rowsBetween(W.unboundedPreceding, 0))
    return (rows.withColumn("_running", running).join(carried, [*keys, "_bucket"])
            .withColumn(name, F.coalesce("_running", "_carried_start")).drop("_prev", "_inner", "_running", "_carried_start", "_bucket"))


def merged_starts(df: DataFrame, keys: list[str], first: str, last: str, is_break, name: str, width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """``name`` = the start of the chain of intervals that the row's interval belongs to.

    Intervals of a key chain up in order of ``first``; ``is_break(reach, first)`` tells where the furthest end so far ends a chain.
    Both that reach and the start of the open chain are carried along the key as one row per bucket.
    """
    rows = _with_bucket(df, first, width)
    staged = _carry(rows, keys, [F.max(last).alias("_reach")], [F.max("_reach").over(_before(keys)).alias("_carried_reach")])
    # intervals that begin together open a chain together, whatever their order
    earlier = W.partitionBy(*keys, "_bucket").orderBy(first).rangeBetween(W.unboundedPreceding, -1)
    reach = F.greatest("_carried_reach", F.max(last).over(earlier))
    opened = staged.withColumn("_reach", reach).withColumn("_opens", F.when(
        F.col("_reach").isNull() | is_break(F.col("_reach"), F.col(first)), F.col(first))).drop("_bucket", "_carried_reach", "_reach")
    return last_before(opened, keys, first, [last], F.col("_opens"), name, True, width).drop("_opens")


def trailing_count(probes: DataFrame, hits: DataFrame, keys: list[str], us: str, tie: str, window_us: int,
                   name: str, width: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Probes with ``name`` = hits of the same key strictly before them and strictly newer than ``us - window_us``.

    Written as the difference of two running counts (before the probe, minus up to the window's edge),
    so no frame is ever scanned. ``tie`` (a bigint) orders rows of equal time. Rows that come several times stay as many, and
    a repeated hit counts each time.
    """
    last = F.lit(2**63 - 1)
    row, nothing = F.struct(*probes.columns), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType)
    marks = F.array(
        F.struct(F.col(us).alias("at"), F.col(tie).alias("tie"), F.lit(1).alias("sign"), row.alias("row")),
        F.struct((F.col(us) - window_us).alias("at"), last.alias("tie"), F.lit(-1).alias("sign"), row.alias("row")))
    asked = (probes.select(*keys, F.col(tie).alias("probe"), F.explode(marks).alias("m"))
             .select(*keys, "probe", "m.*", F.lit(0).alias("hit")))
    happened = hits.select(*keys, F.lit(None).cast("bigint").alias("probe"), F.col(us).alias("at"), F.col(tie).alias("tie"),
                           F.lit(0).alias("sign"), nothing.alias("row"), F.lit(1).alias("hit"))
    # a probe at its own hit sorts first, so that hit is not counted
    counted = running_sum(asked.unionByName(happened), keys, "at", ["tie", "hit"], F.col("hit"), "so_far", width)
    # copies of a probe have the same counts: one sum of all of them, dealt out again
    copies = F.count_if(F.col("sign") == 1)
    summed = (counted.filter(F.col("sign") != 0).groupBy(*keys, "probe", "row")
              .agg(F.expr("sum(sign * so_far) div count_if(sign = 1)").alias(name), copies.cast("int").alias("copies")))
    return summed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*", name)
