"""The streaming operators run to the end of the given event table, each with the SQL of its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.runs import HOURS_72, LATEST, ORACLE as RUNS_SQL, SEQ
from checks.views import VIEWS, view, with_views
from funnelscope.session import work_dir
from funnelscope.streaming import late, merged, ordered, state

QUERIES, ORACLE = {}, {}


def query(name, sql=None, views=()):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views) if views else sql
        return fn
    return register


def stream(spark, sf, name):
    """A derived event table as a stream over the events file; every micro-batch goes through the same SQL."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return spark.sql(VIEWS[name].replace("from events", "from {events}"), events=events)


def landed(spark, df, name):
    """Appended rows of a stream run until its input is used up."""
    folder = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(
        availableNow=True).format("parquet").start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


@query("stream_event_sequence", f"with {SEQ} select audit_id, event_id, seq, t from sq", ("fx_events",))
def _(spark, sf):
    numbered = state.sequence_stream(stream(spark, sf, "fx_events").select("audit_id", "event_id", "ts"))
    return landed(spark, numbered, "sequence").select("audit_id", "event_id", "seq", "t")


def in_order(spark, df, name, **held):
    """Rows that an ordered stream has let go by the end of its input, and those it still holds."""
    folder, (key, value) = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}", ordered.ROCKSDB
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        df.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(
            availableNow=True).format("parquet").start(f"{folder}/rows").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows"), ordered.waiting(spark, f"{folder}/progress", **held)


@query("stream_event_order", f"with {SEQ} select audit_id, event_id, seq, t from sq", ("fx_events",))
def _(spark, sf):
    left, held = in_order(spark, ordered.numbered(stream(spark, sf, "fx_events")), "order")
    return ordered.closed(left, held).select("audit_id", "event_id", "seq", "t")


@query("stream_failure_rate", RUNS_SQL["failure_rate_window"])
def _(spark, sf):
    counts = ordered.failure_counts(stream(spark, sf, "fx_attempts"), HOURS_72)
    left, held = in_order(spark, counts, "failure-rate", key="client", fields=ordered.FailureCounts.FIELDS)
    return ordered.closed_counts(left, held, HOURS_72).select("client", "event_id", "ok", "recent_failures")


@query("stream_layer_state", f"with {LATEST} select audit_id, layer, status from ls", ("fx_events",))
def _(spark, sf):
    folder = f"{work_dir(spark)}/layer-state-{uuid.uuid4().hex}"

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
    states = state.layer_state_stream(stream(spark, sf, "fx_events"))
    states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(
        availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.schema(f"audit_id bigint, layer int, status string, batch int").parquet(f"{folder}/rows")
    return rows.groupBy("audit_id", "layer").agg(F.max_by("status", "batch").alias("status"))


@query("stream_lockout", RUNS_SQL["lockout_replay"].replace("select client, event_id, outcome, seen as recorded_failures from r", "select client, event_id, outcome from r"))
def _(spark, sf):
    judged = state.lockout_stream(stream(spark, sf, "fx_attempts"), window_s=HOURS_72)
    return landed(spark, judged, "lockout").select("client", "event_id", "outcome")


def merged_into(spark, df, name, make):
    """The merged table of a stream run until its input is used up, compacted once it is."""
    folder = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    kept = make(f"{folder}/rows")
    df.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(kept.write).start().awaitTermination()
    kept.compact()
    return kept


@query("stream_notes_upsert", """
select audit_id, layer, left(arg_max(text, event_id), 20000) as text from fx_notes where layer in ('1', '2', '3', '4', '5') group by audit_id, layer""", ("fx_notes",))
def _(spark, sf):
    notes = stream(spark, sf, "fx_notes").withColumn("saved_at", F.col("saved_at").cast("timestamp"))
    kept = merged_into(spark, notes, "notes", lambda folder: merged.notes_table(spark, folder))
    return kept.read().select("audit_id", "layer", "text")


@query("stream_edit_sessions", """
with g as (select *, case when saved_at - lag(saved_at) over w < interval 6 hours then 0 else 1 end as fresh from fx_notes window w as (partition by audit_id, layer order by saved_at, event_id)),
s as (select *, sum(fresh) over (partition by audit_id, layer order by saved_at, event_id rows unbounded preceding) as session from g)
select audit_id, layer, min(saved_at) as session_start, max(saved_at) as last_edit, count(*) as edits, arg_max(text, event_id) as text from s group by audit_id, layer, session""", ("fx_notes",))
def _(spark, sf):
    edits = stream(spark, sf, "fx_notes")
    kept = merged_into(spark, edits, "sessions", lambda folder: merged.sessions_table(spark, folder, 6 * 3600 * 1000, 86_400_000_000))
    plain = {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "last_edit")}
    return merged.sessions(kept).withColumns(plain)


@query("stream_failure_windows", """
with f as (select client, epoch_us(ts) as us from fx_attempts where not ok),
w as (select client, us, unnest(range(cast(floor(us / 3600000000.0) as bigint) - 5, cast(floor(us / 3600000000.0) as bigint) + 1)) as h from f)
select client, make_timestamp((h + 6) * 3600000000) as until, count(*) as failures from w group by client, h""", ("fx_attempts",))
def _(spark, sf):
    kept = merged_into(spark, stream(spark, sf, "fx_attempts"), "failures", lambda folder: merged.failure_windows_table(spark, folder, 6 * 3600, "1 hour"))
    return kept.read().withColumn("until", F.col("until").cast("timestamp_ntz"))


@query("stream_late_split", "select audit_id, event_id, type from fx_events", ("fx_events",))
def _(spark, sf):
    """Main and late rows together: every event once."""
    folder = f"{work_dir(spark)}/late-{uuid.uuid4().hex}"
    events = stream(spark, sf, "fx_events").withColumn("ts", F.col("ts").cast("timestamp")).select("audit_id", "event_id", "type", "ts")
    late.tagged(events, "ts").writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(
        late.split_late(folder)).start().awaitTermination()
    rows = late.main_rows(spark, folder, events.schema).unionByName(late.late_rows(spark, folder, events.schema))
    return rows.select("audit_id", "event_id", "type")


@query("stream_progress", RUNS_SQL["progress_percent"])
def _(spark, sf):
    # as in the batch form, a failed completion stands for a run that ended in an error
    failed = (F.col("type") == "complete") & (F.col("status") == "failed")
    events = stream(spark, sf, "fx_events").withColumn("status", F.when(failed, "error").otherwise(F.col("status")))
    kept = merged_into(spark, events, "progress", lambda folder: merged.progress_table(spark, folder))
    return merged.progress(kept)


@query("stream_log_tail", """
select audit_id, event_id from (select *, row_number() over (partition by audit_id order by ts desc, event_id desc) as back from fx_events where type = 'log') q where back <= 5""", ("fx_events",))
def _(spark, sf):
    lines = landed(spark, state.log_tail_stream(stream(spark, sf, "fx_events"), 5), "log-tail")
    last = lines.groupBy("audit_id").agg(F.max("line").alias("last"))
    return lines.join(last, "audit_id").filter("line > last - 5").select("audit_id", "event_id")
