"""Queries over run bookkeeping and event logs, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.views import audits, table, view, with_views
from funnelscope.operators import outcomes, runstate
from funnelscope.session import work_dir
from funnelscope.sources import checkpoints

QUERIES, ORACLE = {}, {}
HOURS_72 = 72 * 3600
HOURS_6_MS = 6 * 3600 * 1000


def query(name, sql=None, views=()):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return register


# ---- layer results and audits -------------------------------------------------------------------
TITLES = "['Layer 1 - Web Conversion', 'Layer 2 - Paid Acquisition', 'Layer 3 - Organic Search and AEO', 'Layer 4 - Lifecycle and Post-Signup', 'Layer 5 - Competitive Comparison']"
CLASS = """
cl as (select *, case when error_type is null then 'ok' when error_type = 'AuthenticationError' then 'abort'
   when error_type = 'APIStatusError' and contains(lower(error_message), 'credit balance') then 'out_of_credits' else 'failed' end as outcome from fx_layer_runs)"""


@query("layer_failure_classify", f"""
with {CLASS}, r as (select *, case when outcome = 'failed' then case error_type when 'APIStatusError' then 'API error ' || status_code || ': ' || error_message
   when 'APIConnectionError' then 'Connection error: ' || error_message else error_type || ': ' || error_message end end as reason from cl)
select audit_id, layer, outcome, reason, '**' || {TITLES}[layer] || ' could not be completed.** Reason: ' || reason as failed_notes from r""", ("fx_layer_runs",))
def _(spark, sf):
    return outcomes.layer_failure_classify(view(spark, sf, "fx_layer_runs")).select("audit_id", "layer", "outcome", "reason", "failed_notes")


@query("audit_outcome", f"""
with {CLASS},
st as (select audit_id, min(layer) filter (outcome in ('abort', 'out_of_credits') or (layer = 6 and outcome = 'failed' and contains(lower(error_message), 'credit balance'))) as stop_layer from cl group by audit_id),
x as (select cl.*, st.stop_layer from cl join st on st.audit_id = cl.audit_id),
a as (select audit_id, max(case when layer = stop_layer then case when outcome = 'abort' then 'abort' else 'credits' end end) as how,
   coalesce(list(layer order by layer) filter (outcome = 'ok' and layer <= 5 and layer < coalesce(stop_layer, 99)), []) as done, coalesce(list(layer order by layer) filter (outcome = 'failed' and layer <= 5 and layer < coalesce(stop_layer, 99)), []) as failed,
   coalesce(bool_or(layer = 6 and outcome = 'failed'), false) as write_up_failed from x group by audit_id),
s as (select *, case when how = 'abort' then 'error' when how = 'credits' then 'out_of_credits' when write_up_failed or len(failed) > 0 then 'partial' else 'complete' end as status from a)
select audit_id, status, case when how = 'abort' then 'The API key was rejected.' when how = 'credits' then 'The API account is out of credit; completed layers are saved.'
   when write_up_failed then 'The final synthesis step failed.' when len(failed) > 0 then len(failed) || ' layer(s) could not be completed.' else '' end as message,
  array_to_string(list_transform(case when how = 'credits' then list_filter([1, 2, 3, 4, 5], lambda x: not list_contains(done, x)) when how = 'abort' then [] else failed end, lambda x: {TITLES}[x]), '|') as failed_layers,
  case status when 'complete' then 0 when 'out_of_credits' then 2 else 1 end as exit_code from s""", ("fx_layer_runs",))
def _(spark, sf):
    out = outcomes.audit_outcome(outcomes.layer_failure_classify(view(spark, sf, "fx_layer_runs")))
    return out.withColumn("failed_layers", F.array_join("failed_layers", "|"))


LATEST = "ls as (select audit_id, layer, arg_max(status, event_id) as status from fx_events where type = 'layer' group by audit_id, layer)"


def ordered(spark, sf):
    """The event log with its (time, id) order; ids rise with time."""
    return view(spark, sf, "fx_events").withColumn("seq", F.struct("ts", "event_id"))


@query("layer_state_latest", f"with {LATEST} select audit_id, layer, status from ls", ("fx_events",))
def _(spark, sf):
    return runstate.layer_state_latest(ordered(spark, sf))


@query("incomplete_layers", f"""
with {LATEST}, d as (select audit_id, coalesce(list(layer) filter (status = 'done'), []) as done from ls group by audit_id)
select audit_id, array_to_string(list_transform(list_filter([1, 2, 3, 4, 5], lambda x: not list_contains(done, x)), lambda x: 'L' || x), ', ') as incomplete from d""", ("fx_events",))
def _(spark, sf):
    return outcomes.incomplete_layers(runstate.layer_state_latest(ordered(spark, sf)))


def finished_layers(spark, sf):
    """Layers done so far: one per kind of page a site has."""
    sites, pages = view(spark, sf, "fx_sites"), view(spark, sf, "fx_pages")
    return (sites.join(pages.select(F.col("site").alias("url"), "page_id"), "url")
            .select("audit_id", (F.col("page_id") % 5 + 1).cast("int").alias("layer")).distinct())


@query("resume_missing_layers", f"""
with done as (select distinct s.audit_id, p.page_id % 5 + 1 as layer from fx_sites s join fx_pages p on p.site = s.url),
a as (select audit_id, unnest([1, 2, 3, 4, 5]) as layer from fx_sites)
select a.audit_id, a.layer, {TITLES}[a.layer] as title from a left join done d on d.audit_id = a.audit_id and d.layer = a.layer
where d.layer is null or a.audit_id % 3 = 0 or (a.layer = 5 and a.audit_id % 5 = 1)""", ("fx_sites",))
def _(spark, sf):
    a = audits(spark, sf)
    saved = a.select("audit_id", F.when(F.col("audit_id") % 3 == 0, F.lit("https://elsewhere")).otherwise(F.col("url")).alias("url"), "icp",
                     F.when(F.col("audit_id") % 5 == 1, F.array_append("competitors", F.lit("https://new.rival"))).otherwise(F.col("competitors")).alias("competitors"))
    return outcomes.resume_missing_layers(a, saved, finished_layers(spark, sf))


def run_times(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("audit_id")).agg(
        F.min("ts").alias("started"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("finished"))


@query("recent_audits", "select user_id as audit_id, min(ts) as started from events group by user_id order by started desc, audit_id limit 6")
def _(spark, sf):
    return outcomes.recent_audits(run_times(spark, sf).select("audit_id", "started"))


@query("run_duration", """
select user_id as audit_id, cast(floor((epoch_us(coalesce(max(ts) filter (event_type = 'purchase'), timestamp '2024-02-01 00:00:00')) - epoch_us(min(ts))) / 1000000.0) as bigint) as duration from events group by user_id""")
def _(spark, sf):
    return run_times(spark, sf).select("audit_id", runstate.run_duration(
        F.col("started"), F.col("finished"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("duration"))


REQUESTS = """select page_id, case page_id % 3 when 0 then url when 1 then 'no host' else '' end as url, case when page_id % 2 = 0 then html else ' abc ' end as icp,
  case page_id % 4 when 0 then 'square.com, ' || url || ',' when 1 then 'fine.org,bad host,worse host' else '' end as competitors from pages"""


@query("request_validate", f"""
with r as ({REQUESTS}),
e as (select *, list_filter([case when page_id % 3 <> 0 then 'url: Enter a valid website, e.g. https://www.example.com' end, case when page_id % 2 = 1 then 'icp: Describe the ideal customer this audit should be read through' end,
   case when page_id % 4 = 1 then 'competitors: ''bad host'' doesn''t look like a website' end], lambda x: x is not null) as errors from r)
select page_id, array_to_string(errors, '|') as errors, case when len(errors) = 0 then lower(split_part(url, '/', 1) || '//' || split_part(url, '/', 3)) end as clean_url,
  case when len(errors) = 0 then case when page_id % 4 = 0 then 'https://square.com|' || lower(split_part(url, '/', 1) || '//' || split_part(url, '/', 3)) else '' end end as clean_competitors from e""")
def _(spark, sf):
    checked = outcomes.request_validate(spark.sql(REQUESTS.replace("from pages", "from {p}"), p=table(spark, sf, "pages")))
    return checked.select("page_id", F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "|").alias("errors"),
                          "clean_url", F.array_join("clean_competitors", "|").alias("clean_competitors"))


@query("checkpoint_roundtrip", """
select audit_id, layer, arg_max(text, event_id) as notes from fx_events where type = 'layer' and status = 'done' group by audit_id, layer""", ("fx_events",))
def _(spark, sf):
    done = view(spark, sf, "fx_events").filter("type = 'layer' and status = 'done'").select(
        "audit_id", "layer", F.col("text").alias("notes"), F.col("ts").alias("finished_at"))
    folder = f"{work_dir(spark)}/completed-layers-{uuid.uuid4().hex}"
    checkpoints.checkpoint_write(done, folder)
    return checkpoints.checkpoint_read(spark, folder)


@query("checkpoint_resume", """
with done as (select audit_id, layer, arg_max(text, event_id) as notes from fx_events where type = 'layer' and status = 'done' group by audit_id, layer),
a as (select audit_id, count(*) filter (type = 'layer' and status = 'done' and layer = 5) > 0 as fifth from fx_events group by audit_id),
s as (select audit_id, case when audit_id % 11 = 0 then 'none' when audit_id % 7 = 0 then 'other target' when audit_id % 5 = 0 and fifth then 'competitors changed' else 'resumed' end as state from a)
select s.audit_id, state, case when state in ('none', 'other target') then null else 'growth' end as keyword, case when state in ('none', 'other target') then null else 'https://s' || s.audit_id end as source,
  coalesce(string_agg(layer || ':' || coalesce(notes, ''), '|' order by layer) filter (state = 'resumed' or state = 'competitors changed' and layer <> 5), '') as completed
from s left join done on done.audit_id = s.audit_id group by s.audit_id, state""", ("fx_events",))
def _(spark, sf):
    events, folder = view(spark, sf, "fx_events"), f"{work_dir(spark)}/checkpoints-{uuid.uuid4().hex}"
    done = events.filter("type = 'layer' and status = 'done'").select("audit_id", "layer", F.col("text").alias("notes"), F.col("ts").alias("finished_at"))
    checkpoints.checkpoint_write(done, f"{folder}/layers")
    made = events.groupBy("audit_id").agg(F.max("ts").cast("timestamp").alias("saved_at")).selectExpr(
        "audit_id", "concat('https://c', audit_id) as url", "'teams' as icp", "array('a', 'b') as competitors", "array('growth') as keywords",
        "map('Home', concat('https://s', audit_id)) as sources", "saved_at")
    checkpoints.headers_write(made, f"{folder}/headers")
    checkpoints.checkpoints_remove(made.filter("audit_id % 11 = 0").withColumnRenamed("saved_at", "removed_at"), f"{folder}/removed")
    asked = made.selectExpr("audit_id", "if(audit_id % 7 = 0, 'https://other', url) as url", "icp", "if(audit_id % 5 = 0, array('a'), competitors) as competitors")
    found = checkpoints.checkpoint_resume(spark, asked, f"{folder}/layers", f"{folder}/headers", f"{folder}/removed")
    listed = F.array_join(F.transform("completed", lambda x: F.concat(x["layer"].cast("string"), F.lit(":"), F.coalesce(x["notes"], F.lit("")))), "|")
    return found.select("audit_id", "state", F.get("keywords", 0).alias("keyword"), F.col("sources")["Home"].alias("source"), listed.alias("completed"))


# ---- event logs ---------------------------------------------------------------------------------
SEQ = """
sq as (select *, row_number() over (partition by audit_id order by ts, event_id) - 1 as seq,
  round((epoch_us(ts) - epoch_us(min(ts) over (partition by audit_id))) / 1000000.0, 1) as t from fx_events)"""


@query("event_sequence", f"with {SEQ} select audit_id, event_id, seq, t from sq", ("fx_events",))
def _(spark, sf):
    return runstate.event_sequence(view(spark, sf, "fx_events")).select("audit_id", "event_id", "seq", "t")


LAST_ID = "case when audit_id % 3 = 0 then '10' when audit_id % 3 = 1 then 'abc' end"


@query("events_replay", f"with {SEQ} select audit_id, event_id, seq, type from sq where seq > coalesce(try_cast({LAST_ID} as bigint), -1)", ("fx_events",))
def _(spark, sf):
    log = runstate.event_sequence(view(spark, sf, "fx_events"))
    return runstate.events_replay(log, F.expr(LAST_ID)).select("audit_id", "event_id", "seq", "type")


@query("step_phase", """
select audit_id, event_id, case when step <= 2 then 'prep' when step = 8 then 'report' else 'layer' end as phase from fx_events where type = 'step'""", ("fx_events",))
def _(spark, sf):
    return view(spark, sf, "fx_events").filter("type = 'step'").select("audit_id", "event_id", runstate.step_phase(F.col("step")).alias("phase"))


@query("progress_percent", f"""
with {LATEST},
p as (select audit_id, sum(case when status in ('done', 'failed') then 17 when status = 'running' then 5 else 0 end) as points from ls group by audit_id),
a as (select audit_id, coalesce(bool_or(type = 'layer'), false) as began, coalesce(bool_or(type = 'step' and step = 8), false) as report, coalesce(bool_or(type = 'complete' and status <> 'failed'), false) as complete
  from fx_events where type in ('layer', 'step', 'complete') group by audit_id)
select a.audit_id, cast(case when complete then 100 when report then greatest(93, case when began then 6 else 2 end + coalesce(points, 0)) else case when began then 6 else 2 end + coalesce(points, 0) end as integer) as percent
from a left join p on p.audit_id = a.audit_id""", ("fx_events",))
def _(spark, sf):
    # a failed completion stands for a run that ended in an error
    log = ordered(spark, sf).withColumn("status", F.when((F.col("type") == "complete") & (F.col("status") == "failed"), "error").otherwise(F.col("status")))
    return runstate.progress_percent(log)


@query("elapsed_clock", f"""
with {SEQ}, s as (select audit_id, event_id, cast(floor(t) as bigint) as s from sq)
select audit_id, event_id, case when s >= 3600 then (s // 3600) || ':' else '' end || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as clock from s""", ("fx_events",))
def _(spark, sf):
    log = runstate.event_sequence(view(spark, sf, "fx_events"))
    return log.select("audit_id", "event_id", runstate.elapsed_clock(F.col("t")).alias("clock"))


@query("log_tail", """
select audit_id, event_id, text from (select *, row_number() over (partition by audit_id order by ts desc, event_id desc) as back from fx_events where type = 'log') q where back <= 5""", ("fx_events",))
def _(spark, sf):
    return runstate.log_tail(view(spark, sf, "fx_events"), keep=5).select("audit_id", "event_id", "text")


@query("running_activity", """
with e as (select *, case when type = 'layer' then case when status = 'running' then layer else 0 end end as s from fx_events where type = 'layer' or (type = 'log' and level = 'activity')),
h as (select *, last_value(s ignore nulls) over (partition by audit_id order by ts, event_id rows between unbounded preceding and current row) as held from e)
select audit_id, held as layer, arg_max(trim(text), event_id) as activity from h where type = 'log' and held > 0 group by audit_id, held""", ("fx_events",))
def _(spark, sf):
    return runstate.running_activity(view(spark, sf, "fx_events"))


@query("notes_upsert", """
select audit_id, layer, left(arg_max(text, event_id), 20000) as text, max(saved_at) as saved_at from fx_notes where layer in ('1', '2', '3', '4', '5') group by audit_id, layer""", ("fx_notes",))
def _(spark, sf):
    return runstate.notes_upsert(view(spark, sf, "fx_notes"))


@query("edit_sessions", """
with g as (select *, case when saved_at - lag(saved_at) over w < interval 6 hours then 0 else 1 end as fresh from fx_notes window w as (partition by audit_id, layer order by saved_at, event_id)),
s as (select *, sum(fresh) over (partition by audit_id, layer order by saved_at, event_id rows unbounded preceding) as session from g)
select audit_id, layer, min(saved_at) as session_start, max(saved_at) as last_edit, count(*) as edits, arg_max(text, event_id) as text from s group by audit_id, layer, session""", ("fx_notes",))
def _(spark, sf):
    return runstate.edit_sessions(view(spark, sf, "fx_notes"), gap_ms=HOURS_6_MS)


@query("failure_rate_window", f"""
select client, event_id, ok, count(*) filter (not ok) over (partition by client order by epoch_us(ts) range between {HOURS_72 * 1_000_000 - 1} preceding and 1 preceding) as recent_failures from fx_attempts""", ("fx_attempts",))
def _(spark, sf):
    return runstate.failure_rate_window(view(spark, sf, "fx_attempts"), HOURS_72).select("client", "event_id", "ok", "recent_failures")


LOCKOUT = f"""
with recursive a as (select client, event_id, ok, epoch_us(ts) as us, row_number() over (partition by client order by ts, event_id) as n from fx_attempts),
r as (select client, n, event_id, cast(0 as bigint) as seen, case when ok then [] else [us] end as kept, case when ok then 'ok' else 'rejected' end as outcome from a where n = 1
  union all
  select a.client, a.n, a.event_id, len(w), case when a.ok or len(w) >= 5 then w else list_append(w, a.us) end, case when len(w) >= 5 then 'locked' when a.ok then 'ok' else 'rejected' end
  from (select *, list_filter(kept, lambda x: x > next_us - {HOURS_72 * 1_000_000}) as w from (select r.client, r.n, r.kept, b.us as next_us from r join a b on b.client = r.client and b.n = r.n + 1) j) p
  join a on a.client = p.client and a.n = p.n + 1)
select client, event_id, outcome, seen as recorded_failures from r"""


@query("lockout_replay")
def _(spark, sf):
    return runstate.lockout_replay(view(spark, sf, "fx_attempts"), window_s=HOURS_72).select("client", "event_id", "outcome", "recorded_failures")


ORACLE["lockout_replay"] = with_views("", "fx_attempts").replace("with ", "with recursive ", 1) + ",\n" + LOCKOUT.strip()[len("with recursive "):]
