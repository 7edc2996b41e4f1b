"""The end-to-end graphs, and what the physical plans must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import pages as pg, reports as rp
from checks.views import audits, view
from funnelscope.plans import audit

# one of each family; the streaming ones run to the end when they are called
SAMPLED = ["domain_rollup", "capture_resolve", "page_candidates_top6", "organic_rank", "answer_mention_share", "lockout_replay",
           "resume_missing_layers", "report_build", "event_sequence"]


@pytest.mark.parametrize("name", SAMPLED)
def test_no_cross_joins(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    plan = entry.queries()["bare_domain"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[1]


def test_page_graph_and_reports(spark, sf_dir):
    a = audits(spark, sf_dir)
    got = audit.audit_pages(view(spark, sf_dir, "fx_captures"), a)
    assert got["pages"].count() == got["fetch_log"].count()
    assert {r["layer"] for r in got["findings"].select("layer").distinct().collect()} == {1, 3}
    built = audit.final_reports(a, rp.bodies(spark, sf_dir), rp.layer_notes(spark, sf_dir), got, rp.audit_sources(spark, sf_dir))
    assert built.count() == a.count()
    mined = audit.mine_saved_reports(built.select("audit_id", "markdown"))
    with_finding = got["findings"].select("audit_id").distinct().count()
    opening = F.exists("observations", lambda o: (o["layer"] == 1) & F.contains(o["items"][0]["observed"], F.lit("injected via JavaScript")))
    assert mined.filter(opening).count() == with_finding > 0


def test_run_graph(spark, sf_dir):
    got = audit.run_state(view(spark, sf_dir, "fx_events"))
    percents = [r["percent"] for r in got["progress"].collect()]
    assert percents and all(2 <= p <= 100 for p in percents)
    assert got["log"].count() == view(spark, sf_dir, "fx_events").count()
    assert got["tail"].count() > 0 and got["activity"].count() > 0


def test_response_graph(spark, sf_dir):
    blocks = view(spark, sf_dir, "fx_blocks").withColumns({
        "tool_input": F.create_map(F.lit("query"), F.col("text")),
        "citations": F.array(F.struct(F.lit("u").alias("url"), F.lit("t").alias("title"))),
        "results": F.array(F.struct(F.lit("v").alias("url"), F.lit("").alias("title")))})
    got = audit.audit_responses(blocks, view(spark, sf_dir, "fx_layer_runs"))
    assert all(df.count() > 0 for df in got.values())
    keys = got["sources"].select("audit_id", "url")
    assert keys.count() == keys.distinct().count()
