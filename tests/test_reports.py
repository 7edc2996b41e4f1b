"""Reports written, read back and mined; checkpoints on disk."""

import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from funnelscope import fixed_values as fv
from funnelscope.operators import markdown as md, report
from funnelscope.sources import checkpoints, report_files

word = st.text(alphabet="abcdefgh ", min_size=1, max_size=12).map(str.strip).filter(bool)
AUDIT = st.fixed_dictionaries({
    "icp": word, "competitors": st.lists(st.sampled_from(["https://x.com", "https://y.org"]), unique=True),
    "keywords": st.lists(word, min_size=1, max_size=4), "notes": st.dictionaries(st.integers(1, 5), word, max_size=5),
    "analyst": st.dictionaries(st.integers(1, 5), word, max_size=5), "log": st.lists(word, min_size=1, max_size=3),
    "sources": st.dictionaries(st.sampled_from(["https://s.com/a", "https://s.com/b"]), word)})
ROW = ("company string, url string, icp string, date string, competitors array<string>, keywords array<string>, body string, "
       "notes array<struct<layer:int,text:string>>, analyst_notes array<struct<layer:int,text:string>>, fetch_log array<string>, "
       "sources array<struct<url:string,title:string>>")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(AUDIT, min_size=5, max_size=5))
def test_round_trip(spark, audits):
    rows = [("acme", "https://acme.com", a["icp"], "2024-01-30", a["competitors"], a["keywords"], "## 2. What's Working\n- fine",
             sorted(a["notes"].items()), sorted(a["analyst"].items()), a["log"], sorted(a["sources"].items())) for a in audits]
    built = spark.createDataFrame(rows, ROW).select(F.monotonically_increasing_id().alias("id"), report.report_markdown().alias("markdown"))
    for row, back in zip(audits, md.load_reports(built).orderBy("id").collect()):
        assert (back["url"], back["icp"], back["date"], back["company"]) == ("https://acme.com", row["icp"], "2024-01-30", "acme")
        assert back["competitors"] == row["competitors"] and back["keywords"] == row["keywords"]
        assert back["body"] == "## 2. What's Working\n- fine"
        assert {n["layer"]: n["text"] for n in back["analyst_notes"]} == row["analyst"]
        assert back["fetch_log"] == row["log"]
        assert {s["url"]: s["title"] for s in back["sources"]} == row["sources"]
        for layer in back["layers"]:
            note = row["notes"].get(layer["layer"])
            assert layer["status"] == ("done" if note else "failed")
            assert layer["notes"] == (note or fv.NOT_RUN)


def test_report_files(spark, tmp_path):
    rows = [(1, "acme", "2024-01-30", "# old\n"), (2, "acme", "2024-01-30", "# new\n\nx\n"), (3, "b", "2024-01-31", "# b")]
    df = spark.createDataFrame(rows, "audit_id bigint, company string, date string, markdown string")
    folder = str(tmp_path / "reports")
    report_files.report_files_write(df, folder)
    report_files.report_files_write(df.filter("audit_id = 3").withColumn("markdown", F.lit("# again")), folder)
    (tmp_path / "reports" / "loose.md").write_text("# loose\r\n")
    got = sorted(r["markdown"] for r in report_files.report_files_read(spark, folder).collect())
    assert got == ["# again\n", "# loose\r\n", "# new\n\nx\n"]


def test_checkpoints(spark, tmp_path):
    assert checkpoints.checkpoint_read(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "c", 1)], "audit_id bigint, layer int, notes string, s bigint")
    rows = rows.withColumn("finished_at", F.timestamp_seconds("s"))
    folder = str(tmp_path / "layers")
    checkpoints.checkpoint_write(rows.filter("s = 1"), folder)
    checkpoints.checkpoint_write(rows.filter("s = 2"), folder)
    assert {(r["layer"], r["notes"]) for r in checkpoints.checkpoint_read(spark, folder).collect()} == {(1, "b"), (2, "c")}


def test_old_checkpoint_files(spark, tmp_path):
    good = {"url": "https://a.b", "icp": "i", "competitors": [], "keywords": ["k"], "completed": {fv.LAYER_TITLES[2]: "n"}, "sources": {"u": "t"}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "b.json").write_text('{"url": "https://c.d", ')
    rows = checkpoints.checkpoint_files_read(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and [(x["layer"], x["notes"]) for x in rows[0]["layers"]] == [(3, "n")]


def test_scope_defaults(spark):
    df = spark.createDataFrame([("no scope here",)], "markdown string")
    got = md.load_reports(df, F.lit("2020-02-02")).first()
    assert (got["company"], got["date"], got["competitors"], got["keywords"], got["body"]) == ("company", "2020-02-02", [], [], "")
    assert all(x["status"] == "failed" for x in got["layers"])


@pytest.mark.parametrize("text", ["", "free text\nonly"])
def test_unparsed_is_the_whole_body(spark, text):
    got = md.mine_reports(spark.createDataFrame([(text,)], "markdown string")).first()
    assert got["unparsed"] == text and got["data"] == []
