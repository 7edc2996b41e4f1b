"""Hand-written cases: one per rule that is easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from funnelscope.functions import match, text as tx, urls
from funnelscope.operators import markdown as md, outcomes, research, runstate
from funnelscope.sources import captures as cap

c = F.col


@pytest.mark.parametrize("raw, expected", [
    ("Www.Acmepay.com/x?y", "https://www.acmepay.com"), (" HTTP://a.b:80/x ", "http://a.b:80"), ("", "https:"), ("a.b#c", "https://a.b")])
def test_url_normalize(one, raw, expected):
    assert one(urls.url_normalize(c("u")), u=raw) == expected


@pytest.mark.parametrize("url, expected", [
    ("https://www.acmepay.com", "acmepay"), ("https://company.co.uk", "company"), ("https://blog.example.com", "blog"),
    ("https://shop.abc.com", "shop"), ("https://localhost", "localhost"), ("", "company")])
def test_company_name(one, url, expected):
    assert one(urls.company_name(c("u")), u=url) == expected


def test_same_site_quirk(one):
    assert one(urls.same_site(c("u"), c("b")), u="https://notsquare.com", b="https://square.com")
    assert not one(urls.same_site(c("u"), c("b"), strict=True), u="https://notsquare.com", b="https://square.com")
    assert one(urls.same_site(c("u"), c("b"), strict=True), u="https://m.square.com/x", b="https://www.square.com")


@pytest.mark.parametrize("raw, ok", [("acmepay.com", True), ("  ", False), ("a.b:80", False), ("no host", False), ("x.io/path", True)])
def test_url_validate(one, raw, ok):
    assert (one(urls.url_validate(c("u")), u=raw) is not None) == ok


def test_url_path_drops_params_of_last_segment(one):
    assert one(urls.url_path(c("u")), u="https://a.b/x;y/z;p=1?q#f") == "/x;y/z"


def test_title_case_and_csv(one):
    assert one(tx.title_case(c("s")), s="acme-co a1b") == "Acme-Co A1B"
    assert one(urls.csv_split(c("s")), s=" a,, b ,") == ["a", "b"]


def test_prices(one):
    assert one(match.price_mentions(c("s")), s="$349 and 0.35% per month") == ["$349", "0.35%", "per month"]
    assert one(match.price_mentions(c("s")), s="€ 1,200k /mo /month PER SEAT ésuper months 5 %x") == ["€ 1,200k", "/mo", "/month", "PER SEAT", "5 %"]


@pytest.mark.parametrize("text, hit", [("Get Started", True), ("ésales", False), ("sign up", True), ("signup", True), ("signs up", False),
                                       ("Open an account", True), ("retry", False), ("Calls", False)])
def test_cta(one, text, hit):
    assert one(match.cta_match(c("s")), s=text) == hit


def test_page_type_words_are_substrings(one):
    assert one(match.page_type_match(c("t"), c("h")), t="Celebrates", h="https://a.b/x?pricing") == ["pricing"]
    assert one(match.page_type_match(c("t"), c("h")), t="us vs them", h="https://a.b/contact-sales") == ["compare", "contact_sales"]
    assert one(match.page_type_match(c("t"), c("h")), t="vs", h="https://a.b/") == []  # the word is " vs", space included


@pytest.mark.parametrize("items, expected", [(["a"], "a"), (["a", "b", "a"], "a and b"), (["a", "b", "c"], "a, b and c"), ([], None)])
def test_join_natural(spark, items, expected):
    df = spark.createDataFrame([(items,)], "i array<string>")
    assert df.select(tx.join_natural(c("i")).alias("x")).first()["x"] == expected


def test_error_condense(one):
    message = "HTTPSConnectionPool(host='a'): Max retries exceeded (Caused by NewConnectionError('no route (113)'))"
    assert one(cap.error_condense(c("m"), F.lit("ConnectionError")), m=message) == "ConnectionError: 'no route (113)')"  # greedy: one bracket stays
    assert one(cap.error_condense(c("m"), F.lit("E")), m="x" * 300) == "E: " + "x" * 200


def test_classify_and_llms(spark):
    rows = [("https://a/llms.txt", "standard", 200, None, "", " body ", None), ("https://b/llms.txt", "standard", 200, "text/html", "", "", None),
            ("https://c/llms.txt", "standard", 404, "text/plain", "", "", None), ("https://d/llms.txt", "standard", None, None, "", None, "E: x"),
            ("https://e/", "standard", 200, "text/HTML", "", "x", None), ("https://f/", "rendered", 200, "image/png", "", "x", None)]
    df = spark.createDataFrame(rows, "url string, mode string, status_code int, content_type string, final_url string, html string, error string")
    got = {r["site_url"]: r["llms_txt"] for r in cap.llms_txt_status(df).collect()}
    assert got["https://a"] == "https://a/llms.txt: PRESENT (HTTP 200, 6 chars). Preview:\n```\nbody\n```"
    assert got["https://b"].endswith("treat as ABSENT") and got["https://c"].endswith("ABSENT (HTTP 404)")
    assert "LOCAL CHECK FAILED (E: x)" in got["https://d"]
    errors = {r["url"]: r["error"] for r in cap.capture_classify(df).collect()}
    assert errors["https://a/llms.txt"] is None            # a missing content type counts as HTML here
    assert errors["https://e/"] == "Non-HTML content (text/HTML)"
    assert errors["https://f/"] is None


def pairs(rows):
    return [(r["heading"], r["content"]) for r in rows]


def test_md_sections(one):
    assert pairs(one(md.md_sections(c("m"), 2), m="x\n## A\n1\n## B")) == [("", "x"), ("A", "1"), ("B", "")]
    assert pairs(one(md.md_sections(c("m"), 2), m="")) == [("", "")]
    assert pairs(one(md.md_sections(c("m"), 2), m="\n## A\r\n1\r\n### C\n##D\n## \n## E\n")) == [("A", "1\n### C\n##D"), ("E", "")]


def test_md_bullets(one):
    assert one(md.md_bullets(c("m")), m="intro\n- a\n  - b\n\n* c") == ["a\n- b", "c"]
    assert one(md.md_bullets(c("m")), m="- \nx") == ["\nx"]
    assert one(md.md_bullets(c("m")), m="none") == []


def test_working_last_bullet_of_a_layer_wins(one):
    body = "## Networking\n- **Layer 2 - Paid**: old\n- plain\n- **Layer 2 - Paid**: new"
    got = one(md.report_working(md.md_sections(c("m"), 2)), m=body)
    assert [(r["layer"], r["text"]) for r in got] == [(2, "new")]  # the second bullet falls back to 2 as well


def test_duplicate_heading_keeps_last_content(one):
    body = "## Priority\n### 1. A\nImpact: High / Confidence: Medium / Speed: low\nwhy\n## x\n## Priority\n### 2) B\nno scores"
    got = one(md.report_priorities(md.md_sections(c("m"), 2)), m=body)
    assert [(r["title"], r["impact"], r["rationale"]) for r in got] == [("B", "", "no scores")]


def test_scores(one):
    body = "## Priority Stack\n### 1. A\nImpact: High / Confidence: Medium / Speed: low\nwhy"
    got = one(md.report_priorities(md.md_sections(c("m"), 2)), m=body)[0]
    assert (got["impact"], got["confidence"], got["speed"], got["rationale"]) == ("High", "Med", "Low", "why")
    split = "## Priority Stack\n### A\nImpact: High, then\nConfidence: Low Speed: Low"
    assert one(md.report_priorities(md.md_sections(c("m"), 2)), m=split)[0]["impact"] == ""


def test_notes_summary(one):
    assert one(md.notes_summary(c("n")), n="## Summary\nfirst\n### deeper\nx\n## Summary\n \n# z") == "first\n### deeper\nx"
    assert one(md.notes_summary(c("n")), n="# a\n## Genuine Strength:\nyes\n# b") == "yes"
    assert one(md.notes_summary(c("n")), n="# only\n" + "y" * 701) == "y" * 700 + "…"
    assert one(md.notes_summary(c("n")), n="##### Summary\nnot a level") == "not a level"


def test_notes_clean(one):
    assert one(md.notes_clean(c("n")), n="I will fetch.## Found\nx") == "## Found\nx"
    assert one(md.notes_clean(c("n")), n="one\ntwo.## Found") == "one\ntwo.## Found"
    assert one(md.notes_clean(c("n")), n="# Top\nx.## y") == "# Top\nx.## y"


@pytest.mark.parametrize("text, expected", [("", "failed"), ("_Not run._ ", "failed"), ("**L could not be completed.**", "failed"), ("fine", "done")])
def test_loaded_status(one, text, expected):
    assert one(md.loaded_layer_status(c("t")), t=text) == expected


def test_findings_inject_places_and_falls_back(spark):
    finding = "array(named_struct('layer', 1, 'observed', 'o', 'why', 'w', 'hypothesis', 'h'), named_struct('layer', 3, 'observed', 'p', 'why', 'w', 'hypothesis', 'h'))"
    body = "## 3. Obs\n### Layer 1 - X\n\n- old\n## 4. P\n### Layer 3 - Y\n"
    df = spark.createDataFrame([(body,)], "b string").withColumn("f", F.expr(finding))
    got = df.select(md.findings_inject(c("b"), c("f")).alias("x")).first()["x"]
    assert got == ("## 3. Obs\n### Layer 1 - X\n\n- **Observed:** o → **Why it matters:** w → **Hypothesis to test:** h\n- old\n## 4. P\n### Layer 3 - Y"
                   "\n\n## Automated Findings\n\n### Layer 3 - Organic Search and AEO\n\n"
                   "- **Observed:** p → **Why it matters:** w → **Hypothesis to test:** h\n\n")


def test_keywords(spark):
    df = spark.createDataFrame([('x ["a",1,"b"," c "] y', "https://acme.com", ["https://www.rival.com"]), ('["a","b"]', "https://acme.com", []),
                                (None, "https://acme.com", ["https://rival.co.uk"])], "t string, u string, r array<string>")
    got = [r["k"] for r in df.select(research.keywords_extract(c("t"), c("u"), c("r")).alias("k")).collect()]
    assert got[0] == ["a", "b", "c"]
    assert len(got[1]) == 5 and got[1][1] == "switch from square payment processing" and got[1][4] == "acme vs square"
    assert got[2][4] == "acme vs rival"


def test_keywords_choose_commas_only_gives_nothing(spark):
    df = spark.createDataFrame([(",,", ["s"], ["g"]), ("", ["s"], ["g"]), (None, [], ["g"])], "e string, s array<string>, g array<string>")
    assert [r["k"] for r in df.select(research.keywords_choose(c("e"), c("s"), c("g")).alias("k")).collect()] == [[], ["s"], ["g"]]


BLOCKS = "audit_id bigint, layer int, turn int, pos int, block_type string, text string, stop_reason string"


def test_answer_spans_resumed_turns(spark):
    rows = [(1, 1, 0, 0, "text", "a", "pause_turn"), (1, 1, 0, 1, "web_search_tool_result", None, "pause_turn"), (1, 1, 0, 2, "text", " b", "pause_turn"),
            (1, 1, 1, 0, "text", "c ", "end_turn"), (1, 1, 2, 0, "text", "never", "end_turn"),
            (2, 1, 0, 0, "text", "x", "pause_turn"), (2, 1, 1, 0, "server_tool_use", None, "refusal"), (2, 1, 1, 1, "text", "y", "refusal"),
            (3, 1, 0, 0, "text", "cut", "max_tokens")]
    rows += [(4, 1, t, 0, "text", str(t), "pause_turn") for t in range(8)]
    got = {r["audit_id"]: r["answer"] for r in research.answer_after_last_tool(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got[1] == "bc"
    assert got[2] == "x\n\n_(The model declined to complete this part of the audit.)_"
    assert got[3] == "cut\n\n_(Output truncated: max_tokens reached.)_"
    assert got[4] == "012345"


@pytest.mark.parametrize("seconds, clock", [(3725, "1:02:05"), (65, "01:05"), (-3, "00:00"), (59.9, "00:59"), (36000, "10:00:00")])
def test_elapsed_clock(one, seconds, clock):
    assert one(runstate.elapsed_clock(c("s")), s=float(seconds)) == clock


def test_progress(spark):
    rows = [(1, 0, "layer", 1, "running", 1), (1, 1, "layer", 1, "done", 1), (1, 2, "layer", 2, "running", 1), (2, 0, "step", 1, None, 1),
            (3, 0, "step", 1, None, 8), (4, 0, "layer", 1, "done", 1), (4, 1, "complete", None, "error", 1), (5, 0, "complete", None, "partial", 1)]
    df = spark.createDataFrame(rows, "audit_id int, seq int, type string, layer int, status string, step int")
    got = {r["audit_id"]: r["percent"] for r in runstate.progress_percent(df).collect()}
    assert got == {1: 28, 2: 2, 3: 93, 4: 23, 5: 100}


def test_outcomes(spark):
    rows = [(1, i, None, None, None) for i in range(1, 7)]
    rows += [(2, 1, None, None, None), (2, 2, "ValueError", None, "x"), (2, 3, "APIStatusError", 400, "Your CREDIT balance is low")]
    rows += [(3, i, None, None, None) for i in range(1, 6)] + [(3, 6, "ValueError", None, "x")]
    rows += [(4, 1, "AuthenticationError", 401, "bad key")]
    rows += [(5, i, None if i != 2 else "APIConnectionError", None, "down") for i in range(1, 7)]
    df = outcomes.layer_failure_classify(spark.createDataFrame(
        rows, "audit_id int, layer int, error_type string, status_code int, error_message string"))
    got = {r["audit_id"]: (r["status"], len(r["failed_layers"]), r["exit_code"]) for r in outcomes.audit_outcome(df).collect()}
    assert got == {1: ("complete", 0, 0), 2: ("out_of_credits", 4, 2), 3: ("partial", 0, 1), 4: ("error", 0, 1), 5: ("partial", 1, 1)}
    notes = {(r["audit_id"], r["layer"]): r["failed_notes"] for r in df.collect()}
    assert notes[(5, 2)] == "**Layer 2 - Paid Acquisition could not be completed.** Reason: Connection error: down"
