"""Building reports, notes, prompt inputs and the result document from the audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.text import rstrip, strip
from funnelscope.functions.urls import report_title
from funnelscope.operators.discovery import layer_pages
from funnelscope.operators.findings import faq_check_lines, in_order, snapshot_markdown
from funnelscope.operators.markdown import mine_reports

NOTES_TYPE = "array<struct<layer:int,text:string>>"


def notes_annotate(notes: DataFrame, findings: DataFrame, methods: DataFrame) -> DataFrame:
    """Layer notes followed by the JavaScript finding (layers 1 and 3) and the page fetch methods."""
    joined = (notes.join(findings.select("audit_id", "layer", F.col("notes").alias("finding")), ["audit_id", "layer"], "left")
              .join(methods, ["audit_id", "layer"], "left"))
    extra = F.concat_ws("\n\n", "finding", "methods_note")
    return joined.withColumn("notes", F.when(
        extra != "", F.concat(rstrip(F.col("notes")), F.lit("\n\n"), extra)).otherwise(F.col("notes"))).drop("finding", "methods_note")


def _note_text(notes: Column, layer: int, default: str | None) -> Column:
    text = F.try_element_at(F.filter(notes, lambda n: n["layer"] == layer), F.lit(-1))["text"]
    return text if default is None else F.coalesce(text, F.lit(default))


def report_markdown() -> Column:
    """The full report of one audit row.

    Reads ``company, url, icp, date, competitors, keywords, body, notes`` and ``analyst_notes``
    (arrays of layer/text), ``fetch_log`` (array) and ``sources`` (array of url/title).
    """
    c = F.col
    item = lambda label, value: F.concat(F.lit(f"- **{label}:** "), value, F.lit("\n"))
    rivals = F.when(F.size("competitors") > 0, F.array_join("competitors", ", ")).otherwise("none")
    scope = F.concat(
        F.lit("# "), report_title(c("company")), F.lit("\n\n## 1. Audit Scope\n\n"),
        item("URL audited", c("url")), item("ICP lens", c("icp")), item("Date", c("date")),
        item("Competitors compared", rivals), item("Channels covered", F.lit(fv.REPORT_CHANNELS)),
        item("High-intent keywords used", F.array_join("keywords", "; ")), item("Method notes", F.lit(fv.REPORT_METHOD)))

    written = [(t, strip(_note_text(c("analyst_notes"), i, None))) for i, t in enumerate(fv.LAYER_TITLES, 1)]
    note_parts = [F.when(F.length(text) > 0, F.concat(F.lit(f"\n### {title}\n\n"), text, F.lit("\n"))) for title, text in written]
    field_notes = F.concat_ws("", *note_parts)
    body = F.when(field_notes != "", F.concat(
        rstrip(c("body")), F.lit(f"\n\n{fv.FIELD_NOTES_HEADING}\n\n{fv.FIELD_NOTES_INTRO}\n"), field_notes)).otherwise(c("body"))

    log = F.when(F.size("fetch_log") > 0, F.transform("fetch_log", lambda x: F.concat(F.lit("- "), x))).otherwise(
        F.array(F.lit("- (no pages fetched)")))
    details = [F.concat(F.lit(f"<details>\n<summary>{title}</summary>\n\n"), _note_text(c("notes"), i, fv.NOT_RUN),
                        F.lit("\n\n</details>\n")) for i, title in enumerate(fv.LAYER_TITLES, 1)]
    by_url = F.array_sort(F.transform("sources", lambda s: F.struct(s["url"].alias("url"), s["title"].alias("title"))))
    cited = F.transform(by_url, lambda s: F.concat(
        F.lit("- ["), F.when(F.length(s["title"]) > 0, s["title"]).otherwise(s["url"]), F.lit("]("), s["url"], F.lit(")")))
    appendix = F.concat(
        F.array(F.lit("\n---\n\n## Appendix A - Page Fetch Log\n")), log,
        F.array(F.lit("\n## Appendix B - Raw Layer Notes\n"), *details),
        F.when(F.size("sources") > 0, F.concat(F.array(F.lit("\n## Appendix C - Sources Consulted\n")), cited))
         .otherwise(F.array().cast("array<string>")))
    return F.concat(scope, F.lit("\n"), strip(body), F.lit("\n"), F.array_join(appendix, "\n"), F.lit("\n"))


def report_build(audits: DataFrame, bodies: DataFrame, notes: DataFrame, sources: DataFrame, log: DataFrame,
                 analyst_notes: DataFrame | None = None) -> DataFrame:
    """``audit_id, company, date, markdown``; child tables are gathered per audit in one grouping each.

    A report lists every source of its audit, so its row grows with them by definition.
    """
    def gathered(df, *columns, keys, name):
        return df.groupBy("audit_id").agg(in_order(*columns, keys=keys).alias(name))
    layer_text = lambda df, col: df.select("audit_id", F.col("layer").cast("int").alias("layer"), F.col(col).alias("text"))
    out = (audits.join(bodies.select("audit_id", "body"), "audit_id", "left")
           .join(gathered(layer_text(notes, "notes"), "text", keys=["layer"], name="notes"), "audit_id", "left")
           .join(gathered(sources.select("audit_id", "url", "title"), "title", keys=["url"], name="sources"), "audit_id", "left")
           .join(gathered(log, "line", keys=["line_ord"], name="log_rows"), "audit_id", "left"))
    if analyst_notes is not None:
        out = out.join(gathered(layer_text(analyst_notes, "text"), "text", keys=["layer"], name="analyst_notes"), "audit_id", "left")
    else:
        out = out.withColumn("analyst_notes", F.lit(None).cast(NOTES_TYPE))
    none_of = lambda t: F.array().cast(t)
    out = out.withColumns({
        "body": F.coalesce("body", F.lit("")),
        "notes": F.coalesce("notes", none_of(NOTES_TYPE)),
        "analyst_notes": F.coalesce("analyst_notes", none_of(NOTES_TYPE)),
        "sources": F.coalesce("sources", none_of("array<struct<url:string,title:string>>")),
        "fetch_log": F.coalesce(F.transform("log_rows", lambda r: r["line"]), none_of("array<string>")),
    })
    return out.withColumn("markdown", report_markdown()).select("audit_id", "company", "date", "markdown")


def audit_intro() -> Column:
    rivals = F.when(F.size("competitors") > 0, F.array_join("competitors", ", ")).otherwise("(none provided)")
    return F.concat(
        F.lit("Target company: "), F.col("company"), F.lit(" ("), F.col("url"), F.lit(")\nIdeal Customer Profile (ICP) lens: "),
        F.col("icp"), F.lit("\nCompetitors: "), rivals, F.lit("\nAudit date: "), F.col("date"), F.lit("\n"))


# Task texts are this library's own wording; pass ``tasks`` to use others. What each prompt is made of
# (intro, keywords, snapshots, checks, in this order) is fixed by ``layer_prompt_table``.
PROMPT_TASKS = {
    "keywords": "List five high-intent, unbranded search queries of a buyer matching this profile, as a JSON array of strings.",
    "layer_1": "## Task: Layer 1 - Web Conversion audit\nFor each page give the primary and competing calls to action, clarity, friction and missing elements.",
    "layer_2": "## Task: Layer 2 - Paid Acquisition audit\nFor each keyword give paid presence, message match and bidders; label claims OBSERVED or INFERRED.",
    "layer_3": "## Task: Layer 3 - Organic Search and AEO (answer-engine optimization) audit\nGive organic rank per keyword, judge the probe answer, and read the llms.txt and FAQ checks.",
    "layer_4": "## Task: Layer 4 - Lifecycle and Post-Signup audit\nDescribe the start of the signup flow without creating an account.",
    "layer_5": "## Task: Layer 5 - Competitive Comparison\nContrast each competitor's homepage and pricing page with the target's.",
    "answer_engine_probe": "Answer as a neutral answer engine would, researching and citing sources.",
    "synthesis": "Write report sections 2 to 5 from the raw notes below.",
}
SKIPPED_LAYER_5 = "No competitors were provided, so Layer 5 was skipped."


def layer_prompt_table(audits: DataFrame, pages: DataFrame, llms: DataFrame, probes: DataFrame, notes: DataFrame,
                       tasks: dict[str, str] | None = None) -> DataFrame:
    """``audit_id, kind, prompt``: one batch-inference input row per audit and prompt kind; no model is called.

    ``llms``: site_url, llms_txt. ``probes``: audit_id, answer. ``notes``: audit_id, layer, notes.
    """
    task = {**PROMPT_TASKS, **(tasks or {})}
    blocks = (layer_pages(pages.withColumn("snapshot", snapshot_markdown()))
              .groupBy("audit_id", "layer").agg(in_order("role", "site_url", "snapshot", keys=["page_ord"]).alias("rows")))
    per_audit = blocks.groupBy("audit_id").agg(F.map_from_entries(F.collect_list(F.struct("layer", "rows"))).alias("rows"))
    gathered_notes = notes.groupBy("audit_id").agg(in_order("notes", keys=["layer"]).alias("layer_notes"))
    a = (audits.join(per_audit, "audit_id", "left").join(faq_check_lines(pages), "audit_id", "left")
         .join(llms, F.col("url") == F.col("site_url"), "left").join(probes, "audit_id", "left")
         .join(gathered_notes, "audit_id", "left").withColumn("intro", audit_intro()))
    intro = F.concat("intro", F.lit("\n"))
    snaps = lambda rows: F.coalesce(F.array_join(F.transform(rows, lambda r: r["snapshot"]), "\n"), F.lit(""))
    rows = lambda n: F.col("rows")[n]
    numbered = F.array_join(F.transform("keywords", lambda k, i: F.concat((i + 1).cast("string"), F.lit(". "), k)), "\n")
    of_role = lambda role: F.filter(rows(5), lambda r: r["role"] == role)
    rivals = F.array_join(F.transform("competitors", lambda site: F.concat(
        F.lit("## Competitor: "), site, F.lit("\n"),
        snaps(F.filter(of_role("competitor"), lambda r: r["site_url"] == site)))), "\n")
    question = F.concat(F.lit("What is the best payment processor for a "), F.col("icp"), F.lit("?"))
    probe = F.concat(F.lit("**Question asked:** "), question, F.lit("\n\n**Answer engine response:**\n\n"), F.coalesce("answer", F.lit("")))
    signup = F.when(F.size(rows(4)) > 0, snaps(rows(4))).otherwise("(no signup page found)")
    raw_notes = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)),
        lambda n: F.concat(F.lit("# "), F.element_at(F.array(*[F.lit(t) for t in fv.LAYER_TITLES]), n), F.lit("\n\n"),
                           F.coalesce(F.try_element_at(F.filter("layer_notes", lambda x: x["layer"] == n), F.lit(1))["notes"],
                                      F.lit(fv.NOT_RUN)))), "\n\n")
    prompts = {
        "keywords": F.concat(intro, F.lit(task["keywords"])),
        "layer_1": F.concat(intro, F.lit(task["layer_1"] + "\n\n## Page snapshots\n"), snaps(rows(1))),
        "layer_2": F.concat(intro, F.lit(task["layer_2"] + "\n"), numbered,
                            F.lit("\n\n## Target homepage snapshot (for message-match comparison)\n"), snaps(rows(2))),
        "layer_3": F.concat(intro, F.lit(task["layer_3"] + "\n"), numbered, F.lit("\n\n## AI answer-engine probe\n"), probe,
                            F.lit("\n\n## llms.txt check\n"), F.coalesce("llms_txt", F.lit("")),
                            F.lit("\n\n## FAQ schema check (key pages)\n"), F.coalesce("faq_lines", F.lit(""))),
        "layer_4": F.concat(intro, F.lit(task["layer_4"] + "\n\n## Signup page snapshot\n"), signup),
        "layer_5": F.when(F.size("competitors") > 0, F.concat(
            intro, F.lit(task["layer_5"] + "\n\n# Target company (for contrast)\n"), snaps(of_role("target")),
            F.lit("\n\n# Competitors\n"), rivals)).otherwise(SKIPPED_LAYER_5),
        "answer_engine_probe": F.concat(F.lit(task["answer_engine_probe"] + "\n\nQuestion: "), question),
        "synthesis": F.concat(intro, F.lit(task["synthesis"] + "\n\n# Raw research notes\n\n"), raw_notes),
    }
    all_ = F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("prompt")) for k, p in prompts.items()])
    return a.select("audit_id", F.explode(all_).alias("p")).select("audit_id", "p.*")


def result_payload(runs: DataFrame, layers: DataFrame, body: str = "body") -> DataFrame:
    """``audit_id, payload``: the nested result document of each run as JSON.

    ``runs``: audit_id, status, message, company, url, icp, competitors, date, keywords, duration, body,
    n_sources, fetch_log, report_path. ``layers``: audit_id, layer, status, summary, notes, analyst_notes
    (at most five rows per audit).
    """
    mined = mine_reports(runs, body)
    states = layers.groupBy("audit_id").agg(in_order("status", "summary", "notes", "analyst_notes", keys=["layer"]).alias("states"))
    j = mined.join(states, "audit_id", "left")

    def layer(i, title):
        state = F.try_element_at(F.filter("states", lambda s: s["layer"] == i), F.lit(1))
        observed = F.try_element_at(F.filter("observations", lambda o: o["layer"] == i), F.lit(1))["items"]
        text = lambda name, default="": F.coalesce(state[name], F.lit(default)).alias(name)
        return F.struct(
            F.lit(i).alias("index"), F.lit(title).alias("title"), F.lit(fv.LAYER_SHORT_NAMES[i - 1]).alias("short"),
            text("status", "pending"), text("summary"), text("notes"),
            F.coalesce(F.try_element_at(F.filter("working", lambda w: w["layer"] == i), F.lit(1))["text"], F.lit("")).alias("working"),
            F.coalesce(observed, F.array().cast("array<struct<observed:string,why:string,hypothesis:string,raw:string>>")).alias("observations"),
            text("analyst_notes"))
    document = F.struct(
        F.col("audit_id").cast("string").alias("id"), "status", "message", "company", "url", "icp", "competitors", "date",
        "keywords", "duration", "priorities", "data", "unparsed",
        F.array(*[layer(i, t) for i, t in enumerate(fv.LAYER_TITLES, 1)]).alias("layers"),
        F.col("n_sources").alias("sources"), "fetch_log", "report_path")
    return j.select("audit_id", document.alias("document")).select("audit_id", F.to_json("document").alias("payload"))
