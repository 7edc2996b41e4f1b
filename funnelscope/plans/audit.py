"""End-to-end graphs: each takes input tables and returns the result tables by name, all lazy but the page parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from funnelscope.operators import discovery, features, findings, markdown, outcomes, render, report, research, runstate
from funnelscope.session import materialize


def audit_pages(captures: DataFrame, audits: DataFrame) -> dict[str, DataFrame]:
    """Pages of every audit, what is missing, and the findings and notes drawn from them.

    The parse and the pairing of captures are written once; the site pages, which five results read, once more.
    """
    standard = features.page_features(captures.filter(F.col("mode") == "standard"))
    rendered = features.page_features(captures.filter(F.col("mode") == "rendered"))
    resolved = materialize(render.capture_resolve(standard, rendered), "resolved-pages")
    pages = materialize(discovery.site_pages(audits, resolved), "site-pages")
    return {
        "resolved": resolved,
        "pages": pages,
        "matrix": discovery.site_page_matrix(pages),
        "layer_pages": discovery.layer_pages(pages),
        "findings": findings.js_findings(pages),
        "fetch_log": findings.fetch_log(pages),
        "methods": findings.fetch_methods_note(pages),
        "faq": findings.faq_check_lines(pages),
    }


def audit_responses(blocks: DataFrame, layer_runs: DataFrame, seeds: DataFrame | None = None) -> dict[str, DataFrame]:
    """Answers, activity and sources of the research calls, and how each audit ended."""
    classified = outcomes.layer_failure_classify(layer_runs)
    return {
        "answers": research.answer_after_last_tool(blocks),
        "activity": research.activity_feed(blocks),
        "sources": research.sources_dedup(blocks, seeds),
        "layer_results": classified,
        "outcomes": outcomes.audit_outcome(classified),
    }


def final_reports(audits: DataFrame, bodies: DataFrame, notes: DataFrame, results: dict[str, DataFrame],
                  sources: DataFrame, analyst_notes: DataFrame | None = None) -> DataFrame:
    """Reports from ``audit_pages`` results: findings go into the bodies and notes, then everything is laid out."""
    finding = F.struct("layer", "observed", "why", "hypothesis")
    per_audit = results["findings"].groupBy("audit_id").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    none = F.array().cast(per_audit.schema["findings"].dataType)
    injected = bodies.join(per_audit, "audit_id", "left").select("audit_id", markdown.findings_inject(
        F.col("body"), F.coalesce("findings", none)).alias("body"))
    annotated = report.notes_annotate(notes, results["findings"], results["methods"])
    return report.report_build(audits, injected, annotated, sources, results["fetch_log"], analyst_notes)


def mine_saved_reports(reports: DataFrame) -> DataFrame:
    """Saved reports (``markdown``) as audits with their layers, mined section by section."""
    return markdown.mine_reports(markdown.load_reports(reports), "body")


def run_state(events: DataFrame) -> dict[str, DataFrame]:
    """Numbered log, layer states, progress, log tail and current activity of every audit."""
    log = runstate.event_sequence(events)
    return {
        "log": log,
        "layers": runstate.layer_state_latest(log),
        "progress": runstate.progress_percent(log),
        "tail": runstate.log_tail(events),
        "activity": runstate.running_activity(events),
    }
