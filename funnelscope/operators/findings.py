"""Per-audit findings and notes built from the audited pages (a handful of rows per audit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.text import fill, join_natural, thousands
from funnelscope.operators.discovery import layer_pages
from funnelscope.operators.render import fetch_method_text


def in_order(*columns: str | Column, keys: list[str]) -> Column:
    """Array of structs in the order of ``keys``; the explicit ordinal keeps list order right after a shuffle."""
    return F.array_sort(F.collect_list(F.struct(*keys, *columns)))


def js_findings(pages: DataFrame) -> DataFrame:
    """Two rows (layers 1 and 3) for each audit whose own pages hide content behind JavaScript."""
    flagged = pages.filter((F.col("role") == "target") & (F.size("js_missing") > 0))
    grouped = flagged.groupBy("audit_id").agg(in_order(
        "label", "js_missing", "raw_word_count", "word_count", "final_url", keys=["type_ord"]).alias("pages"))
    all_shorts = F.flatten(F.transform("pages", lambda p: F.transform(p["js_missing"], lambda m: m["short"])))
    details = F.array_join(F.transform("pages", lambda p: F.concat(
        join_natural(F.transform(p["js_missing"], lambda m: m["detailed"])), F.lit(" on the "), F.lower(p["label"]))), "; ")
    evidence = F.array_join(F.transform("pages", lambda p: F.concat(
        p["label"], F.lit(": "), thousands(p["raw_word_count"]), F.lit(" words in raw HTML vs "),
        thousands(p["word_count"]), F.lit(" after rendering ("), p["final_url"], F.lit(")"))), "; ")
    parts = grouped.select(
        "audit_id", join_natural(all_shorts).alias("shorts"), details.alias("details"), evidence.alias("evidence"),
        F.when(F.array_contains(all_shorts, "pricing"), fv.JS_LEAD_PRICING).otherwise(fv.JS_LEAD_OTHER).alias("lead"),
        join_natural(F.transform("pages", lambda p: F.lower(p["label"]))).alias("page_names"))
    col = F.col
    footer = fill(fv.JS_FOOTER, evidence=col("evidence"))

    def finding(layer, observed, why, hypothesis, kind):
        observed = fill(observed, lead=col("lead"), details=col("details"), shorts=col("shorts"))
        return F.struct(
            F.lit(layer).alias("layer"), observed.alias("observed"), F.lit(why).alias("why"),
            fill(hypothesis, shorts=col("shorts"), pages=col("page_names")).alias("hypothesis"),
            fill(fv.JS_NOTES, kind=F.lit(kind), observed=observed, why=F.lit(why), footer=footer).alias("notes"))
    both = F.array(finding(1, fv.JS_OBSERVED_1, fv.JS_WHY_1, fv.JS_HYPOTHESIS_1, "CRO"),
                   finding(3, fv.JS_OBSERVED_3, fv.JS_WHY_3, fv.JS_HYPOTHESIS_3, "SEO/AEO"))
    return parts.select("audit_id", F.explode(both).alias("f")).select("audit_id", "f.*")


def fetch_log(pages: DataFrame) -> DataFrame:
    """One line per page: target pages first, then each competitor's."""
    good = F.concat(F.col("label"), F.lit(": "), F.coalesce("final_url", "requested_url"), F.lit(" - OK (HTTP "),
                    F.coalesce(F.col("status_code").cast("string"), F.lit("None")), F.lit(", "), fetch_method_text(), F.lit(")"))
    note = F.when(F.col("render_note") != "", F.concat(F.lit(" [headless browser: "), F.col("render_note"), F.lit("]")))
    bad = F.concat(F.col("label"), F.lit(": "), F.col("requested_url"), F.lit(" - FAILED ("), F.col("error"), F.lit(")"),
                   F.coalesce(note, F.lit("")))
    return pages.select("audit_id", (F.col("site_ord") * 10 + F.col("type_ord")).alias("line_ord"),
                        F.when(F.col("ok"), good).otherwise(bad).alias("line"))


def fetch_methods_note(pages: DataFrame) -> DataFrame:
    """Markdown list, per (audit, layer), of how each page of the layer was fetched."""
    how = F.when(F.col("ok"), fetch_method_text()).otherwise(
        F.concat(F.lit("not retrieved locally ("), F.coalesce("error", F.lit("error")), F.lit(")")))
    rows = layer_pages(pages).withColumn("row", F.concat(F.lit("- "), F.col("label"), F.lit(": "), how))
    note = F.concat(F.lit("**Page fetch methods (local snapshots):**\n"),
                    F.array_join(F.transform("rows", lambda r: r["row"]), "\n"))
    return (rows.groupBy("audit_id", "layer").agg(in_order("row", keys=["page_ord"]).alias("rows"))
            .select("audit_id", "layer", note.alias("methods_note")))


def faq_check_lines(pages: DataFrame) -> DataFrame:
    """Per audit: FAQ markup of each target page."""
    types = F.when(F.size("schema_types") > 0, F.array_join("schema_types", ", ")).otherwise("none")
    seen = F.concat(F.lit("FAQ schema "), F.when(F.col("has_faq_schema"), "PRESENT").otherwise("absent"),
                    F.lit("; schema types: "), types)
    unseen = F.concat(F.lit("not checked locally ("), F.col("error"),
                      F.lit(") - use web_fetch on this URL and look for FAQPage JSON-LD"))
    line = F.concat(F.lit("- "), F.col("label"), F.lit(" ("), F.col("requested_url"), F.lit("): "),
                    F.when(F.col("ok"), seen).otherwise(unseen))
    target = pages.filter(F.col("role") == "target").withColumn("line", line)
    return (target.groupBy("audit_id").agg(in_order("line", keys=["type_ord"]).alias("rows"))
            .select("audit_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("faq_lines")))


def snapshot_markdown() -> Column:
    """One page as a fixed-order markdown block; failed pages get a short one."""
    c = F.col
    joined = lambda name, glue, none: F.when(F.size(name) > 0, F.array_join(name, glue)).otherwise(none)
    # an array holding only empty strings prints like an empty one
    joined_text = lambda name, glue, none: F.when(
        F.array_join(name, glue) != "", F.array_join(name, glue)).otherwise(none)
    text_or = lambda name: F.when(c(name) != "", c(name)).otherwise("(none)")
    line = lambda label, value: F.concat(F.lit(f"- {label}: "), value)
    failed = F.concat(
        F.lit("### "), c("label"), F.lit("\n- URL: "), c("requested_url"), F.lit("\n- LOCAL FETCH FAILED: "), c("error"), F.lit("\n"),
        F.when(c("render_note") != "", F.concat(F.lit("- Headless browser: "), c("render_note"), F.lit("\n"))).otherwise(""),
        F.lit("- Try web_fetch on this URL; if that also fails, record the page as unavailable.\n"))
    low = F.when(c("word_count") < fv.VERY_LOW_WORDS,
                 " (very low - page is likely client-side rendered; consider web_fetch)").otherwise("")
    script_only = F.when(F.size("js_missing") > 0, F.concat(
        F.lit("- JAVASCRIPT-RENDERED: missing from the raw HTML, visible only after JavaScript runs: "),
        F.array_join(F.transform("js_missing", lambda m: m["detailed"]), "; ")))
    good = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), c("label")),
        F.concat(F.lit("- URL: "), c("requested_url"), F.lit(" (final: "), c("final_url"), F.lit(", HTTP "),
                 F.coalesce(c("status_code").cast("string"), F.lit("None")), F.lit(")")),
        line("Fetch method", fetch_method_text()),
        line("Title", text_or("title")),
        line("Meta description", text_or("meta_description")),
        line("H1", joined_text("h1", " | ", "(none)")),
        line("H2 (first 10)", joined_text("h2", " | ", "(none)")),
        line("CTA-like links/buttons (in page order)", joined("ctas", " | ", "(none found)")),
        line("Forms", joined("forms", " || ", "(none)")),
        line("Structured data types", joined_text("schema_types", ", ", "(none)")),
        line("FAQ schema present", F.when(c("has_faq_schema"), "yes").otherwise("no")),
        line("Visible word count", F.concat(c("word_count").cast("string"), low)),
        script_only,
        F.lit(f"- Visible text excerpt (first {fv.EXCERPT_CHARS} chars):"),
        F.lit("```"), c("text_excerpt"), F.lit("```"))
    return F.when(c("ok"), F.concat(good, F.lit("\n"))).otherwise(failed)
