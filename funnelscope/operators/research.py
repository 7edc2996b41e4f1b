"""Mining model responses: answers, activity, sources and keywords from typed blocks.

A *call* is (audit_id, layer); its turns are numbered from 0 and its blocks by ``pos`` within a turn.
Answers are assembled turn by turn first, so a busy audit spreads over its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.text import fill, strip
from funnelscope.functions.urls import company_name, csv_split

CALL = ["audit_id", "layer"]
LINK_TYPE = "array<struct<url:string,title:string>>"


def turn_limit(blocks: DataFrame, max_turns: int = fv.MAX_TURNS) -> DataFrame:
    """Turns that count: up to and including the first that did not pause, never more than ``max_turns``."""
    turns = (blocks.filter(F.col("turn") < max_turns)
             .groupBy(*CALL, "turn").agg(F.max("stop_reason").alias("stop_reason")))
    stopped_before = F.max(F.when(F.coalesce("stop_reason", F.lit("")) != "pause_turn", 1)).over(
        W.partitionBy(*CALL).orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    return turns.withColumn("stopped", stopped_before).filter(F.col("stopped").isNull()).drop("stopped")


def answer_after_last_tool(blocks: DataFrame, max_turns: int = fv.MAX_TURNS) -> DataFrame:
    """One answer per call: the text written after its last tool block, with marks for refusal or truncation.

    First step: one row per (call, turn), at most ``max_turns`` of them; second step: the fold over turns.
    """
    is_tool = F.col("block_type").isin(fv.TOOL_BLOCKS)
    per_turn = (blocks.filter(F.col("turn") < max_turns)
                .groupBy(*CALL, "turn").agg(
                    F.max("stop_reason").alias("stop_reason"),
                    F.max(F.when(is_tool, F.col("pos"))).alias("tool_pos"),
                    F.array_sort(F.collect_list(F.when(F.col("block_type") == "text", F.struct("pos", "text")))).alias("texts")))
    after = F.filter("texts", lambda t: t["pos"] > F.coalesce("tool_pos", F.lit(-1)))
    said = F.array_join(F.transform(after, lambda t: t["text"]), "")
    turn_rows = per_turn.select(
        *CALL, "turn", F.coalesce("stop_reason", F.lit("")).alias("stop"),
        F.col("tool_pos").isNotNull().alias("has_tool"), said.alias("said"))
    calls = turn_rows.groupBy(*CALL).agg(F.array_sort(F.collect_list(
        F.struct("turn", "stop", "has_tool", "said"))).alias("turns"))

    def fold(state, t):
        text = (F.when(t["stop"] == "refusal", F.concat(state["text"], F.lit(fv.DECLINED_MARK)))
                 .otherwise(F.concat(
                     F.when(t["has_tool"], F.lit("")).otherwise(state["text"]), t["said"],
                     F.when(t["stop"] == "max_tokens", fv.TRUNCATED_MARK).otherwise(""))))
        return F.when(state["done"], state).otherwise(
            F.struct(text.alias("text"), (t["stop"] != "pause_turn").alias("done")))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))
    return calls.select(*CALL, F.aggregate("turns", start, fold, lambda s: strip(s["text"])).alias("answer"))


def activity_feed(blocks: DataFrame) -> DataFrame:
    """What the research was doing, one line per reportable block.

    Reads ``tool_name``, ``tool_input`` (map), ``n_results`` and ``error_code`` of tool blocks. The
    writing line comes once per run of text, re-armed by a tool call, within one turn.
    """
    t, c = F.col("block_type"), F.col
    so_far = W.partitionBy(*CALL, "turn").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    last_text = F.max(F.when(t == "text", c("pos"))).over(so_far)
    last_call = F.max(F.when(t == fv.TOOL_CALL, c("pos"))).over(so_far)
    starts_writing = last_text.isNull() | (last_call > last_text)
    value = lambda key, default: F.coalesce(c("tool_input")[key], F.lit(default))
    why = F.coalesce("error_code", F.lit("error"))
    line = (
        F.when((t == "text") & c("starts_writing"), fv.WRITING_ACTIVITY)
        .when((t == fv.TOOL_CALL) & (c("tool_name") == "web_search"),
              F.concat(F.lit('Searching the web: "'), value("query", ""), F.lit('"')))
        .when((t == fv.TOOL_CALL) & (c("tool_name") == "web_fetch"), F.concat(F.lit("Fetching "), value("url", "page")))
        .when((t == fv.SEARCH_RESULT) & c("n_results").isNotNull(),
              F.concat(F.lit("  "), c("n_results").cast("string"), F.lit(" results returned")))
        .when(t == fv.SEARCH_RESULT, F.concat(F.lit("  search failed ("), why, F.lit(")")))
        .when((t == fv.FETCH_RESULT) & c("error_code").isNotNull(), F.concat(F.lit("  fetch failed ("), why, F.lit(")")))
        .when(t == fv.FETCH_RESULT, "  page retrieved"))
    return (blocks.withColumn("starts_writing", starts_writing)
            .select(*CALL, "turn", "pos", line.alias("activity")).filter(F.col("activity").isNotNull()))


def sources_dedup(blocks: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Distinct (audit, url) with the title of the first sighting, empty titles included.

    Citations of text blocks and search results are exploded in one pass; the minimum is combined
    before the shuffle, so a much-cited source costs nothing. ``seeds`` (audit_id, url, title) come first.
    """
    seen = (F.when(F.col("block_type") == "text", F.col("citations"))
             .when(F.col("block_type") == fv.SEARCH_RESULT, F.col("results")))
    sightings = (blocks
                 .select("audit_id", "layer", "turn", "pos", F.posexplode(seen).alias("k", "link"))
                 .filter(F.length("link.url") > 0)
                 .select("audit_id", "link.url", F.coalesce("link.title", F.lit("")).alias("title"),
                         F.struct("layer", "turn", "pos", "k").alias("at")))
    if seeds is not None:
        first = F.struct(*[F.lit(-1).cast(sightings.schema["at"].dataType[n].dataType).alias(n)
                           for n in ("layer", "turn", "pos", "k")])
        sightings = sightings.unionByName(seeds.select(
            "audit_id", "url", F.coalesce("title", F.lit("")).alias("title"), first.alias("at")))
    return sightings.groupBy("audit_id", "url").agg(F.min_by("title", "at").alias("title"))


def sources_list(sources: DataFrame) -> DataFrame:
    """Sources with the text they are shown by, sorted by address within each audit."""
    shown = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url"))
    return sources.select("audit_id", "url", shown.alias("display")).orderBy("audit_id", "url")


def fallback_keywords(url: Column, competitors: Column) -> Column:
    first = F.try_element_at(competitors, F.lit(1))
    rival = F.when(first.isNotNull(), company_name(first)).otherwise(fv.DEFAULT_COMPETITOR)
    return F.array(*[fill(k, rival=rival, company=company_name(url)) for k in fv.FALLBACK_KEYWORDS])


def keywords_extract(answer: Column, url: Column, competitors: Column) -> Column:
    """First five string items of the JSON array in the answer, or the fallback when fewer than three are usable."""
    listed = F.regexp_extract(answer, r"(?s)\[.*\]", 0)
    items = F.try_parse_json(listed).try_cast("array<variant>")
    strings = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"),
                          lambda v: strip(F.variant_get(v, "$", "string")))
    usable = F.filter(strings, lambda k: k != "")
    return F.when(F.size(usable) >= fv.MIN_KEYWORDS, F.slice(usable, 1, fv.MAX_KEYWORDS)).otherwise(
        fallback_keywords(url, competitors))


def keywords_choose(explicit: Column, saved: Column, generated: Column) -> Column:
    """A given list wins (uncapped, may come out empty), then the checkpoint's, then the generated one."""
    return (F.when(F.length(explicit) > 0, csv_split(explicit))
             .when(F.size(saved) > 0, saved)
             .otherwise(generated))


def keyword_brand_check(keywords: Column, company: Column) -> Column:
    """Keywords that name the audited company."""
    return F.filter(keywords, lambda k: F.contains(F.lower(k), company))
