"""Queries over saved and built reports, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import pages as pg
from checks.research import SOURCES, seeds, source_blocks
from checks.views import audits, table, view, with_views
from funnelscope import fixed_values as fv
from funnelscope.functions.arrays import rows_of
from funnelscope.operators import findings, markdown as md, report, research
from funnelscope.session import work_dir
from funnelscope.sources import captures as cap, report_files

QUERIES, ORACLE = {}, {}


def query(name, sql=None, views=()):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return register


R = ("fx_reports",)


def reports(spark, sf):
    return view(spark, sf, "fx_reports")


# ---- mining -------------------------------------------------------------------------------------
@query("md_sections", """
with s as (select report_id, unnest(l) as piece, generate_subscripts(l, 1) as pos from (select report_id, string_split(markdown, chr(10) || '## ') as l from fx_reports) q)
select report_id, cast(pos as int) as pos, case when pos = 1 then '' else split_part(piece, chr(10), 1) end as heading,
  trim(case when pos = 1 then piece else substr(piece, length(split_part(piece, chr(10), 1)) + 1) end, ' ' || chr(10)) as content from s""", R)
def _(spark, sf):
    parts = md.md_sections(F.col("markdown"), 2)
    return rows_of(reports(spark, sf), parts, ["report_id"], "i", "s").select(
        "report_id", (F.col("i") + 1).alias("pos"), "s.heading", "s.content")


@query("md_bullets", """
with l as (select report_id, unnest(x) as line, generate_subscripts(x, 1) as n from (select report_id, string_split(markdown, chr(10)) as x from fx_reports) q),
g as (select *, sum(case when starts_with(line, '- ') or starts_with(line, '* ') then 1 else 0 end) over (partition by report_id order by n) as b from l)
select report_id, cast(b as int) as pos, string_agg(trim(case when starts_with(line, '- ') or starts_with(line, '* ') then substr(line, 3) else line end), chr(10) order by n) as bullet
from g where b > 0 and (trim(line) <> '' or starts_with(line, '- ') or starts_with(line, '* ')) group by report_id, b""", R)
def _(spark, sf):
    return rows_of(reports(spark, sf), md.md_bullets(F.col("markdown")), ["report_id"], "i", "bullet").select(
        "report_id", (F.col("i") + 1).alias("pos"), "bullet")


@query("layer_number", """
select report_id, cast(case when regexp_extract(text, 'Layer\\s*([0-9])', 1) in ('1', '2', '3', '4', '5') then regexp_extract(text, 'Layer\\s*([0-9])', 1) else '9' end as int) as layer
from (select report_id, case when report_id % 2 = 0 then text || ' Layer ' || (report_id % 8) else text end as text from fx_reports) q""", R)
def _(spark, sf):
    text = F.when(F.col("report_id") % 2 == 0, F.concat("text", F.lit(" Layer "), (F.col("report_id") % 8).cast("string"))).otherwise(F.col("text"))
    return reports(spark, sf).select("report_id", md.layer_number(text, F.lit(9)).alias("layer"))


@query("section_find", """
select report_id, trim(split_part(split_part(markdown, '## 4. Priority Stack' || chr(10), 2), chr(10) || '## 5.', 1), ' ' || chr(10)) as content from fx_reports""", R)
def _(spark, sf):
    return reports(spark, sf).select("report_id", md.section_find(md.md_sections(F.col("markdown"), 2), fv.PRIORITY_WORDS).alias("content"))


def mined(spark, sf):
    return md.mine_reports(reports(spark, sf))


@query("report_working", """
with w as (select report_id, report_id % 5 + 1 as layer, 1 as k, replace(text, chr(10), ' ') as t from (select doc_id as report_id, text from documents) q
  union all select doc_id, 2, 2, 'plain strength' || chr(10) || 'more of it' from documents)
select report_id, cast(layer as int) as layer, trim(arg_max(t, k)) as working from w group by report_id, layer""")
def _(spark, sf):
    return rows_of(mined(spark, sf), "working", ["report_id"], item="w").select("report_id", "w.layer", F.col("w.text").alias("working"))


@query("report_observations", """
select doc_id as report_id, 1 as layer, 'a' || doc_id as observed, 'b' as why, 'c' as hypothesis, cast(null as varchar) as raw from documents
union all select doc_id, 1, null, null, null, 'only raw ' || lang from documents where doc_id % 3 = 0
union all select doc_id, 3, null, null, null, 'Nothing to say.' from documents""")
def _(spark, sf):
    o = rows_of(mined(spark, sf), "observations", ["report_id"], item="o").select("report_id", "o.layer", "o.items")
    return rows_of(o, "items", ["report_id", "layer"], item="i").select("report_id", "layer", "i.*")


PRIORITIES = """
pr as (select doc_id as report_id, 1 as rank, 'First ' || source as title, 'Because ' || lang || '.' as rationale, 'High' as impact, case when doc_id % 2 = 0 then 'Med' else 'Low' end as confidence, 'Low' as speed from documents
  union all select doc_id, 2, 'Second', '', 'Med', 'High', 'High' from documents)"""


@query("report_priorities", f"with {PRIORITIES} select * from pr")
def _(spark, sf):
    return rows_of(mined(spark, sf), "priorities", ["report_id"], "i", "p").select(
        "report_id", (F.col("i") + 1).alias("rank"), "p.title", "p.rationale", "p.impact", "p.confidence", "p.speed")


LEVEL = "case {x} when 'High' then 3 when 'Med' then 2 when 'Low' then 1 else 0 end"


@query("priority_top3", f"with {PRIORITIES} select report_id, rank, title, {LEVEL.format(x='impact')} as impact, {LEVEL.format(x='confidence')} as confidence, {LEVEL.format(x='speed')} as speed from pr where rank <= 3")
def _(spark, sf):
    return rows_of(mined(spark, sf), md.priority_top(F.col("priorities")), ["report_id"], item="p").select("report_id", "p.*")


@query("priority_rescore", f"""
with {PRIORITIES}, s as (select report_id, rank, title, {LEVEL.format(x='impact')} * {LEVEL.format(x='confidence')} * {LEVEL.format(x='speed')} as score from pr),
k as (select *, cast(row_number() over (partition by report_id order by score desc, rank) as int) as score_rank from s)
select report_id, rank, title, score, score_rank, rank = score_rank as rank_agrees from k""")
def _(spark, sf):
    return rows_of(mined(spark, sf), md.priority_rescore(F.col("priorities")), ["report_id"], item="p").select("report_id", "p.*")


@query("report_data_questions", "select doc_id as report_id, 'q1|q2 ' || lang as questions from documents")
def _(spark, sf):
    return mined(spark, sf).select("report_id", F.array_join("data", "|").alias("questions"))


@query("report_unparsed", "select doc_id as report_id, text as unparsed from documents")
def _(spark, sf):
    bodies = table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), "text")
    return md.mine_reports(bodies, "text").select("report_id", "unparsed")


GLUED = "case doc_id % 4 when 0 then 'I will look.## Found' || chr(10) || text when 1 then text || '.# T' when 2 then '# T' || chr(10) || text || ':## U' else replace(text, chr(10), ' ') || ')### V' end"


@query("notes_clean", f"""
with n as (select doc_id, {GLUED} as notes from documents),
p as (select *, regexp_extract(notes, '(?s)^(.*?[.!?:)])#{{1,3}} ', 1) as before from n)
select doc_id, case when before <> '' and not regexp_matches(notes, '^#{{1,3}} ') and not contains(trim(before, ' ' || chr(10)), chr(10)) then substr(notes, length(before) + 1) else notes end as cleaned from p""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", md.notes_clean(F.expr(GLUED)).alias("cleaned"))


NOTED = """case doc_id % 4 when 0 then '# Notes' || chr(10) || text || chr(10) || '## Key Findings' || chr(10) || text || chr(10) || '### Sub' || chr(10) || 'more' || chr(10) || '## Next' || chr(10) || 'x' || chr(10) || '## Summary' || chr(10) || ' ' || chr(10) || '# End'
 when 1 then text || chr(10) || '#### One strength' || chr(10) || 'It is ' || source when 2 then '# Heading' || chr(10) || text else '## Layer Summary' || chr(10) || '- ' || text end"""


@query("notes_summary", """
select doc_id, case doc_id % 4 when 0 then trim(text, ' ' || chr(10)) || chr(10) || '### Sub' || chr(10) || 'more' when 1 then 'It is ' || source
  when 2 then case when length(trim(text, ' ' || chr(10))) > 700 then left(trim(text, ' ' || chr(10)), 700) || '…' else trim(text, ' ' || chr(10)) end else '- ' || trim(text, ' ' || chr(10)) end as summary from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", md.notes_summary(F.expr(NOTED)).alias("summary"))


# ---- building and reading back ------------------------------------------------------------------
AUD = """
aud as (select s.audit_id, s.url, 'buyers of plan ' || s.audit_id as icp, list_filter([comp1, comp2], lambda x: x is not null) as competitors,
   split_part(split_part(s.url, '/', 3), '.', 1) as company, ['best plan ' || s.audit_id, 'cheap fees'] as keywords from fx_sites s),
doc as (select a.audit_id, d.text, d.lang, d.source, r.markdown from aud a join documents d on d.doc_id = a.audit_id % (select count(*) from documents) join fx_reports r on r.report_id = d.doc_id)"""


def bodies(spark, sf):
    """A report body per audit, out of the documents."""
    docs = reports(spark, sf)
    keyed = spark.sql("select audit_id, audit_id % (select count(*) from {d}) as report_id from {a}",
                      a=audits(spark, sf).select("audit_id"), d=table(spark, sf, "documents"))
    return keyed.join(docs, "report_id").select("audit_id", F.col("markdown").alias("body"), "text", "lang", "source")


def layer_notes(spark, sf):
    b = bodies(spark, sf)
    note = lambda layer, text: F.struct(F.lit(layer).alias("layer"), text.alias("notes"))
    rows = F.array(note(1, F.concat(F.lit("## Found\n"), "text")), note(2, F.lit("**x could not be completed.** Reason: y")),
                   note(3, F.concat(F.lit("# Summary\n"), "source")))
    return b.select("audit_id", F.explode(rows).alias("r")).select("audit_id", "r.*")


NOTES = """
nt as (select audit_id, 1 as layer, '## Found' || chr(10) || text as notes from doc union all select audit_id, 2, '**x could not be completed.** Reason: y' from doc union all select audit_id, 3, '# Summary' || chr(10) || source from doc)"""


def analyst(spark, sf):
    b = bodies(spark, sf)
    note = lambda layer, text: F.struct(F.lit(layer).alias("layer"), text.alias("text"))
    rows = F.array(note(2, F.concat(F.lit(" seen by hand "), "lang")), note(4, F.lit(" ")))
    return b.filter(F.col("audit_id") % 2 == 0).select("audit_id", F.explode(rows).alias("r")).select("audit_id", "r.*")


def log_lines(spark, sf):
    pages = view(spark, sf, "fx_pages").join(audits(spark, sf).select("audit_id", F.col("url").alias("site")), "site")
    return pages.select("audit_id", F.col("page_id").alias("line_ord"), F.concat(F.lit("Page: "), "url", F.lit(" - OK")).alias("line"))


def audit_sources(spark, sf):
    return research.sources_dedup(source_blocks(spark, sf), seeds(spark, sf)).join(audits(spark, sf).select("audit_id"), "audit_id")


def built(spark, sf):
    return report.report_build(audits(spark, sf), bodies(spark, sf), layer_notes(spark, sf), audit_sources(spark, sf),
                               log_lines(spark, sf), analyst(spark, sf))


NL = " || chr(10) || "
BUILT = f"""
lg as (select a.audit_id, string_agg('- Page: ' || p.url || ' - OK', chr(10) order by p.page_id) as log from aud a join fx_pages p on p.site = a.url group by a.audit_id),
sc as (select a.audit_id, string_agg('- [' || case when title <> '' then title else s.url end || '](' || s.url || ')', chr(10) order by s.url) as cited, count(*) as n from aud a join src s on s.audit_id = a.audit_id group by a.audit_id),
bt as (select a.audit_id, a.company, '2024-01-30' as date, '# ' || array_to_string(list_transform(string_split(a.company, '-'), lambda x: upper(x[1]) || substr(x, 2)), '-') || ' Growth Audit'{NL}''{NL}'## 1. Audit Scope'{NL}''{NL}'- **URL audited:** ' || a.url{NL}'- **ICP lens:** ' || a.icp{NL}
   '- **Date:** 2024-01-30'{NL}'- **Competitors compared:** ' || case when len(competitors) > 0 then array_to_string(competitors, ', ') else 'none' end{NL}'- **Channels covered:** {fv.REPORT_CHANNELS}'{NL}
   '- **High-intent keywords used:** ' || array_to_string(keywords, '; '){NL}'- **Method notes:** {fv.REPORT_METHOD}'{NL}''{NL}
   trim(d.markdown, ' ' || chr(10)) || case when a.audit_id % 2 = 0 then chr(10){NL}'## 6. Analyst Field Notes'{NL}''{NL}'_Live observations added by the analyst, not AI-generated._'{NL}''{NL}'### Layer 2 - Paid Acquisition'{NL}''{NL}'seen by hand ' || d.lang else '' end{NL}
   ''{NL}'---'{NL}''{NL}'## Appendix A - Page Fetch Log'{NL}''{NL}lg.log{NL}''{NL}'## Appendix B - Raw Layer Notes'{NL}''{NL}
   '<details>'{NL}'<summary>Layer 1 - Web Conversion</summary>'{NL}''{NL}'## Found'{NL}d.text{NL}''{NL}'</details>'{NL}''{NL}
   '<details>'{NL}'<summary>Layer 2 - Paid Acquisition</summary>'{NL}''{NL}'**x could not be completed.** Reason: y'{NL}''{NL}'</details>'{NL}''{NL}
   '<details>'{NL}'<summary>Layer 3 - Organic Search and AEO</summary>'{NL}''{NL}'# Summary'{NL}d.source{NL}''{NL}'</details>'{NL}''{NL}
   '<details>'{NL}'<summary>Layer 4 - Lifecycle and Post-Signup</summary>'{NL}''{NL}'_Not run._'{NL}''{NL}'</details>'{NL}''{NL}
   '<details>'{NL}'<summary>Layer 5 - Competitive Comparison</summary>'{NL}''{NL}'_Not run._'{NL}''{NL}'</details>' || chr(10) || case when sc.cited is not null then chr(10){NL}'## Appendix C - Sources Consulted'{NL}''{NL}sc.cited || chr(10) else chr(10) end as markdown
  from aud a join doc d on d.audit_id = a.audit_id join lg on lg.audit_id = a.audit_id left join sc on sc.audit_id = a.audit_id)"""
BV = ("fx_sites", "fx_reports", "fx_sources")


@query("report_build", f"with {AUD}, {SOURCES}, {BUILT} select audit_id, company, date, markdown from bt", BV)
def _(spark, sf):
    return built(spark, sf)


@query("report_scope_fields", f"""
with {AUD} select audit_id, url, icp, array_to_string(competitors, '|') as competitors, company, '2024-01-30' as date, array_to_string(keywords, '|') as keywords from aud""", BV)
def _(spark, sf):
    fields = md.report_scope_fields(F.col("markdown"))
    r = built(spark, sf).select("audit_id", "markdown")
    return r.select("audit_id", *[(F.array_join(c, "|") if n in ("competitors", "keywords") else c).alias(n) for n, c in fields.items()])


@query("report_slices", f"""
with {AUD}, {SOURCES}, {BUILT}
select a.audit_id, trim(substr(d.markdown, 11), ' ' || chr(10)) as body, case when a.audit_id % 2 = 0 then '2:seen by hand ' || d.lang else '' end as analyst, '5' as n_notes,
  coalesce(sc.n, 0) as n_sources, lg.log from aud a join doc d on d.audit_id = a.audit_id join lg on lg.audit_id = a.audit_id left join sc on sc.audit_id = a.audit_id""", BV)
def _(spark, sf):
    r = built(spark, sf).select("audit_id", "markdown").withColumns(md.report_slices(F.col("markdown")))
    analyst_text = F.array_join(F.transform("analyst_notes", lambda n: F.concat(n["layer"].cast("string"), F.lit(":"), n["text"])), "|")
    return r.select("audit_id", "body", analyst_text.alias("analyst"), F.size("notes").cast("string").alias("n_notes"),
                    F.size("sources").cast("bigint").alias("n_sources"),
                    F.array_join(F.transform("fetch_log", lambda x: F.concat(F.lit("- "), x)), "\n").alias("log"))


@query("loaded_layer_status", f"""
with {AUD}, {NOTES}
select a.audit_id, l.layer, case when l.layer in (1, 3) then 'done' else 'failed' end as status, coalesce(n.notes, '_Not run._') as notes
from aud a cross join (values (1), (2), (3), (4), (5)) l(layer) left join nt n on n.audit_id = a.audit_id and n.layer = l.layer""", BV)
def _(spark, sf):
    loaded = md.load_reports(built(spark, sf).select("audit_id", "markdown"))
    return rows_of(loaded, "layers", ["audit_id"], item="l").select("audit_id", "l.layer", "l.status", "l.notes")


@query("findings_inject", """
with f as (select doc_id, '- **Observed:** o ' || lang || ' → **Why it matters:** w → **Hypothesis to test:** h' as bullet, text, lang from documents),
r as (select f.*, m.markdown from f join fx_reports m on m.report_id = f.doc_id)
select doc_id as report_id, case doc_id % 4
  when 0 then rtrim(text, ' ' || chr(10)) || chr(10) || chr(10) || '## Automated Findings' || chr(10) || chr(10) || '### Layer 1 - Web Conversion' || chr(10) || chr(10) || bullet || chr(10) || chr(10) || '### Layer 3 - Organic Search and AEO' || chr(10) || chr(10) || bullet || chr(10) || chr(10)
  when 1 then markdown
  else replace(replace(markdown, '### Layer 1 - Web Conversion' || chr(10), '### Layer 1 - Web Conversion' || chr(10) || bullet || chr(10)), '### Layer 3 - Organic' || chr(10), '### Layer 3 - Organic' || chr(10) || bullet || chr(10)) || chr(10) end as body from r""", R)
def _(spark, sf):
    finding = lambda n: F.struct(F.lit(n).alias("layer"), F.concat(F.lit("o "), "lang").alias("observed"), F.lit("w").alias("why"), F.lit("h").alias("hypothesis"))
    both = F.array(finding(1), finding(3))
    r = reports(spark, sf).select(
        "report_id", F.when(F.col("report_id") % 4 == 0, F.col("text")).otherwise(F.col("markdown")).alias("body"),
        F.when(F.col("report_id") % 4 == 1, F.slice(both, 1, 0)).otherwise(both).alias("findings"))
    return r.select("report_id", md.findings_inject(F.col("body"), F.col("findings")).alias("body"))


@query("notes_annotate", pg.o(pg.JS_SQL + pg.NOTE_SQL + f"""
{AUD.strip()}, {NOTES.strip()}
select n.audit_id, n.layer, rtrim(n.notes, ' ' || chr(10)) || chr(10) || chr(10) || coalesce(j.notes || chr(10) || chr(10), '') || m.methods_note as notes
from nt n left join jsf j on j.audit_id = n.audit_id and j.layer = n.layer join fmn m on m.audit_id = n.audit_id and m.layer = n.layer"""), pg.VW + BV)
def _(spark, sf):
    pages = pg.pages_of_audits(spark, sf)
    return report.notes_annotate(layer_notes(spark, sf), findings.js_findings(pages), findings.fetch_methods_note(pages))


TASKS = {k: v.replace("'", "''") for k, v in report.PROMPT_TASKS.items()}
def _register_prompts():
    newline = lambda s: s.replace("\n", "' || chr(10) || '")
    t = {k: newline(v) for k, v in TASKS.items()}
    titles = ", ".join(f"({i}, '{x}')" for i, x in enumerate(fv.LAYER_TITLES, 1))
    sql = pg.SITE_PAGES + pg.SNAP_SQL + pg.FAQ_SQL + f"""
{AUD.strip()}, {NOTES.strip()},
ll as (select replace(url, '/llms.txt', '') as site_url, url || ': ABSENT (HTTP ' || status_code || ')' as llms_txt from fx_llms where status_code = 404 and error is null),
lps as (select lp.audit_id, lp.layer, lp.role, lp.page_ord, s.snapshot, lp.site_url from lp join snap s on s.audit_id = lp.audit_id and s.site_ord = lp.site_ord and s.type_ord = lp.type_ord),
pre as (select a.*, 'Target company: ' || company || ' (' || url || ')'{NL}'Ideal Customer Profile (ICP) lens: ' || icp{NL}'Competitors: ' || case when len(competitors) > 0 then array_to_string(competitors, ', ') else '(none provided)' end{NL}'Audit date: 2024-01-30'{NL}'' || chr(10) as intro,
   '1. ' || keywords[1] || chr(10) || '2. ' || keywords[2] as kw, 'What is the best payment processor for a ' || icp || '?' as question from aud a),
snaps as (select audit_id, layer, role, site_url, string_agg(snapshot, chr(10) order by page_ord) as block, min(page_ord) as first_ord from lps group by audit_id, layer, role, site_url),
layer_all as (select audit_id, layer, string_agg(snapshot, chr(10) order by page_ord) as block from lps group by audit_id, layer),
rivals as (select audit_id, string_agg('## Competitor: ' || site_url || chr(10) || block, chr(10) order by first_ord) as block from snaps where role = 'competitor' and layer = 5 group by audit_id),
raw_notes as (select a.audit_id, string_agg('# ' || t.title || chr(10) || chr(10) || coalesce(n.notes, '_Not run._'), chr(10) || chr(10) order by t.layer) as notes
  from aud a cross join (values {titles}) t(layer, title) left join nt n on n.audit_id = a.audit_id and n.layer = t.layer group by a.audit_id),
j as (select p.*, l1.block as b1, l2.block as b2, l4.block as b4, t5.block as t5, r.block as rb, f.faq_lines, coalesce(l.llms_txt, '') as llms_txt, coalesce(d.source, '') as answer, rn.notes as rn
  from pre p left join layer_all l1 on l1.audit_id = p.audit_id and l1.layer = 1 left join layer_all l2 on l2.audit_id = p.audit_id and l2.layer = 2 left join layer_all l4 on l4.audit_id = p.audit_id and l4.layer = 4
  left join snaps t5 on t5.audit_id = p.audit_id and t5.layer = 5 and t5.role = 'target' left join rivals r on r.audit_id = p.audit_id left join faq f on f.audit_id = p.audit_id left join ll l on l.site_url = p.url
  left join doc d on d.audit_id = p.audit_id left join raw_notes rn on rn.audit_id = p.audit_id)
select audit_id, 'keywords' as kind, intro || '{t["keywords"]}' as prompt from j
union all select audit_id, 'layer_1', intro || '{t["layer_1"]}'{NL}''{NL}'## Page snapshots'{NL}b1 from j
union all select audit_id, 'layer_2', intro || '{t["layer_2"]}'{NL}kw{NL}''{NL}'## Target homepage snapshot (for message-match comparison)'{NL}b2 from j
union all select audit_id, 'layer_3', intro || '{t["layer_3"]}'{NL}kw{NL}''{NL}'## AI answer-engine probe'{NL}'**Question asked:** ' || question{NL}''{NL}'**Answer engine response:**'{NL}''{NL}answer{NL}''{NL}'## llms.txt check'{NL}llms_txt{NL}''{NL}'## FAQ schema check (key pages)'{NL}faq_lines from j
union all select audit_id, 'layer_4', intro || '{t["layer_4"]}'{NL}''{NL}'## Signup page snapshot'{NL}b4 from j
union all select audit_id, 'layer_5', case when len(competitors) = 0 then '{report.SKIPPED_LAYER_5}' else intro || '{t["layer_5"]}'{NL}''{NL}'# Target company (for contrast)'{NL}t5{NL}''{NL}'# Competitors'{NL}rb end from j
union all select audit_id, 'answer_engine_probe', '{t["answer_engine_probe"]}'{NL}''{NL}'Question: ' || question from j
union all select audit_id, 'synthesis', intro || '{t["synthesis"]}'{NL}''{NL}'# Raw research notes'{NL}''{NL}rn from j"""

    @query("layer_prompt_table", pg.o(sql), pg.VW + BV + ("fx_llms",))
    def _(spark, sf):
        checked = view(spark, sf, "fx_llms").filter("status_code = 404 and error is null")
        probes = bodies(spark, sf).select("audit_id", F.col("source").alias("answer"))
        return report.layer_prompt_table(audits(spark, sf), pg.pages_of_audits(spark, sf), cap.llms_txt_status(checked),
                                         probes, layer_notes(spark, sf))


_register_prompts()


@query("report_files_roundtrip", """
select source || '-growth-audit-' || lang || '.md' as file_name, arg_max(markdown, report_id) || chr(10) as markdown from fx_reports group by source, lang""", R)
def _(spark, sf):
    folder = f"{work_dir(spark)}/reports-{uuid.uuid4().hex}"
    report_files.report_files_write(reports(spark, sf).select(
        F.col("report_id").alias("audit_id"), F.col("source").alias("company"), F.col("lang").alias("date"), "markdown"), folder)
    files = report_files.report_files_read(spark, folder)
    return files.select(F.regexp_extract("path", "file_name=([^/]*)", 1).alias("file_name"), "markdown")


def runs(spark, sf):
    a = audits(spark, sf).join(bodies(spark, sf), "audit_id")
    return a.select("audit_id", F.lit("complete").alias("status"), F.lit("").alias("message"), "company", "url", "icp", "competitors", "date", "keywords",
                    F.lit(61).alias("duration"), "body", F.lit(2).alias("n_sources"), F.array("lang").alias("fetch_log"), F.lit("").alias("report_path"))


@query("result_payload", f"""
with {AUD}
select audit_id, cast(audit_id as varchar) as id, company, '5' as n_layers, 'Web Conversion' as short_1, 'done' as status_1, 'pending' as status_2, '## Found' || chr(10) || text as notes_1,
  'a' || (audit_id % (select count(*) from documents)) as observed_1, 'Second' as title_2, '2' as sources,
  'plain strength' || chr(10) || 'more of it' as working_2 from doc join aud using (audit_id)""", BV)
def _(spark, sf):
    states = layer_notes(spark, sf).filter("layer = 1").select(
        "audit_id", "layer", F.lit("done").alias("status"), md.notes_summary(F.col("notes")).alias("summary"), "notes", F.lit("").alias("analyst_notes"))
    doc = report.result_payload(runs(spark, sf), states)
    at = lambda path: F.get_json_object("payload", path)
    layers = F.from_json(at("$.layers"), "array<struct<index:int>>")
    return doc.select(
        "audit_id", at("$.id").alias("id"), at("$.company").alias("company"), F.size(layers).cast("string").alias("n_layers"),
        at("$.layers[0].short").alias("short_1"), at("$.layers[0].status").alias("status_1"), at("$.layers[1].status").alias("status_2"),
        at("$.layers[0].notes").alias("notes_1"), at("$.layers[0].observations[0].observed").alias("observed_1"),
        at("$.priorities[1].title").alias("title_2"), at("$.sources").alias("sources"), at("$.layers[1].working").alias("working_2"))
