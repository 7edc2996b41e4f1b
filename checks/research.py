"""Queries over response blocks, sources, keywords and search results, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import table, view, with_views
from funnelscope import fixed_values as fv
from funnelscope.functions import urls
from funnelscope.operators import layers, research
from funnelscope.operators.timeline import running_sum

QUERIES, ORACLE = {}, {}


def query(name, sql=None, views=()):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return register


TURNS = """
t as (select audit_id, layer, turn, max(stop_reason) as stop from fx_blocks where turn < 6 group by audit_id, layer, turn),
k as (select *, max(case when stop <> 'pause_turn' then 1 else 0 end) over (partition by audit_id, layer order by turn rows between unbounded preceding and 1 preceding) as stopped from t),
kept as (select audit_id, layer, turn, stop from k where coalesce(stopped, 0) = 0),
b as (select b.*, k.stop from fx_blocks b join kept k on k.audit_id = b.audit_id and k.layer = b.layer and k.turn = b.turn where k.stop <> 'refusal'),
lt as (select audit_id, layer, max(turn * 1000 + pos) filter (block_type <> 'text') as last_tool from b group by audit_id, layer),
said as (select b.audit_id, b.layer, string_agg(b.text, '' order by b.turn, b.pos) as text from b join lt on lt.audit_id = b.audit_id and lt.layer = b.layer
  where b.block_type = 'text' and b.turn * 1000 + b.pos > coalesce(lt.last_tool, -1) group by b.audit_id, b.layer),
ends as (select audit_id, layer, arg_max(stop, turn) as stop from kept group by audit_id, layer),
answers as (select e.audit_id, e.layer, trim(coalesce(s.text, '') || case e.stop when 'refusal' then chr(10) || chr(10) || '_(The model declined to complete this part of the audit.)_'
   when 'max_tokens' then chr(10) || chr(10) || '_(Output truncated: max_tokens reached.)_' else '' end, ' ' || chr(10)) as answer
  from ends e left join said s on s.audit_id = e.audit_id and s.layer = e.layer)
"""


@query("turn_limit", f"with {TURNS} select audit_id, layer, turn, stop as stop_reason from kept", ("fx_blocks",))
def _(spark, sf):
    return research.turn_limit(view(spark, sf, "fx_blocks"))


@query("answer_after_last_tool", f"with {TURNS} select audit_id, layer, answer from answers", ("fx_blocks",))
def _(spark, sf):
    return research.answer_after_last_tool(view(spark, sf, "fx_blocks"))


@query("activity_feed", """
with w as (select *, max(case when block_type = 'text' then pos end) over (partition by audit_id, layer, turn order by pos rows between unbounded preceding and 1 preceding) as last_text,
   max(case when block_type = 'server_tool_use' then pos end) over (partition by audit_id, layer, turn order by pos rows between unbounded preceding and 1 preceding) as last_call from fx_blocks),
a as (select audit_id, layer, turn, pos, case
   when block_type = 'text' then case when last_text is null or last_call > last_text then 'Analyzing results and writing findings' end
   when block_type = 'server_tool_use' and tool_name = 'web_search' then 'Searching the web: "' || text || '"'
   when block_type = 'server_tool_use' then 'Fetching page'
   when block_type = 'web_search_tool_result' then case when n_results is not null then '  ' || n_results || ' results returned' else '  search failed (unavailable)' end
   else case when error_code is not null then '  fetch failed (unavailable)' else '  page retrieved' end end as activity from w)
select * from a where activity is not null""", ("fx_blocks",))
def _(spark, sf):
    blocks = view(spark, sf, "fx_blocks").withColumn("tool_input", F.create_map(F.lit("query"), F.col("text")))
    return research.activity_feed(blocks)


def source_blocks(spark, sf):
    link = F.array(F.struct("url", "title"))
    return view(spark, sf, "fx_sources").select(
        "audit_id", F.lit(1).alias("layer"), "turn", F.lit(0).alias("pos"), "block_type",
        F.when(F.col("block_type") == "text", link).alias("citations"),
        F.when(F.col("block_type") != "text", link).alias("results"))


def seeds(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("audit_id"), "url", F.lit("saved").alias("title"))


SOURCES = """
src as (select audit_id, url, arg_min(title, turn) as title from (
  select audit_id, turn, url, title from fx_sources union all select page_id, -1, url, 'saved' from pages) q group by audit_id, url)"""


@query("sources_dedup", f"with {SOURCES} select audit_id, url, title from src", ("fx_sources",))
def _(spark, sf):
    return research.sources_dedup(source_blocks(spark, sf), seeds(spark, sf))


@query("sources_list", f"with {SOURCES} select audit_id, url, case when title <> '' then title else url end as display from src", ("fx_sources",))
def _(spark, sf):
    return research.sources_list(research.sources_dedup(source_blocks(spark, sf), seeds(spark, sf)))


# a model's keyword answer made of a turn's whole text: sentences as JSON strings, a number among some, some broken off
SAID = """select conv_id, turn, 'Sure [x' || chr(10) || case when conv_id % 4 = 1 then '' else '["' end || replace(clean, '. ', case when conv_id % 3 = 0 then '", 1, " ' else '", "' end) ||
  case when conv_id % 5 = 4 then '"' else '"]' end as answer, 'https://acme' || cast(conv_id as string) || '.com' as url,
  case when conv_id % 2 = 0 then 'https://rival' || cast(conv_id as string) || '.co.uk' end as rival
from (select conv_id, turn, replace(replace(replace(replace(replace(text, '"', ''), chr(92), ''), chr(10), ' '), '[', ''), ']', '') as clean from conversations) q"""
SAID = SAID.replace("'Sure [x' || chr(10)", "'Sure' || chr(10)")
LISTED = f"""
said as ({SAID}),
j as (select *, regexp_extract(answer, '(?s)\\[.*\\]') as js from said),
u as (select *, case when json_valid(js) then list_filter(list_transform(list_filter(cast(js as json[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: trim(x->>'$')), lambda x: x <> '') else [] end as usable,
   case when rival is null then 'square' else 'rival' || conv_id end as r from j),
kw as (select conv_id, turn, url, case when len(usable) >= 3 then usable[1:5] else ['best payment processor for small business', 'switch from ' || r || ' payment processing', 'interchange plus pricing',
   'lowest credit card processing fees', 'acme' || conv_id || ' vs ' || r] end as keywords from u)"""


def generated(spark, sf):
    said = spark.sql(SAID.replace("from conversations", "from {c}").replace("chr(92)", "char(92)"), c=table(spark, sf, "conversations"))
    rivals = F.array_compact(F.array("rival"))
    return said.withColumn("keywords", research.keywords_extract(F.col("answer"), F.col("url"), rivals))


@query("keywords_extract", f"with {LISTED} select conv_id, turn, array_to_string(keywords, '|') as keywords from kw")
def _(spark, sf):
    return generated(spark, sf).select("conv_id", "turn", F.array_join("keywords", "|").alias("keywords"))


CHOOSE = """case when conv_id % 6 = 0 then ' one ,, two,' when conv_id % 6 = 1 then ',,' else '' end"""


@query("keywords_choose", f"""
with {LISTED}
select conv_id, turn, array_to_string(case when conv_id % 6 = 0 then ['one', 'two'] when conv_id % 6 = 1 then [] when conv_id % 6 = 2 then ['kept'] else keywords end, '|') as keywords from kw""")
def _(spark, sf):
    saved = F.when(F.col("conv_id") % 6 == 2, F.array(F.lit("kept")))
    return generated(spark, sf).select("conv_id", "turn", F.array_join(
        research.keywords_choose(F.expr(CHOOSE), saved, F.col("keywords")), "|").alias("keywords"))


@query("keyword_brand_check", f"""
with {LISTED}
select conv_id, turn, array_to_string(list_filter(keywords, lambda k: contains(lower(k), 'acme' || conv_id)), '|') as branded from kw""")
def _(spark, sf):
    return generated(spark, sf).select("conv_id", "turn", F.array_join(
        research.keyword_brand_check(F.col("keywords"), urls.company_name(F.col("url"))), "|").alias("branded"))


@query("organic_rank", """
with s as (select keyword, url, regexp_replace(split_part(url, '/', 3), '^www\\.', '') as domain, row_number() over (partition by keyword order by page_id) as position from fx_serp),
b as (select keyword, domain, min(position) as position, arg_min(url, position) as url from s group by keyword, domain),
r as (select *, row_number() over (partition by keyword order by position) - 1 as domains_above, first_value(domain) over (partition by keyword order by position) as leader from b)
select keyword, domain, position, url, domains_above, leader from r where domain in (select split_part(url, '/', 3) from fx_sites)""", ("fx_serp", "fx_sites"))
def _(spark, sf):
    serp = running_sum(view(spark, sf, "fx_serp"), ["keyword"], "page_id", [], F.lit(1), "position", width=10_000)
    targets = view(spark, sf, "fx_sites").select(urls.bare_domain(F.col("url")).alias("domain"))
    return layers.organic_rank(serp.select("keyword", "position", "url"), targets)


@query("answer_mention_share", f"""
with {TURNS},
own as (select a.audit_id, a.layer, a.answer, regexp_replace(split_part(p.url, '/', 3), '^www\\.', '') as domain from answers a
  join (select conv_id, min(conv_id) % (select count(*) from pages) as page_id from conversations group by conv_id) c on c.conv_id = a.audit_id join pages p on p.page_id = c.page_id),
named as (select *, split_part(domain, '.', case when len(string_split(domain, '.')) > 2 and length(string_split(domain, '.')[-2]) <= 3 then len(string_split(domain, '.')) - 2 else 1 end) as company from own),
ans as (select audit_id, domain, company, case when audit_id % 2 = 0 then answer || ' Try ' || upper(company) else answer end as answer from named),
m as (select company, domain, count(*) as n_answers, count(*) filter (contains(lower(answer), company)) as n_naming from ans group by company, domain),
s as (select a.domain, count(*) as n_sources, count(*) filter (ends_with(regexp_replace(split_part(f.url, '/', 3), '^www\\.', ''), a.domain)) as n_owned
  from (select distinct audit_id, domain from ans) a join (select distinct audit_id, url from fx_sources) f on f.audit_id = a.audit_id group by a.domain)
select m.company, m.domain, n_answers, n_naming, n_naming / n_answers as mention_share, coalesce(n_sources, 0) as n_sources, case when n_sources > 0 then n_owned / n_sources else 0.0 end as owned_share
from m left join s on s.domain = m.domain""", ("fx_blocks", "fx_sources"))
def _(spark, sf):
    pages = table(spark, sf, "pages")
    answers = research.answer_after_last_tool(view(spark, sf, "fx_blocks"))
    owner = spark.sql("select conv_id as audit_id, conv_id % (select count(*) from {p}) as page_id from {c} group by conv_id",
                      p=pages, c=table(spark, sf, "conversations"))
    domain = urls.bare_domain(F.col("url"))
    owned = (answers.join(owner, "audit_id").join(pages.select("page_id", "url"), "page_id")
             .select("audit_id", urls.company_name(F.col("url")).alias("company"), domain.alias("domain"), "answer"))
    told = owned.withColumn("answer", F.when(F.col("audit_id") % 2 == 0, F.concat(
        "answer", F.lit(" Try "), F.upper("company"))).otherwise(F.col("answer")))
    cited = view(spark, sf, "fx_sources").select("audit_id", "url").distinct()
    return layers.answer_mention_share(told, cited)
