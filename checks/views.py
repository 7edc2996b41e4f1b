"""Input tables of the registered queries, derived from the given tables by SQL both engines run.

The given pages hold no forms, prices, structured data or call-to-action links, so ``fx_pages`` writes
some into every page's HTML by a rule on its id; no row or text is left out anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from funnelscope.functions.urls import company_name
from funnelscope.session import spread

SITE = ("'https://' || case when split_part(url, '/', 3) like 'www.%' then substr(split_part(url, '/', 3), 5) "
        "else split_part(url, '/', 3) end")

# More forms, fields and calls to action than a printed summary holds, and a field name with a comma.
LONG_FORMS = ("<form>" + "".join(f'<input name="company {i}" required>' for i in range(20)) + "</form>"
              + '<form><input name="email, phone" required></form>' + "".join(f'<form><input id="bank{i}"></form>' for i in range(5)))
MANY_CTAS = "".join(f"<button>Book a demo {i}</button>" for i in range(30))

VIEWS = {
    "fx_pages": f"""
select page_id, url, {SITE} as site, replace(replace(replace(html,
  '</title>', '</title>' || case when page_id % 3 = 1 then '<meta name="description" content=" All about plan ' || cast(page_id as string) || ' ">' else '' end),
  '</nav>', case when page_id % 4 = 0 then '<a href="/pricing">See pricing</a><a href="/signup?src=nav">Get started free</a><a href="">See  Pricing</a>'
       when page_id % 4 = 1 then '<a href="/compare#top">Compare us vs others</a><button>Book a demo</button><a href="/calculator#a">Savings</a><a href="/calculator#b">Savings</a>'
       when page_id % 4 = 2 then '<a href="//www.other.example.org/fees">Fees</a><a href="mailto:x@y.z">Contact sales</a><a href="/lp/offer">Offer</a><a href="/go/switch-now">Switch now</a>'
       else '<a href="/demo">Book a demo</a>' end || case when page_id % 9 = 4 then '{MANY_CTAS}' else '' end || '</nav>'),
  '</article>', case when page_id % 2 = 0 then '<h2>Plans</h2><h2>Rates</h2><h2></h2><p>$349 per month, 0.35% fee</p>' else '' end ||
  case when page_id % 5 = 0 then '<form><input name="email" required><input type="hidden" name="t"><select id="vol"></select><textarea placeholder="tax id"></textarea><input type="submit"></form>' else '' end ||
  case when page_id % 6 = 5 then '{LONG_FORMS}' else '' end ||
  case when page_id % 7 = 0 then '<div itemscope itemtype="https://schema.org/Product/"></div>' else '' end ||
  case when page_id % 3 = 0 then '<script type="application/ld+json">{{"@type":["FAQPage","WebPage"],"mainEntity":[{{"@type":"Question"}}]}}</script>' else '' end || '</article>') as html
from pages""",
    "fx_named": """
select page_id, url, site, html from fx_pages
union all
select p.page_id, k.url, p.site, p.html
from (select site as url, min(page_id) as page_id from fx_pages group by site) k join fx_pages p on p.page_id = k.page_id
union all
select p.page_id, k.url, p.site, p.html
from (select site || path as url, min(page_id) as page_id from (
        select site, page_id, case page_id % 5 when 0 then '/pricing' when 1 then '/calculator' when 2 then '/demo' when 3 then '/signup' else '/plans' end as path
        from fx_pages) q group by site || path) k join fx_pages p on p.page_id = k.page_id""",
    "fx_captures": """
select url, 'standard' as mode,
  case when page_id % 20 = 13 then null when page_id % 10 = 9 then 403 else 200 end as status_code,
  case when page_id % 10 = 8 then 'application/pdf' when page_id % 10 = 6 then null else 'text/html; charset=utf-8' end as content_type,
  url as final_url, case when page_id % 2 = 0 then regexp_replace(html, '(?s)<article>.*</article>', '') else html end as html,
  case when page_id % 20 = 13 then 'ConnectTimeout: timed out' end as error
from fx_named
union all
select url, 'rendered' as mode, case when page_id % 10 = 7 then 500 else 200 end as status_code, 'text/html' as content_type,
  url as final_url, html, cast(null as string) as error
from fx_named""",
    "fx_sites": """
select h.audit_id, h.url, case when a.site <> h.url then a.site end as comp1,
  case when b.site <> h.url and b.site <> a.site then b.site end as comp2
from (select min(page_id) as audit_id, site as url from fx_pages group by site) h
left join fx_pages a on a.page_id = h.audit_id + 1 left join fx_pages b on b.page_id = h.audit_id + 2""",
    "fx_llms": """
select site || '/llms.txt' as url, 'standard' as mode, case when page_id % 4 = 3 then 404 else 200 end as status_code,
  case when page_id % 4 = 0 then null when page_id % 4 = 1 then 'text/plain' else 'text/html' end as content_type, site || '/llms.txt' as final_url, html,
  case when page_id % 9 = 5 then 'ReadTimeout: slow' end as error
from fx_named where url = site""",
    "fx_blocks": """
select conv_id as audit_id, cast(1 + conv_id % 5 as int) as layer, cast(floor(turn / 3) as bigint) as turn, turn % 3 as pos,
  case when role = 'user' then case when turn % 4 = 0 then 'server_tool_use' when turn % 4 = 2 then 'web_search_tool_result' else 'web_fetch_tool_result' end else 'text' end as block_type,
  text, case when conv_id % 11 = 3 and turn >= 3 then 'refusal' when conv_id % 7 = 2 and turn >= 3 then 'max_tokens'
             when conv_id % 13 = 5 then 'end_turn' else 'pause_turn' end as stop_reason,
  case when conv_id % 2 = 0 then 'web_search' else 'web_fetch' end as tool_name,
  case when conv_id % 3 = 0 then null else length(text) % 9 end as n_results, case when conv_id % 3 = 0 then 'unavailable' end as error_code
from conversations""",
    "fx_sources": """
select c.conv_id as audit_id, c.turn, p.url, case when c.turn % 2 = 0 then '' else 't' || cast(c.turn as string) end as title,
  case when c.role = 'user' then 'web_search_tool_result' else 'text' end as block_type
from (select conv_id, turn, role, (conv_id * 3 + turn % 4) % (select count(*) from pages) as page_id from conversations) c
join pages p on p.page_id = c.page_id""",
    "fx_events": """
select user_id as audit_id, event_id, ts,
  case event_type when 'view' then 'step' when 'click' then 'log' when 'signup' then 'layer' when 'purchase' then 'keywords' else 'complete' end as type,
  cast(event_id % 8 as int) + 1 as step, cast(event_id % 5 as int) + 1 as layer,
  case when value >= 100 then 'done' when value >= 20 then 'running' else 'failed' end as status,
  case when event_id % 2 = 0 then 'activity' else 'info' end as level, ' ' || props as text, value
from events""",
    "fx_layer_runs": """
select audit_id, cast(layer as int) as layer,
  case when value < 60 or kind = 'view' then null when kind = 'error' then 'APIStatusError' when kind = 'click' then 'APIConnectionError'
       when kind = 'purchase' and value > 180 then 'AuthenticationError' else 'ValueError' end as error_type,
  cast(case when kind = 'error' then 400 + event_id % 100 end as int) as status_code,
  case when value > 120 then 'Your Credit balance is too low' else 'overloaded ' || cast(event_id as string) end as error_message
from (select user_id as audit_id, event_id % 6 + 1 as layer, max(event_id) as event_id, max_by(event_type, event_id) as kind, max_by(value, event_id) as value
      from events group by user_id, event_id % 6 + 1) q""",
    "fx_notes": """
select user_id as audit_id, event_id, cast(event_id % 6 as string) as layer, props as text, ts as saved_at from events where event_type in ('view', 'click')""",
    "fx_attempts": """
select user_id as client, event_id, ts, event_type <> 'error' as ok from events where event_type in ('error', 'signup')""",
    "fx_reports": """
select doc_id as report_id, '# Report' || chr(10) || chr(10) || '## 2. What''s Working' || chr(10) || '- **Layer ' || cast(doc_id % 5 + 1 as string) || ' - X**: ' || replace(text, chr(10), ' ') || chr(10) ||
 '- plain strength' || chr(10) || '  more of it' || chr(10) || chr(10) ||
 '## 3. Channel-by-Channel Observations' || chr(10) || '### Layer 1 - Web Conversion' || chr(10) || '- **Observed:** a' || cast(doc_id as string) || ' → **Why it matters:** b -> **Hypothesis to test:** c' || chr(10) ||
 case when doc_id % 3 = 0 then '- only raw ' || lang || chr(10) else '' end || chr(10) || '### Layer 3 - Organic' || chr(10) || 'Nothing to say.' || chr(10) || chr(10) ||
 '## 4. Priority Stack' || chr(10) || '### 1. First ' || source || chr(10) || 'Impact: High / Confidence: ' || case when doc_id % 2 = 0 then 'Medium' else 'low' end || ' / Speed: Low' || chr(10) || 'Because ' || lang || '.' || chr(10) || chr(10) ||
 '### 2) Second' || chr(10) || '**Impact:** Med, **Confidence:** High, **Speed:** High' || chr(10) || chr(10) ||
 '## 5. Data I''d Want Before Committing' || chr(10) || '- q1' || chr(10) || '* q2 ' || lang as markdown, lang, source, text
from documents""",
    "fx_serp": """
select page_id, split_part(url, '/', 4) as keyword, url, 'Result ' || cast(page_id as string) as title from pages""",
}
NEEDS = {
    "fx_pages": ["pages"], "fx_named": ["fx_pages"], "fx_captures": ["fx_named"], "fx_sites": ["fx_pages"],
    "fx_llms": ["fx_named"], "fx_blocks": ["conversations"], "fx_sources": ["conversations", "pages"],
    "fx_events": ["events"], "fx_layer_runs": ["events"], "fx_notes": ["events"], "fx_attempts": ["events"],
    "fx_reports": ["documents"], "fx_serp": ["pages"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # only the tables whose texts are parsed or matched
    return spread(df) if name in ("pages", "documents") else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a lazy DataFrame; inputs are bound by name, nothing stays registered."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    inputs = {n: view(spark, sf_dir, n) for n in NEEDS[name]}
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for n in inputs:
        for word in ("from", "join", ","):
            sql = sql.replace(f"{word} {n}", f"{word} {{{n}}}")
    return spark.sql(sql, **inputs)


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the derived tables it names as CTEs, in order of need."""
    order: list[str] = []

    def add(name):
        if name in VIEWS and name not in order:
            for n in NEEDS[name]:
                add(n)
            order.append(name)
    for name in names:
        add(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} as materialized ({VIEWS[n].strip()})" for n in order)
    return f"with {ctes}\n{sql}" if not sql.lstrip().startswith("with ") else f"with {ctes},\n{sql.lstrip()[5:]}"


def captures(spark, sf_dir, mode: str) -> DataFrame:
    return view(spark, sf_dir, "fx_captures").filter(F.col("mode") == mode)


def audits(spark, sf_dir) -> DataFrame:
    """One audit per site with up to two competitors."""
    sites = view(spark, sf_dir, "fx_sites")
    return sites.select(
        "audit_id", "url", F.concat(F.lit("buyers of plan "), F.col("audit_id").cast("string")).alias("icp"),
        F.array_compact(F.array("comp1", "comp2")).alias("competitors"), company_name(F.col("url")).alias("company"),
        F.lit("2024-01-30").alias("date"),
        F.array(F.concat(F.lit("best plan "), F.col("audit_id").cast("string")), F.lit("cheap fees")).alias("keywords"))
