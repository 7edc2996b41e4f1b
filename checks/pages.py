"""Queries over page captures, each with its SQL: URLs, features, render gaps, discovery, findings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.views import audits, captures, table, view, with_views
from funnelscope import fixed_values as fv
from funnelscope.functions import match, text as tx, urls
from funnelscope.functions.arrays import rows_of
from funnelscope.operators import discovery, features, findings, layers, render
from funnelscope.session import materialize
from funnelscope.sources import captures as cap, html as ht

QUERIES, ORACLE = {}, {}


def query(name, sql=None, views=()):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn
    return register


# ---- SQL building blocks ------------------------------------------------------------------------
DECODE = ("regexp_replace(replace(replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), "
          "'&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp([^a-zA-Z0-9.-]|$)', '&\\1', 'g')")
OK = """
c as (select *, case when error is not null then error when status_code >= 400 then 'HTTP ' || status_code
        when mode = 'standard' and coalesce(content_type, 'html') not like '%html%' then 'Non-HTML content (' || content_type || ')' end as err from fx_captures),
ok as (select url, mode, html from c where err is null),
el as (select url, mode, ord, regexp_extract(e, '^<(a|button)', 1) as tag,
    trim(regexp_replace(""" + DECODE.format(x="regexp_extract(e, '>([^<]*)<', 1)") + """, '\\s+', ' ', 'g')) as text,
    case when e like '<a %' then regexp_extract(e, 'href="([^"]*)"', 1) end as href
  from (select url, mode, unnest(l) as e, generate_subscripts(l, 1) as ord
        from (select url, mode, regexp_extract_all(html, '<(?:a|button)[^>]*>[^<]*</(?:a|button)>') as l from ok) q) r),
ab as (select *, case when href is null then null when href = '' then url when href like '//%' then split_part(url, '/', 1) || href
    when href like '/%' then split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || href else href end as href_abs from el),
links as (select url, mode, text, href_abs as href, row_number() over (partition by url, mode order by ord) - 1 as ord from ab where tag = 'a' and href_abs like 'http%'),
cta0 as (select url, mode, ord, text, case when coalesce(href, '') <> '' then text || ' -> ' || href_abs else text || ' [button]' end as entry,
    row_number() over (partition by url, mode, lower(text) order by ord) as nth
  from ab where text <> '' and length(text) <= 60 and regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(""" + fv.CTA_WORDS + """)($|[^\\p{L}\\p{N}_])')),
cta as (select url, mode, entry, text, row_number() over (partition by url, mode order by ord) as k from cta0 where nth = 1),
ctas as (select url, mode, list(entry order by k) filter (where k <= 25) as ctas, list(text order by k) filter (where k <= 25) as cta_texts,
    list(text order by k) as cta_all from cta group by url, mode),
txt as (select url, mode, html, list_transform(regexp_extract_all(html, '(?s)<form>(.*?)</form>', 1), lambda f: list_transform(
    list_filter(regexp_extract_all(f, '<(?:input|select|textarea)[^>]*>'), lambda t: not regexp_matches(t, 'type="(hidden|submit|button)"')),
    lambda t: {'name': coalesce(nullif(regexp_extract(t, ' name="([^"]*)"', 1), ''), nullif(regexp_extract(t, ' id="([^"]*)"', 1), ''),
      nullif(regexp_extract(t, ' placeholder="([^"]*)"', 1), ''), regexp_extract(t, '^<([a-z]+)', 1)), 'required': regexp_matches(t, ' required[ >]')})) as form_lists, trim(regexp_replace(""" + DECODE.format(
    x="regexp_replace(html, '<style>.*?</style>|<script[^>]*>.*?</script>|<!--.*?-->|<[^>]*>', ' ', 'gs')") + """, '\\s+', ' ', 'g')) as text from ok),
feat0 as (select t.url, t.mode, t.text, case when t.text = '' then 0 else length(t.text) - length(replace(t.text, ' ', '')) + 1 end as word_count,
    regexp_extract_all(t.text, '(?i)[$€£]\\s?\\d[\\d,.]*[km]?\\b|\\b\\d+(?:\\.\\d+)?\\s?%|\\bper (?:month|transaction|user|seat|year)\\b|/mo(?:nth)?\\b') as prices,
    list_transform(regexp_extract_all(t.html, '<h1>([^<]*)', 1)[1:5], lambda x: trim(""" + DECODE.format(x="x") + """)) as h1,
    list_transform(regexp_extract_all(t.html, '<h2>([^<]*)', 1)[1:10], lambda x: trim(x)) as h2,
    trim(""" + DECODE.format(x="regexp_extract(t.html, '<title>([^<]*)', 1)") + """) as title,
    trim(regexp_extract(t.html, '<meta name="description" content="([^"]*)"', 1)) as meta_description,
    list_transform(form_lists[1:5], lambda l, i: 'form ' || i || ': ' || len(l) || ' fields (' || array_to_string(
      list_transform(l[1:15], lambda e: e.name || case when e.required then '*' else '' end), ', ') || ')') as forms, flatten(form_lists) as form_fields,
    list_sort(list_distinct(case when t.html like '%ld+json%' then ['FAQPage', 'WebPage', 'Question'] else []::varchar[] end
      || case when t.html like '%itemtype%' then ['Product'] else []::varchar[] end)) as schema_types
  from txt t),
feat as (select f.*, coalesce(x.ctas, []::varchar[]) as ctas, coalesce(x.cta_texts, []::varchar[]) as cta_texts, coalesce(x.cta_all, []::varchar[]) as cta_all
  from feat0 f left join ctas x on x.url = f.url and x.mode = f.mode),
"""
CAPS = ("fx_captures",)


def o(body: str) -> str:
    """``body`` behind the common CTEs; ``@select`` marks where its own CTEs end."""
    return re.sub(r",\s*@select", "\nselect", "with " + OK.strip() + "\n" + body)


def both(spark, sf):
    """Features of every capture, standard and rendered, in one parse."""
    return features.page_features(view(spark, sf, "fx_captures"))


def standard(spark, sf):
    return features.page_features(captures(spark, sf, "standard"))


def rendered(spark, sf):
    return features.page_features(captures(spark, sf, "rendered"))


def resolved(spark, sf):
    return render.capture_resolve(standard(spark, sf), rendered(spark, sf))


def resolved_table(spark, sf):
    return materialize(resolved(spark, sf), "resolved-pages")


def pages_of_audits(spark, sf):
    return materialize(discovery.site_pages(audits(spark, sf), resolved_table(spark, sf)), "site-pages")


def joined(c, glue="|"):
    return F.array_join(c, glue)


# ---- sources and URL functions ------------------------------------------------------------------
@query("capture_classify", o("@select url, mode, err is null as ok, err as error from c"), CAPS)
def _(spark, sf):
    return cap.capture_classify(view(spark, sf, "fx_captures").drop("html")).select("url", "mode", "ok", "error")


@query("error_condense", """
with m as (select doc_id, case when doc_id % 2 = 0 then 'Max retries exceeded (Caused by NewError(' || replace(text, chr(10), ' ') || '))' else text end as msg from documents)
select doc_id, 'ConnectionError: ' || left(case when regexp_matches(msg, 'Caused by \\w+\\((.*)\\)\\)?$') then regexp_extract(msg, 'Caused by \\w+\\((.*)\\)\\)?$', 1) else msg end, 200) as condensed from m""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    msg = F.when(F.col("doc_id") % 2 == 0, F.concat(
        F.lit("Max retries exceeded (Caused by NewError("), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("))"))).otherwise(F.col("text"))
    return d.select("doc_id", cap.error_condense(msg, F.lit("ConnectionError")).alias("condensed"))


@query("llms_txt_status", """
select replace(url, '/llms.txt', '') as site_url, url || case
  when error is not null then ': LOCAL CHECK FAILED (' || error || '). Use web_fetch on this URL to determine whether llms.txt is present.'
  when status_code = 200 and coalesce(content_type, '') not like '%html%' then ': PRESENT (HTTP 200, ' || length(html) || ' chars). Preview:' || chr(10) || '```' || chr(10) || left(trim(html), 800) || chr(10) || '```'
  when status_code = 200 then ': returned HTTP 200 but as HTML (likely a soft-404 / catch-all page) - treat as ABSENT'
  else ': ABSENT (HTTP ' || status_code || ')' end as llms_txt from fx_llms""", ("fx_llms",))
def _(spark, sf):
    return cap.llms_txt_status(view(spark, sf, "fx_llms"))


@query("request_csv_split", """
select doc_id, len(parts) as n_items, array_to_string(parts, '|') as items
from (select doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') as parts from documents) q""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", urls.csv_split(F.col("text")).alias("p")).select(
        "doc_id", F.size("p").cast("bigint").alias("n_items"), joined("p").alias("items"))


RAW_URL = ("case page_id % 4 when 0 then '  ' || upper(url) when 1 then split_part(url, '://', 2) when 2 then "
           "replace(url, '.example', ':8080.example') else url || ' ' end")


def raw_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.expr(RAW_URL).alias("raw"))


@query("url_normalize", f"""
select page_id, case when regexp_matches(trim(raw), '(?i)^https?://') then lower(split_part(trim(raw), '/', 1)) || '//' || lower(split_part(trim(raw), '/', 3))
  else 'https://' || lower(split_part(trim(raw), '/', 1)) end as normalized from (select page_id, {RAW_URL} as raw from pages) q""")
def _(spark, sf):
    return raw_urls(spark, sf).select("page_id", urls.url_normalize(F.col("raw")).alias("normalized"))


@query("bare_domain", "select page_id, regexp_replace(lower(split_part(url, '/', 3)), '^www\\.', '') as domain from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.bare_domain(F.col("url")).alias("domain"))


@query("company_name", """
with p as (select page_id, string_split(regexp_replace(lower(split_part(url, '/', 3)), '^www\\.', ''), '.') as l from pages)
select page_id, case when n = '' then 'company' else n end as company from (
  select page_id, regexp_replace(case when len(l) <= 2 or length(l[-2]) > 3 then l[1] else l[-3] end, '[^a-z0-9-]', '', 'g') as n from p) q""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.company_name(F.col("url")).alias("company"))


@query("same_site", """
with p as (select page_id, regexp_replace(lower(split_part(url, '/', 3)), '^www\\.', '') as d from pages)
select a.page_id, b.page_id as other_id, ends_with(a.d, b.d) as same, a.d = b.d or ends_with(a.d, '.' || b.d) as same_strict
from p a join p b on b.page_id = a.page_id + 1""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    q = p.select((F.col("page_id") - 1).alias("page_id"), F.col("page_id").alias("other_id"), F.col("url").alias("base"))
    return p.join(q, "page_id").select(
        "page_id", "other_id", urls.same_site(F.col("url"), F.col("base")).alias("same"),
        urls.same_site(F.col("url"), F.col("base"), strict=True).alias("same_strict"))


@query("url_validate", f"""
with n as (select page_id, case when regexp_matches(trim(raw), '(?i)^https?://') then lower(split_part(trim(raw), '/', 1)) || '//' || lower(split_part(trim(raw), '/', 3))
  else 'https://' || lower(split_part(trim(raw), '/', 1)) end as u from (select page_id, {RAW_URL} as raw from pages) q)
select page_id, case when regexp_matches(regexp_replace(split_part(u, '/', 3), '^www\\.', ''), '^[a-z0-9.-]+\\.[a-z]{{2,}}$') then u end as valid_url from n""")
def _(spark, sf):
    return raw_urls(spark, sf).select("page_id", urls.url_validate(F.col("raw")).alias("valid_url"))


@query("report_filename", """
select audit_id, c || '-growth-audit-2024-01-30.md' as file_name, array_to_string(list_transform(string_split(c, '-'), lambda x: upper(x[1]) || substr(x, 2)), '-') || ' Growth Audit' as title
from (select audit_id, split_part(split_part(url, '/', 3), '.', 1) as c from fx_sites) q""", ("fx_sites",))
def _(spark, sf):
    return audits(spark, sf).select(
        "audit_id", urls.report_filename(F.col("company"), F.col("date")).alias("file_name"),
        urls.report_title(F.col("company")).alias("title"))


# ---- page features ------------------------------------------------------------------------------
@query("page_tokenize", o("""
tags as (select url, mode, regexp_extract_all(html, '<(?:a|button|form|h1|h2|input|meta|select|textarea|title)(?: [^>]*)?>|<div itemscope[^>]*>') as l from ok)
select url, mode, cast(ord as int) as ord, regexp_extract(e, '^<([a-z0-9]+)', 1) as tag, case when e like '<a %' then regexp_extract(e, 'href="([^"]*)"', 1) end as href
from (select url, mode, unnest(l) as e, generate_subscripts(l, 1) as ord from tags) q"""), CAPS)
def _(spark, sf):
    parsed = ht.page_tokenize(cap.capture_classify(view(spark, sf, "fx_captures")))
    return rows_of(parsed, "elements", ["url", "mode"], item="e").select("url", "mode", "e.ord", "e.tag", "e.href")


@query("link_resolve", o("@select url, mode, cast(ord as bigint) as nth, href, href_abs from (select *, row_number() over (partition by url, mode order by ord) as nth_ from ab where tag = 'a') q(url, mode, ord_, tag, text, href, href_abs, ord)"), CAPS)
def _(spark, sf):
    parsed = ht.page_tokenize(cap.capture_classify(view(spark, sf, "fx_captures")))
    anchors = F.filter("elements", lambda e: e["tag"] == "a")
    return rows_of(parsed, anchors, ["url", "mode"], "i", "e").select(
        "url", "mode", (F.col("i") + 1).cast("bigint").alias("nth"), "e.href", "e.href_abs")


@query("page_title_meta", o("@select url, mode, title, meta_description from feat"), CAPS)
def _(spark, sf):
    return both(spark, sf).filter("ok").select("url", "mode", "title", "meta_description")


@query("page_headings", o("@select url, mode, array_to_string(h1, '|') as h1, array_to_string(h2, '|') as h2, cast(len(h2) as int) as n_h2 from feat"), CAPS)
def _(spark, sf):
    return both(spark, sf).filter("ok").select("url", "mode", joined("h1").alias("h1"), joined("h2").alias("h2"), F.size("h2").alias("n_h2"))


@query("page_links", o("@select url, mode, cast(ord as int) as ord, text, href from links"), CAPS)
def _(spark, sf):
    return rows_of(both(spark, sf).filter("ok"), "links", ["url", "mode"], "ord", "l").select("url", "mode", "ord", "l.text", "l.href")


@query("page_ctas", o("@select url, mode, array_to_string(ctas, '|') as ctas, cast(len(ctas) as int) as n from feat"), CAPS)
def _(spark, sf):
    return both(spark, sf).filter("ok").select("url", "mode", joined("ctas").alias("ctas"), F.size("ctas").alias("n"))


@query("cta_text", o("@select url, mode, cast(k as int) as k, text as cta from cta where k <= 25"), CAPS)
def _(spark, sf):
    return rows_of(both(spark, sf).filter("ok"), "ctas", ["url", "mode"], "i", "c").select(
        "url", "mode", (F.col("i") + 1).alias("k"), features.cta_text(F.col("c")).alias("cta"))


@query("page_forms", o("@select url, mode, array_to_string(forms, '|') as forms from feat"), CAPS)
def _(spark, sf):
    return both(spark, sf).filter("ok").select("url", "mode", joined("forms").alias("forms"))


@query("jsonld_types", o("""
@select url, mode, case when html like '%ld+json%' then 'FAQPage|Question|WebPage' else '' end as types from ok"""), CAPS)
def _(spark, sf):
    parsed = ht.page_tokenize(cap.capture_classify(view(spark, sf, "fx_captures"))).filter("ok")
    return parsed.select("url", "mode", joined(F.sort_array("ld_types")).alias("types"))


@query("microdata_types", o("""
@select url, mode, array_to_string(list_transform(regexp_extract_all(html, 'itemtype="([^"]*)"', 1), lambda x: string_split(rtrim(x, '/'), '/')[-1]), '|') as types from ok"""), CAPS)
def _(spark, sf):
    parsed = ht.page_tokenize(cap.capture_classify(view(spark, sf, "fx_captures"))).filter("ok")
    return parsed.select("url", "mode", joined(features.microdata_types(F.col("elements"))).alias("types"))


@query("schema_types", o("@select url, mode, array_to_string(schema_types, '|') as types, list_contains(schema_types, 'FAQPage') as has_faq_schema from feat"), CAPS)
def _(spark, sf):
    return both(spark, sf).filter("ok").select("url", "mode", joined("schema_types").alias("types"), "has_faq_schema")


@query("visible_text", o("@select url, mode, text from feat"), CAPS)
def _(spark, sf):
    return ht.page_tokenize(cap.capture_classify(view(spark, sf, "fx_captures"))).filter("ok").select("url", "mode", "text")


@query("word_count", o("@select url, mode, cast(word_count as int) as word_count, length(left(text, 6000)) as excerpt_chars, word_count < 150 as very_low from feat"), CAPS)
def _(spark, sf):
    return both(spark, sf).filter("ok").select(
        "url", "mode", "word_count", F.length("text_excerpt").cast("bigint").alias("excerpt_chars"),
        features.thin_flag(F.col("word_count")).alias("very_low"))


@query("domain_rollup", o("""
d as (select regexp_replace(split_part(url, '/', 3), '^www\\.', '') as domain, f.word_count, coalesce(l.n, 0) as n_links, f.word_count < 500 as thin
  from feat f left join (select url, mode, count(*) as n from links group by url, mode) l using (url, mode) where f.mode = 'standard')
select domain, count(*) as pages, round(avg(word_count), 6) as mean_words, count(*) filter (thin) as thin_pages, cast(sum(n_links) as bigint) as links_out from d group by domain"""), CAPS)
def domain_rollup(spark, sf):
    """Flagship: every page parsed once, then one partial aggregation per domain."""
    f = standard(spark, sf).filter("ok")
    return f.groupBy(urls.bare_domain(F.col("url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.avg("word_count"), 6).alias("mean_words"),
        F.count_if(F.col("word_count") < fv.THIN_PAGE_WORDS).alias("thin_pages"), F.sum(F.size("links")).alias("links_out"))


# ---- predicates ---------------------------------------------------------------------------------
@query("cta_match", f"""
select doc_id, regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({fv.CTA_WORDS})($|[^\\p{{L}}\\p{{N}}_])') as is_cta from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", match.cta_match(F.col("text")).alias("is_cta"))


@query("price_mentions", """
select doc_id, len(m) as n_mentions, array_to_string(m, '|') as mentions from (
  select doc_id, regexp_extract_all(text, '(?i)[$€£]\\s?\\d[\\d,.]*[km]?\\b|\\b\\d+(?:\\.\\d+)?\\s?%|\\bper (?:month|transaction|user|seat|year)\\b|/mo(?:nth)?\\b') as m
  from (select doc_id, text || ' $' || doc_id || '.50k and 0.' || n_chars || '% per month or €' || n_chars || ' /mo' as text from documents) d) q""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    n, i = F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    priced = F.concat("text", F.lit(" $"), i, F.lit(".50k and 0."), n, F.lit("% per month or €"), n, F.lit(" /mo"))
    return d.select("doc_id", match.price_mentions(priced).alias("m")).select(
        "doc_id", F.size("m").cast("bigint").alias("n_mentions"), joined("m").alias("mentions"))


@query("fetch_gate", o("""
@select c.url, case when c.err is null and f.word_count < 500 then 'thin' when c.err is not null and c.status_code in (401, 403, 429, 503) then 'blocked' end as reason
from c left join feat f using (url, mode) where c.mode = 'standard' and (f.word_count < 500 or (c.err is not null and c.status_code in (401, 403, 429, 503)))"""), CAPS)
def _(spark, sf):
    gate = match.fetch_gate(F.col("ok"), F.col("word_count"), F.col("status_code"))
    return standard(spark, sf).select("url", gate.alias("reason")).filter(F.col("reason").isNotNull())


TYPE_SQL = "\n".join(
    f"case when {' or '.join(f'contains(hay, $${w}$$)' for w in words)} then '{key}' end," for key, _, words, _ in fv.PAGE_TYPES)


@query("page_type_match", o(f"""
h as (select url, mode, ord, lower(text) || ' ' || lower(regexp_replace(regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')) as hay from links)
select url, mode, cast(ord as int) as ord, types from (select url, mode, ord, concat_ws('|', {TYPE_SQL.rstrip(',')}) as types from h) q where types <> ''"""), CAPS)
def _(spark, sf):
    l = rows_of(both(spark, sf).filter("ok"), "links", ["url", "mode"], "ord", "l")
    return l.select("url", "mode", "ord", joined(match.page_type_match(F.col("l.text"), F.col("l.href"))).alias("types")).filter("types <> ''")


# ---- raw against rendered -----------------------------------------------------------------------
GAP = """
s as (select * from feat where mode = 'standard'), r as (select * from feat where mode = 'rendered'),
gap0 as (select r.url, s.word_count as raw_words, r.word_count as words,
   list_filter(r.cta_texts, lambda x: not list_contains(list_transform(s.cta_texts, lambda y: lower(y)), lower(x))) as fresh,
   list_filter(r.schema_types, lambda x: not list_contains(s.schema_types, x)) as new_types,
   s.h1 as h1s, r.h1 as h1r, s.h2 as h2s, r.h2 as h2r, s.forms as fs, r.forms as fr, s.prices as ps, r.prices as pr
 from s join r on r.url = s.url),
gap as (select url, raw_words, words, list_filter([
  case when len(pr) >= 2 and len(ps) * 2 < len(pr) then {'short': 'pricing', 'detailed': 'pricing (' || len(pr) || ' price mentions, e.g. ' ||
     array_to_string((list_filter(pr, lambda x, i: list_position(pr, x) = i and x[1] in ('$', '€', '£')) || list_filter(pr, lambda x, i: list_position(pr, x) = i and x[1] not in ('$', '€', '£')))[1:3], ', ') || ')'} end,
  case when len(fresh) > 0 then {'short': 'CTAs', 'detailed': 'calls to action such as ' || array_to_string(list_transform(fresh[1:3], lambda x: '''' || x || ''''), ', ')} end,
  case when len(h1r) > 0 and len(h1s) = 0 then {'short': 'the main headline', 'detailed': 'the main headline (''' || left(h1r[1], 80) || ''')'}
       when len(h2r) >= len(h2s) + 3 then {'short': 'section headings', 'detailed': (len(h2r) - len(h2s)) || ' section headings'} end,
  case when len(fr) > 0 and len(fs) = 0 then {'short': 'forms', 'detailed': 'the page''s forms (e.g. signup or contact fields)'} end,
  case when len(new_types) > 0 then {'short': 'structured data', 'detailed': 'structured data (' || array_to_string(new_types, ', ') || ')'} end,
  case when words >= greatest(2 * raw_words, raw_words + 150) then {'short': 'body copy', 'detailed': 'most of the body copy (' || format('{:,}', raw_words) || ' of ' || format('{:,}', words) || ' words are in the raw HTML)'} end
 ], lambda x: x is not null) as missing from gap0),
res as (select cs.url, case when fs.word_count >= 500 or (cs.err is not null and coalesce(cs.status_code, 0) <> 403) then 'raw'
     when cr.err is not null then 'render failed' when cs.err is not null then 'blocked'
     when len(g.missing) > 0 or fr.word_count >= fs.word_count + 100 then 'rendered' else 'no extra' end as verdict,
   cs.err as raw_err, cr.err as shown_err, cs.status_code as raw_status, cr.status_code as shown_status, fs.word_count as raw_words, fr.word_count as shown_words, g.missing
 from c cs join c cr on cr.url = cs.url and cr.mode = 'rendered' left join s fs on fs.url = cs.url left join r fr on fr.url = cs.url left join gap g on g.url = cs.url
 where cs.mode = 'standard'),
page as (select url, verdict in ('blocked', 'rendered') as shown, raw_err is null or verdict = 'blocked' as ok,
   case when verdict not in ('blocked', 'rendered') then raw_err end as error,
   case when verdict in ('blocked', 'rendered') then shown_status else raw_status end as status_code,
   case when verdict in ('blocked', 'rendered') then 'playwright' else 'standard' end as fetch_method,
   case when verdict = 'rendered' then raw_words end as raw_word_count,
   coalesce(case when verdict in ('blocked', 'rendered') then shown_words else raw_words end, 0) as word_count,
   case when verdict = 'rendered' then missing else [] end as missing,
   case verdict when 'render failed' then 'headless browser retry failed: ' || shown_err when 'blocked' then 'plain request was blocked (' || raw_err || ')'
     when 'no extra' then 'headless browser retry found no extra content (' || format('{:,}', shown_words) || ' words)' else '' end as render_note from res),
"""
METHOD = """case when fetch_method = 'playwright' and raw_word_count is not null then 'headless browser (Playwright) - raw HTML had ' || format('{:,}', raw_word_count) || ' words, rendered page ' || format('{:,}', word_count)
  when fetch_method = 'playwright' then 'headless browser (Playwright) - ' || render_note
  when render_note <> '' then 'standard HTTP (' || render_note || ')' else 'standard HTTP' end"""


@query("render_gap", o(GAP + "@select url, array_to_string(list_transform(missing, lambda x: x.short), '|') as shorts, array_to_string(list_transform(missing, lambda x: x.detailed), '|') as details from gap"), CAPS)
def _(spark, sf):
    return render.render_gaps(standard(spark, sf), rendered(spark, sf)).select(
        "url", joined(F.transform("js_missing", lambda m: m["short"])).alias("shorts"),
        joined(F.transform("js_missing", lambda m: m["detailed"])).alias("details"))


@query("capture_resolve", o(GAP + "@select url, ok, error, cast(status_code as int) as status_code, fetch_method, cast(raw_word_count as int) as raw_word_count, cast(word_count as int) as word_count, cast(len(missing) as int) as n_missing, render_note from page"), CAPS)
def _(spark, sf):
    return resolved(spark, sf).select("url", "ok", "error", "status_code", "fetch_method", "raw_word_count", "word_count",
                                      F.size("js_missing").alias("n_missing"), "render_note")


@query("fetch_method_text", o(GAP + f"@select url, {METHOD} as how from page"), CAPS)
def _(spark, sf):
    return resolved(spark, sf).select("url", render.fetch_method_text().alias("how"))


# ---- discovery ----------------------------------------------------------------------------------
TYPES_CTE = "types as (select * from (values " + ", ".join(
    f"({i}, '{key}', '{label}', [{', '.join(chr(39) + w + chr(39) for w in words)}], [{', '.join(chr(39) + p + chr(39) for p in paths)}])"
    for i, (key, label, words, paths) in enumerate(fv.PAGE_TYPES, 1)) + ") t(type_ord, page_type, label, words, paths)),\n"
CAND = TYPES_CTE + """
site as (select distinct url as site_url from (select url from fx_sites union all select comp1 from fx_sites union all select comp2 from fx_sites) q where url is not null),
hl as (select l.url as site_url, l.ord, l.href, lower(l.text) || ' ' || lower(regexp_replace(regexp_extract(l.href, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')) as hay
  from links l join page p on p.url = l.url and l.mode = case when p.shown then 'rendered' else 'standard' end and p.ok
  join site on site.site_url = l.url
  where ends_with(regexp_replace(split_part(l.href, '/', 3), '^www\\.', ''), regexp_replace(split_part(l.url, '/', 3), '^www\\.', ''))),
m as (select site_url, type_ord, page_type, ord, href, split_part(href, '#', 1) as bare from hl, types where len(list_filter(words, lambda w: contains(hay, w))) > 0),
kept as (select *, min(ord) over (partition by site_url, page_type, bare) as first_ord from m),
lc as (select site_url, type_ord, page_type, ord, bare as url from kept where contains(href, '#') or ord = first_ord),
pc as (select site_url, type_ord, page_type, k, site_url || p as url from (select site_url, type_ord, page_type, unnest(paths) as p, generate_subscripts(paths, 1) as k from site, types) q
  where not exists (select 1 from lc where lc.site_url = q.site_url and lc.page_type = q.page_type and lc.url = q.site_url || q.p)),
cand as (select site_url, type_ord, page_type, source, url, row_number() over (partition by site_url, page_type order by source, k) as rank
  from (select site_url, type_ord, page_type, 'link' as source, ord as k, url from lc union all select site_url, type_ord, page_type, 'path', k, url from pc) q),
tried as (select d.*, coalesce(p.ok, false) as ok, case when not coalesce(p.ok, false) then coalesce(p.error, 'not captured') end as error
  from cand d left join page p on p.url = d.url where rank <= 6),
disc as (select site_url, page_type, type_ord, bool_or(ok) as ok, coalesce(arg_min(url, rank) filter (ok), arg_min(url, rank)) as page_url,
  case when not bool_or(ok) then 'No reachable page found. Tried: ' || string_agg(url, ', ' order by rank) || ' (last error: ' || arg_max(error, rank) || ')' end as error
  from tried group by site_url, page_type, type_ord),
"""
VW = ("fx_captures", "fx_sites")


def sites(spark, sf):
    return discovery.wanted_pages(audits(spark, sf)).select("site_url").distinct()


def found(spark, sf, pages, limit=fv.MAX_CANDIDATES):
    return discovery.page_candidates(discovery.home_pages(sites(spark, sf), pages), limit)


@query("page_candidates_links", o(GAP + CAND + "@select site_url, page_type, cast(rank as int) as rank, url from cand where source = 'link'"), VW)
def _(spark, sf):
    return found(spark, sf, resolved(spark, sf), None).filter("source = 'link'").select("site_url", "page_type", "rank", "url")


@query("page_candidates_paths", o(GAP + CAND + "@select site_url, page_type, cast(rank as int) as rank, url from cand where source = 'path'"), VW)
def _(spark, sf):
    return found(spark, sf, resolved(spark, sf), None).filter("source = 'path'").select("site_url", "page_type", "rank", "url")


@query("page_candidates_top6", o(GAP + CAND + "@select site_url, page_type, cast(rank as int) as rank, source, url from cand where rank <= 6"), VW)
def _(spark, sf):
    return found(spark, sf, resolved(spark, sf)).select("site_url", "page_type", "rank", "source", "url")


@query("page_discover", o(GAP + CAND + "@select site_url, page_type, ok, page_url from disc"), VW)
def _(spark, sf):
    pages = resolved_table(spark, sf)
    return discovery.page_discover(found(spark, sf, pages), pages).select("site_url", "page_type", "ok", "page_url")


@query("page_missing", o(GAP + CAND + "@select site_url, page_type, page_url as requested_url, error from disc where not ok"), VW)
def _(spark, sf):
    pages = resolved_table(spark, sf)
    return discovery.page_missing(discovery.page_discover(found(spark, sf, pages), pages))


SITE_PAGES = GAP + CAND + """
asite as (select audit_id, 'target' as role, 0 as site_ord, url as site_url from fx_sites union all
  select audit_id, 'competitor', 1, comp1 from fx_sites where comp1 is not null union all
  select audit_id, 'competitor', case when comp1 is null then 1 else 2 end, comp2 from fx_sites where comp2 is not null),
want as (select a.*, t.type_ord, t.page_type, case when role = 'target' then t.label when t.type_ord = 0 then split_part(site_url, '/', 3) || ' homepage' else split_part(site_url, '/', 3) || ' pricing page' end as label
  from asite a, (select type_ord, page_type, label from types union all select 0, 'home', 'Homepage') t where role = 'target' or t.type_ord in (0, 1)),
sp0 as (select w.*, case when w.type_ord = 0 then w.site_url else d.page_url end as requested_url, d.error as missing_error
  from want w left join disc d on d.site_url = w.site_url and d.page_type = w.page_type),
sp1 as (select s.audit_id, s.role, s.site_ord, s.site_url, s.type_ord, s.page_type, s.label, s.requested_url,
   coalesce(p.ok, false) and missing_error is null as ok, case when not (coalesce(p.ok, false) and missing_error is null) then coalesce(missing_error, p.error, 'not captured') end as error,
   case when p.url is not null then s.requested_url end as final_url, p.status_code, coalesce(p.fetch_method, 'standard') as fetch_method, p.raw_word_count, coalesce(p.word_count, 0) as word_count,
   coalesce(p.missing, []) as missing, coalesce(p.render_note, '') as render_note, coalesce(p.shown, false) as shown
  from sp0 s left join page p on p.url = s.requested_url),
sp as (select s.*, coalesce(f.title, '') as title, coalesce(f.meta_description, '') as meta_description, coalesce(f.h1, []) as h1, coalesce(f.h2, []) as h2, coalesce(f.ctas, []) as ctas, coalesce(f.forms, []) as forms,
   coalesce(f.cta_texts, []) as cta_texts, coalesce(f.schema_types, []) as schema_types, coalesce(f.prices, []) as prices, coalesce(left(f.text, 6000), '') as text_excerpt, f.mode
  from sp1 s left join feat f on f.url = s.requested_url and f.mode = case when s.shown then 'rendered' else 'standard' end),
lp as (select * from (select sp.*, site_ord * 10 + type_ord as page_ord, unnest([1, 2, 3, 4, 5]) as layer from sp) p
  where case layer when 2 then role = 'target' and type_ord = 0 when 4 then role = 'target' and type_ord = 4 when 5 then role <> 'target' or type_ord in (0, 1) else role = 'target' end),
"""


@query("site_page_matrix", o(SITE_PAGES + """
@select audit_id, role, site_url, max(s) filter (page_type = 'home') as home, max(s) filter (page_type = 'pricing') as pricing, max(s) filter (page_type = 'compare') as compare,
  max(s) filter (page_type = 'contact_sales') as contact_sales, max(s) filter (page_type = 'signup') as signup
from (select *, case when ok then requested_url else 'missing' end as s from sp) q group by audit_id, role, site_url"""), VW)
def _(spark, sf):
    return discovery.site_page_matrix(pages_of_audits(spark, sf))


@query("layer_pages", o(SITE_PAGES + "@select audit_id, cast(layer as int) as layer, cast(page_ord as int) as page_ord, label, requested_url from lp"), VW)
def _(spark, sf):
    return discovery.layer_pages(pages_of_audits(spark, sf)).select("audit_id", "layer", "page_ord", "label", "requested_url")


# ---- findings -----------------------------------------------------------------------------------
@query("join_natural", """
with w as (select doc_id, string_split(replace(text, chr(10), ' '), ' ') as l from documents),
d as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) as u from w)
select doc_id, case when len(u) = 1 then u[1] else array_to_string(u[1:len(u) - 1], ', ') || ' and ' || u[-1] end as joined from d""")
def _(spark, sf):
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    return table(spark, sf, "documents").select("doc_id", tx.join_natural(words).alias("joined"))


def _q(template: str, **parts: str) -> str:
    """A phrase as a SQL concatenation."""
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, sql in parts.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out


JS_SQL = SITE_PAGES + """
uniq as (select *, list_transform(missing, lambda x: x.detailed) as det, list_transform(missing, lambda x: x.short) as sh from sp where role = 'target' and len(missing) > 0),
fl as (select audit_id, flatten(list(sh order by type_ord)) as shorts0, list(lower(label) order by type_ord) as names,
   string_agg(case when len(det) = 1 then det[1] else array_to_string(det[1:len(det) - 1], ', ') || ' and ' || det[-1] end || ' on the ' || lower(label), '; ' order by type_ord) as details,
   string_agg(label || ': ' || format('{:,}', raw_word_count) || ' words in raw HTML vs ' || format('{:,}', word_count) || ' after rendering (' || final_url || ')', '; ' order by type_ord) as evidence
  from uniq group by audit_id),
fj0 as (select *, list_filter(shorts0, lambda x, i: list_position(shorts0, x) = i) as us from fl),
fj as (select audit_id, details, evidence, case when list_contains(us, 'pricing') then 'Pricing and other key content is' else 'Key content is' end as lead,
   case when len(us) = 1 then us[1] else array_to_string(us[1:len(us) - 1], ', ') || ' and ' || us[-1] end as shorts,
   case when len(names) = 1 then names[1] else array_to_string(names[1:len(names) - 1], ', ') || ' and ' || names[-1] end as pages from fj0),
""" + f"""
ff as (select audit_id, 1 as layer, {_q(fv.JS_OBSERVED_1, lead='lead', details='details')} as observed, {_q(fv.JS_WHY_1)} as why,
   {_q(fv.JS_HYPOTHESIS_1, shorts='shorts', pages='pages')} as hypothesis, {_q(fv.JS_FOOTER, evidence='evidence')} as footer, 'CRO' as kind from fj
 union all select audit_id, 3, {_q(fv.JS_OBSERVED_3, shorts='shorts')}, {_q(fv.JS_WHY_3)}, {_q(fv.JS_HYPOTHESIS_3, shorts='shorts')}, {_q(fv.JS_FOOTER, evidence='evidence')}, 'SEO/AEO' from fj),
jsf as (select audit_id, layer, observed, why, hypothesis, {_q(fv.JS_NOTES, kind='kind', observed='observed', why='why', footer='footer')} as notes from ff),
"""


@query("js_findings", o(JS_SQL + "@select audit_id, cast(layer as int) as layer, observed, why, hypothesis, notes from jsf"), VW)
def _(spark, sf):
    return findings.js_findings(pages_of_audits(spark, sf))


LOG_SQL = f"""
flog as (select audit_id, site_ord * 10 + type_ord as line_ord, case when ok then label || ': ' || coalesce(final_url, requested_url) || ' - OK (HTTP ' || coalesce(cast(status_code as varchar), 'None') || ', ' || {METHOD} || ')'
  else label || ': ' || requested_url || ' - FAILED (' || error || ')' || case when render_note <> '' then ' [headless browser: ' || render_note || ']' else '' end end as line from sp),
"""
NOTE_SQL = f"""
fmn as (select audit_id, layer, '**Page fetch methods (local snapshots):**' || chr(10) || string_agg('- ' || label || ': ' || case when ok then {METHOD} else 'not retrieved locally (' || error || ')' end, chr(10) order by page_ord) as methods_note
  from lp group by audit_id, layer),
"""


@query("fetch_log", o(SITE_PAGES + LOG_SQL + "@select audit_id, cast(line_ord as int) as line_ord, line from flog"), VW)
def _(spark, sf):
    return findings.fetch_log(pages_of_audits(spark, sf))


@query("fetch_methods_note", o(SITE_PAGES + NOTE_SQL + "@select audit_id, cast(layer as int) as layer, methods_note from fmn"), VW)
def _(spark, sf):
    return findings.fetch_methods_note(pages_of_audits(spark, sf))


FAQ_SQL = """
faq as (select audit_id, string_agg('- ' || label || ' (' || requested_url || '): ' || case when ok then 'FAQ schema ' || case when list_contains(schema_types, 'FAQPage') then 'PRESENT' else 'absent' end || '; schema types: ' || case when len(schema_types) > 0 then array_to_string(schema_types, ', ') else 'none' end
   else 'not checked locally (' || error || ') - use web_fetch on this URL and look for FAQPage JSON-LD' end, chr(10) order by type_ord) as faq_lines from sp where role = 'target' group by audit_id),
"""


@query("faq_check_lines", o(SITE_PAGES + FAQ_SQL + "@select audit_id, faq_lines from faq"), VW)
def _(spark, sf):
    return findings.faq_check_lines(pages_of_audits(spark, sf))


def _or_none(sql, none="(none)"):
    return f"coalesce(nullif({sql}, ''), '{none}')"


SNAP_SQL = f"""
snap as (select audit_id, role, site_url, site_ord, type_ord, label, requested_url, case when not ok then '### ' || label || chr(10) || '- URL: ' || requested_url || chr(10) || '- LOCAL FETCH FAILED: ' || error || chr(10)
   || case when render_note <> '' then '- Headless browser: ' || render_note || chr(10) else '' end || '- Try web_fetch on this URL; if that also fails, record the page as unavailable.' || chr(10)
 else concat_ws(chr(10), '### ' || label, '- URL: ' || requested_url || ' (final: ' || final_url || ', HTTP ' || status_code || ')', '- Fetch method: ' || {METHOD},
   '- Title: ' || {_or_none('title')}, '- Meta description: ' || {_or_none('meta_description')}, '- H1: ' || {_or_none("array_to_string(h1, ' | ')")},
   '- H2 (first 10): ' || {_or_none("array_to_string(h2, ' | ')")}, '- CTA-like links/buttons (in page order): ' || {_or_none("array_to_string(ctas, ' | ')", '(none found)')},
   '- Forms: ' || {_or_none("array_to_string(forms, ' || ')")}, '- Structured data types: ' || {_or_none("array_to_string(schema_types, ', ')")},
   '- FAQ schema present: ' || case when list_contains(schema_types, 'FAQPage') then 'yes' else 'no' end,
   '- Visible word count: ' || word_count || case when word_count < 150 then ' (very low - page is likely client-side rendered; consider web_fetch)' else '' end,
   case when len(missing) > 0 then '- JAVASCRIPT-RENDERED: missing from the raw HTML, visible only after JavaScript runs: ' || array_to_string(list_transform(missing, lambda x: x.detailed), '; ') end,
   '- Visible text excerpt (first 6000 chars):', '```', text_excerpt, '```') || chr(10) end as snapshot from sp),
"""


@query("snapshot_markdown", o(SITE_PAGES + SNAP_SQL + "@select audit_id, label, snapshot from snap"), VW)
def _(spark, sf):
    return pages_of_audits(spark, sf).select("audit_id", "label", findings.snapshot_markdown().alias("snapshot"))


# ---- layer measures -----------------------------------------------------------------------------
OWN = GAP + "own as (select f.* from page p join feat f on f.url = p.url and f.mode = case when p.shown then 'rendered' else 'standard' end where p.ok),"
PATH_OF = "lower(regexp_replace(regexp_extract({x}, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''))"
SIGNUP = " or ".join(f"contains(' ' || {PATH_OF.format(x='url')}, $${w}$$)" for key, _, words, _ in fv.PAGE_TYPES if key == "signup" for w in words)
KINDS = ("list_transform(form_fields, lambda f: {'required': f.required, 'category': case "
         + " ".join(f"when regexp_matches(lower(f.name), '{'|'.join(words)}') then '{name}'" for name, words in layers.FIELD_CATEGORIES.items())
         + " else 'other' end})")
CATEGORIES = [*layers.FIELD_CATEGORIES, "other"]


def own_pages(spark, sf):
    """Every page by the capture that serves it better."""
    return resolved(spark, sf).filter("ok")


@query("primary_competing_ctas", o(OWN + """
@select url, cta_all[1] as primary_cta, array_to_string(cta_all[2:], '|') as competing, cast(greatest(len(cta_all) - 1, 0) as int) as n_competing,
  case when len(cta_all) > 0 then (len(cta_all) - 1) / len(cta_all) else 0.0 end as dilution from own"""), CAPS)
def _(spark, sf):
    return layers.primary_competing_ctas(own_pages(spark, sf)).select(
        "url", "primary_cta", joined("competing_ctas").alias("competing"), "n_competing", "dilution")


@query("friction_signals", o(OWN + """
@select url, cast(len(form_fields) as int) as visible_fields, cast(len(list_filter(form_fields, lambda f: f.required)) as int) as required_fields, len(prices) = 0 as no_price, len(ctas) = 0 as no_cta, word_count < 150 as very_low_text,
  cast(len(prices) = 0 as int) + cast(len(ctas) = 0 as int) + cast(word_count < 150 as int) as n_flags from own"""), CAPS)
def _(spark, sf):
    return layers.friction_signals(own_pages(spark, sf))


@query("landing_assets", o(OWN + """
k as (select regexp_replace(split_part(href, '/', 3), '^www\\.', '') as domain, href, lower(regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1)) as path from links join (select url, mode from own) p using (url, mode))
select domain, kind, count(*) as links, count(distinct href) as assets, 'INFERRED' as evidence from (select domain, href, case when regexp_matches(path, '/(lp|go)/') then 'campaign'
  when regexp_matches(path, '(^|[/_-])vs([/_-]|$)') then 'versus' when contains(path, 'switch') then 'switch' end as kind from k) q where kind is not null group by domain, kind"""), CAPS)
def _(spark, sf):
    return layers.landing_assets(discovery.link_table(own_pages(spark, sf)))


@query("message_match", o(OWN + """
ad as (select page_id, keyword, url, title || ' ' || keyword || ' Plans' as title from fx_serp),
j as (select a.keyword, a.page_id, a.url, list_distinct(list_filter(regexp_split_to_array(lower(a.title), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as w,
   list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', f.title, array_to_string(f.h1, ' '))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as p
  from ad a join own f on f.url = a.url)
select keyword, page_id as position, url, round(len(list_intersect(w, p)) / len(list_distinct(w || p)), 9) as match from j"""), ("fx_captures", "fx_serp"))
def _(spark, sf):
    serp = view(spark, sf, "fx_serp").select(
        "keyword", F.col("page_id").alias("position"), "url", F.concat("title", F.lit(" "), "keyword", F.lit(" Plans")).alias("title"))
    return layers.message_match(serp, own_pages(spark, sf)).withColumn("match", F.round("match", 9))


@query("upfront_information", o(OWN + f"""
k as (select url, {KINDS} as kinds, {SIGNUP} as is_signup from own where len(form_fields) > 0),
@select url, {', '.join(f"len(list_filter(kinds, lambda k: k.category = '{c}')) as {c}" for c in CATEGORIES)},
  {', '.join(f"len(list_filter(kinds, lambda k: k.category = '{c}' and k.required)) as required_{c}" for c in CATEGORIES)},
  len(list_filter(kinds, lambda k: k.required)) as required, is_signup from k"""), CAPS)
def _(spark, sf):
    return layers.upfront_information(own_pages(spark, sf))


@query("competitive_matrix", o(SITE_PAGES + """
calc as (select distinct url, mode from links where contains(lower(regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1)), 'calculator')),
ps as (select audit_id, role, sp.site_url, bool_or(ok and len(prices) > 0) as has_price, bool_or(ok and calc.url is not null) as has_calculator,
   max(cta_texts[1]) filter (page_type = 'home') as primary_cta, bool_or(list_contains(schema_types, 'FAQPage')) as has_faq
  from sp left join calc on calc.url = sp.requested_url and calc.mode = sp.mode group by audit_id, role, sp.site_url)
select c.audit_id, c.site_url as competitor, c.has_price, c.has_calculator, c.primary_cta, c.has_faq, t.has_price as target_has_price, t.has_calculator as target_has_calculator,
  t.primary_cta as target_primary_cta, t.has_faq as target_has_faq from ps c join ps t on t.audit_id = c.audit_id and t.role = 'target' where c.role = 'competitor'"""), VW)
def _(spark, sf):
    return layers.competitive_matrix(pages_of_audits(spark, sf))


@query("competitive_means", o(SITE_PAGES + """
calc as (select distinct url, mode from links where contains(lower(regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1)), 'calculator')),
ps as (select audit_id, role, sp.site_url, bool_or(ok and len(prices) > 0) as has_price, bool_or(ok and calc.url is not null) as has_calculator,
   max(cta_texts[1]) filter (page_type = 'home') as primary_cta, bool_or(list_contains(schema_types, 'FAQPage')) as has_faq
  from sp left join calc on calc.url = sp.requested_url and calc.mode = sp.mode group by audit_id, role, sp.site_url)
select audit_id, role, cast(grouping(audit_id, role) as int) as level, count(*) as sites, avg(case when has_price then 1.0 else 0.0 end) as price_share,
  avg(case when has_calculator then 1.0 else 0.0 end) as calculator_share, avg(case when has_faq then 1.0 else 0.0 end) as faq_share from ps group by rollup (audit_id, role)"""), VW)
def _(spark, sf):
    return layers.competitive_means(pages_of_audits(spark, sf))
