"""Page features from tokenized elements: array functions only, no explode and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.match import cta_match, price_mentions
from funnelscope.functions.text import collapse, let, rstrip, strip
from funnelscope.sources.captures import capture_classify
from funnelscope.sources.html import page_tokenize


def _tagged(elements: Column, *tags: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*tags))


def page_title(elements: Column) -> Column:
    return F.coalesce(F.try_element_at(_tagged(elements, "title"), F.lit(1))["text"], F.lit(""))


def page_meta_description(elements: Column) -> Column:
    metas = F.filter(elements, lambda e: (e["tag"] == "meta") & (e["attrs"]["name"] == "description"))
    return F.coalesce(strip(F.try_element_at(metas, F.lit(1))["attrs"]["content"]), F.lit(""))


def page_headings(elements: Column, tag: str, limit: int) -> Column:
    return F.transform(F.slice(_tagged(elements, tag), 1, limit), lambda e: e["text"])


def page_links(elements: Column) -> Column:
    """(text, absolute href) of every http link, page order, repeats kept."""
    anchors = F.filter(elements, lambda e: (e["tag"] == "a") & e["href_abs"].startswith("http"))
    return F.transform(anchors, lambda e: F.struct(collapse(e["text"]).alias("text"), e["href_abs"].alias("href")))


def cta_entries(elements: Column) -> Column:
    """Every call-to-action entry in page order; of a text's spellings the first."""
    texts = F.transform(_tagged(elements, "a", "button"), lambda e: F.struct(
        collapse(e["text"]).alias("text"), e["href"].alias("href"), e["href_abs"].alias("href_abs")))
    wanted = F.filter(texts, lambda e: (e["text"] != "") & (F.length(e["text"]) <= fv.MAX_CTA_CHARS)
                      & cta_match(e["text"]))
    entries = F.transform(wanted, lambda e, i: F.struct(
        F.lower(e["text"]).alias("key"), i.alias("pos"),
        F.when(F.length(e["href"]) > 0, F.concat(e["text"], F.lit(" -> "), e["href_abs"]))
         .otherwise(F.concat(e["text"], F.lit(" [button]"))).alias("entry")))
    # Sorted by text, a repeat stands next to its first spelling: no search through what is known for each entry.
    first = let(F.sort_array(entries), lambda by_text: F.filter(
        by_text, lambda e, i: (i == 0) | (e["key"] != F.get(by_text, i - 1)["key"])))
    in_order = F.sort_array(F.transform(first, lambda e: F.struct(e["pos"].alias("pos"), e["entry"].alias("entry"))))
    return F.transform(in_order, lambda e: e["entry"])


def page_ctas(elements: Column) -> Column:
    """The first 25 call-to-action entries, as prompts and snapshots list them."""
    return F.slice(cta_entries(elements), 1, fv.MAX_CTAS)


def cta_text(entry: Column) -> Column:
    return strip(F.replace(F.substring_index(entry, " -> ", 1), F.lit(" [button]"), F.lit("")))


def _field_name(e: Column) -> Column:
    names = [F.when(F.length(e["attrs"][k]) > 0, e["attrs"][k]) for k in ("name", "id", "placeholder")]
    return F.coalesce(*names, e["tag"])


def _is_required(e: Column) -> Column:
    return F.map_contains_key(e["attrs"], "required")


def _visible_fields(elements: Column, form: Column) -> Column:
    return F.filter(elements, lambda e: (
        (e["ord"] > form["ord"]) & (e["ord"] <= form["last"]) & e["tag"].isin("input", "select", "textarea")
        & ~F.coalesce(e["attrs"]["type"].isin("hidden", "submit", "button"), F.lit(False))))


def form_fields(elements: Column, form: Column) -> Column:
    """Names of the visible fields inside ``form`` (nested forms included), ``*`` when required."""
    return F.transform(_visible_fields(elements, form), lambda e: F.concat(
        _field_name(e), F.when(_is_required(e), F.lit("*")).otherwise(F.lit(""))))


def form_field_entries(elements: Column) -> Column:
    """(form, name, required) of every visible field of every form; forms are numbered from 1."""
    return F.flatten(F.transform(_tagged(elements, "form"), lambda form, i: F.transform(
        _visible_fields(elements, form), lambda e: F.struct(
            (i + 1).alias("form"), _field_name(e).alias("name"), _is_required(e).alias("required")))))


def page_forms(elements: Column) -> Column:
    def summary(form, i):
        return let(form_fields(elements, form), lambda names: F.concat(
            F.lit("form "), (i + 1).cast("string"), F.lit(": "), F.size(names).cast("string"), F.lit(" fields ("),
            F.array_join(F.slice(names, 1, fv.MAX_FIELDS), ", "), F.lit(")")))
    return F.transform(F.slice(_tagged(elements, "form"), 1, fv.MAX_FORMS), summary)


def microdata_types(elements: Column) -> Column:
    marked = F.filter(elements, lambda e: F.map_contains_key(e["attrs"], "itemtype"))
    return F.transform(marked, lambda e: F.element_at(F.split(rstrip(e["attrs"]["itemtype"], "/"), "/"), -1))


def schema_types(ld_types: Column, elements: Column) -> Column:
    return F.sort_array(F.array_union(ld_types, microdata_types(elements)))


def has_faq_schema(types: Column) -> Column:
    return F.exists(types, lambda t: F.lower(t).isin("faqpage", "qapage"))


def word_count(text: Column) -> Column:
    """Words of white-space-collapsed text."""
    return F.when(F.length(text) > 0, F.size(F.split(text, " "))).otherwise(F.lit(0))


def excerpt(text: Column) -> Column:
    return F.left(text, F.lit(fv.EXCERPT_CHARS))


def thin_flag(words: Column) -> Column:
    return words < fv.VERY_LOW_WORDS


FEATURE_COLUMNS = [
    "title", "meta_description", "h1", "h2", "ctas", "forms", "schema_types", "has_faq_schema",
    "word_count", "prices", "text_excerpt", "links", "cta_entries", "form_fields",
]


def page_features(captures: DataFrame) -> DataFrame:
    """Captures (both modes) to one feature row each. Columns nobody asks for are pruned after the parse."""
    classified = capture_classify(captures)
    parsed = page_tokenize(classified)
    # a rendered page's trouble is told in one short line
    first_line = F.substring_index("parse_error", "\n", 1)
    failed_text = F.when(F.col("mode") == "standard", F.concat(F.lit("Parse error: "), F.col("parse_error"))).otherwise(
        F.left(first_line, F.locate(": ", first_line) + 1 + fv.ERROR_CHARS))
    nothing = F.array().cast(parsed.schema["elements"].dataType)
    pages = (parsed
             .withColumn("error", F.coalesce("error", failed_text))
             .withColumn("ok", F.col("error").isNull())
             .withColumn("elements", F.coalesce("elements", nothing))
             .withColumn("ld_types", F.coalesce("ld_types", F.array().cast("array<string>")))
             .withColumn("text", F.coalesce("text", F.lit(""))))
    e = F.col("elements")
    return (pages
            .withColumns({
                "title": page_title(e),
                "meta_description": page_meta_description(e),
                "h1": page_headings(e, "h1", fv.MAX_H1),
                "h2": page_headings(e, "h2", fv.MAX_H2),
                "ctas": page_ctas(e),
                "cta_entries": cta_entries(e),
                "forms": page_forms(e),
                "form_fields": form_field_entries(e),
                "schema_types": schema_types(F.col("ld_types"), e),
                "word_count": word_count(F.col("text")),
                "prices": price_mentions(F.col("text")),
                "text_excerpt": excerpt(F.col("text")),
                "links": page_links(e),
            })
            .withColumn("has_faq_schema", has_faq_schema(F.col("schema_types")))
            .drop("ld_types", "parse_error", "text", "elements"))
