"""Text predicates: calls to action, prices, page types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.urls import url_path


def cta_match(text: Column) -> Column:
    return text.rlike(fv.CTA_PATTERN)


def price_mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fv.PRICE_PATTERN), F.lit(0))


def link_haystack(text: Column, href: Column) -> Column:
    return F.concat(F.lower(text), F.lit(" "), F.lower(url_path(href)))


def haystack_has(haystack: Column, words: list[str]) -> Column:
    """Any word is a substring; one pass over the text (the words hold no pattern characters)."""
    return haystack.rlike("|".join(words))


def page_type_match(text: Column, href: Column) -> Column:
    """Keys of every page type one of whose words is in the link's text or path."""
    haystack = link_haystack(text, href)
    keys = [F.when(haystack_has(haystack, words), F.lit(key)) for key, _, words, _ in fv.PAGE_TYPES]
    return F.array_compact(F.array(*keys))


def fetch_gate(ok: Column, word_count: Column, status_code: Column,
               min_words: int = fv.THIN_PAGE_WORDS, statuses: list[int] | None = None) -> Column:
    """``thin`` or ``blocked`` when a page deserves a browser render, else null."""
    return (F.when(ok & (word_count < min_words), F.lit("thin"))
             .when(~ok & F.coalesce(status_code.isin(statuses or fv.BLOCKED_STATUSES), F.lit(False)),
                   F.lit("blocked")))
