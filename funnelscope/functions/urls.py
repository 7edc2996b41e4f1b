"""URL and name column functions. Hosts keep their port; ``www.`` is dropped once."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.text import let, rstrip, strip, title_case

NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def url_normalize(raw: Column) -> Column:
    """``scheme://host`` in lower case, ``https`` when no scheme is given; path and query are dropped."""
    clean = F.regexp_replace(strip(raw), "[\t\r\n]", "")
    full = F.when(clean.rlike("(?i)^https?://"), clean).otherwise(F.concat(F.lit("https://"), clean))
    return rstrip(F.lower(F.regexp_extract(full, r"(?i)^(https?://[^/?#]*)", 1)), "/")


def bare_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, NETLOC, 1)), r"^www\.", "")


def url_path(url: Column) -> Column:
    """Path without query, fragment and the ``;params`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, PATH, 1), ";[^/]*$", "")


def company_name(url: Column) -> Column:
    def pick(labels):
        n = F.size(labels)
        short_second = (n > 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
        return F.when(short_second, F.try_element_at(labels, F.lit(-3))).otherwise(F.element_at(labels, 1))
    name = F.regexp_replace(let(F.split(bare_domain(url), r"\."), pick), "[^a-z0-9-]", "")
    return F.when(name == "", F.lit("company")).otherwise(name)


def same_site(url: Column, base: Column, strict: bool = False) -> Column:
    """Host ends with the base's host. ``strict`` also wants a dot or nothing in front of it."""
    host, site = bare_domain(url), bare_domain(base)
    if not strict:
        return host.endswith(site)
    return (host == site) | host.endswith(F.concat(F.lit("."), site))


def url_validate(raw: Column) -> Column:
    """The normalised URL, or null when blank or when the host is not a plain domain name."""
    url = url_normalize(raw)
    return F.when((strip(raw) != "") & bare_domain(url).rlike(fv.VALID_HOST_PATTERN), url)


def csv_split(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def report_filename(company: Column, date: Column) -> Column:
    return F.concat(company, F.lit("-growth-audit-"), date, F.lit(".md"))


def report_title(company: Column) -> Column:
    return F.concat(title_case(company), F.lit(" Growth Audit"))
