"""Finding each site's pricing, compare, contact and signup pages among its captures.

Candidates are built inside the home page's own row (no explode over all links, no cross join with
the page types). Only then do at most six URLs per (site, type) meet the capture table, in one
equi-join on the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.arrays import rows_of
from funnelscope.functions.match import haystack_has, link_haystack
from funnelscope.functions.text import let
from funnelscope.functions.urls import bare_domain, same_site
from funnelscope.operators.render import missing_page_defaults


def link_table(pages: DataFrame) -> DataFrame:
    """One row per link: ``url, ord, text, href``."""
    return rows_of(pages, "links", ["url"], "ord", "link").select("url", "ord", "link.*")


def link_candidates(links: Column, base: Column, words: list[str]) -> Column:
    """Same-site links naming a page type, fragment cut off.

    A link is a repeat only when its *whole* address equals an address kept before, so ``/p#a`` and
    ``/p#b`` give ``/p`` twice while a second plain ``/p`` is dropped.
    """
    fitting = F.filter(links, lambda link: same_site(link["href"], base)
                       & haystack_has(link_haystack(link["text"], link["href"]), words))

    def add(kept, link):
        return F.when(F.array_contains(kept, link["href"]), kept).otherwise(
            F.array_append(kept, F.substring_index(link["href"], "#", 1)))
    return F.aggregate(fitting, F.array().cast("array<string>"), add)


def path_candidates(found: Column, base: Column, paths: list[str]) -> Column:
    """The usual addresses of a page type that the links did not already give."""
    return F.filter(F.array(*[F.concat(base, F.lit(p)) for p in paths]), lambda u: ~F.array_contains(found, u))


def candidates(links: Column, base: Column, words: list[str], paths: list[str]) -> Column:
    return let(link_candidates(links, base, words), lambda found: F.concat(
        F.transform(found, lambda u: F.struct(F.lit("link").alias("source"), u.alias("url"))),
        F.transform(path_candidates(found, base, paths), lambda u: F.struct(F.lit("path").alias("source"), u.alias("url")))))


def page_candidates(homes: DataFrame, limit: int | None = fv.MAX_CANDIDATES,
                    page_types: list | None = None) -> DataFrame:
    """``site_url, page_type, type_ord, rank, source, url`` from homes(``site_url, links``); rank starts at 1."""
    per_type = F.array(*[
        F.struct(F.lit(key).alias("page_type"), F.lit(i).alias("type_ord"),
                 candidates(F.col("links"), F.col("site_url"), words, paths).alias("found"))
        for i, (key, _, words, paths) in enumerate(page_types or fv.PAGE_TYPES, 1)])
    found = F.col("t.found") if limit is None else F.slice(F.col("t.found"), 1, limit)
    return (homes
            .select("site_url", F.explode(per_type).alias("t"))
            .select("site_url", "t.page_type", "t.type_ord", F.posexplode(found).alias("pos", "c"))
            .select("site_url", "page_type", "type_ord", (F.col("pos") + 1).alias("rank"), "c.source", "c.url"))


def home_pages(sites: DataFrame, resolved: DataFrame) -> DataFrame:
    """Sites with the links of their home page; a site never captured has none."""
    return (sites.select("site_url").distinct()
            .join(resolved.select(F.col("url").alias("site_url"), "links"), "site_url", "left")
            .withColumn("links", F.coalesce("links", F.array().cast("array<struct<text:string,href:string>>"))))


def page_discover(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """First candidate per (site, type) that was fetched well, else the reason none was.

    ``found`` is ``page_candidates``. Groups hold at most six rows. Returns ``site_url, page_type,
    type_ord, ok, page_url, error``; ``page_url`` of a missing page is its first candidate.
    """
    outcome = found.join(resolved.select("url", "ok", "error"), "url", "left").select(
        "site_url", "page_type", "type_ord", "rank", "url",
        F.coalesce("ok", F.lit(False)).alias("ok"),
        F.when(F.coalesce("ok", F.lit(False)), F.lit(None)).otherwise(F.coalesce("error", F.lit("not captured"))).alias("error"))
    tried = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("rank", "url"))))
    best = F.min(F.when(F.col("ok"), F.struct("rank", "url")))
    grouped = outcome.groupBy("site_url", "page_type", "type_ord").agg(
        best.alias("best"), F.min(F.struct("rank", "url")).alias("first"),
        F.max(F.struct("rank", "error")).alias("last"), tried.alias("tried"))
    reason = F.concat(F.lit("No reachable page found. Tried: "),
                      F.array_join(F.transform("tried", lambda t: t["url"]), ", "),
                      F.lit(" (last error: "), F.col("last.error"), F.lit(")"))
    return grouped.select(
        "site_url", "page_type", "type_ord", F.col("best").isNotNull().alias("ok"),
        F.coalesce("best.url", "first.url").alias("page_url"),
        F.when(F.col("best").isNull(), reason).alias("error"))


def page_missing(discovered: DataFrame) -> DataFrame:
    return discovered.filter(~F.col("ok")).select("site_url", "page_type", F.col("page_url").alias("requested_url"), "error")


def _type_label(page_type: Column) -> Column:
    label = F.lit(None).cast("string")
    for key, text, _, _ in fv.PAGE_TYPES:
        label = F.when(page_type == key, F.lit(text)).otherwise(label)
    return F.when(page_type == "home", F.lit("Homepage")).otherwise(label)


def wanted_pages(audits: DataFrame) -> DataFrame:
    """The pages an audit looks at: home and four types of the target, home and pricing of each rival."""
    types = ["home"] + [key for key, *_ in fv.PAGE_TYPES]
    kinds = lambda keys: F.array(*[F.struct(F.lit(types.index(k)).alias("type_ord"), F.lit(k).alias("page_type")) for k in keys])
    sites = F.concat(
        F.array(F.struct(F.lit("target").alias("role"), F.lit(0).alias("site_ord"), F.col("url").alias("site_url"),
                         kinds(types).alias("kinds"))),
        F.transform("competitors", lambda c, i: F.struct(
            F.lit("competitor").alias("role"), (i + 1).alias("site_ord"), c.alias("site_url"),
            kinds(["home", "pricing"]).alias("kinds"))))
    rival = F.col("role") == "competitor"
    label = F.when(~rival, _type_label(F.col("page_type"))).otherwise(
        F.concat(bare_domain(F.col("site_url")), F.lit(" "),
                 F.when(F.col("page_type") == "home", F.lit("homepage")).otherwise(F.lit("pricing page"))))
    return (audits.select("audit_id", F.explode(sites).alias("s"))
            .select("audit_id", "s.role", "s.site_ord", "s.site_url", F.explode("s.kinds").alias("k"))
            .select("audit_id", "role", "site_ord", "site_url", "k.type_ord", "k.page_type")
            .withColumn("label", label))


def site_pages(audits: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every wanted page of every audit with its snapshot: the table the later operators read.

    ``resolved`` is read three times (home links, candidate outcomes, snapshots); pass a written
    table (``session.materialize``) so pages are parsed once.
    """
    wanted = wanted_pages(audits)
    found = page_candidates(home_pages(wanted, resolved))
    discovered = page_discover(found, resolved).select(
        "site_url", "page_type", "page_url", F.col("error").alias("missing_error"))
    addressed = (wanted.join(discovered, ["site_url", "page_type"], "left")
                 .withColumn("page_url", F.when(F.col("page_type") == "home", F.col("site_url")).otherwise(F.col("page_url"))))
    # The uncut entries serve measures of pages; an audit's snapshot has the cut ones.
    snapshots = resolved.withColumnRenamed("url", "page_url").drop("cta_entries", "form_fields")
    joined = (addressed.join(snapshots, "page_url", "left")
              .withColumn("ok", F.coalesce("ok", F.lit(False)) & F.col("missing_error").isNull())
              .withColumn("error", F.when(~F.col("ok"), F.coalesce("missing_error", "error", F.lit("not captured")))))
    return missing_page_defaults(joined).drop("missing_error").withColumnRenamed("page_url", "requested_url")


def site_page_matrix(pages: DataFrame) -> DataFrame:
    """One row per (audit, site) and one status column per page type."""
    types = ["home"] + [key for key, *_ in fv.PAGE_TYPES]
    state = F.when(F.col("ok"), F.col("requested_url")).otherwise(F.lit("missing"))
    return pages.groupBy("audit_id", "role", "site_url").pivot("page_type", types).agg(F.first(state))


def layer_pages(pages: DataFrame) -> DataFrame:
    """Which pages feed which of the five layers, in reading order (``page_ord``)."""
    target = F.col("role") == "target"
    layers = F.array_compact(F.array(
        F.when(target, 1),
        F.when(target & (F.col("page_type") == "home"), 2),
        F.when(target, 3),
        F.when(target & (F.col("page_type") == "signup"), 4),
        F.when(~target | F.col("page_type").isin("home", "pricing"), 5)))
    return (pages.withColumn("page_ord", F.col("site_ord") * 10 + F.col("type_ord"))
            .withColumn("layer", F.explode(layers)))
