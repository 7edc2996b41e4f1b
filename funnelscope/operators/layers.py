"""Measurable counterparts of the five layers' questions, as table operators.

These definitions are this library's own; the audits they serve leave such judgements to a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.match import page_type_match
from funnelscope.functions.urls import bare_domain, url_path
from funnelscope.operators.features import cta_text
from funnelscope.operators.timeline import running_sum

# Form-field words by category, checked in this order.
FIELD_CATEGORIES = {
    "bank": ["bank", "account", "routing", "iban"],
    "tax_id": ["ssn", "ein", "tax", "vat"],
    "contact": ["email", "mail", "phone", "tel", "address"],
    "identity": ["name", "company", "business", "birth"],
}


def primary_competing_ctas(pages: DataFrame) -> DataFrame:
    """First call to action of each page, the ones competing with it, and their share."""
    texts = F.transform("cta_entries", cta_text)
    return (pages.withColumn("texts", texts).select(
        "url", F.try_element_at("texts", F.lit(1)).alias("primary_cta"),
        F.slice("texts", 2, 2**31 - 1).alias("competing_ctas"),
        F.greatest(F.size("texts") - 1, F.lit(0)).alias("n_competing"),
        F.when(F.size("texts") > 0, (F.size("texts") - 1) / F.size("texts")).otherwise(0.0).alias("dilution")))


def friction_signals(pages: DataFrame) -> DataFrame:
    """Visible and required form fields of all forms, and flags for no price, no call to action, a thin page."""
    visible = F.size("form_fields")
    flags = {"no_price": F.size("prices") == 0, "no_cta": F.size("ctas") == 0,
             "very_low_text": F.col("word_count") < fv.VERY_LOW_WORDS}
    required = F.size(F.filter("form_fields", lambda f: f["required"]))
    return pages.select(
        "url", visible.alias("visible_fields"), required.alias("required_fields"),
        *[c.alias(n) for n, c in flags.items()],
        sum((c.cast("int") for c in flags.values()), F.lit(0)).alias("n_flags"))


def landing_assets(links: DataFrame) -> DataFrame:
    """Links that look built for paid traffic, counted per linked domain; always INFERRED."""
    path = F.lower(url_path(F.col("href")))
    kind = (F.when(path.rlike("/(?:lp|go)/"), "campaign").when(path.rlike(r"(?:^|[/_-])vs(?:[/_-]|$)"), "versus")
             .when(F.contains(path, F.lit("switch")), "switch"))
    found = links.select(bare_domain(F.col("href")).alias("domain"), kind.alias("kind"), "href").filter(F.col("kind").isNotNull())
    return (found.groupBy("domain", "kind").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("href").alias("assets"))
            .withColumn("evidence", F.lit("INFERRED")))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != ""))


def message_match(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Word overlap (Jaccard) of a search result's title and its landing page's title and headline."""
    landing = pages.filter("ok").select("url", word_set(F.concat_ws(" ", "title", F.array_join("h1", " "))).alias("page_words"))
    joined = results.withColumn("ad_words", word_set(F.col("title"))).join(landing, "url")
    union = F.size(F.array_union("ad_words", "page_words"))
    return joined.select("keyword", "position", "url", F.when(
        union > 0, F.size(F.array_intersect("ad_words", "page_words")) / union).otherwise(0.0).alias("match"))


def organic_rank(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (keyword, target domain): best organic position, its URL, and how many domains rank above it.

    Positions are first reduced to one row per (keyword, domain), which combines before the shuffle.
    ``targets`` holds the audited ``domain`` values.
    """
    best = (results.withColumn("domain", bare_domain(F.col("url"))).groupBy("keyword", "domain")
            .agg(F.min(F.struct("position", "url")).alias("best")).select("keyword", "domain", "best.*"))
    ranked = running_sum(best, ["keyword"], "position", ["domain"], F.lit(1), "n", width=1000,
                         whole_key={"top": (F.min(F.struct("position", "domain")), F.min)})
    return (ranked.join(targets.select("domain").distinct(), "domain", "left_semi")
            .select("keyword", "domain", "position", "url", (F.col("n") - 1).alias("domains_above"),
                    F.col("top.domain").alias("leader")))


def answer_mention_share(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Per company: share of answers that name it, and share of its audits' sources on its own domain.

    ``answers``: audit_id, company, domain, answer. ``sources``: audit_id, url.
    """
    named = F.contains(F.lower("answer"), F.lower("company"))
    per_audit = sources.withColumn("source_domain", bare_domain(F.col("url")))
    owners = answers.select("audit_id", "domain").distinct()
    owned = (per_audit.join(owners, "audit_id").groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("source_domain").endswith(F.col("domain"))).alias("n_owned")))
    mentions = answers.groupBy("company", "domain").agg(
        F.count(F.lit(1)).alias("n_answers"), F.count_if(named).alias("n_naming"))
    return mentions.join(owned, "domain", "left").select(
        "company", "domain", "n_answers", "n_naming", (F.col("n_naming") / F.col("n_answers")).alias("mention_share"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.when(F.col("n_sources") > 0, F.col("n_owned") / F.col("n_sources")).otherwise(0.0).alias("owned_share"))


def field_category(field: Column) -> Column:
    """Category of a form field by the words in its name."""
    plain = F.lower(field)
    out = F.lit(None).cast("string")
    for name, words in reversed(FIELD_CATEGORIES.items()):
        out = F.when(plain.rlike("|".join(words)), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def upfront_information(pages: DataFrame) -> DataFrame:
    """Fields a page with forms asks for, by category, with how many of each are required, and whether its path is a sign-up page's.

    Fields are counted inside the page's row: no explode and no shuffle.
    """
    def count(category: str | None, required: bool) -> Column:
        def keep(kind):
            fits = F.lit(True) if category is None else kind["category"] == category
            return fits & kind["required"] if required else fits
        return F.size(F.filter("kinds", keep)).cast("long")

    cats = [*FIELD_CATEGORIES, "other"]
    kinds = F.transform("form_fields", lambda f: F.struct(field_category(f["name"]).alias("category"), f["required"].alias("required")))
    return (pages.where(F.size("form_fields") > 0).select("url", kinds.alias("kinds")).select(
        "url", *[count(c, False).alias(c) for c in cats], *[count(c, True).alias(f"required_{c}") for c in cats],
        count(None, True).alias("required"),
        F.array_contains(page_type_match(F.lit(""), F.col("url")), "signup").alias("is_signup")))


def _site_facts(pages: DataFrame) -> DataFrame:
    """One row per site of an audit: published price, calculator page, first CTA, FAQ markup."""
    calculator = F.exists("links", lambda link: F.contains(F.lower(url_path(link["href"])), F.lit("calculator")))
    home = F.col("page_type") == "home"
    return pages.groupBy("audit_id", "role", "site_url").agg(
        F.bool_or(F.col("ok") & (F.size("prices") > 0)).alias("has_price"),
        F.bool_or(F.col("ok") & calculator).alias("has_calculator"),
        F.max(F.when(home, cta_text(F.try_element_at("ctas", F.lit(1))))).alias("primary_cta"),
        F.bool_or("has_faq_schema").alias("has_faq"))


def competitive_matrix(pages: DataFrame) -> DataFrame:
    """Each competitor next to its audit's target: published price, calculator page, first CTA, FAQ markup.

    One grouping by (audit, site) of the site pages; the target's row then meets its competitors'
    through a join on the audit, which holds one target row each.
    """
    per_site = _site_facts(pages)
    facts = ["has_price", "has_calculator", "primary_cta", "has_faq"]
    target = per_site.filter(F.col("role") == "target").select("audit_id", *[F.col(c).alias(f"target_{c}") for c in facts])
    return (per_site.filter(F.col("role") == "competitor").select("audit_id", F.col("site_url").alias("competitor"), *facts)
            .join(target, "audit_id"))


def competitive_means(pages: DataFrame) -> DataFrame:
    """Shares of sites with a price, a calculator and FAQ markup, per audit and role, per audit, and over all audits.

    ``level`` tells the three apart: 0, 1 (``role`` is null) and 3 (both are null). Sums are combined before the shuffle, so the total is
    no task of its own. A site without a known answer counts as one without.
    """
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0)).alias(f"{c[4:]}_share")
    return _site_facts(pages).rollup("audit_id", "role").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("sites"), share("has_price"), share("has_calculator"), share("has_faq"))
