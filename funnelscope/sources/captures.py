"""Fetch records: what came back for each URL, and the /llms.txt check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.text import strip

CAPTURE_COLUMNS = ["url", "mode", "status_code", "content_type", "final_url", "html", "error"]


def error_condense(message: Column, error_type: Column) -> Column:
    """``Type: root cause``, the cause cut out of a nested transport error."""
    cause = F.regexp_extract(message, fv.ROOT_CAUSE_PATTERN, 1)
    root = F.when(message.rlike(fv.ROOT_CAUSE_PATTERN), cause).otherwise(message)
    return F.concat(error_type, F.lit(": "), F.left(root, F.lit(fv.ERROR_CHARS)))


def capture_error(error: Column, status_code: Column, content_type: Column, mode: Column) -> Column:
    """Why a capture is unusable, or null. A missing content type counts as HTML; a rendered page has none to check."""
    return (F.when(error.isNotNull(), error)
             .when(status_code >= 400, F.concat(F.lit("HTTP "), status_code.cast("string")))
             .when((mode == "standard") & ~F.contains(F.coalesce(content_type, F.lit("html")), F.lit("html")),
                   F.concat(F.lit("Non-HTML content ("), content_type, F.lit(")"))))


def capture_classify(captures: DataFrame) -> DataFrame:
    """Adds ``ok`` and replaces ``error``; unusable captures lose their body, so it is never parsed."""
    error = capture_error(F.col("error"), F.col("status_code"), F.col("content_type"), F.col("mode"))
    out = captures.withColumn("error", error).withColumn("ok", F.col("error").isNull())
    if "html" in captures.columns:
        out = out.withColumn("html", F.when(F.col("ok"), F.coalesce("html", F.lit(""))))
    return out


def llms_txt_status(captures: DataFrame) -> DataFrame:
    """One line per ``/llms.txt`` capture. Here a missing content type is *not* HTML."""
    file_rows = captures.filter(F.col("url").endswith("/llms.txt"))
    url, code, body = F.col("url"), F.col("status_code"), F.col("html")
    not_html = ~F.contains(F.coalesce("content_type", F.lit("")), F.lit("html"))
    status = (
        F.when(F.col("error").isNotNull(), F.concat(
            url, F.lit(": LOCAL CHECK FAILED ("), F.col("error"),
            F.lit("). Use web_fetch on this URL to determine whether llms.txt is present.")))
        .when((code == 200) & not_html, F.concat(
            url, F.lit(": PRESENT (HTTP 200, "), F.length(body).cast("string"), F.lit(" chars). Preview:\n```\n"),
            F.left(strip(body), F.lit(fv.LLMS_PREVIEW_CHARS)), F.lit("\n```")))
        .when(code == 200, F.concat(
            url, F.lit(": returned HTTP 200 but as HTML (likely a soft-404 / catch-all page) - treat as ABSENT")))
        .otherwise(F.concat(url, F.lit(": ABSENT (HTTP "), code.cast("string"), F.lit(")"))))
    return file_rows.select(F.regexp_replace(url, "/llms\\.txt$", "").alias("site_url"), status.alias("llms_txt"))
