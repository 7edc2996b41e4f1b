"""Saved reports: one markdown document per audit, addressed by company and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from funnelscope.functions.urls import report_filename


def report_files_write(reports: DataFrame, folder: str) -> None:
    """Reports (``audit_id, company, date, markdown``) as one text file each, below
    ``date=<date>/file_name=<company>-growth-audit-<date>.md``.

    Only addresses present in ``reports`` are replaced. Of two reports with the same address the one
    with the later ``audit_id`` is kept, as a rewritten file would be. Each file ends in one newline.
    """
    latest = reports.groupBy("company", "date").agg(F.max_by("markdown", "audit_id").alias("markdown"))
    named = latest.select("date", report_filename(F.col("company"), F.col("date")).alias("file_name"),
                          F.regexp_replace("markdown", "(?d)\n\\z", "").alias("value"))
    (named.repartition("date", "file_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("date", "file_name").text(folder))


def report_files_read(spark: SparkSession, folder: str) -> DataFrame:
    """Every saved report below ``folder`` as one row, ``path`` and ``markdown``: loose ``*.md`` files
    as well as what ``report_files_write`` leaves."""
    files = (spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown")))
    return files.filter(F.col("path").rlike(r"\.md(?:/[^/]*)?$"))
