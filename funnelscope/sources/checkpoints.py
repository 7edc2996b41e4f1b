"""Completed layers and what they were made for, kept so an interrupted audit can go on where it stopped.

Three append-only tables: finished layers, headers (what the audit was asked for), and removals. A removal hides all that was written
for its audit up to then, so nothing is rewritten when a run ends cleanly.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from funnelscope import fixed_values as fv

LAYER_SCHEMA = "audit_id bigint, layer int, notes string"
HEADER_SCHEMA = ("audit_id bigint, url string, icp string, competitors array<string>, keywords array<string>, "
                 "sources map<string,string>, saved_at timestamp")
REMOVAL_SCHEMA = "audit_id bigint, removed_at timestamp"
LAYER_OF_COMPETITORS = 5
FILE_SCHEMA = ("url string, icp string, competitors array<string>, keywords array<string>, "
               "completed map<string,string>, sources map<string,string>, _broken string")


def checkpoint_write(layers: DataFrame, folder: str) -> None:
    """Appends finished layers (``audit_id, layer, notes, finished_at``)."""
    layers.select("audit_id", "layer", "notes", "finished_at").write.mode("append").partitionBy("layer").parquet(folder)


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a table; one that is not there is empty."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def checkpoint_read(spark: SparkSession, folder: str) -> DataFrame:
    """Latest notes of each finished layer; a table that is not there means a fresh start."""
    rows = _stored(spark, folder, LAYER_SCHEMA + ", finished_at timestamp")
    return rows.groupBy("audit_id", "layer").agg(F.max_by("notes", "finished_at").alias("notes"))


def headers_write(headers: DataFrame, folder: str) -> None:
    """Appends what audits were asked for and the sources found so far (columns of ``HEADER_SCHEMA``)."""
    headers.select("audit_id", "url", "icp", "competitors", "keywords", "sources", "saved_at").write.mode("append").parquet(folder)


def headers_read(spark: SparkSession, folder: str) -> DataFrame:
    """Latest header of each audit."""
    rows = _stored(spark, folder, HEADER_SCHEMA)
    kept = F.struct(*[c for c in rows.columns if c != "audit_id"])
    return rows.groupBy("audit_id").agg(F.max_by(kept, "saved_at").alias("header")).select("audit_id", "header.*")


def checkpoints_remove(finished: DataFrame, folder: str) -> None:
    """Appends removals (``audit_id, removed_at``) of audits that ended cleanly."""
    finished.select("audit_id", "removed_at").write.mode("append").parquet(folder)


def checkpoint_resume(spark: SparkSession, requests: DataFrame, layers: str, headers: str, removals: str) -> DataFrame:
    """What each request (``audit_id, url, icp, competitors``) can go on with: ``audit_id, state, keywords, sources, completed``.

    ``state``: ``none`` (nothing kept), ``other target`` (made for another url or icp: void), ``competitors changed`` (the layer about them
    was complete and has to be done again) or ``resumed``. ``completed`` is sorted by layer; empty where nothing can be used.
    """
    removed = _stored(spark, removals, REMOVAL_SCHEMA).groupBy("audit_id").agg(F.max("removed_at").alias("removed_at"))
    still = lambda at: F.col("removed_at").isNull() | (F.col(at) > F.col("removed_at"))
    asked = requests.select("audit_id", *[F.col(c).alias(f"asked_{c}") for c in ("url", "icp", "competitors")])
    kept = headers_read(spark, headers).join(removed, "audit_id", "left").where(still("saved_at")).drop("removed_at")
    done = _stored(spark, layers, LAYER_SCHEMA + ", finished_at timestamp").join(removed, "audit_id", "left").where(still("finished_at"))
    done = done.groupBy("audit_id", "layer").agg(F.max_by("notes", "finished_at").alias("notes"))
    # one entry per layer of the audit
    done = done.groupBy("audit_id").agg(F.sort_array(F.collect_list(F.struct("layer", "notes"))).alias("done"))
    rows = asked.join(kept, "audit_id", "left").join(done, "audit_id", "left")
    about = lambda x: x["layer"] == LAYER_OF_COMPETITORS
    done, same = F.coalesce("done", F.array()), F.col("url").eqNullSafe(F.col("asked_url")) & F.col("icp").eqNullSafe(F.col("asked_icp"))
    others = ~F.col("competitors").eqNullSafe(F.col("asked_competitors")) & F.exists(done, about)
    rows = rows.withColumn("state", F.when(F.col("saved_at").isNull(), "none").when(~same, "other target").when(others, "competitors changed").otherwise("resumed"))
    usable = F.col("state").isin("resumed", "competitors changed")
    return rows.select("audit_id", "state", F.when(usable, F.col("keywords")).alias("keywords"), F.when(usable, F.col("sources")).alias("sources"),
                       F.when(F.col("state") == "resumed", done).when(usable, F.filter(done, lambda x: ~about(x)))
                       .otherwise(F.filter(done, lambda x: F.lit(False))).alias("completed"))


def checkpoint_files_read(spark: SparkSession, folder: str) -> DataFrame:
    """Old JSON checkpoint files; unreadable ones are dropped, so their audits start afresh."""
    files = (spark.read.schema(FILE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", "_broken").json(folder))
    done = F.filter(F.transform(F.array(*[F.lit(t) for t in fv.LAYER_TITLES]), lambda t, i: F.struct(
        (i + 1).alias("layer"), F.col("completed")[t].alias("notes"))), lambda x: x["notes"].isNotNull())
    # the bad-record column is looked at after the rows are read, or Spark would prune the rest away
    return (files.withColumn("layers", F.when(F.col("_broken").isNull(), done))
            .filter(F.col("url").isNotNull() & F.col("layers").isNotNull())
            .select("url", "icp", "competitors", "keywords", "layers", "sources"))
