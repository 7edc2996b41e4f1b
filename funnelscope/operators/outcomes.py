"""Run bookkeeping: layer results, audit outcomes, resuming, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope import fixed_values as fv
from funnelscope.functions.text import let, strip
from funnelscope.functions.urls import company_name, csv_split, url_validate


def layer_titles() -> Column:
    return F.array(*[F.lit(t) for t in fv.LAYER_TITLES])


def layer_title(layer: Column) -> Column:
    return F.try_element_at(layer_titles(), layer.cast("int"))


def out_of_credits(message: Column) -> Column:
    return F.contains(F.lower(message), F.lit("credit balance"))


def layer_failure_classify(layer_runs: DataFrame) -> DataFrame:
    """Adds ``outcome`` (ok, abort, out_of_credits, failed) and, for failures, ``reason`` and ``failed_notes``."""
    kind, message = F.col("error_type"), F.coalesce("error_message", F.lit(""))
    outcome = (F.when(kind.isNull(), "ok")
                .when(kind == "AuthenticationError", "abort")
                .when((kind == "APIStatusError") & out_of_credits(message), "out_of_credits")
                .otherwise("failed"))
    reason = (F.when(kind == "APIStatusError", F.concat(
                  F.lit("API error "), F.coalesce(F.col("status_code").cast("string"), F.lit("None")), F.lit(": "), message))
               .when(kind == "APIConnectionError", F.concat(F.lit("Connection error: "), message))
               .otherwise(F.concat(kind, F.lit(": "), message)))
    staged = layer_runs.withColumn("outcome", outcome).withColumn(
        "reason", F.when(F.col("outcome") == "failed", reason))
    return staged.withColumn("failed_notes", F.when(F.col("reason").isNotNull(), F.concat(
        F.lit("**"), layer_title(F.col("layer")), F.lit(f" {fv.NOT_COMPLETED}.** Reason: "), F.col("reason"))))


def audit_outcome(classified: DataFrame) -> DataFrame:
    """Status, message, failed layers and exit code per audit.

    ``classified`` is ``layer_failure_classify`` over layers 1-5, and layer 6 for the final write-up.
    Whatever stops a run first (a rejected key, or no credit) decides; later layers did not run.
    """
    layer, outcome = F.col("layer"), F.col("outcome")
    stop = F.when(outcome.isin("abort", "out_of_credits") |
                  ((layer == 6) & (outcome == "failed") & out_of_credits(F.coalesce("error_message", F.lit("")))),
                  F.struct("layer", F.when(outcome == "abort", "abort").otherwise("out_of_credits").alias("how")))
    seen = lambda cond: F.array_sort(F.collect_set(F.when(cond & (layer <= 5), layer)))
    per_audit = classified.groupBy("audit_id").agg(
        F.min(stop).alias("stop"), seen(outcome == "ok").alias("done"), seen(outcome == "failed").alias("failed"),
        F.coalesce(F.bool_or((layer == 6) & (outcome == "failed")), F.lit(False)).alias("write_up_failed"))
    how = F.col("stop.how")
    before_stop = lambda c: F.filter(c, lambda n: F.coalesce(n < F.col("stop.layer"), F.lit(True)))
    done, failed = before_stop("done"), before_stop("failed")
    status = (F.when(how == "abort", "error").when(how == "out_of_credits", "out_of_credits")
               .when(F.col("write_up_failed") | (F.size(failed) > 0), "partial").otherwise("complete"))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(5)), done)
    listed = F.when(how == "out_of_credits", missing).when(how == "abort", F.array().cast("array<int>")).otherwise(failed)
    message = (F.when(how == "abort", "The API key was rejected.")
                .when(how == "out_of_credits", "The API account is out of credit; completed layers are saved.")
                .when(F.col("write_up_failed"), "The final synthesis step failed.")
                .when(F.size(failed) > 0, F.concat(F.size(failed).cast("string"), F.lit(" layer(s) could not be completed.")))
                .otherwise(""))
    code = F.when(F.col("status") == "complete", fv.EXIT_CODES["complete"]).when(
        F.col("status") == "out_of_credits", fv.EXIT_CODES["out_of_credits"]).otherwise(1)
    return (per_audit.select("audit_id", status.alias("status"), message.alias("message"),
                             F.transform(listed, layer_title).alias("failed_layers"))
            .withColumn("exit_code", code))


def incomplete_layers(layer_states: DataFrame) -> DataFrame:
    """``L1, L3`` style label of the layers that are not done, per audit (empty when all five are)."""
    done = F.collect_set(F.when(F.col("status") == "done", F.col("layer").cast("int")))
    return layer_states.groupBy("audit_id").agg(done.alias("done")).select(
        "audit_id", F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(1), F.lit(5)), "done"),
            lambda n: F.concat(F.lit("L"), n.cast("string"))), ", ").alias("incomplete"))


def resume_missing_layers(audits: DataFrame, checkpoints: DataFrame, completed: DataFrame) -> DataFrame:
    """Layers still to run per audit.

    A checkpoint with another URL or ICP is void; with other competitors its layer 5 does not count.
    ``completed`` holds (audit_id, layer); each audit has at most five rows there.
    """
    saved = checkpoints.select("audit_id", *[F.col(c).alias(f"saved_{c}") for c in ("url", "icp", "competitors")])
    finished = completed.groupBy("audit_id").agg(F.collect_set(F.col("layer").cast("int")).alias("finished"))
    joined = audits.join(saved, "audit_id", "left").join(finished, "audit_id", "left")
    valid = (F.col("saved_url") == F.col("url")) & (F.col("saved_icp") == F.col("icp"))
    same_rivals = F.coalesce(F.col("saved_competitors") == F.col("competitors"), F.lit(False))
    reused = F.when(F.coalesce(valid, F.lit(False)), F.when(same_rivals, F.col("finished")).otherwise(
        F.array_remove("finished", 5)))
    todo = F.array_except(F.sequence(F.lit(1), F.lit(5)), F.coalesce(reused, F.array().cast("array<int>")))
    return joined.select("audit_id", F.explode(todo).alias("layer")).withColumn("title", layer_title(F.col("layer")))


def recent_audits(runs: DataFrame, limit: int = fv.RECENT_AUDITS) -> DataFrame:
    """The latest runs by start time; the limit is the feature."""
    return runs.orderBy(F.col("started").desc(), "audit_id").limit(limit)


def request_validate(requests: DataFrame) -> DataFrame:
    """Adds ``errors`` (array of field/message), and for good requests the cleaned audit fields."""
    bad_rivals = F.filter(csv_split(F.col("competitors")), lambda c: url_validate(c).isNull())
    problem = lambda field, text: F.struct(F.lit(field).alias("field"), text.alias("message"))
    first_bad = let(bad_rivals, lambda b: F.try_element_at(b, F.lit(1)))
    errors = F.array_compact(F.array(
        F.when(url_validate(F.col("url")).isNull(), problem("url", F.lit("Enter a valid website, e.g. https://www.example.com"))),
        F.when(F.length(strip(F.col("icp"))) < 5,
               problem("icp", F.lit("Describe the ideal customer this audit should be read through"))),
        F.when(first_bad.isNotNull(), problem("competitors", F.concat(
            F.lit("'"), first_bad, F.lit("' doesn't look like a website"))))))
    good = F.size("errors") == 0
    return (requests.withColumn("errors", errors)
            .withColumn("clean_url", F.when(good, url_validate(F.col("url"))))
            .withColumn("company", F.when(good, company_name(F.col("clean_url"))))
            .withColumn("clean_competitors", F.when(good, F.transform(csv_split(F.col("competitors")), url_validate))))
