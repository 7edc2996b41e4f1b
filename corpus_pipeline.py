"""A corpus pipeline over the operators of ``funnelscope.llm``: quality, near duplicates, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared folder and reads it
again as the next one's ``docs``. Rows without an id pass the first two stages as documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from funnelscope.llm import bpe, mixing, near_dup, pii, quality
from funnelscope.llm.store import written

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
LEAST_QUALITY = 0.3
SALTS = 32


def beside(docs: DataFrame) -> DataFrame:
    """The input row as one column ``row``, so that no name of a stage meets one of the input; ``id`` and ``text`` beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), "text")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the factorisation machine does not reject; it learns from the labelled documents among ``docs``."""
    machine = quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_texts(beside(docs), machine, out="score").where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Texts that share an id are documents of their own.

    Repeated rows stay once, and a blank text goes where its id still has a real one. A group of any size meets its first document in
    ``SALTS`` parts.
    """
    keyed = beside(docs).withColumn("key", F.when(F.col("id").isNotNull(), F.xxhash64("id", "text")))
    judged = near_dup.near_duplicates(keyed.select("key", "text"), doc_id="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    judged = written(judged.where("key is not null").join(keyed.select("key", "id").distinct(), "key"), "judged")
    first = judged.groupBy("component_id").agg(F.min(F.struct("id", "key"))["key"].alias("first"), F.count("*").alias("members"))
    first = first.where("members > 1").select("component_id", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = judged.select("key", "component_id", F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
    gone = salted.join(first, ["component_id", "salt"]).where("key <> first").select("key").distinct()
    # the text is in the row; a second copy would be shuffled with it
    told = keyed.withColumn("blank", ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).drop("text")
    rest = told.join(written(gone, "near-copies"), "key", "left_anti")
    maps = "map<" in keyed.schema["row"].dataType.simpleString()   # maps have no order, their JSON has
    smallest = F.min_by("row", F.to_json("row")) if maps else F.min("row")
    known = (rest.where("id is not null").groupBy("id", "blank", F.when(~F.col("blank"), F.col("key")).alias("key")).agg(smallest.alias("row")))
    known = written(known, "single")
    both = known.groupBy("id").agg(F.min("blank").alias("least"), F.max("blank").alias("blank")).where("blank and not least")
    known = known.join(both.select("id", "blank"), ["id", "blank"], "left_anti").select("row.*")
    return known.unionByName(rest.where("id is null").select("row.*"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; the length follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the rate of its source draws it, in global random order."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text as little-endian unsigned 32-bit integers, with their number and a digest of what they decode to.

    The ids are written in between: in one plan a task would hold a Python worker for each of the two, and the idle ones stay for
    the stages that follow.
    """
    path = public_tokenizers.path(RANK_FILE)
    encoded = bpe.encode_texts(docs, path, public_tokenizers.PATTERN).select("doc_id", "lang", "source", "token_ids")
    decoded = bpe.decode_ids(written(encoded, "token-ids"), path)
    return decoded.select("doc_id", "lang", "source", "token_ids", bpe.n_ids(F.col("token_ids")).alias("n_tokens"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("personal_data", mask_personal_data), ("mixing", mix_sources), ("encode", encode)]
# The scores, spans and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")


QUERIES = {"pipeline": run}
ORACLE = {}
