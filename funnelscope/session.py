"""Session helpers: the shared work folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_scratch: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a scratch folder of its own; a cluster must name a shared one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if context.applicationId not in _scratch:
            _scratch[context.applicationId] = tempfile.mkdtemp(prefix="funnelscope-")
        folder = _scratch[context.applicationId]
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared work folder and read it back.

    Used after the page tokenizer, so that joins which need its output twice do not parse twice.
    The table is columnar, so later reads stay pruned, and it outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, few_files: int = 16) -> DataFrame:
    """A table of a handful of files over all cores; larger tables are left as they are scanned.

    Parsing and text matching are worth more tasks than a small file gives. The exchange is only ever
    paid on ``few_files`` files; a table of many files already has more splits than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) <= min(few_files, cores) else df
