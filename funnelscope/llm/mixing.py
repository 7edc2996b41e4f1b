"""Mixing sources to target weights by Poisson replication.

A source with weight ``w`` gets the mean repetition rate ``w * total size wanted / its size``. Each document draws its number of
copies by inverting the Poisson distribution of its source's rate at a uniform number that is a hash of the seed and the
document's id: no state, the same on every run and machine. Documents are exploded by their counts and put in a global
order by a hash of seed, id and copy.

Without given weights a source weighs its size to the power ``flatten`` (below 1, small sources gain). A null source is a
source of its own, with the empty name. Sizes are code points of the texts; a source of empty texts only has rate 0. A weight for a
source without rows is spread over the others in proportion. Null ids draw as the empty id; repeated rows draw alike.
Null and empty texts stay as they are. Extra columns pass through whatever their names.

The distribution of a rate is an array per source (about ``rate + 12 sqrt(rate) + 20`` numbers), joined to the documents by
source; Spark broadcasts the sources where they are few, else a hot source is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope.llm.store import written

RATE, COPY, ORDER = "_mix_distribution", "_mix_copy", "_mix_order"


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1): the first 52 bits of the MD5 of seed and parts."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities from 0 on, far enough that what is missing is below any 52-bit step."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    # In logarithms, so that a large rate does not underflow.
    log_term = lambda k, log_factorial: F.exp(k * F.log(rate) - rate - log_factorial)
    start = F.struct(F.lit(0.0).alias("log_factorial"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(acc, k):
        log_factorial = acc["log_factorial"] + F.log(k.cast("double"))
        total = acc["sum"] + log_term(k, log_factorial)
        return F.struct(log_factorial.alias("log_factorial"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])).otherwise(F.array(F.lit(1.0)))


def rates(documents: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, flatten: float = 0.7,
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(mix_source, size, rate): one row per source. ``total`` is the wanted size in code points (default: that of the input)."""
    size = (documents.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"))
            .agg(F.sum(F.coalesce(F.char_length(text_col), F.lit(0))).cast("double").alias("size")))
    if weights is None:
        weight = F.pow("size", F.lit(flatten))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("mix_source") == name, F.lit(float(value))).otherwise(weight)
    weighed = written(size.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0))), "mix-sources")
    sums = weighed.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes")).first()
    wanted = float(sums["sizes"] or 0) if total is None else float(total)
    scale = wanted / sums["weights"] if sums["weights"] else 0.0
    rate = F.when(F.col("size") > 0, F.col("weight") * F.lit(scale) / F.col("size")).otherwise(F.lit(0.0))
    return weighed.select("mix_source", "size", rate.alias("rate"))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, flatten: float = 0.7, seed: int = 17,
        doc_id: str = "doc_id", source_col: str = "source", text_col: str = "text", numbered: bool = False) -> DataFrame:
    """Every document as often as drawn, in a global random order. ``numbered`` adds ``copy`` (from 1) and ``mix_position``."""
    kept = documents.columns
    per_source = (rates(documents, weights, total, flatten, source_col, text_col)
                  .select(F.col("mix_source").alias("_mix_source"), distribution(F.col("rate")).alias(RATE)))
    drawn = (documents.withColumn("_mix_source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
             .join(per_source, "_mix_source").withColumn("_mix_u", uniform(seed, F.col(doc_id))))
    copies = F.size(F.filter(RATE, lambda p: p <= F.col("_mix_u")))
    exploded = (drawn.withColumn("_mix_copies", copies).where("_mix_copies > 0")
                .withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))))
    ordered = exploded.withColumn(ORDER, uniform(seed + 1, F.col(doc_id), F.col(COPY))).orderBy(ORDER, doc_id, COPY)
    extra = [F.col(COPY).alias("copy"), F.col(ORDER).alias("mix_position")] if numbered else []
    return ordered.select(*[F.col(c) for c in kept], *extra)
