"""Connected components of links: stars within tasks first, then alternating large-star and small-star steps over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from funnelscope.llm.store import written

TASK_LINKS = 20_000   # links that one task turns into stars; more links are more tasks


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id that the links reach from it) of every id that is not the smallest itself."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[:len(a)], at[len(a):], np.arange(len(ids))
    while (apart := root[x] != root[y]).any():
        left, right = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _stars_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids, least = smallest(table.column("a").to_numpy(), table.column("b").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["a", "b"])

    for batch in batches:
        held.append(batch.select(["a", "b"]))
        rows += batch.num_rows
        if rows >= 4 * TASK_LINKS:
            yield stars()
            held, rows = [], 0
    if rows:
        yield stars()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b), a > b. The smallest neighbour is a table of its own, so a hot node's links can be split."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = (joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(least.select("a", F.col("least").alias("b"))))
    return moved.where("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from every id that the links (a, b) join to a smaller one.

    Ids that are the smallest of their component, or in no link, have no row. Loops, repeats and directions of links do not matter.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    before, now = None, _state(links)
    tasks = -(-now[0] // TASK_LINKS)
    links = links.coalesce(max(1, tasks)).mapInArrow(_stars_within, "a long, b long")
    if tasks > 1:
        links = written(links.distinct(), "stars")
        now = _state(links)
        while now != before:
            links = written(_star(written(_star(links, True), "stars"), False), "stars")
            before, now = now, _state(links)
    return links.select(F.col("a").alias("id"), F.col("b").alias("component"))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after more ``links`` (a, b), as a table: only the components that these touch are gone through again."""
    if labels is None:
        return written(components(links), "labels")
    for end in ("a", "b"):
        label = labels.select(F.col("id").alias(end), F.col("component").alias("label"))
        links = links.join(label, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    moved = written(components(links), "moved")
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    after = labels.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return written(after.unionByName(moved), "labels")
