"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of vectors (``most_fitted``, those with the smallest hashed ids): a node's vectors are split by
spherical k-means into ``branches`` children until a leaf would hold fewer than ``leaf_sample`` of them. Every row is indexed: it
belongs to the leaf that greedy descent reaches. A query visits leaves in the order a priority queue yields them: the node whose
centre is nearest to the query is opened next, whatever its level.

How many leaves a query visits is calibrated on the data: for ``calibration`` queries the exact neighbours are found by
brute force over all rows (in blocks, with bounded queries), and leaves are visited until the wanted share of these lie in visited leaves.
A query goes on from there until the visited leaves hold ``k`` rows besides itself.

Rows take part if the vector is not null or zero, holds no null or non-finite component and has the dimension most rows have.
A leaf's rows are dealt over chunks of bounded size, and its queries as well, so a hot leaf (many equal vectors) is many tasks.
Scores are double precision on the original vectors. Ties go to the smaller id. A null id takes no part. Repeated ids are rows of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from funnelscope.llm.store import written

MOST_FITTED = 8_192
BRANCHES = 8
LEAF_SAMPLE = 64
CALIBRATION = 200
CHUNK_ROWS = 4_096
CHUNK_QUERIES = 512
WANTED_RECALL = 0.96


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each: exact, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Tree:
    """Nodes in one array: ``centres``; ``children[i]`` lists the nodes below node ``i`` (none: a leaf)."""

    def __init__(self, centres: np.ndarray, children: list[list[int]]):
        self.centres, self.children = centres, children
        self.leaf_of = np.cumsum([not c for c in children]) - 1
        self.leaves = int(sum(not c for c in children))

    @classmethod
    def fitted(cls, sample: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, seed: int = 5) -> Tree:
        random, sample = np.random.default_rng(seed), unit(sample)
        centres, children, waiting = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [[]], [(0, np.arange(len(sample)))]
        while waiting:
            node, rows = waiting.pop()
            if len(rows) < 2 * leaf_sample:
                continue
            mine = sample[rows]
            means = mine[random.choice(len(rows), min(branches, len(rows)), replace=False)]
            for _ in range(12):
                nearest = (mine @ means.T).argmax(1)
                sums = np.zeros_like(means)
                np.add.at(sums, nearest, mine)
                means = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), means)
            nearest = (mine @ means.T).argmax(1)
            if len(np.unique(nearest)) < 2:
                continue  # equal vectors do not split
            for i in np.unique(nearest):
                children[node].append(len(centres))
                waiting.append((len(centres), rows[nearest == i]))
                centres.append(means[i])
                children.append([])
        return cls(np.array(centres), children)

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out, waiting = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
            elif len(rows):
                nearest = (vectors[rows] @ self.centres[self.children[node]].T).argmax(1)
                waiting += [(child, rows[nearest == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and further ones until they hold ``least`` rows, by the counts ``held``."""
        near = -(self.centres @ query)
        queue, out, rows = [(0.0, 0)], [], 0
        while queue and (len(out) < most or rows < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (near[child], child))
            else:
                out.append(int(self.leaf_of[node]))
                rows += int(held[out[-1]]) if held is not None else 0
        return out


def best_pairs(queries: np.ndarray, query_ids: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` best other rows: (query index, row index, cosine), ties to the smaller id."""
    if not len(queries) or not len(vectors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, b = scaled(queries), scaled(vectors)
    a_norm, b_norm = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    rough = (a / a_norm[:, None]) @ (b / b_norm[:, None]).T
    rough[query_rows[:, None] == rows[None, :]] = -2
    # A matrix product may round equal vectors apart: whatever is near the k-th best is scored again, pair by pair.
    least = np.partition(rough, max(0, rough.shape[1] - k), 1)[:, max(0, rough.shape[1] - k)]
    q, r = np.nonzero((rough >= least[:, None] - 1e-12) & (rough > -2))
    score = np.concatenate([np.einsum("ij,ij->i", a[q[i:i + CHUNK_ROWS]], b[r[i:i + CHUNK_ROWS]]) for i in range(0, max(1, len(q)), CHUNK_ROWS)])
    score /= a_norm[q] * b_norm[r]
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], r[keep], score[keep]


FOUND = "query_row long, query_id long, vec_id long, leaf int, score double"


class Index:
    """Rows ``(row, vec_id, vector, leaf, chunk)`` in a table, their tree, and the calibrated number of visits."""

    def __init__(self, rows: DataFrame, tree: Tree, visits: int, k: int):
        self.rows, self.tree, self.visits, self.k = rows, tree, visits, k


def brute_force(queries: pd.DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of bounded queries (row, vec_id, vector): the best ``k`` of every batch of rows, then of all."""
    shared = rows.sparkSession.sparkContext.broadcast(
        (np.array(queries["row"], np.int64), np.array(queries["vec_id"], np.int64), np.array(queries["vector"].tolist(), np.float64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, vectors = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(start, CHUNK_ROWS)
                row, vec_id = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id"))
                q, r, score = best_pairs(vectors, ids, own, rows_of(part.column("vector")), vec_id, row, k)
                leaf = part.column("leaf").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[q]), pa.array(vec_id[r]), pa.array(leaf[r], pa.int32()),
                                                  pa.array(score)], ["query_row", "query_id", "vec_id", "leaf", "score"])

    found = rows.select("row", "vec_id", "vector", "leaf").mapInArrow(search, FOUND)
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, wanted: float = WANTED_RECALL,
          most_fitted: int = MOST_FITTED, calibration: int = CALIBRATION) -> Index | None:
    """Fit, assign, calibrate; None where no row takes part."""
    spark = vectors.sparkSession
    clean = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
             .where(F.col("vec_id").isNotNull() & usable(F.col("vector"))))
    common = clean.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return None
    clean = written(clean.where(F.size("vector") == common["size"]).withColumn("row", F.monotonically_increasing_id()), "vectors")
    mixed = clean.orderBy(F.xxhash64("vec_id", "row"), "row")
    sample = mixed.limit(most_fitted).select("vector").toArrow().column("vector").combine_chunks()
    tree = Tree.fitted(rows_of(sample))
    shared = spark.sparkContext.broadcast((tree.centres, tree.children))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Tree(*shared.value)
        for batch in batches:
            leaf = task.assign(unit(rows_of(batch.column("vector"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])

    assigned = clean.select("row", "vec_id", "vector").mapInArrow(assign, "row long, vec_id long, vector array<double>, leaf int")
    rows = written(assigned, "leaves")
    queries = rows.orderBy(F.xxhash64("row", F.lit(1)), "row").limit(calibration).select("row", "vec_id", "vector").toPandas()
    truth = brute_force(queries, rows, k).select("query_row", "leaf").toPandas()
    needed = []
    for row, vector in zip(queries["row"], queries["vector"]):
        place = {leaf: i + 1 for i, leaf in enumerate(tree.visits(unit(np.array([vector]))[0], tree.leaves))}
        needed += [place[leaf] for leaf in truth["leaf"][truth["query_row"] == row]]
    visits = int(np.quantile(needed, wanted, method="higher")) if needed else tree.leaves
    return Index(rows, tree, visits, k)


SEARCHED = "query_row long, query_id long, vec_id long, leaf int, score double"


def search(index: Index, is_query: Column) -> DataFrame:
    """(query_id, rank, vec_id, score) of every indexed row for which ``is_query`` (of ``vec_id``) holds."""
    spark, k, visits = index.rows.sparkSession, index.k, index.visits
    held = np.zeros(index.tree.leaves, np.int64)
    for leaf, count in index.rows.groupBy("leaf").count().collect():
        held[leaf] = count
    shared = spark.sparkContext.broadcast((index.tree.centres, index.tree.children))

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                leaves = [tree.visits(v, visits, held, k + 1) for v in unit(rows_of(part.column("vector")))]
                of = np.repeat(np.arange(part.num_rows), [len(x) for x in leaves])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(of)) for c in ("row", "vec_id", "vector")),
                     pa.array([leaf for some in leaves for leaf in some], pa.int32())], ["row", "vec_id", "vector", "leaf"])

    queries = (index.rows.where(is_query).select("row", "vec_id", "vector")
               .mapInArrow(to_leaves, "row long, vec_id long, vector array<double>, leaf int"))
    # Leaf sizes decide into how many chunks rows and queries are dealt: bounded groups, whatever is hot.
    sizes = written(index.rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("row_chunks")), "leaf-sizes")
    asked = (index.rows.where(is_query).count() * visits) // max(1, index.tree.leaves)
    query_chunks = max(1, -(-asked // CHUNK_QUERIES))
    chunk = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), n).cast("int")
    dealt_rows = (index.rows.join(sizes, "leaf").withColumn("row_chunk", chunk(2, F.col("row_chunks")))
                  .withColumn("query_chunk", F.explode(F.sequence(F.lit(0), F.lit(query_chunks - 1)))))
    dealt_queries = (queries.join(sizes, "leaf").withColumn("query_chunk", chunk(3, F.lit(query_chunks)))
                     .withColumn("row_chunk", F.explode(F.sequence(F.lit(0), F.col("row_chunks") - 1))))
    keys = ["leaf", "row_chunk", "query_chunk"]

    def compare(key: tuple[pa.Scalar, ...], asked: pa.Table, held: pa.Table) -> pa.Table:
        number = lambda table, name: table.column(name).to_numpy()
        own, ids = number(asked, "row"), number(asked, "vec_id")
        row, vec_id = number(held, "row"), number(held, "vec_id")
        q, r, score = best_pairs(rows_of(asked.column("vector").combine_chunks()), ids, own,
                                 rows_of(held.column("vector").combine_chunks()), vec_id, row, k)
        return pa.table({"query_row": own[q], "query_id": ids[q], "vec_id": vec_id[r],
                         "leaf": pa.array(np.full(len(q), key[0].as_py()), pa.int32()), "score": score})

    columns = [*keys, "row", "vec_id", "vector"]
    found = (dealt_queries.select(*columns).groupBy(*keys).cogroup(dealt_rows.select(*columns).groupBy(*keys)).applyInArrow(compare, SEARCHED))
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
