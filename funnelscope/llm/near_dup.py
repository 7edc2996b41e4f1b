"""Near duplicates by an LSH forest over MinHash signatures.

A document's set are its distinct shingles of ``k`` words (lower-cased A-Z); with fewer words, the whole sequence is the
only one. Documents with equal sets are one representative (the smallest id). Each representative gets ``TREES`` sorted
keys of ``DEPTH`` minima. In the global order of a tree, a document's candidates are the neighbours before and after it
with the longest common prefix that are not linked to it yet, if at least ``LEAST_PREFIX`` minima agree: in a
dense region such neighbours agree far deeper, in a sparse one the prefix may be short. Candidates whose set sizes allow the similarity
are confirmed on the full sets, computed from the whole texts. Links give components, and the orders are read again: a
document then meets the next one of *another* component, so whatever lies between two texts in a dense region is stepped
over. This goes on until no order offers an untried candidate that links; every row gives at most two candidates per order and round.

Where three rows or more of several components are left under one prefix, neighbours may hide each other. All rows of such dense regions
are joined exactly: over the rarest shingles of each (prefix filter with positions, PPJoin), hot shingles dealt over salted keys. So every
pair that shares a prefix in some order is either linked, or was tried, or is ruled out by the filter.

Orders are range-partitioned by (tree, key, hashed id), so equal keys spread as well; the rows at the partitions' ends are matched
in a pass of their own. A pair of similarity 0.85 agrees on a prefix of three in a tree with probability 0.61: all twelve miss it once in 90,000.

Null, empty or white-space texts have an empty set and are linked with nothing. Null ids are linked with nothing and kept.
Rows that share an id are one node. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from funnelscope.llm import hashing
from funnelscope.llm.components import merged
from funnelscope.llm.store import written

TREES, DEPTH, LEAST_PREFIX = 12, 6, 3
# Trees read in the first rounds; then all, until nothing new links.
FIRST_ROUNDS = ((0, 1), (2, 3, 4, 5))
EDGE_ROWS = 4
SKETCH_BITS = 20      # counters that order the shingles of dense regions; any order gives the same pairs
CHUNK_ENTRIES = 512   # indexed rows of one shingle under one salt
SLICE_BYTES = 1 << 19   # text whose shingles a task holds at once
SEEDS = np.random.default_rng(20240).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
SETS = "id long, n_shingles long, set_a long, set_b long, minima binary"
FOUND = "a long, b long, tree int, key binary, tie long, id long, n long, component long"


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): the sorted distinct shingle hashes of text ``i`` are ``hashes[first[i]:first[i + 1]]``."""
    words = hashing.Words(hashing.Texts(column, lower=True))
    count, hashes, n = words.counts(), words.hashes(), len(column)
    of = np.repeat(np.arange(n), count)
    all_grams = hashing.grams(hashes, k)
    inside = of[:len(all_grams)] == of[k - 1:] if len(all_grams) else np.zeros(0, bool)
    doc, values = [of[:len(all_grams)][inside]], [all_grams[inside]]
    for size in range(1, k):
        few = np.flatnonzero(count == size)
        whole = np.full(len(few), size, np.uint64)
        for i in range(size):
            whole = hashing.mixed(whole * hashing.BASE + hashes[words.first[few] + i])
        doc.append(few)
        values.append(whole)
    doc, values = np.concatenate(doc), np.concatenate(values)
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[new], values[new]
    return np.searchsorted(doc, np.arange(n + 1)), values


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _sets(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch, "text", SLICE_BYTES):
                first, values = shingles(part.column("text"), k)
                some = np.flatnonzero(np.diff(first))
                begin = first[some]
                sums = [np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)]
                minima = np.zeros((part.num_rows, TREES * DEPTH), ">u4")
                if len(some):
                    sums[0][some] = np.add.reduceat(hashing.mixed(values), begin)
                    sums[1][some] = np.add.reduceat(hashing.mixed(values ^ hashing.BASE), begin)
                    for i, seed in enumerate(SEEDS):
                        minima[some, i] = np.minimum.reduceat((values * seed) >> np.uint64(32), begin)
                packed = minima.tobytes()
                width = 4 * TREES * DEPTH
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(first)), signed(sums[0]), signed(sums[1]),
                     pa.array([packed[i * width:(i + 1) * width] for i in range(part.num_rows)], pa.binary())],
                    ["id", "n_shingles", "set_a", "set_b", "minima"])
    return of


def _neighbours(edges: bool, similar: tuple[int, int]):
    """Over rows in the order of (tree, key, tie): each row with the next and the previous one of another component."""
    names = ["tree", "key", "tie", "id", "n", "component"]

    def pairs(table: pa.Table, fresh: int) -> tuple[np.ndarray, np.ndarray]:
        tree, ids, n, component = (table.column(c).to_numpy() for c in ("tree", "id", "n", "component"))
        key = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint32).reshape(-1, DEPTH)
        size = len(ids)
        starts = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1]]))
        run = np.searchsorted(starts, np.arange(size), "right") - 1
        after = np.concatenate([starts[1:], [size]])[run]
        before = starts[run] - 1
        i = np.concatenate([np.arange(size), np.arange(size)])
        j = np.concatenate([after, before])
        keep = (j >= 0) & (j < size) & (np.maximum(i, j) >= fresh)
        i, j = i[keep], j[keep]
        keep = (tree[i] == tree[j]) & (key[i, :LEAST_PREFIX] == key[j, :LEAST_PREFIX]).all(1) & (ids[i] != ids[j])
        keep &= similar[1] * np.minimum(n[i], n[j]) >= similar[0] * np.maximum(n[i], n[j])
        i, j = ids[i[keep]], ids[j[keep]]
        return np.minimum(i, j), np.maximum(i, j)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("tie", pa.int64()),
                            ("id", pa.int64()), ("n", pa.int64()), ("component", pa.int64())])
        kept, tail = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch.select(names)])
            if edges and tail is None:
                yield from ends(fresh.slice(0, EDGE_ROWS), schema)
            tail = fresh if tail is None else pa.concat_tables([tail, fresh])
            tail = tail.slice(max(0, tail.num_rows - EDGE_ROWS))
            table = fresh if kept is None else pa.concat_tables([kept, fresh])
            a, b = pairs(table.combine_chunks(), table.num_rows - fresh.num_rows)
            empty = {c: pa.nulls(len(a), schema.field(c).type) for c in schema.names[2:]}
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *empty.values()], schema=schema)
            # The last run, and the row before it, meet what comes next.
            component = table.column("component").to_numpy()
            other = np.flatnonzero(component != component[-1])
            kept = table.slice(other[-1] if len(other) else 0)
        if edges and tail is not None:
            yield from ends(tail, schema)

    def ends(rows: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        yield from rows.add_column(0, "b", pa.nulls(rows.num_rows, pa.int64())).add_column(
            0, "a", pa.nulls(rows.num_rows, pa.int64())).cast(schema).to_batches()

    return of


def _candidates(rows: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Distinct (a, b), a < b, of neighbours in the trees' orders."""
    order = ["tree", "key", "tie"]
    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(True, similar), FOUND), "neighbours")
    ends = found.where("a is null").select(*order, "id", "n", "component").repartition("tree").sortWithinPartitions(*order)
    over = ends.mapInArrow(_neighbours(False, similar), FOUND)
    return found.where("a is not null").select("a", "b").unionByName(over.select("a", "b")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                first, values = shingles(pa.concat_arrays([batch.column("text_a").slice(i, 1), batch.column("text_b").slice(i, 1)]), k)
                both = len(values) - len(np.unique(values))
                keep[i] = similar[1] * both >= similar[0] * (len(values) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(of, "a long, b long").distinct()


def _dense(rows: DataFrame) -> DataFrame:
    """(id) of the rows (tree, key, id, component) under a prefix that three rows or more of several components share."""
    rows = rows.withColumn("prefix", F.substring("key", 1, 4 * LEAST_PREFIX))
    shared = (rows.groupBy("tree", "prefix").agg(F.count("*").alias("members"), F.min("component").alias("least"), F.max("component").alias("most"))
              .where("members > 2 and least <> most").select("tree", "prefix"))
    return rows.join(shared, ["tree", "prefix"], "left_semi").select("id").distinct()


def _counters(texts: DataFrame, k: int) -> np.ndarray:
    """How many sets hold a shingle of each hash bucket, by the top bits."""
    shift = np.uint64(64 - SKETCH_BITS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in hashing.slices(batch, "text", SLICE_BYTES):
                count += np.bincount((shingles(part.column("text"), k)[1] >> shift).astype(np.int64), minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["bucket", "n"])

    found = written(texts.select("text").mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "counters").toArrow()
    count = np.zeros(1 << SKETCH_BITS, np.uint32)
    count[found.column("bucket").to_numpy()] = np.minimum(found.column("n").to_numpy(), 0xFFFFFFFF)
    return count


ENTRIES = "token long, id long, component long, n long, place long, indexed boolean"


def _entries(texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """The rarest shingles of each text (id, text, component): as many as a similar, not smaller set must meet (``indexed``), or a not larger one."""
    counters = texts.sparkSession.sparkContext.broadcast(_counters(texts, k))
    p, q = similar

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            for part in hashing.slices(batch, "text", SLICE_BYTES):
                first, values = shingles(part.column("text"), k)
                size = np.diff(first)
                doc = np.repeat(np.arange(part.num_rows), size)
                order = np.lexsort((values, counters.value[(values >> shift).astype(np.int64)], doc))
                place, n = np.arange(len(values)) - first[doc], size[doc]
                keep = place <= n + (-p * n // q)
                indexed = place <= n + (-2 * p * n // (p + q))
                doc, take = doc[keep], pa.array(doc[keep])
                yield pa.RecordBatch.from_arrays(
                    [signed(values[order][keep]), part.column("id").take(take), part.column("component").take(take), pa.array(n[keep]),
                     pa.array(place[keep]), pa.array(indexed[keep])], ["token", "id", "component", "n", "place", "indexed"])

    return written(texts.select("id", "text", "component").mapInArrow(of, ENTRIES), "entries")


def _dense_pairs(texts: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """Distinct (a, b), a < b, of different components: every pair of ``texts`` that is similar enough is among them."""
    entries = _entries(texts, k, similar)
    hot = written(entries.where("indexed").groupBy("token").count().where(F.col("count") > CHUNK_ENTRIES)
                  .select("token", F.ceil(F.col("count") / CHUNK_ENTRIES).cast("int").alias("salts")), "hot-shingles")
    salted = entries.join(hot, "token", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    small = salted.where("indexed").select("token", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.col("id").alias("x"),
                                           F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("place").alias("px"))
    large = salted.select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("y"),
                          F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("place").alias("py"))
    p, q = similar
    fits = (f"cx <> cy and (nx < ny or nx = ny and x < y) and {q} * nx >= {p} * ny "
            f"and {p + q} * least(nx - px, ny - py) >= {p} * (nx + ny)")
    met = large.join(small, ["token", "salt"]).where(fits)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(documents: DataFrame, k: int = 5, similar: tuple[int, int] = (80, 100), doc_id: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id of its near duplicates), ``kept``.

    ``similar`` is the least Jaccard similarity as a fraction of whole numbers, compared exactly.
    """
    texts = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = written(texts.mapInArrow(_sets(k), SETS), "sets")
    linkable = sets.where("id is not null and n_shingles > 0")
    same = written(linkable.groupBy("set_a", "set_b").agg(F.min("id").alias("representative"), F.count("*").alias("members")), "same-sets")
    copies = (linkable.join(same.where("members > 1"), ["set_a", "set_b"]).where("id <> representative")
              .select(F.col("id").alias("a"), F.col("representative").alias("b")))
    firsts = linkable.join(same.select("set_a", "set_b", F.col("representative").alias("id")), ["set_a", "set_b", "id"], "left_semi")
    tree = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        t.alias("tree"), F.substring("minima", t * 4 * DEPTH + 1, F.lit(4 * DEPTH)).alias("key"))))
    trees = (firsts.select("id", F.col("n_shingles").alias("n"), tree.alias("t"))
             .select("t.tree", "t.key", F.xxhash64("t.tree", "id").alias("tie"), "id", "n"))
    trees = written(trees, "trees")
    # A row that shares its prefix with no other row in any tree is never a candidate; texts of the others are needed.
    by_prefix = trees.withColumn("prefix", F.substring("key", 1, 4 * LEAST_PREFIX))
    together = by_prefix.groupBy("tree", "prefix").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most")
    wanted = written(by_prefix.join(together, ["tree", "prefix"], "left_semi").select("id").distinct(), "wanted")
    whole = written(texts.join(wanted, "id", "left_semi").where("text is not null"), "texts")
    trees = written(trees.join(wanted, "id", "left_semi"), "trees")
    tried, labels = None, None
    rounds = iter(FIRST_ROUNDS)
    while True:
        chosen = next(rounds, None)
        rows = trees if chosen is None else trees.where(F.col("tree").isin(*chosen))
        if labels is None:
            rows = rows.withColumn("component", F.col("id"))
        else:
            rows = rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        pairs = _candidates(rows, similar)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "candidates")
        new = written(_confirmed(pairs, whole, k, similar), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not new.isEmpty():
            labels = merged(labels, new)
        elif chosen is None:
            break
    dense = written(_dense(rows), "dense")
    if not dense.isEmpty():
        regions = whole.join(dense, "id", "left_semi")
        if labels is None:
            regions = regions.withColumn("component", F.col("id"))
        else:
            regions = regions.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        pairs = written(_dense_pairs(written(regions, "regions"), k, similar).join(tried, ["a", "b"], "left_anti"), "candidates")
        new = written(_confirmed(pairs, whole, k, similar), "links")
        if not new.isEmpty():
            labels = merged(labels, new)
    found = merged(labels, copies)
    component = F.coalesce("component", "id")
    return (sets.join(found, "id", "left")
            .select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))
