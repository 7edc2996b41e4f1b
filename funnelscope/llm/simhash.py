"""Document fingerprints by SimHash, in DataFrame functions only.

Terms are the words of a text (runs outside ``\\x20 \\x09-\\x0D``), each occurrence with a weight by its length: 1 up to three code points, 4
for four, 6 beyond, so that function words count little. The 64 bits of a term's hash vote for or against the bits of the
fingerprint. The votes of two bits share one long (bit ``k`` in the low half, bit ``k + 32`` in the high half), so a document is 33 sums,
taken by partial aggregation where its words are: only one row per document and task is shuffled, never a word. No half can
overflow: a text has less than 2^31 bytes and a term of weight 6 takes six of them with its separator.

Null and empty texts have the fingerprint 0. Equal texts have equal fingerprints. Fingerprints of all documents stay in tables.

``near_pairs`` finds all distinct fingerprints within a Hamming radius by permuted block tables: the bits are cut into
blocks, and of two fingerprints within radius ``r`` at least ``blocks - r`` blocks agree, so they meet in the table of
those blocks. Equal fingerprints are one class beforehand; a class is one row in the tables, whatever its size.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from funnelscope.llm.store import written

BITS = 64
PAIR = (1 << 32) + 1


def votes(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint`` (long) of every text; rows with equal keys must hold equal texts."""
    words = (texts.select(*keys, F.explode_outer(F.split(text_col, "[ \\t-\\r]+")).alias("term"))
             .select(*keys, F.xxhash64("term").alias("bits"), F.coalesce(F.char_length("term"), F.lit(0)).alias("length")))
    weight = (F.when(F.col("length") > 4, F.lit(6)).when(F.col("length") == 4, F.lit(4)).when(F.col("length") == 0, F.lit(0))
              .otherwise(F.lit(1)).cast("long"))
    sums = [F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(PAIR)) * weight).alias(f"votes_{k}") for k in range(32)]
    counted = words.groupBy(*keys).agg(F.sum(weight).alias("weight"), *sums)
    bits = []
    for k in range(BITS):
        half = F.shiftright(f"votes_{k - 32}", 32) if k >= 32 else F.col(f"votes_{k}").bitwiseAND(F.lit((1 << 32) - 1))
        bits.append(F.shiftleft((half * 2 > F.col("weight")).cast("long"), k))
    while len(bits) > 1:
        bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2])]
    return counted.select(*keys, bits[0].alias("fingerprint"))


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fingerprint): one row per distinct id and text."""
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return votes(texts.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def in_order(documents: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (doc_id, text) in ascending order (null ids first, equal ids by a hash of the text), each with its neighbours.

    Columns: ``id``, ``text_hash``, ``n_chars``, ``times`` (repeated rows), ``seq``, ``next_seq``, ``previous_seq``,
    ``previous_chars``; the order is a ring. Ids are sorted by range; a place is a partition and a position in it, and only the
    first and last rows of the partitions meet in one task.
    """
    ids = (documents.select(F.col(doc_id).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
           .select("id", F.xxhash64("text").alias("text_hash"), F.char_length("text").cast("long").alias("n_chars"))
           .groupBy("id", "text_hash").agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("times")))
    placed = written(ids.orderBy(F.asc_nulls_first("id"), "text_hash")
                     .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "order")
    ends = placed.groupBy("part").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.max_by("n_chars", "seq").alias("last_chars"))
    ring = Window.orderBy("part")
    around = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part", F.coalesce(F.lead("first").over(ring), F.first("first").over(around)).alias("after"),
        F.coalesce(F.lag("last").over(ring), F.last("last").over(around)).alias("before"),
        F.coalesce(F.lag("last_chars").over(ring), F.last("last_chars").over(around)).alias("before_chars"))
    line = Window.partitionBy("part").orderBy("seq")
    return (placed.join(ends, "part").select(
        "id", "text_hash", "n_chars", "times", "seq", F.coalesce(F.lead("seq").over(line), "after").alias("next_seq"),
        F.coalesce(F.lag("seq").over(line), "before").alias("previous_seq"),
        F.coalesce(F.lag("n_chars").over(line), "before_chars").alias("previous_chars")))


def edited_fingerprints(documents: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its text with the second half replaced by the next document's beginning, and likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (long), near_edited, near_next. The next document is the
    next distinct (id, text) of ``in_order``. Texts are shuffled once to their places, and their halves once to where they meet.
    """
    order = written(in_order(documents, doc_id, text_col), "neighbours")
    own = fingerprints(documents, doc_id, text_col)
    own = written(order.join(own, order["id"].eqNullSafe(own["doc_id"]) & (order["text_hash"] == own["text_hash"]))
                  .select("id", "seq", "next_seq", "n_chars", "times", "fingerprint"), "fingerprints")
    texts = (documents.select(F.col(doc_id).alias("own_id"), F.coalesce(text_col, F.lit("")).alias("text"))
             .withColumn("own_hash", F.xxhash64("text")))
    placed = texts.join(order, texts["own_id"].eqNullSafe(order["id"]) & (texts["own_hash"] == order["text_hash"]))
    half = lambda n: F.floor(n / 2).cast("int")
    parts = F.array(
        F.struct(F.col("seq").alias("seq"), F.lit(True).alias("head"),
                 F.substring("text", F.lit(1), (F.col("n_chars") - half(F.col("n_chars"))).cast("int")).alias("part")),
        F.struct(F.col("previous_seq").alias("seq"), F.lit(False).alias("head"),
                 F.substring("text", F.lit(1), half(F.col("previous_chars"))).alias("part")))
    # Rows repeated in the input bring equal parts; any of them will do.
    edited = (placed.select(F.inline(parts)).groupBy("seq")
              .agg(F.max(F.when(F.col("head"), F.col("part"))).alias("head"), F.max(F.when(~F.col("head"), F.col("part"))).alias("tail"))
              .select("seq", F.concat("head", "tail").alias("text")).withColumn("edited_sha256", F.sha2("text", 256)))
    edited = votes(edited, ["seq", "edited_sha256"]).withColumnRenamed("fingerprint", "edited_fingerprint")
    after = own.select(F.col("seq").alias("next_seq"), F.col("fingerprint").alias("next_fingerprint"))
    return (own.join(edited, "seq").join(after, "next_seq").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
            .select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")))


def block_tables(fingerprint: Column, radius: int, blocks: int) -> Column:
    """Array of (table, block bits): one entry per choice of ``blocks - radius`` blocks, which are the bits that must agree."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(edges[i], edges[i + 1])) for i in range(blocks)]
    signed = lambda mask: mask - (1 << BITS) if mask >> (BITS - 1) else mask
    return F.array(*[F.struct(F.lit(i).alias("table"), fingerprint.bitwiseAND(F.lit(signed(sum(chosen)))).alias("bits"))
                     for i, chosen in enumerate(combinations(masks, blocks - radius))])


def near_pairs(fingerprinted: DataFrame, radius: int = 3, blocks: int = 6, fingerprint_col: str = "fingerprint") -> DataFrame:
    """(left, right, distance): all pairs of distinct fingerprints, left < right, at most ``radius`` bits apart.

    Rows with equal fingerprints belong to one class; membership is the input's own fingerprint column. Nulls take no part.
    """
    distinct = fingerprinted.select(F.col(fingerprint_col).alias("fingerprint")).where("fingerprint is not null").distinct()
    entries = distinct.select("fingerprint", F.inline(block_tables(F.col("fingerprint"), radius, blocks)))
    left, right = entries.withColumnRenamed("fingerprint", "left"), entries.withColumnRenamed("fingerprint", "right")
    distance = F.bit_count(F.col("left").bitwiseXOR(F.col("right")))
    return (left.join(right, ["table", "bits"]).where((F.col("left") < F.col("right")) & (distance <= radius))
            .select("left", "right", distance.alias("distance")).distinct())
