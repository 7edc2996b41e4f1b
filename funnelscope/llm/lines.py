"""Lines that stand in several documents, dropped from all but one of them, in DataFrame functions only.

A text is split at ``\\n``. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case; keys shorter than
``least_chars`` code points are never dropped. Keys are exploded with their positions, hashed to 128 bits, and the distinct documents of
each hash are counted in two levels (hash and document, then hash), so that a line of all documents is combined where it is
read and again where its documents meet. A key of ``least_documents`` documents or more stays in the smallest document id
that holds it (all its lines there) and goes everywhere else.

Only hashes and positions are shuffled for the counting. The positions that a document loses travel back to it as one sorted
array, and its text is put together from the stretches between them, in time linear in its lines.

Null and empty texts are one empty line. Rows without an id are one document together, smaller than all others. Rows that
repeat an id are one document as well: a line of theirs is held once, and each row is cut by itself. A text of any length is a row
of its own size. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from funnelscope.functions.arrays import rows_of
from funnelscope.llm.store import written

EDGES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line as it is compared. ``lower`` is the faster way to the same key where every character is ASCII."""
    bare = F.trim(line, F.lit(EDGES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def numbered_lines(texts: DataFrame, least_chars: int) -> DataFrame:
    """(doc, text_hash, at, one, two): position and 128-bit hash of every line that is long enough; ``texts``: (doc, text)."""
    lines = rows_of(texts.select("doc", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines")),
                    "lines", ["doc", "text_hash"], "at", "line")
    keys = lines.select("doc", "text_hash", "at", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= least_chars).select(
        "doc", "text_hash", "at", F.xxhash64("key").alias("one"), F.xxhash64(F.lit("second"), "key").alias("two"))


def shared_lines(lines: DataFrame, least_documents: int) -> DataFrame:
    """(one, two, documents, holder): hashes of at least so many documents, and the smallest of these (null: the rows without id)."""
    held = lines.groupBy("one", "two", "doc").agg(F.lit(1).alias("held"))
    nameless = F.max(F.col("doc").isNull().cast("int"))
    counted = held.groupBy("one", "two").agg(F.count("held").alias("documents"), F.min("doc").alias("least"), nameless.alias("nameless"))
    return counted.where(F.col("documents") >= least_documents).select(
        "one", "two", "documents", F.when(F.col("nameless") == 0, F.col("least")).alias("holder"))


def without_shared_lines(documents: DataFrame, least_documents: int = 2, least_chars: int = 10, doc_id: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines`` (before), ``n_dropped``, ``kept_text`` (what stays, joined by ``\\n``)."""
    texts = documents.select(F.col(doc_id).alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    lines = written(numbered_lines(texts, least_chars), "lines")
    shared = written(shared_lines(lines, least_documents), "lines-shared")
    lost = lines.join(shared, ["one", "two"]).where(~F.col("doc").eqNullSafe(F.col("holder")))
    # rows that repeat id and text bring every position again: a set of them, small as the text
    places = (lost.groupBy(F.col("doc").alias("lost_doc"), F.col("text_hash").alias("lost_hash"))
              .agg(F.sort_array(F.collect_set("at")).alias("lost")))
    split = texts.select("doc", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    joined = split.join(places, F.col("doc").eqNullSafe(F.col("lost_doc")) & (F.col("text_hash") == F.col("lost_hash")), "left")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("lost", i - 1) + 1)
    stretches = F.transform(F.concat("lost", F.array(F.size("lines"))), lambda end, i: F.slice("lines", start(i) + 1, end - start(i)))
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.flatten(stretches))
    return joined.select(F.col("doc").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
                         F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))
