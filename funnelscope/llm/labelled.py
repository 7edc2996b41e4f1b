"""Documents with their labels, for the operators that learn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A label row is a key and a flag: 16 bytes. So many are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def with_labels(documents: DataFrame, labels: DataFrame, label_col: str, learn: Column | None = None, most_rows: int | None = None,
                doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(labelled_id, text, label int) of the documents that have a label 0 or 1.

    ``learn`` says which label rows count; of rows repeated for one id the larger label does. With ``most_rows`` only
    that many ids are taken, those with the smallest hashes: a bounded sample that does not depend on the partitioning.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(doc_id).isNotNull())
    chosen = chosen if learn is None else chosen.where(learn)
    chosen = chosen.groupBy(F.col(doc_id).alias("labelled_id")).agg(F.max(label_col).cast("int").alias("label"))
    if most_rows is not None:
        chosen = chosen.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most_rows)
    small = most_rows is not None and most_rows <= BROADCAST_ROWS or chosen.count() <= BROADCAST_ROWS
    chosen = F.broadcast(chosen) if small else chosen
    return (documents.select(F.col(doc_id).alias("labelled_id"), F.col(text_col).alias("text"))
            .join(chosen, "labelled_id").select("labelled_id", "text", "label"))
