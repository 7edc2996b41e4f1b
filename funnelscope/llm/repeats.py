"""Repeated passages by difference-cover anchors, and texts without them.

A word is ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``window`` successive words of one document; every word of a window whose
word sequence also starts anywhere else (the same document included) is removed. Windows are judged on the input.

Only at word positions whose remainder by ``PERIOD`` is in ``COVER`` an anchor of ``window - PERIOD + 1`` words is hashed. Every
difference modulo the period is a difference of two remainders of the cover, so two equal windows at any positions share an
aligned anchor inside. Anchors that occur again are extended to the windows around them, and these are compared by 96 bits
of hash and the bucket.

Both comparisons travel packed (``occurring_again``): a task hands out packets of whole documents. Within a packet equal hashes are found
on the spot and sent once, so a passage that a third of all documents share arrives once a packet; the others go as four bytes (anchors, whose
chance hits the windows undo) or twelve (windows) to buckets whose number grows with the text. What comes back is one bit a
place. A document's marks are so small that Spark joins them to the texts without a shuffle of texts while they
fit its own limit for broadcasts, and by a shuffle beyond it.

Null, empty and white-space texts have no words. Repeated rows repeat each other. Null ids are documents as any. Other
columns of the input are not read. A document travels by two hashes of id and text. A text is held whole in one task.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from funnelscope.llm import hashing
from funnelscope.llm.store import written

PERIOD, COVER = 13, (0, 1, 3, 9)   # 0, 1, 3, 9 have every difference modulo 13
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PACKET_BYTES = 16 << 20            # text in one packet; a longer text is a packet of its own
BUCKET_BYTES = 32 << 20            # text whose hashes share a bucket
HEADER = -1
CELLS = "packet long, bucket long, hashes binary, places binary, documents binary"
ARROW_CELLS = pa.schema([("packet", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary()),
                         ("documents", pa.binary())])
DOCUMENT = np.dtype([("one", "<i8"), ("two", "<i8"), ("places", "<i8")])
ANCHOR, WINDOW = ("<u4",), ("<u8", "<u4")   # types of the hashes that travel


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as differences, byte planes apart: most planes are zeros, which shuffles compress away."""
    return np.diff(places, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def _neighbours(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row whether an equal one exists, and whether it is the first of its equals."""
    n = len(columns[0])
    order = np.lexsort(columns)
    same = np.ones(max(0, n - 1), bool)
    for column in columns:
        ordered = column[order]
        same &= ordered[1:] == ordered[:-1]
    again, first = np.zeros(n, bool), np.ones(n, bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    first[order[1:]] = ~same
    return again, first


def _packet(documents: np.ndarray, places: np.ndarray, buckets: np.ndarray, hashes: list[np.ndarray]) -> pa.RecordBatch:
    """The header of a packet (its documents, the places that repeat inside it) and its cells, one a bucket."""
    number = uuid.uuid4().int >> 65
    again, first = _neighbours([*hashes, buckets])
    chosen = np.flatnonzero(first)
    chosen = chosen[np.argsort(buckets[chosen], kind="stable")]
    present, starts = np.unique(buckets[chosen], return_index=True)
    rows = [{"packet": number, "bucket": HEADER, "hashes": None, "places": _steps(places[again]), "documents": documents.tobytes()}]
    for bucket, part in zip(present.tolist(), np.split(chosen, starts[1:])):
        rows.append({"packet": number, "bucket": bucket, "hashes": b"".join(h[part].tobytes() for h in hashes),
                     "places": _steps(places[part]), "documents": None})
    return pa.RecordBatch.from_pylist(rows, ARROW_CELLS)


def _packets(parts: Iterator[tuple], packet_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts (bytes of text, documents, places, buckets, hashes) gathered into packets."""
    held, size, offset = [], 0, 0
    for n_bytes, documents, places, buckets, hashes in parts:
        if held and size + n_bytes > packet_bytes:
            yield _packet(*_joined(held))
            held, size, offset = [], 0, 0
        if len(places):
            held.append((documents, places + offset, buckets, hashes))
            size += n_bytes
            offset += int(documents["places"].sum())
    if held:
        yield _packet(*_joined(held))


def _joined(held: list[tuple]) -> tuple:
    documents, places, buckets, hashes = zip(*held)
    return np.concatenate(documents), np.concatenate(places), np.concatenate(buckets), [np.concatenate(h) for h in zip(*hashes)]


def _documents(one: pa.Array, two: pa.Array, places: np.ndarray) -> np.ndarray:
    out = np.empty(len(places), DOCUMENT)
    out["one"], out["two"], out["places"] = one.to_numpy(), two.to_numpy(), places
    return out


def _anchors(window: int, buckets: int, packet_bytes: int):
    """Cells of the anchors of every document with a window; places count its covered positions."""
    size = window - PERIOD + 1
    covered = np.isin(np.arange(PERIOD), COVER)

    def parts(batches):
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                texts = hashing.Texts(part.column("text"))
                words = hashing.Words(texts)
                counts, hashes = words.counts(), hashing.grams(words.hashes(), size)
                doc = np.repeat(np.arange(part.num_rows), counts)
                at = np.arange(len(hashes)) - words.first[doc[:len(hashes)]]
                inside = (doc[:len(hashes)] == doc[size - 1:]) if len(hashes) else np.zeros(0, bool)
                pick = np.flatnonzero(inside & covered[at % PERIOD] & (counts[doc[:len(hashes)]] >= window))
                found, chosen = hashes[pick], np.bincount(doc[pick], minlength=part.num_rows)
                has = np.flatnonzero(chosen)
                rows = pa.array(has)
                yield (len(texts.data), _documents(part.column("one").take(rows), part.column("two").take(rows), chosen[has]),
                       np.arange(len(pick)), ((found >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), [found.astype("<u4")])

    return lambda batches: _packets(parts(batches), packet_bytes)


def _windows(window: int, buckets: int, packet_bytes: int):
    """Cells of the windows around the marked anchors; places count the document's windows."""
    reach = np.arange(PERIOD)

    def parts(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                texts = hashing.Texts(row.column("text"))
                hashes = hashing.Words(texts).hashes()
                last = len(hashes) - window
                position = np.arange(last + PERIOD)
                anchors = position[np.isin(position % PERIOD, COVER)]
                anchors = anchors[np.unpackbits(np.frombuffer(row.column("marks")[0].as_py(), np.uint8), count=len(anchors)).view(bool)]
                around = (anchors[:, None] - reach).ravel()
                wanted = np.zeros(last + 1, bool)
                wanted[around[(around >= 0) & (around <= last)]] = True
                starts = np.flatnonzero(wanted)
                one, two = hashing.grams(hashes, window)[starts], hashing.grams(hashing.mixed(hashes ^ hashing.BASE), window)[starts]
                yield (len(texts.data), _documents(row.column("one"), row.column("two"), np.array([last + 1])), starts,
                       ((two >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), [one, two.astype("<u4")])

    return lambda batches: _packets(parts(batches), packet_bytes)


def _again(types: tuple[str, ...]) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket's cells the places whose hashes another packet has too."""
    width = sum(np.dtype(t).itemsize for t in types)

    def of(cells: pa.Table) -> pa.Table:
        raw = [h.as_py() for h in cells.column("hashes")]
        ends = np.cumsum([len(h) // width for h in raw])
        # A row's hashes lie type after type.
        before = np.cumsum([0] + [np.dtype(t).itemsize for t in types])
        columns = [np.concatenate([np.frombuffer(h, t, len(h) // width, skip * (len(h) // width)) for h in raw])
                   for t, skip in zip(types, before)]
        again, _ = _neighbours(columns)
        places = [_steps(_places(p.as_py())[flags]) for p, flags in zip(cells.column("places"), np.split(again, ends[:-1]))]
        out = pa.table({"packet": cells.column("packet"), "places": pa.array(places, pa.binary()),
                        "documents": pa.nulls(len(raw), pa.binary())})
        return out.filter(pa.array([len(p) > 0 for p in places]))
    return of


def _marks(rows: pa.Table) -> pa.Table:
    """A packet's places that occur again, here or elsewhere, as one row of bits per document."""
    header = next(d for d in rows.column("documents") if d.is_valid)
    documents = np.frombuffer(header.as_py(), DOCUMENT)
    ends = np.cumsum(documents["places"])
    bits = np.zeros(int(ends[-1]), bool)
    for steps in rows.column("places"):
        bits[_places(steps.as_py())] = True
    split = np.split(bits, ends[:-1])
    kept = [i for i, part in enumerate(split) if part.any()]
    return pa.table({"one": pa.array(documents["one"][kept]), "two": pa.array(documents["two"][kept]),
                     "marks": pa.array([np.packbits(split[i]).tobytes() for i in kept], pa.binary())})


def _cut(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column("text"), batch.column("marks")
            total, removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = WORD.findall((texts[i].as_py() or "").encode())
                total.append(len(words))
                if marks[i].is_valid:
                    steps = np.zeros(len(words) + 1, np.int64)
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(marks[i].as_py(), np.uint8), count=len(words) - window + 1))
                    steps[at] += 1
                    steps[at + window] -= 1
                    words = [words[j] for j in np.flatnonzero(np.cumsum(steps)[:-1] == 0)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])
    return of


def occurring_again(cells: DataFrame, types: tuple[str, ...], label: str) -> DataFrame:
    """(one, two, marks) of every document with places whose hashes occur again; ``cells`` are rows of packets."""
    cells = written(cells, f"{label}-cells")
    found = cells.where(F.col("bucket") != HEADER).groupBy("bucket").applyInArrow(_again(types), "packet long, places binary, documents binary")
    packets = cells.where(F.col("bucket") == HEADER).select("packet", "places", "documents").unionByName(found)
    marks = packets.groupBy("packet").applyInArrow(_marks, "one long, two long, marks binary")
    # Rows of equal id and text repeat each other, so that their marks are equal too: all set.
    return written(marks.groupBy("one", "two").agg(F.first("marks").alias("marks")), f"{label}-marks")


def repeated_windows(texts: DataFrame, window: int, packet_bytes: int = PACKET_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(one, two, marks): a bit for each window of a document, set where it occurs again; ``texts``: (one, two, text)."""
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + n_bytes // bucket_bytes
    anchors = occurring_again(texts.select("one", "two", "text").mapInArrow(_anchors(window, buckets, packet_bytes), CELLS), ANCHOR, "anchors")
    near = texts.select("one", "two", "text").join(anchors, ["one", "two"])
    return occurring_again(near.mapInArrow(_windows(window, buckets, packet_bytes), CELLS), WINDOW, "windows")


def without_repeats(documents: DataFrame, window: int = 50, doc_id: str = "doc_id", text_col: str = "text",
                    packet_bytes: int = PACKET_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words, one space between them).

    ``packet_bytes`` and ``bucket_bytes`` (of text) bound what one task holds at a time; results do not depend on them.
    """
    if window < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words at least")
    texts = documents.select(F.col(doc_id).alias("id"), F.xxhash64(doc_id, text_col).alias("one"),
                             F.xxhash64(F.lit(1), doc_id, text_col).alias("two"), F.col(text_col).alias("text"))
    joined = texts.join(repeated_windows(texts, window, packet_bytes, bucket_bytes), ["one", "two"], "left")
    id_type = texts.schema["id"].dataType.simpleString()
    return joined.select("id", "text", "marks").mapInArrow(_cut(window), f"doc_id {id_type}, n_words long, n_removed long, kept_text string")
