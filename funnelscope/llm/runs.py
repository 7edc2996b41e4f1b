"""Periodic runs of words in every text, by recompression, and texts without their repetitions.

A word is ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of successive words with smallest period ``q`` (words ``q`` apart are equal) of at least
``least_words`` words and ``least_power * q`` words, which no neighbouring word extends with that period.

Candidates lie on a harmonic grid: a run of period ``q`` has ``(least_power - 1) * q`` successive places whose word comes again ``q`` later,
so one of them is a multiple of that number. For every period up to the text's length by ``least_power``, each grid place whose
word comes again is extended to both sides on the grammar (``grammar``): exactly the run, or too short. A stretch found with several
periods has the least one (the others are its multiples). All texts of a slice share one grammar, parted by unique symbols.

Everything happens in the document's own task: no shuffle. Grid places are taken in blocks, so memory is bounded by a slice of
texts, or by one text where it is longer. Null, empty and white-space texts have no words and no runs. Repeated rows, equal and null ids
are rows as any. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from funnelscope.llm import hashing
from funnelscope.llm.grammar import Grammar

BLOCK_PLACES = 1 << 20
WORDS = "[ \\t-\\r]+"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_SQL = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_strings(words: hashing.Words) -> pa.Array:
    """All words as an Arrow column; their bytes follow one another in the text."""
    lengths = words.ends - words.starts
    solid = np.zeros(len(words.data) + 1, np.int8)
    solid[words.starts] += 1
    np.subtract.at(solid, words.ends, 1)   # a word may begin where another text's last one ends
    data = words.data[np.cumsum(solid[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _grid(counts: np.ndarray, begins: np.ndarray, least_power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, period) on the harmonic grids of texts of so many words that begin at these places."""
    periods = counts // least_power
    text = np.repeat(np.arange(len(counts)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    apart = period * (least_power - 1)
    places = (counts[text] - 1 - period) // apart + 1
    ends = np.cumsum(places)
    at = 0
    while at < len(text):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + BLOCK_PLACES, "right")))
        n = places[at:stop]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield begins[np.repeat(text[at:stop], n)] + k * np.repeat(apart[at:stop], n), np.repeat(period[at:stop], n)
        at = stop


def runs_of(names: np.ndarray, n_names: int, first: np.ndarray, least_power: int, least_words: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run, in order of text, start and period; ``first`` has each text's first word, and the end."""
    counts = np.diff(first)
    borders = first + np.arange(len(first))
    words = np.zeros(len(names) + len(first), np.int64)
    plain = np.ones(len(words), bool)
    plain[borders] = False
    words[plain] = names
    grammar, found = Grammar(words, n_names, borders), []
    for at, period in _grid(counts, borders[:-1] + 1, least_power):
        again = np.flatnonzero(words[at] == words[at + period])
        at, period = at[again], period[again]
        back = grammar.extend(at, at + period, False)
        length = back + grammar.extend(at, at + period, True) + period
        fits = np.flatnonzero(length >= np.maximum(least_words, least_power * period))
        found.append(np.stack([at[fits] - back[fits], length[fits], period[fits]]))
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort([period, length, start])
    start, length, period = start[order], length[order], period[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort([period, start])
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(borders, start, "right") - 1
    return text, start - borders[text] - 1, length, period


def _found(least_power: int, least_words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                words = hashing.Words(hashing.Texts(part.column("text")))
                strings, counts = word_strings(words), words.counts()
                coded = strings.dictionary_encode()
                text, start, length, period = runs_of(
                    coded.indices.to_numpy().astype(np.int64), len(coded.dictionary), words.first, least_power, least_words)
                steps = np.zeros(len(strings) + 1, np.int64)
                np.add.at(steps, words.first[text] + start + period, 1)
                np.subtract.at(steps, words.first[text] + start + length, 1)
                kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, words.first).astype(np.int32)), strings.take(pa.array(kept)))
                runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)), runs),
                     pc.binary_join(lists, " ")], ["doc_id", "n_words", "runs", "collapsed"])
    return of


def find_runs(documents: DataFrame, doc_id: str = "doc_id", text_col: str = "text", least_power: int = 4, least_words: int = 6) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``runs`` (start, length, period in words; by start, then period), ``collapsed``.

    ``collapsed`` has the words, one space between them, that no run holds after its first period.
    """
    if least_power < 2:
        raise ValueError("a run has two periods at least")
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_found(least_power, least_words), f"doc_id {id_type}, n_words bigint, runs {RUN_SQL}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest length by period, compared exactly; the first of equal ones. Null where there is none."""
    stronger = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    return F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, 0), lambda best, x: F.when(stronger(x, best), x).otherwise(best)))


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line end for every run."""
    return F.array_join(F.transform(runs, lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","),
                                                              x["period"].cast("string"), F.lit("\n"))), "")


def cycled(text: Column, doc_id: Column) -> Column:
    """The text, or for every tenth hash of an id its words from one place on as a cycle of the first few of them.

    With h = crc32 of the decimal id and g = h div 10: if h ends in 0, words from a = g mod n on repeat those from a to a + p, where
    p = 1 + (n - a) div (3 + g mod 8). Rows without an id or without words stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    turned = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")
    return F.when(h % 10 == 0, F.when(n > 0, turned).otherwise(text)).otherwise(text)
