"""Collocations: phrases of few words that stand together more often than their parts would, counted with FM-indexes.

A text, A-Z in lower case, is split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. Every shard, a slice of a
task's texts, gets one bidirectional FM-index over word ids, a word of another language being another id. Its suffixes are sorted
by as many words as a phrase may have, which is all that intervals of such phrases need. From the single words on, intervals are
extended to the right and to the left by turns, all of a length at once: each node is a phrase with its count, its extensions the nodes
of the next length.

Counts of shards are summed in two passes. The first adds them up in 2 ** 32 cells by a hash of the phrase, in pages of which a task holds one
at a time; a shard sends each page its counts as one packed value. Phrases may share a cell, so cells are upper bounds. Cells that reach
``least_count`` set bits in a table of 16 MB, whatever the input's size (fuller cells and tables let more rows through and change no
result). The second pass counts by the words themselves the phrases whose bit is set. A phrase is at most as frequent as its parts,
so parts of candidates always come along, and what is not frequent is not extended.

Parts and longer phrases meet their candidates in plain joins and sums; ranks are taken within salted groups first, so a language with
most of all phrases is no task of its own.

Null and empty texts have no words; a null language is ``und``. Repeated rows count again. A text of any length is a shard of its own
where it is longer than a slice. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from funnelscope.llm import hashing
from funnelscope.llm.store import written

SHARD_BYTES = 4 << 20
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
NO_LANGUAGE = "und"
PAGE_BITS, CELL_BITS, COUNT_BITS = 12, 20, 12   # a hash names a page and a cell there; larger counts are sent as the largest
FILTER_BITS = 27
RANK_SALTS = 64
DIGITS = 14              # counts below 10 ** 14: their product with a million stays within 38 digits


@dataclass
class Nodes:
    """Phrases of ``length`` words: their intervals in both indexes, as starts and a common size."""

    length: int
    ahead: np.ndarray
    back: np.ndarray
    count: np.ndarray

    def where(self, keep: np.ndarray) -> Nodes:
        return Nodes(self.length, self.ahead[keep], self.back[keep], self.count[keep])


def _order(keys: np.ndarray) -> np.ndarray:
    """Places of non-negative keys in stable order. A place fits behind its key as a rule: then plain numbers are sorted."""
    shift = max(len(keys) - 1, 1).bit_length()
    if int(keys.max(initial=0)).bit_length() + shift > 63:
        return np.argsort(keys, kind="stable")
    packed = keys.astype(np.int64) << shift
    packed |= np.arange(len(keys))
    packed.sort()
    packed &= (1 << shift) - 1
    return packed


class _Index:
    """Suffix order by the first ``depth`` symbols (the sequence as a ring), the symbols before, and where a step back leads."""

    def __init__(self, symbols: np.ndarray, depth: int):
        order = _order(np.roll(symbols, 1 - depth))
        for ahead in range(depth - 2, -1, -1):
            order = order[_order(np.roll(symbols, -ahead)[order])]
        self.order = order.astype(np.int32)
        self.before = symbols[order - 1]
        self.step = np.empty(len(symbols), np.int32)
        self.step[_order(self.before)] = np.arange(len(symbols), dtype=np.int32)


class PhraseIndex:
    """A bidirectional FM-index over word ids from 1 on; 0 parts the pieces. Phrases of up to ``depth`` words can be asked for."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.symbols, self.depth = symbols, depth
        self.ahead, self.back = _Index(symbols, depth), _Index(symbols[::-1], depth)

    def words(self) -> Nodes:
        """Every single word."""
        counts = np.bincount(self.symbols)
        starts = np.cumsum(counts) - counts
        return Nodes(1, starts[1:], starts[1:], counts[1:]).where(counts[1:] > 0)

    def extended(self, nodes: Nodes, right: bool) -> Nodes:
        """All phrases one word longer, by a word after (or before) those of ``nodes``."""
        index = self.back if right else self.ahead
        near, far = (nodes.back, nodes.ahead) if right else (nodes.ahead, nodes.back)
        offsets = np.cumsum(nodes.count) - nodes.count
        node = np.repeat(np.arange(len(near)), nodes.count)
        rows = np.arange(len(node)) + np.repeat(near - offsets, nodes.count)
        symbol = index.before[rows].astype(np.int64)
        key = node * (int(self.symbols.max(initial=0)) + 1) + symbol
        order = _order(key)
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        first, of = order[at], node[order[at]]
        near, far = index.step[rows[first]], far[of] + at - offsets[of]
        longer = Nodes(nodes.length + 1, *((far, near) if right else (near, far)), np.diff(np.append(at, len(key))))
        return longer.where(symbol[first] > 0)

    def places(self, nodes: Nodes) -> np.ndarray:
        """Where each phrase begins for one of its times."""
        return self.ahead.order[nodes.ahead]


class Shard:
    """Words of a slice of texts as ids by language, pieces parted by 0."""

    def __init__(self, texts: pa.Array, languages: pa.Array):
        texts = hashing.Texts(texts, lower=True)
        data, offsets = texts.data, texts.offsets
        solid, ends = np.ones(256, bool), np.zeros(256, bool)
        ends[list(PIECE_ENDS)] = True
        solid[[9, 32, *PIECE_ENDS]] = False
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = solid[data]
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        stops = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        text = np.searchsorted(offsets, starts, "right") - 1
        ended = np.cumsum(ends[data])[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (ended[1:] != ended[:-1]) | (text[1:] != text[:-1])
        bounds = np.concatenate([[0], np.cumsum(stops - starts)])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[inside])))
        words = words.dictionary_encode()
        languages = languages.cast(pa.string()).fill_null(NO_LANGUAGE).dictionary_encode()
        # every pair of a language and a word is a symbol
        pairs = pa.array((languages.indices.to_numpy().astype(np.int64)[text] << 32) | words.indices.to_numpy()).dictionary_encode()
        self.pairs = pairs.dictionary.to_numpy()
        self.languages, self.words = languages.dictionary, words.dictionary
        self.symbols = np.zeros(len(starts) + int(fresh.sum()) + 1, np.int32)
        self.symbols[np.arange(len(starts)) + np.cumsum(fresh)] = pairs.indices.to_numpy() + 1
        self.language_counts = np.bincount(self.pairs[pairs.indices.to_numpy()] >> 32, minlength=len(self.languages))

    def hashes(self, places: np.ndarray, length: int) -> np.ndarray:
        """A 64-bit hash of language and words, the same in every shard."""
        if not hasattr(self, "_hashes"):
            digests = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in self.languages.to_pylist()]
            spoken = np.frombuffer(b"".join(digests), np.uint64)
            plain = hashing.Words(hashing.Texts(self.words)).hashes()
            self._hashes = np.concatenate([[np.uint64(0)], plain[self.pairs & 0xFFFFFFFF]]), np.concatenate([[np.uint64(0)], spoken[self.pairs >> 32]])
        word, language = self._hashes
        out = language[self.symbols[places]] + np.uint64(length)
        for k in range(length):
            out = hashing.mixed(out * hashing.BASE + word[self.symbols[places + k]])
        return out

    def phrases(self, places: np.ndarray, length: int) -> tuple[pa.Array, pa.Array]:
        """Languages and phrases."""
        pairs = [self.pairs[self.symbols[places + k] - 1] for k in range(length)]
        words = [self.words.take(pa.array(p & 0xFFFFFFFF)) for p in pairs]
        joined = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if length > 1 else words[0]
        return self.languages.take(pa.array(pairs[0] >> 32)), joined.cast(pa.string())


def _lengths(index: PhraseIndex) -> Iterator[tuple[Nodes, np.ndarray]]:
    """Nodes of every length with a place each; a mask sent back says which may be extended."""
    nodes = index.words()
    while True:
        keep = yield nodes, index.places(nodes)
        if nodes.length == index.depth:
            return
        nodes = index.extended(nodes if keep is None else nodes.where(keep), right=nodes.length % 2 == 1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for part in hashing.slices(batch, "text", SHARD_BYTES):
            shard = Shard(part.column("text"), part.column("lang"))
            if len(shard.pairs):
                yield shard


def _paged(most_words: int):
    """(page, counts): cells of a page and their counts, packed, for every shard."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            cells, counts = [], []
            for nodes, places in _lengths(PhraseIndex(shard.symbols, most_words)):
                cells.append(_cells(shard, nodes, places))
                counts.append(nodes.count)
            cells, counts = np.concatenate(cells), np.minimum(np.concatenate(counts), (1 << COUNT_BITS) - 1)
            packed = (cells << COUNT_BITS) | counts
            packed.sort()
            pages = np.flatnonzero(np.bincount(packed >> (CELL_BITS + COUNT_BITS), minlength=1))
            bounds = np.append(np.searchsorted(packed, pages << (CELL_BITS + COUNT_BITS)), len(packed))
            data = (packed & ((1 << CELL_BITS + COUNT_BITS) - 1)).astype(np.uint32)
            sent = pa.BinaryArray.from_buffers(pa.binary(), len(pages), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(pages.astype(np.int32)), sent], ["page", "counts"])
    return of


def _frequent_cells(least_count: int):
    """(page, bits): the bits of the cells that reach the count, several cells to a bit; rows come in order of page."""
    def bits(page: int, sums: np.ndarray) -> pa.RecordBatch:
        reached = (sums >= least_count).reshape(-1, 1 << PAGE_BITS + CELL_BITS - FILTER_BITS).any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([np.packbits(reached, bitorder="little").tobytes()])], ["page", "bits"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, sums = None, np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for other, sent in zip(batch.column(0).to_pylist(), batch.column(1)):
                if other != page:
                    if page is not None:
                        yield bits(page, sums)
                    page = other
                    sums[:] = 0
                packed = np.frombuffer(sent.as_buffer(), np.uint32)
                np.add.at(sums, packed >> COUNT_BITS, (packed & ((1 << COUNT_BITS) - 1)).astype(np.int64))
        if page is not None:
            yield bits(page, sums)
    return of


def _cells(shard: Shard, nodes: Nodes, places: np.ndarray) -> np.ndarray:
    """The cells of phrases, their pages in the upper bits."""
    return (shard.hashes(places, nodes.length) >> np.uint64(64 - PAGE_BITS - CELL_BITS)).astype(np.int64)


def _counted(most_words: int, bits):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "words", "phrase", "times"]
        table = np.frombuffer(bits.value, np.uint8)
        for shard in _shards(batches):
            spoken = len(shard.languages)
            yield pa.RecordBatch.from_arrays([shard.languages, pa.array(np.zeros(spoken, np.int32)), pa.array([""] * spoken),
                                              pa.array(shard.language_counts.astype(np.int64))], names)
            lengths, frequent = _lengths(PhraseIndex(shard.symbols, most_words)), None
            while True:
                try:
                    nodes, places = lengths.send(frequent)
                except StopIteration:
                    break
                bit = _cells(shard, nodes, places) >> (PAGE_BITS + CELL_BITS - FILTER_BITS)
                frequent = (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                languages, phrases = shard.phrases(places[frequent], nodes.length)
                yield pa.RecordBatch.from_arrays([languages, pa.array(np.full(len(phrases), nodes.length, np.int32)), phrases,
                                                  pa.array(nodes.count[frequent].astype(np.int64))], names)
    return of


def _bit_table(texts: DataFrame, most_words: int, least_count: int) -> bytes:
    """A bit for every few cells: 2 ** FILTER_BITS in all, at any size of the input."""
    counts = texts.mapInArrow(_paged(most_words), "page int, counts binary")
    pages = counts.repartition("page").sortWithinPartitions("page").mapInArrow(_frequent_cells(least_count), "page int, bits binary")
    width, table = 1 << FILTER_BITS - PAGE_BITS - 3, bytearray(1 << FILTER_BITS - 3)
    for page, bits in pages.collect():
        table[page * width:(page + 1) * width] = bits
    return bytes(table)


def phrase_counts(documents: DataFrame, most_words: int = 3, least_count: int = 10, lang: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, words, phrase, times): every phrase of up to ``most_words`` words that is said often enough, its words joined by a space.

    The row with 0 words has the number of all words of its language.
    """
    if not 1 <= least_count < 1 << COUNT_BITS:
        raise ValueError(f"least_count lies between 1 and {(1 << COUNT_BITS) - 1}")
    texts = documents.select(F.col(lang).cast("string").alias("lang"), F.col(text_col).alias("text"))
    bits = documents.sparkSession.sparkContext.broadcast(_bit_table(texts, most_words, least_count))
    counted = (texts.mapInArrow(_counted(most_words, bits), "lang string, words int, phrase string, times bigint")
               .groupBy("lang", "words", "phrase").agg(F.sum("times").alias("times")))
    return written(counted.where((F.col("words") == 0) | (F.col("times") >= least_count)), "phrase-counts")


def _exact(column: Column) -> Column:
    return column.cast(f"decimal({DIGITS},0)")


def _stretch(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("parts", start, length), " ")


def collocations(documents: DataFrame, most_words: int = 3, least_count: int = 10, covered_percent: int = 50, top: int = 2000,
                 lang: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's strongest phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``a``, ``l``, ``r`` count the phrase and the two parts of its weakest cut, ``score`` is ``floor(1000000 * a * a / (l * r))`` there, ``n`` counts
    the language's words. A phrase goes if a longer candidate around it has ``covered_percent`` of its count or more. Rank: by
    score and count, descending, then by the phrase's bytes.
    """
    if most_words < 2:
        raise ValueError("a phrase has two words at least")
    counts = phrase_counts(documents, most_words, least_count, lang, text_col)
    phrases = counts.where("words > 0").select("lang", "phrase", "times")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("times").alias("a"), F.split("phrase", " ").alias("parts"))
    cuts = (candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .select("lang", "phrase", "a", "k", _stretch(F.lit(1), F.col("k")).alias("first"),
                    _stretch(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("times").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("times").alias("r")), ["lang", "rest"])
    cuts = cuts.select("*", (_exact(F.lit(1_000_000)).cast("decimal(7,0)") * _exact(F.col("a")) * _exact(F.col("a"))).alias("above"),
                       (_exact(F.col("l")) * _exact(F.col("r"))).alias("below"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut"))
    # candidates inside longer candidates: the most frequent one around each
    inner = (candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
             .groupBy("lang", _stretch(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around")))
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (_exact(F.col("around")) * 100 < _exact(F.col("a")) * covered_percent))
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))
    first = (kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
             .where(F.col("rank") <= top))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("times").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n",
                                              F.col("cut.score").alias("score"))
