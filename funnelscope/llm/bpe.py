"""Byte-level BPE encoding and decoding with a public rank file.

Each piece that the pattern finds is merged on its own. A segment tree over the piece's byte positions keeps, for
each node, the leftmost smallest rank of the live pairs below it: the root names the next merge, and a merge changes
three leaves (the merged pair, the swallowed position, the neighbour to the left), each a logarithmic update. Short
pieces are merged many at a time, one tree per row of a matrix; long pieces one by one, in n log n steps.

Null texts encode as empty; an empty text has no ids. Texts are never cut, rows are never dropped, and other columns
are not touched, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

NONE = np.int64(1) << np.int64(62)
POSITION_BITS = 8
WIDEST = 64              # pieces of at most so many bytes are merged together
PIECES_AT_ONCE = 2_048
KEPT_STRETCHES = 200_000  # stretches whose ids a task remembers; then it starts anew
ROWS_AT_ONCE = 256
# Fixed value: the pattern whose matches begin anew at a space after another character (public_tokenizers.PATTERN).
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks_of(rank_file: bytes) -> dict[bytes, int]:
    """Token to rank, from the ``base64 rank`` lines of a tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, rank_file.splitlines()))}


def tokens_of(rank_file: bytes) -> list[bytes]:
    """The token of each rank; all that decoding needs."""
    ranks = ranks_of(rank_file)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


class Vocabulary:
    """The ranks of a tiktoken file and the pairs that merge into them."""

    def __init__(self, rank_file: bytes):
        self.rank = ranks_of(rank_file)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.concatenate([keys[order], [NONE]])
        self.ranks = np.concatenate([np.fromiter(pairs.values(), np.int64, len(pairs))[order], [-1]])

    def pair_leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values ``rank, position`` of pairs; NONE where the two never merge."""
        key = left << np.int64(32) | right
        found = np.searchsorted(self.keys, key)
        return np.where(self.keys[found] == key, self.ranks[found] << np.int64(POSITION_BITS) | at, NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32 bit) of pieces of at most WIDEST bytes, of similar length."""
        n, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 1 << max(1, int(sizes.max() - 1).bit_length())
        cell = np.arange(width)
        live = cell < sizes[:, None]
        ids = np.zeros((n, width), np.int64)
        ids[live] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(cell + 1, (n, 1))
        before = np.tile(cell - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        row, at = np.nonzero(live[:, 1:])
        tree[row, width + at] = self.pair_leaves(ids[row, at], ids[row, at + 1], at)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        span, mask = 2 * width, np.int64((1 << POSITION_BITS) - 1)
        flat_ids, flat_after, flat_before, flat_live, flat_tree = (x.reshape(-1) for x in (ids, after, before, live, tree))
        rows = np.arange(n)
        while True:
            best = flat_tree[rows * span + 1]
            going = best < NONE
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            at, rank, own, root = best & mask, best >> np.int64(POSITION_BITS), rows * width, rows * span
            gone = flat_after[own + at]
            follow = flat_after[own + gone]
            flat_ids[own + at] = rank
            flat_live[own + gone] = False
            flat_after[own + at] = follow
            right = np.flatnonzero(follow < sizes[rows])
            beyond = own[right] + follow[right]
            flat_before[beyond] = at[right]
            leaf = np.full(len(rows), NONE, np.int64)
            leaf[right] = self.pair_leaves(rank[right], flat_ids[beyond], at[right])
            prior = flat_before[own + at]
            left = np.flatnonzero(prior >= 0)
            back = prior[left]
            flat_tree[root + width + gone] = NONE
            flat_tree[root + width + at] = leaf
            flat_tree[root[left] + width + back] = self.pair_leaves(flat_ids[own[left] + back], rank[left], back)
            roots, node = np.concatenate([root, root, root[left]]), np.concatenate([gone, at, back]) + width
            for _ in range(width.bit_length() - 1):
                node >>= 1
                child = roots + 2 * node
                flat_tree[roots + node] = np.minimum(flat_tree[child], flat_tree[child + 1])
        flat, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_one(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n = len(piece)
        bits = n.bit_length()
        mask, none = (1 << bits) - 1, 1 << 62
        width = 1 << (n - 1).bit_length()
        ids, after, before = [int(self.byte[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pair
        leaf = lambda i, j: none if (r := pair.get(ids[i] << 32 | ids[j])) is None else r << bits | i
        tree = [none] * (width + n) + [none] * (width - n)
        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                low, high = tree[2 * node], tree[2 * node + 1]
                tree[node] = low if low < high else high

        while (best := tree[1]) < none:
            at = best & mask
            gone = after[at]
            ids[at], ids[gone] = best >> bits, -1
            after[at] = follow = after[gone]
            put(gone, none)
            if follow < n:
                before[follow] = at
            put(at, leaf(at, follow) if follow < n else none)
            if (prior := before[at]) >= 0:
                put(prior, leaf(prior, at))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces."""
        out, by_width, rank = {}, [[] for _ in range(WIDEST.bit_length())], self.rank
        for text in pieces:
            piece = text.encode()
            if piece in rank:
                out[text] = rank[piece].to_bytes(4, "little")
            elif len(piece) > WIDEST:
                out[text] = self.merge_one(piece)
            else:
                by_width[(len(piece) - 1).bit_length()].append(text)
        for group in by_width:
            for start in range(0, len(group), PIECES_AT_ONCE):
                part = group[start:start + PIECES_AT_ONCE]
                out.update(zip(part, self.merge_many([text.encode() for text in part])))
        return out


class Encoder:
    """Texts to ids, with a bounded memory of the stretches seen.

    No match of the public pattern goes on over a space that follows another character than white space, so a text is
    looked up by its stretches between spaces, and only a stretch not seen lately is matched and merged. A text with a
    space inside a longer run of white space is matched whole, as any text is for another pattern.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find, self.known = vocabulary, regex.compile(pattern).findall, {}
        self.by_space = pattern == SPACED_PATTERN
        self.run = re.compile(r"\s (?!\S)").search

    def stretches(self, text: str) -> list[str]:
        if not self.by_space or self.run(text):
            return self.find(text)
        return ("\0" + text.replace(" ", "\0 ")).split("\0")[1:] if "\0" not in text else self.find(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found = [self.stretches(t) if t else [] for t in texts]
        if len(self.known) > KEPT_STRETCHES:
            self.known = {}
        known = self.known
        new = {p: self.find(p) for p in set().union(*found) if p not in known}
        ids = self.vocabulary.encode_pieces(list({p for pieces in new.values() for p in pieces}))
        known.update((p, b"".join([ids[x] for x in pieces])) for p, pieces in new.items())
        return [b"".join(map(known.__getitem__, pieces)) for pieces in found]


def _rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Batches of at most ROWS_AT_ONCE rows, so that no result of a whole batch of Spark's is held, neither here nor by the JVM."""
    for batch in batches:
        for start in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def encoder(spark: SparkSession, rank_file: str, pattern: str):
    """A column function: text to ids, packed as little-endian unsigned 32-bit integers.

    The rank file is read once, by the driver, and broadcast; its size is fixed by the vocabulary (0.8 MB for 50k ranks).
    """
    shared = spark.sparkContext.broadcast(_rank_file(rank_file))

    @F.arrow_udf(T.BinaryType())
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        task = Encoder(Vocabulary(shared.value), pattern)
        for part in _parts(batches):
            yield pa.array(task.encode(part.to_pylist()), pa.binary())

    return encode


def decoder(spark: SparkSession, rank_file: str):
    """A column function: packed ids to the bytes they stand for (null: null)."""
    shared = spark.sparkContext.broadcast(_rank_file(rank_file))

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = tokens_of(shared.value)
        for part in _parts(batches):
            yield pa.array([None if ids is None else b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                            for ids in (x.as_py() for x in part)], pa.binary())

    return decode


def encode_texts(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with the packed ids of each text in ``out``; ``n_ids`` and ``unpacked`` read them."""
    return df.withColumn(out, encoder(df.sparkSession, rank_file, pattern)(F.col(text_col)))


def decode_ids(df: DataFrame, rank_file: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the decoded bytes of each row's packed ids in ``out``."""
    return df.withColumn(out, decoder(df.sparkSession, rank_file)(F.col(ids_col)))


def n_ids(packed: Column) -> Column:
    return F.floor(F.octet_length(packed) / 4).cast("long")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def unpacked(packed: pa.Array) -> pa.Array:
    """Packed ids as an array of integers."""
    return pa.array([None if x is None else np.frombuffer(x, "<u4").astype(np.int32) for x in packed.to_pylist()], pa.list_(pa.int32()))
