"""Byte-level BPE encoding and decoding, and token ids as flat binary files.

Encoding: pretokens.slices() finds the pieces of a whole block of texts; each piece is merged once
by rank and then comes from a cache. Decoding joins the ranks' bytes and needs no scan.

Defined cases: a null or empty text has no ids and decodes to an empty text; every byte of a text comes
back; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import map_blocks, table
from orrery.llm.pretokens import distinct, slices

CACHE_PIECES = 100_000


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def merge(piece: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: the adjacent pair of lowest rank merges, the leftmost first, until none has a rank."""
    whole = rank.get(piece)
    if whole is not None:
        return (whole,)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 200:
        return _merge_long(parts, rank)
    none = len(rank)
    pairs = [rank.get(a + b, none) for a, b in itertools.pairwise(parts)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
    return tuple(rank[x] for x in parts)


def _merge_long(parts: list[bytes], rank: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap and linked neighbours, for pieces of thousands of bytes."""
    import heapq

    n = len(parts)
    right, left, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or parts[i] + parts[j] != both:
            continue
        parts[i], alive[j], right[i] = both, False, right[j]
        if right[j] < n:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (r := rank.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return tuple(rank[p] for p, ok in zip(parts, alive, strict=True) if ok)


def packed(ids: list, kind: str) -> list[bytes]:
    """Each sequence of ids as packed integers."""
    size = np.dtype(kind).itemsize
    ends = np.cumsum([0, *map(len, ids)]) * size
    data = np.fromiter(itertools.chain.from_iterable(ids), kind, ends[-1] // size).tobytes()
    return [data[a:b] for a, b in itertools.pairwise(ends.tolist())]


class Pieces:
    """Ids of pieces as packed integers, computed once and kept in two generations of `most` each.

    When the young one is full it becomes the old one; what is still in use moves back by itself.
    """

    def __init__(self, solve: Callable[[list[bytes]], list[bytes]], kind: str, most: int = CACHE_PIECES):
        self.solve, self.kind, self.most = solve, np.dtype(kind), most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each of several different pieces."""
        found = [*map(self.young.get, pieces)]
        holes = [k for k, ids in enumerate(found) if ids is None]
        if not holes:
            return found
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        young, old, missing = self.young, self.old.get, []
        for k in holes:
            found[k] = ids = old(pieces[k])
            if ids is None:
                missing.append(k)
            else:
                young[pieces[k]] = ids
        for k, ids in zip(missing, self.solve([pieces[k] for k in missing]), strict=True):
            found[k] = ids
            if len(pieces[k]) <= 64:
                young[pieces[k]] = ids
        return found


@functools.cache
def merged(path: str) -> Pieces:
    rank = ranks(path)
    kind = "<u2" if max(rank.values()) < 1 << 16 else "<u4"
    return Pieces(lambda pieces: packed([merge(p, rank) for p in pieces], kind), kind)


def encode_block(texts: list[str | None], pieces_of: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of the texts and where each text's ids start, the end included."""
    data, at, first = slices(texts)
    one, which = distinct(data, at)
    found = pieces_of([data[a:b] for a, b in zip(at[one].tolist(), at[one + 1].tolist(), strict=True)])
    size = np.fromiter(map(len, found), np.int64, len(found)) // pieces_of.kind.itemsize
    start = np.cumsum(size) - size
    ids = np.frombuffer(b"".join(found), pieces_of.kind)
    size, start = size[which], start[which]
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return ids[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)], ends[first]


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every whole text."""

    def make():
        pieces = merged(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), _lists(*encode_block(batch.column(1).to_pylist(), pieces))], names=["doc_id", "ids"])

        return work

    return map_blocks(_rows(docs, id_col, text_col), make, "doc_id long, ids array<int>")


@functools.cache
def _bytes_of(path: str) -> dict[int, bytes]:
    return {v: k for k, v in ranks(path).items()}


def decode_block(ids: np.ndarray, ends: np.ndarray, of: dict[int, bytes]) -> list[bytes]:
    """The bytes of each text of a block, from flat ids and the retained offsets."""
    parts = [*map(of.__getitem__, ids.tolist())]
    return [b"".join(parts[a:b]) for a, b in itertools.pairwise(ends.tolist())]


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and the decoded bytes of every row of encode()."""

    def run(batches):
        of = _bytes_of(vocabulary)
        for batch in batches:
            ids = batch.column(1)
            ends = ids.offsets.to_numpy()
            texts = decode_block(ids.flatten().to_numpy(zero_copy_only=False), ends - ends[0], of)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    return tokens.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one Python process a task: doc_id, ids, decoded."""

    def make():
        pieces, of = merged(vocabulary), _bytes_of(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, ends = encode_block(batch.column(1).to_pylist(), pieces)
            return pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, ends), pa.array(decode_block(ids, ends, of), pa.binary())], names=["doc_id", "ids", "decoded"])

        return work

    return map_blocks(_rows(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Counts and digests of the rows of decode() or round_trip()."""
    return decoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
