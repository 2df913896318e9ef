"""Packing into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole sequences and a tail, which stays whole, so a document that fits a sequence is
never cut (a max_piece below the capacity cuts tails, for fuller sequences). The tails of
about `windows` sequences form a block. Differencing starts with one partial partition for each piece, all other
windows empty, and keeps merging the two of largest spread, the fullest windows of one onto the emptiest of the other,
until one partition is left, with near-equal windows. Where one exceeds the capacity, the number of windows rises by
one and differencing starts again.

A task packs what it reads: nothing is shuffled, a hot source is only more blocks, and a task that is lost and run
again gives the same sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import Codec

_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process; its model serves all the worker's tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec.from_json(path, pattern) if path.endswith(".json") else Codec.from_ranks(path, pattern)
    return _codecs[path, pattern]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of indexes into sizes, with near-equal sums.

    A partial partition holds only its nonempty windows, largest first; all others are empty. Its spread is the
    largest window less the smallest.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    if k == 1 or not sizes:
        return [list(range(len(sizes))), *([] for _ in range(k - 1))]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        spare = k - len(a)
        if len(b) <= spare:  # b's windows fall on a's empty ones
            merged = a + b
        else:  # the fullest of b beside the emptiest of a
            over = len(b) - spare
            merged = a[: len(a) - over] + b[:spare]
            for (x, p), (y, q) in zip(a[len(a) - over :], reversed(b[spare:])):
                merged.append((x + y, p + q))
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1
    out = [p for _, p in heap[0][2]]
    return out + [[] for _ in range(k - len(out))]


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within the capacity; more of them as long as one exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += 1


def _pack(path: str, pattern: str, end: int, capacity: int, max_piece: int, windows: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        last = end.to_bytes(4, "little")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        types = [pa.int64()] * 7 + [pa.binary()]
        sequence, held, total, out = TaskContext.get().partitionId() << 32, [], 0, []

        def settle():
            nonlocal sequence, held, total
            for window in pack_block([p[2] for p in held], capacity) if held else []:
                at = 0
                for i in sorted(window):
                    out.append((*held[i][:5], sequence, at, held[i][5]))
                    at += held[i][2]
                sequence += bool(window)
            held, total = [], 0

        def flush():
            cols = list(zip(*out)) or [[]] * 8
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)][: 7 + with_ids], names=names[: 7 + with_ids])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode_each(batch.column(1))):
                ids += last
                n, start = len(ids) // 4, 0
                while start < n:
                    whole = n - start >= capacity
                    length = capacity if whole else min(n - start, max_piece)
                    part = ids[4 * start : 4 * (start + length)]
                    piece = (doc_id, start, length, zlib.crc32(part), n, part if with_ids else None)
                    if whole:
                        out.append((*piece[:5], sequence, 0, piece[5]))
                        sequence += 1
                    else:
                        held.append(piece)
                        total += length
                    start += length
                if total >= windows * capacity:
                    settle()
                if len(out) >= 20_000:
                    yield flush()
        settle()
        own.forget()
        yield flush()

    return run


def pack_documents(docs: DataFrame, path: str, pattern: str, end: int = 1, capacity: int = 2048, max_piece: int | None = None, windows: int = 64, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text): its place in the document and in its sequence.

    A null or empty text is the end id alone; the string of an added token is ordinary text. A null doc_id stays null. Repeated rows are packed each. sequence_id is
    the task's number in the upper bits and a count in the lower 32. ids holds the piece's ids (little-endian unsigned
    32-bit) if with_ids is set. An empty table gives an empty result.
    """
    max_piece = capacity if max_piece is None else max_piece
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(path, pattern, end, capacity, max_piece, windows, with_ids), kind)
