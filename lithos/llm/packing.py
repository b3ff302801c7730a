"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document is its ids and one end id. Its full windows become sequences of their
own; the rest, cut to at most PIECE ids, is spread over windows by multiway
differencing: partial partitions, each a tuple of window sums, are merged in the
order of their imbalance, the heaviest window of one on the lightest of the
other, until one near-equal partition is left. If its heaviest window exceeds the
capacity, the window count rises by one and the differencing runs again.

Scale. Documents are packed in groups of GROUP_TOKENS ids within the partitions
that the scan gives, so there is no shuffle, a group's memory is bounded, and
each group wastes a fixed share at most. A sequence_id holds the partition and a
running number; a task that is run again yields the same set of rows.

Defined results: null text counts as empty (its one id is the end id); a null
doc_id is carried; repeated rows are packed as documents of their own; other
columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lithos.llm.common import bounded, project
from lithos.llm.tokens import encoder, little_endian

WINDOW = 1024
#: Most ids in a piece that is no full window.
PIECE = 256
#: Ids that are packed together.
GROUP_TOKENS = 1 << 19
END = 0


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Partition items into windows of near-equal sums: (sum, items) of each window.

    A partial partition is a sorted list of (sum, tie-break, items); a single item
    stands for the partition that has it in one window. Merging adds the windows of
    one in ascending order to those of the other in descending order.
    """
    if windows <= 1 or not sizes:
        return [(sum(sizes), list(range(len(sizes))))]
    # heap of (-imbalance, number, item or None, partial partition or None); of equals, the last made comes first
    heap: list[tuple] = [(-x, i, i, None) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    number = 0
    while len(heap) > 1:
        _, _, i, a = heapq.heappop(heap)
        _, _, j, b = heapq.heappop(heap)
        if a is None:
            i, a, j, b = j, b, i, a
        if a is None:  # two single items
            a = [(0, k, []) for k in range(windows - 1)]
            a.append((sizes[i], windows - 1, [i]))
        if b is None:  # a partial partition and a single item
            total, k, items = a.pop(0)
            items.append(j)
            insort(a, (total + sizes[j], k, items))
        else:
            a = sorted(
                (x[0] + y[0], k, x[2] + y[2] if x[2] and y[2] else x[2] or y[2]) for k, (x, y) in enumerate(zip(a, reversed(b), strict=True))
            )
        number -= 1
        heapq.heappush(heap, (a[0][0] - a[-1][0], number, None, a))
    _, _, i, a = heap[0]
    return [(total, items) for total, _, items in a] if a else [(sizes[i], [i])]


def spread(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows of items, none above capacity; the count rises from the least possible until all fit."""
    windows = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, windows)
        if max((total for total, _ in found), default=0) <= capacity:
            return [items for _, items in found if items]
        windows += 1


_PACKED = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


def _pack(docs: list[tuple[int | None, bytes]], sequence: int, with_ids: bool) -> tuple[pa.RecordBatch, int]:
    """One group packed into sequences numbered from sequence on; and the next free number."""
    rows: list[tuple] = []
    pieces: list[tuple[int, int, int]] = []  # document, start, length

    def put(doc: int, start: int, length: int, offset: int) -> None:
        name, ids = docs[doc]
        part = ids[4 * start : 4 * (start + length)]
        rows.append((name, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset, part if with_ids else None))

    for doc, (_, ids) in enumerate(docs):
        n = len(ids) // 4
        full = n - n % WINDOW
        for start in range(0, full, WINDOW):
            put(doc, start, WINDOW, 0)
            sequence += 1
        for start in range(full, n, PIECE):
            pieces.append((doc, start, min(PIECE, n - start)))
    for window in spread([length for _, _, length in pieces]):
        offset = 0
        for k in sorted(window):
            put(*pieces[k], offset)
            offset += pieces[k][2]
        sequence += 1
    columns = zip(*rows, strict=True) if rows else [[] for _ in _PACKED]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED), sequence


def pack(docs: DataFrame, tokenizer_file: str, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer_file: a file of the tokenizers library, whose ids are taken (strings of its added tokens included).
    with_ids adds ids, the piece's unsigned 32-bit little-endian integers; without it the column is null.
    """
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file)
        end = little_endian([END])
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        size = 0
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), own.encode([x or "" for x in b.column(1).to_pylist()]), strict=True):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= GROUP_TOKENS:
                    out, sequence = _pack(held, sequence, with_ids)
                    held, size = [], 0
                    yield out
        out, sequence = _pack(held, sequence, with_ids)
        yield out

    return project(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
