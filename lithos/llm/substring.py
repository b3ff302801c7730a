"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is `size` consecutive words of one document. A word goes if some window
over it has a word sequence that also starts in a document with a smaller
doc_id; overlapping windows merge into maximal removal intervals. Windows are
judged on the input.

How it scales. One pass hashes each text and sends every distinct window of a
batch once, with the smallest doc_id that has it there, to the bucket of its
hash, so a passage in a third of all documents costs its bucket one entry a
batch; documents of the batch beyond that smallest one are known to be repeats
and need no count. A bucket holds a fixed amount of input, so buckets grow in
number, not in size. What comes back is a row per document and window to remove, as
many as there are; gathered per document, a join on doc_id brings them to the text,
which is hashed again.

Windows are equal if their hashes are: two lanes of 64 bits over the words' XXH3. 56
bits of one lane are sent along, the other deals windows into buckets, so 56 bits and
the logarithm of the buckets tell them apart. A bucket holds some 500,000 windows
whatever the input, so of n windows about n * 2^-38 are taken for another: 0.02 at
30 GB (6 * 10^9 windows), some 70 of 2 * 10^13 at 100 TB. The words themselves are not
compared.

Defined results: null text has no words; a document with fewer than `size` words
loses nothing; a null doc_id is ordered with no other, so the row neither loses
words nor makes others lose any; rows that repeat a doc_id are judged alike, and
neither makes the other lose words (its id is not smaller). Other columns are
ignored or, in `remove`, carried. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import bounded, numbered, place, project
from lithos.llm.wordhash import window_hashes, word_hashes, word_spans

WINDOW = 13
#: Bytes of text a bucket of hashes stands for.
BUCKET_BYTES = 3 << 20
#: Bytes of text hashed together in a task.
GROUP_BYTES = 3 << 20
_SPACE = b" \t\n\r\x0b\x0c"
#: The bits of the second lane that are sent along.
_SENT = np.uint64((1 << 56) - 1)


def _planes(a: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane: sorted or small values compress well so."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(dtype).ravel()


def _least(keys: tuple[np.ndarray, ...], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with the same keys (the last one sorts first): the order of all rows, where each set of equals starts in it, its least doc, and a mask of rows beyond the least."""
    order = np.lexsort(keys)
    d = docs[order]
    if not len(d):
        return order, np.empty(0, np.int64), d, np.empty(0, bool)
    new = np.ones(len(d), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(d, first)
    return order, first, least, d > np.repeat(least, np.diff(np.append(first, len(d))))


def _by_doc(docs: np.ndarray, hashes: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Distinct hashes of each document, packed."""
    order = np.lexsort((hashes, docs))
    d, h = docs[order], hashes[order]
    own = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else np.empty(0, bool)
    d, h = d[own], h[own]
    cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else np.empty(0, np.int64)
    ends = np.append(cut[1:], len(d))[: len(cut)]
    return d[cut].tolist(), [h[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]


_SHIPPED = pa.schema([("bucket", pa.int64()), ("doc", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary())])


def _ship(texts: list[bytes], ids: list[int], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A group of texts as rows: distinct windows by bucket, and repeats inside the group by document."""
    found, owners = [], []
    for text, doc in zip(texts, ids, strict=True):
        h = window_hashes(word_hashes(text), size)
        h[:, 1] &= _SENT
        if len(h):
            found.append(h)
            owners.append(np.full(len(h), doc, np.int64))
    if not found:
        return
    both, owner = np.concatenate(found), np.concatenate(owners)
    # one lane deals the windows into buckets, the other tells them apart there
    bucket = (both[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order, first, least, over = _least((both[:, 1], bucket), owner)
    over_doc, over_hash = owner[order][over], both[order[over], 1]
    h, bucket = both[order[first], 1], bucket[order[first]]
    base = int(least.min())
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rows: tuple[list, list, list, list] = ([], [], [], [])
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(h)], strict=True):
        for column, value in zip(rows, (int(bucket[lo]), base, _planes(h[lo:hi]), _planes(least[lo:hi] - base)), strict=True):
            column.append(value)
    docs, lists = _by_doc(over_doc, over_hash)
    for doc, raw in zip(docs, lists, strict=True):
        for column, value in zip(rows, (-1 - doc % buckets, doc, raw, None), strict=True):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SHIPPED, strict=True)], schema=_SHIPPED)


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows (doc_id, hash): windows of the document that also start in one with a smaller id; hash is a signed long."""
    bounded(docs.sparkSession)
    rows = project(docs, doc_id="long", text="string")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(16, -(-total // BUCKET_BYTES)), 1 << 31)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        ids: list[int] = []
        held = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                texts.append(text.encode())
                ids.append(doc)
                held += len(texts[-1])
                if held >= GROUP_BYTES:
                    yield from _ship(texts, ids, size, buckets)
                    texts, ids, held = [], [], 0
        yield from _ship(texts, ids, size, buckets)

    def count(bucket: pa.Table) -> pa.Table:
        if bucket.column("bucket")[0].as_py() < 0:  # found by a batch already
            lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in bucket.column("hashes")]
            docs, hashes = np.repeat(bucket.column("doc").to_numpy(), list(map(len, lists))), np.concatenate(lists)
        else:
            h = np.concatenate([_unplanes(x.as_buffer(), np.uint64) for x in bucket.column("hashes")])
            d = np.concatenate([
                _unplanes(x.as_buffer(), np.int64) + base.as_py()
                for x, base in zip(bucket.column("docs"), bucket.column("doc"), strict=True)
            ])
            order, _, _, over = _least((h,), d)
            docs, hashes = d[order][over], h[order][over]
        return pa.table({"doc_id": docs, "hash": hashes.view(np.int64)})

    sent = rows.mapInArrow(ship, "bucket long, doc long, hashes binary, docs binary")
    return sent.groupBy("bucket").applyInArrow(count, "doc_id long, hash long")


def removal(words: np.ndarray, gone: np.ndarray, size: int) -> np.ndarray:
    """Mask of the words covered by a window whose hash is in gone (maximal intervals merged)."""
    h = window_hashes(words, size)[:, 1] & _SENT
    at = np.flatnonzero(np.isin(h, gone))
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _with_hashes(rows: DataFrame, key: str, docs: DataFrame, size: int) -> DataFrame:
    """rows with a column __gone: the lists of hashes to remove from the document in column key, null if there are none."""
    found = repeated_windows(docs, size).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("hash").alias("__gone"))
    return rows.join(found, rows[key].cast("long") == found["__id"], "left").drop("__id")


def _gone(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """The hashes to remove of each row, null if there are none."""
    values, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield values[a:b] if b > a else None


def _cut(text: bytes, gone: np.ndarray | None, size: int) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """Words, removed words, kept words joined by a space, and removed byte spans of one text."""
    if gone is None:
        words = text.split()
        return len(words), 0, b" ".join(words), []
    starts, ends = word_spans(text)
    mask = removal(word_hashes(text), gone, size)
    kept = b" ".join([text[s:e] for s, e in zip(starts[~mask].tolist(), ends[~mask].tolist(), strict=True)])
    step = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    first, past = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    spans = list(zip(starts[first].tolist(), ends[past - 1].tolist(), strict=True))
    return len(starts), int(mask.sum()), kept, spans


def digest(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by a space."""
    rows = project(docs, doc_id="long", text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, gone in zip(b.column(1).to_pylist(), _gone(b.column(2)), strict=True):
                n, removed, kept, _ = _cut((text or "").encode(), gone, size)
                for column, value in zip(out, (n, removed, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = _with_hashes(rows, "doc_id", docs, size).select("doc_id", "text", "__gone")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with the repeated passages cut out of text and n_chars set anew; all other columns as they are.

    White space around a cut, and at the ends of a text that was cut, closes to one space or none. A document that consists of repeats alone keeps its row with an empty text.
    """
    rows, at = numbered(docs), docs.columns.index("text")
    joined = _with_hashes(rows, place(docs, "doc_id"), docs, size)
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, gone in enumerate(_gone(b.column(len(schema)))):
                if gone is not None and texts[i]:
                    data, parts, past = texts[i].encode(), [], 0
                    for s, e in _cut(texts[i].encode(), gone, size)[3]:
                        parts.append(data[past:s])
                        past = e
                    parts.append(data[past:])
                    texts[i] = b" ".join(x for x in (y.strip(_SPACE) for y in parts) if x).decode()
            arrays = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(schema))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    out = joined.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn(place(docs, "n_chars"), F.length(f"__c{at}").cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as the operator sees them."""
    data = (text or "").encode()
    return [data[s:e] for s, e in zip(*word_spans(data), strict=True)]
