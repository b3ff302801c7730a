"""SimHash near-dedup at a given similarity: wide fingerprints, a trie self-join with a wide error budget, an exact check.

A document is the set of its five-word shingles (words as in `simhash`; with fewer
words the whole sequence is the one shingle), each a 64-bit hash. Two documents are
near copies if their sets' Jaccard similarity is at least 0.8, counted on the whole
sets. Documents of equal sets form one class and meet before anything else.

The fingerprint is a SimHash (a bit is 1 if it is set in over half the set's hashes) of
LANES lanes of 24 bits and 128 bits more. At a similarity of 0.8 two fingerprints
differ in about 15 of 100 bits, so one trie over all bits would have to let nearly every
pair of nodes through. Each lane is therefore a trie of its own with a budget of 1: as
one half of the lane is then equal, both halves deal the classes into buckets, where the tries over the other half are joined with
themselves. Two classes are linked if the 128 bits also keep to the budget of CHECK;
whatever their lanes, so are a class and the least of its bucket, and neighbours by
either half of the 128 bits. A pair at exactly 0.8 meets in some lane with probability
0.987 (sets of some ten shingles or more; 0.84 for sets of 4 and 5), and keeps to CHECK
with 0.999; both rise with the similarity.

Of each bucket's links only a spanning forest is sent on, at most one row a class of
the bucket, however many of them are alike. What the links connect is a family; near
copies that are linked are in one. The sets of a family then meet, once and not lane by
lane: every pair of them that the task has not connected yet, that differs in at most
WIDE bits of the whole fingerprint (sets under SHORT go without) is counted on the
sets, and again only a spanning forest of the near pairs is sent on. So rows grow with
the classes; only comparisons inside a task grow with the pairs of a family. Families
above BLOCK classes or SHINGLES shingles are dealt to pairs of blocks, buckets above
PART classes again by either half of the 12 bits that they leave open, of which a
budget of 1 leaves one half equal. Two groups of equal lanes above SMALL classes are
linked whole, without the 128 bits.

Defined results: as in `simhash.keep_one`; null text is a text without words, and
texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import bounded, discard, materialize, numbered, place, project, release, spread
from lithos.llm.simhash import components, spanning, trie_pairs
from lithos.llm.wordhash import mix, window_hashes, word_hashes

SHINGLE = 5
#: Similarity from which on two documents are near copies, as a ratio of integers.
NEAR = (4, 5)
LANES = 40
#: Bits of half a lane.
HALF = 12
#: Differing bits allowed in a lane, and in the 128 bits beyond the lanes.
BUDGET, CHECK = 1, 32
#: Classes of a group of equal lanes up to which every link is tested on the bits beyond the lanes.
SMALL = 1 << 10
PART = 1 << 15
#: Differing bits of the whole fingerprint of 1088 up to which sets are compared: seven standard deviations above
#: what similarity 0.8 has (165 and 12); sets of fewer than SHORT shingles can differ in more.
WIDE, SHORT = 256, 10
#: Classes, and shingles on average, of a family that one block holds; two blocks meet in one task.
BLOCK, SHINGLES = 1 << 12, 1 << 21
_WORDS = LANES * 2 * HALF // 64 + 2
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, _WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, _WORDS, np.uint64)
_EIGHTHS = np.uint64(0x0101010101010101)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes((text or "").encode().lower())
    return np.unique(window_hashes(words, min(size, len(words)))[:, 0]) if len(words) else np.empty(0, np.uint64)


def node_of(found: np.ndarray) -> int:
    """A signed long that stands for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The bytes of a set's SimHash: lanes of three bytes, then 16 bytes more. An empty set has all zeros."""
    counts = np.zeros((8, 8 * _WORDS), np.int64)
    for at in range(0, len(found), 255):  # bits are counted in bytes, so 255 hashes at a time
        each = mix(found[at : at + 255, None] * _TIMES + _PLUS)
        for bit in range(8):
            counts[bit] += ((each >> np.uint64(bit)) & _EIGHTHS).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(found), axis=0, bitorder="little")[0]


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted distinct arrays have a Jaccard similarity of at least NEAR: the definition, that `_close` counts in bulk."""
    if min(len(a), len(b)) * NEAR[1] < max(len(a), len(b)) * NEAR[0]:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * NEAR[1] >= (len(both) - shared) * NEAR[0]


def _prints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, node, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x) for x in b.column(1).to_pylist()]
            nodes = pa.array([node_of(x) for x in found], pa.int64())
            prints = pa.array([fingerprint(x).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), nodes, prints], names=["doc_id", "node", "fp"])

    return spread(project(docs, doc_id="long", text="string")).mapInArrow(run, "doc_id long, node long, fp binary")


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows (node, fp, shingles, size) for the classes (node, rep) in needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x) for x in b.column(1).to_pylist()]
            prints = pa.array([fingerprint(x).tobytes() for x in found], pa.binary())
            sets, sizes = pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), prints, sets, sizes], names=["node", "fp", "shingles", "size"])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array([node_of(shingles(x)) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([own, b.column(0), b.column(1)], names=["node", "id", "text"])

    texts = project(docs, doc_id="long", text="string").mapInArrow(nodes, "node long, id long, text string")
    same = (texts["node"] == needed["node"]) & texts["id"].eqNullSafe(needed["rep"])
    found = texts.join(needed, same, "left_semi").select("node", "text").mapInArrow(run, "node long, fp binary, shingles binary, size long")
    return found.dropDuplicates(["node"])


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The lanes of fingerprints, a row of bytes each."""
    return raw[:, : 3 * LANES].reshape(len(raw), LANES, 3).astype(np.int32) @ np.array([1, 1 << 8, 1 << 16], np.int32)


def dealt(classes: DataFrame) -> DataFrame:
    """Rows (bucket, other, c1, c2, node): both halves of each lane of (node, fp); the other half and the bits beyond the lanes go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(n, 8 * _WORDS)
            lanes = _lanes(raw)
            low, high = lanes & ((1 << HALF) - 1), lanes >> HALF
            base = np.arange(LANES, dtype=np.int32) << (HALF + 1)
            bucket = np.stack((base + low, base + (1 << HALF) + high), axis=2).reshape(-1)
            other = np.stack((high, low), axis=2).reshape(-1)
            check = np.ascontiguousarray(raw[:, 3 * LANES :]).view(np.int64)
            often = np.repeat(np.arange(n), 2 * LANES)
            nodes = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (bucket, other, check[often, 0], check[often, 1], nodes[often])], names=["bucket", "other", "c1", "c2", "node"]
            )

    return classes.select("node", "fp").mapInArrow(run, "bucket int, other int, c1 long, c2 long, node long")


def _forest(owner: np.ndarray, other: np.ndarray, c1: np.ndarray, c2: np.ndarray, node: np.ndarray, small: int = SMALL) -> np.ndarray:
    """Of each row the first row that links inside its bucket (owner) reach."""
    n = len(owner)

    def keep(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differ = sum(np.bitwise_count((c[i] ^ c[j]).view(np.uint64)).astype(np.int16) for c in (c1, c2))
        kept = (differ <= CHECK) & (label[i] != label[j])
        return spanning(n, np.concatenate((np.arange(n), i[kept])), np.concatenate((label, j[kept])))

    label = np.arange(n)
    # whatever their lanes: every row and the least node of its bucket, and neighbours by either word beyond the lanes
    for k, word in enumerate((node, c1, c2)):
        turn = np.lexsort((word, owner))
        new = np.append(True, owner[turn][1:] != owner[turn][:-1])
        before = turn[np.flatnonzero(new)[np.cumsum(new) - 1]] if k == 0 else np.append(turn[:1], turn[:-1])
        label = keep(label, turn[~new], before[~new])
    order = np.lexsort((other, owner))
    key = (owner[order].astype(np.int64) << HALF) | other[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(new, n))
    # pairs of groups: each with itself, and those of a bucket whose lanes differ by the budget
    cuts = np.flatnonzero(np.append(True, owner[order[new]][1:] != owner[order[new]][:-1]))
    a, b = trie_pairs(other[order[new]].astype(np.uint64) << np.uint64(64 - HALF), np.append(cuts, len(new)), BUDGET)
    own = np.flatnonzero(size > 1)
    a, b = np.concatenate((own, a)), np.concatenate((own, b))
    many = size[a] * size[b]
    whole = many > small * small
    held = np.unique(np.concatenate((a[whole], b[whole])))
    rows = np.repeat(new[held] - np.cumsum(size[held]) + size[held], size[held]) + np.arange(size[held].sum())
    ends = np.arange(n), order[rows], order[new[a[whole]]]
    label = spanning(n, np.concatenate(ends), np.concatenate((label, order[np.repeat(new[held], size[held])], order[new[b[whole]]])))
    a, b, many = a[~whole], b[~whole], many[~whole]
    ends = np.cumsum(many)
    at = 0
    while at < len(a):  # some 2^20 pairs at a time
        to = max(int(np.searchsorted(ends, ends[at] - many[at] + (1 << 20), side="right")), at + 1)
        pair = np.repeat(np.arange(at, to), many[at:to])
        k = np.arange(len(pair)) - (ends - many)[pair] + ends[at] - many[at]
        label = keep(label, order[new[a[pair]] + k // size[b[pair]]], order[new[b[pair]] + k % size[b[pair]]])
        at = to
    return label


def links(classes: DataFrame, small: int = SMALL, part: int = PART) -> DataFrame:
    """Rows (a, b), a > b: of each bucket of classes (node, fp) a forest that connects what its links connect."""
    rows = dealt(classes)
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    half = HALF // 2
    again = F.array(F.shiftright("other", half) + 1, F.col("other").bitwiseAND((1 << half) - 1) + 1 + (1 << half))
    buckets = (
        rows.join(counts, "bucket")
        .withColumn("piece", F.explode(F.when(F.col("size") > part, again).otherwise(F.array(F.lit(0)))))
        .groupBy("bucket", "piece")
        .agg(F.collect_list(F.struct("other", "c1", "c2", "node")).alias("rows"))
        .select("rows")
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            at = 0
            while at < b.num_rows:
                to = max(int(np.searchsorted(offsets, offsets[at] + 2 * part, side="right")) - 1, at + 1)
                flat = lists.values.slice(offsets[at], offsets[to] - offsets[at])
                other, c1, c2, node = (flat.field(k).to_numpy() for k in ("other", "c1", "c2", "node"))
                owner = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
                label = _forest(owner, other, c1, c2, node, small)
                far = np.flatnonzero(label != np.arange(len(label)))
                x, y = node[far], node[label[far]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])
                at = to

    return buckets.mapInArrow(pairs, "a long, b long")


def _close(rows: pa.Table) -> pa.Table:
    """A forest (a, b) that connects what the near pairs of two blocks connect; of one block, if both are the same."""
    across = rows.column("x")[0].as_py() != rows.column("y")[0].as_py()
    node, part = (rows.column(k).to_numpy() for k in ("node", "part"))
    n = len(node)
    words = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(n, _WORDS)
    sets = [np.frombuffer(x, np.uint64) if x else np.empty(0, np.uint64) for x in rows.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(at.reshape(-1), np.cumsum(size)[:-1])
    mark, label, out = np.zeros(len(known), bool), np.arange(n), []
    for i in range(n - 1):
        keep = (label[i + 1 :] != label[i]) & (np.minimum(size[i + 1 :], size[i]) * NEAR[1] >= np.maximum(size[i + 1 :], size[i]) * NEAR[0])
        if across:
            keep &= part[i + 1 :] != part[i]
        j = np.flatnonzero(keep) + i + 1
        differ = np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64)
        j = j[(differ <= WIDE) | (np.minimum(size[j], size[i]) < SHORT)]
        if not len(j):
            continue
        mark[sets[i]] = True
        shared = np.add.reduceat(mark[np.concatenate([sets[k] for k in j])], np.cumsum(size[j]) - size[j], dtype=np.int64)
        mark[sets[i]] = False
        for k in j[shared * NEAR[1] >= (size[i] + size[j] - shared) * NEAR[0]]:
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                out.append((i, k))
    ends = node[np.array(out, np.int64).reshape(-1, 2)]
    return pa.table({"a": ends.max(axis=1), "b": ends.min(axis=1)})


def near_pairs(sets: DataFrame, family: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (a, b), a > b: near pairs that connect, of each family (node, component), what its near pairs connect."""
    members = sets.join(family, "node")
    counts = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("of"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("of") / SHINGLES))
    members = members.join(counts.select("component", blocks.alias("blocks")), "component").withColumn("part", F.pmod("node", "blocks"))
    each = members.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.select("component", F.least("part", "k").alias("x"), F.greatest("part", "k").alias("y"), "part", "node", "fp", "shingles")
    return each.groupBy("component", "x", "y").applyInArrow(_close, "a long, b long")


def classify(docs: DataFrame, small: int = SMALL, part: int = PART, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id and component_id, the smallest doc_id reached."""
    bounded(docs.sparkSession)
    prints = materialize(_prints(docs), "prints")
    family = components(links(prints.select("node", "fp").dropDuplicates(["node"]), small, part))
    reps = prints.groupBy("node").agg(F.min("doc_id").alias("rep"))
    sets = materialize(_sets(docs, reps.join(family, "node", "left_semi")), "sets")
    release(docs.sparkSession)
    label = components(near_pairs(sets, family, block))
    for table in (family, sets):
        discard(table)
    release(docs.sparkSession)
    reps = reps.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    return prints.select("doc_id", "node").join(reps.join(least, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays.

    Rows without an id cannot be told apart and stay; of rows that repeat an id and
    belong to one component, one stays.
    """
    found = classify(docs).filter(F.col("doc_id") != F.col("component_id"))
    gone = found.select(F.col("doc_id").alias("__id")).distinct()
    rows, own = numbered(docs), place(docs, "doc_id")
    out = rows.join(gone, rows[own].cast("long") == gone["__id"], "left_anti")
    ids = project(docs, doc_id="long").filter("doc_id is not null")
    if not ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = out.filter(F.col(own).isNotNull()).dropDuplicates([own]).unionByName(out.filter(F.col(own).isNull()))
    return out.toDF(*docs.columns)
