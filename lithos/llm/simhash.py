"""SimHash near-dedup: fingerprints, a binary-trie self-join, connected components.

Fingerprint: A-Z of the text is lower-cased, words are runs of bytes other than
0x20 and 0x09-0x0D, shingles are `shingle` consecutive words joined by a space
(repeats count; with fewer words the whole sequence is the one shingle), each
hashed by XXH64 with seed 42. A bit is 1 if it is set in over half the hashes.
A text without words has fingerprint zero, linked like any other.

Links: distinct fingerprints that differ in at most `budget` bits. The 64 bits
are cut into 4 blocks of 16; two fingerprints within a budget of 2 agree on some
2 of the blocks, so each of the 6 block pairs deals the fingerprints into
buckets. A bucket above HOT fingerprints is dealt again by the same rule on the
32 bits that it leaves open, after which it holds at most 2^16. In a bucket a
binary trie is joined with itself: node pairs go down together, differing bits
add up, and a pair over the budget is pruned. Of each bucket's links only a
spanning forest is sent on, so edges grow with the fingerprints, not with pairs.

Components: alternating large-star and small-star steps, each written to the
shared folder, until the edges no longer change; up to FEW edges are joined by one
task instead.

Copies meet before the join: it runs over distinct fingerprints, and a component's
smallest doc_id is looked up afterwards, so any 64-bit id can stand there.

Defined results: null text is a text without words; rows that repeat a doc_id are
documents of their own and each give a row; a row with a null doc_id gets a
component_id like any other, which is null only if no row of its component has an
id; other columns are ignored or, in `keep_one`, carried; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import bounded, discard, materialize, numbered, place, project, spread, u64_hex
from lithos.llm.wordhash import word_spans

SHINGLE = 3
BUDGET = 2
SEED = 42
#: A bucket of more fingerprints is dealt again by the bits that it leaves open.
HOT = 1024
#: Edges that one task joins; they take 16 bytes each.
FEW = 1 << 20
#: Fingerprints whose tries are joined in one go.
_TOGETHER = 1 << 16
_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned 64-bit integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(data, SEED)
    starts, ends = word_spans(data)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter(
        [digest(data[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64, n
    )
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the bit matrix of a very long text
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp): fp holds the 64 bits as a signed long."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return spread(project(docs, doc_id="long", text="string")).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(values: np.ndarray, groups: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of values in one group that differ in at most budget bits.

    values: uint64, sorted and distinct inside each group; groups: the offsets where
    groups start, and the end. All groups' tries are joined level by level together.
    """
    sizes = np.diff(groups)
    a0 = b0 = groups[:-1][sizes > 1]
    a1 = b1 = groups[1:][sizes > 1]
    differ = np.zeros(len(a0), np.int8)
    left, right = [], []
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        a_mid, b_mid = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        twin = a0 == b0
        other = ~twin
        # (zeros, zeros), (ones, ones), (zeros, ones) and, for a pair of two nodes, (ones, zeros)
        parts = (
            (a0, a_mid, b0, b_mid, differ),
            (a_mid, a1, b_mid, b1, differ),
            (a0, a_mid, b_mid, b1, differ + 1),
            (a_mid[other], a1[other], b0[other], b_mid[other], differ[other] + 1),
        )
        a0, a1, b0, b1, differ = (np.concatenate(x) for x in zip(*parts, strict=True))
        alone = (a0 == b0) & (a1 - a0 < 2)
        keep = (a1 > a0) & (b1 > b0) & (differ <= budget) & ~alone
        a0, a1, b0, b1, differ = (x[keep] for x in (a0, a1, b0, b1, differ))
        # two leaves: the bits below are compared at once
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            left.append(i[near])
            right.append(j[near])
            a0, a1, b0, b1, differ = (x[~leaf] for x in (a0, a1, b0, b1, differ))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    return np.minimum(i, j), np.maximum(i, j)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node that the links (i, j) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            return label
        label = new


def _bits(fp: Column, block: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, block * width).bitwiseAND(F.lit((1 << width) - 1))


def _deal(fp: Column, width: int) -> Column:
    """The six (block pair, their bits) keys of a fingerprint's four blocks of that width."""
    block = [_bits(fp, k, width) for k in range(4)]
    return F.array(*[F.struct(F.lit(n).alias("n"), (block[i] * (1 << width) + block[j]).alias("bits")) for n, (i, j) in enumerate(_PAIRS)])


def _open_bits(fp: Column, pair: Column) -> Column:
    """The 32 bits outside a block pair."""
    out = None
    for n, (i, j) in enumerate(_PAIRS):
        k, m = (x for x in range(4) if x not in (i, j))
        bits = _bits(fp, k, 16) * (1 << 16) + _bits(fp, m, 16)
        out = F.when(pair == n, bits) if out is None else out.when(pair == n, bits)
    return out


def links(classes: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """Rows (a, b), a > b: links between fingerprints that connect what the budget connects.

    classes: distinct fingerprints (fp). Needs budget <= 2.
    """
    if not 0 <= budget <= 2:
        raise ValueError("the block scheme holds for at most 2 differing bits")
    dealt = classes.select("fp", F.explode(_deal(F.col("fp"), 16)).alias("k")).select("fp", F.col("k.n").alias("n"), F.col("k.bits").alias("bits"))
    counts = dealt.groupBy("n", "bits").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    once = F.array(F.struct(F.lit(-1).alias("n"), F.lit(0).cast("long").alias("bits")))
    again = F.when(F.col("size") > hot, _deal(_open_bits(F.col("fp"), F.col("n")), 8)).otherwise(once)
    buckets = (
        dealt.join(counts, ["n", "bits"])
        .select("fp", "n", "bits", F.explode(again).alias("m"))
        .groupBy("n", "bits", "m")
        .agg(F.collect_list("fp").alias("members"))
        .filter(F.size("members") > 1)
        .select("members")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = 0
            while at < len(offsets) - 1:
                to = max(int(np.searchsorted(offsets, offsets[at] + _TOGETHER, side="right")) - 1, at + 1)
                groups = offsets[at : to + 1] - offsets[at]
                owner = np.repeat(np.arange(to - at), np.diff(groups))
                fps = flat[offsets[at] : offsets[to]]
                fps = fps[np.lexsort((fps, owner))]
                label = spanning(len(fps), *trie_pairs(fps, groups, budget))
                far = np.flatnonzero(label != np.arange(len(fps)))
                a, c = fps.view(np.int64)[far], fps.view(np.int64)[label[far]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, c)), pa.array(np.minimum(a, c))], names=["a", "b"])
                at = to

    return buckets.mapInArrow(join, "a long, b long").distinct()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Rows (node, component) for every node of edges (a, b), the smallest included: component is the smallest node reached.

    Alternates large-star and small-star; each round's edges are written to the shared
    folder, so a lost executor costs at most one round. Up to `few` edges are joined by one task.
    """

    def seal(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = materialize(df, "edges")
        return out, tuple(out.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if ends:
            a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
            nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            label = spanning(len(nodes), at[: len(a)], at[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])

    edges, mark = seal(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if mark[0] <= few:
        out = materialize(edges.coalesce(1).mapInArrow(join, "node long, component long"), "components")
        discard(edges)
        return out
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: every larger neighbour of a node moves to the node's least neighbour
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, now = seal(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        discard(edges)
        edges, before, mark = after, mark, now
        if mark == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def classify(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reached)."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    if budget:
        found = components(links(prints.select("fp").distinct(), budget))
        members = classes.join(found, classes["fp"] == found["node"])
        least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
        linked = found.join(least, "component").select("node", "component_id")
        classes = classes.join(linked, classes["fp"] == linked["node"], "left")
        classes = classes.select("fp", F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    else:
        classes = classes.withColumnRenamed("rep", "component_id")
    return prints.join(classes, "fp").select("doc_id", u64_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays.

    Rows without an id cannot be told apart and stay; of rows that repeat an id and
    belong to one component, one stays.
    """
    found = classify(docs, shingle, budget).filter(F.col("doc_id") != F.col("component_id"))
    gone = found.select(F.col("doc_id").alias("__id")).distinct()
    rows, own = numbered(docs), place(docs, "doc_id")
    out = rows.join(gone, rows[own].cast("long") == gone["__id"], "left_anti")
    ids = project(docs, doc_id="long").filter("doc_id is not null")
    if not ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = out.filter(F.col(own).isNotNull()).dropDuplicates([own]).unionByName(out.filter(F.col(own).isNull()))
    return out.toDF(*docs.columns)
