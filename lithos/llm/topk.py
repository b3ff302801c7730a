"""Exact top-k search by a bit-sliced index.

Vectors are quantised to floor(SCALE * x). The index holds blocks of rows: for
each dimension the least value of the block and, bit by bit, a bitmap (slice) of
the rows whose value above that least has the bit set. A query's scores over a
block are added up with bitmap arithmetic: every slice that a query component
touches is put at its weight, and carry-save adders reduce the bitmaps of each
weight to one, which gives the scores as slices too. The top rows are then chosen
from the most significant slice downward: rows that have a bit where enough
others have it stay, until the boundary value is known; of the rows at the
boundary those with the smallest ids fill up the rest, exactly.

Scale. The query set is a stated share of the rows and meets them in blocks, not
in a cross join: index blocks and query blocks are dealt by (index block, query
part), so a task holds one index block and one part of the queries, both of
bounded size. With few index blocks the queries are split into more parts to fill
the cores. Per query and block only k rows go on, and Spark ranks those.

Defined results: a vector that is null or holds a null or non-finite component takes
no part, nor does a row with a null id; empty vectors meet each other with score 0;
rows that repeat an id are rows of their own, as queries and as candidates, alike or
not (rows alike in id and vector are counted, not repeated, until the end; vectors of
one id are told apart by 128 bits of BLAKE2 where results are ranked); a component
beyond 64 bits after scaling counts as the nearest 64-bit integer; scores are added up
in as many slices as they need, and one beyond 64 bits is given, and ranked among
blocks, as the nearest 64-bit integer; a query only meets rows of its own dimension;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.common import bounded, project

K = 20
SCALE = 64
QUERY_STEP = 20
#: Rows of an index block and queries of a query block.
BLOCK_ROWS = 1 << 15
QUERY_ROWS = 1 << 6
#: Most queries of a part.
PART_QUERIES = 1 << 16
#: Tasks the dealing aims at when there are few index blocks.
TASKS = 24


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, v, copies): floor(scale * x) of each component, and how many rows are alike; rows that take no part are left out."""
    rows = project(vectors, vec_id="long", embedding="array<double>")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))


def build(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Slices of a block: the least value of each dimension, and per dimension a (bits, words) array of bitmaps."""
    low = values.min(axis=0)
    above = values.view(np.uint64) - low.view(np.uint64)  # modulo 2^64, so right for every range
    pad = -len(ids) % 64
    slices = []
    for d in range(values.shape[1]):
        column = above[:, d]
        width = int(column.max()).bit_length()
        bits = (column[None, :] >> np.arange(width, dtype=np.uint64)[:, None]) & np.uint64(1)
        packed = np.packbits(np.pad(bits.astype(np.uint8), ((0, 0), (0, pad))), axis=1, bitorder="little")
        slices.append(np.ascontiguousarray(packed).view(np.uint64))
    return low, slices


def scores(query: np.ndarray, low: np.ndarray, slices: list[np.ndarray], words: int) -> tuple[list[np.ndarray], int]:
    """Slices of the scores of all rows of a block, least significant first, and the constant to add to them.

    A negative component -q on slices of width b is q on the complements: -q * x = q * (2^b - 1 - x) - q * (2^b - 1).
    """
    constant = sum(q * x for q, x in zip(query.tolist(), low.tolist(), strict=True))
    at: list[list[np.ndarray]] = []
    for q, part in zip(query.tolist(), slices, strict=True):
        if not q or not len(part):
            continue
        if q < 0:
            q = -q
            part = ~part
            constant -= q * ((1 << len(part)) - 1)
        shift = 0
        while q:
            if q & 1:
                while len(at) < shift + len(part):
                    at.append([])
                for k in range(len(part)):
                    at[shift + k].append(part[k])
            q >>= 1
            shift += 1
    out = []
    weight = 0
    while weight < len(at):
        column = at[weight]
        if weight + 1 == len(at) and len(column) > 1:
            at.append([])
        stack = np.stack(column) if column else np.zeros((1, words), np.uint64)
        while len(stack) > 1:  # carry-save adders: three bitmaps of a weight to one of it and one of the next
            n = len(stack) // 3
            if n:
                a, b, c = stack[: 3 * n : 3], stack[1 : 3 * n : 3], stack[2 : 3 * n : 3]
                both = a ^ b
                total, carry = both ^ c, (a & b) | (both & c)
            else:
                n, total, carry = 1, stack[:1] ^ stack[1:2], stack[:1] & stack[1:2]
                stack = stack[2:]
                at[weight + 1].extend(carry)
                stack = np.concatenate((total, stack))
                continue
            at[weight + 1].extend(carry)
            stack = np.concatenate((total, stack[3 * n :]))
        out.append(stack[0])
        weight += 1
    return out, constant


def select(score: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k highest scores of the rows in the bitmap among; ties to the smaller row number."""
    sure = np.zeros_like(among)
    tied = among
    for part in reversed(score):
        have = tied & part
        n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(have).sum())
        if n > k:
            tied = have
        else:
            sure = sure | have
            tied = tied & ~part
            if n == k:
                tied = np.zeros_like(tied)
                break

    def rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    first = rows(sure)
    return np.concatenate((first, rows(tied)[: k - len(first)]))


def _values(score: list[np.ndarray], rows: np.ndarray, constant: int) -> list[int]:
    """The scores of some rows, exactly."""
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    out = [constant] * len(rows)
    for weight, part in enumerate(score):
        for k in np.flatnonzero((part[word] >> bit) & np.uint64(1)).tolist():
            out[k] += 1 << weight
    return out


def _packed(values: np.ndarray) -> bytes:
    """Integers in the narrowest of 1, 2, 4 and 8 bytes that holds them all."""
    kinds = (k for k in ("<i1", "<i2", "<i4") if not values.size or (values.min() >= np.iinfo(k).min and values.max() <= np.iinfo(k).max))
    return values.astype(next(kinds, "<i8")).tobytes()


def _unpacked(raw: bytes, rows: int, dims: int) -> np.ndarray:
    width = len(raw) // max(1, rows * dims)
    return np.frombuffer(raw, f"<i{width or 1}").reshape(rows, dims).astype(np.int64)


def _blocks(rows: DataFrame, number: Column, name: str) -> DataFrame:
    """Rows gathered into blocks: (name, dims, ids, v, copies); ids ascending, v the values row by row."""

    def gather(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v = np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in table.column("v")]).reshape(len(ids), -1)
        packed = (ids[order].astype("<i8").tobytes(), _packed(v[order]), _packed(table.column("copies").to_numpy()[order]))
        return pa.table({
            name: table.column("n")[:1].combine_chunks(), "dims": pa.array([v.shape[1]], pa.int32()),
            **{k: pa.array([x], pa.binary()) for k, x in zip(("ids", "v", "copies"), packed, strict=True)},
        })

    dealt = rows.select(number.alias("n"), F.size("v").alias("dims"), "vec_id", "v", "copies")
    return dealt.groupBy("n", "dims").applyInArrow(gather, f"{name} long, dims int, ids binary, v binary, copies binary")


def _own(ids: np.ndarray, values: np.ndarray, name: int, query: np.ndarray) -> int:
    """The row of a block that is the query itself, or -1."""
    first, past = np.searchsorted(ids, name), np.searchsorted(ids, name, side="right")
    same = np.flatnonzero((values[first:past] == query).all(axis=1))
    return int(first + same[0]) if len(same) else -1


def search(vectors: DataFrame, is_query: Column | None = None, k: int = K, scale: int = SCALE) -> DataFrame:
    """For each query row its k highest inner products with other rows: query_id, rank, vec_id, score.

    is_query: a condition on vec_id; by default ids divisible by QUERY_STEP.
    """
    bounded(vectors.sparkSession)
    is_query = F.col("vec_id") % QUERY_STEP == 0 if is_query is None else is_query
    rows = quantised(vectors, scale)
    total = project(vectors, vec_id="long").count()
    index_blocks = max(1, -(-total // BLOCK_ROWS))
    parts = max(1, -(-TASKS // index_blocks), -(-total // (QUERY_STEP * PART_QUERIES)))
    row_block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(index_blocks))
    query_block = F.pmod(F.xxhash64("vec_id", "v", F.lit("q")), F.lit(max(parts, -(-total // (QUERY_STEP * QUERY_ROWS)))))
    index = _blocks(rows, row_block, "block").select(
        "block", "dims", F.col("ids").alias("row_ids"), F.col("v").alias("rows"), F.col("copies").alias("row_copies")
    )
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = _blocks(rows.filter(is_query), query_block, "query_block").select(
        "dims", F.col("ids").alias("query_ids"), F.col("v").alias("queries"), F.col("copies").alias("query_copies"),
        (F.col("query_block") % parts).cast("int").alias("part"),
    )
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index_blocks - 1).cast("long"))))

    def run(block: pa.Table, part: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("query_id", "query", "query_copies", "vec_id", "score", "copies")}
        if block.num_rows and part.num_rows:
            ids = np.frombuffer(block.column("row_ids")[0].as_py(), "<i8")
            dims = block.column("dims")[0].as_py()
            values = _unpacked(block.column("rows")[0].as_py(), len(ids), dims)
            copies = _unpacked(block.column("row_copies")[0].as_py(), len(ids), 1)[:, 0]
            low, slices = build(ids, values)
            words = -(-len(ids) // 64)
            real = np.full(words, np.uint64(0xFFFFFFFFFFFFFFFF))
            if len(ids) % 64:
                real[-1] = np.uint64((1 << (len(ids) % 64)) - 1)
            for names, packed, many in zip(*(part.column(c).to_pylist() for c in ("query_ids", "queries", "query_copies")), strict=True):
                query_ids = np.frombuffer(names, "<i8")
                own_copies = _unpacked(many, len(query_ids), 1)[:, 0].tolist()
                for name, query, alike in zip(query_ids.tolist(), _unpacked(packed, len(query_ids), dims), own_copies, strict=True):
                    among = real.copy()
                    own = _own(ids, values, name, query)
                    if own >= 0 and alike == 1:  # of rows that are alike, each still meets the others
                        among[own >> 6] &= ~np.uint64(1 << (own & 63))
                    total, constant = scores(query, low, slices, words)
                    top = select(total, among, k)
                    out["query_id"].extend([name] * len(top))
                    out["query"].extend([hashlib.blake2b(query.tobytes(), digest_size=16).digest()] * len(top))
                    out["query_copies"].extend([alike] * len(top))
                    out["vec_id"].extend(ids[top].tolist())
                    out["score"].extend([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in _values(total, top, constant)])
                    out["copies"].extend([min(int(copies[t]) - (t == own), k) for t in top.tolist()])
        kinds = {"query": pa.binary()}
        return pa.table({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in out.items()})

    keys = ("block", "part", "dims")
    found = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(
        run, "query_id long, query binary, query_copies long, vec_id long, score long, copies long"
    )
    best = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    ranked = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    alike = F.explode(F.sequence(F.lit(1).cast("long"), F.col("query_copies")))
    return ranked.select("query_id", "rank", "vec_id", "score", alike.alias("alike")).drop("alike")
