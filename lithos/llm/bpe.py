"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

A text is split into words by the pattern. The bytes of each distinct unseen word
become rows (word, position, token) of a DuckDB table; a recursive query joins
neighbouring rows with the merge table and contracts the leftmost pair of least
rank of every word until no word changes. Ordered aggregation over the rows of
the fixpoint gives a word's ids and, joined with the vocabulary, its decoded bytes.

A recursive query keeps the rows of all its steps, which a long word would make
grow with the square of its length, so words above PLAIN bytes are taken apart first.
They are cut wherever no token of the vocabulary, as it would lie in the text, spans
the place: no contraction can cross it. What is still above LONG bytes (letters
without rhyme, encoded data) is contracted in blocks that overlap by half, and the
blocks are joined at a place in the overlap where both have a token border and the
two tokens beside it, contracted as one word, stay two tokens. A sequence of tokens of
which each neighbouring pair stays as it is under contraction is the contraction of
the whole. If there is no such place the blocks grow, up to the whole word; blocks
above LONG take the step as a statement over all of them that replaces their table.

Scale: one pass without a shuffle. Memory is bounded by the Arrow batch, the cache
of CACHE chunks, and DuckDB's memory limit.

Defined results: null text counts as empty; an empty text has no ids (n_tokens 0,
digests of the empty string); words of any length and script take time in proportion
to their length; a null doc_id is carried; repeated rows give equal rows; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lithos.llm.common import bounded, project, spread
from lithos.llm.tokens import Generations, Spans, cut, read_ranks, tails_of

#: Words above this many bytes are cut where no token can span.
PLAIN = 24
#: Most bytes of a word in a recursive query.
LONG = 64
#: Bytes of the first blocks of a longer word.
BLOCK = 32
#: Chunks and words in each of the two generations that a worker keeps.
CACHE = 450_000
#: Words in one recursive query.
WORDS = 40_000
MEMORY = "400MB"

#: One step for long words: the rows of tokens (word, pos, tok) after contraction; done if nothing in the word changes any more.
_STEP = """
    SELECT w, pos, CASE WHEN here THEN m ELSE tok END AS tok, least IS NULL AS done
    FROM (
        SELECT *, coalesce(lag(here) OVER (PARTITION BY w ORDER BY pos), false) AS eaten
        FROM (
            -- of places that overlap (a run of one token), every second one from the left is contracted
            SELECT *, hit AND (l <> r OR (row_number() OVER (PARTITION BY w, hit, island ORDER BY pos)) % 2 = 1) AS here
            FROM (
                SELECT *, idx - row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS island
                FROM (
                    SELECT *, coalesce(m = min(m) OVER (PARTITION BY w), false) AS hit, min(m) OVER (PARTITION BY w) AS least
                    FROM (
                        SELECT w, pos, tok,
                            lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt,
                            row_number() OVER (PARTITION BY w ORDER BY pos) AS idx
                        FROM tokens
                    ) p LEFT JOIN merges ON l = tok AND r = nxt
                )
            )
        )
    ) WHERE NOT eaten
"""

#: The place of a row: word << 7 | position, so a word of up to LONG bytes fits.
_RECURSIVE = """
    WITH RECURSIVE steps(n, id, tok, next_id) AS (
        SELECT 0::UTINYINT, id, tok, next_id FROM tokens
        UNION ALL (
            WITH pairs AS (
                SELECT a.n, a.id, a.tok, a.next_id, b.next_id AS after_id, m
                FROM steps a LEFT JOIN steps b ON b.id = a.next_id LEFT JOIN merges ON l = a.tok AND r = b.tok
            ), best AS (  -- rank, position and next position of each word's leftmost pair of least rank
                SELECT id >> 7 AS w, min((m::BIGINT << 32) | ((id & 127) << 8) | (next_id & 127)) AS k
                FROM pairs WHERE m IS NOT NULL GROUP BY ALL
            )
            SELECT
                (n + 1)::UTINYINT, id,
                CASE WHEN (id & 127) = ((k >> 8) & 127) THEN (k >> 32)::INTEGER ELSE tok END,
                CASE WHEN (id & 127) = ((k >> 8) & 127) THEN after_id ELSE next_id END
            FROM pairs JOIN best ON w = id >> 7 WHERE (id & 127) <> (k & 127)
        )
    ), fixpoint AS (SELECT id >> 7 AS w, max(n) AS n FROM steps GROUP BY ALL)
    SELECT w, string_agg(tok::VARCHAR, ' ' ORDER BY s.id) AS ids, string_agg(bytes, '' ORDER BY s.id) AS bytes
    FROM steps s JOIN fixpoint f ON f.w = s.id >> 7 AND f.n = s.n JOIN vocabulary v ON v.id = tok
    GROUP BY w ORDER BY w
"""

_FIXPOINT = """
    SELECT w, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS ids, string_agg(bytes, '' ORDER BY pos) AS bytes
    FROM tokens JOIN vocabulary v ON v.id = tok GROUP BY w ORDER BY w
"""


class Codec:
    """A worker's DuckDB database with merge table and vocabulary, and its cache of encoded chunks."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        import duckdb
        import regex

        ranks = read_ranks(rank_file)
        # every way to cut a token into two tokens: joined, two tokens give the token with their bytes
        merges = [(ranks[t[:k]], ranks[t[k:]], id_) for t, id_ in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._split = regex.compile(pattern).findall
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        left, right, merged = (np.array(c, np.int32) for c in zip(*merges, strict=True))
        table = pa.table({"l": left, "r": right, "m": merged})
        names = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array([t.hex() for t in ranks])})
        self._db.register("t", table)
        self._db.execute("CREATE TABLE merges AS SELECT * FROM t")
        self._db.register("t", names)
        self._db.execute("CREATE TABLE vocabulary AS SELECT * FROM t")
        self._cache, self._words, self._parts = Generations(CACHE), Generations(CACHE), Generations(CACHE)
        self._tokens = {id_: t for t, id_ in ranks.items()}
        self._spans = Spans(ranks)

    def _rows(self, words: list[bytes]) -> pa.Table:
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        w = np.repeat(np.arange(len(words), dtype=np.int64), size)
        pos = np.arange(len(raw)) - np.repeat(first, size)
        last = np.zeros(len(raw), bool)
        last[first + size - 1] = True
        place = w << 7 | pos
        return pa.table({"w": w, "pos": pos, "tok": self._bytes[raw], "id": place, "next_id": pa.array(place + 1, mask=last)})

    def _query(self, sql: str) -> list[tuple[str, str]]:
        found = self._db.sql(sql).to_arrow_table()
        return list(zip(found.column("ids").to_pylist(), found.column("bytes").to_pylist(), strict=True))

    def _cut(self, word: bytes) -> list[bytes]:
        """The word cut wherever no token can span."""
        spanned = self._spans.of(word)
        cuts = [0, *(np.flatnonzero(~spanned[1:-1]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in itertools.pairwise(cuts)]

    def _contract(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Each word's ids in decimal, a space before each, and its bytes as decoded from the ids."""
        cut = [[w] if len(w) <= PLAIN else self._cut(w) for w in words]
        parts = {p for ps in cut if len(ps) > 1 for p in ps}
        known = self._parts.fetch(parts, self._contract_parts) if parts else {}
        whole = [ps[0] for ps in cut if len(ps) == 1]
        found = dict(zip(whole, self._contract_parts(whole), strict=True))
        out = [found[ps[0]] if len(ps) == 1 else tuple(b"".join(x) for x in zip(*map(known.__getitem__, ps), strict=True)) for ps in cut]
        self._parts.drop_long()
        return out

    def _contract_parts(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        out: dict[bytes, tuple[bytes, bytes]] = {}
        short = sorted((w for w in words if len(w) <= LONG), key=len)  # words of a query need about as many steps
        for at in range(0, len(short), WORDS):
            part = short[at : at + WORDS]
            self._db.register("tokens", self._rows(part))
            out.update(zip(part, self._joined(self._query(_RECURSIVE)), strict=True))
        long = [w for w in words if len(w) > LONG]
        if long:
            ids = self._contract_long(long)
            size = list(map(len, ids))
            rows = {"w": np.repeat(np.arange(len(long)), size), "pos": np.arange(sum(size)), "tok": np.concatenate(ids)}
            self._db.register("tokens", pa.table(rows))
            out.update(zip(long, self._joined(self._query(_FIXPOINT)), strict=True))
        return [out[w] for w in words]

    @staticmethod
    def _joined(found: list[tuple[str, str]]) -> list[tuple[bytes, bytes]]:
        return [(f" {ids}".encode(), bytes.fromhex(raw)) for ids, raw in found]

    def _ids(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """The ids of distinct words, each contracted as a whole."""
        short, long = [w for w in words if len(w) <= LONG], [w for w in words if len(w) > LONG]
        out = {w: list(map(int, ids.split())) for w, (ids, _) in zip(short, self._contract_parts(short), strict=True)}
        for at in range(0, len(long), WORDS):
            part = long[at : at + WORDS]
            tokens = self._rows(part).select(["w", "pos", "tok"])
            while tokens.num_rows:
                self._db.register("tokens", tokens)
                after = self._db.sql(_STEP).to_arrow_table()
                done = after.filter(after.column("done")).sort_by([("w", "ascending"), ("pos", "ascending")])
                w, ids = done.column("w").to_numpy(), done.column("tok").to_numpy()
                cuts = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1).tolist(), len(w)] if len(w) else []
                out.update((part[w[a]], ids[a:b].tolist()) for a, b in itertools.pairwise(cuts))
                tokens = after.filter(pc.invert(after.column("done"))).select(["w", "pos", "tok"])
        return out

    def _contract_long(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words by blocks that overlap by half, joined where two tokens stay apart."""
        out: dict[bytes, list[int]] = {}
        size, left = BLOCK, list(dict.fromkeys(words))
        while left:
            blocks = {w: [w[a : a + size] for a in range(0, max(1, len(w) - size // 2), size // 2)] for w in left}
            found = self._ids(list({b for bs in blocks.values() for b in bs}))
            # candidates for each seam: place in the right block, number of tokens before it in both, the two tokens
            seams: dict[tuple[bytes, int], list[tuple[int, int, bytes, bytes]]] = {}
            for w, bs in blocks.items():
                for k in range(len(bs) - 1):
                    a, b = found[bs[k]], found[bs[k + 1]]
                    ends = {e - size // 2: i + 1 for i, e in enumerate(itertools.accumulate(len(self._tokens[t]) for t in a))}
                    near = [(e, ends[e], j) for j, e in enumerate(itertools.accumulate((len(self._tokens[t]) for t in b), initial=0)) if 0 < e < size // 2 and e in ends]
                    near.sort(key=lambda x: abs(x[0] - size // 4))
                    seams[w, k] = [(i, j, self._tokens[a[i - 1]], self._tokens[b[j]]) for _, i, j in near]
            apart: dict[tuple[bytes, bytes], bool] = {}
            chosen: dict[tuple[bytes, int], tuple[int, int]] = {}
            turn = 0
            while open_ := [s for s in seams if s not in chosen and len(seams[s]) > turn]:
                asked = {seams[s][turn][2:] for s in open_} - apart.keys()
                both = self._ids(list({x + y for x, y in asked}))
                apart.update((p, [self._tokens[t] for t in both[p[0] + p[1]]] == list(p)) for p in asked)
                chosen.update((s, seams[s][turn][:2]) for s in open_ if apart[seams[s][turn][2:]])
                turn += 1
            again = []
            for w, bs in blocks.items():
                if any((w, k) not in chosen for k in range(len(bs) - 1)):
                    again.append(w)
                    continue
                cuts = [chosen[w, k] for k in range(len(bs) - 1)]
                starts, ends = [0, *(j for _, j in cuts)], [*(i for i, _ in cuts), None]
                out[w] = [t for b, x, y in zip(bs, starts, ends, strict=True) for t in found[b][x:y]]
            left, size = again, size * 4
        return [out[w] for w in words]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Each text's ids in decimal, a space before each, and its decoded bytes."""
        pieces = list(map(cut, texts))
        tails = tails_of(pieces)
        known = self._cache.fetch(tails, lambda todo: self._chunks([" " + p for p in todo]))
        heads = self._chunks([ps[0] for ps in pieces])
        out = []
        for head, ps in zip(heads, pieces, strict=True):
            both = [head, *[known[p] for p in ps[1:]]]
            out.append((b"".join([x for x, _ in both]), b"".join([y for _, y in both])))
        self._cache.drop_long()
        return out

    def _chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        split = [[w.encode() for w in self._split(c)] for c in chunks]
        found = self._words.fetch({w for ws in split for w in ws}, self._contract)
        out = [found[ws[0]] if len(ws) == 1 else (b"".join([found[w][0] for w in ws]), b"".join([found[w][1] for w in ws])) for ws in split]
        self._words.drop_long()
        return out


@functools.cache
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256, and ids and decoded.

    ids are decimal, joined by a space; decoded is their bytes. Without with_ids both are null.
    """
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for ids, decoded in own.encode([x or "" for x in b.column(1).to_pylist()]):
                row = (
                    ids.count(b" "), hashlib.sha256(ids[1:]).hexdigest(), hashlib.sha256(decoded).hexdigest(),
                    ids[1:].decode() if with_ids else None, decoded if with_ids else None,
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
            )

    return spread(project(docs, doc_id="long", text="string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string, decoded binary"
    )


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per row of (doc_id, ids in decimal joined by a space): doc_id and decoded bytes.

    Token rows (document, position, id) join the vocabulary in DuckDB; an aggregation
    ordered by position joins their bytes. Null or empty ids decode to no bytes; an id
    outside the vocabulary is a ValueError.
    """
    bounded(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                ids = np.array((text or "").split(), np.int32)
                own._db.register("given", pa.table({"pos": np.arange(len(ids)), "tok": ids}))
                n, raw = own._db.execute(
                    "SELECT count(bytes), coalesce(string_agg(bytes, '' ORDER BY pos), '') FROM given JOIN vocabulary ON id = tok"
                ).fetchall()[0]
                if n != len(ids):
                    raise ValueError("an id is not in the vocabulary")
                out.append(bytes.fromhex(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return project(encoded, doc_id="long", ids="string").mapInArrow(run, "doc_id long, decoded binary")
