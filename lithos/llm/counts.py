"""Edit-aware token counts: a segment tree of pre-token runs per document.

A text is cut into leaves of about LEAF characters at places where pre-tokens
certainly start, whatever stands farther off: before white space, after a single line
end, and where letters, numbers and symbols meet. A run of letters that is longer than four
leaves (a phrase in a script without spaces) is also cut between two letters that no
token of the vocabulary can span. No token spans such a place, so the document's count
is the sum over its leaves, kept in a segment tree together with the leaves' lengths.
An edit finds the leaves that it touches by descending the tree, takes in a neighbour
wherever the edit spoils the border to it (the boundary context), encodes that region
alone anew, and updates the sums above it. The tree has free places between its
leaves; where more leaves come in, the smallest subtree with room spreads its own.

Scale: one pass without a shuffle when edits come with the documents; edits in a
table of their own are joined by doc_id. A worker holds one document's tree at a
time beside its Arrow batch.

Defined results: null text counts as empty and has no tokens; edits are applied in
their order, each to the text as the ones before left it; positions count code
points and are clipped to the text, an end before its start counts as the start,
and null positions as 0; a null replacement deletes; null edits, or none, change
nothing; a null doc_id is carried (and has no edits in a join); repeated rows are
counted alike; other columns are ignored; an empty table gives an empty result. A run
of one kind of character without any border (letters of which all pairs occur in
tokens) is one leaf, however long.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import bounded, project, spread
from lithos.llm.tokens import Spans, read_ranks

#: Characters of a leaf, up to the next border.
LEAF = 256
#: Characters on either side of a place that tell whether it is a border.
CONTEXT = 4
# Where a pre-token of the byte-level pattern certainly starts.
_BORDER = regex.compile(
    r"(?<=\S)(?=\s)|(?<=\S[^\S ])(?=\S)|(?<=\s)(?=\s\S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
    r"|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=')(?=\p{N})"
)
# A place inside a run of letters, clear of contractions.
_INSIDE = regex.compile(r"(?<=\p{L})(?<!'.?)(?=\p{L})", regex.DOTALL)
EDITS = "array<struct<start:long,end:long,replacement:string>>"


class Borders:
    """Finds the places where a text can be cut without changing its tokens."""

    def __init__(self, ranks: Iterable[bytes]) -> None:
        self._spans = Spans(ranks)

    def _inside(self, run: str) -> list[int]:
        """The places in a text without borders where no token spans two letters."""
        data = run.encode()
        starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # of characters
        free = np.flatnonzero(~self._spans.of(data)[starts]).tolist()
        return [p for p in free if p and _INSIDE.match(run, p)]

    def leaves(self, text: str, size: int = LEAF) -> list[str]:
        """The text in leaves; only the last is shorter than size."""
        cuts = [0]
        while cuts[-1] < len(text):
            found = _BORDER.search(text, cuts[-1] + size)
            end = found.start() if found else len(text)
            if end - cuts[-1] > 4 * size:
                first = cuts[-1]
                for p in self._inside(text[first:end]):
                    if first + p >= cuts[-1] + size and end - first - p >= size:
                        cuts.append(first + p)
            cuts.append(end)
        return [text[a:b] for a, b in itertools.pairwise(cuts)]

    def between(self, left: str, right: str) -> bool:
        """Whether a text can be cut between its ends left and right, each of CONTEXT characters or as long as there are any."""
        both, at = left + right, len(left)
        if _BORDER.match(both, at):
            return True
        return bool(_INSIDE.match(both, at)) and not self._spans.of(both.encode())[len(left.encode())]


class CountTree:
    """Leaves of a text, and a segment tree of their lengths and token counts.

    Node n has the children 2n and 2n + 1; place p among the leaves is node width + p. An
    empty place has an empty leaf.
    """

    def __init__(self, text: str, count: Callable[[str], int], borders: Borders) -> None:
        self._count, self._borders = count, borders
        self.encoded_chars = 0
        self._build([(x, self._encode(x)) for x in borders.leaves(text)])

    def _encode(self, text: str) -> int:
        self.encoded_chars += len(text)
        return self._count(text)

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        """The sums over leaves and their counts, with as many free places; encodes nothing."""
        self._width = 1 << (2 * len(leaves)).bit_length()
        self._leaves = [""] * self._width
        self._chars, self._tokens, self._used = ([0] * (2 * self._width) for _ in range(3))
        self._spread(0, self._width, leaves)

    def _spread(self, low: int, size: int, leaves: list[tuple[str, int]]) -> None:
        """Put leaves evenly into the size places from low on, a whole subtree, and add up the sums in it and above it."""
        for p in range(low, low + size):
            self._leaves[p] = ""
            self._chars[self._width + p] = self._tokens[self._width + p] = self._used[self._width + p] = 0
        for k, (text, tokens) in enumerate(leaves):
            p = low + k * size // len(leaves)
            node = self._width + p
            self._leaves[p], self._chars[node], self._tokens[node], self._used[node] = text, len(text), tokens, 1
        first, last = self._width + low, self._width + low + size - 1
        while first > 1:
            first, last = first >> 1, last >> 1
            for node in range(first, last + 1):
                for sums in (self._chars, self._tokens, self._used):
                    sums[node] = sums[2 * node] + sums[2 * node + 1]

    @property
    def chars(self) -> int:
        return self._chars[1]

    @property
    def tokens(self) -> int:
        return self._tokens[1]

    @property
    def n_leaves(self) -> int:
        return self._used[1]

    def text(self) -> str:
        return "".join(self._leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The place of the leaf that holds character at (of the last leaf if at is the end), and at in it."""
        if at >= self.chars:
            p = self._end(1, 1)
            return p, len(self._leaves[p])
        node = 1
        while node < self._width:
            node *= 2
            if at >= self._chars[node]:
                at -= self._chars[node]
                node += 1
        return node - self._width, at

    def _end(self, node: int, side: int) -> int:
        """The place of the first (side 0) or last (side 1) leaf under a node that has any."""
        while node < self._width:
            node = 2 * node + side if self._used[2 * node + side] else 2 * node + 1 - side
        return node - self._width

    def _next(self, place: int, step: int) -> int | None:
        """The place of the leaf after (step 1) or before (step -1) a place."""
        node = self._width + place
        while node > 1 and (node % 2 == (step > 0) or not self._used[node + step]):
            node >>= 1
        return None if node == 1 else self._end(node + step, step < 0)

    def _context(self, text: str, place: int, step: int) -> str:
        """text, and as much of what lies before (step -1) or after it as CONTEXT asks for."""
        at: int | None = place
        while len(text) < CONTEXT and (at := self._next(at, step)) is not None:
            text = self._leaves[at] + text if step < 0 else text + self._leaves[at]
        return text[-CONTEXT:] if step < 0 else text[:CONTEXT]

    def replace(self, start: int, end: int, replacement: str) -> None:
        """Replace characters start to end; encodes only the leaves around them."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        if not self.n_leaves:
            self._build([(x, self._encode(x)) for x in self._borders.leaves(replacement)])
            return
        first, offset = self._find(start)
        last, past = self._find(end)
        region = self._leaves[first][:offset] + replacement + self._leaves[last][past:]
        while True:
            before, after = self._next(first, -1), self._next(last, 1)
            if before is not None and not self._holds(before, first, last, region, -1):
                first, region = before, self._leaves[before] + region
            elif after is not None and not self._holds(after, first, last, region, 1):
                last, region = after, region + self._leaves[after]
            else:
                break
        # as many leaves as before where that keeps them between half and four times their size
        one = first == last and 0 < len(region) <= 4 * LEAF
        self._put(first, last, [region] if one else self._borders.leaves(region))

    def _holds(self, neighbour: int, first: int, last: int, region: str, step: int) -> bool:
        """Whether the border between region, in the places first to last, and a neighbouring leaf is one."""
        if not region:
            return False
        own = region
        if len(region) < CONTEXT:  # what lies on the far side of a short region counts as well
            own = self._context(region, last if step < 0 else first, -step)
        far = self._context(self._leaves[neighbour], neighbour, step)
        return self._borders.between(far, own[:CONTEXT]) if step < 0 else self._borders.between(own[-CONTEXT:], far)

    def _put(self, first: int, last: int, new: list[str]) -> None:
        """Put new leaves into the places first to last, in the smallest subtree with room; leaves as they were are not encoded."""
        if first == last and len(new) == 1:
            if self._leaves[first] != new[0]:
                self._spread(first, 1, [(new[0], self._encode(new[0]))])
            return
        known = {self._leaves[p]: self._tokens[self._width + p] for p in range(first, last + 1) if self._leaves[p]}
        made = [(x, known[x] if x in known else self._encode(x)) for x in new]
        size = 1
        while True:
            low = first - first % size
            if last < low + size:
                around = [p for p in (*range(low, first), *range(last + 1, low + size)) if self._leaves[p]]
                if 4 * (len(around) + len(made)) <= 3 * size or (size == self._width and not around and not made):
                    break
                if size == self._width:
                    break
            size *= 2
        own = lambda ps: [(self._leaves[p], self._tokens[self._width + p]) for p in ps]
        leaves = [*own(p for p in around if p < first), *made, *own(p for p in around if p > last)]
        if 4 * len(leaves) <= 3 * size:
            self._spread(low, size, leaves)
        else:
            self._build(leaves)


@functools.cache
def counter(rank_file: str, pattern: str) -> Callable[[str], int]:
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(rank_file), special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


@functools.cache
def borders(rank_file: str) -> Borders:
    return Borders(read_ranks(rank_file))


def count(docs: DataFrame, rank_file: str, pattern: str, edits: Column | None = None) -> DataFrame:
    """Per document: its token count, the count after its edits, and how much of it was encoded anew.

    edits: a column expression over doc_id and text, of type EDITS. Returns doc_id,
    n_tokens, n_leaves, n_edits, n_tokens_after, n_chars_after, reencoded_chars.
    """
    bounded(docs.sparkSession)
    own = F.lit(None) if edits is None else edits
    rows = spread(project(docs, doc_id="long", text="string")).select("doc_id", "text", own.cast(EDITS).alias("edits"))
    return _counted(rows, rank_file, pattern)


def count_edited(docs: DataFrame, edits: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """As count, with edits in a table of their own: doc_id, seq (their order), start, end, replacement."""
    bounded(docs.sparkSession)
    own = project(edits, doc_id="long", seq="long", start="long", end="long", replacement="string").filter("doc_id is not null")
    listed = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
    rows = project(docs, doc_id="long", text="string").join(listed, "doc_id", "left")
    plain = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement")))
    return _counted(rows.select("doc_id", "text", plain.alias("edits")), rank_file, pattern)


_COLUMNS = ("n_tokens", "n_leaves", "n_edits", "n_tokens_after", "n_chars_after", "reencoded_chars")


def _counted(rows: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, own = counter(rank_file, pattern), borders(rank_file)
        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in _COLUMNS)
            for text, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tree = CountTree(text or "", encode, own)
                before, leaves, encoded = tree.tokens, tree.n_leaves, tree.encoded_chars
                todo = [e for e in edits or () if e is not None]
                for e in todo:
                    tree.replace(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                row = (before, leaves, len(todo), tree.tokens, tree.chars, tree.encoded_chars - encoded)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", *_COLUMNS])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _COLUMNS))


def revision() -> Column:
    """Edits that stand for a revision of a document, drawn from its checksum: a deletion, an insertion and a replacement."""
    size, sum_ = F.length("text"), F.crc32("text")
    at = lambda k: F.pmod(F.shiftright(sum_, k), size + 1).cast("long")
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("replacement"))
    return F.array(edit(at(0), at(0) + 40, ""), edit(at(7), at(7), " [edited] "), edit(at(13), at(13) + 12, "re-\nplaced"))
