"""Language ID by segmentation-marginalised unigrams.

Each language gives every piece of a fixed public vocabulary a probability. The
probability of a word is the sum over all its segmentations into pieces of the
product of their probabilities (forward algorithm); a text's score is the product
over its words. Words are runs of letters (Unicode category L) and the marks (M) on
them, lower-cased, and start with the vocabulary's word mark. Probabilities are learned by EM from labelled documents.

Scale. The model is fitted on at most about DOCS_PER_LANG documents per language,
drawn by a hash of doc_id (a documented bound; whole texts); statistics for the
draw are counted over all documents. Scoring is one pass without a shuffle: the
distinct words of a batch are scored together in numpy. What goes to the
executors is one float per piece and language.

Defined results: null text, or one without a letter (numerals such as a half or a
circled one are none), is `und` with score 0; if no
labelled document can be learned from, every text is `und`; equal scores go to the
first language by name; a null doc_id is neither held out nor learned from;
repeated rows are predicted alike; other columns are ignored or, in `keep_known`,
carried.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import bounded, numbered, project, release, spread

UNDETERMINED = "und"
#: Bound of the training sample: expected documents per language.
DOCS_PER_LANG = 400
EM_ROUNDS = 4
SMOOTHING = 0.05
#: Words whose segmentations are summed together; bounds a worker's memory.
WORDS = 8_192
#: Documents under this posterior are rejected by keep_known.
LEAST_SCORE = 0.5

_MARK = "▁"


def _classes(*kinds: str, last: int = sys.maxunicode) -> str:
    """The characters whose Unicode category starts with one of kinds, as the inside of a character class."""
    own = [c for c in range(last + 1) if unicodedata.category(chr(c))[0] in kinds]
    first = [c for c, before in zip(own, [-2, *own], strict=False) if c != before + 1]
    ends = [c for c, after in zip(own, [*own[1:], -2], strict=True) if after != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, ends, strict=True))


#: Runs of letters and the marks that belong to them, with at least one letter; numerals are none.
_WORDS = re.compile(f"[{_classes('M')}]*[{_classes('L')}][{_classes('L', 'M')}]*")
#: The same runs in a text without marks, numerals that are no digits, and characters beyond the first plane.
_PLAIN_WORDS = re.compile(r"[^\W\d_]+")
_ODD = re.compile(f"[{_classes('M', 'N', last=0xFFFF).replace('0-9', '')}\U00010000-\U0010FFFF]")


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased."""
    text = text.lower()
    return (_WORDS if not text.isascii() and _ODD.search(text) else _PLAIN_WORDS).findall(text)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


@functools.cache
def vocabulary(model_file: str) -> tuple[str, ...]:
    """The pieces that lower-cased words can be cut into, in the vocabulary's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return tuple(p for p in plain if (p == _MARK or _WORDS.fullmatch(p.removeprefix(_MARK))) and p == p.lower() and _MARK not in p[1:])


class Pieces:
    """Finds every piece at every place of a batch of words, by rolling hashes of code points."""

    def __init__(self, pieces: tuple[str, ...]) -> None:
        self.count = len(pieces)  # the id after the last is that of a letter outside the vocabulary
        self.longest = max(map(len, pieces), default=1)
        self.table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == size], np.int64)
            if len(ids):
                points = np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64)
                h = np.zeros(len(ids), np.uint64)
                for k in range(size):
                    h = h * _STEP + points[:, k] + np.uint64(1)
                order = np.argsort(h)
                self.table[size] = (h[order], ids[order])
        self.filter = np.zeros(1 << _TABLE_BITS, bool)
        for h, _ in self.table.values():
            self.filter[self._slot(h)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * _STEP >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(self, words)


class Lattice:
    """All segmentations of a batch of words; slot start[w] + t stands before letter t of word w."""

    def __init__(self, pieces: Pieces, words: list[str]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1  # with the mark
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        joined = "".join(f"{_MARK}{words[i]}\n" for i in self.order.tolist())
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.slots = len(points)
        self.start = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1] if len(words) else np.empty(0, np.int64)
        self.unknown = pieces.count
        self.match: list[np.ndarray | None] = []
        h = np.zeros(self.slots, np.uint64)
        for size in range(1, pieces.longest + 1):
            n = self.slots - size + 1
            if n <= 0:
                break
            h = h[:n] * _STEP + points[size - 1 :] + np.uint64(1)
            found = np.full(self.slots, -1, np.int32)
            if size in pieces.table:
                hashes, ids = pieces.table[size]
                maybe = np.flatnonzero(pieces.filter[Pieces._slot(h)])
                at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                hit = hashes[at] == h[maybe]
                found[maybe[hit]] = ids[at[hit]]
            if size == 1:
                found[(found < 0) & (points != 10)] = self.unknown
            self.match.append(found if (found >= 0).any() else None)

    def _edges(self, t: int, active: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per piece length: the words (by rank), the slots and the pieces that end before letter t."""
        end = self.start[:active] + t
        for size in range(1, min(t, len(self.match)) + 1):
            if self.match[size - 1] is not None:
                piece = self.match[size - 1][end - size]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    yield hit, end[hit] - size, piece[hit]

    def forward(self, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward sums by slot, the logarithm of their scale by slot, and the log probability of each word (in the order given)."""
        langs = chance.shape[1]
        alpha = np.zeros((self.slots, langs))
        alpha[self.start] = 1
        scale = np.zeros((self.slots, langs))
        for t in range(1, int(self.sizes[0]) + 1 if len(self.sizes) else 0):
            active = int(np.searchsorted(-self.sizes, -t, side="right"))
            total = np.zeros((active, langs))
            for word, slot, piece in self._edges(t, active):
                total[word] += alpha[slot] * chance[piece]
            here = self.start[:active] + t
            alpha[here] = total
            scale[here] = scale[here - 1]
            if t % 16 == 0 and t >= 32:  # long words would underflow
                top = np.where(total > 0, total, 1.0)
                for back in range(min(t, len(self.match)) + 1):
                    alpha[here - back] /= top
                    scale[here - back] += np.log(top)
        out = np.empty((len(self.start), langs))
        with np.errstate(divide="ignore"):
            out[self.order] = np.log(alpha[self.start + self.sizes]) + scale[self.start + self.sizes]
        return alpha, scale, np.maximum(out, -1e6)

    def expected(self, chance: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts under chance; weight: word by language."""
        alpha, scale, _ = self.forward(chance)
        last = self.start + self.sizes
        beta = np.zeros_like(alpha)
        beta[last] = 1
        whole = scale[last]
        passed = np.zeros_like(whole)  # the logarithm of beta's scale at the place reached
        share = weight[self.order] / np.maximum(alpha[last], 1e-300)
        counts = np.zeros_like(chance)
        for t in range(int(self.sizes[0]) if len(self.sizes) else 0, 0, -1):
            active = int(np.searchsorted(-self.sizes, -t, side="right"))
            here = self.start[:active] + t
            if t % 16 == 0:
                top = np.where(beta[here] > 0, beta[here], 1.0)
                for back in range(min(t, len(self.match)) + 1):
                    beta[here - back] /= top
                passed[:active] += np.log(top)
            ends = beta[here]
            for word, slot, piece in self._edges(t, active):
                flow = chance[piece] * ends[word]
                level = np.exp(np.minimum(scale[slot] + passed[word] - whole[word], 700.0))
                np.add.at(counts, piece, alpha[slot] * flow * share[word] * level)
                beta[slot] += flow
        return counts


def fit(pieces: Pieces, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Piece probabilities by language from word counts (word by language), by EM."""
    langs = counts.shape[1]
    chance = np.full((pieces.count + 1, langs), 1.0 / (pieces.count + 1))
    for _ in range(EM_ROUNDS):
        sums = np.zeros_like(chance)
        for at in range(0, len(words), WORDS):
            sums += pieces.lattice(words[at : at + WORDS]).expected(chance, counts[at : at + WORDS])
        sums += SMOOTHING
        chance = sums / sums.sum(axis=0)
    return chance


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Model:
    """Languages, in name order, and the probability of each piece in each."""

    def __init__(self, langs: list[str], pieces: tuple[str, ...], chance: np.ndarray) -> None:
        self.langs, self.pieces, self.chance = langs, pieces, chance

    @functools.cached_property
    def finder(self) -> Pieces:
        return Pieces(self.pieces)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "finder"}

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        flat: list[int] = []
        sizes = []
        for text in texts:
            words = words_of(text) if text else []
            flat.extend([number[w] for w in words])
            sizes.append(len(words))
        # words of like length go together, a bounded number of them at a time
        names = sorted(number, key=len)
        logs = np.empty((len(names), len(self.langs)))
        for at in range(0, len(names), WORDS):
            part = names[at : at + WORDS]
            logs[[number[w] for w in part]] = self.finder.lattice(part).forward(self.chance)[2]
        size = np.array(sizes, np.int64)
        total = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(size)
        if len(full):
            starts = (np.cumsum(size) - size)[full]
            total[full] = np.add.reduceat(logs[np.array(flat, np.int64)], starts, axis=0)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        found = [self.langs[b] if n else UNDETERMINED for b, n in zip(best.tolist(), sizes, strict=True)]
        return found, np.where(size > 0, score, 0.0).tolist()


def train(docs: DataFrame, model_file: str, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Learn from documents with a lang and a text that are not held out."""
    bounded(docs.sparkSession)
    rows = project(docs, doc_id="long", text="string", lang="string")
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("doc_id").alias("n")).collect()}
    pieces = vocabulary(model_file)
    if not sizes:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    drawn = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, docs_per_lang / n))) for k, n in sizes.items()))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(seen.values(), pa.int64())],
            names=["lang", "word", "n"],
        )

    counted = (
        known.filter(chance < drawn[F.col("lang")])
        .select("text", "lang")
        .mapInArrow(count, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = sorted(set(counted.column("lang").to_pylist()))
    words = sorted(set(counted.column("word").to_pylist()))
    place, column = {w: i for i, w in enumerate(words)}, {k: i for i, k in enumerate(langs)}
    counts = np.zeros((len(words), len(langs)))
    for lang, word, n in zip(*(counted.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[place[word], column[lang]] = n
    del counted
    pa.default_memory_pool().release_unused()
    release(docs.sparkSession)
    return Model(langs, pieces, fit(Pieces(pieces), words, counts))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    bounded(docs.sparkSession)
    rows = spread(project(docs, doc_id="long", text="string")).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the texts whose language is undetermined or scores under least."""
    bounded(docs.sparkSession)
    rows, text = numbered(docs), docs.columns.index("text")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = model.predict(b.column(text).to_pylist())
            keep = [n != UNDETERMINED and s >= least for n, s in zip(langs, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns], names=names)

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
