"""Token ids of whole texts by a tokenizer file of a public byte-level BPE vocabulary.

A text is cut at each single space between two characters that are not white
space; such a space always starts a pre-token, so the cut is exact. The chunks
of a text are looked up in a cache, and only unseen ones are encoded.
"""

from __future__ import annotations

import array
import base64
import functools
import os
import re
import sys
from collections.abc import Callable, Iterable

import numpy as np

#: Chunks that a worker keeps, or in each of the two generations; characters count as well, 16 for a chunk.
CACHE = 400_000
#: Chunks encoded as one text.
JOINED = 2048
#: Chunks looked up at a time.
TOGETHER = 1 << 18
#: Longer chunks are encoded each time.
CACHED_CHUNK = 64
# A space beside white space or at an end of the text.
_ODD = re.compile(r" (?:(?=\s)|(?<=\s )|\Z)")
_BORDER = re.compile(r"(?<=\S) (?=\S)")


def little_endian(ids: Iterable[int]) -> bytes:
    """Ids as unsigned 32-bit little-endian integers."""
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Generations:
    """A bounded cache: when the young generation is full it becomes the old one, and what is used of that is kept."""

    def __init__(self, limit: int) -> None:
        self._limit, self._young, self._old, self._long = limit, {}, {}, []

    def fetch(self, keys: set, compute: Callable[[list], Iterable]) -> dict:
        """A mapping with every key; compute gives the values of those that are not kept."""
        missing = keys.difference(self._young)
        if len(self._young) + len(missing) > self._limit:
            self._old, self._young = self._young, {}
            missing = keys
        old, todo = self._old, []
        for k in missing:
            if k in old:
                self._young[k] = old[k]
            else:
                todo.append(k)
        self._young.update(zip(todo, compute(todo), strict=True))
        self._long = [k for k in todo if len(k) > CACHED_CHUNK]
        return self._young

    def drop_long(self) -> None:
        """Forget the keys of the last fetch that are too long to keep."""
        for k in self._long:
            self._young.pop(k, None)


def cut(text: str) -> list[str]:
    """The text's chunks, all but the first without their leading space."""
    return _BORDER.split(text) if text[:1] == " " or _ODD.search(text) else text.split(" ")


def tails_of(pieces: list[list[str]]) -> set[str]:
    """The distinct chunks of texts but for first ones."""
    out: set[str] = set()
    for ps in pieces:
        out.update(ps[1:])
    return out


class _Numbers(dict):
    """A running number for each chunk, given when it is first asked for."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = number = len(self)
        return number


class Encoder:
    """Texts to packed ids, as the tokenizers library gives them without the special tokens that frame a text.

    The ids of the chunks met so far stand one after another in one array; a text's ids are taken from there.
    """

    def __init__(self, file: str, cache: int = CACHE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._all = Tokenizer.from_file(file)
        self._added = [t.content for t in self._all.get_added_tokens_decoder().values()]
        space = "".join(w for w, _ in self._all.pre_tokenizer.pre_tokenize_str(" "))
        size = self._all.get_vocab_size()
        self._spaced = np.array([(self._all.id_to_token(i) or "").startswith(space) for i in range(size)])
        self._limit = cache
        self._clear()

    def _clear(self) -> None:
        self._number, self._chars = _Numbers(), 0
        self._start, self._size, self._ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._all.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks and note where the ids of each stand."""
        ids, size = self._joined(chunks)
        self._start = np.concatenate((self._start, len(self._ids) + np.cumsum(size) - size))
        self._size, self._ids = np.concatenate((self._size, size)), np.concatenate((self._ids, ids))
        self._chars += sum(map(len, chunks))

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their number for each chunk: chunks without a space inside go many at a time as one text, in which each starts with the only space."""
        sizes, found = [], []
        at = 0
        while at < len(chunks):
            to = min(len(chunks), at + JOINED)
            text = " " + " ".join(chunks[at:to])
            if text.count(" ") != to - at:  # a chunk with a space inside
                to = next((k for k in range(at, to) if " " in chunks[k]), to)
                text = " " + " ".join(chunks[at:to])
            if to > at:
                ids = np.array(self._whole([text])[0], "<u4")
                starts = np.flatnonzero(self._spaced[ids])
                if len(starts) != to - at:
                    raise ValueError("the vocabulary does not mark chunk starts by a leading space")
                sizes.append(np.diff(np.append(starts, len(ids))))
            else:
                to = at + 1
                ids = np.array(self._whole([" " + chunks[at]])[0], "<u4")
                sizes.append(np.array([len(ids)]))
            found.append(ids)
            at = to
        return np.concatenate(found), np.concatenate(sizes)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed by little_endian."""
        # the library cuts a text at the strings of added tokens first, and such texts are rare
        odd = {i for i, t in enumerate(texts) if any(x in t for x in self._added)}
        pieces = [[""] if i in odd else cut(t) for i, t in enumerate(texts)]
        heads = self._whole([texts[i] if i in odd else ps[0] for i, ps in enumerate(pieces)])
        chunks = [p for ps in pieces for p in ps[1:]]
        ends = np.cumsum([len(ps) - 1 for ps in pieces])
        out = [[little_endian(head)] for head in heads]
        for at in range(0, len(chunks), TOGETHER):
            ids, past = self._looked_up(chunks[at : at + TOGETHER])
            first, last = np.searchsorted(ends, (at, at + len(past) - 1), side="right").tolist()
            cuts = past[np.minimum(ends[first:last], at + len(past)) - at - 1].tolist()
            for i, x, y in zip(range(first, last + 1), [0, *cuts], [*cuts, len(ids)], strict=True):
                out[i].append(ids[x:y].tobytes())
        return [b"".join(parts) for parts in out]

    def _looked_up(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after another, and where each chunk's end."""
        if max(len(self._number), self._chars // 16) > self._limit:
            self._clear()
        number = np.fromiter(map(self._number.__getitem__, chunks), np.int64, len(chunks))
        if self._number.new:
            self._learn(self._number.new)
            self._number.new = []
        start, size = self._start[number], self._size[number]
        past = np.cumsum(size)
        return self._ids[np.repeat(start - past + size, size) + np.arange(int(past[-1]))], past


@functools.cache
def encoder(file: str) -> Encoder:
    return Encoder(file)


def read_ranks(file: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Spans:
    """Tells where a token of a vocabulary, as it would lie in a text, spans a border between two bytes.

    Where none does, no merge crosses the border. Whole tokens of 2 and 3 bytes count, and any
    4 neighbouring bytes of a token, so that a border is judged by 3 bytes on either side.
    """

    def __init__(self, ranks: Iterable[bytes]) -> None:
        own = list(ranks)
        self._codes = {n: np.array(sorted({int.from_bytes(t) for t in own if len(t) == n}), np.uint32) for n in (2, 3)}
        self._codes[4] = np.array(sorted({int.from_bytes(t[k : k + 4]) for t in own for k in range(len(t) - 3)}), np.uint32)

    def of(self, data: bytes) -> np.ndarray:
        """A mask over the places 0 to len(data)."""
        raw = np.frombuffer(data, np.uint8).astype(np.uint32)
        out = np.zeros(len(raw) + 1, bool)
        code = raw
        for n, known in self._codes.items():
            code = code[:-1] * np.uint32(256) + raw[n - 1 :]
            if len(known):
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code)
                for k in range(1, n):
                    out[at + k] = True
        return out
