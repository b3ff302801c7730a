"""Byte-level BPE, packing, media columns, token counts against libraries and brute force."""

import array
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lithos.llm import bpe, counts, jpeg, media, packing
from lithos.llm.queries import JSON_FILE, RANK_FILE
from lithos.llm.tokens import cut, encoder, little_endian, read_ranks

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANK_FILE), special_tokens={})


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


ODD = [
    "", "a", "  x  y ", "a\n\n b\t\tc", "it's 'll we're'd", "naïve 漢字漢字 ١٢٣  x\x1cy \x85z", "a" * 700, " " * 300, "ab" * 400, "<|endoftext|>",
    "trailing ", "xyz" * 200, "a b　c 　 d", "퟿﻿" + "é" * 90,
]


def test_bpe_equals_tiktoken(tik):
    random.seed(2)
    texts = [*ODD, "".join(random.choice("abcdefghij") for _ in range(300))]
    for text, (ids, raw) in zip(texts, bpe.codec(RANK_FILE, PATTERN).encode(texts), strict=True):
        assert ids.decode().split() == [str(i) for i in tik.encode_ordinary(text)]
        assert raw == text.encode()


_RNG = random.Random(8)
LONG_WORDS = {
    "letters": "".join(_RNG.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)),
    "base64": "".join(_RNG.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=20_000)),
    "one letter": "a" * 50_000,
    "lines": "-" * 9_000 + "=" * 3_000 + " " * 2_000 + "x",
    "period": "abc" * 9_000 + "ÃÂ" * 900,
    "prose": ("thequickbrownfoxjumpsoverthelazydog" * 40 + "antidisestablishmentarianism") * 4,
    "chinese": " ".join("".join(chr(_RNG.randint(0x4E00, 0x9FA5)) for _ in range(50)) for _ in range(60)),
    "thai": " ".join("".join(chr(_RNG.randint(0xE01, 0xE3A)) for _ in range(60)) for _ in range(60)),
    "kana": "".join(chr(_RNG.randint(0x3041, 0x3093)) for _ in range(4_000)),
    "mixed": "".join(_RNG.choice(["the", "ing", "漢", "é", "ß", "ตั", "x", "qu", "あ", "🙂"]) for _ in range(4_000)),
}


@pytest.mark.parametrize("kind", LONG_WORDS)
def test_bpe_of_long_words(tik, kind):
    text = LONG_WORDS[kind]
    began = time.process_time()
    ((ids, raw),) = bpe.codec(RANK_FILE, PATTERN).encode([text])
    assert time.process_time() - began < 20
    assert ids.decode().split() == [str(i) for i in tik.encode_ordinary(text)]
    assert raw == text.encode()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["ab", "the", "ing", "zz", "q", "漢", "字", "é", "ÃÂ", "--", "==", "aaaa", "tion", "7", "ü"]), min_size=10, max_size=120))
def test_bpe_of_any_long_word(tik, parts):
    text = "".join(parts)
    ((ids, _),) = bpe.codec(RANK_FILE, PATTERN).encode([text])
    assert ids.decode().split() == [str(i) for i in tik.encode_ordinary(text)]


def test_bpe_query_and_decode(spark, odd, empty, tik):
    found = bpe.encode(odd, RANK_FILE, PATTERN)
    texts = sorted((r.text or "" for r in odd.collect()))
    assert sorted(r.decoded.decode() for r in found.collect()) == texts
    for r in found.collect():
        ids = " ".join(map(str, tik.encode_ordinary(bytes(r.decoded).decode())))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids.split()), _sha(ids.encode()), _sha(r.decoded))
    back = bpe.decode(found.select("doc_id", "ids"), RANK_FILE, PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == texts
    assert bpe.encode(empty, RANK_FILE, PATTERN).count() == 0


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext|", "a <|endoftext|>b\n"]


def test_encoder_equals_the_library():
    plain = Tokenizer.from_file(JSON_FILE)
    every = [chr(c) for c in range(0x250)]
    texts = [*ODD, *SPECIAL, "".join(every), " ".join(every), " x".join(every), "if x:\n        y  =  1 # it's\n\n", "  lead and trail  "]
    own = encoder(JSON_FILE)
    assert own.encode(SPECIAL[:1]) == [little_endian([64, 220, 50256, 275])]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == little_endian(plain.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z'sré漢1٣½\n\t \x1c\x85　.,<|é\u0301🙂")))
def test_encoder_equals_the_library_on_any_text(text):
    plain = Tokenizer.from_file(JSON_FILE)
    assert encoder(JSON_FILE).encode([text, "x " + text]) == [little_endian(plain.encode(t, add_special_tokens=False).ids) for t in (text, "x " + text)]


def test_encoder_equals_the_library_on_documents(spark):
    plain = Tokenizer.from_file(JSON_FILE)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    want = [little_endian(e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert encoder(JSON_FILE).encode(texts) == want


def test_cut():
    assert cut(" a") == [" a"] and cut("a\n b") == ["a\n b"] and cut("a 　b c") == ["a 　b", "c"] and cut("a\nb c") == ["a\nb", "c"]
    assert cut("") == [""] and cut("a  b c ") == ["a  b", "c "]


def test_differencing():
    random.seed(5)
    sizes = [random.randint(1, 256) for _ in range(400)]
    found = packing.differencing(sizes, 50)
    assert sorted(i for _, items in found for i in items) == list(range(400))
    assert all(total == sum(sizes[i] for i in items) for total, items in found)
    assert max(t for t, _ in found) - min(t for t, _ in found) <= 8
    assert packing.differencing([8, 7, 6, 5, 4], 2)[0][0] + packing.differencing([8, 7, 6, 5, 4], 2)[1][0] == 30
    assert packing.spread([]) == [] and packing.spread([1024, 1024, 1]) != []
    assert all(sum([600, 600, 600][i] for i in w) <= 1024 for w in packing.spread([600, 600, 600]))


def test_packing(spark, docs, odd, empty):
    own = Tokenizer.from_file(JSON_FILE)
    odd = odd.union(docs([(90 + i, t) for i, t in enumerate(SPECIAL)]))
    rows = packing.pack(odd, JSON_FILE).collect()
    used: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    assert max(used.values()) <= packing.WINDOW
    want = sorted(len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r.length for r in rows) == sum(want)
    long = sorted((r for r in rows if r.doc_id == 7), key=lambda r: r.start)
    ids = own.encode("word " * 3000, add_special_tokens=False).ids + [0]
    assert b"".join(bytes(r.ids) for r in long) == array.array("I", ids).tobytes()
    assert packing.pack(empty, JSON_FILE).count() == 0


@pytest.mark.parametrize("data", [bytes(64), b"\xff" * 192, bytes(range(256)), np.random.default_rng(1).integers(0, 256, 64 * 700, dtype=np.uint8).tobytes()])
def test_jpeg_keeps_the_payload(data):
    image = jpeg.decode(jpeg.encode(data))
    assert jpeg.payload_of(image) == data
    assert image.rgb().shape == (image.height, image.width, 3)


def test_jpeg_general_scans():
    """A file with interleaved DC, chroma at half size, runs, late coefficients and signs goes through the general paths."""
    bits: list[int] = []

    def put(value: int, n: int) -> None:
        bits.extend((value >> (n - 1 - k)) & 1 for k in range(n))

    def scan(parts: tuple, start: int, end: int, high: int, low: int) -> bytes:
        body = bytes([len(parts), *(x for c in parts for x in (c, 0)), start, end, high << 4 | low])
        out = jpeg._segment(0xDA, body) + jpeg._coded(np.array(bits, np.uint8))
        bits.clear()
        return out

    dc = ((0, 1), (1, 2), (2, 3))  # codes 0, 10, 110
    ac = ((0x00, 1), (0x01, 2), (0x11, 3))  # end of band 0; one bit 10; after one zero 110
    out = [b"\xff\xd8", jpeg._segment(0xDB, bytes([0] + [2] * 64))]
    out.append(jpeg._segment(0xC2, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(jpeg._segment(0xC4, jpeg._table(0, dc) + jpeg._table(1, ac)))
    for step in (3, 0, -1, 1, 2, -2):  # four luma blocks, then one of each chroma
        size = abs(step).bit_length()
        put((0, 0b10, 0b110)[size], size + 1)
        if size:
            put(step if step > 0 else step + (1 << size) - 1, size)
    out.append(scan((1, 2, 3), 0, 0, 0, 1))
    for bit in (1, 0, 1, 0, 0, 1):
        put(bit, 1)
    out.append(scan((1, 2, 3), 0, 0, 1, 0))
    for k in range(4):  # coefficient 1 is 1 or -1 (times 2), the rest of the band is empty
        put(0b10, 2)
        put(k % 2, 1)
        put(0, 1)
    out.append(scan((1,), 1, 3, 0, 1))
    for k in range(4):
        put(0b10, 2)  # a new coefficient at place 2, once the old one at 1 is refined
        put(1, 1)
        put(k // 2, 1)
        put(0, 1)  # end of band
    out.append(scan((1,), 1, 3, 1, 0))
    out.append(b"\xff\xd9")
    image = jpeg.decode(b"".join(out))
    luma = image.coefficients[1].reshape(-1, 64)
    assert luma[:, 0].tolist() == [7, 6, 5, 6] and image.coefficients[2].ravel()[0] == 4 and image.coefficients[3].ravel()[0] == -3
    assert [row[:4].tolist()[1:] for row in luma] == [[-2, 1, 0], [2, 1, 0], [-3, 1, 0], [3, 1, 0]]
    assert image.rgb().shape == (16, 16, 3)
    with pytest.raises(ValueError):
        jpeg.decode(b"no file")


def test_inverse_transform_is_the_cosine_sum():
    rng = np.random.default_rng(3)
    c = rng.integers(-40, 40, (5, 64))
    square = np.zeros((5, 64))
    square[:, jpeg.ZIGZAG] = c
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    want = np.einsum("nuv,ux,vy->nxy", square.reshape(5, 8, 8), basis, basis).reshape(5, 64) + 128
    assert np.abs(jpeg.inverse_transform(c).astype(float) - np.clip(want, 0, 255)).max() <= 1


def test_media(spark, odd, empty):
    for r in media.store(odd).collect():
        image = jpeg.decode(bytes(r.media))
        back = jpeg.payload_of(image)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(back), _sha(back), zlib.crc32(back[-64:]))
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) and not any(back[r.n_bytes :])
        assert r.media_sha256 == _sha(r.media) and r.media_bytes == len(r.media) and r.rgb == image.rgb().tobytes()
    found = media.store(odd, with_media=False).collect()
    assert sorted(r.n_bytes for r in found) == sorted(len((r.text or "").encode()) for r in odd.collect())
    assert media.store(empty).count() == 0


def _tree(text):
    return counts.CountTree(text, counts.counter(RANK_FILE, PATTERN), counts.borders(RANK_FILE))


_PIECES = ["", " ", "\n", "  x", "a b c ", "'s", "'", "ll", "9", " hello world", "　", "word " * 80, "漢字かな", "漢" * 300, "é", "!?", "\x1c", "x\n" * 200, "½", "\t \n"]


def test_count_tree_equals_full_count():
    count = counts.counter(RANK_FILE, PATTERN)
    random.seed(3)
    chinese = "".join(chr(random.randint(0x4E00, 0x9FA5)) for _ in range(6000))
    for text in ["", "a", " ", "one two three " * 200, "x" * 3000, "a\n\n b " * 300, "item\n" * 500, chinese, "it's 'll 12ab," * 200, " \n" * 900]:
        tree = _tree(text)
        for _ in range(60):
            a = random.randint(0, len(text))
            b = min(len(text), a + random.choice([0, 0, 1, 2, 5, 40, 600]))
            new = random.choice(_PIECES)
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert (tree.text(), tree.tokens, tree.chars) == (text, count(text), len(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "'", "s", "ll", "re", " ", "\n", "\x1c", "\x85", "　", "1", "½", "!", "漢", "字", "é", "\u0301", "🙂"]), max_size=60), st.data())
def test_cuts_keep_the_count(parts, data):
    count, text = counts.counter(RANK_FILE, PATTERN), "".join(parts)
    for size in (1, 2, 3):
        leaves = counts.borders(RANK_FILE).leaves(text, size)
        assert "".join(leaves) == text and sum(map(count, leaves)) == count(text)
    tree = _tree(text)
    for _ in range(6):
        a = data.draw(st.integers(0, len(text)))
        b = min(len(text), a + data.draw(st.integers(0, 4)))
        new = "".join(data.draw(st.lists(st.sampled_from(parts or ["x"]), max_size=4)))
        tree.replace(a, b, new)
        text = text[:a] + new + text[b:]
        assert (tree.text(), tree.tokens) == (text, count(text))


@pytest.mark.parametrize("text", [
    "some words here " * 6000, "item\n" * 20_000, "".join(chr(random.Random(1).randint(0x4E00, 0x9FA5) + k % 7) for k in range(100_000)),
    "".join(random.Random(2).choices("的一是不了人我在有他这中大来上国个到说们", k=100_000)), "a1" * 50_000, "x;y=" * 25_000,
])
def test_small_edit_encodes_little(text):
    tree = _tree(text)
    assert tree.n_leaves > 100
    for at, new in ((40_000, "other"), (70_001, ""), (10, "漢字")):
        before = tree.encoded_chars
        tree.replace(at, at + 4, new)
        assert tree.encoded_chars - before < 2000


def test_many_insertions_spread_the_leaves():
    count = counts.counter(RANK_FILE, PATTERN)
    tree, text = _tree("start and end"), "start and end"
    for k in range(400):
        at = (k * 7919) % (len(text) + 1)
        new = f" new text number {k} " * 20
        tree.replace(at, at, new)
        text = text[:at] + new + text[at:]
    assert (tree.text(), tree.tokens) == (text, count(text))
    assert tree.encoded_chars < 12 * len(text)


def test_counts(spark, odd, empty):
    count = counts.counter(RANK_FILE, PATTERN)
    rows = counts.count(odd, RANK_FILE, PATTERN, counts.revision()).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(count(r.text or "") for r in odd.collect())
    edits = spark.createDataFrame([(8, 2, 0, 3, "By"), (8, 1, 0, 2, None), (None, 1, 0, 0, "x"), (4, 1, 5, 9, "bc")], "doc_id long, seq long, start long, end long, replacement string")
    found = {r.doc_id: r.n_tokens_after for r in counts.count_edited(odd, edits, RANK_FILE, PATTERN).collect() if r.doc_id in (4, 8)}
    text = next(r.text for r in odd.collect() if r.doc_id == 8)
    assert found == {4: count("abc"), 8: count("By" + text[2:][3:])}
    assert counts.count(empty, RANK_FILE, PATTERN).count() == 0
