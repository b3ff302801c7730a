"""Progressive JPEG: a decoder, and lossless storage of bytes in its coefficients.

The decoder takes progressive files (SOF2, 8 bits, 1 or 3 components, any sampling
factors): it accumulates the scans - spectral selection and successive
approximation - into coefficient arrays, then dequantises, inverse-transforms all
blocks in numpy, repeats chroma to full resolution and converts to an RGB tensor.

The encoder stores a payload of 64 bytes a block. JPEG samples are lossy, its
coefficients are not, so a byte v becomes the coefficient 256 + v, the format's
unit. Its top bit is the same everywhere and goes into the first scans; the eight
bits of v follow as eight successive approximations of DC, of coefficients 1 to 5
and of 6 to 63. All coefficients being non-zero by then, a refinement is an
end-of-band run followed by plain bits, for which encoder and decoder have a fast
path; the decoder's general path reads any such scan.

Two chroma components at half the width hold zero. The payload's length stands in
a comment segment.
"""

from __future__ import annotations

import functools
import math

import numpy as np

BLOCK = 64
#: Most blocks in a row of an image; sides are at most 65535 samples.
WIDE = 256
_COMMENT = b"payload "

# The zig-zag order follows from walking the anti-diagonals.
ZIGZAG = np.array(
    [r * 8 + c for _, _, r, c in sorted((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8))], np.int64
)
#: Bands of the AC refinement scans.
BANDS = ((1, 5), (6, 63))
#: Fractional bits of the integer inverse transform; sums of products stay exact in float64.
_FRACTION = 13


@functools.cache
def _basis() -> np.ndarray:
    """Rows: coefficients in zig-zag order; columns: the 64 samples; integers scaled by 2^_FRACTION."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * math.pi / 16) * np.where(k == 0, math.sqrt(1 / 8), 0.5)
    two = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(two[ZIGZAG] * (1 << _FRACTION))


def inverse_transform(coefficients: np.ndarray) -> np.ndarray:
    """(n, 64) dequantised coefficients in zig-zag order to (n, 64) samples from 0 to 255."""
    sums = coefficients.astype(np.float64) @ _basis()
    return np.clip(np.floor(sums / (1 << _FRACTION) + 0.5) + 128, 0, 255).astype(np.uint8)


def to_plane(samples: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Blocks of 64 samples, row by row of blocks, as one plane."""
    return samples.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Full-resolution planes to an RGB tensor (height, width, 3), in 16-bit fixed point."""
    y = y.astype(np.int32) << 16
    b, r = cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    half = 1 << 15
    planes = (y + 91881 * r + half, y - 22554 * b - 46802 * r + half, y + 116130 * b + half)
    return np.stack([np.clip(p >> 16, 0, 255).astype(np.uint8) for p in planes], axis=-1)


# --- entropy coding ---------------------------------------------------------------------------------------------------


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[at]
                code += 1
                at += 1
            code <<= 1

    def code_of(self, symbol: int) -> tuple[int, int]:
        """(length, code) of a symbol."""
        return next(k for k, s in self.codes.items() if s == symbol)


class _Bits:
    """The bits of a scan's data, without stuffed zeros."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for bit in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | bit
        self.at += n
        return out

    def symbol(self, table: _Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            found = table.codes.get((length, code))
            if found is not None:
                return found
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _dc_first(bits: _Bits, blocks: list[np.ndarray], tables: list[_Huffman], low: int) -> None:
    """blocks: one array (n, 64) per component, each with its rows in scan order; here one component."""
    rows, table = blocks[0], tables[0]
    # fast path: a first difference and then, as far as the data go, the code of "no difference"
    before = 0
    size = bits.symbol(table)
    before += bits.signed(size)
    rows[0, 0] = before << low
    n = len(rows) - 1
    zero = [c for c in table.codes.items() if c[1] == 0]
    if n and zero and zero[0][0][0] == 1:
        code = zero[0][0][1]
        if (bits.bits[bits.at : bits.at + n] == code).all() and len(bits.bits) >= bits.at + n:
            rows[1:, 0] = before << low
            bits.at += n
            return
    for k in range(1, len(rows)):
        before += bits.signed(bits.symbol(table))
        rows[k, 0] = before << low


def _dc_refine(bits: _Bits, rows: np.ndarray, low: int) -> None:
    rows[:, 0] |= bits.bits[bits.at : bits.at + len(rows)].astype(rows.dtype) << low
    bits.at += len(rows)


def _ac_first(bits: _Bits, rows: np.ndarray, table: _Huffman, start: int, end: int, low: int) -> None:
    width = end - start + 1
    # fast path: the same one-bit coefficient at every place
    ones = [c for c in table.codes.items() if c[1] == 1]
    n = len(rows) * width
    if ones:
        length, code = ones[0][0]
        one = [(code >> (length - 1 - k)) & 1 for k in range(length)] + [1]
        part = bits.bits[bits.at : bits.at + n * len(one)]
        if len(part) == n * len(one) and (part.reshape(n, -1) == np.array(one, np.uint8)).all():
            rows[:, start : end + 1] = 1 << low
            bits.at += len(part)
            return
    run = 0
    for row in rows:
        if run:
            run -= 1
            continue
        k = start
        while k <= end:
            symbol = bits.symbol(table)
            skip, size = symbol >> 4, symbol & 15
            if size:
                k += skip
                row[k] = bits.signed(size) << low
                k += 1
            elif skip == 15:
                k += 16
            else:
                run = (1 << skip) + bits.take(skip) - 1
                break


def _ac_refine(bits: _Bits, rows: np.ndarray, table: _Huffman, start: int, end: int, low: int) -> None:
    step = 1 << low
    band = rows[:, start : end + 1]

    def refine(value: int) -> int:
        if bits.take(1) and not abs(value) & step:
            return value + (step if value > 0 else -step)
        return value

    at = 0
    while at < len(rows):
        row = rows[at]
        k, run = start, 0
        while k <= end:
            symbol = bits.symbol(table)
            skip, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = step if bits.take(1) else -step
            elif skip < 15:
                run = (1 << skip) + bits.take(skip)
                break
            while k <= end:
                if row[k]:
                    row[k] = refine(int(row[k]))
                elif skip:
                    skip -= 1
                else:
                    break
                k += 1
            if new and k <= end:
                row[k] = new
            k += 1
        if not run:
            at += 1
            continue
        # an end-of-band run: plain bits refine what is non-zero, first in the rest of this block
        for m in range(k, end + 1):
            if k > start and row[m]:
                row[m] = refine(int(row[m]))
        if k > start:
            at, run = at + 1, run - 1
        part = band[at : at + run]
        plain = bits.bits[bits.at : bits.at + part.size]
        if 0 < part.size == len(plain) and part.min() > 0 and not (part & step).any():  # all are refined, and upwards
            part += plain.reshape(part.shape).astype(part.dtype) << part.dtype.type(low)
            bits.at += part.size
            at += run
            continue
        live = part != 0
        n = int(live.sum())
        plain = bits.bits[bits.at : bits.at + n].astype(part.dtype)
        bits.at += n
        value = part[live]
        part[live] = np.where((plain == 1) & (np.abs(value) & step == 0), value + np.sign(value) * step, value)
        at += run


# --- files ------------------------------------------------------------------------------------------------------------


class _Component:
    def __init__(self, ident: int, horizontal: int, vertical: int, quantiser: int) -> None:
        self.id, self.h, self.v, self.q = ident, horizontal, vertical, quantiser


class Image:
    """A decoded file: size, comment, and per component its coefficient array (block rows, block columns, 64)."""

    def __init__(self) -> None:
        self.height = self.width = 0
        self.comment = b""
        self.components: list[_Component] = []
        self.tables: dict[int, np.ndarray] = {}
        self.coefficients: dict[int, np.ndarray] = {}

    def _own(self, c: _Component) -> tuple[int, int]:
        """Blocks of a component in a scan of its own: rows, columns."""
        tall, wide = max(x.v for x in self.components), max(x.h for x in self.components)
        return -(-(-(-self.height * c.v // tall)) // 8), -(-(-(-self.width * c.h // wide)) // 8)

    def _frame(self) -> None:
        tall, wide = max(x.v for x in self.components), max(x.h for x in self.components)
        rows, columns = -(-self.height // (8 * tall)), -(-self.width // (8 * wide))
        for c in self.components:
            self.coefficients[c.id] = np.zeros((rows * c.v, columns * c.h, 64), np.int16)

    def rgb(self) -> np.ndarray:
        """The RGB tensor (height, width, 3), chroma repeated to full resolution."""
        tall, wide = max(x.v for x in self.components), max(x.h for x in self.components)
        planes = []
        for c in self.components:
            blocks = self.coefficients[c.id]
            flat = blocks.reshape(-1, 64)
            if flat.any():
                samples = inverse_transform(flat * self.tables[c.q])
            else:
                samples = np.full(flat.shape, 128, np.uint8)
            plane = to_plane(samples, *blocks.shape[:2])
            plane = plane.repeat(tall // c.v, axis=0).repeat(wide // c.h, axis=1)
            planes.append(plane[: self.height, : self.width])
        return to_rgb(*planes) if len(planes) == 3 else np.repeat(planes[0][:, :, None], 3, axis=2)


def _scan_data(data: bytes, at: int) -> tuple[bytes, int]:
    """Entropy-coded data from at to the next marker, and where that stands."""
    end = at
    while True:
        end = data.index(b"\xff", end)
        if data[end + 1] != 0:
            return data[at:end], end
        end += 2


def decode(data: bytes) -> Image:
    """Read a progressive file. Restart intervals and arithmetic coding are not supported."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image = Image()
    huffman: dict[tuple[int, int], _Huffman] = {}
    at = 2
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 << wide
                image.tables[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [_Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            image._frame()
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = _Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD and any(body):
            raise ValueError("restart intervals are not supported")
        elif marker == 0xDA:
            raw, at = _scan_data(data, at)
            _scan(image, huffman, body, raw)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive file")


def _scan(image: Image, huffman: dict, body: bytes, raw: bytes) -> None:
    n = body[0]
    chosen = [(next(c for c in image.components if c.id == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(n)]
    start, end, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    bits = _Bits(raw)
    if n > 1:  # interleaved, which only DC scans are
        before = [0] * n
        rows, columns = (x // y for x, y in zip(image.coefficients[chosen[0][0].id].shape, (chosen[0][0].v, chosen[0][0].h), strict=False))
        for row in range(rows):
            for column in range(columns):
                for k, (c, tables) in enumerate(chosen):
                    for v in range(c.v):
                        for h in range(c.h):
                            block = image.coefficients[c.id][row * c.v + v, column * c.h + h]
                            if high:
                                block[0] |= bits.take(1) << low
                            else:
                                before[k] += bits.signed(bits.symbol(huffman[0, tables >> 4]))
                                block[0] = before[k] << low
        return
    c, tables = chosen[0]
    tall, wide = image._own(c)
    whole = image.coefficients[c.id]
    exact = whole.shape[:2] == (tall, wide)
    part = whole.reshape(-1, 64) if exact else np.ascontiguousarray(whole[:tall, :wide]).reshape(-1, 64)
    if not start:
        if high:
            _dc_refine(bits, part, low)
        else:
            _dc_first(bits, [part], [huffman[0, tables >> 4]], low)
    elif high:
        _ac_refine(bits, part, huffman[1, tables & 15], start, end, low)
    else:
        _ac_first(bits, part, huffman[1, tables & 15], start, end, low)
    if not exact:
        whole[:tall, :wide] = part.reshape(tall, wide, 64)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _coded(bits: np.ndarray) -> bytes:
    """Bits as scan data: filled up with ones, and a zero stuffed after each 0xFF."""
    fill = -len(bits) % 8
    if fill:
        bits = np.concatenate((bits, np.ones(fill, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _binary(value: int, n: int) -> list[int]:
    return [(value >> (n - 1 - k)) & 1 for k in range(n)]


# Huffman tables of the encoder, each symbol with its code length:
# DC: no difference 1 bit, difference of one bit 2 bits; AC: one-bit coefficient 1 bit, end-of-band runs 5 bits.
_DC = ((0, 1), (1, 2))
_AC = ((0x01, 1), *((run << 4, 5) for run in range(15)))


def _table(kind: int, codes: tuple[tuple[int, int], ...]) -> bytes:
    counts = bytes(sum(1 for _, length in codes if length == n) for n in range(1, 17))
    return bytes((kind << 4,)) + counts + bytes(s for s, _ in codes)


@functools.cache
def _own_tables() -> tuple[_Huffman, _Huffman]:
    return tuple(_Huffman(raw[1:17], raw[17:]) for raw in (_table(0, _DC), _table(1, _AC)))


def encode(payload: bytes) -> bytes:
    """A progressive file whose luma coefficients hold the payload, a positive multiple of 64 bytes."""
    n = len(payload) // BLOCK
    if not n or len(payload) % BLOCK:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    columns = min(n + n % 2, max(WIDE, 2 * -(-n // 16000)))  # even: chroma is half as wide
    rows = -(-n // columns)
    blocks = np.zeros((rows * columns, BLOCK), np.uint8)
    blocks.ravel()[: len(payload)] = np.frombuffer(payload, np.uint8)
    count = len(blocks)
    dc, ac = _own_tables()
    out = [
        b"\xff\xd8", _segment(0xFE, _COMMENT + str(len(payload)).encode()), _segment(0xDB, bytes((0,)) + bytes([1] * 64)),
        _segment(0xC2, bytes((8,)) + (rows * 8).to_bytes(2, "big") + (columns * 8).to_bytes(2, "big") + bytes((3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0))),
        _segment(0xC4, _table(0, _DC) + _table(1, _AC)),
    ]

    def scan(component: int, start: int, end: int, high: int, low: int, bits: np.ndarray) -> None:
        out.append(_segment(0xDA, bytes((1, component, 0, start, end, high << 4 | low))) + _coded(bits))

    def code(table: _Huffman, symbol: int) -> list[int]:
        length, value = table.code_of(symbol)
        return _binary(value, length)

    # the first scans: 256 >> 8 = 1 at every place of luma, 0 in chroma
    scan(1, 0, 0, 0, 8, np.concatenate((np.array([*code(dc, 1), 1], np.uint8), np.full(count - 1, code(dc, 0)[0], np.uint8))))
    half = rows * columns // 2
    for component in (2, 3):
        scan(component, 0, 0, 0, 0, np.full(half, code(dc, 0)[0], np.uint8))
    for start, end in BANDS:
        scan(1, start, end, 0, 8, np.tile(np.array([*code(ac, 1), 1], np.uint8), count * (end - start + 1)))
    # refinements: bit by bit, an end-of-band run over up to 32767 blocks and their plain bits
    for low in range(7, -1, -1):
        plane = (blocks >> np.uint8(low)) & np.uint8(1)
        scan(1, 0, 0, low + 1, low, plane[:, 0])
        for start, end in BANDS:
            parts = []
            for at in range(0, count, 32767):
                run = min(32767, count - at)
                size = run.bit_length() - 1
                parts.append(np.array([*code(ac, size << 4), *_binary(run - (1 << size), size)], np.uint8))
                parts.append(plane[at : at + run, start : end + 1].ravel())
            scan(1, start, end, low + 1, low, np.concatenate(parts))
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(image: Image) -> bytes:
    """The payload that encode() put into a file, from its decoded coefficients."""
    if not image.comment.startswith(_COMMENT):
        raise ValueError("the file holds no payload")
    size = int(image.comment[len(_COMMENT) :])
    luma = image.coefficients[image.components[0].id]
    rows, columns = image._own(image.components[0])
    return (luma[:rows, :columns].reshape(-1) - 256).astype(np.uint8).tobytes()[:size]
