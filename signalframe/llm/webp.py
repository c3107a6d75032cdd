"""Lossless WebP: a decoder of the whole VP8L format (RFC 9649), and an encoder.

``decode`` reads prefix codes, back-references and the colour cache, and undoes
the predictor, cross-colour, subtract-green and palette transforms, symbol by
symbol.  ``decode_many`` does the same for many files: those that begin alike are
decoded in step, one symbol of each at a time.  ``encode`` writes palettes,
predictors, cross-colour transforms, back-references and cached colours.
"""

from __future__ import annotations

import functools
import heapq
import struct
import zlib

import numpy as np

MAX_SIDE = 1 << 14

# Fixed values of the format: the order of code length codes, and the (column, row) offsets of the short distances.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class WebPError(ValueError):
    """The bytes are not lossless WebP."""


class Bits:
    """Reads bits from the low end of each byte."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.end = data, at, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 6], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise WebPError("the data ends too soon")
        return out


class PrefixCode:
    """A canonical prefix code; ``uniform`` is the length of all its codes, or -1."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        self.symbols: np.ndarray = used
        if len(used) <= 1:
            self.single, self.uniform, self.most = (int(used[0]) if len(used) else 0), 0, 0
            return
        self.single, size = None, lengths[used]
        if (np.ldexp(1.0, -size.astype(int))).sum() != 1:
            raise WebPError("a prefix code is not complete")
        order = np.lexsort((used, size))
        self.symbols, size = used[order], size[order]
        self.most = int(size[-1])
        self.uniform = int(size[0]) if size[0] == size[-1] else -1
        self._sizes = size
        self._table: list[tuple[int, int]] | None = None

    def table(self) -> list[tuple[int, int]]:
        """For each value of the next ``most`` bits the symbol and its length."""
        if self._table is None:
            out: list[tuple[int, int]] = [(0, 0)] * (1 << self.most)
            code, last = 0, int(self._sizes[0])
            for symbol, size in zip(self.symbols.tolist(), self._sizes.tolist(), strict=True):
                code <<= size - last
                last = size
                low = int(format(code, f"0{size}b")[::-1], 2)
                for i in range(low, 1 << self.most, 1 << size):
                    out[i] = (symbol, size)
                code += 1
            self._table = out
        return self._table

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        symbol, size = self.table()[bits.peek(self.most)]
        bits.at += size
        return symbol


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(max(alphabet, 256), np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths[:alphabet])
    of_lengths = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = PrefixCode(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left > 0:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            before = symbol or before
            continue
        times = 3 + bits.read(2) if symbol == 16 else 3 + bits.read(3) if symbol == 17 else 11 + bits.read(7)
        if at + times > alphabet:
            raise WebPError("code lengths run past the alphabet")
        lengths[at : at + times] = before if symbol == 16 else 0
        at += times
    return PrefixCode(lengths[:alphabet])


def _value(prefix: int, bits: Bits) -> int:
    """A length or distance from its prefix and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as 32-bit ARGB, in a row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    tile, groups_of, count = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        groups_of = ((read_image(bits, across, (height + (1 << tile) - 1) >> tile, False) >> np.uint32(8)) & np.uint32(0xFFFF)).tolist()
        count = max(groups_of) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, size) for size in sizes] for _ in range(count)]
    total = width * height

    if count == 1 and all(c.uniform >= 0 for c in groups[0][:4]) and int(groups[0][0].symbols.max(initial=0)) < 256:
        return _read_uniform(bits, groups[0], total)

    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift = 32 - cache_bits
    at, cached = 0, 0
    while at < total:
        if groups_of is None:
            group = groups[0]
        else:
            group = groups[groups_of[(at // width >> tile) * across + (at % width >> tile)]]
        symbol = group[0].read(bits)
        if symbol < 256:
            red = group[1].read(bits)
            blue = group[2].read(bits)
            out[at] = group[3].read(bits) << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < 280:
            length = _value(symbol - 256, bits)
            distance = _value(group[4].read(bits), bits)
            if distance > 120:
                distance -= 120
            else:
                x, y = NEAR[distance - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > total:
                raise WebPError("a back-reference leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - distance]
            at += length
        else:
            for i in range(cached, at):
                cache[(CACHE_FACTOR * out[i] & 0xFFFFFFFF) >> shift] = out[i]
            cached = at
            out[at] = cache[symbol - 280]
            at += 1
        if bits.at > bits.end + 64:
            raise WebPError("the data ends too soon")
    if bits.at > bits.end:
        raise WebPError("the data ends too soon")
    return np.array(out, np.uint32)


def _read_uniform(bits: Bits, group: list[PrefixCode], total: int) -> np.ndarray:
    """Pixels whose codes have one length in each channel: bit i of every pixel is at one distance."""
    stride = sum(c.uniform for c in group[:4])
    if bits.at + stride * total > bits.end:
        raise WebPError("the data ends too soon")
    out = np.zeros(total, np.uint32)
    if stride:
        first = bits.at >> 3
        raw = np.frombuffer(bits.data, np.uint8, (bits.at + stride * total + 7 >> 3) - first, first)
        flat = np.unpackbits(raw, bitorder="little")[bits.at & 7 :][: stride * total].reshape(total, stride)
        bits.at += stride * total
    column = 0
    for code, shift in zip(group[:4], (8, 16, 0, 24), strict=True):
        if not code.uniform:
            out |= np.uint32(code.single << shift)
            continue
        rank = np.zeros(total, np.uint16)
        for i in range(code.uniform):
            rank = (rank << np.uint16(1)) | flat[:, column + i]
        column += code.uniform
        out |= code.symbols.astype(np.uint32)[rank] << np.uint32(shift)
    return out


def _channels(pixels: np.ndarray) -> np.ndarray:
    """ARGB numbers as rows of B, G, R, A bytes."""
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _average(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _predict(mode: int, left, top, right, corner):
    """The prediction of a pixel (B, G, R, A) from its neighbours."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        half = _average(left, top)
        return [min(255, max(0, h + int((h - c) / 2))) for h, c in zip(half, corner, strict=True)]
    return (0, 0, 0, 255)


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    rest = _channels(pixels.reshape(height, width))
    out = np.zeros_like(rest)
    out[0, 0] = rest[0, 0] + np.array([0, 0, 0, 255], np.uint8)
    out[0] = np.cumsum(np.vstack([out[0, :1], rest[0, 1:]]), axis=0, dtype=np.uint8)
    out[:, 0] = np.cumsum(np.vstack([out[:1, 0], rest[1:, 0]]), axis=0, dtype=np.uint8)
    across = (width + (1 << bits) - 1) >> bits
    kinds = (modes.reshape(-1, across) >> np.uint32(8)) & np.uint32(15)
    for y in range(1, height):
        row = kinds[y >> bits]
        if row[0] in (2, 3, 4, 8, 9) and (row == row[0]).all():  # by pixels above alone
            top, corner = out[y - 1, 1:], out[y - 1, :-1]
            right = np.concatenate([out[y - 1, 2:], out[y, :1]])
            mode = int(row[0])
            if mode == 8:
                guess = (corner & top) + ((corner ^ top) >> 1)
            elif mode == 9:
                guess = (top & right) + ((top ^ right) >> 1)
            else:
                guess = {2: top, 3: right, 4: corner}[mode]
            out[y, 1:] = rest[y, 1:] + guess
            continue
        if (row == 1).all():  # the pixel before
            out[y] = np.cumsum(np.vstack([out[y, :1], rest[y, 1:]]), axis=0, dtype=np.uint8)
            continue
        above, own, new = out[y - 1].tolist(), rest[y].tolist(), [out[y, 0].tolist()]
        above.append(new[0])  # right of the last column stands the first pixel of this row
        for x in range(1, width):
            guess = _predict(int(row[x >> bits]), new[x - 1], above[x], above[x + 1], above[x - 1])
            new.append([(a + g) & 255 for a, g in zip(own[x], guess, strict=True)])
        out[y] = new
    return out.reshape(-1, 4).copy().view("<u4")[:, 0].astype(np.uint32)


def undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    across = (width + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(width * height), width)
    own = _channels(factors)[(y >> bits) * across + (x >> bits)].view(np.int8).astype(np.int32)
    px = _channels(pixels).copy()
    signed = px.view(np.int8).astype(np.int32)
    red = (px[:, 2] + ((own[:, 0] * signed[:, 1]) >> 5)).astype(np.uint8)
    blue = px[:, 0] + ((own[:, 1] * signed[:, 1]) >> 5) + ((own[:, 2] * red.view(np.int8).astype(np.int32)) >> 5)
    px[:, 2], px[:, 0] = red, blue.astype(np.uint8)
    return px.view("<u4")[:, 0].astype(np.uint32)


def undo_palette(pixels: np.ndarray, table: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if bits:
        packed = (width + (1 << bits) - 1) >> bits
        size = 8 >> bits
        column = np.arange(width)
        index = (index.reshape(height, packed)[:, column >> bits] >> ((column & ((1 << bits) - 1)) * size).astype(np.uint32)) & np.uint32((1 << size) - 1)
    index = index.reshape(-1)
    return np.where(index < len(table), table[np.minimum(index, len(table) - 1)], 0).astype(np.uint32)


def decode(data: bytes) -> tuple[np.ndarray, bool]:
    """Pixels (height, width, 4) as R, G, B, A bytes of one lossless WebP file, and whether its alpha counts."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebPError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + struct.unpack_from("<I", data, 16)[0]])
    if bits.read(8) != 0x2F:
        raise WebPError("the signature is wrong")
    full, height, alpha = bits.read(14) + 1, bits.read(14) + 1, bool(bits.read(1))
    if bits.read(3):
        raise WebPError("the version is unknown")
    width, undo = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            held = read_image(bits, (width + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size, False)
            undo.append((kind, held, size, width))
        elif kind == PALETTE:
            count = bits.read(8) + 1
            table = np.cumsum(_channels(read_image(bits, count, 1, False)), axis=0, dtype=np.uint8).view("<u4")[:, 0].astype(np.uint32)
            size = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            undo.append((kind, table, size, width))
            width = (width + (1 << size) - 1) >> size
        else:
            undo.append((kind, None, 0, width))
    pixels = read_image(bits, width, height, True)
    for kind, held, size, width in reversed(undo):
        if kind == SUBTRACT_GREEN:
            px = _channels(pixels).copy()
            px[:, 0] += px[:, 1]
            px[:, 2] += px[:, 1]
            pixels = px.view("<u4")[:, 0].astype(np.uint32)
        else:
            pixels = (undo_predictor, undo_cross_colour, None, undo_palette)[kind](pixels, held, size, width, height)
    return _channels(pixels.reshape(height, full))[..., [2, 1, 0, 3]], alpha


class BitWriter:
    """Collects numbers of given bit widths, low bits first."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.size
        self.size += bits

    def array(self) -> np.ndarray:
        """The bits, one a byte."""
        return np.unpackbits(np.frombuffer(self.value.to_bytes((self.size + 7) // 8, "little"), np.uint8), bitorder="little")[: self.size]


def _lengths(weights: list[int], most: int = 15) -> np.ndarray:
    """The code lengths of Huffman's code for these weights (0: no code); weights are evened out until none is over ``most``."""
    heap = [(w, i, (i,)) for i, w in enumerate(weights) if w]
    out = np.zeros(len(weights), np.int64)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        out[list(x + y)] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    return out if out.max(initial=0) <= most else _lengths([(w + 1) // 2 + 1 if w else 0 for w in weights], most)


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes, with their first bit lowest."""
    out, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for s in used[np.lexsort((used, lengths[used]))].tolist():
        size = int(lengths[s])
        code <<= size - last
        last = size
        out[s] = int(format(code, f"0{size}b")[::-1], 2)
        code += 1
    return out


def _put_code(out: BitWriter, lengths: np.ndarray) -> None:
    """Write a prefix code by its lengths, with runs of zeros; of one symbol alone as a simple code."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        out.put(0b1 | 0 << 1 | 1 << 2 | int(used[0]) << 3, 11)
        return
    tokens: list[tuple[int, int, int]] = []
    at = 0
    while at < len(lengths):
        run = 1
        while lengths[at] == 0 and at + run < len(lengths) and lengths[at + run] == 0 and run < 138:
            run += 1
        if lengths[at] or run < 3:
            tokens.append((int(lengths[at]), 0, 0))
            at += 1
        else:
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            at += run
    weights = np.bincount([t[0] for t in tokens], minlength=19).tolist()
    if sum(w > 0 for w in weights) == 1:
        weights[(weights.index(max(weights)) + 1) % 19] = 1  # a code of one token would have no bits
    own = _lengths(weights, 7)
    codes = _codes(own)
    last = max(i for i, t in enumerate(CODE_LENGTH_ORDER) if own[t] or i == 3)
    out.put(0, 1)
    out.put(last + 1 - 4, 4)
    for t in CODE_LENGTH_ORDER[: last + 1]:
        out.put(int(own[t]), 3)
    out.put(0, 1)
    for token, extra, bits in tokens:
        out.put(int(codes[token]), int(own[token]))
        out.put(extra, bits)


def _prefix(value: np.ndarray | int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number of a length or distance; the reverse of ``_value``."""
    w = int(value) - 1
    if w < 4:
        return w, 0, 0
    k = w.bit_length() - 1
    return 2 * k + (w >> (k - 1) & 1), w & ((1 << (k - 1)) - 1), k - 1


WIDTH = 64  # of the images that ``encode`` is made for
CACHE_BITS = 8
LEAST_MATCH = 4
#: The ways in which images are written; all but the palette's have codes fixed in advance.
WAYS = ("plain", "predictor", "cross_colour")
MODES = (2, 1, 4, 8, 3, 9)
FACTORS = (20, 244, 7)  # of green to red, green to blue and red to blue, as signed bytes


class Way:
    """The bits before the pixels, and the codes of the symbols, of one way of writing images."""

    def __init__(self, kind: str, mode: int = 0) -> None:
        self.kind, self.mode = kind, mode
        # texts have letters and blanks mostly; what a transform leaves is spread over all values
        own = [6 if 97 <= b <= 122 or b == 32 else 3 if 33 <= b < 127 else 2 for b in range(256)]
        self.green = _lengths(own + [1] * 24 + [1] * (1 << CACHE_BITS))
        self.other, self.distance = _lengths(own), _lengths([1] * 40)
        self.alpha = np.zeros(256, np.int64)
        self.alpha[0 if kind == "predictor" else 255] = 1
        self.codes = {name: (_codes(x), x.astype(np.uint64)) for name, x in (("green", self.green), ("other", self.other), ("distance", self.distance))}
        out = BitWriter()
        if kind != "plain":
            out.put(1 | (PREDICTOR if kind == "predictor" else CROSS_COLOUR) << 1, 3)
            out.put(7, 3)  # tiles of 512 pixels
            out.put(0, 1)  # one colour for all tiles
            values = (self.mode, 0, 0, 255) if kind == "predictor" else (FACTORS[1], FACTORS[2], FACTORS[0], 255)
            for symbol in (*values, 0):
                _put_code(out, np.eye(1, 256, symbol, dtype=np.int64)[0])
        out.put(0, 1)
        out.put(1 | CACHE_BITS << 1, 5)
        out.put(0, 1)
        for lengths in (self.green, self.other, self.other, self.alpha, self.distance):
            _put_code(out, lengths)
        self.head = out.array()


@functools.cache
def way(kind: str, mode: int = 0) -> Way:
    return Way(kind, mode)


def _predicted(px: np.ndarray, mode: int) -> np.ndarray:
    """The prediction of every pixel (height, width, 4) by one mode that needs no more than the pixel before or those above."""
    out = np.zeros_like(px)
    out[0, 0] = (0, 0, 0, 255)
    out[0, 1:] = px[0, :-1]
    out[1:, 0] = px[:-1, 0]
    top, corner = px[:-1, 1:], px[:-1, :-1]
    right = np.concatenate([px[:-1, 2:], px[1:, :1]], 1)  # right of the last column stands the first pixel of the row itself
    if mode == 1:
        out[1:, 1:] = px[1:, :-1]
    elif mode == 8:
        out[1:, 1:] = (corner & top) + ((corner ^ top) >> 1)
    elif mode == 9:
        out[1:, 1:] = (top & right) + ((top ^ right) >> 1)
    else:
        out[1:, 1:] = {2: top, 3: right, 4: corner}[mode]
    return out


def _matches(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of repeats of ``LEAST_MATCH`` pixels and more, from left to right."""
    n = len(flat) - LEAST_MATCH + 1
    if n < 2:
        return []
    h = flat[:n].astype(np.uint64)
    for k in range(1, LEAST_MATCH):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[k : n + k]
    h = (h >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    out, at, places = [], 0, np.flatnonzero(before >= 0)
    while True:
        i = int(np.searchsorted(places, at))
        if i >= len(places):
            return out
        at = int(places[i])
        j, most = int(before[at]), min(4096, len(flat) - at)
        differs = np.flatnonzero(flat[at : at + 64] != flat[j : j + min(64, len(flat) - at)])
        if len(differs):
            length = int(differs[0])
        else:
            differs = np.flatnonzero(flat[at : at + most] != flat[j : j + most])
            length = int(differs[0]) if len(differs) else most
        if length < LEAST_MATCH:  # another hash by chance
            at += 1
            continue
        out.append((at, length, at - j))
        at += length


def _near_codes(width: int) -> dict[int, int]:
    """The codes of the distances that have a short one."""
    out: dict[int, int] = {}
    for code, (x, y) in enumerate(NEAR, 1):
        if x + y * width > 0:
            out.setdefault(x + y * width, code)
    return out


_NEAR_CODES = functools.cache(_near_codes)


def _packed(values: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """The bytes of numbers of so many bits each, side by side, after ``first`` zero bits (7 at most)."""
    ends = np.cumsum(sizes.astype(np.int64)) + first
    at = ends - sizes.astype(np.int64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    words = np.zeros(int(ends[-1] if len(ends) else first) // 64 + 2, np.uint64)
    if len(at):
        begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[begins]] |= np.bitwise_or.reduceat(values << shift, begins)
        over = np.where(shift > 0, values >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        words[word[begins] + 1] |= np.bitwise_or.reduceat(over, begins)
    return words.view(np.uint8)[: (int(ends[-1] if len(ends) else first) + 7) // 8]


def _wrapped(body: bytes) -> bytes:
    padded = body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded


def _start(width: int, height: int) -> bytes:
    """Signature, sides, no alpha, version 0: five bytes."""
    return bytes([0x2F]) + struct.pack("<I", (width - 1) | (height - 1) << 14)


def _with_palette(flat: np.ndarray, width: int, height: int) -> bytes | None:
    """The file of an image of few colours; None where it has more than 256, or too many for its size."""
    colours, index = np.unique(flat, return_inverse=True)
    if len(colours) > 256 or 4 * len(colours) > len(flat):
        return None
    out = BitWriter()
    out.put(1 | PALETTE << 1, 3)
    out.put(len(colours) - 1, 8)
    out.put(0, 1)
    parts = _pixel_bits(out, np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.uint8))[:, [1, 2, 0, 3]])
    out = BitWriter()
    out.put(0, 1)
    size = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    across = (width + (1 << size) - 1) >> size
    cells = np.zeros((height, across << size), np.uint32)
    cells[:, :width] = index.reshape(height, width)
    green = sum(cells[:, k :: 1 << size] << np.uint32(k * (8 >> size)) for k in range(1 << size)).reshape(-1)
    pixels = np.zeros((len(green), 4), np.uint8)
    pixels[:, 0], pixels[:, 3] = green, 255
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # no groups
    parts += _pixel_bits(out, pixels)
    return _start(width, height) + np.packbits(np.concatenate(parts), bitorder="little").tobytes()


def _pixel_bits(out: BitWriter, pixels: np.ndarray) -> list[np.ndarray]:
    """The bits of ``out``, of codes made for the pixels' channels (green, red, blue, alpha), and of the pixels."""
    values, sizes = np.zeros(len(pixels), np.uint64), np.zeros(len(pixels), np.uint64)
    for c in range(4):
        counts = np.bincount(pixels[:, c], minlength=280 if c == 0 else 256)
        if np.count_nonzero(counts) == 1:
            lengths = (counts > 0).astype(np.int64)
            _put_code(out, lengths)
            continue
        lengths = _lengths(counts.tolist())
        _put_code(out, lengths)
        values |= _codes(lengths)[pixels[:, c]] << sizes
        sizes += lengths.astype(np.uint64)[pixels[:, c]]
    _put_code(out, np.eye(1, 40, 0, dtype=np.int64)[0])
    return [out.array(), np.unpackbits(_packed(values, sizes, 0), bitorder="little")[: int(sizes.sum())]]


def _cached(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in the colour cache, and whether it stands there: the last pixel of that place is the same."""
    place = ((flat * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - CACHE_BITS)).astype(np.uint8)
    order = np.argsort(place, kind="stable")
    cached = np.zeros(len(flat), bool)
    cached[order[1:]] = (place[order[1:]] == place[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
    return place.astype(np.int64), cached


def encode(rgb: np.ndarray) -> bytes:
    """A lossless WebP file of (height, width, 3) bytes.

    An image of few colours has a palette.  Others are written in one of ``WAYS``, told
    by a checksum of their bytes so that equal images give equal files: as they are, with a
    predictor (its mode is told by the checksum too), or with a cross-colour
    transform; repeats become back-references, and pixels in the colour cache its
    symbols.
    """
    height, width, _ = rgb.shape
    if not (1 <= height <= MAX_SIDE and 1 <= width <= MAX_SIDE):
        raise ValueError(f"the sides of an image are 1 to {MAX_SIDE}")
    px = np.full((height, width, 4), 255, np.uint8)
    px[..., :3] = rgb[..., ::-1]
    flat = px.reshape(-1, 4).view("<u4")[:, 0]
    if len(flat) >= 64 and 4 * np.count_nonzero(_cached(flat)[1]) >= 3 * len(flat) and (file := _with_palette(flat, width, height)) is not None:
        return _wrapped(file)
    told = zlib.crc32(rgb.tobytes())
    kind = WAYS[told % len(WAYS)]
    w = way(kind, MODES[told // 8 % len(MODES)] if kind == "predictor" else 0)
    if kind == "predictor":
        px = px - _predicted(px, w.mode)
    elif kind == "cross_colour":
        signed = px.view(np.int8).astype(np.int32)
        to_red, to_blue, red_to_blue = (f - 256 if f > 127 else f for f in FACTORS)
        px = px.copy()
        px[..., 2] -= ((to_red * signed[..., 1]) >> 5).astype(np.uint8)
        px[..., 0] -= (((to_blue * signed[..., 1]) >> 5) + ((red_to_blue * signed[..., 2]) >> 5)).astype(np.uint8)
    flat = np.ascontiguousarray(px.reshape(-1, 4)).view("<u4")[:, 0]
    place, cached = _cached(flat)
    (green, green_size), (other, other_size), (distance, distance_size) = (w.codes[n] for n in ("green", "other", "distance"))
    b, g, r = (px.reshape(-1, 4)[:, c].astype(np.int64) for c in (0, 1, 2))
    values = np.where(cached, green[280 + place], green[g] | other[r] << green_size[g] | other[b] << (green_size[g] + other_size[r]))
    sizes = np.where(cached, green_size[280 + place], green_size[g] + other_size[r] + other_size[b])
    matches = _matches(flat)
    if matches:
        near, kept = _NEAR_CODES(width), np.ones(len(flat), bool)
        for at, length, step in matches:
            code, more, bits = _prefix(length)
            value, size = int(green[256 + code]), int(green_size[256 + code])
            value, size = value | more << size, size + bits
            code, more, bits = _prefix(near.get(step, step + 120))
            value, size = value | int(distance[code]) << size, size + int(distance_size[code])
            values[at], sizes[at] = value | more << size, size + bits
            kept[at + 1 : at + length] = False
        values, sizes = values[kept], sizes[kept]
    whole = len(w.head) // 8 * 8
    body = _packed(values, sizes, len(w.head) - whole)
    last = int(np.packbits(w.head[whole:], bitorder="little")[0]) if whole < len(w.head) else 0
    if len(body):
        body[0] |= last
    return _wrapped(_start(width, height) + np.packbits(w.head[:whole], bitorder="little").tobytes() + body.tobytes())


class Known:
    """The bits before the pixels that were met before, and what they mean: all that ``decode_many`` reads side by side."""

    MOST = 64

    def __init__(self) -> None:
        #: For each head: its whole bytes, its last bits, their number in all, the transforms, the alpha of every pixel, and the number of its codes.
        self.heads: list[tuple[bytes, int, int, list, int, int]] = []
        #: The size of the colour cache, and the codes of green, red, blue and distance.
        self.codes: list[tuple[int, list[PrefixCode]]] = []
        self.numbers: dict[tuple, int] = {}

    def of(self, body: bytes):
        for head in self.heads:
            whole, last, bits = head[0], head[1], head[2]
            end = 5 + len(whole)
            if body[5:end] == whole and (not bits & 7 or len(body) > end and body[end] & ((1 << (bits & 7)) - 1) == last):
                return head
        return None

    def learn(self, body: bytes) -> None:
        """Remember the head of a file whose transforms have one colour, and so no bits for their pixels."""
        sides = struct.unpack_from("<I", body, 1)[0]
        bits, width, height, undo = Bits(body, 40), (sides & 0x3FFF) + 1, (sides >> 14 & 0x3FFF) + 1, []
        while bits.read(1):
            kind = bits.read(2)
            if kind == PALETTE:
                return
            if kind == SUBTRACT_GREEN:
                undo.append((kind, 0, 0))
                continue
            size = bits.read(3) + 2
            before = bits.at
            held = read_image(bits, (width + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size, False)
            again = Bits(body, before)
            if again.read(1) or any([read_code(again, n).most for n in (280, 256, 256, 256, 40)]) or again.at != bits.at:
                return
            undo.append((kind, int(held[0]), size))
        cache_bits = bits.read(4) if bits.read(1) else 0
        if bits.read(1) or not 1 <= cache_bits <= 11:
            return
        codes = [read_code(bits, n) for n in (280 + (1 << cache_bits), 256, 256, 256, 40)]
        if codes[3].most or any(c.most > 15 for c in codes) or len(self.heads) >= self.MOST:
            return
        alpha = codes.pop(3).single
        key = (cache_bits, *(c.symbols.tobytes() + (b"" if c.single is not None else c._sizes.tobytes()) for c in codes))
        if key not in self.numbers:
            self.numbers[key] = len(self.codes)
            self.codes.append((cache_bits, codes))
        n = bits.at - 40
        whole, rest = body[5 : 5 + n // 8], n & 7
        self.heads.append((whole, body[5 + n // 8] & ((1 << rest) - 1) if rest else 0, n, undo, alpha, self.numbers[key]))


def _table(code: PrefixCode) -> tuple[np.ndarray, int]:
    """Symbol and length (in the low 4 bits) for each value of the next bits, and how many they are."""
    if code.single is not None:
        return np.array([code.single << 4], np.int64), 0
    return np.array([s << 4 | n for s, n in code.table()], np.int64), code.most


def _side_by_side(bodies: list[bytes], first_bits: np.ndarray, alphas: np.ndarray, cache_bits: int, codes: list[PrefixCode], totals: np.ndarray, width: int) -> np.ndarray:
    """The pixels, before the transforms are undone, of images with the same codes: a row each, decoded in step, the longest image first."""
    n = len(bodies)
    joined = b"".join([x + b"\0" * 8 for x in bodies])
    start = np.cumsum([0, *(len(x) + 8 for x in bodies)])[:-1]
    stop = 8 * (start + np.array([len(x) for x in bodies]))
    words = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    bit = 8 * start + 40 + first_bits
    (green, gn), (red, rn), (blue, bn), (far, fn) = map(_table, codes)
    gm, rm, bm = (np.uint64((1 << k) - 1) for k in (gn, rn, bn))
    alpha = alphas.astype(np.uint32) << np.uint32(24)
    out = np.zeros((n, int(totals[0])), np.uint32)
    cache = np.zeros((n, 1 << cache_bits), np.uint32)
    shift, factor = np.uint32(32 - cache_bits), np.uint32(CACHE_FACTOR)
    at, active = np.zeros(n, np.int64), np.arange(n)
    least = int(totals[-1])  # no image ends before so many pixels
    while len(active) >= _ALONE:
        own = bit[active]
        peek = words[own >> 3] >> (own & 7).astype(np.uint64)
        x = green[(peek & gm).astype(np.int64)]
        symbol, used = x >> 4, x & 15
        p = peek >> used.astype(np.uint64)
        y = red[(p & rm).astype(np.int64)]
        p >>= (y & 15).astype(np.uint64)
        z = blue[(p & bm).astype(np.int64)]
        pixel = ((y >> 4) << 16 | symbol << 8 | z >> 4).astype(np.uint32) | alpha[active]
        literal = symbol < 256
        bit[active] = own + np.where(literal, used + (y & 15) + (z & 15), used)
        i = np.flatnonzero(symbol >= 280)
        pixel[i] = cache[active[i], symbol[i] - 280]
        copied = np.flatnonzero((symbol >= 256) & (symbol < 280))
        rows = active
        if len(copied):
            one = np.ones(len(active), bool)
            one[copied] = False
            rows, pixel = active[one], pixel[one]
        here = at[rows]
        out[rows, here] = pixel
        cache[rows, (pixel * factor) >> shift] = pixel
        at[rows] = here + 1
        for k in copied.tolist():
            row = int(active[k])
            bits = Bits(bodies[row], int(bit[row]) - 8 * int(start[row]))
            length = _value(int(symbol[k]) - 256, bits)
            v = int(far[bits.peek(fn)])
            bits.at += v & 15
            step = _value(v >> 4, bits)
            if step > 120:
                step -= 120
            else:
                dx, dy = NEAR[step - 1]
                step = max(1, dx + dy * width)
            place = int(at[row])
            if step > place or place + length > totals[row]:
                raise WebPError("a back-reference leaves the image")
            cells = out[row]
            cells[place : place + length] = np.resize(cells[place - step : place], length) if step < length else cells[place - step : place - step + length]
            new = cells[place : place + length]
            cache[row, (new * factor) >> shift] = new
            at[row], bit[row] = place + length, bits.at + 8 * int(start[row])
        if (bit[active] > stop[active]).any():
            raise WebPError("the data ends too soon")
        if int(at[active].max()) >= least:
            active = active[at[active] < totals[active]]
    for row in active.tolist():  # too few to go on in step
        bits, total, place = Bits(bodies[row], int(bit[row]) - 8 * int(start[row])), int(totals[row]), int(at[row])
        cells, cached, high = out[row, :place].tolist(), cache[row].tolist(), int(alpha[row])
        shift_by = 32 - cache_bits
        while len(cells) < total:
            symbol = codes[0].read(bits)
            before = len(cells)
            if symbol < 256:
                r = codes[1].read(bits)
                cells.append(high | r << 16 | symbol << 8 | codes[2].read(bits))
            elif symbol < 280:
                length = _value(symbol - 256, bits)
                step = _value(codes[3].read(bits), bits)
                if step > 120:
                    step -= 120
                else:
                    dx, dy = NEAR[step - 1]
                    step = max(1, dx + dy * width)
                if step > before or before + length > total:
                    raise WebPError("a back-reference leaves the image")
                for k in range(before, before + length):
                    cells.append(cells[k - step])
            else:
                cells.append(cached[symbol - 280])
            for c in cells[before:]:
                cached[(CACHE_FACTOR * c & 0xFFFFFFFF) >> shift_by] = c
            if bits.at > bits.end:
                raise WebPError("the data ends too soon")
        out[row, :total] = cells
    return out


_TOGETHER, _ALONE = 1024, 16


def decode_many(files: list[bytes], known: Known) -> list[np.ndarray]:
    """The pixels of many files, as ``decode`` gives them: those whose head was met before in step with others of the same codes, the rest one by one."""
    out: list[np.ndarray | None] = [None] * len(files)
    groups: dict[tuple[int, int], list[tuple[int, int, bytes, tuple]]] = {}
    for i, file in enumerate(files):
        if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
            raise WebPError("not a lossless WebP file")
        body = file[20 : 20 + struct.unpack_from("<I", file, 16)[0]]
        head = known.of(body)
        if head is None:
            known.learn(body)
            head = known.of(body)
        if head is not None:
            sides = struct.unpack_from("<I", body, 1)[0]
            groups.setdefault((head[5], (sides & 0x3FFF) + 1), []).append(((sides >> 14 & 0x3FFF) + 1, i, body, head))
    for (number, width), members in groups.items():
        members.sort(key=lambda m: -m[0])
        for lo in range(0, len(members), _TOGETHER):
            some = members[lo : lo + _TOGETHER]
            if len(some) < _ALONE:
                continue
            heights = np.array([m[0] for m in some])
            pixels = _side_by_side([m[2] for m in some], np.array([m[3][2] for m in some]), np.array([m[3][4] for m in some]), *known.codes[number], heights * width, width)
            for row, (height, i, _, head) in enumerate(some):
                own = pixels[row, : height * width]
                for kind, value, size in reversed(head[3]):
                    tiles = ((width + (1 << size) - 1) >> size) * ((height + (1 << size) - 1) >> size)
                    if kind == SUBTRACT_GREEN:
                        px = _channels(own).copy()
                        px[:, 0] += px[:, 1]
                        px[:, 2] += px[:, 1]
                        own = px.view("<u4")[:, 0].astype(np.uint32)
                    else:
                        own = (undo_predictor if kind == PREDICTOR else undo_cross_colour)(own, np.full(tiles, value, np.uint32), size, width, height)
                out[i] = _channels(own.reshape(height, width))[..., [2, 1, 0, 3]]
    return [x if x is not None else decode(files[i])[0] for i, x in enumerate(out)]
