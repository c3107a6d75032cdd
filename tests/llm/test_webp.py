"""Images with every feature of the format, written by a plain encoder and read by the decoder."""

import heapq
import random
import struct

import numpy as np
import pytest

from signalframe.llm import webp

ADD = lambda a, b: [(x + y) & 255 for x, y in zip(a, b)]
SUB = lambda a, b: [(x - y) & 255 for x, y in zip(a, b)]
AVG = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, table, symbol):
        self.bits += table[symbol]

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def lengths_of(counts):
    """Code lengths of symbols by Huffman's method."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))]
    size = dict.fromkeys(counts, 0)
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            size[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    return size


def write_code(w, counts, alphabet):
    """Writes a code for the symbols met and gives their bits."""
    if not counts:
        counts = {0: 1}
    symbols = sorted(counts)
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        w.put(symbols[0], 8)
        if len(symbols) == 2:
            w.put(symbols[1], 8)
        return {s: [i] if len(symbols) == 2 else [] for i, s in enumerate(symbols)}
    size = lengths_of(counts) if len(symbols) > 1 else {symbols[0]: 1, (symbols[0] + 1) % alphabet: 1}
    # the sixteen lengths have codes of four bits each
    w.put(0, 1)
    w.put(15, 4)
    for s in webp.CODE_LENGTH_ORDER:
        w.put(4 if s < 16 else 0, 3)
    w.put(0, 1)
    for s in range(alphabet):
        n = size.get(s, 0)
        assert n < 16
        w.bits += [n >> 3 & 1, n >> 2 & 1, n >> 1 & 1, n & 1]
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in size.items()):
        code <<= n - last
        last = n
        out[s] = [code >> (n - 1 - i) & 1 for i in range(n)]
        code += 1
    return out


def prefix(v):
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    top = v.bit_length() - 1
    return 2 * top + (v >> top - 1 & 1), top - 1, v & (1 << top - 1) - 1


def tokens_of(pixels, width, rng, cache_bits, copies):
    """Literals, copies of what stands before, and places of the colour cache."""
    out, cache, i = [], {}, 0
    near = {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(webp.NEAR))) if x + y * width > 0}
    while i < len(pixels):
        if copies and i:
            d = rng.choice([1, width, rng.randrange(1, i + 1)])
            n = 0
            while d <= i and i + n < len(pixels) and pixels[i + n] == pixels[i + n - d] and n < 4000:
                n += 1
            if n >= 2:
                out.append(("copy", n, near.get(d, d + 120), pixels[i : i + n]))
                for p in pixels[i : i + n]:
                    cache[webp.CACHE_FACTOR * p % 2**32 >> 32 - cache_bits if cache_bits else 0] = p
                i += n
                continue
        p = pixels[i]
        at = webp.CACHE_FACTOR * p % 2**32 >> 32 - cache_bits if cache_bits else 0
        out.append(("cache", at) if cache_bits and cache.get(at) == p else ("pixel", p))
        cache[at] = p
        i += 1
    return out


def write_image(w, pixels, width, rng, main=False, cache_bits=0, copies=False, tile=0):
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    height = len(pixels) // width
    groups, across, group_of = 1, 1, [0]
    if main:
        w.put(bool(tile), 1)
        if tile:
            w.put(tile - 2, 3)
            across = -(-width >> tile) * -1 if False else (width + (1 << tile) - 1) >> tile
            group_of = [rng.randrange(3) for _ in range(across * ((height + (1 << tile) - 1) >> tile))]
            groups = max(group_of) + 1
            write_image(w, [g << 8 for g in group_of], across, rng)
    tokens = tokens_of(pixels, width, rng, cache_bits, copies)
    counts = [[{} for _ in range(5)] for _ in range(groups)]

    def each(emit):
        at = 0
        for t in tokens:
            g = group_of[(at // width >> tile) * across + (at % width >> tile)] if tile else 0
            if t[0] == "pixel":
                p = t[1]
                for k, v in ((0, p >> 8 & 255), (1, p >> 16 & 255), (2, p & 255), (3, p >> 24)):
                    emit(g, k, v, 0, 0)
                at += 1
            elif t[0] == "cache":
                emit(g, 0, 280 + t[1], 0, 0)
                at += 1
            else:
                s, n, x = prefix(t[1])
                emit(g, 0, 256 + s, n, x)
                s, n, x = prefix(t[2])
                emit(g, 4, s, n, x)
                at += t[1]

    each(lambda g, k, v, n, x: counts[g][k].__setitem__(v, counts[g][k].get(v, 0) + 1))
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    tables = [[write_code(w, c, size) for c, size in zip(group, sizes)] for group in counts]

    def emit(g, k, v, n, x):
        w.code(tables[g][k], v)
        w.put(x, n)

    each(emit)


def guess(mode, left, top, right, corner):
    if mode == 0:
        return [0, 0, 0, 255]
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return AVG(AVG(left, right), top)
    if mode in (6, 7, 8, 9):
        return AVG(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return AVG(AVG(left, corner), AVG(top, right))
    if mode == 11:
        ahead = [x + t - c for x, t, c in zip(left, top, corner)]
        far = lambda n: sum(abs(a - b) for a, b in zip(ahead, n))
        return left if far(left) < far(top) else top
    if mode == 12:
        return [max(0, min(255, x + t - c)) for x, t, c in zip(left, top, corner)]
    return [max(0, min(255, a + int((a - c) / 2))) for a, c in zip(AVG(left, top), corner)]


def parts(p):
    return [p & 255, p >> 8 & 255, p >> 16 & 255, p >> 24]


def whole(b):
    return b[0] | b[1] << 8 | b[2] << 16 | b[3] << 24


def signed(x):
    return x - 256 if x > 127 else x


def encode(pixels, width, transforms, rng, **image):
    """``pixels`` are 32-bit ARGB numbers in rows."""
    height, w, full = len(pixels) // width, Writer(), width
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    for name in transforms:
        w.put(1, 1)
        if name == "predictor":
            w.put(0, 2)
            w.put(1, 3)
            across = width + 7 >> 3
            modes = [rng.randrange(14) for _ in range(across * (height + 7 >> 3))]
            write_image(w, [m << 8 for m in modes], across, rng)
            px, out = [parts(p) for p in pixels], []
            for i, p in enumerate(px):
                y, x = divmod(i, width)
                if y == 0:
                    g = px[i - 1] if x else [0, 0, 0, 255]
                elif x == 0:
                    g = px[i - width]
                else:
                    g = guess(modes[(y >> 3) * across + (x >> 3)], px[i - 1], px[i - width], px[i - width + 1], px[i - width - 1])
                out.append(whole(SUB(p, g)))
            pixels = out
        elif name == "cross":
            w.put(1, 2)
            w.put(0, 3)
            across = width + 3 >> 2
            factors = [[rng.randrange(256) for _ in range(3)] for _ in range(across * (height + 3 >> 2))]
            write_image(w, [whole([f[0], f[1], f[2], 255]) for f in factors], across, rng)
            out = []
            for i, p in enumerate(pixels):
                y, x = divmod(i, width)
                to_red, to_blue, red_to_blue = map(signed, factors[(y >> 2) * across + (x >> 2)])
                b, g, r, a = parts(p)
                out.append(whole([(b - (to_blue * signed(g) >> 5) - (red_to_blue * signed(r) >> 5)) & 255, g, (r - (to_red * signed(g) >> 5)) & 255, a]))
            pixels = out
        elif name == "green":
            w.put(2, 2)
            pixels = [whole([(b - g) & 255, g, (r - g) & 255, a]) for b, g, r, a in map(parts, pixels)]
        else:
            w.put(3, 2)
            table = sorted(set(pixels))
            w.put(len(table) - 1, 8)
            write_image(w, [whole(SUB(parts(p), parts(q))) for p, q in zip(table, [0, *table])], len(table), rng)
            bits = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            packed = (width + (1 << bits) - 1) >> bits
            out = [0xFF000000] * (packed * height)
            for i, p in enumerate(pixels):
                y, x = divmod(i, width)
                out[y * packed + (x >> bits)] |= table.index(p) << 8 + (x & (1 << bits) - 1) * (8 >> bits)
            pixels, width = out, packed
    w.put(0, 1)
    write_image(w, pixels, width, rng, main=True, **image)
    body = w.bytes()
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(body) % 2) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2), full


CASES = [
    ([], {}), ([], {"copies": True}), ([], {"cache_bits": 5}), ([], {"cache_bits": 1, "copies": True}), ([], {"tile": 2, "copies": True, "cache_bits": 11}),
    (["green"], {}), (["cross"], {"copies": True}), (["predictor"], {}), (["predictor", "cross", "green"], {"copies": True, "cache_bits": 4, "tile": 3}), (["palette"], {"copies": True}),
]


@pytest.mark.parametrize(("transforms", "image"), CASES)
@pytest.mark.parametrize("colours", [1, 2, 4, 13, 60, 0])
def test_decodes_what_was_written(transforms, image, colours):
    rng = random.Random(f"{transforms}{image}{colours}")
    width, height = rng.choice([(1, 1), (7, 9), (17, 20), (33, 6)])
    table = [rng.getrandbits(32) for _ in range(colours)]
    pixels = [rng.choice(table) if table else rng.getrandbits(32) for _ in range(width * height)]
    if transforms == ["palette"] and not table:
        pixels = [p & 0xFF0000FF | 0x100 for p in pixels][:200]
        width, pixels = 10, pixels[: len(pixels) // 10 * 10] or pixels[:1] * 10
    if image.get("copies") and len(pixels) > 60:
        pixels[40:60] = pixels[10:30]
    data, _ = encode(pixels, width, transforms, rng, **image)
    got, alpha = webp.decode(data)
    assert alpha and got.shape == (len(pixels) // width, width, 4)
    b = np.array(pixels, np.uint32)
    want = np.stack([b >> 16 & 255, b >> 8 & 255, b & 255, b >> 24], -1).astype(np.uint8).reshape(got.shape)
    assert (got == want).all()


def test_own_files_and_broken_ones():
    r = np.random.default_rng(3)
    for h, w, k in ((1, 1, 1), (3, 64, 256), (5, 7, 2), (40, 64, 57)):
        rgb = r.integers(0, k, (h, w, 3)).astype(np.uint8)
        got, alpha = webp.decode(webp.encode(rgb))
        assert not alpha and (got[..., :3] == rgb).all() and (got[..., 3] == 255).all()
    data = webp.encode(r.integers(0, 256, (4, 64, 3)).astype(np.uint8))
    for bad in (b"", b"RIFF1234WEBPVP8 ", data[:20] + b"\0" + data[21:], data[:16] + struct.pack("<I", 40) + data[20:60]):
        with pytest.raises((webp.WebPError, struct.error)):
            webp.decode(bad)


def test_files_of_every_way_are_read_in_step():
    """The encoder's own files: each way, palettes and back-references are met, and the decoders agree."""
    import random

    from signalframe.llm import media

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() for _ in range(r.randint(1, 400))) for _ in range(150)]
    texts += ["Ver " * 900, "é" * 3000, "", "x" * 192, texts[0] + texts[1] + texts[0] + texts[0], "ab" * 40_000]
    payloads = [t.encode() + b" " * (max(192, -(-len(t.encode()) // 192) * 192) - len(t.encode())) for t in texts]
    stored = [media.to_media(p) for p in payloads]
    kinds, seen = set(), webp.Known()
    for m in stored:
        bits = webp.Bits(m[20:], 40)
        kinds.add(bits.read(2) >> 1 if bits.peek(1) and bits.peek(3) >> 1 != webp.PALETTE else "palette" if bits.peek(1) else "plain")
    assert "plain" in kinds and "palette" in kinds and len(kinds) >= 3
    side_by_side = media.many_pixels(stored, seen)
    assert len(seen.codes) == 1 and len(seen.heads) > 3
    for p, m, x in zip(payloads, stored, side_by_side, strict=True):
        assert x.tobytes() == p == media.to_pixels(m).tobytes()
    flat = np.frombuffer(payloads[-2], np.uint8).reshape(-1, 3)
    assert webp._matches(np.pad(flat, ((0, 0), (0, 1))).view("<u4")[:, 0]), "a repeated text has back-references"


def test_broken_files_are_refused_in_step():
    from signalframe.llm import media

    stored = [media.to_media(bytes(range(33, 33 + 64)) * 3 * n) for n in range(20, 60)]
    assert len(webp.decode_many(stored, webp.Known())) == 40
    with pytest.raises(webp.WebPError):
        webp.decode_many([s[: len(s) // 2] for s in stored], webp.Known())
