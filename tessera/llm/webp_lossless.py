"""Lossless WebP: decoder for every feature of the bit stream, writer, and column operators.

``decode`` reads prefix codes, back-references, the colour cache and meta prefix groups, and
inverts the predictor, cross-colour, subtract-green and palette transforms. ``decode_many``
reads a batch: streams of one varying channel, with back-references, colour cache, and what
inverts subtract-green, a predictor of one mode or a palette, are decoded in lockstep, one
pixel of all images at a time, and any other stream by ``decode``.

A payload is stored as grey images of 24 pixels a row, at most TILE bytes each; several images
follow each other (each RIFF chunk holds its own size). For each image ``encode_grey`` takes the
smallest of these forms: subtract-green, the best predictor before it, or a palette that packs
pixels; each with and without back-references, and with the colour caches of CACHES where the image
has few colours. Sizes are compared by estimates.
All work is a projection over Arrow batches.

Defined results: null text is empty; the payload of an empty text is one row block of 255;
equal texts give equal bytes; texts of any length become as many images as needed; an empty
table gives an empty result; further columns pass through (clashing names are replaced).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import _Local, arrow_batches, by_value

by_value(__name__)

UNIT, ROW = 576, 24
TILE = UNIT * 24
LIMIT = 9  # longest code of the writer
CACHES = (0, 1, 2, 3)  # bits of the colour cache that the writer tries, beyond 0 in images of at most FEW colours
FEW = 32
MODES = (1, 2, 4, 7, 11, 12)  # predictors that the writer tries
GRAM = 5  # equal bytes that may begin a back-reference
LONGEST = 4096  # pixels of a back-reference
WRITE_BATCH, READ_BATCH = 1 << 20, 4 << 20  # bytes of pixels and of files that are handled at once

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
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
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        if not n:
            return 0
        first, shift = self.at >> 3, self.at & 7
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the bit stream is too short")
        return (int.from_bytes(self.data[first : first + 5], "little") >> shift) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)


def reversed_bits(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


class Code:
    """Canonical prefix code from code lengths; a lone symbol takes no bits."""

    def __init__(self, lengths: list[int] | dict[int, int]):
        pairs = sorted((n, s) for s, n in (lengths.items() if isinstance(lengths, dict) else enumerate(lengths)) if n)
        self.only = pairs[0][1] if len(pairs) == 1 else None
        if not pairs:
            self.only = 0
        self.codes, self.table, self.width = {}, {}, 0
        if self.only is None:
            if sum(1 << (15 - n) for n, _ in pairs) != 1 << 15:
                raise ValueError("a prefix code is not complete")
            code, before = 0, pairs[0][0]
            for n, s in pairs:
                code <<= n - before
                before = n
                self.codes[s] = (reversed_bits(code, n), n)
                code += 1
            self.width = pairs[-1][0]
            self.table = {(c, n): s for s, (c, n) in self.codes.items()}

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        look = bits.peek(self.width)
        for n in range(1, self.width + 1):
            s = self.table.get((look & ((1 << n) - 1), n))
            if s is not None:
                bits.at += n
                return s
        raise ValueError("no such code")


_TABLES: dict = _Local()


def _length_table(lengths: tuple[int, ...]) -> list[int]:
    """Symbol << 4 | bits for what is read next, of a code of code lengths."""
    if lengths not in _TABLES:
        code = Code(list(lengths))
        look = [0] * (1 << code.width) if code.only is None else [code.only << 4]
        for s, (c, n) in code.codes.items():
            look[c :: 1 << n] = [s << 4 | n] * (1 << code.width - n)
        if len(_TABLES) > 1000:
            _TABLES.clear()
        _TABLES[lengths] = look
    return _TABLES[lengths]


def read_lengths(bits: Bits, size: int) -> dict[int, int]:
    """Code length of each used symbol."""
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        return dict.fromkeys(symbols, 1)
    lengths = [0] * 19
    for i in range(4 + bits.read(4)):
        lengths[LENGTH_ORDER[i]] = bits.read(3)
    look = _length_table(tuple(lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    first, at, mask = bits.at >> 3, bits.at & 7, len(look) - 1
    window = int.from_bytes(bits.data[first : first + 2 * size + 2], "little")  # at most 14 bits a symbol
    out, i, before = {}, 0, 8
    while i < size and left:
        left -= 1
        got = look[window >> at & mask]
        at += got & 15
        s = got >> 4
        if s < 16:
            if s:
                out[i] = before = s
            i += 1
        elif s == 16:
            n = 3 + (window >> at & 3)
            out.update(dict.fromkeys(range(i, i + n), before))
            i, at = i + n, at + 2
        elif s == 17:
            i, at = i + 3 + (window >> at & 7), at + 3
        else:
            i, at = i + 11 + (window >> at & 127), at + 7
    bits.at = 8 * first + at
    if bits.at > 8 * len(bits.data):
        raise ValueError("the bit stream is too short")
    if i > size:
        raise ValueError("too many code lengths")
    return out


def _extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def read_groups(bits: Bits, width: int, height: int, main: bool):
    """(cache bits, tile bits, group of each tile, code lengths of the prefix groups)."""
    cache = bits.read(4) if bits.read(1) else 0
    tile, groups = 0, None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        groups = [(p >> 8) & 0xFFFF for p in read_pixels(bits, -(-width // (1 << tile)), -(-height // (1 << tile)), False)]
    count = max(groups) + 1 if groups else 1
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    return cache, tile, groups, [[read_lengths(bits, n) for n in sizes] for _ in range(count)]


def read_pixels(bits: Bits, width: int, height: int, main: bool, groups=None) -> list[int]:
    """ARGB values of an entropy-coded image, back-references and colour cache resolved."""
    cache, tile, of, lengths = groups or read_groups(bits, width, height, main)
    codes = [[Code(x) for x in group] for group in lengths]
    out: list[int] = []
    colours, across = [0] * (1 << cache), -(-width // (1 << tile))
    total, done = width * height, 0

    def remember(upto):
        nonlocal done
        while done < upto:
            colours[(CACHE_FACTOR * out[done] & 0xFFFFFFFF) >> (32 - cache)] = out[done]
            done += 1

    while len(out) < total:
        i = len(out)
        group = codes[of[(i // width >> tile) * across + (i % width >> tile)]] if of else codes[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = _extra(bits, s - 256)
            d = _extra(bits, group[4].read(bits))
            if d > 120:
                d -= 120
            else:
                d = max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * width)
            if d > i or n > total - i:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out.append(out[-d])
        else:
            if cache:
                remember(len(out))
            out.append(colours[s - 280])
        if cache and s < 280:
            remember(len(out))
    return out


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """Predictor modes; right is top-right, corner is top-left."""

    def mean(a, b):
        return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)

    def each(f):
        a, r, g, b = (f(*x) for x in zip(_channels(left), _channels(top), _channels(corner), strict=True))
        return a << 24 | r << 16 | g << 8 | b

    def clamp(v):
        return min(255, max(0, v))

    def select():
        far_left = sum(abs(t - c) for t, c in zip(_channels(top), _channels(corner), strict=True))
        far_top = sum(abs(x - c) for x, c in zip(_channels(left), _channels(corner), strict=True))
        return left if far_left < far_top else top

    def half(x, t, c):
        m = (x + t) >> 1
        return clamp(m + int((m - c) / 2))

    return (
        lambda: 0xFF000000, lambda: left, lambda: top, lambda: right, lambda: corner,
        lambda: mean(mean(left, right), top), lambda: mean(left, corner), lambda: mean(left, top),
        lambda: mean(corner, top), lambda: mean(top, right), lambda: mean(mean(left, corner), mean(top, right)),
        select, lambda: each(lambda x, t, c: clamp(x + t - c)), lambda: each(half), lambda: 0xFF000000, lambda: 0xFF000000,
    )[mode]()


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0xFF00FF) + (b & 0xFF00FF) & 0xFF00FF)


def _sub(a: int, b: int) -> int:
    w, x, y, z = ((p - q) & 255 for p, q in zip(_channels(a), _channels(b), strict=True))
    return w << 24 | x << 16 | y << 8 | z


def _predictor(pixels: list[int], width: int, bits: int, modes: list[int], inverse: bool) -> list[int]:
    out, across = [], -(-width // (1 << bits))
    full = out if inverse else pixels
    for i, p in enumerate(pixels):
        x, y = i % width, i // width
        if not i:
            guess = 0xFF000000
        elif not y:
            guess = full[i - 1]
        elif not x:
            guess = full[i - width]
        else:
            mode = modes[(y >> bits) * across + (x >> bits)] >> 8 & 15
            guess = _predict(mode, full[i - 1], full[i - width], full[i - width + 1], full[i - width - 1])
        out.append(_add(p, guess) if inverse else _sub(p, guess))
    return out


def _signed(v: int) -> int:
    return v - 256 if v > 127 else v


def _cross(pixels: list[int], width: int, bits: int, factors: list[int], inverse: bool) -> list[int]:
    out, across = [], -(-width // (1 << bits))
    for i, p in enumerate(pixels):
        _, red_blue, green_blue, green_red = _channels(factors[(i // width >> bits) * across + (i % width >> bits)])
        a, r, g, b = _channels(p)
        by = lambda t, c: _signed(t) * _signed(c) >> 5
        r2 = (r + (by(green_red, g) if inverse else -by(green_red, g))) & 255
        shift = by(green_blue, g) + by(red_blue, r2 if inverse else r)
        out.append(a << 24 | r2 << 16 | g << 8 | (b + (shift if inverse else -shift)) & 255)
    return out


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _unpack(pixels: list[int], width: int, bits: int, table: list[int]) -> list[int]:
    """Palette indexes, several in a green value, to colours; indexes beyond the table are transparent black."""
    packed, depth = -(-width // (1 << bits)), 8 >> bits
    out = []
    for y in range(len(pixels) // packed if packed else 0):
        for x in range(width):
            v = pixels[y * packed + (x >> bits)] >> 8 & 255
            k = v >> depth * (x & ((1 << bits) - 1)) & ((1 << depth) - 1)
            out.append(table[k] if k < len(table) else 0)
    return out


def _open(data: bytes) -> tuple[Bits, int, int]:
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]], 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return bits, width, height


def _transforms(bits: Bits, width: int, height: int):
    """(transforms as read, width of the coded image)."""
    found = []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            n = bits.read(3) + 2
            found.append((kind, width, n, read_pixels(bits, -(-width // (1 << n)), -(-height // (1 << n)), False)))
        elif kind == GREEN:
            found.append((kind, width, 0, None))
        else:
            size = bits.read(8) + 1
            table = read_pixels(bits, size, 1, False)
            for i in range(1, size):
                table[i] = _add(table[i], table[i - 1])
            found.append((kind, width, _palette_bits(size), table))
            width = -(-width // (1 << _palette_bits(size)))
    return found, width


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """width, height and ARGB pixels (uint32) of a lossless WebP file."""
    bits, width, height = _open(data)
    transforms, coded = _transforms(bits, width, height)
    pixels = read_pixels(bits, coded, height, True)
    for kind, w, n, more in reversed(transforms):
        if kind == PREDICTOR:
            pixels = _predictor(pixels, w, n, more, True)
        elif kind == CROSS:
            pixels = _cross(pixels, w, n, more, True)
        elif kind == GREEN:
            pixels = [_green(p) for p in pixels]
        else:
            pixels = _unpack(pixels, w, n, more)
    return width, height, np.array(pixels, dtype=np.uint32)


def _green(p: int) -> int:
    a, r, g, b = _channels(p)
    return a << 24 | (r + g & 255) << 16 | g << 8 | (b + g & 255)


# ------------------------------------------------------------------ writing


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n


LENGTH_CODES = {s: reversed_bits(i, 4) for i, s in enumerate([*range(14), 17, 18])}


def write_lengths(w: Writer, lengths: dict[int, int], size: int) -> None:
    """A prefix code: one or two symbols below 256 in simple form, else code lengths with runs of zeros."""
    if len(lengths) == 2 and max(lengths) < 256:
        w.put(7, 3)
        for s in sorted(lengths):
            w.put(s, 8)
        return
    if len(lengths) <= 1 and next(iter(lengths), 0) < 256:
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(next(iter(lengths), 0), 8)
        return
    w.put(0, 1), w.put(13, 4)
    for s in LENGTH_ORDER[:17]:  # 16 symbols of 4 bits: lengths 0 to 13 and both runs of zeros
        w.put(0 if s == 16 else 4, 3)
    w.put(0, 1)
    codes = LENGTH_CODES
    at = 0
    for s in [*sorted(lengths), size]:
        gap = s - at
        while gap:
            if gap < 3:
                w.put(codes[0], 4)
                gap -= 1
            elif gap < 11:
                w.put(codes[17], 4), w.put(gap - 3, 3)
                gap = 0
            else:
                n = min(gap, 138)
                w.put(codes[18], 4), w.put(n - 11, 7)
                gap -= n
        if s < size:
            w.put(codes[lengths[s]], 4)
        at = s + 1


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of complete prefix codes, a row of counts each; a lone symbol has length 1.

    Rounded information content first; then the rarest symbols are lengthened, or the most
    frequent that fit are shortened, until each code is exactly complete.
    """
    used = counts > 0
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    length = np.where(used, np.clip(np.ceil(-np.log2(np.where(used, p, 1.0))), 1, limit), 0).astype(np.int64)
    room = 1 << limit
    lanes = np.flatnonzero(used.sum(1) > 1)
    while len(lanes):
        part, n = length[lanes], counts[lanes]
        share = np.where(part > 0, room >> np.minimum(part, limit), 0)
        slack = room - share.sum(1)
        lanes, part, n, share, slack = (x[slack != 0] for x in (lanes, part, n, share, slack))
        if not len(lanes):
            break
        over = slack < 0
        can = np.where(over[:, None], (part > 0) & (part < limit), (part > 1) & (share <= slack[:, None]))
        # Lengthen what is rare and long, shorten what is frequent.
        worth = np.where(over[:, None], -(n * (1 << 20) + share), n)
        pick = np.where(can, worth, np.iinfo(np.int64).min).argmax(1)
        length[lanes, pick] += np.where(over, 1, -1)
    return length


def _file(value: bytes) -> bytes:
    body = b"\x2f" + value
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(body) % 2) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


REVERSED = np.array([reversed_bits(i, LIMIT) for i in range(1 << LIMIT)], np.int64)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Prefix codes of rows of code lengths (at most LIMIT), first bit lowest; a lone symbol takes no bits."""
    codes, start = np.zeros(lengths.shape, np.int64), np.zeros(len(lengths), np.int64)
    for n in range(1, LIMIT + 1):
        mine = lengths == n
        rank = np.cumsum(mine, 1)
        value = start[:, None] + rank - 1
        codes[mine] = REVERSED[value[mine] << LIMIT - n & (1 << LIMIT) - 1]
        start = start + rank[:, -1] << 1
    return codes


def _prefixes(top: int = TILE + 120) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of every length or distance code up to ``top``."""
    v = np.maximum(np.arange(top + 1) - 1, 0)
    n = np.maximum(np.frexp(v)[1] - 2, 0)
    return np.where(v < 4, v, 2 * n + 2 + (v >> n & 1)), v & (1 << n) - 1, n


PREFIX, EXTRA, EXTRA_BITS = _prefixes()


def _near(width: int) -> np.ndarray:
    """Code of each distance (0: none below 120) in images of ``width``."""
    out = np.zeros(TILE + 1, np.int64)
    for k in range(120, 0, -1):
        out[max(1, NEAR[k - 1][0] + NEAR[k - 1][1] * width)] = k
    return out


NEAR_CODES = {w: _near(w) for w in (ROW, ROW // 2, ROW // 4, ROW // 8)}


def _guess(mode: int, left, top, right, corner):
    """Predictor modes on one channel of grey pixels (signed arrays)."""
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode == 11:
        return np.where(np.abs(top - corner) < np.abs(left - corner), left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = left + top >> 1
        half = m - corner
        return np.clip(m + (half + (half < 0) >> 1), 0, 255)
    pair = {1: (left, left), 2: (top, top), 3: (right, right), 4: (corner, corner), 6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}
    a, b = pair[mode]
    return a + b >> 1


def _residuals(data: np.ndarray, at: np.ndarray, modes):
    """Green values that a predictor of one mode leaves of grey images, by mode; ``at``: position in the image."""
    x = np.concatenate([np.zeros(ROW + 1, np.int16), data.astype(np.int16)])
    left, top, right, corner = (x[ROW + 1 - d : ROW + 1 - d + len(data)] for d in (1, ROW, ROW - 1, ROW + 1))
    edge, above = np.flatnonzero(at % ROW == 0), np.flatnonzero(at < ROW)
    at_edge, before = top[edge], np.where(at[above] == 0, 0, left[above])
    for m in modes:
        guess = _guess(m, left, top, right, corner).astype(np.uint8)
        guess[edge] = at_edge
        guess[above] = before
        yield m, data - guess


def _information(counts: np.ndarray) -> np.ndarray:
    """Bits of each row of counts under its own frequencies."""
    total = counts.sum(1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(1)


def _cost(counts: np.ndarray) -> np.ndarray:
    """About the bits of rows of symbols and of their prefix codes: of few symbols by code lengths, of many by information."""
    used = counts > 0
    many = used.sum(1)
    gaps = (used[:, :-1] & ~used[:, 1:]).sum(1) + 1
    simple = (many < 3) & ~used[:, 256:].any(1)
    bits = _information(counts)
    few = np.flatnonzero((many > 1) & (many <= 20))
    if len(few):
        n = np.sort(counts[few], 1)[:, -20:]  # which symbols they are doesn't matter
        bits[few] = (n * code_lengths(n)).sum(1)
    return bits + np.where(simple, 11 + 8 * (many == 2), 57 + 4 * many + 9 * gaps)


def _forms(data: np.ndarray, size: np.ndarray, lane: np.ndarray, at: np.ndarray):
    """Candidates: (tile, transform, its mode or bits, width, green values), as lists."""
    tiles = len(size)
    counts = np.bincount(lane * 256 + data, minlength=256 * tiles).reshape(-1, 256)
    plain = _information(counts)
    first = np.cumsum(size) - size
    out = [(i, GREEN, 0, ROW, data[f : f + n]) for i, (f, n) in enumerate(zip(first.tolist(), size.tolist(), strict=True))]
    best, mode = np.full(tiles, np.inf), np.zeros(tiles, np.int64)
    row = lane * 256
    for m, left in _residuals(data, at, MODES):
        bits = _information(np.bincount(row + left, minlength=256 * tiles).reshape(-1, 256))
        mode = np.where(bits < best, m, mode)
        best = np.minimum(bits, best)
    good = best < plain
    for m in np.unique(mode[good]).tolist():
        for i in np.flatnonzero(good & (mode == m)).tolist():
            part = slice(int(first[i]), int(first[i] + size[i]))
            out.append((i, PREDICTOR, m, ROW, next(_residuals(data[part], at[part], [m]))[1]))
    colours = (counts > 0).sum(1)
    for i in np.flatnonzero(colours <= 16).tolist():
        bits = _palette_bits(int(colours[i]))
        rank = (np.cumsum(counts[i] > 0) - 1).astype(np.uint8)
        index = rank[data[first[i] : first[i] + size[i]]].reshape(-1, 1 << bits)
        packed = (index << (np.arange(1 << bits) * (8 >> bits)).astype(np.uint8)).sum(1).astype(np.uint8)
        out.append((i, PALETTE, bits, ROW >> bits, packed))
    return out, counts


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on, the first lowest."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()


def _matches(words: np.ndarray, lane: np.ndarray, first: np.ndarray, end: np.ndarray):
    """Distance (0: none) and length of the match with the nearest earlier place of the same GRAM bytes."""
    n = len(lane)
    every = np.arange(n, dtype=np.int32)
    index = np.flatnonzero(every <= end - GRAM)
    low = words[index] & np.uint64((1 << 8 * GRAM) - 1)
    shift = np.uint64(n.bit_length())
    h = low * np.uint64(0x9E3779B97F4A7C15) + lane[index].astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)
    keys = np.sort(h >> shift << shift | index.astype(np.uint64))
    same = keys[1:] >> shift == keys[:-1] >> shift
    place = (keys & np.uint64((1 << int(shift)) - 1)).astype(np.int64)
    here, there = place[1:][same], place[:-1][same]
    far, length = np.zeros(n, np.int32), np.zeros(n, np.int32)
    ok = there >= first[lane[here]]
    here, there = here[ok], there[ok]
    far[here] = here - there
    for k in range(0, 32, 8):
        x = words[here + k] ^ words[there + k]
        equal = np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1 >> 3
        equal = np.where(x == 0, 8, equal)
        length[here] = k + equal
        here, there = here[equal == 8], there[equal == 8]
    length = np.minimum(length, end - every)
    far[length < GRAM] = 0
    # Where the next place has the same distance, its match goes on with this one.
    last = np.append((far[1:] != far[:-1]) | (lane[1:] != lane[:-1]), True)
    stop = np.minimum.accumulate(np.where(last, every, n)[::-1])[::-1]
    return far, np.where(far > 0, np.minimum(stop - every + length[stop], LONGEST), 0)


def _references(v: np.ndarray, lane: np.ndarray, size: np.ndarray, cost: np.ndarray):
    """(places, lengths, distances) of the back-references of each candidate; ``cost``: bits of a literal."""
    n = len(v)
    end = np.cumsum(size)
    first = end - size
    words = _words(np.concatenate([v, np.zeros(48, np.uint8)]))
    ends = end.astype(np.int32)[lane]
    gain = np.zeros(n, np.float32)
    far, length = _matches(words, lane, first, ends)
    some = np.flatnonzero(far)
    gain[some] = length[some] * cost.astype(np.float32)[lane[some]] - np.float32(11) - np.log2(far[some] + np.float32(1))
    use = gain > 0
    use[:-1] &= (gain[1:] <= gain[:-1]) | (lane[1:] != lane[:-1])  # a literal first, where the next match is better
    # From each place the next reference; then all candidates at once, from one to the next.
    following = np.minimum.accumulate(np.append(np.where(use, np.arange(n, dtype=np.int32), n), n)[::-1])[::-1]
    live, found = np.arange(len(size)), []
    at = following[first]
    while True:
        inside = at < end[live]
        live, at = live[inside], at[inside]
        if not len(live):
            break
        found.append(at)
        at = following[at + length[at]]
    at = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return at, length[at].astype(np.int64), far[at].astype(np.int64)


def _cache_hits(v: np.ndarray, lane: np.ndarray, alpha: np.ndarray, bits: int) -> np.ndarray:
    """Index of each pixel in a colour cache that holds it, else -1."""
    slots = [(CACHE_FACTOR * (a << 24 | np.arange(256) << 8) & 0xFFFFFFFF) >> 32 - bits for a in (0, 255)]
    slot = np.where(alpha[lane] == 0, slots[0][v], slots[1][v])
    out = np.full(len(v), -1, np.int64)
    for k in range(1 << bits):
        mine = np.flatnonzero(slot == k)
        hit = (v[mine[1:]] == v[mine[:-1]]) & (lane[mine[1:]] == lane[mine[:-1]])
        out[mine[1:][hit]] = k
    return out


def _head(tile: int, kind: int, arg: int, colours: np.ndarray) -> Writer:
    """All of an image before its prefix codes, as far as it doesn't depend on the pixels' order."""
    w = Writer()
    w.put(ROW - 1, 14), w.put(tile // ROW - 1, 14), w.put(0, 1), w.put(0, 3)
    if kind == PREDICTOR:
        # A row of images of 512 x 512 pixels: one mode for all.
        w.put(1, 1), w.put(PREDICTOR, 2), w.put(7, 3), w.put(0, 1)
        for s, n in ((arg, 280), (0, 256), (0, 256), (255, 256), (0, 40)):
            write_lengths(w, {s: 1}, n)
    if kind == PALETTE:
        table = [0xFF000000 | int(c) * 0x10101 for c in colours]
        w.put(1, 1), w.put(PALETTE, 2), w.put(len(table) - 1, 8)
        _write_image(w, [_sub(p, q) for p, q in zip(table, [0, *table[:-1]], strict=True)], len(table), 0, False, False)
    else:
        w.put(1, 1), w.put(GREEN, 2)
    w.put(0, 1)
    return w


def encode_grey(tiles: list[bytes]) -> list[bytes]:
    """Grey images of ROW pixels a row, as lossless WebP, each in its smallest form; all tiles at once."""
    size = np.array([len(t) for t in tiles])
    data = np.frombuffer(b"".join(tiles), np.uint8)
    lane = np.repeat(np.arange(len(tiles)), size)
    forms, colours = _forms(data, size, lane, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size))
    tile, kind, arg, width = (np.array([f[k] for f in forms]) for k in range(4))
    heads = [_head(int(size[t]), k, a, np.flatnonzero(colours[t])) if k != GREEN else None for t, k, a, _, _ in forms]
    size = np.array([len(f[4]) for f in forms])
    v = np.concatenate([f[4] for f in forms])
    many = len(forms)
    del forms
    lane = np.repeat(np.arange(many), size)
    counts = np.bincount(lane * 256 + v, minlength=256 * many).reshape(-1, 256)
    places, length, far = _references(v, lane, size, _information(counts) / size)
    # Symbols: a pixel, or a reference; pixels that a reference covers are none.
    cover = np.zeros(len(v) + 1, np.int32)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + length, -1)
    covered = np.cumsum(cover[:-1]) > 0
    owner = lane[places]
    near = np.zeros(len(places), np.int64)
    for w, codes in NEAR_CODES.items():
        mine = width[owner] == w
        near[mine] = codes[far[mine]]
    near = np.where(near > 0, near, far + 120)
    extra = np.bincount(owner, weights=EXTRA_BITS[length] + EXTRA_BITS[near], minlength=many)
    lengths_used = np.bincount(owner * 24 + PREFIX[length], minlength=24 * many).reshape(-1, 24)
    distances = np.bincount(owner * 40 + PREFIX[near], minlength=40 * many).reshape(-1, 40)
    far_cost = _cost(distances)
    alpha = np.where(kind == PREDICTOR, 0, 255)
    fixed = np.array([h.n if h else 36 for h in heads])
    top = 280 + (1 << max(CACHES))
    best, choice = np.full(many, np.inf), np.zeros((many, 2), np.int64)
    tried, hits = np.arange(many), np.full(len(v), -1, np.int64)
    for cache in CACHES:
        # A larger cache is tried where the one before it made the image smaller.
        index = np.flatnonzero((np.bincount(tried, minlength=many) > 0)[lane]) if cache else slice(None)
        sym, held = v[index].astype(np.int64), None
        if cache:
            held = _cache_hits(v[index], lane[index], alpha, cache)
            sym = np.where(held >= 0, 280 + held, sym)
        sym += (np.cumsum(np.bincount(tried, minlength=many)) - 1)[lane[index]] * top
        shrunk = np.zeros(many, bool)
        for refs in (False, True):
            mine = tried if not cache else tried[choice[tried, 1] == refs]  # with a cache: references as without one
            if not len(mine):
                continue
            n = np.bincount(sym[~covered[index]] if refs else sym, minlength=top * len(tried)).reshape(-1, top)
            if cache:
                n = n[choice[tried, 1] == refs]
            bits = fixed[mine] + 4.0 * bool(cache)
            if refs:
                n[:, 256:280] = lengths_used[mine]
                bits = bits + (far_cost + extra)[mine]
            bits = bits + _cost(n)
            less = bits < best[mine]
            choice[mine[less]] = (cache, refs)
            best[mine[less]] = bits[less]
            shrunk[mine[less]] = True
        if cache:
            new = shrunk[lane[index]]
            hits[index[new]] = held[new]
        tried = np.flatnonzero(shrunk & ((counts > 0).sum(1) <= FEW))
        if not len(tried):
            break
    # The smallest candidate of each tile.
    order = np.lexsort((np.arange(many), best, tile))
    chosen = np.zeros(many, bool)
    chosen[order[np.append(True, tile[order[1:]] != tile[order[:-1]])]] = True
    refs = choice[:, 1] > 0
    keep = chosen[lane] & ~(covered & refs[lane])
    starts = np.zeros(len(v), bool)
    kept = (chosen & refs)[owner]
    starts[places[kept]] = True
    index = np.flatnonzero(keep | starts)
    sym, who = v[index].astype(np.int64), lane[index]
    sym = np.where(hits[index] >= 0, 280 + hits[index], sym)
    is_ref = np.flatnonzero(starts[index])
    sym[is_ref] = 256 + PREFIX[length[kept]]
    rows = np.cumsum(chosen) - 1
    green = np.bincount(rows[who] * top + sym, minlength=top * int(chosen.sum())).reshape(-1, top)
    distances = np.where(refs[chosen, None], distances[chosen], 0)
    green_lengths, far_lengths = code_lengths(green), code_lengths(distances)
    green_codes, far_codes = canonical(green_lengths), canonical(far_lengths)
    writers = []
    for k, i in enumerate(np.flatnonzero(chosen).tolist()):
        w = heads[i] or _head(len(tiles[tile[i]]), GREEN, 0, colours[tile[i]])
        cache = int(choice[i, 0])
        w.put(cache > 0, 1)
        if cache:
            w.put(cache, 4)
        w.put(0, 1)
        write_lengths(w, {int(s): int(green_lengths[k, s]) for s in np.flatnonzero(green_lengths[k])}, 280 + (1 << cache if cache else 0))
        for s, n in ((0, 256), (0, 256), (int(alpha[i]), 256)):
            write_lengths(w, {s: 1}, n)
        write_lengths(w, {int(s): int(far_lengths[k, s]) for s in np.flatnonzero(far_lengths[k])}, 40)
        writers.append(w)
    for x in (green_lengths, far_lengths):
        x[(x > 0).sum(1) == 1] = 0  # a lone symbol takes no bits
    who = rows[who]
    value, n = green_codes[who, sym], green_lengths[who, sym]
    r, d, k = who[is_ref], near[kept], length[kept]
    for x, bits in ((EXTRA[k], EXTRA_BITS[k]), (far_codes[r, PREFIX[d]], far_lengths[r, PREFIX[d]]), (EXTRA[d], EXTRA_BITS[d])):
        value[is_ref] |= x << n[is_ref]
        n[is_ref] += bits
    files = _join(writers, who, value, n)
    out: list = [None] * len(tiles)
    for t, f in zip(tile[chosen].tolist(), files, strict=True):
        out[t] = f
    return out


def _join(writers: list[Writer], who: np.ndarray, value: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Files of what the writers hold and of each one's values of ``n`` bits (at most 56)."""
    before = np.cumsum(n) - n
    total = np.bincount(who, weights=n, minlength=len(writers)).astype(np.int64)
    head = np.array([w.n for w in writers])
    length = -(-(head + total) // 8)
    base = np.cumsum(length) - length
    place = before + (head + 8 * base - (np.cumsum(total) - total))[who]
    v = value << (place & 7)
    first, bits = place >> 3, n + (place & 7)
    out = np.zeros(int(length.sum()), np.uint8)
    while len(v):
        out |= np.bincount(first, weights=v & 255, minlength=len(out)).astype(np.uint8)
        more = np.flatnonzero(bits > 8)
        first, v, bits = first[more] + 1, v[more] >> 8, bits[more] - 8
    files = []
    for w, b, k in zip(writers, base.tolist(), length.tolist(), strict=True):
        mine = out[b : b + k]
        h = np.frombuffer(w.value.to_bytes(-(-w.n // 8), "little"), np.uint8)
        mine[: len(h)] |= h
        files.append(_file(mine.tobytes()))
    return files


def encode_argb(pixels: list[int], width: int, predictor: int | None = None, cross: int | None = None, green: bool = False, palette: bool = False, cache: int = 0, references: bool = True) -> bytes:
    """Any ARGB image with the chosen transforms, colour cache and back-references (one symbol at a time)."""
    w, height, size = Writer(), len(pixels) // width, 2
    w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    coded = width

    def block(kind):
        w.put(1, 1), w.put(kind, 2)

    if palette:
        table = sorted(set(pixels))
        block(PALETTE)
        w.put(len(table) - 1, 8)
        _write_image(w, [_sub(p, q) for p, q in zip(table, [0, *table[:-1]], strict=True)], len(table), 0, False, False)
        bits = _palette_bits(len(table))
        at = {c: i for i, c in enumerate(table)}
        coded, packed = -(-width // (1 << bits)), []
        for y in range(height):
            for x in range(coded):
                v = 0
                for k, p in enumerate(pixels[y * width + (x << bits) : y * width + min(width, (x + 1) << bits)]):
                    v |= at[p] << k * (8 >> bits)
                packed.append(0xFF000000 | v << 8)
        pixels = packed
    for kind, value in ((PREDICTOR, predictor), (CROSS, cross)):
        if value is not None:
            n = -(-coded // (1 << size)) * -(-height // (1 << size))
            image = [0xFF000000 | value << 8] * n if kind == PREDICTOR else [0xFF000000 | value] * n
            pixels = (_predictor if kind == PREDICTOR else _cross)(pixels, coded, size, image, False)
            block(kind)
            w.put(size - 2, 3)
            _write_image(w, image, -(-coded // (1 << size)), 0, False, False)
    if green:
        block(GREEN)
        pixels = [_sub(p, (p >> 8 & 255) * 0x10001) for p in pixels]
    w.put(0, 1)
    _write_image(w, pixels, coded, cache, references, True)
    return _file(w.value.to_bytes(-(-w.n // 8), "little"))


def _write_image(w: Writer, pixels: list[int], width: int, cache: int, references: bool, main: bool) -> None:
    colours, symbols, last = [None] * (1 << cache), [], {}
    i = 0
    while i < len(pixels):
        n, d = 0, 0
        if references and i + 3 <= len(pixels) and (j := last.get(tuple(pixels[i : i + 3]))) is not None:
            while i + n < len(pixels) and n < 4096 and pixels[j + n] == pixels[i + n]:
                n += 1
            d = i - j
        step = n if n >= 3 else 1
        if n >= 3:
            symbols.append(("ref", n, d + 120))
        elif cache and colours[k := (CACHE_FACTOR * pixels[i] & 0xFFFFFFFF) >> (32 - cache)] == pixels[i]:
            symbols.append(("cache", k, 0))
        else:
            symbols.append(("pixel", pixels[i], 0))
        for k in range(i, i + step):
            if cache:
                colours[(CACHE_FACTOR * pixels[k] & 0xFFFFFFFF) >> (32 - cache)] = pixels[k]
            last[tuple(pixels[k : k + 3])] = k
        i += step

    def prefix(v):
        if v <= 4:
            return v - 1, 0, 0
        v -= 1
        n = v.bit_length() - 2
        return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n

    use = [{} for _ in range(5)]
    stream = []
    for kind, a, b in symbols:
        if kind == "pixel":
            al, r, g, bl = _channels(a)
            items = [(0, g, 0, 0), (1, r, 0, 0), (2, bl, 0, 0), (3, al, 0, 0)]
        elif kind == "cache":
            items = [(0, 280 + a, 0, 0)]
        else:
            p, e, n = prefix(a)
            q, f, m = prefix(b)
            items = [(0, 256 + p, e, n), (4, q, f, m)]
        for c, s, *_ in items:
            use[c][s] = use[c].get(s, 0) + 1
        stream += items
    w.put(cache > 0, 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(0, 1)
    codes = []
    for c, size in enumerate((280 + (1 << cache if cache else 0), 256, 256, 256, 40)):
        counts = np.zeros((1, size), np.int64)
        for s, n in use[c].items():
            counts[0, s] = n
        row = code_lengths(counts, 13)[0]
        own = {int(s): int(row[s]) for s in np.flatnonzero(row)}
        write_lengths(w, own, size)
        codes.append(Code(own or {0: 1}))
    for c, s, e, n in stream:
        if codes[c].only is None:
            w.put(*codes[c].codes[s])
        w.put(e, n)


# ------------------------------------------------------------------ batches


def _tables(lengths: list[dict[int, int]], size: int, first: int) -> np.ndarray:
    """What each LIMIT bits mean in each code: code bits, extra bits << 4, value << 9 and kind << 31.

    Kinds: 0 pixel, 1 length, 2 distance code, 3 index of the colour cache; ``first``: symbol of the first length or distance.
    """
    n = np.zeros((len(lengths), size), np.int64)
    for row, own in zip(n, lengths, strict=True):
        row[list(own)] = list(own.values())
    lone = np.flatnonzero((n > 0).sum(1) < 2)
    symbol = n[lone].argmax(1)
    n[lone] = 0
    order = np.argsort(np.where(n > 0, n, LIMIT + 1), axis=1, kind="stable")
    by_length = np.take_along_axis(n, order, 1)
    share = np.where(by_length > 0, (1 << LIMIT) >> by_length, 0)
    share[lone, 0] = 1 << LIMIT
    if (share.sum(1) != 1 << LIMIT).any():
        raise ValueError("a prefix code is not complete")
    order[lone, 0] = symbol
    s = np.arange(size)
    p = s - first
    extra = np.where(p < 4, 0, p - 2 >> 1)
    value, kind = np.where(p < 4, p, 2 + (p & 1) << extra) + 1, np.full(size, 1 if first else 2)
    if first:
        value = np.where(s < 256, s, np.where(s < 280, value, s - 280))
        kind = np.where(s < 256, 0, np.where(s < 280, 1, 3))
        extra = np.where(kind == 1, extra, 0)
    meaning = extra << 4 | value << 9 | kind << 31
    out = np.repeat((by_length | meaning[order]).ravel(), share.ravel()).reshape(-1, 1 << LIMIT)
    return out[:, REVERSED].ravel()


def _symbols(lanes: list):
    """(lane, kind, value) of all that is read of each lane, in order; one code of every lane a step.

    A lane may be read on for some steps beyond its last pixel.
    """
    count, cache = (np.array([x[k] for x in lanes]) for k in (2, 3))
    table = np.concatenate([_tables([x[4][0] for x in lanes], 280 + (1 << int(cache.max()) if cache.any() else 0), 256), _tables([x[4][4] for x in lanes], 40, 0)])
    look = _words(np.frombuffer(b"".join(x[0].data for x in lanes) + b"\0" * 1024, np.uint8)).view(np.int64)  # shifted right by at most 7 + LIMIT and masked below
    size = np.array([len(x[0].data) for x in lanes])
    start = 8 * (np.cumsum(size) - size)
    at, last = start + np.array([x[0].at for x in lanes]), start + 8 * (size + 256)
    room = 2 * count + 72
    base = np.cumsum(room) - room
    got_at, got_value = np.zeros(len(lanes), np.int64), np.zeros(int(room.sum()), np.int32)
    masks, pixels_of = (1 << np.arange(32)) - 1, np.array([1, -1, 0, 1])
    live = np.arange(len(lanes))
    rows = live << LIMIT
    row, left, to, distance = rows, count.copy(), base.copy(), len(lanes) << LIMIT
    mask, step = (1 << LIMIT) - 1, 0
    while len(live):
        for k in range(32):
            if k == 31:
                done = left <= 0  # the last step reads the distance, where the last symbol is a length
            w = look[at >> 3] >> (at & 7)
            got = table[row + (w & mask)]
            n, more = got & 15, got >> 4 & 31
            value, kind = (got >> 9 & 0x3FFFFF) + (w >> n & masks[more]), got >> 31
            at += n + more
            got_value[to + step] = value << 2 | kind
            step += 1
            one = kind == 1
            left -= np.where(one, value, pixels_of[kind])
            row = rows + one * distance
        if (at > last).any():
            raise ValueError("the bit stream is too short")
        if done.any():
            got_at[live[done]] = step
            stay = ~done
            live, at, last, row, rows, left, to = (x[stay] for x in (live, at, last, row, rows, left, to))
    lane = np.repeat(np.arange(len(lanes)), got_at)
    value = got_value[np.arange(len(lane)) + (base - np.cumsum(got_at) + got_at)[lane]]
    return lane, value & 3, value >> 2


def _lockstep(lanes: list) -> np.ndarray:
    """Green values of all lanes (bits, width, pixels, cache bits, code lengths, pixel without green), one after another."""
    width, count, cache, fixed = (np.array([x[k] for x in lanes]) for k in (1, 2, 3, 5))
    lane, kind, value = _symbols(lanes)
    pixels = np.where(kind == 1, value, kind != 2).astype(np.int64)
    after = np.cumsum(pixels)
    used = np.bincount(lane, minlength=len(lanes))
    begin = (after - pixels)[np.cumsum(used) - used]
    x = after - pixels - begin[lane]
    place = np.cumsum(count) - count
    ref = np.flatnonzero((kind == 1) & (x < count[lane]))
    n, who, near = pixels[ref], lane[ref], np.array([(0, 0), *NEAR])
    d = value[ref + 1].astype(np.int64)
    by = near[np.minimum(d, 120)]
    d = np.where(d > 120, d - 120, np.maximum(1, by[:, 0] + by[:, 1] * width[who]))
    if (d > x[ref]).any() or (x[ref] + n > count[who]).any():
        raise ValueError("a back-reference leaves the image")
    out, total = np.zeros(int(count.sum()), np.uint8), int(n.sum())
    inside = (x < count[lane]) & (kind != 1) & (kind != 2)
    plain = np.flatnonzero(inside & (kind == 0))
    out[place[lane[plain]] + x[plain]] = value[plain]
    # Where each copied pixel comes from; then, round by round, where that one comes from.
    copied = np.repeat(place[who] + x[ref] - np.cumsum(n) + n, n) + np.arange(total)
    source = np.arange(len(out))
    source[copied] = copied - np.repeat(d, n)
    caching = np.flatnonzero(cache)
    if len(caching):
        cached = np.flatnonzero(inside & (kind == 3))
        slot = np.full(len(out), -1, np.int16)
        slot[place[lane[cached]] + x[cached]] = value[cached]
        for i in caching.tolist():
            _with_cache(out, source, slot, *(int(q[i]) for q in (place, count, cache, fixed)))
        copied = copied[np.repeat(cache[who] == 0, n)]
    rest = copied
    while len(rest):
        further = source[source[rest]]
        moved = further != source[rest]
        source[rest] = further
        rest = rest[moved]
    out[copied] = out[source[copied]]
    return out


def _with_cache(out, source, slot, place: int, count: int, bits: int, fixed: int) -> None:
    """Pixels of an image with a colour cache, in place."""
    pixels, sources, slots = (x[place : place + count].tolist() for x in (out, source, slot))
    index = ((CACHE_FACTOR * (fixed | np.arange(256) << 8) & 0xFFFFFFFF) >> 32 - bits).tolist()
    colours = [0] * (1 << bits)
    for i in range(count):
        k = slots[i]
        v = pixels[i] = colours[k] if k >= 0 else pixels[sources[i] - place]
        colours[index[v]] = v
    out[place : place + count] = pixels


def _unpredict(residual: np.ndarray, place: np.ndarray, count: np.ndarray, width: np.ndarray, mode: int) -> None:
    """Grey images of one predictor mode, in place: one pixel of every image a step; falling number of pixels."""
    x = residual.astype(np.int32)
    live = len(count)
    for step in range(int(count[0])):
        while count[live - 1] <= step:
            live -= 1
        i, w = place[:live] + step, width[:live]
        left, top, right, corner = (x[np.maximum(i - d, 0)] for d in (1, w, w - 1, w + 1))
        guess = np.where(step % w == 0, top, _guess(mode, left, top, right, corner))
        guess = np.where(step < w, left if step else 0, guess)
        x[i] = x[i] + guess & 255
    for p, n in zip(place.tolist(), count.tolist(), strict=True):
        residual[p : p + n] = x[p : p + n]


def _lane(data: bytes):
    """(lane of `_lockstep`, height, transforms, red, blue and alpha) of a file that it can read, else None."""
    bits, width, height = _open(data)
    transforms, coded = _transforms(bits, width, height)
    cache, _, groups, codes = read_groups(bits, coded, height, True)
    kinds, codes = [t[0] for t in transforms], codes[0]
    if groups is not None or kinds not in ([], [GREEN], [PALETTE], [PREDICTOR, GREEN]):
        return None
    if any(len(c) > 1 for c in codes[1:4]) or any(n > LIMIT for k in (0, 4) for n in codes[k].values()):
        return None
    red, blue, alpha = (next(iter(c), 0) for c in codes[1:4])
    if PREDICTOR in kinds and (red or blue or alpha or len({m >> 8 & 15 for m in transforms[0][3]}) > 1 or not 0 < transforms[0][3][0] >> 8 & 15 < 14):
        return None
    return (bits, coded, coded * height, cache, codes, alpha << 24 | red << 16 | blue), width, height, transforms, (red, blue, alpha)


def decode_many(files: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """width, height and ARGB pixels of each file; streams of one varying channel in lockstep."""
    out: list = [None] * len(files)
    lanes = []
    for i, data in enumerate(files):
        lane = _lane(data)
        if lane is None:
            out[i] = decode(data)
        else:
            lanes.append((i, *lane))
    if not lanes:
        return out
    lanes.sort(key=lambda x: -x[1][2])
    green = _lockstep([x[1] for x in lanes])
    count = np.array([x[1][2] for x in lanes])
    place = np.cumsum(count) - count
    mode = np.array([x[4][0][3][0] >> 8 & 15 if x[4] and x[4][0][0] == PREDICTOR else 0 for x in lanes])
    for m in set(mode.tolist()) - {0}:
        mine = mode == m
        _unpredict(green, place[mine], count[mine], np.array([x[2] for x in lanes])[mine], m)
    for k, (i, _, width, height, transforms, (red, blue, alpha)) in enumerate(lanes):
        g = green[place[k] : place[k] + count[k]]
        kind = transforms[0][0] if transforms else None
        if kind == PALETTE:
            bits, table = transforms[0][2:]
            colours = np.zeros(256, np.uint32)
            colours[: len(table)] = table
            index = g.reshape(height, -1, 1) >> (np.arange(1 << bits) * (8 >> bits)).astype(np.uint8) & np.uint8((1 << (8 >> bits)) - 1)
            pixels = colours[index.reshape(height, -1)[:, :width].ravel()]
        else:
            g = g.astype(np.uint32)
            r, b = (np.uint32(c) + g * np.uint32(kind is not None) & np.uint32(255) for c in (red, blue))
            a = 255 if kind == PREDICTOR else alpha
            pixels = np.uint32(a) << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b
        out[i] = (width, height, pixels)
    return out


def split_files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(media[at : at + n])
        at += n
    return out


def store_texts(texts: list[bytes]) -> list[bytes]:
    """Stored form of each payload (text and 255 up to a positive multiple of UNIT)."""
    tiles, count = [], []
    for t in texts:
        p = t + b"\xff" * (max(1, -(-len(t) // UNIT)) * UNIT - len(t))
        parts = [p[i : i + TILE] for i in range(0, len(p), TILE)]
        tiles += parts
        count.append(len(parts))
    files, at, out = [f for i in _chunks(tiles, WRITE_BATCH) for f in encode_grey(tiles[i])], 0, []
    for n in count:
        out.append(b"".join(files[at : at + n]))
        at += n
    return out


def read_payloads(media: list[bytes]) -> list[bytes]:
    files = [split_files(m) for m in media]
    every = [f for m in files for f in m]
    pixels = ((p >> np.uint32(8)).astype(np.uint8).tobytes() for i in _chunks(every, READ_BATCH) for _, _, p in decode_many(every[i]))
    return [b"".join(next(pixels) for _ in m) for m in files]


def feature(payload: bytes) -> str:
    """Size, mean, deviation, mean step between neighbours, and a 16-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    bins = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return f"{ROW}x{len(x) // ROW};{x.mean():.4f};{x.std():.4f};{np.abs(np.diff(x)).mean():.4f};" + ",".join(map(str, bins.tolist()))


def write_pixels(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` plus images: width, height and ARGB pixels of every lossless WebP file in a binary column."""
    df = df.select([c for c in df.columns if c.lower() != "images"])
    image = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.LongType()))])
    schema = T.StructType([*df.schema.fields, T.StructField("images", T.ArrayType(image))])
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.list_(pa.int64()))]))

    def run(batches):
        for b in batches:
            files = [split_files(m) if m else [] for m in b.column(media).to_pylist()]
            pixels = iter(decode_many([f for m in files for f in m]))
            images = [[{"width": w, "height": h, "pixels": p.astype(np.int64)} for w, h, p in (next(pixels) for _ in m)] for m in files]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(images, kind)], names=[*b.schema.names, "images"])

    return df.mapInArrow(run, schema)


def media_columns(docs: DataFrame, text: str = "text", with_media: bool = True) -> DataFrame:
    """``docs`` plus n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and media)."""
    arrow_batches(docs.sparkSession)
    new = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    docs = docs.select([c for c in docs.columns if c.lower() not in new])
    keep = [c for c in docs.columns if with_media or c != text]
    extra = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    extra += ", media binary" if with_media else ""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), extra])

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(text).cast(pa.binary()).to_pylist()]
            for i in _chunks(texts, 8 << 20):
                part = texts[i]
                media = store_texts(part)
                back = read_payloads(media)
                columns = [
                    pa.array([len(t) for t in part], pa.int64()), pa.array([len(p) for p in back], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([feature(p) for p in back]), *([pa.array(media, pa.binary())] if with_media else []),
                ]
                own = b.slice(i.start, len(part))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), *columns], names=[*keep, *new[: len(columns)]])

    return docs.mapInArrow(run, schema)


def _chunks(texts: list[bytes], limit: int = 4 << 20):
    """Slices of rows of about ``limit`` bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + UNIT
    if start < len(texts):
        yield slice(start, len(texts))


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_media=False)
