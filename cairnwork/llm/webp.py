"""Lossless WebP (VP8L) pixels: a decoder to numpy arrays and the writer for byte payloads.

The decoder reads prefix codes (with meta codes), back-references and the colour cache and
inverts the predictor, cross-colour, subtract-green and palette transforms. The writer
stores bytes as a grey image and gives each image prefix codes of its own, back-references
to runs that stood before, a palette with packed pixels where an image has few values, and
a predictor where differences have less entropy; of the forms that may be shorter it keeps
the shortest. (A grey pixel is one literal of one code, so a colour cache hit can't be
shorter, and without colours there is nothing for cross-colour to take away.) Images of one
changing channel are decoded by looking up all bit positions of a span at once and
following the chain from token to token.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES, DISTANCE_CODES = 24, 40
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
ROW, HIGH = 576, 2048  # pixels of a row, and the most rows of an image: a longer text is several images
EIGHT = np.arange(8, dtype=np.uint32)
SPAN, MARGIN = 1 << 15, 64  # bytes of a stream looked up at a time, and more bits than a token has (4 of them have under 256)
SHORTEST, LONGEST, FARTHEST = 8, 4096, (1 << 20) - 120  # lengths of back-references that the writer makes, and their greatest distance
CODE_BITS, MULTIPLIER = 12, 0x9E3779B97F4A7C15  # the longest code that the writer makes, and of the hash of the first bytes of a run


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + (n + 14 >> 3)], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


@lru_cache(maxsize=16)
def _reversed(n: int) -> np.ndarray:
    """The n-bit numbers with their bits in reverse order."""
    i, out = np.arange(1 << n), np.zeros(1 << n, dtype=np.int64)
    for b in range(n):
        out |= (i >> b & 1) << (n - 1 - b)
    return out


class Code:
    """A canonical prefix code: ``table[next bits]`` is symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        self.only = int(used[0]) if len(used) == 1 else -1
        if len(used) < 2:
            self.bits, self.table = 0, np.array([(self.only if len(used) else 0) << 4])
        else:
            used = used[lengths[used].argsort(kind="stable")]
            self.bits = int(lengths[used[-1]])
            spread = np.repeat(used << 4 | lengths[used], 1 << (self.bits - lengths[used]))
            if len(spread) != 1 << self.bits:
                raise ValueError("a prefix code is not complete")
            self.table = spread[_reversed(self.bits)]
        self.look = None

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return self.only if self.only > 0 else 0
        if self.look is None:
            self.look = self.table.tolist()
        found = self.look[bits.peek(self.bits)]
        bits.at += found & 15
        return found >> 4


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, dtype=np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, dtype=np.int64)
    for k in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[k]] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, at, last = Code(own), 0, 8
    look, mask, only = code.table.tolist(), (1 << code.bits) - 1, max(code.only, 0)
    ahead, left = 0, 0  # bits taken from the stream and how many of them are left
    while at < size and most > 0:
        if left < 14:  # a symbol and its extra bits
            bits.at -= left
            ahead, left = bits.peek(1024), 1024
            bits.at += left
        most -= 1
        symbol, width = (look[ahead & mask] >> 4, look[ahead & mask] & 15) if code.bits else (only, 0)
        ahead, left = ahead >> width, left - width
        if symbol < 16:
            lengths[at] = symbol
            last, at = symbol or last, at + 1
        else:
            run, value, width = ((3, last, 2), (3, 0, 3), (11, 0, 7))[symbol - 16]
            run += ahead & ((1 << width) - 1)
            ahead, left = ahead >> width, left - width
            lengths[at : at + run] = value
            at += run
    bits.at -= left
    return Code(lengths)


def _prefixed(symbol: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _extra_bits(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < 4, 0, (symbols - 2) >> 1)


EXTRA = _extra_bits(np.arange(max(LENGTH_CODES, DISTANCE_CODES)))


@lru_cache(maxsize=8)
def _near_distances(width: int) -> np.ndarray:
    """Distances of the codes 1 to 120 in an image of that width."""
    return np.array([0, *(max(1, x + y * width) for x, y in NEAR)])


def _values(symbols: np.ndarray, fields: np.ndarray) -> np.ndarray:
    """Lengths or distance codes from their prefix symbols and the bits after them."""
    extra = EXTRA[symbols]
    return np.where(symbols < 4, symbols, (2 + (symbols & 1)) << extra) + (fields & ((1 << extra) - 1)) + 1


def _one_channel(bits: Bits, green: Code, far: Code, n: int, width: int) -> np.ndarray:
    """``n`` greens of an image whose pixels are literals of that code and back-references."""
    if not green.bits:
        if green.table[0] >> 4 > 255:
            raise ValueError("a back-reference leaves the image")
        return np.full(n, green.table[0] >> 4, dtype=np.int64)
    out, done = bytearray(n), 0
    view, near = np.frombuffer(out, dtype=np.uint8), _near_distances(width)
    while done < n:  # a bounded run of bytes at a time
        first = bits.at >> 3
        span = min(SPAN, len(bits.data) - 16 - first)
        if span <= 0:
            raise ValueError("the image ends early")
        raw = np.frombuffer(bits.data, dtype=np.uint8, count=span + 12, offset=first).astype(np.uint32)
        words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        windows = (words[:, None] >> EIGHT).ravel()  # at least 25 bits from each bit position
        stop = 8 * span
        found = green.table.take(windows[:stop] & np.uint32((1 << green.bits) - 1))
        steps = (found & 15).astype(np.uint8)
        at = np.flatnonzero(found >= 256 << 4)
        after = at + steps[at] + EXTRA[(found[at] >> 4) - 256]
        named = far.table.take(windows[after] & np.uint32((1 << far.bits) - 1))
        steps[at] = after - at + (named & 15) + EXTRA[named >> 4]
        one = np.arange(stop + MARGIN, dtype=np.int32)  # the place after each token, then after two and four
        one[:stop] += steps
        two = one[one]
        jumps, p, fourth = (two[two] - np.arange(stop + MARGIN, dtype=np.int32)).astype(np.uint8).tobytes(), bits.at & 7, []
        append = fourth.append
        while p < stop:
            append(p)
            p += jumps[p]
        each = np.empty((len(fourth), 4), dtype=np.int64)
        each[:, 0] = fourth
        each[:, 1], each[:, 2] = one[each[:, 0]], two[each[:, 0]]
        each[:, 3] = one[each[:, 2]]
        met = each.ravel()
        met = met[: np.searchsorted(met, stop)]
        p = int(one[met[-1]])
        symbols = found[met] >> 4
        refs = np.flatnonzero(symbols > 255)
        own = symbols[refs] - 256
        after = met[refs] + (found[met[refs]] & 15)
        sizes = np.ones(len(met), dtype=np.int64)
        sizes[refs] = _values(own, windows[after].astype(np.int64))
        ends = done + np.cumsum(sizes)
        whole = int(np.searchsorted(ends, n)) + 1  # tokens up to the one that fills the image
        if whole <= len(met):
            bits.at, (met, symbols, ends, sizes) = first * 8 + (int(met[whole]) if whole < len(met) else p), (x[:whole] for x in (met, symbols, ends, sizes))
            refs = refs[: np.searchsorted(refs, whole)]
            if ends[-1] > n:
                raise ValueError("a back-reference leaves the image")
        else:
            bits.at = first * 8 + p
        begins = ends - sizes
        literal = symbols < 256
        view[begins[literal]] = symbols[literal]
        after = met[refs] + (found[met[refs]] & 15) + EXTRA[symbols[refs] - 256]
        named = far.table.take(windows[after] & np.uint32((1 << far.bits) - 1))
        back = _values(named >> 4, windows[after + (named & 15)].astype(np.int64))
        back = np.where(back > 120, back - 120, near[np.minimum(back, 120)])
        if np.any(back > begins[refs]):
            raise ValueError("a back-reference leaves the image")
        for a, b, d in zip(begins[refs].tolist(), ends[refs].tolist(), back.tolist(), strict=True):
            out[a:b] = out[a - d : b - d] if d >= b - a else (out[a - d : a] * (-(-(b - a) // d)))[: b - a]
        done = int(ends[-1])
    return view.astype(np.int64)


def _image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image: ARGB values in scan order."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    block, meta = 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        meta = (_image(bits, across, (height + (1 << block) - 1) >> block) >> 8 & 0xFFFF).tolist()
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    groups = [[_read_code(bits, s) for s in sizes] for _ in range(max(meta) + 1 if meta else 1)]
    n, (green, red, blue, alpha, far) = width * height, groups[0]
    if meta is None and not cache_bits and not (red.bits or blue.bits or alpha.bits):
        fixed = int(alpha.table[0]) >> 4 << 24 | int(red.table[0]) >> 4 << 16 | int(blue.table[0]) >> 4
        return _one_channel(bits, green, far, n, width) << 8 | fixed
    out, cache, i = [0] * n, [0] * (1 << cache_bits), 0
    entered = 0  # pixels before this place are in the cache
    while i < n:
        if meta is not None:
            green, red, blue, alpha, far = groups[meta[(i // width >> block) * across + (i % width >> block)]]
        symbol = green.read(bits)
        if symbol < 256:
            out[i] = red.read(bits) << 16 | symbol << 8 | blue.read(bits)
            out[i] |= alpha.read(bits) << 24
            i += 1
        elif symbol < 256 + LENGTH_CODES:
            length = _prefixed(symbol - 256, bits)
            back = _prefixed(far.read(bits), bits)
            if back > 120:
                back -= 120
            else:
                x, y = NEAR[back - 1]
                back = max(1, x + y * width)
            if back > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for i in range(i, i + length):
                out[i] = out[i - back]
            i += 1
        else:
            while entered < i:
                cache[(CACHE_FACTOR * out[entered] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[entered]
                entered += 1
            out[i] = cache[symbol - 256 - LENGTH_CODES]
            i += 1
    return np.array(out, dtype=np.int64)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], axis=-1)


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction from left, top, top-right and top-left pixels (A, R, G, B)."""
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return ((left + right) // 2 + top) // 2
    if mode <= 9:
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return (a + b) // 2
    if mode == 10:
        return ((left + corner) // 2 + (top + right) // 2) // 2
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = (left + top) // 2
    return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int64), 0, 255)


def _unpredict(argb: np.ndarray, modes: np.ndarray, block: int, width: int, height: int) -> np.ndarray:
    p = _channels(argb).reshape(height, width, 4)
    p[0, 0, 0] += 255
    p[0] = np.cumsum(p[0], axis=0) & 255
    only = np.unique(modes)
    if len(only) == 1 and only[0] in (1, 2):  # left everywhere, or top: running sums
        p[:, 0] = np.cumsum(p[:, 0], axis=0) & 255
        if only[0] == 1:
            p[1:] = np.cumsum(p[1:], axis=1) & 255
        else:
            p[:, 1:] = np.cumsum(p[:, 1:], axis=0) & 255
        return p.reshape(-1, 4) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
    for y in range(1, height):
        p[y, 0] = (p[y, 0] + p[y - 1, 0]) & 255
        for x in range(1, width):
            right = p[y - 1, x + 1] if x + 1 < width else p[y, 0]
            p[y, x] = (p[y, x] + _predict(int(modes[y >> block, x >> block]), p[y, x - 1], p[y - 1, x], right, p[y - 1, x - 1])) & 255
    return p.reshape(-1, 4) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ 128) - 128


def _uncross(argb: np.ndarray, element: np.ndarray) -> np.ndarray:
    """``element`` has each pixel's multipliers: red to blue, green to blue and green to red."""
    green = _signed(argb >> 8 & 255)
    red = (argb >> 16) + (_signed(element & 255) * green >> 5) & 255
    blue = argb + (_signed(element >> 8 & 255) * green >> 5) + (_signed(element >> 16 & 255) * _signed(red) >> 5) & 255
    return argb & 0xFF00FF00 | red << 16 | blue


def decode_vp8l(data: bytes) -> np.ndarray:
    """Pixels of a VP8L stream as (height, width, 4) unsigned bytes: alpha, red, green, blue."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(4)
    steps, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            block = bits.read(3) + 2
            w, h = ((v + (1 << block) - 1) >> block for v in (across, height))
            steps.append((kind, across, block, _image(bits, w, h).reshape(h, w)))
        elif kind == 2:
            steps.append((kind, across, 0, None))
        else:
            size = bits.read(8) + 1
            colours = np.cumsum(_channels(_image(bits, size, 1)), axis=0) & 255
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            steps.append((kind, across, pack, colours @ np.array([1 << 24, 1 << 16, 1 << 8, 1])))
            across = (across + (1 << pack) - 1) >> pack
    argb = _image(bits, across, height, main=True)
    for kind, w, block, own in reversed(steps):
        if kind == 0:
            argb = _unpredict(argb, own >> 8 & 255, block, w, height)
        elif kind == 1:
            each = own[np.arange(height)[:, None] >> block, np.arange(w)[None, :] >> block].ravel()
            argb = _uncross(argb, each)
        elif kind == 2:
            green = argb >> 8 & 255
            argb = argb & 0xFF00FF00 | (argb & 0xFF00FF) + green * 0x10001 & 0xFF00FF
        else:
            index = argb >> 8 & 255
            if block:
                each = 8 >> block
                index = (index.reshape(height, -1, 1) >> (np.arange(1 << block) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :w].ravel()
            argb = np.concatenate([own, np.zeros(256 - len(own), dtype=np.int64)])[index]
    return argb.astype(">u4").view(np.uint8).reshape(height, width, 4)


def _lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; a lone symbol gets length 1."""
    out = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts).tolist()
    weights = counts[used].tolist()
    if len(used) == 1:
        out[used[0]] = 1
    while len(used) > 1:
        n = len(used)
        by_weight = sorted(range(n), key=weights.__getitem__)
        queue, made = [weights[i] for i in by_weight], []  # leaves and inner nodes, both rising: the two least stand at their heads
        up, leaf, inner = [0] * (2 * n - 1), 0, 0
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (inner == len(made) or queue[leaf] <= made[inner]):
                    total += queue[leaf]
                    up[by_weight[leaf]] = k
                    leaf += 1
                else:
                    total += made[inner]
                    up[n + inner] = k
                    inner += 1
            made.append(total)
        depth = [0] * len(up)
        for i in range(len(up) - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth) <= most:
            out[used] = depth[: len(used)]
            break
        weights = [(w >> 1) + 1 for w in weights]
    return out


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of ``lengths``, first bit lowest."""
    out = np.zeros(len(lengths), dtype=np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    if len(used) > 1:
        own, most = lengths[used], int(lengths[used[-1]])
        first = np.concatenate([[0], np.cumsum(1 << (most - own))[:-1]])
        out[used] = _reversed(most)[first]
    return out


class Writer:
    """Collects (value, bits) fields and packs them, lowest bit first."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.widths: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, *fields: tuple[int, int]) -> None:
        for value, width in fields:
            self.values.append(value)
            self.widths.append(width)

    def many(self, values: np.ndarray, widths: np.ndarray) -> None:
        self._close()
        self.parts.append((values, widths))

    def _close(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, dtype=np.uint64), np.array(self.widths, dtype=np.int64)))
            self.values, self.widths = [], []

    def bytes(self) -> bytes:
        self._close()
        values, widths = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        values, widths = values.astype(np.uint64), widths.astype(np.int64)
        if not widths.all():
            values, widths = values[widths > 0], widths[widths > 0]
        ends = np.cumsum(widths)
        starts, total = ends - widths, int(ends[-1])
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        out = np.zeros((total >> 6) + 2, dtype="<u8")
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((starts & 63) + widths > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.tobytes()[: (total + 7) // 8]

    def lone(self, symbol: int) -> None:
        """A prefix code of one symbol under 256, which takes no bits."""
        self.put((1, 1), (0, 1), (1, 1), (symbol, 8))

    def code(self, lengths: np.ndarray) -> None:
        """A prefix code's lengths, runs of zeros in short; nothing used is written as the symbol 0."""
        used = lengths.nonzero()[0]
        if len(used) < 2 and (not len(used) or used[0] < 256):
            self.lone(int(used[0]) if len(used) else 0)
            return
        if len(used) == 2 and used[1] < 256:
            self.put((1, 1), (1, 1), (1, 1), (int(used[0]), 8), (int(used[1]), 8))
            return
        tokens, at = [], 0
        for place, length in zip(used.tolist(), lengths[used].tolist(), strict=True):
            gap, at = place - at, place + 1
            while gap >= 3:
                run = min(gap, 138)
                tokens.append((18, run - 11, 7) if run > 10 else (17, run - 3, 3))
                gap -= run
            tokens += [(0, 0, 0)] * gap
            tokens.append((length, 0, 0))
        symbols = np.array([t[0] for t in tokens])
        own = _lengths(np.bincount(symbols, minlength=19), 7)
        kept = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s] or k == 3) + 1
        count = max(len(tokens), 2) - 2
        self.put((0, 1), (kept - 4, 4), *((int(own[s]), 3) for s in CODE_LENGTH_ORDER[:kept]), (1, 1), *([(3, 3), (count, 8)] if count < 256 else [(5, 3), (count, 12)]))
        codes, widths = _codes(own).tolist(), own.tolist() if (own > 0).sum() > 1 else [0] * 19
        for symbol, value, width in tokens:
            self.values.append(codes[symbol] | value << widths[symbol])
            self.widths.append(widths[symbol] + width)


def _prefix_fields(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix symbols, extra values) of lengths or distance codes."""
    less = values - 1
    high = np.frexp(np.maximum(less, 1).astype(float))[1] - 1
    symbols = np.where(less < 4, less, 2 * high + (less >> np.maximum(high - 1, 0) & 1))
    return symbols, less & ((1 << EXTRA[symbols]) - 1)


def _entropy(counts: np.ndarray) -> float:
    """Bits of a symbol."""
    used = counts[counts > 0].astype(float)
    return float(np.log2(used.sum()) - used @ np.log2(used) / used.sum())


def _common(data: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from ``a`` equal those from ``b``, at most ``most``; the first SHORTEST do."""
    n = SHORTEST
    while n + 16 <= most and data[a + n : a + n + 16] == data[b + n : b + n + 16]:
        n += 16
    while n < most and data[a + n] == data[b + n]:
        n += 1
    return n


def back_references(data: bytes, bits_each: float) -> np.ndarray:
    """(start, length, distance) of runs that stand before, from left to right, each to the nearest place with the same first bytes.

    A run is taken if it needs fewer bits than its literals at ``bits_each``.
    """
    n, out, at = len(data) - SHORTEST + 1, [], 0
    if n > 1:
        keys = np.ndarray((n,), dtype="<u8", buffer=data + bytes(8), strides=(1,)) & np.uint64((1 << 8 * SHORTEST) - 1)
        halves = (keys * np.uint64(MULTIPLIER) >> np.uint64(32)).astype("<u4").view("<u2").reshape(-1, 2)
        order = halves[:, 0].argsort(kind="stable")  # 16-bit numbers are sorted by counting
        order = order[halves[order, 1].argsort(kind="stable")]
        sorted_keys = keys[order]
        same = (sorted_keys[1:] == sorted_keys[:-1]).nonzero()[0]
        before = np.full(n, -1, dtype=np.int64)
        before[order[same + 1]] = order[same]
        ends = (before >= np.maximum(np.arange(n) - FARTHEST, 0)).nonzero()[0]
        for i, j in zip(ends.tolist(), before[ends].tolist(), strict=True):
            if i >= at:
                size = _common(data, i, j, min(LONGEST, len(data) - i))
                # codes of about 7 and 5 bits, and their extra bits
                if size * bits_each > 8 + size.bit_length() + (i - j + 120).bit_length():
                    out.append((i, size, i - j))
                    at = i + size
                else:  # a long run that doesn't pay isn't compared again from each of its bytes
                    at = i + size - SHORTEST
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def _write_pixels(writer: Writer, greens: np.ndarray, width: int, fixed: tuple[int, int, int], main: bool) -> None:
    """An entropy-coded image whose pixels are (alpha, red, blue) of ``fixed`` and the greens."""
    data = greens.tobytes()
    counts = np.bincount(greens, minlength=256)
    refs = back_references(data, _entropy(counts))
    start, size, back = refs.T
    inside = np.zeros(len(greens) + 1, dtype=np.int64)
    inside[start] += 1
    inside[start + size] -= 1
    literal = np.cumsum(inside[:-1]) == 0
    if len(refs):
        counts = np.bincount(greens[literal], minlength=256)
    near = {d: c for c, d in reversed(list(enumerate(_near_distances(width).tolist()))) if c}
    length_symbols, length_extra = _prefix_fields(size)
    far_symbols, far_extra = _prefix_fields(np.array([near.get(d, d + 120) for d in back.tolist()], dtype=np.int64))
    green = _lengths(np.concatenate([counts, np.bincount(length_symbols, minlength=LENGTH_CODES)]), CODE_BITS)
    far = _lengths(np.bincount(far_symbols, minlength=DISTANCE_CODES), CODE_BITS)
    alpha, red, blue = fixed
    writer.put((0, 1), *([(0, 1)] if main else []))  # no colour cache, no meta codes
    writer.code(green)
    for symbol in (red, blue, alpha):
        writer.lone(symbol)
    writer.code(far)
    if (green > 0).sum() < 2:
        return  # one green everywhere takes no bits
    codes, widths = _codes(green), green
    values, bits = np.where(literal, codes[greens], 0).astype(np.uint64), np.where(literal, widths[greens], 0)
    if len(refs):
        far_codes, far_widths = _codes(far), far if (far > 0).sum() > 1 else np.zeros_like(far)
        value, shift = np.zeros(len(refs), dtype=np.uint64), np.zeros(len(refs), dtype=np.int64)
        for field, width_ in (
            (codes[256 + length_symbols], widths[256 + length_symbols]), (length_extra, EXTRA[length_symbols]), (far_codes[far_symbols], far_widths[far_symbols]), (far_extra, EXTRA[far_symbols]),
        ):
            value |= field.astype(np.uint64) << shift.astype(np.uint64)
            shift += width_
        values[start], bits[start] = value, shift
    writer.many(values, bits)


def _file(width: int, height: int, write: Callable[[Writer], None]) -> bytes:
    writer = Writer()
    writer.put((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4))
    write(writer)
    data = writer.bytes()
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + bytes(len(data) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _grey(samples: np.ndarray, predictor: int) -> bytes:
    """The form with the subtract-green transform, and a predictor everywhere (1 left, 2 top) if it isn't 0."""
    height, width = samples.shape
    greens, alpha = samples, 255

    def write(writer: Writer) -> None:
        writer.put((1, 1), (2, 2))
        if predictor:
            writer.put((1, 1), (0, 2), (7, 3))  # one mode for each block of 512 pixels a side
            across, down = (-(-v // 512) for v in (width, height))
            _write_pixels(writer, np.full(across * down, predictor, dtype=np.uint8), across, (255, 0, 0), False)
        writer.put((0, 1))
        _write_pixels(writer, greens.ravel(), width, (alpha, 0, 0), True)

    if predictor:
        greens, alpha = _differences(samples, predictor), 0
    return _file(width, height, write)


def _differences(samples: np.ndarray, predictor: int) -> np.ndarray:
    """What a predictor leaves: the first row is predicted from the left, the first column from the top."""
    out = samples.copy()
    out[0, 1:] -= samples[0, :-1]
    out[1:, 0] -= samples[:-1, 0]
    if predictor == 1:
        out[1:, 1:] -= samples[1:, :-1]
    else:
        out[1:, 1:] -= samples[:-1, 1:]
    return out


def _palette(samples: np.ndarray, colours: np.ndarray) -> bytes:
    """The form with a palette of at most 16 colours, two, four or eight pixels in a byte."""
    height, width = samples.shape
    pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
    index = np.zeros(256, dtype=np.uint8)
    index[colours] = np.arange(len(colours))
    across = -(-width // (1 << pack))
    cells = np.pad(index[samples], ((0, 0), (0, (across << pack) - width))).reshape(height, across, 1 << pack)
    greens = (cells << (np.arange(1 << pack, dtype=np.uint8) * (8 >> pack))).sum(axis=2, dtype=np.uint8)

    def write(writer: Writer) -> None:
        writer.put((1, 1), (3, 2), (len(colours) - 1, 8))
        steps = np.diff(colours, prepend=0)
        channel = _lengths(np.bincount(steps, minlength=256), CODE_BITS)
        opaque = _lengths(np.bincount([255, *[0] * (len(colours) - 1)], minlength=256), CODE_BITS)
        writer.put((0, 1))
        grown = np.concatenate([channel, np.zeros(LENGTH_CODES, dtype=np.int64)])
        for lengths in (grown, channel, channel, opaque, np.zeros(DISTANCE_CODES, dtype=np.int64)):
            writer.code(lengths)
        for k, step in enumerate(steps.tolist()):
            for lengths, symbol in ((channel, step), (channel, step), (channel, step), (opaque, 0 if k else 255)):
                if (lengths > 0).sum() > 1:
                    writer.put((int(_codes(lengths)[symbol]), int(lengths[symbol])))
        writer.put((0, 1))
        _write_pixels(writer, greens.ravel(), across, (255, 0, 0), True)

    return _file(width, height, write)


def write_grey(samples: np.ndarray) -> bytes:
    """A WebP file of a grey image of 8-bit samples, the shortest of the forms that may pay."""
    counts = np.bincount(samples.ravel(), minlength=256)
    colours, plain = np.flatnonzero(counts), _entropy(counts)
    forms = [_grey(samples, 0)]
    if 1 < len(colours) <= 16:
        forms.append(_palette(samples, colours))
    flat = samples.ravel()
    for predictor, back in ((1, 1), (2, samples.shape[1])):
        if len(flat) > back and _entropy(np.bincount(flat[back:] - flat[:-back], minlength=256)) < 0.9 * plain:
            forms.append(_grey(samples, predictor))
    return min(forms, key=len)


def decode_webp(file: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file as (height, width, 4): alpha, red, green, blue."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(file):
        size = int.from_bytes(file[at + 4 : at + 8], "little")
        if file[at : at + 4] == b"VP8L":
            return decode_vp8l(file[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("the file has no lossless image")


def store(text: bytes) -> bytes:
    """The text, padded with bytes 255 to a positive multiple of 576, as one WebP file of at most HIGH rows, or several one after another."""
    n = max(1, -(-len(text) // ROW)) * ROW
    samples = np.full(n, 255, dtype=np.uint8)
    samples[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    rows = samples.reshape(-1, ROW)
    return b"".join(write_grey(rows[at : at + HIGH]) for at in range(0, len(rows), HIGH))


def load_samples(media: bytes) -> np.ndarray:
    """The samples of the files in ``media``, one after another."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(decode_webp(media[at:end])[:, :, 2].ravel())
        at = end
    return np.concatenate(out)


def features(samples: np.ndarray) -> str:
    """Mean and deviation of the samples in hundredths, and a 64-bit hash: which of 64 equal runs lie above the mean."""
    total, n = int(samples.sum(dtype=np.int64)), len(samples)
    squares = int(np.dot(np.bincount(samples, minlength=256), np.arange(256) ** 2))
    runs = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = "".join("1" if int(r) * 64 > total else "0" for r in runs)
    return f"mean={100 * total // n};var={(squares * n - total * total) // (n * n)};hash={int(bits, 2):016x}"


def media_row(text: bytes) -> tuple:
    """The values of ``COLUMNS`` for one text: it is stored, and what is read back is described."""
    media = store(text)
    samples = load_samples(media)
    payload = samples.tobytes()
    return len(text), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha256(media).hexdigest(), features(samples)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, *COLUMNS)`` for each row of ``docs``; see ``store`` and ``features``.

    Null texts count as empty, which is one row of padding; equal texts, repeated rows too,
    have equal values; null and equal ids are kept. Long texts are stored whole, an image after
    another. An empty table gives no rows; other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            made = {text: media_row(text) for text in set(texts)}
            rows = [made[text] for text in texts]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *COLUMNS])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


COLUMNS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
