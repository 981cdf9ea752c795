"""The VP8L decoder on streams that use every part of the format, written here by plain scalar code."""

import random

import numpy as np
import pytest

from cairnwork.llm import webp


def prefix(value):
    """(symbol, extra bits, extra value) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    for symbol in range(4, 40):
        extra = (symbol - 2) >> 1
        low = ((2 + (symbol & 1)) << extra) + 1
        if low <= value < low + (1 << extra):
            return symbol, extra, value - low
    raise ValueError(value)


def write_image(out, pixels, width, cache_bits=0, groups=None, block=0, back=0, main=False):
    """Pixels as literals, colour-cache hits and back-references of distance code ``back``; groups by block if given."""
    out.put(*([(1, 1), (cache_bits, 4)] if cache_bits else [(0, 1)]))
    if main:
        out.put((1 if groups else 0, 1))
        if groups:
            out.put((block - 2, 3))
            write_image(out, [g << 8 | 255 << 24 for g in groups], -(-width // (1 << block)))
    x, y = webp.NEAR[back - 1] if 0 < back <= 120 else (back - 120, 0)
    distance = max(1, x + y * width) if back else 0
    across, cache, steps, i = -(-width // (1 << block)) if groups else 0, {}, [], 0
    while i < len(pixels):
        group = groups[(i // width >> block) * across + (i % width >> block)] if groups else 0
        run = 0
        while distance and distance <= i and i + run < len(pixels) and run < 40 and pixels[i + run] == pixels[i + run - distance]:
            run += 1
        p = pixels[i]
        slot = (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if run > 2:
            steps.append((group, "copy", run))
        elif cache_bits and cache.get(slot) == p:
            steps.append((group, "cache", slot))
        else:
            steps.append((group, "literal", p))
        for q in pixels[i : i + max(1, run if run > 2 else 1)]:
            if cache_bits:
                cache[(webp.CACHE_FACTOR * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
        i += run if run > 2 else 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(s, dtype=int) for s in sizes] for _ in range(max(groups) + 1 if groups else 1)]
    fields = []
    for g, kind, v in steps:
        if kind == "literal":
            own = [(0, v >> 8 & 255), (1, v >> 16 & 255), (2, v & 255), (3, v >> 24)]
        elif kind == "cache":
            own = [(0, 280 + v)]
        else:
            (a, an, av), (b, bn, bv) = prefix(v), prefix(back)
            own = [(0, 256 + a), (av, an, None), (4, b), (bv, bn, None)]
        fields.append((g, own))
        for f in own:
            if len(f) == 2:
                counts[g][f[0]][f[1]] += 1
    lengths = [[webp._lengths(c, 15) for c in own] for own in counts]
    for own in lengths:
        for x in own:
            out.code(x)
    codes = [[webp._codes(x) for x in own] for own in lengths]
    for g, own in fields:
        for f in own:
            if len(f) == 3:
                out.put((f[0], f[1]))
            elif np.count_nonzero(lengths[g][f[0]]) > 1:
                out.put((int(codes[g][f[0]][f[1]]), int(lengths[g][f[0]][f[1]])))
    return {kind for _, kind, _ in steps}


def channels(p):
    return [p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255]


def joined(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def prediction(mode, le, t, tr, tl):
    avg = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        near_left = sum(abs(l_ + u - c - l_) for l_, u, c in zip(le, t, tl, strict=True))
        near_top = sum(abs(l_ + u - c - u) for l_, u, c in zip(le, t, tl, strict=True))
        return le if near_left < near_top else t
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(le, t, tl, strict=True)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(avg(le, t), tl, strict=True)]
    simple = [[255, 0, 0, 0], le, t, tr, tl, avg(avg(le, tr), t), avg(le, tl), avg(le, t), avg(tl, t), avg(t, tr), avg(avg(le, tl), avg(t, tr))]
    return simple[mode]


def predicted(image, width, modes, block):
    """Residuals of the predictor transform."""
    out, across = [], -(-width // (1 << block))
    for i, p in enumerate(image):
        x, y = i % width, i // width
        if i == 0:
            q = [255, 0, 0, 0]
        elif y == 0:
            q = channels(image[i - 1])
        elif x == 0:
            q = channels(image[i - width])
        else:
            q = prediction(modes[(y >> block) * across + (x >> block)], *(channels(image[j]) for j in (i - 1, i - width, i - width + 1, i - width - 1)))
        out.append(joined([(a - b) & 255 for a, b in zip(channels(p), q, strict=True)]))
    return out


def crossed(image, width, elements, block):
    signed = lambda v: v - 256 if v > 127 else v
    out, across = [], -(-width // (1 << block))
    for i, p in enumerate(image):
        (_, rb, gb, gr), (a, r, g, b) = channels(elements[(i // width >> block) * across + (i % width >> block)]), channels(p)
        new_b = b - (signed(gb) * signed(g) >> 5) - (signed(rb) * signed(r) >> 5)
        out.append(joined([a, (r - (signed(gr) * signed(g) >> 5)) & 255, g, new_b & 255]))
    return out


def picture(width, height, colours, seed):
    rng = random.Random(seed)
    kinds = [rng.getrandbits(32) for _ in range(colours)]
    rows = [[rng.choice(kinds) for _ in range(width)] for _ in range(4)]
    return [p for y in range(height) for p in (rows[y % 4] if y % 5 else [rng.choice(kinds) for _ in range(width)])]


def decoded(out, width, height):
    data = out.bytes()
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + bytes(len(data) & 1)
    pixels = webp.decode_webp(b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk)
    assert pixels.shape == (height, width, 4)
    return [joined([int(v) for v in p]) for p in pixels.reshape(-1, 4)]


def header(width, height):
    out = webp.Writer()
    out.put((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3))
    return out


@pytest.mark.parametrize("back,cache", [(0, 0), (1, 0), (2, 4), (5, 7), (121, 3), (0, 10)])
def test_references_cache_and_groups(back, cache):
    width, height = 19, 23
    image = picture(width, height, 9, back + cache)
    groups = [random.Random(g).randrange(3) for g in range(5 * 6)]
    groups[0] = 2
    out = header(width, height)
    out.put((0, 1))
    kinds = write_image(out, image, width, cache, groups, 2, back, main=True)
    assert ("cache" in kinds) == (cache > 0) and ("copy" in kinds) <= (back > 0)
    assert decoded(out, width, height) == image


@pytest.mark.parametrize("mode", range(14))
def test_predictor_cross_colour_and_subtract_green(mode):
    width, height, rng = 11, 9, random.Random(mode)
    image = picture(width, height, 30, mode)
    modes = [mode if k % 2 else rng.randrange(14) for k in range(3 * 3)]
    elements = [255 << 24 | rng.getrandbits(24) for _ in range(3 * 3)]
    step = predicted(image, width, modes, 2)
    step = crossed(step, width, elements, 2)
    step = [joined([a, (r - g) & 255, g, (b - g) & 255]) for a, r, g, b in map(channels, step)]
    out = header(width, height)
    out.put((1, 1), (0, 2), (0, 3))
    write_image(out, [255 << 24 | m << 8 for m in modes], 3)
    out.put((1, 1), (1, 2), (0, 3))
    write_image(out, elements, 3)
    out.put((1, 1), (2, 2), (0, 1))
    write_image(out, step, width, 5, back=2, main=True)
    assert decoded(out, width, height) == image


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 16, 17, 200])
def test_palette(colours):
    width, height = 13, 17
    image = picture(width, height, colours, colours)
    table = sorted(set(image))
    pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    own = [table.index(p) for p in image]
    rows = []
    for y in range(height):
        for x in range(0, width, 1 << pack):
            rows.append(255 << 24 | sum(own[y * width + k] << ((k - x) * (8 >> pack)) for k in range(x, min(width, x + (1 << pack)))) << 8)
    deltas = [joined([(a - b) & 255 for a, b in zip(channels(p), channels(q), strict=True)]) for p, q in zip(table, [0, *table], strict=False)]
    out = header(width, height)
    out.put((1, 1), (3, 2), (len(table) - 1, 8))
    write_image(out, deltas, len(table))
    out.put((0, 1))
    write_image(out, rows, -(-width // (1 << pack)), main=True)
    assert decoded(out, width, height) == image
