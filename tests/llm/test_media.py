"""The media table against recomputation, and the parts of the format that stored texts pass through."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnwork.llm import webp
from cairnwork.storage import materialize


def test_table_against_recomputation(spark):
    rng = random.Random(3)
    prose = " ".join(rng.choice(["river", "stone", "a", "walked", "slowly", "é"]) for _ in range(40_000))
    rows = [(0, None), (1, ""), (None, "x"), (2, "same text"), (2, "same text"), (3, prose), (4, "\xff" * 600), (5, "ab" * 576), (6, "😀 déjà " * 100)]
    docs = materialize(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit(1)).withColumn("feature", F.lit("own")), "test")
    got = webp.media_table(docs).collect()
    assert len(got) == len(rows)
    by_payload = {}
    for r in got:
        by_payload.setdefault((r.doc_id, r.n_bytes), set()).add(tuple(r)[1:])
    assert all(len(x) == 1 for x in by_payload.values())
    for doc, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        (n, size, sha, crc, media, media_sha, feature), = by_payload[doc, len(raw)]
        stored = webp.store(raw)
        assert (n, size, sha, crc) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (media, media_sha) == (len(stored), hashlib.sha256(stored).hexdigest())
        values = np.frombuffer(payload, dtype=np.uint8).astype(object)
        mean, square = sum(values), sum(v * v for v in values)
        assert feature.startswith(f"mean={100 * mean // len(values)};var={(square * len(values) - mean * mean) // len(values) ** 2};hash=")
        runs = [sum(x) for x in np.array_split(values, 64)]
        assert feature.endswith("".join("1" if r * 64 > mean else "0" for r in runs) and f"{int(''.join('1' if r * 64 > mean else '0' for r in runs), 2):016x}")


def transforms(file):
    """Kinds of the transforms of a stored text's first image, in the order of the stream."""
    bits = webp.Bits(file[20:])
    bits.at = 8 + 14 + 14 + 4
    return bits.read(1) and bits.read(2)


@pytest.mark.parametrize("colours", [2, 3, 4, 9, 16])
def test_few_values_take_a_palette(colours):
    rng = random.Random(colours)
    # mostly one value: a pixel of its own takes a bit at least, packed ones less
    text = bytes(100 if rng.random() < 0.97 else rng.choice(range(100, 100 + colours)) for _ in range(576 * 8))
    file = webp.store(text)
    assert transforms(file) == 3
    assert webp.load_samples(file).tobytes() == text


def test_slopes_take_a_predictor(monkeypatch):
    rng = random.Random(7)
    left = np.cumsum([rng.choice([0, 1, 1, 2]) for _ in range(576 * 8)]).astype(np.uint8).tobytes()
    row = np.array([rng.randrange(256) for _ in range(576)])
    top = np.concatenate([row + np.array([rng.choice([-1, 0, 1]) for _ in row]) * k for k in range(8)]).astype(np.uint8).tobytes()
    used = []
    real = webp._unpredict
    monkeypatch.setattr(webp, "_unpredict", lambda argb, modes, *a: used.append(int(modes.flat[0])) or real(argb, modes, *a))
    for text in (left, top):
        assert webp.load_samples(webp.store(text)).tobytes() == text
    assert used == [1, 2]


def test_repeats_take_back_references():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    text = " ".join(rng.choice(words) for _ in range(2_000)).encode()
    assert len(webp.back_references(text, 3.2)) > 100
    once = webp.store(text)
    assert webp.load_samples(once).tobytes()[: len(text)] == text and len(webp.store(text * 2)) < 1.2 * len(once)
    far = rng.randbytes(900_000)
    assert webp.load_samples(webp.store(far + far[:5000])).tobytes()[: len(far) + 5000] == far + far[:5000]


def test_prefix_codes_are_of_each_image():
    plain = webp.store(b"aaaabbbbccccdddd" * 40 + bytes(range(32, 127)) * 3)
    other = webp.store(b"ZZZZYYYYXXXXWWWW" * 40 + bytes(range(127, 255)) * 3)
    assert plain[40:60] != other[40:60]


def test_references_are_checked():
    text = ("the quick brown fox jumps over the lazy dog; " * 50).encode()
    file = bytearray(webp.store(text))
    bad = 0
    for k in range(30, len(file)):
        broken = bytearray(file)
        broken[k] ^= 0x55
        try:
            webp.load_samples(bytes(broken))
        except (ValueError, IndexError):
            bad += 1
    assert bad
