import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import media, webp


def images():
    r = np.random.default_rng(3)
    text = (b"The cat and the hat sat on a mat; " * 60)[:1900]
    yield "text", np.frombuffer(text.ljust(2304, b"\xff"), np.uint8).reshape(-1, 12, 4)
    yield "noise", r.integers(0, 256, (17, 23, 4), dtype=np.uint8)
    yield "one", np.full((1, 1, 4), 255, np.uint8)
    yield "flat", np.full((9, 144, 4), 7, np.uint8)
    yield "two colours", np.where(r.random((13, 19, 1)) < 0.3, np.uint8([1, 2, 3, 4]), np.uint8([9, 8, 7, 255])).astype(np.uint8)
    yield "ten colours", r.integers(0, 256, (10, 4), dtype=np.uint8)[r.integers(0, 10, (21, 31))]
    ramp = (np.arange(40)[:, None, None] * 3 + np.arange(50)[None, :, None] * 2 + np.arange(4) * 11) % 256
    yield "ramp", (ramp + r.integers(0, 3, ramp.shape)).astype(np.uint8)


WAYS = [
    {},
    {"transforms": []},
    {"transforms": [("green",)]},
    {"transforms": [("cross", 13, 240, 77)]},
    *({"transforms": [("predictor", m)]} for m in range(14)),
    {"transforms": [("predictor", 11), ("cross", 200, 3, 100), ("green",)]},
    {"transforms": [], "cache": 5},
    {"transforms": [("green",)], "cache": 11, "groups": 3},
    {"transforms": [("predictor", 12)], "groups": 4},
]


@pytest.mark.parametrize("how", range(len(WAYS)))
def test_round_trip(how):
    for name, pixels in images():
        assert np.array_equal(webp.decode(webp.encode(pixels, **WAYS[how])), pixels), (name, WAYS[how])


def test_palette_sizes():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 5, 16, 17, 200, 256):
        colours = np.unique(r.integers(0, 256, (n, 4), dtype=np.uint8), axis=0)
        pixels = colours[r.integers(0, len(colours), (9, 29))]
        for extra in ([], [("predictor", 2)]):
            assert np.array_equal(webp.decode(webp.encode(pixels, [("palette",), *extra], cache=3 * (n > 16))), pixels)


def test_distance_codes():
    near = webp._near()
    assert len(near) == len(set(near)) == 120
    assert near[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert near[-3:] == [(-7, 7), (8, 6), (8, 7)]


def _by_hand(symbols, sizes, width, height, distance):
    """An image of one literal and one back-reference, written field by field."""
    out = webp.Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    out.put(0, 1)
    out.put(0, 1)
    out.put(0, 1)
    for code, size in zip(symbols, sizes, strict=True):
        webp._put_code(out, code, size)
    return out, distance


def test_back_reference_by_hand():
    # Pixels A B, then 4 copies from two pixels back (distance code 6: two to the left).
    symbol, extra, more = webp.prefix(4)
    green = {10: 2, 20: 2, 256 + symbol: 1}
    rest = {5: 1, 6: 1}
    back, back_extra, back_more = webp.prefix(6)
    out, _ = _by_hand([green, rest, rest, rest, {back: 0}], [280, 256, 256, 256, 40], 6, 1, 6)
    g, r = webp.canonical(green), webp.canonical(rest)
    for a, b in ((10, 5), (20, 6)):
        out.put(*g[a])
        for _ in range(3):
            out.put(*r[b])
    out.put(*g[256 + symbol])
    out.put(more, extra)
    out.put(back_more, back_extra)
    body = b"\x2f" + out.bytes()
    import struct

    chunk = struct.pack("<4sI", b"VP8L", len(body)) + body + b"\0" * (len(body) & 1)
    pixels = webp.decode(struct.pack("<4sI4s", b"RIFF", len(chunk) + 4, b"WEBP") + chunk)
    assert pixels.tolist() == [[[5, 10, 5, 5], [6, 20, 6, 6]] * 3]


def test_not_webp():
    with pytest.raises(ValueError):
        webp.decode(b"RIFF" + bytes(40))


def test_operator(spark):
    rows = [(1, "hello " * 300), (2, None), (3, ""), (4, "x" * 576), (5, "x" * 577), (6, "hello " * 300), (7, "ß" * 100_000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in media.read(media.store(df)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and bytes(r.pixels) == payload
    assert got[1].media_sha256 == got[6].media_sha256 and got[1].feature == got[6].feature
    assert media.read(media.store(df.limit(0))).count() == 0
