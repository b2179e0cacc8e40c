"""Lossless WebP as a media column: a decoder and an encoder for one image, in numpy.

The decoder reads what the format allows: several groups of prefix codes, back-references, colour
cache, and the predictor, cross-colour, subtract-green and palette transforms, each inverted.
Where an image has one group of prefix codes and no colour cache, pixels are found by
looking up every bit position at once and following the positions that pixels start at; other
images are read symbol by symbol.

The encoder takes the transform whose samples need the fewest bits, writes prefix codes of
at most 15 bits, and a back-reference for the run that ends an image.  Options make it use any of the
transforms, a colour cache and several groups; tests take every one through the decoder.

Pixels are arrays (height, width, 4) of 8-bit R, G, B, A.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIDE = 16384
CACHE_FACTOR = 0x1E35A7BD
LENGTHS, DISTANCES = 24, 40


def _near() -> list[tuple[int, int]]:
    """The 120 neighbours (left, up) that short distance codes mean: by distance, then by column."""
    found = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(found, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


# --------------------------------------------------------------------------- prefix codes
def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Huffman code lengths of at most `most` bits; a lone symbol has length 0."""
    if len(counts) == 1:
        return {next(iter(counts)): 0}
    floor = 0
    while True:
        heap = [(max(n, floor), s, None) for s, n in counts.items()]
        heapq.heapify(heap)
        tag = 1 << 20
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            tag += 1
            heapq.heappush(heap, (a[0] + b[0], tag, (a, b)))
        out, stack = {}, [(heap[0], 0)]
        while stack:
            (_, s, pair), depth = stack.pop()
            if pair is None:
                out[s] = depth
            else:
                stack += ((pair[0], depth + 1), (pair[1], depth + 1))
        if max(out.values()) <= most:
            return out
        floor = max(2 * floor, sum(counts.values()) >> (most - 1), 1)


_REVERSED = [0] * 32768
for _i in range(1, 32768):
    _REVERSED[_i] = _REVERSED[_i >> 1] >> 1 | (_i & 1) << 14


def _reverse(code: int, n: int) -> int:
    return _REVERSED[code] >> (15 - n)


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol: (code as it lies in the stream, its bits)."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s] = (_reverse(code, n), n)
        code, last = code + 1, n
    return out


@lru_cache(512)
def lookup(lengths: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and bits by the next bits of the stream, and how many bits that takes."""
    present = {s: n for s, n in enumerate(lengths) if n}
    if len(present) <= 1:
        symbol = next(iter(present), 0)
        return np.array([symbol], np.uint16), np.zeros(1, np.uint8), 0
    top = max(present.values())
    if sum(1 << (top - n) for n in present.values()) != 1 << top:
        raise ValueError("prefix code is not complete")
    symbols, bits = np.zeros(1 << top, np.uint16), np.zeros(1 << top, np.uint8)
    for s, (code, n) in canonical(present).items():
        symbols[code :: 1 << n] = s
        bits[code :: 1 << n] = n
    return symbols, bits, top


def prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits, extra bits of a length or distance (from 1)."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = (v >> (top - 1)) & 1
    return 2 * top + half, top - 1, v & ((1 << (top - 1)) - 1)


class Bits:
    """A reader of single fields."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        at = self.at
        self.at = at + n
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7)) & ((1 << n) - 1)

    def symbol(self, table) -> int:
        symbols, bits, top = table
        if not top:
            return int(symbols[0])
        at = self.at
        w = (int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & ((1 << top) - 1)
        self.at = at + int(bits[w])
        return int(symbols[w])


# --------------------------------------------------------------------------- decoder
def _read_code(bits: Bits, size: int):
    if bits.read(1):  # simple
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        lengths = bytearray(size)
        if two:
            lengths[first] = lengths[bits.read(8)] = 1
            return lookup(bytes(lengths))
        return np.array([first], np.uint16), np.zeros(1, np.uint8), 0
    own = bytearray(19)
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    most = size
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
    symbols, sizes, top = _as_lists(bytes(own))
    lengths, i, last = bytearray(size), 0, 8
    at = bits.at
    v, room = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 600], "little") >> (at & 7), 0
    mask = (1 << top) - 1
    while i < size and most:
        most -= 1
        if room > 4600:
            at, room = at + room, 0
            v = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 600], "little") >> (at & 7)
        s, n = symbols[v & mask], sizes[v & mask]
        v >>= n
        room += n
        if s < 16:
            lengths[i] = s
            i += 1
            if s:
                last = s
            continue
        n, base = ((2, 3), (3, 3), (7, 11))[s - 16]
        times = base + (v & ((1 << n) - 1))
        v >>= n
        room += n
        if i + times > size:
            raise ValueError("code lengths run over")
        if s == 16:
            lengths[i : i + times] = bytes([last]) * times
        i += times
    bits.at = at + room
    return lookup(bytes(lengths))


@lru_cache(64)
def _as_lists(own: bytes):
    symbols, sizes, top = lookup(own)
    return symbols.tolist(), sizes.tolist(), top


@lru_cache(1)
def _distance_map() -> list[tuple[int, int]]:
    return _near()


def _number(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = _distance_map()[code - 1]
    return max(x + y * width, 1)


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers."""
    cache = bits.read(4) if bits.read(1) else 0
    groups, which, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        w = (width + (1 << shift) - 1) >> shift
        codes = _read_pixels(bits, w, (height + (1 << shift) - 1) >> shift, False)
        which = ((codes >> np.uint32(8)) & np.uint32(0xFFFF)).reshape(-1, w)
        groups = int(which.max()) + 1
    sizes = (256 + LENGTHS + ((1 << cache) if cache else 0), 256, 256, 256, DISTANCES)
    tables = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    if groups == 1 and not cache:
        return _follow(bits, tables[0], width, width * height)
    return _step(bits, tables, which, shift, cache, width, width * height)


def _step(bits, tables, which, shift, cache, width, n) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    colours = [0] * (1 << cache)
    kept = 0  # pixels whose colours are in the cache

    def remember(to):
        nonlocal kept
        for x in out[kept:to].tolist():
            colours[((CACHE_FACTOR * x) & 0xFFFFFFFF) >> (32 - cache)] = x
        kept = to

    i = 0
    while i < n:
        green, red, blue, alpha, distance = tables[int(which[(i // width) >> shift, (i % width) >> shift]) if which is not None else 0]
        s = bits.symbol(green)
        if s < 256:
            r = bits.symbol(red)
            b = bits.symbol(blue)
            out[i] = (bits.symbol(alpha) << 24) | (r << 16) | (s << 8) | b
            i += 1
        elif s < 256 + LENGTHS:
            length = _number(bits, s - 256)
            back = _distance(_number(bits, bits.symbol(distance)), width)
            _copy(out, i, back, length)
            i += length
        else:
            if cache:
                remember(i)
            out[i] = colours[s - 256 - LENGTHS]
            i += 1
    return out


def _copy(out: np.ndarray, i: int, back: int, length: int) -> None:
    if back > i or i + length > len(out):
        raise ValueError("back-reference leaves the image")
    while length:
        n = min(back, length)
        out[i : i + n] = out[i - back : i - back + n]
        i, length, back = i + n, length - n, back + (n if back == n else 0)


def _follow(bits: Bits, tables, width: int, n: int) -> np.ndarray:
    """One group without cache: what each bit position would mean, then the chain of positions."""
    if all(not t[2] for t in tables[:4]) and int(tables[0][0][0]) < 256:
        g, r, b, a = (int(t[0][0]) for t in tables[:4])
        return np.full(n, (a << 24) | (r << 16) | (g << 8) | b, np.uint32)
    base = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8)[base:]
    raw = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint32)
    three = raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))
    window = (three[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
    last = len(window) - 1
    here = np.arange(last + 1, dtype=np.int32)
    after: dict[int, np.ndarray] = {}
    for _, sizes, top in tables[:4]:
        if id(sizes) not in after:
            after[id(sizes)] = here + sizes.take(window & np.uint32((1 << top) - 1))
    g, r, b, a = (after[id(t[1])] for t in tables[:4])
    masks = [np.uint32((1 << t[2]) - 1) for t in tables[:4]]
    green = tables[0][0].take(window & masks[0])
    jump = a.take(b.take(r.take(g, mode="clip"), mode="clip"), mode="clip")
    np.minimum(jump, last, out=jump)
    jump[green >= 256] = -1
    chain = memoryview(jump)
    out = np.zeros(n, np.uint32)
    at, i, pending, start = bits.at - 8 * base, 0, [], 0
    put = pending.append

    def write():
        nonlocal start
        if pending:
            p = np.array(pending, np.int64)
            channels, q = [], p
            for table, mask, step in zip(tables[1:4], masks[1:], (g, r, b), strict=True):
                q = np.minimum(step[q], last)
                channels.append(table[0][window[q] & mask].astype(np.uint32))
            red, blue, alpha = channels
            out[start : start + len(p)] = (alpha << np.uint32(24)) | (red << np.uint32(16)) | (green[p].astype(np.uint32) << np.uint32(8)) | blue
            start += len(p)
            pending.clear()

    while i < n:
        to = chain[at]
        if to >= 0:
            put(at)
            at = to
            i += 1
            continue
        write()
        bits.at = 8 * base + int(min(g[at], last))
        length = _number(bits, int(green[at]) - 256)
        back = _distance(_number(bits, bits.symbol(tables[4])), width)
        _copy(out, i, back, length)
        i += length
        start = i
        at = bits.at - 8 * base
    write()
    bits.at = 8 * base + at
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    """ARGB numbers as (..., 4) R, G, B, A."""
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)[..., [2, 1, 0, 3]]


def _numbers(rgba: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rgba[..., [2, 1, 0, 3]]).view("<u4")[..., 0]


def _average(a, b):
    return (a.astype(np.int16) + b) >> 1


def _predict(mode: int, left, top, topleft, topright):
    """The prediction for pixels (..., 4) from their neighbours, as in the format's 14 modes."""
    L, T, TL, TR = (x.astype(np.int16) for x in (left, top, topleft, topright))
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255], np.int16), L.shape)
    if mode < 5:
        return (L, T, TR, TL)[mode - 1]
    if mode == 5:
        return _average(_average(L, TR), T)
    if mode < 10:
        return _average(*((L, TL), (L, T), (TL, T), (T, TR))[mode - 6])
    if mode == 10:
        return _average(_average(L, TL), _average(T, TR))
    if mode == 11:
        nearer = np.abs(T - TL).sum(-1, keepdims=True) < np.abs(L - TL).sum(-1, keepdims=True)
        return np.where(nearer, L, T)
    if mode == 12:
        return np.clip(L + T - TL, 0, 255)
    half = _average(L, T)
    return np.clip(half + ((half - TL) / 2).astype(np.int16), 0, 255)


def _unpredict(rest: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Add predictions back: rows of one mode that needs no left neighbour (or only it) at once, others pixel by pixel."""
    h, w, _ = rest.shape
    out = rest.copy()
    out[0, 0] += np.array([0, 0, 0, 255], np.uint8)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    for y in range(1, h):
        out[y, 0] += out[y - 1, 0]
        row = modes[y >> bits]
        above = out[y - 1]
        for x0 in range(0, w, 1 << bits):
            a, b = max(x0, 1), min(x0 + (1 << bits), w)
            if a >= b:
                continue
            mode = int(row[x0 >> bits])
            right = above[a + 1 : b + 1] if b < w else np.concatenate([above[a + 1 :], out[y, :1]])
            if mode == 1:
                out[y, a - 1 : b] = np.cumsum(np.concatenate([out[y, a - 1 : a], rest[y, a:b]]), axis=0, dtype=np.uint8)
            elif mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                out[y, a:b] = rest[y, a:b] + _predict(mode, above[a:b], above[a:b], above[a - 1 : b - 1], right).astype(np.uint8)
            else:
                for x in range(a, b):
                    out[y, x] = rest[y, x] + _predict(mode, out[y, x - 1], above[x], above[x - 1], right[x - a]).astype(np.uint8)
    return out


def _block(values: np.ndarray, bits: int, h: int, w: int) -> np.ndarray:
    return np.repeat(np.repeat(values, 1 << bits, 0)[:h], 1 << bits, 1)[:, :w]


def _colour_delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((t.view(np.int8).astype(np.int16) * c.view(np.int8).astype(np.int16)) >> 5).astype(np.uint8)


def _uncross(pixels: np.ndarray, elements: np.ndarray, bits: int, sign: int = 1) -> np.ndarray:
    h, w, _ = pixels.shape
    red_to_blue, green_to_blue, green_to_red = (np.ascontiguousarray(_block(elements[..., i], bits, h, w)) for i in range(3))
    out = pixels.copy()
    green, red = np.ascontiguousarray(pixels[..., 1]), np.ascontiguousarray(pixels[..., 0])
    new_red = red + sign * _colour_delta(green_to_red, green) if sign > 0 else red - _colour_delta(green_to_red, green)
    base = new_red if sign > 0 else red
    delta = _colour_delta(green_to_blue, green) + _colour_delta(red_to_blue, np.ascontiguousarray(base))
    out[..., 0] = new_red
    out[..., 2] = pixels[..., 2] + delta if sign > 0 else pixels[..., 2] - delta
    return out


def _bundle(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]] + bytes(8))
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOR):
            size = bits.read(3) + 2
            across = (w + (1 << size) - 1) >> size
            image = _channels(_read_pixels(bits, across, (height + (1 << size) - 1) >> size, False)).reshape(-1, across, 4)
            undo.append((kind, size, image, w))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_read_pixels(bits, n, 1, False)), axis=0, dtype=np.uint8)
            undo.append((kind, _bundle(n), np.concatenate([table, np.zeros((256 - n, 4), np.uint8)]), w))
            w = (w + (1 << _bundle(n)) - 1) >> _bundle(n)
        else:
            undo.append((kind, 0, None, w))
    pixels = _channels(_read_pixels(bits, w, height, True)).reshape(height, w, 4)
    for kind, size, image, across in reversed(undo):
        if kind == PREDICTOR:
            pixels = _unpredict(np.ascontiguousarray(pixels), image[..., 1], size)
        elif kind == CROSS_COLOR:
            pixels = _uncross(pixels, image, size)
        elif kind == SUBTRACT_GREEN:
            pixels = pixels.copy()
            pixels[..., 0] += pixels[..., 1]
            pixels[..., 2] += pixels[..., 1]
        else:
            each = 8 >> size
            index = (pixels[..., 1][:, :, None] >> (each * np.arange(1 << size, dtype=np.uint8))) & np.uint8((1 << each) - 1)
            pixels = image[index.reshape(height, -1)[:, :across]]
    return pixels


# --------------------------------------------------------------------------- encoder
class Writer:
    """Fields and arrays of codes, packed together at the end."""

    def __init__(self):
        self.values, self.sizes, self.acc, self.n = [], [], 0, 0

    def put(self, value: int, n: int) -> None:
        self.acc |= value << self.n
        self.n += n

    def flush(self) -> None:
        if self.n:
            parts = (self.n + 15) >> 4
            sizes = np.full(parts, 16, np.int64)
            sizes[-1] = self.n - 16 * (parts - 1)
            self.values.append(np.frombuffer(self.acc.to_bytes(2 * parts, "little"), "<u2").astype(np.uint64))
            self.sizes.append(sizes)
            self.acc = self.n = 0

    def codes(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.flush()
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        self.flush()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        stop = np.cumsum(sizes)
        start = stop - sizes
        word = start >> 5
        total = int(stop[-1])
        # Codes don't share bits, so sums are unions; below 2**47 they are exact in floats.
        sums = np.bincount(word, (values << (start & 31).astype(np.uint64)).astype(np.float64), (total >> 5) + 2).astype(np.uint64)
        low = (sums & np.uint64(0xFFFFFFFF)).astype(np.uint64)
        low[1:] += sums[:-1] >> np.uint64(32)
        return low.astype("<u4").tobytes()[: (total + 7) >> 3]


# A fixed complete code for code lengths: 14 symbols of 4 bits, 4 of 5 bits (16 is not used).
_HEAD = {s: 4 for s in (0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 17, 18)} | {s: 5 for s in (1, 13, 14, 15)}
_HEAD_CODE = canonical(_HEAD)


def _put_code(out: Writer, lengths: dict[int, int], size: int) -> None:
    symbols = sorted(lengths)
    if len(symbols) <= 2 and symbols[-1] < 256:
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for s in symbols:
            out.put(s, 8)
        return
    if len(symbols) == 1:  # a lone symbol beyond 255 needs a partner
        lengths = {symbols[0]: 1, 0: 1}
        symbols = sorted(lengths)
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(_HEAD.get(s, 0), 3)
    out.put(0, 1)
    at = 0
    for s in [*symbols, size]:
        gap = s - at
        while gap:
            if gap >= 11:
                n = min(gap, 138)
                out.put(*_HEAD_CODE[18])
                out.put(n - 11, 7)
            elif gap >= 3:
                n = gap
                out.put(*_HEAD_CODE[17])
                out.put(n - 3, 3)
            else:
                n = 1
                out.put(*_HEAD_CODE[0])
            gap -= n
        if s < size:
            out.put(*_HEAD_CODE[lengths[s]])
        at = s + 1


def _arrays(lengths: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    values, sizes = [0] * size, [0] * size
    for s, (code, n) in canonical(lengths).items():
        values[s], sizes[s] = code, n
    return np.array(values, np.uint64), np.array(sizes, np.int64)


def _histogram(x: np.ndarray) -> dict[int, int]:
    n = np.bincount(x)
    some = np.flatnonzero(n)
    return dict(zip(some.tolist(), n[some].tolist(), strict=True))


def _put_pixels(out: Writer, rgba: np.ndarray, main: bool, cache: int = 0, groups: int = 0) -> None:
    """An entropy-coded image: literals, a back-reference for the closing run, cache hits if asked for."""
    flat = rgba.reshape(-1, 4)
    n = len(flat)
    height, width = rgba.shape[:2]
    packed = _numbers(flat)
    end = n
    if n > 8 and packed[-1] == packed[-2]:
        differ = np.flatnonzero(packed != packed[-1])
        end = int(differ[-1]) + 2 if len(differ) else 1
        if n - end < 4:
            end = n
    run = n - end
    green = flat[:end, 1].astype(np.int64)
    literal = np.ones(end, bool)
    if cache:
        seen = [-1] * (1 << cache)
        for i, x in enumerate(packed[:end].tolist()):
            k = ((CACHE_FACTOR * x) & 0xFFFFFFFF) >> (32 - cache)
            if seen[k] == x:
                literal[i] = False
                green[i] = 256 + LENGTHS + k
            seen[k] = x
    out.put(1 if cache else 0, 1)
    if cache:
        out.put(cache, 4)
    size = 256 + LENGTHS + ((1 << cache) if cache else 0)
    group = np.zeros(end, np.int64)
    if main:
        out.put(1 if groups else 0, 1)
        if groups:  # groups by blocks of 4 rows and columns
            out.put(0, 3)
            w, h = (width + 3) >> 2, (height + 3) >> 2
            which = np.zeros((h, w, 4), np.uint8)
            which[..., 1] = (np.arange(h)[:, None] + np.arange(w)) % groups
            which[..., 3] = 255
            groups = int(which[..., 1].max()) + 1
            _put_pixels(out, which, False)
            group = _block(which[..., 1], 2, height, width).ravel()[:end].astype(np.int64)
            last_group = int(_block(which[..., 1], 2, height, width).ravel()[min(end, n - 1)])
    last_group = last_group if main and groups else 0
    symbol, extra, more = prefix(run) if run else (0, 0, 0)
    back, back_extra, back_more = prefix(2)  # distance code 2: the pixel before
    values, sizes = np.zeros((end, 4), np.uint64), np.zeros((end, 4), np.int64)
    tail = None
    for k in range(max(groups, 1)):
        own = group == k
        lit = own & literal
        counts = _histogram(green[own]) or {0: 1}
        rest = _histogram(flat[:end][lit][:, [0, 2, 3]].ravel()) or {0: 1}
        if run and k == last_group:
            counts[256 + symbol] = 1
        codes = code_lengths(counts)
        if len(codes) == 1 and next(iter(codes)) > 255:
            codes = {next(iter(codes)): 1, 0: 1}
        same = code_lengths(rest)
        _put_code(out, codes, size)
        head = Writer()  # the same code for red, blue and alpha
        _put_code(head, same, 256)
        for _ in range(3):
            out.put(head.acc, head.n)
        _put_code(out, {back: 0}, DISTANCES)
        v, s = _arrays(codes, size)
        values[own, 0], sizes[own, 0] = v[green[own]], s[green[own]]
        if run and k == last_group:
            tail = (int(v[256 + symbol]), int(s[256 + symbol]))
        v, s = _arrays(same, 256)
        for j, channel in ((1, 0), (2, 2), (3, 3)):
            values[lit, j], sizes[lit, j] = v[flat[:end][lit][:, channel]], s[flat[:end][lit][:, channel]]
    out.codes(values.ravel(), sizes.ravel())
    if run:
        out.put(*tail)
        out.put(more, extra)
        out.put(back_more, back_extra)


def _bits(pixels: np.ndarray) -> float:
    n = np.bincount(pixels.ravel(), minlength=256)
    n = n[n > 0]
    return float(-(n * np.log2(n / n.sum())).sum())


def _repredict(pixels: np.ndarray, mode: int) -> np.ndarray:
    """What predictions of one mode leave."""
    h, w, _ = pixels.shape
    out = pixels.copy()
    above = np.zeros_like(pixels)
    above[1:] = pixels[:-1]
    left = np.zeros_like(pixels)
    left[:, 1:] = pixels[:, :-1]
    topleft = np.zeros_like(pixels)
    topleft[1:, 1:] = pixels[:-1, :-1]
    right = np.zeros_like(pixels)
    right[1:, :-1] = pixels[:-1, 1:]
    right[1:, -1] = pixels[1:, 0]
    out -= _predict(mode, left, above, topleft, right).astype(np.uint8)
    out[0] = pixels[0]
    out[0, 1:] -= pixels[0, :-1]
    out[0, 0] = pixels[0, 0] - np.array([0, 0, 0, 255], np.uint8)
    out[1:, 0] = pixels[1:, 0] - pixels[:-1, 0]
    return out


def encode(pixels: np.ndarray, transforms: list[tuple] | None = None, cache: int = 0, groups: int = 0) -> bytes:
    """A lossless WebP file.

    transforms, in order: ("palette",), ("green",), ("cross", red_to_blue, green_to_blue, green_to_red), ("predictor", mode).
    None takes a palette where there are at most 16 colours, else the cheapest of none, green and the left predictor.
    """
    height, width = pixels.shape[:2]
    if not (0 < height <= SIDE and 0 < width <= SIDE):
        raise ValueError("size out of range")
    pixels = np.ascontiguousarray(pixels)
    if transforms is None:
        flat = _numbers(pixels).ravel()
        if len(set(flat[:128].tolist())) <= 16 and len(np.unique(flat)) <= 16:
            transforms = [("palette",)]
        else:
            some = pixels[:64]  # enough to tell which transform suits
            green = some.copy()
            green[..., 0] -= some[..., 1]
            green[..., 2] -= some[..., 1]
            costs = {"none": _bits(some), "green": _bits(green), "predictor": _bits(some[:, 1:] - some[:, :-1]) + 200}
            best = min(costs, key=costs.get)
            transforms = {"none": [], "green": [("green",)], "predictor": [("predictor", 1)]}[best]
    out = Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind, *how in transforms:
        out.put(1, 1)
        h, w = pixels.shape[:2]
        if kind == "palette":
            out.put(PALETTE, 2)
            found, index = np.unique(_numbers(pixels), return_inverse=True)
            if len(found) > 256:
                raise ValueError("too many colours")
            out.put(len(found) - 1, 8)
            table = _channels(found)
            _put_pixels(out, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))[None], False)
            size = _bundle(len(found))
            each, per = 8 >> size, 1 << size
            across = (w + per - 1) >> size
            padded = np.zeros((h, across * per), np.uint8)
            padded[:, :w] = index.reshape(h, w)
            packed = (padded.reshape(h, across, per) << (each * np.arange(per, dtype=np.uint8))).sum(-1, dtype=np.uint8)
            pixels = np.zeros((h, across, 4), np.uint8)
            pixels[..., 1], pixels[..., 3] = packed, 255
        elif kind == "green":
            out.put(SUBTRACT_GREEN, 2)
            pixels = pixels.copy()
            pixels[..., 0] -= pixels[..., 1]
            pixels[..., 2] -= pixels[..., 1]
        else:
            out.put(CROSS_COLOR if kind == "cross" else PREDICTOR, 2)
            out.put(7, 3)
            element = np.zeros(((h + 511) >> 9, (w + 511) >> 9, 4), np.uint8)
            element[..., 3] = 255
            if kind == "cross":
                element[..., :3] = how
                pixels_new = _uncross(pixels, element, 9, -1)
            else:
                element[..., 1] = how[0]
                pixels_new = _repredict(pixels, how[0])
            _put_pixels(out, element, False)
            pixels = pixels_new
    out.put(0, 1)
    _put_pixels(out, pixels, True, cache, groups)
    body = b"\x2f" + out.bytes()
    chunk = struct.pack("<4sI", b"VP8L", len(body)) + body + b"\0" * (len(body) & 1)
    return struct.pack("<4sI4s", b"RIFF", len(chunk) + 4, b"WEBP") + chunk
