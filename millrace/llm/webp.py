"""Lossless WebP images: a decoder of the whole format, an encoder, and lanes for many grey images at once.

In the lanes all images are read in step, one symbol of each at a time, whatever
their prefix codes; places that a back-reference fills are looked up at the end.
Files that need more than one code to a pixel, a colour cache or several groups
of codes go one by one.

Pixels are numbers with alpha, red, green and blue from the highest byte down.
Bits are read from the lowest bit of each byte up.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from itertools import groupby

import numpy as np

#: Fixed values of the format.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
OPAQUE = 0xFF000000
#: Near pixels that short distance codes stand for: by distance, then by |x|, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# bits


class Bits:
    """Reader; beyond the end it gives zeros, and ``over`` tells."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        """The next n bits, 56 at most."""
        low = self.at >> 3
        return (int.from_bytes(self.data[low : low + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        return out

    @property
    def over(self) -> bool:
        return self.at > self.size


class Writer:
    def __init__(self):
        self.done, self.value, self.open = bytearray(), 0, 0

    @property
    def at(self) -> int:
        return 8 * len(self.done) + self.open

    def write(self, x: int, n: int) -> None:
        self.value |= x << self.open
        self.open += n
        if self.open >= 64:
            self.done += (self.value & (2**64 - 1)).to_bytes(8, "little")
            self.value >>= 64
            self.open -= 64

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.open + 7) // 8, "little")


# prefix codes


def code_lengths(weights: list[int], most: int = 15) -> list[int]:
    """Lengths of a complete prefix code, at most ``most``; weights are flattened until it fits. A single symbol has length 1."""
    used = [i for i, w in enumerate(weights) if w]
    lengths = [0] * len(weights)
    if len(used) == 1:
        lengths[used[0]] = 1
        return lengths
    while True:
        n = len(used)
        heap = [(weights[i], k) for k, i in enumerate(used)]
        heapq.heapify(heap)
        above, node = [0] * (2 * n), n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            above[a[1]] = above[b[1]] = node
            heapq.heappush(heap, (a[0] + b[0], node))
            node += 1
        depth = [0] * (2 * n)
        for k in range(node - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n], default=0) <= most:
            for k, i in enumerate(used):
                lengths[i] = depth[k]
            return lengths
        weights = [(w + 1) // 2 + 1 if w else 0 for w in weights]


@lru_cache(maxsize=32)
def _reversed_bits(width: int) -> np.ndarray:
    """Every number of so many bits, read backwards."""
    x = np.arange(1 << width)
    return sum(((x >> k) & 1) << (width - 1 - k) for k in range(width)) if width else x


def _canonical(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in the order of their codes, their lengths, and their codes with the first bit highest."""
    n = np.asarray(lengths, np.int64)
    used = np.flatnonzero(n)
    used = used[np.argsort(n[used], kind="stable")]
    size, width = n[used], int(n.max(initial=0))
    room = np.int64(1) << (width - size)
    return used, size, (np.cumsum(room) - room) >> (width - size)


def codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code as it stands in the stream, first bit lowest; length), canonical."""
    used, size, code = _canonical(lengths)
    width = int(size.max(initial=0))
    return dict(zip(used.tolist(), zip(_reversed_bits(width)[code << (width - size)].tolist(), size.tolist(), strict=True), strict=True))


class Prefix:
    """A code for reading: a table by the next bits; one symbol alone takes no bits."""

    def __init__(self, lengths: list[int]):
        used, size, _ = _canonical(lengths)
        self.only = int(used[0]) if len(used) == 1 else 0 if not len(used) else None
        self.width = int(size.max(initial=0))
        if self.only is None:
            room = np.int64(1) << (self.width - size)
            if room.sum() != 1 << self.width:
                raise ValueError("incomplete prefix code")
            at = _reversed_bits(self.width)
            self.symbol, self.length = np.repeat(used, room)[at].astype(np.int16), np.repeat(size, room)[at].astype(np.int8)

    @classmethod
    @lru_cache(maxsize=512)
    def single(cls, symbol: int) -> Prefix:
        """The code of one symbol, which takes no bits."""
        out = cls([])
        out.only = symbol
        return out

    @cached_property
    def pairs(self) -> list[tuple[int, int]]:
        return list(zip(self.symbol.tolist(), self.length.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.pairs[bits.peek(self.width)]
        bits.at += n
        return symbol


def read_prefix(bits: Bits, symbols: int) -> Prefix:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        if not two:
            return Prefix.single(bits.read(8 if wide else 1))
        found = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        return Prefix([int(i in found) for i in range(max(symbols, max(found) + 1))])
    lengths = [0] * 19
    for k in range(4 + bits.read(4)):
        lengths[LENGTH_ORDER[k]] = bits.read(3)
    inner = Prefix(lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    out, last = [], 8
    while len(out) < symbols and left:
        left -= 1
        s = inner.read(bits)
        if s < 16:
            out.append(s)
            last = s or last
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            out += [last if s == 16 else 0] * n
    if len(out) > symbols or bits.over:
        raise ValueError("code lengths run over")
    return Prefix(out + [0] * (symbols - len(out)))


def write_prefix(w: Writer, lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Write a code and give what to write for each symbol."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        w.write(1, 1)
        for s in used:
            w.write(s, 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    runs = []
    for value, same in groupby(lengths):
        n = len(list(same))
        while n:
            if value == 0 and n >= 3:
                k = min(n, 138)
                runs.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            elif n >= 4:
                k = min(n, 7)
                runs += [(value, 0, 0), (16, k - 4, 2)]
            else:
                k = 1
                runs.append((value, 0, 0))
            n -= k
    weights = [0] * 19
    for s, _, _ in runs:
        weights[s] += 1
    inner = code_lengths(weights, 7)
    w.write(0, 1)
    count = max(4, max(k for k in range(19) if inner[LENGTH_ORDER[k]]) + 1)
    w.write(count - 4, 4)
    for k in range(count):
        w.write(inner[LENGTH_ORDER[k]], 3)
    w.write(0, 1)
    known = codes(inner) if sum(n > 0 for n in inner) > 1 else {s: (0, 0) for s in range(19)}
    for s, extra, n in runs:
        w.write(*known[s])
        w.write(extra, n)
    return {s: (0, 0) for s in used} if len(used) == 1 else codes(lengths)


# image data


def _value(prefix: int, bits: Bits) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def split_value(v: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + ((v >> n) & 1), v & ((1 << n) - 1), n


def _slot(pixel: int, cache_bits: int) -> int:
    return ((pixel * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits)


def read_image(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """Pixels of an entropy-coded image; only the main one may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache is too large")
    group_of, tile, across = None, 0, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        group_of = [(p >> 8) & 0xFFFF for p in read_image(bits, across, -(-height >> tile), False)]
    sizes = [256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    groups = [[read_prefix(bits, n) for n in sizes] for _ in range(max(group_of) + 1 if group_of else 1)]
    cache = [0] * (1 << cache_bits)
    out: list[int] = []
    total = width * height
    while len(out) < total:
        if bits.over:
            raise ValueError("image data ends early")
        i = len(out)
        green, red, blue, alpha, far = groups[group_of[(i // width >> tile) * across + (i % width >> tile)] if group_of else 0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            new = [a << 24 | r << 16 | s << 8 | b]
        elif s < 280:
            length = _value(s - 256, bits)
            code = _value(far.read(bits), bits)
            back = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if back > i or i + length > total:
                raise ValueError("back-reference leaves the image")
            new = out[i - back : i - back + length] if length <= back else (out[i - back :] * (length // back + 1))[:length]
        else:
            new = [cache[s - 280]]
        if cache_bits:
            for p in new:
                cache[_slot(p, cache_bits)] = p
        out += new
    return out


# transforms, on arrays of (height, width, 4) with alpha, red, green, blue


def _planes(pixels: list[int] | np.ndarray, width: int) -> np.ndarray:
    return np.asarray(pixels, ">u4").view(np.uint8).reshape(-1, width, 4).astype(np.int32)


def _pixels(planes: np.ndarray) -> list[int]:
    return np.ascontiguousarray(planes.astype(np.uint8)).view(">u4").ravel().tolist()


def _predicted(mode: int, left, top, right_top, left_top) -> np.ndarray:
    """Predictions from the neighbours, arrays of pixels by four channels."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        guess = left + top - left_top
        return np.where((np.abs(guess - left).sum(-1) < np.abs(guess - top).sum(-1))[..., None], left, top)
    if mode == 13:
        m = mean(left, top)
        d = m - left_top
        return np.clip(m + np.where(d < 0, -(-d // 2), d // 2), 0, 255)
    black = np.array([255, 0, 0, 0])
    return [
        lambda: black, lambda: left, lambda: top, lambda: right_top, lambda: left_top,
        lambda: mean(mean(left, right_top), top), lambda: mean(left, left_top), lambda: mean(left, top), lambda: mean(left_top, top),
        lambda: mean(top, right_top), lambda: mean(mean(left, left_top), mean(top, right_top)), None, lambda: np.clip(left + top - left_top, 0, 255),
        None, lambda: black, lambda: black,
    ][mode]()


def predict(x: np.ndarray, modes: np.ndarray, tile: int, inverse: bool) -> np.ndarray:
    """Add the predictions to residuals, or (not inverse) take them off.

    A pixel needs the one to its left and three of the row above, so all pixels
    whose column plus twice their row is the same are added at once.
    """
    height, width, _ = x.shape
    out = x.copy()
    sign = 1 if inverse else -1
    black = np.array([255, 0, 0, 0])
    if inverse:
        out[0, 0] += black
        out[0] = np.cumsum(out[0], 0)
        out[:, 0] = np.cumsum(out[:, 0], 0)
    else:
        out[0, 0] -= black
        out[0, 1:] -= x[0, :-1]
        out[1:, 0] -= x[:-1, 0]
    out &= 255
    done = out if inverse else x
    flat = done.reshape(-1, 4)
    kinds = np.unique(modes)
    if inverse and len(kinds) == 1 and kinds[0] in (1, 2):  # each row, or each column, is a running sum
        if height > 1 and width > 1:
            axis = 1 if kinds[0] == 1 else 0
            part = out[1:] if axis else out[:, 1:]
            part[...] = np.cumsum(part, axis) & 255
        return out

    def add(rows, columns):
        at = rows * width + columns
        mode = modes[rows >> tile, columns >> tile]
        for k in np.unique(mode):
            own = at[mode == k]
            p = _predicted(int(k), flat[own - 1], flat[own - width], flat[own - width + 1], flat[own - width - 1])
            out.reshape(-1, 4)[own] = (x.reshape(-1, 4)[own] + sign * p) & 255

    if not inverse:
        if height > 1 and width > 1:
            add(np.repeat(np.arange(1, height), width - 1), np.tile(np.arange(1, width), height - 1))
        return out
    for t in range(3, width + 2 * height - 2):
        rows = np.arange(max(1, (t - width + 2) // 2), min(height - 1, (t - 1) // 2) + 1)
        if len(rows):
            add(rows, t - 2 * rows)
    return out


def cross_colour(x: np.ndarray, factors: np.ndarray, tile: int, inverse: bool) -> np.ndarray:
    """factors (rows, columns, 4): red to blue, green to blue and green to red stand in red, green and blue."""
    rows, columns = np.arange(x.shape[0]) >> tile, np.arange(x.shape[1]) >> tile
    f = factors[rows][:, columns].astype(np.uint8).view(np.int8).astype(np.int32)
    signed = lambda c: ((c & 255) ^ 128) - 128
    part = lambda t, c: (t * signed(c)) >> 5
    out = x.copy()
    sign = 1 if inverse else -1
    red = (x[..., 1] + sign * part(f[..., 3], x[..., 2])) & 255
    out[..., 1] = red
    true_red = red if inverse else x[..., 1]
    out[..., 3] = (x[..., 3] + sign * (part(f[..., 2], x[..., 2]) + part(f[..., 1], true_red))) & 255
    return out


def subtract_green(x: np.ndarray, inverse: bool) -> np.ndarray:
    out = x.copy()
    for c in (1, 3):
        out[..., c] = (x[..., c] + (x[..., 2] if inverse else -x[..., 2])) & 255
    return out


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def from_palette(x: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    pack = _packing(len(table))
    each = 8 >> pack
    index = x[..., 2]
    if pack:
        index = ((index[..., None] >> (each * np.arange(1 << pack))) & ((1 << each) - 1)).reshape(len(x), -1)[:, :width]
    padded = np.zeros((256, 4), np.int32)
    padded[: len(table)] = table
    return padded[index]


def to_palette(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    pack = _packing(len(table))
    each = 8 >> pack
    at = {tuple(c): k for k, c in enumerate(table.tolist())}
    index = np.array([[at[tuple(p)] for p in row] for row in x.tolist()])
    if pack:
        index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << pack))))
        index = (index.reshape(len(index), -1, 1 << pack) << (each * np.arange(1 << pack))).sum(2)
    out = np.zeros((*index.shape, 4), np.int32)
    out[..., 0], out[..., 2] = 255, index
    return out


# files


def wrap(data: bytes) -> bytes:
    """The file of a bit stream; chunks have even lengths."""
    body = b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def files(data: bytes) -> list[bytes]:
    """Bit streams of files that stand one behind another."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        size, length = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<I", data, at + 16)[0]
        if at + 8 + size > len(data) or length + 12 > size:
            raise ValueError("file ends early")
        out.append(data[at + 20 : at + 20 + length])
        at += 8 + size
    return out


def _head(bits: Bits) -> tuple[int, int, list]:
    """Width and height of the coded image, and what undoes its transforms, last written first; the reader stands at its data."""
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            across = -(-now >> tile)
            image = _planes(read_image(bits, across, -(-height >> tile), False), across)
            undo.append((lambda x, m=image, t=tile: predict(x, m[..., 2] & 15, t, True)) if kind == PREDICTOR else (lambda x, m=image, t=tile: cross_colour(x, m, t, True)))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda x: subtract_green(x, True))
        else:
            size = bits.read(8) + 1
            table = np.cumsum(_planes(read_image(bits, size, 1, False), size)[0], 0) & 255
            undo.append(lambda x, t=table, n=now: from_palette(x, t, n))
            now = -(-now >> _packing(size))
    return now, height, undo[::-1]


def _undone(x: np.ndarray, undo: list) -> np.ndarray:
    for step in undo:
        x = step(x)
    return x.astype(np.uint8)


def decode(stream: bytes) -> np.ndarray:
    """Array (height, width, 4) of alpha, red, green and blue, 8 bits each."""
    bits = Bits(stream)
    width, height, undo = _head(bits)
    x = _planes(read_image(bits, width, height, True), width)
    if bits.over:
        raise ValueError("image data ends early")
    return _undone(x, undo)


def _references(pixels: list[int], width: int, cache_bits: int, search: bool) -> list[tuple]:
    """Literals, cache hits and back-references of pixels, by a greedy search for the last place of the same three pixels."""
    out, i = [], 0
    last: dict[tuple, int] = {}
    cache: list[int | None] = [None] * (1 << cache_bits)
    code_of = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    while i < len(pixels):
        key, n = tuple(pixels[i : i + 3]), 0
        back = i - last.get(key, i)
        if search and back:
            while n < 4096 and i + n < len(pixels) and pixels[i + n] == pixels[i + n - back]:
                n += 1
        if n >= 3:
            out.append(("copy", n, code_of.get(back, back + 120)))
        else:
            n = 1
            hit = cache_bits and cache[_slot(pixels[i], cache_bits)] == pixels[i]
            out.append(("hit", _slot(pixels[i], cache_bits)) if hit else ("pixel", pixels[i]))
        for k in range(i, i + n):
            last[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[_slot(pixels[k], cache_bits)] = pixels[k]
        i += n
    return out


def write_image(w: Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, search: bool = False) -> None:
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if main:
        w.write(0, 1)
    items = _references(pixels, width, cache_bits, search)
    weights = [[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    spelled = []
    for kind, *v in items:
        if kind == "pixel":
            p = v[0]
            s = [(0, (p >> 8) & 255), (1, (p >> 16) & 255), (2, p & 255), (3, p >> 24)]
        elif kind == "hit":
            s = [(0, 280 + v[0])]
        else:
            (a, ea, na), (b, eb, nb) = split_value(v[0]), split_value(v[1])
            s = [(0, 256 + a), (None, ea, na), (4, b), (None, eb, nb)]
        spelled += s
        for t, x, *_ in s:
            if t is not None:
                weights[t][x] += 1
    tables = [write_prefix(w, code_lengths(x) if any(x) else [0] * len(x)) for x in weights]
    for t, x, *n in spelled:
        w.write(*((x, n[0]) if t is None else tables[t][x]))


def encode(x: np.ndarray, transforms: tuple = (), cache_bits: int = 0, search: bool = False) -> bytes:
    """Bit stream of an array (height, width, 4).

    transforms, in the order of writing: ("palette",), ("predictor", tile,
    modes), ("cross colour", tile, factors), ("subtract green",).
    """
    x = np.asarray(x, np.int32)
    w = Writer()
    w.write(0x2F, 8)
    w.write(x.shape[1] - 1, 14)
    w.write(x.shape[0] - 1, 14)
    w.write(int((x[..., 0] != 255).any()), 1)
    w.write(0, 3)
    for name, *more in transforms:
        w.write(1, 1)
        if name == "palette":
            table = np.unique(x.reshape(-1, 4), axis=0)
            w.write(PALETTE, 2)
            w.write(len(table) - 1, 8)
            write_image(w, _pixels(np.diff(table, axis=0, prepend=0) & 255), len(table), False)
            x = to_palette(x, table)
        elif name == "subtract green":
            w.write(SUBTRACT_GREEN, 2)
            x = subtract_green(x, False)
        else:
            tile, image = more
            w.write(PREDICTOR if name == "predictor" else CROSS_COLOUR, 2)
            w.write(tile - 2, 3)
            if name == "predictor":
                full = np.zeros((*image.shape, 4), np.int32)
                full[..., 0], full[..., 2] = 255, image
                write_image(w, _pixels(full), image.shape[1], False)
                x = predict(x, image, tile, False)
            else:
                write_image(w, _pixels(image), image.shape[1], False)
                x = cross_colour(x, image, tile, False)
    w.write(0, 1)
    write_image(w, _pixels(x), x.shape[1], True, cache_bits, search)
    return w.bytes()


# many grey images at once; the samples are green, and the other channels hold one value each

#: Codes of the lanes have so many bits at most, so that their tables stay small.
LANE_BITS = 11


def _one(w: Writer, symbol: int) -> None:
    """A code of one symbol."""
    for x, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
        w.write(x, n)


@dataclass(frozen=True)
class Shared:
    """Codes that many images share: the bits behind the size, their number, and code and length of each green symbol and distance prefix."""

    head: bytes
    bits: int
    green: np.ndarray
    green_bits: np.ndarray
    far: np.ndarray
    far_bits: np.ndarray


@lru_cache(maxsize=2)
def shared_code(copies: bool) -> Shared:
    """Fixed codes for written text, without or with back-references.

    Letters that are frequent in written text get short codes, every byte has
    one. Red, blue and alpha have one symbol each.
    """
    weights = [2] * 256 + [0] * 24
    for chars, weight in ((range(128, 256), 8), (range(32, 127), 16), (range(48, 91), 32), (b"\n.,", 256), (range(97, 123), 512), (b"lduschmg", 1024), (b"etaonirs", 2048), (b" ", 4096)):
        for c in chars:
            weights[c] = weight
    reach = [0] * 40
    if copies:  # lengths from four on and distances within an image
        weights[256:] = [1, 1, 1, 256, 768, 512, 256, 256, 192, 128, 96, 64, 48, 32, 24, 16, 16, 16, 16, 16, 16, 16, 16, 16]
        reach = [1 if k < 8 else 4 if k < 14 else 2 ** (k // 2 - 4) if k < 26 else 1 for k in range(40)]
    w = Writer()
    w.write(0, 3)  # no transform, no colour cache, one group of codes
    green, far = np.zeros((2, 280), np.int64), np.zeros((2, 40), np.int64)
    for s, code in write_prefix(w, code_lengths(weights, LANE_BITS)).items():
        green[:, s] = code
    for only in (0, 0, 255):
        _one(w, only)
    if copies:
        for s, code in write_prefix(w, code_lengths(reach, LANE_BITS)).items():
            far[:, s] = code
    else:
        _one(w, 0)
    return Shared(w.bytes(), w.at, *green, *far)


@lru_cache(maxsize=8)
def _distance_codes(width: int) -> np.ndarray:
    """Code of each distance up to that of the farthest near pixel; others have distance plus 120."""
    out = np.arange(8 * width + 8) + 120
    for k, (x, y) in reversed(list(enumerate(NEAR))):
        if x + y * width > 0:
            out[x + y * width] = k + 1
    return out


def _split_values(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number of many lengths or distances."""
    v = v - 1
    n = np.maximum(0, np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 2)
    prefix = np.where(v < 4, v, 2 * n + 2 + ((v >> n) & 1))
    n = np.where(v < 4, 0, n)
    return prefix, v & ((np.int64(1) << n) - 1), n


def _matches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample how many from it on also stand at the last place of the same four, 0 if there is none; and how far back that is."""
    n = len(data)
    length, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 8:
        return length, back
    wide = data.astype(np.uint64)
    image = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(image[:-3] == image[3:])
    key = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24) | image[:-3].astype(np.uint64) << np.uint64(32)
    key = key[inside]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    at, before = inside[order[1:][same]], inside[order[:-1][same]]
    back[at] = at - before
    # a run of places with one distance is one match; its last place adds four
    change = np.flatnonzero(np.concatenate((back[1:] != back[:-1], [True])))
    last = change[np.searchsorted(change, np.arange(n))]
    length = np.where(back > 0, np.minimum(last - np.arange(n) + 4, 4096), 0)
    return length, back


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of literals (length 1, distance 0) and copies, by a greedy walk over matches that pay."""
    length, back = _matches(data, offsets)
    pays = np.flatnonzero(4.5 * length > 12 + np.log2(np.maximum(back, 1)))
    after = np.searchsorted(pays, pays + length[pays]).tolist()
    taken, i, n = [], 0, len(pays)
    while i < n:
        taken.append(i)
        i = after[i]
    at = pays[taken]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[at + 1] += 1
    inside[at + length[at]] -= 1
    start = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
    copy = np.zeros(len(data), bool)
    copy[at] = True
    copy = copy[start]
    return start, np.where(copy, length[start], 1), np.where(copy, back[start], 0)


def _written(image: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], heads: list[tuple[bytes, int]]) -> list[bytes]:
    """Bit streams of a head and then the tokens of the image, in order; a token is parts (value, bits), 56 bits together at most."""
    value, size = np.zeros(len(image), np.int64), np.zeros(len(image), np.int64)
    for v, n in parts:
        value |= v << size
        size += n
    ends = np.concatenate(([0], np.cumsum(size)))
    first = np.searchsorted(image, np.arange(len(heads) + 1))
    head_bits = np.array([n for _, n in heads], np.int64)
    room = (head_bits + ends[first[1:]] - ends[first[:-1]] + 7) // 8
    base = np.concatenate(([0], np.cumsum(room)))
    at = ends[:-1] + np.repeat(8 * base[:-1] + head_bits - ends[first[:-1]], np.diff(first))
    size += at & 7
    value = (value << (at & 7)).view(np.uint64)
    at >>= 3
    out = np.zeros(base[-1] + 8, np.float64)
    while len(at):
        out += np.bincount(at, value & np.uint64(255), len(out))
        more = size > 8
        at, value, size = at[more] + 1, value[more] >> np.uint64(8), size[more] - 8
    out = out.astype(np.uint8)
    streams = []
    for i, (head, _) in enumerate(heads):
        own = out[base[i] : base[i + 1]]
        own[: len(head)] |= np.frombuffer(head, np.uint8)[: len(own)]
        streams.append(own.tobytes())
    return streams


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits that the counts of each row take at their own shares."""
    n = counts.sum(-1, keepdims=True)
    return -(counts * np.log2(np.maximum(counts, 1) / np.maximum(n, 1))).sum(-1)


def _histograms(image: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """How often each image has each value, from its rows."""
    return np.bincount((image[:, None] * 256 + rows).ravel(), minlength=256 * count).reshape(count, 256)


def _foretold(rows: np.ndarray, image: np.ndarray) -> list[np.ndarray]:
    """Residuals of rows by the sample to the left and by the one above, in first rows by the one to the left."""
    opens = np.concatenate(([True], image[1:] != image[:-1]))
    left, above = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    left[1:, 0] -= np.where(opens[1:], 0, rows[:-1, 0]).astype(np.uint8)
    above[1:] -= rows[:-1]
    above[opens] = left[opens]
    return [left, above]


def _own_codes(w: Writer, alpha: int, green: np.ndarray, reach: np.ndarray, into: list[np.ndarray]) -> None:
    """Write the codes of one image, and put code and length of its green symbols and distance prefixes into four rows."""
    w.write(0, 3)
    for s, (code, n) in write_prefix(w, code_lengths(green.tolist(), LANE_BITS)).items():
        into[0][s], into[1][s] = code, n
    for only in (0, 0, alpha):
        _one(w, only)
    for s, (code, n) in write_prefix(w, code_lengths(reach.tolist(), LANE_BITS) if reach.any() else [0] * 40).items():
        into[2][s], into[3][s] = code, n


def encode_texts(data: np.ndarray, offsets: np.ndarray, width: int = 64) -> list[bytes]:
    """Streams of images whose green samples are data[offsets[i]:offsets[i + 1]], a positive multiple of width each.

    Each image takes what makes it smaller: few values become a packed palette;
    samples that the ones to their left or above foretell become residuals;
    repeated strings become back-references. Codes of the image's own, with the
    tables that they need, are written where they save a quarter against the
    fixed ones, and with a transform.
    """
    count = len(offsets) - 1
    n = np.diff(offsets)
    dims = [0x2F | (width - 1) << 8 | (int(k) // width - 1) << 22 for k in n]
    rows = data.reshape(-1, width)
    image = np.repeat(np.arange(count), n // width)
    counts = _histograms(image, rows, count)
    plain, few = _entropy(counts), (counts > 0).sum(1) <= 16
    rest = _foretold(rows, image)
    foretold = [_entropy(_histograms(image, r, count)) for r in rest]
    mode = np.where(few | (np.minimum(*foretold) > 0.8 * plain - 64), 0, np.where(foretold[0] <= foretold[1], 1, 2))
    if mode.any():
        rows = np.where((mode[image] == 1)[:, None], rest[0], np.where((mode[image] == 2)[:, None], rest[1], rows))
    samples, widths = rows.ravel(), np.full(count, width)
    del rest, rows, image
    tables: dict[int, np.ndarray] = {}
    if few.any():
        parts = np.split(samples, offsets[1:-1])
        for i in np.flatnonzero(few).tolist():
            tables[i] = np.flatnonzero(counts[i])
            each = 8 >> _packing(len(tables[i]))
            index = np.searchsorted(tables[i], parts[i]).reshape(-1, 8 // each)
            parts[i] = (index << (each * np.arange(8 // each))).sum(1).astype(np.uint8)
            widths[i] = width * each // 8
        samples, offsets = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    start, length, back = _tokens(samples, offsets)
    image = np.repeat(np.arange(count), np.diff(np.searchsorted(start, offsets)))
    copy = np.flatnonzero(back)
    near = _distance_codes(width)
    far = np.where((back[copy] < len(near)) & (widths[image[copy]] == width), near[np.minimum(back[copy], len(near) - 1)], back[copy] + 120)
    size, size_extra, size_bits = _split_values(length[copy])
    dist, dist_extra, dist_bits = _split_values(far)
    symbol = samples[start].astype(np.int64)
    symbol[copy] = 256 + size
    green = np.bincount(image * 280 + symbol, minlength=280 * count).reshape(count, 280)
    reach = np.bincount(image[copy] * 40 + dist, minlength=40 * count).reshape(count, 40)
    extra = np.bincount(image[copy], size_bits + dist_bits, count)
    # what each image takes with the fixed codes and with its own
    few_codes, all_codes = shared_code(False), shared_code(True)
    literal = counts @ few_codes.green_bits[:256] + few_codes.bits
    referring = green @ all_codes.green_bits + reach @ all_codes.far_bits + extra + all_codes.bits
    own = _entropy(green) * 1.02 + _entropy(reach) + extra + 160 + 5 * (green > 0).sum(1) + 5 * (reach > 0).sum(1)
    form = np.where((mode > 0) | few | (own < 0.75 * np.minimum(literal, referring)), 2, np.where(literal <= referring, 0, 1))
    out: list[bytes] = [b""] * count

    def write(which, token_image, parts, heads):
        for i, body in zip(which.tolist(), _written(token_image, parts, heads), strict=True):
            out[i] = dims[i].to_bytes(5, "little") + body

    which = np.flatnonzero(form == 0)
    if len(which):  # these have their samples as they are
        value = samples[np.repeat(form == 0, np.diff(offsets))]
        write(which, np.repeat(np.arange(len(which)), np.diff(offsets)[which]), [(few_codes.green[value], few_codes.green_bits[value])], [(few_codes.head, few_codes.bits)] * len(which))
    for kind in (1, 2):
        which = np.flatnonzero(form == kind)
        if not len(which):
            continue
        number = np.zeros(count, np.int64)
        number[which] = np.arange(len(which))
        here = form[image] == kind
        s, k = symbol[here], number[image[here]]
        at = np.flatnonzero(here[copy])
        place = np.searchsorted(np.flatnonzero(here), copy[at])
        if kind == 1:
            heads = [(all_codes.head, all_codes.bits)] * len(which)
            codes_ = [all_codes.green[s], all_codes.green_bits[s], all_codes.far[dist[at]], all_codes.far_bits[dist[at]]]
        else:
            heads, own_codes = [], [np.zeros((len(which), m), np.int64) for m in (280, 280, 40, 40)]
            for j, i in enumerate(which.tolist()):
                w = Writer()
                if mode[i]:
                    for x, bits in ((1, 1), (PREDICTOR, 2), (7, 3), (0, 1)):  # one tile of 512 by 512 pixels
                        w.write(x, bits)
                    for only in (int(mode[i]), 0, 0, 255, 0):
                        _one(w, only)
                if i in tables:
                    w.write(1, 1)
                    w.write(PALETTE, 2)
                    w.write(len(tables[i]) - 1, 8)
                    colours = np.zeros((1, len(tables[i]), 4), np.int32)
                    colours[..., 2] = np.diff(tables[i], prepend=0)
                    colours[0, 0, 0] = 255
                    write_image(w, _pixels(colours), len(tables[i]), False)
                _own_codes(w, 0 if mode[i] else 255, green[i], reach[i], [c[j] for c in own_codes])  # alpha has no residual
                heads.append((w.bytes(), w.at))
            codes_ = [own_codes[0][k, s], own_codes[1][k, s], own_codes[2][k[place], dist[at]], own_codes[3][k[place], dist[at]]]
        tail, tail_bits = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        tail[place] = size_extra[at] | codes_[2] << size_bits[at] | dist_extra[at] << (size_bits[at] + codes_[3])
        tail_bits[place] = size_bits[at] + codes_[3] + dist_bits[at]
        write(which, k, [(codes_[0], codes_[1]), (tail, tail_bits)], heads)
    return out


@dataclass
class Lane:
    """An image whose green samples alone take bits: where they begin, the codes of samples and distances, and what the other channels hold."""

    width: int
    height: int
    first: int
    green: Prefix
    far: Prefix
    rest: tuple[int, int, int]
    undo: list


def _lane(stream: bytes) -> Lane | None:
    """The head of a stream; None if its samples can't be read in a lane."""
    bits = Bits(stream)
    width, height, undo = _head(bits)
    if bits.read(2):  # a colour cache, or groups of codes
        return None
    green, red, blue, alpha, far = (read_prefix(bits, n) for n in (280, 256, 256, 256, 40))
    if None in (red.only, blue.only, alpha.only):
        return None
    return Lane(width, height, bits.at, green, far, (alpha.only, red.only, blue.only), undo)


#: What a prefix of a length or distance stands for without its extra bits, and their number.
_EXTRA = np.array([max(0, (k - 2) >> 1) if k >= 4 else 0 for k in range(40)])
_LEAST = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)])
_MASK = (np.int64(1) << _EXTRA) - 1


@lru_cache(maxsize=2)
def _shared_lane(copies: bool) -> tuple[bytes, int, Lane]:
    """What a stream under a shared code holds behind its size: whole bytes, the bits of the next one, and how to read on."""
    code = shared_code(copies)
    whole, left = divmod(code.bits, 8)
    return code.head[:whole], left, _lane((0x2F).to_bytes(5, "little") + code.head)


def _known_lane(stream: bytes) -> Lane | None:
    """The lane of a stream under one of the shared codes, without reading them again."""
    for copies in (False, True):
        head, left, lane = _shared_lane(copies)
        end = 5 + len(head)
        if stream[5:end] == head and stream[:1] == b"/" and len(stream) > end and not (stream[end] ^ shared_code(copies).head[-1]) & ((1 << left) - 1) and not stream[4] >> 5:
            size = int.from_bytes(stream[1:5], "little")
            return replace(lane, width=(size & 0x3FFF) + 1, height=((size >> 14) & 0x3FFF) + 1)
    return None


def _values(prefix: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of prefixes whose extra bits stand at ``at``, and the places behind them."""
    return _LEAST[prefix] + ((word[at >> 3] >> (at & 7)) & _MASK[prefix]), at + _EXTRA[prefix]


def _read_lanes(streams: list[bytes], lanes: list[Lane]) -> list[np.ndarray]:
    """Green samples of each lane, before its transforms are undone."""
    tables: dict[int, tuple[int, int]] = {}
    symbols, lengths, used = [], [], 0
    for code in (c for lane in lanes for c in (lane.green, lane.far)):
        if id(code) not in tables:
            symbols.append(np.array([code.only], np.int16) if code.only is not None else code.symbol)
            lengths.append(np.zeros(1, np.int8) if code.only is not None else code.length)
            tables[id(code)] = used, len(symbols[-1]) - 1
            used += len(symbols[-1])
    symbol, length = np.concatenate(symbols).astype(np.int64), np.concatenate(lengths).astype(np.int64)
    green, green_mask = np.array([tables[id(lane.green)] for lane in lanes], np.int64).T
    far, far_mask = np.array([tables[id(lane.far)] for lane in lanes], np.int64).T
    near = np.array([[0, *(max(1, x + y * w) for x, y in NEAR)] for w in sorted({lane.width for lane in lanes})], np.int64)
    wide = np.searchsorted(sorted({lane.width for lane in lanes}), [lane.width for lane in lanes])
    start = np.cumsum([0, *(len(s) + 8 for s in streams)])
    raw = np.frombuffer(b"".join(s + bytes(8) for s in streams), np.uint8).astype(np.int64)
    word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    where = np.cumsum([0, *(lane.width * lane.height for lane in lanes)])
    out = np.zeros(where[-1], np.uint8)
    at, end = 8 * start[:-1] + [lane.first for lane in lanes], 8 * (start[1:] - 8)
    put, stop, base = where[:-1].copy(), where[1:], where[:-1]
    live = np.flatnonzero(put < stop)
    copies = []
    while len(live):
        p, o = at[live], put[live]
        i = green[live] + ((word[p >> 3] >> (p & 7)) & green_mask[live])
        s = symbol[i]
        p += length[i]
        out[o] = s  # of copies, for now, anything
        o += 1
        m = np.flatnonzero(s >= 256)
        if len(m):
            own = live[m]
            n, q = _values(s[m] - 256, word, p[m])
            i = far[own] + ((word[q >> 3] >> (q & 7)) & far_mask[own])
            code, q = _values(symbol[i], word, q + length[i])
            back = np.where(code > 120, code - 120, near[wide[own], np.minimum(code, 120)])
            first = o[m] - 1
            if (first - back < base[own]).any() or (first + n > stop[own]).any():
                raise ValueError("back-reference leaves the image")
            copies.append((first, n, back))
            p[m], o[m] = q, first + n
        if (p > end[live]).any():
            raise ValueError("image data ends early")
        at[live], put[live] = p, o
        live = live[o < stop[live]]
    if copies:
        first, n, back = (np.concatenate(c) for c in zip(*copies, strict=True))
        ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places = (np.repeat(first, n) + ramp).astype(np.int32)
        source = np.arange(len(out), dtype=np.int32)
        source[places] -= np.repeat(back, n).astype(np.int32)
        todo = places
        while len(todo):  # a copy of a copy: each round doubles how far back a place looks
            now = source[todo]
            further = source[now]
            source[todo] = further
            todo = todo[further != now]
        out[places] = out[source[places]]
    return [out[a:b] for a, b in zip(where[:-1], where[1:], strict=True)]


def decode_texts(streams: list[bytes]) -> list[np.ndarray]:
    """Green samples of each stream as one row; lanes are read in step, other files one by one."""
    out: list[np.ndarray | None] = [None] * len(streams)
    own, lanes = [], []
    for i, s in enumerate(streams):
        lane = _known_lane(s) or _lane(s)
        if lane is None:
            out[i] = np.ascontiguousarray(decode(s)[..., 2]).ravel()
        else:
            own.append(i)
            lanes.append(lane)
    if lanes:
        for i, lane, samples in zip(own, lanes, _read_lanes([streams[i] for i in own], lanes), strict=True):
            if lane.undo:
                x = np.empty((lane.height, lane.width, 4), np.int32)
                x[..., 0], x[..., 1], x[..., 3] = lane.rest
                x[..., 2] = samples.reshape(lane.height, lane.width)
                samples = np.ascontiguousarray(_undone(x, lane.undo)[..., 2]).ravel()
            out[i] = samples
    return out
