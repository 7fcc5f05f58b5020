"""Lossless WebP pictures of 8-bit RGBA samples: the whole stream format read, and its features written.

A picture is an array (height, width, 4). The streams of many small pictures are coded together and decoded in step, one
symbol of each at a time, with back-references, colour caches and transforms; streams with several groups of codes or
codes over LONGEST bits go through the general decoder.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from .common import offsets, ranges

# Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_CODES, DISTANCE_CODES = 24, 40
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = np.array([0, 0, 0, 255], np.int64)

#: Written code lengths: of these symbols the first 13 take 4 bits and the others 5, which fills the code.
LENGTH_SYMBOLS = [4] * 11 + [5] * 6 + [4, 4]
#: The longest code that is written, so that a pixel's four symbols fit in one 64-bit load.
LONGEST = 12
WIDTH = 16
TILE_ROWS = 64
CACHE_BITS = 6
#: The shortest copy that is written, and the pixels that must be alike for it to be found.
LEAST_COPY, ALIKE = 2, 3


def near_pixels() -> list[tuple[int, int]]:
    """The (x, y) back-distances that short distance codes stand for: nearest first, then less far aside, left before right."""
    places = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


NEAR = near_pixels()
REVERSED = np.array([int(f"{x:015b}"[::-1], 2) for x in range(1 << 15)])


class Bits:
    """Bits read from the low end of each byte."""

    def __init__(self, data: bytes):
        self.at, self.end = 0, 8 * len(data)
        self.data = data + bytes(8)

    def read(self, n: int) -> int:
        a = self.at >> 3
        out = int.from_bytes(self.data[a : a + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end + 64:
            raise ValueError("the stream ends too early")
        return out


    def peek(self, at: int, n: int) -> int:
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Prefix code lengths for symbol counts, none over `longest`; a lone symbol gets length 1."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    weights = counts[used]
    while n > 1:
        order = np.argsort(weights, kind="stable")
        leaves, inner = [*weights[order].tolist(), float("inf")], [float("inf")] * n
        above = [0] * (2 * n - 1)
        i = j = 0
        for k in range(n - 1):  # the two lightest of the sorted leaves and of the inner nodes, which come in order too
            total = 0
            for _ in range(2):
                if leaves[i] <= inner[j]:
                    total += leaves[i]
                    above[i] = n + k
                    i += 1
                else:
                    total += inner[j]
                    above[n + j] = n + k
                    j += 1
            inner[k] = total
        deep = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            deep[k] = deep[above[k]] + 1
        if max(deep[:n]) <= longest:
            out[used[order]] = deep[:n]
            return out
        weights = weights // 2 + 1
    out[used] = 1
    return out


def in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The used symbols by length and value, and their lengths."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    return used, lengths[used]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol with its first bit lowest, as the stream holds it."""
    codes = np.zeros(len(lengths), np.int64)
    symbols, own = in_order(lengths)
    codes[symbols] = REVERSED[offsets(1 << (15 - own))[:-1]]
    return codes


def put_code(out: Writer, lengths: np.ndarray) -> None:
    """A prefix code's description."""
    used = np.flatnonzero(lengths).tolist()
    if not used or (len(used) == 1 and used[0] < 256):
        symbol = used[0] if used else 0
        out.put(1, 1)
        out.put(0, 1)
        out.put(symbol > 1, 1)
        out.put(symbol, 8 if symbol > 1 else 1)
        return
    out.put(LENGTH_TEXT << 5 | 15 << 1, 62)
    size = max(used[-1] + 1, 2)
    bits = max(2, (size - 2).bit_length() + (size - 2).bit_length() % 2)
    out.put(1, 1)
    out.put((bits - 2) // 2, 3)
    # the count is of symbols written, runs of zeros being one each
    value = place = count = 0
    at, values = 0, lengths.tolist()
    for symbol in used:
        while at < symbol:
            run = min(symbol - at, 138)
            zeros, extra, n = (18, run - 11, 7) if run > 10 else (17, run - 3, 3) if run > 2 else (0, 0, 0)
            value |= (LENGTH_CODE[zeros] | extra << LENGTH_SYMBOLS[zeros]) << place
            place += LENGTH_SYMBOLS[zeros] + n
            count += 1
            at += run if zeros else 1
        own = values[symbol]
        value |= LENGTH_CODE[own] << place
        place += LENGTH_SYMBOLS[own]
        count += 1
        at += 1
    while count < 2:
        value |= LENGTH_CODE[0] << place
        place += LENGTH_SYMBOLS[0]
        count += 1
    out.put(count - 2, bits)
    out.put(value, place)


LENGTH_TEXT = sum(LENGTH_SYMBOLS[symbol] << 3 * k for k, symbol in enumerate(CODE_LENGTH_ORDER))
LENGTH_CODE = canonical(np.array(LENGTH_SYMBOLS)).tolist()


class Code:
    """A prefix code read from a stream; its table is made when it is first used."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.lengths = lengths
        self.only = int(used[0]) if len(used) == 1 else None
        self.longest = int(lengths.max()) if self.only is None and len(used) else 0
        self.next: list[int] | None = None
        if self.only is None and (not len(used) or (1 << 15 >> lengths[used]).sum() != 1 << 15):
            raise ValueError("a prefix code isn't complete")

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.next is None:
            self.next = self.table(self.longest).tolist()
        at = bits.at
        found = self.next[bits.read(self.longest)]
        bits.at = at + (found >> 16)
        return found & 0xFFFF

    def table(self, wide: int) -> np.ndarray:
        """For each possible run of the next `wide` bits the symbol, and from bit 16 its length."""
        out = np.zeros(1 << wide, np.int32)
        if self.only is not None:
            out[:] = self.only
            return out
        symbols, own = in_order(self.lengths)
        return np.repeat(symbols | own << 16, 1 << (wide - own)).astype(np.int32)[REVERSED[: 1 << wide] >> (15 - wide)]


@lru_cache(100)
def length_table(n: int, text: int) -> tuple[list[int], int]:
    """The table of the n code lengths' code described by `text`, and a mask of its longest code."""
    own = np.zeros(19, np.int64)
    own[CODE_LENGTH_ORDER[:n]] = [text >> 3 * k & 7 for k in range(n)]
    code = Code(own)
    return code.table(code.longest).tolist(), (1 << code.longest) - 1


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    n = 4 + bits.read(4)
    found, low = length_table(n, bits.peek(bits.at, 3 * n))
    bits.read(3 * n)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    data, at, last = bits.data, bits.at, 8
    values: list[int] = []
    while len(values) < size and left:
        left -= 1
        window = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        one = found[window & low]
        symbol, n = one & 0xFFFF, one >> 16
        at += n
        if symbol < 16:
            values.append(symbol)
            last = symbol or last
        else:
            base, more = {16: (3, 2), 17: (3, 3), 18: (11, 7)}[symbol]
            values += [last if symbol == 16 else 0] * (base + (window >> n & ((1 << more) - 1)))
            at += more
    bits.at = at
    bits.read(0)  # tells of an early end
    lengths[: len(values)] = values[:size]
    return Code(lengths)


def prefix_value(symbol: int, bits: Bits) -> int:
    """The length or distance code of a prefix symbol and its extra bits."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def prefix_symbol(value: int) -> tuple[int, int, int]:
    """The inverse: symbol, extra bits, and their number."""
    value -= 1
    if value < 4:
        return value, 0, 0
    n = value.bit_length() - 2
    return 2 * n + 2 + (value >> n & 1), value & ((1 << n) - 1), n


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded picture as rows (r, g, b, a)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tile, which = 1, 0, None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        which = read_pixels(bits, across, -(-height >> tile), False)
        which = (which[:, 0] << 8 | which[:, 1]).reshape(-1, across)
        groups = int(which.max()) + 1
    sizes = [256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES]
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    out = np.zeros((width * height, 4), np.int64)
    cache = np.zeros((1 << cache_bits, 4), np.int64)
    cached = 0
    k = 0

    def remember(stop: int) -> None:
        nonlocal cached
        for p in out[cached:stop].tolist():
            cache[((p[3] << 24 | p[0] << 16 | p[1] << 8 | p[2]) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        cached = stop

    while k < len(out):
        own = codes[int(which[k // width >> tile, k % width >> tile]) if which is not None else 0]
        symbol = own[0].read(bits)
        if symbol < 256:
            red, blue, alpha = own[1].read(bits), own[2].read(bits), own[3].read(bits)
            out[k] = red, symbol, blue, alpha
            k += 1
        elif symbol < 256 + LENGTH_CODES:
            length = prefix_value(symbol - 256, bits)
            far = prefix_value(own[4].read(bits), bits)
            if far <= len(NEAR):
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            else:
                far -= len(NEAR)
            for j in range(k, min(k + length, len(out))):
                out[j] = out[j - far]
            k = min(k + length, len(out))
        else:
            if cache_bits:
                remember(k)
            out[k] = cache[symbol - 256 - LENGTH_CODES]
            k += 1
    return out


def half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """One pixel's prediction from its neighbours; right is the one above and to the right."""
    if mode < 5:
        return (BLACK, left, top, right, corner)[mode]
    if mode == 11:
        by_left, by_top = np.abs(top - corner).sum(), np.abs(left - corner).sum()
        return left if by_left < by_top else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        difference = mean - corner
        return np.clip(mean + np.sign(difference) * (np.abs(difference) >> 1), 0, 255)
    return {
        5: lambda: half(half(left, right), top),
        6: lambda: half(left, corner),
        7: lambda: half(left, top),
        8: lambda: half(corner, top),
        9: lambda: half(top, right),
        10: lambda: half(half(left, corner), half(top, right)),
    }.get(mode, lambda: BLACK)()


def predictions(pixels: np.ndarray, width: int, mode_of: np.ndarray, tile: int, residual: np.ndarray | None) -> np.ndarray:
    """Predictions of all pixels; where residuals are given, pixels are first restored from them, in order."""
    out = np.zeros_like(pixels)
    for k in range(len(pixels)):
        x, y = k % width, k // width
        if not k:
            guess = BLACK
        elif not y:
            guess = pixels[k - 1]
        elif not x:
            guess = pixels[k - width]
        else:
            guess = predicted(int(mode_of[y >> tile, x >> tile]), pixels[k - 1], pixels[k - width], pixels[k - width + 1], pixels[k - width - 1])
        out[k] = guess
        if residual is not None:
            pixels[k] = (residual[k] + guess) & 255
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) & 255 ^ 128) - 128


def cross_colour(pixels: np.ndarray, width: int, elements: np.ndarray, tile: int, sign: int) -> np.ndarray:
    """Adds (1) or takes away (-1) what a block's element says of red and blue. elements: (rows, columns, 4)."""
    k = np.arange(len(pixels))
    element = elements[k // width >> tile, k % width >> tile]
    out = pixels.copy()
    green = signed(pixels[:, 1])
    delta = lambda t, c: (signed(t) * c) >> 5
    out[:, 0] = (pixels[:, 0] + sign * delta(element[:, 2], green)) & 255
    red = signed(out[:, 0] if sign > 0 else pixels[:, 0])
    out[:, 2] = (pixels[:, 2] + sign * (delta(element[:, 1], green) + delta(element[:, 0], red))) & 255
    return out


def restored(residual: np.ndarray, width: int, mode_of: np.ndarray, tile: int) -> np.ndarray:
    """Pixels from their residuals; by sums where all are predicted from the left or all from above."""
    if mode_of.min() == mode_of.max() and mode_of.flat[0] in (1, 2):
        grid = residual.reshape(-1, width, 4).astype(np.int64)
        grid[0, 0] += BLACK
        if mode_of.flat[0] == 1:
            grid[:, 0] = grid[:, 0].cumsum(0)
            return (grid.cumsum(1) & 255).reshape(-1, 4)
        grid[0] = grid[0].cumsum(0)
        return (grid.cumsum(0) & 255).reshape(-1, 4)
    pixels = np.zeros_like(residual)
    predictions(pixels, width, mode_of, tile, residual)
    return pixels


def opening(bits: Bits) -> tuple[int, int, list[tuple], int]:
    """Width, height, transforms (kind, width, tile or shift, data), and the width of the picture that is coded."""
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    full, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            across = -(-width >> tile)
            undo.append((kind, width, tile, read_pixels(bits, across, -(-height >> tile), False).reshape(-1, across, 4)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, width, 0, None))
        else:
            size = bits.read(8) + 1
            table = np.cumsum(read_pixels(bits, size, 1, False), axis=0) & 255
            shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, width, shift, table))
            width = -(-width >> shift)
    return full, height, undo, width


def undone(pixels: np.ndarray, height: int, undo: list[tuple]) -> np.ndarray:
    """Rows (r, g, b, a) of the picture from those that were coded."""
    for kind, wide, tile, what in reversed(undo):
        if kind == PREDICTOR:
            pixels = restored(pixels, wide, what[:, :, 1] & 15, tile)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, wide, what, tile, 1)
        elif kind == SUBTRACT_GREEN:
            pixels[:, 0], pixels[:, 2] = (pixels[:, 0] + pixels[:, 1]) & 255, (pixels[:, 2] + pixels[:, 1]) & 255
        else:
            packed = pixels[:, 1].reshape(height, -1)
            x = np.arange(wide)
            each = 8 >> tile
            index = packed[:, x >> tile] >> ((x & ((1 << tile) - 1)) * each) & ((1 << each) - 1)
            table = np.zeros((256, 4), np.int64)
            table[: len(what)] = what
            pixels = table[index].reshape(-1, 4)
    return pixels


def decode_stream(data: bytes) -> np.ndarray:
    """Any lossless stream as an array (height, width, 4)."""
    bits = Bits(data)
    full, height, undo, width = opening(bits)
    pixels = undone(read_pixels(bits, width, height, True), height, undo)
    return pixels.reshape(height, full, 4).astype(np.uint8)


def put_pixels(out: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = False) -> None:
    """An entropy-coded picture, with one group of prefix codes."""
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    rows = [tuple(p) for p in pixels.tolist()]
    items: list[list[tuple[int, int, int, int]]] = []  # (code, symbol, extra, bits)
    cache: dict[int, tuple] = {}
    seen: dict[tuple, int] = {}
    near = {max(1, x + y * width): n + 1 for n, (x, y) in reversed(list(enumerate(NEAR)))}
    k = 0
    while k < len(rows):
        start, length = seen.get(tuple(rows[k : k + 3]), -1) if copies else -1, 0
        while start >= 0 and k + length < len(rows) and rows[start + length] == rows[k + length] and length < 4096:
            length += 1
        r, g, b, a = rows[k]
        key = ((a << 24 | r << 16 | g << 8 | b) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 3:
            symbol, extra, n = prefix_symbol(length)
            far, far_extra, m = prefix_symbol(near.get(k - start, k - start + len(NEAR)))
            items.append([(0, 256 + symbol, extra, n), (4, far, far_extra, m)])
        elif cache_bits and cache.get(key) == rows[k]:
            items.append([(0, 256 + LENGTH_CODES + key, 0, 0)])
            length = 1
        else:
            items.append([(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)])
            length = 1
        for j in range(k, k + length):
            seen[tuple(rows[j : j + 3])] = j
            if cache_bits:
                r, g, b, a = rows[j]
                cache[((a << 24 | r << 16 | g << 8 | b) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = rows[j]
        k += length
    sizes = [256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES]
    counts = [np.zeros(n, np.int64) for n in sizes]
    for item in items:
        for code, symbol, _, _ in item:
            counts[code][symbol] += 1
    lengths = [code_lengths(c) for c in counts]
    for n in lengths:
        put_code(out, n)
    codes = [canonical(n) for n in lengths]
    for item in items:
        for code, symbol, extra, n in item:
            if np.count_nonzero(lengths[code]) > 1 or symbol >= 256 and np.count_nonzero(lengths[code]) > 1:
                out.put(int(codes[code][symbol]), int(lengths[code][symbol]))
            out.put(extra, n)


def encode_stream(picture: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, copies: bool = False, tile: int = 3) -> bytes:
    """A lossless stream with any of the format's features. predictor: the mode of all tiles; cross: red to blue, green to blue, green to red."""
    height, width = picture.shape[:2]
    pixels = picture.reshape(-1, 4).astype(np.int64)
    out = Writer()
    out.put(SIGNATURE, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    if palette:
        table, index = np.unique(pixels, axis=0, return_inverse=True)
        size = len(table)
        if size > 256:
            raise ValueError("a palette has 256 colours at most")
        shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(size - 1, 8)
        put_pixels(out, np.diff(table, axis=0, prepend=0) & 255, size, False)
        narrow = -(-width >> shift)
        each = np.zeros((height, narrow << shift), np.int64)
        each[:, :width] = index.reshape(height, width)
        packed = sum(each[:, k :: 1 << shift] << (k * (8 >> shift)) for k in range(1 << shift))
        pixels = np.zeros((height * narrow, 4), np.int64)
        pixels[:, 1], pixels[:, 3] = packed.ravel(), 255
        width = narrow
    across, down = -(-width >> tile), -(-height >> tile)
    if predictor is not None:
        modes = np.full((down, across), predictor)
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(tile - 2, 3)
        element = np.zeros((down * across, 4), np.int64)
        element[:, 1], element[:, 3] = predictor, 255
        put_pixels(out, element, across, False)
        pixels = (pixels - predictions(pixels, width, modes, tile, None)) & 255
    if cross is not None:
        out.put(1, 1)
        out.put(CROSS_COLOUR, 2)
        out.put(tile - 2, 3)
        element = np.tile(np.array([*cross, 255]), (down * across, 1)) & 255
        put_pixels(out, element, across, False)
        pixels = cross_colour(pixels, width, element.reshape(down, across, 4), tile, -1)
    if green:
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
        pixels = pixels.copy()
        pixels[:, 0], pixels[:, 2] = (pixels[:, 0] - pixels[:, 1]) & 255, (pixels[:, 2] - pixels[:, 1]) & 255
    out.put(0, 1)
    put_pixels(out, pixels, width, True, cache_bits, copies)
    return out.bytes()


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)


def container(tiles: Sequence[bytes], width: int, heights: Sequence[int]) -> bytes:
    """One picture as a plain file, or several as frames that stand below each other on one canvas."""
    if len(tiles) == 1:
        return b"RIFF" + struct.pack("<I", 4 + 8 + len(tiles[0]) + (len(tiles[0]) & 1)) + b"WEBP" + chunk(b"VP8L", tiles[0])
    three = lambda x: struct.pack("<I", x)[:3]
    parts, y = [b"WEBP", chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + three(width - 1) + three(sum(heights) - 1)), chunk(b"ANIM", bytes(6))], 0
    for tile, rows in zip(tiles, heights, strict=True):
        parts.append(chunk(b"ANMF", three(0) + three(y // 2) + three(width - 1) + three(rows - 1) + three(0) + b"\2" + chunk(b"VP8L", tile)))
        y += rows
    body = b"".join(parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def streams(data: bytes) -> list[bytes]:
    """The lossless streams in a file, in the order of its frames."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at = [], 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            out.append(data[at + 8 : at + 8 + size])
        at += 8 + (16 if name == b"ANMF" else size + (size & 1))
    return out


def decode(data: bytes) -> np.ndarray:
    """The picture of a file; frames are put below each other."""
    return np.concatenate([decode_stream(x) for x in streams(data)])


def transform_text(kind: int, element: Sequence[int] = ()) -> tuple[int, int]:
    """A transform's description, as value and size; elements hold for a whole tile."""
    out = Writer()
    out.put(1, 1)
    out.put(kind, 2)
    if element:
        out.put(7, 3)
        put_pixels(out, np.array([element]), 1, False)
    return out.value, out.size


#: What a document's pixels may be changed by: nothing, less green, less the left, less the upper pixel, blue less red.
TRANSFORMS = [(0, 0), transform_text(SUBTRACT_GREEN), transform_text(PREDICTOR, (0, 1, 0, 255)), transform_text(PREDICTOR, (0, 2, 0, 255)), transform_text(CROSS_COLOUR, (32, 0, 0, 255))]


def changed(data: np.ndarray, inside: np.ndarray, which: int) -> np.ndarray:
    """Pixels (n, 4) of 8 bits under a transform; inside: each one's place in its tile."""
    if not which:
        return data
    if which in (2, 3):
        k = np.arange(len(data))
        guess = data[k - np.where((inside < WIDTH) if which == 3 else (inside % WIDTH > 0), 1, np.minimum(inside, WIDTH))]
        guess[inside == 0] = BLACK
        return data - guess
    out = data.copy()
    if which == 1:
        out[:, 0] -= data[:, 1]
        out[:, 2] -= data[:, 1]
    else:
        out[:, 2] -= data[:, 0]
    return out


def coded_bits(counts: np.ndarray, described: int) -> np.ndarray:
    """About the bits that each row's symbols take, with `described` bits for a used symbol's code."""
    total = counts.sum(1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(1) + described * np.count_nonzero(counts, axis=1)


def prefix_symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """prefix_symbol of many values."""
    v = np.asarray(values, np.int64) - 1
    n = np.maximum(np.frexp(v)[1].astype(np.int64) - 2, 0)
    return np.where(v < 4, v, 2 * n + 2 + (v >> n & 1)), np.where(v < 4, 0, v & ((1 << n) - 1)), np.where(v < 4, 0, n)


def argb(pixels: np.ndarray) -> np.ndarray:
    """Samples r, g, b, a as one number of 32 bits each, turned to the order that is hashed."""
    return pixels & np.uint32(0xFF00FF00) | (pixels & np.uint32(255)) << np.uint32(16) | pixels >> np.uint32(16) & np.uint32(255)


def find_copies(pixels: np.ndarray, tile_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of copies within tiles, which don't overlap."""
    n = len(pixels) - ALIKE + 1
    wide = pixels.astype(np.uint64)
    key = tile_of[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        key += (wide[j : n + j] ^ wide[j : n + j] >> np.uint64(15)) * np.uint64(factor)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    here, before = order[again + 1], order[again]
    good = (tile_of[here] == tile_of[before]) & (tile_of[here + ALIKE - 1] == tile_of[here])
    for j in range(ALIKE):
        good &= pixels[here + j] == pixels[before + j]
    far = np.zeros(n + 1, np.int64)
    far[here[good]] = (here - before)[good]
    edges = np.flatnonzero(np.diff(far, prepend=0))
    start = edges[far[edges] > 0]
    end = edges[np.searchsorted(edges, start, side="right")] + ALIKE - 1  # far ends with 0
    begin = np.maximum(start, np.concatenate([[0], end[:-1]]))
    kept = end - begin >= LEAST_COPY
    return begin[kept], (end - begin)[kept], far[start][kept]


def find_cached(pixels: np.ndarray, tile_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in a colour cache, and whether it lies there when it comes."""
    place = (argb(pixels) * np.uint32(CACHE_FACTOR) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    slot = tile_of << CACHE_BITS | place
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return place, hit


def write_payloads(payloads: Sequence[bytes]) -> list[bytes]:
    """A file for each payload (bytes, a multiple of 64), 16 pixels wide, in tiles of at most 64 rows that share their codes.

    Each payload is coded with the transform and with copies, a colour cache, both or neither as takes the fewest bits by
    its counts; tiles of few colours are tried as palettes too.
    """
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads], np.int64) // 4  # in pixels
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 4)
    docs, at = len(payloads), offsets(sizes)
    tiles = -(-sizes // (WIDTH * TILE_ROWS))
    doc = np.repeat(np.arange(docs), tiles)
    begin = at[doc] + (np.arange(len(doc)) - offsets(tiles)[doc]) * WIDTH * TILE_ROWS
    size = np.minimum(WIDTH * TILE_ROWS, at[doc + 1] - begin)
    tile_of = np.repeat(np.arange(len(doc)), size)
    inside = np.arange(len(data)) - begin[tile_of]
    doc_of = doc[tile_of]
    main = 256 + LENGTH_CODES + (1 << CACHE_BITS)

    def literal_bits(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        lines = lines << 8
        counts = sum(np.bincount(lines | x[:, c], minlength=docs << 8) for c in (0, 2, 3))
        return coded_bits(counts.reshape(docs, 256), 12)

    options = []
    for k, (_, extra) in enumerate(TRANSFORMS):
        x = changed(data, inside, k)
        options.append(literal_bits(x, doc_of) + coded_bits(np.bincount(doc_of << 8 | x[:, 1], minlength=docs << 8).reshape(docs, 256), 4) + extra)
    transform = np.argmin(options, axis=0)
    coded = data.copy()
    for k in range(1, len(TRANSFORMS)):
        mine = np.flatnonzero(transform[doc_of] == k)
        if len(mine):
            # whole documents, so each pixel's neighbours stay where they were
            coded[mine] = changed(data[mine], inside[mine], k)
    pixels = coded.view("<u4").ravel()

    start, length, far = find_copies(pixels, tile_of)
    near = np.arange(WIDTH * TILE_ROWS + 1) + len(NEAR)
    for n, (x, y) in reversed(list(enumerate(NEAR))):
        if max(1, x + y * WIDTH) < len(near):
            near[max(1, x + y * WIDTH)] = n + 1
    length_symbol, length_extra, length_bits = prefix_symbols(length)
    far_symbol, far_extra, far_bits = prefix_symbols(near[far])
    place, hit = find_cached(pixels, tile_of)
    copy_at = np.full(len(pixels), -1)
    copy_at[start] = np.arange(len(start))
    covered = np.zeros(len(pixels), bool)
    covered[ranges(start, length)] = True
    copied = np.bincount(doc_of[start], length_bits + far_bits, docs) + coded_bits(np.bincount(doc_of[start] * DISTANCE_CODES + far_symbol, minlength=docs * DISTANCE_CODES).reshape(docs, -1), 4)
    best, with_copies, with_cache = np.full(docs, np.inf), np.zeros(docs, bool), np.zeros(docs, bool)

    def tokens(copies: np.ndarray | bool, cache: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray]:
        """Pixels at which symbols stand, and the symbols."""
        c = covered & copies
        stand = np.flatnonzero(~c | (copy_at >= 0) & copies)
        symbol = np.where((hit & cache)[stand], 256 + LENGTH_CODES + place[stand], coded[stand, 1])
        isa = np.flatnonzero(c[stand])
        symbol[isa] = 256 + length_symbol[copy_at[stand[isa]]]
        return stand, symbol

    for copies in (False, True):
        for cache in (False, True):
            stand, symbol = tokens(copies, cache)
            literal = stand[symbol < 256]
            cost = coded_bits(np.bincount(doc_of[stand] * main + symbol, minlength=docs * main).reshape(docs, main), 4)
            cost += literal_bits(coded[literal], doc_of[literal]) + copied * copies
            better = cost < best
            best[better], with_copies[better], with_cache[better] = cost[better], copies, cache
    stand, symbol = tokens(with_copies[doc_of], with_cache[doc_of])
    own_doc = doc_of[stand]
    literal, copy = np.flatnonzero(symbol < 256), np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTH_CODES))
    which = copy_at[stand[copy]]

    # counts, codes and their descriptions: green and the rest of a symbol, other channels, distances
    alphabets = [main, 256, DISTANCE_CODES]
    where = [(own_doc, symbol), (np.repeat(own_doc[literal], 3), coded[stand[literal]][:, [0, 2, 3]].ravel()), (own_doc[copy], far_symbol[which])]
    counts = [np.bincount(d * n + x, minlength=docs * n).reshape(docs, n) for n, (d, x) in zip(alphabets, where, strict=True)]
    codes = [np.zeros((docs, n), np.int64) for n in alphabets]  # from bit 16 their lengths
    code_text = []
    for k in range(docs):
        own = Writer()
        value, bits = TRANSFORMS[transform[k]]
        own.put(value, bits)
        own.put(0, 1)
        own.put(1 | CACHE_BITS << 1 if with_cache[k] else 0, 5 if with_cache[k] else 1)
        own.put(0, 1)  # one group of codes
        texts = []
        for c in range(3):
            n = code_lengths(counts[c][k])
            text = Writer()
            put_code(text, n if c or with_cache[k] else n[: 256 + LENGTH_CODES])
            texts.append(text)
            if np.count_nonzero(n) > 1:
                codes[c][k] = canonical(n) | n << 16
        for c in (0, 1, 1, 1, 2):
            own.put(texts[c].value, texts[c].size)
        code_text.append(own)
    heads = []
    for k, n in zip(doc.tolist(), size.tolist(), strict=True):
        head = Writer()
        head.put(SIGNATURE | (WIDTH - 1) << 8 | (n // WIDTH - 1) << 22 | 1 << 36, 40)
        head.put(code_text[k].value, code_text[k].size)
        heads.append(head)
    # four fields a symbol: green, red, blue, alpha; or length, its bits, distance, its bits; or a cached colour alone
    field = np.zeros((len(stand), 4), np.int64)
    field[:, 0] = codes[0].ravel()[own_doc * main + symbol]
    field[literal, 1:] = codes[1].ravel()[where[1][0] << 8 | where[1][1]].reshape(-1, 3)
    field[copy, 1] = length_extra[which] | length_bits[which] << 16
    field[copy, 2] = codes[2].ravel()[own_doc[copy] * DISTANCE_CODES + far_symbol[which]]
    field[copy, 3] = far_extra[which] | far_bits[which] << 16
    field = field.ravel()
    value, bits = (field & 0xFFFF).astype(np.uint64), field >> 16
    run = offsets(bits)
    edges = 4 * offsets(np.bincount(tile_of[stand], minlength=len(doc)))
    head_bits = np.array([h.size for h in heads], np.int64)
    total = head_bits + run[edges[1:]] - run[edges[:-1]]
    base = offsets((total + 31) // 32 + 2)  # in words
    spot = run[:-1] + np.repeat(32 * base[:-1] + head_bits - run[edges[:-1]], np.diff(edges))
    words = np.zeros(int(base[-1]) + 1, np.uint64)
    value = value << (spot & 31).astype(np.uint64)
    word = spot >> 5
    group = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[group]] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), group)
    words[word[group] + 1] += np.add.reduceat(value >> np.uint64(32), group)
    packed = words.astype("<u4").view(np.uint8)
    few = np.bincount(tile_of[stand[literal]], minlength=len(doc)) <= 24
    out: list[list[bytes]] = [[] for _ in payloads]
    for j, k in enumerate(doc.tolist()):
        a = 4 * int(base[j])
        head = heads[j].bytes()
        packed[a : a + len(head)] |= np.frombuffer(head, np.uint8)
        stream = packed[a : a + (int(total[j]) + 7) // 8].tobytes()
        if few[j]:
            tile = data[begin[j] : begin[j] + size[j]]
            colours = len(set(tile.view("<u4").ravel().tolist()))
            if colours <= 16 and 2 * colours <= size[j]:
                stream = min(stream, encode_stream(tile.reshape(-1, WIDTH, 4), palette=True, copies=True), key=len)
        out[k].append(stream)
    rows = (size // WIDTH).tolist()
    edges = offsets(tiles).tolist()
    return [container(x, WIDTH, rows[a:b]) for x, a, b in zip(out, edges, edges[1:], strict=False)]


def lane_header(bits: Bits) -> tuple | None:
    """(width, height, transforms, coded width, cache bits, five tables, bits up to the pixels); None for streams with several groups or long codes."""
    width, height, undo, narrow = opening(bits)
    cache_bits = bits.read(4) if bits.read(1) else 0
    if bits.read(1):
        return None
    codes = [read_code(bits, 256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0))]
    text, size = None, 0
    for _ in range(3):  # mostly the same description again
        if size and bits.peek(bits.at, size) == text:
            codes.append(codes[-1])
            bits.at += size
        else:
            first = bits.at
            codes.append(read_code(bits, 256))
            size = bits.at - first
            text = bits.peek(first, size)
    codes.append(read_code(bits, DISTANCE_CODES))
    if max(c.longest for c in codes) > LONGEST:
        return None
    made: dict[int, np.ndarray] = {}
    tables = [made[id(c)] if id(c) in made else made.setdefault(id(c), c.table(LONGEST)) for c in codes]
    return width, height, undo, narrow, cache_bits, tables, bits.at


def read_payloads(files: Sequence[bytes]) -> list[bytes]:
    """The samples of each file, row by row; streams with one group of codes are decoded in step."""
    owner, parts, lanes = [], [], []
    for k, data in enumerate(files):
        shared: list[tuple[int, int, tuple]] = []
        for stream in streams(data):
            owner.append(k)
            parts.append(None)
            bits = Bits(stream)
            head = int.from_bytes(stream[:5], "little")
            width, height = (head >> 8 & 0x3FFF) + 1, (head >> 22 & 0x3FFF) + 1
            # tiles of one file mostly repeat one description of transforms and codes
            for size, text, known in shared:
                fits = head & 0xFF == SIGNATURE and not head >> 37 and known[0] == width and all(t[0] not in (PREDICTOR, CROSS_COLOUR) or len(t[3]) == -(-height >> t[2]) for t in known[2])
                if fits and bits.peek(40, size) == text:
                    break
            else:
                known = lane_header(bits)
                if known is None:
                    parts[-1] = decode_stream(stream).tobytes()
                    continue
                shared.append((bits.at - 40, bits.peek(40, bits.at - 40), known))
            lanes.append((known[3] * height, len(owner) - 1, stream, known, height))
    lanes.sort(key=lambda x: -x[0])
    for (_, j, _, known, height), pixels in zip(lanes, _in_step(lanes), strict=True):
        parts[j] = undone(pixels.astype(np.int64), height, known[2]).astype(np.uint8).tobytes() if known[2] else pixels.tobytes()
    out: list[list[bytes]] = [[] for _ in files]
    for k, part in zip(owner, parts, strict=True):
        out[k].append(part)
    return [b"".join(x) for x in out]


def prefix_values(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """prefix_value of many symbols whose extra bits come lowest in `window`, and the numbers of these bits."""
    n = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << n) + (window.astype(np.int64) & ((1 << n) - 1)) + 1), n


def _in_step(lanes: list[tuple]) -> list[np.ndarray]:
    """Coded pixels (n, 4) of lanes (pixels, -, stream, header, -), the longest first."""
    if not lanes:
        return []
    counts = np.array([x[0] for x in lanes], np.int64)
    held: dict[int, int] = {}
    tables, bases = [], np.zeros((5, len(lanes)), np.int64)
    for j, lane in enumerate(lanes):
        for c, own in enumerate(lane[3][5]):
            if id(own) not in held:
                held[id(own)] = len(tables) << LONGEST
                tables.append(own)
            bases[c, j] = held[id(own)]
    table = np.concatenate(tables)
    at = offsets([len(x[2]) for x in lanes])
    raw = b"".join(x[2] for x in lanes) + bytes(16)
    eights = np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,))
    p = 8 * at[:-1] + np.array([x[3][6] for x in lanes], np.int64)
    end, width = 8 * at[1:], np.array([x[3][3] for x in lanes], np.int64)
    first = offsets(counts)[:-1]
    target, stop = first.copy(), first + counts
    start = first
    pixels = np.zeros(int(counts.sum()), "<u4")
    back = np.zeros(len(pixels), np.int32)  # a copy's distance, or less than 0: a place in the cache
    copies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    near_x, near_y = np.array(NEAR).T
    low = np.uint64((1 << LONGEST) - 1)
    while len(target):
        window = eights[p >> 3] >> (p & 7).astype(np.uint64)
        found = table[bases[0] + (window & low).astype(np.int64)]
        symbol, used = found & 0xFFFF, found >> 16
        window >>= used.astype(np.uint64)
        rest = window
        value, more = symbol.astype(np.uint32) << np.uint32(8), np.zeros_like(used)
        for c, shift in ((1, 0), (2, 16), (3, 24)):
            found = table[bases[c] + (rest & low).astype(np.int64)]
            value |= (found & 255).astype(np.uint32) << np.uint32(shift)
            found >>= 16
            more += found
            rest = rest >> found.astype(np.uint64)
        step = np.ones(len(target), np.int64)
        other = (symbol >= 256).nonzero()[0]
        if len(other):
            more[other] = 0
            own = symbol[other].astype(np.int64) - 256
            cached = own >= LENGTH_CODES
            back[target[other[cached]]] = LENGTH_CODES - 1 - own[cached]
            c, own = other[~cached], own[~cached]
            if len(c):
                w = window[c]
                length, n = prefix_values(own, w)
                w = w >> n.astype(np.uint64)
                found = table[bases[4, c] + (w & low).astype(np.int64)].astype(np.int64)
                w = w >> (found >> 16).astype(np.uint64)
                far, m = prefix_values(found & 0xFFFF, w)
                short = np.minimum(far, len(NEAR)) - 1
                far = np.where(far <= len(NEAR), np.maximum(1, near_x[short] + near_y[short] * width[c]), far - len(NEAR))
                length = np.minimum(length, stop[c] - target[c])
                if (far > target[c] - start[c]).any():
                    raise ValueError("a copy from before the picture")
                copies.append((target[c], length, far))
                more[c] = n + (found >> 16) + m
                step[c] = length
        pixels[target] = value
        p = p + used + more
        target = target + step
        if (p > end).any():
            raise ValueError("a stream ends too early")
        left = target < stop
        if not left.all():
            p, target, stop, end, start, width, bases = p[left], target[left], stop[left], end[left], start[left], width[left], bases[:, left]
    if copies:
        begin, length, far = (np.concatenate(x) for x in zip(*copies, strict=True))
        back[ranges(begin, length)] = np.repeat(far, length)
    _resolve(pixels, back, first, counts, np.array([x[3][4] for x in lanes], np.int64))
    rows = pixels.view(np.uint8).reshape(-1, 4)
    return [rows[a : a + n] for a, n in zip(first.tolist(), counts.tolist(), strict=True)]


def _resolve(pixels: np.ndarray, back: np.ndarray, first: np.ndarray, counts: np.ndarray, cache_bits: np.ndarray) -> None:
    """Puts in the pixels that are copied or come from a cache, one pixel of each picture at a time."""
    mine = np.flatnonzero(np.logical_or.reduceat(back != 0, first))
    if not len(mine):
        return
    first, counts, cache_bits = first[mine], counts[mine], cache_bits[mine]
    shift = np.where(cache_bits > 0, 32 - cache_bits, 31).astype(np.uint32)
    slots = offsets(1 << (32 - shift.astype(np.int64)))
    cache, slots = np.zeros(int(slots[-1]), np.uint32), slots[:-1]
    live = len(first)
    for step in range(int(counts[0])):
        while counts[live - 1] <= step:
            live -= 1
        t = first[:live] + step
        far, value = back[t], pixels[t]
        copy, cached = (far > 0).nonzero()[0], (far < 0).nonzero()[0]
        if len(copy):
            value[copy] = pixels[t[copy] - far[copy]]
        if len(cached):
            value[cached] = cache[slots[cached] - 1 - far[cached]]
        pixels[t] = value
        cache[slots[:live] + (argb(value) * np.uint32(CACHE_FACTOR) >> shift[:live])] = value
