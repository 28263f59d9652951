"""Lossless WebP: a decoder of the whole format and an encoder for byte payloads.

The decoder reads prefix codes (also one set for each region), back-references and the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms. Where all of an image's
information is in the green channel and the back-references, as in what the encoder writes, the
symbols are decoded for all bit positions of a stretch at once: every position's code says where the next
symbol would begin, and the chain of actual beginnings is followed in jumps of 8 symbols.

A payload is stored as one grey image (each byte a pixel) in one file. Bytes that repeat at least SHORTEST bytes of
what came up to REACH before are written as back-references. A payload of up to 16 different bytes is written by a palette, with
as many pixels to a byte as fit; others have the green sample coded, and red and blue equal by the subtract-green transform. The image is
WIDTH columns wide, or the least multiple of it with which it is no higher than the format allows; what the last row then holds beyond the
payload is told by a chunk of its own in the file's extended form. A payload beyond the greatest image (MOST_ROWS and MOST_COLUMNS, 256 MiB) fills several, one behind the other.

Defined cases of the DataFrame operator: a null text is the empty one, whose payload is 64 zero bytes; rows that repeat
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parcela.llm.common import texts_of

WIDTH, MOST_ROWS, MOST_COLUMNS = 64, 1 << 14, 1 << 14
#: The shortest back-reference written, how far one reaches, and how much of a payload is searched at once.
SHORTEST, REACH = 8, 1 << 18
#: Bytes of a stream whose bit positions are decoded at once.
STRETCH = 1 << 15

# Fixed values of the format: the order of code length codes, and the (x, y) of the short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
MOST_BITS = 15
PREDICTOR, CROSS, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS = 256, 24


def mirror_table(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in the other order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


MIRROR = mirror_table(MOST_BITS)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of a prefix code with these lengths, as they stand in the stream (first bit lowest)."""
    lengths = lengths.astype(np.int64, copy=False)
    used = lengths.nonzero()[0]
    order = used[lengths[used].argsort(kind="stable")]
    step = np.int64(1) << (MOST_BITS - lengths[order])
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = MIRROR[step.cumsum() - step]
    return codes


@lru_cache(maxsize=MOST_BITS + 1)
def mirrored(bits: int) -> np.ndarray:
    return MIRROR[: 1 << bits] >> (MOST_BITS - bits)


class Code:
    """A prefix code as a table over the next `bits` bits: length and, above its 4 bits, symbol."""

    def __init__(self, coded: bytes):
        lengths = np.frombuffer(coded, np.uint8)
        used = lengths.nonzero()[0]
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.only, self.plain = int(used[0]) if len(used) == 1 else None, None
        self.bits = bits = 0 if self.only is not None else max(coded)
        if self.only is not None:
            self.table = used << 4
            return
        sizes = lengths[used]
        order = sizes.argsort(kind="stable")
        sizes = sizes[order].astype(np.int64)
        times = np.int64(1) << (bits - sizes)
        if times.sum() != 1 << bits:
            raise ValueError("a prefix code that isn't complete")
        self.table = (used[order] << 4 | sizes).repeat(times)[mirrored(bits)]

    def lists(self) -> tuple[list[int], list[int]]:
        if self.plain is None:
            self.plain = (self.table >> 4).tolist(), (self.table & 15).tolist()
        return self.plain


@lru_cache(maxsize=64)
def code_of(lengths: bytes) -> Code:
    return Code(lengths)


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def peek(self) -> int:
        """At least 24 bits from here on."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        out = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the data end within an image")
        return out

    def symbol(self, code: Code) -> int:
        symbols, lengths = code.lists()
        i = self.peek() & ((1 << code.bits) - 1)
        self.at += lengths[i]
        return symbols[i]


def read_code(r: Reader, size: int) -> Code:
    lengths = bytearray(size)
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        lengths[r.read(8 if wide else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return code_of(bytes(lengths))
    of_lengths, told = bytearray(19), 4 + r.read(4)
    ahead = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 8], "little") >> (r.at & 7)  # 57 bits at most
    for i, k in enumerate(LENGTH_ORDER[:told]):
        of_lengths[k] = ahead >> 3 * i & 7
    r.at += 3 * told
    code = code_of(bytes(of_lengths))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    symbols, sizes, mask = *code.lists(), (1 << code.bits) - 1
    at, last = 0, 8
    while at < size and left:
        # A symbol and its extra bits take 22 bits at most; so many are taken out of the stream at once.
        some = min(left, 48)
        ahead, used = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 3 * some + 2], "little") >> (r.at & 7), 0
        for _ in range(some):
            i = (ahead >> used) & mask
            used += sizes[i]
            s = symbols[i]
            if s < 16:
                lengths[at] = s
                at += 1
                if s:
                    last = s
            else:
                more = (2, 3, 7)[s - 16]
                n = (11 if s == 18 else 3) + ((ahead >> used) & ((1 << more) - 1))
                used += more
                if at + n > size:
                    raise ValueError("code lengths beyond the alphabet")
                if s == 16:
                    lengths[at : at + n] = bytes((last,)) * n
                at += n
            left -= 1
            if at >= size:
                break
        r.at += used
        if r.at > r.end:
            raise ValueError("the data end within an image")
    return Code(bytes(lengths))


#: Of each length or distance prefix: how many bits follow, and the value without them.
EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(40)])
EXTRA_MASK = (np.uint64(1) << EXTRA.astype(np.uint64)) - np.uint64(1)
EIGHT = np.arange(8, dtype=np.int32)
LEAST = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)])


@lru_cache(maxsize=64)
def near_distances(width: int) -> np.ndarray:
    """What the short distance codes mean in an image of this width."""
    return np.array([0, *[max(1, x + y * width) for x, y in NEAR]])


def green_only(r: Reader, green: Code, far: Code, width: int, n: int) -> np.ndarray:
    """n values of one code with back-references, a stretch of the stream at a time."""
    if green.only is not None and green.only < LITERALS:
        return np.full(n, green.only, np.uint8)
    out, have, near = bytearray(n), 0, near_distances(width)
    mask, far_mask = np.int32((1 << green.bits) - 1), np.uint64((1 << far.bits) - 1)
    table, of_far, far_length = green.table.astype(np.int32), far.table >> 4, far.table & 15
    far_steps = far_length + EXTRA[of_far]
    while have < n:
        base = r.at >> 3
        data = np.frombuffer(r.data[base : base + STRETCH + 16] + bytes(24), np.uint8)
        word, near_word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)), np.ndarray((len(data) - 7,), "<i4", data, 0, (1,))
        end = 8 * min(STRETCH, max(0, len(r.data) - base))
        bits = lambda at, m: (word[at >> 3] >> (at & 7).astype(np.uint64)) & m  # noqa: E731, B023
        seen = near_word[: end >> 3, None] >> EIGHT
        seen &= mask  # a code has 15 bits at most
        known = table.take(seen.reshape(-1))  # length and, above it, symbol
        reach = np.arange(end + 1)
        reach[:end] += known & 15
        copies = (known >= LITERALS << 4).nonzero()[0]
        if len(copies):
            at = np.minimum(reach[copies] + EXTRA[(known[copies] >> 4) - LITERALS], end + 64)
            reach[copies] = at + far_steps[bits(at, far_mask).astype(np.int64)]
        jump = np.minimum(reach, end)
        step, reach = reach, jump
        for _ in range(3):
            jump = jump.take(jump)
        starts, p, follow = [], r.at & 7, memoryview(jump)
        while p < end:
            starts.append(p)
            p = follow[p]
        if not starts:
            raise ValueError("the data end within an image")
        chain = np.empty((8, len(starts)), np.int64)
        chain[0] = starts
        for k in range(1, 8):
            chain[k] = reach.take(chain[k - 1])
        chain = chain.T.reshape(-1)
        chain = chain[: int(chain.searchsorted(end))]
        known = known.take(chain)
        found = known >> 4
        back = (found >= LITERALS).nonzero()[0] if len(copies) else copies
        if not len(back):
            found = found[: n - have]
            chain = chain[: len(found)]
            out[have : have + len(found)] = found.astype(np.uint8).tobytes()
            have += len(found)
        else:
            size = np.ones(len(chain), np.int64)
            kind, at = found[back] - LITERALS, chain[back] + (known[back] & 15)
            size[back] = LEAST[kind] + bits(at, EXTRA_MASK[kind]).astype(np.int64)
            at = np.minimum(at + EXTRA[kind], end + 64)
            code = bits(at, far_mask).astype(np.int64)
            of = of_far[code]
            at = np.minimum(at + far_length[code], end + 64)
            distance = LEAST[of] + bits(at, EXTRA_MASK[of]).astype(np.int64)
            distance = np.where(distance > len(NEAR), distance - len(NEAR), near[np.minimum(distance, len(NEAR))])
            ends = have + size.cumsum()
            many = int(ends.searchsorted(n)) + 1  # tokens that are part of the image
            if many <= len(ends):
                found, size, ends, chain = found[:many], size[:many], ends[:many], chain[:many]
                back = back[: int(back.searchsorted(many))]
                distance = distance[: len(back)]
            length = size[back]
            begin = ends[back] - length
            if (distance > begin).any() or ends[-1] > n:
                raise ValueError("a back-reference beyond the image")
            out[have : int(ends[-1])] = found.astype(np.uint8).repeat(size).tobytes()  # what copies cover is written next
            for at, many, far_back in zip(begin.tolist(), length.tolist(), distance.tolist(), strict=True):
                if many <= far_back:
                    out[at : at + many] = out[at - far_back : at - far_back + many]
                else:
                    out[at : at + many] = (out[at - far_back : at] * (many // far_back + 1))[:many]
            have = int(ends[-1])
        r.at = 8 * base + int(step[chain[-1]])
        if r.at > r.end:
            raise ValueError("the data end within an image")
    return np.frombuffer(out, np.uint8)


def prefix_value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as one row of ARGB numbers."""
    cache_bits = r.read(4) if r.read(1) else 0
    if r.read(1) if main else 0:
        region = 2 + r.read(3)
        across = (width + (1 << region) - 1) >> region
        kinds = (pixels(r, across, (height + (1 << region) - 1) >> region, False) >> 8) & 0xFFFF
    else:
        region, across, kinds = 0, 0, np.zeros(1, np.int64)
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(r, s) for s in sizes] for _ in range(int(kinds.max()) + 1)]
    n = width * height
    green, red, blue, alpha, far = groups[0]
    if len(groups) == 1 and not cache_bits and all(c.only is not None for c in (red, blue, alpha)):
        return (green_only(r, green, far, width, n).astype(np.int64) << 8) | (alpha.only << 24 | red.only << 16 | blue.only)
    out, cache, at = [0] * n, [0] * (1 << cache_bits), 0
    shift = 32 - cache_bits

    def put(v: int) -> None:
        nonlocal at
        out[at] = v
        at += 1
        if cache_bits:
            cache[((CACHE_FACTOR * v) & 0xFFFFFFFF) >> shift] = v

    while at < n:
        green, red, blue, alpha, far = groups[int(kinds[(at // width >> region) * across + (at % width >> region)])] if across else groups[0]
        s = r.symbol(green)
        if s < LITERALS:
            v = s << 8
            v |= r.symbol(red) << 16
            v |= r.symbol(blue)
            put(v | r.symbol(alpha) << 24)
        elif s < LITERALS + LENGTHS:
            length, code = prefix_value(r, s - LITERALS), prefix_value(r, r.symbol(far))
            if code > len(NEAR):
                back = code - len(NEAR)
            else:
                x, y = NEAR[code - 1]
                back = max(1, x + y * width)
            if back > at or at + length > n:
                raise ValueError("a back-reference beyond the image")
            for _ in range(length):
                put(out[at - back])
        else:
            put(cache[s - LITERALS - LENGTHS])
        if r.at > r.end:
            raise ValueError("the data end within an image")
    return np.array(out, np.int64)


def channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], -1)


def joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predicted(mode: int, left, top, right, corner):
    """The prediction from the neighbours: left, top, top right and top left."""
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        by_left, by_top = np.abs(top - corner).sum(), np.abs(left - corner).sum()
        return left if by_left < by_top else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int64), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: half(half(left, right), top), 6: lambda: half(left, corner),
        7: lambda: half(left, top), 8: lambda: half(corner, top), 9: lambda: half(top, right), 10: lambda: half(half(left, corner), half(top, right)),
    }.get(mode, lambda: np.array([255, 0, 0, 0]))()


#: Modes whose prediction doesn't look at the pixel to the left.
NO_LEFT = (0, 2, 3, 4, 8, 9, 14, 15)


def undo_predictor(argb: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """Row by row, and within a row by runs of one mode; only modes that mix the left pixel with others go pixel by pixel."""
    c = channels(argb).reshape(-1, width, 4).astype(np.int64)
    across = (width + (1 << bits) - 1) >> bits
    modes = (modes.reshape(-1, across) >> 8) & 15
    c[0, 0] += [255, 0, 0, 0]
    c[0] = np.cumsum(c[0], 0) & 255
    for y in range(1, len(c)):
        row, above = c[y], c[y - 1]
        row[0] = (row[0] + above[0]) & 255
        kinds = modes[y >> bits]
        edges = np.flatnonzero(np.diff(kinds, prepend=-1))
        for tile, after in zip(edges, np.append(edges[1:], across), strict=True):
            x, end, mode = max(1, int(tile) << bits), min(width, int(after) << bits), int(kinds[tile])
            if x >= end:
                continue
            right = np.vstack([above[x + 1 : end + 1], row[:1]])[: end - x]  # beyond the last column lies the row's own first pixel
            if mode == 1:
                row[x:end] = (row[x - 1] + np.cumsum(row[x:end], 0)) & 255
            elif mode in NO_LEFT:
                row[x:end] = (row[x:end] + predicted(mode, None, above[x:end], right, above[x - 1 : end - 1])) & 255
            else:
                for i in range(x, end):
                    row[i] = (row[i] + predicted(mode, row[i - 1], above[i], right[i - x], above[i - 1])) & 255
    return joined(c.reshape(-1, 4))


def undo_cross(argb: np.ndarray, width: int, elements: np.ndarray, bits: int) -> np.ndarray:
    i = np.arange(len(argb))
    e = elements[((i // width) >> bits) * ((width + (1 << bits) - 1) >> bits) + ((i % width) >> bits)]
    signed = lambda v: ((v & 255) ^ 128) - 128
    red, green, blue = argb >> 16, signed(argb >> 8), argb
    red = red + (signed(e) * green >> 5)
    blue = blue + (signed(e >> 8) * green >> 5) + (signed(e >> 16) * signed(red) >> 5)
    return (argb & 0xFF00FF00) | (red & 255) << 16 | (blue & 255)


def undo_green(argb: np.ndarray) -> np.ndarray:
    green = (argb >> 8) & 255
    return (argb & 0xFF00FF00) | ((argb & 0x00FF00FF) + green * 0x00010001) & 0x00FF00FF  # red and blue at once


def undo_palette(argb: np.ndarray, width: int, height: int, colours: np.ndarray, bits: int) -> np.ndarray:
    packed = ((argb >> 8) & 255).reshape(height, -1)
    if bits:
        each = 8 >> bits
        packed = ((packed[:, :, None] >> (np.arange(1 << bits) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.int64)
    table[: len(colours)] = colours
    return table[packed].reshape(-1)


def decode_image(data: bytes) -> np.ndarray:
    """The ARGB numbers of a VP8L stream, height x width."""
    if data[:1] != b"\x2f":
        raise ValueError("not a lossless image")
    r = Reader(data, 8)
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("an unknown version")
    inner, undo, seen = width, [], set()
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise ValueError("a transform that comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            bits = 2 + r.read(3)
            side = pixels(r, (inner + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)
            undo.append((kind, inner, side, bits))
        elif kind == PALETTE:
            n = 1 + r.read(8)
            colours = joined(np.cumsum(channels(pixels(r, n, 1, False)), 0))
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, inner, colours, bits))
            inner = (inner + (1 << bits) - 1) >> bits
        else:
            undo.append((kind, inner, None, 0))
    out = pixels(r, inner, height, True)
    for kind, w, side, bits in reversed(undo):
        if kind == PREDICTOR:
            out = undo_predictor(out, w, side, bits)
        elif kind == CROSS:
            out = undo_cross(out, w, side, bits)
        elif kind == PALETTE:
            out = undo_palette(out, w, height, side, bits)
        else:
            out = undo_green(out)
    return out.reshape(height, width)


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The names and contents of a file's chunks."""
    mark, size, form = struct.unpack_from("<4sI4s", media, 0)
    if mark != b"RIFF" or form != b"WEBP":
        raise ValueError("not a WebP file")
    p, end = 12, 8 + size
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", media, p)
        yield kind, media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)


class Writer:
    """Bits, the first one lowest."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def code_lengths(counts: list[int]) -> list[int]:
    """Huffman code lengths of at most 15 bits, for two symbols or more, by two queues: the symbols and the pairs made, both rising."""
    used = sorted([i for i, n in enumerate(counts) if n], key=counts.__getitem__)
    weight, none = [counts[i] for i in used], float("inf")
    while True:
        pairs = len(weight) - 1
        leaf, made = [*weight, none], [none] * (pairs + 1)
        over, above, a, b = [0] * (pairs + 1), [0] * pairs, 0, 0
        for k in range(pairs):
            total = 0
            for _ in (0, 1):
                x, y = leaf[a], made[b]
                if x <= y:
                    over[a] = k
                    a += 1
                    total += x
                else:
                    above[b] = k
                    b += 1
                    total += y
            made[k] = total
        depth = [1] * pairs  # of what is below a pair
        for k in range(pairs - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth) <= MOST_BITS:
            break
        weight = [(n + 1) // 2 for n in weight]
    lengths = [0] * len(counts)
    for i, k in zip(used, over, strict=True):
        lengths[i] = depth[k]
    return lengths


#: The code for code lengths: those up to 13 have 4 bits, 14, 15 and the runs of zeros (17, 18) have 5.
RUN_LENGTHS = np.array([4] * 14 + [5, 5, 0, 5, 5])
RUN_CODES = canonical(RUN_LENGTHS).tolist()
#: A code by code lengths, 19 of them for the lengths themselves (3 bits each), and the whole alphabet: the value and its bits.
RUN_HEAD = 15 << 1 | sum(int(RUN_LENGTHS[k]) << (5 + 3 * i) for i, k in enumerate(LENGTH_ORDER)), 5 + 3 * 19 + 1


def put_only(w: Writer, symbol: int) -> None:
    w.put(1 | 1 << 2 | symbol << 3, 11)


@lru_cache(maxsize=512)
def zeros(n: int) -> tuple[int, int]:
    """The code for n code lengths of 0, and its bits."""
    w = Writer()
    while n:
        run = min(n, 138)
        if run >= 11:
            w.put(RUN_CODES[18] | (run - 11) << 5, 12)
        elif run >= 3:
            w.put(RUN_CODES[17] | (run - 3) << 5, 8)
        else:
            run = 1
            w.put(RUN_CODES[0], 4)
        n -= run
    return w.value, w.size


def put_code(w: Writer, lengths: list[int], size: int) -> None:
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1 | (len(used) - 1) << 1 | 1 << 2, 3)
        for s in used:
            w.put(s, 8)
        return
    value, bits = RUN_HEAD
    at = 0
    for k in used:
        if k > at:
            v, n = zeros(k - at)
            value |= v << bits
            bits += n
        n = lengths[k]
        value |= RUN_CODES[n] << bits
        bits += 4 if n < 14 else 5
        at = k + 1
    v, n = zeros(size - at)
    w.put(value | v << bits, bits + n)


FIRST, LOW, HALF = np.zeros(1, np.int64), np.uint64((1 << 32) - 1), np.uint64(32)


def packed(head: Writer, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """The head's bits and then codes of these lengths, of at most 32 bits each."""
    end = head.size + lengths.cumsum()
    total = int(end[-1]) if len(end) else head.size
    out = np.zeros(total // 32 + 3, "<u4")
    if len(end):
        at = end - lengths
        word = at >> 5
        first = (word[1:] != word[:-1]).nonzero()[0] + 1
        first = np.concatenate([FIRST, first])
        sums, word = np.add.reduceat((codes << (at & 31)).astype(np.uint64), first), word[first]  # no two codes share a bit
        out[word] = sums & LOW
        out[word + 1] |= (sums >> HALF).astype(np.uint32)
    start = head.value.to_bytes(head.size // 8 + 1, "little")
    out = out.view(np.uint8)
    out[: len(start)] |= np.frombuffer(start, np.uint8)
    return out[: (total + 7) // 8].tobytes()

PLACES = np.uint64(2 * REACH - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)


def repeats(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where samples repeat what came before: beginnings, lengths and distances, in order and apart from each other."""
    n, parts = len(samples), []
    for lo in range(0, n, REACH):
        begin, end = max(0, lo - REACH), min(n, lo + REACH)
        if end - begin < SHORTEST + 1:
            continue
        part = np.ascontiguousarray(samples[begin:end])
        eight = np.ndarray((len(part) - 7,), "<u8", part, 0, (1,)).copy()
        # Places in the order of a hash of their eight bytes, and of the place: a sort of plain numbers.
        order = mixed(eight)
        order &= ~PLACES
        order |= np.arange(len(eight), dtype=np.uint64)
        order.sort()
        order &= PLACES
        order = order.astype(np.int64)
        eight = eight.take(order)
        same = (eight[1:] == eight[:-1]).nonzero()[0]
        if not len(same):
            continue
        back, later = np.zeros(len(order), np.int64), order[same + 1]  # to the last place with the same eight bytes
        back[later] = later - order[same]
        back[: lo - begin] = 0  # the first place has none before it in any case
        edge = (back[1:] != back[:-1]).nonzero()[0] + 1
        stop = np.append(edge[1:], len(back)) + 7  # a run's last eight bytes reach so far
        back = back[edge]
        run = back.nonzero()[0]
        parts.append((edge[run] + begin, stop[run] + begin, back[run]))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    run, stop, back = parts[0] if len(parts) == 1 else (np.concatenate([p[k] for p in parts]) for k in range(3))
    run[1:] = np.maximum(run[1:], np.maximum.accumulate(stop)[:-1])
    length = stop - run
    good = (length >= SHORTEST).nonzero()[0]
    return run[good], length[good], back[good]


def prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of values from 1 on: the prefix, how many bits follow it, and these."""
    prefix = LEAST.searchsorted(values, "right") - 1
    return prefix, EXTRA[prefix], values - LEAST[prefix]


#: Samples up to a back-reference are written as they are, those of it are not.
PLAIN = np.array([True, False])


def put_pixels(w: Writer, samples: np.ndarray, only: tuple[int, int, int] = (0, 0, 255)) -> bytes:
    """An image of green samples, all else being the same in all pixels; closes the stream."""
    w.put(0, 2)  # no cache, one set of codes
    begin, length, back = repeats(samples)
    if length.max(initial=0) > 4096:
        split = -(-length // 4096)
        nth = np.arange(split.sum()) - np.repeat(np.cumsum(split) - split, split)
        begin, length, back = np.repeat(begin, split) + 4096 * nth, np.minimum(4096, np.repeat(length, split) - 4096 * nth), np.repeat(back, split)
    if not len(begin):
        plain = samples.astype(np.int64)
        lengths = put_counts(w, np.bincount(plain, minlength=LITERALS + LENGTHS).tolist(), LITERALS + LENGTHS)
        for o in (*only, 0):
            put_only(w, o)
        return packed(w, canonical(lengths)[plain], lengths[plain])
    # Samples between back-references, and how many of them each back-reference has before it.
    stops = np.empty(2 * len(begin) + 1, np.int64)
    stops[:-1:2], stops[1::2], stops[-1] = begin, begin + length, len(samples)
    stops[1:] -= stops[:-1].copy()
    between = stops[::2]
    plain = samples[np.resize(PLAIN, len(stops)).repeat(stops)].astype(np.int64)
    before = between.cumsum()
    p1, e1, x1 = prefixed(length)
    p2, e2, x2 = prefixed(back + len(NEAR))
    p1 += LITERALS
    green = np.bincount(plain, minlength=LITERALS + LENGTHS) + np.bincount(p1, minlength=LITERALS + LENGTHS)
    near = put_counts(w, green.tolist(), LITERALS + LENGTHS)
    for o in only:
        put_only(w, o)
    far = put_counts(w, np.bincount(p2, minlength=40).tolist(), 40)
    near_code, far_code = canonical(near), canonical(far)
    # Fields in the order of the stream: a plain sample has one, a back-reference four.
    at = np.arange(len(plain)) + np.arange(0, 4 * len(between), 4).repeat(between)
    code, size = np.empty(len(plain) + 4 * len(begin), np.int64), np.empty(len(plain) + 4 * len(begin), np.int64)
    code[at], size[at] = near_code[plain], near[plain]
    at = np.arange(0, 4 * len(begin), 4) + before[:-1]
    for c, n in ((near_code[p1], near[p1]), (x1, e1), (far_code[p2], far[p2]), (x2, e2)):
        code[at], size[at] = c, n
        at += 1
    return packed(w, code, size)


def put_counts(w: Writer, counts: list[int], size: int) -> np.ndarray:
    """Writes the code for these counts; its lengths, 0 for an only symbol."""
    several = len(counts) - counts.count(0) > 1
    lengths = code_lengths(counts) if several else [int(n > 0) for n in counts]
    put_code(w, lengths, size)
    return np.array(lengths, np.int64) if several else np.zeros(len(counts), np.int64)


def put_palette(w: Writer, colours: np.ndarray) -> None:
    """A palette of greys, as differences from one to the next."""
    w.put(1 | PALETTE << 1, 3)
    w.put(len(colours) - 1, 8)
    w.put(0, 1)  # no cache
    steps = np.diff(colours.astype(np.int64), prepend=0).tolist()
    alphas = [255, *[0] * (len(steps) - 1)]
    tables = []
    for values, size in ((steps, LITERALS + LENGTHS), (steps, 256), (steps, 256), (alphas, 256)):
        lengths = put_counts(w, np.bincount(values, minlength=size).tolist(), size)
        tables.append((canonical(lengths), lengths))
    put_only(w, 0)
    for step, alpha in zip(steps, alphas, strict=True):
        for (codes, lengths), v in zip(tables, (step, step, step, alpha), strict=True):
            w.put(int(codes[v]), int(lengths[v]))


def encode_image(samples: np.ndarray, width: int) -> bytes:
    """A VP8L stream of a grey image of these bytes, row by row; their number is a multiple of the width."""
    height = len(samples) // width
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    colours = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(colours) <= 16:
        put_palette(w, colours)
        bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        index = np.pad(np.searchsorted(colours, samples).reshape(height, width), ((0, 0), (0, -width % (1 << bits))))
        samples = (index.reshape(height, -1, 1 << bits) << (np.arange(1 << bits) * (8 >> bits))).sum(2).reshape(-1).astype(np.uint8)
    else:
        w.put(1 | SUBTRACT_GREEN << 1, 3)
    w.put(0, 1)  # no more transforms
    return put_pixels(w, samples)


def payload_of(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def store(payload: bytes) -> bytes:
    data = np.frombuffer(payload, np.uint8)
    parts, sides, told = [], (0, 0), b""
    most = MOST_ROWS * MOST_COLUMNS
    for lo in range(0, len(data), most):
        some = data[lo : lo + most]
        width = WIDTH * max(1, -(-len(some) // (WIDTH * MOST_ROWS)))
        rows = -(-len(some) // width)
        parts.append((b"VP8L", encode_image(np.pad(some, (0, rows * width - len(some))) if rows * width > len(some) else some, width)))
        sides = max(sides[0], width), max(sides[1], rows)
        if rows * width > len(some) or len(parts) > 1:
            told = struct.pack("<Q", len(data))
    if told:
        parts = [(b"VP8X", bytes(4) + (sides[0] - 1).to_bytes(3, "little") + (sides[1] - 1).to_bytes(3, "little")), *parts, (b"SIZE", told)]
    body = b"".join(struct.pack("<4sI", k, len(c)) + c + b"\0" * (len(c) & 1) for k, c in parts)
    return struct.pack("<4sI4s", b"RIFF", len(body) + 4, b"WEBP") + body


def load(media: bytes) -> list[np.ndarray]:
    """The ARGB numbers of a file's images."""
    return [decode_image(c) for k, c in chunks(media) if k == b"VP8L"]


def restore(media: bytes) -> np.ndarray:
    """The payload that was stored."""
    told, images = [], []
    for k, c in chunks(media):
        if k == b"VP8L":
            images.append(decode_image(c).reshape(-1).astype("<i8", copy=False).view(np.uint8)[1::8])  # the second byte of a number is the green one
        elif k == b"SIZE":
            told.append(struct.unpack("<Q", c)[0])
    samples = np.ascontiguousarray(images[0]) if len(images) == 1 else np.concatenate(images)
    return samples[: told[0]] if told else samples


VALUES = np.arange(256)
SQUARES = VALUES * VALUES


def feature_of(grey: np.ndarray) -> str:
    """A hash of which of 8 x 8 areas are lighter than the mean, the mean and the deviation; sums are whole numbers, thus exact."""
    height, width = grey.shape
    first = [k * height // 8 for k in range(8)]
    rows = [max(1, b - a) for a, b in zip(first, [*first[1:], height], strict=True)]
    cells = np.add.reduceat(grey, first, 0, np.int64).reshape(8, 8, width // 8).sum(2)  # of a first row that is the next one's too: the row itself
    counts = np.bincount(grey.reshape(-1), minlength=256)
    n, total, squares = height * width, int(counts @ VALUES), int(counts @ SQUARES)
    bits = np.packbits(cells / (np.array(rows)[:, None] * (width // 8)) > total / n).tobytes().hex()
    return f"{bits}:{total / n:.4f}:{math.sqrt(n * squares - total * total) / n:.4f}"


def round_trip(docs: DataFrame, media: bool = False) -> DataFrame:
    """Stores each text's payload, reads it back and describes what was read; with the stored bytes, if asked for."""

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                payload = payload_of(text)
                stored = store(payload)
                grey = restore(stored).reshape(-1, WIDTH)
                back = grey.tobytes()
                row = (doc_id, len(text.encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(grey))
                out.append((*row, stored) if media else row)
            yield pd.DataFrame(out, columns=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if media else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return texts_of(docs).mapInPandas(run, schema)
