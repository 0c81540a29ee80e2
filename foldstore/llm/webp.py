"""Lossless WebP (VP8L): a complete decoder and an encoder, on arrays.

Pixels are unsigned 32-bit numbers, alpha in the highest byte, then red, green, blue. The decoder handles all of the
format: simple and full prefix codes, groups of them, back-references, the colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. An image with one group of codes, which is what most have, is
decoded by array operations: the token that would begin at each bit is looked up for all bits at once, the chain of
tokens is followed by jumps of sixteen, and only back-references and cached colours are resolved one by one. Images with
several groups are decoded token by token.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cache, cached_property, lru_cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
MOST_SIDE = 1 << 14
# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD


class Damaged(ValueError):
    """The bytes aren't a lossless WebP image."""


@cache
def near_distances() -> tuple[tuple[int, int], ...]:
    """(x, y) of the short distance codes: the pixels before this one within 8 columns and 7 rows, nearest first."""
    around = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return tuple(sorted(around, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)))


@lru_cache(maxsize=16)
def _reversal(bits: int) -> np.ndarray:
    r = np.zeros(1, np.int64)
    for _ in range(bits):
        r = np.concatenate([r * 2, r * 2 + 1])
    return r


# ---------------------------------------------------------------------------------------------- prefix codes


_NO_BITS = np.zeros(1, np.int64)


@cache
def _back() -> list[int]:
    """The reversal of 15 bits as a list."""
    return _reversal(15).tolist()


class Code:
    """A prefix code as a table over the next ``bits`` bits of the stream: symbol and length; as arrays and as a list."""

    def __init__(self, symbols: list[int], sizes: list[int]):
        if not symbols:
            raise Damaged("a prefix code without symbols")
        self.rows = sorted(zip(sizes, symbols, strict=True))
        self.bits = self.rows[-1][0] if len(symbols) > 1 else 0
        if self.bits and sum([1 << self.bits - n for n in sizes]) != 1 << self.bits:
            raise Damaged("an incomplete prefix code")

    @cached_property
    def entries(self) -> list[int]:
        """Symbol and, in the lowest four bits, length."""
        if not self.bits:
            return [self.rows[0][1] << 4]
        out, back, first = [0] * (1 << self.bits), _back(), 0
        for n, s in self.rows:
            out[back[first] :: 1 << n] = [s << 4 | n] * (1 << self.bits - n)
            first += 1 << 15 - n
        return out

    @cached_property
    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.bits:
            return np.array([self.rows[0][1]]), _NO_BITS
        size, symbol = np.array(self.rows, np.int64).T
        row = np.repeat(np.arange(len(size)), np.left_shift(1, self.bits - size))[_reversal(self.bits)]
        return symbol.take(row), size.take(row)

    @property
    def symbol(self) -> np.ndarray:
        return self._arrays[0]

    @property
    def length(self) -> np.ndarray:
        return self._arrays[1]


@lru_cache(maxsize=512)
def _short_code(*symbols: int) -> Code:
    """A code of one symbol, or of two with a bit each."""
    return Code(list(symbols), [1] * len(symbols))


def _depths(weight: list[int], most: int) -> list[int]:
    """Lengths of an optimal prefix code of two symbols or more, flattened until none is over ``most``."""
    n, never = len(weight), 1 << 62
    while True:
        order = sorted(range(n), key=weight.__getitem__)
        # Sums come out in rising order, so that the symbols and the sums are two queues; of equals, symbols go first.
        leaf, sums = [weight[k] for k in order] + [never], [never] * n
        above, over = [0] * n, [0] * n
        i = j = 0
        for node in range(n - 1):
            if leaf[i] <= sums[j]:
                total, above[i], i = leaf[i], node, i + 1
            else:
                total, over[j], j = sums[j], node, j + 1
            if leaf[i] <= sums[j]:
                total, above[i], i = total + leaf[i], node, i + 1
            else:
                total, over[j], j = total + sums[j], node, j + 1
            sums[node] = total
        depth = [1] * (n - 1)
        for k in range(n - 3, -1, -1):
            depth[k] = depth[over[k]] + 1
        if max(depth) <= most:
            out = [0] * n
            for k, a in zip(order, above, strict=True):
                out[k] = depth[a]
            return out
        weight = [(x + 1) // 2 for x in weight]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code, flattened until none is over ``most``."""
    out = np.zeros(len(counts), np.int64)
    used = counts.nonzero()[0]
    if len(used) <= 1:
        out[used if len(used) else 0] = 1
    else:
        out[used] = _depths(counts[used].tolist(), most)
    return out


def _small_code(counts: list[int], most: int) -> tuple[list[int], list[int]]:
    """``code_lengths`` and ``code_words`` as lists, for a few symbols."""
    used = [k for k, n in enumerate(counts) if n] or [0]
    lengths, words = [0] * len(counts), [0] * len(counts)
    for k, n in zip(used, _depths([counts[k] for k in used], most) if len(used) > 1 else (1,), strict=True):
        lengths[k] = n
    if len(used) > 1:
        back, first = _back(), 0
        for n, k in sorted([(lengths[k], k) for k in used]):
            words[k] = back[first]
            first += 1 << 15 - n
    return lengths, words


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol as it stands in the stream, first bit lowest; zero bits for a single symbol."""
    out = np.zeros(len(lengths), np.int64)
    used = lengths.nonzero()[0]
    if len(used) <= 1:
        return out
    size = lengths[used]
    order = np.argsort(size, kind="stable")
    share = np.left_shift(np.int64(1), 15 - size[order])
    first = np.cumsum(share) - share
    back = _reversal(15)
    out[used[order]] = back[first]
    return out


# ---------------------------------------------------------------------------------------------- reading bits


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data + bytes(8), at, 8 * len(data)

    def read(self, n: int) -> int:
        p = self.at
        self.at = p + n
        if self.at > self.end:
            raise Damaged("the image ends too early")
        return (int.from_bytes(self.data[p >> 3 : (p >> 3) + 8], "little") >> (p & 7)) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        p = self.at
        e = code.entries[(int.from_bytes(self.data[p >> 3 : (p >> 3) + 3], "little") >> (p & 7)) & ((1 << code.bits) - 1)]
        self.at = p + (e & 15)
        if self.at > self.end:
            raise Damaged("the image ends too early")
        return e >> 4

    def extra(self, prefix: int) -> int:
        """A length or distance from its prefix symbol and the bits that follow."""
        if prefix < 4:
            return prefix + 1
        n = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << n) + self.read(n) + 1


def _read_code(r: Reader, alphabet: int) -> Code:
    data, at = r.data, r.at
    head = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
    if head & 1:
        n = 8 if head & 4 else 1
        symbols = [head >> 3 & ((1 << n) - 1)]
        if head & 2:
            symbols.append(head >> 3 + n & 255)
        r.at = at + 3 + n + (8 if head & 2 else 0)
        if r.at > r.end:
            raise Damaged("the image ends too early")
        if max(symbols) >= alphabet:
            raise Damaged("a symbol outside the alphabet")
        return _short_code(*sorted(set(symbols)))
    bits = int.from_bytes(data[at >> 3 : (at >> 3) + 12], "little") >> (at & 7)  # 82 bits at most come before the lengths
    shown = 4 + (bits >> 1 & 15)
    meta, have = {}, 5
    for s in LENGTH_ORDER[:shown]:
        if n := bits >> have & 7:
            meta[s] = n
        have += 3
    code, left = Code(list(meta), list(meta.values())), alphabet
    if bits >> have & 1:
        n = 2 + 2 * (bits >> have + 1 & 7)
        left = 2 + (bits >> have + 4 & ((1 << n) - 1))
        have += 3 + n
    at += have + 1
    if left > alphabet:
        raise Damaged("more code lengths than symbols")
    # Bits are taken from the stream 32 bytes at a time; a length and its repeats are 14 bits at most.
    entries, mask, have = code.entries, (1 << code.bits) - 1, 0
    symbols, sizes, k, last = [], [], 0, 8
    while k < alphabet and left:
        if have < 14:
            bits, have = int.from_bytes(data[at >> 3 : (at >> 3) + 32], "little") >> (at & 7), 249
        left -= 1
        e = entries[bits & mask]
        s, n = e >> 4, e & 15
        if s < 16:
            if s:
                symbols.append(k)
                sizes.append(s)
                last = s
            k += 1
        else:
            more, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            times = least + (bits >> n & ((1 << more) - 1))
            n += more
            if k + times > alphabet:
                raise Damaged("more code lengths than symbols")
            if s == 16:
                symbols += range(k, k + times)
                sizes += [last] * times
            k += times
        bits >>= n
        at += n
        have -= n
    r.at = at
    if at > r.end:
        raise Damaged("the image ends too early")
    return Code(symbols, sizes)


def _read_group(r: Reader, cache_size: int) -> list[Code]:
    return [_read_code(r, n) for n in (LITERALS + LENGTHS + cache_size, LITERALS, LITERALS, LITERALS, DISTANCES)]


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = near_distances()[code - 1]
    return max(1, x + y * width)


def _copy(out: list[int], distance: int, length: int) -> None:
    n = len(out)
    if distance > n:
        raise Damaged("a reference before the first pixel")
    if distance >= length:
        out += out[n - distance : n - distance + length]
    else:
        part = out[n - distance :]
        out += (part * (length // distance + 1))[:length]


def _fill_cache(table: list[int], pixels: list[int], bits: int) -> None:
    for p in pixels:
        table[((p * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - bits)] = p


def _tokens_one_by_one(r: Reader, width: int, height: int, groups: list[list[Code]], meta: np.ndarray | None, meta_bits: int, cache_bits: int) -> np.ndarray:
    out: list[int] = []
    table = [0] * (1 << cache_bits if cache_bits else 0)
    fresh, n = 0, width * height
    while len(out) < n:
        at = len(out)
        group = groups[int(meta[(at // width) >> meta_bits, (at % width) >> meta_bits])] if meta is not None else groups[0]
        s = r.symbol(group[0])
        if s < LITERALS:
            red = r.symbol(group[1])
            blue = r.symbol(group[2])
            out.append(r.symbol(group[3]) << 24 | red << 16 | s << 8 | blue)
        elif s < LITERALS + LENGTHS:
            length = r.extra(s - LITERALS)
            distance = _distance(r.extra(r.symbol(group[4])), width)
            if at + length > n:
                raise Damaged("a reference past the last pixel")
            _copy(out, distance, length)
        else:
            _fill_cache(table, out[fresh:], cache_bits)
            fresh = at
            out.append(table[s - LITERALS - LENGTHS])
    return np.array(out, np.uint32)


#: An image of at most so many pixels is read symbol by symbol: arrays would cost more.
FEW = 256


def _few_literals(r: Reader, n: int, group: list[Code]) -> np.ndarray:
    """A small image without references and cached colours, symbol by symbol."""
    fixed, codes = 0, []
    for c, shift in zip(group, (8, 16, 0, 24), strict=False):
        if c.bits:
            codes.append((c.entries, (1 << c.bits) - 1, shift))
        else:
            fixed |= c.entries[0] >> 4 << shift
    at, out = r.at, []
    bits = int.from_bytes(r.data[at >> 3 : (at + n * sum(c.bits for c in group[:4]) + 15) >> 3], "little") >> (at & 7)
    for _ in range(n):
        p = fixed
        for entries, mask, shift in codes:
            e = entries[bits & mask]
            bits >>= e & 15
            at += e & 15
            p |= e >> 4 << shift
        out.append(p)
    if at > r.end:
        raise Damaged("the image ends too early")
    r.at = at
    return np.array(out, np.uint32)


def _tokens_at_once(r: Reader, width: int, height: int, group: list[Code], cache_bits: int) -> np.ndarray:
    """As above for a single group. Arrays over all bits of what is left of the stream; bit numbers count from its first byte."""
    n, base = width * height, r.at >> 3
    green, red, blue, alpha, far = group
    special = any(s >= LITERALS for _, s in green.rows)
    if n <= FEW and not special:
        return _few_literals(r, n, group)
    data = np.frombuffer(r.data, np.uint8)[base:].astype(np.uint32)
    start, bits = r.at - 8 * base, r.end - 8 * base
    if all(c.bits == 0 for c in group[:4]):  # no bit is spent on a pixel
        s = int(green.symbol[0])
        if s < LITERALS:
            return np.full(n, int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | s << 8 | int(blue.symbol[0]), np.uint32)
        return _tokens_one_by_one(r, width, height, [group], None, 0, cache_bits)
    whole = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    windows = (whole[: (bits + 7) // 8, None] >> np.arange(8, dtype=np.uint32)).ravel()[:bits]
    look = lambda code, at: at & ((1 << code.bits) - 1)
    k = look(green, windows).astype(np.int64)
    after = np.arange(bits + 1)  # the place past the last bit leads to itself
    within = after[:bits]
    within += green.length.take(k)
    symbol = green.symbol.take(k) if special else None
    for c in (red, blue, alpha):
        if c.bits:
            step = c.length.take(look(c, windows[np.minimum(within, bits - 1)]))
            within += np.where(symbol < LITERALS, step, 0) if special else step
    refers = np.flatnonzero((symbol >= LITERALS) & (symbol < LITERALS + LENGTHS)) if special else ()
    if len(refers):
        prefix = symbol[refers] - LITERALS
        p = np.minimum(within[refers] + np.maximum(0, (prefix - 2) >> 1), bits - 1)
        d = look(far, windows[p])
        prefix = far.symbol[d]
        within[refers] = p + far.length[d] + np.maximum(0, (prefix - 2) >> 1)
    np.minimum(after[-128:], bits, out=after[-128:])  # no token has more bits
    jump = after
    for _ in range(4):
        jump = jump.take(jump)
    stops, p, far_on = [], start, memoryview(jump)
    for _ in range(n // 16 + 1):
        if p >= bits:
            break
        stops.append(p)
        p = far_on[p]
    at = np.empty((16, len(stops)), np.int64)
    if len(stops):
        at[0] = stops
        for j in range(1, 16):
            after.take(at[j - 1], out=at[j], mode="clip")
    at = at.T.ravel()[:n]
    if len(at) and at[-1] >= bits:
        at = at[: np.searchsorted(at, bits)]
    k = k.take(at)
    symbol = green.symbol.take(k)
    plain = symbol < LITERALS if special else None
    all_plain = not special or bool(plain.all())
    if all_plain and len(at) < n:
        raise Damaged("the image ends too early")
    if all_plain and not (red.bits or blue.bits or alpha.bits):
        p = at[-1:] + green.length.take(k[-1:])
    else:
        p = at + green.length.take(k) if all_plain else (at + green.length.take(k))[plain]
    value = (symbol if all_plain else symbol[plain]).astype(np.uint32) << np.uint32(8)
    for c, shift in ((red, 16), (blue, 0), (alpha, 24)):
        if c.bits:
            q = look(c, windows[np.minimum(p, bits - 1)])
            value |= c.symbol.take(q).astype(np.uint32) << np.uint32(shift)
            p = p + c.length.take(q)
        elif c.symbol[0]:
            value |= np.uint32(int(c.symbol[0]) << shift)
    if all_plain:
        if p[-1] > bits:
            raise Damaged("the image ends too early")
        r.at = 8 * base + int(p[-1])
        return value
    pixel = np.zeros(len(at), np.uint32)
    pixel[plain] = value
    # Runs of literals go over as they are; references and cached colours one by one.
    out: list[int] = []
    table = [0] * (1 << cache_bits if cache_bits else 0)
    rank = np.cumsum(plain)
    fresh, done = 0, 0
    for t in [*np.flatnonzero(~plain).tolist(), len(at)]:
        run = min(t - done, n - len(out))
        if run:
            out += pixel[done : done + run].tolist()
            r.at = 8 * base + int(p[rank[done + run - 1] - 1])
        if len(out) == n:
            break
        if t == len(at):
            raise Damaged("the image ends too early")
        done = t + 1
        s = int(symbol[t])
        r.at = 8 * base + int(at[t]) + int(green.length[look(green, windows[at[t]])])
        if s < LITERALS + LENGTHS:
            length = r.extra(s - LITERALS)
            _copy(out, _distance(r.extra(r.symbol(far)), width), length)
            if len(out) > n:
                raise Damaged("a reference past the last pixel")
        else:
            _fill_cache(table, out[fresh:], cache_bits)
            fresh = len(out)
            out.append(table[s - LITERALS - LENGTHS])
    return np.array(out, np.uint32)


def _image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; the main one may have groups of codes by block."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise Damaged("a colour cache of a size that isn't allowed")
    meta, meta_bits = None, 0
    if main and r.read(1):
        meta_bits = r.read(3) + 2
        meta = ((_image(r, -(-width >> meta_bits), -(-height >> meta_bits), False) >> 8) & 0xFFFF).astype(np.int64).reshape(-(-height >> meta_bits), -1)
    groups = [_read_group(r, 1 << cache_bits if cache_bits else 0) for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    if len(groups) == 1:
        return _tokens_at_once(r, width, height, groups[0], cache_bits)
    return _tokens_one_by_one(r, width, height, groups, meta, meta_bits, cache_bits)


# ---------------------------------------------------------------------------------------------- transforms


def _bytes_of(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def _pixels_of(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b.astype(np.uint8)).view("<u4").reshape(b.shape[:-1]).astype(np.uint32)


def predictions(mode: int, left, top, top_left, top_right):
    """What a predictor mode foretells, on arrays or rows of (..., 4) numbers."""
    half = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        near_left = np.abs(top - top_left).sum(-1, keepdims=True) < np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(near_left, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        away = mean - top_left
        return np.clip(mean + np.where(away < 0, -(-away >> 1), away >> 1), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(left))  # 0 and the modes without a meaning


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w = pixels.shape
    rest = _bytes_of(pixels).astype(np.int32)
    out = np.zeros((h, w, 4), np.int32)
    out[0, 0] = (rest[0, 0] + (0, 0, 0, 255)) & 255
    out[0] = np.concatenate([out[:1, 0], rest[0, 1:]]).cumsum(0) & 255
    for y in range(1, h):
        above = out[y - 1]
        out[y, 0] = (rest[y, 0] + above[0]) & 255
        row = modes[y >> bits]
        x = 1
        while x < w:
            mode = int(row[x >> bits])
            end = x
            while end < w and int(row[end >> bits]) == mode:
                end = min(w, ((end >> bits) + 1) << bits)
            if mode == 1:
                out[y, x:end] = (np.concatenate([out[y, x - 1 : x], rest[y, x:end]]).cumsum(0) & 255)[1:]
            elif mode in (2, 3, 4, 8, 9, 0, 14, 15):
                # Right of the last pixel of the row above lies the first of this row.
                right = np.concatenate([above[1:], out[y, :1]])
                out[y, x:end] = (rest[y, x:end] + predictions(mode, above[x:end], above[x:end], above[x - 1 : end - 1], right[x:end])) & 255
            else:
                for i in range(x, end):
                    right = above[i + 1] if i + 1 < w else out[y, 0]
                    out[y, i] = (rest[y, i] + predictions(mode, out[y, i - 1], above[i], above[i - 1], right)) & 255
            x = end
    return _pixels_of(out)


def _residues(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w = pixels.shape
    b = _bytes_of(pixels).astype(np.int32)
    guess = np.zeros_like(b)
    guess[0, 0] = (0, 0, 0, 255)
    guess[0, 1:] = b[0, :-1]
    guess[1:, 0] = b[:-1, 0]
    if h > 1 and w > 1:
        right = np.concatenate([b[:-1, 1:], b[1:, :1]], 1)
        each = modes[np.arange(h) >> bits][:, np.arange(w) >> bits]
        for mode in np.unique(each):
            here = predictions(int(mode), b[1:, :-1], b[:-1, 1:], b[:-1, :-1], right[:, 1:])
            guess[1:, 1:] = np.where((each[1:, 1:] == mode)[..., None], here, guess[1:, 1:])
    return _pixels_of((b - guess) & 255)


def _cross(pixels: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    h, w = pixels.shape
    b = _bytes_of(pixels).astype(np.int32)
    e = _bytes_of(elements[np.arange(h) >> bits][:, np.arange(w) >> bits]).astype(np.int8).astype(np.int32)
    signed = lambda x: ((x & 255) ^ 128) - 128
    delta = lambda t, c: (t * signed(c)) >> 5
    green, red = b[..., 1], b[..., 2]
    new_red = (red + sign * delta(e[..., 0], green)) & 255
    real_red = new_red if sign > 0 else red
    blue = (b[..., 0] + sign * (delta(e[..., 1], green) + delta(e[..., 2], real_red))) & 255
    return _pixels_of(np.stack([blue, green, new_red, b[..., 3]], -1))


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    b = _bytes_of(pixels).astype(np.int32)
    b[..., 0] += sign * b[..., 1]
    b[..., 2] += sign * b[..., 1]
    return _pixels_of(b & 255)


def _packing(colours: int) -> int:
    """log2 of the palette indexes that share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    index = (pixels >> 8) & 255
    pack = _packing(len(palette))
    if pack:
        each = 8 >> pack
        index = ((index[..., None] >> (np.arange(1 << pack, dtype=np.uint32) * each)) & ((1 << each) - 1)).reshape(len(pixels), -1)[:, :width]
    full = np.zeros(256, np.uint32)  # indexes past the palette are transparent black
    full[: len(palette)] = palette
    return full[index]


# ---------------------------------------------------------------------------------------------- decoding


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width) of a lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Damaged("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise Damaged("no lossless image in the file")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1) // 2 * 2
    size = struct.unpack_from("<I", data, at + 4)[0]
    body = data[at + 8 : at + 8 + size]
    if len(body) < size or body[:1] != b"\x2f":
        raise Damaged("the image chunk is cut or has another signature")
    r = Reader(body, 8)
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise Damaged("a version that isn't known")
    undo, seen, inner = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise Damaged("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            blocks = _image(r, -(-inner >> bits), -(-height >> bits), False).reshape(-(-height >> bits), -1)
            undo.append((lambda p, b=blocks, n=bits: _undo_predictor(p, (b >> 8) & 15, n)) if kind == PREDICTOR else (lambda p, b=blocks, n=bits: _cross(p, b, n, 1)))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda p: _green(p, 1))
        else:
            n = r.read(8) + 1
            palette = _pixels_of(_bytes_of(_image(r, n, 1, False)).cumsum(0) & 255)
            undo.append(lambda p, t=palette, w=inner: _undo_palette(p, t, w))
            inner = -(-inner >> _packing(n))
    pixels = _image(r, inner, height, True).reshape(height, inner)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels


def split(data: bytes) -> list[bytes]:
    """The files of a row of WebP files; each says its own length."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF":
            raise Damaged("not a WebP file")
        n = 8 + struct.unpack_from("<I", data, at + 4)[0]
        out.append(data[at : at + n])
        at += n
    return out


# ---------------------------------------------------------------------------------------------- encoding


class Writer:
    """Values with their numbers of bits (32 at most), set in the stream all at once; single ones gather in a number first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.one = self.one_bits = 0

    def put(self, value: int, bits: int) -> None:
        self.one |= value << self.one_bits
        self.one_bits += bits

    def _flush(self) -> None:
        if self.one_bits:
            n = (self.one_bits + 31) // 32
            size = np.full(n, 32)
            size[-1] = self.one_bits - 32 * (n - 1)
            self.values.append(np.frombuffer(self.one.to_bytes(4 * n, "little"), "<u4").astype(np.uint64))
            self.sizes.append(size)
            self.one = self.one_bits = 0

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        values, sizes = values.astype(np.uint64, copy=False), sizes.astype(np.int64, copy=False)
        while len(values) > 64 and int(sizes.max()) <= 16:  # two and two, as long as they fit in 32 bits
            odd = len(values) & 1
            first = sizes[::2]
            both, size = values[::2].copy(), first.copy()
            both[: len(both) - odd] |= values[1::2] << first[: len(both) - odd].astype(np.uint64)
            size[: len(both) - odd] += sizes[1::2]
            values, sizes = both, size
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        self._flush()
        value, size = np.concatenate(self.values), np.concatenate(self.sizes)
        end = np.cumsum(size)
        at = end - size
        wide = value << (at & 31).astype(np.uint64)
        word, n = at >> 5, int(end[-1] + 31 >> 5) + 1
        # Bits of different values never overlap, so that sums are unions; below 2^32 they are exact as floats.
        low = np.bincount(word, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        high = np.bincount(word + 1, (wide >> np.uint64(32)).astype(np.float64), n + 1)[:n]
        return (low + high).astype("<u4").tobytes()[: int(end[-1] + 7 >> 3)]


def _put_code(w: Writer, lengths: list[int]) -> None:
    used = [k for k, n in enumerate(lengths) if n]
    if len(used) <= 2 and (not used or used[-1] < 256):
        first = used[0] if used else 0
        w.put(1 | int(len(used) == 2) << 1 | int(first > 1) << 2, 3)
        w.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    rows: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    seq, last = lengths[: used[-1] + 1], 8
    value, run = seq[0], 0
    for v in [*seq, -1]:
        if v == value:
            run += 1
            continue
        if value and value != last:
            rows.append((value, 0, 0))
            run, last = run - 1, value
        while run >= 3:
            now = min(run, 6 if value else 138)
            rows.append((16, now - 3, 2) if value else (18, now - 11, 7) if now >= 11 else (17, now - 3, 3))
            run -= now
        if run:
            rows += [(value, 0, 0)] * run
        value, run = v, 1
    counts = [0] * 19
    for r in rows:
        counts[r[0]] += 1
    meta, words = _small_code(counts, 7)
    sizes = meta if len(meta) - meta.count(0) > 1 else [0] * 19
    shown = max(4, max([k for k, s in enumerate(LENGTH_ORDER) if meta[s]]) + 1)
    bits, at = shown - 4 << 1, 5
    for s in LENGTH_ORDER[:shown]:
        bits |= meta[s] << at
        at += 3
    if len(seq) == len(lengths) or len(rows) < 2:
        at += 1
        if len(seq) < len(lengths):  # too few rows for a count of them: the rest is said to be 0
            raise AssertionError("a full code has two symbols at least")
    else:
        need = max(1, ((len(rows) - 2).bit_length() + 1) // 2)
        bits |= (1 | need - 1 << 1 | len(rows) - 2 << 4) << at
        at += 4 + 2 * need
    for s, extra, n in rows:
        bits |= (words[s] | extra << sizes[s]) << at
        at += sizes[s] + n
    w.put(bits, at)


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of lengths or distance codes."""
    v = values.astype(np.int64) - 1
    top = np.maximum(1, np.frexp(np.maximum(v, 1).astype(float))[1] - 1)
    n = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1))
    return symbol, np.where(n > 0, v & ((1 << n) - 1), 0), n


def matches(pixels: np.ndarray, least: int = 4, most: int = 4096) -> list[tuple[int, int, int]]:
    """(position, length, distance) of repeats, greedily from left to right, each of the last place with the same start."""
    n = len(pixels) - least + 1
    if n < 2:
        return []
    key = np.zeros(n, np.uint64)
    for k in range(least):
        key = (key ^ pixels[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    last = np.full(n, -1, np.int64)
    last[order[1:][same]] = order[:-1][same]
    starts = np.flatnonzero(last >= 0)
    out, at = [], 0
    while True:
        k = int(np.searchsorted(starts, at))
        if k == len(starts):
            return out
        at = int(starts[k])
        j, size, step = int(last[at]), 0, 64
        while size < most:
            end = min(most, size + step, len(pixels) - at)
            differ = np.flatnonzero(pixels[j + size : j + end] != pixels[at + size : at + end])
            if len(differ):
                size += int(differ[0])
                break
            if size == end:
                break
            size, step = end, 1024
        if size >= least:  # else two starts share a key
            out.append((at, size, at - j))
        at += max(size, 1)


@dataclass(frozen=True)
class Options:
    """What the encoder uses. predictor: a mode from 1 to 13, or a grid of them by block; cross: (green to red, green to blue, red to blue); least: pixels of a reference; groups: meta prefix blocks of so many bits."""

    palette: bool = False
    predictor: int | None = None
    cross: tuple[int, int, int] | None = None
    subtract_green: bool = False
    references: bool = False
    least: int = 4
    cache_bits: int = 0
    group_bits: int = 0
    block_bits: int = 3


def _put_literals(w: Writer, flat: np.ndarray) -> None:
    """Pixels of an image without references, cache and groups."""
    channels = []
    rest = flat & np.uint32(0xFFFF00FF)
    same = bool((rest == rest[0]).all())
    for k, shift in enumerate((8, 16, 0, 24)):
        if k and same:
            _put_single(w, int(flat[0] >> np.uint32(shift)) & 255)
            continue
        c = ((flat >> np.uint32(shift)) & np.uint32(255)).astype(np.int64)
        lengths = code_lengths(np.bincount(c, minlength=LITERALS if k else LITERALS + LENGTHS), 15)
        _put_code(w, lengths.tolist())
        if np.count_nonzero(lengths) > 1:
            channels.append((code_words(lengths).take(c), lengths.take(c)))
    _put_single(w, 0)
    if len(channels) == 1:
        w.put_all(*channels[0])
    elif channels:
        w.put_all(np.stack([c[0] for c in channels], 1).ravel(), np.stack([c[1] for c in channels], 1).ravel())


def _put_single(w: Writer, symbol: int) -> None:
    """A code of one symbol below 256."""
    w.put(1 | int(symbol > 1) << 2, 3)
    w.put(symbol, 8 if symbol > 1 else 1)


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    """The short code of each distance that has one."""
    return {max(1, x + y * width): c + 1 for c, (x, y) in reversed(list(enumerate(near_distances())))}


def _put_image(w: Writer, pixels: np.ndarray, main: bool, options: Options, repeats: list[tuple[int, int, int]] | None = None) -> None:
    height, width = pixels.shape
    flat = pixels.ravel()
    if not main or not (options.references or options.cache_bits or options.group_bits):
        w.put(0, 2 if main else 1)
        _put_literals(w, flat)
        return
    cache_bits = options.cache_bits if main else 0
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    block, group_of = None, np.zeros(len(flat), np.int64)
    if main:
        w.put(int(options.group_bits > 0), 1)
        if options.group_bits:
            bits = options.group_bits
            w.put(bits - 2, 3)
            rows, cols = -(-height >> bits), -(-width >> bits)
            block = (np.add.outer(np.arange(rows), np.arange(cols)) % 2).astype(np.uint32)
            _put_image(w, block << 8, False, Options())
            group_of = block[np.arange(height) >> bits][:, np.arange(width) >> bits].ravel().astype(np.int64)
    kind = np.zeros(len(flat), np.int8)  # 0 literal, 1 reference, 2 cached, -1 within a reference
    length, distance = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    if main and options.references:
        for at, n, d in matches(flat, options.least) if repeats is None else repeats:
            kind[at : at + n] = -1
            kind[at], length[at], distance[at] = 1, n, d
    slot = np.zeros(len(flat), np.int64)
    if cache_bits:
        slot = ((flat.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        slot = slot.astype(np.int64)
        order = np.argsort(slot, kind="stable")
        held = order[1:][(slot[order[1:]] == slot[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])]
        kind[held[kind[held] == 0]] = 2
    at = np.flatnonzero(kind >= 0)
    k, p, group = kind[at], flat[at].astype(np.int64), group_of[at]
    ls, le, ln = _prefix(np.maximum(length[at], 1))
    near, codes = _near_codes(width), distance[at] + 120
    refers = np.flatnonzero(k == 1)
    codes[refers] = [near.get(d, d + 120) for d in distance[at[refers]].tolist()]
    ds, de, dn = _prefix(np.maximum(codes, 1))
    symbol = np.where(k == 0, (p >> 8) & 255, np.where(k == 1, LITERALS + ls, LITERALS + LENGTHS + slot[at]))
    alphabet = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    groups = range(int(group_of.max()) + 1 if block is not None else 1)
    channels = ((p >> 16) & 255, p & 255, (p >> 24) & 255)
    tables = []
    for g in groups:
        mine = group == g if len(groups) > 1 else slice(None)
        literal, refer = k[mine] == 0, k[mine] == 1
        counts = [np.bincount(symbol[mine], minlength=alphabet), *[np.bincount(c[mine][literal], minlength=LITERALS) for c in channels], np.bincount(ds[mine][refer], minlength=DISTANCES)]
        lengths = [code_lengths(c, 15) for c in counts]
        for x in lengths:
            _put_code(w, x.tolist())
        tables.append([(code_words(x), x if np.count_nonzero(x) > 1 else np.zeros_like(x)) for x in lengths])
    pick = lambda which, s: (tables[0][which][0][s], tables[0][which][1][s]) if len(groups) == 1 else tuple(np.stack([t[which][i] for t in tables])[group, s] for i in (0, 1))
    columns = [pick(0, symbol)]
    some = (k == 0, k == 1)
    for which, c in enumerate(channels, 1):
        if any(t[which][1].any() for t in tables):
            v, n = pick(which, c)
            columns.append((np.where(some[0], v, 0), np.where(some[0], n, 0)))
    if some[1].any():
        for v, n in ((le, ln), pick(4, ds), (de, dn)):
            columns.append((np.where(some[1], v, 0), np.where(some[1], n, 0)))
    if len(columns) == 1:
        w.put_all(*columns[0])
    else:
        w.put_all(np.stack([c[0] for c in columns], 1).ravel(), np.stack([c[1] for c in columns], 1).ravel())


def encode(pixels: np.ndarray, options: Options = Options()) -> bytes:
    """A lossless WebP file of pixels (height, width)."""
    height, width = pixels.shape
    if not (0 < height <= MOST_SIDE and 0 < width <= MOST_SIDE):
        raise ValueError(f"an image has 1 to {MOST_SIDE} rows and columns")
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int((pixels >> 24 != 255).any()), 1)
    w.put(0, 3)
    if options.palette:
        palette, index = np.unique(pixels, return_inverse=True)
        index = index.reshape(pixels.shape)
        pixels = _put_palette(w, palette, index)
    grid = lambda value: np.full((-(-height >> options.block_bits), -(-pixels.shape[1] >> options.block_bits)), value, np.uint32)
    if options.subtract_green:
        w.put(1 | SUBTRACT_GREEN << 1, 3)
        pixels = _green(pixels, -1)
    if options.predictor is not None:
        modes = grid(options.predictor) if options.predictor > 0 else (np.arange(grid(0).size, dtype=np.uint32).reshape(grid(0).shape) % 14)
        w.put(1 | PREDICTOR << 1, 3)
        w.put(options.block_bits - 2, 3)
        _put_image(w, modes << 8 | np.uint32(0xFF000000), False, Options())
        pixels = _residues(pixels, modes, options.block_bits)
    if options.cross is not None:
        red, blue, both = (v & 255 for v in options.cross)
        elements = grid(0xFF000000 | both << 16 | blue << 8 | red)
        w.put(1 | CROSS_COLOUR << 1, 3)
        w.put(options.block_bits - 2, 3)
        _put_image(w, elements, False, Options())
        pixels = _cross(pixels, elements, options.block_bits, -1)
    return _finish(w, pixels, options)


def _put_palette(w: Writer, palette: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Writes the palette as differences; the image of indexes, several to a pixel where they are few."""
    w.put(1 | PALETTE << 1, 3)
    w.put(len(palette) - 1, 8)
    b = _bytes_of(palette).astype(np.int32)
    _put_image(w, _pixels_of(np.diff(b, axis=0, prepend=0) & 255)[None, :], False, Options())
    return _packed(index, len(palette))


def _packed(index: np.ndarray, colours: int) -> np.ndarray:
    pack = _packing(colours)
    if pack:
        each, pad = 8 >> pack, -index.shape[1] % (1 << pack)
        index = np.pad(index, ((0, 0), (0, pad))).reshape(index.shape[0], -1, 1 << pack)
        index = (index.astype(np.uint32) << (np.arange(1 << pack, dtype=np.uint32) * each)).sum(-1)
    return index.astype(np.uint32) << 8 | np.uint32(0xFF000000)


def _finish(w: Writer, pixels: np.ndarray, options: Options, repeats: list[tuple[int, int, int]] | None = None) -> bytes:
    w.put(0, 1)
    _put_image(w, pixels, True, options, repeats)
    return _file(w.bytes())


def _file(body: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


#: References are tried where a general compressor gets below this share of what single samples take.
REPETITIVE = 0.6
#: A repeat takes about as many bits as so many samples; sizes of the colour cache that are tried with references.
REPEAT, CACHES = 6, (0, 4)


def _bits(counts: np.ndarray) -> float:
    """Bits of symbols by their entropy."""
    some = counts[counts > 0]
    return float((some * (np.log2(some.sum()) - np.log2(some))).sum())


def _put_greens(w: Writer, values: list[int]) -> None:
    """The palette of samples, colours that differ in green alone, as ``_put_palette`` has it: differences in green and, in the first colour, alpha."""
    w.put(1 | PALETTE << 1 | len(values) - 1 << 3, 11)
    w.put(0, 1)
    steps, counts = [values[0], *[b - a for a, b in zip(values, values[1:], strict=False)]], [0] * (LITERALS + LENGTHS)
    for d in steps:
        counts[d] += 1
    sizes, words = _small_code(counts, 15)
    _put_code(w, sizes)
    _put_single(w, 0)
    _put_single(w, 0)
    if len(values) == 1:
        _put_single(w, 255)
        _put_single(w, 0)
        return
    w.put(0b011, 3)  # alpha: 0, a bit 0, and 255, a bit 1
    w.put(255 << 1, 9)
    _put_single(w, 0)
    if max(counts) == len(steps):  # a single step
        sizes[steps[0]] = 0
    for k, d in enumerate(steps):
        w.put(words[d] | int(k == 0) << sizes[d], sizes[d] + 1)


def encode_samples(samples: np.ndarray) -> bytes:
    """A file of 8-bit samples (height, width), the smallest of several.

    Always tried are a palette of the values that occur with indexes in prefix codes; in place of the palette the
    predictor of the sample to the left, if the differences say less than the samples; and with the palette references,
    without and with a colour cache, if the samples repeat themselves.
    """
    height, width = samples.shape
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    alone = _bits(counts)
    values = np.flatnonzero(counts)
    place = np.zeros(256, np.int64)
    place[values] = np.arange(len(values))

    head = Writer()
    head.put(0x2F | width - 1 << 8 | height - 1 << 22, 40)
    _put_greens(head, values.tolist())

    def begun() -> Writer:
        w = Writer()
        w.put(head.one, head.one_bits)
        return w

    def literals() -> bytes:
        """Prefix codes alone, of indexes that have a pixel each."""
        w = begun()
        w.put(0, 1 + 2)
        lengths = code_lengths(np.concatenate([counts[values], np.zeros(LITERALS + LENGTHS - len(values), np.int64)]), 15)
        _put_code(w, lengths.tolist())
        for v in (0, 0, 255, 0):
            _put_single(w, v)
        w.put_all(code_words(lengths).astype(np.uint64).take(place).take(flat), lengths.take(place).take(flat))
        return _file(w.bytes())

    repetitive = len(values) > 1 and 8 * len(zlib.compress(flat, 1)) < REPETITIVE * alone
    packed = _packed(place[samples], len(values)) if repetitive or _packing(len(values)) else None
    found = [_finish(begun(), packed, Options()) if _packing(len(values)) else literals()]
    if repetitive:
        repeats = matches(packed.ravel(), REPEAT)
        found += [_finish(begun(), packed, Options(references=True, least=REPEAT, cache_bits=n), repeats) for n in CACHES]
    if _bits(np.bincount(flat[1:] - flat[:-1], minlength=256)) < alone:
        found.append(encode(flat.reshape(height, width).astype(np.uint32) << 8 | np.uint32(0xFF000000), Options(predictor=1, block_bits=9)))
    return min(found, key=len)


def decode_samples(data: bytes) -> np.ndarray:
    return ((decode(data) >> 8) & 255).astype(np.uint8)
