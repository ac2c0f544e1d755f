"""Lossless WebP pictures, from the published description of the bitstream. Lossy ones aren't decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from ..errors import ImageError

# Fixed values of the format: order in which lengths of length codes come, and the near pixels, as (left, up), that the first
# 120 distance codes stand for.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_CACHE_FACTOR = 0x1E35A7BD


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(tag, body) of the chunks of a WebP file, those of its first animated frame included."""
    at = 12
    while at + 8 <= len(data):
        tag, (n,) = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])
        if tag == b"ANMF":
            at += 24  # its own chunks follow
            continue
        yield tag, data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def decode_webp(data: bytes, limit: int) -> np.ndarray:
    """(h, w, 4) pixels of a lossless file."""
    for tag, body in chunks(data):
        if tag == b"VP8L":
            return _Stream(body).picture(limit)
        if tag == b"VP8 ":
            raise ImageError("UnsupportedFormat", "lossy WebP isn't decoded")
    raise ImageError("DecodeError", "WebP without a picture")


class _Stream:
    """Bits of a lossless picture, the least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0
        self.end = len(data) * 8

    def bits(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ImageError("DecodeError", "unexpected end of WebP")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << n) - 1)

    def picture(self, limit: int) -> np.ndarray:
        if self.bits(8) != 0x2F:
            raise ImageError("DecodeError", "bad signature of a lossless WebP")
        width, height = self.bits(14) + 1, self.bits(14) + 1
        alpha = self.bits(1)
        if self.bits(3):
            raise ImageError("DecodeError", "unknown version of a lossless WebP")
        if width * height * 4 > limit:
            raise ImageError("InvalidImage", "decoded size exceeds the limit")
        undo, seen, w = [], set(), width
        while self.bits(1):
            kind = self.bits(2)
            if kind in seen:
                raise ImageError("DecodeError", "a WebP transform comes twice")
            seen.add(kind)
            if kind in (0, 1):
                size = self.bits(3) + 2
                blocks = self.argb(-(-w >> size), -(-height >> size), False)
                undo.append((_predicted if kind == 0 else _recoloured, w, (size, blocks)))
            elif kind == 2:
                undo.append((_with_green, w, None))
            else:
                n = self.bits(8) + 1
                steps = self.argb(n, 1, False).view(np.uint8).reshape(n, 4)
                table = np.cumsum(steps, axis=0, dtype=np.uint8).view(np.uint32).ravel()
                packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                undo.append((_looked_up, w, (packed, table)))
                w = -(-w >> packed)
        pixels = self.argb(w, height, True)
        for how, wide, given in reversed(undo):
            pixels = how(pixels, wide, given)
        out = pixels.view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]
        if not alpha:
            out[..., 3] = 255
        return out

    def argb(self, width: int, height: int, main: bool) -> np.ndarray:
        """(height, width) pixels as 32-bit numbers, before transforms are undone."""
        cache_bits = self.bits(4) if self.bits(1) else 0
        if cache_bits > 11:
            raise ImageError("DecodeError", "bad colour cache of a WebP")
        which, shift = None, 0
        count = 1
        if main and self.bits(1):
            shift = self.bits(3) + 2
            which = (self.argb(-(-width >> shift), -(-height >> shift), False) >> 8) & 0xFFFF
            count = int(which.max()) + 1
            which = which.tolist()
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        codes = [[self.code(n) for n in sizes] for _ in range(count)]
        return self.coded(width, height, codes, which, shift, cache_bits)

    def coded(self, width: int, height: int, codes: list, which: list | None, shift: int, cache_bits: int) -> np.ndarray:
        total = width * height
        out = [0] * total
        cache = [0] * (1 << cache_bits) if cache_bits else None
        turn = 32 - cache_bits
        symbol, done = self.symbol, 0
        green, red, blue, alpha, far = codes[0]
        cached = 0  # pixels that are in the cache
        while done < total:
            if which is not None:
                y, x = divmod(done, width)
                green, red, blue, alpha, far = codes[which[y >> shift][x >> shift]]
            s = symbol(green)
            if s < 256:
                r = symbol(red)
                b = symbol(blue)
                out[done] = symbol(alpha) << 24 | r << 16 | s << 8 | b
                done += 1
            elif s < 280:
                n, code = self.number(s - 256), self.number(symbol(far))
                if code > 120:
                    back = code - 120
                else:
                    left, up = _NEAR[code - 1]
                    back = max(1, left + up * width)
                if back > done or done + n > total:
                    raise ImageError("DecodeError", "a WebP copy leaves the picture")
                for k in range(done, done + n):
                    out[k] = out[k - back]
                done += n
            else:
                if cache is None or s - 280 >= len(cache):
                    raise ImageError("DecodeError", "bad WebP code")
                for k in range(cached, done):
                    cache[(_CACHE_FACTOR * out[k] & 0xFFFFFFFF) >> turn] = out[k]
                cached = done
                out[done] = cache[s - 280]
                done += 1
        return np.array(out, np.uint32).reshape(height, width)

    def number(self, code: int) -> int:
        """A length or distance with its extra bits."""
        if code < 4:
            return code + 1
        extra = (code - 2) >> 1
        return ((2 + (code & 1)) << extra) + self.bits(extra) + 1

    def symbol(self, code: tuple[int, list]) -> int:
        longest, table = code
        at = self.at
        n, value = table[int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << longest) - 1)]
        self.at = at + n
        if self.at > self.end:
            raise ImageError("DecodeError", "unexpected end of WebP")
        return value

    def code(self, n: int) -> tuple[int, list]:
        """A prefix code over ``n`` symbols: its longest length, and (length, symbol) for each string of so many bits."""
        if self.bits(1):
            two, long = self.bits(1), self.bits(1)
            names = [self.bits(8 if long else 1)]
            if two:
                names.append(self.bits(8))
            if max(names) >= n:
                raise ImageError("DecodeError", "bad WebP code")
            return (0, [(0, names[0])]) if len(names) == 1 else (1, [(1, names[0]), (1, names[1])])
        lengths = [0] * 19
        for k in range(4 + self.bits(4)):
            lengths[_LENGTH_ORDER[k]] = self.bits(3)
        code = _table(lengths)
        left = 2 + self.bits(2 + 2 * self.bits(3)) if self.bits(1) else n
        found: list[int] = []
        before = 8
        while len(found) < n and left:
            left -= 1
            s = self.symbol(code)
            if s < 16:
                found.append(s)
                before = s or before
            else:
                value, times = (before, 3 + self.bits(2)) if s == 16 else (0, 3 + self.bits(3)) if s == 17 else (0, 11 + self.bits(7))
                found += [value] * times
        if len(found) > n:
            raise ImageError("DecodeError", "bad WebP code lengths")
        return _table(found)


def _table(lengths: list[int]) -> tuple[int, list]:
    """Canonical prefix code of the lengths; bits come in reverse."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if not used:
        raise ImageError("DecodeError", "empty WebP code")
    if len(used) == 1:
        return 0, [(0, used[0][1])]
    longest = max(used)[0]
    if sum(1 << (longest - n) for n, _ in used) != 1 << longest:
        raise ImageError("DecodeError", "incomplete WebP code")
    table: list = [None] * (1 << longest)
    code = before = 0
    for n, s in sorted(used):
        code <<= n - before
        before = n
        turned = int(format(code, f"0{n}b")[::-1], 2)
        table[turned :: 1 << n] = [(n, s)] * (1 << (longest - n))
        code += 1
    return longest, table


# ---------------------------------------------------------------- transforms, undone


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(h, w, 4) bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)


def _spread(blocks: np.ndarray, size: int, width: int, height: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << size, axis=0)[:height], 1 << size, axis=1)[:, :width]


def _with_green(pixels: np.ndarray, width: int, given: None) -> np.ndarray:
    c = _channels(pixels).copy()
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return c.view(np.uint32)[..., 0]


def _recoloured(pixels: np.ndarray, width: int, given: tuple[int, np.ndarray]) -> np.ndarray:
    size, blocks = given
    c = _channels(pixels).copy()
    t = _channels(_spread(blocks, size, width, len(pixels))).view(np.int8).astype(np.int32)
    signed = lambda x: x.view(np.int8).astype(np.int32)
    green = signed(np.ascontiguousarray(c[..., 1]))
    c[..., 2] += (t[..., 0] * green >> 5).astype(np.uint8)
    c[..., 0] += ((t[..., 1] * green >> 5) + (t[..., 2] * signed(np.ascontiguousarray(c[..., 2])) >> 5)).astype(np.uint8)
    return c.view(np.uint32)[..., 0]


def _looked_up(pixels: np.ndarray, width: int, given: tuple[int, np.ndarray]) -> np.ndarray:
    packed, table = given
    index = _channels(pixels)[..., 1].astype(np.int64)
    if packed:
        bits = 8 >> packed
        index = (index[..., None] >> (np.arange(1 << packed) * bits) & ((1 << bits) - 1)).reshape(len(pixels), -1)[:, :width]
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole[index]


def _predicted(pixels: np.ndarray, width: int, given: tuple[int, np.ndarray]) -> np.ndarray:
    """Adds the predictions. At time t = x + 2 y the pixels to the left, above and above to the right are done, so all rows
    are worked off together along these diagonals."""
    size, blocks = given
    height = len(pixels)
    modes = _channels(_spread(blocks, size, width, height))[..., 1] & 15
    rest = _channels(pixels).astype(np.int16)
    out = np.zeros((height, width, 4), np.int16)
    black = np.array([0, 0, 0, 255], np.int16)
    for t in range(width + 2 * (height - 1)):
        y = np.arange(max(0, -(-(t - width + 1) // 2)), min(height - 1, t // 2) + 1)
        if not len(y):
            continue
        x = t - 2 * y
        left = out[y, np.maximum(x - 1, 0)]
        top = out[np.maximum(y - 1, 0), x]
        corner = out[np.maximum(y - 1, 0), np.maximum(x - 1, 0)]
        # right of the last column memory goes on with the first pixel of the row itself
        last = x == width - 1
        right = out[np.where(last, y, np.maximum(y - 1, 0)), np.where(last, 0, np.minimum(x + 1, width - 1))]
        mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, modes[y, x]))
        guess = np.empty_like(left)
        for m in np.unique(mode):
            at = mode == m
            guess[at] = _guess(int(m), left[at], top[at], corner[at], right[at], black)
        out[y, x] = (rest[y, x] + guess) & 255
    return np.ascontiguousarray(out.astype(np.uint8)).view(np.uint32)[..., 0]


def _guess(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray, black: np.ndarray) -> np.ndarray:
    mean = lambda a, b: a + b >> 1
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return mean(mean(left, right), top)
        case 6:
            return mean(left, corner)
        case 7:
            return mean(left, top)
        case 8:
            return mean(corner, top)
        case 9:
            return mean(top, right)
        case 10:
            return mean(mean(left, corner), mean(top, right))
        case 11:
            nearer = np.abs(top - corner).sum(axis=1) < np.abs(left - corner).sum(axis=1)
            return np.where(nearer[:, None], left, top)
        case 12:
            return np.clip(left + top - corner, 0, 255)
        case 13:
            a = mean(left, top)
            step = a - corner
            return np.clip(a + (step + (step < 0) >> 1), 0, 255)
    return np.broadcast_to(black, left.shape)
