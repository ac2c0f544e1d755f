"""JPEG in numpy: baseline and progressive Huffman pictures of 8 bits, grey, YCbCr, RGB and CMYK.

Coefficients are read bit by bit in Python, everything after that is vectorised. About a megapixel takes a second or two; where
Pillow is installed it is used instead.
"""

from __future__ import annotations

import struct

import numpy as np

from ..errors import ImageError


def _zigzag() -> np.ndarray:
    """Place in an 8 x 8 block of each coefficient: along the diagonals, up and down in turn."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


_PLACE = _zigzag()
_BASIS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


class _Bits:
    """Bits of one stretch of coded data, without stuffed bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.held = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.held < n:
            piece = self.data[self.at : self.at + 6]
            self.at += 6
            if not piece and self.at > len(self.data) + 64:
                raise ImageError("DecodeError", "JPEG data ends early")
            piece = piece.ljust(6, b"\0")
            self.hold = (self.hold & ((1 << self.held) - 1)) << 48 | int.from_bytes(piece, "big")
            self.held += 48

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.held -= n
        return self.hold >> self.held & ((1 << n) - 1)

    def symbol(self, table: list[tuple[int, int]]) -> int:
        self.need(16)
        size, value = table[self.hold >> (self.held - 16) & 0xFFFF]
        if not size:
            raise ImageError("DecodeError", "bad JPEG code")
        self.held -= size
        return value

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def _table(counts: bytes, values: bytes) -> list[tuple[int, int]]:
    """Of each 16 bits the length and value of the code they start with."""
    out: list[tuple[int, int]] = []
    k = 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            if k >= len(values):
                raise ImageError("DecodeError", "bad JPEG table")
            out += [(size, values[k])] * (1 << (16 - size))
            k += 1
    if len(out) > 65536:
        raise ImageError("DecodeError", "bad JPEG table")
    return out + [(0, 0)] * (65536 - len(out))


class _Part:
    """One component: sampling, tables and its coefficients."""

    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant
        self.dc = self.ac = 0
        self.last = 0


class _Picture:
    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.parts: list[_Part] = []
        self.restart, self.adobe, self.progressive = 0, None, False
        self.width = self.height = 0

    def frame(self, body: bytes, progressive: bool) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or n not in (1, 3, 4) or not self.width or not self.height:
            raise ImageError("UnsupportedFormat", "JPEG of this kind isn't decoded")
        self.progressive = progressive
        self.parts = [_Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if any(not 1 <= p.h <= 4 or not 1 <= p.v <= 4 for p in self.parts):
            raise ImageError("DecodeError", "bad JPEG sampling")
        self.hmax, self.vmax = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for p in self.parts:
            p.wide, p.high = self.across * p.h, self.down * p.v
            p.own_wide = -(-(-(-self.width * p.h // self.hmax)) // 8)
            p.own_high = -(-(-(-self.height * p.v // self.vmax)) // 8)
            p.blocks = [None] * (p.wide * p.high)

    def scan(self, body: bytes, stretches: list[bytes]) -> None:
        n = body[0]
        parts = []
        for i in range(n):
            part = next((p for p in self.parts if p.ident == body[1 + 2 * i]), None)
            if part is None:
                raise ImageError("DecodeError", "bad JPEG scan")
            part.dc, part.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            parts.append(part)
        first, last, packed = body[1 + 2 * n : 4 + 2 * n]
        high, low = packed >> 4, packed & 15
        if n == 1:
            p = parts[0]
            units = [[(p, y * p.wide + x)] for y in range(p.own_high) for x in range(p.own_wide)]
        else:
            units = [[(p, (my * p.v + v) * p.wide + mx * p.h + h) for p in parts for v in range(p.v) for h in range(p.h)] for my in range(self.down) for mx in range(self.across)]
        step = self.restart or len(units)
        for k, data in enumerate(stretches):
            bits = _Bits(data)
            for p in parts:
                p.last = 0
            self.run = 0
            for unit in units[k * step : (k + 1) * step]:
                for p, at in unit:
                    block = p.blocks[at]
                    if block is None:
                        block = p.blocks[at] = [0] * 64
                    if not self.progressive:
                        self.baseline(bits, p, block)
                    elif first == 0:
                        self.progressive_dc(bits, p, block, high, low)
                    elif high == 0:
                        self.progressive_ac(bits, p, block, first, last, low)
                    else:
                        self.refine_ac(bits, p, block, first, last, low)

    def codes(self, kind: int, number: int) -> list[tuple[int, int]]:
        if (kind, number) not in self.huffman:
            raise ImageError("DecodeError", "JPEG lacks a table")
        return self.huffman[kind, number]

    def baseline(self, bits: _Bits, p: _Part, block: list[int]) -> None:
        p.last += bits.signed(bits.symbol(self.codes(0, p.dc)))
        block[0] = p.last
        table, k = self.codes(1, p.ac), 1
        while k < 64:
            v = bits.symbol(table)
            run, size = v >> 4, v & 15
            if not size:
                if run != 15:
                    return
                k += 16
                continue
            k += run
            if k > 63:
                raise ImageError("DecodeError", "bad JPEG block")
            block[k] = bits.signed(size)
            k += 1

    def progressive_dc(self, bits: _Bits, p: _Part, block: list[int], high: int, low: int) -> None:
        if high:
            block[0] |= bits.take(1) << low
        else:
            p.last += bits.signed(bits.symbol(self.codes(0, p.dc)))
            block[0] = p.last << low

    def progressive_ac(self, bits: _Bits, p: _Part, block: list[int], k: int, last: int, low: int) -> None:
        if self.run:
            self.run -= 1
            return
        table = self.codes(1, p.ac)
        while k <= last:
            v = bits.symbol(table)
            run, size = v >> 4, v & 15
            if size:
                k += run
                if k > 63:
                    raise ImageError("DecodeError", "bad JPEG block")
                block[k] = bits.signed(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                self.run = (1 << run) + bits.take(run) - 1
                return

    def refine_ac(self, bits: _Bits, p: _Part, block: list[int], k: int, last: int, low: int) -> None:
        one = 1 << low

        def correct(i: int) -> None:
            if bits.take(1) and not abs(block[i]) & one:
                block[i] += one if block[i] > 0 else -one

        if not self.run:
            table = self.codes(1, p.ac)
            while k <= last:
                v = bits.symbol(table)
                run, size = v >> 4, v & 15
                new = 0
                if size:
                    new = one if bits.take(1) else -one
                elif run != 15:
                    self.run = (1 << run) + bits.take(run)
                    break
                while k <= last:
                    if block[k]:
                        correct(k)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if new and k <= last:
                    block[k] = new
                k += 1
        if self.run:
            while k <= last:
                if block[k]:
                    correct(k)
                k += 1
            self.run -= 1

    def pixels(self) -> np.ndarray:
        planes = []
        for p in self.parts:
            if p.quant not in self.quant:
                raise ImageError("DecodeError", "JPEG lacks a quantisation table")
            zero = [0] * 64
            flat = np.array([zero if b is None else b for b in p.blocks], np.float64)
            c = np.empty_like(flat)
            c[:, _PLACE] = flat * self.quant[p.quant]
            spatial = np.einsum("xu,nuv,yv->nxy", _BASIS, c.reshape(-1, 8, 8), _BASIS, optimize=True) + 128
            plane = spatial.reshape(p.high, p.wide, 8, 8).transpose(0, 2, 1, 3).reshape(p.high * 8, p.wide * 8)
            plane = np.clip(np.rint(plane), 0, 255)
            own_h, own_w = -(-self.height * p.v // self.vmax), -(-self.width * p.h // self.hmax)
            planes.append(_enlarged(plane[:own_h, :own_w], self.vmax // p.v, self.hmax // p.h)[: self.height, : self.width])
        return _colours(planes, self.adobe, [p.ident for p in self.parts])


def _enlarged(x: np.ndarray, down: int, across: int) -> np.ndarray:
    """Samples spread over the pixels they stand for, blended with their neighbours."""
    for axis, n in ((0, down), (1, across)):
        if n > 1:
            size = x.shape[axis]
            at = np.clip((np.arange(size * n) + 0.5) / n - 0.5, 0, size - 1)
            lo = at.astype(int)
            hi = np.minimum(lo + 1, size - 1)
            w = (at - lo).reshape((-1, 1) if axis == 0 else (1, -1))
            x = np.take(x, lo, axis) * (1 - w) + np.take(x, hi, axis) * w
    return x


def _colours(planes: list[np.ndarray], adobe: int | None, idents: list[int]) -> np.ndarray:
    if len(planes) == 1:
        return planes[0].astype(np.uint8)[..., None]
    a, b, c = planes[:3]
    if adobe in (1, 2) or (adobe is None and len(planes) == 3 and idents != [82, 71, 66]):
        # YCbCr to RGB of the JFIF definition.
        a, b, c = a + 1.402 * (c - 128), a - 0.344136 * (b - 128) - 0.714136 * (c - 128), a + 1.772 * (b - 128)
    rgb = np.clip(np.rint(np.stack([a, b, c], axis=-1)), 0, 255)
    if len(planes) == 4:  # inks are stored inverted by the programs that write them
        rgb = np.rint(rgb * planes[3][..., None] / 255)
    return rgb.astype(np.uint8)


def decode_jpeg(data: bytes, limit: int) -> np.ndarray:
    picture, at, done = _Picture(), 2, False
    try:
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ImageError("DecodeError", "bad JPEG marker")
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
                continue
            if mark == 0xD9:
                break
            if 0xD0 <= mark <= 0xD8 or mark == 0x01:
                at += 2
                continue
            (n,) = struct.unpack(">H", data[at + 2 : at + 4])
            body = data[at + 4 : at + 2 + n]
            if len(body) != n - 2:
                raise ImageError("DecodeError", "unexpected end of JPEG")
            at += 2 + n
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    size = 128 if wide else 64
                    picture.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.float64)
                    if len(picture.quant[body[0] & 15]) != 64:
                        raise ImageError("DecodeError", "bad JPEG table")
                    body = body[1 + size :]
            elif mark == 0xC4:
                while body:
                    count = sum(body[1:17])
                    picture.huffman[body[0] >> 4, body[0] & 15] = _table(body[1:17], body[17 : 17 + count])
                    body = body[17 + count :]
            elif mark in (0xC0, 0xC1, 0xC2):
                if picture.parts:
                    raise ImageError("DecodeError", "JPEG with two frames")
                picture.frame(body, mark == 0xC2)
                if picture.width * picture.height * 4 > limit:
                    raise ImageError("InvalidImage", "decoded size exceeds the limit")
            elif 0xC3 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
                raise ImageError("UnsupportedFormat", "JPEG of this kind isn't decoded")
            elif mark == 0xDD:
                (picture.restart,) = struct.unpack(">H", body[:2])
            elif mark == 0xEE and body[:5] == b"Adobe":
                picture.adobe = body[11]
            elif mark == 0xDA:
                if not picture.parts:
                    raise ImageError("DecodeError", "JPEG without a frame")
                end = start = at
                stretches = []
                while True:  # to the next marker that isn't a restart; a zero after 0xFF is stuffing
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        end = len(data)
                        break
                    if data[end + 1] == 0:
                        end += 2
                    elif 0xD0 <= data[end + 1] <= 0xD7:
                        stretches.append(data[start:end].replace(b"\xff\0", b"\xff"))
                        end = start = end + 2
                    elif data[end + 1] == 0xFF:
                        end += 1
                    else:
                        break
                stretches.append(data[start:end].replace(b"\xff\0", b"\xff"))
                picture.scan(body, stretches)
                done, at = True, end
    except (IndexError, struct.error, ValueError) as e:
        raise ImageError("DecodeError", f"JPEG: {e}") from None
    if not done:
        raise ImageError("DecodeError", "JPEG without picture data")
    return picture.pixels()
