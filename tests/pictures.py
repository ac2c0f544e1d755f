"""Encoders for test pictures: PNG, BMP and GIF bytes of numpy pixels."""

import struct
import zlib

import numpy as np


def png(pixels, depth=8, interlace=False, filters=(0,), palette=None, exif=None):
    pixels = np.asarray(pixels)
    if pixels.ndim == 2:
        pixels = pixels[..., None]
    h, w, c = pixels.shape
    colour = 3 if palette is not None else {1: 0, 2: 4, 3: 2, 4: 6}[c]

    def lines(p):
        step = max(1, c * depth // 8)
        out, above = [], None
        for y in range(p.shape[0]):
            if depth == 8:
                raw = p[y].astype(np.uint8).tobytes()
            elif depth == 16:
                raw = (p[y].astype(">u2") * 257).tobytes()
            else:
                bits = np.unpackbits(p[y].astype(np.uint8).reshape(-1, 1), axis=1)[:, 8 - depth :]
                raw = np.packbits(bits.ravel()).tobytes()
            above = above or bytes(len(raw))
            kind = filters[y % len(filters)]
            got = bytearray()
            for i, b in enumerate(raw):
                left = raw[i - step] if i >= step else 0
                up = above[i]
                corner = above[i - step] if i >= step else 0
                if kind == 4:
                    g = left + up - corner
                    guess = min((abs(g - left), 0, left), (abs(g - up), 1, up), (abs(g - corner), 2, corner))[2]
                else:
                    guess = (0, left, up, (left + up) // 2)[kind]
                got.append((b - guess) & 255)
            out.append(bytes([kind]) + bytes(got))
            above = raw
        return b"".join(out)

    if interlace:
        data = b"".join(lines(pixels[y::sy, x::sx]) for x, y, sx, sy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)) if pixels[y::sy, x::sx].size)
    else:
        data = lines(pixels)

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlace)))
    if exif is not None:
        out += chunk(b"eXIf", exif_block(exif))
    if palette is not None:
        out += chunk(b"PLTE", np.asarray(palette, np.uint8).tobytes())
    return out + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def exif_block(orientation, order="<"):
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHH", 8, 1, 0x0112, 3, 1, orientation, 0)


def bmp(rgb, bits=24, top_down=False):
    h, w, _ = rgb.shape
    rows = rgb if top_down else rgb[::-1]
    extra = np.zeros((h, w, 1), np.uint8) if bits == 32 else np.zeros((h, w, 0), np.uint8)
    body = b"".join(r.tobytes().ljust(-(-w * bits // 32) * 4, b"\0") for r in np.concatenate([rows[..., ::-1], extra], axis=2))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, bits, 0, len(body), 0, 0, 0, 0) + body


def gif(index, palette, interlace=False):
    """Uncompressed codes: a clear code before the table grows."""
    h, w = index.shape
    bits = max(2, int(np.ceil(np.log2(len(palette)))))
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(palette)] = palette
    if interlace:
        index = index[[*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]]
    clear, codes = 1 << bits, []
    for i, v in enumerate(index.ravel().tolist()):
        if i % ((1 << bits) - 2 or 1) == 0:
            codes.append(clear)
        codes.append(v)
    codes.append(clear + 1)
    text = 0
    for i, c in enumerate(codes):
        text |= c << (i * (bits + 1))
    data = text.to_bytes(-(-len(codes) * (bits + 1) // 8), "little")
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | (bits - 1), 0, 0) + table.tobytes() + b"!\xf9\x04\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0x40 if interlace else 0) + bytes([bits]) + blocks + b"\0;"


class Bits:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value, n):
        self.value |= int(value) << self.n
        self.n += n

    def bytes(self):
        return self.value.to_bytes(-(-self.n // 8), "little")


def _flat_code(out, n):
    """A code of 8 bits for each of the first 256 of n symbols."""
    out.put(0, 1)
    out.put(12 - 4, 4)  # lengths of 17, 18, 0 .. 8 and 16 in their order: only 8 and 18 are used
    for s in (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8):
        out.put(1 if s in (8, 18) else 0, 3)
    out.put(0, 1)
    for _ in range(256):
        out.put(0, 1)
    left = n - 256
    while left:  # zeros, eleven or more at a time
        times = left if left < 139 else min(128, left)
        out.put(1, 1)
        out.put(times - 11, 7)
        left -= times


def _turned(v):
    return int(f"{int(v):08b}"[::-1], 2)


def _coded(out, argb, main=False, copies=False, cache_bits=0):
    """Pixels by literals; with ``copies`` rows that repeat the one above are one copy, with a cache known colours by it."""
    h, w = argb.shape
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    size = 280 + (1 << cache_bits if cache_bits else 0)
    if copies or cache_bits:  # nine bits for each of 512 symbols, or all that there are
        out.put(0, 1)
        out.put(13 - 4, 4)
        for s in (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9):
            out.put(1 if s in (9, 18) else 0, 3)
        out.put(0, 1)
        assert size >= 512
        for _ in range(512):
            out.put(0, 1)
        left = size - 512
        while left:
            times = min(128, left)
            out.put(1, 1)
            out.put(times - 11, 7)
            left -= times
    else:
        _flat_code(out, size)
    for _ in range(3):
        _flat_code(out, 256)
    for bit in (1, 0, 0, 0):  # distances: the only code is that of the pixel above
        out.put(bit, 1)
    wide = copies or cache_bits
    green = lambda s: out.put(int(f"{s:09b}"[::-1], 2), 9) if wide else out.put(_turned(s), 8)
    cache = [None] * (1 << cache_bits) if cache_bits else None
    for y in range(h):
        if copies and y and w >= 4 and (argb[y] == argb[y - 1]).all():
            code, extra = (w - 1, 0) if w <= 4 else next((c, e) for c in range(4, 24) for e in [w - 1 - ((2 + (c & 1)) << ((c - 2) >> 1))] if 0 <= e < 1 << ((c - 2) >> 1))
            green(256 + code)
            if code >= 4:
                out.put(extra, (code - 2) >> 1)
            if cache is not None:
                for v in argb[y].tolist():
                    cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
            continue
        for v in argb[y].tolist():
            slot = (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache is not None and cache[slot] == v and 280 + slot < 512:
                green(280 + slot)
            else:
                green(v >> 8 & 255)
                out.put(_turned(v >> 16 & 255), 8)
                out.put(_turned(v & 255), 8)
                out.put(_turned(v >> 24), 8)
            if cache is not None:
                cache[slot] = v


def _predict(c, y, x, mode):
    get = lambda j, i: c[j, i].astype(int)
    h, w, _ = c.shape
    if y == 0 and x == 0:
        return np.array([0, 0, 0, 255])
    if y == 0:
        return get(0, x - 1)
    if x == 0:
        return get(y - 1, 0)
    left, top, corner = get(y, x - 1), get(y - 1, x), get(y - 1, x - 1)
    right = get(y - 1, x + 1) if x + 1 < w else get(y, 0)
    half = lambda a, b: (a + b) // 2
    if mode == 11:
        p = left + top - corner
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = half(left, top)
        return np.clip(a + np.trunc((a - corner) / 2).astype(int), 0, 255)
    return [np.array([0, 0, 0, 255]), left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right), half(half(left, corner), half(top, right))][mode]


def webp(rgba, transforms=(), copies=False, cache_bits=0, exif=None, seed=0):
    """A lossless WebP file. ``transforms``, in their order in the file, of "predict", "recolour", "green", "palette"."""
    rng = np.random.default_rng(seed)
    h, w, _ = rgba.shape
    out = Bits()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    c = np.ascontiguousarray(rgba[..., [2, 1, 0, 3]]).astype(np.uint8)  # blue, green, red, alpha
    number = lambda c: np.ascontiguousarray(c.astype(np.uint8)).view(np.uint32)[..., 0]
    for t in transforms:
        out.put(1, 1)
        if t == "green":
            out.put(2, 2)
            c = c.copy()
            c[..., 0] -= c[..., 1]
            c[..., 2] -= c[..., 1]
        elif t == "palette":
            out.put(3, 2)
            colours, index = np.unique(number(c).ravel(), return_inverse=True)
            out.put(len(colours) - 1, 8)
            table = np.ascontiguousarray(colours.astype(np.uint32)).view(np.uint8).reshape(-1, 4)
            _coded(out, number(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))[None]))
            packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index = np.pad(index.reshape(h, w), ((0, 0), (0, -w % (1 << packed))))
            wide = index.reshape(h, -1, 1 << packed) << (np.arange(1 << packed) * (8 >> packed))
            c = np.zeros((h, wide.shape[1], 4), np.uint8)
            c[..., 1] = wide.sum(axis=2)
            c[..., 3] = 255
        else:
            size = 2
            blocks = np.zeros((-(-c.shape[0] // 4), -(-c.shape[1] // 4), 4), np.uint8)
            out.put(0 if t == "predict" else 1, 2)
            out.put(size - 2, 3)
            if t == "predict":
                blocks[..., 1] = rng.integers(0, 14, blocks.shape[:2])
                rest = np.zeros_like(c)
                for y in range(c.shape[0]):
                    for x in range(c.shape[1]):
                        rest[y, x] = (c[y, x].astype(int) - _predict(c, y, x, int(blocks[y // 4, x // 4, 1]))) & 255
                c, after = rest, blocks
            else:
                blocks[..., :3] = rng.integers(0, 256, (*blocks.shape[:2], 3))
                signed = lambda v: v.astype(np.int8).astype(int)
                m = signed(np.repeat(np.repeat(blocks, 4, axis=0), 4, axis=1)[: c.shape[0], : c.shape[1]])
                green, red = signed(c[..., 1]), signed(c[..., 2])
                d = c.astype(int)
                d[..., 0] -= (m[..., 1] * green >> 5) + (m[..., 2] * red >> 5)
                d[..., 2] -= m[..., 0] * green >> 5
                c, after = (d & 255).astype(np.uint8), blocks
            _coded(out, number(after))
    out.put(0, 1)
    _coded(out, number(c), True, copies, cache_bits)
    body = out.bytes()
    part = lambda tag, b: tag + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1)
    parts = part(b"VP8L", body)
    if exif is not None:
        parts = part(b"VP8X", bytes([8, 0, 0, 0]) + struct.pack("<I", w - 1)[:3] + struct.pack("<I", h - 1)[:3]) + parts + part(b"EXIF", exif_block(exif))
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WEBP" + parts


def gradient(w, h, blue=None):
    x, y = np.arange(w)[None] % 256, np.arange(h)[:, None] % 256
    x, y = np.broadcast_to(x, (h, w)), np.broadcast_to(y, (h, w))
    return np.stack([x, y, (x + y) % 256 if blue is None else np.full((h, w), blue)], axis=-1).astype(np.uint8)
