"""Decoding of encoded pictures: format by magic bytes, guards in a fixed order, pixels, orientation.

PNG, BMP, GIF (first frame), JPEG (``jpeg``) and lossless WebP (``webp``) are decoded by the library. Pillow is used for JPEG
and WebP where it is installed; without it, lossy WebP gives UnsupportedFormat.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

from ..errors import ImageError
from ..schema import PreprocessConfig
from .jpeg import decode_jpeg
from .webp import chunks as webp_chunks
from .webp import decode_webp

try:
    from PIL import Image
except ImportError:
    Image = None

# Magic bytes of the formats.
_PNG = b"\x89PNG\r\n\x1a\n"


def sniff(data: bytes) -> str | None:
    """Format by the first bytes, whatever the file's name says."""
    if data.startswith(_PNG):
        return "PNG"
    if data.startswith(b"\xff\xd8\xff"):
        return "JPEG"
    if data.startswith((b"GIF87a", b"GIF89a")):
        return "GIF"
    if data.startswith(b"BM"):
        return "BMP"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "WebP"
    return None


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height by the header, without decoding; None if the header can't be read."""
    try:
        kind = sniff(data)
        if kind == "PNG":
            return struct.unpack(">II", data[16:24]) if data[12:16] == b"IHDR" else None
        if kind == "GIF":
            return struct.unpack("<HH", data[6:10])
        if kind == "BMP":
            (size,) = struct.unpack("<I", data[14:18])
            w, h = struct.unpack("<HH", data[18:22]) if size == 12 else struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if kind == "JPEG":
            return _jpeg_size(data)
        if kind == "WebP":
            return _webp_size(data)
    except (struct.error, IndexError):
        pass
    return None


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 if mark in (0x01, *range(0xD0, 0xD9)) else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _webp_size(data: bytes) -> tuple[int, int] | None:
    tag = data[12:16]
    if tag == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if tag == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if tag == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def check_size(width: int, height: int, config: PreprocessConfig, when: str = "") -> None:
    """Too large comes before too small."""
    note = f"{when} " if when else ""
    if width > config.max_dimension or height > config.max_dimension:
        raise ImageError("InvalidImage", f"{note}dimensions {width}x{height} exceed {config.max_dimension}x{config.max_dimension}")
    if width < config.min_dimension or height < config.min_dimension:
        raise ImageError("ImageTooSmall", f"{note}dimensions {width}x{height} are below {config.min_dimension}x{config.min_dimension}")


# ---------------------------------------------------------------- PNG

# Samples per pixel by PNG colour type, and the seven passes of interlacing (x, y, step x, step y).
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfilter(raw: bytes, rows: int, stride: int, step: int, band: int = 512) -> np.ndarray:
    """Undoes the row filters of one pass. Rows that depend on their left and upper neighbours at once are worked off along
    diagonals, all rows of a band together."""
    data = np.frombuffer(raw, np.uint8).reshape(rows, stride + 1)
    kinds, lines = data[:, 0], data[:, 1:]
    if int(kinds.max(initial=0)) > 4:
        raise ImageError("DecodeError", f"unknown PNG filter {int(kinds.max())}")
    out = np.zeros((rows + 1, stride), np.uint8)
    y = 0
    while y < rows:
        if kinds[y] <= 2:
            # rows of one kind together: those with a left filter don't depend on one another, those with an upper one add up
            n = int(np.argmax(np.r_[kinds[y:] != kinds[y], True]))
            given, done = lines[y : y + n], out[y + 1 : y + 1 + n]
            if kinds[y] == 1:
                steps = np.pad(given, ((0, 0), (0, -stride % step))).reshape(n, -1, step)
                done[:] = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(n, -1)[:, :stride]
            elif kinds[y] == 2:
                done[:] = given
                done[0] += out[y]
                np.cumsum(done, axis=0, dtype=np.uint8, out=done)
            else:
                done[:] = given
            y += n
            continue
        # to the last such row of the band, with the rows between
        mixed = np.flatnonzero(kinds[y : y + band] > 2)
        n = int(mixed[-1]) + 1
        out[y + 1 : y + 1 + n] = _diagonals(kinds[y : y + n], lines[y : y + n], out[y], step)
        y += n
    return out[1:]


def _diagonals(kinds: np.ndarray, lines: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Rows 1..n below ``above``, row 0. At time t row r has come to unit t - r, so its left neighbour is row r at t - 1, the
    upper one row r - 1 at t - 1, and the corner row r - 1 at t - 2: all in place, whatever the filters of the rows."""
    n, stride = lines.shape
    units = -(-stride // step)
    wide = lambda x: np.pad(x, ((0, 0), (0, units * step - stride))).reshape(len(x), units, step).astype(np.int16)
    given = wide(lines)
    past = np.zeros((units + n + 1, n + 1, step), np.int16)
    skewed = np.zeros((units + n + 1, n + 1, step), np.int16)
    t = np.arange(units)
    past[t, 0] = wide(above[None])[0]
    for r in range(1, n + 1):
        skewed[t + r, r] = given[r - 1]
    kind = kinds[:, None]
    some = set(kinds.tolist())
    for t in range(1, units + n):
        lo, hi = max(1, t - units + 1), min(n, t) + 1
        left, up = past[t - 1, lo:hi], past[t - 1, lo - 1 : hi - 1]
        of = kind[lo - 1 : hi - 1]
        if some == {3}:
            guess = left + up >> 1
        else:
            corner = past[t - 2, lo - 1 : hi - 1] if t > 1 else np.zeros_like(up)
            # nearest of the three to left + up - corner, ties in this order; without distances: an end, or the corner
            turn = corner * 3 - left - up
            low, high = np.minimum(left, up), np.maximum(left, up)
            guess = np.where(turn <= low, high, np.where(turn >= high, low, corner))
            if some != {4}:
                guess = np.where(of == 4, guess, np.where(of == 3, left + up >> 1, np.where(of == 2, up, np.where(of == 1, left, 0))))
        past[t, lo:hi] = (skewed[t, lo:hi] + guess) & 255
    t = np.arange(units)
    return np.stack([past[t + r, r] for r in range(1, n + 1)]).reshape(n, -1)[:, :stride].astype(np.uint8)


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    if depth == 8:
        return lines.reshape(len(lines), width, channels)
    if depth == 16:
        return lines.reshape(len(lines), width, channels, 2)[..., 0]
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :width, None]


def decode_png(data: bytes, limit: int) -> np.ndarray:
    at, header, palette, parts = 8, None, None, []
    while True:
        if at + 12 > len(data):
            raise ImageError("DecodeError", "unexpected end of PNG")
        (n,) = struct.unpack(">I", data[at : at + 4])
        tag, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise ImageError("DecodeError", "unexpected end of PNG")
        if zlib.crc32(tag + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ImageError("DecodeError", "PNG checksum mismatch")
        at += 12 + n
        if tag == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif tag == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif tag == b"IDAT":
            parts.append(body)
        elif tag == b"IEND":
            break
    if header is None:
        raise ImageError("DecodeError", "PNG without header")
    width, height, depth, colour, _, _, interlaced = header
    if colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16) or (colour == 3 and palette is None):
        raise ImageError("DecodeError", "bad PNG header")
    channels = _CHANNELS[colour]
    passes = _PASSES if interlaced else ((0, 0, 1, 1),)
    shapes = [(-(-(width - x) // sx) if width > x else 0, -(-(height - y) // sy) if height > y else 0) for x, y, sx, sy in passes]
    strides = [-(-w * channels * depth // 8) for w, _ in shapes]
    need = sum(h * (s + 1) for (w, h), s in zip(shapes, strides, strict=True) if w and h)
    if need > limit:
        raise ImageError("InvalidImage", "decoded size exceeds the limit")
    try:
        raw = zlib.decompressobj().decompress(b"".join(parts), need)
    except zlib.error as e:
        raise ImageError("DecodeError", f"PNG data: {e}") from None
    if len(raw) < need:
        raise ImageError("DecodeError", "PNG data ends early")
    out, start = np.zeros((height, width, channels), np.uint8), 0
    for (x, y, sx, sy), (w, h), stride in zip(passes, shapes, strides, strict=True):
        if w and h:
            size = h * (stride + 1)
            out[y::sy, x::sx] = _samples(_unfilter(raw[start : start + size], h, stride, max(1, channels * depth // 8)), w, channels, depth)
            start += size
    if colour == 3:
        if int(out.max(initial=0)) >= len(palette):
            raise ImageError("DecodeError", "PNG palette is too short")
        return palette[out[..., 0]]
    return out if depth >= 8 else out * np.uint8(255 // ((1 << depth) - 1))


# ---------------------------------------------------------------- BMP


def decode_bmp(data: bytes, limit: int) -> np.ndarray:
    try:
        (start,) = struct.unpack("<I", data[10:14])
        (size,) = struct.unpack("<I", data[14:18])
        if size == 12:
            w, h, _, bits = struct.unpack("<HHHH", data[18:26])
            packing, colours, entry = 0, 0, 3
        else:
            w, h, _, bits, packing = struct.unpack("<iiHHI", data[18:34])
            (colours,) = struct.unpack("<I", data[46:50])
            entry = 4
    except struct.error:
        raise ImageError("DecodeError", "unexpected end of BMP") from None
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32):
        raise ImageError("UnsupportedFormat", f"BMP of {bits} bits, packing {packing}")
    if w <= 0 or not h:
        raise ImageError("DecodeError", "BMP without pixels")
    rows, stride = abs(h), -(-w * bits // 32) * 4
    if w * rows * 3 > limit:
        raise ImageError("InvalidImage", "decoded size exceeds the limit")
    raw = np.frombuffer(data, np.uint8, count=-1)[start : start + rows * stride]
    if len(raw) < rows * stride:
        raise ImageError("DecodeError", "unexpected end of BMP")
    lines = raw.reshape(rows, stride)
    if bits <= 8:
        table = np.frombuffer(data[14 + size : 14 + size + (colours or 1 << bits) * entry], np.uint8).reshape(-1, entry)[:, 2::-1]
        index = _samples(lines, w, 1, bits)[..., 0]
        if int(index.max(initial=0)) >= len(table):
            raise ImageError("DecodeError", "BMP palette is too short")
        out = table[index]
    elif bits == 16:
        v = lines[:, : w * 2].copy().view("<u2").astype(np.uint32)
        masks = struct.unpack("<III", data[54:66]) if packing == 3 else (0x7C00, 0x03E0, 0x001F)
        out = np.stack([_masked(v, m) for m in masks], axis=-1)
    elif bits == 32 and packing == 3:
        v = lines[:, : w * 4].copy().view("<u4")
        out = np.stack([_masked(v, m) for m in struct.unpack("<III", data[54:66])], axis=-1)
    else:
        out = lines[:, : w * bits // 8].reshape(rows, w, bits // 8)[..., 2::-1]
    return np.ascontiguousarray(out[::-1] if h > 0 else out)


def _masked(v: np.ndarray, mask: int) -> np.ndarray:
    if not mask:
        return np.zeros(v.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    return (((v & mask) >> shift) * 255 // top).astype(np.uint8)


# ---------------------------------------------------------------- GIF


def decode_gif(data: bytes, limit: int) -> np.ndarray:
    """The first frame on the whole screen; what it doesn't cover is black."""
    try:
        w, h, flags = struct.unpack("<HHB", data[6:11])
        if w * h * 3 > limit:
            raise ImageError("InvalidImage", "decoded size exceeds the limit")
        at, table = 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            table = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
            at += 3 * n
        while data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
        if data[at] != 0x2C:
            raise ImageError("DecodeError", "GIF without a frame")
        x, y, fw, fh, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        if fw * fh * 3 > limit:
            raise ImageError("InvalidImage", "decoded size exceeds the limit")
        at += 10
        if flags & 0x80:
            n = 2 << (flags & 7)
            table = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
            at += 3 * n
        bits, packed = data[at], []
        at += 1
        while data[at]:
            packed.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
    except (IndexError, struct.error, ValueError):
        raise ImageError("DecodeError", "unexpected end of GIF") from None
    if table is None:
        raise ImageError("DecodeError", "GIF without colours")
    index = _lzw(b"".join(packed), bits, fw * fh)
    frame = np.frombuffer(index, np.uint8).reshape(fh, fw)
    if flags & 0x40:  # interlaced: every eighth row, then those between
        order = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
        straight = np.empty_like(frame)
        straight[order] = frame
        frame = straight
    if int(frame.max(initial=0)) >= len(table):
        raise ImageError("DecodeError", "GIF palette is too short")
    out = np.zeros((h, w, 3), np.uint8)
    out[y : y + fh, x : x + fw] = table[frame][: max(0, h - y), : max(0, w - x)]
    return out


def _lzw(data: bytes, bits: int, need: int) -> bytes:
    if not 2 <= bits <= 11:
        raise ImageError("DecodeError", "bad GIF code size")
    clear, end = 1 << bits, (1 << bits) + 1
    words = [bytes((i,)) for i in range(clear)] + [b"", b""]
    width, before, out, size = bits + 1, None, [], 0
    hold = held = 0
    for byte in data:
        hold |= byte << held
        held += 8
        while held >= width:
            code = hold & ((1 << width) - 1)
            hold >>= width
            held -= width
            if code == clear:
                del words[end + 1 :]
                width, before = bits + 1, None
                continue
            if code == end or size >= need:
                break
            if code < len(words):
                word = words[code]
            elif before is not None and code == len(words):
                word = before + before[:1]
            else:
                raise ImageError("DecodeError", "bad GIF code")
            out.append(word)
            size += len(word)
            if before is not None and len(words) < 4096:
                words.append(before + word[:1])
                if len(words) == 1 << width and width < 12:
                    width += 1
            before = word
    joined = b"".join(out)[:need]
    if len(joined) < need:
        raise ImageError("DecodeError", "GIF data ends early")
    return joined


# ---------------------------------------------------------------- orientation


def orientation(data: bytes) -> int:
    """EXIF orientation 1..8 of the primary picture; 1 where there is none or it can't be read."""
    try:
        kind = sniff(data)
        if kind == "JPEG":
            at = 2
            while data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
                (n,) = struct.unpack(">H", data[at + 2 : at + 4])
                if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    return _tiff_orientation(data[at + 10 : at + 2 + n])
                at += 2 + n
        elif kind == "PNG":
            at = 8
            while (tag := data[at + 4 : at + 8]) and tag != b"IEND":
                (n,) = struct.unpack(">I", data[at : at + 4])
                if tag == b"eXIf":
                    return _tiff_orientation(data[at + 8 : at + 8 + n])
                at += 12 + n
        elif kind == "WebP":
            for tag, body in webp_chunks(data):
                if tag == b"EXIF":
                    return _tiff_orientation(body.removeprefix(b"Exif\0\0"))
    except (IndexError, struct.error):
        pass
    return 1


def _tiff_orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return 1
    (start,) = struct.unpack(order + "I", tiff[4:8])
    (count,) = struct.unpack(order + "H", tiff[start : start + 2])
    for i in range(count):
        tag, kind = struct.unpack(order + "HH", tiff[start + 2 + 12 * i : start + 6 + 12 * i])
        if tag == 0x0112:
            value = struct.unpack(order + ("H" if kind == 3 else "I"), tiff[start + 10 + 12 * i :][: 2 if kind == 3 else 4])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def oriented(pixels: np.ndarray, how: int) -> np.ndarray:
    """The picture as it should be looked at."""
    match how:
        case 2:
            return pixels[:, ::-1]
        case 3:
            return pixels[::-1, ::-1]
        case 4:
            return pixels[::-1]
        case 5:
            return pixels.swapaxes(0, 1)
        case 6:
            return np.rot90(pixels, -1)
        case 7:
            return np.rot90(pixels, 2).swapaxes(0, 1)
        case 8:
            return np.rot90(pixels, 1)
    return pixels


# ---------------------------------------------------------------- all of it


def decode_pixels(data: bytes, config: PreprocessConfig) -> np.ndarray:
    """Pixels of encoded bytes, without guards on their size but that of the decoded picture."""
    limit = config.max_dimension * config.max_dimension * 4
    kind = sniff(data)
    if kind is None:
        raise ImageError("UnsupportedFormat", "the format isn't known")
    if kind == "JPEG" and Image is None:
        return decode_jpeg(data, limit)
    if kind == "WebP" and Image is None:
        return decode_webp(data, limit)
    if kind in ("JPEG", "WebP"):
        try:
            with Image.open(io.BytesIO(data)) as picture:
                return np.asarray(picture.convert("RGB"))
        except Exception as e:  # noqa: BLE001
            raise ImageError("DecodeError", str(e)) from None
    if kind == "PNG":
        return decode_png(data, limit)
    return decode_bmp(data, limit) if kind == "BMP" else decode_gif(data, limit)


def decode(data: bytes, config: PreprocessConfig | None = None) -> np.ndarray:
    """Pixels of encoded bytes, or an ImageError of the first check that fails: empty, limits of the configuration, byte
    cap, size by the header, format, pixels, decoded size, size after orientation."""
    config = config or PreprocessConfig()
    if not data:
        raise ImageError("InvalidImage", "empty input")
    if config.min_dimension > config.max_dimension:
        raise ImageError("InvalidImage", f"min_dimension {config.min_dimension} exceeds max_dimension {config.max_dimension}")
    if len(data) > config.max_input_bytes:
        raise ImageError("InvalidImage", f"{len(data)} bytes exceed {config.max_input_bytes}")
    if size := header_size(data):
        check_size(*size, config)
    try:
        pixels = decode_pixels(data, config)
    except (ValueError, IndexError, KeyError, struct.error, MemoryError) as e:
        raise ImageError("DecodeError", str(e)) from None
    check_size(pixels.shape[1], pixels.shape[0], config)
    pixels = oriented(pixels, orientation(data))
    check_size(pixels.shape[1], pixels.shape[0], config, "post-orientation")
    return pixels
