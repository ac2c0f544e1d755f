import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelweft.errors import ImageError
from pixelweft.operators import decode
from pixelweft.operators.exact import blake3
from pixelweft.schema import PreprocessConfig

from . import pictures
from .pictures import bmp, exif_block, gif, gradient, png


def kind(data, config=None):
    try:
        decode.decode(data, config)
    except ImageError as e:
        return e.kind
    return None


@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(channels, interlace):
    rng = np.random.default_rng(channels)
    pixels = rng.integers(0, 256, (37, 45, channels), dtype=np.uint8)
    assert (decode.decode(png(pixels, interlace=interlace, filters=(0, 1, 2, 3, 4))).reshape(pixels.shape) == pixels).all()
    assert (decode.decode(png(pixels, depth=16, interlace=interlace)).reshape(pixels.shape) == pixels).all()


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_small_depths_and_palette(depth):
    rng = np.random.default_rng(depth)
    index = rng.integers(0, 1 << depth, (33, 41), dtype=np.uint8)
    palette = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
    assert (decode.decode(png(index, depth=depth, palette=palette)) == palette[index]).all()
    assert (decode.decode(png(index, depth=depth))[..., 0] == index * (255 // ((1 << depth) - 1))).all()


def test_bmp_and_gif():
    rgb = gradient(45, 37)
    for bits in (24, 32):
        for top_down in (False, True):
            assert (decode.decode(bmp(rgb, bits, top_down)) == rgb).all()
    rng = np.random.default_rng(0)
    palette = rng.integers(0, 256, (16, 3), dtype=np.uint8)
    index = rng.integers(0, 16, (50, 40), dtype=np.uint8)
    for interlace in (False, True):
        assert (decode.decode(gif(index, palette, interlace)) == palette[index]).all()


def test_guards_in_order():
    good = png(gradient(100, 100))
    assert kind(good) is None
    assert kind(b"") == "InvalidImage"
    assert kind(b"", PreprocessConfig(min_dimension=9, max_dimension=8)) == "InvalidImage"
    assert kind(good, PreprocessConfig(min_dimension=9, max_dimension=8)) == "InvalidImage"
    assert kind(good, PreprocessConfig(max_input_bytes=10)) == "InvalidImage"
    assert kind(good, PreprocessConfig(max_input_bytes=len(good))) is None
    assert kind(png(np.zeros((100, 31)))) == "ImageTooSmall"
    assert kind(png(np.zeros((31, 31))), PreprocessConfig(min_dimension=16)) is None
    assert kind(png(np.zeros((10, 8193), np.uint8))) == "InvalidImage"  # too large is said before too small
    assert kind(b"not an image") == "UnsupportedFormat"
    assert kind(b"\x89PNG\r\n\x1a\n" + bytes(100)) in ("DecodeError", "InvalidImage")
    assert kind(good[:-30]) == "DecodeError"
    assert kind(good[:60] + b"\x01" + good[61:]) == "DecodeError"


def test_orientation():
    rgb = gradient(60, 40)
    for how in range(1, 9):
        got = decode.decode(png(rgb, exif=how))
        want = {1: rgb, 2: rgb[:, ::-1], 3: rgb[::-1, ::-1], 4: rgb[::-1], 5: rgb.transpose(1, 0, 2), 6: np.rot90(rgb, -1), 7: rgb[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(rgb)}[how]
        assert (got == want).all()
    assert decode.orientation(png(rgb, exif=9)) == 1 and decode.orientation(b"x") == 1
    for order in "<>":
        segment = b"Exif\0\0" + exif_block(6, order)
        jpeg = b"\xff\xd8\xff\xe1" + (len(segment) + 2).to_bytes(2, "big") + segment + b"\xff\xda"
        assert decode.orientation(jpeg) == 6


def test_sizes_by_header():
    assert decode.header_size(png(np.zeros((33, 44)))) == (44, 33)
    assert decode.header_size(bmp(gradient(44, 33), top_down=True)) == (44, 33)
    assert decode.header_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x21\0\x2c\x03") == (44, 33)
    assert decode.header_size(b"RIFF....WEBPVP8X........" + (43).to_bytes(3, "little") + (32).to_bytes(3, "little")) == (44, 33)
    assert decode.header_size(b"GIF89a") is None


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.sampled_from([b"", b"\x89PNG\r\n\x1a\n", b"BM", b"GIF89a", b"\xff\xd8\xff", b"RIFF1234WEBP"]))
def test_any_bytes_give_pixels_or_an_error(data, magic):
    kind(magic + data)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2000), st.binary(min_size=1, max_size=4))
def test_damaged_pictures_give_pixels_or_an_error(at, patch):
    for whole in (png(gradient(40, 40)), bmp(gradient(40, 40)), gif(np.zeros((40, 40), np.uint8), np.zeros((4, 3), np.uint8))):
        i = at % len(whole)
        kind(whole[:i] + patch + whole[i + len(patch) :])


def test_blake3_vectors():
    # published vectors: input bytes 0, 1, …, 250, 0, …
    data = bytes(i % 251 for i in range(31744))
    for n, start in ((0, "af1349b9f5f9a1a6a0404dea36dcc949"), (1, "2d3adedff11b61f14c886e35afa03673"), (1023, "10108970eeda3eb932baac1428c7a216"), (1024, "42214739f095a406f3fc83deb889744a"), (1025, "d00278ae47eb27b34faecf67b4fe263f"), (2048, "e776b6028c7cd22a4d0ba182a8bf6220"), (2049, "5f4d72f40d7a5f82b15ca2b2e44b1de3"), (3072, "b98cb0ff3623be03326b373de6b90952"), (31744, "62b6960e1a44bcc1eb1a611a8d6235b6")):
        assert blake3(data[:n]).hex()[:32] == start


def jpeg(spark, rgb, progressive):
    """Encoded by the JVM."""
    jvm = spark.sparkContext._jvm
    h, w = rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 5 if rgb.ndim == 3 else 10)
    values = spark.sparkContext._gateway.new_array(jvm.int, rgb.size)
    for i, v in enumerate(rgb.ravel().tolist()):
        values[i] = v
    image.getRaster().setPixels(0, 0, w, h, values)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1 if progressive else 0)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.flush()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg(spark, tmp_path, progressive):
    y, x = np.mgrid[0:45, 0:61]
    colour = np.stack([x * 4 % 256, y * 5 % 256, (x + y) * 2 % 256], -1).astype(np.uint8)
    blocks = np.kron(np.random.default_rng(0).integers(0, 256, (6, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    for i, rgb in enumerate((colour, colour[..., 0], blocks)):
        data = jpeg(spark, rgb, progressive)
        got = decode.decode(data).astype(int)
        (tmp_path / f"{i}.jpg").write_bytes(data)
        r = spark.read.format("image").load(f"file://{tmp_path}/{i}.jpg").select("image.*").first()
        want = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])[..., ::-1].astype(int)
        assert got.shape[:2] == rgb.shape[:2] and np.abs(got - want).mean() < 1.5 and np.abs(got - want).max() < 40
        for cut in (20, len(data) // 3):
            assert kind(data[:cut]) is not None or cut > 200
        assert kind(data[: len(data) // 2] + b"\xff\xd9") in (None, "DecodeError")


LOSSLESS_1X1 = "UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="


@pytest.mark.parametrize("transforms", [(), ("green",), ("predict",), ("recolour",), ("predict", "recolour", "green"), ("green", "predict")])
def test_webp_lossless(transforms):
    rng = np.random.default_rng(3)
    smooth = (np.cumsum(rng.integers(-3, 4, (37, 41, 4)), axis=1) + 128).astype(np.uint8)
    for rgba in (smooth, rng.integers(0, 256, (9, 5, 4), dtype=np.uint8)):
        got = decode.decode_webp(pictures.webp(rgba, transforms), 1 << 24)
        assert (got == rgba).all()


@pytest.mark.parametrize("colours", [2, 4, 16, 200])
def test_webp_palette(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    rgba = table[rng.integers(0, colours, (21, 19))]
    assert (decode.decode_webp(pictures.webp(rgba, ("palette",)), 1 << 24) == rgba).all()
    assert (decode.decode_webp(pictures.webp(rgba, ("palette", "predict")), 1 << 24) == rgba).all()


def test_webp_copies_and_cache():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 256, (6, 50, 4), dtype=np.uint8)[:, rng.integers(0, 9, 50)]
    rgba = np.repeat(rows, 5, axis=0)
    assert (decode.decode_webp(pictures.webp(rgba, (), False, 9), 1 << 24) == rgba).all()
    assert (decode.decode_webp(pictures.webp(rgba, ("green",), True, 10), 1 << 24) == rgba).all()


def test_webp_as_a_picture():
    import base64

    rgba = np.concatenate([pictures.gradient(40, 36), np.full((36, 40, 1), 255, np.uint8)], axis=2)
    data = pictures.webp(rgba, ("green",), exif=6)
    assert decode.sniff(data) == "WebP" and decode.header_size(data) == (40, 36)
    assert decode.decode(data).shape[:2] == (40, 36)  # turned
    assert decode.decode_webp(base64.b64decode(LOSSLESS_1X1), 100).shape == (1, 1, 4)
    for bad, kind in ((data[:40], "DecodeError"), (data.replace(b"VP8L", b"VP8 "), "UnsupportedFormat"), (data[:30] + b"\xff" * 200, "DecodeError")):
        with pytest.raises(ImageError) as e:
            decode.decode(bad)
        assert e.value.kind == kind


def test_limits_hold_for_all_formats():
    small = PreprocessConfig(max_dimension=64, min_dimension=1)
    # sizes in the header within the cap, decoded size not
    assert decode.decode(pictures.bmp(pictures.gradient(64, 64)), small).shape[:2] == (64, 64)
    for data in (pictures.bmp(pictures.gradient(80, 80)), pictures.gif(np.zeros((80, 80), int), np.zeros((4, 3)))):
        with pytest.raises(ImageError) as e:
            decode.decode_pixels(data, PreprocessConfig(max_dimension=40))
        assert e.value.kind == "InvalidImage"


def test_orientation_is_read_from_its_chunk_only():
    rgb = pictures.gradient(40, 36)
    inside = pictures.png(rgb)
    hidden = inside[:-12] + inside[-12:] + b"eXIf" + pictures.exif_block(6)  # after the end
    assert decode.orientation(hidden) == 1 and decode.orientation(pictures.png(rgb, exif=6)) == 6


def test_blake3_of_many_is_that_of_each(monkeypatch):
    from pixelweft.operators import exact

    rng = np.random.default_rng(6)
    data = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3073, 5000, 8192, 31744, 102400)]
    alone = [exact.blake3(d) for d in data]
    assert exact.blake3_many(data) == alone and exact.blake3_many([]) == []
    monkeypatch.setattr(exact, "LANES", 7)
    assert exact.blake3_many(data) == alone and [exact.blake3(d) for d in data] == alone
