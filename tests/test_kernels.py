import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweft.functions import hashing
from pixelweft.operators import kernels

from .pictures import gradient

ONES = -1  # all 64 bits


def flat(v, n=32):
    return np.full((n, n), v, np.float32)


def test_regions():
    grey = np.arange(65536, dtype=np.uint32).reshape(256, 256).astype(np.uint8)
    grey[100:150] += 7
    centre = kernels.global_region(grey)
    assert (centre == grey[112:144, 112:144].astype(np.float32) * np.float32(1 / 255)).all()
    blocks = kernels.block_grid(grey)
    for k in range(16):
        y, x = k // 4 * 64, k % 4 * 64
        assert (blocks[k] == grey[y : y + 64, x : x + 64].astype(np.float32) * np.float32(1 / 255)).all()


def test_resampling():
    x = np.random.default_rng(0).random((32, 32), dtype=np.float32)
    assert (kernels.bilinear(x, 32, 32) == x).all()
    assert (kernels.bilinear(x, 8, 8) == x[::4, ::4]).all()  # plain decimation
    assert [t[0] for t in hashing.taps(32, 9)] == [0, 3, 7, 10, 14, 17, 21, 24, 28]
    with pytest.raises(ValueError):
        kernels.bilinear(x, 0, 8)
    assert kernels.box_halved(np.arange(16, dtype=np.float32).reshape(4, 4)).tolist() == [[2.5, 4.5], [10.5, 12.5]]


def test_normalise():
    rgb = gradient(300, 300)
    assert kernels.normalise(rgb).shape == (256, 256)
    same = gradient(256, 256)
    assert (kernels.normalise(same) == kernels.luma(same)).all()
    constant = np.full((90, 123, 3), (100, 150, 200), np.uint8)
    assert (kernels.normalise(constant) == (77 * 100 + 150 * 150 + 29 * 200) >> 8).all()
    alpha = np.dstack([same, np.full((256, 256), 3, np.uint8)])
    assert (kernels.normalise(alpha) == kernels.normalise(same)).all()  # dropped, not blended
    grey = same[..., 0]
    assert (kernels.to_rgb(grey) == np.repeat(grey[..., None], 3, axis=2)).all()
    for size in (32, 255, 257, 1000):
        assert np.allclose(kernels.lanczos_weights(size, 256).sum(axis=1), 1, atol=1e-5)


def test_flat_and_ramp_hashes():
    for v in (0.0, 0.5, 1.0):
        assert kernels.ahash(flat(v)) == ONES and kernels.dhash(flat(v)) == 0
        assert kernels.ahash(flat(v, 64)) == ONES and kernels.dhash(flat(v, 64)) == 0
        assert kernels.phash(flat(v)) != 0
    ramp = np.tile(np.arange(32, dtype=np.float32) / 31, (32, 1))
    assert kernels.dhash(ramp) == 0 and kernels.ahash(ramp) != 0
    assert kernels.dhash(ramp[:, ::-1]) == ONES
    checker = np.indices((32, 32)).sum(axis=0) // 3 % 2
    assert all(h(checker.astype(np.float32)) != 0 for h in kernels.HASHES.values())
    assert kernels.median_bits(np.full(64, 0.3, np.float32)) == ONES
    assert int(kernels.mean_bits(np.r_[np.zeros(32), np.ones(32)].astype(np.float32))) == 2**32 - 1


def test_not_a_number():
    for bad in (np.nan, np.inf):
        x = flat(0.5)
        x[0, 0] = bad
        assert kernels.phash(x) == 0
    c = np.arange(64, dtype=np.float32)
    c[5] = np.nan
    assert int(kernels.median_bits(c)) >> 58 & 1 == 0


def test_dct_matches_its_definition():
    x = np.random.default_rng(1).random((5, 32)).astype(np.float32)
    n = np.arange(32)
    basis = np.cos(np.pi * (2 * n[None] + 1) * np.arange(8)[:, None] / 64)
    assert np.allclose(kernels.dct_low(x), x @ basis.T * 2 / 32, atol=1e-5)
    assert (kernels.dct_low(flat(0.7))[:, 1:] == 0).all()


def test_phash_of_smooth_pictures_by_definition():
    rng = np.random.default_rng(2)
    basis = np.cos(np.pi * (2 * np.arange(32)[None] + 1) * np.arange(8)[:, None] / 64)
    for _ in range(20):
        x = rng.random((32, 32)).astype(np.float32)
        c = (basis @ x @ basis.T / 256).ravel()
        m = np.sort(c)[32]
        assert int(kernels.phash(x)) & (2**64 - 1) == int("".join("1" if v >= m else "0" for v in c), 2)


def test_native_stages_equal_the_kernels(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.random(64, dtype=np.float32)]) for i in range(40)]
    rows += [(100 + g, [float(np.float32(g) * np.float32(1 / 255))] * 64) for g in range(0, 256, 3)]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    got = {r["i"]: (r["mean"], r["median"]) for r in df.select("i", hashing.mean_threshold(F.col("v")).alias("mean"), hashing.median_threshold(F.col("v")).alias("median")).collect()}
    for i, v in rows:
        x = np.array(v, np.float32)
        assert got[i] == (int(kernels.mean_bits(x)), int(kernels.median_bits(x)))
    # the 32-bit mean of a flat picture rounds: some grey levels give no bit at all
    assert {0, -1} <= {got[i][0] for i, _ in rows if i >= 100}
    nan = spark.createDataFrame([([float("nan")] * 40 + [1.0] * 24,), ([float("nan")] + [1.0] * 63,)], "v array<float>")
    assert [r[0] for r in nan.select(hashing.median_threshold(F.col("v"))).collect()] == [0, 2**63 - 1]


def test_native_gradient_and_box(spark):
    x = np.random.default_rng(4).random((64, 64), dtype=np.float32)
    df = spark.createDataFrame([([float(v) for v in x.ravel()],)], "v array<float>")
    assert np.array_equal(np.array(df.select(hashing.box_halved(F.col("v"))).first()[0], np.float32), kernels.box_halved(x).ravel())
    at = lambda y, c: F.get(F.col("v"), F.lit(y * 64 + c))
    grid = df.select(F.array(*hashing.bilinear(at, 64, 9, 8)).alias("g"))
    assert np.array_equal(np.array(grid.first()[0], np.float32), kernels.bilinear(x, 9, 8).ravel())
    assert grid.select(hashing.gradient(F.col("g"))).first()[0] == int(kernels.dhash(x))


def test_luma_is_the_same_everywhere(spark):
    rgb = np.random.default_rng(5).integers(0, 256, (300, 3), dtype=np.uint8)
    df = spark.createDataFrame([tuple(map(int, r)) for r in rgb], "r int, g int, b int")
    assert [r[0] for r in df.select(hashing.luma(F.col("r"), F.col("g"), F.col("b"))).collect()] == kernels.luma(rgb).tolist()
