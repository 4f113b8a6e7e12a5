"""Filters, resampling, fits and surfaces against plain NumPy."""

import numpy as np
import pytest

from stimulake.errors import InvalidParameterError
from stimulake.operators import gaussians, images, scalp, series, surfaces


def frame(spark, x, start=0, channel="a"):
    return spark.createDataFrame([(channel, start + i, float(v)) for i, v in enumerate(x)], "channel string, at long, value double").repartition(3)


def values(df):
    return {(r["channel"], r["at"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("pad", ["zero", "reflect"])
def test_filter_equals_a_whole_convolution_over_block_edges(spark, pad):
    rng = np.random.default_rng(1)
    taps = series.band_taps(0.05, 0.2, 0.1)
    h = len(taps) // 2
    for n, start, size in ((500, -37, 40), (500, 123456, 1 << 14), (9, 5, 3)):
        x = np.cumsum(rng.normal(size=n))
        out = [np.concatenate([[x[0] * 2 - x[i] if i < n else 0.0 for i in range(h, 0, -1)], x, [2 * x[-1] - x[-1 - i] if i < n else 0.0 for i in range(1, h + 1)]]), np.pad(x, h)][pad == "zero"]
        expect = np.convolve(out, taps, "valid")
        got = values(series.filtered(frame(spark, x, start), ["channel"], "at", "value", taps, pad, size))
        assert len(got) == n and np.allclose([got["a", start + i] for i in range(n)], expect, atol=1e-9)


def test_filter_edges(spark):
    taps = series.band_taps(None, 0.2, 0.3)
    assert np.isclose(taps.sum(), 1) and np.isclose(series.band_taps(0.1, None, 0.2).sum(), 0)
    rows = [("a", 0, 1.0), ("a", 50, None), ("a", None, 3.0), (None, 7, 2.0)]
    df = spark.createDataFrame(rows, "channel string, at long, value double")
    got = values(series.filtered(df, ["channel"], "at", "value", taps, "zero", 8))
    assert set(got) == {("a", 0), ("a", 50), (None, 7)} and np.isclose(got["a", 0], taps[len(taps) // 2]) and np.isclose(got["a", 50], 0)
    assert series.filtered(df.limit(0), ["channel"], "at", "value", taps).count() == 0
    for bad in ((0.3, 0.2, 0.1), (None, 0.6, 0.1), (0.1, None, 0)):
        with pytest.raises(InvalidParameterError):
            series.band_taps(*bad)


@pytest.mark.parametrize("up,down", [(2, 5), (3, 1), (7, 4), (1, 1)])
def test_resampling_equals_fourier_away_from_the_ends(spark, up, down):
    n = 2000 // down * down
    t = np.arange(n)
    rate = min(1, up / down)
    wave = lambda t: sum(np.sin(2 * np.pi * f * rate / 2 * t + p) for f, p in ((0.1, 1), (0.45, 2), (0.85, 0.3)))
    got = values(series.resampled(frame(spark, wave(t), 1000 * up * down), ["channel"], "at", "value", up, down, size=300))
    j = np.arange(0, (n - 1) * up // down + 1)
    assert sorted(k[1] for k in got) == (j + 1000 * up * up).tolist()
    out = np.array([got["a", i + 1000 * up * up] for i in j])
    away = slice(int(96 * max(1, up / down)), -int(96 * max(1, up / down)))
    assert np.abs(out - wave(j * down / up))[away].max() < 1e-4 * 3


def test_resampled_edges(spark):
    df = frame(spark, [1.0, 2.0, 4.0])
    assert len(values(series.resampled(df, ["channel"], "at", "value", 2, 1))) == 5
    assert series.resampled(df.limit(0), ["channel"], "at", "value", 2, 1).count() == 0
    with pytest.raises(InvalidParameterError):
        series.resampled(df, ["channel"], "at", "value", 0, 1)


GX, GY = (a.ravel() for a in np.meshgrid(np.linspace(-0.5, 0.5, 11), np.linspace(-0.5, 0.5, 9)[::-1]))


def test_gaussian_slopes():
    p = np.array([[0.3, 0.1, -0.2, -1.5, -1.1, 0.4, 0.2]])
    _, slope = gaussians.surface(p, GX, GY)
    steps = 1e-6 * np.eye(7)
    plain = np.stack([(gaussians.surface(p + s, GX, GY)[0] - gaussians.surface(p - s, GX, GY)[0]) / 2e-6 for s in steps], axis=-1)
    assert np.allclose(slope, plain, atol=1e-7)


def test_gaussian_fits(spark):
    rng = np.random.default_rng(2)
    n = 40
    planted = np.column_stack([rng.uniform(-0.5, 1, n), rng.uniform(-0.3, 0.3, n), rng.uniform(-0.3, 0.3, n), np.log(rng.uniform(0.1, 0.2, n)), np.log(rng.uniform(0.22, 0.35, n)), rng.uniform(-1, 1, n), rng.uniform(-0.2, 0.2, n)])
    clean = gaussians.surface(planted, GX, GY)[0]
    noisy = clean + 0.02 * rng.normal(size=clean.shape)
    rows = [(i, z.tolist()) for i, z in enumerate(np.vstack([clean, noisy]))] + [(200, None), (201, [1.0] * 5), (202, [3.0] * 99), (203, [None] + [1.0] * 98), (None, clean[0].tolist())]
    got = {r["k"]: r for r in gaussians.fit_maps(spark.createDataFrame(rows, "k long, z array<double>").repartition(3), ["k"], "z", 9, 11).collect()}
    assert len(got) == 2 * n + 5
    for k in (200, 201, 202, 203):
        assert got[k]["residual"] == -1 and tuple(got[k]["params"]) == tuple(got[k]["errors"]) == gaussians.FAILED
    for i in range(n):
        p = np.array([got[i]["params"]])
        assert got[i]["residual"] < 1e-4 and np.allclose(gaussians.surface(p, GX, GY)[0], clean[i], atol=1e-5)
        assert np.allclose(p[0][[1, 2]], planted[i][[1, 2]], atol=1e-4)
        r = got[n + i]
        p = np.array([r["params"]])
        value, slope = gaussians.surface(p, GX, GY)
        rest = noisy[i] - value[0]
        assert np.isclose(r["residual"], np.sqrt((rest**2).sum()))
        assert r["residual"] <= np.sqrt(((noisy[i] - clean[i]) ** 2).sum()) and np.abs(slope[0].T @ rest).max() < 1e-3
        assert np.allclose(r["errors"], np.sqrt(np.diag(np.linalg.inv(slope[0].T @ slope[0])) * (rest**2).sum() / (99 - 7)), rtol=1e-4)


def test_fits_equal_a_plain_loop():
    """Step by step for one map, with a dense solve and the same damping."""
    rng = np.random.default_rng(3)
    z = gaussians.surface(np.array([[0.5, 0.1, 0.0, -1.8, -1.2, 0.3, 0.1]]), GX, GY)[0] + 0.05 * rng.normal(size=(1, 99))
    p, damping = gaussians.first_guess(z, GX, GY)[0], 1e-3
    for _ in range(300):
        value, slope = gaussians.surface(p[None], GX, GY)
        j, r = slope[0], z[0] - value[0]
        step = np.linalg.solve(j.T @ j + damping * np.diag(np.diag(j.T @ j)), j.T @ r)
        after = ((z[0] - gaussians.surface((p + step)[None], GX, GY)[0][0]) ** 2).sum()
        if after <= (r**2).sum():
            p, damping = p + step, max(damping * 0.3, 1e-12)
        else:
            damping *= 5
    both = np.vstack([z, z[:, ::-1], z])
    found, _, _ = gaussians.fit_batch(both, GX, GY)
    assert np.allclose(found[0], p, atol=1e-4) and np.array_equal(found[0], found[2])


def test_volume_edges(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 3.0), (0, 1, 0, None), (-1, 0, 0, 7.0)], "i int, j int, k int, value double")
    at = [(1, 0.25, 0.0, 0.0), (2, 0.5, 0.5, 0.0), (3, 5.0, 5.0, 5.0), (4, -0.5, 0.0, 0.0), (None, 1.0, 0.0, 0.0), (6, None, 0.0, 0.0), (7, 0.0, 0.75, 0.0)]
    vertices = spark.createDataFrame(at, "unit long, x double, y double, z double")
    got = {r["unit"]: r["value"] for r in surfaces.sample_volume(vertices, cells, ["unit"]).collect()}
    assert got == {1: 1.5, 2: 2.0, 3: None, 4: 4.0, None: 3.0, 6: None, 7: 1.0}
    near = {r["unit"]: r["value"] for r in surfaces.sample_volume(vertices, cells, ["unit"], method="nearest").collect()}
    assert near == {1: 1.0, 2: None, 3: None, 4: 1.0, None: 3.0, 6: None, 7: None}
    assert surfaces.sample_volume(vertices, cells.limit(0), ["unit"]).where("value IS NOT NULL").count() == 0
    with pytest.raises(InvalidParameterError):
        surfaces.sample_volume(vertices, cells, ["unit"], method="cubic")


def plain_resize(image, height, width):
    """Pixel by pixel: a triangle as wide as the step, or a pixel, around each new pixel's middle."""
    out = np.zeros((height, width, image.shape[2]))
    for i in range(height):
        for j in range(width):
            total = 0.0
            for y in range(image.shape[0]):
                for x in range(image.shape[1]):
                    sy, sx = max(image.shape[0] / height, 1), max(image.shape[1] / width, 1)
                    w = max(0, 1 - abs(y + 0.5 - (i + 0.5) * image.shape[0] / height) / sy) * max(0, 1 - abs(x + 0.5 - (j + 0.5) * image.shape[1] / width) / sx)
                    total += w
                    out[i, j] += w * image[y, x]
            out[i, j] /= total
    return out


def test_resize_against_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(7)
    for (h, w), (height, width) in (((9, 7), (4, 5)), ((5, 6), (11, 13)), ((1, 1), (3, 2)), ((8, 8), (8, 8)), ((17, 3), (2, 9))):
        image = rng.normal(size=(h, w, 3))
        expect = plain_resize(image, height, width)
        assert np.allclose(images.resize(image, height, width), expect)
        monkeypatch.setattr(images, "HELD", 1)  # a row at a time
        assert np.allclose(images.resize(image, height, width), expect)
        monkeypatch.undo()
    assert np.allclose(images.resize(np.array([[[0.0]], [[4.0]]]), 4, 1, antialias=False).ravel(), [0, 1, 3, 4])


def test_images_prepared(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 256, size=(9, 6, 3))
    rows = [(1, 9, 6, a.ravel().tolist()), (2, 6, 9, a.ravel().tolist()), (3, 2, 2, None)]
    df = spark.createDataFrame(rows, "k long, h int, w int, image array<int>")
    got = {r["k"]: np.array(r["values"]).reshape(3, 4, 4) for r in images.prepared(df, ["k"], "image", "h", "w", 3, 4, mean=(0.5, 0.4, 0.3), scale=(0.2, 0.3, 0.4)).collect()}
    squares = {1: a[2:8], 2: a.reshape(6, 9, 3)[:, 2:8]}
    assert set(got) == {1, 2}
    for k, square in squares.items():
        expect = (plain_resize(square, 4, 4) / 255 - [0.5, 0.4, 0.3]) / [0.2, 0.3, 0.4]
        assert np.allclose(got[k], expect.transpose(2, 0, 1))
    bad = spark.createDataFrame([(5, 2, 3, [1] * 17)], "k long, h int, w int, image array<int>")
    with pytest.raises(Exception, match="not 2 by 3 by 3"):
        images.prepared(bad, ["k"], "image", "h", "w", 3, 4).collect()
    with pytest.raises(InvalidParameterError):
        images.prepared(df, ["k"], "image", "h", "w", 3, 0)


def test_density_of_a_known_potential(spark):
    """Spherical harmonics of degree n have the Laplacian -n(n + 1) of themselves; the mean goes."""
    n = np.arange(256)
    z, turn = 1 - (2 * n + 1) / 256, n * np.pi * (3 - 5**0.5)
    at = np.column_stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z])
    waves = {1: at[:, 0], 2: 1.5 * at[:, 2] ** 2 - 0.5, 3: at[:, 0] * at[:, 1] * at[:, 2]}
    df = spark.createDataFrame([(k, (5 + v).tolist()) for k, v in waves.items()] + [(9, None), (10, [None] + [1.0] * 255)], "k long, x array<double>").repartition(2)
    got = {r["k"]: r["values"] for r in scalp.current_source_density(df, ["k"], "x", at * 3, regular=1e-12).collect()}
    for k, v in waves.items():
        assert np.allclose(got[k], k * (k + 1) * v, atol=2e-2 * k * (k + 1) * np.abs(v).max())
    assert 9 not in got and all(v is None for v in got[10])
    assert np.allclose(scalp.csd_matrix(at, radius=2.0) * 4, scalp.csd_matrix(at)) and np.allclose(scalp.csd_matrix(at) @ np.ones(256), 0, atol=1e-6)
    for bad in (np.zeros((0, 3)), np.zeros((2, 3)), at[:, :2]):
        with pytest.raises(InvalidParameterError):
            scalp.csd_matrix(bad)
