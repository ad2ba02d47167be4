"""Tiles with a rim: the same numbers as on the whole image, wherever tiles end."""

import math

import numpy as np
import pytest

from craterline.operators import tiles as T


def frame(spark, images, band=None):
    rows = [(k, l, s, None if v is None or math.isnan(v) else float(v)) for k, image in images.items() for l, line in enumerate(image) for s, v in enumerate(line)]
    df = spark.createDataFrame(rows, "product_id string, line int, sample int, dn double").repartition(3)
    return df


def plain_gradient(image, l, s):
    def value(a, b):
        return image[a][b] if 0 <= a < len(image) and 0 <= b < len(image[0]) and not math.isnan(image[a][b]) else None

    def diff(before, after):
        if before is not None and after is not None:
            return (after - before) / 2
        here = value(l, s)
        if before is None and after is None:
            return 0.0
        return None if here is None else after - here if after is not None else here - before
    return diff(value(l, s - 1), value(l, s + 1)), diff(value(l - 1, s), value(l + 1, s))


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(1)
    holes = rng.integers(0, 100, (13, 9)).astype(float)
    holes[rng.random(holes.shape) < 0.2] = np.nan
    return {"full": rng.integers(0, 100, (17, 11)).astype(float), "holes": holes, "line": rng.random((1, 8)), "dot": np.array([[5.0]])}


@pytest.mark.parametrize("size", [4, 5, 256])
def test_gradients_across_tiles(spark, images, size):
    df = frame(spark, images)
    got = {(r.product_id, r.line, r.sample): r for r in T.central_gradients(df, size).collect()}
    assert len(got) == df.count()
    for k, image in images.items():
        for l in range(image.shape[0]):
            for s in range(image.shape[1]):
                assert (got[k, l, s].gx, got[k, l, s].gy) == plain_gradient(image.tolist(), l, s)
    sobel = {(r.product_id, r.line, r.sample): (r.gx, r.gy) for r in T.sobel(df, size).collect()}
    kernel = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    want = {}
    for k, image in images.items():
        for l in range(1, image.shape[0] - 1):
            for s in range(1, image.shape[1] - 1):
                part = image[l - 1:l + 2, s - 1:s + 2]
                if not np.isnan(part).any():
                    want[k, l, s] = ((part * kernel).sum(), (part * kernel.T).sum())
    assert sobel == want


def test_bands_and_repeated_pixels(spark):
    rows = [("a", 0, s, b, float(s * (b + 1))) for s in range(6) for b in range(2)] + [("a", 0, 3, 0, 3.0)]
    got = T.central_gradients(spark.createDataFrame(rows, "product_id string, line int, sample int, band int, dn double"), 2).collect()
    assert len(got) == 13 and all(r.gx == r.band + 1 for r in got)


def plain_level(image, scale):
    """Mirror, smooth, average: one output after the other."""
    sigma, reach = T.low_pass(scale)
    taps = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma ** 2)) if reach else np.ones(1)
    taps /= taps.sum()
    for axis in (0, 1):
        if reach:
            pad = [(0, 0), (0, 0)]
            pad[axis] = (reach, reach)
            image = np.apply_along_axis(lambda x: np.convolve(x, taps, "valid"), axis, np.pad(image, pad, "reflect"))
        n = image.shape[axis]
        m = max(1, round(n / scale))
        cover = np.array([[max(0.0, min(x + 1, (o + 1) * n / m) - max(x, o * n / m)) for x in range(n)] for o in range(m)])
        image = np.moveaxis(np.tensordot(cover / cover.sum(1, keepdims=True), image, (1, axis)), 0, axis)
    return image


@pytest.mark.parametrize("size", [3, 256])
def test_levels_equal_whole_images(spark, size):
    rng = np.random.default_rng(2)
    images = {"p": rng.random((61, 43)) * 100, "q": np.full((40, 40), 7.0)}
    df = frame(spark, images)
    products = spark.createDataFrame([("p", 0.5, 61, 43), ("q", 0.5, 40, 40), ("unknown", None, 5, 5)], "product_id string, gsd_m double, lines long, samples long")
    levels, reduced = T.pyramid(df, products, 0.5 * 5.3, size)
    got = {}
    for r in reduced.collect():
        got.setdefault((r.product_id, r.level_index), {})[r.line, r.sample] = r.dn
    for r in levels.collect():
        cells = got[r.product_id, r.level_index]
        want = plain_level(images[r.product_id], r.scale_factor) if r.scale_factor != 1 else images[r.product_id]
        assert (r.lines, r.samples) == want.shape and len(cells) == want.size
        assert all(cells[a, b] == pytest.approx(want[a, b]) for a, b in np.ndindex(want.shape))
    assert {k for k, _ in got} == {"p", "q"} and all(v == pytest.approx(7.0) for k, c in got.items() if k[0] == "q" for v in c.values())


def test_missing_pixels_have_no_weight(spark):
    image = np.full((32, 32), 9.0)
    image[5:12, 5:30] = np.nan
    products = spark.createDataFrame([("h", 1.0, 32, 32)], "product_id string, gsd_m double, lines long, samples long")
    rows = T.pyramid(frame(spark, {"h": image}), products, 3.0, 4)[1].collect()
    assert all(r.dn is None or r.dn == pytest.approx(9.0) for r in rows)


def test_one_shuffle(spark, images):
    plan = T.central_gradients(frame(spark, images))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_mean_slope_sums_windows_over_cells(spark):
    """Points are not written out for each cell of their window; empty cells count neither as zero nor as a place."""
    from craterline.operators import raster
    slopes = spark.createDataFrame([("A", l, s, None if (l, s) == (3, 3) else float(l * 10 + s)) for l in range(8) for s in range(8) if (l, s) != (4, 4)],
                                   "product_id string, line long, sample long, slope double")
    points = spark.createDataFrame([("a", "A", 3.0, 3.0, 1), ("b", "A", -5.0, 99.0, 2), ("c", "B", 3.0, 3.0, 3), ("d", None, 3.0, 3.0, 4)], "key string, product_id string, x double, y double, marked int")
    found = raster.mean_slope_at(points, slopes, 8, 8)
    rows = {r.key: (r.slope_mean, r.marked) for r in found.collect()}
    near = [l * 10 + s for l in (2, 3, 4) for s in (2, 3, 4) if (l, s) not in ((3, 3), (4, 4))]
    low = [l * 10 + s for l in (4, 5, 6) for s in (1, 2, 3)]
    assert rows == {"a": (pytest.approx(sum(near) / 7), 1), "b": (pytest.approx(sum(low) / 9), 2), "c": (None, 3), "d": (None, 4)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Generate" in line and "marked" in line for line in plan.splitlines())
