"""Distributed statistics and matching against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from craterline.functions.stats import exact_percentiles, with_previous
from craterline.operators import matching as M
from craterline.operators import neighbours as N
from craterline.operators import raster as R


def test_percentiles_with_a_hot_key_and_ties(spark):
    rng = np.random.RandomState(1)
    hot = np.concatenate([rng.lognormal(0, 3, 30000), np.full(9000, 2.5)])
    rows = [("hot", float(v)) for v in hot] + [("small", float(v)) for v in rng.randn(7)] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    # A coarse sketch forces the interval path for the hot key.
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}, accuracy=1000).collect()}
    for k in ("hot", "small", "one"):
        vals = [v for kk, v in rows if kk == k]
        for n, p in (("a", 50), ("b", 95), ("c", 0), ("d", 100)):
            assert got[k][n] == pytest.approx(np.percentile(vals, p), rel=1e-12)
    assert exact_percentiles(df, [], "v", {"m": 0.5}, accuracy=1000).first()["m"] == pytest.approx(np.median([v for _, v in rows]))


def test_previous_row_is_the_same_in_chunks(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 37 % 4001).alias("ts"), "id")
    get = lambda n: {r["id"]: r["prev"] and r["prev"]["id"] for r in with_previous(df, ["k"], ["ts", "id"], ["id"], "ts", n).collect()}
    assert get(100) == get(1_000_000)


def brute_hull_area(p):
    pts = sorted(map(tuple, p))
    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]
    h = np.array(half(pts) + half(pts[::-1]))
    return abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2


def test_hull_areas_in_blocks(spark):
    rng = np.random.RandomState(5)
    circle = np.c_[np.cos(np.linspace(0, 6.28, 3000)), np.sin(np.linspace(0, 6.28, 3000))] * 50
    sets = {"cloud": rng.randn(4000, 2) * 30, "circle": circle, "line": np.c_[np.arange(50.0), np.arange(50.0)], "point": np.ones((9, 2))}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, v in sets.items() for x, y in v], "k string, x double, y double").repartition(5)
    got = {r["k"]: r["hull_area"] for r in M.hull_areas(df, ["k"], "x", "y", block=200).collect()}
    assert got["cloud"] == pytest.approx(brute_hull_area(sets["cloud"])) and got["circle"] == pytest.approx(brute_hull_area(circle))
    assert got["line"] == 0.0 and got["point"] == 0.0


@pytest.mark.parametrize("metric", ["l2", "hamming"])
def test_neighbours_across_blocks(spark, metric):
    rng = np.random.RandomState(2)
    make = (lambda n: rng.randint(0, 2 ** 62, (n, 2)).tolist()) if metric == "hamming" else (lambda n: rng.randn(n, 8).tolist())
    a, b = make(40), make(70)
    kind = "array<long>" if metric == "hamming" else "array<double>"
    d = spark.createDataFrame([("A", i, v) for i, v in enumerate(a)] + [("B", i, v) for i, v in enumerate(b)] + [("C", i, v) for i, v in enumerate(make(3))], f"image_id string, kp_id int, vec {kind}")
    pairs = spark.createDataFrame([("AB", "A", "B"), ("AC", "A", "C")], "pair_id string, source_id string, target_id string")
    got = {r["src_kp"]: (r["tgt_kp"], r["distance"]) for r in N.match_descriptors(d, pairs, 0.97, metric, block=16).collect() if r["pair_id"] == "AB"}
    dist = (lambda x, y: float(sum(bin(p ^ q).count("1") for p, q in zip(x, y)))) if metric == "hamming" else (lambda x, y: float(np.linalg.norm(np.subtract(x, y))))
    want = {}
    for i, x in enumerate(a):
        o = sorted((dist(x, y), j) for j, y in enumerate(b))
        if o[0][0] < 0.97 * o[1][0]:
            want[i] = (o[0][1], o[0][0])
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)
    assert N.match_descriptors(d, pairs, 0.97, metric).filter("pair_id = 'AC'").count() == 0


def test_fit_recovers_transform_with_outliers(spark):
    rng = np.random.RandomState(4)
    h = np.array([[1.02, 0.03, 12.0], [-0.02, 0.98, -7.0], [1e-5, -2e-5, 1.0]])
    rows = []
    for pair, n, bad in ((1, 900, 0.4), (2, 60, 0.2), (3, 3, 0.0)):
        p = rng.rand(n, 2) * 512
        q = np.c_[p, np.ones(n)] @ h.T
        q = q[:, :2] / q[:, 2:] + rng.randn(n, 2) * 0.3
        q[: int(n * bad)] = rng.rand(int(n * bad), 2) * 512
        rows += [(pair, f"{pair}-{i}", *map(float, (*a, *b)), 10.0) for i, (a, b) in enumerate(zip(p, q))]
    m = spark.createDataFrame(rows, "pair_id int, match_id string, src_x double, src_y double, tgt_x double, tgt_y double, distance double").repartition(6)
    fits = {r["pair_id"]: r for r in M.fit_transforms(m, block=100).collect()}
    assert set(fits) == {1, 2}
    for pair, n, bad in ((1, 900, 0.4), (2, 60, 0.2)):
        got = np.array(fits[pair]["h"]).reshape(3, 3)
        c = np.c_[rng.rand(50, 2) * 512, np.ones(50)]
        a, b = c @ h.T, c @ got.T
        assert np.abs(a[:, :2] / a[:, 2:] - b[:, :2] / b[:, 2:]).max() < 0.5
        assert fits[pair]["inliers"] >= 0.95 * n * (1 - bad)
    # A third of all rows as copies of one match: counted, not piled up.
    copies = m.unionByName(m.filter("match_id = '1-899'").crossJoin(spark.range(500)).drop("id"))
    assert {r["pair_id"]: (r["matches"], r["inliers"]) for r in M.fit_transforms(copies, block=100).collect()}[1] == (1400, fits[1]["inliers"] + 500)
    again = {r["pair_id"]: r["inliers"] for r in M.fit_transforms(m.repartition(2), block=4096).collect()}
    assert again == {k: v["inliers"] for k, v in fits.items()}


def test_entropy_and_empty_confidence(spark):
    df = spark.createDataFrame([(1, 10.0 + 128 * i, 10.0 + 128 * j) for i in range(4) for j in range(4)] + [(2, 5.0, 5.0)] * 9, "pair_id int, src_x double, src_y double")
    got = {r["pair_id"]: r["spatial_entropy"] for r in M.grid_entropy(df, 512, 512).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0
    pairs = spark.createDataFrame([(1,), (9,)], "pair_id int")
    c = {r["pair_id"]: r["confidence"] for r in M.match_confidence(df.withColumn("distance", F.lit(150.0)), pairs).collect()}
    assert c == {1: 0.5, 9: 0.0}


def test_downsample_matches_area_weights(spark):
    img = np.random.RandomState(0).rand(7, 10) * 100
    df = spark.createDataFrame([("P", i, j, float(img[i, j])) for i in range(7) for j in range(10)], "product_id string, line long, sample long, dn double")
    got = {(r["line"], r["sample"]): r["dn"] for r in R.downsample(df, 2.5, 7, 10).collect()}
    oh, ow = round(7 / 2.5), round(10 / 2.5)
    def weights(n, m):
        w = np.zeros((m, n))
        for k in range(m):
            for i in range(n):
                w[k, i] = max(0.0, min((i + 1) * m / n, k + 1) - max(i * m / n, k))
        return w / w.sum(1, keepdims=True)
    want = weights(7, oh) @ img @ weights(10, ow).T
    assert got.keys() == {(i, j) for i in range(oh) for j in range(ow)}
    assert all(got[k] == pytest.approx(want[k]) for k in got)
