"""Descriptor neighbours: blocks ruled out by norms, hash tables, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from craterline.operators import neighbours as N

PAIR = [("AB", "A", "B")]


def frames(spark, a, b, kind="array<double>"):
    rows = [("A", i, v) for i, v in enumerate(a.tolist())] + [("B", i, v) for i, v in enumerate(b.tolist())]
    return spark.createDataFrame(rows, f"image_id string, kp_id int, vec {kind}"), spark.createDataFrame(PAIR, "pair_id string, source_id string, target_id string")


def brute(a, b, ratio, metric="l2"):
    dist = N.distances(a, b, metric)
    order = np.lexsort((np.broadcast_to(np.arange(len(b)), dist.shape), dist), axis=1)
    first, second = (np.take_along_axis(dist, order[:, [k]], 1)[:, 0] for k in (0, 1))
    return {i: int(order[i, 0]) for i in np.flatnonzero(first < ratio * second)}


def matched(df):
    return {r.src_kp: r.tgt_kp for r in df.collect()}


@pytest.mark.parametrize("spread", [0.0, 5.0])
def test_norm_blocks_keep_the_exact_answer(spark, spread):
    """Equal norms cannot be told apart and are cut by a hash; spread norms rule blocks out."""
    rng = np.random.default_rng(3)
    make = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True) * (1 + spread * rng.random((n, 1))))(rng.standard_normal((n, 6)))
    a, b = make(150), make(230)
    a[:60] = b[:60] + 0.01
    d, pairs = frames(spark, a, b)
    blocks = N.norm_blocks(d, block=20).collect()
    assert max(len(r.kps) for r in blocks) < 80 and sum(len(r.kps) for r in blocks) == 380
    assert matched(N.match_descriptors(d, pairs, 0.9, block=20)) == brute(a, b, 0.9)


def test_blocks_that_norms_rule_out_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = np.ones((300, 4)) + 0.01 * rng.standard_normal((300, 4))
    base *= (np.arange(1, 301) / np.linalg.norm(base, axis=1))[:, None]
    d, pairs = frames(spark, base + 0.01, base)
    seen, real = [], N._two_nearest
    monkeypatch.setattr(N, "_two_nearest", lambda blocks, keys, metric: (seen.append(blocks.select("s_kps").count()), real(blocks, keys, metric))[1])
    assert matched(N.match_descriptors(d, pairs, 0.5, block=15)) == brute(base + 0.01, base, 0.5)
    n = N.norm_blocks(d, block=15).groupBy("image_id").count().collect()
    assert sum(seen) < 0.5 * n[0]["count"] * n[1]["count"]


def test_negative_words_count_their_bits(spark):
    rng = np.random.default_rng(6)
    a, b = (rng.integers(-2 ** 63, 2 ** 63 - 1, (n, 3)) for n in (30, 50))
    bits = lambda x: [bin(int(w) & (1 << 64) - 1).count("1") for w in x]
    assert N.distances(a, b, "hamming").tolist() == [[float(sum(bits(p ^ q))) for q in b] for p in a]
    d, pairs = frames(spark, a, b, "array<long>")
    assert matched(N.match_descriptors(d, pairs, 0.95, "hamming", block=8)) == brute(a, b, 0.95, "hamming")


@pytest.mark.parametrize("metric", ["l2", "hamming"])
def test_hashing_reports_nothing_wrong_and_loses_little(spark, metric):
    rng = np.random.default_rng(12)
    if metric == "l2":
        b = rng.standard_normal((1500, 32)) + 3.0
        a = np.vstack([b[:500] + 0.25 * rng.standard_normal((500, 32)), rng.standard_normal((500, 32)) + 3.0])
    else:
        b = rng.integers(-2 ** 63, 2 ** 63 - 1, (1500, 4))
        flips = np.array([np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 62, 3)) for _ in range(2000)]).reshape(500, 4)
        a = np.vstack([b[:500] ^ flips, rng.integers(-2 ** 63, 2 ** 63 - 1, (500, 4))])
    d, pairs = frames(spark, a, b, "array<double>" if metric == "l2" else "array<long>")
    want = N.match_descriptors(d, pairs, 0.8, metric)
    r = N.recall(N.hashed_matches(d, pairs, 0.8, metric, bits=6), want).first()
    assert r.wanted >= 490 and r.besides == 0 and r.recall >= 0.9


def test_hashing_with_a_crowded_key_ties_and_small_images(spark):
    same = np.ones((90, 5))
    a = np.vstack([same, [[9.0, 0, 0, 0, 0]]])
    b = np.vstack([same[:40], [[9.0, 0, 0, 0, 0.1]], [[0, 8.0, 0, 0, 0]]])
    d, pairs = frames(spark, a, b)
    assert matched(N.hashed_matches(d, pairs, 0.8, block=10, bits=3)) == {90: 40} == matched(N.match_descriptors(d, pairs, 0.8, block=10))
    few = d.filter("image_id = 'A' or kp_id < 3")
    assert N.hashed_matches(few, pairs, 0.8).count() == 0 and N.match_descriptors(few, pairs, 0.8).count() == 0
    assert N.recall(few.filter("false").select(F.lit("x").alias("pair_id"), F.lit(1).alias("src_kp"), F.lit(1).alias("tgt_kp")),
                    few.filter("false").select(F.lit("x").alias("pair_id"), F.lit(1).alias("src_kp"), F.lit(1).alias("tgt_kp"))).first().recall is None


@pytest.mark.parametrize("metric", ["l2", "hamming"])
def test_a_large_image_is_few_blocks_and_strips_change_nothing(spark, monkeypatch, metric):
    """With blocks of 8 each, whatever the size, block pairs and the descriptors sent to them would grow with the square."""
    rng = np.random.default_rng(9)
    a, b = (rng.standard_normal((n, 6)) if metric == "l2" else rng.integers(-2 ** 63, 2 ** 63 - 1, (n, 2)) for n in (2000, 1700))
    b[200:260] = b[100]
    d, pairs = frames(spark, a, b, "array<double>" if metric == "l2" else "array<long>")
    sizes = N.norm_blocks(d, metric, block=8).groupBy("image_id").agg(F.count("*").alias("blocks"), F.sum(F.size("kps")).alias("n")).collect()
    assert {r.image_id: r.n for r in sizes} == {"A": 2000, "B": 1700} and max(r.blocks for r in sizes) <= 3 * N.BLOCKS
    assert matched(N.match_descriptors(d, pairs, 0.97, metric, block=8)) == brute(a, b, 0.97, metric)
    whole = N.two_nearest(a, b, metric)
    monkeypatch.setattr(N, "CELLS", 40 * len(b))
    parts = N.two_nearest(a, b, metric)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1]) and N.two_nearest(a[:3], b[:1], metric)[0].tolist() == [[0]] * 3
