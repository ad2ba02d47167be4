"""Keypoints to verdict in one job: planted transforms, slopes, gradients, gates, failed runs, levels, ablations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from craterline.operators import geometry as G
from craterline.plans import match_runs as MR

PAIR = ("pair_id string, source_id string, target_id string, source_sensor string, target_sensor string, src_gsd_m double, tgt_gsd_m double, src_azimuth double, "
        "tgt_azimuth double, src_elevation double, tgt_elevation double, is_real_data boolean, grid_id string, target_grid_id string, error string")


def pair(name, source, target, error=None):
    return (name, source, target, "TMC-2", "TMC-2", 1.0, 1.0, 90.0, 90.0, 40.0, 40.0, True, "SRC", "TGT", error)


@pytest.fixture(scope="module")
def planted(spark):
    """Sixty points: the target shows them rotated, enlarged and seen at a slant; the strangers share nothing."""
    rng = np.random.default_rng(4)
    xy = rng.uniform(6, 90, (60, 2))
    vec = rng.standard_normal((60, 12))
    h = np.array([[1.02, -0.05, 3.0], [0.04, 0.99, -2.0], [1e-4, 5e-5, 1.0]])
    p = np.c_[xy, np.ones(60)] @ h.T
    seen = p[:, :2] / p[:, 2:]
    rows = [("A", i, *xy[i].tolist(), vec[i].tolist()) for i in range(60)]
    rows += [("B", i, *seen[i].tolist(), (vec[i] + 0.01 * rng.standard_normal(12)).tolist()) for i in range(60)]
    rows += [("C", i, *xy[i].tolist(), (5 * rng.standard_normal(12)).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "image_id string, kp_id int, x double, y double, vec array<double>").persist(), h


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame([(n, l, s, float((l * 7 + s * 3 + (l * s) % 11) % 97)) for n in "AB" for l in range(100) for s in range(100)],
                                 "product_id string, line int, sample int, dn double").persist()


def test_projective_pair_failed_runs_and_pixels(spark, planted, pixels):
    keypoints, h = planted
    pairs = spark.createDataFrame([pair("AB", "A", "B"), pair("AC", "A", "C"), pair("AX", "A", "X"), pair("AE", "A", "B", "Product Ingestion Failure: cut short")], PAIR)
    runs = MR.evaluate_runs(pairs, {"plain": MR.Matcher(keypoints), "hashed": MR.Matcher(keypoints, hashed=True)}, 100.0, 100.0, pixels)
    got = {(r.pair_id, r.matcher): r for r in runs.collect()}
    assert len(got) == 8
    for m in ("plain", "hashed"):
        ab = got["AB", m]
        assert (ab.candidates, ab.inliers, ab.status, ab.is_stable, ab.error) == (60, 60, "GEOMETRICALLY_STABLE", True, None)
        assert np.allclose(np.array(ab.h).reshape(3, 3) / ab.h[8], h, atol=2e-2) and ab.mean_error_px < 0.05
        assert ab.terrain_score is not None and 0 <= ab.illumination_score <= 1 and 0 < ab.total_uncertainty < 0.5
        assert got["AC", m].status != "GEOMETRICALLY_STABLE" and got["AC", m].inliers < 8
        assert got["AX", m].dominant_failure == "COMPUTATIONAL_FAILURE" and got["AX", m].error == "Feature Matching Failure: no descriptors of X" and got["AX", m].candidates == 0
        assert got["AE", m].error == "Product Ingestion Failure: cut short" and got["AE", m].status == "REJECTED"


def test_pixels_change_terrain_and_illumination(spark, planted, pixels):
    keypoints, _ = planted
    pairs = spark.createDataFrame([pair("AB", "A", "B")], PAIR)
    job = lambda pixels: MR.evaluate_runs(pairs, {"m": MR.Matcher(keypoints)}, 100.0, 100.0, pixels)
    r = MR.run_ablation(job, ["pair_id", "matcher"], ["terrain_score", "illumination_score"], "Pixels", pixels=pixels).first()
    assert r.component == "Pixels" and r.ablated_terrain_score == 0.70 and r.delta_terrain_score != 0
    same = MR.gradient_alignments(pairs, pixels).first()
    assert same.gradient_alignment == pytest.approx(1.0, abs=1e-4)


def test_gates_refuse_a_pair_beside_the_target(spark, planted):
    keypoints, _ = planted
    node = lambda g, x: [(g, 20 * p, 20 * s, x + 0.01 * p, 0.01 * s) for p in range(6) for s in range(6)]
    cells = lambda rows: G.grid_cells(spark.createDataFrame(rows, "grid_id string, pixel long, scan long, lon double, lat double")).persist()
    frame = G.DemFrame(-1.0, 1.0, 19.0, 31.0, 10.0, 20, 120)
    dem = G.dem_cells(spark.createDataFrame([(a, b, 0.0) for a in range(20) for b in range(120)], "line int, sample int, elev float"), frame)
    source = cells(node("SRC", 20.0))
    pairs = spark.createDataFrame([pair("AB", "A", "B")], PAIR)
    found = {}
    for name, lon in (("over", 20.0), ("beside", 30.0)):
        target = cells(node("TGT", lon))
        grids = G.GridPair(source, G.grid_meta(source), target, G.grid_meta(target), dem, frame, G.PushBroom(100000.0, 10.0, 50.0))
        found[name] = MR.evaluate_runs(pairs, {"m": MR.Matcher(keypoints)}, 100.0, 100.0, grids=grids).first()
    assert found["over"].gate_accepted > 0 and found["over"].rejection_summary is None
    assert found["beside"].gate_accepted == 0 and found["beside"].verification_status == "REJECTED" and "GATE3" in found["beside"].rejection_summary


def test_levels_have_their_own_sampling(spark, planted):
    keypoints, _ = planted
    levels = spark.createDataFrame([("A", 0, 1.0), ("A", 1, 4.0)], "image_id string, level_index int, scale_factor double")
    pairs = spark.createDataFrame([pair("AB", "A", "B")], PAIR)
    reduced = keypoints.filter("image_id = 'A'").withColumn("level_index", F.lit(1))
    runs, decision = MR.scale_experiment(pairs, levels, {"m": MR.Matcher(keypoints.withColumn("level_index", F.lit(0)).unionByName(reduced))}, 100.0, 100.0)
    got = {r.level_index: (r.src_gsd_m, r.inliers) for r in runs.collect()}
    assert got == {0: (1.0, 60), 1: (4.0, 60)} and decision.first().decision == "GEOMETRICALLY_STABLE_CORRESPONDENCE_FOUND"
