"""Cases in which rows were lost or a job failed: headers, null times, unknown sides, degenerate and noisy fits, long tracks."""

import random

import pytest
from pyspark.sql import functions as F

from craterline.functions import stats
from craterline.operators import matching as M
from craterline.operators import resolve as E
from craterline.operators.geometry import gate_matches
from craterline.operators.joins import pair_observations
from craterline.sources import grids

SQUARE = "0.5,0.5,{},{}"


@pytest.mark.parametrize("text", ["INVALID,0.5,100,200", "Infinity,0.5,9,9", "abc,1,2,3", ",1,2,3"])
def test_text_row_is_no_header(spark, text):
    lines = ["Longitude,Latitude,Pixel,Scan", *(SQUARE.format(i, j) for i in range(2) for j in range(2)), text]
    nodes, problems = grids.parse_grid(spark.createDataFrame([("g", x) for x in lines], "grid_id string, value string"))
    assert nodes.count() == 4 and [r.problem for r in problems.collect()] == [f"MALFORMED_ROW: {text}"]


def test_second_header_is_a_problem(spark):
    lines = ["Longitude,Latitude,Pixel,Scan", "Pixel,Scan,Longitude,Latitude", *(SQUARE.format(i, j) for i in range(2) for j in range(2))]
    _, problems = grids.parse_grid(spark.createDataFrame([("g", x) for x in lines], "grid_id string, value string"))
    assert [r.problem for r in problems.collect()] == ["MALFORMED_ROW: Pixel,Scan,Longitude,Latitude"]


def test_previous_row_does_not_depend_on_chunks(spark):
    rows = [("a", i, None if i % 4 == 0 else f"2024-01-{i + 1:02d} 00:00:00") for i in range(12)]
    df = spark.createDataFrame(rows, "k string, n int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    found = [sorted((r.n, r.prev and r.prev.n) for r in stats.with_previous(df, ["k"], ["ts", "n"], ["n"], "ts", size).collect()) for size in (1, 4, 2_000_000)]
    assert found[0] == found[1] == found[2] and dict(found[0])[0] is None


def test_pair_with_unknown_side_stays(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "zz"), (3, None, "b"), (4, "x", "y")], "pair_id int, source_observation_id string, target_observation_id string")
    observations = spark.createDataFrame([("a", "OHRC"), ("b", "IIRS")], "observation_id string, sensor string")
    got = {r.pair_id: (r.src_sensor, r.tgt_sensor, r.unknown_side) for r in pair_observations(pairs, observations).collect()}
    assert got == {1: ("OHRC", "IIRS", None), 2: ("OHRC", None, "target"), 3: (None, "IIRS", "source"), 4: (None, None, "source,target")}


def test_fit_skips_pairs_on_few_places(spark):
    rows = [(1, i, float(i % 3), 0.0, float(i % 3), 1.0) for i in range(9)] + [(2, i, float(i), 0.0, float(i), 1.0) for i in range(9)]
    rows += [(3, i, float(i * 37 % 101), float(i * 53 % 97), i * 37 % 101 + 5.0, i * 53 % 97 - 2.0) for i in range(30)]
    m = spark.createDataFrame(rows, "pair_id int, match_id int, src_x double, src_y double, tgt_x double, tgt_y double")
    fits = {r.pair_id: r for r in M.fit_transforms(m).collect()}
    assert 1 not in fits and fits[3].inliers == 30 and abs(fits[3].h[2] - 5) < 1e-6


def test_fit_finds_a_quarter_of_inliers(spark):
    rnd = random.Random(1)
    rows = []
    for pair in range(24):
        for i in range(400):
            x, y = rnd.uniform(0, 500), rnd.uniform(0, 500)
            u, v = (1.05 * x + 3 + pair, 0.97 * y - 8) if i % 4 == 0 else (rnd.uniform(0, 500), rnd.uniform(0, 500))
            rows.append((pair, i, x, y, u, v))
    m = spark.createDataFrame(rows, "pair_id int, match_id int, src_x double, src_y double, tgt_x double, tgt_y double")
    fits = M.fit_transforms(m).collect()
    assert len(fits) == 24 and min(r.inliers for r in fits) >= 100


def test_samples_are_distinct_and_even():
    import numpy as np
    rng = np.random.RandomState(0)
    drawn = M._samples(rng, 5, 20_000)
    assert all(len(set(r)) == 4 for r in drawn[:500].tolist())
    assert abs(np.bincount(drawn.ravel()) / 80_000 - 0.2).max() < 0.01


def test_track_resolves_in_few_rounds(spark, monkeypatch):
    staged = []
    real = E.stage
    monkeypatch.setattr(E, "stage", lambda df: staged.append(1) or real(df))
    points = spark.range(10_000).select(F.col("id"), (F.col("id") * 0.004).alias("lat"), F.lit(1.0).alias("lon"))
    points = points.union(spark.createDataFrame([(20_000, None, 1.0)], "id long, lat double, lon double"))
    entities = spark.createDataFrame([], "entity_id string, latitude double, longitude double")
    got = E.resolve_entities(points, entities, "id").collect()
    assert len(got) == 10_001 and [r.id for r in got if r.entity_id is None] == [20_000]
    assert len(staged) < 2 * 20 + 4


def test_only_reduced_views_of_one_camera_are_scaled(spark):
    import craterline.operators.geometry as G
    seen = {}
    m = spark.createDataFrame([("OHRC", 100), ("OHRC", 78175), ("TMC-2", 100)], "sensor string, height int").withColumns({"src_x": F.lit(1.0), "src_y": F.lit(1.0)})
    real, G.physical_gates = G.physical_gates, lambda points, grids: points
    try:
        rows = gate_matches(m, None, F.lit(50), F.col("height"), F.col("sensor")).collect()
    finally:
        G.physical_gates = real
    for r in rows:
        seen[r.sensor, r.height] = r.scan
    assert seen["OHRC", 78175] == 1.0 and seen["TMC-2", 100] == 1.0 and abs(seen["OHRC", 100] - 78174 / 99) < 1e-9


def test_label_entities_and_cdata(spark):
    from craterline.sources import labels
    text = ("<Product><instrument_name>OHRC</instrument_name><logical_identifier>urn:a&amp;b &lt;c&gt;</logical_identifier>"
            "<processing_level><![CDATA[Calibrated]]></processing_level></Product>")
    files = spark.createDataFrame([("/x/ch2_ohr_1.xml", text)], "path string, content string")
    row = labels.parse_labels(files).first()
    assert row.product_id == "urn:a&b <c>" and row.processing_level == "Calibrated"
