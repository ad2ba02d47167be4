"""Lattices, elevation, corridors and gates on small closed-form grids."""

import pytest
from pyspark.sql import functions as F

from craterline.operators import geometry as G


def lattice(spark, grid, ps, ss, lon, lat):
    rows = [(grid, p, s, lon[0] + (lon[1] - lon[0]) * p / ps[-1], lat[0] + (lat[1] - lat[0]) * s / ss[-1]) for p in ps for s in ss]
    return spark.createDataFrame(rows, "grid_id string, pixel long, scan long, lon double, lat double")


@pytest.fixture(scope="module")
def grids(spark):
    src = G.grid_cells(lattice(spark, "SRC", list(range(0, 100, 11)), list(range(0, 100, 11)), (20, 21), (0, 1))).persist()
    tgt = G.grid_cells(lattice(spark, "TGT", [0, 4, 9, 14, 19], [0, 4, 9, 14, 19], (19.5, 21.5), (-0.5, 1.5))).persist()
    frame = G.DemFrame(-0.5, 1.5, 19.5, 21.5, 10.0, 20, 20)
    dem = spark.createDataFrame([(l, s, -1500.0) for l in range(20) for s in range(20)], "line int, sample int, elev float")
    return G.GridPair(src, G.grid_meta(src), tgt, G.grid_meta(tgt), G.dem_cells(dem, frame), frame, G.PushBroom(100000.0, 10.0, 9.5))


def points(spark, rows):
    return spark.createDataFrame([(i, "SRC", "TGT", float(p), float(s)) for i, (p, s) in enumerate(rows)],
                                 "id int, grid_id string, target_grid_id string, pixel double, scan double")


def test_dem_centre_is_mean_and_outside_is_null(spark):
    frame = G.DemFrame(0.0, 1.0, 20.0, 21.0, 1.0, 2, 2)
    dem = spark.createDataFrame([(0, 0, 100.0), (0, 1, 200.0), (1, 0, 300.0), (1, 1, 400.0)], "line int, sample int, elev double")
    p = spark.createDataFrame([(20.5, 0.5), (20.0, 1.0), (21.0, 0.0), (22.0, 0.5)], "lon double, lat double")
    cells = G.dem_cells(dem, frame)
    got = {(r["lon"], r["lat"]): r["elevation_m"] for r in G.sample_dem(p, cells, frame).collect()}
    assert got == {(20.5, 0.5): 250.0, (20.0, 1.0): 100.0, (21.0, 0.0): 400.0, (22.0, 0.5): None}
    hole = G.dem_cells(dem.withColumn("elev", F.when(F.col("line") + F.col("sample") == 2, -32768.0).otherwise(F.col("elev"))), frame)
    assert G.sample_dem(p.limit(1), hole, frame).first()["elevation_m"] is None


def test_projection_and_round_trip(spark, grids):
    p = points(spark, [(49.5, 49.5), (0, 0), (99, 99), (11, 22), (98.9, 0.1), (-1, 5), (120, 4)])
    r = {x["id"]: x for x in G.round_trip(p, grids.source_cells, grids.source_meta, grids.target_cells, grids.target_meta).collect()}
    assert r[0]["target_pixel"] == pytest.approx(9.5, abs=1e-9) and r[0]["target_scan"] == pytest.approx(9.5, abs=1e-9)
    assert all(r[i]["ground_residual_m"] < 1e-3 for i in range(5))
    assert r[5]["lon"] is None and r[6]["target_pixel"] is None and len(r) == 7


def test_every_node_of_the_target_is_found_once(spark, grids):
    nodes = lattice(spark, "TGT", [0, 4, 9, 14, 19], [0, 4, 9, 14, 19], (19.5, 21.5), (-0.5, 1.5)).withColumnsRenamed({"pixel": "p", "scan": "s"})
    got = G.ground_to_pixel(nodes, grids.target_cells, grids.target_meta).collect()
    assert len(got) == 25
    for r in got:
        assert r["pixel"] == pytest.approx(r["p"], abs=1e-6) and r["scan"] == pytest.approx(r["s"], abs=1e-6)


def test_curved_lattice_inverse(spark):
    rows = [("C", p, s, 23.0 + 1e-4 * p + 2e-9 * s * s, 0.2 + 3e-5 * s + 1e-9 * p * p) for p in range(0, 401, 10) for s in range(0, 3001, 10)]
    cells = G.grid_cells(spark.createDataFrame(rows, "grid_id string, pixel long, scan long, lon double, lat double")).persist()
    meta = G.grid_meta(cells)
    pts = [(float(p) + 0.37, float(s) + 0.81) for p in range(3, 390, 13) for s in range(5, 2980, 97)]
    q = spark.createDataFrame([("C", p, s, 23.0 + 1e-4 * p + 2e-9 * s * s, 0.2 + 3e-5 * s + 1e-9 * p * p) for p, s in pts], "grid_id string, p double, s double, lon double, lat double")
    for r in G.ground_to_pixel(q, cells, meta).collect():
        assert r["pixel"] == pytest.approx(r["p"], abs=0.05) and r["scan"] == pytest.approx(r["s"], abs=0.05)


def test_corridor(spark, grids):
    r = G.target_corridors(points(spark, [(50, 50), (-10500, 3)]), grids, 200.0).orderBy("id").collect()
    assert (r[0]["elevation_min_m"], r[0]["elevation_max_m"]) == (pytest.approx(-1700.0), pytest.approx(-1300.0)) and r[0]["corridor_valid"]
    assert r[0]["target_pixel"] == pytest.approx(9.54798, abs=1e-4)
    assert r[0]["corridor_pixel_min"] <= r[0]["target_pixel"] + 0.001 and r[0]["corridor_scan_max"] - r[0]["corridor_scan_min"] == 4.0
    assert r[1]["corridor_reason"] == "SOURCE_OUT_OF_BOUNDS"


def test_gates(spark, grids):
    ok = G.physical_gates(points(spark, [(50, 50), (-10500, 3)]), grids).orderBy("id").collect()
    assert ok[0]["is_accepted"] and ok[1]["rejection_reason"] == "GATE1_SOURCE_OUT_OF_CALIBRATED_GRID"
    far = G.grid_cells(lattice(spark, "TGT", [0, 9, 19], [0, 9, 19], (40.0, 41.0), (5.0, 6.0)))
    apart = G.GridPair(grids.source_cells, grids.source_meta, far, G.grid_meta(far), grids.elevation_cells, grids.frame, grids.view)
    assert G.physical_gates(points(spark, [(50, 50)]), apart).first()["rejection_reason"] == "GATE3_TARGET_OUTSIDE_CALIBRATED_SWATH"
    edge = G.grid_cells(lattice(spark, "TGT", [0, 9, 19], [0, 9, 19], (20.0, 21.0), (-0.5, 1.5)))
    clamped = G.GridPair(grids.source_cells, grids.source_meta, edge, G.grid_meta(edge), grids.elevation_cells, grids.frame, grids.view)
    assert G.physical_gates(points(spark, [(0, 50)]), clamped).first()["rejection_reason"] == "GATE4_TARGET_CLAMPED_TO_SWATH_BOUNDARY"
    nowhere = G.DemFrame(10.0, 12.0, 50.0, 52.0, 10.0, 20, 20)
    blind = G.GridPair(grids.source_cells, grids.source_meta, grids.target_cells, grids.target_meta, grids.elevation_cells, nowhere, grids.view)
    assert G.physical_gates(points(spark, [(50, 50)]), blind).first()["rejection_reason"] == "GATE2_INVALID_DEM_ELEVATION"
    steep = G.GridPair(*[getattr(grids, f) for f in ("source_cells", "source_meta", "target_cells", "target_meta", "elevation_cells", "frame")], G.PushBroom(100.0, 10.0, 2.0))
    assert G.physical_gates(points(spark, [(50, 50)]), steep).first()["rejection_reason"] == "GATE5_PARALLAX_EXCEEDS_PHYSICAL_BOUNDS"
    # One pixel inside the edge the scan corridor leaves the array.
    inner = G.GridPair(*[getattr(grids, f) for f in ("source_cells", "source_meta")], edge, G.grid_meta(edge), grids.elevation_cells, grids.frame, grids.view)
    bottom = G.grid_cells(lattice(spark, "TGT", [0, 9, 19], [0, 9, 19], (19.5, 21.5), (0.0, 1.0)))
    inner = G.GridPair(inner.source_cells, inner.source_meta, bottom, G.grid_meta(bottom), inner.elevation_cells, inner.frame, inner.view)
    assert G.physical_gates(points(spark, [(50, 1)]), inner).first()["rejection_reason"] == "GATE6_CORRIDOR_OUTSIDE_TARGET_ARRAY"
