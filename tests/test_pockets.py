"""The area between a lattice and its convex hull."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from craterline.operators import geometry as G
from craterline.operators import pockets as P


def bent(grid, lines=13, columns=7, bend=0.02, drop=()):
    """Rows of equal latitude whose first column is bent towards the east."""
    west = lambda s: 20.0 + bend * s * (lines - 1 - s)
    return [(grid, 10 * p, 10 * s, west(s) + 0.1 * p, 0.05 * s) for s in range(lines) for p in range(columns) if (p, s) not in drop]


def cells_of(spark, rows):
    return G.grid_cells(spark.createDataFrame(rows, "grid_id string, pixel long, scan long, lon double, lat double"))


def area(points):
    return 0.5 * float(np.sum(points[:, 0] * np.roll(points[:, 1], -1) - points[:, 1] * np.roll(points[:, 0], -1)))


def test_triangles_cover_a_polygon():
    rng = np.random.default_rng(4)
    for n in (3, 4, 9, 60):
        x = np.sort(rng.random(n))
        straight = np.c_[x, np.r_[0, -rng.random(n - 2), 0]]  # below its chord, never turning back
        angle = np.sort(rng.random(n)) * 2 * np.pi
        star = np.c_[np.cos(angle), np.sin(angle)] * rng.uniform(0.2, 1, n)[:, None]
        for polygon in (straight, star if n > 8 else straight):
            triangles = P.triangulate(polygon)
            sizes = [area(polygon[list(t)]) for t in triangles]
            assert min(sizes) > 0 and sum(sizes) == pytest.approx(area(polygon))
    assert P.triangulate(np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]])) == []


def test_hull_and_touching_loops():
    points = np.array([[0, 0], [2, 0], [1, 0], [2, 2], [0, 2], [1, 1]], float)
    assert [points[i].tolist() for i in P.hull(points)] == [[0, 0], [2, 0], [2, 2], [0, 2]]
    assert sorted(sorted(w) for w in P.loops([(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 0)])) == [[0, 1, 2], [0, 3, 4]]


def test_pocket_gives_the_position_on_the_edge(spark):
    cells = cells_of(spark, bent("B") + bent("STRAIGHT", bend=0.0)).persist()
    pockets = P.hull_pockets(cells).persist()
    assert {r.grid_id for r in pockets.select("grid_id").distinct().collect()} == {"B"}
    meta = G.grid_meta(cells)
    # On the hull, in the pocket, on a corner between triangles, beyond the hull, above the swath, and without a place.
    points = [("a", 20.0, 0.3), ("b", 20.3, 0.3), ("c", 20.0, 0.0), ("d", 19.99, 0.3), ("e", 20.3, 0.7), ("f", None, 0.3), ("g", 20.72 + 0.3, 0.3)]
    q = spark.createDataFrame([(n, "B", x, y) for n, x, y in points], "name string, grid_id string, lon double, lat double")
    got = {r.name: (r.pixel, r.scan) for r in G.ground_to_pixel(q, cells, meta, pockets=pockets).collect()}
    assert len(got) == 7 and got["a"][0] == 0.0 and got["b"][0] == 0.0 and got["b"][1] == pytest.approx(60.0)
    assert got["c"] == (pytest.approx(0.0), pytest.approx(0.0)) and got["g"][0] == pytest.approx(30.0)
    assert all(got[n] == (None, None) for n in "def")
    plain = {r.name: r.pixel for r in G.ground_to_pixel(q, cells, meta).collect()}
    assert plain["b"] is None and plain["g"] == pytest.approx(30.0)


def test_points_on_sides_of_triangles_meet_one(spark):
    cells = cells_of(spark, bent("B")).persist()
    pockets = P.hull_pockets(cells).persist()
    rows = [(f"{k}-{s}-{w}", "B", r[f"{s[0]}_lon"] * (1 - w) + r[f"{s[1]}_lon"] * w, r[f"{s[0]}_lat"] * (1 - w) + r[f"{s[1]}_lat"] * w)
            for k, r in enumerate(pockets.collect()) for s in ("ab", "bc", "ca") for w in (0.0, 0.25, 0.5)]
    q = spark.createDataFrame(rows, "name string, grid_id string, lon double, lat double")
    got = G.ground_to_pixel(q, cells, G.grid_meta(cells), pockets=pockets).collect()
    assert len(got) == len(rows)
    assert sum(r.pixel is None for r in got) <= sum(r[2] < 20.0 + 1e-12 for r in rows)  # only on the hull may rounding put one outside


def test_hole_and_mirrored_lattice(spark):
    """A missing node leaves a hole of four cells; a mirrored lattice runs the other way round."""
    rows = bent("H", bend=0.0, drop={(3, 6)}) + [("M", p, s, 40.0 - x, y) for _, p, s, x, y in bent("M")]
    cells = cells_of(spark, rows).persist()
    q = spark.createDataFrame([(1, "H", 20.3, 0.3), (2, "M", 19.7, 0.3), (3, "H", 20.35, 0.31)], "k int, grid_id string, lon double, lat double")
    got = {r.k: (r.pixel, r.scan) for r in G.ground_to_pixel(q, cells, G.grid_meta(cells), pockets=P.hull_pockets(cells)).collect()}
    assert got[1] == (pytest.approx(30.0), pytest.approx(60.0)) and got[3] == (pytest.approx(35.0), pytest.approx(62.0))
    assert got[2] == (0.0, pytest.approx(60.0))


def test_pocket_is_gate_four_not_three(spark):
    target = cells_of(spark, bent("TGT")).persist()
    source = cells_of(spark, [("SRC", 10 * p, 10 * s, 20.1 + 0.05 * p, 0.05 * s) for s in range(13) for p in range(11)]).persist()
    frame = G.DemFrame(-1.0, 2.0, 19.0, 22.0, 10.0, 30, 30)
    dem = G.dem_cells(spark.createDataFrame([(a, b, 0.0) for a in range(30) for b in range(30)], "line int, sample int, elev float"), frame)
    sides = [source, G.grid_meta(source), target, G.grid_meta(target), dem, frame, G.PushBroom(100000.0, 10.0, 30.0)]
    q = spark.createDataFrame([(1, "SRC", "TGT", 10.0, 60.0), (2, "SRC", "TGT", 0.0, 0.0)], "id int, grid_id string, target_grid_id string, pixel double, scan double")
    without, filled = ({r.id: r.rejection_reason for r in G.physical_gates(q, G.GridPair(*sides, target_pockets=x)).collect()} for x in (None, P.hull_pockets(target)))
    assert without[1] == "GATE3_TARGET_OUTSIDE_CALIBRATED_SWATH" and filled[1] == "GATE4_TARGET_CLAMPED_TO_SWATH_BOUNDARY"
    assert without[2] == filled[2]


def test_plan_has_no_nested_loop(spark):
    cells = cells_of(spark, bent("B"))
    q = spark.range(5).select(F.when(F.col("id") >= 0, "B").alias("grid_id"), (F.col("id") + 20.0).alias("lon"), F.lit(0.3).alias("lat"))
    plan = G.ground_to_pixel(q, cells, G.grid_meta(cells), pockets=P.hull_pockets(cells))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_long_edge_is_filled_with_arrays():
    """A row of objects for each triangle took kilobytes, and a lattice's edge is one task's work."""
    n = 20_000
    s = np.arange(n) * 50.0
    ring = np.c_[np.zeros(n), s, 20.2 + 4e-6 * s * (s[-1] - s) / 50, 0.4 + 3e-4 * s]
    loop = np.vstack([ring + [1500.0, 0, 0.9, 0], ring[::-1]])
    both = np.vstack([loop, np.roll(loop, -1, axis=0)])
    tracemalloc.start()
    corners, on_hull = P._fill(both)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    columns = P._columns(corners, on_hull)
    assert len(corners) == 2 * (n - 2) - (n - 2) and peak < 1000 * n
    size = area(ring[::-1, 2:])
    assert sum(area(t[:, 2:]) for t in corners) == pytest.approx(abs(size), rel=1e-6)
    assert on_hull.sum() == 1 and set(columns) == {c.split(" ")[0] for c in P._SCHEMA.split(", ")[1:]}
