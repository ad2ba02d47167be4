"""Georeferencing: lattices, elevation, corridors and the six ordered gates.

A lattice or an elevation grid is first turned into a *cell table* whose rows carry their own
four corners. It is built once per product and can be stored; every lookup after that is one
equi-join of the points with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions import geo
from craterline.functions.common import first_of
from craterline.functions.stage import stage
from craterline.functions.stats import exact_percentiles
from craterline.operators.pockets import fill_from_pockets


# --- Lattice ------------------------------------------------------------------
def _axis(nodes: DataFrame, name: str) -> DataFrame:
    """Neighbours of each distinct axis value; an axis is as long as one side of the lattice."""
    w = Window.partitionBy("grid_id").orderBy(name)
    return nodes.select("grid_id", name).distinct().select(
        F.col("grid_id").alias(f"_{name}_grid"), F.col(name).alias(f"_{name}"),
        F.lag(name).over(w).alias(f"{name}_before"), F.lead(name).over(w).alias(f"{name}_after"))


def grid_cells(nodes: DataFrame) -> DataFrame:
    """Cells of a lattice (grid_id, pixel, scan, lon, lat) that have all four corners.

    Every node is sent to the at most four cells it belongs to, so building costs one shuffle.
    """
    # Written first, so that a short axis is known to be short and the nodes are not shuffled for it.
    p, s = stage(_axis(nodes, "pixel")), stage(_axis(nodes, "scan"))
    n = (nodes.join(p, (nodes["grid_id"] == p["_pixel_grid"]) & (nodes["pixel"] == p["_pixel"]))
              .join(s, (nodes["grid_id"] == s["_scan_grid"]) & (nodes["scan"] == s["_scan"])))

    def side(name: str) -> Column:
        here, before, after = F.col(name).cast("double"), F.col(f"{name}_before").cast("double"), F.col(f"{name}_after").cast("double")
        return F.array_compact(F.array(
            F.when(after.isNotNull(), F.struct(here.alias("lo"), after.alias("hi"), F.lit(0).alias("corner"))),
            F.when(before.isNotNull(), F.struct(before.alias("lo"), here.alias("hi"), F.lit(1).alias("corner")))))

    n = n.withColumn("_p", F.explode(side("pixel"))).withColumn("_s", F.explode(side("scan")))

    def corner(value: str, pc: int, sc: int) -> Column:
        return F.max(F.when((F.col("_p.corner") == pc) & (F.col("_s.corner") == sc), F.col(value))).alias(f"{value}{pc}{sc}")

    cells = n.groupBy("grid_id", F.col("_p.lo").alias("p0"), F.col("_p.hi").alias("p1"), F.col("_s.lo").alias("s0"), F.col("_s.hi").alias("s1")).agg(
        *[corner(v, a, b) for v in ("lon", "lat") for a in (0, 1) for b in (0, 1)])
    return cells.dropna(subset=[f"{v}{a}{b}" for v in ("lon", "lat") for a in (0, 1) for b in (0, 1)])


LONS = ["lon00", "lon01", "lon10", "lon11"]
LATS = ["lat00", "lat01", "lat10", "lat11"]


def grid_meta(cells: DataFrame) -> DataFrame:
    """One row per grid: bounds and the bucket widths that its lookups use.

    Bucket widths are maxima, which do not depend on the order of aggregation, so both sides of
    a join compute the same buckets.
    """
    width = lambda cols: F.max(F.greatest(*cols) - F.least(*cols))
    return cells.groupBy("grid_id").agg(
        F.min("p0").alias("pixel_min"), F.max("p1").alias("pixel_max"), F.min("s0").alias("scan_min"), F.max("s1").alias("scan_max"),
        F.max(F.col("p1") - F.col("p0")).alias("pixel_step"), F.max(F.col("s1") - F.col("s0")).alias("scan_step"),
        width(LONS).alias("lon_step"), width(LATS).alias("lat_step"))


def grid_summary(nodes: DataFrame) -> DataFrame:
    """Records, axis sizes, bounds and whether the lattice is complete."""
    n, p, s = F.count("*"), F.count_distinct("pixel"), F.count_distinct("scan")
    return nodes.groupBy("grid_id").agg(
        n.alias("records"), p.alias("unique_pixels"), s.alias("unique_scans"), (n == p * s).alias("is_rectilinear"),
        *[f(c).alias(f"{c}_{t}") for c in ("pixel", "scan", "lon", "lat") for t, f in (("min", F.min), ("max", F.max))])


def _bucket(value: Column, step: Column) -> Column:
    return F.floor(value / step).cast("long")


def _bucket_under(value: Column, step: Column) -> Column:
    """As ``_bucket``, but never a bucket whose border ``bucket * step`` lies above the value."""
    b = _bucket(value, step)
    return F.when(b * step > value, b - 1).otherwise(b)


#: A small number of each row that comes from all of its columns: look-ups spread rows without a place by it, and need not carry the columns.
SPREAD = "_spread"
#: Buckets of the inverse look-up are so many times as wide as its cells, which then lie in fewer of them.
WIDE = 2.0


def _hashable(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


def _spread(points: DataFrame) -> DataFrame:
    return points if SPREAD in points.columns else points.withColumn(SPREAD, F.pmod(F.xxhash64(*_hashable(points)), F.lit(1 << 16)).cast("int"))


def _as_given(found: DataFrame, points: DataFrame) -> DataFrame:
    """Without the spread, if the points came without it."""
    return found if SPREAD in points.columns else found.drop(SPREAD)


def _with_meta(df: DataFrame, meta: DataFrame, columns: list[str], grid: str = "grid_id") -> DataFrame:
    m = meta.select(F.col("grid_id").alias("_grid"), *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(m, df[grid] == m["_grid"], "left").drop("_grid")


def _placed(q: DataFrame, a: str, b: str) -> DataFrame:
    """Buckets ``a`` and ``b`` of each row and ``_own``, false for a row without buckets.

    Such rows find nothing; with null keys all of them would meet in one task of the look-up, so each gets buckets by its own values or by ``SPREAD``.
    """
    own = F.col(a).isNotNull() & F.col(b).isNotNull()
    aside = F.col(SPREAD).cast("long") if SPREAD in q.columns else F.pmod(F.xxhash64(*_hashable(q)), F.lit(1 << 40))
    return q.withColumns({"_own": own, a: F.when(own, F.col(a)).otherwise(aside), b: F.when(own, F.col(b)).otherwise(F.lit(-1).cast("long"))})


def pixel_to_ground(points: DataFrame, cells: DataFrame, meta: DataFrame, grid: str = "grid_id",
                    pixel: str = "pixel", scan: str = "scan", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Bilinear longitude and latitude of image points; null outside the lattice.

    A point belongs to exactly one cell (the upper edge counts only at the end of an axis), so
    the left join neither drops nor doubles points.
    """
    c = _with_meta(cells, meta, ["pixel_step", "scan_step", "pixel_max", "scan_max"])
    def buckets(low: str, high: str, step: str, last: str) -> Column:
        """A cell whose upper edge is the border of a bucket has no points in that bucket, but for the last one."""
        b = _bucket_under(F.col(high), F.col(step))
        return F.explode(F.sequence(_bucket_under(F.col(low), F.col(step)), F.when((b * F.col(step) == F.col(high)) & ~F.col(last), b - 1).otherwise(b)))

    c = c.withColumn("_p_last", F.col("p1") == F.col("_pixel_max")).withColumn("_s_last", F.col("s1") == F.col("_scan_max"))
    c = c.withColumn("_pb", buckets("p0", "p1", "_pixel_step", "_p_last")).withColumn("_sb", buckets("s0", "s1", "_scan_step", "_s_last"))
    c = c.select(F.col("grid_id").alias("_cg"), "_pb", "_sb", "_p_last", "_s_last", "p0", "p1", "s0", "s1", *LONS, *LATS)
    q = _with_meta(points, meta, ["pixel_step", "scan_step"], grid)
    q = q.withColumn("_qp", _bucket_under(F.col(pixel), F.col("_pixel_step"))).withColumn("_qs", _bucket_under(F.col(scan), F.col("_scan_step")))
    q = _placed(q, "_qp", "_qs")
    x, y = F.col(pixel), F.col(scan)
    # Coordinates that are null are inside of nothing.
    inside = ((x >= F.col("p0")) & ((x < F.col("p1")) | (F.col("_p_last") & (x == F.col("p1"))))
              & (y >= F.col("s0")) & ((y < F.col("s1")) | (F.col("_s_last") & (y == F.col("s1")))))
    j = q.join(c, (q[grid] == c["_cg"]) & (q["_qp"] == c["_pb"]) & (q["_qs"] == c["_sb"]) & inside, "left")
    u = (x - F.col("p0")) / (F.col("p1") - F.col("p0"))
    v = (y - F.col("s0")) / (F.col("s1") - F.col("s0"))

    def blend(name: str) -> Column:
        return (F.col(f"{name}00") * (1 - u) * (1 - v) + F.col(f"{name}10") * u * (1 - v)
                + F.col(f"{name}01") * (1 - u) * v + F.col(f"{name}11") * u * v)

    return j.select(*points.columns, blend("lon").alias(lon), blend("lat").alias(lat))


RIM = 1e-9


def ground_to_pixel(points: DataFrame, cells: DataFrame, meta: DataFrame, grid: str = "grid_id",
                    lon: str = "lon", lat: str = "lat", pixel: str = "pixel", scan: str = "scan", pockets: DataFrame | None = None) -> DataFrame:
    """Pixel and scan of ground points, linear on two triangles per cell; null outside the swath.

    With the ``pockets`` of the lattice (``hull_pockets``) only points outside its convex hull are null.
    Neighbouring cells test the edge they share with the same numbers, and only one of them owns
    it, so a point meets one cell at most: the left join keeps the rows as they are and nothing
    has to be grouped afterwards. The rim of the lattice counts as inside within ``RIM``.
    """
    c = _with_meta(cells, meta, ["lon_step", "lat_step", "pixel_min", "pixel_max", "scan_min", "scan_max"])
    c = c.withColumns({"_lon_step": F.col("_lon_step") * WIDE, "_lat_step": F.col("_lat_step") * WIDE})
    spread = lambda cols, step: F.sequence(_bucket(F.least(*cols) - step * RIM, step), _bucket(F.greatest(*cols) + step * RIM, step))
    area = ((F.col("lon10") - F.col("lon00")) * (F.col("lat01") - F.col("lat00")) - (F.col("lat10") - F.col("lat00")) * (F.col("lon01") - F.col("lon00")))
    # What the corners tell is worked out after the shuffle; the sides at the rim travel as bits.
    rim = [F.col("s0") == F.col("_scan_min"), F.col("p0") == F.col("_pixel_min"), F.col("s1") == F.col("_scan_max"), F.col("p1") == F.col("_pixel_max")]
    c = c.withColumn("_rim", sum((F.when(at, 1 << k).otherwise(0) for k, at in enumerate(rim)), F.lit(0)))
    turn = F.signum(area)
    low_s, low_p, top_s, top_p = (F.when(F.col("_rim").bitwiseAND(1 << k) != 0, F.abs(area) * RIM).otherwise(F.lit(0.0)) for k in range(4))
    c = (c.withColumn("_xb", F.explode(spread([F.col(n) for n in LONS], F.col("_lon_step"))))
          .withColumn("_yb", F.explode(spread([F.col(n) for n in LATS], F.col("_lat_step")))))
    c = c.select(F.col("grid_id").alias("_cg"), "_xb", "_yb", "_rim", "p0", "p1", "s0", "s1", *LONS, *LATS)
    q = _with_meta(points, meta, ["lon_step", "lat_step"], grid)
    q = q.withColumn("_qx", _bucket(F.col(lon), F.col("_lon_step") * WIDE)).withColumn("_qy", _bucket(F.col(lat), F.col("_lat_step") * WIDE))
    q = _placed(q, "_qx", "_qy")
    x, y = F.col(lon), F.col(lat)

    def side(a: str, b: str) -> Column:
        """Positive where the point lies to the left of the edge a to b, seen in lattice orientation."""
        ax, ay, bx, by = F.col(f"lon{a}"), F.col(f"lat{a}"), F.col(f"lon{b}"), F.col(f"lat{b}")
        return ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) * turn

    top, right = side("01", "11"), side("10", "11")
    inside = ((side("00", "10") >= -low_s) & (side("00", "01") <= low_p)
              & ((top < 0) | ((top_s > 0) & (top <= top_s))) & ((right > 0) | ((top_p > 0) & (right >= -top_p))))
    j = q.join(c, (q[grid] == c["_cg"]) & (q["_qx"] == c["_xb"]) & (q["_qy"] == c["_yb"]) & inside, "left")

    def share(corner: str, along: str, across: str) -> tuple[Column, Column]:
        """Steps from a corner towards its two neighbours that reach the point."""
        ax, ay = F.col(f"lon{corner}"), F.col(f"lat{corner}")
        ux, uy, vx, vy = F.col(f"lon{along}") - ax, F.col(f"lat{along}") - ay, F.col(f"lon{across}") - ax, F.col(f"lat{across}") - ay
        den = ux * vy - uy * vx
        return ((x - ax) * vy - (y - ay) * vx) / den, (ux * (y - ay) - uy * (x - ax)) / den

    low = side("10", "01") >= 0
    (u0, v0), (u1, v1) = share("00", "10", "01"), share("11", "01", "10")
    wide, tall = F.col("p1") - F.col("p0"), F.col("s1") - F.col("s0")
    px = F.when(low, F.col("p0") + u0 * wide).otherwise(F.col("p1") - u1 * wide)
    sc = F.when(low, F.col("s0") + v0 * tall).otherwise(F.col("s1") - v1 * tall)
    found = F.col("p0").isNotNull()
    placed = j.select(*points.columns, F.when(found, px).alias(pixel), F.when(found, sc).alias(scan))
    return placed if pockets is None else fill_from_pockets(placed, pockets, grid, lon, lat, pixel, scan)


def project_between(points: DataFrame, source_cells: DataFrame, source_meta: DataFrame,
                    target_cells: DataFrame, target_meta: DataFrame) -> DataFrame:
    """Source (grid_id, pixel, scan) to target (target_grid_id, target_pixel, target_scan) on the datum."""
    ground = pixel_to_ground(_spread(points), source_cells, source_meta)
    return _as_given(ground_to_pixel(ground, target_cells, target_meta, grid="target_grid_id", pixel="target_pixel", scan="target_scan"), points)


def round_trip(points: DataFrame, source_cells: DataFrame, source_meta: DataFrame,
               target_cells: DataFrame, target_meta: DataFrame) -> DataFrame:
    """Each point with the ground residual after source, target and back to ground."""
    there = project_between(_spread(points), source_cells, source_meta, target_cells, target_meta)
    back = pixel_to_ground(there, target_cells, target_meta, grid="target_grid_id", pixel="target_pixel", scan="target_scan",
                           lon="back_lon", lat="back_lat")
    d_lon, d_lat = F.col("back_lon") - F.col("lon"), F.col("back_lat") - F.col("lat")
    north = F.radians(d_lat) * F.lit(C.MOON_RADIUS_M)
    east = F.radians(d_lon) * F.lit(C.MOON_RADIUS_M) * F.cos(F.radians("lat"))
    return _as_given(back.withColumns({"delta_lon": d_lon, "delta_lat": d_lat, "ground_residual_m": F.hypot(north, east)}), points)


def round_trip_statistics(trips: DataFrame) -> DataFrame:
    """Counts and residual statistics over all points, in one row."""
    ok, r = F.col("target_pixel").isNotNull(), "ground_residual_m"
    one = trips.agg(
        F.count("*").alias("total_points"), F.count_if(ok).alias("valid_count"), F.count_if(~ok).alias("invalid_count"),
        F.avg(F.abs("delta_lon")).alias("mean_delta_lon"), F.max(F.abs("delta_lon")).alias("max_delta_lon"),
        F.avg(F.abs("delta_lat")).alias("mean_delta_lat"), F.max(F.abs("delta_lat")).alias("max_delta_lat"),
        F.avg(r).alias("mean_residual_m"), F.max(r).alias("max_residual_m"), F.min(r).alias("min_residual_m"),
        F.stddev_pop(r).alias("std_residual_m"))
    return one.withColumn("median_residual_m", exact_percentiles(trips, [], r, {"median_residual_m": 0.5}).scalar())


# --- Elevation ----------------------------------------------------------------
@dataclass(frozen=True)
class DemFrame:
    """Placement of an elevation grid: line 0 at lat_max, sample 0 at lon_min."""
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    ppd: float
    lines: int
    samples: int
    nodata: float = -32768.0


def dem_cells(dem: DataFrame, frame: DemFrame) -> DataFrame:
    """Cells with the values of their four corners; the last line and sample repeat themselves.

    A corner that is nodata, NaN or absent leaves the value null.
    """
    def owners(name: str, size: int) -> Column:
        c = F.col(name)
        return F.array_compact(F.array(
            F.struct(c.alias("at"), F.lit(0).alias("corner")),
            F.when(c > 0, F.struct((c - 1).alias("at"), F.lit(1).alias("corner"))),
            F.when(c == size - 1, F.struct(c.alias("at"), F.lit(1).alias("corner")))))

    value = F.col("elev").cast("double")
    valid = F.when((value != frame.nodata) & ~F.isnan(value), value)
    d = (dem.select("line", "sample", valid.alias("_v"))
            .withColumn("_l", F.explode(owners("line", frame.lines))).withColumn("_s", F.explode(owners("sample", frame.samples))))
    corner = lambda a, b: F.max(F.when((F.col("_l.corner") == a) & (F.col("_s.corner") == b), F.col("_v"))).alias(f"v{a}{b}")
    return d.groupBy(F.col("_l.at").alias("line"), F.col("_s.at").alias("sample")).agg(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))


def dem_contains(frame: DemFrame, lon: Column, lat: Column) -> Column:
    return geo.inside_box(lon, lat, frame.lon_min, frame.lon_max, frame.lat_min, frame.lat_max)


def sample_dem(points: DataFrame, cells: DataFrame, frame: DemFrame, lon: str = "lon", lat: str = "lat", out: str = "elevation_m") -> DataFrame:
    """Bilinear elevation; null outside the grid or where one of the four cells has no value."""
    f_line = (F.lit(frame.lat_max) - F.col(lat)) * F.lit(frame.ppd)
    f_samp = (F.col(lon) - F.lit(frame.lon_min)) * F.lit(frame.ppd)
    inside = dem_contains(frame, F.col(lon), F.col(lat))
    at = lambda f, size: F.least(F.greatest(F.floor(f), F.lit(0)), F.lit(size - 1)).cast("long")
    q = points.withColumn("_ql", F.when(inside, at(f_line, frame.lines))).withColumn("_qs", F.when(inside, at(f_samp, frame.samples)))
    q = _placed(q, "_ql", "_qs")
    c = cells.select(F.col("line").cast("long").alias("_cl"), F.col("sample").cast("long").alias("_cs"), "v00", "v01", "v10", "v11")
    j = q.join(c, inside & (q["_ql"] == c["_cl"]) & (q["_qs"] == c["_cs"]), "left")
    dl, ds = f_line - F.col("_ql"), f_samp - F.col("_qs")
    value = (F.col("v00") * (1 - ds) * (1 - dl) + F.col("v01") * ds * (1 - dl) + F.col("v10") * (1 - ds) * dl + F.col("v11") * ds * dl)
    return j.select(*points.columns, value.alias(out))


def sample_dem_nearest(points: DataFrame, dem: DataFrame, frame: DemFrame, lon: str = "lon", lat: str = "lat", out: str = "elevation_m") -> DataFrame:
    """Value of the nearest cell, half to even."""
    near = lambda f, size: F.least(F.greatest(F.rint(f), F.lit(0.0)), F.lit(float(size - 1))).cast("long")
    inside = dem_contains(frame, F.col(lon), F.col(lat))
    q = (points.withColumn("_ql", F.when(inside, near((F.lit(frame.lat_max) - F.col(lat)) * F.lit(frame.ppd), frame.lines)))
               .withColumn("_qs", F.when(inside, near((F.col(lon) - F.lit(frame.lon_min)) * F.lit(frame.ppd), frame.samples))))
    q = _placed(q, "_ql", "_qs")
    c = dem.select(F.col("line").cast("long").alias("_cl"), F.col("sample").cast("long").alias("_cs"), F.col("elev").cast("double").alias("_v"))
    j = q.join(c, inside & (q["_ql"] == c["_cl"]) & (q["_qs"] == c["_cs"]), "left")
    return j.select(*points.columns, F.when((F.col("_v") != frame.nodata) & ~F.isnan("_v"), F.col("_v")).alias(out))


def elevation_statistics(samples: DataFrame, value: str = "elevation_m") -> DataFrame:
    """Counts, shares, range, mean, median and population deviation in one row."""
    v, n = F.col(value), F.count("*")
    one = samples.agg(
        n.alias("total_points"), F.count(v).alias("valid_count"), (n - F.count(v)).alias("nodata_count"),
        (F.count(v) / n * 100.0).alias("valid_percentage"), ((n - F.count(v)) / n * 100.0).alias("nodata_percentage"),
        F.min(v).alias("min_elevation_m"), F.max(v).alias("max_elevation_m"), F.avg(v).alias("mean_elevation_m"),
        F.stddev_pop(v).alias("std_elevation_m"))
    return one.withColumn("median_elevation_m", exact_percentiles(samples, [], value, {"median_elevation_m": 0.5}).scalar())


# --- Terrain and corridors ----------------------------------------------------
def pixel_to_terrain(points: DataFrame, cells: DataFrame, meta: DataFrame, elevation_cells: DataFrame | None = None,
                     frame: DemFrame | None = None, datum_m: float = 0.0) -> DataFrame:
    """Longitude, latitude and elevation of image points; the datum height without an elevation grid."""
    ground = pixel_to_ground(_spread(points), cells, meta)
    if elevation_cells is None:
        return _as_given(ground.withColumn("elevation_m", F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.lit(float(datum_m)))), points)
    return _as_given(sample_dem(ground, elevation_cells, frame), points)


def sample_transects(transects: DataFrame, n: int = 50) -> DataFrame:
    """Evenly spaced points along each transect (start/end pixel and scan), both ends included."""
    step = F.col("ordinal") / F.lit(float(max(n - 1, 1)))
    along = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * step
    return (transects.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("pixel", along("start_pixel", "end_pixel")).withColumn("scan", along("start_scan", "end_scan")))


@dataclass(frozen=True)
class PushBroom:
    """Viewing constants of a sensor."""
    altitude_m: float
    gsd_m: float
    center: float

    @staticmethod
    def named(sensor: str) -> "PushBroom":
        altitude_km, gsd, _, center = C.PARALLAX_SENSORS[sensor]
        return PushBroom(altitude_km * 1000.0, gsd, center)

    def shift(self, elevation: Column, sample: Column) -> Column:
        return geo.pixel_displacement(elevation, sample, self.altitude_m, self.gsd_m, self.center)


@dataclass(frozen=True)
class GridPair:
    """Everything a corridor needs: source and target cell tables with their meta, elevation, viewing.

    With ``target_pockets``, points beside a bent edge of the target count as clamped to it (gate 4); without, as outside (gate 3).
    """
    source_cells: DataFrame
    source_meta: DataFrame
    target_cells: DataFrame
    target_meta: DataFrame
    elevation_cells: DataFrame
    frame: DemFrame
    view: PushBroom
    target_pockets: DataFrame | None = None


def target_corridors(points: DataFrame, grids: GridPair, margin_m: float = 150.0, scan_margin: float = 2.0) -> DataFrame:
    """Elevation-bounded search corridor of each point (grid_id, target_grid_id, pixel, scan).

    Three joins: source cell, elevation cell, target cell. Rejection reasons are kept as rows.
    """
    terrain = pixel_to_terrain(_spread(points), grids.source_cells, grids.source_meta, grids.elevation_cells, grids.frame)
    df = ground_to_pixel(terrain, grids.target_cells, grids.target_meta, grid="target_grid_id",
                         pixel="target_pixel", scan="target_scan", pockets=grids.target_pockets)
    df = _with_meta(df, grids.target_meta, ["pixel_min", "pixel_max", "scan_min", "scan_max"], "target_grid_id")
    known = F.col("elevation_m").isNotNull() & F.col("lon").isNotNull()
    # Without a height there is no target reference either.
    ref_p = F.when(known, F.col("target_pixel"))
    ref_s = F.when(known, F.col("target_scan"))
    h = F.col("elevation_m")
    a = ref_p + grids.view.shift(h - margin_m, ref_p)
    b = ref_p + grids.view.shift(h + margin_m, ref_p)
    df = df.withColumns({"target_pixel": ref_p, "target_scan": ref_s, "_a": a, "_b": b})
    df = df.withColumns({
        "elevation_min_m": h - margin_m, "elevation_max_m": h + margin_m,
        "corridor_pixel_min": F.when(F.col("_a").isNotNull(), F.least("_a", "_b")),
        "corridor_pixel_max": F.when(F.col("_a").isNotNull(), F.greatest("_a", "_b")),
        "corridor_scan_min": F.col("target_scan") - scan_margin, "corridor_scan_max": F.col("target_scan") + scan_margin,
    })
    touches = ((F.col("corridor_pixel_max") >= F.col("_pixel_min")) & (F.col("corridor_pixel_min") <= F.col("_pixel_max"))
               & (F.col("corridor_scan_max") >= F.col("_scan_min")) & (F.col("corridor_scan_min") <= F.col("_scan_max")))
    contained = ((F.col("corridor_pixel_min") >= F.col("_pixel_min")) & (F.col("corridor_pixel_max") <= F.col("_pixel_max"))
                 & (F.col("corridor_scan_min") >= F.col("_scan_min")) & (F.col("corridor_scan_max") <= F.col("_scan_max")))
    reason = first_of([
        (F.col("lon").isNull() | F.col("lat").isNull(), "SOURCE_OUT_OF_BOUNDS"),
        (h.isNull(), "NO_VALID_DEM_ELEVATION"),
        (F.col("target_pixel").isNull() | F.col("target_scan").isNull(), "TARGET_OUTSIDE_CALIBRATED_SWATH"),
        (F.col("target_pixel") == 0.0, "CORRIDOR_CLAMPED_TO_WESTERN_BOUNDARY"),
        (~touches, "CORRIDOR_OUTSIDE_TARGET_SENSOR"),
    ])
    width = F.coalesce(F.col("corridor_pixel_max") - F.col("corridor_pixel_min"), F.lit(0.0))
    return _as_given(df.withColumns({"corridor_width_px": width, "corridor_width_m": width * grids.view.gsd_m, "corridor_reason": reason,
                            "corridor_valid": reason.isNull(), "corridor_inside_array": F.coalesce(contained, F.lit(False))})
              .drop("_a", "_b", "_pixel_min", "_pixel_max", "_scan_min", "_scan_max"), points)


def physical_gates(points: DataFrame, grids: GridPair, margin_m: float = 150.0) -> DataFrame:
    """Six ordered gates per point; the first failing one is the reason. One row per input point."""
    df = target_corridors(points, grids, margin_m)
    shift = grids.view.shift(F.col("elevation_m"), F.col("target_pixel"))
    reasons = C.GATE_REASONS
    reason = first_of([
        (F.col("lon").isNull() | F.col("lat").isNull(), reasons["GATE1"]),
        (F.col("elevation_m").isNull(), reasons["GATE2"]),
        (F.col("target_pixel").isNull() | F.col("target_scan").isNull(), reasons["GATE3"]),
        (F.col("target_pixel") == 0.0, reasons["GATE4"]),
        (F.abs(shift * grids.view.gsd_m) > C.MAX_PARALLAX_M, reasons["GATE5"]),
        (~F.col("corridor_inside_array"), reasons["GATE6"]),
    ])
    reached = F.col("target_pixel") != 0.0
    return df.withColumns({
        "parallax_shift_px": F.when(reached, shift), "predicted_pixel": F.when(reached, F.col("target_pixel") + shift),
        "predicted_scan": F.when(reached, F.col("target_scan")), "rejection_reason": reason, "is_accepted": reason.isNull()})


def point_id(pixel: Column, scan: Column, ordinal: Column | None = None) -> Column:
    """PT_0007 for the seventh point of a batch, else PT_{pixel}_{scan}."""
    if ordinal is not None:
        return F.concat(F.lit("PT_"), F.lpad(ordinal.cast("string"), F.greatest(F.length(ordinal.cast("string")), F.lit(4)), F.lit("0")))
    return F.concat(F.lit("PT_"), F.rint(pixel).cast("long").cast("string"), F.lit("_"), F.rint(scan).cast("long").cast("string"))


def gate_matches(matches: DataFrame, grids: GridPair, view_width: Column | int | None = None, view_height: Column | int | None = None,
                 sensor: Column | str = "OHRC") -> DataFrame:
    """Gate the source points of matches given in view coordinates (src_x, src_y).

    A reduced view of the high-resolution camera is scaled to its full frame; other sensors and full
    views are not. View size and sensor may be columns of the match's pair.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    width, height = as_column(view_width), as_column(view_height)
    scaled = (as_column(sensor) == "OHRC") & (width > 0) & (height > 0) & (height < C.OHRC_VIEW_LINES)
    sx = F.when(scaled, (C.OHRC_SAMPLES - 1.0) / F.greatest(width - 1, F.lit(1))).otherwise(1.0)
    sy = F.when(scaled, (C.OHRC_LINES - 1.0) / F.greatest(height - 1, F.lit(1))).otherwise(1.0)
    points = matches.withColumn("pixel", F.col("src_x") * sx).withColumn("scan", F.col("src_y") * sy)
    return physical_gates(points, grids)


def gate_tally(gated: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Accepted and rejected matches per pair with the reasons by falling count.

    At most six reasons per pair, so the list is bounded; counts are formed before it is built.
    """
    per_reason = gated.groupBy(pair, "rejection_reason").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.when(F.col("rejection_reason").isNotNull(), F.struct(
        (-F.col("n")).alias("k"), F.col("rejection_reason").alias("reason")))))
    text = F.array_join(F.transform(listed, lambda r: F.concat(r["reason"], F.lit(" (count="), (-r["k"]).cast("string"), F.lit(")"))), " / ")
    accepted = F.coalesce(F.sum(F.when(F.col("rejection_reason").isNull(), F.col("n"))), F.lit(0))
    return per_reason.groupBy(pair).agg(
        F.sum("n").alias("candidates"), accepted.alias("accepted"), text.alias("_text")).select(
        pair, "candidates", "accepted", F.when(F.col("accepted") == 0, F.concat(F.lit("PHYSICAL_GATE_REJECTION: "), F.col("_text"))).alias("rejection_summary"),
        F.when(F.col("accepted") == 0, "REJECTED").alias("forced_status"))


def top_gate_reasons(gated: DataFrame, n: int = 6) -> DataFrame:
    """Most frequent gate reasons over all pairs."""
    return gated.filter("rejection_reason is not null").groupBy("rejection_reason").agg(F.count("*").alias("rejections")) \
        .orderBy(F.desc("rejections"), "rejection_reason").limit(n)
