"""Queries over lattices, elevation cells and gates.

The lattices are affine and the elevation grid is regular, so the SQL answers are closed form
or direct look-ups by index.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions import geo
from craterline.functions.stage import stage
from craterline.operators import geometry as G
from craterline.operators.pockets import hull_pockets
from craterline.queries.registry import Tables, query

PPD = 80.0


class Prepared:
    """Cell tables of one Tables object, each built once and only when asked for."""

    def __init__(self, t: Tables):
        self._t = t

    @cached_property
    def source(self):
        return stage(G.grid_cells(self._t.source_node))

    @cached_property
    def target(self):
        return stage(G.grid_cells(self._t.target_node))

    @cached_property
    def source_meta(self):
        return stage(G.grid_meta(self.source))

    @cached_property
    def target_meta(self):
        return stage(G.grid_meta(self.target))

    @cached_property
    def frame(self):
        lines = self._t.dem.agg(F.max("line")).first()[0] + 1
        return G.DemFrame(0.3, 0.3 + lines / PPD, 20.0, 21.6, PPD, lines, 128)

    @cached_property
    def dem(self):
        return G.dem_cells(self._t.dem, self.frame)

    @cached_property
    def grids(self):
        return G.GridPair(self.source, self.source_meta, self.target, self.target_meta, self.dem, self.frame, G.PushBroom.named("TMC-2"))


def points(t: Tables):
    # Written as a property of the row, as in a table of many grids; a constant would drop out of the join.
    named = lambda g: F.when(F.col("pair_id") >= 0, F.lit(g))
    return t.point.withColumn("grid_id", named("SRC")).withColumn("target_grid_id", named("TGT"))


# Source ground, then elevation, then target pixel, each by index or closed form.
FORWARD = """n AS (SELECT count(*) AS k FROM orders),
  fw AS (SELECT p.*, CASE WHEN ok THEN 20 + pixel * 0.00025 + scan * 0.00001 END AS lon, CASE WHEN ok THEN 0.5 + scan * 0.00002 - pixel * 0.000003 END AS lat FROM (
    SELECT p.*, pixel >= 0 AND pixel <= 4000 AND scan >= 0 AND (CAST(floor(scan / 100) AS bigint) + 1) * 41 + least(CAST(floor(pixel / 100) AS bigint), 39) + 1 < k AS ok
    FROM v_point p, n) p)"""
ELEVATION = """dm AS (SELECT max(line) + 1 AS h, 0.3::double + (max(line) + 1) / 80.0::double AS lat_max FROM v_dem),
  ix AS (SELECT f.*, h, (lat_max - lat) * 80.0::double AS fl, (lon - 20.0::double) * 80.0::double AS fs,
    lon BETWEEN 20.0 AND 21.6 AND lat BETWEEN 0.3 AND lat_max AS inside FROM fw f, dm),
  iy AS (SELECT *, least(greatest(CAST(floor(fl) AS bigint), 0), h - 1) AS l0, least(greatest(CAST(floor(fs) AS bigint), 0), 127) AS s0 FROM ix),
  ok AS (SELECT line, sample, elev FROM v_dem WHERE elev <> -32768),
  el AS (SELECT y.*, CASE WHEN inside THEN a.elev * (1 - (fs - s0)) * (1 - (fl - l0)) + b.elev * (fs - s0) * (1 - (fl - l0)) + c.elev * (1 - (fs - s0)) * (fl - l0)
      + d.elev * (fs - s0) * (fl - l0) END AS elevation_m FROM iy y
    LEFT JOIN ok a ON a.line = l0 AND a.sample = s0 LEFT JOIN ok b ON b.line = l0 AND b.sample = least(s0 + 1, 127)
    LEFT JOIN ok c ON c.line = least(l0 + 1, h - 1) AND c.sample = s0 LEFT JOIN ok d ON d.line = least(l0 + 1, h - 1) AND d.sample = least(s0 + 1, 127))"""
INVERSE = """iv AS (SELECT *, (0.00003 * (lon - 20.2) - 0.00002 * (lat - 0.4)) / (0.0006 * 0.00003 + 0.00002 * 0.000004)::double AS tp,
    (0.000004 * (lon - 20.2) + 0.0006 * (lat - 0.4)) / (0.0006 * 0.00003 + 0.00002 * 0.000004)::double AS ts FROM {src}),
  tg AS (SELECT i.*, CASE WHEN ok2 THEN tp END AS target_pixel, CASE WHEN ok2 THEN ts END AS target_scan FROM (
    SELECT i.*, tp >= 0 AND tp <= 1500 AND ts >= 0 AND (CAST(floor(ts / 50) AS bigint) + 1) * 31 + CAST(floor(tp / 50) AS bigint) + 1 < n.k AS ok2 FROM iv i, n) i)"""


@query(f"WITH {FORWARD} SELECT point_id, lon, lat FROM fw", {"lon": 6, "lat": 6})
def j07_pixel_to_ground(t: Tables):
    p = Prepared(t)
    return G.pixel_to_ground(points(t), p.source, p.source_meta).select("point_id", "lon", "lat")


GROUND = """gp AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS bigint) AS point_id,
    20.1 + CAST(l_partkey * 7919 % 100003 AS double) / 70000 AS lon, 0.35 + CAST(l_orderkey * 104729 % 100019 AS double) / 130000 AS lat FROM lineitem)"""


@query(f"WITH n AS (SELECT count(*) AS k FROM orders), {GROUND}, {INVERSE.format(src='gp')} SELECT point_id, target_pixel AS pixel, target_scan AS scan FROM tg",
       {"pixel": 4, "scan": 4})
def j08_ground_to_pixel(t: Tables):
    p = Prepared(t)
    g = t.spark.sql(f"WITH {GROUND.replace('lineitem', '{lineitem}')} SELECT *, CASE WHEN lon > 0 THEN 'TGT' END AS grid_id FROM gp", lineitem=t.lineitem)
    return G.ground_to_pixel(g, p.target, p.target_meta).select("point_id", "pixel", "scan")


def _edge(s: str) -> str:
    """Longitude of the first column of a lattice of full rows; it is bent inwards between the ends."""
    return f"(20.2::double + 0.000004 * ({s}) * (top - ({s})) / 50)"


BENT = f"""bn AS (SELECT CAST(o_orderkey % 31 * 50 AS double) AS pixel, CAST(floor(o_orderkey / 31) * 50 AS double) AS scan, top FROM orders, tp WHERE floor(o_orderkey / 31) * 50 <= top),
  bent AS (SELECT 'BENT' AS grid_id, pixel, scan, {_edge('scan')} + pixel * 0.0006 AS lon, 0.4::double + scan * 0.0003 AS lat FROM bn)"""


@query(f"""WITH tp AS (SELECT (count(*) // 31 - 2) * 50 AS top FROM orders), {GROUND},
  pt AS (SELECT *, lon - 0.2::double + (l % 97) / 400.0::double AS x, 0.39::double + top * 0.0003::double * ((l % 1009) / 1000.0::double) AS y FROM (
    SELECT gp.*, top, CAST(floor((lon - 20) * 100000) AS bigint) AS l FROM gp, tp)),
  rw AS (SELECT *, (y - 0.4::double) / 0.0003::double AS s, least(greatest(floor((y - 0.4::double) / 0.0003::double / 50), 0), top / 50 - 1) * 50 AS s0 FROM pt),
  ed AS (SELECT *, {_edge('s0')} + ({_edge('s0 + 50')} - {_edge('s0')}) * (s - s0) / 50 AS west FROM rw),
  ps AS (SELECT *, (x - west) / 0.0006::double AS p, s BETWEEN 0 AND top AS row_ok FROM ed)
  SELECT point_id, CASE WHEN row_ok AND p BETWEEN 0 AND 1500 THEN p WHEN row_ok AND p < 0 AND x >= 20.2 THEN 0 END::double AS pixel,
    CASE WHEN row_ok AND x >= 20.2 AND p <= 1500 THEN s END::double AS scan FROM ps""", {"pixel": 3, "scan": 3})
def j08_hull_fill(t: Tables):
    """Points on and beside a lattice with a bent edge: those in its pocket lie on the first column, at the scan of their latitude."""
    full = "tp AS (SELECT (count(*) DIV 31 - 2) * 50 AS top FROM {orders})"
    nodes = t.spark.sql(f"WITH {full}, {BENT.replace('FROM orders', 'FROM {orders}').replace('::double', '')} SELECT * FROM bent", orders=t.orders)
    cells = stage(G.grid_cells(nodes))
    top = nodes.agg(F.max("scan").alias("top"))
    g = t.spark.sql(f"WITH {GROUND.replace('lineitem', '{lineitem}')} SELECT * FROM gp", lineitem=t.lineitem)
    n = F.floor((F.col("lon") - 20) * 100000)
    g = g.select("point_id", (F.col("lon") - 0.2 + n % 97 / 400.0).alias("lon"), (0.39 + top.scalar() * 0.0003 * (n % 1009 / 1000.0)).alias("lat"),
                 F.when(F.col("lon") > 0, F.lit("BENT")).alias("grid_id"))
    return G.ground_to_pixel(g, cells, stage(G.grid_meta(cells)), pockets=stage(hull_pockets(cells))).select("point_id", "pixel", "scan")


@query(f"WITH {FORWARD}, {INVERSE.format(src='fw')} SELECT point_id, lon, lat, target_pixel, target_scan FROM tg",
       {"lon": 6, "lat": 6, "target_pixel": 4, "target_scan": 4})
def j09_project_between(t: Tables):
    p = Prepared(t)
    return G.project_between(points(t), p.source, p.source_meta, p.target, p.target_meta).select(
        "point_id", "lon", "lat", "target_pixel", "target_scan")


@query(f"""WITH {FORWARD}, {INVERSE.format(src='fw')} SELECT count(*) AS total_points, count(target_pixel) AS valid_count, count(*) - count(target_pixel) AS invalid_count,
  CASE WHEN count(target_pixel) > 0 THEN 0.0::double END AS mean_residual_m, CASE WHEN count(target_pixel) > 0 THEN 0.0::double END AS median_residual_m, CASE WHEN count(target_pixel) > 0 THEN 0.0::double END AS max_residual_m FROM tg""",
       {"mean_residual_m": 4, "median_residual_m": 4, "max_residual_m": 4})
def a02_round_trip_residual(t: Tables):
    p = Prepared(t)
    trips = stage(G.round_trip(points(t), p.source, p.source_meta, p.target, p.target_meta).select(
        "target_pixel", "delta_lon", "delta_lat", "ground_residual_m"))
    return G.round_trip_statistics(trips).select("total_points", "valid_count", "invalid_count", "mean_residual_m", "median_residual_m", "max_residual_m")


@query("""SELECT grid_id, count(*) AS records, count(DISTINCT pixel) AS unique_pixels, count(DISTINCT scan) AS unique_scans,
  count(*) = count(DISTINCT pixel) * count(DISTINCT scan) AS is_rectilinear, min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max
  FROM v_source_node GROUP BY grid_id""", {c: 6 for c in ("lon_min", "lon_max", "lat_min", "lat_max")})
def a03_grid_summary(t: Tables):
    return G.grid_summary(t.source_node).select(
        "grid_id", "records", "unique_pixels", "unique_scans", "is_rectilinear", "lon_min", "lon_max", "lat_min", "lat_max")


@query(f"WITH {FORWARD}, {ELEVATION} SELECT point_id, elevation_m FROM el", {"elevation_m": 3})
def j06_sample_dem(t: Tables):
    p = Prepared(t)
    return G.sample_dem(G.pixel_to_ground(points(t), p.source, p.source_meta), p.dem, p.frame).select("point_id", "elevation_m")


@query(f"""WITH {GROUND}, dm AS (SELECT max(line) + 1 AS h, 0.3::double + (max(line) + 1) / 80.0::double AS lat_max FROM v_dem),
  x AS (SELECT point_id, lon, lat, h, lat_max, least(greatest(CAST(round_even((lat_max - lat) * 80.0::double, 0) AS bigint), 0), h - 1) AS l0,
    least(greatest(CAST(round_even((lon - 20.0::double) * 80.0::double, 0) AS bigint), 0), 127) AS s0 FROM gp, dm)
  SELECT point_id, d.elev AS elevation_m FROM x LEFT JOIN v_dem d ON d.line = l0 AND d.sample = s0 AND d.elev <> -32768
    AND lon BETWEEN 20.0 AND 21.6 AND lat BETWEEN 0.3 AND lat_max""")
def j06_sample_dem_nearest(t: Tables):
    p = Prepared(t)
    g = t.spark.sql(f"WITH {GROUND.replace('lineitem', '{lineitem}')} SELECT * FROM gp", lineitem=t.lineitem)
    return G.sample_dem_nearest(g, t.dem, p.frame).select("point_id", "elevation_m")


STATS = {c: 3 for c in ("valid_percentage", "min_elevation_m", "max_elevation_m", "mean_elevation_m", "median_elevation_m", "std_elevation_m")}


@query(f"""WITH {FORWARD}, {ELEVATION} SELECT count(*) AS total_points, count(elevation_m) AS valid_count, count(*) - count(elevation_m) AS nodata_count,
  count(elevation_m) / count(*) * 100.0 AS valid_percentage, min(elevation_m) AS min_elevation_m, max(elevation_m) AS max_elevation_m,
  avg(elevation_m) AS mean_elevation_m, quantile_cont(elevation_m, 0.5) AS median_elevation_m, stddev_pop(elevation_m) AS std_elevation_m FROM el""", STATS)
def a01_elevation_statistics(t: Tables):
    p = Prepared(t)
    heights = stage(G.pixel_to_terrain(points(t), p.source, p.source_meta, p.dem, p.frame).select("elevation_m"))
    return G.elevation_statistics(heights).select(
        "total_points", "valid_count", "nodata_count", *STATS)


@query(f"WITH {FORWARD}, {ELEVATION} SELECT point_id, lon, lat, elevation_m FROM el", {"lon": 6, "lat": 6, "elevation_m": 3})
def d01_pixel_to_terrain(t: Tables):
    p = Prepared(t)
    return G.pixel_to_terrain(points(t), p.source, p.source_meta, p.dem, p.frame).select("point_id", "lon", "lat", "elevation_m")


TRANSECT = """SELECT o_orderkey AS transect_id, CAST(o_orderkey % 4000 AS double) AS start_pixel, CAST(o_orderkey * 2 AS double) AS start_scan,
  CAST(o_custkey * 3 % 4000 AS double) AS end_pixel, CAST(o_orderkey * 2 + 40 AS double) AS end_scan FROM {orders}"""


@query(f"""WITH n AS (SELECT count(*) AS k FROM orders), tr AS ({TRANSECT.format(orders='orders')}),
  ti AS (SELECT *, start_pixel + (end_pixel - start_pixel) * (ordinal / 9.0::double) AS pixel, start_scan + (end_scan - start_scan) * (ordinal / 9.0::double) AS scan
    FROM tr, (SELECT CAST(unnest(range(0, 10)) AS integer) AS ordinal) q)
  SELECT transect_id, ordinal, pixel, scan, CASE WHEN ok THEN 20 + pixel * 0.00025 + scan * 0.00001 END AS lon FROM (
    SELECT ti.*, (CAST(floor(scan / 100) AS bigint) + 1) * 41 + least(CAST(floor(pixel / 100) AS bigint), 39) + 1 < k AS ok FROM ti, n)""",
       {"pixel": 4, "scan": 4, "lon": 6})
def d02_sample_transect(t: Tables):
    p = Prepared(t)
    tr = G.sample_transects(t.spark.sql(TRANSECT, orders=t.orders).withColumn("grid_id", F.lit("SRC")), 10)
    return G.pixel_to_ground(tr, p.source, p.source_meta).select("transect_id", "ordinal", "pixel", "scan", "lon")


_SHIFT = "(-({h}) * tan(atan(({p} - 1999.5::double) * 6.0::double / 121430.0::double)) / 6.0::double)"
GATES = f"""{FORWARD}, {ELEVATION}, {INVERSE.format(src='el')},
  bd AS (SELECT max(s1) AS smax FROM (SELECT scan + 50 AS s1 FROM v_target_node v, n WHERE pixel = 0 AND (scan // 50 + 1) * 31 + 1 < k)),
  rf AS (SELECT *, CASE WHEN elevation_m IS NOT NULL THEN target_pixel END AS rp, CASE WHEN elevation_m IS NOT NULL THEN target_scan END AS rs FROM tg, bd),
  cr AS (SELECT *, rp + {_SHIFT.format(h='elevation_m - 150', p='rp')} AS c0, rp + {_SHIFT.format(h='elevation_m + 150', p='rp')} AS c1,
    {_SHIFT.format(h='elevation_m', p='rp')} AS dp FROM rf),
  co AS (SELECT *, least(c0, c1) AS lo, greatest(c0, c1) AS hi FROM cr)"""


@query(f"""WITH {GATES} SELECT point_id, rp AS target_pixel, rs AS target_scan, lo AS corridor_pixel_min, hi AS corridor_pixel_max, coalesce(hi - lo, 0) * 6 AS corridor_width_m,
  CASE WHEN lon IS NULL THEN 'SOURCE_OUT_OF_BOUNDS' WHEN elevation_m IS NULL THEN 'NO_VALID_DEM_ELEVATION' WHEN rp IS NULL THEN 'TARGET_OUTSIDE_CALIBRATED_SWATH'
    WHEN hi < 0 OR lo > 1500 OR rs + 2 < 0 OR rs - 2 > smax THEN 'CORRIDOR_OUTSIDE_TARGET_SENSOR' END AS corridor_reason FROM co""",
       {c: 3 for c in ("target_pixel", "target_scan", "corridor_pixel_min", "corridor_pixel_max", "corridor_width_m")})
def d03_target_corridors(t: Tables):
    p = Prepared(t)
    return G.target_corridors(points(t), p.grids).select(
        "point_id", "target_pixel", "target_scan", "corridor_pixel_min", "corridor_pixel_max", "corridor_width_m", "corridor_reason")


GATED = f"""{GATES}, gt AS (SELECT *, CASE WHEN lon IS NULL THEN '{C.GATE_REASONS['GATE1']}' WHEN elevation_m IS NULL THEN '{C.GATE_REASONS['GATE2']}'
    WHEN rp IS NULL THEN '{C.GATE_REASONS['GATE3']}' WHEN rp = 0 THEN '{C.GATE_REASONS['GATE4']}' WHEN abs(dp * 6) > 350 THEN '{C.GATE_REASONS['GATE5']}'
    WHEN NOT (lo >= 0 AND hi <= 1500 AND rs - 2 >= 0 AND rs + 2 <= smax) THEN '{C.GATE_REASONS['GATE6']}' END AS rejection_reason FROM co)"""


@query(f"WITH {GATED} SELECT point_id, rp + dp AS predicted_pixel, dp AS parallax_shift_px, rejection_reason, rejection_reason IS NULL AS is_accepted FROM gt",
       {"predicted_pixel": 3, "parallax_shift_px": 4})
def d04_physical_gates(t: Tables):
    p = Prepared(t)
    return G.physical_gates(points(t), p.grids).select("point_id", "predicted_pixel", "parallax_shift_px", "rejection_reason", "is_accepted")


def gated(t: Tables):
    p = Prepared(t)
    m = points(t).withColumnsRenamed({"pixel": "src_x", "scan": "src_y"})
    return G.gate_matches(m, p.grids)


@query(f"""WITH {GATED}, c AS (SELECT pair_id, rejection_reason, count(*) AS k FROM gt GROUP BY pair_id, rejection_reason)
  SELECT pair_id, CAST(sum(k) AS bigint) AS candidates, CAST(coalesce(sum(k) FILTER (WHERE rejection_reason IS NULL), 0) AS bigint) AS accepted,
    CASE WHEN coalesce(sum(k) FILTER (WHERE rejection_reason IS NULL), 0) = 0 THEN 'PHYSICAL_GATE_REJECTION: '
      || string_agg(rejection_reason || ' (count=' || k || ')', ' / ' ORDER BY k DESC, rejection_reason) FILTER (WHERE rejection_reason IS NOT NULL) END AS rejection_summary,
    CASE WHEN coalesce(sum(k) FILTER (WHERE rejection_reason IS NULL), 0) = 0 THEN 'REJECTED' END AS forced_status FROM c GROUP BY pair_id""")
def d05_gate_matches(t: Tables):
    return G.gate_tally(gated(t))


@query(f"""WITH {GATED} SELECT pair_id, rejection_reason, count(*) AS rejections FROM gt WHERE rejection_reason IS NOT NULL GROUP BY pair_id, rejection_reason""")
def a11_gate_rejection_tally(t: Tables):
    return gated(t).filter("rejection_reason is not null").groupBy("pair_id", "rejection_reason").agg(F.count("*").alias("rejections"))


@query(f"""WITH {GATED} SELECT rejection_reason, count(*) AS rejections FROM gt WHERE rejection_reason IS NOT NULL GROUP BY rejection_reason
  ORDER BY rejections DESC, rejection_reason LIMIT 3""")
def o02_top_gate_reasons(t: Tables):
    return G.top_gate_reasons(gated(t), 3)


PARALLAX = ["look_deg", "ground_m", "pixels", "max_ground_m", "new_lon", "new_lat"]


@query("""WITH s AS (SELECT o_orderkey, sensor, CASE sensor WHEN 'OHRC' THEN 102710.0 ELSE 121430.0 END::double AS alt, CASE sensor WHEN 'OHRC' THEN 0.25 ELSE 6.0 END::double AS gsd,
    CASE sensor WHEN 'OHRC' THEN 5999.5 ELSE 1999.5 END::double AS xc, CASE sensor WHEN 'OHRC' THEN 11999.0 ELSE 3999.0 END::double AS xl,
    CAST(o_custkey * 7 % 4000 AS double) AS x, o_totalprice / 100 AS h, CAST(o_orderkey % 360 AS double) AS lon, CAST(o_orderkey % 120 - 60 AS double) AS lat FROM (
    SELECT *, CASE o_orderkey % 2 WHEN 0 THEN 'OHRC' ELSE 'TMC-2' END AS sensor FROM orders)),
  d AS (SELECT *, -h * tan(atan((x - xc) * gsd / alt)) AS g FROM s)
  SELECT o_orderkey, degrees(atan((x - xc) * gsd / alt)) AS look_deg, g AS ground_m, g / gsd AS pixels, abs(-h * tan(atan((xl - xc) * gsd / alt))) AS max_ground_m,
    lon + g * sin(radians(100.0)) / (1737400.0 * cos(radians(lat))) * (180.0 / pi()) AS new_lon, lat + g * cos(radians(100.0)) / 1737400.0 * (180.0 / pi()) AS new_lat FROM d""",
       {c: 4 for c in PARALLAX})
def m05_parallax(t: Tables):
    sensor = F.when(F.col("o_orderkey") % 2 == 0, "OHRC").otherwise("TMC-2")
    alt, gsd, n, xc = (geo.sensor_constant(sensor, i) for i in range(4))
    x, h = (F.col("o_custkey") * 7 % 4000).cast("double"), F.col("o_totalprice") / 100
    lon, lat = (F.col("o_orderkey") % 360).cast("double"), (F.col("o_orderkey") % 120 - 60).cast("double")
    g = geo.ground_displacement(h, x, alt, gsd, xc)
    new_lon, new_lat = geo.parallax_corrected(lon, lat, g, 10.0)
    return t.orders.select(
        "o_orderkey", F.degrees(geo.look_angle(x, alt, gsd, xc)).alias("look_deg"), g.alias("ground_m"),
        geo.pixel_displacement(h, x, alt, gsd, xc).alias("pixels"), geo.max_displacement(h, alt, gsd, n, xc).alias("max_ground_m"),
        new_lon.alias("new_lon"), new_lat.alias("new_lat"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'PT_' || lpad(CAST(o_orderkey AS string), CAST(greatest(length(CAST(o_orderkey AS string)), 4) AS integer), '0')
    ELSE 'PT_' || CAST(o_orderkey AS string) || '_' || CAST(o_custkey AS string) END AS point_id, pi() * 1737400.0 / 180.0 / (1 + o_custkey % 512) AS dem_resolution_m,
  o_custkey % 100 BETWEEN 9 AND 51 AND o_orderkey % 100 BETWEEN 19 AND 71 AND o_orderkey % 4 <> 0 AS in_corridor FROM orders""", {"dem_resolution_m": 4})
def p09_corridor_contains(t: Tables):
    ordinal = F.col("o_orderkey")
    named = F.when(ordinal % 3 == 0, G.point_id(ordinal, ordinal, ordinal)).otherwise(
        G.point_id(ordinal.cast("double") + 0.25, F.col("o_custkey").cast("double")))
    inside = geo.corridor_contains(ordinal % 4 != 0, F.lit(10.0), F.lit(50.0), F.lit(20.0), F.lit(70.0), F.col("o_custkey") % 100, ordinal % 100)
    return t.orders.select("o_orderkey", named.alias("point_id"), geo.dem_resolution_m(1 + F.col("o_custkey") % 512).alias("dem_resolution_m"), inside.alias("in_corridor"))


@query(f"""WITH {FORWARD}, {INVERSE.format(src='fw')} SELECT point_id, lon IS NOT NULL AS in_source, coalesce(lon BETWEEN 20.0 AND 21.6 AND lat BETWEEN 0.3 AND 1.3, false) AS in_dem,
  target_pixel IS NOT NULL AS ground_in_target FROM tg""")
def p08_domain_predicates(t: Tables):
    p = Prepared(t)
    frame = G.DemFrame(0.3, 1.3, 20.0, 21.6, PPD, 80, 128)
    df = G.project_between(points(t), p.source, p.source_meta, p.target, p.target_meta)
    return df.select("point_id", F.col("lon").isNotNull().alias("in_source"), F.coalesce(G.dem_contains(frame, F.col("lon"), F.col("lat")), F.lit(False)).alias("in_dem"),
                     F.col("target_pixel").isNotNull().alias("ground_in_target"))



