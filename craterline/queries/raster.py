"""Queries over pixel tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from craterline.functions.score import gradient_alignment
from craterline.functions.stage import shared_folder, stage
from craterline.operators import raster as R
from craterline.operators import tiles as TL
from craterline.queries.registry import Tables, query
from craterline.sources import raster_source


@query("SELECT product_id, line, sample, dn FROM v_pixel WHERE dn <> 7 AND band = 0")
def p10_nodata_and_band(t: Tables):
    return R.select_band(R.mask_nodata(t.pixel, 7.0), 0).select("product_id", "line", "sample", "dn")


@query("SELECT product_id, line, sample, dn FROM v_pixel")
def s08_raster_round_trip(t: Tables):
    """All products as one raster, their lines in turn, written in strips and read back; places without a pixel are NaN."""
    raster_source.register(t.spark)
    path = f"{shared_folder(t.spark)}/raster-{uuid.uuid4().hex}"
    number = F.col("line") * 5 + F.right("product_id", F.lit(1)).cast("long")
    held = t.pixel.groupBy(number.alias("line")).agg(F.map_from_entries(F.collect_list(F.struct("sample", "dn"))).alias("m"))  # 64 samples
    dns = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(float("nan"))))
    options = {"path": path, "data_type": "ieee754lsbsingle", "samples": "64"}
    held.select("line", dns.alias("dns")).repartitionByRange("line").sortWithinPartitions("line").write.format("raster_lines").options(**options).mode("append").save()
    back = t.spark.read.format("raster_lines").options(**options, partition_bytes=str(1 << 16)).load()
    pixels = back.select("line", F.posexplode("dns").alias("sample", "dn")).filter(~F.isnan("dn"))
    return pixels.select(F.concat(F.lit("IMG-"), (F.col("line") % 5).cast("string")).alias("product_id"), F.floor(F.col("line") / 5).alias("line"), F.col("sample").cast("long").alias("sample"), "dn")


@query("""WITH s AS (SELECT product_id, greatest(CAST(ceil(greatest(max(line), max(sample)) + 1) AS bigint), 1) AS side FROM v_pixel GROUP BY product_id)
  SELECT p.product_id, line, sample, dn FROM v_pixel p JOIN s ON s.product_id = p.product_id
  WHERE line % greatest(CAST(ceil(side / 16) AS bigint), 1) = 0 AND sample % greatest(CAST(ceil(side / 16) AS bigint), 1) = 0""")
def p10_decimate(t: Tables):
    return R.decimate(t.pixel, 16).select("product_id", "line", "sample", "dn")


RAW = "CASE WHEN o_orderkey % 4999 = 0 THEN 'NaN' WHEN o_orderkey % 7001 = 3 THEN 'Infinity' ELSE '1.5' END"


@query(f"""SELECT product_id, bool_or(isnan(v)) AS has_nan, bool_or(isinf(v)) AS has_inf FROM (
  SELECT 'IMG-' || CAST(o_orderkey % 11 AS string) AS product_id, CAST({RAW} AS double) AS v FROM orders) GROUP BY product_id""")
def p03_raster_integrity(t: Tables):
    return R.integrity(t.spark.sql(
        f"SELECT 'IMG-' || CAST(o_orderkey % 11 AS string) AS product_id, CAST({RAW} AS double) AS dn FROM {{orders}}", orders=t.orders))


@query("""SELECT p.product_id, line, sample, CASE WHEN hi > lo THEN CAST(floor((dn - lo) / (hi - lo) * 255.0::double) AS integer) ELSE 0 END AS dn8
  FROM v_pixel p JOIN (SELECT product_id, min(dn) AS lo, max(dn) AS hi FROM v_pixel GROUP BY product_id) m ON m.product_id = p.product_id""")
def a22_stretch_8bit(t: Tables):
    return R.stretch_8bit(t.pixel).select("product_id", "line", "sample", "dn8")


def _lines(t: Tables) -> int:
    return t.pixel.agg(F.max("line")).first()[0] + 1


@query("SELECT product_id, line // 4 AS line, sample // 4 AS sample, avg(dn) AS dn FROM v_pixel GROUP BY product_id, line // 4, sample // 4", {"dn": 4})
def a23_downsample(t: Tables):
    # The frame is padded to whole output lines.
    return R.downsample(t.pixel, 4.0, -(-_lines(t) // 4) * 4, 64).select("product_id", "line", "sample", "dn")


@query("""WITH f AS (SELECT max(line) + 1 AS h FROM v_pixel), o AS (SELECT h, greatest(CAST(round_even(h / 2.5, 0) AS bigint), 1) AS oh, 26 AS ow FROM f),
  a AS (SELECT p.*, k.k AS ok, least((line + 1) * oh / h::double, k.k + 1) - greatest(line * oh / h::double, k.k) AS wl, ow FROM v_pixel p, o,
    (SELECT unnest(range(0, 2)) AS d) q, LATERAL (SELECT CAST(floor(line * oh / h::double) AS bigint) + q.d AS k) k WHERE k.k < oh),
  b AS (SELECT a.*, m.k AS os, least((sample + 1) * ow / 64.0::double, m.k + 1) - greatest(sample * ow / 64.0::double, m.k) AS ws FROM a,
    (SELECT unnest(range(0, 2)) AS d) q, LATERAL (SELECT CAST(floor(sample * ow / 64.0::double) AS bigint) + q.d AS k) m WHERE m.k < ow)
  SELECT product_id, ok AS line, os AS sample, sum(dn * wl * ws) / sum(wl * ws) AS dn FROM b WHERE wl > 0 AND ws > 0 AND wl * ws > 1e-12 GROUP BY product_id, ok, os""", {"dn": 3})
def a23_downsample_fractional(t: Tables):
    return R.downsample(t.pixel, 2.5, _lines(t), 64).select("product_id", "line", "sample", "dn")


@query("""WITH l AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k),
  x AS (SELECT 'P' || CAST(o_orderkey AS string) AS product_id, CAST(l.k AS integer) AS level_index, CASE l.k WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 4.0 WHEN 3 THEN 8.0 WHEN 4 THEN 16.0
      ELSE 6.07::double / 0.26::double END::double AS scale_factor, 1000 + o_custkey AS lines, 1200 AS samples FROM orders, l)
  SELECT product_id, level_index, scale_factor, 0.26::double * scale_factor AS effective_gsd_m,
    CASE level_index WHEN 0 THEN 'Level_0_Original' WHEN 5 THEN 'Level_5_TMC_Equivalent' ELSE 'Level_' || level_index END AS level_name,
    CASE WHEN level_index = 0 THEN lines ELSE CAST(round_even(lines / scale_factor, 0) AS bigint) END AS lines,
    level_index > 0 AS derived_from_real_data FROM x""", {"effective_gsd_m": 6, "scale_factor": 6})
def a23_pyramid_levels(t: Tables):
    products = t.orders.select(F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("product_id"), F.lit(0.26).alias("gsd_m"),
                               (1000 + F.col("o_custkey")).alias("lines"), F.lit(1200).cast("long").alias("samples"))
    return R.pyramid_levels(products, 6.07).select("product_id", "level_index", "scale_factor", "effective_gsd_m", "level_name", "lines", "derived_from_real_data")


def _tap(k: int) -> str:
    import math
    return repr(math.exp(-k * k / (2.0 * 0.8 * 0.8)))


_TAPS = ", ".join(f"({k}, {_tap(k)}::double)" for k in range(-2, 3))


@query(f"""WITH t(k, w) AS (VALUES {_TAPS}), m AS (SELECT product_id, max(line) AS hl FROM v_pixel GROUP BY product_id),
  a AS (SELECT p.product_id, line + k AS line, sample, sum(dn * w) / sum(w) AS dn FROM v_pixel p JOIN m USING (product_id), t WHERE line + k BETWEEN 0 AND hl GROUP BY p.product_id, line + k, sample)
  SELECT product_id, line, sample + k AS sample, sum(dn * w) / sum(w) AS dn FROM a, t WHERE sample + k BETWEEN 0 AND 63 GROUP BY product_id, line, sample + k""", {"dn": 4})
def a23_gaussian_prefilter(t: Tables):
    return R.gaussian_blur(t.pixel, 0.8)


def _weights(axis: str, full: str, scale: str, taps: str) -> str:
    """SQL for the weights of input places in each output of an axis: Gaussian taps, mirrored ends, shares of the outputs."""
    return f"""SELECT o, src, sum(part * w) AS w FROM (
      SELECT o.o, t.w, least((x.x + 1), (o.o + 1) * {full} / n::double) - greatest(x.x, o.o * {full} / n::double) AS part,
        CASE WHEN abs(x.x + t.k) < {full} THEN abs(x.x + t.k) ELSE 2 * ({full} - 1) - (x.x + t.k) END AS src
      FROM (SELECT h, ww, greatest(CAST(round_even({full} / {scale}, 0) AS bigint), 1) AS n FROM f) f, LATERAL (SELECT unnest(range(0, n)) AS o) o,
        LATERAL (SELECT unnest(range(CAST(floor(o.o * {full} / n::double) AS bigint), least({full}, CAST(ceil((o.o + 1) * {full} / n::double) AS bigint)))) AS x) x, (VALUES {taps}) t(k, w))
      WHERE part > 0 GROUP BY o, src"""


def _gauss(scale: float) -> str:
    import math
    sigma = scale / 2 - 0.2
    reach = math.ceil(2 * sigma)
    taps = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)}
    return ", ".join(f"({k}, {w / sum(taps.values())!r}::double)" for k, w in taps.items())


_LEVEL = """SELECT p.product_id, CAST({k} AS integer) AS level_index, a.o AS line, b.o AS sample, sum(dn * a.w * b.w) / sum(a.w * b.w) AS dn
    FROM v_pixel p JOIN wl{k} a ON a.src = p.line JOIN ws{k} b ON b.src = p.sample GROUP BY p.product_id, a.o, b.o"""


@query("WITH f AS (SELECT max(line) + 1 AS h, 64 AS ww FROM v_pixel), " + ", ".join(
    f"wl{k} AS ({_weights('line', 'h', s, _gauss(x))}), ws{k} AS ({_weights('sample', 'ww', s, _gauss(x))})" for k, x, s in ((1, 2.0, "2.0::double"), (2, 4.0, "4.0::double"), (5, 6.07 / 2.0, "(6.07::double / 2.0::double)")))
    + " SELECT product_id, CAST(0 AS integer) AS level_index, line, sample, dn FROM v_pixel UNION ALL " + " UNION ALL ".join(_LEVEL.format(k=k) for k in (1, 2, 5)), {"dn": 4})
def a23_smoothed_pyramid(t: Tables):
    """Levels 0, 1, 2 and the one of the target's sampling, each smoothed before it is averaged."""
    frame = t.pixel.agg((F.max("line") + 1).alias("lines"))
    products = t.pixel.select("product_id").distinct().select("product_id", frame.scalar().alias("lines"), F.lit(2.0).alias("gsd_m"), F.lit(64).cast("long").alias("samples"))
    return TL.pyramid(t.pixel.drop("band"), products, 6.07)[1].filter("level_index in (0, 1, 2, 5)").select("product_id", "level_index", "line", "sample", "dn")


GRAD = """g AS (SELECT product_id, line, sample, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN (r - l) / 2.0 WHEN r IS NOT NULL THEN r - dn WHEN l IS NOT NULL THEN dn - l ELSE 0 END::double AS gx,
    CASE WHEN u IS NOT NULL AND d IS NOT NULL THEN (d - u) / 2.0 WHEN d IS NOT NULL THEN d - dn WHEN u IS NOT NULL THEN dn - u ELSE 0 END::double AS gy FROM (
    SELECT *, lag(dn) OVER a AS l, lead(dn) OVER a AS r, lag(dn) OVER b AS u, lead(dn) OVER b AS d FROM v_pixel
    WINDOW a AS (PARTITION BY product_id, line ORDER BY sample), b AS (PARTITION BY product_id, sample ORDER BY line)))"""


@query(f"WITH {GRAD} SELECT product_id, line, sample, gx, gy, sqrt(gx * gx + gy * gy) AS slope FROM g", {"slope": 4})
def w06_central_gradients(t: Tables):
    return TL.central_gradients(t.pixel).select("product_id", "line", "sample", "gx", "gy", "slope")


SOBEL = """sx AS (SELECT *, lag(dn) OVER a + 2 * dn + lead(dn) OVER a AS smooth, lead(dn) OVER a - lag(dn) OVER a AS diff FROM v_pixel
    WINDOW a AS (PARTITION BY product_id, line ORDER BY sample)),
  sb AS (SELECT product_id, line, sample, lag(diff) OVER b + 2 * diff + lead(diff) OVER b AS gx, lead(smooth) OVER b - lag(smooth) OVER b AS gy FROM sx
    WINDOW b AS (PARTITION BY product_id, sample ORDER BY line) QUALIFY gx IS NOT NULL AND gy IS NOT NULL)"""


@query(f"WITH {SOBEL} SELECT product_id, line, sample, gx, gy FROM sb")
def w06_sobel(t: Tables):
    return TL.sobel(t.pixel).select("product_id", "line", "sample", "gx", "gy")


MEAN = f"""{SOBEL}, md AS (SELECT product_id, avg(gx / (sqrt(gx * gx + gy * gy) + 1e-6)) AS mean_gx, avg(gy / (sqrt(gx * gx + gy * gy) + 1e-6)) AS mean_gy FROM sb GROUP BY product_id)"""


@query(f"""WITH {MEAN} SELECT a.product_id AS src, b.product_id AS tgt, least(greatest(((a.mean_gx * b.mean_gx + a.mean_gy * b.mean_gy)
   / (sqrt(a.mean_gx * a.mean_gx + a.mean_gy * a.mean_gy) * sqrt(b.mean_gx * b.mean_gx + b.mean_gy * b.mean_gy) + 1e-6) + 1) / 2, 0), 1) AS alignment
   FROM md a JOIN md b ON CAST(right(b.product_id, 1) AS bigint) = CAST(right(a.product_id, 1) AS bigint) + 1""", {"alignment": 4})
def a24_gradient_alignment(t: Tables):
    m = stage(TL.mean_direction(t.pixel))
    number = F.right("product_id", F.lit(1)).cast("long")
    a = m.select(F.col("product_id").alias("src"), (number + 1).alias("n"), F.col("mean_gx").alias("sx"), F.col("mean_gy").alias("sy"))
    b = m.select(F.col("product_id").alias("tgt"), number.alias("n"), F.col("mean_gx").alias("tx"), F.col("mean_gy").alias("ty"))
    return a.join(b, "n").select("src", "tgt", gradient_alignment(*[F.col(c) for c in ("sx", "sy", "tx", "ty")]).alias("alignment"))


@query(f"""WITH {GRAD}, q AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS bigint) AS key,
    'IMG-' || CAST(l_orderkey % 5 AS string) AS product_id, greatest(least(l_partkey % 64, 61), 2) AS cx, greatest(least(l_orderkey % 45, h - 3), 2) AS cy
    FROM lineitem, (SELECT max(line) + 1 AS h FROM v_pixel))
  SELECT key, avg(sqrt(gx * gx + gy * gy)) AS slope_mean FROM q LEFT JOIN g ON g.product_id = q.product_id AND g.line BETWEEN cy - 1 AND cy + 1 AND g.sample BETWEEN cx - 1 AND cx + 1 GROUP BY key""",
       {"slope_mean": 3})
def w06_mean_slope_at_points(t: Tables):
    pts = t.point.select(F.col("point_id").alias("key"), F.split("point_id", "-").alias("k"))
    pts = pts.select("key", F.concat(F.lit("IMG-"), (F.col("k")[0].cast("long") % 5).cast("string")).alias("product_id"),
                     (F.col("k")[1].cast("long") % 64).cast("double").alias("x"), (F.col("k")[0].cast("long") % 45).cast("double").alias("y"))
    return R.mean_slope_at(pts, TL.central_gradients(t.pixel), _lines(t), 64).select("key", "slope_mean")


@query("""SELECT pair_id, count(*) AS overlap_pixels, count(*) FILTER (WHERE a > 5 AND b > 5) AS valid_pixels,
    sqrt(CASE WHEN count(*) FILTER (WHERE a > 5 AND b > 5) > 100 THEN avg((a - b) * (a - b)) FILTER (WHERE a > 5 AND b > 5) ELSE avg((a - b) * (a - b)) END) AS rmse FROM (
  SELECT s.product_id || '>' || t.product_id AS pair_id, s.dn AS a, t.dn AS b FROM v_pixel s JOIN v_pixel t ON t.line = s.line + 2 AND t.sample = s.sample + 3
    AND CAST(right(t.product_id, 1) AS bigint) = (CAST(right(s.product_id, 1) AS bigint) + 1) % 5) GROUP BY pair_id""", {"rmse": 4})
def a25_overlap_rmse(t: Tables):
    n = F.right("product_id", F.lit(1)).cast("long")
    target = F.concat(F.lit("IMG-"), ((n + 1) % 5).cast("string"))
    pairs = t.pixel.select("product_id").distinct().select(
        F.concat("product_id", F.lit(">"), target).alias("pair_id"), F.col("product_id").alias("source_id"), target.alias("target_id"),
        F.array(*[F.lit(float(v)) for v in (1, 0, 3, 0, 1, 2, 0, 0, 1)]).alias("h"))
    return R.overlap_rmse(t.pixel, t.pixel, pairs)
