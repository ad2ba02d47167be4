"""Queries over matches, pair verification and uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from craterline.functions import geo
from craterline.functions import score as S
from craterline.functions.common import all_of
from craterline.operators import matching as M
from craterline.operators import neighbours as N
from craterline.operators import verification as V
from craterline.queries.registry import Tables, query

SHIFT = [1.0, 0.0, 25.0, 0.0, 1.0, -18.0, 0.0, 0.0, 1.0]
RES = "r AS (SELECT *, sqrt(pow(src_x + 25 - tgt_x, 2) + pow(src_y - 18 - tgt_y, 2)) AS residual FROM v_match)"


def shifts(t: Tables):
    """The known transform of every pair."""
    return t.match.select("pair_id").distinct().withColumn("h", F.array(*[F.lit(v) for v in SHIFT]))


def residuals(t: Tables):
    return M.with_residuals(t.match, shifts(t))


@query(f"WITH {RES} SELECT pair_id, match_id, residual FROM r", {"residual": 6})
def j19_match_transform_join(t: Tables):
    return residuals(t).select("pair_id", "match_id", "residual")


INLIER = {c: 5 for c in ("inlier_ratio", "mean_error_px", "rmse_px", "median_error_px", "p95_error_px")}


@query(f"""WITH {RES} SELECT pair_id, count(*) AS matches, count(*) FILTER (WHERE residual <= 3.5) AS inliers, count(*) FILTER (WHERE residual <= 3.5) / count(*) AS inlier_ratio,
  avg(residual) FILTER (WHERE residual <= 3.5) AS mean_error_px, sqrt(avg(residual * residual) FILTER (WHERE residual <= 3.5)) AS rmse_px,
  quantile_cont(residual, 0.5) FILTER (WHERE residual <= 3.5) AS median_error_px, quantile_cont(residual, 0.95) FILTER (WHERE residual <= 3.5) AS p95_error_px
  FROM r GROUP BY pair_id""", INLIER)
def a04_inlier_statistics(t: Tables):
    return M.inlier_statistics(residuals(t)).drop("weight_collapse")


@query("SELECT pair_id, count(*) AS matches, 1 / (1 + avg(distance) / 150) AS confidence FROM v_match GROUP BY pair_id", {"confidence": 6})
def a05_match_confidence(t: Tables):
    return M.match_confidence(t.match)


@query("SELECT pair_id, count(*) AS matches, least(greatest(1 - avg(distance) / 64, 0), 1) AS confidence FROM v_match GROUP BY pair_id", {"confidence": 6})
def a05_hamming_confidence(t: Tables):
    return M.match_confidence(t.match, metric="hamming")


@query(rounds={"hull_ratio": 6})
def a07_hull_ratio(t: Tables):
    return M.hull_ratio(t.match, 512.0, 512.0).select("pair_id", "hull_ratio")


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS pair_id, CAST(100 + l_suppkey % 300 AS double) AS w, CAST(80 + l_suppkey % 200 AS double) AS h, CAST(l_suppkey % 31 AS double) AS c FROM lineitem)
  SELECT pair_id, (w * h - 2 * c * c) / 262144 AS src_hull_ratio, (w * h - 2 * c * c) / 1048576 AS tgt_hull_ratio, (w * h - 2 * c * c) / 524288 * 1.25 AS hull_ratio FROM p""",
       {c: 6 for c in ("src_hull_ratio", "tgt_hull_ratio", "hull_ratio")})
def a07_hull_of_known_polygons(t: Tables):
    """Each match stands among the corners of a rectangle with cut corners; target points are half as far apart."""
    k = F.col("l_suppkey")
    w, h, c = (x.cast("double") for x in (100 + k % 300, 80 + k % 200, k % 31))
    inner = (c + (F.col("l_orderkey") * 53 % 37) / 37 * (w - 2 * c), c + (F.col("l_partkey") * 29 % 41) / 41 * (h - 2 * c))
    corners = [inner, (c, F.lit(0.0)), (w - c, F.lit(0.0)), (w, c), (w, h - c), (w - c, h), (c, h), (F.lit(0.0), h - c), (F.lit(0.0), c)]
    points = F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]))
    m = t.lineitem.select(k.alias("pair_id"), points.alias("p")).select("pair_id", F.col("p.x").alias("src_x"), F.col("p.y").alias("src_y"),
                                                                       (F.col("p.x") / 2 + 7).alias("tgt_x"), (F.col("p.y") / 2 + 9).alias("tgt_y"))
    return M.hull_ratio(m, 512.0, 512.0).select("pair_id", "src_hull_ratio", "tgt_hull_ratio", "hull_ratio")


@query("""WITH c AS (SELECT pair_id, count(*) AS k FROM v_match GROUP BY pair_id, least(floor(src_x / 128), 3), least(floor(src_y / 128), 3)),
  s AS (SELECT *, sum(k) OVER (PARTITION BY pair_id) AS n FROM c)
  SELECT pair_id, CAST(max(n) AS bigint) AS points, -sum((k / n) * log2(k / n)) / 4 AS spatial_entropy FROM s GROUP BY pair_id""", {"spatial_entropy": 5})
def a08_grid_entropy(t: Tables):
    return M.grid_entropy(t.match, 512.0, 512.0)


TRUTH = """SELECT {keys}, candidates, tp, candidates - tp AS fp, greatest({cap} - tp, 0) AS fn, tp / candidates AS precision, CASE WHEN tp + greatest({cap} - tp, 0) > 0 THEN tp / (tp + greatest({cap} - tp, 0)) ELSE 0 END AS recall,
    CASE WHEN tp > 0 THEN 2 * (tp / candidates) * (tp / (tp + greatest({cap} - tp, 0))) / (tp / candidates + tp / (tp + greatest({cap} - tp, 0))) ELSE 0 END AS f1, median_error, p95_error
  FROM (SELECT {keys}, count(*) AS candidates, count(*) FILTER (WHERE residual <= 3.5) AS tp,
    coalesce(quantile_cont(residual, 0.5) FILTER (WHERE residual <= 3.5), quantile_cont(residual, 0.5)) AS median_error,
    coalesce(quantile_cont(residual, 0.95) FILTER (WHERE residual <= 3.5), quantile_cont(residual, 0.95)) AS p95_error FROM {src} GROUP BY {keys})"""
METRICS = {c: 5 for c in ("precision", "recall", "f1", "median_error", "p95_error")}


@query(f"WITH {RES} " + TRUTH.format(keys="pair_id", cap="100", src="r"), METRICS)
def a18_precision_recall(t: Tables):
    return M.score_against_truth(residuals(t), ["pair_id"])


def label_descriptors(t: Tables):
    """Each label as an image, its vectors as descriptors."""
    return t.embeddings.select(F.col("label").cast("string").alias("image_id"), F.col("vec_id").alias("kp_id"), F.col("embedding").alias("vec"))


def label_pairs(t: Tables):
    return t.embeddings.select("label").distinct().select(
        F.concat_ws(">", F.col("label").cast("string"), (F.col("label") + 1).cast("string")).alias("pair_id"),
        F.col("label").cast("string").alias("source_id"), (F.col("label") + 1).cast("string").alias("target_id"))


EMB = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"""WITH n AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 4),
  d AS (SELECT a.label || '>' || b.label AS pair_id, a.vec_id AS src_kp, b.vec_id AS tgt_kp, {EMB} AS distance FROM embeddings a JOIN embeddings b ON b.label = a.label + 1
    WHERE a.label IN (SELECT label FROM n) AND b.label IN (SELECT label FROM n)),
  k AS (SELECT *, row_number() OVER w AS rn, lead(distance) OVER w AS second_distance FROM d WINDOW w AS (PARTITION BY pair_id, src_kp ORDER BY distance, tgt_kp))
  SELECT pair_id, src_kp, tgt_kp, distance, second_distance FROM k WHERE rn = 1 AND distance < 0.95 * second_distance""", {"distance": 4, "second_distance": 4})
def j10_descriptor_neighbours(t: Tables):
    return N.match_descriptors(label_descriptors(t), label_pairs(t), ratio=0.95, block=32)


@query(f"""WITH n AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 4),
  b AS (SELECT label, vec_id, list_reduce(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END), lambda x, y: x + y) AS w
    FROM embeddings WHERE label IN (SELECT label FROM n)),
  d AS (SELECT a.label || '>' || b.label AS pair_id, a.vec_id AS src_kp, b.vec_id AS tgt_kp, CAST(bit_count(xor(a.w, b.w)) AS DOUBLE) AS distance FROM b a JOIN b ON b.label = a.label + 1),
  k AS (SELECT *, row_number() OVER w AS rn, lead(distance) OVER w AS second_distance FROM d WINDOW w AS (PARTITION BY pair_id, src_kp ORDER BY distance, tgt_kp))
  SELECT pair_id, src_kp, tgt_kp, distance, second_distance FROM k WHERE rn = 1 AND distance < 0.95 * second_distance""")
def j10_hamming_neighbours(t: Tables):
    """Signs of the components as one binary word."""
    word = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda w, i: w.bitwiseOR(
        F.when(F.get("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    d = t.embeddings.select(F.col("label").cast("string").alias("image_id"), F.col("vec_id").alias("kp_id"), F.array(word).alias("vec"))
    return N.match_descriptors(d, label_pairs(t), ratio=0.95, metric="hamming", block=32)


@query(f"""WITH n AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 4),
  d AS (SELECT a.label || '>' || b.label AS pair_id, a.vec_id AS src_kp, b.vec_id AS tgt_kp, {EMB} AS distance FROM embeddings a JOIN embeddings b ON b.label = a.label + 1
    WHERE a.label IN (SELECT label FROM n) AND b.label IN (SELECT label FROM n)),
  k AS (SELECT *, row_number() OVER w AS rn, lead(distance) OVER w AS second_distance FROM d WINDOW w AS (PARTITION BY pair_id, src_kp ORDER BY distance, tgt_kp))
  SELECT count(*) AS wanted, CAST(0 AS BIGINT) AS besides, true AS enough FROM k WHERE rn = 1 AND distance < 0.95 * second_distance""")
def j10_hashed_recall(t: Tables):
    """Hash tables against the exact comparison: nothing besides, and nine tenths of the matches at least."""
    d = label_descriptors(t)
    pairs = label_pairs(t)
    one = N.recall(N.hashed_matches(d, pairs, ratio=0.95, bits=4), N.match_descriptors(d, pairs, ratio=0.95))
    return one.select("wanted", "besides", (F.coalesce("recall", F.lit(1.0)) >= 0.9).alias("enough"))


@query(rounds={"h11": 3, "h13": 3, "h23": 3})
def d06_fit_transforms(t: Tables):
    f = M.fit_transforms(t.match)
    return f.select("pair_id", "matches", "inliers", *[F.element_at("h", i).alias(n) for n, i in (("h11", 1), ("h13", 3), ("h23", 6))])


PLANTED = """SELECT pair_id, match_id, src_x, src_y, 1 + CAST(pair_id % 5 AS double) / 50 AS a, CAST(pair_id % 40 AS double) AS u, CAST(pair_id % 30 AS double) - 15 AS v,
    CAST(src_x * 512 + src_y AS bigint) % 4 = 0 AS planted FROM v_match"""


@query(f"""WITH p AS ({PLANTED}) SELECT pair_id, count(*) AS matches, count(*) FILTER (WHERE planted) AS inliers, min(a) AS h11, min(u) AS h13, min(v) AS h23, CAST(0 AS double) AS h31
  FROM p GROUP BY pair_id""", {"h11": 4, "h13": 2, "h23": 2, "h31": 6})
def d06_planted_transforms(t: Tables):
    """A quarter of each pair's matches follow a scaled shift exactly; the others lie far off in all directions."""
    k, n = F.col("pair_id"), (F.col("src_x") * 512 + F.col("src_y")).cast("long")
    a, u, v = 1 + (k % 5).cast("double") / 50, (k % 40).cast("double"), (k % 30).cast("double") - 15
    far_x, far_y = (n * 7919 % 401).cast("double"), (n * 104729 % 397).cast("double")
    planted = n % 4 == 0
    m = t.match.select("pair_id", "match_id", "src_x", "src_y", (a * F.col("src_x") + u + F.when(planted, 0.0).otherwise(30 + far_x)).alias("tgt_x"),
                       (a * F.col("src_y") + v + F.when(planted, 0.0).otherwise(far_y - 200)).alias("tgt_y"), "distance")
    f = M.fit_transforms(m)
    return f.select("pair_id", "matches", "inliers", *[F.element_at("h", i).alias(c) for c, i in (("h11", 1), ("h13", 3), ("h23", 6), ("h31", 7))])


def pair_meta(t: Tables):
    """Sampling and sun angles of every pair, from the supplier key."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("pair_id"), F.when(k % 9 != 0, F.lit(0.26)).alias("src_gsd_m"), F.lit(0.26).alias("tgt_gsd_m"), (k * 37 % 360).cast("double").alias("src_azimuth"),
        (k * 53 % 360).cast("double").alias("tgt_azimuth"), (k % 60).cast("double").alias("src_elevation"), (k * 3 % 60).cast("double").alias("tgt_elevation"),
        ((k % 10) / 10.0).alias("gradient_alignment"))


VERIFIED = ["visual_score", "geometry_score", "illumination_score", "terrain_score", "scale_score", "spatial_score", "overall_confidence"]


@query(rounds={c: 3 for c in VERIFIED})
def d07_verify_pairs(t: Tables):
    m = t.match.withColumn("src_slope", F.col("src_x") % 17).withColumn("tgt_slope", F.col("src_x") % 17 + F.col("distance") / 50)
    v = V.verify_pairs(m, pair_meta(t))
    return v.select("pair_id", "matches", "inliers", *VERIFIED, "status", F.array_join("rejection_reasons", " | ").alias("reasons"))


@query("""WITH s AS (SELECT l_suppkey AS pair_id, l_quantity AS a, l_quantity * 0.5 + l_tax * 100 AS b FROM lineitem),
  g AS (SELECT pair_id, count(*) AS n, least(greatest((corr(a, b) + 1) / 2, 0), 1) AS sc, least(stddev_pop(a), stddev_pop(b)) / greatest(stddev_pop(a), stddev_pop(b), 1e-6) AS ro FROM s GROUP BY pair_id)
  SELECT pair_id, n AS terrain_points, sc AS slope_correlation, ro AS roughness_similarity, 0.5 * sc + 0.3 * ro + 0.2 * (0.5 * sc + 0.5 * ro) AS terrain_score FROM g""",
       {"slope_correlation": 5, "roughness_similarity": 5, "terrain_score": 5})
def a06_terrain_agreement(t: Tables):
    return V.terrain_agreement(t.lineitem.select(F.col("l_suppkey").alias("pair_id"), F.col("l_quantity").alias("src_slope"),
                                                 (F.col("l_quantity") * 0.5 + F.col("l_tax") * 100).alias("tgt_slope")))


TRANSFORM = "o_orderkey AS pair_id, CAST(o_custkey % 50 + 1 AS double) / 10 AS a, CAST(o_orderkey % 7 - 3 AS double) / 10 AS b, CAST(o_orderkey % 5 - 2 AS double) / 10 AS c, CAST(o_orderkey % 40 - 5 AS double) / 10 AS d"


@query(f"""WITH t AS (SELECT {TRANSFORM} FROM orders), s AS (SELECT *, sqrt(pow(a + d, 2) + pow(c - b, 2)) AS p, sqrt(pow(a - d, 2) + pow(b + c, 2)) AS q, a * d - b * c AS det2 FROM t),
  k AS (SELECT *, (p + q) / 2 AS s1, abs(p - q) / 2 AS s2 FROM s)
  SELECT pair_id, det2, det2 AS det3, s1 / greatest(s2, 1e-7) AS anisotropy, CASE WHEN s2 > 1e-3 THEN greatest(s1, 1) / least(s2, 1) END AS condition_number,
    CASE WHEN s2 > 1e-3 THEN det2 > 0 END AS corners_valid FROM k""", {"det2": 5, "det3": 5, "anisotropy": 3, "condition_number": 3})
def m11_degeneracy_checks(t: Tables):
    df = t.spark.sql(f"SELECT {TRANSFORM} FROM {{orders}}", orders=t.orders)
    zero, one = F.lit(0.0), F.lit(1.0)
    df = df.withColumn("h", F.array("a", "b", zero, "c", "d", zero, zero, zero, one))
    a, b, c, d = (F.col(n) for n in "abcd")
    # A rank-deficient transform has no finite condition to compare.
    full = F.abs(F.hypot(a + d, c - b) - F.hypot(a - d, b + c)) / 2 > 1e-3
    df = V.transform_checks(df, 512.0, 512.0)
    return df.select("pair_id", "det2", "det3", "anisotropy", F.when(full, F.col("condition_number")).alias("condition_number"), F.when(full, F.col("corners_valid")).alias("corners_valid"))


SCORING = {c: 4 for c in ("illumination", "geometry", "scale", "spatial", "composite", "shadow_azimuth", "phase")}


@query("""WITH x AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS bigint) AS id, CAST(l_orderkey % 360 AS double) AS az1,
    CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 360 AS double) END AS az2, CAST(l_orderkey % 80 AS double) AS el1, CAST(l_partkey % 80 AS double) AS el2,
    CAST(l_suppkey % 11 AS double) / 10 AS g, CAST(l_quantity AS bigint) AS m, CAST(floor(l_quantity * l_discount * 8) AS bigint) AS i, l_tax * 60 AS e, l_tax > 0.07 AS deg,
    l_discount * 3 + 0.05 AS det2, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 0.26::double END AS g1, 0.3 + l_tax AS g2, l_discount * 4 AS hull, l_tax * 12 AS ent FROM lineitem),
  y AS (SELECT *, coalesce(az2, 45) AS az3 FROM x),
  z AS (SELECT *, CASE WHEN abs(az1 - az3) > 180 THEN 360 - abs(az1 - az3) ELSE abs(az1 - az3) END AS da FROM y),
  w AS (SELECT *, 0.4 * least(greatest(1 - pow(da / 120, 2), 0), 1) + 0.3 * least(greatest(1 - abs(el1 - el2) / 50, 0.2), 1) + 0.3 * g AS illumination,
    CASE WHEN m < 4 THEN 0 WHEN i < 6 THEN least(greatest(i / m * 0.5, 0), 0.4) WHEN deg THEN 0.1 ELSE 0.55 * least(i / m / 0.85, 1) + 0.45 * least(greatest(1 - e / 4, 0), 1) END AS geometry,
    CASE WHEN g1 IS NULL THEN 0.5 ELSE least(greatest(1 - (greatest(sqrt(det2) / (g1 / g2), (g1 / g2) / sqrt(det2)) - 1) / 3.5, 0.1), 1) END AS scale,
    0.55 * least(hull / 0.35, 1) + 0.45 * ent AS spatial FROM z)
  SELECT id, illumination, az2 IS NULL AS illumination_defaulted, (az1 + 180) % 360 AS shadow_azimuth, least(greatest(1 - abs(el1 - el2) / 90, 0.1), 1) AS phase, geometry, scale, spatial,
    CASE WHEN deg THEN least(0.2 * g + 0.3 * geometry + 0.2 * illumination + 0.15 * 0.7 + 0.08 * scale + 0.07 * spatial, 0.4)
      ELSE 0.2 * g + 0.3 * geometry + 0.2 * illumination + 0.15 * 0.7 + 0.08 * scale + 0.07 * spatial END AS composite FROM w""", SCORING)
def m15_scores(t: Tables):
    df = t.spark.sql("""SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS bigint) AS id, CAST(l_orderkey % 360 AS double) AS az1,
      CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 360 AS double) END AS az2, CAST(l_orderkey % 80 AS double) AS el1, CAST(l_partkey % 80 AS double) AS el2,
      CAST(l_suppkey % 11 AS double) / 10 AS g, CAST(l_quantity AS bigint) AS m, CAST(floor(l_quantity * l_discount * 8) AS bigint) AS i, l_tax * 60 AS e, l_tax > 0.07 AS deg,
      l_discount * 3 + 0.05 AS det2, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 0.26D END AS g1, 0.3D + l_tax AS g2, l_discount * 4 AS hull, l_tax * 12 AS ent FROM {lineitem}""", lineitem=t.lineitem)
    c = F.col
    df = df.withColumns({
        "illumination": S.illumination_score(c("az1"), c("az2"), c("el1"), c("el2"), c("g")), "illumination_defaulted": S.illumination_defaulted(c("az1"), c("az2")),
        "shadow_azimuth": geo.shadow_azimuth(c("az1")), "phase": geo.phase_compatibility(c("el1"), c("el2")), "geometry": S.geometry_score(c("m"), c("i"), c("deg"), c("e")),
        "scale": S.scale_score(c("det2"), c("g1"), c("g2")), "spatial": S.spatial_score(c("hull"), c("ent"))})
    df = df.withColumn("composite", S.composite_confidence(c("g"), c("geometry"), c("illumination"), F.lit(0.70), c("scale"), c("spatial"), ~c("deg")))
    return df.select("id", "illumination_defaulted", *SCORING)


UNC = """u AS (SELECT *, (visual_score + geometry_score + illumination_score + terrain_score + scale_score + spatial_score) / 6 AS mu FROM v_profile),
  p AS (SELECT *, least(sqrt((pow(visual_score - mu, 2) + pow(geometry_score - mu, 2) + pow(illumination_score - mu, 2) + pow(terrain_score - mu, 2) + pow(scale_score - mu, 2) + pow(spatial_score - mu, 2)) / 6) * 2.8, 1) AS d,
    0.6 * least(mean_err_px / 4, 1) + 0.4 * least(greatest(log10(greatest(condition_number, 1)) / 2.5, 0), 1) AS g,
    least(greatest(1 - inlier_ratio, 0.05), 0.95) AS a, least(greatest(1 - spatial_score, 0.05), 0.95) AS s FROM u),
  w AS (SELECT *, least(greatest(0.35 * d + 0.25 * g + 0.2 * a + 0.2 * s, 0.02), 0.98) AS raw FROM p),
  v AS (SELECT * REPLACE (floor(d * 10000 + 0.5) / 10000 AS d, floor(g * 10000 + 0.5) / 10000 AS g, floor(a * 10000 + 0.5) / 10000 AS a, floor(s * 10000 + 0.5) / 10000 AS s),
    floor(raw * 10000 + 0.5) / 10000 AS total, CASE WHEN status = 'VERIFIED' AND raw < 0.25 THEN 'CALIBRATED_LOW_UNCERTAINTY' WHEN d > 0.45 THEN 'HIGH_EPISTEMIC_RISK'
    WHEN g > 0.5 THEN 'GEOMETRIC_ALEATORIC_NOISE' ELSE 'MODERATE_UNCERTAINTY' END AS calibration FROM w)"""
PARTS = ["total_uncertainty", "evidence_disagreement", "geometric_instability", "feature_ambiguity", "spatial_sparsity"]


@query(f"""WITH {UNC} SELECT correspondence_id, total AS total_uncertainty, d AS evidence_disagreement, g AS geometric_instability, a AS feature_ambiguity, s AS spatial_sparsity,
  calibration AS calibration_status FROM v""")
def d08_pair_uncertainty(t: Tables):
    return V.pair_uncertainty(t.profile).select("correspondence_id", *PARTS, "calibration_status")


@query(f"""WITH {UNC} SELECT correspondence_id, CASE WHEN total < 0.3 THEN 'LOW' WHEN total < 0.6 THEN 'MODERATE' WHEN total < 0.85 THEN 'HIGH' ELSE 'SATURATED' END AS qualitative,
  floor(greatest(0, total - 0.15) * 10000 + 0.5) / 10000 AS interval_low, floor(least(1, total + 0.15) * 10000 + 0.5) / 10000 AS interval_high, floor(total * 0.6 * 10000 + 0.5) / 10000 AS cov11, floor(d * 0.2 * 10000 + 0.5) / 10000 AS cov12 FROM v""")
def m17_uncertainty_view(t: Tables):
    v = V.uncertainty_view(V.pair_uncertainty(t.profile))
    return v.select("correspondence_id", "qualitative", "interval_low", "interval_high", F.col("covariance")[0][0].alias("cov11"), F.col("covariance")[0][1].alias("cov12"))


@query(f"""WITH {UNC} SELECT avg(total) AS mean_correspondence_uncertainty, avg(d) AS mean_evidence_disagreement, count(*) AS evaluated_correspondences,
  (SELECT avg(uncertainty) FROM v_entity) AS mean_entity_uncertainty FROM v""", {c: 3 for c in ("mean_correspondence_uncertainty", "mean_evidence_disagreement", "mean_entity_uncertainty")})
def a10_uncertainty_summary(t: Tables):
    return V.uncertainty_summary(V.pair_uncertainty(t.profile), t.entity)


_DIM = {"GEOMETRIC": "geometry_score", "TERRAIN": "terrain_score", "ILLUMINATION": "illumination_score", "SPECTRAL": "0", "SCALE": "scale_score", "TEMPORAL": "0.5",
        "TEXTURE": "visual_score", "REGISTRATION": "spatial_score", "PHYSICAL": "CASE WHEN status = 'VERIFIED' THEN 1 ELSE 0 END", "MANUAL": "0",
        "SYNTHETIC": "CASE WHEN is_synthetic THEN 1 ELSE 0 END"}
_SUP = ", ".join(f"CASE WHEN {v} > 0.6 THEN '{k} (score=' || printf('%.2f', CAST({v} AS double)) || ')' END" for k, v in _DIM.items())
_MIS = ", ".join(f"CASE WHEN {v} = 0 THEN '{k}' END" for k, v in _DIM.items() if k not in ("MANUAL", "SYNTHETIC"))


@query(f"SELECT correspondence_id, concat_ws(', ', {_SUP}) AS supporting_evidence, concat_ws(', ', {_MIS}) AS missing_evidence FROM v_profile")
def m23_evidence_vector(t: Tables):
    return V.evidence_vector(t.profile).select("correspondence_id", F.array_join("supporting_evidence", ", ").alias("supporting_evidence"),
                                               F.array_join("missing_evidence", ", ").alias("missing_evidence"))


REASON = "CASE WHEN correspondence_id % 4 = 0 THEN 'PHYSICAL_GATE_REJECTION: GATE3_TARGET_OUTSIDE_CALIBRATED_SWATH (count=3)' WHEN correspondence_id % 4 = 1 THEN 'GATE5_PARALLAX_EXCEEDS_PHYSICAL_BOUNDS' ELSE 'none' END"


@query(f"""SELECT correspondence_id, CASE WHEN num_inliers >= 4 THEN 'VERIFIED' ELSE 'DEGENERATE' END AS geometric_status, CASE WHEN ok THEN 'PASS' ELSE 'REJECTED' END AS physical_status,
  concat_ws(',', g0, g0, CASE WHEN contains(reason, 'GATE3_T') THEN 'REJECTED' ELSE g0 END, g0, CASE WHEN contains(reason, 'GATE5_P') THEN 'REJECTED' ELSE g0 END, g0) AS gates,
  CASE WHEN contains(reason, 'GATE3') THEN 'GATE3' END AS failed_gate, CASE WHEN is_synthetic THEN 'SYNTHETIC' ELSE 'REAL_LUNAR' END AS data_origin FROM (
    SELECT *, status <> 'REJECTED' AND num_inliers > 0 AS ok, {REASON} AS reason, CASE WHEN status <> 'REJECTED' AND num_inliers > 0 THEN 'PASS' ELSE 'NOT_EVALUATED' END AS g0 FROM v_profile)""")
def p16_correspondence_view(t: Tables):
    df = t.profile.withColumn("rejection_reasons", F.array(F.expr(REASON)))
    return V.correspondence_view(df).select("correspondence_id", "geometric_status", "physical_status", F.array_join(F.transform("gates", lambda g: g["status"]), ",").alias("gates"),
                                            "failed_gate", "data_origin")


@query("""SELECT correspondence_id, CASE WHEN overall >= 0.72 AND k = 0 THEN 'VERIFIED' WHEN overall < 0.45 OR k >= 2 THEN 'REJECTED' ELSE 'UNCERTAIN' END AS pair_status,
  CASE WHEN status = 'VERIFIED' THEN 'ACCEPTED' ELSE status END AS final_status, CASE WHEN overall >= 0.9 THEN 'CONFIRMED' WHEN overall >= 0.7 THEN 'SUPPORTED' ELSE 'CANDIDATE' END AS entity_state
  FROM (SELECT *, visual_score AS overall, num_inliers % 3 AS k FROM v_profile)""")
def m25_status_maps(t: Tables):
    c = F.col("visual_score")
    return t.profile.select("correspondence_id", S.pair_status(c, F.col("num_inliers") % 3).alias("pair_status"),
                            S.final_status(F.col("status")).alias("final_status"), S.state_by_confidence(c).alias("entity_state"))


@query("SELECT pair_id, match_id FROM v_match WHERE abs(tgt_x - src_x - 25) < 2 INTERSECT ALL SELECT pair_id, match_id FROM v_match WHERE abs(tgt_y - src_y + 18) < 2")
def u04_inliers_and_accepted(t: Tables):
    a = F.abs(F.col("tgt_x") - F.col("src_x") - 25) < 2
    b = F.abs(F.col("tgt_y") - F.col("src_y") + 18) < 2
    return t.match.filter(all_of([a, b])).select("pair_id", "match_id")
