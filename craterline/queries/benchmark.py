"""Queries over pairs, benchmark runs, sweeps and ablations."""

from __future__ import annotations

from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions import score as S
from craterline.operators import benchmark as B
from craterline.operators import gaps as G
from craterline.operators import joins as J
from craterline.operators import world as W
from craterline.functions.stage import stage
from craterline.operators.geometry import gate_matches, pixel_to_terrain
from craterline.operators.matching import fit_transforms, flag_inliers
from craterline.operators.verification import geometry_profile
from craterline.plans.match_runs import run_ablation
from craterline.queries.gaps import GAPS, detected
from craterline.queries.geometry import ELEVATION, FORWARD, GATED, Prepared, points
from craterline.queries.matching import METRICS, TRUTH
from craterline.queries.registry import Tables, query

BOX = ["lat_min", "lat_max", "lon_min", "lon_max"]
OVERLAP = "greatest(a.lat_min, b.lat_min) {op} least(a.lat_max, b.lat_max) AND greatest(a.lon_min, b.lon_min) {op} least(a.lon_max, b.lon_max)"
_TIERS = ", ".join(f"('{s}', '{t}', {n}, '{d}', '{p}')" for s, t, n, d, p, _ in C.PAIR_TIERS)


@query(f"""WITH p AS (SELECT observation_id, CASE sensor WHEN 'LROC_NAC' THEN 'LRO_NAC' ELSE sensor END AS sensor, lat_min, lat_max, lon_min, lon_max FROM v_footprint),
  r(source_sensor, target_sensor, priority_tier, expected_difficulty, prefix) AS (VALUES {_TIERS})
  SELECT prefix || '_P' || a.observation_id || '_P' || b.observation_id AS pair_id, r.source_sensor, r.target_sensor, priority_tier, expected_difficulty
  FROM p a JOIN r ON r.source_sensor = a.sensor JOIN p b ON b.sensor = r.target_sensor AND {OVERLAP.format(op='<=')}""")
def j01_tier_pairs(t: Tables):
    p = t.footprint.select(F.concat(F.lit("P"), F.col("observation_id").cast("string")).alias("product_id"), "sensor", *BOX)
    return B.tier_pairs(p, 0.5).select("pair_id", "source_sensor", "target_sensor", "priority_tier", "expected_difficulty")


@query("""WITH r(source_sensor, target_sensor, tier) AS (VALUES ('OHRC', 'LRO_NAC', 1), ('OHRC', 'TMC-2', 2), ('TMC-2', 'LRO_NAC', 3), ('IIRS', 'OHRC', 4), ('IIRS', 'TMC-2', 4)),
  s AS (SELECT DISTINCT tier, 'source' AS side, source_sensor AS sensor FROM r UNION ALL SELECT DISTINCT tier, 'target', target_sensor FROM r),
  p AS (SELECT observation_id, CASE WHEN sensor = 'LROC_NAC' THEN 'LRO_NAC' ELSE sensor END AS sensor FROM v_footprint WHERE observation_id % 3 = 0)
  SELECT CAST(tier AS integer) AS priority_tier, side, 'P' || observation_id AS product_id, p.sensor, 'BOUNDS_UNKNOWN' AS reason FROM p JOIN s ON s.sensor = p.sensor""")
def j01_products_without_bounds(t: Tables):
    """Every third product has lost a bound and the camera is spelled as in its labels."""
    sensor = F.when(F.col("sensor") == "LROC_NAC", "LROC NAC").otherwise(F.col("sensor"))
    p = t.footprint.select(F.concat(F.lit("P"), F.col("observation_id").cast("string")).alias("product_id"), sensor.alias("sensor"), *BOX)
    p = p.withColumn("lon_max", F.when(F.substring("product_id", 2, 20).cast("long") % 3 != 0, F.col("lon_max")))
    return B.unpaired_products(p)


@query("""SELECT pair_no, a.sensor AS src_sensor, b.sensor AS tgt_sensor, a.is_synthetic OR b.is_synthetic AS is_synthetic FROM v_pair p
  JOIN v_observation a ON a.observation_id = id_a JOIN v_observation b ON b.observation_id = id_b""")
def j02_pair_observations(t: Tables):
    p = t.pair.withColumnsRenamed({"id_a": "source_observation_id", "id_b": "target_observation_id"})
    df = J.pair_observations(p, t.observation).filter("unknown_side is null")
    return df.select("pair_no", "src_sensor", "tgt_sensor", (F.col("src_is_synthetic") | F.col("tgt_is_synthetic")).alias("is_synthetic"))


@query("""SELECT pair_no, a.sensor AS src_sensor, b.sensor AS tgt_sensor, a.is_synthetic OR b.is_synthetic AS is_synthetic,
    CASE WHEN b.observation_id IS NULL AND a.observation_id IS NULL THEN 'source,target' WHEN a.observation_id IS NULL THEN 'source' WHEN b.observation_id IS NULL THEN 'target' END AS unknown_side
  FROM (SELECT pair_no, id_a, CASE WHEN pair_no % 7 = 0 THEN -id_b ELSE id_b END AS id_b FROM v_pair) p
  LEFT JOIN v_observation a ON a.observation_id = id_a LEFT JOIN v_observation b ON b.observation_id = id_b""")
def j02_pairs_with_unknown_side(t: Tables):
    """Every seventh pair names a target that is in no table; all pairs stay."""
    p = t.pair.withColumn("id_b", F.when(F.col("pair_no") % 7 == 0, -F.col("id_b")).otherwise(F.col("id_b")))
    p = p.withColumnsRenamed({"id_a": "source_observation_id", "id_b": "target_observation_id"})
    df = J.pair_observations(p, t.observation)
    return df.select("pair_no", "src_sensor", "tgt_sensor", (F.col("src_is_synthetic") | F.col("tgt_is_synthetic")).alias("is_synthetic"), "unknown_side")


@query("""SELECT e.ekey AS point, CASE WHEN d.entity_id IS NULL THEN NULL ELSE d.entity_id END AS entity_id FROM (SELECT ekey, latitude + (ekey % 3) * 0.003 AS lat, longitude + (ekey % 5) * 0.0021 AS lon FROM v_entity) e
  LEFT JOIN v_entity d ON d.latitude BETWEEN e.lat - 0.005 AND e.lat + 0.005 AND d.longitude BETWEEN e.lon - 0.005 AND e.lon + 0.005
  QUALIFY row_number() OVER (PARTITION BY e.ekey ORDER BY pow(d.latitude - e.lat, 2) + pow((d.longitude - e.lon) * cos(radians(e.lat)), 2), d.entity_id) = 1""")
def j03_nearest_in_box(t: Tables):
    p = t.entity.select(F.col("ekey").alias("point"), (F.col("latitude") + F.col("ekey") % 3 * 0.003).alias("lat"), (F.col("longitude") + F.col("ekey") % 5 * 0.0021).alias("lon"))
    return J.nearest_in_box(p, t.entity).select("point", "entity_id")


HAV = "1737400.0 * 2 * atan2(sqrt(a), sqrt(1 - a))"


@query(f"""SELECT observation_id, entity_id, {HAV} AS distance_m FROM (SELECT o.observation_id, e.entity_id, pow(sin(radians(obs_lat - latitude) / 2), 2)
    + cos(radians(latitude)) * cos(radians(obs_lat)) * pow(sin(radians(obs_lon - longitude) / 2), 2) AS a FROM v_observation o JOIN v_entity e
    ON latitude BETWEEN obs_lat - 0.05 AND obs_lat + 0.05) WHERE {HAV} <= 1000""", {"distance_m": 3})
def j04_radius_discovery(t: Tables):
    p = t.observation.select("observation_id", F.col("obs_lat").alias("lat"), F.col("obs_lon").alias("lon"))
    return J.within_radius(p, t.entity.select("entity_id", "latitude", "longitude"), 1000.0).select("observation_id", "entity_id", "distance_m")


@query("SELECT c.correspondence_id, c.status, e.visual_score FROM (SELECT DISTINCT correspondence_id, status FROM v_profile) c LEFT JOIN (SELECT correspondence_id, max(visual_score) AS visual_score FROM v_profile WHERE num_inliers > 20 GROUP BY correspondence_id) e USING (correspondence_id)")
def j13_correspondence_evidence(t: Tables):
    c = t.profile.select("correspondence_id", "status").distinct()
    e = t.profile.filter("num_inliers > 20").groupBy("correspondence_id").agg(F.max("visual_score").alias("visual_score"))
    return J.with_evidence(c, e).select("correspondence_id", "status", "visual_score")


@query(f"""SELECT a.observation_id AS a_id, b.observation_id AS b_id, greatest(a.lat_min, b.lat_min) AS overlap_lat_min, least(a.lon_max, b.lon_max) AS overlap_lon_max
  FROM v_footprint a JOIN v_footprint b ON {OVERLAP.format(op='<')} WHERE a.sensor = 'OHRC' AND b.sensor = 'TMC-2'""", {"overlap_lat_min": 5, "overlap_lon_max": 5})
def j18_overlapping_footprints(t: Tables):
    side = lambda s, n: t.footprint.filter(F.col("sensor") == s).select(F.col("observation_id").alias(n), *BOX)
    return J.overlapping_boxes(side("OHRC", "a_id"), side("TMC-2", "b_id"), "a_id", "b_id", 0.5).select("a_id", "b_id", "overlap_lat_min", "overlap_lon_max")


@query(f"""SELECT pair_no, CASE WHEN a.is_synthetic OR b.is_synthetic THEN 4 WHEN {OVERLAP.format(op='<=')} THEN 1 ELSE 0 END AS ground_truth_level
  FROM v_pair p JOIN v_footprint a ON a.observation_id = id_a JOIN v_footprint b ON b.observation_id = id_b""")
def m21_ground_truth_level(t: Tables):
    p = t.pair.withColumnsRenamed({"id_a": "source_observation_id", "id_b": "target_observation_id"})
    df = J.pair_observations(p, t.footprint).filter("unknown_side is null")
    box = lambda s: tuple(F.col(f"{s}_{c}") for c in BOX)
    return df.select("pair_no", S.ground_truth_level(F.col("src_is_synthetic"), F.col("tgt_is_synthetic"), box("src"), box("tgt")).alias("ground_truth_level"))


_FAIL = [("keypoints_src < 10 OR keypoints_tgt < 10", "FEATURE_SPARSITY_FAILURE", 0.90), ("candidates < 4", "FEATURE_SPARSITY_FAILURE", 0.95), ("inliers < 6", "GEOMETRIC_FAILURE", 0.85),
         ("inlier_ratio < 0.25", "GEOMETRIC_FAILURE", 0.80), ("mean_error_px > 4", "GEOMETRIC_FAILURE", 0.88), ("condition_number > 500", "GEOMETRIC_FAILURE", 0.75),
         ("hull_ratio < 0.04 AND inliers >= 6", "FALSE_CORRESPONDENCE_RISK", 0.92), ("(source_sensor = 'IIRS' OR target_sensor = 'IIRS') AND source_sensor <> target_sensor", "CROSS_MODAL_FAILURE", 0.70),
         ("src_gsd_m IS NULL OR tgt_gsd_m IS NULL", "METADATA_UNCERTAINTY", 0.50),
         ("CASE WHEN abs(src_azimuth - tgt_azimuth) > 180 THEN 360 - abs(src_azimuth - tgt_azimuth) ELSE abs(src_azimuth - tgt_azimuth) END > 90", "ILLUMINATION_FAILURE", 0.80)]
_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {{'s': {-s}::double, 'o': {n}, 'c': '{k}'}} END" for n, (c, k, s) in enumerate(_FAIL)) + "], lambda x: x IS NOT NULL)"
RUNS = f"""f AS (SELECT *, list_sort({_LIST}) AS fs FROM v_run),
  cl AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'REJECTED' WHEN len(fs) = 0 AND is_stable THEN 'GEOMETRICALLY_STABLE' WHEN len(fs) = 0 THEN 'ACCEPTED' WHEN inliers < 4 THEN 'INSUFFICIENT_EVIDENCE'
    WHEN NOT is_stable THEN 'GEOMETRICALLY_DEGENERATE' WHEN inlier_ratio >= 0.15 AND inliers >= 5 THEN 'AMBIGUOUS' ELSE 'REJECTED' END AS status FROM f)"""


@query(f"""WITH {RUNS} SELECT pair_id, matcher, status, CASE WHEN error IS NOT NULL THEN 'COMPUTATIONAL_FAILURE' ELSE fs[1].c END AS dominant_failure, CASE WHEN error IS NULL THEN fs[2].c END AS secondary_failure,
  CAST(CASE WHEN error IS NOT NULL THEN 0 ELSE len(fs) END AS integer) AS failure_count, CASE WHEN src_gsd_m > 0 AND tgt_gsd_m > 0 THEN src_gsd_m / tgt_gsd_m END AS scale_ratio FROM cl""", {"scale_ratio": 6})
def d24_evaluate_pairs(t: Tables):
    return B.classify_runs(t.run).select("pair_id", "matcher", "status", "dominant_failure", "secondary_failure", "failure_count", "scale_ratio")


@query(f"""WITH {RUNS} SELECT count(DISTINCT pair_id) AS pairs, count(*) AS runs, count(*) FILTER (WHERE status IN ('ACCEPTED', 'GEOMETRICALLY_STABLE')) AS accepted, count(*) FILTER (WHERE status = 'REJECTED') AS rejected,
  count(*) FILTER (WHERE status = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (WHERE status = 'INSUFFICIENT_EVIDENCE') AS insufficient, count(*) FILTER (WHERE status = 'GEOMETRICALLY_DEGENERATE') AS degenerate,
  bool_or(is_real_data) AS has_real_data FROM cl WHERE is_real_data""")
def a12_benchmark_summary(t: Tables):
    return B.benchmark_summary(B.real_results(B.classify_runs(t.run)))


@query("""SELECT *, CASE WHEN stable_runs = 0 AND (derived_candidates > 0 OR derived_inliers > 0) THEN 'SCALE_EFFECT_OBSERVED_BUT_GEOMETRICALLY_UNSTABLE' WHEN stable_runs > 0 THEN 'GEOMETRICALLY_STABLE_CORRESPONDENCE_FOUND'
    WHEN derived_inliers > base_inliers THEN 'SCALE_EFFECT_SUPPORTED' WHEN derived_inliers = base_inliers AND derived_inliers > 0 THEN 'INCONCLUSIVE' ELSE 'SCALE_EFFECT_NOT_SUPPORTED' END AS decision FROM (
  SELECT experiment_id, coalesce(max(inliers) FILTER (WHERE level_index = 0), 0) AS base_inliers, coalesce(max(inliers) FILTER (WHERE level_index > 0), 0) AS derived_inliers,
    coalesce(max(candidates) FILTER (WHERE level_index > 0), 0) AS derived_candidates, count(*) FILTER (WHERE is_stable) AS stable_runs FROM v_run GROUP BY experiment_id)""")
def a13_scale_decision(t: Tables):
    return B.scale_decision(t.run)


@query("""WITH p AS (SELECT pair_id, matcher, level_index, inliers, is_stable FROM v_run), d AS (SELECT pair_id AS experiment_id, coalesce(max(inliers) FILTER (WHERE level_index = 0), 0) AS base_inliers,
    coalesce(max(inliers) FILTER (WHERE level_index > 0), 0) AS derived_inliers, count(*) FILTER (WHERE is_stable) AS stable_runs FROM p GROUP BY pair_id)
  SELECT * FROM d""")
def d25_scale_experiment(t: Tables):
    runs = t.run.withColumn("experiment_id", F.col("pair_id"))
    return B.scale_decision(runs).select("experiment_id", "base_inliers", "derived_inliers", "stable_runs")


SWEEP = TRUTH.format(keys="sweep, method, value", cap="50", src="v_sweep")


@query(f"""SELECT * REPLACE (CASE WHEN tp > 0 THEN median_error END AS median_error, CASE WHEN tp > 0 THEN p95_error END AS p95_error),
  CASE WHEN sweep = 'overlap_fraction' AND value = 0 THEN 'FOOTPRINT_NON_OVERLAP' WHEN tp >= 6 THEN 'INLIER_CONFIRMED' ELSE 'AMBIGUOUS' END AS classification FROM ({SWEEP})""", METRICS)
def a19_sweep_curves(t: Tables):
    return B.sweep_curves(t.sweep)


@query("""WITH r AS (SELECT p_partkey, p_retailprice AS relief_m, CAST(p_size * 80 AS double) AS sample FROM part), d AS (SELECT *, atan((sample - 1999.5) * 6.0::double / 121430.0::double) AS look FROM r)
  SELECT p_partkey, abs(relief_m * tan(look)) AS displacement_m, degrees(look) AS look_angle_deg, 0.0::double AS error_m, relief_m * tan(radians(5.6::double)) AS nominal_m FROM d""",
       {"displacement_m": 4, "look_angle_deg": 4, "error_m": 4, "nominal_m": 4})
def a20_relief_sweep(t: Tables):
    r = t.part.select("p_partkey", F.col("p_retailprice").alias("relief_m"), (F.col("p_size") * 80).cast("double").alias("sample"))
    return B.relief_sweep(r).select("p_partkey", "displacement_m", "look_angle_deg", "error_m", "nominal_m")


COMPARE = TRUTH.format(keys="method, condition, physics", cap="100", src="v_sweep")


@query(f"""WITH m AS ({COMPARE}), i AS (SELECT method, condition, count(*) FILTER (WHERE residual <= 1) AS inliers FROM v_sweep GROUP BY method, condition)
  SELECT m.*, i.inliers, CASE WHEN NOT physics THEN 'NOT_APPLIED' WHEN condition IN ('reflection', 'partial_overlap') THEN 'REJECTED_UNPHYSICAL_GEOMETRY' WHEN condition LIKE '%illum%' THEN 'ACCEPTED_ILLUMINATION_CONSISTENT'
      WHEN inliers >= 6 THEN 'ACCEPTED_SURFACE_CONSISTENT' ELSE 'REJECTED_DEGENERATE' END AS physical_validation,
    CASE WHEN NOT physics AND inliers >= 6 THEN 'INLIER_CONFIRMED' WHEN NOT physics THEN 'AMBIGUOUS' WHEN condition IN ('reflection', 'partial_overlap') THEN 'PHYSICALLY_REJECTED' WHEN condition LIKE '%illum%' THEN 'ILLUMINATION_ROBUST'
      WHEN inliers >= 6 THEN 'VERIFIED_CORRESPONDENCE' ELSE 'AMBIGUOUS' END AS final_classification FROM m JOIN i USING (method, condition)""", METRICS)
def d26_baseline_comparison(t: Tables):
    i = t.sweep.groupBy("method", "condition").agg(F.count_if(F.col("residual") <= 1).alias("inliers"))
    return B.compare_methods(t.sweep, i)


@query(f"""WITH {GAPS}, f AS (SELECT entity_id, count(*) AS gaps FROM gaps GROUP BY entity_id),
  b AS (SELECT entity_id, count(*) AS gaps FROM gaps WHERE gap_type <> 'FOOTPRINT_NON_OVERLAP' GROUP BY entity_id)
  SELECT 'Rejection events' AS component, entity_id, coalesce(f.gaps, 0) AS full_gaps, coalesce(b.gaps, 0) AS ablated_gaps, coalesce(f.gaps, 0) - coalesce(b.gaps, 0) AS delta_gaps FROM f FULL JOIN b USING (entity_id)""")
def d27_ablate_rejection_events(t: Tables):
    count = lambda df: df.groupBy("entity_id").agg(F.count("*").alias("gaps"))
    a = W.associate(t.observation, t.entity)
    without = G.detect_gaps(t.entity, a, t.evidence)
    return B.ablate(count(detected(t)), count(without), ["entity_id"], ["gaps"], "Rejection events")


@query("""WITH x AS (SELECT o_orderkey, abs(-(o_totalprice / 100) * tan(atan((CAST(o_custkey * 7 % 4000 AS double) - 1999.5) * 6.0::double / 121430.0::double))) AS d FROM orders)
  SELECT 'Physical Parallax Modeling' AS component, o_orderkey, d AS full_displacement_m, 0.0::double AS ablated_displacement_m, d AS delta_displacement_m FROM x""",
       {"full_displacement_m": 4, "ablated_displacement_m": 4, "delta_displacement_m": 4})
def d27_ablate_parallax(t: Tables):
    r = t.orders.select("o_orderkey", (F.col("o_totalprice") / 100).alias("relief_m"), (F.col("o_custkey") * 7 % 4000).cast("double").alias("sample"))
    full = B.relief_sweep(r).select("o_orderkey", "displacement_m")
    flat = B.relief_sweep(r.withColumn("relief_m", F.lit(0.0))).select("o_orderkey", "displacement_m")
    return B.ablate(full, flat, ["o_orderkey"], ["displacement_m"], "Physical Parallax Modeling")


@query(f"""WITH {GATED}, c AS (SELECT pair_id, count(*) FILTER (WHERE rejection_reason IS NOT NULL) AS rejections FROM gt GROUP BY pair_id)
  SELECT 'Calibrated GroundGrid Validation' AS component, pair_id, rejections AS full_rejections, CAST(0 AS BIGINT) AS ablated_rejections, rejections AS delta_rejections FROM c""")
def d27_ablate_ground_grids(t: Tables):
    """Refused matches of each pair with lattices, and without: then nothing is refused."""
    def job(grids=None):
        m = points(t).withColumnsRenamed({"pixel": "src_x", "scan": "src_y"})
        gated = m.withColumn("rejection_reason", F.lit(None).cast("string")) if grids is None else gate_matches(m, grids)
        return gated.groupBy("pair_id").agg(F.count("rejection_reason").alias("rejections"))
    return run_ablation(job, ["pair_id"], ["rejections"], "Calibrated GroundGrid Validation", grids=Prepared(t).grids)


@query(f"""WITH {FORWARD}, {ELEVATION} SELECT 'DEM / Terrain Validation' AS component, point_id, coalesce(elevation_m, 0) AS full_elevation_m,
    0.0::double AS ablated_elevation_m, coalesce(elevation_m, 0) AS delta_elevation_m FROM el""", {c: 3 for c in ("full_elevation_m", "ablated_elevation_m", "delta_elevation_m")})
def d27_ablate_elevation(t: Tables):
    """Height under each point from the elevation grid, and on the datum; a point without a place has neither."""
    p = Prepared(t)
    job = lambda dem=None: pixel_to_terrain(points(t), p.source, p.source_meta, dem, p.frame).select("point_id", "elevation_m")
    return run_ablation(job, ["point_id"], ["elevation_m"], "DEM / Terrain Validation", dem=p.dem)


@query(f"""WITH {GAPS}, f AS (SELECT entity_id, count(*) AS gaps FROM gaps GROUP BY entity_id)
  SELECT 'Knowledge-Gap Engine' AS component, entity_id, coalesce(gaps, 0) AS full_gaps, CAST(0 AS BIGINT) AS ablated_gaps, coalesce(gaps, 0) AS delta_gaps FROM v_entity LEFT JOIN f USING (entity_id)""")
def d27_ablate_gap_engine(t: Tables):
    def job(detect=None):
        found = t.entity.select("entity_id").filter("false") if detect is None else detect(t).select("entity_id")
        return t.entity.select("entity_id").join(found.groupBy("entity_id").agg(F.count("*").alias("gaps")), "entity_id", "left").select("entity_id", F.coalesce("gaps", F.lit(0)).alias("gaps"))
    return run_ablation(job, ["entity_id"], ["gaps"], "Knowledge-Gap Engine", detect=detected)


@query(f"""WITH {GAPS}, f AS (SELECT entity_id, count(*) AS n FROM gaps WHERE gap_type IN ({', '.join(f"'{r[0]}'" for r in C.GAP_SENSOR_RULES)}) GROUP BY entity_id)
  SELECT 'Active Observation Engine' AS component, entity_id, n AS full_recommendations, CAST(0 AS BIGINT) AS ablated_recommendations, n AS delta_recommendations FROM f""")
def d27_ablate_recommendations(t: Tables):
    def job(sensors=None):
        found = G.recommend_for_gaps(detected(t), sensors or []).groupBy("entity_id").agg(F.count("*").alias("recommendations"))
        return found if sensors else found.filter("false")
    return run_ablation(job, ["entity_id"], ["recommendations"], "Active Observation Engine", sensors=["OHRC", "TMC-2"])


@query("""WITH m AS (SELECT pair_id, count(*) AS n, pair_id % 3 = 0 AS mirrored FROM v_match GROUP BY pair_id)
  SELECT 'Geometric Verification' AS component, pair_id, CAST(NOT mirrored AS INTEGER) AS full_accepted, 1 AS ablated_accepted, CAST(NOT mirrored AS INTEGER) - 1 AS delta_accepted FROM m""")
def d27_ablate_geometry(t: Tables):
    """Every third pair is seen in a mirror: the transform fits, but turns the surface inside out. Without verification any match counts."""
    mirrored = F.when(F.col("pair_id") % 3 == 0, 500.0 - F.col("src_x")).otherwise(F.col("src_x") + 25.0)
    m = stage(t.match.select("pair_id", "match_id", "src_x", "src_y", mirrored.alias("tgt_x"), (F.col("src_y") - 18.0).alias("tgt_y"), "distance"))

    def job(verify=None):
        if verify is None:
            return m.groupBy("pair_id").agg((F.count("*") > 0).cast("int").alias("accepted"))
        fits = stage(fit_transforms(m))
        g = verify(stage(flag_inliers(m, fits)), fits, 512.0, 512.0)
        return g.select("pair_id", F.coalesce(F.col("is_stable") & (F.col("det3") > 0), F.lit(False)).cast("int").alias("accepted"))
    return run_ablation(job, ["pair_id"], ["accepted"], "Geometric Verification", verify=geometry_profile)


@query("SELECT pair_id, matcher, candidates FROM v_run WHERE matcher = 'ORB' AND pair_id = (SELECT min(pair_id) FROM v_run)")
def p07_filter_results(t: Tables):
    first = t.run.agg(F.min("pair_id")).first()[0]
    return B.filter_results(t.run, first, "ORB").select("pair_id", "matcher", "candidates")


def tiered(t: Tables):
    n = F.col("o_orderkey") % 4 + 1
    return t.orders.select(F.concat(F.lit("P-"), F.col("o_orderkey").cast("string")).alias("pair_id"), n.cast("int").alias("priority_tier"), (F.col("o_custkey") % 3 != 0).alias("is_real_data"))


@query("SELECT 'P-' || o_orderkey AS pair_id, CAST(o_orderkey % 4 + 1 AS integer) AS priority_tier FROM orders WHERE o_orderkey % 4 + 1 = 2 AND o_custkey % 3 <> 0 ORDER BY priority_tier, pair_id")
def p06_list_pairs(t: Tables):
    return B.list_pairs(tiered(t), 2, real_only=True).select("pair_id", "priority_tier")


@query("SELECT 'P-' || o_orderkey AS pair_id, CAST(o_orderkey % 4 + 1 AS integer) AS priority_tier FROM orders ORDER BY priority_tier, pair_id LIMIT 10")
def o04_first_ten(t: Tables):
    return B.list_pairs(tiered(t)).limit(10).select("pair_id", "priority_tier")


@query("SELECT pair_id, matcher, is_real_data FROM v_run WHERE is_real_data")
def p14_real_only(t: Tables):
    return B.real_results(t.run).select("pair_id", "matcher", "is_real_data")
