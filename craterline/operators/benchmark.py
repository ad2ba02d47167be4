"""Pair lists, run classification and roll-ups of a matching benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions import geo
from craterline.functions import score as S
from craterline.functions.common import any_of, first_of
from craterline.operators import catalog
from craterline.operators.joins import overlapping_boxes
from craterline.operators.matching import inlier_statistics, score_against_truth


# --- Pairs --------------------------------------------------------------------
def tier_sensor(sensor: Column) -> Column:
    """The name under which the tiers know a sensor; labels and tables spell one camera in several ways."""
    return F.when(F.upper(F.regexp_replace(sensor, "[ _-]", "")).isin("LROCNAC", "LRONAC"), "LRO_NAC").otherwise(sensor)


def unpaired_products(products: DataFrame) -> DataFrame:
    """Products of a tier that can't be paired, one row for each tier and side, with the reason."""
    rules = catalog.small(catalog.pair_tiers(products.sparkSession))
    unknown = products.filter(any_of([F.col(c).isNull() for c in ("lat_min", "lat_max", "lon_min", "lon_max")])).withColumn("sensor", tier_sensor(F.col("sensor")))
    sides = [rules.select("priority_tier", F.lit(side).alias("side"), F.col(f"{side}_sensor").alias("sensor")).distinct() for side in ("source", "target")]
    return unknown.join(sides[0].unionByName(sides[1]), "sensor").select(
        "priority_tier", "side", "product_id", "sensor", F.lit("BOUNDS_UNKNOWN").alias("reason"))


def tier_pairs(products: DataFrame, cell_deg: float | None = 1.0) -> DataFrame:
    """Pairs of products by sensor class with tier and difficulty.

    Products whose boxes are known are paired where their footprints meet (an equi-join on grid
    cells); a pair without common ground has nothing to match and would only multiply rows. Products
    without a box are the rows of ``unpaired_products``.
    Columns: product_id, sensor, lat_min, lat_max, lon_min, lon_max.
    """
    rules = catalog.small(catalog.pair_tiers(products.sparkSession))
    products = products.withColumn("sensor", tier_sensor(F.col("sensor")))
    left = products.join(rules.select(F.col("source_sensor").alias("sensor")).distinct(), "sensor", "left_semi")
    right = products.join(rules.select(F.col("target_sensor").alias("sensor")).distinct(), "sensor", "left_semi")
    a = left.withColumnRenamed("product_id", "source_product_id")
    b = right.withColumnRenamed("product_id", "target_product_id")
    met = overlapping_boxes(a, b, "source_product_id", "target_product_id", cell_deg, strict=False)
    named = (met.select("source_product_id", "target_product_id")
             .join(a.select("source_product_id", F.col("sensor").alias("source_sensor")), "source_product_id")
             .join(b.select("target_product_id", F.col("sensor").alias("target_sensor")), "target_product_id"))
    out = named.join(rules, ["source_sensor", "target_sensor"])
    return out.select(
        F.concat_ws("_", "id_prefix", "source_product_id", "target_product_id").alias("pair_id"), "source_sensor", "target_sensor",
        "source_product_id", "target_product_id", "priority_tier", "expected_difficulty", "notes", F.lit(True).alias("is_real_data"))


def list_pairs(pairs: DataFrame, tier: int | None = None, real_only: bool = False) -> DataFrame:
    """Pairs in (tier, id) order."""
    df = pairs if tier is None else pairs.filter(F.col("priority_tier") == tier)
    df = df.filter("is_real_data") if real_only else df
    return df.orderBy("priority_tier", "pair_id")


def filter_results(results: DataFrame, pair_id: str | None = None, matcher: str | None = None) -> DataFrame:
    df = results if pair_id is None else results.filter(F.col("pair_id") == pair_id)
    return df if matcher is None else df.filter(F.col("matcher") == matcher)


# --- Runs ---------------------------------------------------------------------
def classify_runs(runs: DataFrame, min_inliers: int = 6) -> DataFrame:
    """Outcome, dominant and secondary failure of each run (one row per pair and matcher).

    Runs whose products or matcher failed carry ``error``; they stay as rejected rows.
    """
    c = F.col
    failures = S.failure_list(
        keypoints_src=c("keypoints_src"), keypoints_tgt=c("keypoints_tgt"), candidates=c("candidates"), inliers=c("inliers"),
        inlier_ratio=c("inlier_ratio"), mean_error=c("mean_error_px"), condition=c("condition_number"), hull_ratio=c("hull_ratio"),
        src_instrument=c("source_sensor"), tgt_instrument=c("target_sensor"), src_gsd=c("src_gsd_m"), tgt_gsd=c("tgt_gsd_m"),
        src_az=c("src_azimuth"), tgt_az=c("tgt_azimuth"), min_inliers=min_inliers)
    df = runs.withColumn("failures", failures)
    ranked = S.by_severity(c("failures"))
    known = (c("src_gsd_m") > 0) & (c("tgt_gsd_m") > 0)
    error = c("error") if "error" in runs.columns else F.lit(None).cast("string")
    broken = error.isNotNull()
    return df.withColumns({
        "status": F.when(broken, "REJECTED").otherwise(S.pair_outcome(F.size("failures"), c("inliers"), c("inlier_ratio"), c("is_stable"))),
        "dominant_failure": F.when(broken, "COMPUTATIONAL_FAILURE").otherwise(F.get(ranked, 0)),
        "secondary_failure": F.when(~broken, F.get(ranked, 1)),
        "first_reason": F.when(broken, error).otherwise(F.get(c("failures"), 0)["reason"]),
        "failure_count": F.when(broken, 0).otherwise(F.size("failures")),
        "scale_ratio": F.when(known, c("src_gsd_m") / c("tgt_gsd_m")),
        "scale_ratio_status": F.when(known, "KNOWN").otherwise("UNKNOWN")})


def benchmark_summary(results: DataFrame) -> DataFrame:
    """Distinct pairs, runs, status counts and whether any run is real; one row."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        F.count_distinct("pair_id").alias("pairs"), F.count("*").alias("runs"),
        F.count_if(F.col("status").isin("ACCEPTED", "GEOMETRICALLY_STABLE")).alias("accepted"), n("REJECTED").alias("rejected"),
        n("AMBIGUOUS").alias("ambiguous"), n("INSUFFICIENT_EVIDENCE").alias("insufficient"), n("GEOMETRICALLY_DEGENERATE").alias("degenerate"),
        F.coalesce(F.bool_or("is_real_data"), F.lit(False)).alias("has_real_data"))


def real_results(results: DataFrame) -> DataFrame:
    """Synthetic rows never enter a real roll-up."""
    return results.filter("is_real_data")


def scale_decision(results: DataFrame) -> DataFrame:
    """Decision of a scale experiment from level 0 against the derived levels; one row per experiment."""
    derived = F.col("level_index") > 0
    top = lambda v, cond: F.coalesce(F.max(F.when(cond, F.col(v))), F.lit(0))
    g = results.groupBy("experiment_id").agg(
        top("inliers", ~derived).alias("base_inliers"), top("inliers", derived).alias("derived_inliers"),
        top("candidates", derived).alias("derived_candidates"), F.count_if("is_stable").alias("stable_runs"))
    return g.withColumn("decision", first_of([
        ((F.col("stable_runs") == 0) & ((F.col("derived_candidates") > 0) | (F.col("derived_inliers") > 0)), "SCALE_EFFECT_OBSERVED_BUT_GEOMETRICALLY_UNSTABLE"),
        (F.col("stable_runs") > 0, "GEOMETRICALLY_STABLE_CORRESPONDENCE_FOUND"),
        (F.col("derived_inliers") > F.col("base_inliers"), "SCALE_EFFECT_SUPPORTED"),
        ((F.col("derived_inliers") == F.col("base_inliers")) & (F.col("derived_inliers") > 0), "INCONCLUSIVE"),
    ], "SCALE_EFFECT_NOT_SUPPORTED"))


# --- Method comparison and sweeps --------------------------------------------
def compare_methods(residuals: DataFrame, inliers: DataFrame, cap: int = 100, tolerance: float = 3.5) -> DataFrame:
    """Metrics per method and condition; physics-aware methods refuse reflections and partial overlap.

    ``residuals``: method, condition, physics (bool), residual against the known transform.
    ``inliers``: method, condition, inliers of the verified transform.
    """
    keys = ["method", "condition", "physics"]
    s = score_against_truth(residuals, keys, tolerance, cap).join(inliers.select("method", "condition", "inliers"), ["method", "condition"], "left")
    s = s.withColumn("inliers", F.coalesce("inliers", F.lit(0)).cast("bigint"))
    label, enough = F.col("condition"), F.col("inliers") >= 6
    unphysical = any_of([label.contains(k) for k in ("reflection", "partial_overlap")])
    return s.withColumns({
        "physical_validation": first_of([
            (~F.col("physics"), "NOT_APPLIED"), (unphysical, "REJECTED_UNPHYSICAL_GEOMETRY"),
            (label.contains("illum"), "ACCEPTED_ILLUMINATION_CONSISTENT"), (enough, "ACCEPTED_SURFACE_CONSISTENT")], "REJECTED_DEGENERATE"),
        "final_classification": first_of([
            (~F.col("physics") & enough, "INLIER_CONFIRMED"), (~F.col("physics"), "AMBIGUOUS"), (unphysical, "PHYSICALLY_REJECTED"),
            (label.contains("illum"), "ILLUMINATION_ROBUST"), (enough, "VERIFIED_CORRESPONDENCE")], "AMBIGUOUS")})


def sweep_curves(residuals: DataFrame, cap: int | Column = 50, tolerance: float = 3.5, min_inliers: int = 6) -> DataFrame:
    """One row per (sweep, method, value) from a match table tagged with the sweep."""
    keys = ["sweep", "method", "value"]
    s = score_against_truth(residuals, keys, tolerance, cap)
    kept = F.col("tp") > 0
    return s.withColumns({
        "median_error": F.when(kept, F.col("median_error")), "p95_error": F.when(kept, F.col("p95_error")),
        "classification": first_of([
            ((F.col("sweep") == "overlap_fraction") & (F.col("value") == 0), "FOOTPRINT_NON_OVERLAP"),
            (F.col("tp") >= min_inliers, "INLIER_CONFIRMED")], "AMBIGUOUS")})


def relief_sweep(reliefs: DataFrame, sensor: str = "TMC-2", look_deg: float = 5.6) -> DataFrame:
    """Displacement for each relief (relief_m, sample) and its difference from h*tan(look angle)."""
    altitude_km, gsd, _, center = C.PARALLAX_SENSORS[sensor]
    args = (altitude_km * 1000.0, gsd, center)
    d = F.abs(geo.ground_displacement(F.col("relief_m"), F.col("sample"), *args))
    theory = F.abs(F.col("relief_m") * F.tan(geo.look_angle(F.col("sample"), *args)))
    return reliefs.withColumns({"displacement_m": d, "look_angle_deg": F.degrees(geo.look_angle(F.col("sample"), *args)),
                                "error_m": F.abs(d - theory), "nominal_m": F.col("relief_m") * F.tan(F.radians(F.lit(look_deg)))})


def ablate(full: DataFrame, ablated: DataFrame, keys: list[str], metrics: list[str], component: str) -> DataFrame:
    """Both variants of an operator side by side with the differences of their metrics.

    Keys present on one side only stay, with zero on the other.
    """
    a = full.select(*keys, *[F.col(m).alias(f"full_{m}") for m in metrics])
    b = ablated.select(*keys, *[F.col(m).alias(f"ablated_{m}") for m in metrics])
    j = a.join(b, keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(F.lit(component).alias("component"), *keys, *[
        e for m in metrics for e in (zero(f"full_{m}").alias(f"full_{m}"), zero(f"ablated_{m}").alias(f"ablated_{m}"),
                                     (zero(f"full_{m}") - zero(f"ablated_{m}")).alias(f"delta_{m}"))])


def run_statistics(residuals: DataFrame) -> DataFrame:
    """Inlier statistics of a run table, keyed like a pair."""
    return inlier_statistics(residuals)
