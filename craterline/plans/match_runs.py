"""From keypoints to a verdict: one staged job over all pairs and matchers.

Keypoints are matched, a transform is fitted to the matches, slopes under them and the direction of the images' gradients are
taken from the pixels, the pair is scored, its matches pass the gates, and the run is classified. A
run that cannot be made, for want of a product or of descriptors, stays as a row with its error.

A pyramid experiment is the same job with an image for each level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterline.functions import score as S
from craterline.functions.stage import stage
from craterline.operators import benchmark as B
from craterline.operators import neighbours as N
from craterline.operators import raster as R
from craterline.operators import tiles as TL
from craterline.operators import verification as V
from craterline.operators.geometry import GridPair, gate_matches, gate_tally

KEYS = ["pair_id", "matcher"]


@dataclass(frozen=True)
class Matcher:
    """Keypoints (image_id, kp_id, x, y, vec) of one kind and how they are compared; ``hashed`` proposes by hash tables."""
    keypoints: DataFrame
    metric: str = "l2"
    ratio: float = 0.80
    hashed: bool = False


def run_id(pair: str = "pair_id", matcher: str = "matcher"):
    return F.concat_ws("|", F.col(matcher), F.col(pair).cast("string"))


def matched(pairs: DataFrame, matchers: dict[str, Matcher], sizes: DataFrame | None = None) -> DataFrame:
    """Matches of all runs with coordinates: run_id, pair_id, matcher, src_id, tgt_id, src_x … tgt_y, distance.

    ``sizes``: descriptors (_n) of each image (_im) and matcher (_m), if they are counted already.
    """
    def one(name: str, m: Matcher) -> DataFrame:
        ids = pairs.select("pair_id", F.col("source_id").cast("string").alias("source_id"), F.col("target_id").cast("string").alias("target_id"))
        k = m.keypoints.withColumn("image_id", F.col("image_id").cast("string"))
        find = N.hashed_matches if m.hashed else N.match_descriptors
        own = None if sizes is None else sizes.filter(F.col("_m") == name).select(F.col("_im").alias("image_id"), F.col("_n").alias("n"))
        near = find(k, ids, m.ratio, m.metric, sizes=own).join(ids, "pair_id")
        at = lambda s: k.select(F.col("image_id").alias(f"{s}_id"), F.col("kp_id").cast("long").alias(f"{s}_kp"), F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"))
        both = near.withColumnsRenamed({"source_id": "src_id", "target_id": "tgt_id"}).join(at("src"), ["src_id", "src_kp"]).join(at("tgt"), ["tgt_id", "tgt_kp"])
        return both.withColumn("matcher", F.lit(name)).select(
            run_id().alias("run_id"), "pair_id", "matcher", F.concat_ws("-", run_id(), "src_kp").alias("match_id"), "src_id", "tgt_id",
            *[F.col(c).cast("double").alias(c) for c in ("src_x", "src_y", "tgt_x", "tgt_y", "distance")])

    return reduce(DataFrame.unionByName, [one(n, m) for n, m in matchers.items()])


def with_slopes(matches: DataFrame, pixels: DataFrame, lines: int, samples: int) -> DataFrame:
    """Matches with the mean slope around both of their points."""
    slopes = stage(TL.central_gradients(pixels).select("product_id", "line", "sample", "slope"))
    out = matches
    for side in ("src", "tgt"):
        points = matches.select(F.col("match_id").alias("key"), F.col(f"{side}_id").alias("product_id"), F.col(f"{side}_x").alias("x"), F.col(f"{side}_y").alias("y"))
        found = R.mean_slope_at(points, slopes, lines, samples).select(F.col("key").alias("match_id"), F.col("slope_mean").alias(f"{side}_slope"))
        out = out.join(found, "match_id", "left")
    return out


def gradient_alignments(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """Alignment of the mean gradients of both images of each pair; null without pixels."""
    m = stage(TL.mean_direction(pixels))
    at = lambda s, x: m.select(F.col("product_id").alias(f"{s}_id"), F.col("mean_gx").alias(f"{x}x"), F.col("mean_gy").alias(f"{x}y"))
    ids = pairs.select("pair_id", F.col("source_id").cast("string").alias("source_id"), F.col("target_id").cast("string").alias("target_id"))
    j = ids.join(at("source", "s"), "source_id", "left").join(at("target", "t"), "target_id", "left")
    return j.select("pair_id", S.gradient_alignment(*[F.col(c) for c in ("sx", "sy", "tx", "ty")]).alias("gradient_alignment"))


def evaluate_runs(pairs: DataFrame, matchers: dict[str, Matcher], width: float, height: float, pixels: DataFrame | None = None,
                  grids: GridPair | None = None, min_inliers: int = 6) -> DataFrame:
    """One row for each pair and matcher: counts, scores, gates, uncertainty, outcome and failures.

    ``pairs``: pair_id, source_id, target_id, source_sensor, target_sensor, the sampling and sun angles of
    ``verification.PAIR_META``, is_real_data, and ``error`` where a product could not be read; with ``grids`` also grid_id and
    target_grid_id. ``pixels`` (product_id as the images' ids) give slopes and gradient directions.
    """
    runs = stage(pairs.withColumn("matcher", F.explode(F.array(*[F.lit(n) for n in matchers]))).withColumn("run_id", run_id()))
    counts = reduce(DataFrame.unionByName, [m.keypoints.groupBy(F.col("image_id").cast("string").alias("_im")).agg(F.count("*").alias("_n")).withColumn("_m", F.lit(n))
                                            for n, m in matchers.items()])
    counts = stage(counts)
    for side, out in (("source_id", "keypoints_src"), ("target_id", "keypoints_tgt")):
        c = counts.select(F.col("_im").alias("_i"), F.col("_m").alias("_k"), F.col("_n").alias(out))
        runs = runs.join(c, (F.col(side).cast("string") == c["_i"]) & (F.col("matcher") == c["_k"]), "left").drop("_i", "_k")
    missing = F.when(F.col("keypoints_src").isNull(), F.concat(F.lit("Feature Matching Failure: no descriptors of "), F.col("source_id").cast("string"))) \
        .when(F.col("keypoints_tgt").isNull(), F.concat(F.lit("Feature Matching Failure: no descriptors of "), F.col("target_id").cast("string")))
    told = F.col("error") if "error" in pairs.columns else F.lit(None).cast("string")
    runs = stage(runs.withColumns({"error": F.coalesce(told, missing), "keypoints_src": F.coalesce("keypoints_src", F.lit(0)).cast("long"),
                                   "keypoints_tgt": F.coalesce("keypoints_tgt", F.lit(0)).cast("long")}))
    good = pairs.filter(told.isNull()) if "error" in pairs.columns else pairs
    matches = matched(good, matchers, counts.filter("_im is not null"))
    if pixels is not None:
        matches = with_slopes(stage(matches), pixels, int(height), int(width))
    matches = stage(matches)
    meta = runs.select(F.col("run_id").alias("pair_id"), *[F.col(c) if c in runs.columns else F.lit(None).cast("double").alias(c) for c in V.PAIR_META if c != "gradient_alignment"],
                       F.col("pair_id").alias("_pair"))
    if pixels is not None:
        meta = meta.join(gradient_alignments(good, pixels).withColumnRenamed("pair_id", "_pair"), "_pair", "left")
    else:
        meta = meta.withColumn("gradient_alignment", F.lit(None).cast("double"))
    of_run = matches.drop("pair_id").withColumnRenamed("run_id", "pair_id")
    v = V.verify_pairs(of_run, meta.drop("_pair"), width, height)
    if grids is not None:
        at = runs.select(F.col("run_id").alias("pair_id"), "grid_id", "target_grid_id", F.col("source_sensor").alias("_sensor"))
        gated = gate_matches(of_run.join(at, "pair_id"), grids, width, height, F.col("_sensor"))
        v = v.join(stage(gate_tally(gated)).select("pair_id", F.col("accepted").alias("gate_accepted"), "rejection_summary", "forced_status"), "pair_id", "left")
    else:
        v = v.withColumns({"gate_accepted": F.lit(None).cast("long"), "rejection_summary": F.lit(None).cast("string"), "forced_status": F.lit(None).cast("string")})
    v = V.pair_uncertainty(v.withColumn("status", F.coalesce("forced_status", "status")), "mean_error_px", "condition_number", "inlier_ratio", "status")
    profile = v.select(F.col("pair_id").alias("run_id"), F.col("matches").alias("candidates"), F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers"),
                       F.coalesce("inlier_ratio", F.lit(0.0)).alias("inlier_ratio"), "mean_error_px", "condition_number", "hull_ratio", "is_stable", "terrain_score",
                       "illumination_score", "overall_confidence", "total_uncertainty", "gate_accepted", "rejection_summary", F.col("status").alias("verification_status"), "h")
    joined = runs.join(stage(profile), "run_id", "left")
    broken = F.col("error").isNotNull()
    gone = lambda c, kind: F.when(broken, F.lit(None).cast(kind)).otherwise(F.col(c))
    joined = joined.withColumns({c: F.when(broken, F.lit(0).cast(k)).otherwise(F.coalesce(F.col(c), F.lit(0).cast(k))) for c, k in (("candidates", "long"), ("inliers", "long"), ("inlier_ratio", "double"))}
                                | {c: gone(c, "double") for c in ("overall_confidence", "total_uncertainty", "mean_error_px", "condition_number", "hull_ratio")}
                                | {"is_stable": F.coalesce("is_stable", F.lit(False)) & ~broken, "verification_status": F.when(broken, "REJECTED").otherwise(F.col("verification_status"))})
    return B.classify_runs(joined, min_inliers)


def level_images(keypoints: DataFrame) -> DataFrame:
    """Keypoints of pyramid levels (image_id, level_index, …) as those of images of their own."""
    return keypoints.withColumn("image_id", F.concat_ws("@", F.col("image_id").cast("string"), F.col("level_index").cast("string"))).drop("level_index")


def scale_experiment(pairs: DataFrame, levels: DataFrame, matchers: dict[str, Matcher], width: float, height: float) -> tuple[DataFrame, DataFrame]:
    """Runs of every level of the source image against the target, and the decision of each experiment (pair).

    ``levels``: image_id, level_index, scale_factor of the sources; keypoints carry ``level_index``, which for targets is 0.
    The sampling of a level is that of the source times its factor.
    """
    lv = levels.select(F.col("image_id").cast("string").alias("_im"), F.col("level_index").cast("int").alias("level_index"), "scale_factor")
    p = pairs.join(lv, pairs["source_id"].cast("string") == lv["_im"]).drop("_im")
    p = p.withColumns({"experiment_id": F.col("pair_id").cast("string"), "source_id": F.concat_ws("@", F.col("source_id").cast("string"), F.col("level_index").cast("string")),
                       "target_id": F.concat(F.col("target_id").cast("string"), F.lit("@0")), "src_gsd_m": F.col("src_gsd_m") * F.col("scale_factor"),
                       "pair_id": F.concat_ws("@", F.col("pair_id").cast("string"), F.col("level_index").cast("string"))})
    images = {n: Matcher(level_images(m.keypoints), m.metric, m.ratio, m.hashed) for n, m in matchers.items()}
    runs = stage(evaluate_runs(stage(p), images, width, height))
    return runs, B.scale_decision(runs)


def run_ablation(job, keys: list[str], metrics: list[str], component: str, **parts) -> DataFrame:
    """What a component contributes: ``job(**parts)`` against the same job without them (each None), by key."""
    return B.ablate(job(**parts), job(**dict.fromkeys(parts)), keys, metrics, component)
