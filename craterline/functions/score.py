"""Scores, degeneracy tests and classifications of image pairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from craterline.constants import CONFIDENCE_WEIGHTS, GATE_REASONS, GROUND_TRUTH_NAMES
from craterline.functions.common import all_of, any_of, clip, compact, first_of, fixed, round_at
from craterline.functions.geo import azimuth_difference, boxes_overlap, project


# --- Illumination -------------------------------------------------------------
def illumination_score(src_az: Column, tgt_az: Column, src_el: Column, tgt_el: Column, gradient: Column,
                       max_azimuth: float = 120.0) -> Column:
    """Missing sun angles count as 45 and 30 degrees; see ``illumination_defaulted``."""
    d_az = azimuth_difference(F.coalesce(src_az, F.lit(45.0)), F.coalesce(tgt_az, F.lit(45.0)))
    d_el = F.abs(F.coalesce(src_el, F.lit(30.0)) - F.coalesce(tgt_el, F.lit(30.0)))
    part = d_az / F.lit(max_azimuth)
    az = clip(F.lit(1.0) - part * part, 0.0, 1.0)
    el = clip(F.lit(1.0) - d_el / F.lit(50.0), 0.2, 1.0)
    return F.lit(0.40) * az + F.lit(0.30) * el + F.lit(0.30) * F.coalesce(gradient, F.lit(0.70))


def illumination_defaulted(*angles: Column) -> Column:
    return any_of([a.isNull() for a in angles])


def gradient_alignment(sx: Column, sy: Column, tx: Column, ty: Column) -> Column:
    """Cosine of two mean gradient directions mapped to 0..1."""
    norm = F.sqrt(sx * sx + sy * sy) * F.sqrt(tx * tx + ty * ty) + F.lit(1e-6)
    return clip(((sx * tx + sy * ty) / norm + F.lit(1.0)) / F.lit(2.0), 0.0, 1.0)


# --- Planar transforms --------------------------------------------------------
def _entries(h: Column) -> list[Column]:
    return [F.element_at(h, i + 1) for i in range(9)]


def det2(h: Column) -> Column:
    a, b, _, d, e, *_ = _entries(h)
    return a * e - b * d


def det3(h: Column) -> Column:
    a, b, c, d, e, f, g, i, j = _entries(h)
    return a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)


def anisotropy(h: Column) -> Column:
    """Ratio of the singular values of the 2x2 part, smaller one floored at 1e-7."""
    a, b, _, d, e, *_ = _entries(h)
    s1, s2 = F.hypot(a + e, d - b), F.hypot(a - e, b + d)
    return (s1 + s2) / F.lit(2.0) / F.greatest(F.abs(s1 - s2) / F.lit(2.0), F.lit(1e-7))


def condition_number(h: Column, size: Column | float) -> Column:
    """2-norm condition of the transform in coordinates scaled by the larger image side.

    The squared singular values are the roots of a cubic. Its first coefficient is the sum
    of squares, the second the sum of squared 2x2 minors, the third the squared determinant;
    none of the three loses digits by cancellation. The largest root is polished by Newton
    steps and the smallest follows from the product, so the value holds for ill-conditioned
    transforms as well.
    """
    size = size if isinstance(size, Column) else F.lit(float(size))
    names = "abcdefgij"
    scaled = [e / size if n in "cf" else e * size if n in "gi" else e for n, e in zip(names, _entries(h))]

    def let(items: Column, body) -> Column:
        # One-element transform: the lambda variable is evaluated once and then shared.
        return F.transform(items, body)

    def coefficients(m: Column) -> Column:
        a, b, c, d, e, f, g, i, j = (m[n] for n in names)
        minors = [a * e - b * d, a * f - c * d, b * f - c * e, a * i - b * g, a * j - c * g,
                  b * j - c * i, d * i - e * g, d * j - f * g, e * j - f * i]
        det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
        squares = lambda xs: sum([x * x for x in xs[1:]], xs[0] * xs[0])
        return F.struct(squares([m[n] for n in names]).alias("p"), squares(minors).alias("q"), (det * det).alias("r"))

    def largest(k: Column) -> Column:
        # Newton from above converges to the largest root of x^3 - p x^2 + q x - r.
        def step(x: Column, _: Column) -> Column:
            slope = (x * 3 - k["p"] * 2) * x + k["q"]
            return x - (((x - k["p"]) * x + k["q"]) * x - k["r"]) / F.when(slope != 0, slope).otherwise(F.lit(1.0))

        top = F.aggregate(F.sequence(F.lit(1), F.lit(40)), k["p"], step)
        return F.struct(k["p"].alias("p"), k["q"].alias("q"), k["r"].alias("r"), top.alias("top"))

    def rest(k: Column) -> Column:
        # The other two roots have product r / top and sum (q - product) / top.
        product = k["r"] / k["top"]
        total = (k["q"] - product) / k["top"]
        big = (total + F.sqrt(F.greatest(total * total - product * 4, F.lit(0.0)))) / 2
        return F.struct(k["top"].alias("top"), (product / F.when(big > 0, big)).alias("small"))

    start = F.array(F.struct(*[e.cast("double").alias(n) for n, e in zip(names, scaled)]))
    cond = let(let(let(let(start, coefficients), largest), rest), lambda k: F.sqrt(k["top"] / F.when(k["small"] > 0, k["small"])))
    value = F.element_at(cond, 1)
    return F.when(h.isNotNull(), F.least(F.coalesce(value, F.lit(1e12)), F.lit(1e12)))


def corners_valid(h: Column, width: Column | float, height: Column | float) -> Column:
    """Projected image corners form a convex polygon wound the same way as the source."""
    width = width if isinstance(width, Column) else F.lit(float(width))
    height = height if isinstance(height, Column) else F.lit(float(height))
    zero = F.lit(0.0)
    pts = [project(h, x, y) for x, y in [(zero, zero), (width, zero), (width, height), (zero, height)]]
    turns = []
    for n in range(4):
        (x0, y0, _), (x1, y1, _), (x2, y2, _) = pts[n], pts[(n + 1) % 4], pts[(n + 2) % 4]
        turns.append((x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1))
    return all_of([t > 0 for t in turns]) & ~corner_pole(h, width, height)


def corner_pole(h: Column, width: Column | float, height: Column | float) -> Column:
    width = width if isinstance(width, Column) else F.lit(float(width))
    height = height if isinstance(height, Column) else F.lit(float(height))
    zero = F.lit(0.0)
    return any_of([F.abs(project(h, x, y)[2]) < 0.1
                   for x, y in [(zero, zero), (width, zero), (width, height), (zero, height)]])


def degeneracies(condition: Column, d2: Column, d3: Column, stretch: Column, pole: Column, corners_ok: Column,
                 mean_error: Column, median_error: Column, p95_error: Column, max_condition: float = 500.0) -> Column:
    """Array of degeneracy texts, empty when the transform is sound."""
    sci = F.format_string("%.1e", condition)
    return compact([
        F.when(condition > max_condition, F.concat(F.lit("HIGH_CONDITION_NUMBER (kappa="), sci, F.lit(")"))),
        F.when((d2 <= 0.01) | (d2 > 100.0), F.concat(F.lit("EXTREME_DETERMINANT (det="), fixed(d2, 3), F.lit(")"))),
        F.when(d3 <= 0, F.lit("NEGATIVE_HOMOGRAPHY_DETERMINANT")),
        F.when(stretch > 4.0, F.concat(F.lit("EXTREME_ANISOTROPIC_DISTORTION (ratio="), fixed(stretch, 2), F.lit(")"))),
        F.when(pole, F.lit("VANISHING_LINE_IN_FRAME_POLE")),
        F.when(~corners_ok, F.lit("NON_CONVEX_FLIPPED_CORNER_PROJECTION")),
        F.when((mean_error > 20.0) | (median_error > 10.0), F.concat(
            F.lit("EXTREME_REPROJECTION_RESIDUAL (mean="), fixed(mean_error, 1), F.lit("px, median="),
            fixed(median_error, 1), F.lit("px)"))),
        F.when(p95_error > 25.0, F.concat(F.lit("EXTREME_TAIL_RESIDUAL (p95="), fixed(p95_error, 1), F.lit("px)"))),
    ])


def geometry_score(matches: Column, inliers: Column, degenerate: Column, mean_error: Column,
                   min_inliers: int = 6, max_error: float = 4.0) -> Column:
    ratio = inliers / F.greatest(matches, F.lit(1))
    good = (F.lit(0.55) * clip(ratio / F.lit(0.85), 0.0, 1.0)
            + F.lit(0.45) * clip(F.lit(1.0) - mean_error / F.lit(max_error), 0.0, 1.0))
    return first_of([
        (matches < 4, F.lit(0.0)),
        (inliers < min_inliers, clip(ratio * F.lit(0.5), 0.0, 0.4)),
        (degenerate, F.lit(0.10)),
    ], good)


# --- Scale and spread ---------------------------------------------------------
def scale_ratio(source_gsd: Column, target_gsd: Column) -> Column:
    """Target over source; null unless both are positive."""
    return F.when((source_gsd > 0) & (target_gsd > 0), target_gsd / source_gsd)


def scale_score(d2: Column, source_gsd: Column, target_gsd: Column, factor: float = 3.5) -> Column:
    """0.5 where a ground sampling distance is unknown."""
    known = (source_gsd > 0) & (target_gsd > 0)
    expected = source_gsd / F.greatest(target_gsd, F.lit(1e-4))
    estimated = F.sqrt(F.abs(d2))
    worse = F.greatest(estimated / F.greatest(expected, F.lit(1e-5)), expected / F.greatest(estimated, F.lit(1e-5)))
    return F.when(known, clip(F.lit(1.0) - (worse - F.lit(1.0)) / F.lit(factor), 0.1, 1.0)).otherwise(F.lit(0.5))


def spatial_score(hull_ratio: Column, entropy: Column) -> Column:
    return F.lit(0.55) * clip(hull_ratio / F.lit(0.35), 0.0, 1.0) + F.lit(0.45) * entropy


def terrain_score(slope_corr: Column, roughness: Column) -> Column:
    aspect = clip(F.lit(0.5) * slope_corr + F.lit(0.5) * roughness, 0.0, 1.0)
    return F.lit(0.50) * slope_corr + F.lit(0.30) * roughness + F.lit(0.20) * aspect


# --- Composite ----------------------------------------------------------------
def composite_confidence(visual: Column, geometry: Column, illumination: Column, terrain: Column, scale: Column,
                         spatial: Column, geometry_valid: Column, weights: dict[str, float] | None = None) -> Column:
    w = weights or CONFIDENCE_WEIGHTS
    total = (F.lit(w["visual"]) * visual + F.lit(w["geometry"]) * geometry + F.lit(w["illumination"]) * illumination
             + F.lit(w["terrain"]) * terrain + F.lit(w["scale"]) * scale + F.lit(w["spatial"]) * spatial)
    return F.when(geometry_valid, total).otherwise(F.least(total, F.lit(0.40)))


def pair_status(confidence: Column, reason_count: Column, verified: float = 0.72, rejected: float = 0.45) -> Column:
    return first_of([
        ((confidence >= verified) & (reason_count == 0), "VERIFIED"),
        ((confidence < rejected) | (reason_count >= 2), "REJECTED"),
    ], "UNCERTAIN")


# --- Benchmark classifications -----------------------------------------------
def ground_truth_level(src_synthetic: Column, tgt_synthetic: Column, src_box: tuple, tgt_box: tuple,
                       explicit: Column | None = None) -> Column:
    """A synthetic side always gives level 4; boxes are (lat_lo, lat_hi, lon_lo, lon_hi), touching counts."""
    overlap = boxes_overlap(*src_box, *tgt_box, strict=False)
    derived = F.when(F.coalesce(overlap, F.lit(False)) & all_of([c.isNotNull() for c in (*src_box, *tgt_box)]), 1).otherwise(0)
    level = derived if explicit is None else F.coalesce(explicit, derived)
    return F.when(src_synthetic | tgt_synthetic, 4).otherwise(level)


def ground_truth_name(level: Column) -> Column:
    return first_of([(level == k, v) for k, v in GROUND_TRUTH_NAMES.items()], "LEVEL_UNKNOWN")


def failure_list(*, keypoints_src: Column, keypoints_tgt: Column, candidates: Column, inliers: Column,
                 inlier_ratio: Column, mean_error: Column, condition: Column, hull_ratio: Column,
                 src_instrument: Column, tgt_instrument: Column, src_gsd: Column, tgt_gsd: Column,
                 src_az: Column, tgt_az: Column, min_inliers: int = 8, min_ratio: float = 0.25,
                 max_error: float = 4.0, min_hull: float = 0.04) -> Column:
    """Failures in detection order as structs (category, severity, ordinal, reason)."""
    src_i, tgt_i = F.upper(F.coalesce(src_instrument, F.lit(""))), F.upper(F.coalesce(tgt_instrument, F.lit("")))
    d_az = azimuth_difference(src_az, tgt_az)
    number = lambda c: c.cast("string")
    percent = lambda c, n: fixed(c * 100, n)
    rules = [
        ((keypoints_src < 10) | (keypoints_tgt < 10), "FEATURE_SPARSITY_FAILURE", 0.90, F.concat(
            F.lit("Feature Sparsity: Extremely low keypoint extraction count (Src: "), number(keypoints_src),
            F.lit(", Tgt: "), number(keypoints_tgt), F.lit(")"))),
        (candidates < 4, "FEATURE_SPARSITY_FAILURE", 0.95, F.concat(
            F.lit("Insufficient Candidate Matches: Only "), number(candidates), F.lit(" raw candidate matches found"))),
        (inliers < min_inliers, "GEOMETRIC_FAILURE", 0.85, F.concat(
            F.lit("Low Inlier Count: "), number(inliers), F.lit(f" inliers found (< {min_inliers} required minimum)"))),
        (inlier_ratio < min_ratio, "GEOMETRIC_FAILURE", 0.80, F.concat(
            F.lit("Low Inlier Ratio: "), percent(inlier_ratio, 1), F.lit(f"% inliers (< {min_ratio:.1%} required)"))),
        (mean_error > max_error, "GEOMETRIC_FAILURE", 0.88, F.concat(
            F.lit("High Reprojection Error: "), fixed(mean_error, 2),
            F.lit(f" px mean residual (> {max_error:.1f} px threshold)"))),
        (condition > 500.0, "GEOMETRIC_FAILURE", 0.75, F.concat(
            F.lit("Unstable Transformation Matrix: Homography condition number = "), fixed(condition, 1),
            F.lit(" (> 500.0)"))),
        ((hull_ratio < min_hull) & (inliers >= min_inliers), "FALSE_CORRESPONDENCE_RISK", 0.92, F.concat(
            F.lit("Spatial Coverage Collapse: Inliers cover only "), percent(hull_ratio, 2),
            F.lit(f"% of frame (< {min_hull * 100:.1f}% minimum)"))),
        ((src_i.contains("IIRS") | tgt_i.contains("IIRS")) & (src_i != tgt_i), "CROSS_MODAL_FAILURE", 0.70,
         F.lit("Cross-Modal Ambiguity: IIRS spectral imagery vs panchromatic optical camera mismatch")),
        (src_gsd.isNull() | tgt_gsd.isNull(), "METADATA_UNCERTAINTY", 0.50,
         F.lit("Metadata Uncertainty: Native GSD is UNKNOWN for one or both products")),
        (d_az > 90.0, "ILLUMINATION_FAILURE", 0.80, F.concat(
            F.lit("Severe Solar Illumination Shift: Sun azimuth difference ΔAz = "), fixed(d_az, 1), F.lit("°"))),
    ]
    return compact([
        F.when(cond, F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"),
                              F.lit(n).alias("ordinal"), reason.alias("reason")))
        for n, (cond, cat, sev, reason) in enumerate(rules)
    ])


def by_severity(failures: Column) -> Column:
    """Failures by falling severity, detection order among equals."""
    key = F.transform(failures, lambda f: F.struct(
        (-f["severity"]).alias("k"), f["ordinal"].alias("o"), f["category"].alias("category")))
    return F.transform(F.array_sort(key), lambda f: f["category"])


def pair_outcome(reason_count: Column, inliers: Column, inlier_ratio: Column, stable: Column) -> Column:
    return first_of([
        ((reason_count == 0) & stable, "GEOMETRICALLY_STABLE"),
        (reason_count == 0, "ACCEPTED"),
        (inliers < 4, "INSUFFICIENT_EVIDENCE"),
        (~stable, "GEOMETRICALLY_DEGENERATE"),
        ((inlier_ratio >= 0.15) & (inliers >= 5), "AMBIGUOUS"),
    ], "REJECTED")


# --- Gate and status maps -----------------------------------------------------
def physically_passed(status: Column, inliers: Column) -> Column:
    return ~status.isin("REJECTED", "GEOMETRICALLY_DEGENERATE") & (inliers > 0)


def gate_results(reasons: Column, passed: Column) -> Column:
    """One struct per gate: REJECTED when its reason occurs, else PASS or NOT_EVALUATED."""
    text = F.concat_ws(" ", reasons)
    return F.array(*[
        F.struct(F.lit(gate).alias("gate_id"), F.lit(reason).alias("gate_reason"), first_of([
            (text.contains(reason), "REJECTED"), (passed, "PASS")], "NOT_EVALUATED").alias("status"))
        for gate, reason in GATE_REASONS.items()
    ])


def final_status(status: Column) -> Column:
    return F.when(status.isin("ACCEPTED", "ACCEPTED_ILLUMINATION_CONSISTENT", "SUPPORTED", "VERIFIED"),
                  F.lit("ACCEPTED")).otherwise(status)


def state_by_confidence(confidence: Column) -> Column:
    return first_of([(confidence >= 0.90, "CONFIRMED"), (confidence >= 0.70, "SUPPORTED")], "CANDIDATE")


def scale_needs_normalisation(src_gsd: Column, tgt_gsd: Column) -> tuple[Column, Column]:
    """(ratio of the coarser to the finer sampling, ratio above two); missing counts as 1 m."""
    a, b = (F.when(F.coalesce(g, F.lit(0.0)) != 0.0, g).otherwise(F.lit(1.0)) for g in (src_gsd, tgt_gsd))
    ratio = F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1e-4))
    return ratio, ratio > 2.0


def information_gain(uncertainty: Column, relevance: Column, seen: Column, quality: Column, feasibility: Column) -> Column:
    missing = F.when(seen, F.lit(0.45)).otherwise(F.lit(1.0))
    return round_at(F.greatest(uncertainty, F.lit(0.25)) * relevance * missing * quality * feasibility, 4)
