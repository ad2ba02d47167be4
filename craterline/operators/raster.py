"""Pixel tables (product_id, line, sample, band, dn): masks, stretch, downsampling, gradients, residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline.functions import geo
from craterline.functions.common import clip
from craterline.operators.tiles import gaussian_blur  # noqa: F401


def mask_nodata(pixels: DataFrame, nodata: float) -> DataFrame:
    return pixels.filter(F.col("dn").isNotNull() & ~F.isnan(F.col("dn").cast("double")) & (F.col("dn") != nodata))


def select_band(pixels: DataFrame, band: int = 0) -> DataFrame:
    return pixels.filter(F.col("band") == band)


def decimate(pixels: DataFrame, max_dimension: int = 2048) -> DataFrame:
    """Every s-th line and sample of each product, s = ceil(longest side / max_dimension)."""
    size = pixels.groupBy("product_id").agg((F.greatest(F.max("line"), F.max("sample")) + 1).alias("_side"))
    size = size.select(F.col("product_id").alias("_pid"), F.greatest(F.ceil(F.col("_side") / max_dimension), F.lit(1)).alias("_step"))
    j = pixels.join(size, pixels["product_id"] == size["_pid"])
    return j.filter((F.col("line") % F.col("_step") == 0) & (F.col("sample") % F.col("_step") == 0)).drop("_pid", "_step")


def integrity(pixels: DataFrame) -> DataFrame:
    """Per product: any NaN is a warning, any infinity an error."""
    v = F.col("dn").cast("double")
    return pixels.groupBy("product_id").agg(
        F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)).alias("has_nan"),
        F.coalesce(F.bool_or(F.abs(v) == float("inf")), F.lit(False)).alias("has_inf"))


def stretch_8bit(pixels: DataFrame) -> DataFrame:
    """Min-max stretch per product to 0..255 on finite values; a constant product becomes 0."""
    v = F.col("dn").cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    span = pixels.filter(finite).groupBy("product_id").agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    span = span.select(F.col("product_id").alias("_pid"), "_lo", "_hi")
    j = pixels.join(span, pixels["product_id"] == span["_pid"], "left")
    scaled = F.floor(clip((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(255.0), 0.0, 255.0)).cast("int")
    value = F.when(finite & (F.col("_hi") > F.col("_lo")), scaled).otherwise(0)
    return j.select(*pixels.columns, value.alias("dn8"))


# --- Area-average pyramid -----------------------------------------------------
def pyramid_levels(products: DataFrame, target_gsd: float) -> DataFrame:
    """Level table of each product (product_id, gsd_m, lines, samples): factor, size, sampling, provenance."""
    exact = F.lit(float(target_gsd)) / F.col("gsd_m")
    levels = F.array(*[F.lit(float(x)) for x in (1, 2, 4, 8, 16)], exact)
    df = products.filter(F.col("gsd_m") > 0).select(*products.columns, F.posexplode(levels).alias("level_index", "scale_factor"))
    original = F.col("scale_factor") == 1.0
    size = lambda c: F.when(original, F.col(c)).otherwise(F.greatest(F.rint(F.col(c) / F.col("scale_factor")), F.lit(1.0)).cast("long"))
    name = F.when(original, "Level_0_Original").when(F.col("scale_factor") == exact, F.concat(F.lit("Level_"), F.col("level_index").cast("string"), F.lit("_TMC_Equivalent"))) \
            .otherwise(F.concat(F.lit("Level_"), F.col("level_index").cast("string")))
    return df.select(
        "product_id", "level_index", name.alias("level_name"), "scale_factor", (F.col("gsd_m") * F.col("scale_factor")).alias("effective_gsd_m"),
        size("lines").alias("lines"), size("samples").alias("samples"),
        F.when(original, "none_original").otherwise("anti_aliased_area_averaging").alias("resampling_method"),
        (~original).alias("derived_from_real_data"))


def _shares(pos: Column, scale: float, size: int) -> Column:
    """Output cells that an input cell overlaps, with the overlap length; at most two for scale >= 1."""
    lo, hi = pos / F.lit(scale), (pos + 1) / F.lit(scale)
    first = F.floor(lo).cast("long")
    last = F.least(F.ceil(hi).cast("long") - 1, F.lit(size - 1))
    return F.transform(
        F.sequence(F.least(first, F.lit(size - 1)), F.greatest(last, F.least(first, F.lit(size - 1)))),
        lambda k: F.struct(k.alias("at"), (F.least(hi, (k + 1).cast("double")) - F.greatest(lo, k.cast("double"))).alias("w")))


def downsample(pixels: DataFrame, scale: float, lines: int, samples: int) -> DataFrame:
    """Area average to round(lines/scale) x round(samples/scale) cells; fractional edges are weighted.

    The averages are formed map-side first, so the shuffle carries about one row per output cell
    and task, not the pixels.
    """
    out_l, out_s = max(1, round(lines / scale)), max(1, round(samples / scale))
    sl, ss = lines / out_l, samples / out_s
    d = (pixels.withColumn("_l", F.explode(_shares(F.col("line"), sl, out_l))).withColumn("_s", F.explode(_shares(F.col("sample"), ss, out_s))))
    w = F.col("_l.w") * F.col("_s.w")
    return (d.filter(w > 1e-12).groupBy("product_id", F.col("_l.at").alias("line"), F.col("_s.at").alias("sample"))
             .agg((F.sum(F.col("dn") * w) / F.sum(w)).alias("dn")))


# --- Gradients ----------------------------------------------------------------
def mean_slope_at(points: DataFrame, slopes: DataFrame, lines: int, samples: int, x: str = "x", y: str = "y", out: str = "slope_mean") -> DataFrame:
    """Mean slope of the 3x3 window around each point, kept two cells inside the frame.

    Points need a unique ``key`` column and a product_id. The windows are summed up over the cells, map-side first, so a point
    goes through one join and is never written out for each cell of its window.
    """
    cx = F.least(F.greatest(F.col(x), F.lit(2.0)), F.lit(float(samples - 3))).cast("long")
    cy = F.least(F.greatest(F.col(y), F.lit(2.0)), F.lit(float(lines - 3))).cast("long")
    window = F.array(*[F.struct(F.lit(a).alias("dl"), F.lit(b).alias("ds")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    s = slopes.select(F.col("product_id").alias("_pid"), F.col("line").cast("long").alias("_line"), F.col("sample").cast("long").alias("_sample"), "slope").withColumn("_w", F.explode(window))
    s = s.groupBy("_pid", (F.col("_line") + F.col("_w.dl")).alias("_sl"), (F.col("_sample") + F.col("_w.ds")).alias("_ss")).agg(
        F.sum("slope").alias("_sum"), F.count("slope").alias("_n"))
    q = points.withColumn("_l", cy).withColumn("_s", cx)
    j = q.join(s, (q["product_id"] == s["_pid"]) & (q["_l"] == s["_sl"]) & (q["_s"] == s["_ss"]), "left")
    carried = [F.first(c).alias(c) for c in points.columns if c != "key"]
    return j.groupBy("key").agg(*carried, F.try_divide(F.sum("_sum"), F.sum("_n")).alias(out)).select(*points.columns, out)


# --- Registration residual ----------------------------------------------------
def overlap_rmse(source: DataFrame, target: DataFrame, pairs: DataFrame, floor: float = 5.0, min_overlap: int = 100) -> DataFrame:
    """Root mean square difference of registered pixels per pair.

    ``pairs`` holds pair_id, source_id, target_id and the transform ``h`` (nine numbers). Pixels
    count where both values exceed ``floor``; with at most ``min_overlap`` of them, all overlapping
    pixels count.
    """
    p = pairs.select("pair_id", F.col("source_id").alias("_src"), F.col("target_id").alias("_tgt"), "h")
    s = source.join(p, source["product_id"] == p["_src"])
    x, y, _ = geo.project(F.col("h"), F.col("sample").cast("double"), F.col("line").cast("double"), guarded=False)
    s = s.select("pair_id", "_tgt", F.rint(y).cast("long").alias("_line"), F.rint(x).cast("long").alias("_sample"), F.col("dn").cast("double").alias("a"))
    t = target.select(F.col("product_id").alias("_tp"), F.col("line").alias("_tl"), F.col("sample").alias("_ts"), F.col("dn").cast("double").alias("b"))
    j = s.join(t, (s["_tgt"] == t["_tp"]) & (s["_line"] == t["_tl"]) & (s["_sample"] == t["_ts"]))
    d2 = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))
    lit_up = (F.col("a") > floor) & (F.col("b") > floor)
    g = j.groupBy("pair_id").agg(F.count("*").alias("overlap_pixels"), F.count_if(lit_up).alias("valid_pixels"),
                                 F.avg(d2).alias("_all"), F.avg(F.when(lit_up, d2)).alias("_valid"))
    return g.select("pair_id", "overlap_pixels", "valid_pixels",
                    F.sqrt(F.when(F.col("valid_pixels") > min_overlap, F.col("_valid")).otherwise(F.col("_all"))).alias("rmse"))


