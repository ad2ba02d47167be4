"""Neighbourhood work on pixel tables (product_id, line, sample, dn) in tiles with a rim.

A pixel is sent to its own tile and to those whose rim it lies in, once for each; a task then holds a
dense array of bounded size and does all neighbour work on it. That is one shuffle, whatever
the operator, and a product of any size is many tiles. Pixels that are absent, null or NaN are no
neighbours; pixels of a ``band`` only meet their own band.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline.functions.stage import stage

#: Lines and samples of a tile without its rim.
TILE = 256
#: Reductions beyond this are smoothed first.
SMOOTHED_FROM = 1.5


def _bands(pixels: DataFrame) -> list[str]:
    return ["band"] if "band" in pixels.columns else []


def _tiles_of(position: Column, size: int, rim: int) -> Column:
    low = F.greatest(F.floor((position - rim) / size), F.lit(0))
    return F.explode(F.sequence(low.cast("int"), F.floor((position + rim) / size).cast("int")))


def by_tile(pixels: DataFrame, work: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str], rim: int = 1, size: int = TILE) -> DataFrame:
    """The pixels with columns ``names`` that ``work`` gives from an array with its rim, NaN where there is no value.

    ``work`` returns arrays without the rim; NaN becomes null.
    """
    keys = ["product_id", *_bands(pixels)]
    p = pixels.select(*keys, F.col("line").cast("long").alias("line"), F.col("sample").cast("long").alias("sample"), F.col("dn").cast("double").alias("dn"))
    spread = p.withColumn("_tl", _tiles_of(F.col("line"), size, rim)).withColumn("_ts", _tiles_of(F.col("sample"), size, rim))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in p.schema] + [f"{n} double" for n in names])
    columns = p.columns

    def run(key, table):
        first = [k.as_py() * size for k in key[-2:]]
        line, sample = (table[c].to_numpy() - f for c, f in zip(("line", "sample"), first, strict=True))
        own = (line >= 0) & (line < size) & (sample >= 0) & (sample < size)
        if not own.any():  # a tile beyond the last line or sample
            return pa.table({c: table[c].slice(0, 0) for c in columns} | {n: pa.array([], pa.float64()) for n in names})
        # No larger than the pixels reach.
        shape = [min(size, int(x[own].max()) + 1) + 2 * rim for x in (line, sample)]
        inside = (line < shape[0] - rim) & (sample < shape[1] - rim)
        dense = np.full(shape, np.nan)
        dense[line[inside] + rim, sample[inside] + rim] = table["dn"].to_numpy(zero_copy_only=False)[inside]
        found = work(dense)
        rows = table.select(columns).filter(pa.array(own))
        for n in names:
            rows = rows.append_column(n, pa.array(found[n][line[own], sample[own]], from_pandas=True))
        return rows

    return spread.groupBy(*keys, "_tl", "_ts").applyInArrow(run, schema)


# --- Smoothing ----------------------------------------------------------------
def gaussian_blur(pixels: DataFrame, sigma: float, size: int = TILE) -> DataFrame:
    """Separable Gaussian at every place of the frame that a pixel reaches, with weights renormalised at the rim and around gaps.

    Copies of a pixel count as often as they occur; of a null value only the weight counts. A task holds one tile, whatever the product's size.
    """
    radius = int(np.ceil(2 * sigma))
    taps = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2.0 * sigma * sigma))
    p = pixels.select("product_id", F.col("line").cast("long").alias("line"), F.col("sample").cast("long").alias("sample"), F.col("dn").cast("double").alias("dn"))
    # The frame ends at the last line, and at the last sample of the lines that reach into it. Stored, so that its size is known.
    top = stage(p.groupBy(F.col("product_id").alias("_pid")).agg(F.max("line").alias("_top_l"), F.max(F.when(F.col("line") >= -radius, F.col("sample"))).alias("_top_s")))
    p = p.filter((F.col("line") >= -radius) & (F.col("sample") >= -radius))
    j = p.join(top, (p["product_id"] == top["_pid"]) & (top["_top_l"] >= 0) & (top["_top_s"] >= 0)).drop("_pid")

    def tiles(position: str, last: str) -> Column:
        low, high = F.greatest(F.col(position) - radius, F.lit(0)), F.least(F.col(position) + radius, F.col(last))
        return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))

    spread = j.withColumn("_tl", tiles("line", "_top_l")).withColumn("_ts", tiles("sample", "_top_s"))

    def smooth(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sums over windows of lines; a place out of reach is never touched, so NaN does not spread further."""
        n = len(x) - 2 * radius
        return sum(w * x[k:k + n] for k, w in enumerate(weights))

    def run(key, table):
        first = [k.as_py() * size for k in key[-2:]]
        shape = [min(size, table[c][0].as_py() - f + 1) for c, f in zip(("_top_l", "_top_s"), first, strict=True)]
        line, sample = (table[c].to_numpy() - f + radius for c, f in zip(("line", "sample"), first, strict=True))
        full = [n + 2 * radius for n in shape]
        at, known = line * full[1] + sample, table["dn"].is_valid().to_numpy()
        total, weight, have = (np.bincount(at, w, full[0] * full[1]).reshape(full) for w in (pc.fill_null(table["dn"], 0.0).to_numpy(), None, known))
        for _ in range(2):  # along lines, then along samples
            total, weight, have = smooth(total, taps), smooth(weight, taps), smooth(have, np.ones(len(taps)))
            there, known = weight > 0, have > 0
            total = np.divide(total, weight, out=np.zeros(weight.shape), where=known).T
            weight, have = there.T.astype(float), known.T.astype(float)
        a, b = np.nonzero(there.T)
        return pa.table({"product_id": pa.array([key[0].as_py()] * len(a), table["product_id"].type), "line": pa.array(a + first[0]), "sample": pa.array(b + first[1]),
                         "dn": pa.array(total[a, b], mask=~known.T[a, b])})

    kind = pixels.schema["product_id"].dataType.simpleString()
    return spread.groupBy("product_id", "_tl", "_ts").applyInArrow(run, f"product_id {kind}, line long, sample long, dn double")


# --- Gradients ----------------------------------------------------------------
def _central(dense: np.ndarray) -> dict[str, np.ndarray]:
    here = dense[1:-1, 1:-1]

    def diff(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        left, right = ~np.isnan(before), ~np.isnan(after)
        return np.where(left & right, (after - before) / 2.0, np.where(right, after - here, np.where(left, here - before, 0.0)))

    gx, gy = diff(dense[1:-1, :-2], dense[1:-1, 2:]), diff(dense[:-2, 1:-1], dense[2:, 1:-1])
    return {"gx": gx, "gy": gy, "slope": np.sqrt(gx * gx + gy * gy)}


def central_gradients(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """Central differences, one-sided where there is no neighbour, by sample (gx) and by line (gy), and their magnitude."""
    return by_tile(pixels, _central, ["gx", "gy", "slope"], size=size)


def _sobel(dense: np.ndarray) -> dict[str, np.ndarray]:
    smooth, diff = dense[:, :-2] + 2 * dense[:, 1:-1] + dense[:, 2:], dense[:, 2:] - dense[:, :-2]
    return {"gx": diff[:-2] + 2 * diff[1:-1] + diff[2:], "gy": smooth[2:] - smooth[:-2] + 0 * diff[1:-1] + 0 * smooth[1:-1]}


def sobel(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """3x3 Sobel responses where all nine neighbours exist."""
    return by_tile(pixels, _sobel, ["gx", "gy"], size=size).filter("gx is not null and gy is not null")


def mean_direction(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """Mean unit gradient of each product from Sobel responses."""
    mag = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) + F.lit(1e-6)
    return sobel(pixels, size).groupBy("product_id").agg(F.avg(F.col("gx") / mag).alias("mean_gx"), F.avg(F.col("gy") / mag).alias("mean_gy"))


# --- Pyramid ------------------------------------------------------------------
def low_pass(scale: float) -> tuple[float, int]:
    """Deviation and reach of the Gaussian that goes before a reduction; (0, 0) for a small one."""
    if scale <= SMOOTHED_FROM:
        return 0.0, 0
    sigma = scale / 2.0 - 0.2
    return sigma, max(1, int(np.ceil(2 * sigma)))


def axis_weights(first: int, stop: int, length: int, reduced: int, scale: float) -> tuple[int, np.ndarray]:
    """First input place and weights (output, input) of the outputs ``first`` to ``stop`` of an axis.

    An input place is spread by the Gaussian, mirrored at the ends without repeating them, then
    averaged by the part of each place that an output covers.
    """
    sigma, reach = low_pass(scale)
    step = length / reduced
    lo, hi = int(np.floor(first * step)), min(length, int(np.ceil(stop * step)))
    edges = np.arange(first, stop + 1) * step
    places = np.arange(lo, hi)
    cover = np.clip(np.minimum(places + 1, edges[1:, None]) - np.maximum(places, edges[:-1, None]), 0, None)
    taps = np.arange(-reach, reach + 1)
    weight = np.exp(-taps ** 2 / (2 * sigma ** 2)) if reach else np.ones(1)
    weight = weight / weight.sum()
    turn = max(1, 2 * (length - 1))
    source = np.abs((places[:, None] + taps) % turn) if length > 1 else np.zeros((len(places), len(taps)), np.int64)
    source = np.where(source >= length, turn - source, source)
    low, high = int(source.min()), int(source.max())
    blur = np.zeros((len(places), high - low + 1))
    np.add.at(blur, (np.arange(len(places))[:, None], source - low), weight)
    return low, cover @ blur


def reduce_levels(pixels: DataFrame, levels: DataFrame, size: int = TILE) -> DataFrame:
    """Smoothed and area-averaged pixels of each level: product_id, level_index, line, sample, dn.

    ``levels``: product_id, level_index, scale_factor, lines, samples (of the level), full_lines, full_samples. A level of
    scale 1 holds the pixels as they are. Every output is the weighted mean of the pixels that exist; one with none is absent.
    """
    keys = ["product_id", *_bands(pixels)]
    lv = levels.select(F.col("product_id").alias("_pid"), "level_index", F.col("scale_factor").cast("double").alias("_scale"),
                       *[F.col(c).cast("long").alias(f"_{c}") for c in ("lines", "samples", "full_lines", "full_samples")])
    p = pixels.select(*keys, F.col("line").cast("long").alias("line"), F.col("sample").cast("long").alias("sample"), F.col("dn").cast("double").alias("dn"))
    j = p.join(lv, p["product_id"] == lv["_pid"])
    plain = j.filter("_scale = 1").select(*keys, "level_index", "line", "sample", "dn")
    some = F.col("_scale") > SMOOTHED_FROM
    reach = F.when(some, F.greatest(F.ceil(F.col("_scale") - 0.4), F.lit(1))).otherwise(0)

    def tiles(position: str, full: str, out: str) -> Column:
        step = F.col(full) / F.col(out)
        at = lambda x: F.floor(F.floor(x / step) / size)
        last = F.floor((F.col(out) - 1) / size)
        # A place next to an end is mirrored into the outputs there, which its own reach covers.
        low, high = F.greatest(at(F.col(position) - reach), F.lit(0)), F.least(at(F.col(position) + reach + 1), last)
        return F.explode(F.sequence(F.least(low, last).cast("int"), high.cast("int")))

    spread = (j.filter("_scale <> 1").withColumn("_tl", tiles("line", "_full_lines", "_lines")).withColumn("_ts", tiles("sample", "_full_samples", "_samples")))
    schema = ", ".join([f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys] + ["level_index int, line long, sample long, dn double"])
    n_keys = len(keys)

    def run(key, table):
        one = {c: table[c][0].as_py() for c in ("_scale", "_lines", "_samples", "_full_lines", "_full_samples")}
        tile = [k.as_py() for k in key[-2:]]
        bounds = [(t * size, min((t + 1) * size, one[o])) for t, o in zip(tile, ("_lines", "_samples"), strict=True)]
        (l0, wl), (s0, ws) = (axis_weights(*b, one[f], one[o], one["_scale"]) for b, f, o in zip(bounds, ("_full_lines", "_full_samples"), ("_lines", "_samples"), strict=True))
        line, sample, dn = table["line"].to_numpy() - l0, table["sample"].to_numpy() - s0, table["dn"].to_numpy(zero_copy_only=False)
        inside = (line >= 0) & (line < wl.shape[1]) & (sample >= 0) & (sample < ws.shape[1]) & ~np.isnan(dn)
        dense, have = np.zeros((2, wl.shape[1], ws.shape[1]))
        dense[line[inside], sample[inside]], have[line[inside], sample[inside]] = dn[inside], 1.0
        total, weight = wl @ dense @ ws.T, wl @ have @ ws.T
        a, b = np.nonzero(weight > 1e-12)
        fixed = {k: pa.array([v.as_py()] * len(a), v.type) for k, v in zip(keys, key[:n_keys], strict=True)}
        return pa.table(fixed | {"level_index": pa.array(np.full(len(a), key[n_keys].as_py(), np.int32)), "line": pa.array(a + bounds[0][0]),
                                 "sample": pa.array(b + bounds[1][0]), "dn": pa.array(total[a, b] / weight[a, b])})

    reduced = spread.groupBy(*keys, "level_index", "_tl", "_ts").applyInArrow(run, schema)
    return plain.withColumn("level_index", F.col("level_index").cast("int")).unionByName(reduced)


def pyramid(pixels: DataFrame, products: DataFrame, target_gsd: float, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Level table of each product (product_id, gsd_m, lines, samples) and the pixels of all its levels."""
    from craterline.operators.raster import pyramid_levels
    full = products.select(F.col("product_id").alias("_p"), F.col("lines").alias("full_lines"), F.col("samples").alias("full_samples"))
    levels = pyramid_levels(products, target_gsd)
    sized = levels.join(full, levels["product_id"] == full["_p"]).drop("_p")
    return levels, reduce_levels(pixels, sized, size)
