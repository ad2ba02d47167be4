"""Match tables: descriptor neighbours, residuals, spread, and planar transforms by voting.

Python runs only where the arithmetic is matrix work (neighbour distances, minimal-sample
solutions, hulls). Its input is always a block of bounded size that Spark has formed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline.functions import geo
from craterline.functions.common import clip
from craterline.functions.stage import stage
from craterline.functions.stats import exact_percentiles

#: Rows of a block.
BLOCK = 4096
#: Matches of a pair from which minimal samples are drawn.
POOL = 2000


def _packed(df: DataFrame, group: list[str], unique: list[str], item: Column, block: int) -> DataFrame:
    """Rows of each group packed in blocks of about ``block`` rows, whatever the group's size.

    Blocks are few bytes and long work, so their partitions are not put together by size.
    """
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = df.groupBy(*group).agg(F.count("*").alias("_n"))
    # Written first: a row for each group is often known to be little, and then the rows are not shuffled for it.
    n = stage(n.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.ceil(F.col("_n") / block).alias("_blocks")))
    cond = [df[g] == n[f"_g{i}"] for i, g in enumerate(group)]
    b = df.join(n, cond).withColumn("_block", F.pmod(F.xxhash64(*unique), F.col("_blocks")))
    return b.repartition(parts, *group, "_block").groupBy(*group, "_block").agg(F.collect_list(item).alias("items"), F.max("_blocks").alias("_blocks"))


def match_confidence(matches: DataFrame, pairs: DataFrame | None = None, metric: str = "l2") -> DataFrame:
    """Visual confidence of a pair from its mean match distance; zero for pairs without matches."""
    d = F.avg("distance")
    score = F.lit(1.0) / (F.lit(1.0) + d / F.lit(150.0)) if metric == "l2" else F.lit(1.0) - d / F.lit(64.0)
    c = matches.groupBy("pair_id").agg(F.count("*").alias("matches"), clip(score, 0.0, 1.0).alias("confidence"))
    if pairs is None:
        return c
    return pairs.select("pair_id").join(c, "pair_id", "left").select(
        "pair_id", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


# --- Residuals ----------------------------------------------------------------
def with_residuals(matches: DataFrame, transforms: DataFrame, guarded: bool = True) -> DataFrame:
    """Matches with the transform of their pair applied: residual in pixels and homogeneous weight."""
    t = transforms.select(F.col("pair_id").alias("_p"), "h")
    j = matches.join(t, matches["pair_id"] == t["_p"]).drop("_p")
    x, y, w = geo.project(F.col("h"), F.col("src_x"), F.col("src_y"), guarded)
    return j.withColumns({"residual": F.hypot(x - F.col("tgt_x"), y - F.col("tgt_y")), "w": w}).drop("h")


def inlier_statistics(residuals: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Inlier count, ratio, mean, median, 95th percentile and rms per pair.

    Rows carry ``is_inlier``, or are inliers up to ``threshold``.
    """
    flag = F.col("is_inlier") if "is_inlier" in residuals.columns else F.col("residual") <= threshold
    r = residuals.withColumn("_in", flag)
    e = F.when(F.col("_in"), F.col("residual"))
    one = r.groupBy("pair_id").agg(
        F.count("*").alias("matches"), F.count_if("_in").alias("inliers"), (F.count_if("_in") / F.count("*")).alias("inlier_ratio"),
        F.avg(e).alias("mean_error_px"), F.sqrt(F.avg(e * e)).alias("rmse_px"),
        F.coalesce(F.bool_or(F.col("_in") & (F.abs("w") < 0.1)), F.lit(False)).alias("weight_collapse") if "w" in r.columns
        else F.lit(False).alias("weight_collapse"))
    pct = exact_percentiles(r.filter("_in"), ["pair_id"], "residual", {"median_error_px": 0.5, "p95_error_px": 0.95})
    return one.join(pct, "pair_id", "left")


def score_against_truth(residuals: DataFrame, keys: list[str], tolerance: float = 3.5, cap: int | Column = 100) -> DataFrame:
    """Precision, recall and F1 against a known transform, with error quantiles of the true matches.

    Missed matches are max(0, cap - true). Without any true match the quantiles cover all matches.
    """
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    good = F.col("residual") <= tolerance
    one = residuals.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if(good).alias("tp"))
    one = one.withColumns({"fp": F.col("candidates") - F.col("tp"), "fn": F.greatest(cap - F.col("tp"), F.lit(0)).cast("bigint")})
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    one = one.withColumns({"precision": ratio(F.col("tp"), F.col("candidates")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    one = one.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    flagged = residuals.withColumn("_good", good)
    none_good = one.filter("tp = 0").select(*keys)
    fallback = flagged.join(none_good, keys, "left_semi")
    usable = flagged.filter("_good").unionByName(fallback)
    return one.join(exact_percentiles(usable, keys, "residual", {"median_error": 0.5, "p95_error": 0.95}), keys, "left")


# --- Spread -------------------------------------------------------------------
def grid_entropy(points: DataFrame, width: float, height: float, x: str = "src_x", y: str = "src_y") -> DataFrame:
    """Entropy of a 4x4 occupancy grid over its maximum of four bits, per pair. Two-level aggregation."""
    cell = lambda c, side: F.least(F.greatest(F.floor(F.col(c) / F.lit(side / 4.0)), F.lit(0)), F.lit(3)).cast("int")
    n = points.groupBy("pair_id", cell(x, width).alias("cx"), cell(y, height).alias("cy")).agg(F.count("*").alias("n"))
    # At most sixteen cells per pair.
    g = n.groupBy("pair_id").agg(F.sum("n").alias("points"), F.collect_list("n").alias("c"))
    part = lambda k: (k / F.col("points")) * F.log2(k / F.col("points"))
    total = F.aggregate(F.array_sort("c"), F.lit(0.0), lambda acc, k: acc + part(k))
    return g.select("pair_id", "points", clip(-total / F.lit(4.0), 0.0, 1.0).alias("spatial_entropy"))


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points sorted by x, then y."""
    xy = np.unique(xy, axis=0)
    if len(xy) <= 2:
        return xy
    if len(xy) > 64:
        # Only points on or outside the polygon of the extremes in 32 directions can be corners.
        angle = np.arange(32) * (2 * np.pi / 32)
        poly = xy[np.unique(np.argmax(xy @ np.vstack([np.cos(angle), np.sin(angle)]), axis=0))]
        centre = poly.mean(0)
        poly = poly[np.argsort(np.arctan2(poly[:, 1] - centre[1], poly[:, 0] - centre[0]))]
        a, b = poly, np.roll(poly, -1, axis=0)
        side = ((b[:, 0] - a[:, 0])[None] * (xy[:, 1][:, None] - a[:, 1][None])
                - (b[:, 1] - a[:, 1])[None] * (xy[:, 0][:, None] - a[:, 0][None]))
        xy = xy[(side <= 0).any(1)]

    def half(points) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    pts = [tuple(p) for p in xy]
    return np.asarray(half(pts) + half(reversed(pts)))


def _area(xy: np.ndarray) -> float:
    if len(xy) < 3:
        return 0.0
    x, y = xy[:, 0], xy[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2.0)


OCTANTS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def _outer_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Points of each key that do not lie strictly inside the octagon of its extremes."""
    xy = F.struct("x", "y")
    far = rows.groupBy(*keys).agg(*[F.max_by(xy, F.col("x") * dx + F.col("y") * dy).alias(f"_o{i}") for i, (dx, dy) in enumerate(OCTANTS)])
    here, there = ([F.col(f"_o{j % 8}") for j in range(n, n + 8)] for n in (0, 1))
    # Sides as plain numbers that are never null: with structs the test grows beyond what the JVM compiles.
    sides = [[a["x"], a["y"], b["x"] - a["x"], b["y"] - a["y"], F.when((a["x"] == b["x"]) & (a["y"] == b["y"]), 1.0).otherwise(0.0)] for a, b in zip(here, there, strict=True)]
    # A side without length shuts no point out; without width nothing is inside.
    sides[0][4] = F.when(F.col("_o0.x") > F.col("_o4.x"), sides[0][4]).otherwise(float("-inf"))
    far = far.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.coalesce(c, F.lit(0.0)).alias(f"_s{i}{n}") for i, side in enumerate(sides) for n, c in enumerate(side)])
    j = rows.join(far, [rows[k] == far[f"_k{i}"] for i, k in enumerate(keys)])
    x, y = F.col("x"), F.col("y")
    left = [F.col(f"_s{i}2") * (y - F.col(f"_s{i}1")) - F.col(f"_s{i}3") * (x - F.col(f"_s{i}0")) + F.col(f"_s{i}4") for i in range(8)]
    return j.filter(~(F.least(*left) > 0)).select(*keys, "x", "y")


def hull_areas(points: DataFrame, keys: list[str], x: str, y: str, block: int = 50_000) -> DataFrame:
    """Convex hull area per key.

    Copies, then points strictly inside the octagon of a key's extremes are dropped by built-in expressions,
    which leaves few. The rest is cut in blocks of bounded size; the hull of a union is the hull
    of the partial hulls, so about the square root of a key's blocks are merged at a time, and the
    merged hulls meet in the end. What one task holds grows with that root and with the hull's own corners.
    """
    rows = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    # Copies go before anything is sorted or joined; both tables are read twice.
    rows = stage(rows.distinct())
    packs = _packed(stage(_outer_points(rows, keys)), keys, ["x", "y"], F.array("x", "y"), block)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["flat"] = [_hull(np.asarray(f).reshape(-1, 2)).ravel() for f in pdf["flat"]]
            yield pdf

    def area(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["hull_area"] = [_area(_hull(np.asarray(f).reshape(-1, 2))) for f in pdf["flat"]]
            yield pdf[[*keys, "hull_area"]]

    merged = F.pmod("_block", F.ceil(F.sqrt("_blocks"))).cast("long").alias("_merged")
    part = packs.select(*keys, merged, F.flatten("items").alias("flat"))
    for over in ([*keys, "_merged"], keys):
        part = part.mapInPandas(corners, f"{kinds}, _merged long, flat array<double>")
        part = part.groupBy(*over).agg(F.flatten(F.collect_list("flat")).alias("flat"))
    return part.mapInPandas(area, f"{kinds}, hull_area double")


def hull_ratio(points: DataFrame, width: float, height: float) -> DataFrame:
    """Hull share of the frame per pair, averaged over the source and the target points."""
    sides = points.select("pair_id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("src_x").alias("x"), F.col("src_y").alias("y")),
        F.struct(F.lit(1).alias("side"), F.col("tgt_x").alias("x"), F.col("tgt_y").alias("y")))).alias("p")).select("pair_id", "p.*")
    areas = hull_areas(sides, ["pair_id", "side"], "x", "y").withColumn("r", clip(F.col("hull_area") / F.lit(float(width * height)), 0.0, 1.0))
    return areas.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("r"))).alias("src_hull_ratio"),
        F.max(F.when(F.col("side") == 1, F.col("r"))).alias("tgt_hull_ratio")).withColumn(
        "hull_ratio", (F.col("src_hull_ratio") + F.col("tgt_hull_ratio")) / 2.0)


# --- Planar transform by voting ----------------------------------------------
def _four_point(src: np.ndarray, tgt: np.ndarray) -> np.ndarray:
    """Transforms through four point pairs each; degenerate samples are left out."""
    def areas(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Twice the areas of the triangles in which the fourth point stands for one of the others."""
        return [(x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a]) for a, b, c in ((3, 1, 2), (0, 3, 2), (0, 1, 3))]

    x, y, u, v = src[..., 0].T, src[..., 1].T, tgt[..., 0].T, tgt[..., 1].T
    d, e = areas(x, y), areas(u, v)
    # The closed form through two projective bases; its last entry is the determinant of the linear system, but for the sign.
    h = np.zeros((9, len(src)))
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        w = e[i] * d[j] * d[k]
        for c, part in enumerate((w * (y[j] - y[k]), w * (x[k] - x[j]), w * (x[j] * y[k] - x[k] * y[j]))):
            h[c] += u[i] * part
            h[3 + c] += v[i] * part
            h[6 + c] += part
    ok = np.abs(h[8]) > 1e-9
    return (h[:, ok] / h[8, ok]).T


def _frame(p: np.ndarray) -> np.ndarray:
    """Centre and spread that bring points to about unit size."""
    c = p.mean(0)
    s = max(float(np.abs(p - c).max()), 1e-9)
    return np.array([c[0], c[1], s])


def _to_image(h: np.ndarray, fs: np.ndarray, ft: np.ndarray) -> np.ndarray:
    """Transform between centred frames expressed in image coordinates, scaled to h33 = 1."""
    n = np.array([[1 / fs[2], 0, -fs[0] / fs[2]], [0, 1 / fs[2], -fs[1] / fs[2]], [0, 0, 1.0]])
    d = np.array([[ft[2], 0, ft[0]], [0, ft[2], ft[1]], [0, 0, 1.0]])
    m = d @ h.reshape(-1, 3, 3) @ n
    last = m[:, 2, 2]
    m = m / np.where(np.abs(last) > 1e-12, last, 1.0)[:, None, None]
    return m.reshape(-1, 9)


def _samples(rng: np.random.RandomState, n: int, count: int) -> np.ndarray:
    """``count`` samples of four different numbers below n, all equally likely."""
    drawn, taken = [], []
    for k in range(4):
        x = rng.randint(0, n - k, count)
        for t in taken:  # step over the numbers that are taken, the smallest first
            x = x + (x >= t)
        drawn.append(x)
        larger = []
        for t in taken:
            larger.append(np.minimum(x, t))
            x = np.maximum(x, t)
        taken = [*larger, x]
    return np.column_stack(drawn)


def _fitting(h: np.ndarray, p: np.ndarray, threshold: float, keep: int) -> np.ndarray:
    """The transforms under which most of the matches p (x, y, u, v) agree, in their old order."""
    return _best_fitting([h], p, threshold, keep)


def _best_fitting(parts: Iterable[np.ndarray], p: np.ndarray, threshold: float, keep: int) -> np.ndarray:
    """``_fitting`` of all parts together.

    Where ``keep`` of the first ones have the votes of all matches, none that follows could take a place, since equals stand in their
    old order: the rest is neither scored nor asked for.
    """
    found, votes, full = [], [], 0
    for h in parts:
        for part, own in _voted(h, p, threshold):
            found.append(part)
            votes.append(own)
            full += np.count_nonzero(own == len(p))
            if full >= keep:
                break
        if full >= keep:
            break
    if not found:
        return np.zeros((0, 9))
    h = np.concatenate(found)
    return h[np.sort(np.argsort(-np.concatenate(votes), kind="stable")[:keep])]


def _voted(h: np.ndarray, p: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of the transforms with the number of matches that agree with each."""
    x, y, u, v = np.ascontiguousarray(p.T)
    grid = np.vstack([x, y, np.ones(len(p))])
    # Squares on both sides, times the weight: no division and no root; each difference is one product.
    to_x, to_y = np.vstack([grid, -u * grid]), np.vstack([grid, -v * grid])
    hx, hy, hw = np.ascontiguousarray(h[:, [0, 1, 2, 6, 7, 8]]), np.ascontiguousarray(h[:, 3:]), np.ascontiguousarray(h[:, 6:])
    step = 128  # small enough for a processor's own memory
    room = np.empty((2, min(step, len(h)), len(p)))
    for at in range(0, len(h), step):
        part = slice(at, at + step)
        a, b = room[:, :len(h) - at]
        np.matmul(hx[part], to_x, out=a)
        np.multiply(a, a, out=a)
        np.matmul(hy[part], to_y, out=b)
        np.multiply(b, b, out=b)
        a += b
        np.matmul(hw[part], grid, out=b)
        flat = np.abs(b) <= 1e-12
        if flat.any():
            # Beside the pole the weight is held away from zero, in the differences too.
            w = np.where(flat, 1e-12, b)
            a = (hx[part, :3] @ grid - w * u) ** 2 + (hy[part, :3] @ grid - w * v) ** 2
            b[flat] = 1e-12
        b *= threshold
        np.multiply(b, b, out=b)
        yield h[part], np.count_nonzero(a <= b, axis=1)


def fit_transforms(matches: DataFrame, threshold: float = 3.5, samples: int = 8000, hypotheses: int = 200, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Best planar transform of each pair with at least four matches: pair_id, h, best_h, matches, inliers.

    A pair with fewer than four different matches, or only degenerate samples, has no row.

    Equal matches are counted once with their number, so copies never pile up in one block.

    1. A pool of matches per pair is drawn by hash order; minimal samples of four come from it. Of 8000 samples
       at least one is free of outliers with probability .9999 if 18 % of the matches are inliers. The
       samples' transforms that fit most of 256 matches of the pool become hypotheses.
    2. Every hypothesis is scored on *all* matches of the pair, block by block, and the votes are
       summed map-side. The best has most inliers, then least error, then lowest number.
    3. The inliers of the best hypothesis give the least-squares transform, from sums of moments.
    """
    m = (matches.groupBy("pair_id", *[F.col(c).cast("double").alias(c) for c in ("src_x", "src_y", "tgt_x", "tgt_y")])
         # A number for the draw and the blocks instead of a text that every shuffle would carry.
         .agg(F.coalesce(F.min(F.when(F.col("match_id").isNotNull(), F.xxhash64(F.lit(seed), "match_id"))), F.xxhash64(F.lit(seed))).alias("order"), F.count("*").alias("copies")))
    m = stage(m)  # read by the draw, the votes and the refit
    kind = m.schema["pair_id"].dataType.simpleString()
    counts = stage(m.groupBy("pair_id").agg(F.sum("copies").alias("matches"), F.count("*").alias("_places")).filter("matches >= 4"))
    sized = counts.select(F.col("pair_id").alias("_p"), "_places")
    counts = counts.drop("_places")
    pool_size = POOL
    order = F.col("order")
    # Uniform share in [0, 1): keeps about twice the pool, so that no pair is gathered whole.
    share = F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = m.join(sized, m["pair_id"] == sized["_p"]).filter(share < F.lit(2.0 * pool_size) / F.col("_places"))
    pool = drawn.groupBy("pair_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(
        "order", "src_x", "src_y", "tgt_x", "tgt_y"))), 1, pool_size).alias("pool"))
    flat = F.flatten(F.transform("pool", lambda p: F.array(p["src_x"], p["src_y"], p["tgt_x"], p["tgt_y"])))
    # The pool is small in bytes and long in work, so it is dealt out to all cores.
    pool = pool.select("pair_id", flat.alias("flat")).repartition(m.sparkSession.sparkContext.defaultParallelism, "pair_id")

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                p = np.asarray(row.flat).reshape(-1, 4)
                if len(p) < 4:
                    continue
                fs, ft = _frame(p[:, :2]), _frame(p[:, 2:])
                s, t = (p[:, :2] - fs[:2]) / fs[2], (p[:, 2:] - ft[:2]) / ft[2]
                rng = np.random.RandomState(zlib.crc32(f"{row.pair_id}|{seed}".encode()) & 0x7FFFFFFF)

                def solved():
                    for at in range(0, samples, 2000):
                        pick = _samples(rng, len(p), min(2000, samples - at))
                        h = _to_image(_four_point(s[pick], t[pick]), fs, ft)
                        yield h[np.isfinite(h).all(1)]

                h = _best_fitting(solved(), p[:256], threshold, hypotheses)
                if len(h):
                    out.append((row.pair_id, h.ravel().tolist(), [*fs, *ft]))
            yield pd.DataFrame(out, columns=["pair_id", "hyps", "frame"])

    # The longest step, read by the votes and by the choice.
    proposals = stage(pool.mapInPandas(propose, f"pair_id {kind}, hyps array<double>, frame array<double>"))
    packs = _packed(m, ["pair_id"], ["order"], F.array("src_x", "src_y", "tgt_x", "tgt_y", F.col("copies").cast("double")), block)
    jobs = packs.select("pair_id", F.flatten("items").alias("flat")).join(proposals.select("pair_id", "hyps"), "pair_id")

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                p, h = np.asarray(row.flat).reshape(-1, 5), np.asarray(row.hyps).reshape(-1, 9)
                x, y, u, v, copies = np.ascontiguousarray(p.T)
                grid = np.vstack([x, y, np.ones(len(p))])
                w = h[:, 6:] @ grid
                w[np.abs(w) <= 1e-12] = 1e-12
                a, b = h[:, :3] @ grid / w - u, h[:, 3:6] @ grid / w - v
                e = np.sqrt(a * a + b * b)
                hit = np.where(e <= threshold, copies, 0.0)
                out.append((row.pair_id, hit.sum(1).astype("int64").tolist(), (hit * e).sum(1).tolist()))
            yield pd.DataFrame(out, columns=["pair_id", "votes", "errors"])

    votes = jobs.mapInPandas(vote, f"pair_id {kind}, votes array<long>, errors array<double>")
    per_h = (votes.select("pair_id", F.posexplode(F.arrays_zip("votes", "errors")).alias("k", "v"))
                  .groupBy("pair_id", "k").agg(F.sum("v.votes").alias("inliers"), F.sum("v.errors").alias("err")))
    best = per_h.groupBy("pair_id").agg(F.max(F.struct("inliers", (-F.round("err", 6)).alias("e"), (-F.col("k")).alias("nk"))).alias("b"))
    chosen = stage(best.join(proposals, "pair_id").select(
        "pair_id", F.col("b.inliers").alias("inliers"), F.slice("hyps", (-F.col("b.nk")) * 9 + 1, 9).alias("best_h"), "frame"))
    moments = _moments(m, chosen, threshold)

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                f = np.asarray(row.frame)
                sums = np.asarray(row.sums)
                h = _to_image(_smallest(sums), f[:3], f[3:])[0] if np.isfinite(sums).all() else np.full(9, np.nan)
                out.append((row.pair_id, h.tolist() if np.isfinite(h).all() else list(row.best_h)))
            yield pd.DataFrame(out, columns=["pair_id", "h"])

    solved = moments.mapInPandas(refit, f"pair_id {kind}, h array<double>")
    return chosen.join(solved, "pair_id").join(counts, "pair_id").select("pair_id", "h", "best_h", "matches", "inliers")


def _moments(m: DataFrame, chosen: DataFrame, threshold: float) -> DataFrame:
    """Sums of the monomials of the inliers from which the normal equations are built (24 numbers per pair)."""
    c = chosen.select(F.col("pair_id").alias("_p"), "best_h", "frame")
    j = m.join(c, m["pair_id"] == c["_p"])
    px, py, _ = geo.project(F.col("best_h"), F.col("src_x"), F.col("src_y"), guarded=False)
    j = j.filter(F.hypot(px - F.col("tgt_x"), py - F.col("tgt_y")) <= threshold)
    f = [F.element_at("frame", i + 1) for i in range(6)]
    x, y = (F.col("src_x") - f[0]) / f[2], (F.col("src_y") - f[1]) / f[2]
    u, v = (F.col("tgt_x") - f[3]) / f[5], (F.col("tgt_y") - f[4]) / f[5]
    j = j.select("pair_id", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"), "copies")
    x, y, u, v = (F.col(n) for n in "xyuv")
    base = [x * x, x * y, x, y * y, y, F.lit(1.0)]
    sums = [F.sum(b * w * F.col("copies")) for w in (F.lit(1.0), u, v, u * u + v * v) for b in base]
    return j.groupBy("pair_id").agg(F.array(*sums).alias("sums")).join(chosen.select("pair_id", "best_h", "frame"), "pair_id")


def _smallest(sums: np.ndarray) -> np.ndarray:
    """Null direction of the normal matrix of the direct linear transform."""
    def block(s: np.ndarray) -> np.ndarray:
        xx, xy, x, yy, y, n = s
        return np.array([[xx, xy, x], [xy, yy, y], [x, y, n]])

    m1, mu, mv, mq = (block(sums[i * 6:i * 6 + 6]) for i in range(4))
    a = np.zeros((9, 9))
    a[:3, :3] = a[3:6, 3:6] = m1
    a[:3, 6:] = -mu
    a[3:6, 6:] = -mv
    a[6:, :3], a[6:, 3:6], a[6:, 6:] = -mu.T, -mv.T, mq
    return np.linalg.eigh(a)[1][:, 0]


def flag_inliers(matches: DataFrame, fits: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Matches of fitted pairs with ``is_inlier`` under the best hypothesis and the residual under the refit."""
    f = fits.select(F.col("pair_id").alias("_p"), "h", "best_h")
    j = matches.join(f, matches["pair_id"] == f["_p"]).drop("_p")
    bx, by, _ = geo.project(F.col("best_h"), F.col("src_x"), F.col("src_y"), guarded=False)
    x, y, w = geo.project(F.col("h"), F.col("src_x"), F.col("src_y"))
    return j.withColumns({
        "is_inlier": F.hypot(bx - F.col("tgt_x"), by - F.col("tgt_y")) <= threshold,
        "residual": F.hypot(x - F.col("tgt_x"), y - F.col("tgt_y")), "w": w}).drop("h", "best_h")
