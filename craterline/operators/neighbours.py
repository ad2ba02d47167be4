"""Descriptor neighbours with the ratio test: exact in blocks that norms rule out, or proposed by hash tables.

Exact: descriptors of an image are cut into blocks along their norm (bits set, for binary ones). Two
descriptors are at least as far apart as their norms, so a target block whose norms are further
from a source block's than the second-best distance found so far can hold no neighbour. The blocks closest
by norm are compared first and give that distance; only blocks it does not rule out follow. What
travels to every pair of blocks is their range of norms, not their descriptors. An image of many blocks gets
larger ones, so that its descriptors travel to few of them; a block pair is compared in strips of bounded size.

Hashed: random hyperplanes through the mean (random bits, for binary descriptors) make a key in each
of several tables; a source descriptor also looks under the keys with its least certain bits turned. Source
descriptors whose two best candidates pass the ratio test are then compared exactly, so nothing is
reported that the exact comparison would not report; what hashing can lose is a match, and
``recall`` measures how many.

A table that holds a crowd under one key is cut into blocks as well. Images with fewer than four
descriptors have no matches. Ties go to the smaller keypoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craterline.functions.stage import stage

BLOCK = 4096
#: An image has about so many blocks at most, until they hold LARGEST descriptors.
BLOCKS, LARGEST = 16, 16_384
#: Distances that are held at a time.
CELLS = 4_000_000
_COLUMNS = ("src_kp", "tgt_kp", "distance")


def _norm(metric: str) -> Column:
    if metric == "hamming":
        return F.aggregate("vec", F.lit(0), lambda a, w: a + F.bit_count(w)).cast("double")
    return F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))


def _typed(descriptors: DataFrame, metric: str) -> DataFrame:
    kind = "array<long>" if metric == "hamming" else "array<double>"
    return descriptors.select("image_id", F.col("kp_id").cast("long").alias("kp_id"), F.col("vec").cast(kind).alias("vec"))


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group with its keypoints, its descriptors in one array and its range of norms."""
    item = F.collect_list(F.struct("kp_id", "vec")).alias("items")
    return rows.groupBy(*keys).agg(item, F.min("norm").alias("low"), F.max("norm").alias("high")).select(
        *keys, "low", "high", F.transform("items", lambda i: i["kp_id"]).alias("kps"), F.flatten(F.transform("items", lambda i: i["vec"])).alias("flat"))


def image_sizes(descriptors: DataFrame) -> DataFrame:
    """Descriptors of each image: image_id, n."""
    return descriptors.groupBy("image_id").agg(F.count("*").alias("n")).filter("image_id is not null")


def norm_blocks(descriptors: DataFrame, metric: str = "l2", block: int = BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """Descriptors (image_id, kp_id, vec) in blocks of ``block`` at least: image_id, block, low, high, kps, flat.

    Images of ``block`` descriptors or fewer are one block. Borders are quantiles of the norm; a stretch of equal norms that is
    too long for a block is cut by a hash. ``sizes`` are those of ``image_sizes``, if they are kept already.
    """
    d = _typed(descriptors, metric).filter("image_id is not null").withColumn("norm", _norm(metric))
    if metric != "hamming" and descriptors.schema["vec"].dataType.elementType.typeName() == "float":
        d = d.withColumn("vec", F.col("vec").cast("array<float>"))  # as they came; they are compared as doubles
    large = stage((image_sizes(descriptors) if sizes is None else sizes).filter(F.col("n") > block))
    one = lambda rows: _packed(rows.withColumn("block", F.struct(F.lit(0).alias("stretch"), F.lit(0).cast("long").alias("part"))), ["image_id", "block"])
    if large.isEmpty():
        return one(d)
    size = F.greatest(F.lit(block), F.least(F.ceil(F.col("n") / BLOCKS), F.lit(LARGEST))).alias("_size")
    large = large.select(F.col("image_id").alias("_im"), "n", size)
    few = one(d.join(large, d["image_id"] == large["_im"], "left_anti"))
    d = d.join(large.select("_im"), d["image_id"] == large["_im"], "left_semi")
    steps = 64  # quantiles an image has at most; longer stretches are cut by hash
    cuts = F.array(*[F.lit(k / steps) for k in range(1, steps)])
    every = F.greatest(F.lit(1), F.floor(F.lit(steps) * F.col("_size") / F.col("n")))
    borders = d.groupBy("image_id").agg(F.percentile_approx("norm", cuts, F.lit(1000)).alias("_cuts")).join(large, F.col("image_id") == F.col("_im"))
    borders = stage(borders.select("_im", "_size", F.array_distinct(F.filter("_cuts", lambda c, i: (i + 1) % every == 0)).alias("_cuts")))
    d = d.join(borders, d["image_id"] == borders["_im"]).withColumn("stretch", F.size(F.filter("_cuts", lambda c: c < F.col("norm")))).drop("_cuts", "_im")
    crowd = d.groupBy("image_id", "stretch").agg(F.ceil(F.count("*") / F.first("_size")).alias("_parts"))
    crowd = crowd.select(F.col("image_id").alias("_im"), F.col("stretch").alias("_st"), "_parts")
    d = d.join(crowd, (d["image_id"] == crowd["_im"]) & (d["stretch"] == crowd["_st"]))
    part = F.pmod(F.xxhash64("image_id", "kp_id"), F.col("_parts"))
    return few.unionByName(_packed(d.withColumn("block", F.struct("stretch", part.alias("part"))), ["image_id", "block"]))


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which words differ, in the smallest type that holds one more than all of them."""
    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))  # signed words would count the bits of their magnitude
    total = np.zeros((len(a), len(b)), dtype=np.uint8 if a.shape[1] < 4 else np.uint16 if a.shape[1] < 1024 else np.uint32)
    for w in range(a.shape[1]):
        total += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return total


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    products = a @ b.T
    products *= 2.0
    squares -= products
    return np.maximum(squares, 0.0, out=squares)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    return _bits(a, b).astype(np.float64) if metric == "hamming" else np.sqrt(_squares(a, b))


def two_nearest(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in b of the two nearest (one, if b has no more) of each row of a, the earlier of equals first, and their distances."""
    between, beyond = (_bits, None) if metric == "hamming" else (_squares, np.inf)
    step, keep, places, found = max(1, CELLS // max(1, len(b))), min(2, len(b)), [], []
    for at in range(0, len(a), step):
        dist = between(a[at:at + step], b)
        rows = np.arange(len(dist))
        for k in range(keep):
            place = dist.argmin(axis=1)
            places.append(place)
            found.append(dist[rows, place].astype(np.float64))
            if k + 1 < keep:
                dist[rows, place] = np.iinfo(dist.dtype).max if beyond is None else beyond
    columns = lambda x: np.column_stack([np.concatenate(x[k::keep]) for k in range(keep)])
    return columns(places), columns(found) if metric == "hamming" else np.sqrt(columns(found))


def _two_nearest(blocks: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """The two nearest targets of each source keypoint within its row (s_kps, s_flat, t_kps, t_flat)."""
    schema = ", ".join([f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys] + ["src_kps array<long>, tgt_kps array<long>, distances array<double>"])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.to_dict("records"):
                a, b = (np.asarray(row[f"{s}_flat"], dtype=np.int64 if metric == "hamming" else np.float64).reshape(len(row[f"{s}_kps"]), -1) for s in "st")
                kps = np.asarray(row["t_kps"])
                by_kp = np.argsort(kps, kind="stable")
                # The earliest of equal minima is the smaller keypoint.
                order, held = two_nearest(a, b[by_kp], metric)
                found.append((*[row[k] for k in keys], np.repeat(np.asarray(row["s_kps"]), order.shape[1]), kps[by_kp][order].ravel(), held.ravel()))
            yield pd.DataFrame(found, columns=[*keys, "src_kps", "tgt_kps", "distances"])

    # One row for a pair of blocks leaves Python; its keypoints are told apart afterwards.
    rows = blocks.select(*keys, "s_kps", "s_flat", "t_kps", "t_flat").mapInPandas(nearest, schema)
    one = F.explode(F.arrays_zip("src_kps", "tgt_kps", "distances")).alias("_o")
    return rows.select(*keys, one).select(*keys, F.col("_o.src_kps").alias("src_kp"), F.col("_o.tgt_kps").alias("tgt_kp"), F.col("_o.distances").alias("distance"))


def _usable(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    enough = sizes.filter("n >= 4").select(F.col("image_id").alias("_im"))
    return (pairs.join(enough.withColumnRenamed("_im", "_a"), F.col("source_id") == F.col("_a"), "left_semi")
                 .join(enough.withColumnRenamed("_im", "_b"), F.col("target_id") == F.col("_b"), "left_semi"))


def _best_two(near: DataFrame, ratio: float) -> DataFrame:
    """Reduce the candidates of each source keypoint, at most two from a block, to matches."""
    best = near.groupBy("pair_id", "src_kp").agg(F.array_sort(F.collect_set(F.struct("distance", "tgt_kp"))).alias("c")).filter(F.size("c") >= 2)
    first, second = F.element_at("c", 1), F.element_at("c", 2)
    return best.filter(first["distance"] < F.lit(ratio) * second["distance"]).select(
        "pair_id", "src_kp", first["tgt_kp"].alias("tgt_kp"), first["distance"].alias("distance"), second["distance"].alias("second_distance"))


def _exact(sources: DataFrame, targets: DataFrame, pairs: DataFrame, ratio: float, metric: str) -> DataFrame:
    """Matches between blocks of source descriptors, of their own (``pair_id``) or of all pairs, and of target ones."""
    own = "pair_id" in sources.columns
    s = sources.select(*([F.col("pair_id").alias("_pair")] if own else []), F.col("image_id").alias("_s"), F.col("block").alias("s_block"),
                       F.col("low").alias("s_low"), F.col("high").alias("s_high"))
    t = targets.select(F.col("image_id").alias("_t"), F.col("block").alias("t_block"), F.col("low").alias("t_low"), F.col("high").alias("t_high"))
    of_pair = (F.col("source_id") == F.col("_s")) & (F.col("pair_id") == F.col("_pair")) if own else F.col("source_id") == F.col("_s")
    gap = F.greatest(F.lit(0.0), F.col("t_low") - F.col("s_high"), F.col("s_low") - F.col("t_high"))
    # A row for each pair of blocks, without descriptors.
    met = (pairs.join(s, of_pair).join(t, F.col("target_id") == F.col("_t")).select("pair_id", "source_id", "target_id", "s_block", "t_block", gap.alias("gap")))
    by_gap = Window.partitionBy("pair_id", "s_block").orderBy("gap", "t_block")
    met = stage(met.withColumn("turn", F.row_number().over(by_gap)))

    def compared(chosen: DataFrame) -> DataFrame:
        left = sources.select(*([F.col("pair_id").alias("_pair")] if own else []), F.col("image_id").alias("_s"), F.col("block").alias("_sb"),
                              F.col("kps").alias("s_kps"), F.col("flat").alias("s_flat"))
        right = targets.select(F.col("image_id").alias("_t"), F.col("block").alias("_tb"), F.col("kps").alias("t_kps"), F.col("flat").alias("t_flat"))
        at = (F.col("source_id") == F.col("_s")) & (F.col("s_block") == F.col("_sb"))
        if own:
            at &= F.col("pair_id") == F.col("_pair")
        # Binary descriptors are few bytes and long work, so their partitions are not put together by size.
        spark = chosen.sparkSession
        parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        both = chosen.join(left, at).repartition(parts, "target_id", "t_block").join(right, (F.col("target_id") == F.col("_t")) & (F.col("t_block") == F.col("_tb")))
        return _two_nearest(both, ["pair_id", "s_block"], metric)

    if met.filter("turn > 2").isEmpty():
        return _best_two(compared(met).drop("s_block"), ratio)
    near = stage(compared(met.filter("turn <= 2")))
    seconds = near.groupBy("pair_id", "s_block", "src_kp").agg(F.sort_array(F.collect_list("distance")).alias("d"))
    reach = seconds.groupBy("pair_id", "s_block").agg(F.max(F.coalesce(F.get("d", F.lit(1)), F.lit(float("inf")))).alias("reach"))
    # A little more than the distance, for rounding in norms and products.
    rest = met.filter("turn > 2").join(reach, ["pair_id", "s_block"]).filter(F.col("gap") <= F.col("reach") * (1 + 1e-9) + 1e-6)
    return _best_two(near.drop("s_block").unionByName(compared(rest).drop("s_block")), ratio)


def match_descriptors(descriptors: DataFrame, pairs: DataFrame, ratio: float = 0.80, metric: str = "l2", block: int = BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """Ratio-tested nearest neighbours of each source keypoint (image_id, kp_id, vec) per named pair, exact for any size.

    ``vec`` is a vector of numbers for ``l2`` or of 64-bit words for ``hamming``.
    """
    sizes = stage(image_sizes(descriptors)) if sizes is None else sizes
    blocks = stage(norm_blocks(descriptors, metric, block, sizes))
    return _exact(blocks, blocks, _usable(pairs, sizes), ratio, metric)


# --- Hash tables --------------------------------------------------------------
def mean_vector(descriptors: DataFrame) -> np.ndarray:
    """Mean of each component; one row a component comes to the driver."""
    def add(batches):
        total = n = None
        for batch in batches:
            x = batch.column(0).drop_null()
            if len(x):
                rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                total, n = (rows.sum(0) if total is None else total + rows.sum(0)), (n or 0) + len(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n, np.int64))], names=["at", "total", "n"])

    sums = descriptors.select("vec").mapInArrow(add, "at int, total double, n long").groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mean"))
    return np.array([r["mean"] for r in sums.orderBy("at").collect()])


def hash_keys(descriptors: DataFrame, metric: str, tables: int, bits: int, probes: int, seed: int = 1) -> DataFrame:
    """The descriptors (image_id, kp_id, vec) under their keys: ``slot`` (table), ``key`` and ``own``, false for a turned bit."""
    mean = mean_vector(descriptors) if metric != "hamming" else None
    kind = descriptors.schema["image_id"].dataType.simpleString()
    vec = descriptors.schema["vec"].dataType.simpleString()

    def keyed(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            rng = np.random.default_rng(seed)
            for slot in range(tables):
                if metric == "hamming":
                    chosen = rng.choice(rows.shape[1] * 64, size=bits, replace=False)
                    sides = (rows[:, chosen // 64] >> (chosen % 64)) & 1
                    sure = rng.random((n, bits))
                else:
                    planes = rng.standard_normal((rows.shape[1], bits))
                    along = (rows - mean) @ planes
                    sides, sure = (along > 0).astype(np.int64), np.abs(along)
                weights = np.int64(1) << np.arange(bits, dtype=np.int64)
                key = sides @ weights if bits else np.zeros(n, np.int64)
                doubtful = np.argsort(sure, axis=1)[:, :probes]
                for k in range(1 + min(probes, bits)):
                    turned = key if k == 0 else key ^ weights[doubtful[:, k - 1]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(n, slot, np.int32)), pa.array(turned), pa.array(np.full(n, k == 0))],
                        names=["image_id", "kp_id", "vec", "slot", "key", "own"])

    return descriptors.mapInArrow(keyed, f"image_id {kind}, kp_id long, vec {vec}, slot int, key long, own boolean")


def hashed_matches(descriptors: DataFrame, pairs: DataFrame, ratio: float = 0.80, metric: str = "l2", block: int = BLOCK,
                   tables: int = 8, bits: int | None = None, probes: int = 4, sizes: DataFrame | None = None) -> DataFrame:
    """Matches as of ``match_descriptors``, of source keypoints that two candidates under their keys let pass the ratio test.

    Without ``bits`` a key holds about 64 descriptors of the largest image.
    """
    d = stage(_typed(descriptors, metric))
    sizes = stage(image_sizes(d)) if sizes is None else sizes
    usable = stage(_usable(pairs, sizes))
    if bits is None:
        largest = sizes.agg(F.max("n")).first()[0] or 0
        bits = max(0, min(48, int(np.log2(max(1, largest / 64)))))
    keyed = hash_keys(d, metric, tables, bits, probes).withColumn("norm", F.lit(0.0))
    place = ["image_id", "slot", "key"]
    crowd = keyed.groupBy(*place, "own").agg(F.ceil(F.count("*") / block).alias("parts"))
    parted = keyed.join(crowd, [*place, "own"]).withColumn("part", F.pmod(F.xxhash64("kp_id"), F.col("parts")))
    packs = stage(_packed(parted, [*place, "own", "part"]))
    s = packs.select(F.col("image_id").alias("source_id"), "slot", "key", F.col("kps").alias("s_kps"), F.col("flat").alias("s_flat"))
    t = packs.filter("own").select(F.col("image_id").alias("target_id"), "slot", "key", F.col("kps").alias("t_kps"), F.col("flat").alias("t_flat"))
    near = _two_nearest(usable.join(s, "source_id").join(t, ["target_id", "slot", "key"]), ["pair_id"], metric)
    # A target that several tables propose counts once, whatever the rounding of its distance in each tile.
    near = near.groupBy("pair_id", "src_kp", "tgt_kp").agg(F.min("distance").alias("distance"))
    hopeful = stage(_best_two(near, ratio).select("pair_id", F.col("src_kp").alias("kp_id")))
    # The few that are left meet all blocks that norms do not rule out.
    asked = (hopeful.join(usable.select("pair_id", F.col("source_id").alias("image_id")), "pair_id").join(d, ["image_id", "kp_id"])
             .withColumn("norm", _norm(metric)))
    parts = asked.groupBy("pair_id").agg(F.ceil(F.count("*") / block).alias("parts"))
    asked = asked.join(parts, "pair_id").withColumn("block", F.struct(F.lit(0).alias("stretch"), F.pmod(F.xxhash64("kp_id"), F.col("parts")).alias("part")))
    sources = stage(_packed(asked, ["pair_id", "image_id", "block"]))
    return _exact(sources, stage(norm_blocks(d, metric, block, sizes)), usable, ratio, metric)


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: how many matches are wanted, how many of them were found, how many were found besides, and the share found."""
    keys = ["pair_id", "src_kp", "tgt_kp"]
    both = wanted.select(*keys, F.lit(1).alias("_w")).join(found.select(*keys, F.lit(1).alias("_f")), keys, "full")
    n = lambda c: F.count_if(c)
    w, f = F.col("_w").isNotNull(), F.col("_f").isNotNull()
    one = both.agg(n(w).alias("wanted"), n(w & f).alias("found"), n(~w & f).alias("besides"))
    return one.withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")))
