"""Exact statistics that stay distributed when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craterline.functions.common import all_of
from craterline.functions.stage import stage


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      accuracy: int = 10000) -> DataFrame:
    """Exact linear-interpolated percentiles per key, without gathering a key's rows in one task.

    A mergeable quantile sketch gives, per key and probability, an interval of values whose
    rank error is bounded by 1/accuracy of the group, so a margin of four times that always
    holds the wanted ranks. Rows outside the interval are only counted (map-side); rows inside
    it, about 8/accuracy of the group, are counted per distinct value and ranked. Groups of at
    most ``accuracy`` rows are sorted as they are, by one aggregate; nothing of them is joined.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    if keys:
        long = stage(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > accuracy).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
        short = lambda some: some.groupBy(*keys).agg(*[F.percentile("_v", F.lit(float(p))).alias(name) for name, p in probs.items()])
        if long.isEmpty():
            return short(rows)
        same = all_of([F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        return short(rows.join(long, same, "left_anti")).unionByName(_bracketed(rows.join(long, same, "left_semi"), keys, probs, accuracy))
    return _bracketed(rows, keys, probs, accuracy)


def _bracketed(rows: DataFrame, keys: list[str], probs: dict[str, float], accuracy: int) -> DataFrame:
    """``exact_percentiles`` of the column ``_v`` by brackets; groups of at most ``accuracy`` rows take their whole range."""
    margin = 4.0 / accuracy
    brackets = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"),
                 F.lit(max(0.0, p - margin)).alias("p_lo"), F.lit(min(1.0, p + margin)).alias("p_hi"))
        for name, p in probs.items()])
    wanted = []
    for name, p in probs.items():
        wanted += [max(0.0, p - margin), min(1.0, p + margin)]
    sketch = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
             F.percentile_approx("_v", wanted, accuracy).alias("_q"))
        .select(*keys, "_n", "_min", "_max", F.posexplode(brackets).alias("_i", "_b"), "_q")
        .select(
            *keys, "_n", F.col("_b.name").alias("_name"),
            (F.col("_b.p") * (F.col("_n") - 1)).alias("_h"),
            F.when((F.col("_b.p_lo") <= 0.0) | (F.col("_n") <= accuracy), F.col("_min"))
             .otherwise(F.element_at("_q", (F.col("_i") * 2 + 1).cast("int"))).alias("_lo"),
            F.when((F.col("_b.p_hi") >= 1.0) | (F.col("_n") <= accuracy), F.col("_max"))
             .otherwise(F.element_at("_q", (F.col("_i") * 2 + 2).cast("int"))).alias("_hi"),
        )
    )
    if keys:
        packed = sketch.groupBy(*keys).agg(F.collect_list(F.struct("_name", "_h", "_lo", "_hi")).alias("_w"))
        joined = rows.alias("r").join(
            packed.alias("s"), all_of([F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]))
        joined = joined.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col("r._v").alias("_v"), "_w")
    else:
        # One value for the whole table: a scalar subquery.
        packed = sketch.agg(F.collect_list(F.struct("_name", "_h", "_lo", "_hi")).alias("_w"))
        joined = rows.withColumn("_w", packed.scalar())
    w = F.col("_w1")
    counted = (
        joined.select(*keys, "_v", F.explode("_w").alias("_w1"))
        .select(*keys, w["_name"].alias("_name"), w["_h"].alias("_h"),
                F.when(F.col("_v") < w["_lo"], -1).when(F.col("_v") > w["_hi"], 1).otherwise(0).alias("_zone"), "_v")
        .withColumn("_v", F.when(F.col("_zone") == 0, F.col("_v")))
        .groupBy(*keys, "_name", "_h", "_zone", "_v").agg(F.count("*").alias("_c"))
    )
    upto = Window.partitionBy(*keys, "_name").orderBy("_zone", "_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    low, high = F.floor("_h"), F.ceil("_h")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy(*keys, "_name").agg(
        at(low).alias("_a"), at(high).alias("_b"), F.max(F.col("_h") - low).alias("_f"))
    picked = picked.withColumn("_p", F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(
        F.lit("quantile sketch left its error bound"))).otherwise(
            F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")))
    return picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_p"))).alias(name) for name in probs])


def with_previous(df: DataFrame, keys: list[str], order: list[str], carry: list[str], time: str,
                  rows_per_chunk: int = 2_000_000) -> DataFrame:
    """Add ``prev`` (struct of ``carry``) holding the previous row of the same key.

    A key with many rows is cut into time chunks of about ``rows_per_chunk`` rows, each its own
    window partition; the last row of every chunk is carried to the first row of the next one.
    Small keys have one chunk. Rows without a time come first, as the order has it.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    span = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(seconds).alias("_t0"), F.max(seconds).alias("_t1"))
    span = span.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_t0",
        F.ceil(F.col("_n") / F.lit(rows_per_chunk)).alias("_chunks"),
        F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1)).alias("_span"))
    place = F.floor((seconds - F.col("_t0")).cast("double") / F.col("_span") * F.col("_chunks"))
    chunk = F.when(seconds.isNull(), F.lit(0)).otherwise(F.least(F.col("_chunks") - 1, place)).cast("long")
    parts = (df.join(span, all_of([df[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]))
               .withColumn("_chunk", chunk)
               .drop("_t0", "_chunks", "_span", *[f"_k{i}" for i in range(len(keys))]))
    tails = parts.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("_last"))
    tails = tails.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")))
    tails = tails.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_kc"), "_carry")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    lagged = parts.withColumn("_lag", F.lag(F.struct(*carry)).over(inside))
    joined = lagged.join(
        tails, all_of([lagged[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        & (lagged["_chunk"] == F.col("_kc")), "left")
    return (joined.withColumn("prev", F.coalesce("_lag", "_carry"))
                  .drop("_lag", "_carry", "_chunk", "_kc", *[f"_k{i}" for i in range(len(keys))]))


def _tie_break(df: DataFrame, order: list[str]) -> Column:
    """The order columns, then every other comparable column, so that ties resolve the same way each run."""
    rest = [f.name for f in df.schema.fields if f.name not in order and "map<" not in f.dataType.simpleString()]
    return F.struct(*order, *rest)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key. An aggregate, so rows are reduced before the shuffle."""
    row = F.max_by(F.struct(*df.columns), _tie_break(df, order)).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key, reduced before the shuffle."""
    row = F.min_by(F.struct(*df.columns), _tie_break(df, order)).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")
