"""Exact top-k by inner product with MaxScore.

The terms are the vector's components; a term's postings are the values of all candidates of a shard
in that component. For a query, the smallest and largest value of each term in the shard bound what
the term can add. A query's terms are ordered by the width of that range; the narrow ones that cannot
lift any candidate to the query's k-th best score together are non-essential. Essential postings are
traversed for the whole shard; the others are probed, widest first, only for candidates that can
still compete. Shards report their k best and the merge keeps the k best of all.

Queries and candidates are packed into blocks of bounded size and every block of queries meets every
shard in a row of its own, so work and memory of a row do not depend on the number of rows. The copies of blocks are
shuffled, never broadcast, and hold whole numbers in as few bytes as they need.

Vectors that are null or hold a null or a non-finite component take no part; nor do rows without id.
A component missing in the shorter of two vectors is zero. Equal scores go to the smaller id. A query
never finds its own id. Of repeated query ids one row asks (the least vector); repeated candidate rows
count each. With fewer than k candidates all are returned, and an empty table gives no rows. Other columns
are not looked at. ``floor(scale * x)`` is exact for every finite x (beyond the doubles: the largest
double), and so are products and ranks within a shard, in Python's integers where 64 bits are too few.
A score beyond 64 bits is reported as the nearest 64-bit number; two such scores of different shards
are told apart by their logarithm. Vectors with large values stand in blocks of their own.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craterline.functions.stage import stage

SHARD, QUERIES = 8_192, 16_384
#: Partitions at most over which the meetings of a shard and a block of queries are dealt.
MEETINGS = 4_096
#: Terms that are probed between two looks at who still competes, and candidates that give the first threshold.
PROBED, SEED = 8, 512
#: Vectors with a larger value are packed apart from the others, whose products then fit 64 bits.
LARGE = 2**24


def integer_vector(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as a double, which holds it exactly; null if the vector takes no part."""
    def whole(v):
        y = v * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(F.greatest(F.lit(-sys.float_info.max), F.least(F.lit(sys.float_info.max), y)))

    x = vector.cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(usable, F.transform(x, whole))


def _large() -> Column:
    return F.exists("v", lambda v: F.abs(v) > LARGE)


def _blocks(rows: DataFrame, size: int) -> tuple[int, int]:
    """Blocks for the usual vectors and for those with large values."""
    n, large = rows.agg(F.count("*"), F.count_if(_large())).first()
    return max(1, -(-(n - large) // size)), -(-large // size)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in 16 or 32 bits if they fit, else as doubles; ``_values`` tells them by their size."""
    most = np.abs(values).max(initial=0)
    return values.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _values(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32}.get(len(data) // max(1, rows * width), np.float64)
    return np.frombuffer(data, dtype=kind).reshape(rows, width).astype(np.float64)


def _packed(rows: DataFrame, blocks: tuple[int, int] | int, name: str) -> DataFrame:
    """Rows (id, v, number) as blocks (``name``, ids, values, width); the number spreads the copies of an id.

    One number of blocks holds for usual vectors; large values then share one more.
    """
    blocks = (blocks, 1) if isinstance(blocks, int) else blocks

    def pack(key, table):
        ids, vectors = table["id"].to_numpy(), table["v"].to_pylist()
        width = max(map(len, vectors))
        values = np.zeros((len(ids), width))
        for row, v in enumerate(vectors):
            values[row, :len(v)] = v
        return pa.table({name: pa.array([key[0].as_py()], pa.int32()), f"{name}_ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                         f"{name}_values": pa.array([_narrow(values).tobytes()], pa.binary()), f"{name}_width": pa.array([width], pa.int32())})

    own = F.xxhash64("id", "number")
    block = F.when(_large(), blocks[0] + F.pmod(own, F.lit(max(1, blocks[1])))).otherwise(F.pmod(own, F.lit(blocks[0])))
    return (rows.withColumn("block", block.cast("int"))
            .groupBy("block").applyInArrow(pack, f"{name} int, {name}_ids binary, {name}_values binary, {name}_width int"))


def _exact(values: np.ndarray, most: int) -> np.ndarray:
    """Doubles while every sum stays exact in them, else 64-bit integers, else Python's integers."""
    if most < 2**53:
        return values.astype(np.float64)
    return values.astype(np.int64) if most < 2**63 else np.frompyfunc(int, 1, 1)(values).astype(object)


def _reported(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as 64-bit numbers, and their logarithm with the sign where those are too few (0 elsewhere)."""
    if score.dtype != object:
        return score.astype(np.int64), np.zeros(len(score))
    held = [max(-2**63, min(2**63 - 1, int(s))) for s in score]
    beyond = [0.0 if h == s else math.copysign(math.log2(abs(int(s))), h) for h, s in zip(held, score, strict=True)]
    return np.array(held, dtype=np.int64), np.array(beyond)


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray, k: int):
    """(query id, id, score) of the k best of a shard for each query."""
    width = max(queries.shape[1], shard.shape[1])
    queries, shard = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, shard))
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(shard).max(initial=0)) * max(width, 1)
    queries, shard = _exact(queries, most), _exact(shard, most)
    postings = np.ascontiguousarray(shard.T)
    low, high = postings.min(axis=1), postings.max(axis=1)
    first = queries @ shard[:SEED].T
    for q, query_id in enumerate(query_ids.tolist()):
        query = queries[q]
        seen = first[q][ids[:SEED] != query_id]
        threshold = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else -np.inf
        ends = np.sort(np.stack([query * low, query * high]), axis=0)  # least and most that each term adds
        order = np.argsort(ends[1] - ends[0], kind="stable")
        reach = ends[0].sum() + np.cumsum((ends[1] - ends[0])[order])
        cut = int(np.searchsorted(reach, threshold, side="left"))  # terms order[:cut] are non-essential
        essential, probes = order[cut:], order[:cut][::-1]
        if cut and not essential.size:
            continue  # nothing in this shard reaches the threshold
        score, bound = query[essential] @ postings[essential], ends[1][probes].sum()
        live = np.flatnonzero(score + bound >= threshold)
        score = score[live]
        for at in range(0, len(probes), PROBED):
            terms = probes[at:at + PROBED]
            score = score + query[terms] @ postings[np.ix_(terms, live)]
            bound -= ends[1][terms].sum()
            still = score + bound >= threshold
            live, score = live[still], score[still]
        own = ids[live] != query_id
        live, score = live[own], score[own]
        best = np.lexsort((ids[live], -score))[:k]
        yield query_id, ids[live[best]], score[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k best rows of ``vectors`` for every row of ``queries``."""
    def usable(rows):
        return rows.select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")

    candidates = stage(usable(vectors).withColumn("number", F.monotonically_increasing_id()))
    asked = stage(usable(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("number", F.lit(0)))
    shards, parts = _blocks(candidates, SHARD), _blocks(asked, QUERIES)
    # Few rows of long work: dealt out by number, and merged, since a broadcast would bring every copy of a side's blocks to the driver.
    met = min(sum(shards) * sum(parts), MEETINGS)
    left = _packed(candidates, shards, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sum(parts) - 1)))).repartition(met, "shard", "part")
    right = _packed(asked, parts, "part").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(sum(shards) - 1)))).repartition(met, "shard", "part")

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = (np.frombuffer(row[f"{n}_ids"], dtype=np.int64) for n in ("shard", "part"))
                shard, block = (_values(row[f"{n}_values"], len(i), row[f"{n}_width"]) for n, i in (("shard", ids), ("part", query_ids)))
                found = [(q, i, *_reported(score)) for q, i, score in search_shard(query_ids, block, ids, shard, k)]
                columns = [np.repeat(np.array([f[0] for f in found], dtype=np.int64), [len(f[1]) for f in found])]
                columns += [np.concatenate([f[c] for f in found] or [np.zeros(0)]).astype(t) for c, t in ((1, np.int64), (2, np.int64), (3, np.float64))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score", "beyond"])

    found = left.join(right.hint("merge"), ["shard", "part"]).mapInArrow(search, "query_id long, id long, score long, beyond double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
