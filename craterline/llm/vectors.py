"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside them.

Centres are fitted on a bounded sample. Every vector lives in the cell of its closest centre and is
also a guest in cells whose centre is nearly as close, so that
partners on both sides of a border meet: for partners a, b at home with centres p, q the two gaps a(p - q) and b(q - p) are not negative
and add up to (a - b)(p - q), at most sqrt(2 - 2 least) |p - q|, so one of the gaps is at most half of
that, and such a vector is a guest. No link is lost. A pair of one cell is compared there; a pair of two cells in the lower of
them if the other's vector is a guest there, else in the higher one. Vectors that live in a cell are cut into blocks of at
most ``block``, its guests into larger ones; blocks at home meet each other and those of the guests, and guests of a
third cell never meet, so a crowded cell costs more tasks, not a larger one.
Vectors with equal components are one node with a count, however many rows have them.

In many dimensions the bound admits guests to most cells. With a ``margin`` a vector visits only cells whose centre is at most so
much further in cosine than its own: far fewer products, and a pair close to ``least`` across a border may be missed.

Products are taken in single precision first, and those within its error of ``least`` or above it in double precision. A block pair reports how many links each vector has and a
spanning forest of the links, never all pairs.

A vector that is null, empty, zero or holds a null or a non-finite component links with nothing and
keeps its row. Vectors of each length are a set of their own. A row without id keeps its row and counts as a partner, but never names a component. Repeated rows keep their rows
and count as vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterline.functions.stage import stage
from craterline.llm.components import Forest, components

SAMPLE = 20_000
MOST_CELLS = 1024
#: Vectors a cell should hold, while there are fewer than MOST_CELLS cells.
FILLED = 2_000
BLOCK = 2_048
#: A block of guests is so many times as large.
GUESTS = 4
#: No product of unit vectors is off by more in single precision.
SINGLE = 1e-4
#: Guests are admitted with so much more, for rounding.
ROUNDING = 1e-9


def spherical_k_means(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = _closest(sample, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
    return centres


def _closest(vectors: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    return np.concatenate([(vectors[i:i + rows] @ centres.T).argmax(axis=1) for i in range(0, len(vectors), rows)] or [np.zeros(0, np.int64)])


def usable(vector: str):
    """Whether a vector column is not null, finite in every component and not zero."""
    v = F.col(vector)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else a square may overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(embeddings: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
                    margin: float | None = None, block: int = BLOCK, filled: int | None = None) -> DataFrame:
    """Id, ``n_links``, ``component_id`` and ``kept`` of every row; a ``margin`` replaces the bound that loses no link."""
    rows = stage(embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("ok", usable("v")))
    # One node for equal vectors, named by a hash that only labels it.
    keyed = rows.where("ok").select("id", "v", F.xxhash64("v").alias("hash"))
    nodes = stage(keyed.groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.min("hash").alias("hash"))
                  .withColumn("node", F.monotonically_increasing_id()))
    found = None
    for width, n in nodes.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy("width").collect():
        own = _found(nodes.where(F.size("v") == width), width, n, least, margin, block, filled or FILLED)
        found = own if found is None else found.union(own)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    named = (nodes.join(counts, "node", "left").join(components(links), "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least_id, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    component = F.coalesce("component_id", "id")
    return (rows.withColumn("key", F.when(F.col("ok"), F.col("v"))).join(named.withColumnRenamed("v", "key"), "key", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))


def _found(nodes: DataFrame, width: int, n: int, least: float, margin: float | None, block: int, filled: int) -> DataFrame:
    """Counts of links and links of a spanning forest of the nodes, whose vectors all have this length."""
    share = min(1.0, SAMPLE / n)
    sample = np.array([r.v for r in nodes.where(F.pmod("hash", F.lit(1_000_000)) < share * 1_000_000).select("v").limit(2 * SAMPLE).collect()] or [nodes.first().v])
    sample = sample / np.abs(sample).max(axis=1, keepdims=True)
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centres = spherical_k_means(sample, max(1, min(MOST_CELLS, round(n / filled))))

    placed = stage(_placed(nodes.select("node", "copies", "v"), centres, width, least, margin))
    at_home = F.col("home") == F.col("cell")
    crowd = placed.groupBy("cell").agg(F.ceil(F.count_if(at_home) / block).cast("int").alias("blocks"),
                                       F.ceil(F.count_if(~at_home) / (GUESTS * block)).cast("int").alias("guests")).where("blocks > 0")
    own = F.when(at_home, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.col("blocks") + F.pmod(F.xxhash64("node"), F.col("guests"))).cast("int")
    met = (placed.join(F.broadcast(crowd), "cell")  # at most MOST_CELLS rows
           .withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(at_home, F.col("blocks") + F.col("guests")).otherwise(F.col("blocks")) - 1)))
           .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "home", "guest", "v"))
    return stage(met.groupBy("cell", "i", "j").applyInArrow(_products(least, width), "node long, links long, other long"))


def _placed(nodes: DataFrame, centres: np.ndarray, width: int, least: float, margin: float | None) -> DataFrame:
    """A row for each node and cell that it lives in or visits, with the list of the cells that it visits."""
    squares = (centres ** 2).sum(axis=1)
    apart = np.sqrt(np.maximum(0, squares[:, None] + squares - 2 * centres @ centres.T) + ROUNDING)
    reach = np.sqrt(max(0.0, 2 - 2 * least)) / 2

    def place(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch.column(2), width)
            for at in range(0, len(x), 4096):
                near = x[at:at + 4096] @ centres.T
                home = near.argmax(axis=1)
                at_cell = near >= near.max(axis=1, keepdims=True) - (reach * apart[home] if margin is None else margin) - ROUNDING
                rows, cells = np.nonzero(at_cell)
                visits = [np.flatnonzero(r).astype(np.int32) for r in at_cell]
                own = batch.slice(at, len(near)).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), pa.array(cells.astype(np.int32)), pa.array(home[rows].astype(np.int32)),
                     pa.array([visits[r] for r in rows], pa.list_(pa.int32()))], names=["node", "copies", "v", "cell", "home", "guest"])

    return nodes.mapInArrow(place, "node long, copies long, v array<double>, cell int, home int, guest array<int>")


def _products(least: float, width: int):
    """Links between two blocks of a cell: counts for each node, and a spanning forest as (node, other)."""
    def compare(key, table):
        cell, i, j = (k.as_py() for k in key)
        own, home, node, copies = (table[c].to_numpy() for c in ("own", "home", "node", "copies"))
        x = _unit(table["v"].combine_chunks(), width)
        single = x.astype(np.float32)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links, forest = np.zeros(len(node), dtype=np.int64), Forest()
        for at in range(0, len(left), 256):
            part = left[at:at + 256]
            a, b = np.nonzero(single[part] @ single[right].T >= least - SINGLE)
            a, b = part[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            sure = np.concatenate([(x[a[k:k + 65_536]] * x[b[k:k + 65_536]]).sum(axis=1) >= least for k in range(0, len(a), 65_536)] or [np.zeros(0, bool)])
            a, b = a[sure], b[sure]
            # A pair of two cells counts once: in the lower cell if the other is a guest there. One of the two is at home here.
            here = np.ones(len(a), dtype=bool)
            low, high = np.minimum(home[a], home[b]), np.maximum(home[a], home[b])
            visitor = np.where(home[a] < home[b], b, a)
            maybe = np.flatnonzero((low != high) & (high == cell))
            visits = table["guest"].take(pa.array(visitor[maybe])).to_pylist()
            here[maybe] = [n not in cells for n, cells in zip(low[maybe].tolist(), visits, strict=True)]
            a, b = a[here], b[here]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for p, q in zip(node[a].tolist(), node[b].tolist(), strict=True):
                forest.link(p, q)
        some = np.flatnonzero(links)
        stars = list(forest.parent)
        return pa.table({"node": pa.array(np.r_[node[some], np.array(stars, dtype=np.int64)]),
                         "links": pa.array(np.r_[links[some], np.zeros(len(stars), np.int64)]),
                         "other": pa.array([None] * len(some) + [forest.root(s) for s in stars], pa.int64())})

    return compare
