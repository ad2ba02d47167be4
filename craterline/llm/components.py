"""Connected components of a graph given as links, with nothing gathered on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterline.functions.stage import stage


class Forest:
    """Sets of integers joined by links; the smallest member stands for its set."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def batches(self, rows: int = 100_000):
        """One link (a, b) for each member but the smallest of each set, b being that smallest."""
        members = list(self.parent)
        for at in range(0, len(members), rows):
            own = members[at:at + rows]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([self.root(x) for x in own], pa.int64())], names=["a", "b"])


def spanning_links(links: DataFrame) -> DataFrame:
    """Each task's links (a, b) replaced by stars with the same components, at most one link for each node."""
    def join(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.link(a, b)
        yield from forest.batches()

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(join, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link to another; the component is its smallest node.

    Rounds of large and small stars: a node hands its larger neighbours, then its smaller ones, to the
    smallest node it sees. The number of rounds grows with the logarithm of the longest path, a round
    is a few joins and aggregates, and each is written to the shared folder. Null ends are no links.
    """
    star = stage(spanning_links(links.dropna(subset=["a", "b"])).distinct())
    before = None
    while True:
        state = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                star.select("b", "b").distinct())
        before = state
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", "m")).distinct())
        star = stage(small)
