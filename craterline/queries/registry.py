"""Named queries with the SQL that must give the same rows.

A query takes a ``Tables`` object and returns a DataFrame. Its oracle is SQL text in which
``{v_entity}`` and the like stand for a domain view; the views it names are put in front as CTEs.
``rounds`` lists the double columns to compare at a fixed number of decimals on both sides. The
cut is set a little off the half, since values with few decimals often lie exactly on it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from craterline.queries import views


CUT = 0.4937219


def shown(c: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(CUT)).cast("double") / F.lit(scale)


@dataclass
class Query:
    name: str
    build: Callable[["Tables"], DataFrame]
    oracle: str | None = None
    rounds: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        return df.withColumns({c: shown(F.col(c), n) for c, n in self.rounds.items()}) if self.rounds else df

    def sql(self) -> str | None:
        if self.oracle is None:
            return None
        body = self.oracle.strip().rstrip(";")
        names = views.closure(re.findall(r"\bv_\w+", body))
        ctes = [f"{n} AS ({views.SQL[n]})" for n in names]
        if self.rounds:
            part = ", ".join(f"floor({c}*1e{n}+{CUT})/1e{n} AS {c}" for c, n in self.rounds.items())
            body = f"SELECT * REPLACE ({part}) FROM ({body}) AS answer"
        if not ctes:
            return body
        head = f"WITH {', '.join(ctes)}"
        own = re.match(r"WITH\s+(.*)", body, re.S)
        return f"{head}, {own.group(1)}" if own else f"{head} {body}"


class Tables:
    """The given tables and the domain views derived from them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._views = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._views:
            if f"v_{name}" in views.SQL:
                self._views[name] = views.build(self, f"v_{name}")
            else:
                self._views[name] = self.table(name)
        return self._views[name]


QUERIES: dict[str, Query] = {}


def query(oracle: str | None = None, rounds: dict[str, int] | None = None):
    """Register a function as a query under its own name."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = Query(fn.__name__, fn, oracle, rounds or {})
        return fn
    return add
