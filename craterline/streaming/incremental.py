"""Incremental update of the entity model from a stream of new observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from craterline.functions.stats import latest
from craterline.operators import gaps as G
from craterline.operators import world as W

OBSERVATION = "observation_id bigint, entity_id string, sensor string, acquisition_time timestamp, obs_lat double, obs_lon double"
BUCKETS = 64


def bucket(entity: str = "entity_id"):
    return F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")


class WorldStore:
    """Append-only logs of associations, states and gaps under one folder.

    Batch ``v`` writes only its own partition ``v=...``: the new associations, and the states and
    gaps of the entities they touch. Nothing older is rewritten. Logs are split by entity bucket,
    so re-evaluating an entity reads the buckets that the batch touches. A batch that runs again
    after a failure overwrites its own partition with the same rows.

    Every ``every`` batches the log up to then is folded into one base with the latest row of each key, so a reading
    lists one base and fewer than ``every`` batches. A base counts once it is complete; batches and bases it
    replaces go with the next one. Schemas are those of the operators and fixed.
    """

    def __init__(self, spark: SparkSession, folder: str, entities: DataFrame, every: int = 16):
        self.spark, self.folder, self.entities, self.every = spark, folder.rstrip("/"), entities, every
        found = W.associate(spark.createDataFrame([], OBSERVATION), entities)
        schemas = {"associations": found, "states": W.lifecycle(found, None, entities), "gaps": G.detect_gaps(entities, found, None, W.blocking_factors(found))}
        self.schemas = {n: StructType([StructField(f.name, f.dataType) for f in df.schema] + [StructField("seen", LongType()), StructField("bucket", IntegerType())])
                        for n, df in schemas.items()}

    def _children(self, path: str) -> list[str]:
        """Names in a folder, none if it does not exist."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _base(self) -> int:
        """The batch up to which the log is folded, -1 before the first time."""
        done = [int(n[5:]) for n in self._children(f"{self.folder}/bases") if n.startswith("upto=") and "_DONE" in self._children(f"{self.folder}/bases/{n}")]
        return max(done, default=-1)

    def _log(self, name: str, upto: int | None = None) -> DataFrame:
        base = self._base()
        paths = [f"{self.folder}/bases/upto={base}/{name}"] if base >= 0 else []
        batches = sorted(int(n[2:]) for n in self._children(f"{self.folder}/{name}") if n.startswith("v="))
        paths += [f"{self.folder}/{name}/v={v}" for v in batches if v > base and (upto is None or v <= upto)]
        parts = [self.spark.read.schema(self.schemas[name]).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], self.schemas[name]))

    def _put(self, df: DataFrame, name: str, version: int) -> None:
        self._write(df.withColumns({"seen": F.lit(version).cast("long"), "bucket": bucket()}), f"{self.folder}/{name}/v={version}")

    def _write(self, df: DataFrame, path: str) -> None:
        """Write rows by bucket. A bucket's rows meet in one task before, in several if they are many; else each task would write a file for each bucket."""
        df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def apply(self, batch: DataFrame, version: int) -> None:
        """Log the batch's associations, then re-evaluate the touched entities."""
        if version <= self._base():
            return  # folded already
        self._put(W.associate(batch, self.entities), "associations", version)
        log = self._log("associations", version)
        touched = log.filter(F.col("seen") == version).select("entity_id", "bucket").distinct()
        mine = latest(log.join(touched, ["entity_id", "bucket"], "left_semi"), ["entity_id", "observation_id"], ["seen"]).drop("seen", "bucket")
        # Read by the states and twice by the gaps; the next batch overwrites it.
        mine.write.mode("overwrite").parquet(f"{self.folder}/working")
        mine = self.spark.read.schema(mine.schema).parquet(f"{self.folder}/working")
        who = self.entities.join(touched, "entity_id", "left_semi")
        self._put(W.lifecycle(mine, None, who), "states", version)
        self._put(G.detect_gaps(who, mine, None, W.blocking_factors(mine)), "gaps", version)
        if (version + 1) % self.every == 0:
            self.fold(version)

    def fold(self, version: int) -> None:
        """Write the latest rows of the log up to a batch as a base, then drop what the base before had replaced."""
        before = self._base()
        folder = f"{self.folder}/bases/upto={version}"
        newest = latest(self._log("states", version), ["entity_id"], ["seen"])
        for name, df in (("associations", latest(self._log("associations", version), ["entity_id", "observation_id"], ["seen"])), ("states", newest),
                         ("gaps", self._log("gaps", version).join(newest.select("entity_id", "seen"), ["entity_id", "seen"], "left_semi"))):
            self._write(df.select(*self.schemas[name].names), f"{folder}/{name}")
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_DONE")
        done.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(done, True).close()
        for name in self.schemas:
            for n in self._children(f"{self.folder}/{name}"):
                if n.startswith("v=") and int(n[2:]) <= before:
                    self._drop(f"{self.folder}/{name}/{n}")
        if before >= 0:
            self._drop(f"{self.folder}/bases/upto={before}")

    def associations(self) -> DataFrame:
        return latest(self._log("associations"), ["entity_id", "observation_id"], ["seen"]).drop("seen", "bucket")

    def states(self) -> DataFrame:
        """Latest state of every entity seen so far."""
        return latest(self._log("states"), ["entity_id"], ["seen"]).drop("seen", "bucket")

    def gaps(self) -> DataFrame:
        """Gaps of each entity's latest evaluation; gaps that were closed since are gone."""
        newest = self._log("states").groupBy("entity_id").agg(F.max("seen").alias("seen"))
        return self._log("gaps").join(newest, ["entity_id", "seen"], "left_semi").drop("seen", "bucket")


def stream_observations(spark: SparkSession, folder: str, files_per_batch: int = 100, lateness: str | None = None) -> DataFrame:
    """Observation files as a stream.

    Repeated observations need no state here, as the store keeps the latest association of each.
    ``lateness`` adds a watermark that drops repeats early, and with them anything later than it.
    """
    s = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    if lateness is None:
        return s
    return s.withWatermark("acquisition_time", lateness).dropDuplicatesWithinWatermark(["observation_id", "entity_id"])


def run_updates(stream: DataFrame, store: WorldStore, checkpoint: str) -> StreamingQuery:
    """Apply what is available now, batch by batch."""
    return (stream.writeStream.foreachBatch(lambda df, n: store.apply(df, n)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
