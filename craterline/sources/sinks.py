"""Sinks: insert-if-absent, upsert, benchmark result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from craterline.functions.stage import stage
from craterline.functions.stats import latest


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those whose key is not stored yet, one per key."""
    return latest(new.join(existing.select(*keys), keys, "left_anti"), keys, [])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The stored table after the update: the row with the highest version of every key."""
    return latest(existing.unionByName(new, allowMissingColumns=True), keys, [version])


class BucketTable:
    """A stored table whose updates rewrite only the buckets of the keys they touch.

    The schema is fixed. An update reads the touched buckets alone, keeps the row with the highest version of each
    key and replaces those partitions; a bucket with no new row keeps its files. Done again after a failure
    it gives the same rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], version: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.version, self.buckets = spark, path.rstrip("/"), keys, version, buckets
        self.columns = StructType.fromDDL(schema)

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _stored(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], self.columns).withColumn("bucket", F.lit(0))
        return self.spark.read.schema(StructType([*self.columns.fields, StructField("bucket", IntegerType())])).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._stored().drop("bucket")

    def update(self, new: DataFrame) -> None:
        """Merge rows into the buckets they belong to."""
        mine = stage(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.columns])
                     .withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")))
        touched = [r.bucket for r in mine.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        old = self._stored().filter(F.col("bucket").isin(touched))
        merged = stage(latest(old.select(*mine.columns).unionByName(mine), [*self.keys, "bucket"], [self.version]))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing columns as null."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns}) if columns else df


SUMMARY_COLUMNS = [
    "pair_id", "matcher", "source_sensor", "target_sensor", "is_real_data", "ground_truth_level", "status", "matcher_implementation_status",
    "candidate_matches", "inliers", "inlier_ratio", "mean_reprojection_error_px", "spatial_coverage_ratio", "homography_condition_number",
    "scale_ratio_status", "dominant_failure", "processing_time_sec",
]


def flat_results(results: DataFrame) -> DataFrame:
    """Result rows in the columns of the flat file; absent ones are null."""
    return results.select(*[F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY_COLUMNS])


def write_results(results: DataFrame, summary: DataFrame, folder: str) -> None:
    """Results and refused runs as JSON lines, the flat table as CSV, the summary as JSON."""
    results.write.mode("overwrite").json(f"{folder}/results")
    flat_results(results).write.mode("overwrite").option("header", True).csv(f"{folder}/results_csv")
    results.filter(~F.col("status").isin("ACCEPTED", "GEOMETRICALLY_STABLE")).write.mode("overwrite").json(f"{folder}/failures")
    summary.write.mode("overwrite").json(f"{folder}/summary")
