"""Ground-grid CSV files, elevation rows, pair manifests and raw raster lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from craterline.constants import RASTER_TYPES
from craterline.functions.common import first_of


# --- Ground grid --------------------------------------------------------------
def read_grid_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file as grid id; the header line of each file carries ``pos`` words."""
    return spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("grid_id"), "value")


REQUIRED = ["longitude", "latitude", "pixel", "scan"]


def parse_grid(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, problems) of grid texts (grid_id, value).

    The header is the line that has the name of a required column as a field; column order and case
    do not matter, and a header that differs from the first in text order is a problem. Rows with
    fewer than four fields are skipped, a row that does not parse is a problem, and so are a
    missing column, fewer than four records and repeated (pixel, scan).
    """
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    df = lines.withColumn("_f", cells)
    is_head = F.arrays_overlap(F.transform("_f", lambda c: F.lower(c)), F.array(*map(F.lit, REQUIRED)))
    headers = df.filter(is_head).select("grid_id", "value", F.transform("_f", lambda c: F.lower(c)).alias("_h"))
    heads = headers.groupBy("grid_id").agg(F.min("_h").alias("_head"))
    repeated = headers.join(heads, "grid_id").filter("_h <> _head").select("grid_id", F.concat(F.lit("MALFORMED_ROW: "), F.col("value")).alias("problem"))
    body = df.filter(~is_head & (F.size("_f") >= 4)).join(heads.withColumnRenamed("grid_id", "_g"), F.col("grid_id") == F.col("_g"), "left")
    value = lambda n: F.get("_f", (F.array_position("_head", n) - 1).cast("int")).try_cast("double")
    parsed = body.select("grid_id", "value", *[F.when(F.array_position("_head", n) > 0, value(n)).alias(n) for n in REQUIRED])
    bad = F.greatest(*[F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf")) for n in REQUIRED])
    nodes = parsed.filter(~bad).select("grid_id", F.rint("pixel").cast("bigint").alias("pixel"), F.rint("scan").cast("bigint").alias("scan"),
                                       F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    grids = lines.select("grid_id").distinct()
    missing = grids.join(heads, "grid_id", "left").select("grid_id", F.array_except(F.array(*[F.lit(n) for n in REQUIRED]), F.coalesce("_head", F.array().cast("array<string>"))).alias("m"))
    missing = missing.filter(F.size("m") > 0).select("grid_id", F.concat(F.lit("MISSING_COLUMN: "), F.array_join("m", ",")).alias("problem"))
    malformed = parsed.join(missing.select("grid_id"), "grid_id", "left_anti").filter(bad).select("grid_id", F.concat(F.lit("MALFORMED_ROW: "), F.col("value")).alias("problem"))
    counts = grids.join(nodes.groupBy("grid_id").agg(F.count("*").alias("n")), "grid_id", "left")
    few = counts.filter(F.coalesce("n", F.lit(0)) < 4).select("grid_id", F.lit("INSUFFICIENT_RECORDS").alias("problem"))
    twice = nodes.groupBy("grid_id", "pixel", "scan").agg(F.count("*").alias("n")).filter("n > 1").select(
        "grid_id", F.format_string("DUPLICATE_NODE: %d,%d", "pixel", "scan").alias("problem"))
    return nodes, missing.unionByName(malformed).unionByName(repeated).unionByName(few).unionByName(twice)


def valid_grids(nodes: DataFrame, problems: DataFrame) -> DataFrame:
    """Nodes of grids without problems."""
    return nodes.join(problems.select("grid_id").distinct(), "grid_id", "left_anti")


# --- Elevation ----------------------------------------------------------------
def dem_rows_to_cells(rows: DataFrame, tile_lines: int = 512) -> DataFrame:
    """Elevation rows (line, values array) as cells with the tile they are stored under."""
    cells = rows.select("line", F.posexplode("values").alias("sample", "elev"))
    return cells.withColumn("tile", F.concat_ws("_", F.floor(F.col("line") / tile_lines).cast("string"), F.floor(F.col("sample") / tile_lines).cast("string")))


# --- Manifest -----------------------------------------------------------------
MANIFEST = ("pairs array<struct<pair_id:string,source_sensor:string,target_sensor:string,source_product_id:string,target_product_id:string,"
            "source_file_path:string,target_file_path:string,priority_tier:int,expected_difficulty:string,is_real_data:boolean,"
            "ground_truth_level:int,acquisition_info_status:string,spatial_metadata_status:string,gsd_status:string,overlap_status:string,notes:string>>")
DEFAULTS = {"priority_tier": 1, "expected_difficulty": "medium", "is_real_data": True, "ground_truth_level": 0, "acquisition_info_status": "UNKNOWN",
            "spatial_metadata_status": "UNKNOWN", "gsd_status": "UNKNOWN", "overlap_status": "UNKNOWN", "notes": ""}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_pairs(spark.read.schema(MANIFEST).json(path, multiLine=True))


def manifest_pairs(documents: DataFrame) -> DataFrame:
    """One row per pair of manifest documents (column ``pairs``), missing keys filled with defaults."""
    p = documents.select(F.explode("pairs").alias("p")).select("p.*")
    return p.select(*[F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in p.columns])


# --- Raster -------------------------------------------------------------------
def read_raster_lines(spark: SparkSession, path: str, data_type: str, samples: int, bands: int = 1) -> DataFrame:
    """Scan lines (line, dns) of a headerless image file, in parallel.

    The file is read as fixed-length records, one per line, so it splits between tasks at any
    size; the byte offset of a record gives its line number.
    """
    kind = np.dtype(RASTER_TYPES.get(data_type.lower(), "u1"))
    length = samples * bands * kind.itemsize
    records = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(length)})
    df = spark.createDataFrame(records.map(lambda r: (int(r[0]), bytes(r[1]))), "start long, data binary")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"line": pdf["start"] // length, "dns": [np.frombuffer(d, kind).astype("float64") for d in pdf["data"]]})

    return df.mapInPandas(decode, "line long, dns array<double>")


def check_raster_size(products: DataFrame) -> DataFrame:
    """Products (lines, samples, num_bands, data_type, length) with expected bytes and whether the file holds them."""
    width = first_of([(F.lower("data_type") == k, F.lit(np.dtype(v).itemsize)) for k, v in RASTER_TYPES.items()], F.lit(1))
    expected = F.col("lines").cast("bigint") * F.col("samples") * F.coalesce("num_bands", F.lit(1)) * width
    return products.withColumn("expected_bytes", expected).withColumn("size_ok", F.col("length") >= F.col("expected_bytes"))


def lines_to_pixels(lines: DataFrame, product_id: str, bands: int = 1) -> DataFrame:
    """Pixel table of scan lines; band varies fastest."""
    p = lines.select(F.lit(product_id).alias("product_id"), "line", F.posexplode("dns").alias("_i", "dn"))
    return p.select("product_id", "line", F.floor(F.col("_i") / bands).cast("bigint").alias("sample"), (F.col("_i") % bands).cast("bigint").alias("band"), "dn")
