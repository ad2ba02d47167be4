"""Product labels and files: XML label rows, adapter routing, inventory, validation, provenance.

Labels are small texts. One pass lists the leaf elements of a label in document order; a field
is then the first leaf with one of its tag names, picked by the adapter (``adapters.py``) that takes
the file. All of it runs as built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions import text as T
from craterline.functions.common import any_of, compact, first_of
from craterline.sources import adapters as A


# --- Files --------------------------------------------------------------------
def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Files of a folder with content; the path column is the Hadoop URI."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def with_name(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumn("file_name", name).withColumn("extension", F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)))


# --- Label text ---------------------------------------------------------------
def _with_clean(df: DataFrame, content: Column) -> DataFrame:
    """Adds ``_xml``: label text without declarations, comments and namespace prefixes; empty tags written out.

    Each step reads the text of the one before several times, so each is computed once.
    """
    def where(x: Column, marks: tuple[str, ...], pattern: str, by: str) -> Column:
        return F.when(any_of([x.contains(m) for m in marks]), F.regexp_replace(x, pattern, by)).otherwise(x)

    x = F.col("_xml")
    df = _once(df, _xml=content)
    # An alternative behind the bracket, so that other letters are passed over quickly.
    for step in (where(x, ("<?", "<!--"), r"(?s)<(?:\?.*?\?|!--.*?--)>", ""),
                 F.regexp_replace(where(x, ("<![CDATA[",), r"(?s)<!\[CDATA\[([^<]*?)\]\]>", "$1"), r"<(/?)[A-Za-z_][\w.\-]*+:", "<$1"),
                 where(x, ("/>",), r"<([A-Za-z_][\w.\-]*+)((?:[^<>/]|/(?!>))*+)/>", "<$1></$1>")):
        df = _once(df, _next=step).drop("_xml").withColumnRenamed("_next", "_xml")
    return df


#: Names and texts never give back what they have matched, so a tag is looked at once.
LEAF = r"<([A-Za-z_][\w.\-]*+)(?:\s[^<>]*+)?>([^<]*+)</\1>"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later columns read many times; the generator keeps them from being computed again for each."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.withColumn("_row", F.explode(F.array(row))).select(*df.columns, "_row.*")


def _leaves(xml: Column) -> tuple[Column, Column]:
    names = F.regexp_extract_all(xml, F.lit(LEAF), F.lit(1))
    values = F.regexp_extract_all(xml, F.lit(LEAF), F.lit(2))
    return names, values


def _texts(names: Column, values: Column, tags: tuple[str, ...]) -> Column:
    """The text of the first leaf of each tag: null without one, '' for an empty one."""
    at = F.transform(F.array(*[F.lit(t) for t in tags]), lambda tag: F.array_position(names, tag))
    return F.transform(at, lambda n: F.when(n > 0, F.coalesce(A.decoded(F.trim(F.get(values, (n - 1).cast("int")))), F.lit(""))))


def parse_labels(files: DataFrame, corners: str = "system", override: Column | None = None, adapters: tuple[A.LabelAdapter, ...] = A.ADAPTERS) -> DataFrame:
    """Metadata row per label (path, content), read by the first of the adapters that takes its name. Unknown stays null.

    ``corners="refined"`` reads the footprint from the refined corner block where there is one;
    by default the first corners of the document count.
    """
    df = with_name(files) if "file_name" not in files.columns else files
    df = df.withColumn("adapter", A.adapter_of(F.col("file_name"), override, adapters))
    df = _with_clean(df, F.col("content").cast("string"))
    names, values = _leaves(F.col("_xml"))
    df = _once(df, _names=names, _values=values)
    label = A.LabelText(A.tags_of(adapters), F.col("file_name"), F.col("_xml"))
    part = lambda b: F.struct(F.upper(A.inside(b, "type")).alias("kind"), A.inside(b, "name").alias("name"))
    df = _once(df, _found=_texts(F.col("_names"), F.col("_values"), label.tags),
               _parts=F.transform(A.blocks(F.col("_xml"), "Observing_System_Component"), part)).drop("_names", "_values")
    lats, lons = (compact([label.number(f"{c}_{axis}") for c in C.LABEL_CORNERS]) for axis in ("latitude", "longitude"))
    if corners == "refined":
        block = F.try_element_at(A.blocks(F.col("_xml"), "Refined_Corner_Coordinates"), F.lit(1))
        pick = lambda axis: compact([A.inside(block, f"{c}_{axis}").try_cast("double") for c in C.LABEL_CORNERS])
        lats, lons = (F.when(F.size(pick(x)) > 0, pick(x)).otherwise(d) for x, d in (("latitude", lats), ("longitude", lons)))
    array_block = F.coalesce(*[F.get(A.blocks(F.col("_xml"), t), 0) for t in ("Array_2D_Image", "Array_3D_Image", "Array_2D")])
    df = _once(df, _lats=lats, _lons=lons, _array=array_block, _bins=A.blocks(F.col("_xml"), "Band_Bin"), _instrument=A.instrument_of(label, adapters))
    side = lambda b: F.struct(F.lower(A.inside(b, "axis_name")).alias("name"), A.inside(b, "elements").alias("elements"))
    df = _once(df, _axes=F.transform(A.blocks(F.col("_array"), "Axis_Array"), side))
    fields = {f: A.chosen(f, label, adapters) for f in A.FIELDS}
    fields["product_id"] = F.coalesce(fields["product_id"], F.regexp_replace("file_name", r"\.[^.]+$", ""))
    fields["num_bands"] = F.coalesce(fields["num_bands"], F.lit(1))
    named = {f: c.alias(f) for f, c in fields.items()}
    out = df.select("path", "file_name", "extension", "adapter", named.pop("product_id"), named.pop("mission"), F.col("_instrument").alias("instrument"), *named.values())
    known = lambda c: F.when(c, "KNOWN").otherwise("UNKNOWN")
    return out.withColumns({"solar_status": known(A.solar_known(adapters)), "bounds_status": known(F.col("lat_min").isNotNull()), "gsd_status": known(F.col("gsd_m").isNotNull())})


def parse_generic(files: DataFrame) -> DataFrame:
    """Raster files without a label: name, size and time; every scientific field unknown."""
    df = with_name(files)
    null = lambda n, t: F.lit(None).cast(t).alias(n)
    return df.select("path", "file_name", "extension", F.lit("GENERIC").alias("adapter"), F.regexp_replace("file_name", r"\.[^.]+$", "").alias("product_id"),
                     null("mission", "string"), null("instrument", "string"), null("gsd_m", "double"), F.lit("UNKNOWN").alias("gsd_status"),
                     F.lit("UNKNOWN").alias("solar_status"), F.lit("UNKNOWN").alias("bounds_status"), *[c for c in ("length", "modificationTime") if c in df.columns])


# --- Discovery and inventory --------------------------------------------------
def discover_products(files: DataFrame) -> DataFrame:
    """Product files of each folder: data labels first, then other labels, then images; no browse or grid files."""
    df = with_name(files).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).filter(~F.col("file_name").startswith("."))
    low = F.lower("file_name")
    side = F.col("file_name").rlike(r"_b_brw_d18\.xml$|_g_grd_d18\.xml$")
    xml = low.endswith(".xml")
    data = xml & ~side & (low.contains("_d_img_") | (F.lower("folder").contains("data") & F.lower("folder").contains("calibrated")))
    image = low.rlike(r"\.(lbl|tif|tiff|png|jpg)$") & ~low.rlike("^(diff_|reg_|synth_)") & ~low.rlike("_b_brw_|_g_grd_")
    df = df.withColumns({"_data": data, "_xml": xml, "_label": xml & ~side, "_image": image})
    seen = df.groupBy("folder").agg(F.bool_or("_data").alias("_any_data"), F.bool_or("_xml").alias("_any_xml")).withColumnRenamed("folder", "_f")
    j = df.join(seen, df["folder"] == seen["_f"])
    keep = F.when(F.col("_any_data"), F.col("_data")).when(F.col("_any_xml"), F.col("_label")).otherwise(F.col("_image"))
    return j.filter(keep).select("path", "file_name").dropDuplicates(["path"])


def inventory(files: DataFrame, products: DataFrame) -> DataFrame:
    """Inventory row per supported file with sensor verification and display texts (files: path, length, content)."""
    low = F.lower(F.col("path"))
    df = with_name(files).filter(F.col("extension").isin(C.INVENTORY_EXTENSIONS) & ~any_of([low.contains(s) for s in C.INVENTORY_SKIP]))
    # Contents are read here for the last time: only their digests are sorted and joined.
    df = df.select("path", "file_name", "extension", "length", F.sha2("content", 256).alias("sha256")).dropDuplicates(["path"])
    p = products.drop("file_name", "extension").withColumnRenamed("path", "_path")
    j = df.join(p, df["path"] == p["_path"], "left")
    return verify_sensor(j).select(
        "path", "file_name", "extension", F.col("length").alias("file_size_bytes"), T.dims_text(F.col("lines"), F.col("samples")).alias("dimensions"), "num_bands", "data_type",
        "sensor", "product_id", F.coalesce(F.date_format("acquisition_time", "yyyy-MM-dd HH:mm:ss"), F.lit("UNKNOWN")).alias("acquisition_time"), T.gsd_text(F.col("gsd_m")).alias("gsd"),
        T.sun_text(F.col("sun_azimuth_deg"), F.col("sun_elevation_deg")).alias("solar_geometry"),
        T.bounds_text(F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max")).alias("bounds"), F.coalesce("crs", F.lit("UNKNOWN")).alias("projection"),
        "is_real_data", "sensor_verification_status", "sha256")


def verify_sensor(df: DataFrame) -> DataFrame:
    """Sensor identity from the label and whether the file is real data (instrument, extension, path)."""
    sensor = F.coalesce("instrument", F.lit("UNKNOWN"))
    label = F.col("extension").isin(".xml", ".lbl")
    low = F.lower(F.col("path"))
    placed = low.contains("data/real")
    up = F.upper(sensor)
    return df.withColumns({
        "sensor": sensor,
        "sensor_verification_status": first_of([
            (up.isin("UNKNOWN", "GENERIC_RASTER", "UNSPECIFIED"), "UNKNOWN"),
            (up.isin(C.VERIFIED_SENSORS) & (label | placed), "VERIFIED"), (up.isin(C.VERIFIED_SENSORS), "UNKNOWN")], "REJECTED"),
        "is_real_data": (placed | label) & ~low.contains("synthetic")})


# --- Validation and intake ----------------------------------------------------
def validate_products(products: DataFrame, integrity: DataFrame | None = None) -> DataFrame:
    """Seven rules per product: errors, warnings, checked rules and validity.

    ``integrity`` (product_id, has_nan, has_inf) adds the raster findings.
    """
    df = products
    if integrity is not None:
        i = integrity.withColumnRenamed("product_id", "_pid")
        df = df.join(i, df["product_id"] == i["_pid"], "left").drop("_pid")
    else:
        df = df.withColumn("has_nan", F.lit(False)).withColumn("has_inf", F.lit(False))
    c = F.col
    s = lambda x: c(x).cast("string")
    lat_known = c("lat_min").isNotNull() & c("lat_max").isNotNull()
    sun = c("solar_status") == "KNOWN"
    exists = c("file_exists") if "file_exists" in products.columns else F.lit(True)
    errors = compact([
        F.when(~exists, F.concat(F.lit("File "), c("file_name"), F.lit(" does not exist on disk"))),
        F.when(c("lines") <= 0, F.concat(F.lit("Invalid lines count: "), s("lines"))),
        F.when(c("samples") <= 0, F.concat(F.lit("Invalid samples count: "), s("samples"))),
        F.when(c("num_bands") < 1, F.concat(F.lit("Invalid band count: "), s("num_bands"))),
        F.when(c("has_inf"), F.lit("Raster contains infinite (Inf) numeric values")),
        F.when(lat_known & ~(c("lat_min").between(-90, 90) & c("lat_max").between(-90, 90)), F.concat(
            F.lit("Latitude bounds out of range [-90, 90]: min="), s("lat_min"), F.lit(", max="), s("lat_max"))),
        F.when(lat_known & (c("lat_min") > c("lat_max")), F.concat(F.lit("lat_min ("), s("lat_min"), F.lit(") greater than lat_max ("), s("lat_max"), F.lit(")"))),
        F.when(sun & ~c("sun_azimuth_deg").between(0, 360), F.concat(F.lit("Sun azimuth out of range [0, 360]: "), s("sun_azimuth_deg"))),
        F.when(sun & ~c("sun_elevation_deg").between(-90, 90), F.concat(F.lit("Sun elevation out of range [-90, 90]: "), s("sun_elevation_deg"))),
    ])
    warnings = compact([
        F.when((c("instrument") == "IIRS") & (c("num_bands") < 2), F.lit("IIRS spectrometer product loaded with single band (expected hyperspectral band stack)")),
        F.when(c("has_nan"), F.lit("Raster contains NaN values")),
        F.when(~lat_known, F.lit("Geographic footprint not provided in metadata (marked UNKNOWN)")),
        F.when(~sun, F.lit("Solar illumination geometry not provided in metadata (marked UNKNOWN)")),
        F.when(c("gsd_m").isNull(), F.lit("GSD / spatial resolution unavailable in product metadata (marked UNKNOWN)")),
    ])
    df = df.withColumns({"errors": errors, "warnings": warnings, "checked_rules": F.array(*[F.lit(r) for r in C.VALIDATION_RULES])})
    return df.withColumn("is_valid", F.size("errors") == 0).drop("has_nan", "has_inf")


def intake(observations: DataFrame, registered: DataFrame) -> DataFrame:
    """Incoming observations with ``intake_error`` null when accepted.

    An observation that claims to be real must already be registered as real.
    """
    real = registered.filter(~F.col("is_synthetic")).select(F.col("observation_id").alias("_real")).distinct()
    j = observations.join(real, observations["observation_id"] == real["_real"], "left")
    c = F.col
    error = first_of([
        (~c("sensor").isin(C.INTAKE_SENSORS), F.concat(F.lit("Unsupported sensor: "), c("sensor"))),
        ((c("lat_min") > c("lat_max")) | (c("lon_min") > c("lon_max")), F.lit("Invalid geographic coordinates: min greater than max")),
        (~(c("lat_min").between(-90, 90) & c("lat_max").between(-90, 90)), F.lit("Latitude must be in range [-90, 90]")),
        (~(c("lon_min").between(-180, 360) & c("lon_max").between(-180, 360)), F.lit("Longitude must be in range [-180, 360]")),
        (~c("is_synthetic") & c("_real").isNull(), F.lit("Forbidden: Cannot register non-synthetic observation without authenticated real flight product data")),
    ])
    return j.withColumn("intake_error", error).drop("_real")


def to_observations(products: DataFrame, fill_zero: bool = False) -> DataFrame:
    """Product rows as observation rows. Missing geometry stays null unless ``fill_zero`` is set."""
    fields = ["lat_min", "lat_max", "lon_min", "lon_max", "gsd_m", "sun_azimuth_deg", "sun_elevation_deg", "incidence_angle_deg", "emission_angle_deg", "phase_angle_deg"]
    value = lambda f: F.coalesce(F.col(f), F.lit(0.0)).alias(f) if fill_zero else F.col(f)
    return products.select(F.col("product_id").alias("observation_id"), F.coalesce("instrument", F.lit("UNKNOWN")).alias("sensor"), "acquisition_time", *[value(f) for f in fields], "num_bands")


def observation_view(observations: DataFrame) -> DataFrame:
    """Footprint, sun and origin of an observation as structs."""
    c = F.col
    return observations.select(
        "observation_id", "sensor", "acquisition_time", F.struct("lat_min", "lat_max", "lon_min", "lon_max").alias("footprint"),
        F.struct("sun_azimuth_deg", "sun_elevation_deg").alias("solar_geometry"),
        F.struct(F.when(c("is_synthetic"), "SYNTHETIC").otherwise("REAL_LUNAR").alias("type"), "is_synthetic").alias("data_provenance"))


# --- Provenance ---------------------------------------------------------------
def ingest_records(files: DataFrame) -> DataFrame:
    """Ingest record per file: checksum of the content and an empty history. For small files."""
    return with_name(files).select("path", F.col("file_name").alias("original_filename"), F.sha2("content", 256).alias("sha256"),
                                   F.lit("SUCCESS").alias("metadata_extraction_status"),
                                   F.array().cast("array<struct<operation:string,parameters:map<string,string>>>").alias("history"))


def record_transformation(records: DataFrame, operation: str, parameters: dict[str, str]) -> DataFrame:
    """Append one operation to the history of every record."""
    pairs = [F.lit(x) for kv in parameters.items() for x in kv]
    entry = F.struct(F.lit(operation).alias("operation"), F.create_map(*pairs).cast("map<string,string>").alias("parameters"))
    return records.withColumn("history", F.array_append("history", entry))
