"""Queries over labels, files, grids and catalogs. Label texts are written from the observation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions import score as S
from craterline.functions import text as T
from craterline.operators import catalog
from craterline.queries.registry import Tables, query
from craterline.sources import adapters, grids, labels, sinks


def _tag(name: str, value) -> F:
    return F.coalesce(F.concat(F.lit(f"<pds:{name}>"), value.cast("string"), F.lit(f"</pds:{name}>")), F.lit(""))


INSTRUMENT = {"OHRC": "Orbiter High Resolution Camera", "TMC-2": "Terrain Mapping Camera 2", "IIRS": "Imaging Infrared Spectrometer"}


def label_files(t: Tables):
    """One label text per footprint. The camera decides the file name and so the adapter."""
    c, k = F.col, F.col("observation_id")
    stem = F.concat(F.when(c("sensor") == "LROC_NAC", "LROC_").when(c("sensor") == "SELENE_TC", F.when(k % 2 == 0, "SELENE_TC_").otherwise("SELENE_MI_")).otherwise("ch2_prod_"), k.cast("string"))
    inst = F.coalesce(*[F.when(c("sensor") == s, F.lit(n)) for s, n in INSTRUMENT.items()], F.lit("Other"))
    bands = F.when(c("sensor") == "IIRS", F.lit("".join(f"<Band_Bin><center_wavelength unit='nm'>{w}</center_wavelength></Band_Bin>" for w in (850, 1250, 2800)))).otherwise("")
    corners = F.concat(*[_tag(f"{a}_{b}_{axis}", c(f"{'lat' if axis == 'latitude' else 'lon'}_{m}"))
                         for axis, pairs in (("latitude", (("upper", "max"), ("lower", "min"))), ("longitude", (("left", "min"), ("right", "max"))))
                         for first, m in pairs for a, b in (((first, o) if axis == "latitude" else (o, first)) for o in (("left", "right") if axis == "latitude" else ("upper", "lower")))])
    body = F.concat(
        F.lit("<?xml version='1.0'?><pds:Product_Observational xmlns:pds='http://pds'><!-- made from a table -->"), _tag("logical_identifier", F.concat(F.lit("urn:"), k.cast("string"))),
        F.lit("<Observing_System_Component><name>"), inst, F.lit("</name><type>Instrument</type></Observing_System_Component>"),
        _tag("start_date_time", F.date_format("acquisition_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")), _tag("sun_azimuth_angle", F.when(k % 4 != 0, c("sun_azimuth_deg"))),
        _tag("sun_elevation_angle", F.when(k % 4 != 0, c("sun_elevation_deg"))), _tag("incidence_angle", F.when(k % 7 != 0, F.lit(90.0) - c("sun_elevation_deg"))),
        F.when(k % 5 != 4, corners).otherwise(""), _tag("pixel_resolution", c("gsd_m")),
        F.lit("<Array_2D_Image><Axis_Array><axis_name>Line</axis_name><elements>"), (k % 900 + 1).cast("string"), F.lit("</elements></Axis_Array><Axis_Array><axis_name>Sample</axis_name><elements>1200</elements></Axis_Array>"
              "<Element_Array><data_type>UnsignedLSB2</data_type></Element_Array></Array_2D_Image>"), bands, F.lit("<pds:note/></pds:Product_Observational>"))
    # Writing and parsing texts is CPU work: spread the slim rows first.
    return t.footprint.repartition("observation_id").select(F.concat(F.lit("file:/data/real/"), stem, F.lit(".xml")).alias("path"), body.alias("content"), F.length(body).cast("bigint").alias("length"))


LABEL = """lb AS (SELECT observation_id AS k, sensor, CASE sensor WHEN 'LROC_NAC' THEN 'LROC_' WHEN 'SELENE_TC' THEN CASE WHEN observation_id % 2 = 0 THEN 'SELENE_TC_' ELSE 'SELENE_MI_' END ELSE 'ch2_prod_' END || observation_id AS stem,
    CASE sensor WHEN 'LROC_NAC' THEN 'LROC' WHEN 'SELENE_TC' THEN 'SELENE' ELSE 'ISSDC' END AS adapter, gsd_m, CASE WHEN observation_id % 4 <> 0 THEN sun_azimuth_deg END AS az, CASE WHEN observation_id % 7 <> 0 THEN 90 - sun_elevation_deg END AS inc,
    CASE WHEN observation_id % 5 <> 4 THEN lat_min END AS lat_min, CASE WHEN observation_id % 5 <> 4 THEN lat_max END AS lat_max, CASE WHEN observation_id % 5 <> 4 THEN lon_min END AS lon_min, CASE WHEN observation_id % 5 <> 4 THEN lon_max END AS lon_max,
    acquisition_time FROM v_footprint)"""


def products(t: Tables):
    return labels.parse_labels(label_files(t))


@query(f"""WITH {LABEL} SELECT 'urn:' || k AS product_id, sensor AS instrument, az AS sun_azimuth_deg, inc AS incidence_angle_deg, lat_min, lat_max, lon_min, lon_max, gsd_m, CAST(k % 900 + 1 AS integer) AS lines,
  CAST(CASE sensor WHEN 'IIRS' THEN 3 ELSE 1 END AS integer) AS num_bands, CASE WHEN az IS NOT NULL OR inc IS NOT NULL THEN 'KNOWN' ELSE 'UNKNOWN' END AS solar_status,
  CASE WHEN lat_min IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS bounds_status FROM lb WHERE adapter = 'ISSDC'""", {c: 6 for c in ("lat_min", "lat_max", "lon_min", "lon_max")})
def s01_label_scan(t: Tables):
    return products(t).filter("adapter = 'ISSDC'").select("product_id", "instrument", "sun_azimuth_deg", "incidence_angle_deg", "lat_min", "lat_max", "lon_min", "lon_max", "gsd_m", "lines", "num_bands", "solar_status", "bounds_status")


@query(f"""WITH {LABEL} SELECT 'urn:' || k AS product_id, 'LROC NAC' AS instrument, inc AS incidence_angle_deg, az AS sun_azimuth_deg, gsd_m, CASE WHEN inc IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS solar_status, 'UNKNOWN' AS bounds_status
  FROM lb WHERE adapter = 'LROC'""")
def s02_nac_label_scan(t: Tables):
    return products(t).filter("adapter = 'LROC'").select("product_id", "instrument", "incidence_angle_deg", "sun_azimuth_deg", "gsd_m", "solar_status", "bounds_status")


@query(f"""WITH {LABEL} SELECT stem AS product_id, CASE WHEN k % 2 = 0 THEN 'Terrain Camera' ELSE 'Multiband Imager' END AS instrument, gsd_m, 'UNKNOWN' AS solar_status FROM lb WHERE adapter = 'SELENE'""")
def s03_terrain_camera_scan(t: Tables):
    return products(t).filter("adapter = 'SELENE'").select("product_id", "instrument", "gsd_m", "solar_status")


@query("SELECT 'scene_' || o_orderkey || '.png' AS file_name, 'scene_' || o_orderkey AS product_id, 'UNKNOWN' AS gsd_status, CAST(o_custkey AS bigint) AS length FROM orders")
def s04_generic_rasters(t: Tables):
    files = t.orders.select(F.concat(F.lit("file:/img/scene_"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"), F.col("o_custkey").alias("length"))
    return labels.parse_generic(files).select("file_name", "product_id", "gsd_status", "length")


NAMES = "CASE o_orderkey % 6 WHEN 0 THEN 'ch2_ohr_' WHEN 1 THEN 'M1234_' WHEN 2 THEN 'Kaguya_' WHEN 3 THEN 'scene_' WHEN 4 THEN 'x_TMC_' ELSE 'lroc_tmc_' END || o_orderkey || '.png'"


@query(f"""SELECT {NAMES} AS file_name, CASE WHEN o_custkey % 50 = 0 THEN 'SELENE' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'ISSDC' WHEN 1 THEN 'LROC' WHEN 2 THEN 'SELENE' WHEN 3 THEN 'GENERIC' ELSE 'ISSDC' END END AS adapter,
  CASE o_orderkey % 6 WHEN 0 THEN 'OHRC' WHEN 4 THEN 'TMC-2' WHEN 5 THEN 'TMC-2' END AS inferred FROM orders""")
def s05_adapter_routing(t: Tables):
    name = F.expr(NAMES)
    return t.orders.select(name.alias("file_name"), adapters.adapter_of(name, F.when(F.col("o_custkey") % 50 == 0, "SELENE")).alias("adapter"), T.instrument_from_name(name).alias("inferred"))


#: An adapter of a user's own: it takes files that another one would, and reads tags and a time that none of the others knows.
PROBE = adapters.LabelAdapter(
    "PROBE", marks=("probe",), tags=("probe_id", "ground_scale", "sun_height"), instrument=lambda label: F.concat(F.lit("Probe "), F.coalesce(label.first("instrument_id"), F.lit("?"))),
    solar=("sun_elevation_deg",),
    fields={"product_id": lambda label: label.first("probe_id"), "gsd_m": lambda label: label.number("ground_scale") / 100,
            "sun_elevation_deg": lambda label: label.number("sun_height"), "lat_min": lambda label: label.corner_bound("lat_min"), "num_bands": lambda label: F.lit(2)})


@query("""SELECT CASE WHEN o_custkey % 3 = 0 THEN 'ISSDC' ELSE 'PROBE' END AS adapter, CASE WHEN o_custkey % 3 = 0 THEN 'ch2_' || o_orderkey WHEN o_custkey % 5 <> 0 THEN 'p' || o_orderkey ELSE 'probe_ch2_' || o_orderkey END AS product_id,
  CASE WHEN o_custkey % 3 <> 0 THEN 'Probe ' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'x' || o_orderkey % 7 WHEN o_custkey % 3 <> 0 THEN '?' END AS instrument, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice / 100 END AS gsd_m,
  CASE WHEN o_custkey % 3 <> 0 AND o_orderkey % 4 <> 1 THEN CAST(o_orderkey % 90 AS double) END AS sun_elevation_deg, CAST(-(o_orderkey % 80) AS double) AS lat_min,
  CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 2 END::INTEGER AS num_bands, CASE WHEN o_custkey % 3 <> 0 AND o_orderkey % 4 <> 1 THEN 'KNOWN' ELSE 'UNKNOWN' END AS solar_status FROM orders""", {"gsd_m": 6})
def s05_added_adapter(t: Tables):
    """Labels read by an adapter put in front of the others, and by those for the files that it leaves."""
    k, mine = F.col("o_orderkey"), F.col("o_custkey") % 3 != 0
    name = F.concat(F.when(mine, "probe_ch2_").otherwise("ch2_"), k.cast("string"))
    body = F.concat(F.lit("<label>"), F.when(F.col("o_custkey") % 5 != 0, _tag("probe_id", F.concat(F.lit("p"), k.cast("string")))).otherwise(""), _tag("ground_scale", F.col("o_totalprice")),
                    _tag("instrument_id", F.when(k % 2 == 0, F.concat(F.lit("x"), (k % 7).cast("string")))), _tag("sun_height", F.when(k % 4 != 1, k % 90)),
                    _tag("minimum_latitude", -(k % 80)), F.lit("</label>"))
    files = t.orders.select(F.concat(F.lit("file:/probe/"), name, F.lit(".xml")).alias("path"), body.alias("content"))
    return labels.parse_labels(files, adapters=(PROBE, *adapters.ADAPTERS)).select("adapter", "product_id", "instrument", "gsd_m", "sun_elevation_deg", "lat_min", "num_bands", "solar_status")


def grid_texts(t: Tables):
    """Ground-grid lines: one grid per customer, some with defects."""
    k = F.col("o_orderkey")
    row = F.concat_ws(", ", (F.lit(20.0) + k % 13 / 16.0).cast("string"), (k % 7 / 8.0).cast("string"), F.when(F.col("o_custkey") % 50 == 3, F.element_at(F.array(F.lit("bad"), F.lit("INVALID"), F.lit("Infinity")), (k % 3 + 1).cast("int"))).otherwise(k.cast("string")), (k % 11).cast("string"))
    body = t.orders.select(F.concat(F.lit("G"), F.col("o_custkey").cast("string")).alias("grid_id"), row.alias("value"))
    head = t.orders.select(F.concat(F.lit("G"), F.col("o_custkey").cast("string")).alias("grid_id"),
                           F.when(F.col("o_custkey") % 40 == 7, "Longitude,Latitude,Pixel").otherwise(" Longitude ,Latitude, PIXEL,Scan").alias("value")).distinct()
    return head.unionByName(body)


@query("""WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
  SELECT 'G' || o_custkey AS grid_id, CASE WHEN o_custkey % 40 = 7 THEN 'MISSING_COLUMN' WHEN o_custkey % 50 = 3 THEN 'MALFORMED_ROW' END AS kind, CASE WHEN o_custkey % 40 = 7 THEN 1 ELSE n END AS problems FROM g WHERE o_custkey % 40 = 7 OR o_custkey % 50 = 3
  UNION ALL SELECT 'G' || o_custkey, 'INSUFFICIENT_RECORDS', 1 FROM g WHERE n < 4 OR o_custkey % 40 = 7 OR o_custkey % 50 = 3""")
def s06_grid_validation(t: Tables):
    _, problems = grids.parse_grid(grid_texts(t))
    return problems.groupBy("grid_id", F.regexp_extract("problem", "^[A-Z_]+", 0).alias("kind")).agg(F.count("*").alias("problems"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
  SELECT 'G' || o.o_custkey AS grid_id, o_orderkey AS pixel, o_orderkey % 11 AS scan, 20.0::double + o_orderkey % 13 / 16.0::double AS lon, o_orderkey % 7 / 8.0::double AS lat FROM orders o JOIN g ON g.o_custkey = o.o_custkey
  WHERE n >= 4 AND o.o_custkey % 40 <> 7 AND o.o_custkey % 50 <> 3""")
def s06_valid_grid_nodes(t: Tables):
    return grids.valid_grids(*grids.parse_grid(grid_texts(t)))


@query("SELECT line, sample, dn AS elev, CAST(floor(line / 16) AS bigint) || '_' || CAST(floor(sample / 16) AS bigint) AS tile FROM v_pixel WHERE product_id = 'IMG-0' UNION ALL SELECT line, sample, dn, CAST(floor(line / 16) AS bigint) || '_' || CAST(floor(sample / 16) AS bigint) FROM v_pixel WHERE product_id <> 'IMG-0'")
def s07_elevation_rows_to_cells(t: Tables):
    # Rows of at most one image line each.
    rows = t.pixel.groupBy("product_id", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "dn"))), lambda p: p["dn"]).alias("values"))
    return grids.dem_rows_to_cells(rows, 16).select("line", F.col("sample").cast("bigint").alias("sample"), "elev", "tile")


@query("""SELECT 'PR-' || o_orderkey AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'OHRC' ELSE 'IIRS' END AS source_sensor, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey % 4 + 1 END AS integer) AS priority_tier, 'medium' AS expected_difficulty, true AS is_real_data, 'UNKNOWN' AS gsd_status FROM orders""")
def s09_pair_manifest(t: Tables):
    k = F.col("o_orderkey")
    entry = F.concat(F.lit('{"pair_id":"PR-'), k.cast("string"), F.lit('","source_sensor":"'), F.when(k % 2 == 0, "OHRC").otherwise("IIRS"), F.lit('"'),
                     F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(',"priority_tier":'), (F.col("o_custkey") % 4 + 1).cast("string"))), F.lit("}"))
    docs = t.orders.select(F.from_json(F.concat(F.lit('{"pairs":['), entry, F.lit("]}")), grids.MANIFEST).alias("d")).select("d.*")
    return grids.manifest_pairs(docs).select("pair_id", "source_sensor", "priority_tier", "expected_difficulty", "is_real_data", "gsd_status")


@query(f"""WITH {LABEL} SELECT stem || '.xml' AS file_name, CAST(k % 900 + 1 AS string) || 'x1200' AS dimensions, coalesce(printf('%.2f', gsd_m) || ' m/px', 'UNKNOWN') AS gsd,
  CASE WHEN lat_min IS NULL THEN 'UNKNOWN' ELSE '[' || printf('%.2f', lat_min) || '°, ' || printf('%.2f', lat_max) || '° N, ' || printf('%.2f', lon_min) || '°, ' || printf('%.2f', lon_max) || '° E]' END AS bounds,
  strftime(acquisition_time, '%Y-%m-%d %H:%M:%S') AS acquisition_time, true AS is_real_data, 'VERIFIED' AS sensor_verification_status FROM lb WHERE adapter = 'ISSDC'""")
def s10_inventory(t: Tables):
    f = label_files(t)
    inv = labels.inventory(f, labels.parse_labels(f))
    return inv.filter(F.col("file_name").startswith("ch2")).select("file_name", "dimensions", "gsd", "bounds", "acquisition_time", "is_real_data", "sensor_verification_status")


FOLDER = "'file:/x/' || o_custkey || '/' || CASE o_orderkey % 5 WHEN 0 THEN 'a_d_img_' || o_orderkey || '.xml' WHEN 1 THEN 'a' || o_orderkey || '_b_brw_d18.xml' WHEN 2 THEN 'a' || o_orderkey || '_g_grd_d18.xml' WHEN 3 THEN 'b' || o_orderkey || '.xml' ELSE 'c' || o_orderkey || '.tif' END"


@query("""WITH f AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS m, bool_or(o_orderkey % 5 = 0) OVER (PARTITION BY o_custkey) AS d, bool_or(o_orderkey % 5 <> 4) OVER (PARTITION BY o_custkey) AS x FROM orders)
  SELECT o_custkey AS folder, o_orderkey AS item FROM f WHERE CASE WHEN d THEN m = 0 WHEN x THEN m = 3 ELSE m = 4 END""")
def s11_product_discovery(t: Tables):
    found = labels.discover_products(t.orders.select(F.expr(FOLDER).alias("path")))
    return found.select(F.regexp_extract("path", r"/x/(\d+)/", 1).cast("bigint").alias("folder"), F.regexp_extract("file_name", r"(\d+)(_[bg]_(brw|grd)_d18)?\.", 1).cast("bigint").alias("item"))


@query("SELECT (SELECT count(*) FROM v_observation) AS observations, (SELECT count(*) FROM v_entity) AS entities, (SELECT count(*) FROM v_profile WHERE status = 'VERIFIED') AS verified, (SELECT count(*) FROM v_observation WHERE is_synthetic) AS synthetic")
def a26_table_counts(t: Tables):
    o = t.observation.agg(F.count("*").alias("observations"), F.count_if("is_synthetic").alias("synthetic"))
    e = t.entity.agg(F.count("*").alias("entities"))
    p = t.profile.agg(F.count_if(F.col("status").isin("VERIFIED", "ACCEPTED")).alias("verified"))
    return o.withColumns({"entities": e.scalar(), "verified": p.scalar()}).select("observations", "entities", "verified", "synthetic")


@query("SELECT pair_id, matcher, status, dominant_failure FROM (SELECT pair_id, matcher, CASE WHEN is_stable THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, CAST(NULL AS varchar) AS dominant_failure FROM v_run)")
def s13_flat_results(t: Tables):
    r = t.run.withColumn("status", F.when(F.col("is_stable"), "ACCEPTED").otherwise("REJECTED"))
    return sinks.flat_results(r).select("pair_id", "matcher", "status", "dominant_failure")


@query(f"""WITH {LABEL} SELECT 'urn:' || k AS observation_id, sensor, coalesce(gsd_m, 0) AS gsd_m, coalesce(az, 0) AS sun_azimuth_deg FROM lb WHERE adapter = 'ISSDC'""")
def s17_products_to_observations(t: Tables):
    return labels.to_observations(products(t).filter("adapter = 'ISSDC'"), fill_zero=True).select("observation_id", "sensor", "gsd_m", "sun_azimuth_deg")


@query(f"""WITH {LABEL} SELECT 'urn:' || k AS product_id, true AS is_valid, concat_ws(' | ', CASE WHEN lat_min IS NULL THEN 'Geographic footprint not provided in metadata (marked UNKNOWN)' END,
  CASE WHEN az IS NULL AND inc IS NULL THEN 'Solar illumination geometry not provided in metadata (marked UNKNOWN)' END, CASE WHEN gsd_m IS NULL THEN 'GSD / spatial resolution unavailable in product metadata (marked UNKNOWN)' END) AS warnings
  FROM lb WHERE adapter = 'ISSDC'""")
def p02_validate_products(t: Tables):
    return labels.validate_products(products(t).filter("adapter = 'ISSDC'")).select("product_id", "is_valid", F.array_join("warnings", " | ").alias("warnings"))


@query("""SELECT o_orderkey AS id, concat_ws(' | ', CASE WHEN o_custkey % 10 = 0 THEN 'Invalid lines count: 0' END, CASE WHEN o_custkey % 11 = 0 THEN 'Raster contains infinite (Inf) numeric values' END,
  CASE WHEN o_custkey % 13 = 0 THEN 'Sun azimuth out of range [0, 360]: 400.0' END) AS errors FROM orders""")
def p02_validation_errors(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    df = t.orders.select(k.cast("string").alias("product_id"), F.lit("f").alias("file_name"), F.when(c % 10 == 0, 0).otherwise(5).alias("lines"), F.lit(5).alias("samples"), F.lit(1).alias("num_bands"), F.lit("OHRC").alias("instrument"),
                         F.lit(1.0).alias("lat_min"), F.lit(2.0).alias("lat_max"), F.lit("KNOWN").alias("solar_status"), F.when(c % 13 == 0, 400.0).otherwise(40.0).alias("sun_azimuth_deg"), F.lit(10.0).alias("sun_elevation_deg"), F.lit(0.3).alias("gsd_m"))
    flags = t.orders.select(k.cast("string").alias("product_id"), F.lit(False).alias("has_nan"), (c % 11 == 0).alias("has_inf"))
    return labels.validate_products(df, flags).select(F.col("product_id").cast("bigint").alias("id"), F.array_join("errors", " | ").alias("errors"))


@query("""SELECT observation_id, CASE WHEN observation_id % 17 = 0 THEN 'Unsupported sensor: MYSTERY' WHEN lat_min > lat_max THEN 'Invalid geographic coordinates: min greater than max' WHEN lat_min < -90 OR lat_max > 90 OR lat_max < -90 THEN 'Latitude must be in range [-90, 90]'
  WHEN lon_min > 360 OR lon_max > 360 THEN 'Longitude must be in range [-180, 360]' WHEN NOT is_synthetic AND observation_id % 2 = 1 THEN 'Forbidden: Cannot register non-synthetic observation without authenticated real flight product data' END AS intake_error
  FROM (SELECT * REPLACE (lat_min - 6 AS lat_min, CASE WHEN observation_id % 19 = 0 THEN lat_max - 20 ELSE lat_max END AS lat_max) FROM v_footprint)""")
def p04_observation_intake(t: Tables):
    k = F.col("observation_id")
    new = t.footprint.withColumns({"lat_min": F.col("lat_min") - 6, "lat_max": F.when(k % 19 == 0, F.col("lat_max") - 20).otherwise(F.col("lat_max")), "sensor": F.when(k % 17 == 0, "MYSTERY").otherwise(F.col("sensor"))})
    return labels.intake(new, t.footprint.filter("observation_id % 2 = 0")).select("observation_id", "intake_error")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 'VERIFIED' ELSE 'UNKNOWN' END WHEN 2 THEN 'VERIFIED' ELSE 'REJECTED' END AS sensor_verification_status,
  CASE o_orderkey % 4 WHEN 2 THEN true ELSE o_custkey % 2 = 0 END AND o_custkey % 5 <> 0 AS is_real_data FROM orders""")
def p11_sensor_verification(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    df = t.orders.select("o_orderkey", F.when(k % 4 == 1, "OHRC").when(k % 4 == 2, "IIRS").when(k % 4 == 3, "HiRISE").alias("instrument"), F.when(k % 4 == 2, ".xml").otherwise(".img").alias("extension"),
                         F.concat(F.when(c % 2 == 0, "/data/real/").otherwise("/tmp/"), F.when(c % 5 == 0, "synthetic").otherwise("x")).alias("path"))
    return labels.verify_sensor(df).select("o_orderkey", "sensor_verification_status", "is_real_data")


@query("SELECT doc_id, sha256(text) AS sha256, 1 AS steps FROM documents")
def p13_provenance(t: Tables):
    files = t.documents.select(F.concat(F.lit("file:/d/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    r = labels.record_transformation(labels.ingest_records(files), "SCALE_NORMALIZATION_DOWNSAMPLING", {"scale_factor": "2.0"})
    return r.select(F.col("original_filename").cast("bigint").alias("doc_id"), "sha256", F.size("history").alias("steps"))


@query("SELECT observation_id, sensor, lat_min, CASE WHEN is_synthetic THEN 'SYNTHETIC' ELSE 'REAL_LUNAR' END AS origin FROM v_footprint", {"lat_min": 5})
def p15_observation_view(t: Tables):
    v = labels.observation_view(t.footprint)
    return v.select("observation_id", "sensor", F.col("footprint.lat_min").alias("lat_min"), F.col("data_provenance.type").alias("origin"))


_GATES = ", ".join(f"('{g}', '{r}')" for g, r in C.GATE_REASONS.items())


@query(f"SELECT g.gate_id, g.gate_reason, count(*) AS uses FROM (VALUES {_GATES}) g(gate_id, gate_reason) JOIN v_run r ON 'GATE' || (r.level_index % 6 + 1) = g.gate_id GROUP BY ALL")
def p17_gate_catalog(t: Tables):
    used = t.run.select(F.concat(F.lit("GATE"), (F.col("level_index") % 6 + 1).cast("string")).alias("gate_id"))
    return used.join(catalog.small(catalog.gate_definitions(t.spark)), "gate_id").groupBy("gate_id", "gate_reason").agg(F.count("*").alias("uses"))


@query("SELECT s.sensor, s.resolution_m, count(*) AS observations FROM (VALUES " + ", ".join(f"('{s}', {r}::double)" for s, _, _, _, r in C.SENSOR_CATALOG) + ") s(sensor, resolution_m) JOIN v_observation o ON o.sensor = s.sensor GROUP BY ALL")
def p17_sensor_catalog(t: Tables):
    return t.observation.join(catalog.small(catalog.sensor_specs(t.spark)), "sensor").groupBy("sensor", "resolution_m").agg(F.count("*").alias("observations"))


@query("SELECT entity_id, uncertainty, uncertainty_m FROM v_entity WHERE entity_id = (SELECT min(entity_id) FROM v_entity)")
def p18_entity_uncertainty(t: Tables):
    from craterline.operators.joins import lookup
    return lookup(t.entity, "entity_id", t.entity.agg(F.min("entity_id")).first()[0]).select("entity_id", "uncertainty", "uncertainty_m")


@query("SELECT observation_id, sensor FROM v_observation WHERE NOT is_synthetic")
def p19_real_observations(t: Tables):
    return t.observation.filter("not is_synthetic").select("observation_id", "sensor")


@query("SELECT product_id, CASE WHEN gsd_m IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS gsd_status FROM (SELECT CASE WHEN sensor = 'SELENE_TC' THEN stem ELSE 'urn:' || k END AS product_id, gsd_m FROM (WITH " + LABEL + " SELECT * FROM lb))")
def p01_status_tagging(t: Tables):
    return products(t).select("product_id", "gsd_status")


@query("""SELECT o_orderkey, CASE WHEN a > 0 AND b > 0 THEN b / a END AS ratio, greatest(a1, b1) / greatest(least(a1, b1), 1e-4) > 2 AS needs FROM (
  SELECT *, CASE WHEN coalesce(a, 0) = 0 THEN 1 ELSE a END AS a1, CASE WHEN coalesce(b, 0) = 0 THEN 1 ELSE b END AS b1 FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey % 40 END AS double) AS a, CAST(o_orderkey % 30 AS double) AS b FROM orders))""", {"ratio": 6})
def m13_scale_ratio(t: Tables):
    a = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey") % 40).cast("double")
    b = (F.col("o_orderkey") % 30).cast("double")
    return t.orders.select("o_orderkey", S.scale_ratio(a, b).alias("ratio"), S.scale_needs_normalisation(a, b)[1].alias("needs"))


@query("""SELECT entity_id, right(entity_id, 6) AS tail, 'GAP-' || right(entity_id, 6) || '-TERRAIN' AS gap_id, 'CORR-' || entity_id || '-' || entity_type AS correspondence_id FROM v_entity""")
def m27_identifiers(t: Tables):
    e = F.col("entity_id")
    return t.entity.select("entity_id", T.suffix(e, 6).alias("tail"), T.gap_id(e, "TERRAIN").alias("gap_id"), T.correspondence_id(e, F.col("entity_type")).alias("correspondence_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS parsed FROM orders""")
def m29_iso_dates(t: Tables):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("not a date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.orders.select("o_orderkey", T.iso_timestamp(text).alias("parsed"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS bigint) AS k FROM events")
def m28_json_columns(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
