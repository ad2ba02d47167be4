"""Label, raster, grid and manifest files; sinks; the stream store."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from craterline.operators import raster as R
from craterline.sources import grids, labels, sinks
from craterline.streaming import incremental as I

HEAD = '<?xml version="1.0"?><Product_Observational xmlns="http://pds.nasa.gov/pds4/pds/v1" xmlns:isda="x"><Identification_Area><logical_identifier>{lid}</logical_identifier></Identification_Area>'
INST = "<Observing_System_Component><name>{name}</name><type>Instrument</type></Observing_System_Component>"


def write(folder, name, text):
    p = folder / name
    p.write_text(text)
    return p


def test_labels(spark, tmp_path):
    corners = "".join(f"<isda:{v}_{h}_latitude>{la}</isda:{v}_{h}_latitude><isda:{v}_{h}_longitude>{lo}</isda:{v}_{h}_longitude>" for v, la in (("upper", -70.4), ("lower", -70.5)) for h, lo in (("left", 22.8), ("right", 22.9)))
    refined = "<isda:Refined_Corner_Coordinates>" + corners.replace("-70.5", "-71.0") + "</isda:Refined_Corner_Coordinates>"
    write(tmp_path, "ch2_ohr_1.xml", HEAD.format(lid="urn:ohrc") + INST.format(name="Orbiter High Resolution Camera") + "<start_date_time>2021-04-02T05:46:28.4043Z</start_date_time><sun_azimuth>42.5</sun_azimuth><sun_elevation>35</sun_elevation><solar_incidence>55</solar_incidence>"
          + "<isda:System_Level_Coordinates>" + corners + "</isda:System_Level_Coordinates>" + refined + "<isda:pixel_resolution unit='m'>0.32</isda:pixel_resolution></Product_Observational>")
    write(tmp_path, "ch2_tmc_1.xml", HEAD.format(lid="urn:tmc") + INST.format(name="Terrain Mapping Camera 2") + "<sun_azimuth>65.0</sun_azimuth><sun_elevation>30.0</sun_elevation><pixel_resolution/><map_scale>9</map_scale></Product_Observational>")
    write(tmp_path, "ch2_iir_1.xml", HEAD.format(lid="urn:iirs") + INST.format(name="Imaging Infrared Spectrometer") + "".join(f"<Band_Bin><center_wavelength unit='nm'>{w}</center_wavelength></Band_Bin>" for w in (850, 1250, 2800)) + "</Product_Observational>")
    files = labels.read_files(spark, str(tmp_path), "*.xml")
    r = {x["instrument"]: x for x in labels.parse_labels(files).collect()}
    o = r["OHRC"]
    assert (o["product_id"], o["sun_azimuth_deg"], o["gsd_m"], o["lat_min"], o["lat_max"], o["lon_min"], o["lon_max"]) == ("urn:ohrc", 42.5, 0.32, -70.5, -70.4, 22.8, 22.9)
    assert o["acquisition_time"].year == 2021 and o["solar_status"] == o["bounds_status"] == "KNOWN"
    assert {x["instrument"]: x["lat_min"] for x in labels.parse_labels(files, corners="refined").collect()}["OHRC"] == -71.0
    # An empty first tag ends the search: the sampling stays unknown.
    assert r["TMC-2"]["gsd_m"] is None and r["TMC-2"]["gsd_status"] == "UNKNOWN" and r["TMC-2"]["bounds_status"] == "UNKNOWN"
    assert r["IIRS"]["num_bands"] == 3 and [b["center_wavelength_nm"] for b in r["IIRS"]["bands"]] == [850.0, 1250.0, 2800.0]
    v = {x["instrument"]: x for x in labels.validate_products(labels.parse_labels(files)).collect()}
    assert all(x["is_valid"] for x in v.values()) and len(v["TMC-2"]["warnings"]) == 2 and len(v["OHRC"]["checked_rules"]) == 7
    sums = {x["original_filename"]: x["sha256"] for x in labels.ingest_records(files).collect()}
    import hashlib
    assert sums["ch2_ohr_1.xml"] == hashlib.sha256((tmp_path / "ch2_ohr_1.xml").read_bytes()).hexdigest()
    assert labels.inventory(files, labels.parse_labels(files)).filter("sensor_verification_status = 'VERIFIED'").count() == 3


@pytest.mark.parametrize("kind,dtype", [("UnsignedByte", "u1"), ("UnsignedLSB2", "<u2"), ("SignedMSB2", ">i2"), ("IEEE754MSBSingle", ">f4")])
def test_raster_lines(spark, tmp_path, kind, dtype):
    img = (np.arange(60 * 12 * 2).reshape(60, 12, 2) % 200).astype(dtype)
    path = tmp_path / "x.img"
    path.write_bytes(img.tobytes())
    lines = grids.read_raster_lines(spark, str(path), kind, 12, 2)
    px = grids.lines_to_pixels(lines, "P", 2)
    got = {(r["line"], r["sample"], r["band"]): r["dn"] for r in px.collect()}
    assert len(got) == img.size and all(got[k] == float(img[k]) for k in ((0, 0, 0), (59, 11, 1), (17, 3, 1)))
    assert R.select_band(px, 1).count() == 720


def test_raster_size_check(spark):
    p = spark.createDataFrame([(10, 5, 1, "UnsignedLSB2", 100), (10, 5, 1, "UnsignedLSB2", 99)], "lines int, samples int, num_bands int, data_type string, length long")
    assert [r["size_ok"] for r in grids.check_raster_size(p).collect()] == [True, False]


def test_grid_files(spark, tmp_path):
    ok = "\r\n".join(["Longitude,Latitude,Pixel,Scan"] + [f"{20 + p / 10},{s / 10},{p},{s}" for p in (0, 11) for s in (0, 11, 22)])
    write(tmp_path, "ok.csv", ok)
    write(tmp_path, "nocol.csv", ok.replace("Scan", "Line"))
    write(tmp_path, "bad.csv", ok.replace("20.0,0.0", "abc,0.0", 1))
    write(tmp_path, "dup.csv", ok + "\r\n20.0,0.0,0,0")
    write(tmp_path, "few.csv", "\n".join(ok.split("\r\n")[:4]))
    nodes, problems = grids.parse_grid(grids.read_grid_lines(spark, str(tmp_path)))
    got = {r["grid_id"]: r["problem"].split(":")[0] for r in problems.collect() if not (r["grid_id"] == "nocol.csv" and r["problem"] == "INSUFFICIENT_RECORDS")}
    assert got == {"nocol.csv": "MISSING_COLUMN", "bad.csv": "MALFORMED_ROW", "dup.csv": "DUPLICATE_NODE", "few.csv": "INSUFFICIENT_RECORDS"}
    good = grids.valid_grids(nodes, problems)
    assert {r["grid_id"] for r in good.collect()} == {"ok.csv"} and good.count() == 6


def test_manifest(spark, tmp_path):
    base = {k: "x" for k in ("source_sensor", "target_sensor", "source_product_id", "target_product_id", "source_file_path", "target_file_path")}
    write(tmp_path, "pairs.json", json.dumps({"pairs": [{"pair_id": "A", **base}, {"pair_id": "B", "priority_tier": 3, "is_real_data": False, **base}]}, indent=2))
    r = {x["pair_id"]: x for x in grids.read_manifest(spark, str(tmp_path / "pairs.json")).collect()}
    assert r["A"]["priority_tier"] == 1 and r["A"]["is_real_data"] and r["A"]["gsd_status"] == "UNKNOWN" and r["B"]["priority_tier"] == 3 and not r["B"]["is_real_data"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, version int")
    assert {(r["k"], r["v"]) for r in sinks.upsert(old, new, ["k"], "version").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [r["k"] for r in sinks.insert_if_absent(new, old, ["k"]).collect()] == [3]
    runs = spark.createDataFrame([("p", "SIFT", "ACCEPTED"), ("q", "ORB", "REJECTED")], "pair_id string, matcher string, status string")
    sinks.write_results(runs, runs.agg(F.count("*").alias("runs")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/failures")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out/results_csv")).columns == sinks.SUMMARY_COLUMNS
    assert "extra" in sinks.evolve(runs, {"extra": "double"}).columns


def test_stream_store_is_idempotent(spark, tmp_path):
    ents = spark.createDataFrame([("E1", "crater", 0.0, 0.0, None, None)], "entity_id string, entity_type string, latitude double, longitude double, elevation_m double, uncertainty_m double")
    batch = lambda *rows: spark.createDataFrame([(i, "E1", s, None, la, 0.0) for i, s, la in rows], I.OBSERVATION)
    st = I.WorldStore(spark, str(tmp_path / "w"), ents)
    st.apply(batch((1, "OHRC", 0.0)), 0)
    assert st.states().first()["state"] == "SUPPORTED" and "INSUFFICIENT_CORRESPONDENCE" in {r["gap_type"] for r in st.gaps().collect()}
    for _ in range(2):
        st.apply(batch((2, "IIRS", 0.0), (1, "OHRC", 0.001)), 1)
    assert st.states().first()["state"] == "CONFIRMED" and st.associations().count() == 2
    assert {r["gap_type"] for r in st.gaps().collect()} == {"MISSING_TERRAIN_VALIDATION"}


def test_update_rewrites_touched_buckets_only(spark, tmp_path):
    stored = sinks.BucketTable(spark, str(tmp_path / "t"), "k int, v string, version int", ["k"], "version", buckets=16)
    assert stored.rows().count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, version int")
    stored.update(rows(*[(i, "old", 0) for i in range(200)], (3, "older", -1)))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    for _ in range(2):  # again after a failure
        stored.update(rows((7, "new", 2), (500, "more", 1), (8, "late", -5)))
    after = files()
    kept = {p.parent.name for p in before if p in after and before[p] == after[p]}
    assert len(kept) >= 13
    got = {r.k: r.v for r in stored.rows().collect()}
    assert len(got) == 201 and got[7] == "new" and got[500] == "more" and got[8] == "old" and got[3] == "old"
    stored.update(rows().withColumn("extra", F.lit(1)))
    assert stored.rows().columns == ["k", "v", "version"] and stored.rows().count() == 201


def test_folded_stream_log_equals_the_batch_answer(spark, tmp_path):
    from craterline.operators import gaps as G
    from craterline.operators import world as W
    ents = spark.createDataFrame([(f"E{k}", "crater", 0.0, 0.1 * k, None, 80.0 * k) for k in range(4)],
                                 "entity_id string, entity_type string, latitude double, longitude double, elevation_m double, uncertainty_m double")
    rows = [(i, f"E{i % 5}", ("OHRC", "IIRS", "TMC-2")[i % 3], None, 0.0 if i % 4 else 0.5, 0.1 * (i % 5)) for i in range(30)]
    st = I.WorldStore(spark, str(tmp_path / "w"), ents, every=2)
    for v in range(5):
        for _ in range(1 + v % 2):
            st.apply(spark.createDataFrame(rows[6 * v:6 * v + 6], I.OBSERVATION), v)
    whole = W.associate(spark.createDataFrame(rows, I.OBSERVATION), ents)
    as_set = lambda df: {tuple(r) for r in df.select(*sorted(df.columns)).collect()}
    assert as_set(st.associations()) == as_set(whole) and len(as_set(whole)) == 30
    assert {r.rejection_reason for r in whole.filter("status = 'UNRESOLVED'").collect()} == {"ENTITY_NOT_FOUND: E4"}
    names = ["entity_id", "gap_type", "severity"]
    assert as_set(st.gaps().select(*names)) == as_set(G.detect_gaps(ents, whole, None, W.blocking_factors(whole)).select(*names))
    assert as_set(st.states().select("entity_id", "state")) == as_set(W.lifecycle(whole, None, ents).select("entity_id", "state"))
    assert [p.name for p in (tmp_path / "w/bases").iterdir()] == ["upto=3"] and {p.name for p in (tmp_path / "w/states").iterdir()} == {"v=2", "v=3", "v=4"}


@pytest.mark.parametrize("kind, low, high", [("uint8", 0, 255), ("SignedMSB2", -32768, 32767), ("IEEE754LSBSingle", -1.5, 2.5)])
def test_raster_source_round_trip(spark, tmp_path, kind, low, high):
    from craterline.sources import raster_source
    raster_source.register(spark)
    rows = [(n, [float(low), float(high), float(n % 7), None]) for n in [*range(300), *range(500, 520)]]
    options = {"path": str(tmp_path / "r"), "data_type": kind, "samples": "2", "bands": "2"}
    frame = spark.createDataFrame(rows, "line long, dns array<double>").repartitionByRange(4, "line").sortWithinPartitions("line")
    for _ in range(2):  # again after a failure
        frame.write.format("raster_lines").options(**options).mode("append").save()
    back = spark.read.format("raster_lines").options(**options, partition_bytes="64").load()
    got = {r.line: r.dns for r in back.collect()}
    assert back.rdd.getNumPartitions() > 10 and got.keys() == {n for n, _ in rows}
    assert all(got[n][:3] == v[:3] for n, v in rows) and all(x[3] == 0 or x[3] != x[3] for x in got.values())
    (tmp_path / "one.img").write_bytes(b"abcdefg")
    one = spark.read.format("raster_lines").options(path=f"file://{tmp_path}/one.img", samples="3").load().collect()
    assert [(r.line, r.dns) for r in one] == [(0, [97.0, 98.0, 99.0]), (1, [100.0, 101.0, 102.0])]
    bad = spark.createDataFrame([(0, [300.0, 0.0, 0.0, 0.0])], "line long, dns array<double>")
    with pytest.raises(Exception, match="does not fit"):
        bad.write.format("raster_lines").options(**{**options, "data_type": "uint8", "path": str(tmp_path / "bad")}).mode("append").save()


def test_a_label_is_cleaned_step_by_step(spark):
    """Each step of the cleaning stands once in the plan, and contents do not reach the inventory's sort."""
    text = "<?xml a='>'?><p:a xmlns:p='x'><!-- <gone>1</gone> --><p:product_id><![CDATA[x&amp;y]]></p:product_id><!----><p:empty/><pixel_resolution>2.5</pixel_resolution><?end?></p:a>"
    files = spark.createDataFrame([("file:/data/real/LROC_1.xml", text, 9), ("file:/data/real/LROC_1.xml", text, 9), ("file:/data/real/LROC_2.xml", None, None)],
                                  "path string, content string, length long")
    parsed = labels.parse_labels(files)
    assert [(r.file_name, r.gsd_m) for r in parsed.dropDuplicates(["path"]).orderBy("path").collect()] == [("LROC_1.xml", 2.5), ("LROC_2.xml", None)]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xmlns") == 0 and plan.count("CDATA") == 2
    listed = labels.inventory(files, parsed.dropDuplicates(["path"])).orderBy("path")
    assert [(r.file_name, r.file_size_bytes, r.sha256 is None) for r in listed.collect()] == [("LROC_1.xml", 9, False), ("LROC_2.xml", None, True)]
    assert "first(content" not in listed._jdf.queryExecution().optimizedPlan().toString()
