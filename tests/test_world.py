"""Entities, change, gaps, resolution, graph and the follow-up loop."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from craterline.operators import gaps as G
from craterline.operators import graph as R
from craterline.operators import resolve as E
from craterline.operators import world as W
from craterline.operators.joins import nearest_in_box, within_radius
from craterline.plans import world_build as B

T0 = datetime(2024, 1, 1)


def test_temporal_states(spark):
    def ep(e, n, az, el, dia, notes=None):
        return (e, n, T0 + timedelta(days=n), az, el, dia, notes)

    rows = [ep("single", 1, 10.0, 30.0, 100.0), ep("light", 1, 10.0, 30.0, 100.0), ep("light", 2, 100.0, 60.0, 100.0), ep("grow", 1, 10.0, 30.0, 100.0), ep("grow", 2, 12.0, 31.0, 110.0),
            ep("both", 1, 10.0, 30.0, 100.0), ep("both", 2, 100.0, 60.0, 110.0), ep("bad", 1, 10.0, 30.0, 100.0), ep("bad", 2, 10.0, 30.0, 110.0, "claim CONTRADICTED"), ep("same", 1, 10.0, 30.0, 100.0), ep("same", 2, 11.0, 30.0, 101.0)]
    df = spark.createDataFrame(rows, "entity_id string, epoch_id int, ts timestamp, solar_azimuth_deg double, solar_elevation_deg double, feature_diameter_m double, notes string")
    got = {r["entity_id"]: r["temporal_state"] for r in W.temporal_states(df).collect()}
    assert got == {"single": "INSUFFICIENT_TEMPORAL_EVIDENCE", "light": "STABLE", "grow": "CHANGE_SUPPORTED", "both": "POSSIBLE_CHANGE", "bad": "CHANGE_CONTRADICTED", "same": "STABLE"}


ENT = "entity_id string, entity_type string, latitude double, longitude double, elevation_m double, uncertainty_m double"
OBS = "observation_id long, entity_id string, sensor string, obs_lat double, obs_lon double, acquisition_time timestamp"


def entity(name, elev=None, unc=None):
    return (name, "crater", -70.5, 22.8, elev, unc)


def test_association_gate_and_lifecycle(spark):
    ents = spark.createDataFrame([entity(n) for n in ("two", "mono", "one", "far", "none")], ENT)
    far = -70.5 + 454.85 / (1737400.0 * math.pi / 180)
    rows = [(1, "two", "OHRC", -70.5003, 22.8, T0), (2, "two", "TMC-2", -70.501, 22.8, T0), (3, "mono", "OHRC", -70.5, 22.8, T0), (4, "mono", "OHRC", -70.5, 22.8001, T0), (5, "one", "OHRC", -70.5, 22.8, T0), (6, "far", "OHRC", far, 22.8, T0)]
    a = W.associate(spark.createDataFrame(rows, OBS), ents)
    d = a.filter("entity_id = 'far'").first()
    assert d["status"] == "REJECTED" and d["rejection_reason"].startswith("SPATIAL_DISTANCE_EXCEEDS_TOLERANCE: 454.") and d["confidence"] == 0.0
    got = {r["entity_id"]: (r["evaluated_case"][:6], r["state"]) for r in W.lifecycle(a, None, ents).collect()}
    assert got["two"] == ("CASE_A", "CONFIRMED") and got["mono"] == ("CASE_A", "SUPPORTED") and got["one"] == ("CASE_D", "SUPPORTED")
    assert got["far"] == ("CASE_B", "REJECTED") and got["none"] == ("CASE_D", "CANDIDATE")
    ev = spark.createDataFrame([("two", "TERRAIN", "CONTRADICTED")], "entity_id string, evidence_type string, status string")
    assert {r["entity_id"]: r["state"] for r in W.lifecycle(a, ev, ents).collect()}["two"] == "CONTRADICTED"
    forced = spark.createDataFrame([(9, "one", "OHRC", -70.5, 22.8, T0, "BY_HAND")], OBS + ", forced_reason string")
    assert W.associate(forced, ents).first()["rejection_reason"] == "BY_HAND"


def test_unknown_is_not_negative(spark):
    ents = spark.createDataFrame([entity("e")], ENT)
    ev = spark.createDataFrame([("e", "GEOMETRIC", "SUPPORTED"), ("e", "TERRAIN", "REJECTED"), ("e", "SCALE", "INSUFFICIENT_EVIDENCE")], "entity_id string, evidence_type string, status string")
    r = W.fuse_evidence(ev, ents).first()
    assert r["supported_dimensions"] == ["GEOMETRIC"] and r["contradicted_dimensions"] == [] and r["insufficient_dimensions"] == ["SCALE"]
    assert "TERRAIN" in r["unknown_dimensions"] and len(r["unknown_dimensions"]) == 8


def test_gap_scenarios(spark):
    ents = spark.createDataFrame([entity(f"BENCH-{i}", elev=5.0 if i != 4 else None, unc=75.0 if i == 8 else None) for i in range(1, 9)], ENT)
    obs = spark.createDataFrame([(i, f"BENCH-{i}", "OHRC", -70.5, 22.8, T0) for i in (1, 2, 5, 6)], OBS)
    events = spark.createDataFrame([("BENCH-7", "GATE3_TARGET_OUTSIDE_CALIBRATED_SWATH: scan -140.2")], "entity_id string, rejection_reason string")
    empty = spark.createDataFrame([], "entity_id string, evidence_type string, status string")
    gaps = G.detect_gaps(ents, W.associate(obs, ents), empty, events)
    want = ["MISSING_SPECTRAL_VALIDATION", "MISSING_TEMPORAL_OBSERVATION", "MISSING_GEOMETRIC_VALIDATION", "MISSING_TERRAIN_VALIDATION", "MISSING_MODALITY", "INSUFFICIENT_CORRESPONDENCE", "FOOTPRINT_NON_OVERLAP", "UNCERTAINTY_TOO_HIGH"]
    expected = spark.createDataFrame([(f"BENCH-{i + 1}", w) for i, w in enumerate(want)], "entity_id string, target_gap_type string")
    assert G.benchmark_summary(G.benchmark_gaps(gaps, expected)).first()["all_passed"]
    recs = {r["gap_type"] for r in G.recommend_for_gaps(gaps).collect()}
    assert len(recs) == 5 and "MISSING_MODALITY" not in recs
    assert {r["feasibility"] for r in G.recommend_for_gaps(gaps, ["OHRC"]).filter("candidate_sensor = 'IIRS'").collect()} == {"PAYLOAD_UNAVAILABLE"}


def test_compatibility(spark):
    sch = "observation_id string, sensor string, lat_min double, lat_max double, lon_min double, lon_max double, has_grid boolean, has_polygon boolean, is_synthetic boolean"
    o = spark.createDataFrame([("a", "OHRC", 0., 1., 23., 24., True, True, False), ("b", "TMC-2", 0., 1., 23., 24., True, True, False), ("c", "IIRS", 0., 1., 23., 24., False, False, False),
                               ("d", "OHRC", 0., 1., 23., 24., False, False, True), ("e", "IIRS", .5, 2., 23., 24., False, False, True)], sch)
    p = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "e"), ("a", "zz")], "id_a string, id_b string")
    got = {(r["id_a"], r["id_b"]): (r["overlap_status"], r["separation_distance_m"]) for r in W.compatibility(p, o).collect()}
    assert got == {("a", "b"): ("NO_OVERLAP", 1773.2), ("a", "c"): ("INSUFFICIENT_GEOMETRY", None), ("d", "e"): ("VALIDATED_OVERLAP", None), ("a", "zz"): ("UNKNOWN", None)}
    assert {(r["id_a"], r["id_b"]): r["overlap_status"] for r in W.compatibility(p, o, strict=True).collect()}[("a", "b")] == "VALIDATED_OVERLAP"


def test_resolution_equals_sequential(spark):
    import random
    rnd = random.Random(3)
    known = [(f"K{i}", rnd.uniform(0, .2), rnd.uniform(0, .2)) for i in range(6)]
    pts = [(i, rnd.choice([rnd.uniform(0, .2), .05]), rnd.choice([rnd.uniform(0, .2), .07])) for i in range(400)]
    h = 0.005
    got = {r["id"]: (r["entity_id"], r["is_new"]) for r in E.resolve_entities(
        spark.createDataFrame(pts, "id long, lat double, lon double"), spark.createDataFrame(known, "entity_id string, latitude double, longitude double"), "id", "id", h).collect()}
    inside = lambda a, b, y, x: y - h <= a <= y + h and x - h <= b <= x + h
    sites, want = [], {}
    for i, y, x in pts:
        if any(inside(a, b, y, x) for _, a, b in known):
            want[i] = False
            continue
        if not any(inside(a, b, y, x) for a, b in sites):
            sites.append((y, x))
        want[i] = True
    assert {k: v[1] for k, v in got.items()} == want and len(got) == 400
    assert len({v[0] for v in got.values() if v[1]}) == len(sites)


def test_radius_join_at_pole_and_date_line(spark):
    import random
    rnd = random.Random(9)
    pts = [(i, rnd.choice([rnd.uniform(89.8, 90), rnd.uniform(-.1, .1), rnd.uniform(-60.1, -60)]), rnd.choice([rnd.uniform(359.8, 360), rnd.uniform(0, .2), rnd.uniform(0, 360)])) for i in range(300)]
    ents = [(f"E{i}", rnd.choice([rnd.uniform(89.8, 90), rnd.uniform(-.1, .1), rnd.uniform(-60.1, -60)]), rnd.choice([rnd.uniform(359.8, 360), rnd.uniform(0, .2), rnd.uniform(0, 360)])) for i in range(200)]
    def hav(a, b, c, d):
        s = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 1737400.0 * 2 * math.atan2(math.sqrt(s), math.sqrt(1 - s))
    want = {(i, e) for i, y, x in pts for e, a, b in ents if hav(a, b, y, x) <= 2500}
    got = within_radius(spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(ents, "entity_id string, latitude double, longitude double"), 2500.0).collect()
    assert {(r["id"], r["entity_id"]) for r in got} == want and len(got) == len(want) and want


def test_nearest_in_box_keeps_unmatched_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0), (3, None, 1.0)], "id int, lat double, lon double")
    e = spark.createDataFrame([("b", 0.001, 0.0), ("a", 0.001, 0.0), ("c", 0.004, 0.0)], "entity_id string, latitude double, longitude double")
    assert {r["id"]: r["entity_id"] for r in nearest_in_box(p, e).collect()} == {1: "a", 2: None, 3: None}


def test_shared_entity_is_no_match(spark):
    edges = spark.createDataFrame([("1", "E", "OBSERVES", "SUPPORTED", 0), ("2", "E", "OBSERVES", "SUPPORTED", 0), ("3", "2", "MATCHED_WITH", "SUPPORTED", 0)], "src string, dst string, relation string, status string, version int")
    pairs = spark.createDataFrame([("1", "2"), ("2", "3")], "id_a string, id_b string")
    assert [(r["id_a"], r["id_b"]) for r in R.valid_correspondences(pairs, edges).collect()] == [("2", "3")]
    nodes = spark.createDataFrame([("1",), ("2",), ("E",)], "id string")
    assert [(r["src"], r["missing"]) for r in R.dangling_edges(nodes, edges).collect()] == [("3", "SOURCE")]
    twice = edges.unionByName(edges.filter("src = '1'").withColumn("relation", F.lit("DERIVED_FROM")).withColumn("version", F.lit(1)))
    assert {r["relation"] for r in R.last_write(twice).filter("src = '1'").collect()} == {"DERIVED_FROM"}


def test_follow_up_closes_terrain_gap(spark):
    ents = spark.createDataFrame([entity("LUNAR-1")], ENT)
    obs = spark.createDataFrame([(1, "LUNAR-1", "OHRC", -70.5, 22.8, T0)], OBS)
    ev = spark.createDataFrame([(1, "LUNAR-1", 1, "GEOMETRIC", "SUPPORTED", T0)], "evidence_id long, entity_id string, observation_id long, evidence_type string, status string, updated_at timestamp")
    w = B.build_world(ents, obs, ev)
    assert w.states().first()["state"] == "SUPPORTED"
    f = spark.createDataFrame([(2, "LUNAR-1", "SLDEM2015", -70.5, 22.8, T0 + timedelta(days=1), 2, "TERRAIN", -1892.4)], OBS + ", evidence_id long, evidence_type string, measured_elevation_m double")
    n = B.apply_followups(w, f)
    assert n.states().first()["state"] == "CONFIRMED" and n.entities.first()["elevation_m"] == -1892.4
    assert {r["gap_type"]: r["status"] for r in n.gaps.collect()}["MISSING_TERRAIN_VALIDATION"] == "RESOLVED"
