"""Queries over entities, associations, evidence and change."""

from __future__ import annotations

from pyspark.sql import functions as F

from craterline import constants as C
from craterline.operators import world as W
from craterline.queries.registry import Tables, query

DIMS = "['" + "','".join(C.FUSED_DIMENSIONS) + "']"


def associations(t: Tables):
    return W.associate(t.observation, t.entity)


def joined(df, *names: str, sep: str = ","):
    """Array columns as text, so that values compare on both sides."""
    return df.withColumns({n: F.array_join(n, sep) for n in names})


@query("""SELECT observation_id, entity_id, sensor, status, association_type, distance_m,
  CASE WHEN distance_m > 200 THEN 'SPATIAL_DISTANCE_EXCEEDS_TOLERANCE: ' || printf('%.1f', distance_m) || 'm > 200.0m' END AS rejection_reason
  FROM v_association""", {"distance_m": 4})
def j04_radius_association(t: Tables):
    return associations(t).select("observation_id", "entity_id", "sensor", "status", "association_type", "distance_m", "rejection_reason")


STATE_SQL = """SELECT entity_id, count(*) FILTER (WHERE status = 'SUPPORTED') AS supported, count(*) FILTER (WHERE status = 'REJECTED') AS rejected,
  count(*) FILTER (WHERE status = 'CONTRADICTED') AS contradicted,
  CASE WHEN count(*) FILTER (WHERE status = 'CONTRADICTED') > 0 THEN 'CONTRADICTED' WHEN count(*) FILTER (WHERE status = 'SUPPORTED') >= 2 THEN 'CONFIRMED'
    WHEN count(*) FILTER (WHERE status = 'SUPPORTED') = 1 THEN 'SUPPORTED' WHEN count(*) FILTER (WHERE status = 'REJECTED') > 0 THEN 'REJECTED' ELSE 'CANDIDATE' END AS state
  FROM {src} GROUP BY entity_id"""


@query(STATE_SQL.format(src="v_association"))
def a14_entity_state(t: Tables):
    return W.entity_states(associations(t))


@query(STATE_SQL.format(src="v_report"))
def a14_reported_state(t: Tables):
    return W.entity_states(t.report)


@query("""SELECT entity_id, array_to_string(list_sort(list_distinct(list(sensor))), ',') AS sensors, count(*) AS observation_count
  FROM v_association GROUP BY entity_id""")
def a15_entity_sensors(t: Tables):
    return joined(W.entity_sensors(associations(t)), "sensors")


@query("""SELECT entity_id, observation_id, version, sensor, status FROM v_report
  QUALIFY row_number() OVER (PARTITION BY entity_id, observation_id ORDER BY version DESC) = 1""")
def w03_latest_association(t: Tables):
    return W.latest_associations(t.report, "version").select("entity_id", "observation_id", "version", "sensor", "status")


DIM_STATUS = """SELECT entity_id, evidence_type, CASE WHEN bool_or(status = 'CONTRADICTED') THEN 'CONTRADICTED'
    WHEN bool_or(status = 'REJECTED') AND NOT bool_or(status = 'SUPPORTED') THEN 'REJECTED' WHEN bool_or(status = 'SUPPORTED') THEN 'SUPPORTED'
    WHEN bool_or(status = 'INSUFFICIENT_EVIDENCE') THEN 'INSUFFICIENT_EVIDENCE' WHEN bool_or(status = 'UNVALIDATED') THEN 'UNVALIDATED' ELSE 'UNKNOWN' END AS status,
  count(*) AS items FROM v_evidence GROUP BY entity_id, evidence_type"""


@query(DIM_STATUS)
def a16_dimension_status(t: Tables):
    return W.dimension_status(t.evidence)


@query("SELECT entity_id, bool_or(status = 'CONTRADICTED') AS has_contradiction FROM v_evidence GROUP BY entity_id")
def a17_contradictions(t: Tables):
    return W.contradictions(t.evidence)


@query("""WITH a AS (SELECT * FROM v_evidence QUALIFY row_number() OVER (PARTITION BY entity_id, evidence_id ORDER BY updated_at DESC,
    observation_id DESC NULLS LAST, evidence_type DESC, status DESC) = 1),
  b AS (SELECT * FROM a WHERE observation_id IS NOT NULL QUALIFY row_number() OVER (
    PARTITION BY entity_id, evidence_type, observation_id ORDER BY updated_at DESC, evidence_id DESC) = 1)
  SELECT evidence_id, entity_id, observation_id, evidence_type, status FROM (SELECT * FROM a WHERE observation_id IS NULL UNION ALL SELECT * FROM b)""")
def w04_latest_evidence(t: Tables):
    return W.latest_evidence(t.evidence).select("evidence_id", "entity_id", "observation_id", "evidence_type", "status")


@query(f"""SELECT e.entity_id, array_to_string(list_filter({DIMS}, lambda x: NOT list_contains(coalesce(p.present, []), x)), ',') AS unmeasured
  FROM v_entity e LEFT JOIN (SELECT entity_id, list(DISTINCT evidence_type) AS present FROM v_evidence GROUP BY entity_id) p USING (entity_id)""")
def u03_unmeasured_dimensions(t: Tables):
    return joined(W.unmeasured_dimensions(t.evidence, t.entity), "unmeasured")


def _dims(*wanted: str) -> str:
    inside = ",".join(f"'{w}'" for w in wanted)
    return f"array_to_string(list_filter({DIMS}, lambda x: coalesce(map_extract(m, x)[1], 'NONE') IN ({inside})), ', ')"


FUSED = f"""WITH d AS ({DIM_STATUS}), p AS (SELECT entity_id, map_from_entries(list({{'k': evidence_type, 'v': status}})) AS m FROM d GROUP BY entity_id),
  f AS (SELECT e.entity_id, entity_type, {_dims('SUPPORTED')} AS supported_dimensions, {_dims('CONTRADICTED')} AS contradicted_dimensions,
    {_dims('INSUFFICIENT_EVIDENCE')} AS insufficient_dimensions, {_dims('NONE', 'REJECTED', 'UNVALIDATED', 'UNKNOWN')} AS unknown_dimensions
    FROM v_entity e LEFT JOIN p USING (entity_id))
  SELECT *, concat_ws(chr(10), 'Entity ' || entity_id || ' (' || upper(entity_type) || ') Evaluation Summary:',
    CASE WHEN supported_dimensions <> '' THEN 'SUPPORTED BY: ' || supported_dimensions END,
    CASE WHEN contradicted_dimensions <> '' THEN 'CONTRADICTED BY: ' || contradicted_dimensions END,
    CASE WHEN unknown_dimensions <> '' THEN 'UNKNOWN DIMENSIONS (' || CAST(len(string_split(unknown_dimensions, ', ')) AS string) || '): ' || unknown_dimensions END,
    CASE WHEN insufficient_dimensions <> '' THEN 'INSUFFICIENT EVIDENCE DIMENSIONS: ' || insufficient_dimensions END) AS summary FROM f"""


@query(FUSED)
def d11_fuse_evidence(t: Tables):
    df = W.fuse_evidence(t.evidence, t.entity)
    return joined(df, "supported_dimensions", "contradicted_dimensions", "insufficient_dimensions", "unknown_dimensions", sep=", ")


@query(f"""WITH d AS ({DIM_STATUS}) SELECT e.evidence_id, e.entity_id, e.evidence_type, e.status FROM v_evidence e JOIN d
  ON d.entity_id = e.entity_id AND d.evidence_type = e.evidence_type AND d.status = e.status WHERE d.status IN ('SUPPORTED', 'CONTRADICTED')""")
def d11_evidence_items(t: Tables):
    return W.evidence_items(t.evidence).select("evidence_id", "entity_id", "evidence_type", "status")


CASES = """CASE WHEN contradicted > 0 OR coalesce(bad, false) THEN 'CASE_C_CONTRADICTORY_EVIDENCE' WHEN rejected > 0 AND supported = 0 THEN 'CASE_B_PHYSICALLY_INCOMPATIBLE'
    WHEN supported = 1 THEN 'CASE_D_SINGLE_OBSERVATION' WHEN supported >= 2 AND len(sensors) >= 2 THEN 'CASE_A_COMPATIBLE_OVERLAP'
    WHEN supported >= 2 THEN 'CASE_A_MONO_SENSOR_MULTIPLE_ACQUISITIONS' ELSE 'CASE_DEFAULT_CANDIDATE' END"""
LIFECYCLE = f"""WITH n AS (SELECT entity_id, count(*) FILTER (WHERE status = 'SUPPORTED') AS supported, count(*) FILTER (WHERE status = 'REJECTED') AS rejected,
    count(*) FILTER (WHERE status = 'CONTRADICTED') AS contradicted, list_sort(list_distinct(list(sensor) FILTER (WHERE status = 'SUPPORTED'))) AS sensors
    FROM v_association GROUP BY entity_id),
  b AS (SELECT entity_id, bool_or(status = 'CONTRADICTED') AS bad FROM v_evidence GROUP BY entity_id),
  j AS (SELECT e.entity_id, coalesce(supported, 0) AS supported, coalesce(rejected, 0) AS rejected, coalesce(contradicted, 0) AS contradicted,
    coalesce(sensors, []) AS sensors, bad FROM v_entity e LEFT JOIN n USING (entity_id) LEFT JOIN b USING (entity_id)),
  c AS (SELECT *, {CASES} AS evaluated_case FROM j)
  SELECT entity_id, evaluated_case, CASE evaluated_case WHEN 'CASE_C_CONTRADICTORY_EVIDENCE' THEN 'CONTRADICTED' WHEN 'CASE_B_PHYSICALLY_INCOMPATIBLE' THEN 'REJECTED'
    WHEN 'CASE_A_COMPATIBLE_OVERLAP' THEN 'CONFIRMED' WHEN 'CASE_DEFAULT_CANDIDATE' THEN 'CANDIDATE' ELSE 'SUPPORTED' END AS state,
    evaluated_case = 'CASE_A_COMPATIBLE_OVERLAP' AS is_confirmed, supported, rejected, contradicted, array_to_string(sensors, ',') AS sensors FROM c"""


@query(LIFECYCLE)
def d10_entity_lifecycle(t: Tables):
    df = W.lifecycle(associations(t), t.evidence, t.entity).drop("explanation", "blocking_factor")
    return joined(df, "sensors")


@query("""WITH n AS (SELECT entity_id, count(*) FILTER (WHERE status = 'SUPPORTED') AS supported, count(*) FILTER (WHERE status = 'REJECTED') AS rejected,
    list_sort(list_distinct(list(sensor) FILTER (WHERE status = 'SUPPORTED'))) AS sensors FROM v_association GROUP BY entity_id)
  SELECT entity_id, CASE WHEN rejected > 0 AND supported = 0 THEN 'Entity rejected: all candidate associations failed physical, geometric, or footprint checks.'
    WHEN supported = 1 THEN 'Entity supported by a single observation; cannot be confirmed without independent cross-sensor verification.'
    WHEN len(sensors) >= 2 THEN 'Entity CONFIRMED: Independently corroborated across distinct sensors: [''' || array_to_string(sensors, ''', ''') || '''].'
    ELSE 'Entity supported by multiple acquisitions of the same sensor (' || sensors[1] || '), but lacks multi-modal cross-sensor confirmation.' END AS explanation
  FROM n""")
def d10_lifecycle_explanation(t: Tables):
    return W.lifecycle(associations(t)).select("entity_id", "explanation")


@query("""SELECT entity_id, observation_id, sensor, 'SPATIAL_DISTANCE_EXCEEDS_TOLERANCE: ' || printf('%.1f', distance_m) || 'm > 200.0m' AS rejection_reason
  FROM v_association WHERE status = 'REJECTED'""")
def d10_blocking_factors(t: Tables):
    return W.blocking_factors(associations(t))


EPOCHS = """WITH p AS (SELECT *, lag(solar_azimuth_deg) OVER w AS az0, lag(solar_elevation_deg) OVER w AS el0, lag(apparent_brightness) OVER w AS br0,
    lag(feature_diameter_m) OVER w AS di0, lag(notes) OVER w AS no0, lag(epoch_id) OVER w AS id0 FROM v_epoch WINDOW w AS (PARTITION BY entity_id ORDER BY ts, epoch_id)),
  s AS (SELECT entity_id, ts, epoch_id, id0, CASE WHEN abs(az0 - solar_azimuth_deg) % 360 > 180 THEN 360 - abs(az0 - solar_azimuth_deg) % 360
      ELSE abs(az0 - solar_azimuth_deg) % 360 END AS azimuth_shift, abs(el0 - solar_elevation_deg) AS elevation_shift,
    abs(br0 - apparent_brightness) AS brightness_shift, abs(di0 - feature_diameter_m) AS diameter_shift,
    id0 IS NOT NULL AND (coalesce(contains(no0, 'CONTRADICTED'), false) OR coalesce(contains(notes, 'CONTRADICTED'), false)) AS contradicted FROM p),
  f AS (SELECT *, coalesce(azimuth_shift > 10, false) OR coalesce(elevation_shift > 5, false) OR coalesce(brightness_shift > 0.15, false) AS illumination_shift,
    coalesce(diameter_shift > 3, false) AS geometric_shift FROM s)"""
SHIFTS = ["azimuth_shift", "elevation_shift", "brightness_shift", "diameter_shift"]


@query(EPOCHS + f" SELECT entity_id, epoch_id, {', '.join(SHIFTS)}, illumination_shift, geometric_shift, contradicted FROM f",
       {c: 6 for c in SHIFTS})
def w01_epoch_differences(t: Tables):
    return W.epoch_differences(t.epoch).select("entity_id", "epoch_id", *SHIFTS, "illumination_shift", "geometric_shift", "contradicted")


@query(EPOCHS + """ SELECT entity_id, epoch_id, unnest(list_filter([
    CASE WHEN azimuth_shift > 10 THEN 'Solar azimuth shifted by ' || printf('%.1f', azimuth_shift) || '° between ' || id0 || ' and ' || epoch_id || '.' END,
    CASE WHEN elevation_shift > 5 THEN 'Solar elevation shifted by ' || printf('%.1f', elevation_shift) || '° between ' || id0 || ' and ' || epoch_id || '.' END,
    CASE WHEN brightness_shift > 0.15 THEN 'Apparent pixel brightness shifted by ' || printf('%.2f', brightness_shift) || '.' END,
    CASE WHEN diameter_shift > 3 THEN 'Physical diameter shifted by ' || printf('%.1f', diameter_shift) || 'm (exceeds 3.0m tolerance).' END],
    lambda x: x IS NOT NULL)) AS difference FROM f""")
def w01_difference_texts(t: Tables):
    return W.difference_texts(W.epoch_differences(t.epoch)).drop("ts")


@query(EPOCHS + """, g AS (SELECT entity_id, count(*) AS epoch_count, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS days,
    bool_or(illumination_shift) AS il, bool_or(geometric_shift) AS ge, bool_or(contradicted) AS co FROM f GROUP BY entity_id)
  SELECT entity_id, CASE WHEN epoch_count < 2 THEN 'INSUFFICIENT_TEMPORAL_EVIDENCE' WHEN co THEN 'CHANGE_CONTRADICTED' WHEN ge AND NOT il THEN 'CHANGE_SUPPORTED'
    WHEN ge AND il THEN 'POSSIBLE_CHANGE' ELSE 'STABLE' END AS temporal_state, epoch_count, CASE WHEN epoch_count < 2 THEN 0.0 ELSE days END AS time_span_days,
    epoch_count >= 2 AND NOT co AND ge AND NOT il AS physical_change_supported FROM g""", {"time_span_days": 2})
def d12_temporal_state(t: Tables):
    return W.temporal_states(t.epoch).drop("explanation")


@query("SELECT entity_id, acquisition_time, observation_id, sensor FROM v_association WHERE status = 'SUPPORTED'")
def d21_entity_timeline(t: Tables):
    return W.entity_timeline(associations(t))


@query("""SELECT entity_id, sensor, count(*) AS observations, min(acquisition_time) AS first_seen, max(acquisition_time) AS last_seen
  FROM v_association WHERE status = 'SUPPORTED' GROUP BY entity_id, sensor""")
def d21_entity_modalities(t: Tables):
    return W.entity_modalities(associations(t))


COMPAT = """SELECT p.id_a, p.id_b, CASE WHEN miss THEN 'UNKNOWN' ELSE a_sensor END AS source_sensor, CASE WHEN miss THEN 'UNKNOWN' ELSE b_sensor END AS target_sensor,
    CASE method WHEN 'SYNTHETIC_BOUNDING_BOX' THEN 'VALIDATED_OVERLAP' WHEN 'CALIBRATED_POLYGON_INTERSECTION' THEN 'VALIDATED_OVERLAP'
      WHEN 'CALIBRATED_GEOMETRY_CHECK' THEN 'INSUFFICIENT_GEOMETRY' WHEN 'CALIBRATED_GROUNDGRID_BOUNDARY_DISTANCE' THEN 'NO_OVERLAP' ELSE 'UNKNOWN' END AS overlap_status,
    method AS evaluation_method, CAST(CASE WHEN method = 'CALIBRATED_GROUNDGRID_BOUNDARY_DISTANCE' THEN gap END AS double) AS separation_distance_m FROM (
  SELECT *, CASE WHEN miss THEN 'REGISTRATION_LOOKUP' WHEN NOT grids AND synth AND overlap THEN 'SYNTHETIC_BOUNDING_BOX' WHEN NOT grids THEN 'CALIBRATED_GEOMETRY_CHECK'
      WHEN gap > 246.4 THEN 'CALIBRATED_GROUNDGRID_BOUNDARY_DISTANCE' WHEN polys AND (NOT {strict} OR overlap) THEN 'CALIBRATED_POLYGON_INTERSECTION' ELSE 'DEFAULT' END AS method FROM (
    SELECT q.id_a, q.id_b, a.sensor AS a_sensor, b.sensor AS b_sensor, a.observation_id IS NULL OR b.observation_id IS NULL AS miss,
      a.has_grid AND b.has_grid AS grids, a.has_polygon AND b.has_polygon AS polys, a.is_synthetic AND b.is_synthetic AS synth,
      greatest(a.lat_min, b.lat_min) < least(a.lat_max, b.lat_max) AND greatest(a.lon_min, b.lon_min) < least(a.lon_max, b.lon_max) AS overlap,
      CASE WHEN q.measured_gap_m IS NOT NULL THEN q.measured_gap_m WHEN NOT {strict} AND ((a.sensor = 'OHRC' AND b.sensor = 'TMC-2') OR (a.sensor = 'TMC-2' AND b.sensor = 'OHRC'))
        THEN 1773.2 END AS gap
    FROM {pairs} q LEFT JOIN v_footprint a ON a.observation_id = q.id_a LEFT JOIN v_footprint b ON b.observation_id = q.id_b)) p"""


@query(COMPAT.format(pairs="v_pair", strict="false"))
def j05_compatibility(t: Tables):
    return W.compatibility(t.pair.select("id_a", "id_b", "measured_gap_m"), t.footprint)


@query(COMPAT.format(pairs="v_pair", strict="true"))
def j05_compatibility_strict(t: Tables):
    return W.compatibility(t.pair.select("id_a", "id_b", "measured_gap_m"), t.footprint, strict=True)


@query("""SELECT sensor, observation_id, acquisition_time FROM v_footprint
  QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY observation_id) = 1""")
def w07_first_per_sensor(t: Tables):
    return W.first_per_sensor(t.footprint).select("sensor", "observation_id", "acquisition_time")


_CELLS = ", ".join(f"max(cell) FILTER (WHERE sensor_b = '{s}') AS \"{s}\"" for s in C.MATRIX_SENSORS)


@query(f"""WITH o AS (SELECT sensor, min(observation_id) AS oid FROM v_footprint GROUP BY sensor),
  q AS (SELECT a.sensor AS sensor_a, b.sensor AS sensor_b, a.oid AS id_a, b.oid AS id_b, CAST(NULL AS double) AS measured_gap_m FROM o a CROSS JOIN o b),
  r AS ({COMPAT.format(pairs='q', strict='false')}),
  x AS (SELECT DISTINCT q.sensor_a, q.sensor_b, CASE WHEN q.sensor_a = q.sensor_b THEN '—' ELSE r.overlap_status END AS cell FROM q JOIN r ON r.id_a = q.id_a AND r.id_b = q.id_b)
  SELECT sensor_a, {_CELLS} FROM x GROUP BY sensor_a""")
def d17_compatibility_matrix(t: Tables):
    return W.compatibility_matrix(t.footprint)


@query("""WITH g AS (SELECT a.observation_id, a.entity_id, a.distance_m, f.gsd_m, floor(sqrt(f.gsd_m * f.gsd_m + 59.0 * 59.0 + 20.0 * 20.0) * 100 + 0.5) / 100 AS hi,
    floor(f.gsd_m * 100 + 0.5) / 100 AS lo FROM v_association a JOIN v_footprint f USING (observation_id))
  SELECT observation_id, entity_id, CASE WHEN gsd_m IS NULL THEN 'UNKNOWN' ELSE 'INTERVAL' END AS geometry_type, lo AS geometry_low, hi AS geometry_high,
    CASE WHEN gsd_m IS NULL THEN 'UNKNOWN' WHEN distance_m > 200 THEN 'QUALITATIVE' ELSE 'INTERVAL' END AS association_type,
    CASE WHEN gsd_m IS NOT NULL AND distance_m > 200 THEN 'REJECTED_OUT_OF_BOUNDS' END AS association_label,
    CASE WHEN distance_m <= 200 THEN floor((hi + distance_m) * 100 + 0.5) / 100 END AS association_high FROM g""")
def d31_uncertainty_propagation(t: Tables):
    a = associations(t).join(t.footprint.select("observation_id", "gsd_m"), "observation_id")
    c = F.col("chain")
    return W.propagate_uncertainty(a, 59.0, 20.0).select(
        "observation_id", "entity_id", c["geometry"]["type"].alias("geometry_type"), F.element_at(c["geometry"]["interval"], 1).alias("geometry_low"),
        F.element_at(c["geometry"]["interval"], 2).alias("geometry_high"), c["association"]["type"].alias("association_type"),
        c["association"]["label"].alias("association_label"), F.element_at(c["association"]["interval"], 2).alias("association_high"))
