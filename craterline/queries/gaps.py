"""Queries over knowledge gaps and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from craterline import constants as C
from craterline.operators import gaps as G
from craterline.operators import world as W
from craterline.queries.registry import Tables, query
from craterline.queries.world import associations


def _gap(kind: str, cond: str, current: str) -> str:
    severity, tag, _, _ = C.GAP_TEXT[kind]
    return f"SELECT entity_id, '{kind}' AS gap_type, '{severity}' AS severity, '{tag}' AS tag, {current} AS current_evidence FROM n WHERE {cond}"


GAPS = """n AS (SELECT e.entity_id, e.elevation_m, e.uncertainty_m, coalesce(a.n_all, 0) AS n_all, coalesce(a.n_supported, 0) AS n_supported,
    coalesce(a.n_supported, 0) AS n_temporal, coalesce(a.sensors, []) AS sensors, coalesce(v.sp, false) AS sp, coalesce(v.te, false) AS te, coalesce(v.ge, false) AS ge
  FROM v_entity e LEFT JOIN (SELECT entity_id, count(*) AS n_all, count(*) FILTER (WHERE status = 'SUPPORTED') AS n_supported,
      list_sort(list_distinct(list(sensor) FILTER (WHERE status = 'SUPPORTED'))) AS sensors FROM v_association GROUP BY entity_id) a USING (entity_id)
  LEFT JOIN (SELECT entity_id, bool_or(evidence_type = 'SPECTRAL') AS sp, bool_or(evidence_type = 'TERRAIN') AS te, bool_or(evidence_type = 'GEOMETRIC') AS ge
      FROM v_evidence WHERE status = 'SUPPORTED' GROUP BY entity_id) v USING (entity_id)),
  gaps AS (""" + " UNION ALL ".join([
    _gap("MISSING_SPECTRAL_VALIDATION", "NOT sp AND NOT list_contains(sensors, 'IIRS')", "array_to_string(sensors, ', ')"),
    _gap("MISSING_TERRAIN_VALIDATION", "NOT te AND elevation_m IS NULL", "array_to_string(sensors, ', ')"),
    _gap("MISSING_TEMPORAL_OBSERVATION", "n_temporal < 2", "CAST(n_temporal AS string) || ' observation(s) recorded'"),
    _gap("UNCERTAINTY_TOO_HIGH", "uncertainty_m > 50", "'Current uncertainty: ' || printf('%.1f', uncertainty_m) || 'm'"),
    _gap("INSUFFICIENT_CORRESPONDENCE", "n_all = 1 AND n_supported = 1", "'Single sensor: ' || array_to_string(sensors, ', ')"),
    _gap("MISSING_GEOMETRIC_VALIDATION", "NOT ge", "NULL"),
    _gap("MISSING_MODALITY", "NOT sp", "NULL"),
    "SELECT entity_id, 'FOOTPRINT_NON_OVERLAP', 'HIGH', 'NONOVERLAP', 'Footprints disjoint; rejection reason: SPATIAL_DISTANCE_EXCEEDS_TOLERANCE: '"
    " || printf('%.1f', distance_m) || 'm > 200.0m' FROM v_association WHERE status = 'REJECTED'",
]) + ")"


def detected(t: Tables):
    a = associations(t)
    return G.detect_gaps(t.entity, a, t.evidence, W.blocking_factors(a))


@query(f"""WITH {GAPS} SELECT 'GAP-' || right(entity_id, 6) || '-' || tag AS gap_id, entity_id, gap_type, severity, current_evidence, 'OPEN' AS status FROM gaps""")
def d13_detect_gaps(t: Tables):
    return detected(t).select("gap_id", "entity_id", "gap_type", "severity", "current_evidence", "status")


@query(f"WITH {GAPS} SELECT gap_type, count(*) AS gaps FROM gaps GROUP BY gap_type")
def a27_gap_counts(t: Tables):
    return G.gap_counts(detected(t))


LINKS = """m AS (SELECT e.entity_id, count(a.observation_id) AS n, count(*) FILTER (WHERE a.sensor = 'IIRS') AS ii, count(*) FILTER (WHERE a.sensor = 'TMC-2') AS tm
  FROM v_entity e LEFT JOIN v_association a ON a.entity_id = e.entity_id AND a.status = 'SUPPORTED' GROUP BY e.entity_id)"""


def links(t: Tables):
    return associations(t).filter("status = 'SUPPORTED'")


def _service(n: int, cond: str) -> str:
    kind, sev, tag, sensor, _ = C.SERVICE_GAPS[n]
    return (f"SELECT 'GAP-' || right(entity_id, 5) || '-{tag}' AS gap_id, entity_id, '{kind}' AS gap_type, '{sev}' AS severity, "
            f"'{sensor}' AS recommended_sensor FROM m WHERE {cond}")


SERVICE = f"WITH {LINKS} " + " UNION ALL ".join([_service(0, "ii = 0"), _service(1, "n < 2"), _service(2, "tm = 0")])


@query(SERVICE)
def d14_scan_service_gaps(t: Tables):
    return G.scan_service_gaps(t.entity, links(t)).select("gap_id", "entity_id", "gap_type", "severity", "recommended_sensor")


@query("""SELECT entity_id FROM v_entity e WHERE NOT EXISTS (SELECT 1 FROM v_association a WHERE a.entity_id = e.entity_id AND a.status = 'SUPPORTED' AND a.sensor = 'IIRS')""")
def j15_entities_without_sensor(t: Tables):
    return G.without_sensor(t.entity, links(t), "IIRS").select("entity_id")


@query(f"""SELECT * FROM ({SERVICE}) g WHERE NOT (gap_type = 'HIGH_ILLUMINATION_UNCERTAINTY' AND CAST(right(entity_id, 6) AS bigint) % 2 = 0)""")
def j15_gaps_not_present(t: Tables):
    stored = t.entity.filter("ekey % 2 = 0").select("entity_id", F.lit("HIGH_ILLUMINATION_UNCERTAINTY").alias("gap_type"))
    found = G.scan_service_gaps(t.entity, links(t)).select("gap_id", "entity_id", "gap_type", "severity", "recommended_sensor")
    return G.not_present(found, stored).select(found.columns)


_RULES = ", ".join(f"('{g}', '{s}', '{e}', '{p}', '{b}')" for g, s, e, p, _, _, b in C.GAP_SENSOR_RULES)


@query(f"""WITH {GAPS}, r(gap_type, candidate_sensor, expected_evidence_type, potential, basis) AS (VALUES {_RULES})
  SELECT entity_id, gap_type, candidate_sensor, expected_evidence_type, potential, basis,
    CASE WHEN candidate_sensor IN ('OHRC', 'TMC-2') THEN 'FEASIBLE' ELSE 'PAYLOAD_UNAVAILABLE' END AS feasibility FROM gaps JOIN r USING (gap_type)""")
def d15_recommend_for_gaps(t: Tables):
    return G.recommend_for_gaps(detected(t), ["OHRC", "TMC-2"]).select(
        "entity_id", "gap_type", "candidate_sensor", "expected_evidence_type", "potential", "basis", "feasibility")


def _ranked(question: str) -> str:
    rows = ", ".join(f"({n}, '{s}', {q}, {f}, '{b}', {v})" for n, ((s, q, f, b, _), v) in enumerate(zip(
        C.RANKED_SENSORS, C.RELEVANCE.get(question, (C.UNKNOWN_QUESTION_RELEVANCE,) * 3))))
    return f"""s(ord, sensor, quality, feasibility, band, relevance) AS (SELECT col0, col1, CAST(col2 AS double), CAST(col3 AS double), col4, CAST(col5 AS double) FROM (VALUES {rows})),
  g AS (SELECT e.entity_id, s.*, x.sensor IS NOT NULL AS seen, floor(greatest(e.uncertainty, 0.25::double) * relevance * (CASE WHEN x.sensor IS NULL THEN 1.0::double ELSE 0.45::double END)
      * quality * feasibility * 10000 + 0.5) / 10000 AS gain FROM v_entity e CROSS JOIN s
    LEFT JOIN (SELECT DISTINCT entity_id, sensor FROM v_association WHERE status = 'SUPPORTED') x ON x.entity_id = e.entity_id AND x.sensor = s.sensor),
  k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY gain DESC, ord) AS rank, floor(gain * 0.42::double * 1000 + 0.5) / 1000 AS cut FROM g)"""


@query(f"""WITH {_ranked('spectral analysis')} SELECT entity_id, CAST(rank AS integer) AS rank, sensor, gain AS expected_information_gain, cut AS uncertainty_reduction,
  NOT seen AS is_new_modality, CASE WHEN seen THEN 'Secondary priority: Repeated observation at orthogonal solar azimuth will refine existing measurements.'
  ELSE 'High priority: Entity lacks ' || band || ' data. POTENTIALLY_REDUCES_UNCERTAINTY: May reduce spectral analysis epistemic uncertainty by up to ' || printf('%.1f', cut * 100) || '%.' END AS explanation FROM k""")
def d16_rank_next_observation(t: Tables):
    return G.rank_sensors(t.entity, links(t)).select(
        "entity_id", "rank", "sensor", "expected_information_gain", "uncertainty_reduction", "is_new_modality", "explanation")


@query(f"""WITH {_ranked('albedo survey')} SELECT 'REC-' || entity_id || '-' || sensor AS recommendation_id, entity_id, sensor AS recommended_sensor,
  gain AS expected_information_gain, feasibility, 'AVAILABLE' AS payload_status FROM k WHERE rank = 1""")
def o03_top_recommendation(t: Tables):
    q = "albedo survey"
    return G.top_recommendation(G.rank_sensors(t.entity, links(t), q), q).select(
        "recommendation_id", "entity_id", "recommended_sensor", "expected_information_gain", "feasibility", "payload_status")


@query("""SELECT 'REC-' || entity_id || '-UNAVAILABLE' AS recommendation_id, entity_id, 'NONE' AS recommended_sensor, 'PAYLOAD_UNAVAILABLE' AS payload_status
  FROM v_entity WHERE entity_type = 'ridge'""")
def d16_unavailable_payload(t: Tables):
    asks = t.entity.select("entity_id", F.when(F.col("entity_type") == "ridge", "Spectrometer OFFLINE sounding").otherwise("boulder hazard").alias("scientific_question"))
    return G.unavailable_recommendation(asks).select("recommendation_id", "entity_id", "recommended_sensor", "payload_status")


EXPECTED = "SELECT entity_id, CASE ekey % 3 WHEN 0 THEN 'MISSING_TERRAIN_VALIDATION' WHEN 1 THEN 'UNCERTAINTY_TOO_HIGH' ELSE 'MISSING_SPECTRAL_VALIDATION' END AS target_gap_type FROM v_entity"
SCENARIOS = f"""{GAPS}, x AS ({EXPECTED}), sc AS (SELECT x.entity_id, x.target_gap_type, count(g.entity_id) AS detected_count,
  coalesce(bool_or(g.gap_type = x.target_gap_type), false) AS passed FROM x LEFT JOIN gaps g ON g.entity_id = x.entity_id GROUP BY x.entity_id, x.target_gap_type)"""


def scenarios(t: Tables):
    kind = F.when(F.col("ekey") % 3 == 0, "MISSING_TERRAIN_VALIDATION").when(F.col("ekey") % 3 == 1, "UNCERTAINTY_TOO_HIGH").otherwise("MISSING_SPECTRAL_VALIDATION")
    return G.benchmark_gaps(detected(t), t.entity.select("entity_id", kind.alias("target_gap_type")))


@query(f"WITH {SCENARIOS} SELECT * FROM sc")
def d28_gap_benchmark(t: Tables):
    return scenarios(t)


@query(f"""WITH {SCENARIOS} SELECT count(*) AS total_scenarios, count(*) FILTER (WHERE passed) AS passed_scenarios,
  count(*) FILTER (WHERE passed) / count(*) AS pass_rate, bool_and(passed) AS all_passed FROM sc""", {"pass_rate": 6})
def a21_gap_benchmark_summary(t: Tables):
    return G.benchmark_summary(scenarios(t))
