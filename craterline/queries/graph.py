"""Queries over the knowledge graph, entity resolution and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions.stage import shared_folder
from craterline.operators import graph as R
from craterline.operators import resolve as E
from craterline.plans import explain as X
from craterline.plans import world_build as B
from craterline.queries.gaps import GAPS, detected
from craterline.queries.registry import Tables, query
from craterline.queries.world import associations
from craterline.operators import gaps as G
from craterline.sources import sinks

CORR = "SELECT 'CORR-' || id_a || '-' || id_b AS correspondence_id, id_a, id_b, CASE WHEN id_a % 3 = 0 THEN 'SUPPORTED' WHEN id_a % 3 = 1 THEN 'VERIFIED' ELSE 'REJECTED' END AS status FROM v_pair GROUP BY id_a, id_b"


def correspondences(t: Tables):
    p = t.pair.select("id_a", "id_b").distinct()
    m = F.col("id_a") % 3
    return p.select(F.concat_ws("-", F.lit("CORR"), F.col("id_a").cast("string"), F.col("id_b").cast("string")).alias("correspondence_id"),
                    F.col("id_a").alias("source_observation_id"), F.col("id_b").alias("target_observation_id"),
                    F.when(m == 0, "SUPPORTED").when(m == 1, "VERIFIED").otherwise("REJECTED").alias("status"), F.lit(0.8).alias("overall_confidence"))


def stored_graph(t: Tables):
    c = correspondences(t)
    ev = c.filter(F.col("source_observation_id") % 2 == 0).select("correspondence_id", F.lit(0.5).alias("visual_score"), F.lit(0.2).alias("total_uncertainty"))
    links = associations(t).filter("status = 'SUPPORTED'")
    return R.build_graph(t.entity, t.observation, links, c, ev, E.initial_hypotheses(t.entity))


_TPL = ", ".join(f"('{n}', '{p}')" for n, p, *_ in C.HYPOTHESIS_TEMPLATES)
GRAPH = f"""c AS ({CORR}), hy AS (SELECT entity_id || '-' || n AS hypothesis_id, entity_id, p FROM v_entity, (VALUES {_TPL}) q(n, p)),
  nd AS (SELECT entity_id AS id, 'LunarEntity' AS node_type FROM v_entity UNION ALL SELECT CAST(observation_id AS string), 'Observation' FROM v_observation
    UNION ALL SELECT DISTINCT 'SENSOR-' || sensor, 'Sensor' FROM v_observation UNION ALL SELECT 'EV-' || correspondence_id, 'PhysicsEvidence' FROM c WHERE id_a % 2 = 0
    UNION ALL SELECT DISTINCT 'HYP-' || hypothesis_id, 'Hypothesis' FROM hy),
  ea AS (SELECT CAST(observation_id AS string) AS src, 'SENSOR-' || sensor AS dst, 'ACQUIRED_BY' AS relation, 'SUPPORTED' AS status, 0 AS v FROM v_observation
    UNION ALL SELECT entity_id, CAST(observation_id AS string), 'OBSERVED_BY', 'SUPPORTED', 1 FROM v_association WHERE status = 'SUPPORTED'
    UNION ALL SELECT CAST(id_a AS string), CAST(id_b AS string), 'MATCHED_WITH', status, 2 FROM c
    UNION ALL SELECT CAST(id_a AS string), 'EV-' || correspondence_id, 'EVALUATED_BY', 'SUPPORTED', 3 FROM c WHERE id_a % 2 = 0
    UNION ALL SELECT 'EV-' || correspondence_id, CAST(id_b AS string), 'VERIFIES', 'SUPPORTED', 3 FROM c WHERE id_a % 2 = 0
    UNION ALL SELECT entity_id, 'HYP-' || hypothesis_id, 'BELIEVES', 'SUPPORTED', 4 FROM hy),
  ed AS (SELECT src, dst, relation, status FROM ea QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY v DESC, relation DESC) = 1)"""


@query(f"WITH {GRAPH} SELECT id, node_type FROM nd")
def d18_graph_nodes(t: Tables):
    return stored_graph(t)[0].select("id", "node_type")


@query(f"WITH {GRAPH} SELECT * FROM ed")
def d18_graph_edges(t: Tables):
    return stored_graph(t)[1].select("src", "dst", "relation", "status")


@query(f"WITH {GRAPH} SELECT node_type, count(*) AS nodes FROM nd GROUP BY node_type")
def a26_node_counts(t: Tables):
    return R.node_counts(stored_graph(t)[0])


@query(f"""WITH {GRAPH} SELECT src, dst, relation, 'SOURCE' AS missing FROM ed WHERE src NOT IN (SELECT id FROM nd)
  UNION ALL SELECT src, dst, relation, 'TARGET' FROM ed WHERE dst NOT IN (SELECT id FROM nd)""")
def j17_dangling_edges(t: Tables):
    return R.dangling_edges(*stored_graph(t))


@query(f"""WITH {GRAPH} SELECT p.pair_no, p.id_a, p.id_b FROM v_pair p WHERE EXISTS (SELECT 1 FROM ed WHERE relation = 'MATCHED_WITH' AND status = 'SUPPORTED'
    AND src = CAST(p.id_b AS string) AND dst = CAST(p.id_a AS string)) OR EXISTS (SELECT 1 FROM ed WHERE relation = 'MATCHED_WITH' AND status = 'SUPPORTED' AND src = CAST(p.id_a AS string) AND dst = CAST(p.id_b AS string))""")
def j16_valid_correspondences(t: Tables):
    return R.valid_correspondences(t.pair.select("pair_no", "id_a", "id_b"), stored_graph(t)[1])


@query(f"WITH {GRAPH}, i AS (SELECT entity_id AS id FROM v_entity WHERE entity_type = 'ridge') SELECT * FROM ed WHERE src IN (SELECT id FROM i) OR dst IN (SELECT id FROM i)")
def j20_subgraph(t: Tables):
    ids = t.entity.filter("entity_type = 'ridge'").select(F.col("entity_id").alias("id"))
    return R.subgraph(stored_graph(t)[1], ids).select("src", "dst", "relation", "status")


@query(f"WITH {GRAPH} SELECT src, dst, relation FROM ed ORDER BY src, dst")
def o01_ordered_edges(t: Tables):
    return R.ordered_edges(stored_graph(t)[1]).select("src", "dst", "relation")


@query(f"WITH {GRAPH} SELECT id, node_type FROM nd")
def s14_graph_json_round_trip(t: Tables):
    lines = R.as_json(R.ordered_nodes(stored_graph(t)[0].select("id", "node_type")))
    return R.from_json(lines, "id string, node_type string")


WORLD = f"""{GAPS}, ga AS (SELECT DISTINCT entity_id, gap_type FROM gaps),
  we AS (SELECT CAST(observation_id AS string) AS src, entity_id AS dst, CASE WHEN status = 'SUPPORTED' THEN 'OBSERVES' ELSE 'CONTRADICTED_BY' END AS relation, status FROM v_association
    UNION ALL SELECT DISTINCT 'EV-' || evidence_id, entity_id, CASE status WHEN 'CONTRADICTED' THEN 'CONTRADICTED_BY' WHEN 'SUPPORTED' THEN 'SUPPORTED_BY' ELSE 'ASSOCIATED_WITH' END, status FROM
      (SELECT *, row_number() OVER (PARTITION BY evidence_id, entity_id ORDER BY CASE status WHEN 'CONTRADICTED' THEN 'CONTRADICTED_BY' WHEN 'SUPPORTED' THEN 'SUPPORTED_BY' ELSE 'ASSOCIATED_WITH' END DESC, status DESC) AS rn FROM v_evidence) WHERE rn = 1
    UNION ALL SELECT entity_id, 'GAP|' || entity_id || '|' || gap_type, 'HAS_GAP', 'OPEN' FROM ga)"""


@query(f"WITH {WORLD} SELECT relation, status, count(*) AS edges FROM we GROUP BY relation, status")
def d19_world_graph(t: Tables):
    g = detected(t)
    _, edges = R.world_graph(t.entity, t.observation, associations(t), t.evidence, g)
    return edges.groupBy("relation", "status").agg(F.count("*").alias("edges"))


# --- Resolution ---------------------------------------------------------------
def arrivals(t: Tables):
    """Every observation as a point, in key order, on a coarse field so that many fall together."""
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("point"), (F.col("o_custkey") % 97 / 400.0).alias("lat"), (k * 7 % 89 / 400.0).alias("lon"))


@query()
def d22_resolve_entities(t: Tables):
    known = t.entity.select("entity_id", (F.col("ekey") % 31 / 130.0).alias("latitude"), (F.col("ekey") % 29 / 130.0).alias("longitude"))
    return E.resolve_entities(arrivals(t), known, "point", "point").select("point", "entity_id", "is_new")


@query(f"SELECT entity_id || '-' || n AS hypothesis_id, entity_id, p AS property_name FROM v_entity, (VALUES {_TPL}) q(n, p)")
def d22_initial_hypotheses(t: Tables):
    return E.initial_hypotheses(t.entity).select("hypothesis_id", "entity_id", "property_name")


# --- Stored tables ------------------------------------------------------------
@query("SELECT entity_id, observation_id, sensor FROM v_association WHERE observation_id % 3 <> 0 AND status = 'SUPPORTED'")
def s15_insert_if_absent(t: Tables):
    a = associations(t).filter("status = 'SUPPORTED'").select("entity_id", "observation_id", "sensor")
    return sinks.insert_if_absent(a, a.filter("observation_id % 3 = 0"), ["entity_id", "observation_id"])


@query("""SELECT entity_id, observation_id, version, status FROM v_report QUALIFY row_number() OVER (PARTITION BY entity_id, observation_id ORDER BY version DESC) = 1""")
def s16_upsert(t: Tables):
    r = t.report.select("entity_id", "observation_id", "version", "status")
    return sinks.upsert(r.filter("version % 2 = 0"), r.filter("version % 2 = 1"), ["entity_id", "observation_id"], "version")


@query("""SELECT entity_id, observation_id, version, status FROM v_report QUALIFY row_number() OVER (PARTITION BY entity_id, observation_id ORDER BY version DESC) = 1""")
def s16_upsert_in_buckets(t: Tables):
    """The same updates to a stored table, in three batches, each of which rewrites the buckets it touches."""
    r = t.report.select("entity_id", "observation_id", "version", "status")
    stored = sinks.BucketTable(t.spark, f"{shared_folder(t.spark)}/reports-{uuid.uuid4().hex}", "entity_id string, observation_id bigint, version bigint, status string",
                               ["entity_id", "observation_id"], "version", buckets=8)
    for k in range(3):
        stored.update(r.filter(F.col("version") % 3 == k))
    return stored.rows()


@query("SELECT entity_id, entity_type, latitude, longitude FROM v_entity WHERE entity_id = (SELECT max(entity_id) FROM v_entity)")
def p05_point_lookup(t: Tables):
    from craterline.operators.joins import lookup
    return lookup(t.entity.select("entity_id", "entity_type", "latitude", "longitude"), "entity_id", t.entity.agg(F.max("entity_id")).first()[0])


@query("""SELECT e.entity_id, count(a.observation_id) AS observations, count(DISTINCT a.sensor) AS sensors, 3 AS hypotheses FROM v_entity e
  LEFT JOIN v_association a ON a.entity_id = e.entity_id AND a.status = 'SUPPORTED' GROUP BY e.entity_id""")
def j14_entity_detail(t: Tables):
    links = associations(t).filter("status = 'SUPPORTED'").groupBy("entity_id").agg(F.count("*").alias("observations"), F.count_distinct("sensor").alias("sensors"))
    hyps = E.initial_hypotheses(t.entity).groupBy("entity_id").agg(F.count("*").cast("int").alias("hypotheses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return t.entity.select("entity_id").join(links, "entity_id", "left").join(hyps, "entity_id", "left").select("entity_id", zero("observations"), zero("sensors"), "hypotheses")


# --- Cards and loop -----------------------------------------------------------
CARD = f"""{GAPS}, ds AS (SELECT entity_id, evidence_type, CASE WHEN bool_or(status = 'CONTRADICTED') THEN 'CONTRADICTED' WHEN bool_or(status = 'REJECTED') AND NOT bool_or(status = 'SUPPORTED') THEN 'REJECTED'
    WHEN bool_or(status = 'SUPPORTED') THEN 'SUPPORTED' ELSE 'x' END AS st FROM v_evidence WHERE evidence_type IN ('GEOMETRIC', 'TERRAIN', 'ILLUMINATION', 'SPECTRAL', 'TEMPORAL') GROUP BY entity_id, evidence_type),
  li AS (SELECT entity_id, 'HEADER' AS section FROM v_entity UNION ALL SELECT entity_id, 'UNKNOWN EVIDENCE' FROM v_entity UNION ALL SELECT entity_id, 'UNCERTAINTY' FROM v_entity
    UNION ALL SELECT v.entity_id, CASE v.status WHEN 'SUPPORTED' THEN 'SUPPORTED EVIDENCE' ELSE 'CONTRADICTING EVIDENCE' END FROM v_evidence v JOIN ds ON ds.entity_id = v.entity_id AND ds.evidence_type = v.evidence_type AND ds.st = v.status WHERE v.status IN ('SUPPORTED', 'CONTRADICTED')
    UNION ALL SELECT entity_id, 'BLOCKED FACTORS' FROM v_association WHERE status = 'REJECTED' UNION ALL SELECT entity_id, 'ACTIVE KNOWLEDGE GAPS' FROM gaps
    UNION ALL SELECT entity_id, 'NEXT-BEST OBSERVATIONS' FROM gaps WHERE gap_type IN ('FOOTPRINT_NON_OVERLAP', 'MISSING_SPECTRAL_VALIDATION', 'MISSING_TERRAIN_VALIDATION', 'MISSING_TEMPORAL_OBSERVATION', 'UNCERTAINTY_TOO_HIGH'))"""


@query(f"WITH {CARD} SELECT entity_id, section, count(*) AS lines FROM li GROUP BY entity_id, section")
def d20_explain_entities(t: Tables):
    g = detected(t)
    return X.card_counts(X.explain_entities(t.entity, associations(t), t.evidence, g, G.recommend_for_gaps(g)))


@query("""SELECT entity_id, 'Entity Type: ' || upper(entity_type) || ' | Coordinates: Lat ' || printf('%.4f', latitude) || '° N, Lon ' || printf('%.4f', longitude) || '° E, Elev '
  || coalesce(printf('%.1f', elevation_m), 'UNCONSTRAINED') || 'm' AS head, 'Localization spatial bound ~' || printf('%.2f', uncertainty_m) || 'm; regional DEM resolution limit 59.2m' AS bound FROM v_entity""")
def d20_card_header(t: Tables):
    g = detected(t)
    card = X.explain_entities(t.entity, associations(t), t.evidence, g, G.recommend_for_gaps(g))
    one = card.filter("section in ('HEADER', 'UNCERTAINTY')").groupBy("entity_id").agg(
        F.max(F.when(F.col("section") == "HEADER", F.regexp_replace("line", r" \| Lifecycle State: .*", ""))).alias("head"), F.max(F.when(F.col("section") == "UNCERTAINTY", F.col("line"))).alias("bound"))
    return one


def followups(t: Tables):
    """A sounding of every entity at its own position."""
    return t.entity.select("entity_id", (F.lit(10_000_000) + F.col("ekey")).alias("observation_id"), F.lit("SLDEM2015").alias("sensor"), F.col("latitude").alias("obs_lat"), F.col("longitude").alias("obs_lon"),
                           F.lit("2031-01-01").cast("timestamp_ntz").alias("acquisition_time"), (F.lit(10_000_000_000) + F.col("ekey")).alias("evidence_id"), F.lit("TERRAIN").alias("evidence_type"), F.lit(-1892.4).alias("measured_elevation_m"))


def world(t: Tables):
    return B.build_world(t.entity, t.observation, t.evidence)


@query(f"""WITH {GAPS} SELECT gap_type, CASE WHEN gap_type = 'MISSING_TERRAIN_VALIDATION' THEN 'RESOLVED' ELSE 'OPEN' END AS status, count(*) AS gaps FROM gaps GROUP BY gap_type""")
def d29_active_loop_step(t: Tables):
    return B.apply_followups(world(t), followups(t)).gaps.groupBy("gap_type", "status").agg(F.count("*").alias("gaps"))


@query("""WITH a AS (SELECT entity_id, sensor, status FROM v_association UNION ALL SELECT entity_id, 'SLDEM2015', 'SUPPORTED' FROM v_entity),
  l1 AS (SELECT * FROM v_evidence QUALIFY row_number() OVER (PARTITION BY entity_id, evidence_id ORDER BY updated_at DESC, observation_id DESC NULLS LAST, evidence_type DESC, status DESC) = 1),
  l2 AS (SELECT entity_id, status FROM l1 WHERE observation_id IS NULL UNION ALL SELECT entity_id, status FROM (SELECT * FROM l1 WHERE observation_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY entity_id, evidence_type, observation_id ORDER BY updated_at DESC, evidence_id DESC) = 1)),
  b AS (SELECT entity_id, bool_or(status = 'CONTRADICTED') AS bad FROM l2 GROUP BY entity_id),
  n AS (SELECT entity_id, count(*) FILTER (WHERE status = 'SUPPORTED') AS s, count(DISTINCT sensor) FILTER (WHERE status = 'SUPPORTED') AS k FROM a GROUP BY entity_id)
  SELECT n.entity_id, CASE WHEN coalesce(bad, false) THEN 'CONTRADICTED' WHEN s = 1 THEN 'SUPPORTED' WHEN k >= 2 THEN 'CONFIRMED' ELSE 'SUPPORTED' END AS state FROM n LEFT JOIN b USING (entity_id)""")
def d29_state_after_followup(t: Tables):
    return B.apply_followups(world(t), followups(t)).states().select("entity_id", "state")


@query(f"""WITH {GAPS}, s AS (SELECT entity_id, count(*) FILTER (WHERE status = 'SUPPORTED') AS supported FROM v_association GROUP BY entity_id),
  g AS (SELECT entity_id, count(*) AS gaps, count(*) FILTER (WHERE gap_type IN ('FOOTPRINT_NON_OVERLAP', 'MISSING_SPECTRAL_VALIDATION', 'MISSING_TERRAIN_VALIDATION', 'MISSING_TEMPORAL_OBSERVATION', 'UNCERTAINTY_TOO_HIGH')) AS recommendations FROM gaps GROUP BY entity_id)
  SELECT e.entity_id, coalesce(supported, 0) AS supported, coalesce(gaps, 0) AS gaps, coalesce(recommendations, 0) AS recommendations FROM v_entity e LEFT JOIN s USING (entity_id) LEFT JOIN g USING (entity_id)""")
def d30_world_model_build(t: Tables):
    w = world(t)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    s = w.states().select("entity_id", "supported")
    g = w.gaps.groupBy("entity_id").agg(F.count("*").alias("gaps"))
    r = w.recommendations.groupBy("entity_id").agg(F.count("*").alias("recommendations"))
    return s.join(g, "entity_id", "left").join(r, "entity_id", "left").select("entity_id", zero("supported"), zero("gaps"), zero("recommendations"))


@query(f"""WITH {GRAPH}, l AS (SELECT entity_id, observation_id FROM v_association WHERE status = 'SUPPORTED')
  SELECT DISTINCT p.id_a, p.id_b FROM (SELECT l_orderkey AS id_a, l_partkey AS id_b FROM lineitem) p JOIN l a ON a.observation_id = p.id_a JOIN l b ON b.observation_id = p.id_b AND b.entity_id = a.entity_id
  WHERE NOT EXISTS (SELECT 1 FROM ed WHERE relation = 'MATCHED_WITH' AND status = 'SUPPORTED' AND ((src = CAST(p.id_a AS string) AND dst = CAST(p.id_b AS string)) OR (src = CAST(p.id_b AS string) AND dst = CAST(p.id_a AS string))))""")
def d30_shared_entity_without_match(t: Tables):
    pairs = t.lineitem.select(F.col("l_orderkey").alias("id_a"), F.col("l_partkey").alias("id_b"))
    return B.shared_entity_pairs_without_match(world(t), pairs, stored_graph(t)[1])
