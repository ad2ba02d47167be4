"""The typed knowledge graph as two tables: nodes (id, node_type, ...) and edges (src, dst, relation, status, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions.stats import latest
from craterline.functions.text import suffix

EDGE_COLUMNS = ["src", "dst", "relation", "status", "confidence", "method", "provenance", "version"]


def _edges(df: DataFrame, src: Column, dst: Column, relation: Column | str, status: Column | str = "SUPPORTED",
           confidence: Column | None = None, method: str = "DIRECT", provenance: Column | None = None, version: int = 0) -> DataFrame:
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        src.cast("string").alias("src"), dst.cast("string").alias("dst"), text(relation).alias("relation"), text(status).alias("status"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"), F.lit(method).alias("method"),
        (F.lit(None) if provenance is None else provenance).cast("string").alias("provenance"), F.lit(version).alias("version"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def last_write(edges: DataFrame) -> DataFrame:
    """One edge per ordered (src, dst): the last write."""
    return latest(edges, ["src", "dst"], ["version"])


# --- Stored-table graph -------------------------------------------------------
def build_graph(entities: DataFrame, observations: DataFrame, links: DataFrame, correspondences: DataFrame,
                evidence: DataFrame | None = None, hypotheses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of entities, observations, sensors, pair evidence and hypotheses.

    correspondences: correspondence_id, source_observation_id, target_observation_id, status, overall_confidence.
    evidence: correspondence_id, visual_score, total_uncertainty. hypotheses: hypothesis_id, entity_id,
    property_name, hypothesis_value, confidence, uncertainty.
    """
    s = lambda c: F.col(c).cast("string")
    nodes = [
        entities.select(F.col("entity_id").alias("id"), F.lit("LunarEntity").alias("node_type"),
                        F.concat(F.col("entity_id"), F.lit(" ("), F.upper("entity_type"), F.lit(")")).alias("label")),
        observations.select(s("observation_id").alias("id"), F.lit("Observation").alias("node_type"),
                            F.concat(F.col("sensor"), F.lit(" ("), s("observation_id"), F.lit(")")).alias("label")),
        observations.select("sensor").distinct().select(F.concat(F.lit("SENSOR-"), F.col("sensor")).alias("id"), F.lit("Sensor").alias("node_type"),
                                                        F.concat(F.lit("PAYLOAD: "), F.col("sensor")).alias("label")),
    ]
    src, dst = F.col("source_observation_id"), F.col("target_observation_id")
    edges = [
        _edges(observations, F.col("observation_id"), F.concat(F.lit("SENSOR-"), F.col("sensor")), "ACQUIRED_BY", version=0),
        _edges(links, F.col("entity_id"), F.col("observation_id"), "OBSERVED_BY", confidence=F.col("confidence") if "confidence" in links.columns else None, version=1),
        _edges(correspondences, src, dst, "MATCHED_WITH", F.col("status"), F.col("overall_confidence"), version=2),
    ]
    if evidence is not None:
        ev = correspondences.join(evidence, "correspondence_id")
        ev_id = F.concat(F.lit("EV-"), F.col("correspondence_id"))
        nodes.append(ev.select(ev_id.alias("id"), F.lit("PhysicsEvidence").alias("node_type"), F.concat(F.lit("Physics Verification ("), F.col("status"), F.lit(")")).alias("label")))
        edges += [_edges(ev, src, ev_id, "EVALUATED_BY", version=3), _edges(ev, ev_id, dst, "VERIFIES", version=3)]
    if hypotheses is not None:
        hyp_id = F.concat(F.lit("HYP-"), F.col("hypothesis_id"))
        nodes.append(hypotheses.select(hyp_id.alias("id"), F.lit("Hypothesis").alias("node_type"), F.initcap(F.replace("property_name", F.lit("_"), F.lit(" "))).alias("label")))
        edges.append(_edges(hypotheses, F.col("entity_id"), hyp_id, "BELIEVES", confidence=F.col("confidence"), version=4))
    return _union(nodes).dropDuplicates(["id"]), last_write(_union(edges))


# --- World graph --------------------------------------------------------------
def world_graph(entities: DataFrame, observations: DataFrame, associations: DataFrame, evidence: DataFrame | None = None,
                gaps: DataFrame | None = None, recommendations: DataFrame | None = None, hypotheses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed nodes with their attributes and provenance-bearing edges of the entity model."""
    s = lambda c: F.col(c).cast("string")
    kind = lambda k: F.lit(k).alias("node_type")
    nodes = [
        entities.select(F.col("entity_id").alias("id"), kind("ENTITY"), "entity_type", "latitude", "longitude"),
        observations.select(s("observation_id").alias("id"), kind("OBSERVATION"), F.col("sensor").alias("sensor_type"), "is_synthetic"),
    ]
    obs_edge = F.when(F.col("status") == "SUPPORTED", "OBSERVES").otherwise("CONTRADICTED_BY")
    edges = [_edges(associations, F.col("observation_id"), F.col("entity_id"), obs_edge, F.col("status"), provenance=F.col("sensor"), version=0)]
    if evidence is not None:
        nodes.append(evidence.select(F.concat(F.lit("EV-"), s("evidence_id")).alias("id"), kind("EVIDENCE"), "evidence_type", "status"))
        rel = F.when(F.col("status") == "CONTRADICTED", "CONTRADICTED_BY").when(F.col("status") == "SUPPORTED", "SUPPORTED_BY").otherwise("ASSOCIATED_WITH")
        edges.append(_edges(evidence, F.concat(F.lit("EV-"), s("evidence_id")), F.col("entity_id"), rel, F.col("status"), version=1))
    if hypotheses is not None:
        nodes.append(hypotheses.select(F.concat(F.lit("HYP-"), s("hypothesis_id")).alias("id"), kind("HYPOTHESIS"), "property_name", "hypothesis_value"))
        edges.append(_edges(hypotheses, F.col("entity_id"), F.concat(F.lit("HYP-"), s("hypothesis_id")), "HYPOTHESIZES", version=2))
    if gaps is not None:
        gid = lambda: F.concat_ws("|", F.lit("GAP"), F.col("entity_id"), F.col("gap_type"))
        g = gaps.dropDuplicates(["entity_id", "gap_type"])
        nodes.append(g.select(gid().alias("id"), kind("KNOWLEDGE_GAP"), "gap_type", "severity", F.col("status")))
        edges.append(_edges(g, F.col("entity_id"), gid(), "HAS_GAP", "OPEN", version=3))
        if recommendations is not None:
            r = recommendations.dropDuplicates(["recommendation_id"])
            nodes.append(r.select(F.col("recommendation_id").alias("id"), kind("RECOMMENDATION"), "candidate_sensor", "status"))
            edges.append(_edges(r, gid(), F.col("recommendation_id"), "RECOMMENDS", "ACTIVE", version=4))
    return _union(nodes), last_write(_union(edges))


# --- Checks and parts ---------------------------------------------------------
def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose source or target node does not exist, with the missing side."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    side = lambda c, tag: edges.join(ids, F.col(c) == F.col("_id"), "left_anti").select("src", "dst", "relation", F.lit(tag).alias("missing"))
    return side("src", "SOURCE").unionByName(side("dst", "TARGET"))


def unknown_relations(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("relation").isin(C.EDGE_RELATIONS))


def valid_correspondences(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b) joined by a direct supported match edge in either direction.

    A common entity never counts: reaching one observation from another is not a match.
    """
    ok = edges.filter((F.col("relation") == "MATCHED_WITH") & (F.col("status") == "SUPPORTED"))
    both = ok.select(F.col("src").alias("_a"), F.col("dst").alias("_b")).unionByName(ok.select(F.col("dst").alias("_a"), F.col("src").alias("_b")))
    return pairs.join(both, (pairs["id_a"].cast("string") == both["_a"]) & (pairs["id_b"].cast("string") == both["_b"]), "left_semi")


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges within one hop of the given ids."""
    i = ids.select(F.col("id").alias("_id")).distinct()
    out = edges.join(i, edges["src"] == i["_id"], "left_semi")
    into = edges.join(i, edges["dst"] == i["_id"], "left_semi").join(i, edges["src"] == i["_id"], "left_anti")
    return out.unionByName(into)


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("nodes"))


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("id")


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "dst")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, keys in column order."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def from_json(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def link_id(entity: Column, observation: Column) -> Column:
    return F.concat(F.lit("EO-"), suffix(entity, 5), F.lit("-"), observation.cast("string"))
