"""Build the entity model from tables, and move it forward by follow-up observations."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterline.operators import gaps as G
from craterline.operators import graph as R
from craterline.operators import world as W
from craterline.sources.sinks import upsert


@dataclass(frozen=True)
class World:
    """Tables of the entity model. Gaps and recommendations are derived from the first three."""
    entities: DataFrame
    associations: DataFrame
    evidence: DataFrame
    gaps: DataFrame
    recommendations: DataFrame

    def states(self) -> DataFrame:
        return W.lifecycle(self.associations, self.evidence, self.entities)


def build_world(entities: DataFrame, observations: DataFrame, evidence: DataFrame, tolerance_m: float = 200.0) -> World:
    """Associate, collect rejections, find gaps and recommend, for every entity."""
    associations = W.associate(observations, entities, tolerance_m).withColumn("version", F.lit(0))
    gaps = G.detect_gaps(entities, associations, evidence, W.blocking_factors(associations))
    return World(entities, associations, evidence, gaps, G.recommend_for_gaps(gaps))


def shared_entity_pairs_without_match(world: World, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Named pairs that share an entity but have no direct match: sharing never implies a match."""
    links = world.associations.filter("status = 'SUPPORTED'").select("entity_id", "observation_id")
    a = links.select(F.col("entity_id").alias("ea"), F.col("observation_id").alias("oa"))
    b = links.select(F.col("entity_id").alias("eb"), F.col("observation_id").alias("ob"))
    shared = pairs.join(a, F.col("id_a") == F.col("oa")).join(b, (F.col("id_b") == F.col("ob")) & (F.col("ea") == F.col("eb"))).select("id_a", "id_b").distinct()
    direct = R.valid_correspondences(shared, edges)
    return shared.join(direct, ["id_a", "id_b"], "left_anti")


# Evidence type that closes each gap.
CLOSING = {
    "TERRAIN": ["MISSING_TERRAIN_VALIDATION"],
    "SPECTRAL": ["MISSING_SPECTRAL_VALIDATION", "MISSING_MODALITY"],
    "GEOMETRIC": ["MISSING_GEOMETRIC_VALIDATION"],
    "ILLUMINATION": ["MISSING_TEMPORAL_OBSERVATION"],
}


def apply_followups(world: World, followups: DataFrame, version: int = 1) -> World:
    """One loop step: follow-up observations (entity_id, observation_id, sensor, obs_lat, obs_lon,
    acquisition_time, evidence_id, evidence_type, measured_elevation_m) join the model.

    Associations and evidence are upserted, a measured elevation is set on the entity, gaps that
    the new supported evidence answers become RESOLVED. States follow from the tables.
    """
    news = W.associate(followups, world.entities).withColumn("version", F.lit(version))
    associations = upsert(world.associations, news, ["entity_id", "observation_id"], "version")
    ok = news.filter("status = 'SUPPORTED'").select("entity_id", "observation_id")
    backed = followups.join(ok, ["entity_id", "observation_id"], "left_semi")
    ev = backed.filter("evidence_type is not null").select("evidence_id", "entity_id", "observation_id", "evidence_type", F.lit("SUPPORTED").alias("status"),
                                                          F.col("acquisition_time").alias("updated_at"))
    evidence = W.latest_evidence(world.evidence.unionByName(ev, allowMissingColumns=True))
    height = backed.filter("measured_elevation_m is not null").groupBy("entity_id").agg(F.max_by("measured_elevation_m", F.struct("acquisition_time", "observation_id")).alias("_h"))
    entities = world.entities.join(height, "entity_id", "left").withColumn("elevation_m", F.coalesce("_h", "elevation_m")).drop("_h")
    answers = F.create_map(*[x for t, kinds in CLOSING.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in kinds]))])
    closed = backed.select("entity_id", F.explode(answers[F.col("evidence_type")]).alias("gap_type")).distinct().withColumn("_closed", F.lit(True))
    gaps = world.gaps.join(closed, ["entity_id", "gap_type"], "left").withColumn("status", F.when(F.col("_closed"), "RESOLVED").otherwise(F.col("status"))).drop("_closed")
    open_gaps = gaps.filter("status = 'OPEN'")
    return replace(world, entities=entities, associations=associations, evidence=evidence, gaps=gaps.select(world.gaps.columns), recommendations=G.recommend_for_gaps(open_gaps))
