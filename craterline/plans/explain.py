"""Explanation cards as line tables: one row per line, so that an entity of any size can be told whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions.common import fixed
from craterline.operators import world as W

SECTIONS = ["HEADER", "SUPPORTED EVIDENCE", "CONTRADICTING EVIDENCE", "UNKNOWN EVIDENCE", "BLOCKED FACTORS", "UNCERTAINTY", "ACTIVE KNOWLEDGE GAPS", "NEXT-BEST OBSERVATIONS"]


def _lines(df: DataFrame, section: str, line: Column, item: Column | None = None) -> DataFrame:
    return df.select("entity_id", F.lit(SECTIONS.index(section)).alias("section_no"), F.lit(section).alias("section"),
                     (F.lit("") if item is None else item.cast("string")).alias("item"), line.alias("line"))


def explain_entities(entities: DataFrame, associations: DataFrame, evidence: DataFrame, gaps: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Card lines (entity_id, section_no, section, item, line); order by section_no, item, line.

    Only supporting items of a supported dimension are listed, and a missing uncertainty reads
    UNKNOWN. Sections without entries have no line here; ``empty_sections`` names them.
    """
    state = W.lifecycle(associations, evidence, entities).select(F.col("entity_id").alias("_e"), "state")
    e = entities.join(state, entities["entity_id"] == state["_e"])
    elev = F.coalesce(fixed(F.col("elevation_m"), 1), F.lit("UNCONSTRAINED"))
    head = F.concat_ws(
        " | ", F.concat(F.lit("Entity Type: "), F.upper("entity_type")),
        F.concat(F.lit("Coordinates: Lat "), fixed(F.col("latitude"), 4), F.lit("° N, Lon "), fixed(F.col("longitude"), 4), F.lit("° E, Elev "), elev, F.lit("m")),
        F.concat(F.lit("Lifecycle State: "), F.col("state")))
    card = evidence.filter(F.col("evidence_type").isin(C.CARD_DIMENSIONS))
    items = W.evidence_items(card)
    dims = F.array(*[F.lit(d) for d in C.CARD_DIMENSIONS])
    status = W.dimension_status(card).groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("evidence_type", "status"))).alias("m"))
    s = lambda d: F.coalesce(F.element_at("m", d), F.lit("NONE"))
    unknown = F.transform(F.filter(dims, lambda d: ~s(d).isin("SUPPORTED", "CONTRADICTED")), lambda d: F.when(
        s(d) == "INSUFFICIENT_EVIDENCE", F.concat(d, F.lit(" (INSUFFICIENT_EVIDENCE)"))).otherwise(d))
    u = entities.select("entity_id").join(status, "entity_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,string>")))
    told = lambda mark: F.concat(F.lit(f"  {mark} "), F.col("evidence_type"), F.lit(" ("), F.col("evidence_id").cast("string"), F.lit(")"))
    bound = F.concat(F.lit("Localization spatial bound ~"), F.coalesce(F.concat(fixed(F.col("uncertainty_m"), 2), F.lit("m")), F.lit("UNKNOWN")), F.lit("; regional DEM resolution limit 59.2m"))
    blocked = W.blocking_factors(associations)
    parts = [
        _lines(e, "HEADER", head),
        _lines(items.filter("status = 'SUPPORTED'"), "SUPPORTED EVIDENCE", told("+"), F.col("evidence_id")),
        _lines(items.filter("status = 'CONTRADICTED'"), "CONTRADICTING EVIDENCE", told("-"), F.col("evidence_id")),
        _lines(u, "UNKNOWN EVIDENCE", F.coalesce(F.nullif(F.array_join(unknown, ", "), F.lit("")), F.lit("None"))),
        _lines(blocked, "BLOCKED FACTORS", F.concat(F.lit("  ! "), F.col("sensor"), F.lit(": "), F.col("rejection_reason")), F.col("observation_id")),
        _lines(entities, "UNCERTAINTY", bound),
        _lines(gaps, "ACTIVE KNOWLEDGE GAPS", F.concat(F.lit("  * ["), F.col("severity"), F.lit("] "), F.col("gap_type"), F.lit(": "), F.col("description")), F.col("gap_type")),
        _lines(recommendations, "NEXT-BEST OBSERVATIONS", F.concat(F.lit("  > Target "), F.col("candidate_sensor"), F.lit(": "), F.col("basis")), F.col("gap_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def empty_sections(entities: DataFrame, card: DataFrame) -> DataFrame:
    """Sections of each entity that have no line."""
    have = card.groupBy("entity_id").agg(F.collect_set("section").alias("have"))
    every = F.array(*[F.lit(s) for s in SECTIONS])
    return entities.select("entity_id").join(have, "entity_id", "left").select(
        "entity_id", F.explode(F.array_except(every, F.coalesce("have", F.array().cast("array<string>")))).alias("section"))


def card_counts(card: DataFrame) -> DataFrame:
    """Lines per entity and section."""
    return card.groupBy("entity_id", "section").agg(F.count("*").alias("lines"))
