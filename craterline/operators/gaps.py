"""What is not known about an entity, and which observation to take next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions.common import any_of, compact, fixed, round_at
from craterline.functions.score import information_gain
from craterline.functions.text import gap_id, stable_id
from craterline.operators import catalog


def _gap(kind: str, current: Column, description: Column | None = None, blocking: str | None = None) -> Column:
    severity, tag, text, required = C.GAP_TEXT[kind]
    return F.struct(
        F.lit(kind).alias("gap_type"), F.lit(severity).alias("severity"), F.lit(tag).alias("tag"),
        (F.lit(text) if description is None else description).alias("description"),
        F.lit(required).alias("required_evidence"), current.cast("string").alias("current_evidence"),
        F.lit(blocking).cast("string").alias("blocking_reason"))


def detect_gaps(entities: DataFrame, associations: DataFrame, evidence: DataFrame | None = None,
                rejection_events: DataFrame | None = None, threshold_m: float = 50.0) -> DataFrame:
    """One row per gap.

    Seven rules read one row of counts per entity in a single pass; footprint gaps come one per
    rejection event. The rules for geometry and modality apply only to entities with a profile,
    that is where ``evidence`` is given.
    """
    status = F.col("status")
    counts = associations.groupBy("entity_id").agg(
        F.count("*").alias("n_all"), F.count_if(status == "SUPPORTED").alias("n_supported"),
        F.count_if((F.col("association_type") == "TEMPORAL") | (status == "SUPPORTED")).alias("n_temporal"),
        F.array_sort(F.collect_set(F.when(status == "SUPPORTED", F.col("sensor")))).alias("sensors"))
    df = entities.select("entity_id", "elevation_m", "uncertainty_m").join(counts, "entity_id", "left")
    for c in ("n_all", "n_supported", "n_temporal"):
        df = df.withColumn(c, F.coalesce(c, F.lit(0)))
    df = df.withColumn("sensors", F.coalesce("sensors", F.array().cast("array<string>")))
    if evidence is not None:
        backed = evidence.filter("status = 'SUPPORTED'").groupBy("entity_id").agg(*[
            F.bool_or(F.col("evidence_type") == t).alias(f"has_{t.lower()}") for t in ("SPECTRAL", "TERRAIN", "GEOMETRIC")])
        df = df.join(backed, "entity_id", "left")
    has = lambda t: F.coalesce(F.col(f"has_{t}"), F.lit(False)) if evidence is not None else F.lit(False)
    profile = F.lit(evidence is not None)
    sensors = F.array_join("sensors", ", ")
    unc = F.col("uncertainty_m")
    rules = compact([
        F.when(~has("spectral") & ~F.array_contains("sensors", "IIRS"),
               _gap("MISSING_SPECTRAL_VALIDATION", sensors, blocking="NO_SPECTRAL_DATA_ATTACHED")),
        F.when(~has("terrain") & F.col("elevation_m").isNull(), _gap("MISSING_TERRAIN_VALIDATION", sensors)),
        F.when(F.col("n_temporal") < 2, _gap("MISSING_TEMPORAL_OBSERVATION", F.concat(
            F.col("n_temporal").cast("string"), F.lit(" observation(s) recorded")))),
        F.when(unc > threshold_m, _gap(
            "UNCERTAINTY_TOO_HIGH", F.concat(F.lit("Current uncertainty: "), fixed(unc, 1), F.lit("m")),
            F.concat(F.lit("Spatial/elevation uncertainty ("), fixed(unc, 1),
                     F.lit(f"m) exceeds scientific tolerance ({threshold_m:.1f}m).")))),
        F.when((F.col("n_all") == 1) & (F.col("n_supported") == 1),
               _gap("INSUFFICIENT_CORRESPONDENCE", F.concat(F.lit("Single sensor: "), sensors))),
        F.when(profile & ~has("geometric"), _gap("MISSING_GEOMETRIC_VALIDATION", F.lit(None))),
        F.when(profile & ~has("spectral"), _gap("MISSING_MODALITY", F.lit(None))),
    ])
    found = df.select("entity_id", F.explode(rules).alias("g")).select("entity_id", "g.*")
    if rejection_events is not None:
        reason = F.col("rejection_reason")
        disjoint = any_of([reason.contains(t) for t in (C.GATE_REASONS["GATE3"], "FOOTPRINT", "SPATIAL_DISTANCE")])
        events = (rejection_events.filter(disjoint)
                  .join(entities.select(F.col("entity_id").alias("_e")), F.col("entity_id") == F.col("_e"), "left_semi")
                  .select("entity_id", _gap(
                      "FOOTPRINT_NON_OVERLAP", F.concat(F.lit("Footprints disjoint; rejection reason: "), reason),
                      blocking="PHYSICAL_FOOTPRINT_SEPARATION").alias("g")).select("entity_id", "g.*"))
        found = found.unionByName(events)
    return found.select(gap_id(F.col("entity_id"), F.col("tag")).alias("gap_id"), "*").drop("tag").withColumn("status", F.lit("OPEN"))


def scan_service_gaps(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Three rules over the attached observations: no IIRS, fewer than two links, no TMC-2.

    Counted per entity in one pass, which also covers entities without any link.
    """
    n = links.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("sensor") == "IIRS").alias("iirs"), F.count_if(F.col("sensor") == "TMC-2").alias("tmc"))
    df = entities.select("entity_id").join(n, "entity_id", "left")
    conds = [F.coalesce(F.col("iirs"), F.lit(0)) == 0, F.coalesce(F.col("n"), F.lit(0)) < 2, F.coalesce(F.col("tmc"), F.lit(0)) == 0]
    rules = compact([
        F.when(cond, F.struct(F.lit(kind).alias("gap_type"), F.lit(sev).alias("severity"), F.lit(tag).alias("tag"),
                              F.lit(sensor).alias("recommended_sensor"), F.lit(text).alias("reason")))
        for cond, (kind, sev, tag, sensor, text) in zip(conds, C.SERVICE_GAPS)])
    return (df.select("entity_id", F.explode(rules).alias("g")).select("entity_id", "g.*")
              .select(gap_id(F.col("entity_id"), F.col("tag"), 5).alias("gap_id"), "*").drop("tag").withColumn("status", F.lit("OPEN")))


def footprint_gaps(pairs: DataFrame) -> DataFrame:
    """Footprint gap of each entity whose pair was refused for lack of overlap (reasons array, tgt_sensor)."""
    text = F.array_join("rejection_reasons", " ")
    hit = pairs.filter(text.contains("FOOTPRINT_NON_OVERLAP") | text.contains("GATE3"))
    return hit.groupBy("entity_id").agg(F.min("tgt_sensor").alias("recommended_sensor")).select(
        gap_id(F.col("entity_id"), "NONOVERLAP", 5).alias("gap_id"), "entity_id", F.lit("FOOTPRINT_NON_OVERLAP").alias("gap_type"),
        F.lit("HIGH").alias("severity"), "recommended_sensor", F.lit(C.FOOTPRINT_GAP_REASON).alias("reason"), F.lit("OPEN").alias("status"))


def without_sensor(entities: DataFrame, links: DataFrame, sensor: str) -> DataFrame:
    """Entities with no link of a sensor."""
    return entities.join(links.filter(F.col("sensor") == sensor).select("entity_id"), "entity_id", "left_anti")


def not_present(gaps: DataFrame, existing: DataFrame) -> DataFrame:
    """Gaps not stored yet, keyed on entity and gap type."""
    return gaps.join(existing.select("entity_id", "gap_type"), ["entity_id", "gap_type"], "left_anti")


# --- Recommendations ----------------------------------------------------------
def recommend_for_gaps(gaps: DataFrame, available: list[str] | None = None) -> DataFrame:
    """Sensor per gap by rule; gap types without a rule yield no row."""
    available = available if available is not None else C.MATRIX_SENSORS
    rules = catalog.small(catalog.gap_sensor_rules(gaps.sparkSession))
    out = gaps.select("gap_id", "entity_id", "gap_type").join(rules, "gap_type")
    feasible = F.when(F.col("candidate_sensor").isin(available), "FEASIBLE").otherwise("PAYLOAD_UNAVAILABLE")
    return out.select(
        stable_id("REC-", F.col("entity_id"), F.col("gap_type"), F.col("candidate_sensor")).alias("recommendation_id"),
        "entity_id", "gap_id", "gap_type", "candidate_sensor", "reason", "required_geometry", "expected_evidence_type",
        feasible.alias("feasibility"), "basis", "potential", F.lit("ACTIVE").alias("status"))


def rank_sensors(entities: DataFrame, links: DataFrame, question: str = "spectral analysis") -> DataFrame:
    """Sensors of each entity ranked by expected information gain (three rows per entity)."""
    target = question.lower()
    seen = links.groupBy("entity_id").agg(F.collect_set("sensor").alias("seen"))
    rel = dict(zip([r[0] for r in C.RANKED_SENSORS], C.RELEVANCE.get(target, (C.UNKNOWN_QUESTION_RELEVANCE,) * 3)))
    # Three fixed sensors, ranked inside the row: no join and no shuffle for the ranking.
    options = F.array(*[
        F.struct(F.lit(n).alias("sensor_order"), F.lit(s).alias("sensor"), F.lit(q).alias("quality"), F.lit(f).alias("feasibility"),
                 F.lit(band).alias("band"), F.lit(rel[s]).alias("relevance"))
        for n, (s, q, f, band, _) in enumerate(C.RANKED_SENSORS)])
    df = entities.select("entity_id", "uncertainty").join(seen, "entity_id", "left")

    def scored(o: Column) -> Column:
        was = F.coalesce(F.array_contains("seen", o["sensor"]), F.lit(False))
        gain = information_gain(F.col("uncertainty"), o["relevance"], was, o["quality"], o["feasibility"])
        return F.struct((-gain).alias("neg_gain"), o["sensor_order"].alias("sensor_order"), o["sensor"].alias("sensor"),
                        o["relevance"].alias("relevance"), o["feasibility"].alias("feasibility"), o["band"].alias("band"), was.alias("seen"))

    ranked = df.select("entity_id", F.posexplode(F.array_sort(F.transform(options, scored))).alias("pos", "o"))
    gain = -F.col("o.neg_gain")
    reduction = round_at(gain * 0.42, 3)
    fresh = F.concat(F.lit("High priority: Entity lacks "), F.col("o.band"),
                     F.lit(f" data. POTENTIALLY_REDUCES_UNCERTAINTY: May reduce {target} epistemic uncertainty by up to "),
                     fixed(reduction * 100, 1), F.lit("%."))
    again = "Secondary priority: Repeated observation at orthogonal solar azimuth will refine existing measurements."
    return ranked.select(
        "entity_id", (F.col("pos") + 1).alias("rank"), F.col("o.sensor").alias("sensor"), gain.alias("expected_information_gain"),
        reduction.alias("uncertainty_reduction"), F.col("o.relevance").alias("relevance"), F.col("o.feasibility").alias("feasibility"),
        (~F.col("o.seen")).alias("is_new_modality"), F.when(F.col("o.seen"), again).otherwise(fresh).alias("explanation"))


def top_recommendation(ranked: DataFrame, question: str = "spectral analysis") -> DataFrame:
    """The best sensor of each entity as a recommendation row."""
    text = F.col("explanation")
    text = F.when(text.contains("POTENTIALLY_REDUCES_UNCERTAINTY"), text).otherwise(
        F.concat(F.lit("POTENTIALLY_REDUCES_UNCERTAINTY: "), text))
    return ranked.filter("rank = 1").select(
        F.concat(F.lit("REC-"), F.col("entity_id"), F.lit("-"), F.col("sensor")).alias("recommendation_id"),
        "entity_id", F.lit(question).alias("scientific_question"), F.col("sensor").alias("recommended_sensor"),
        "expected_information_gain", "uncertainty_reduction", "feasibility", F.lit("AVAILABLE").alias("payload_status"),
        text.alias("explanation"))


def unavailable_recommendation(requests: DataFrame) -> DataFrame:
    """Requests (entity_id, scientific_question) that name an unavailable payload."""
    q = F.lower("scientific_question")
    refused = any_of([q.contains(w) for w in ("unavailable", "offline", "unsupported")])
    return requests.filter(refused).select(
        F.concat(F.lit("REC-"), F.col("entity_id"), F.lit("-UNAVAILABLE")).alias("recommendation_id"),
        "entity_id", "scientific_question", F.lit("NONE").alias("recommended_sensor"),
        F.lit(0.0).alias("expected_information_gain"), F.lit(0.0).alias("uncertainty_reduction"),
        F.lit(0.0).alias("feasibility"), F.lit("PAYLOAD_UNAVAILABLE").alias("payload_status"),
        F.lit("Requested instrument payload is currently unavailable in the lunar operational fleet. Orbital tasking cannot be simulated.").alias("explanation"))


def gap_counts(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("gap_type").agg(F.count("*").alias("gaps"))


def benchmark_gaps(detected: DataFrame, expected: DataFrame) -> DataFrame:
    """Per scenario (entity_id, target_gap_type): was the named gap found, and how many in all."""
    hit = detected.join(expected.select(F.col("entity_id").alias("_e"), "target_gap_type"), F.col("entity_id") == F.col("_e"))
    n = hit.groupBy("entity_id").agg(F.count("*").alias("detected_count"), F.bool_or(F.col("gap_type") == F.col("target_gap_type")).alias("passed"))
    return expected.join(n, "entity_id", "left").select(
        "entity_id", "target_gap_type", F.coalesce("detected_count", F.lit(0)).cast("bigint").alias("detected_count"),
        F.coalesce("passed", F.lit(False)).alias("passed"))


def benchmark_summary(scenarios: DataFrame) -> DataFrame:
    return scenarios.agg(
        F.count("*").alias("total_scenarios"), F.count_if("passed").alias("passed_scenarios"),
        (F.count_if("passed") / F.count("*")).alias("pass_rate"), F.bool_and("passed").alias("all_passed"))

