"""Entities: association, lifecycle, evidence, change over time, compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from craterline import constants as C
from craterline.functions import uncertainty as U
from craterline.functions.common import any_of, compact, first_of, fixed
from craterline.functions.geo import azimuth_difference, boxes_overlap, haversine_m
from craterline.functions.stats import first_row, latest, with_previous


# --- Association --------------------------------------------------------------
def associate(observations: DataFrame, entities: DataFrame, tolerance_m: float = 200.0) -> DataFrame:
    """One association per (observation, named entity).

    Within the tolerance SUPPORTED, beyond it REJECTED with the distances as reason. An observation that
    names no known entity stays as UNRESOLVED, with that as its reason. Optional
    observation columns: confidence, uncertainty, forced_reason (a non-null reason rejects).
    """
    sites = entities.select(F.col("entity_id").alias("_eid"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    joined = observations.join(sites, observations["entity_id"] == sites["_eid"], "left")
    return _grade(joined.withColumn("_known", F.col("_eid").isNotNull()).withColumn("distance_m", haversine_m(F.col("_lat"), F.col("_lon"), F.col("obs_lat"), F.col("obs_lon"))), tolerance_m)


def _grade(df: DataFrame, tolerance_m: float) -> DataFrame:
    have = set(df.columns)
    forced = F.col("forced_reason") if "forced_reason" in have else F.lit(None).cast("string")
    rejected = forced.isNotNull() | (F.col("distance_m") > tolerance_m)
    too_far = F.concat(F.lit("SPATIAL_DISTANCE_EXCEEDS_TOLERANCE: "), fixed(F.col("distance_m"), 1), F.lit(f"m > {tolerance_m:.1f}m"))

    def given(name: str) -> Column:
        return F.col(name).cast("double") if name in have else F.lit(None).cast("double")

    keep = [c for c in ("observation_id", "entity_id", "sensor", "acquisition_time") if c in have]
    unknown = ~F.col("_known") if "_known" in have else F.lit(False)
    graded = lambda lost, refused, other: F.when(unknown, lost).when(rejected, refused).otherwise(other)
    return df.select(
        *keep, "distance_m", graded("UNRESOLVED", "REJECTED", F.lit("SUPPORTED")).alias("status"),
        graded("UNRESOLVED", "REJECTED", F.lit("GEOMETRIC")).alias("association_type"),
        graded(F.lit(0.0), F.lit(0.0), given("confidence")).alias("confidence"), graded(F.lit(1.0), F.lit(1.0), given("uncertainty")).alias("uncertainty"),
        graded(F.concat(F.lit("ENTITY_NOT_FOUND: "), F.coalesce("entity_id", F.lit("none"))), F.coalesce(forced, too_far), F.lit(None).cast("string")).alias("rejection_reason"))


def latest_associations(associations: DataFrame, version: str) -> DataFrame:
    """Latest association per (entity, observation)."""
    return latest(associations, ["entity_id", "observation_id"], [version])


def entity_states(associations: DataFrame) -> DataFrame:
    """Entity state from association status counts alone."""
    n = _status_counts(associations)
    return n.withColumn("state", first_of([
        (F.col("contradicted") > 0, "CONTRADICTED"),
        (F.col("supported") >= 2, "CONFIRMED"),
        (F.col("supported") == 1, "SUPPORTED"),
        (F.col("rejected") > 0, "REJECTED"),
    ], "CANDIDATE")).drop("sensors")


def _status_counts(associations: DataFrame) -> DataFrame:
    status = F.col("status")
    return associations.groupBy("entity_id").agg(
        F.count_if(status == "SUPPORTED").alias("supported"),
        F.count_if(status == "REJECTED").alias("rejected"),
        F.count_if(status == "CONTRADICTED").alias("contradicted"),
        F.array_sort(F.collect_set(F.when(status == "SUPPORTED", F.col("sensor")))).alias("sensors"))


def entity_sensors(associations: DataFrame) -> DataFrame:
    """Distinct sensors and number of observations per entity."""
    return associations.groupBy("entity_id").agg(
        F.array_sort(F.collect_set("sensor")).alias("sensors"), F.count("*").alias("observation_count"))


def lifecycle(associations: DataFrame, evidence: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Lifecycle case per entity; confirmation needs two distinct sensors and no contradiction.

    Entities without associations appear when ``entities`` is given. The single reasons behind a
    rejection come from ``blocking_factors`` as rows, since their number is unbounded.
    """
    counts = _status_counts(associations)
    if entities is not None:
        counts = entities.select("entity_id").join(counts, "entity_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    counts = counts.select("entity_id", *[zero(c).alias(c) for c in ("supported", "rejected", "contradicted")],
                           F.coalesce("sensors", F.array().cast("array<string>")).alias("sensors"))
    if evidence is not None:
        bad = contradictions(evidence)
        counts = counts.join(bad, "entity_id", "left")
    else:
        counts = counts.withColumn("has_contradiction", F.lit(False))
    conflict = (F.col("contradicted") > 0) | F.coalesce("has_contradiction", F.lit(False))
    case = first_of([
        (conflict, "CASE_C_CONTRADICTORY_EVIDENCE"),
        ((F.col("rejected") > 0) & (F.col("supported") == 0), "CASE_B_PHYSICALLY_INCOMPATIBLE"),
        (F.col("supported") == 1, "CASE_D_SINGLE_OBSERVATION"),
        ((F.col("supported") >= 2) & (F.size("sensors") >= 2), "CASE_A_COMPATIBLE_OVERLAP"),
        (F.col("supported") >= 2, "CASE_A_MONO_SENSOR_MULTIPLE_ACQUISITIONS"),
    ], "CASE_DEFAULT_CANDIDATE")
    state = first_of([
        (F.col("evaluated_case").startswith("CASE_C"), "CONTRADICTED"),
        (F.col("evaluated_case").startswith("CASE_B"), "REJECTED"),
        (F.col("evaluated_case") == "CASE_A_COMPATIBLE_OVERLAP", "CONFIRMED"),
        (F.col("evaluated_case") == "CASE_DEFAULT_CANDIDATE", "CANDIDATE"),
    ], "SUPPORTED")
    listed = F.concat(F.lit("['"), F.array_join("sensors", "', '"), F.lit("']"))
    text = first_of(
        [(F.col("evaluated_case") == k, F.lit(v)) for k, v in C.LIFECYCLE_TEXT.items()]
        + [(F.col("evaluated_case") == "CASE_A_COMPATIBLE_OVERLAP", F.concat(
            F.lit("Entity CONFIRMED: Independently corroborated across distinct sensors: "), listed, F.lit(".")))],
        F.concat(F.lit("Entity supported by multiple acquisitions of the same sensor ("), F.element_at("sensors", 1),
                 F.lit("), but lacks multi-modal cross-sensor confirmation.")))
    block = first_of([(F.col("evaluated_case") == k, v) for k, v in C.LIFECYCLE_BLOCKS.items()])
    return (counts.withColumn("evaluated_case", case).withColumn("state", state)
            .select("entity_id", "evaluated_case", "state", (F.col("state") == "CONFIRMED").alias("is_confirmed"),
                    "supported", "rejected", "contradicted", "sensors",
                    text.alias("explanation"), block.alias("blocking_factor")))


def blocking_factors(associations: DataFrame) -> DataFrame:
    """One row per rejected association that carries a reason."""
    return associations.filter("status = 'REJECTED'").select(
        "entity_id", "observation_id", "sensor",
        F.coalesce("rejection_reason", F.lit("UNKNOWN_REJECTION")).alias("rejection_reason"))


# --- Evidence -----------------------------------------------------------------
def latest_evidence(evidence: DataFrame, version: str = "updated_at") -> DataFrame:
    """Latest item per evidence id, then per (entity, type, observation) where an observation is named."""
    by_id = latest(evidence, ["entity_id", "evidence_id"], [version])
    named = latest(by_id.filter("observation_id is not null"),
                   ["entity_id", "evidence_type", "observation_id"], [version, "evidence_id"])
    return named.unionByName(by_id.filter("observation_id is null"))


def dimension_status(evidence: DataFrame) -> DataFrame:
    """Status per (entity, dimension) by precedence."""
    def seen(status: str) -> Column:
        return F.coalesce(F.bool_or(F.col("status") == status), F.lit(False))

    return evidence.groupBy("entity_id", "evidence_type").agg(first_of([
        (seen("CONTRADICTED"), "CONTRADICTED"),
        (seen("REJECTED") & ~seen("SUPPORTED"), "REJECTED"),
        (seen("SUPPORTED"), "SUPPORTED"),
        (seen("INSUFFICIENT_EVIDENCE"), "INSUFFICIENT_EVIDENCE"),
        (seen("UNVALIDATED"), "UNVALIDATED"),
    ], "UNKNOWN").alias("status"), F.count("*").alias("items"))


def contradictions(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("entity_id").agg(
        F.coalesce(F.bool_or(F.col("status") == "CONTRADICTED"), F.lit(False)).alias("has_contradiction"))


def fuse_evidence(evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """Per entity: which dimensions are supported, contradicted, insufficient or unknown. No averaging.

    A dimension without items, or only REJECTED or UNVALIDATED ones, is unknown. The items
    themselves are rows of ``evidence_items``.
    """
    by_dim = dimension_status(evidence.filter(F.col("evidence_type").isin(C.FUSED_DIMENSIONS)))
    # At most ten entries per entity: one per dimension.
    per_entity = by_dim.groupBy("entity_id").agg(
        F.map_from_entries(F.collect_list(F.struct("evidence_type", "status"))).alias("m"))
    all_dims = F.array(*[F.lit(d) for d in C.FUSED_DIMENSIONS])
    status = lambda d: F.coalesce(F.element_at("m", d), F.lit("NONE"))

    def dims(*wanted: str) -> Column:
        return F.filter(all_dims, lambda d: status(d).isin(*wanted))

    out = entities.join(per_entity, "entity_id", "left").withColumn(
        "m", F.coalesce("m", F.create_map().cast("map<string,string>")))
    out = out.select(
        "entity_id", "entity_type", dims("SUPPORTED").alias("supported_dimensions"),
        dims("CONTRADICTED").alias("contradicted_dimensions"), dims("INSUFFICIENT_EVIDENCE").alias("insufficient_dimensions"),
        dims("NONE", "REJECTED", "UNVALIDATED", "UNKNOWN", "NOT_APPLICABLE").alias("unknown_dimensions"))
    unknown, insufficient = F.col("unknown_dimensions"), F.col("insufficient_dimensions")
    return out.withColumn("summary", F.concat_ws(
        "\n",
        F.concat(F.lit("Entity "), F.col("entity_id"), F.lit(" ("), F.upper("entity_type"), F.lit(") Evaluation Summary:")),
        F.when(F.size("supported_dimensions") > 0, F.concat(F.lit("SUPPORTED BY: "), F.array_join("supported_dimensions", ", "))),
        F.when(F.size("contradicted_dimensions") > 0, F.concat(F.lit("CONTRADICTED BY: "), F.array_join("contradicted_dimensions", ", "))),
        F.when(F.size(unknown) > 0, F.concat(F.lit("UNKNOWN DIMENSIONS ("), F.size(unknown).cast("string"), F.lit("): "), F.array_join(unknown, ", "))),
        F.when(F.size(insufficient) > 0, F.concat(F.lit("INSUFFICIENT EVIDENCE DIMENSIONS: "), F.array_join(insufficient, ", ")))))


def evidence_items(evidence: DataFrame) -> DataFrame:
    """The supporting items of supported dimensions and the conflicting items of contradicted ones."""
    by_dim = dimension_status(evidence).select(
        F.col("entity_id").alias("_e"), F.col("evidence_type").alias("_t"), F.col("status").alias("dimension_status"))
    joined = evidence.join(by_dim, (evidence["entity_id"] == by_dim["_e"]) & (evidence["evidence_type"] == by_dim["_t"])).drop("_e", "_t")
    return joined.filter(F.col("dimension_status").isin("SUPPORTED", "CONTRADICTED") & (F.col("status") == F.col("dimension_status")))


def unmeasured_dimensions(evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """Dimensions of each entity without any item."""
    present = evidence.groupBy("entity_id").agg(F.collect_set("evidence_type").alias("present"))
    all_dims = F.array(*[F.lit(d) for d in C.FUSED_DIMENSIONS])
    return entities.select("entity_id").join(present, "entity_id", "left").select(
        "entity_id", F.array_except(all_dims, F.coalesce("present", F.array().cast("array<string>"))).alias("unmeasured"))


# --- Change over time ---------------------------------------------------------
EPOCH_VALUES = ["epoch_id", "solar_azimuth_deg", "solar_elevation_deg", "incidence_angle_deg",
                "apparent_brightness", "feature_diameter_m", "notes"]


def epoch_differences(epochs: DataFrame, tolerance_m: float = 3.0, rows_per_chunk: int = 2_000_000) -> DataFrame:
    """Each epoch next to the previous one of its entity, with the shift flags. First epochs have none."""
    for name in EPOCH_VALUES:
        if name not in epochs.columns:
            epochs = epochs.withColumn(name, F.lit(None).cast("string" if name in ("epoch_id", "notes") else "double"))
    df = with_previous(epochs, ["entity_id"], ["ts", "epoch_id"], EPOCH_VALUES, "ts", rows_per_chunk)
    p = F.col("prev")
    shift = lambda c: F.abs(p[c] - F.col(c))
    contradicted = lambda c: F.coalesce(c.contains("CONTRADICTED"), F.lit(False))
    df = df.withColumns({
        "azimuth_shift": azimuth_difference(p["solar_azimuth_deg"], F.col("solar_azimuth_deg")),
        "elevation_shift": shift("solar_elevation_deg"),
        "incidence_shift": shift("incidence_angle_deg"),
        "brightness_shift": shift("apparent_brightness"),
        "diameter_shift": shift("feature_diameter_m"),
    })
    flag = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns({
        "illumination_shift": flag(F.col("azimuth_shift") > 10.0) | flag(F.col("elevation_shift") > 5.0)
        | flag(F.col("incidence_shift") > 5.0) | flag(F.col("brightness_shift") > 0.15),
        "geometric_shift": flag(F.col("diameter_shift") > tolerance_m),
        "contradicted": p.isNotNull() & (contradicted(p["notes"]) | contradicted(F.col("notes"))),
    })


def difference_texts(differences: DataFrame, tolerance_m: float = 3.0) -> DataFrame:
    """One row per observed difference, worded."""
    a, b = F.col("prev.epoch_id").cast("string"), F.col("epoch_id").cast("string")
    between = F.concat(F.lit("° between "), a, F.lit(" and "), b, F.lit("."))

    def line(name: str, limit: float, text: Column) -> Column:
        return F.when(F.col(name) > limit, text)

    lines = compact([
        line("azimuth_shift", 10.0, F.concat(F.lit("Solar azimuth shifted by "), fixed(F.col("azimuth_shift"), 1), between)),
        line("elevation_shift", 5.0, F.concat(F.lit("Solar elevation shifted by "), fixed(F.col("elevation_shift"), 1), between)),
        line("incidence_shift", 5.0, F.concat(F.lit("Solar incidence angle shifted by "), fixed(F.col("incidence_shift"), 1), between)),
        line("brightness_shift", 0.15, F.concat(F.lit("Apparent pixel brightness shifted by "), fixed(F.col("brightness_shift"), 2), F.lit("."))),
        line("diameter_shift", tolerance_m, F.concat(F.lit("Physical diameter shifted by "), fixed(F.col("diameter_shift"), 1),
                                                     F.lit(f"m (exceeds {tolerance_m}m tolerance)."))),
    ])
    return differences.select("entity_id", "ts", "epoch_id", F.explode(lines).alias("difference"))


def temporal_states(epochs: DataFrame, tolerance_m: float = 3.0, rows_per_chunk: int = 2_000_000) -> DataFrame:
    """Temporal state per entity: illumination shifts alone never count as change."""
    d = epoch_differences(epochs, tolerance_m, rows_per_chunk)
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / F.lit(86400000000.0)
    n = d.groupBy("entity_id").agg(
        F.count("*").alias("epoch_count"), span.alias("time_span_days"),
        F.bool_or("illumination_shift").alias("illumination"), F.bool_or("geometric_shift").alias("geometry"),
        F.bool_or("contradicted").alias("contradicted"))
    few, il, ge = F.col("epoch_count") < 2, F.col("illumination"), F.col("geometry")
    reason = first_of([
        (few, "SINGLE"), (F.col("contradicted"), "CONTRADICTED"), (ge & ~il, "GEOMETRY"),
        (il & ~ge, "ILLUMINATION"), (ge & il, "BOTH")], "NONE")
    state = first_of([
        (F.col("_r") == "SINGLE", "INSUFFICIENT_TEMPORAL_EVIDENCE"), (F.col("_r") == "CONTRADICTED", "CHANGE_CONTRADICTED"),
        (F.col("_r") == "GEOMETRY", "CHANGE_SUPPORTED"), (F.col("_r") == "BOTH", "POSSIBLE_CHANGE")], "STABLE")
    return n.withColumn("_r", reason).select(
        "entity_id", state.alias("temporal_state"), "epoch_count",
        F.when(few, 0.0).otherwise(F.col("time_span_days")).alias("time_span_days"),
        (F.col("_r") == "GEOMETRY").alias("physical_change_supported"),
        first_of([(F.col("_r") == k, v) for k, v in C.TEMPORAL_TEXT.items()]).alias("explanation"))


def entity_timeline(associations: DataFrame) -> DataFrame:
    """The supported observations of each entity, one row each; ordering columns are part of the row."""
    return associations.filter("status = 'SUPPORTED'").select("entity_id", "acquisition_time", "observation_id", "sensor")


def entity_modalities(associations: DataFrame) -> DataFrame:
    """Observations per entity and sensor with first and last acquisition."""
    return associations.filter("status = 'SUPPORTED'").groupBy("entity_id", "sensor").agg(
        F.count("*").alias("observations"), F.min("acquisition_time").alias("first_seen"), F.max("acquisition_time").alias("last_seen"))


# --- Compatibility ------------------------------------------------------------
def compatibility(pairs: DataFrame, observations: DataFrame, strict: bool = False) -> DataFrame:
    """Overlap status of named pairs (id_a, id_b, optional measured_gap_m).

    ``strict`` tests the boxes where polygons exist and uses no default gap.
    """
    box = ["lat_min", "lat_max", "lon_min", "lon_max"]
    wanted = ["observation_id", "sensor", *box, "has_grid", "has_polygon", "is_synthetic"]
    df = pairs if "measured_gap_m" in pairs.columns else pairs.withColumn("measured_gap_m", F.lit(None).cast("double"))
    for t in ("a", "b"):
        side = observations.select(*[F.col(c).alias(f"{t}_{c}") for c in wanted])
        df = df.join(side, df[f"id_{t}"] == side[f"{t}_observation_id"], "left")
    missing = F.col("a_observation_id").isNull() | F.col("b_observation_id").isNull()
    both = lambda c: F.coalesce(F.col(f"a_{c}") & F.col(f"b_{c}"), F.lit(False))
    overlap = F.coalesce(boxes_overlap(*[F.col(f"a_{c}") for c in box], *[F.col(f"b_{c}") for c in box], strict=True), F.lit(False))
    optical = any_of([(F.col("a_sensor") == x) & (F.col("b_sensor") == y) for x, y in (("OHRC", "TMC-2"), ("TMC-2", "OHRC"))])
    gap = F.col("measured_gap_m")
    if not strict:
        gap = F.coalesce(gap, F.when(optical, F.lit(C.DEFAULT_GAP_M)))
    apart = F.coalesce(gap > C.MAX_RELIEF_M, F.lit(False))
    method = first_of([
        (missing, "REGISTRATION_LOOKUP"),
        (~both("has_grid") & both("is_synthetic") & overlap, "SYNTHETIC_BOUNDING_BOX"),
        (~both("has_grid"), "CALIBRATED_GEOMETRY_CHECK"),
        (apart, "CALIBRATED_GROUNDGRID_BOUNDARY_DISTANCE"),
        (both("has_polygon") & (overlap if strict else F.lit(True)), "CALIBRATED_POLYGON_INTERSECTION"),
    ], "DEFAULT")
    status = first_of([
        (F.col("evaluation_method").isin("SYNTHETIC_BOUNDING_BOX", "CALIBRATED_POLYGON_INTERSECTION"), "VALIDATED_OVERLAP"),
        (F.col("evaluation_method") == "CALIBRATED_GEOMETRY_CHECK", "INSUFFICIENT_GEOMETRY"),
        (F.col("evaluation_method") == "CALIBRATED_GROUNDGRID_BOUNDARY_DISTANCE", "NO_OVERLAP"),
    ], "UNKNOWN")
    return df.withColumn("evaluation_method", method).select(
        "id_a", "id_b", F.when(missing, "UNKNOWN").otherwise(F.col("a_sensor")).alias("source_sensor"),
        F.when(missing, "UNKNOWN").otherwise(F.col("b_sensor")).alias("target_sensor"),
        status.alias("overlap_status"), "evaluation_method",
        F.when(F.col("evaluation_method") == "CALIBRATED_GROUNDGRID_BOUNDARY_DISTANCE", gap).alias("separation_distance_m"))


def first_per_sensor(observations: DataFrame, order: str = "observation_id") -> DataFrame:
    """First registered observation of each sensor."""
    return first_row(observations, ["sensor"], [order])


def compatibility_matrix(observations: DataFrame, sensors: list[str] | None = None) -> DataFrame:
    """Square status table over a short sensor list; diagonal dash, unregistered UNKNOWN."""
    sensors = sensors or C.MATRIX_SENSORS
    spark = observations.sparkSession
    grid = spark.createDataFrame([(a, b) for a in sensors for b in sensors], "sensor_a string, sensor_b string")
    firsts = first_per_sensor(observations.filter(F.col("sensor").isin(sensors))).select("sensor", F.col("observation_id").alias("oid"))
    named = (grid.join(firsts.select(F.col("sensor").alias("sensor_a"), F.col("oid").alias("id_a")), "sensor_a", "left")
                 .join(firsts.select(F.col("sensor").alias("sensor_b"), F.col("oid").alias("id_b")), "sensor_b", "left"))
    cells = compatibility(named, observations)
    out = (named.join(cells.select(F.col("id_a").alias("_a"), F.col("id_b").alias("_b"), "overlap_status"),
                      (named["id_a"] == F.col("_a")) & (named["id_b"] == F.col("_b")), "left")
           .withColumn("cell", F.when(F.col("sensor_a") == F.col("sensor_b"), F.lit("—"))
                       .otherwise(F.coalesce("overlap_status", F.lit("UNKNOWN")))))
    return out.groupBy("sensor_a").pivot("sensor_b", sensors).agg(F.first("cell"))


# --- Uncertainty propagation --------------------------------------------------
def propagate_uncertainty(associations: DataFrame, dem_m: float, corridor_m: float, tolerance_m: float = 200.0) -> DataFrame:
    """Uncertainty chain per association (needs sensor, gsd_m, distance_m)."""
    geometry = U.geometric_uncertainty(F.col("sensor"), F.col("gsd_m"), dem_m, corridor_m)
    df = associations.withColumn("_geometry", geometry)
    chain = U.uncertainty_chain(
        source=U.scalar_uncertainty(F.col("gsd_m"), "meters", "SENSOR_GSD"), geometry=F.col("_geometry"),
        association=U.association_uncertainty(F.col("_geometry"), F.col("distance_m"), tolerance_m))
    return df.withColumn("chain", chain).drop("_geometry")
