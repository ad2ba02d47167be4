"""Small fixed dimension tables. Their size never grows with the data, so they may broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from craterline import constants as C


def sensor_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.SENSOR_CATALOG, "sensor string, role string, min_lat double, max_lat double, resolution_m double")


def ranked_sensors(spark: SparkSession) -> DataFrame:
    rows = [(n, *r) for n, r in enumerate(C.RANKED_SENSORS)]
    return spark.createDataFrame(rows, "sensor_order int, sensor string, quality double, feasibility double, band string, role string")


def relevance(spark: SparkSession) -> DataFrame:
    names = [r[0] for r in C.RANKED_SENSORS]
    rows = [(q, s, v) for q, values in C.RELEVANCE.items() for s, v in zip(names, values)]
    return spark.createDataFrame(rows, "question string, sensor string, relevance double")


def gap_sensor_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.GAP_SENSOR_RULES, (
        "gap_type string, candidate_sensor string, expected_evidence_type string, potential string, "
        "reason string, required_geometry string, basis string"))


def gap_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, *C.GAP_TEXT[g][:2]) for g in C.GAP_TYPES], "gap_type string, severity string, id_suffix string")


def evidence_dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(C.EVIDENCE_DIMENSIONS)), "dimension_order int, dimension string")


def gate_definitions(spark: SparkSession) -> DataFrame:
    rows = [(g, C.GATE_REASONS[g], what, fails, limit) for g, what, fails, limit in C.GATE_CATALOG]
    return spark.createDataFrame(rows, "gate_id string, gate_reason string, description string, failure_criterion string, threshold string")


def hypothesis_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.HYPOTHESIS_TEMPLATES, (
        "suffix string, property_name string, hypothesis_value string, confidence double, uncertainty double, evidence_count int"))


def pair_tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.PAIR_TIERS, (
        "source_sensor string, target_sensor string, priority_tier int, expected_difficulty string, id_prefix string, notes string"))


def small(df: DataFrame) -> DataFrame:
    """Mark a fixed table for broadcast."""
    return F.broadcast(df)
