"""Domain tables derived from the given star-schema tables.

One SQL text per view serves Spark and the oracle. Keys of the views:
entities from customers, observations from orders, epochs from events, matches, evidence and
profiles from line items, and image, lattice and elevation cells from orders.
"""

from __future__ import annotations

import re

SQL = {
    "v_entity": """
SELECT 'LUNAR-ENT-' || lpad(CAST(c_custkey AS string), 6, '0') AS entity_id, c_custkey AS ekey,
  CASE c_custkey % 4 WHEN 0 THEN 'crater' WHEN 1 THEN 'boulder_field' WHEN 2 THEN 'ridge' ELSE 'rille' END AS entity_type,
  CAST(c_custkey * 7919 % 17000 AS double) / 100 - 85 AS latitude, CAST(c_custkey * 104729 % 36000 AS double) / 100 AS longitude,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS elevation_m, abs(c_acctbal) / 100 AS uncertainty_m,
  CAST(c_custkey % 100 AS double) / 100 AS uncertainty FROM customer""",
    "v_observation": """
SELECT o_orderkey AS observation_id, 'LUNAR-ENT-' || lpad(CAST(o_custkey AS string), 6, '0') AS entity_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'OHRC' WHEN 1 THEN 'TMC-2' WHEN 2 THEN 'IIRS' WHEN 3 THEN 'LROC_NAC' ELSE 'SELENE_TC' END AS sensor,
  o_orderdate AS acquisition_time, e.latitude + CAST(o_orderkey * 31 % 41 - 20 AS double) / 2000 AS obs_lat,
  e.longitude + CAST(o_orderkey * 17 % 41 - 20 AS double) / 2000 AS obs_lon, CAST(o_orderkey * 37 % 360 AS double) AS sun_azimuth_deg,
  CAST(o_orderkey * 13 % 90 AS double) AS sun_elevation_deg, o_orderstatus = 'F' AS is_synthetic
FROM orders JOIN v_entity e ON e.ekey = o_custkey""",
    "v_epoch": """
SELECT 'E' || CAST(user_id AS string) AS entity_id, event_id AS epoch_id, ts, CAST(event_id * 37 % 360 AS double) AS solar_azimuth_deg,
  CAST(event_id * 7 % 60 AS double) AS solar_elevation_deg, 100 + CAST(event_id * 13 % 7 AS double) AS feature_diameter_m,
  value / 500 AS apparent_brightness, CASE WHEN event_id % 97 = 0 THEN 'CONTRADICTED' ELSE event_type END AS notes FROM events""",
    "v_match": """
SELECT l_suppkey AS pair_id, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS bigint) AS match_id, CAST(l_orderkey * 53 % 512 AS double) AS src_x,
  CAST(l_partkey * 29 % 512 AS double) AS src_y, CAST(l_orderkey * 53 % 512 AS double) + 25 + l_discount * 40 AS tgt_x,
  CAST(l_partkey * 29 % 512 AS double) - 18 + l_tax * 40 AS tgt_y, l_quantity * 4 AS distance FROM lineitem""",
    "v_evidence": """
SELECT l_orderkey * 10 + l_linenumber AS evidence_id, 'LUNAR-ENT-' || lpad(CAST(l_orderkey % 150 AS string), 6, '0') AS entity_id,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_suppkey END AS observation_id,
  CASE l_partkey % 10 WHEN 0 THEN 'GEOMETRIC' WHEN 1 THEN 'TERRAIN' WHEN 2 THEN 'ILLUMINATION' WHEN 3 THEN 'SPECTRAL' WHEN 4 THEN 'SCALE'
    WHEN 5 THEN 'TEMPORAL' WHEN 6 THEN 'TEXTURE' WHEN 7 THEN 'REGISTRATION' WHEN 8 THEN 'PHYSICAL' ELSE 'MANUAL' END AS evidence_type,
  CASE WHEN l_quantity <= 1 THEN 'CONTRADICTED' WHEN l_quantity <= 10 THEN 'REJECTED' WHEN l_quantity <= 30 THEN 'SUPPORTED'
    WHEN l_quantity <= 40 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'UNVALIDATED' END AS status, l_shipdate AS updated_at FROM lineitem""",
    "v_profile": """
SELECT l_orderkey * 10 + l_linenumber AS correspondence_id, CAST(l_orderkey * 7 % 101 AS double) / 100 AS visual_score,
  CAST(l_orderkey * 11 % 101 AS double) / 100 AS geometry_score, CAST(l_orderkey * 13 % 101 AS double) / 100 AS illumination_score,
  CAST(l_orderkey * 17 % 101 AS double) / 100 AS terrain_score, CAST(l_orderkey * 19 % 101 AS double) / 100 AS scale_score,
  CAST(l_orderkey * 23 % 101 AS double) / 100 AS spatial_score, l_quantity / 10 AS mean_err_px, 1 + l_extendedprice AS condition_number,
  l_discount * 10 AS inlier_ratio, l_linenumber % 2 = 0 AS is_synthetic,
  CASE WHEN l_quantity <= 10 THEN 'REJECTED' WHEN l_quantity <= 30 THEN 'UNCERTAIN' ELSE 'VERIFIED' END AS status,
  CAST(l_quantity AS bigint) AS num_inliers FROM lineitem""",
    # Associations of every observation with its entity; haversine on the lunar sphere.
    "v_association": """
SELECT observation_id, entity_id, sensor, acquisition_time, distance_m,
  CASE WHEN distance_m > 200 THEN 'REJECTED' ELSE 'SUPPORTED' END AS status,
  CASE WHEN distance_m > 200 THEN 'REJECTED' ELSE 'GEOMETRIC' END AS association_type
FROM (SELECT o.*, 1737400.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) AS distance_m FROM (
  SELECT o.*, pow(sin(radians(obs_lat - e.latitude) / 2), 2)
     + cos(radians(e.latitude)) * cos(radians(obs_lat)) * pow(sin(radians(obs_lon - e.longitude) / 2), 2) AS a
  FROM v_observation o JOIN v_entity e ON e.entity_id = o.entity_id) o)""",
    # Versioned reports of an observation about an entity; several per pair of keys.
    "v_report": """
SELECT 'R' || CAST(l_suppkey AS string) AS entity_id, l_partkey AS observation_id, (l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS bigint) AS version,
  CASE l_linenumber % 4 WHEN 0 THEN 'OHRC' WHEN 1 THEN 'TMC-2' WHEN 2 THEN 'IIRS' ELSE 'LROC_NAC' END AS sensor, l_shipdate AS acquisition_time,
  CASE WHEN l_quantity >= 50 AND l_suppkey % 3 = 0 THEN 'CONTRADICTED' WHEN l_quantity > 25 THEN 'SUPPORTED' ELSE 'REJECTED' END AS status,
  CASE WHEN l_quantity > 45 THEN 'TEMPORAL' ELSE 'DIRECT' END AS association_type FROM lineitem""",
    # Footprints, two metadata gaps included; odd keys have a calibrated grid.
    "v_footprint": """
SELECT observation_id, sensor, is_synthetic, obs_lat - 0.05 AS lat_min, obs_lat + CAST(observation_id % 7 AS double) / 100 AS lat_max,
  obs_lon - 0.05 AS lon_min, obs_lon + CAST(observation_id % 11 AS double) / 100 AS lon_max,
  observation_id % 3 <> 0 AS has_grid, observation_id % 2 = 0 AS has_polygon, sun_azimuth_deg, sun_elevation_deg,
  CAST(CASE WHEN observation_id % 6 = 0 THEN NULL WHEN sensor = 'OHRC' THEN 0.26 WHEN sensor = 'TMC-2' THEN 6.07
       WHEN sensor = 'IIRS' THEN 80.0 ELSE 1.0 END AS double) AS gsd_m, acquisition_time, entity_id FROM v_observation""",
    # Named observation pairs, some with an unregistered side, some with a measured gap.
    "v_pair": """
SELECT l_orderkey * 10 + l_linenumber AS pair_no, l_orderkey AS id_a, l_partkey * 8 + l_linenumber AS id_b,
  CAST(CASE l_linenumber WHEN 1 THEN 100.0 WHEN 2 THEN 300.0 END AS double) AS measured_gap_m FROM lineitem""",
    # Residuals tagged with a sweep, a method and a parameter value.
    "v_sweep": """
SELECT CASE l_suppkey % 3 WHEN 0 THEN 'scale' WHEN 1 THEN 'noise' ELSE 'overlap_fraction' END AS sweep,
  CASE l_partkey % 2 WHEN 0 THEN 'float-descriptor' ELSE 'binary-descriptor' END AS method, CAST(l_linenumber - 1 AS double) / 4 AS value,
  CASE l_orderkey % 4 WHEN 0 THEN 'scale' WHEN 1 THEN 'illum_30deg' WHEN 2 THEN 'reflection' ELSE 'partial_overlap' END AS condition,
  l_partkey % 2 = 0 AS physics, sqrt(l_discount * l_discount * 1600 + l_tax * l_tax * 1600) + CASE WHEN l_quantity > 45 THEN 40 ELSE 0 END AS residual FROM lineitem""",
    # Benchmark runs, one per line item.
    "v_run": """
SELECT 'PAIR-' || CAST(l_orderkey AS string) AS pair_id, CASE l_linenumber % 3 WHEN 0 THEN 'SIFT' WHEN 1 THEN 'ORB' ELSE 'RIFT' END AS matcher,
  l_suppkey AS experiment_id, CAST(l_linenumber - 1 AS integer) AS level_index, CAST(l_partkey % 60 AS bigint) AS keypoints_src, CAST(l_quantity AS bigint) * 3 AS keypoints_tgt,
  CAST(l_quantity AS bigint) AS candidates, CAST(floor(CAST(l_quantity AS bigint) * (l_linenumber - 1) / 8) AS bigint) AS inliers, CAST(l_linenumber - 1 AS double) / 8 AS inlier_ratio,
  l_discount * 50 AS mean_error_px, l_extendedprice / 100 AS condition_number, l_tax AS hull_ratio,
  CASE l_orderkey % 3 WHEN 0 THEN 'OHRC' WHEN 1 THEN 'TMC-2' ELSE 'IIRS' END AS source_sensor, CASE l_partkey % 3 WHEN 0 THEN 'OHRC' WHEN 1 THEN 'TMC-2' ELSE 'IIRS' END AS target_sensor,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(0.26 AS double) END AS src_gsd_m, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(6.07 AS double) END AS tgt_gsd_m,
  CAST(l_orderkey % 360 AS double) AS src_azimuth, CAST(l_partkey % 360 AS double) AS tgt_azimuth, l_tax < 0.05 AND l_discount < 0.05 AS is_stable,
  l_suppkey % 7 <> 0 AS is_real_data, CASE WHEN l_orderkey % 97 = 0 THEN 'Product Ingestion Failure: unreadable' END AS error FROM lineitem""",
    # Image samples: five products, 64 samples per line.
    "v_pixel": """
SELECT 'IMG-' || CAST(o_orderkey % 5 AS string) AS product_id, CAST(floor(o_orderkey / 5 / 64) AS bigint) AS line,
  CAST(floor(o_orderkey / 5) AS bigint) % 64 AS sample, CAST(0 AS bigint) AS band, CAST(CAST(floor(o_totalprice) AS bigint) % 4096 AS double) AS dn
FROM orders""",
    # Elevation cells, 128 per line; some nodata.
    "v_dem": """
SELECT CAST(floor(o_orderkey / 128) AS bigint) AS line, o_orderkey % 128 AS sample,
  CASE WHEN o_orderkey % 211 = 0 THEN -32768.0 ELSE CAST(CAST(floor(o_totalprice) AS bigint) % 3000 AS double) - 1500 END AS elev FROM orders""",
    # Source lattice: 41 nodes across, 100 samples apart; an oblique affine swath.
    "v_source_node": """
SELECT 'SRC' AS grid_id, CAST(o_orderkey % 41 * 100 AS bigint) AS pixel, CAST(floor(o_orderkey / 41) * 100 AS bigint) AS scan,
  20 + CAST(o_orderkey % 41 * 100 AS double) * 0.00025 + floor(o_orderkey / 41) * 100 * 0.00001 AS lon,
  0.5 + floor(o_orderkey / 41) * 100 * 0.00002 - CAST(o_orderkey % 41 * 100 AS double) * 0.000003 AS lat FROM orders""",
    # Target lattice: 31 nodes across, 50 samples apart, partly beside the source swath.
    "v_target_node": """
SELECT 'TGT' AS grid_id, CAST(o_orderkey % 31 * 50 AS bigint) AS pixel, CAST(floor(o_orderkey / 31) * 50 AS bigint) AS scan,
  20.2 + CAST(o_orderkey % 31 * 50 AS double) * 0.0006 + floor(o_orderkey / 31) * 50 * 0.00002 AS lon,
  0.4 + floor(o_orderkey / 31) * 50 * 0.00003 - CAST(o_orderkey % 31 * 50 AS double) * 0.000004 AS lat FROM orders""",
    # Points on the source image, some of them outside the lattice.
    "v_point": """
SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || CAST(round(l_extendedprice * 100) AS bigint) AS point_id, CAST(l_partkey * 37 % 4200 AS double) + l_discount * 5 - 50 AS pixel,
  CAST(l_orderkey * 100 AS double) / 41 + l_tax * 7 - 20 AS scan, l_suppkey AS pair_id FROM lineitem""",
}

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]


def needs(name: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\bv_\w+", SQL[name])) if n != name]


def closure(names: list[str]) -> list[str]:
    """Views in the order they must be defined."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in out:
            return
        for n in needs(name):
            add(n)
        out.append(name)

    for n in names:
        if n in SQL:
            add(n)
    return out


def build(tables, name: str):
    """The view as a DataFrame: its SQL over the DataFrames it names, without global temp names."""
    text = SQL[name]
    args = {}
    for n in needs(name):
        args[n] = getattr(tables, n[2:])
    for b in BASE:
        if re.search(rf"\b{b}\b", text):
            args[b] = tables.table(b)
    for n in args:
        text = re.sub(rf"\b{n}\b", "{" + n + "}", text)
    return tables.spark.sql(text, **args)
