"""Every registered query against its SQL, and the shape of the plans that must scale."""

import pytest

import __spark_entry__ as entry
from compare import compare
from craterline.queries import load_all
from craterline.queries.registry import QUERIES

load_all()
SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    ok, text = compare(spark, name, QUERIES[name].run, ORACLE.get(name), SF)
    assert ok, text


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["gap_id", "entity_id", "gap_type"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j03_nearest_in_box", "j04_radius_association", "j04_radius_discovery", "j07_pixel_to_ground", "j08_ground_to_pixel",
                                  "d04_physical_gates", "j18_overlapping_footprints", "j01_tier_pairs", "d13_detect_gaps", "d10_entity_lifecycle"])
def test_no_row_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name].run(spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["a05_match_confidence"].run(spark, SF))
    assert "l_extendedprice" not in text.split("ReadSchema")[-1] or "match_id" not in text
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in text


def test_inverse_lookup_does_not_regroup_points(spark):
    """The inverse lookup is a join only: no aggregate above the scan of the points."""
    text = plan(QUERIES["j08_ground_to_pixel"].run(spark, SF))
    assert "SortAggregate" not in text
