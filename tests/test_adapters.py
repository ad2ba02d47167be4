"""Label adapters of a user's own, and hulls of keys with many blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from craterline.operators import matching as M
from craterline.sources import adapters as A
from craterline.sources import labels

MINE = A.LabelAdapter("MINE", marks=("kaguya_new",), extensions=(".img",), tags=("name",), fields={"product_id": lambda label: label.first("name"), "lines": lambda label: label.axis("line")})


def test_first_adapter_that_takes_a_name(spark):
    names = ["kaguya_new_1.xml", "KAGUYA_NEW_2.lbl", "kaguya_3.xml", "x.IMG", "plain.xml", "a.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    of = lambda adapters: [r[0] for r in df.select(A.adapter_of(F.col("n"), adapters=adapters)).collect()]
    assert of((MINE, *A.ADAPTERS)) == ["MINE", "MINE", "SELENE", "MINE", "GENERIC", "GENERIC"]
    assert of((*A.ADAPTERS, MINE)) == ["SELENE", "SELENE", "SELENE", "MINE", "GENERIC", "GENERIC"]
    assert of((MINE,)) == ["MINE", "MINE", "GENERIC", "MINE", "GENERIC", "GENERIC"]
    told = df.select(A.adapter_of(F.col("n"), F.when(F.col("n") == "a.png", "LROC"))).collect()
    assert told[-1][0] == "LROC"


def test_fields_of_an_added_adapter(spark):
    array = "<Array_2D><Axis_Array><axis_name>Line</axis_name><elements>70</elements></Axis_Array></Array_2D>"
    rows = [("f:/kaguya_new_1.xml", f"<l><name>a &amp; b</name>{array}</l>"), ("f:/kaguya_new_2.xml", "<l><name> </name></l>"), ("f:/kaguya_new_3.xml", None), ("f:/ch2_tmc_4.xml", f"<l><name>c</name>{array}</l>")]
    got = {r.path[-5]: r for r in labels.parse_labels(spark.createDataFrame(rows, "path string, content string"), adapters=(MINE, *A.ADAPTERS)).collect()}
    assert (got["1"].product_id, got["1"].lines, got["1"].instrument, got["1"].num_bands, got["1"].gsd_status) == ("a & b", 70, None, 1, "UNKNOWN")
    assert [got[i].product_id for i in "234"] == ["kaguya_new_2", "kaguya_new_3", "ch2_tmc_4"]
    assert (got["4"].adapter, got["4"].instrument, got["4"].lines, got["4"].mission) == ("ISSDC", "TMC-2", 70, "Chandrayaan-2")
    plain = labels.parse_labels(spark.createDataFrame(rows, "path string, content string"))
    assert plain.dtypes == labels.parse_labels(spark.createDataFrame(rows, "path string, content string"), adapters=(MINE,)).dtypes


def test_unknown_fields_are_refused():
    with pytest.raises(ValueError, match="colour"):
        A.LabelAdapter("X", fields={"colour": lambda label: label.first("colour")})


@pytest.mark.parametrize("shape", ["disc", "circle", "line"])
def test_hull_of_many_blocks(spark, shape):
    """Blocks of 40 points: inner points go, points on a circle are all corners, and a line has no area."""
    rng = np.random.default_rng(2)
    angle, radius = rng.uniform(0, 2 * np.pi, 3000), np.sqrt(rng.uniform(0, 1, 3000)) if shape == "disc" else np.ones(3000)
    xy = np.stack([radius * np.cos(angle), radius * np.sin(angle) * (shape != "line")], axis=1)
    rows = [("big", *p) for p in xy.tolist()] + [("small", *p) for p in xy[:7].tolist()] + [("two", 0.0, 1.0), ("two", 4.0, 1.0), ("null", None, 1.0)]
    got = {r.k: r.hull_area for r in M.hull_areas(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", block=40).collect()}
    assert set(got) == {"big", "small", "two"} and got["two"] == 0
    assert np.isclose(got["big"], M._area(M._hull(xy)), rtol=1e-9, atol=1e-12) and np.isclose(got["small"], M._area(M._hull(xy[:7])), rtol=1e-9, atol=1e-12)
