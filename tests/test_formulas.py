"""Closed-form values of the column functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from craterline.functions import geo
from craterline.functions import score as S
from craterline.functions import text as T
from craterline.functions import uncertainty as U
from craterline.functions.common import fixed, round_at
from craterline.operators import gaps as G
from craterline.operators import verification as V
from craterline.operators.geometry import PushBroom


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


L = F.lit
TMC = PushBroom.named("TMC-2")


def test_haversine(spark):
    assert one(spark, geo.haversine_m(L(0.5542), L(23.411), L(0.5692), L(23.411))) == pytest.approx(454.8503, abs=1e-3)


def test_parallax(spark):
    args = (TMC.altitude_m, TMC.gsd_m, TMC.center)
    assert abs(one(spark, geo.ground_displacement(L(1000.0), L(3800.0), *args))) == pytest.approx(88.9648, abs=1e-4)
    assert one(spark, F.degrees(geo.look_angle(L(3800.0), *args))) == pytest.approx(5.0839, abs=1e-4)
    assert one(spark, geo.max_displacement(L(3000.0), TMC.altitude_m, TMC.gsd_m, 4000, TMC.center)) == pytest.approx(296.393, abs=1e-3)
    assert one(spark, geo.ground_displacement(L(0.0), L(3800.0), *args)) == 0.0
    assert one(spark, geo.ground_displacement(L(500.0), L(1999.5), *args)) == 0.0
    assert one(spark, geo.ground_displacement(L(None).cast("double"), L(10.0), *args)) is None


def test_geometric_interval(spark):
    assert one(spark, U.geometric_interval(L(0.26), 59.0, 20.0)) == [0.26, 62.30]


def test_azimuth_difference_wraps(spark):
    assert one(spark, geo.azimuth_difference(L(350.0), L(10.0))) == 20.0


@pytest.mark.parametrize("scores,err,cond,ratio,total,status", [
    ([0.9] * 6, 0.5, 1.5, 0.8, 0.0858, "CALIBRATED_LOW_UNCERTAINTY"),
    ([0.9, 0.9, 0.1, 0.9, 0.9, 0.9], 0.5, 1.5, 0.8, 0.3780, "HIGH_EPISTEMIC_RISK"),
    ([0.99, 0.05, 0.10, 0.02, 0.20, 0.10], None, None, 0.05, 0.9143, "HIGH_EPISTEMIC_RISK"),
])
def test_uncertainty_golden(spark, scores, err, cond, ratio, total, status):
    df = spark.createDataFrame([(*scores, err, cond, ratio, "VERIFIED")], ", ".join(f"{c} double" for c in V.SCORES) + ", mean_err_px double, condition_number double, inlier_ratio double, status string")
    r = V.pair_uncertainty(df).first()
    assert r["total_uncertainty"] == pytest.approx(total, abs=1e-4) and r["calibration_status"] == status


def test_illumination_golden(spark):
    az = one(spark, geo.azimuth_difference(L(268.810944), L(285.644863)))
    assert az == pytest.approx(16.8339, abs=1e-4)
    v = one(spark, S.illumination_score(L(268.810944), L(285.644863), L(10.130514), L(57.314926), L(0.7)))
    assert v == pytest.approx(0.6621, abs=1e-4)


def test_information_gain_golden(spark):
    e = spark.createDataFrame([("LUNAR-ENT-000001", 0.10)], "entity_id string, uncertainty double")
    links = spark.createDataFrame([], "entity_id string, sensor string")
    rows = {r["sensor"]: r["expected_information_gain"] for r in G.rank_sensors(e, links).collect()}
    assert rows == {"OHRC": 0.0310, "TMC-2": 0.0518, "IIRS": 0.1814}


def test_condition_number_matches_svd(spark):
    rng = np.random.RandomState(3)
    hs = [rng.randn(9) for _ in range(40)] + [np.eye(3).ravel(), np.diag([2, .001, 1]).ravel(), np.array([1, 0, 0, 0, 1, 0, 1e-3, 0, 1.])]
    df = spark.createDataFrame([(i, [float(v) for v in h]) for i, h in enumerate(hs)], "i int, h array<double>")
    got = {r["i"]: r["c"] for r in df.select("i", S.condition_number(F.col("h"), 512.0).alias("c")).collect()}
    t, inv = np.diag([1 / 512, 1 / 512, 1.0]), np.diag([512.0, 512.0, 1.0])
    for i, h in enumerate(hs):
        assert got[i] == pytest.approx(np.linalg.cond(t @ h.reshape(3, 3) @ inv), rel=1e-6)


def test_degenerate_transforms(spark):
    hs = {"squash": [2, 0, 0, 0, .001, 0, 0, 0, 1], "mirror": [-1, 0, 512, 0, 1, 0, 0, 0, 1], "pole": [1, 0, 0, 0, 1, 0, -1 / 512, 0, 1], "fine": [1, 0, 25, 0, 1, -18, 0, 0, 1]}
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in hs.items()], "k string, h array<double>")
    df = V.transform_checks(df, 512.0, 512.0)
    bad = S.degeneracies(*[F.col(c) for c in ("condition_number", "det2", "det3", "anisotropy", "corner_pole", "corners_valid")], L(1.0), L(1.0), L(2.0))
    r = {x["k"]: " ".join(x["b"]) for x in df.select("k", bad.alias("b")).collect()}
    assert "HIGH_CONDITION_NUMBER" in r["squash"] and "EXTREME_DETERMINANT" in r["squash"]
    assert "NEGATIVE_HOMOGRAPHY_DETERMINANT" in r["mirror"] and "NON_CONVEX" in r["mirror"]
    assert "VANISHING_LINE_IN_FRAME_POLE" in r["pole"] and "NON_CONVEX_FLIPPED_CORNER_PROJECTION" in r["pole"]
    assert r["fine"] == ""


def test_text_rounding_uses_binary_value(spark):
    assert one(spark, fixed(L(12.35), 1)) == f"{12.35:.1f}"
    assert one(spark, fixed(L(1234.0), 2)) == "1234.00"
    assert one(spark, round_at(L(0.12345), 4)) == 0.1235


def test_iso_timestamp(spark):
    assert one(spark, T.iso_timestamp(L("2021-04-02T05:46:28.4043Z"))).year == 2021
    assert one(spark, T.iso_timestamp(L("not a date"))) is None


def test_scale_ratio_needs_positive(spark):
    assert one(spark, S.scale_ratio(L(0.26), L(6.07))) == pytest.approx(23.346, abs=1e-3)
    assert one(spark, S.scale_ratio(L(0.0), L(6.07))) is None
