"""Golden effect summaries on four rows, and empty groups."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import metrics as M

ROWS = [(1, 1, 1, 1, 2., 2., 1., 1.5, 1.2, 1., .1), (1, 1, 1, 1, 10., 9., 12., 8., 3., 2., .6),
        (1, 0, 1, 0, None, 12., 8., 9., 5., 4., .9), (1, 0, 0, 1, 4., 4., 3., 3., None, 0., None)]
NAMES = ["a", "vis", "t", "r", "raw_error", "filled_error", "final_error", "prior_error", "final_shift", "delta_mag", "trust"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(ROWS, ", ".join(f"{n} {'int' if n in ('a', 'vis', 't', 'r') else 'double'}" for n in NAMES))
    df = df.withColumns({"target_valid": F.col("t") == 1, "raw_valid": F.col("r") == 1})
    return M.in_groups(M.gain_rows(df, "final_error"), F.array_compact(F.array(F.lit("all"), F.when(F.col("vis") == 1, "vis"))))


def test_correction_effect(rows):
    out = {r.grp: r for r in M.effect_by_group(rows, ["all", "vis", "none"], shift_threshold=1.0).collect()}
    a = out["all"]
    assert (a.eligible_raw, a.raw_improved_count, a.raw_worsened_count, a.raw_effective_count, a.raw_hurt_count, a.raw_neutral_count) == (2, 1, 1, 1, 1, 0)
    assert (a.eligible_filled, a.filled_effective_count, a.filled_hurt_count, a.moved_count) == (3, 2, 1, 3)
    assert a.mean_gain_raw == pytest.approx(-0.5) and a.gain_filled_median == pytest.approx(1.0)
    assert a.mean_shift == pytest.approx(9.2 / 3) and a.shift_median == pytest.approx(3.0) and a.mean_delta == pytest.approx(7 / 3)
    n = out["none"]
    assert n.eligible_raw == 0 and n.raw_improved_rate is None and n.gain_raw_median is None


def test_trust_effect(rows):
    out = {(r.base, r.grp, r.bucket): r for r in M.trust_effect_rows(rows, ["all", "vis"]).collect()}
    assert len(out) == 20
    low = out[("filled", "all", "0.0_0.2")]
    assert (low["count"], low.eligible, low.effective_count) == (1, 3, 1) and low.trust_mean == pytest.approx(0.1)
    assert low.frame_rate == pytest.approx(1 / 3)
    assert out[("raw", "all", "0.8_1.0")]["count"] == 0 and out[("raw", "all", "0.8_1.0")].mean is None


def test_pck_curve_admits_equal_ratios(spark):
    df = spark.createDataFrame([("s", x / 1000) for x in range(0, 101, 10)] + [("s", 0.5)], "k string, ratio double")
    curve = {r.step: r for r in M.pck_curve(df, ["k"], "ratio").collect()}
    for step, r in curve.items():
        want = sum(1 for x in df.collect() if x.ratio <= step / 100 * 0.1) / 12
        assert r.pck == pytest.approx(want)


def test_error_stats_nan_poisons_its_group(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 4.0), ("b", float("nan")), ("b", 1.0)], "k string, e double")
    out = {r.k: r for r in M.error_stats(df, ["k"], "e").collect()}
    assert out["a"].rmse == pytest.approx(12.5 ** .5) and out["b"].rmse != out["b"].rmse and out["b"].p90 != out["b"].p90
