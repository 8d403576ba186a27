"""Features: fill rules, invariance to annotations, block borders."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import windows as W
from trackloom.operators import sequence as Q
from trackloom.schemas import FEATURES_25, WindowSettings

SMALL = WindowSettings(size=3, stride=1, include_first=True, width=1.0, height=1.0)
SCHEMA = ("swing_id string, image_stem string, frame_idx int, view_label string, flip boolean, head_pred_x double, head_pred_y double, head_pred_conf double, "
          "tail_pred_x double, tail_pred_y double, tail_pred_conf double")


def base(spark, **change):
    rows = [["s", f"f{i}", i, "1b_side", False, .1 * (i + 1), .1 * (i + 2), .9 - .1 * i, .1 * (i + 4), .1 * (i + 5), .7 - .1 * i] for i in range(3)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for key, value in change.items():
        col, row = key.rsplit("__", 1)
        rows[int(row)][names.index(col)] = value
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def feats(df, settings=SMALL):
    return sorted(W.observation_windows(df, settings).collect(), key=lambda r: (r.win_start, r.idx))


def test_tie_takes_the_earlier_row(spark):
    out = feats(base(spark, tail_pred_x__1=None, tail_pred_y__1=None))
    assert (out[1].tail_x_norm, out[1].tail_y_norm, out[1].tail_valid) == (pytest.approx(.4), pytest.approx(.5), 0.0)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_non_finite_is_invalid(spark, bad):
    for col in ("head_pred_x", "head_pred_y", "head_pred_conf"):
        out = feats(base(spark, **{f"{col}__0": bad}))
        assert out[0].head_valid == 0.0 and out[0].head_conf == 0.0 and out[0].head_x_norm == pytest.approx(.2)


def test_no_known_row_gives_zero(spark):
    out = feats(base(spark, **{f"tail_pred_conf__{i}": 0.0 for i in range(3)}))
    assert all(r.tail_x_norm == 0.0 and r.tail_valid == 0.0 for r in out)


def test_window_edges_reset_motion(spark):
    out = feats(base(spark))
    assert out[0].head_speed_over_image_diagonal == 0.0 and out[1].head_acceleration_over_image_diagonal == 0.0
    assert out[1].head_speed_over_image_diagonal == pytest.approx(.1)
    assert [r.window_time_minus1_to_plus1 for r in out] == [-1.0, 0.0, 1.0]


def test_small_blocks_give_the_same_features(spark, monkeypatch):
    rows = [("s", f"f{i:04d}", i, "front", i % 2 == 3, float(i % 7), float(i % 5), .5, None if i % 3 else float(i % 11), float(i % 4), .5) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    settings = WindowSettings(size=9, stride=4, width=10.0, height=10.0)
    whole = feats(df, settings)
    real = Q.with_halo
    monkeypatch.setattr(W, "with_halo", lambda d, **kw: real(d, **{**kw, "rows": 10}))
    cut = feats(df.repartition(5), settings)
    assert [tuple(r[c] for c in FEATURES_25) for r in whole] == [tuple(r[c] for c in FEATURES_25) for r in cut]


def test_carried_annotations_do_not_change_features(spark):
    a = W.observation_windows(base(spark).withColumn("gt", F.lit(1.0)), SMALL, carry=["gt"])
    b = W.observation_windows(base(spark).withColumn("gt", F.lit(float("nan"))), SMALL, carry=["gt"])
    assert a.select(*FEATURES_25).exceptAll(b.select(*FEATURES_25)).count() == 0
