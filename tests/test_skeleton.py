"""Skeleton rows: compiled column arithmetic, absent markers stay NULL."""

from pyspark.sql import functions as F

from trackloom.operators import projection as P
from trackloom.schemas import BODY_MARKERS


def test_skeleton_is_column_arithmetic(spark):
    names = ("eye", "fwd", "right", "up")
    basis = {"eye": (0.0, 0.0, 0.0), "fwd": (0.0, 0.0, 1.0), "right": (1.0, 0.0, 0.0), "up": (0.0, 1.0, 0.0)}
    cols = {f"{n}_{a}": F.lit(v) for n in names for a, v in zip("xyz", basis[n])}
    cams = spark.createDataFrame([("s", "c1"), ("s", "c2")], "sequence_id string, camera_id string").withColumns(
        {**cols, "zoom": F.lit(1.0), "pan_x": F.lit(0.0), "pan_y": F.lit(0.0)})
    m0, m1 = BODY_MARKERS[:2]
    body = spark.createDataFrame([("s", 0, m0, 0.0, 0.0, 2.0), ("s", 0, m0, 0.0, 0.0, 1.0), ("s", 1, m1, 0.5, 0.0, 1.0)],
                                 "sequence_id string, frame_idx int, marker string, x double, y double, z double")
    wide = P.skeleton_columns(P.skeleton(body, cams))
    assert "lambda" not in wide._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.frame_idx, r.camera_id): r for r in wide.collect()}
    assert len(got) == 4
    row = got[(0, "c1")]
    assert (row[f"skel_{m0}_u"], row[f"skel_{m0}_v"], row[f"skel_{m0}_depth"], row[f"skel_{m0}_in_frame"]) == (960.0, 540.0, 2.0, True)
    assert row[f"skel_{m1}_u"] is None and row[f"skel_{m1}_in_frame"] is False
    assert got[(1, "c2")][f"skel_{m1}_u"] > 960.0
