"""Marker rows move once for the skeleton, and its numbers are rounded in double arithmetic up to a limit."""

import random

from pyspark.sql import functions as F

from trackloom.operators import projection as P
from trackloom.schemas import BODY_MARKERS
from trackloom.workload.registry import rounded, rounded_small


def test_marker_rows_move_once(spark):
    body = spark.range(9000).select(F.concat(F.lit("s"), F.floor(F.col("id") / 2) % 2).alias("sequence_id"), F.floor(F.col("id") / 2).cast("int").alias("frame_idx"),
                                    F.when(F.col("id") % 2 == 0, BODY_MARKERS[0]).otherwise(BODY_MARKERS[3]).alias("marker"), *[(F.col("id") + 1.0).alias(a) for a in "xyz"])
    cams = spark.createDataFrame([("s0", "c1"), ("s0", "c2"), ("s1", "c1"), ("s1", "c2")], "sequence_id string, camera_id string").withColumns(
        {**{f"{n}_{a}": F.lit(1.0) for n in ("eye", "fwd", "right", "up") for a in "xyz"}, "zoom": F.lit(1.0), "pan_x": F.lit(0.0), "pan_y": F.lit(0.0)})
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.skeleton(body, cams)
        plan = out._jdf.queryExecution().executedPlan().toString()
        moves = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert not any("frame_idx" in line or "marker" in line for line in moves)
        assert sum("REPARTITION_BY_NUM" in line for line in moves) == 1
        assert out.count() == 9000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_large_numbers_round_as_before(spark):
    rng = random.Random(8)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-3, 17) for _ in range(20_000)] + [0.0, -0.0, None, float("nan"), float("inf"), -float("inf"), 1e9, -1e9]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(4)
    plain, fast = ({r.id: repr(r.v) for r in f(df).collect()} for f in (lambda d: rounded(d, digits=4), lambda d: rounded_small(d, 4, limit=1e9)))
    assert plain == fast and len(fast) == len(values)
