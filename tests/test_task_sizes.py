"""Partitions follow the rows, not the session: a task of the frame metrics holds a fixed number of rows."""

from pyspark.sql import functions as F

from trackloom.operators.metrics import with_sequence_scale
from trackloom.operators.scoring import AVERAGED, overlap_mean
from trackloom.operators.windows import supervised_windows
from trackloom.schemas import WindowSettings
from trackloom.session import tasks_for_rows


def _frames(spark, n=200):
    points = {f"{k}_{s}_{a}": F.col("id") + 0.5 for k in ("head", "tail") for s in ("pred", "gt") for a in "xy"}
    text = {f"{k}_visibility": F.lit("fully_visible") for k in ("head", "tail")}
    return spark.range(n).select(
        "id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("swing_id"), F.col("id").cast("string").alias("image_stem"),
        F.col("id").cast("int").alias("frame_idx"), F.lit("front").alias("view_label"), F.lit(False).alias("flip")).withColumns(
        {**points, **text, "head_pred_conf": F.lit(0.5), "tail_pred_conf": F.lit(0.5)})


def _averaged(wins, **kwargs):
    return overlap_mean(wins.withColumns({c: F.col("tail_x_norm") for c in AVERAGED}), **kwargs)


def test_tasks_follow_the_rows(spark):
    assert tasks_for_rows(spark, 400_000) is None  # four shuffle partitions hold them
    assert tasks_for_rows(spark, 4_000_001) == 41
    assert tasks_for_rows(spark, 24_000_000) == 240


def test_every_exchange_of_rows_has_the_wanted_number(spark):
    wins = supervised_windows(_frames(spark), WindowSettings(size=7, stride=3), keep_block=True, tasks=9)
    plan = _averaged(wins, tasks=9)._jdf.queryExecution().executedPlan().toString()
    numbers = [line.split("hashpartitioning(")[1].split("), ")[0].split(", ")[-1] for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(numbers) >= 5 and set(numbers) == {"9"}
    # Rows of the windows stay where their block is: the only exchange after the explode deals out frames.
    above = plan.split("Generate explode(CASE")[0]
    assert above.count("Exchange ") == 1


def test_results_do_not_depend_on_tasks(spark):
    settings = WindowSettings(size=7, stride=3)
    plain = _averaged(supervised_windows(_frames(spark), settings))
    sized = _averaged(supervised_windows(_frames(spark), settings, keep_block=True, tasks=9), tasks=9)
    order = lambda df: [tuple(r) for r in df.select(*plain.columns).orderBy("swing_id", "frame_idx").collect()]
    a, b = order(plain), order(sized)
    assert len(a) == 200
    for x, y in zip(a, b):
        assert all(abs(u - v) < 1e-12 if isinstance(u, float) else u == v for u, v in zip(x, y))


def test_frames_are_not_sorted_beside_the_scale_of_their_sequence(spark):
    rows = spark.createDataFrame([("a", True, 2.0), ("a", False, 9.0), ("a", True, 3.0), ("b", True, 1.0)], "swing_id string, target_valid boolean, v double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_sequence_scale(rows, F.col("v"))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.swing_id, r.v, r.max_length) for r in out.collect()) == [("a", 2.0, 3.0), ("a", 3.0, 3.0), ("a", 9.0, 3.0), ("b", 1.0, 1.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
