"""Keys beyond the usual widths, exact number text, and plans that deal out long sequences."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import flow, reshape
from trackloom.operators.augment import time_steps
from trackloom.operators.sequence import block_window, frame_positions, with_halo
from trackloom.schemas import GLOBAL_FLOW_STATS


def test_long_numbers_are_never_cut(spark):
    df = spark.createDataFrame([("1",), ("1000001",), ("10000000001",)], "n string")
    assert [r[0] for r in df.select(S.padded(F.col("n"), 6)).collect()] == ["000001", "1000001", "10000000001"]
    frames = spark.createDataFrame([("000001.jpg",), ("1000001.jpg",), ("f10000000001",), (None,), ("none",)], "f string")
    assert [r[0] for r in frames.select(S.frame_number(F.col("f"))).collect()] == [1, 1000001, 10000000001, 0, 0]


def test_labels_of_far_frames_stay_apart(spark):
    rows = [("s", "000001", "ignore", 1), ("s", "1000001", "fully_occluded", 2)]
    df = spark.createDataFrame(rows, "swing_id string, frame string, tail_visibility string, line long").withColumn("image_stem", F.col("frame"))
    got = {r.frame_idx: r.visibility for r in reshape.visibility_from_labels(df, "line").collect()}
    assert got == {1: "ignore", 1000001: "fully_occluded"}


def test_number_text_rounds_the_exact_value_half_to_even(spark):
    values = [587.25, 592.65, 0.05, -0.05, 1e-7, 0.5, 2.5, 0.125, 0.0625, 1e15 + 0.5, 99.95, 9.96, -3.75, 0.0, 123456.789, 5e-7, 1.5e-6, 0.35, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 3, 6):
        got = [r[0] for r in df.select(S.fixed_text(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]
    assert df.limit(1).select(S.fixed6(F.lit(None).cast("double"))).first()[0] == ""


def test_step_uses_all_gaps(spark):
    times = [i / 360 for i in range(200)] + [10 + i / 120 for i in range(400)]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "g string, pos long, time_sec double")
    assert time_steps(df, ["g"], 60.0, 360.0).first().step == 2


def test_repeated_flow_keys_are_refused(spark):
    """The merge is checked inside its plan, so the query fails, not its construction."""
    names = ["has_prev_flow", "prev_frame_idx", "flow_file", "frame_name", *GLOBAL_FLOW_STATS]
    wide = spark.createDataFrame([("s", 1)], "swing_id string, frame_idx int")
    stats = spark.createDataFrame([("s", 1), ("s", 1)], "swing_id string, frame_idx int").withColumns({n: F.lit(0) for n in names})
    merged = flow.merge_global(wide, stats)
    with pytest.raises(PySparkException, match="global flow: repeated key swing_id=s, frame_idx=1"):
        merged.collect()
    assert flow.merge_global(wide, stats.distinct()).count() == 1


def test_one_long_sequence_is_dealt_out(spark):
    """After a join on the sequence, windows over bins and blocks still get exchanges of their own."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "long").otherwise(F.col("id").cast("string")).alias("swing_id"),
                                          F.col("id").alias("frame_idx"), F.col("id").cast("string").alias("image_stem"))
        facts = rows.select("swing_id").distinct().withColumn("fact", F.lit(1))
        placed = frame_positions(rows.join(facts, "swing_id"))
        halo = with_halo(placed, before=1, after=0).withColumn("last", F.lag("frame_idx").over(block_window()))
        plan = halo._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(swing_id" in plan and "block" in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
        sizes = [r[0] for r in halo.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert halo.filter("not is_halo").count() == 60_000
        assert max(sizes) < 0.55 * sum(sizes)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
