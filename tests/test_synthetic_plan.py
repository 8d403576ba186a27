"""Synthetic windows: the projection is dealt out, and windows are moved once."""

from pyspark.sql import functions as F

from trackloom.operators.augment import WIN
from trackloom.operators.sequence import with_sequence_facts
from trackloom.operators.windows import features_in_windows, pack_windows
from trackloom.schemas import FEATURES_25


def test_a_join_that_multiplies_rows_is_not_one_task(spark):
    rows = spark.range(40).select(F.concat(F.lit("s"), F.col("id") % 20).alias("sequence_id"), F.floor(F.col("id") / 20).cast("int").alias("frame_idx"))
    facts = rows.select("sequence_id").distinct().select("sequence_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("camera"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_sequence_facts(rows, facts, fan_out=True)
        assert out.count() == 320
        assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_windows_are_not_moved_by_features_and_packing(spark):
    cols = {"view_label": F.lit("front"), "flip": F.lit(False), **{f"{k}_pred_{f}": F.lit(0.5) for k in ("head", "tail") for f in ("x", "y", "conf")}}
    df = spark.range(62).select(
        (F.col("id") / 1000).cast("int").cast("string").alias("swing_id"), (F.col("id") / 1000).cast("int").cast("string").alias("view_id"), (F.floor(F.col("id") / 31) * 5).alias("win_start"), (F.col("id") % 31).cast("int").alias("idx"),
        F.lit(36).cast("long").alias("n"), F.lit("").alias("image_stem"), F.lit(None).cast("string").alias("ctx")).withColumns(cols)
    df = df.withColumns({"pos": F.col("win_start") + F.col("idx"), "frame_idx": (F.col("win_start") + F.col("idx")).cast("int")})
    packed = pack_windows(features_in_windows(df.repartition(3, *WIN), WIN), FEATURES_25, keys=WIN)
    assert packed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.win_start: (len(r.x), r.start_frame_idx, r.end_frame_idx) for r in packed.collect()}
    assert got == {0: (31, 0, 30), 5: (31, 5, 35)}
