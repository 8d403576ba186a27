"""Frame averages: window rows are hashed, not sorted, and a block is sorted once."""

from pyspark.sql import functions as F

from trackloom.operators.scoring import AVERAGED, overlap_mean
from trackloom.operators.windows import observation_windows


def _windows(spark):
    rows = [("s", 7, p, w, f"img{p}", float(w + p)) for p, ws in ((6, (0, 5)), (7, (0, 5, 7))) for w in ws]
    df = spark.createDataFrame(rows, "swing_id string, frame_idx int, pos long, win_start long, image_stem string, v double")
    return df.withColumns({**{c: F.col("v") for c in (*AVERAGED, "tail_x_norm", "tail_y_norm")}, "tail_seen": F.lit(True), "ctx": F.struct(F.col("pos").alias("from_pos"))})


def test_overlap_mean_hashes_window_rows(spark):
    out = overlap_mean(_windows(spark))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    first = [x for x in plan.splitlines() if "Aggregate(" in x][-1]
    assert "HashAggregate" in first
    r = out.first()
    assert r.trust == (6 + 11 + 7 + 12 + 14) / 5
    assert (r.image_stem, r.from_pos) == ("img7", 7)  # the lowest start, there the last row


def test_a_block_is_sorted_in_one_direction(spark):
    cols = {"view_label": F.lit("front"), "flip": F.lit(False), **{f"{k}_pred_{f}": F.lit(0.5) for k in ("head", "tail") for f in ("x", "y", "conf")}}
    df = spark.range(40).select(F.lit("s").alias("swing_id"), F.col("id").cast("string").alias("image_stem"), F.col("id").cast("int").alias("frame_idx")).withColumns(cols)
    assert "DESC" not in observation_windows(df)._jdf.queryExecution().sparkPlan().toString()
