"""Selection deals candidate lists out twice: facts come by bins, states by blocks, empty frames without lists."""

from pyspark.sql import functions as F

from trackloom.operators import sequence as Q
from trackloom.operators.selection import ordered_records


def _rows(spark):
    return spark.range(40).select((F.col("id") % 3).cast("string").alias("swing_id"), F.col("id").cast("int").alias("frame_idx"), F.col("id").cast("string").alias("image_stem"))


def test_facts_of_a_sequence_come_with_the_numbering(spark):
    facts = spark.createDataFrame([("0", 1.5), ("1", 2.5)], "swing_id string, anchor double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = Q.frame_positions(_rows(spark), facts=facts)
        want = {(r.image_stem, r.pos, r.anchor) for r in Q.frame_positions(_rows(spark)).join(facts, "swing_id", "left").collect()}
        assert {(r.image_stem, r.pos, r.anchor) for r in out.collect()} == want and len(want) == 40
        # Frames meet their bins and stay there: the join on the sequence is below that of the bins.
        joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
        assert "Inner" in joins[0] and "LeftOuter" in joins[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_states_by_block_are_those_of_the_rows(spark):
    p = Q.frame_positions(_rows(spark)).withColumns({
        "block": F.floor(F.col("pos") / 4), "step": F.when(F.col("pos") == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.col("frame_idx") % 2))})
    args = (p, "swing_id", "pos", "step", [])
    rows = {(r.swing_id, r.pos): (r.before, r.after) for r in Q.follow_states(*args, block="block", levels=1, fan=2).collect()}
    blocks = Q.follow_states(*args, block="block", levels=1, fan=2, by_block=True).collect()
    assert {(b.swing_id, b.first + i): (s.before, s.after) for b in blocks for i, s in enumerate(b.path)} == rows
    assert len(rows) == 40 and all(len(b.path) <= 4 for b in blocks)


def test_numbering_needs_no_candidate_list(spark):
    rows = spark.createDataFrame([("s", "a", 1, "a", 2), ("s", "b", 2, "b", 0), ("s", "c", None, "c", 1)],
                                 "swing_id string, prediction_stem string, frame_no int, frame_name string, n_eligible int")
    assert sorted((r.prediction_stem, r.pos, r.turn) for r in ordered_records(rows).collect()) == [("a", 0, 0), ("b", 1, 1), ("c", 2, 1)]
