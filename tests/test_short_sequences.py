"""Sequences that one group holds are chosen where an exchange by sequence puts them; longer ones are cut, with the same choices."""

import random

from pyspark.sql import functions as F

from trackloom.operators.selection import select_candidates
from trackloom.schemas import DETECTION_TYPE


def _records(spark):
    rng = random.Random(3)
    rows = []
    for s, n in (("a", 40), ("b", 7), ("c", 1)):
        for i in range(n):
            found = [(k + 1, rng.random(), (rng.random(), rng.random(), 0.1, 0.1), (rng.random(), rng.random(), rng.random()), (rng.random(), rng.random(), rng.choice([0.05, 0.9])))
                     for k in range(rng.randrange(0, 4))]
            name = f"{i:09d}"
            rows.append((f"{s}_{name}", f"{s}_{name}", s, None if i % 9 == 4 else rng.randrange(0, 500), name, found))
    return spark.createDataFrame(rows, f"prediction_stem string, image_stem string, swing_id string, frame_no int, frame_name string, detections array<{DETECTION_TYPE.simpleString()}>")


def _table(df):
    return {r.image_stem: (r.pos, r.chosen, r.parts, r.n_detections) for r in df.collect()}


def test_whole_and_cut_sequences_have_the_same_choices(spark):
    records = _records(spark)
    whole = _table(select_candidates(records))
    assert len(whole) == 48 and sum(v[1] is not None for v in whole.values()) > 20
    assert _table(select_candidates(records, short_rows=0)) == whole
    assert _table(select_candidates(records, short_rows=10)) == whole


def test_frames_outside_only_take_no_part(spark):
    records = _records(spark)
    names = records.filter(F.col("frame_name") % 3 != 1).select("image_stem", "swing_id")
    want = _table(select_candidates(records.join(names.select("image_stem"), "image_stem", "left_semi").select(records.columns)))
    twice = names.unionByName(names)
    for short in (0, 10, 1024):
        assert _table(select_candidates(records, only=twice, short_rows=short)) == want


def test_lists_of_short_sequences_are_moved_once_and_stored_once(spark):
    out = select_candidates(_records(spark))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan  # no checkpoint of scored tables
    assert plan.count("RepartitionByExpression") == 1
