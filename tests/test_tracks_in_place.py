"""Tracks are numbered, downsampled and sharded where their rows lie; wide rows and samples are not moved for it."""

import statistics

from pyspark.sql import functions as F

from trackloom.operators import augment as A
from trackloom.operators.quantiles import group_quantiles
from trackloom.operators.sequence import number_in_place
from trackloom.schemas import WindowSettings
from trackloom.sources import files as FS

KEYS = ["swing_id", "view_id"]


def _data():
    """Two sequences, two views; gaps of one and two frames, a view whose hand changes, a point that is missing."""
    rows = []
    for s, step in (("a", 120.0), ("b", 240.0)):
        for v in ("v1", "v2"):
            for i in range(9000):
                if i % 50 != 7:
                    rows.append((s, v, i, None if i % 97 == 5 else i / step, "L" if v == "v2" and i % 3 == 0 else "R", "front", 1.0 + i, None if i % 101 == 0 else 2.0, 3.0, 4.0))
    return rows


SCHEMA = "swing_id string, view_id string, frame_idx int, time_sec double, batter_hand string, camera_name string, head_u double, head_v double, tail_u double, tail_v double"


def _laid(df):
    return df.withColumn(A.FRAME_PART, F.floor(F.col("frame_idx") / 4096)).repartition(4, "swing_id", A.FRAME_PART)


def _plain(rows):
    out = {}
    for key in sorted({r[:2] for r in rows}):
        group = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])
        times = [r[3] for r in group if r[3] is not None]
        step = max(1, round(1 / statistics.median([b - a for a, b in zip(times, times[1:]) if b > a]) / 60))
        kept = [r for r in group[::step] if r[4] == "R" and r[7] is not None]
        out.update({(*key, r[2]): (pos, len(kept)) for pos, r in enumerate(kept)})
    return out


def test_tracks_equal_the_definition(spark):
    rows = _data()
    df, want = spark.createDataFrame(rows, SCHEMA), _plain(rows)
    for given in (df, _laid(df)):
        got = {(r.swing_id, r.view_id, r.frame_idx): (r.pos, r.n) for r in A.clean_tracks(given).collect()}
        assert got == want
    one = A.clean_tracks(_laid(df), only=spark.createDataFrame([("b",)], "swing_id string"))
    assert {(r.swing_id, r.view_id, r.frame_idx) for r in one.collect()} == {k for k in want if k[0] == "b"}


def test_rows_are_not_moved_by_their_numbers(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = number_in_place(_laid(spark.createDataFrame(_data()[:400], SCHEMA)), *KEYS, A.FRAME_PART, [F.col("frame_idx")])
        plan = out._jdf.queryExecution().executedPlan().toString()
        # Rows pass the exchange that laid them out; what else moves are counts by view and maps by part.
        assert "Exchange hashpartitioning(swing_id" in plan
        for line in plan.splitlines():
            if "Exchange hashpartitioning(" in line and "view_id" in line:
                assert A.FRAME_PART not in line
        assert out.count() == 400
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_counted_values_have_the_same_quantiles(spark):
    values = [("g", float(v % 7)) for v in range(100)] + [("h", 2.5)]
    rows = spark.createDataFrame(values, "g string, v double")
    counted = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("times"))
    probs = {"p50": 0.5, "p90": 0.9}
    want = {tuple(r) for r in group_quantiles(rows, ["g"], {"v": F.col("v")}, probs).collect()}
    assert {tuple(r) for r in group_quantiles(counted, ["g"], {"v": F.col("v")}, probs, times="times").collect()} == want


def test_labels_that_come_with_the_frames(spark):
    lookup = spark.range(200).selectExpr("'a' as swing_id", "cast(id as int) as frame_idx", "case when id % 3 = 0 then 'ignore' else 'fully_visible' end as visibility").filter("frame_idx % 10 < 9 or frame_idx > 120")
    tracks = spark.range(200).selectExpr("'a' as swing_id", "'v' as view_id", "cast(id as int) as frame_idx", "id as pos", "200L as n")
    late = A.visibility_labels(A.clean_windows(tracks, WindowSettings()), lookup)
    early = A.visibility_labels(A.clean_windows(A.with_real_labels(tracks, lookup), WindowSettings()), None)
    cols = ["swing_id", "view_id", "win_start", "idx", "label", "found"]
    got = sorted(tuple(r) for r in early.select(*cols).collect())
    assert got == sorted(tuple(r) for r in late.select(*cols).collect()) and len(got) == 35 * 31


def test_samples_that_lie_by_shard_are_written_as_they_lie(spark, tmp_path):
    samples = spark.range(230).select(F.when(F.col("id") < 200, "train").otherwise("val").alias("split"), "id", (F.col("id") * 2).alias("payload"))
    plain = FS.write_exact_shards(samples, str(tmp_path / "a"), shard_size=50, order=["id"], seed=3)
    numbers = FS.numbered_shards(samples.select("split", "id"), 50, ["id"], seed=3)
    laid = samples.join(numbers, ["split", "id"]).repartition(4, "split", "shard")
    early = FS.write_exact_shards(laid, str(tmp_path / "b"), shard_size=50, order=["id"], seed=3)
    cols = ["split", "shard", "samples", "first_place", "last_place"]
    table = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert table(early) == table(plain) and len(table(early)) == 5
    held = lambda where: sorted(tuple(r) for r in FS.read_shards(spark, str(tmp_path / where)).select("split", "shard", "place", "id", "payload").collect())
    assert held("b") == held("a")
    assert early.select("path").distinct().count() == 5
