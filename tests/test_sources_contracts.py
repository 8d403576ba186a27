"""Files in, files out, and table contracts."""

import json

import pytest
from pyspark.sql import functions as F

from trackloom.operators import contracts as K
from trackloom.schemas import FEATURES_25, FEATURES_45, FLOW_KINDS, WindowSettings
from trackloom.sources import readers as I
from trackloom.sources import sinks as O


def test_detection_files_keep_line_order_on_ties(spark, tmp_path):
    d = tmp_path / "run" / "labels"
    d.mkdir(parents=True)
    line = "0 .5 .5 .2 .2 {} .4 .9 .6 .6 .8 {}"
    (d / "swing_1_000001.txt").write_text("\n".join([line.format(.1, .5), "junk line", line.format(.2, .9), line.format(.3, .5), "0 1 2"]) + "\n")
    (d / "swing_1_000002.txt").write_text("")
    for i in (1, 2):
        (tmp_path / "run" / f"swing_1_00000{i}.JPG").write_bytes(b"x")
    images = I.image_paths(I.list_files(spark, str(tmp_path / "run")))
    found = I.frame_population(I.read_detections(spark, str(d)), images)
    out = {r.prediction_stem: r.detections for r in found.collect()}
    assert [x.head.x for x in out["swing_1_000001"]] == [.2, .1, .3]
    assert [x.detection_rank for x in out["swing_1_000001"]] == [1, 2, 3]
    assert out["swing_1_000002"] == []


def test_annotations_last_line_wins_and_bad_numbers_raise(spark, tmp_path):
    p = tmp_path / "gt.csv"
    p.write_text("swing_id,frame,head_x\nswing_1,000001.jpg,1\nswing_1,000001.jpg,2\nswing_1,000002.jpg,\n")
    out = {r.image_stem: r.head_x for r in I.read_annotations(spark, str(p)).collect()}
    assert out == {"swing_1_000001": 2.0, "swing_1_000002": None}
    p.write_text("swing_id,frame,head_x\nswing_1,000001.jpg,oops\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        I.read_annotations(spark, str(p)).collect()


def test_splits_file(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"train": ["a", "b"], "val": ["c"], "test": []}))
    assert {(r.swing_id, r.split) for r in I.read_splits(spark, str(p)).collect()} == {("a", "train"), ("b", "train"), ("c", "val")}


def test_folder_writer_overwrites_or_appends(spark, tmp_path):
    rows = spark.createDataFrame([("root/A B/x.c3d", 1), ("root/A B/y.c3d", 2), ("root/c/z.c3d", 3)], "source_c3d string, frame_idx int")
    path = str(tmp_path / "out")
    O.write_by_folder(rows, path)
    O.write_by_folder(rows, path, append=True)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 6 and {r.folder for r in back.select("folder").distinct().collect()} == {"A_B", "c"}
    O.write_by_folder(rows, path)
    assert spark.read.option("header", True).csv(path).count() == 3


def test_shards_hold_at_most_their_size(spark, tmp_path):
    rows = spark.range(25).select(F.col("id"), F.when(F.col("id") < 20, "train").otherwise("val").alias("split")).coalesce(1)
    path = str(tmp_path / "shards")
    O.write_shards(rows, path, shard_size=10)
    sizes = spark.read.parquet(path).groupBy("split", F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) <= 10 and sum(r["count"] for r in sizes) == 25


def test_feature_lists():
    assert len(FEATURES_25) == 25 and len(FEATURES_45) == 45 == len(set(FEATURES_45))
    assert sorted(set(FLOW_KINDS.values())) == ["flag", "magnitude", "signed"] and len(FLOW_KINDS) == 20


def test_contract_travels_with_the_stored_table(spark, tmp_path):
    facts = K.feature_facts(True, "s1", window_size=31)
    K.stamped(spark.range(3), facts).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert K.contract_differences(back, facts) == []
    other = K.feature_facts(False, "s2", window_size=5)
    assert [n for n, _, _ in K.contract_differences(back, other)] == ["columns", "split", "setting.window_size"]
    with pytest.raises(ValueError, match="split: 's1' instead of 's2'"):
        K.require_contract(back, other)
    assert len(K.contract_differences(spark.range(1), facts)) == 4


@pytest.mark.parametrize("kw", [{"size": 0}, {"stride": -1}, {"width": float("inf")}, {"flow_clip_px": 0.0}])
def test_settings_are_guarded(kw):
    with pytest.raises(ValueError):
        WindowSettings(**kw)


def test_alignment_reports_the_changed_value(spark):
    sel = spark.createDataFrame([("s1", "frame_1", k, x, y, c, 1., 2., 30., 40.) for k, x, y, c in (("head", 10., 20., .9), ("tail", 25., 35., .8))],
                                "swing_id string, image_stem string, keypoint string, pred_x double, pred_y double, pred_conf double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    flow = spark.createDataFrame([("s1", "frame_1", 10., 20., .9, 25., 35., .8, 1., 2., 30., 40.)],
                                 "swing_id string, image_stem string, head_pred_x double, head_pred_y double, head_pred_conf double, tail_pred_x double, tail_pred_y double, tail_pred_conf double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    assert K.verify_alignment(sel, flow, expected_frames=1, expected_swings=1)["frame_count"] == 1
    with pytest.raises(ValueError, match="value_mismatches = 1"):
        K.verify_alignment(sel, flow.withColumn("tail_pred_y", F.lit(99.0)))
    with pytest.raises(ValueError, match="swing_count"):
        K.verify_alignment(sel, flow, expected_swings=2)
