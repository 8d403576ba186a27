"""Catalogues, split files, exact shards, folder sinks and reports, written to a folder and read back."""

import os
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackloom.operators import contracts as K
from trackloom.sources import files as FS


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "swing_id string")


def test_wildcards_duplicates_and_label_folders(spark, tmp_path):
    for name in ("run1/labels", "run2", "other"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "f1.txt").write_text("x")
    (tmp_path / "run1/labels/skip.png").write_text("x")
    os.symlink(tmp_path / "run2", tmp_path / "link2")
    given = [f"{tmp_path}/run*", f"{tmp_path}/./run2/", f"{tmp_path}/link2", f"{tmp_path}/none*", f"{tmp_path}/absent", f"{tmp_path}/run1/labels"]
    found = FS.label_folders(FS.matched_folders(spark, given)).collect()
    short = [(r.given_no, r.path.rsplit("/", 1)[1], r.first, r.labels_dir.split(tmp_path.name)[1]) for r in found]
    assert short == [(0, "run1", True, "/run1/labels"), (0, "run2", True, "/run2"), (1, "run2", False, "/run2"), (2, "link2", False, "/link2"),
                     (4, "absent", True, "/absent"), (5, "labels", True, "/run1/labels")]
    files = FS.file_catalogue(spark, [f"{tmp_path}/run1", f"{tmp_path}/run1/labels"], pattern="*.txt", recursive=True).collect()
    assert [(r.path.rsplit("/", 2)[1:], r.length) for r in files] == [(["labels", "f1.txt"], 1)]
    assert FS.file_catalogue(spark, []).count() == 0
    assert FS.matched_folders(spark, []).count() == 0


def test_split_file_is_written_once_and_extended(spark, tmp_path):
    where = str(tmp_path / "deep" / "splits")
    some, more = [f"s{i}" for i in range(40)], [f"s{i}" for i in range(60)]
    first = FS.split_file(spark, where, ids(spark, some + some), train=0.8, val=0.1, seed=7).collect()
    assert Counter(r.split for r in first) == {"train": 32, "val": 4, "test": 4}
    stamp = {p: os.path.getmtime(p) for p in (os.path.join(d, f) for d, _, fs in os.walk(where) for f in fs)}
    again = FS.split_file(spark, where, ids(spark, some), train=0.1, val=0.1, seed=99).collect()
    assert sorted(first) == sorted(again)
    assert stamp == {p: os.path.getmtime(p) for p in (os.path.join(d, f) for d, _, fs in os.walk(where) for f in fs)}
    full = {r.swing_id: r for r in FS.split_file(spark, where, ids(spark, more), train=0.5, val=0.25, seed=7).collect()}
    assert len(full) == 60 and all(full[r.swing_id] == r for r in first)
    assert Counter(r.split for r in full.values() if r.generation == 1) == {"train": 10, "val": 5, "test": 5}
    assert {r.swing_id for r in FS.split_file(spark, where, ids(spark, ["s3", "s50"]), train=0.5, val=0.25, seed=7).collect()} == {"s3", "s50"}
    assert not [f for f in os.listdir(where) if f.startswith("_staged")]


def test_a_place_taken_meanwhile_counts(spark, tmp_path, monkeypatch):
    """Another run publishes the same generation between the look and the rename: its assignments stay."""
    where = str(tmp_path / "splits")
    split = FS.entity_split

    def race(fresh, *args):
        monkeypatch.setattr(FS, "entity_split", split)
        other = spark.createDataFrame([("a", "val")], "swing_id string, split string")
        other.write.parquet(f"{where}/generation=0")
        return split(fresh, *args)
    monkeypatch.setattr(FS, "entity_split", race)
    out = {r.swing_id: (r.split, r.generation) for r in FS.split_file(spark, where, ids(spark, ["a", "b"]), train=1.0, val=0.0, seed=1).collect()}
    assert out == {"a": ("val", 0), "b": ("train", 1)}


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 950])
def test_shards_are_exact(spark, tmp_path, n):
    rows = spark.range(n).select(F.col("id"), F.when(F.col("id") % 10 < 8, "train").otherwise("val").alias("split"), (F.col("id") * 2).alias("payload"))
    if n == 0:
        assert FS.numbered_shards(rows, 50, ["id"]).count() == 0
        return
    where = str(tmp_path / "s")
    manifest = FS.write_exact_shards(rows, where, shard_size=50, order=["id"], seed=3).collect()
    sizes = Counter(r.split for r in rows.collect())
    for split, total in sizes.items():
        mine = sorted((r for r in manifest if r.split == split), key=lambda r: r.shard)
        assert [r.samples for r in mine] == [50] * (total // 50) + [total % 50] * (total % 50 > 0)
        assert [r.shard for r in mine] == list(range(len(mine))) and all(r.first_place == 0 and r.last_place == r.samples - 1 for r in mine)
    assert len({r.path for r in manifest}) == len(manifest)
    back = FS.read_shards(spark, where)
    assert sorted((r.id, r.payload) for r in back.collect()) == [(i, 2 * i) for i in range(n)]
    again = FS.numbered_shards(rows.repartition(7), 50, ["id"], seed=3)
    assert sorted((r.id, r.shard, r.place) for r in again.collect()) == sorted((r.id, r.shard, r.place) for r in back.collect())


def test_folder_sink_replaces_folders_and_quarantines(spark, tmp_path):
    where = str(tmp_path / "out")
    schema = "source_c3d string, frame_idx int"
    inputs = lambda *rows: spark.createDataFrame(list(rows), "source_c3d string, problem string")
    rows = spark.createDataFrame([("r/A B/x.c3d", 1), ("r/A B/x.c3d", 2), ("r/c/z.c3d", 3)], schema)
    counts = FS.write_folders(rows, inputs(("r/A B/x.c3d", None), ("r/A B/bad.c3d", "broken header"), ("r/A B/none.c3d", None), ("r/c/z.c3d", None)), where)
    assert {r.folder: (r.files, r.rows, r.skipped) for r in counts.collect()} == {"A_B": (1, 2, 2), "c": (1, 1, 0)}
    assert {(r.folder, r.source_c3d, r.problem) for r in FS.read_quarantine(spark, where).collect()} == {("A_B", "r/A B/bad.c3d", "broken header"), ("A_B", "r/A B/none.c3d", "no rows")}
    FS.write_folders(rows.filter("frame_idx = 3").withColumn("frame_idx", F.lit(9)), inputs(("r/c/z.c3d", None)), where)
    back = sorted((r.folder, r.frame_idx) for r in FS.read_folders(spark, where, schema + ", folder string").collect())
    assert back == [("A_B", 1), ("A_B", 2), ("c", 9)]
    FS.write_folders(rows.filter("frame_idx = 3"), inputs(("r/c/z.c3d", None)), where, append=True)
    assert FS.read_folders(spark, where, schema).count() == 4


def test_nested_report(spark, tmp_path):
    errors = spark.createDataFrame([("raw", "all", 3, 1.5), ("raw", "none", 0, None), ("final", "all", 3, 0.25)], "series string, grp string, count long, rmse double")
    trust = spark.createDataFrame([("all", 0.5)], "grp string, mean double")
    frames = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "swing_id string, i int")
    report = FS.nested_report({"error": (errors, "series", "grp"), "trust": (trust, None, "grp")}, {"swings": F.count_distinct("swing_id"), "frames": F.count(F.lit(1))}, frames)
    where = str(tmp_path / "report")
    FS.write_report(report, where)
    assert len([f for f in os.listdir(where) if f.endswith(".json")]) == 1
    back = FS.read_report(spark, where, "swings: bigint, frames: bigint")
    row = back.first()
    assert tuple(row.run) == (2, 3) and row.metrics["error"]["final"]["all"] == {"count": 3.0, "rmse": 0.25}
    assert {(r.metric, r.series, r.grp, r.stat): r.value for r in FS.report_rows(back).collect()} == {
        ("error", "raw", "all", "count"): 3.0, ("error", "raw", "all", "rmse"): 1.5, ("error", "raw", "none", "count"): 0.0, ("error", "raw", "none", "rmse"): None,
        ("error", "final", "all", "count"): 3.0, ("error", "final", "all", "rmse"): 0.25, ("trust", "all", "all", "mean"): 0.5}


def test_one_changed_cell_changes_the_fingerprint(spark):
    df = spark.createDataFrame([("a", 1.25, None), ("b", 2.5, "x"), ("b", 2.5, "x")], "k string, v double, t string")
    whole = K.content_fingerprints(df, ["k", "v", "t"]).first()
    assert whole.rows == 3 and K.content_fingerprints(df.repartition(3).orderBy(F.desc("v")), ["k", "v", "t"]).first() == whole
    for change in (df.withColumn("v", F.when(F.col("k") == "a", 1.250001).otherwise(F.col("v"))), df.dropDuplicates(), df.withColumn("t", F.coalesce("t", F.lit("")))):
        assert K.content_fingerprints(change, ["k", "v", "t"]).first().fingerprint != whole.fingerprint
    assert K.content_fingerprints(df.limit(0), ["k", "v", "t"]).first().fingerprint == 0


def test_split_report(spark):
    point = lambda s, i, k: (s, f"{s}{i}", k, 1.0, 2.0, .5, 1., 2., 3., 4.)
    sel = spark.createDataFrame([point(s, i, k) for s, i in (("a", 1), ("a", 2), ("b", 1), ("z", 1)) for k in ("head", "tail")],
                                "swing_id string, image_stem string, keypoint string, pred_x double, pred_y double, pred_conf double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    flow = sel.filter("keypoint = 'head'").selectExpr("swing_id", "image_stem", *[f"{f} as {k}_{f}" for k in ("head", "tail") for f in ("pred_x", "pred_y", "pred_conf")], "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    splits = spark.createDataFrame([("a", "train"), ("b", "val")], "swing_id string, split string")
    out = {r.split: r for r in K.split_report(sel, flow, splits, {"train": (1, 2), "val": (2, 1), "test": (0, 0)}).collect()}
    assert {k: (r.selected_swings, r.frames, r.flow_rows, r.as_expected) for k, r in out.items()} == {
        "train": (1, 2, 2, True), "val": (1, 1, 1, False), "test": (0, 0, 0, True), None: (1, 1, 1, False)}
    changed = {r.split: r for r in K.split_report(sel, flow.withColumn("tail_pred_x", F.when(F.col("image_stem") == "a1", 9.0).otherwise(F.col("tail_pred_x"))), splits, {}).collect()}
    assert changed["train"].flow_fingerprint != out["train"].flow_fingerprint and changed["train"].selected_fingerprint == out["train"].selected_fingerprint
    assert changed["val"].flow_fingerprint == out["val"].flow_fingerprint
    assert {(r.split, r.swing_id, r.frames) for r in K.split_sequences(sel, splits).collect()} == {("train", "a", 2), ("val", "b", 1), (None, "z", 1)}


def test_an_empty_table_fails_where_rows_are_required(spark):
    df = spark.range(5).withColumn("s", F.lit("x"))
    assert K.require_rows(df, "nothing here").count() == 5
    with pytest.raises(PySparkException, match="nothing here"):
        K.require_rows(df.filter("id > 9"), "nothing here").collect()
    facts = spark.createDataFrame([(7,)], "n int")
    with pytest.raises(PySparkException, match="only 7 rows"):
        K.require_rows(df.filter("id > 9"), F.concat(F.lit("only "), F.col("n"), F.lit(" rows")), facts).collect()
    assert K.require_rows(df, F.col("n").cast("string"), facts).count() == 5


def test_differing_columns_are_named(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0), (3, 0.0, 0.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.5, 3.0), (4, 0.0, 0.0)], "k int, x double, y double")
    assert {r.k: r.differing for r in K.column_differences(a, b, ["k"], ["x", "y"]).collect()} == {1: [], 2: ["x"], 3: ["x", "y"], 4: ["x", "y"]}
