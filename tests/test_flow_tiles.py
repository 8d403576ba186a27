"""Tiled flow fields against whole-image numpy, and the merge checks inside the plan."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackloom.operators import flow as W
from trackloom.schemas import FLOW_REGIONS, GLOBAL_FLOW_STATS, REGION_FLOW_STATS


def image(rng, h, w, constant=False):
    return (np.full((h, w), 2.5), np.full((h, w), -1.0)) if constant else (rng.normal(1000, 3, (h, w)), rng.normal(0, 1e-3, (h, w)))


@pytest.fixture(scope="module")
def fields(spark):
    rng = np.random.default_rng(4)
    made = {("a", 2): image(rng, 7, 11), ("a", 3): image(rng, 7, 11, True), ("b", 2): image(rng, 20, 33), ("b", 9): image(rng, 1, 1)}
    rows = [(s, i - 1, i, f"{s}{i}", *fx.shape, fx.ravel().tolist(), fy.ravel().tolist()) for (s, i), (fx, fy) in made.items()]
    df = spark.createDataFrame(rows, "swing_id string, prev_frame_idx int, frame_idx int, flow_file string, height int, width int, fx array<double>, fy array<double>")
    return made, df


def expected(fx, fy):
    mag = np.hypot(fx, fy)
    q = np.percentile(mag, [50, 90, 95, 99])
    return dict(zip(GLOBAL_FLOW_STATS, [fx.mean(), fy.mean(), fx.std(), fy.std(), mag.mean(), mag.std(), mag.max(), *q], strict=True))


@pytest.mark.parametrize(("tile", "row_pixels"), [((3, 4), 20), ((64, 1024), 65_536), ((2, 50), 0)])
def test_whole_fields(spark, fields, tile, row_pixels):
    made, df = fields
    tiles = W.field_tiles(df, *tile)
    assert tiles.agg(F.max(F.size("fx"))).first()[0] <= tile[0] * tile[1]
    assert tiles.agg(F.sum(F.size("fx"))).first()[0] == sum(fx.size for fx, _ in made.values())
    got = {(r.swing_id, r.frame_idx): r for r in W.global_stats(tiles, row_pixels=row_pixels).collect()}
    assert got.keys() == made.keys()
    for key, (fx, fy) in made.items():
        for name, want in expected(fx, fy).items():
            assert got[key][name] == pytest.approx(want, rel=1e-9, abs=1e-9), (key, name)


@pytest.mark.parametrize("row_pixels", [10, 65_536])
def test_regions(spark, fields, row_pixels):
    made, df = fields
    rng = np.random.default_rng(8)
    frames = []
    for (s, i), (fx, _) in [*made.items(), (("c", 5), (np.zeros((3, 3)), None)), (("a", 1), (np.zeros((3, 3)), None))]:
        h, w = fx.shape
        for k in range(4):
            hx, hy, tx, ty = (float(v) for v in rng.uniform(-2, [w + 2, h + 2, w, h]))
            x1, x2 = sorted(float(v) for v in rng.uniform(-3, w + 3, 2))
            y1, y2 = sorted(float(v) for v in rng.uniform(-3, h + 3, 2))
            frames.append((f"{s}{i}_{k}", s, i, hx, hy, tx, ty if k else None, x1, y1, x2, y2))
    frames += frames[:1]
    names = "image_stem string, swing_id string, frame_idx int, head_pred_x double, head_pred_y double, tail_pred_x double, tail_pred_y double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double"
    tile = (4, 6)
    got = W.region_stats(spark.createDataFrame(frames, names), W.field_tiles(df, *tile), radius=2, pad=1, tile=tile, row_pixels=row_pixels).collect()
    assert len(got) == len(frames)
    seen = 0
    for r in got:
        f = next(x for x in frames if x[0] == r.image_stem)
        field = made.get((r.swing_id, r.frame_idx)) if r.frame_idx > 1 else None
        for region, (x, y) in (("head", f[3:5]), ("tail", f[5:7]), ("bbox", (None, None))):
            box = None
            if field is not None:
                h, w = field[0].shape
                if region == "bbox":
                    e = [int(np.clip(np.rint(v) + d, 0, top)) for v, d, top in ((f[7], -1, w), (f[9], 1, w), (f[8], -1, h), (f[10], 1, h))]
                    box = e if e[1] > e[0] and e[3] > e[2] else None
                elif x is not None and y is not None and 0 <= np.rint(x) < w and 0 <= np.rint(y) < h:
                    cx, cy = int(np.rint(x)), int(np.rint(y))
                    box = [max(cx - 2, 0), min(cx + 3, w), max(cy - 2, 0), min(cy + 3, h)]
            assert r[f"{region}_valid"] == int(box is not None)
            want = expected(field[0][box[2]:box[3], box[0]:box[1]], field[1][box[2]:box[3], box[0]:box[1]]) if box else dict.fromkeys(REGION_FLOW_STATS, 0.0)
            seen += box is not None
            for name in REGION_FLOW_STATS:
                assert r[f"{region}_{name}"] == pytest.approx(want[name], rel=1e-9, abs=1e-9), (r.image_stem, region, name)
    assert seen > 20 and FLOW_REGIONS


def test_region_pixels(spark, fields):
    made, df = fields
    frame = spark.createDataFrame([("x", "b", 2, 10.0, 10.0, None, None, 0.0, 0.0, 32.0, 19.0)], "image_stem string, swing_id string, frame_idx int, head_pred_x double, head_pred_y double, tail_pred_x double, tail_pred_y double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    px = W.region_pixels(frame, W.field_tiles(df, 6, 10), radius=3, pad=0, tile=(6, 10)).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("fx").alias("s")).collect()
    fx = made["b", 2][0]
    assert {r.region: r.n for r in px} == {"head": 49, "bbox": 32 * 19}
    assert next(r.s for r in px if r.region == "head") == pytest.approx(fx[7:14, 7:14].sum())


def test_no_fields_and_no_frames(spark, fields):
    _, df = fields
    frames = spark.createDataFrame([("x", "b", 2, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 2.0, 2.0)], "image_stem string, swing_id string, frame_idx int, head_pred_x double, head_pred_y double, tail_pred_x double, tail_pred_y double, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    r = W.region_stats(frames, W.field_tiles(df.limit(0))).first()
    assert (r.has_prev_flow, r.head_valid, r.head_flow_mag_max) == (0, 0, 0.0)
    assert W.region_stats(frames.limit(0), W.field_tiles(df)).count() == 0
    assert W.global_stats(W.field_tiles(df.limit(0))).count() == 0


@pytest.mark.parametrize("side", ["observations", "local flow"])
def test_a_repeated_key_fails_the_query_itself(spark, side):
    columns = ["image_stem", "swing_id", "frame"]
    once = spark.createDataFrame([("i", "s", "f"), ("j", "s", "g")], "image_stem string, swing_id string, frame string")
    twice = once.unionByName(once.limit(1))
    wide, local = (twice, once) if side == "observations" else (once, twice)
    merged = W.merge_local(wide, local.withColumn("has_prev_flow", F.lit(1)))  # building it runs no job
    with pytest.raises(PySparkException, match=f"{side}: repeated key image_stem="):
        merged.select(*columns, "has_prev_flow").collect()
    assert W.merge_local(once, once.withColumn("has_prev_flow", F.lit(1))).count() == 2


def test_merge_checks_cost_no_exchange(spark):
    """Counting uses the exchange that the merge needs: two sides, two exchanges."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(10).selectExpr("cast(id as string) as image_stem", "'s' as swing_id", "'f' as frame", "id as v")
        plan = W.merge_local(rows, rows.withColumnRenamed("v", "u"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "raise_error" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
