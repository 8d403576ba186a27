"""Queries over row windows and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import windows as W
from trackloom.operators.reshape import wide_observations
from trackloom.operators.scoring import argmax_class, overlap_mean, score_windows
from trackloom.operators.sequence import fill_linear, frame_positions
from trackloom.plans.flow import flow_observations
from trackloom.schemas import FEATURES_25, FEATURES_45, FLOW_SOURCE_COLUMNS, WindowSettings
from trackloom.workload import bindings as B
from trackloom.workload import frames as X
from trackloom.workload.bindings import cte
from trackloom.workload.flow_queries import TILED
from trackloom.workload.registry import R, query, r, rounded, rounded_small, rs

KEY = ["swing_id", "win_start", "idx", "frame_idx"]
KEYS = ", ".join(KEY)


def _windows(spark, d):
    return W.observation_windows(X.tracked(spark, d), tasks=B.frame_tasks(spark, d))


def _select(names):
    return lambda spark, d: rounded_small(_windows(spark, d).select(*KEY, *names))


def _sql(names):
    return f"select {KEYS}, " + ", ".join(f'{r(chr(34) + n + chr(34))} as "{n}"' for n in names) + " from features"


for _name, _cols in {
    "fill_nearest": ["head_x_norm", "head_y_norm", "tail_x_norm", "tail_y_norm", "head_valid", "tail_valid"],
    "lag_difference": ["bat_length_over_image_diagonal", "bat_length_change_over_image_diagonal"],
    "point_speed": ["head_speed_over_image_diagonal", "tail_speed_over_image_diagonal"],
    "point_acceleration": ["head_acceleration_over_image_diagonal", "tail_acceleration_over_image_diagonal"],
    "direction_change": ["bat_unit_x", "bat_unit_y", "bat_direction_change_1_minus_cos"],
    "window_time": ["window_time_minus1_to_plus1"],
    "clean_features_25": list(FEATURES_25),
}.items():
    query(_name, _sql(_cols), "features")(_select(_cols))


@query("tail_aligned_windows", "select swing_id, image_stem, cast(pos as bigint) as pos, win_start from win", "win")
def tail_aligned_windows(spark, d):
    rows = frame_positions(B.track(spark, d).select("swing_id", "image_stem", "frame_idx"))
    return W.explode_windows(rows).select("swing_id", "image_stem", "pos", "win_start")


@query("fill_linear", f"select swing_id, frame_idx, {rs(X._gts)} from gtfill", "gtfill")
def linear_fill(spark, d):
    out = W.target_rows(frame_positions(X.tracked(spark, d)))
    return rounded(out.select("swing_id", "frame_idx", *X._gts))


cte("wideflow", "select t.*, " + ", ".join(f"g.{c.removeprefix('global_')} as {c}" if c.startswith("global_") else f"l.{c}" for c in FLOW_SOURCE_COLUMNS)
    + " from tracked t join local_flow l using (image_stem) join global_flow g on g.swing_id = t.swing_id and g.frame_idx = t.frame_idx", "tracked", "local_flow", "global_flow")


def wide_flow(spark, d):
    """Tracked frames with the flow statistics of their fields."""
    return flow_observations(X.tracked(spark, d), B.flow_tiles(spark, d), scale=(240.0, 135.0), **TILED)


def _flow_sql(name: str, flip: str) -> str:
    v = f"coalesce({name}, 0)"
    if name.endswith("_valid") or name == "has_prev_flow":
        return f"case when {v} > 0 then 1e0 else 0e0 end"
    if "mag" in name:
        return f"least(greatest({v}, 0), 50) / 50e0"
    e = f"least(greatest({v}, -50), 50) / 50e0"
    return f"case when {flip} then -({e}) else {e} end" if "flow_x" in name and flip else e


@query("normalise_flow_columns", "select image_stem, " + ", ".join(
    f"{r(_flow_sql(s, ''))} as {f}" for s, f in zip(FLOW_SOURCE_COLUMNS, FEATURES_45[25:])) + " from wideflow", "wideflow")
def normalise_flow_columns(spark, d):
    return wide_flow(spark, d).select("image_stem", *[
        R(S.flow_feature(s, F.col(s), 50.0)).alias(f) for s, f in zip(FLOW_SOURCE_COLUMNS, FEATURES_45[25:])])


cte("features45", "select features.*, " + ", ".join(
    f"{_flow_sql(s, 'f.flip').replace('coalesce(' + s, 'coalesce(f.' + s)} as {n}" for s, n in zip(FLOW_SOURCE_COLUMNS, FEATURES_45[25:]))
    + " from features join wideflow f using (swing_id, image_stem)", "features", "wideflow")


@query("clean_features_45", "select swing_id, win_start, idx, frame_idx, " + ", ".join(f'{r(chr(34) + n + chr(34))} as "{n}"' for n in FEATURES_45) + " from features45", "features45")
def clean_features_45(spark, d):
    wins = W.observation_windows(wide_flow(spark, d), use_flow=True, tasks=B.frame_tasks(spark, d))
    return rounded_small(wins.select(*KEY, *FEATURES_45))


_l = "over (partition by swing_id order by pos)"
cte("legacy0", "select *, coalesce(head_x, 0) as hx, coalesce(head_y, 0) as hy, coalesce(tail_x, 0) as tx, coalesce(tail_y, 0) as ty from seq", "seq")
cte("legacy1", "select *, " + ", ".join(f"lag({p}, {i}) {_l} as {p}{i}" for p in ("hx", "hy", "tx", "ty") for i in (1, 2))
    + ", sqrt(((tx - hx) * 1920)**2 + ((ty - hy) * 1080)**2) as len from legacy0", "legacy0")
cte("legacy2", f"select *, case when len > 1e-6 then (tx - hx) * 1920 / len else 0e0 end as ux, case when len > 1e-6 then (ty - hy) * 1080 / len else 0e0 end as uy, lag(len) {_l} as len1 from legacy1", "legacy1")
cte("legacy3", f"select *, lag(ux) {_l} as ux1, lag(uy) {_l} as uy1 from legacy2", "legacy2")


@query("legacy_geometry_19", "select swing_id, image_stem, frame_idx, " + ", ".join(
    f'{r(f"cast({X._feat[n]} as double)")} as "{n}"' for n in FEATURES_25[:19]) + " from legacy3", "legacy3")
def legacy_geometry_19(spark, d):
    return rounded(W.legacy_features(X.tracked(spark, d)).drop("pos"))


@query("sequence_order", "select swing_id, image_stem, frame_idx, cast(pos as bigint) as pos, n from seq", "seq")
def sequence_order(spark, d):
    return frame_positions(B.track(spark, d).select("swing_id", "image_stem", "frame_idx"))


@query("pack_windows", "select swing_id, win_start, cast(min(frame_idx) as int) as start_frame_idx, cast(max(frame_idx) as int) as end_frame_idx, "
       "cast(count(*) as int) as rows, 25 as width, " + r('sum(tail_x_norm * (idx + 1))', 5) + " as checksum from features group by all", "features")
def pack_windows(spark, d):
    packed = W.pack_windows(_windows(spark, d), FEATURES_25)
    weighted = F.transform("x", lambda v, i: F.get(v, F.lit(2)) * (i + 1))
    return packed.select("swing_id", "win_start", "start_frame_idx", "end_frame_idx", F.size("x").alias("rows"),
                         F.size(F.get("x", F.lit(0))).alias("width"),
                         R(F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b), 5).alias("checksum"))


_DEC = list(X._avg)


@query("blend_prediction", f"select {KEYS}, {rs(_DEC)} from decoded", "decoded")
def blend_prediction(spark, d):
    return rounded_small(X.decoded(_windows(spark, d)).select(*KEY, *_DEC))


@query("overlap_mean", f"select swing_id, frame_idx, {rs(_DEC + ['filled_x', 'filled_y'])} from frames0", "frames0")
def overlap(spark, d):
    return rounded(X.scored_frames(spark, d).select("swing_id", "frame_idx", *_DEC, "filled_x", "filled_y"))


@query("argmax_mean_probs", "select swing_id, frame_idx, bucket_pred from frames1", "frames1")
def argmax_mean_probs(spark, d):
    return X.scored_frames(spark, d).select("swing_id", "frame_idx", "bucket_pred")


def stub_scorer():
    """Factory of the linear stand-in on [batch, rows, features]; holds plain arrays only."""
    import numpy as np
    weights = np.zeros((len(FEATURES_25), len(X.STUB_WEIGHTS)))
    bias = np.zeros(len(X.STUB_WEIGHTS))
    for j, terms in enumerate(X.STUB_WEIGHTS.values()):
        for name, w in terms.items():
            if name == "bias":
                bias[j] = w
            else:
                weights[FEATURES_25.index(name), j] = w
    return lambda: (lambda x: x @ weights + bias)


@query("score_windows", "select swing_id, win_start, idx, " + ", ".join(f"{r(f's{i}')} as s{i}" for i in range(10)) + " from scores", "scores")
def scored(spark, d):
    out = score_windows(_windows(spark, d), FEATURES_25, stub_scorer())
    return out.select("swing_id", "win_start", "idx", *[R(F.col("scores")[i]).alias(f"s{i}") for i in range(10)])


@query("velocity_loss_terms", "select * from (with v as (select swing_id, win_start, idx, target_valid as t, final_x * 1920 as px, final_y * 1080 as py, gt_tail_x * 1920 as gx, gt_tail_y * 1080 as gy, "
       + ", ".join(f"lag({e}, {k}) over w as {n}{k}" for e, n in (("target_valid", "t"), ("final_x * 1920", "px"), ("final_y * 1080", "py"), ("gt_tail_x * 1920", "gx"), ("gt_tail_y * 1080", "gy")) for k in (1, 2))
       + " from decoded window w as (partition by swing_id, win_start order by idx)) "
       "select swing_id, win_start, count(*) filter (t and t1) as velocity_pairs, "
       + r("sum(abs((px - px1) - (gx - gx1)) + abs((py - py1) - (gy - gy1))) filter (t and t1)", 5) + " as velocity_abs, "
       "count(*) filter (t and t1 and t2) as acceleration_triples, "
       + r("sum(abs((px - 2*px1 + px2) - (gx - 2*gx1 + gx2)) + abs((py - 2*py1 + py2) - (gy - 2*gy1 + gy2))) filter (t and t1 and t2)", 5)
       + " as acceleration_abs from v group by all)", "decoded")
def velocity_loss_terms(spark, d):
    from trackloom.operators.losses import with_window_lags
    rows = with_window_lags(X.flat(X.decoded(X.windows(spark, d))))
    c = F.col
    v, a = c("pair_ok"), c("triple_ok")
    vel = F.abs(c("vel_px") - c("vel_gx")) + F.abs(c("vel_py") - c("vel_gy"))
    acc = F.abs(c("acc_px") - c("acc_gx")) + F.abs(c("acc_py") - c("acc_gy"))
    return rows.groupBy("swing_id", "win_start").agg(
        F.count_if(v).alias("velocity_pairs"), R(F.sum(F.when(v, vel)), 5).alias("velocity_abs"),
        F.count_if(a).alias("acceleration_triples"), R(F.sum(F.when(a, acc)), 5).alias("acceleration_abs"))
