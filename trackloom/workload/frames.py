"""Windows, features and scored frames of ``track``, with matching SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.metrics import frame_errors
from trackloom.operators.reshape import attach_metadata, clip_metadata
from trackloom.operators.scoring import decode_scores, linear_scores, overlap_mean
from trackloom.operators.windows import supervised_windows
from trackloom.session import materialised
from trackloom.schemas import FEATURES_25, FEATURES_45, FLOW_SOURCE_COLUMNS, WindowSettings
from trackloom.workload import bindings as B
from trackloom.workload.bindings import cte

SETTINGS = WindowSettings()

# A linear stand-in for a trained model, so that scores can be recomputed in SQL.
STUB_WEIGHTS = {
    "prior_x": {"tail_x_norm": 0.9, "head_x_norm": 0.1},
    "prior_y": {"tail_y_norm": 0.9, "head_y_norm": 0.1},
    "delta_x": {"bat_unit_x": 6.0, "window_time_minus1_to_plus1": 2.0},
    "delta_y": {"bat_unit_y": 6.0, "window_time_minus1_to_plus1": -2.0},
    "trust": {"tail_conf": 4.0, "window_time_minus1_to_plus1": 0.5, "bias": -2.0},
    "bucket0": {"tail_speed_over_image_diagonal": -6.0, "bias": 1.0},
    "bucket1": {"tail_conf": 1.0},
    "bucket2": {"window_time_minus1_to_plus1": 1.0},
    "bucket3": {"tail_speed_over_image_diagonal": 6.0},
    "quality": {"tail_conf": 3.0, "bias": -1.0},
}


# The same for the 45 columns: flow moves the prediction and its trust.
FLOW_STUB_WEIGHTS = {
    **STUB_WEIGHTS,
    "delta_x": {**STUB_WEIGHTS["delta_x"], "tail_flow_x_mean_clipped_norm": 9.0, "global_flow_x_mean_clipped_norm": -4.0},
    "delta_y": {**STUB_WEIGHTS["delta_y"], "tail_flow_y_mean_clipped_norm": 9.0, "global_flow_y_mean_clipped_norm": -4.0},
    "trust": {**STUB_WEIGHTS["trust"], "tail_flow_mag_p95_clipped_norm": 1.5, "has_prev_flow": 0.25},
    "quality": {**STUB_WEIGHTS["quality"], "bbox_flow_mag_mean_clipped_norm": -2.0},
}


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip_metadata(B.clips(spark, sf_dir), "line_no")


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_metadata(B.track(spark, sf_dir), metadata(spark, sf_dir), tasks=B.frame_tasks(spark, sf_dir))


def _canon(t: str, left: str) -> str:
    side = f"case when {left} then '3b_side' else '1b_side' end"
    back = f"case when {left} then '1b_side' else '3b_side' end"
    base = (f"case when {t} = 'side' then {side} when {t} = 'back' then {back} "
            f"when {t} like '%1b%' or {t} like '%first%' then '1b_side' when {t} like '%3b%' or {t} like '%third%' then '3b_side' "
            f"when {t} like '%front%' then 'front' when {t} like '%home%' then 'home_side' else 'random' end")
    return (f"case when {left} and ({base}) = '1b_side' then '3b_side' when {left} and ({base}) = '3b_side' then '1b_side' "
            f"else ({base}) end")


_T, _L = "lower(trim(view))", "lower(trim(batter_side)) like 'l%'"
cte("meta", f"select name as swing_id, case when {_L} then 'left' else 'right' end as side, case when {_L} then 'L' else 'R' end as hand, "
    f"{_L} as flip, case when view = '' then 'random' else view end as source_view, {_canon(_T, _L)} as view_label from clips", "clips")
cte("tracked", "select track.*, coalesce(side, 'right') as side, coalesce(hand, 'R') as hand, coalesce(flip, false) as flip, "
    "coalesce(source_view, 'random') as source_view, coalesce(view_label, 'random') as view_label from track left join meta using (swing_id)",
    "track", "meta")
_ok = {k: f"coalesce({k}_pred_x is not null and {k}_pred_y is not null and {k}_pred_conf > 0, false)" for k in ("head", "tail")}
cte("seq", "select *, row_number() over (partition by swing_id order by frame_idx, image_stem) - 1 as pos, "
    "count(*) over (partition by swing_id) as n, "
    + ", ".join(f"{_ok[k]} as {k}_ok, case when flip then 1 - {k}_pred_x / 1920e0 else {k}_pred_x / 1920e0 end as {k}_x, "
                f"{k}_pred_y / 1080e0 as {k}_y, case when {_ok[k]} then {k}_pred_conf else 0e0 end as {k}_c, "
                f"case when flip then 1 - {k}_gt_x / 1920e0 else {k}_gt_x / 1920e0 end as gt_{k}_rx, {k}_gt_y / 1080e0 as gt_{k}_ry"
                for k in ("head", "tail")) + " from tracked", "tracked")
_gts = [f"gt_{k}_{a}" for k in ("head", "tail") for a in "xy"]
_pn = []
for _g in _gts:
    _raw = _g[:-1] + "r" + _g[-1]
    for _f, _d, _s in (("p", "", "unbounded preceding and current row"), ("n", "", "current row and unbounded following")):
        _fn = "last_value" if _f == "p" else "first_value"
        _w = f"over (partition by swing_id order by pos rows between {_s})"
        _pn.append(f"{_fn}({_raw} ignore nulls) {_w} as {_f}v_{_g}, {_fn}(case when {_raw} is not null then pos end ignore nulls) {_w} as {_f}p_{_g}")
cte("gtfill0", "select *, " + ", ".join(_pn) + " from seq", "seq")
cte("gtfill", "select * exclude (" + ", ".join(f"{f}{v}_{g}" for g in _gts for f in "pn" for v in "vp") + "), "
    + " and ".join(f"gt_{k}_r{a} is not null" for k in ("head", "tail") for a in "xy") + " and tail_visibility <> 'ignore' as target_valid, "
    + ", ".join(f"coalesce({g[:-1]}r{g[-1]}, pv_{g} + (nv_{g} - pv_{g}) * ((pos - pp_{g}) / cast(greatest(np_{g} - pp_{g}, 1) as double)), "
                f"pv_{g}, nv_{g}, 0e0) as {g}" for g in _gts) + " from gtfill0", "gtfill0")
cte("starts", "select swing_id, unnest(list_concat(range(n - 31, -1, -5), case when (n - 31) % 5 <> 0 then [0] else [] end)) as win_start "
    "from (select distinct swing_id, n from seq where n >= 31)", "seq")
cte("win", "select gtfill.*, win_start, cast(pos - win_start as int) as idx from gtfill join starts using (swing_id) "
    "where pos between win_start and win_start + 30", "gtfill", "starts")
_near = []
for _k in ("head", "tail"):
    for _f, _fn, _s in (("p", "last_value", "unbounded preceding and current row"), ("n", "first_value", "current row and unbounded following")):
        for _v, _e in (("p", "pos"), ("x", f"{_k}_x"), ("y", f"{_k}_y")):
            _near.append(f"{_fn}(case when {_k}_ok then {_e} end ignore nulls) over (partition by swing_id, win_start order by pos rows between {_s}) as {_k}_{_f}{_v}")
cte("near", "select *, " + ", ".join(_near) + " from win", "win")
_fill = []
for _k in ("head", "tail"):
    for _a in "xy":
        _fill.append(f"case when {_k}_pp is null and {_k}_np is null then 0e0 when {_k}_np is null then {_k}_p{_a} when {_k}_pp is null then {_k}_n{_a} "
                     f"when pos - {_k}_pp <= {_k}_np - pos then {_k}_p{_a} else {_k}_n{_a} end as {_k[0]}{_a}")
cte("filled", "select *, " + ", ".join(_fill) + " from near", "near")
_wl = "over (partition by swing_id, win_start order by pos)"
cte("lagged", "select *, " + ", ".join(f"lag({p}, {i}) {_wl} as {p}{i}" for p in ("hx", "hy", "tx", "ty") for i in (1, 2))
    + ", sqrt(((tx - hx) * 1920)**2 + ((ty - hy) * 1080)**2) as len from filled", "filled")
cte("unit", f"select *, case when len > 1e-6 then (tx - hx) * 1920 / len else 0e0 end as ux, case when len > 1e-6 then (ty - hy) * 1080 / len else 0e0 end as uy, "
    f"lag(len) {_wl} as len1 from lagged", "lagged")
_diag = "sqrt(1920e0**2 + 1080e0**2)"
cte("features0", f"select *, lag(ux) {_wl} as ux1, lag(uy) {_wl} as uy1 from unit", "unit")
_feat = {
    "head_x_norm": "hx", "head_y_norm": "hy", "tail_x_norm": "tx", "tail_y_norm": "ty", "head_conf": "head_c", "tail_conf": "tail_c",
    "head_valid": "cast(head_ok as double)", "tail_valid": "cast(tail_ok as double)", "bat_dx_norm": "tx - hx", "bat_dy_norm": "ty - hy",
    "bat_length_over_image_diagonal": f"len / {_diag}", "bat_length_change_over_image_diagonal": f"coalesce((len - len1) / {_diag}, 0)",
    "bat_unit_x": "ux", "bat_unit_y": "uy",
    "bat_direction_change_1_minus_cos": "case when len > 1e-6 and len1 > 1e-6 then 1 - least(greatest(ux * ux1 + uy * uy1, -1), 1) else 0e0 end",
    **{f"{k}_speed_over_image_diagonal": f"coalesce(sqrt((({k[0]}x - {k[0]}x1) * 1920)**2 + (({k[0]}y - {k[0]}y1) * 1080)**2) / {_diag}, 0)" for k in ("head", "tail")},
    **{f"{k}_acceleration_over_image_diagonal": f"coalesce(sqrt((({k[0]}x - 2 * {k[0]}x1 + {k[0]}x2) * 1920)**2 + (({k[0]}y - 2 * {k[0]}y1 + {k[0]}y2) * 1080)**2) / {_diag}, 0)" for k in ("head", "tail")},
    "window_time_minus1_to_plus1": "-1 + 2 * idx / 30e0",
    **{f"view_{v}": f"cast(view_label = '{v}' as double)" for v in ("1b_side", "front", "3b_side", "home_side", "random")},
}
assert tuple(_feat) == FEATURES_25
cte("features", "select swing_id, win_start, idx, pos, n, frame_idx, image_stem, head_ok as head_seen, tail_ok as tail_seen, view_label, target_valid, "
    "head_visibility, tail_visibility, " + ", ".join(_gts) + ", head_x as raw_head_x, head_y as raw_head_y, tail_x as raw_tail_x, tail_y as raw_tail_y, "
    "head_c as raw_head_conf, tail_c as raw_tail_conf, "
    + ", ".join(f'cast({e} as double) as "{n}"' for n, e in _feat.items()) + " from features0", "features0")


def features_over(prefix: str, source: str) -> str:
    """The steps from windows to features once more, over the windows ``source``; returns the last step's name."""
    return B.cte_again(prefix, ("near", "filled", "lagged", "unit", "features0"), {"win": source})


def feature_columns(digits: int = 6) -> str:
    from trackloom.workload.registry import r
    return ", ".join(f'{r(f"cast({e} as double)", digits)} as "{n}"' for n, e in _feat.items())


def _lin(terms: dict) -> str:
    parts = [f"{float(terms.get('bias', 0.0))!r}e0".replace("e0e0", "e0")]
    parts += [f'"{n}" * {w}e0' for n, w in terms.items() if n != "bias"]
    return " + ".join(parts)


cte("scores", "select *, " + ", ".join(f"{_lin(t)} as s{i}" for i, t in enumerate(STUB_WEIGHTS.values())) + " from features", "features")
_clip = lambda e: f"least(greatest({e}, 0), 1)"
cte("decoded0", "select *, 1 / (1 + exp(-s4)) as trust, 1 / (1 + exp(-s9)) as quality, greatest(s5, s6, s7, s8) as top from scores", "scores")
cte("decoded1", "select *, exp(s5 - top) as e0, exp(s6 - top) as e1, exp(s7 - top) as e2, exp(s8 - top) as e3 from decoded0", "decoded0")
cte("decoded", f"select *, {_clip('s0')} as prior_x, {_clip('s1')} as prior_y, s2 as delta_x, s3 as delta_y, "
    f"{_clip('tail_x_norm + trust * s2 / 1920')} as final_x, {_clip('tail_y_norm + trust * s3 / 1080')} as final_y, "
    f"{_clip('tail_x_norm + s2 / 1920')} as corrected_x, {_clip('tail_y_norm + s3 / 1080')} as corrected_y, "
    + ", ".join(f"e{i} / (e0 + e1 + e2 + e3) as p{i}" for i in range(4)) + " from decoded1", "decoded1")
_avg = ("prior_x", "prior_y", "final_x", "final_y", "corrected_x", "corrected_y", "delta_x", "delta_y", "trust", "p0", "p1", "p2", "p3", "quality")
_any = ("image_stem", "tail_seen", "head_seen", "target_valid", *_gts, "head_visibility", "tail_visibility", "raw_head_x", "raw_head_y",
        "raw_tail_x", "raw_tail_y", "raw_head_conf", "raw_tail_conf")
cte("frames0", "select swing_id, frame_idx, " + ", ".join(f"any_value({c}) as {c}" for c in _any) + ", "
    + ", ".join(f"avg({c}) as {c}" for c in _avg) + ", avg(tail_x_norm) as filled_x, avg(tail_y_norm) as filled_y from decoded group by swing_id, frame_idx", "decoded")


def _perr(p: str, q: str = "gt_tail") -> str:
    return f"round(sqrt((({p}_x - {q}_x) * 1920)**2 + (({p}_y - {q}_y) * 1080)**2), 9)"


cte("frames1", "select *, tail_seen as raw_valid, tail_seen as obs_valid, head_seen as head_valid, "
    "cast(list_position([p0, p1, p2, p3], greatest(p0, p1, p2, p3)) - 1 as int) as bucket_pred from frames0", "frames0")
cte("frames", "select * exclude (" + ", ".join(_gts) + "), " + ", ".join(f"case when target_valid then {g} end as {g}" for g in _gts)
    + f", {_perr('raw_tail')} as raw_error, {_perr('filled')} as filled_error, {_perr('prior')} as prior_error, {_perr('final')} as final_error, "
    f"{_perr('corrected')} as corrected_error, {_perr('final', 'filled')} as final_shift, sqrt(delta_x**2 + delta_y**2) as delta_mag from "
    "(select * exclude (" + ", ".join(_gts) + "), " + ", ".join(f"case when target_valid then {g} end as {g}" for g in _gts) + " from frames1)", "frames1")


CARRY = ("raw_head_x", "raw_head_y", "raw_tail_x", "raw_tail_y", "raw_head_conf", "raw_tail_conf")


def windows(spark: SparkSession, sf_dir: str, settings: WindowSettings = SETTINGS) -> DataFrame:
    """Feature windows of ``track`` with targets and the raw normalised points."""
    return supervised_windows(with_raw(tracked(spark, sf_dir), settings), settings, carry=CARRY, keep_block=True, tasks=B.frame_tasks(spark, sf_dir))


def with_raw(df: DataFrame, settings: WindowSettings) -> DataFrame:
    from trackloom.functions import scalars as S
    cols = {}
    for k in ("head", "tail"):
        x, y, c = (S.finite(F.col(f"{k}_pred_{f}")) for f in ("x", "y", "conf"))
        cols[f"raw_{k}_x"] = S.mirrored_x(x / settings.width, F.col("flip"))
        cols[f"raw_{k}_y"] = y / settings.height
        cols[f"raw_{k}_conf"] = F.when(S.observed(x, y, c), c).otherwise(0.0)
    return df.withColumns(cols)


def decoded(wins: DataFrame, settings: WindowSettings = SETTINGS, weights: dict = STUB_WEIGHTS) -> DataFrame:
    d = decode_scores(linear_scores(weights), F.col("tail_x_norm"), F.col("tail_y_norm"), settings)
    return wins.withColumns(d)


def frames_of(scored_windows: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Overlap-averaged frames with errors and the columns the metrics read."""
    out = overlap_mean(scored_windows, tasks=tasks)
    gts = ["gt_head_x", "gt_head_y", "gt_tail_x", "gt_tail_y"]
    out = out.withColumns({g: F.when(F.col("target_valid"), F.col(g)) for g in gts})
    out = out.withColumns({
        "raw_valid": F.col("tail_seen"), "obs_valid": F.col("tail_seen"), "head_valid": F.col("raw_head_conf") > 0})
    return frame_errors(out)


def flat(wins: DataFrame) -> DataFrame:
    return wins.select("*", "ctx.*").drop("ctx")


def scored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of(decoded(windows(spark, sf_dir)), tasks=B.frame_tasks(spark, sf_dir))


def stored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored frames kept in the shared folder: the metric queries read them several times."""
    return materialised(scored_frames(spark, sf_dir))
