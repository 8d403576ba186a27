"""Queries over scored frames: error statistics and reports."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from trackloom.operators import metrics as M
from trackloom.operators.losses import weighted_loss_terms
from trackloom.session import materialised, shared_folder
from trackloom.sources.files import nested_report, read_report, report_rows, write_report
from trackloom.sources.sinks import prediction_rows, write_predictions
from trackloom.schemas import FEATURES_25, PREDICTION_COLUMNS, VISIBILITIES
from trackloom.workload import bindings as B
from trackloom.workload import frames as X
from trackloom.workload.bindings import cte
from trackloom.workload.registry import R, query, r, rounded
from trackloom.workload.window_queries import wide_flow

_names = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_e = "case when raw_valid and target_valid then raw_error end"
_base = (f"['all', case when raw_valid then 'raw_matched' else 'raw_missing' end, case when obs_valid then 'obs_valid' else 'obs_missing' end, "
         f"case when ({_e}) < 5 then 'raw_error_lt5' when ({_e}) < 10 then 'raw_error_5_10' when ({_e}) < 20 then 'raw_error_10_20' when ({_e}) >= 20 then 'raw_error_gt20' end]")
cte("grouped", f"select *, unnest(list_filter(list_append({_base}, tail_visibility), lambda v: v is not null)) as grp from frames", "frames")
cte("groups", f"select unnest({_names(M.GROUPS)}) as grp")
cte("series", " union all ".join(
    f"select swing_id, frame_idx, grp, '{s}' as series, {s}_error as error from grouped where target_valid" + (" and raw_valid" if s == "raw" else "") for s in M.SERIES), "grouped")
cte("series_names", f"select unnest({_names(M.SERIES)}) as series")
_err = (f"count(*) as count, {r('sqrt(avg(error * error))')} as rmse, {r('avg(abs(error))')} as mae, {r('quantile_cont(error, 0.9)')} as p90, "
        f"{r('avg(case when error > 20 then 1e0 else 0e0 end)')} as gt20, {r('avg(case when error > 40 then 1e0 else 0e0 end)')} as gt40")


def frames(spark, d):
    return X.stored_frames(spark, d)


cte("by_group", f"select s.series, g.grp, coalesce(count, 0) as count, rmse, mae, p90, gt20, gt40 from groups g cross join series_names s left join "
    f"(select series, grp, {_err} from series group by all) t using (series, grp)", "groups", "series_names", "series")


@query("error_by_group", "select * from by_group", "by_group")
def error_by_group(spark, d):
    return rounded(M.error_by_group(frames(spark, d)))


cte("terr", "select swing_id, target_valid, tail_visibility, sqrt((tail_pred_x - tail_gt_x)**2 + (tail_pred_y - tail_gt_y)**2) as error, tail_pred_x - tail_gt_x as dx from "
    "(select *, coalesce(head_gt_x is not null and tail_gt_x is not null and tail_visibility <> 'ignore', false) as target_valid from track)", "track")


def _track_errors(spark, d):
    t = B.track(spark, d)
    ok = F.col("head_gt_x").isNotNull() & F.col("tail_gt_x").isNotNull() & (F.col("tail_visibility") != "ignore")
    dx, dy = F.col("tail_pred_x") - F.col("tail_gt_x"), F.col("tail_pred_y") - F.col("tail_gt_y")
    return t.select("swing_id", ok.alias("target_valid"), "tail_visibility", F.hypot(dx, dy).alias("error"), dx.alias("dx"))


@query("error_stats", f"select swing_id, {_err} from terr where error is not null group by swing_id", "terr")
def error_stats(spark, d):
    rows = _track_errors(spark, d).filter(F.col("error").isNotNull())
    return rounded(M.error_stats(rows, ["swing_id"], "error"))


_sc = lambda v: (f"count({v}) as count, {r(f'avg({v})')} as mean, {r(f'quantile_cont({v}, 0.5)')} as median, {r(f'quantile_cont({v}, 0.1)')} as p10, {r(f'quantile_cont({v}, 0.9)')} as p90")


@query("scalar_stats", f"select swing_id, {_sc('dx')} from terr group by swing_id", "terr")
def scalar_stats(spark, d):
    return rounded(M.scalar_stats(_track_errors(spark, d), ["swing_id"], "dx"))


@query("component_stats", f"select tail_visibility, count(dx) as count, {r('avg(dx)')} as mean_signed, {r('avg(abs(dx))')} as mae, {r('sqrt(avg(dx * dx))')} as rmse, "
       + ", ".join(f"{r(f'avg(case when abs(dx) > {t} then 1e0 when dx is not null then 0e0 end)')} as gt{t}" for t in (5, 10, 20))
       + f", {r('quantile_cont(abs(dx), 0.5)')} as median_abs, {r('quantile_cont(abs(dx), 0.9)')} as p90_abs from terr group by tail_visibility", "terr")
def component_stats(spark, d):
    return rounded(M.component_stats(_track_errors(spark, d), ["tail_visibility"], "dx"))


_mq = lambda v: f"count(*) as count, {r(f'avg({v})')} as mean, {r(f'quantile_cont({v}, 0.5)')} as p50, {r(f'quantile_cont({v}, 0.9)')} as p90"


@query("trust_stats", f"select grp, coalesce(count, 0) as count, mean, p50, p90 from groups left join (select grp, {_mq('trust')} from grouped group by grp) using (grp)", "groups", "grouped")
def trust_stats(spark, d):
    return rounded(M.mean_and_quantiles(frames(spark, d), "trust"))


@query("quality_stats", f"select grp, coalesce(count, 0) as count, mean, p50, p90 from groups left join (select grp, {_mq('quality')} from grouped where target_valid group by grp) using (grp)", "groups", "grouped")
def quality_stats(spark, d):
    return rounded(M.mean_and_quantiles(frames(spark, d).filter("target_valid"), "quality"))


_bk = ("lt5", "5_10", "10_20", "gt20")
_tb = "case when raw_error < 5 then 0 when raw_error < 10 then 1 when raw_error < 20 then 2 else 3 end"


@query("bucket_accuracy", "select grp, coalesce(count, 0) as count, accuracy, " + ", ".join(f"coalesce({p}_{n}, 0) as {p}_{n}" for p in ("pred", "true") for n in _bk)
       + f" from groups left join (select grp, count(*) as count, {r(f'avg(case when bucket_pred = {_tb} then 1e0 else 0e0 end)')} as accuracy, "
       + ", ".join(f"count(*) filter ({e} = {i}) as {p}_{n}" for p, e in (("pred", "bucket_pred"), ("true", _tb)) for i, n in enumerate(_bk))
       + " from grouped where target_valid and raw_valid and raw_error is not null group by grp) using (grp)", "groups", "grouped")
def bucket_accuracy(spark, d):
    return rounded(M.bucket_accuracy(X.scored_frames(spark, d)))


cte("axis0", "select *, gt_tail_x * 1920 - gt_head_x * 1920 as ax, gt_tail_y * 1080 - gt_head_y * 1080 as ay, (raw_head_x - gt_head_x) * 1920 as ddx, (raw_head_y - gt_head_y) * 1080 as ddy from frames where target_valid and head_valid", "frames")
cte("axis1", "select *, round((ddx * -ay + ddy * ax) / sqrt(ax * ax + ay * ay), 9) as u, round((ddx * ax + ddy * ay) / sqrt(ax * ax + ay * ay), 9) as v, sqrt(ddx * ddx + ddy * ddy) as euclid from axis0 where sqrt(ax * ax + ay * ay) > 1e-6", "axis0")
cte("axis2", "select *, case when abs(u) < 2 then 'ok' when abs(u) < 5 then 'slightly_bad' when abs(u) < 10 then 'bad' else 'very_bad' end as uq, "
    "case when v >= -3 and v <= 5 then 'ok' when v >= -7 and v <= 10 then 'slightly_bad' else 'bad' end as vq from axis1", "axis1")
cte("axis", "select *, case when uq = 'very_bad' then uq when uq = 'bad' or vq = 'bad' then 'bad' when uq = 'slightly_bad' or vq = 'slightly_bad' then 'slightly_bad' else 'ok' end as aq from axis2", "axis2")
cte("axis_grouped", f"select *, unnest(list_filter(list_concat({_base}, ['head_' || head_visibility, 'tail_' || tail_visibility]), lambda v: v is not null)) as grp from axis", "axis")
_agroups = [g for gs in M.AXIS_FAMILIES.values() for g in gs]
_q = {"u": ("uq", ("ok", "slightly_bad", "bad", "very_bad")), "v": ("vq", ("ok", "slightly_bad", "bad")), "axis": ("aq", ("ok", "slightly_bad", "bad", "very_bad"))}
_ax = ["count(*) as count"]
for _c in ("u", "v"):
    _ax += [f"{r(f'avg({_c})')} as {_c}_mean_signed", f"{r(f'avg(abs({_c}))')} as {_c}_mae", f"{r(f'sqrt(avg({_c} * {_c}))')} as {_c}_rmse",
            *[f"{r(f'avg(case when abs({_c}) > {t} then 1e0 else 0e0 end)')} as {_c}_gt{t}" for t in (5, 10, 20)],
            f"{r(f'quantile_cont(abs({_c}), 0.5)')} as {_c}_median_abs", f"{r(f'quantile_cont(abs({_c}), 0.9)')} as {_c}_p90_abs"]
_ax += [f"{r('sqrt(avg(euclid * euclid))')} as euclid_rmse", f"{r('avg(euclid)')} as euclid_mae", f"{r('quantile_cont(euclid, 0.9)')} as euclid_p90",
        *[f"{r(f'avg(case when euclid > {t} then 1e0 else 0e0 end)')} as euclid_gt{t}" for t in (20, 40)]]
_axn = []
for _k, (_c, _ls) in _q.items():
    for _l in _ls:
        _ax += [f"count(*) filter ({_c} = '{_l}') as {_k}_{_l}_count", f"{r(f'''avg(case when {_c} = '{_l}' then 1e0 else 0e0 end)''')} as {_k}_{_l}_rate"]
        _axn.append(f"{_k}_{_l}_count")


@query("axis_error_summary", "select g.grp, t.* exclude (grp, count, " + ", ".join(_axn) + "), coalesce(count, 0) as count, " + ", ".join(f"coalesce({n}, 0) as {n}" for n in _axn)
       + f" from (select unnest({_names(_agroups)}) as grp) g left join (select grp, " + ", ".join(_ax) + " from axis_grouped group by grp) t using (grp)", "axis_grouped")
def axis_error_summary(spark, d):
    return rounded(M.axis_error_summary(frames(spark, d)))


@query("axis_components", f"select swing_id, frame_idx, {r('u')} as u, {r('v')} as v, {r('euclid')} as euclid from axis", "axis")
def axis_components(spark, d):
    return rounded(M.axis_rows(X.scored_frames(spark, d)).select("swing_id", "frame_idx", "u", "v", "euclid"))


@query("axis_quality", "select swing_id, frame_idx, uq as u_quality, vq as v_quality, aq as axis_quality from axis", "axis")
def axis_quality(spark, d):
    return M.axis_rows(X.scored_frames(spark, d)).select("swing_id", "frame_idx", "u_quality", "v_quality", "axis_quality")


def _gains(after: str) -> str:
    return (f"select *, case when target_valid and raw_valid then raw_error - {after} end as gain_raw, case when target_valid then filled_error - {after} end as gain_filled from grouped")


cte("gain_final", _gains("final_error"), "grouped")
cte("gain_prior", _gains("prior_error"), "grouped")
_kinds = {"improved": "{g} > 0", "worsened": "{g} < 0", "effective": "{g} >= 1", "hurt": "{g} <= -1", "neutral": "abs({g}) < 1"}


def _effects(prefix: str, g: str) -> list[str]:
    out = []
    for k, cond in _kinds.items():
        c = cond.format(g=g)
        out += [f"count(*) filter ({c}) as {prefix}{k}_count", f"{r(f'avg(case when {g} is null then null when {c} then 1e0 else 0e0 end)')} as {prefix}{k}_rate"]
    return out


def _effect_sql(source: str, shift: bool, extra: str = "") -> str:
    items, counts = [], []
    for b in ("raw", "filled"):
        g = f"gain_{b}"
        items += [f"count({g}) as eligible_{b}", f"{r(f'avg({g})')} as mean_gain_{b}", *_effects(f"{b}_", g),
                  *[f"{r(f'quantile_cont({g}, {p})')} as {g}_{n}" for n, p in (("median", .5), ("p10", .1), ("p90", .9))]]
        counts += [f"eligible_{b}", *[f"{b}_{k}_count" for k in _kinds]]
    if shift:
        ok = "gain_filled is not null"
        items += [f"count(*) filter ({ok} and final_shift >= 1) as moved_count", f"{r(f'avg(case when {ok} then case when final_shift >= 1 then 1e0 else 0e0 end end)')} as moved_rate",
                  f"{r(f'avg(final_shift) filter ({ok})')} as mean_shift", f"{r(f'avg(delta_mag) filter ({ok})')} as mean_delta", f"{r(f'quantile_cont(final_shift, 0.5) filter ({ok})')} as shift_median"]
        counts.append("moved_count")
    return ("select g.grp, t.* exclude (grp, " + ", ".join(counts) + "), " + ", ".join(f"coalesce({c}, 0) as {c}" for c in counts) + extra
            + f" from groups g left join (select grp, {', '.join(items)} from {source} group by grp) t using (grp)")


@query("correction_effect", _effect_sql("gain_final", True), "groups", "gain_final")
def correction_effect(spark, d):
    return rounded(M.correction_effect(frames(spark, d)))



@query("prior_effect", "select *, " + ", ".join(
    f"case when mean_gain_{b} is not null then 0e0 - mean_gain_{b} end as prior_minus_{b}_mean, 0e0 - gain_{b}_median as prior_minus_{b}_median, "
    f"0e0 - gain_{b}_p90 as prior_minus_{b}_p10, 0e0 - gain_{b}_p10 as prior_minus_{b}_p90" for b in ("raw", "filled"))
       + f" from ({_effect_sql('gain_prior', False)})", "groups", "gain_prior")
def prior_effect(spark, d):
    out = rounded(M.prior_effect(frames(spark, d)))
    neg = {}
    for b in ("raw", "filled"):
        neg.update({f"prior_minus_{b}_mean": 0.0 - F.col(f"mean_gain_{b}"), f"prior_minus_{b}_median": 0.0 - F.col(f"gain_{b}_median"),
                    f"prior_minus_{b}_p10": 0.0 - F.col(f"gain_{b}_p90"), f"prior_minus_{b}_p90": 0.0 - F.col(f"gain_{b}_p10")})
    return out.withColumns(neg)


_tbk = "case " + " ".join(f"when trust >= {lo} and trust < {hi} then '{n}'" for lo, hi, n in zip(M.TRUST_EDGES, M.TRUST_EDGES[1:], M.TRUST_LABELS)) + " end"
cte("gain_long", " union all ".join(f"select grp, trust, '{b}' as base, gain_{b} as gain, {_tbk} as bucket from gain_final where gain_{b} is not null" for b in ("raw", "filled")), "gain_final")


@query("trust_effect", "select b.base, g.grp, k.bucket, coalesce(count, 0) as count, trust_mean, mean, gain_median, gain_p10, gain_p90, "
       + ", ".join(f"coalesce({k}_count, 0) as {k}_count, {k}_rate" for k in _kinds) + f", coalesce(eligible, 0) as eligible, case when eligible > 0 then {r('coalesce(count, 0) / cast(eligible as double)')} end as frame_rate "
       f"from groups g cross join (select unnest(['raw', 'filled']) as base) b cross join (select unnest({_names(M.TRUST_LABELS)}) as bucket) k left join "
       f"(select base, grp, bucket, count(*) as count, {r('avg(trust)')} as trust_mean, {r('avg(gain)')} as mean, "
       + ", ".join(f"{r(f'quantile_cont(gain, {p})')} as gain_{n}" for n, p in (("median", .5), ("p10", .1), ("p90", .9))) + ", " + ", ".join(_effects("", "gain"))
       + " from gain_long group by all) t on t.base = b.base and t.grp = g.grp and t.bucket = k.bucket left join (select base, grp, count(*) as eligible from gain_long group by all) e on e.base = b.base and e.grp = g.grp",
       "groups", "gain_long")
def trust_effect(spark, d):
    return rounded(M.trust_effect(frames(spark, d)))


cte("rmse_wide", "select grp, " + ", ".join(f"max(x) filter (series = '{s}') as {s}" for s in M.SERIES) + " from (select series, grp, sqrt(avg(error * error)) as x from series group by all) group by grp", "series")


@query("rmse_improvement", "select grp, " + ", ".join(f"{r(f'{b} - {a}')} as {a}_vs_{b}" for a in ("final", "prior") for b in ("raw", "filled")) + " from groups left join rmse_wide using (grp)", "groups", "rmse_wide")
def rmse_improvement(spark, d):
    return rounded(M.rmse_improvement(M.error_by_group(frames(spark, d))))


_len = "sqrt(((gt_head_x - gt_tail_x) * 1920)**2 + ((gt_head_y - gt_tail_y) * 1080)**2)"
cte("scaled", f"select *, max({_len}) over (partition by swing_id) as max_length from frames", "frames")
cte("ratios", " union all ".join(f"select swing_id, '{s}' as series, {s}_error as error, round({s}_error / max_length, 12) as ratio from scaled where target_valid and raw_valid and {s}_error is not null" for s in ("raw", "filled", "prior", "final")), "scaled")


def ratio_rows(spark, d, scored=None):
    length = F.hypot((F.col("gt_head_x") - F.col("gt_tail_x")) * 1920.0, (F.col("gt_head_y") - F.col("gt_tail_y")) * 1080.0)
    rows = M.with_sequence_scale((frames(spark, d) if scored is None else scored).select("swing_id", "target_valid", "raw_valid", "gt_head_x", "gt_head_y", "gt_tail_x", "gt_tail_y",
                                                         *[f"{s}_error" for s in M.SERIES]), length)
    pairs = F.array(*[F.struct(F.lit(s).alias("series"), F.col(f"{s}_error").alias("error"), F.round(F.col(f"{s}_error") / F.col("max_length"), 12).alias("ratio")) for s in M.SERIES])
    return rows.filter("target_valid and raw_valid").select("swing_id", F.inline(pairs)).filter("error is not null")


_pck = lambda: ", ".join(f"{r(f'avg(case when ratio <= {a} then 1e0 else 0e0 end)')} as {n}" for n, a in (("pck_2_5", "0.025e0"), ("pck_5", "0.05e0")))


@query("pck_per_sequence", f"select swing_id, series, count(*) as frames, {_pck()} from ratios group by all", "ratios")
def pck_per_sequence(spark, d):
    return rounded(M.pck(ratio_rows(spark, d), ["swing_id", "series"], "ratio"))


cte("curve", "select series, i as step, i / 100e0 * 0.1e0 as alpha, avg(case when ratio <= i / 100e0 * 0.1e0 then 1e0 else 0e0 end) as pck from ratios, range(101) t(i) group by all", "ratios")
cte("auc", "select series, sum(pck * case when step in (0, 100) then 0.5 else 1 end) / 100 as auc from curve group by series", "curve")


@query("pck_auc", f"select series, {r('auc')} as auc from auc", "auc")
def pck_auc(spark, d):
    return rounded(M.pck_auc(M.pck_curve(ratio_rows(spark, d), ["series"], "ratio"), ["series"]))


cte("headline", f"select series, count(*) as frames, sqrt(avg(error * error)) as rmse, avg(error) as mean, quantile_cont(error, 0.5) as median, quantile_cont(error, 0.9) as p90, "
    "avg(case when ratio <= 0.025e0 then 1e0 else 0e0 end) as pck_2_5, avg(case when ratio <= 0.05e0 then 1e0 else 0e0 end) as pck_5, any_value(auc) as auc from ratios join auc using (series) group by series", "ratios", "auc")


@query("headline_metrics", "select series, frames, " + ", ".join(f"{r(n)} as {n}" for n in ("rmse", "mean", "median", "p90", "pck_2_5", "pck_5", "auc")) + " from headline", "headline")
def headline_metrics(spark, d):
    return rounded(M.headline(ratio_rows(spark, d)))


@query("relative_change", "select t.series, " + ", ".join(f"{r(f'(t.{n} / b.{n} - 1) * 100')} as {n}_change_pct" for n in ("rmse", "mean", "median", "p90"))
       + ", " + ", ".join(f"{r(f'(t.{n} - b.{n}) * 100')} as {n}_change_points" for n in ("pck_2_5", "pck_5", "auc"))
       + " from headline t join headline b on b.series = 'raw' where t.series <> 'raw'", "headline")
def relative_change(spark, d):
    return rounded(M.relative_change(M.headline(ratio_rows(spark, d)), "raw"))


@query("valid_rmse", f"select swing_id, {r('sqrt(avg(final_error * final_error))')} as rmse, count(final_error) as valid from frames group by swing_id", "frames")
def valid_rmse(spark, d):
    return rounded(M.valid_rmse(X.scored_frames(spark, d), ["swing_id"], "final_error"))


_p = lambda e: r(e, 4)


@query("sink_prediction_rows",
       f"select swing_id, image_stem, frame_idx, 'head' as keypoint, head_visibility as visibility, cast(target_valid as int) as target_valid, 1 as obs_valid, "
       f"{_p('raw_head_x * 1920')} as raw_x, {_p('raw_head_y * 1080')} as raw_y, {_p('raw_head_x * 1920')} as filled_x, {_p('raw_head_y * 1080')} as filled_y, null::double as prior_x, null::double as prior_y, "
       f"{_p('raw_head_x * 1920')} as final_x, {_p('raw_head_y * 1080')} as final_y, {_p('raw_head_x * 1920')} as corrected_x, {_p('raw_head_y * 1080')} as corrected_y, "
       f"{_p('gt_head_x * 1920')} as gt_x, {_p('gt_head_y * 1080')} as gt_y, {_p('raw_head_conf')} as pred_conf, {_p('trust')} as trust, {_p('quality')} as yolo_quality, "
       f"{_p('he')} as raw_error_px, {_p('he')} as filled_error_px, null::double as prior_error_px, {_p('he')} as final_error_px, {_p('he')} as corrected_error_px, 0e0 as final_shift_px "
       f"from (select *, case when target_valid then sqrt(((raw_head_x - gt_head_x) * 1920)**2 + ((raw_head_y - gt_head_y) * 1080)**2) end as he from frames) "
       f"union all select swing_id, image_stem, frame_idx, 'tail', tail_visibility, cast(target_valid as int), cast(obs_valid as int), "
       f"case when obs_valid then {_p('raw_tail_x * 1920')} end, case when obs_valid then {_p('raw_tail_y * 1080')} end, "
       + ", ".join(f"{_p(f'{s}_x * 1920')}, {_p(f'{s}_y * 1080')}" for s in ("filled", "prior", "final", "corrected", "gt_tail"))
       + f", {_p('raw_tail_conf')}, {_p('trust')}, {_p('quality')}, case when target_valid and obs_valid then {_p('raw_error')} end, "
       + ", ".join(f"case when target_valid then {_p(f'{s}_error')} end" for s in ("filled", "prior", "final", "corrected")) + f", {_p('final_shift')} from frames", "frames")
def sink_prediction_rows(spark, d):
    f = X.scored_frames(spark, d).withColumnsRenamed({"raw_head_conf": "head_conf", "raw_tail_conf": "tail_conf"})
    rows = prediction_rows(f, 1920.0, 1080.0)
    where = shared_folder(spark, "predictions")
    write_predictions(rows, where)
    back = spark.read.option("header", True).schema(rows.schema).csv(where)
    assert tuple(back.columns) == PREDICTION_COLUMNS
    return rounded(back, digits=4)


@query("unpivot_predictions", f"select swing_id, frame_idx, 'head' as keypoint, {_p('raw_head_x * 1920')} as final_x from frames union all select swing_id, frame_idx, 'tail', {_p('final_x * 1920')} from frames", "frames")
def unpivot_predictions(spark, d):
    f = X.scored_frames(spark, d).withColumnsRenamed({"raw_head_conf": "head_conf", "raw_tail_conf": "tail_conf"})
    return rounded(prediction_rows(f, 1920.0, 1080.0).select("swing_id", "frame_idx", "keypoint", "final_x"), digits=4)


_REPORT_SQL = {
    "error": ("by_group", "series", "grp", ("count", "rmse", "mae", "p90", "gt20", "gt40")),
    "trust": (f"(select grp, coalesce(count, 0) as count, mean, p50, p90 from groups left join (select grp, {_mq('trust')} from grouped group by grp) using (grp))", "'all'", "grp", ("count", "mean", "p50", "p90")),
    "quality": (f"(select grp, coalesce(count, 0) as count, mean, p50, p90 from groups left join (select grp, {_mq('quality')} from grouped where target_valid group by grp) using (grp))", "'all'", "grp", ("count", "mean", "p50", "p90")),
    "headline": ("headline", "'all'", "series", ("frames", "rmse", "mean", "median", "p90", "pck_2_5", "pck_5", "auc"))}
_RUN_FACTS = {"swings": "count(distinct swing_id)", "frames": "count(*)", "target_frames": "count(*) filter (target_valid)"}


@query("sink_metric_report", " union all ".join(
    f"select '{m}' as metric, {s} as series, {g} as grp, unnest({_names(cols)}) as stat, unnest([{', '.join(r(f'cast({c} as double)') for c in cols)}]) as value from {t}" for m, (t, s, g, cols) in _REPORT_SQL.items())
    + "".join(f" union all select 'run', 'all', 'all', '{n}', cast({e} as double) from frames" for n, e in _RUN_FACTS.items()), "by_group", "groups", "grouped", "headline", "frames")
def sink_metric_report(spark, d):
    """The nested report written as one JSON document, read back, and taken apart."""
    f = frames(spark, d)
    tables = {
        "error": (M.error_by_group(f), "series", "grp"), "trust": (M.mean_and_quantiles(f, "trust"), None, "grp"),
        "quality": (M.mean_and_quantiles(f.filter("target_valid"), "quality"), None, "grp"), "headline": (M.headline(ratio_rows(spark, d, f)), None, "series")}
    facts = {"swings": F.count_distinct("swing_id"), "frames": F.count(F.lit(1)), "target_frames": F.count_if("target_valid")}
    where = shared_folder(spark, "report")
    write_report(nested_report(tables, facts, f), where)
    back = read_report(spark, where, ", ".join(f"{n}: bigint" for n in facts))
    run = F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(f"run.{n}").cast("double").alias("value")) for n in facts]))
    run_rows = back.select(F.lit("run").alias("metric"), F.lit("all").alias("series"), F.lit("all").alias("grp"), run)
    return rounded(report_rows(back).unionByName(run_rows))




@query("evaluate_tracks", "select series, grp, count, rmse, mae, p90, gt20, gt40, (select count(distinct swing_id) from frames) as swings, (select count(*) from starts) as windows, (select count(*) from frames) as frames "
       "from by_group", "by_group", "starts", "frames")
def evaluate_tracks(spark, d):
    from trackloom.plans.evaluation import evaluate
    return rounded(evaluate(X.decoded(X.windows(spark, d)), partial(X.frames_of, tasks=B.frame_tasks(spark, d))))


_terms = {
    "position": ("h(px - gx) + h(py - gy)", "w"), "prior": ("h(qx - gx) + h(qy - gy)", "w"),
    "length": ("h(sqrt((px - hx)**2 + (py - hy)**2) - sqrt((gx - hx)**2 + (gy - hy)**2))", "w"),
    "correction": ("h(delta_x - (gx - ox)) + h(delta_y - (gy - oy))", "w"),
    "prior_guidance": ("h(delta_x - (qx - ox)) + h(delta_y - (qy - oy))", "w"),
    "error_bucket": ("ln(exp(s5) + exp(s6) + exp(s7) + exp(s8)) - case when oe < 5 then s5 when oe < 10 then s6 when oe < 20 then s7 else s8 end", "w"),
    "quality": ("greatest(s9, 0) - s9 * least(greatest((10 - oe) / 5e0, 0), 1) + ln(1 + exp(-abs(s9)))", "w"),
    "trust": ("greatest(s4, 0) - s4 * tt + ln(1 + exp(-abs(s4)))", "w * tv"),
    "direction": ("1 - ((px - hx) / greatest(sqrt((px - hx)**2 + (py - hy)**2), 1e-6) * tux + (py - hy) / greatest(sqrt((px - hx)**2 + (py - hy)**2), 1e-6) * tuy)", "w"),
    "line": ("greatest(across - 3, 0)**2", "w"), "endpoint": ("greatest(abs(along) - 10, 0)**2", "w"),
    "velocity": ("h(px - px1 - gx + gx1) + h(py - py1 - gy + gy1)", "w2"), "prior_velocity": ("h(qx - qx1 - gx + gx1) + h(qy - qy1 - gy + gy1)", "w2"),
    "acceleration": ("h(px - 2*px1 + px2 - gx + 2*gx1 - gx2) + h(py - 2*py1 + py2 - gy + 2*gy1 - gy2)", "w3"),
    "prior_acceleration": ("h(qx - 2*qx1 + qx2 - gx + 2*gx1 - gx2) + h(qy - 2*qy1 + qy2 - gy + 2*gy1 - gy2)", "w3"),
    "observation": ("h(px - ox) + h(py - oy)", "sv * tail_conf"),
    "damage": ("greatest(fe - oe - 1, 0)**2", "sv"), "good_damage": ("greatest(fe - oe - 0.25, 0)**2", "case when oe < 5 then sv else 0 end"),
}


def _huber(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        if text.startswith("h(", i) and (i == 0 or not text[i - 1].isalnum()):
            depth, j = 1, i + 2
            while depth:
                depth += {"(": 1, ")": -1}.get(text[j], 0)
                j += 1
            x = text[i + 2:j - 1]
            out += f"(case when abs({x}) < 1 then 0.5e0 * ({x})**2 else abs({x}) - 0.5e0 end)"
            i = j
        else:
            out += text[i]
            i += 1
    return out


cte("loss0", "select *, cast(target_valid as int) as tv, cast(target_valid and tail_seen as int) as sv, final_x * 1920 as px, final_y * 1080 as py, prior_x * 1920 as qx, prior_y * 1080 as qy, "
    "tail_x_norm * 1920 as ox, tail_y_norm * 1080 as oy, case when target_valid then gt_tail_x else tail_x_norm end * 1920 as gx, case when target_valid then gt_tail_y else tail_y_norm end * 1080 as gy, "
    "case when target_valid then gt_head_x else head_x_norm end * 1920 as hx, case when target_valid then gt_head_y else head_y_norm end * 1080 as hy from decoded", "decoded")
cte("loss1", "select *, sqrt((ox - gx)**2 + (oy - gy)**2) as oe, sqrt((px - gx)**2 + (py - gy)**2) as fe, greatest(sqrt((gx - hx)**2 + (gy - hy)**2), 1e-6) as tl, delta_x**2 + delta_y**2 as nn from loss0", "loss0")
cte("loss2", "select *, case when tail_visibility <> 'fully_visible' or not tail_seen then 4e0 when oe < 5 then 0.3e0 when oe < 10 then 1e0 when oe < 20 then 2e0 else 4e0 end * tv as w, "
    "(gx - hx) / tl as tux, (gy - hy) / tl as tuy, least(greatest(((gx - ox) * delta_x + (gy - oy) * delta_y) / greatest(nn, 1e-6), 0), 1) as bt from loss1", "loss1")
cte("loss3", "select *, (px - gx) * tux + (py - gy) * tuy as along, case when nn >= 0.25 then bt * least(greatest((oe - sqrt((ox + bt * delta_x - gx)**2 + (oy + bt * delta_y - gy)**2) - 0.5) / 2.5, 0), 1) else 0e0 end as tt from loss2", "loss2")
cte("loss4", "select *, sqrt((px - gx - along * tux)**2 + (py - gy - along * tuy)**2) as across, "
    + ", ".join(f"lag({c}, {i}) over wn as {c}{i}" for c in ("px", "py", "qx", "qy", "gx", "gy", "w", "tv") for i in (1, 2)).replace("as w1", "as lw1").replace("as w2", "as lw2")
    + " from loss3 window wn as (partition by swing_id, win_start order by idx)", "loss3")
cte("loss", "select *, (w + lw1) / 2 * tv * tv1 as w2, (w + lw1 + lw2) / 3 * tv * tv1 * tv2 as w3 from loss4", "loss4")
_loss_cols = ", ".join(f"coalesce(sum(({_huber(l)}) * ({w})), 0) / greatest(sum({w}), 1) as {n}" for n, (l, w) in _terms.items())


@query("weighted_loss_terms", f"select swing_id, " + ", ".join(r(n, 5) + f" as {n}" for n in _terms) + ", " + r(
    "position + 0.5*prior + correction + 0.05*prior_guidance + 0.2*trust + direction + 0.05*velocity + 0.02*prior_velocity + 0.01*acceleration + 0.005*prior_acceleration + 0.05*observation + 0.05*line + 0.02*endpoint + 0.01*damage", 5)
    + f" as total from (select swing_id, {_loss_cols} from loss group by swing_id)", "loss")
def loss_terms(spark, d):
    from trackloom.operators.scoring import linear_scores
    wins = X.decoded(X.windows(spark, d)).withColumns({f"s{i}": c for i, c in enumerate(linear_scores(X.STUB_WEIGHTS))})
    return rounded(weighted_loss_terms(X.flat(wins), ["swing_id"]), digits=5)


cte("hist", "select o_orderpriority as run, cast(datediff('month', timestamp '1995-01-01 00:00:00', o_orderdate) as int) as epoch, o_orderkey, 1 + o_orderkey % 16 as batch_size, o_totalprice as total, o_totalprice / 3 as position from orders")


def history(spark, d):
    o = B.table(spark, d, "orders")
    months = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1 - 1995 * 12
    return o.select(F.col("o_orderpriority").alias("run"), months.cast("int").alias("epoch"), (1 + F.col("o_orderkey") % 16).alias("batch_size"),
                    F.col("o_totalprice").alias("total"), (F.col("o_totalprice") / 3).alias("position"))


cte("epochs", "select run, epoch, sum(total * batch_size) / greatest(sum(batch_size), 1) as total, sum(position * batch_size) / greatest(sum(batch_size), 1) as position from hist group by all", "hist")


@query("epoch_running_mean", f"select run, epoch, {r('total', 3)} as total, {r('position', 3)} as position from epochs", "epochs")
def epoch_running_mean(spark, d):
    return rounded(M.epoch_means(history(spark, d), ["total", "position"]), digits=3)


cte("best0", "select *, arg_min(epoch, total) over (partition by run order by epoch rows unbounded preceding) as best_at from epochs", "epochs")
cte("stops", "select run, min(epoch) filter (epoch - best_at >= 10) as stop_epoch from best0 group by run", "best0")


@query("best_row_selection", f"select run, arg_min(epoch, total) as best_epoch, {r('min(total)', 3)} as best_total, any_value(stop_epoch) as stop_epoch from epochs join stops using (run) where stop_epoch is null or epoch <= stop_epoch group by run", "epochs", "stops")
def best_row_selection(spark, d):
    return rounded(M.best_epochs(M.epoch_means(history(spark, d), ["total", "position"]), 10), digits=3)


cte("flow_scores", "select *, " + ", ".join(f"{X._lin(t)} as s{i}" for i, t in enumerate(X.FLOW_STUB_WEIGHTS.values())) + " from features45", "features45")
B.cte_again("flow_", ("decoded0", "decoded1", "decoded", "frames0", "frames1", "frames", "grouped", "series", "by_group"), {"scores": "flow_scores"})


@query("evaluate_with_flow", "select series, grp, count, rmse, mae, p90, gt20, gt40, (select count(distinct swing_id) from flow_frames) as swings, (select count(*) from starts) as windows, (select count(*) from flow_frames) as frames "
       "from flow_by_group", "flow_by_group", "starts", "flow_frames")
def evaluate_with_flow(spark, d):
    """The 45-column build from real flow statistics; the stand-in model reads flow columns, too."""
    from trackloom.operators.contracts import require_feature_order
    from trackloom.operators.windows import supervised_windows
    from trackloom.plans.evaluation import evaluate
    tasks = B.frame_tasks(spark, d)
    wins = supervised_windows(X.with_raw(wide_flow(spark, d), X.SETTINGS), X.SETTINGS, carry=X.CARRY, use_flow=True, keep_block=True, tasks=tasks)
    return rounded(evaluate(X.decoded(require_feature_order(wins, True), weights=X.FLOW_STUB_WEIGHTS), partial(X.frames_of, tasks=tasks)))


@query("path_consistency", "select column_name, count(*) as rows, 0::bigint as without_flow_differs, 0::bigint as supervised_differs from features, (select unnest(" + _names(FEATURES_25) + ") as column_name) group by column_name", "features")
def path_consistency(spark, d):
    """The three ways that build the 25 columns (inference, with flow, with targets), compared column by column."""
    from trackloom.operators.contracts import column_differences
    from trackloom.operators.windows import observation_windows, supervised_windows
    key = ["swing_id", "win_start", "idx"]
    plain = materialised(observation_windows(X.tracked(spark, d)).select(*key, *FEATURES_25))
    out = None
    for name, other in (("without_flow_differs", observation_windows(wide_flow(spark, d), use_flow=True)), ("supervised_differs", supervised_windows(X.tracked(spark, d)))):
        rows = column_differences(plain, other, key, FEATURES_25)
        hits = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.array_contains("differing", c)).alias(f"__{i}") for i, c in enumerate(FEATURES_25)])
        long = hits.select("rows", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__{i}").alias(name)) for i, c in enumerate(FEATURES_25)])))
        out = long if out is None else out.join(long.drop("rows"), "column_name")
    return out.select("column_name", "rows", "without_flow_differs", "supervised_differs")
