"""Queries over flow fields, their joins, and the alignment contracts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from trackloom.operators import contracts as K
from trackloom.operators import flow as W
from trackloom.operators.reshape import pivot_wide
from trackloom.plans.flow import flow_feature_table, scaled_frames
from trackloom.schemas import FLOW_REGIONS, GLOBAL_FLOW_STATS, REGION_FLOW_STATS
from trackloom.session import materialised
from trackloom.workload import bindings as B
from trackloom.workload import frames as X
from trackloom.workload.bindings import cte
from trackloom.workload.registry import R, query, r, rounded, rs

_stat = {
    "flow_x_mean": "avg(fx)", "flow_y_mean": "avg(fy)", "flow_x_std": "stddev_pop(fx)", "flow_y_std": "stddev_pop(fy)", "flow_mag_mean": "avg(mag)",
    "flow_mag_std": "stddev_pop(mag)", "flow_mag_max": "max(mag)", **{f"flow_mag_p{p}": f"quantile_cont(mag, {p / 100})" for p in (50, 90, 95, 99)}}
assert tuple(_stat) == GLOBAL_FLOW_STATS
cte("pix", "select *, sqrt(fx * fx + fy * fy) as mag, i % 8 as px, i // 8 as py from flow_pixels", "flow_pixels")
cte("gstats", "select swing_id, frame_idx, " + ", ".join(f"{e} as {n}" for n, e in _stat.items()) + " from pix group by all", "pix")
# head, tail and box of the wide frames in pixels of the 8 x 8 field
cte("fframes", "select image_stem, swing_id, frame, frame_idx, head_pred_x / 240 as hx, head_pred_y / 135 as hy, tail_pred_x / 240 as tx, tail_pred_y / 135 as ty, bbox_x1 / 240 as x1, bbox_y1 / 135 as y1, bbox_x2 / 240 as x2, bbox_y2 / 135 as y2 from track", "track")
_rb = lambda e: f"cast(round_even({e}, 0) as int)"
cte("usable", "select f.*, c.flow_file is not null and f.frame_idx > 1 as usable from fframes f left join flow_cat c using (swing_id, frame_idx)", "fframes", "flow_cat")
_boxes = {}
for _k, _x, _y in (("head", "hx", "hy"), ("tail", "tx", "ty")):
    _cx, _cy = _rb(_x), _rb(_y)
    _boxes[_k] = (f"usable and {_x} is not null and {_cx} between 0 and 7 and {_cy} between 0 and 7", f"greatest({_cx} - 1, 0)", f"least({_cx} + 2, 8)", f"greatest({_cy} - 1, 0)", f"least({_cy} + 2, 8)")
_cl = lambda e: f"greatest(least({e}, 8), 0)"
_b = [_cl(f"{_rb('x1')} - 1"), _cl(f"{_rb('x2')} + 1"), _cl(f"{_rb('y1')} - 1"), _cl(f"{_rb('y2')} + 1")]
_boxes["bbox"] = (f"usable and x1 is not null and {_b[1]} > {_b[0]} and {_b[3]} > {_b[2]}", *_b)
cte("region_boxes", " union all ".join(f"select image_stem, swing_id, frame_idx, '{k}' as region, {x1} as bx1, {x2} as bx2, {y1} as by1, {y2} as by2 from usable where coalesce({ok}, false)" for k, (ok, x1, x2, y1, y2) in _boxes.items()), "usable")
cte("region_stats", "select b.image_stem, region, " + ", ".join(f"{e} as {n}" for n, e in _stat.items() if n != "flow_mag_p50") + " from region_boxes b join pix p on p.swing_id = b.swing_id and p.frame_idx = b.frame_idx and px >= bx1 and px < bx2 and py >= by1 and py < by2 group by all", "region_boxes", "pix")
_lcols = [f"{g}_{s}" for g in FLOW_REGIONS for s in REGION_FLOW_STATS]
cte("local_flow", "select u.image_stem, u.swing_id, u.frame, u.frame_idx, case when u.frame_idx > 1 then u.frame_idx - 1 end as prev_frame_idx, cast(usable as int) as has_prev_flow, "
    + ", ".join(f"cast({g}.image_stem is not null as int) as {g}_valid, " + ", ".join(f"coalesce({g}.{s}, 0) as {g}_{s}" for s in REGION_FLOW_STATS) for g in FLOW_REGIONS)
    + " from usable u " + " ".join(f"left join region_stats {g} on {g}.image_stem = u.image_stem and {g}.region = '{g}'" for g in FLOW_REGIONS), "usable", "region_stats")
cte("global_flow", "select t.swing_id, t.frame_idx, t.frame as frame_name, c.prev_frame_idx, c.flow_file, cast(c.flow_file is not null as int) as has_prev_flow, "
    + ", ".join(f"coalesce(g.{s}, 0) as {s}" for s in GLOBAL_FLOW_STATS) + " from track t left join flow_cat c using (swing_id, frame_idx) left join gstats g using (swing_id, frame_idx)", "track", "flow_cat", "gstats")


_TILED = {"radius": 1, "pad": 1, "tile": B.FLOW_TILE}
TILED = {**_TILED, "row_pixels": B.FLOW_ROW_PIXELS}


def local_rows(spark, d):
    return W.region_stats(scaled_frames(B.track(spark, d)), B.flow_tiles(spark, d), **TILED)


def global_rows(spark, d):
    frames = B.track(spark, d).select("swing_id", "frame_idx", F.col("frame").alias("frame_name"))
    return W.attach_global(frames, W.global_stats(B.flow_tiles(spark, d), row_pixels=B.FLOW_ROW_PIXELS))


@query("flow_global_stats", f"select swing_id, frame_idx, {rs(list(GLOBAL_FLOW_STATS))} from gstats", "gstats")
def flow_global_stats(spark, d):
    return rounded(W.global_stats(B.flow_tiles(spark, d), row_pixels=B.FLOW_ROW_PIXELS).drop("prev_frame_idx", "flow_file"))


@query("flow_region_stats", "select image_stem, head_valid, tail_valid, bbox_valid, " + rs(_lcols) + " from local_flow", "local_flow")
def flow_region_stats(spark, d):
    return rounded(local_rows(spark, d).select("image_stem", "head_valid", "tail_valid", "bbox_valid", *_lcols))


@query("region_pixel_join", "select b.image_stem, region, count(*) as pixels, " + r("sum(fx)") + " as sum_fx from region_boxes b join pix p on p.swing_id = b.swing_id and p.frame_idx = b.frame_idx and px >= bx1 and px < bx2 and py >= by1 and py < by2 group by all", "region_boxes", "pix")
def region_pixel_join(spark, d):
    frames = scaled_frames(B.track(spark, d))
    return rounded(W.region_pixels(frames, B.flow_tiles(spark, d), **_TILED).groupBy("image_stem", "region").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("fx").alias("sum_fx")))


@query("asof_prev_flow", "select swing_id, frame_idx, frame_name, prev_frame_idx, flow_file, has_prev_flow, " + r("flow_mag_mean") + " as flow_mag_mean from global_flow", "global_flow")
def asof_prev_flow(spark, d):
    return rounded(global_rows(spark, d).select("swing_id", "frame_idx", "frame_name", "prev_frame_idx", "flow_file", "has_prev_flow", "flow_mag_mean"))


@query("scan_flow_fields", "select flow_file, prev_frame_idx, frame_idx from flow_cat", "flow_cat")
def scan_flow_fields(spark, d):
    files = W.field_catalogue(B.flow_tiles(spark, d)).select("flow_file")
    return W.catalogue_indices(files, "flow_file")


@query("flow_completeness", "select swing_id, count(*) as n_frames, coalesce(any_value(e), 0) as existing_flows, count(*) - 1 as expected_flows, count(*) >= 2 and coalesce(any_value(e), 0) = count(*) - 1 as complete from track left join (select swing_id, count(*) as e from flow_fields group by 1) using (swing_id) group by swing_id", "track", "flow_fields")
def flow_completeness(spark, d):
    return W.completeness(B.track(spark, d).select("swing_id"), W.field_catalogue(B.flow_tiles(spark, d)).select("swing_id"))


@query("merge_local_flow", "select t.image_stem, t.frame_idx, has_prev_flow, head_valid, " + r("head_flow_mag_p95") + " as head_flow_mag_p95, t.detection_rank from track t join local_flow using (image_stem)", "track", "local_flow")
def merge_local_flow(spark, d):
    wide = pivot_wide(B.details(spark, d), F.col("keypoint"))
    m = W.merge_local(wide, local_rows(spark, d))
    return rounded(m.select("image_stem", "frame_idx", "has_prev_flow", "head_valid", "head_flow_mag_p95", "detection_rank"))


@query("merge_global_flow", "select t.image_stem, t.frame_idx, g.frame_name, g.has_prev_flow as global_has_prev_flow, " + r("g.flow_mag_p50") + " as global_flow_mag_p50 from track t join global_flow g using (swing_id, frame_idx)", "track", "global_flow")
def merge_global_flow(spark, d):
    m = W.merge_global(B.track(spark, d), global_rows(spark, d))
    return rounded(m.select("image_stem", "frame_idx", "frame_name", "global_has_prev_flow", "global_flow_mag_p50"))


@query("flow_feature_table", "select t.image_stem, l.has_prev_flow, l.head_valid, l.tail_valid, l.bbox_valid, " + ", ".join(
    f"{r(f'l.{g}_{s}')} as {g}_{s}" for g in FLOW_REGIONS for s in ("flow_x_mean", "flow_mag_p95")) + f", {r('g.flow_x_mean')} as global_flow_x_mean, {r('t.bbox_x2 - t.bbox_x1')} as bbox_w, "
    + r("sqrt((t.head_pred_x - t.tail_pred_x)**2 + (t.head_pred_y - t.tail_pred_y)**2)") + " as pred_bat_length from track t join local_flow l using (image_stem) join global_flow g on g.swing_id = t.swing_id and g.frame_idx = t.frame_idx", "track", "local_flow", "global_flow")
def flow_table(spark, d):
    # Groups of up to 65,536 pixels in one row, as by default; the queries above use the way for larger ones, too.
    t = flow_feature_table(B.details(spark, d), F.col("keypoint"), B.flow_tiles(spark, d), scale=(240.0, 135.0), **_TILED)
    return rounded(t.select("image_stem", "has_prev_flow", "head_valid", "tail_valid", "bbox_valid", *[f"{g}_{s}" for g in FLOW_REGIONS for s in ("flow_x_mean", "flow_mag_p95")],
                            "global_flow_x_mean", "bbox_w", "pred_bat_length"))


# --- contracts: the flow side is the wide table with some damage -------------------------

_dmg = {
    "tail_pred_y": "case when event_id % 101 = 0 then tail_pred_y + 1 else tail_pred_y end", "head_pred_x": "case when event_id % 103 = 0 then null else head_pred_x end",
    "bbox_x1": "case when event_id % 107 = 0 then bbox_x1 - 1 else bbox_x1 end"}
_keep = [f"{k}_pred_{f}" for k in ("head", "tail") for f in ("x", "y", "conf")] + ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]
cte("damaged0", "select image_stem, swing_id, event_id, " + ", ".join(f"{_dmg.get(c, c)} as {c}" for c in _keep) + " from track where event_id % 109 <> 0", "track")
cte("damaged", "select * from damaged0 union all select * from damaged0 where event_id % 113 = 0 union all select image_stem || '_x', swing_id, event_id, " + ", ".join(_keep) + " from damaged0 where event_id % 127 = 0", "damaged0")


def damaged(spark, d):
    base = B.track(spark, d).filter("event_id % 109 <> 0").selectExpr("image_stem", "swing_id", "event_id", *[f"{_dmg.get(c, c)} as {c}" for c in _keep])
    extra = base.filter("event_id % 127 = 0").withColumn("image_stem", F.concat("image_stem", F.lit("_x")))
    return base.unionByName(base.filter("event_id % 113 = 0")).unionByName(extra)


_pf = [(k, f) for k in ("head", "tail") for f in ("pred_x", "pred_y", "pred_conf")]
_mm = " union all ".join(f"select d.swing_id, d.image_stem, '{k}' as keypoint, '{f}' as field, t.{k}_{f} as selected, d.{k}_{f} as flow from damaged d join track t using (image_stem) where t.{k}_{f} is distinct from d.{k}_{f}" for k, f in _pf)
_bm = " union all ".join(f"select d.swing_id, d.image_stem, '{f}' as field, 'mismatch' as problem from damaged d join track t using (image_stem) where t.{f} is distinct from d.{f}" for f in K.BOX_FIELDS)
_kd = ("select swing_id, image_stem, 'missing' as problem from track where image_stem not in (select image_stem from damaged) union all select distinct swing_id, image_stem, 'extra' from damaged where image_stem not in (select image_stem from track)")


@query("check_duplicate_keys", "select swing_id, image_stem, count(*) as rows from damaged group by all having count(*) > 1", "damaged")
def check_duplicate_keys(spark, d):
    return K.duplicate_keys(damaged(spark, d), ["swing_id", "image_stem"])


@query("key_set_diff", _kd, "damaged", "track")
def key_set_diff(spark, d):
    return K.key_differences(B.details(spark, d), damaged(spark, d))


@query("check_value_alignment", _mm, "damaged", "track")
def check_value_alignment(spark, d):
    return K.value_mismatches(B.details(spark, d), damaged(spark, d))


@query("check_group_consistency", f"select * from ({_bm}) where image_stem not in (select image_stem from track where event_id % 131 = 0) union all select swing_id, image_stem, 'bbox_x1', 'inconsistent' from damaged where image_stem in (select image_stem from track where event_id % 131 = 0 and bbox_x1 is not null)"
       f" union all select * from ({_bm}) where image_stem in (select image_stem from track where event_id % 131 = 0) and field <> 'bbox_x1'", "damaged", "track")
def check_group_consistency(spark, d):
    odd = B.track(spark, d).filter("event_id % 131 = 0").select("image_stem", F.lit(True).alias("odd"))
    det = B.details(spark, d).join(odd, "image_stem", "left").withColumn(
        "bbox_x1", F.when(F.col("odd") & (F.col("keypoint") == "tail"), F.col("bbox_x1") + 1).otherwise(F.col("bbox_x1")))
    return K.box_mismatches(det, damaged(spark, d))


_rep = [("frame_count", "select count(*) as value from track"), ("swing_count", "select count(distinct swing_id) as value from track"), ("duplicate_selected", "select 0::bigint as value"),
        ("duplicate_flow", "select count(*) as value from (select 1 from damaged group by image_stem having count(*) > 1)"), ("key_differences", f"select count(*) as value from ({_kd})"),
        ("value_mismatches", f"select count(*) as value from ({_mm})"), ("box_mismatches", f"select count(*) as value from ({_bm})")]


@query("alignment_report", " union all ".join(f"select '{n}' as measure, value from ({q})" for n, q in _rep), "damaged", "track")
def alignment_report(spark, d):
    return K.alignment_counts(B.details(spark, d), damaged(spark, d))


@query("verify_alignment", " union all ".join(f"select '{n}' as measure, value from ({q})" if n in ("frame_count", "swing_count") else f"select '{n}', 0::bigint" for n, q in _rep), "damaged", "track")
def verify_alignment(spark, d):
    return K.alignment_counts(B.details(spark, d), B.track(spark, d))


_h = "row_number() over (order by md5('7|' || swing_id), swing_id) - 1 as pos, count(*) over () as n"
_ids = "(select distinct swing_id from track)"


@query("entity_split", f"select swing_id, case when pos < round_even(n * 0.8e0, 0) then 'train' when pos < round_even(n * 0.8e0, 0) + round_even(n * 0.1e0, 0) then 'val' else 'test' end as split from (select *, {_h} from {_ids})", "track")
def entity_split(spark, d):
    return K.entity_split(B.track(spark, d), 0.8, 0.1, 7)


_known = "cast(regexp_extract(swing_id, '([0-9]+)$', 1) as int) % 3"


def _generation(number: int, where: str) -> str:
    return (f"select swing_id, case when pos < round_even(n * 0.8e0, 0) then 'train' when pos < round_even(n * 0.8e0, 0) + round_even(n * 0.1e0, 0) then 'val' else 'test' end as split, {number} as generation "
            f"from (select *, {_h} from (select distinct swing_id from track where {where}))")


@query("scan_split_assignment", f"{_generation(0, _known + ' <> 0')} union all {_generation(1, _known + ' = 0')}", "track")
def scan_split_assignment(spark, d):
    """A split file written for two thirds of the sequences, read again unchanged, then extended by the rest."""
    from trackloom.session import shared_folder
    from trackloom.sources.files import split_file
    ids, where = B.track(spark, d).select("swing_id").distinct(), shared_folder(spark, "splits")
    known = ids.filter(F.expr(_known) != 0)
    for wanted in (known, known, ids):
        out = split_file(spark, where, wanted, train=0.8, val=0.1, seed=7)
    return out


_splits = f"select swing_id, case when pos < round_even(n * 0.8e0, 0) then 'train' when pos < round_even(n * 0.8e0, 0) + round_even(n * 0.1e0, 0) then 'val' else 'test' end as split from (select *, {_h} from {_ids})"


@query("check_disjoint_splits", f"select swing_id, count(distinct split) as splits from ({_splits} union all select swing_id, 'test' from {_ids} where swing_id like '%3') group by swing_id having count(distinct split) > 1", "track")
def check_disjoint_splits(spark, d):
    s = K.entity_split(B.track(spark, d), 0.8, 0.1, 7)
    leak = B.track(spark, d).select("swing_id").distinct().filter(F.col("swing_id").endswith("3")).withColumn("split", F.lit("test"))
    return K.split_overlaps(s.unionByName(leak))


@query("join_split_map", f"select image_stem, swing_id, split from track join ({_splits}) using (swing_id)", "track")
def join_split_map(spark, d):
    t = B.track(spark, d)
    return t.select("image_stem", "swing_id").join(K.entity_split(t, 0.8, 0.1, 7), "swing_id")


@query("prepare_training", f"select split, count(*) as windows, " + r("sum(w)", 4) + f" as weight from (select swing_id, win_start, sum(case tail_visibility when 'partially_occluded' then 2e0 when 'fully_occluded' then 3e0 when 'ignore' then 4e0 else 0.75e0 end) as w from features group by all) join "
       f"(select swing_id, case when pos < greatest(1, round_even(n * 0.2e0, 0)) then 'val' else 'train' end as split from (select *, {_h} from (select distinct swing_id from features))) using (swing_id) group by split", "features")
def prepare_training(spark, d):
    from trackloom.plans.training import training_windows
    t = training_windows(X.tracked(spark, d), val_fraction=0.2, seed=7)
    total = F.aggregate("tail_weight", F.lit(0.0), lambda a, b: a + b)
    return rounded(t.groupBy("split").agg(F.count(F.lit(1)).alias("windows"), F.sum(total).alias("weight")), digits=4)


_expected = {"train": (8, 300), "val": (1, 100), "test": (1, 100), "holdout": (0, 0)}
_num = lambda e: f"coalesce('=' || cast(cast(round_even({e} * 1000000e0, 0) as bigint) as varchar), '-')"
_txt = lambda e: f"coalesce('=' || {e}, '-')"
_fp = lambda parts: f"cast(sum(cast(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::bigint as decimal(38, 0))) as decimal(38, 0))"
_sel_fp = _fp([_txt("d.swing_id"), _txt("image_stem"), _txt("keypoint"), *[_num(f) for f in (*K.PREDICTION_FIELDS, *K.BOX_FIELDS)]])
_flow_fp = _fp([_txt("d.swing_id"), _txt("image_stem"), *[_num(f"{k}_{f}") for k in ("head", "tail") for f in K.PREDICTION_FIELDS], *[_num(f) for f in K.BOX_FIELDS]])
cte("align_split", f"{_splits}", "track")


@query("alignment_splits", "select w.split, expected_swings, expected_frames, coalesce(selected_swings, 0) as selected_swings, coalesce(selected_rows, 0) as selected_rows, coalesce(selected_fingerprint, 0) as selected_fingerprint, "
       "coalesce(flow_swings, 0) as flow_swings, coalesce(flow_rows, 0) as flow_rows, coalesce(flow_fingerprint, 0) as flow_fingerprint, coalesce(frames, 0) as frames, coalesce(selected_swings, 0) = expected_swings and coalesce(frames, 0) = expected_frames as as_expected "
       "from (values " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in _expected.items()) + ") w(split, expected_swings, expected_frames) "
       f"left join (select split, count(distinct d.swing_id) as selected_swings, count(*) as selected_rows, {_sel_fp} as selected_fingerprint, count(distinct image_stem) as frames from details d join align_split using (swing_id) group by split) a using (split) "
       f"left join (select split, count(distinct d.swing_id) as flow_swings, count(*) as flow_rows, {_flow_fp} as flow_fingerprint from damaged d join align_split using (swing_id) group by split) b using (split)", "align_split", "details", "damaged")
def alignment_splits(spark, d):
    """Sizes, content fingerprints and expectations per split: one changed cell changes a fingerprint."""
    splits = K.entity_split(B.track(spark, d), 0.8, 0.1, 7)
    out = K.split_report(B.details(spark, d), damaged(spark, d), splits, _expected)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("selected_rows", "flow_rows")})


@query("alignment_sequences", "select split, swing_id, count(distinct image_stem) as frames from details join align_split using (swing_id) group by all", "align_split", "details")
def alignment_sequences(spark, d):
    return K.split_sequences(B.details(spark, d), K.entity_split(B.track(spark, d), 0.8, 0.1, 7))


@query("argument_guards", "select 'no windows' as guard, 'no windows: ' || count(*) || ' sequences, the longest has ' || max(n) || ' frames of ' || (max(n) + 1) as message from (select count(*) as n from track group by swing_id) "
       "union all select 'no training windows', 'no training windows: all ' || count(*) || ' are held out' from starts "
       "union all select 'accepted', count(*) || ' windows' from starts union all select 'window size', 'window size and stride must be positive' union all select 'flow clip', 'flow_clip_px must be finite and positive'", "track", "starts")
def argument_guards(spark, d):
    """The messages of guards: those of settings when they are made, those that depend on data when the query runs."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    from trackloom.operators.sequence import frame_positions
    from trackloom.operators.windows import explode_windows
    from trackloom.plans.training import trainable
    from trackloom.schemas import WindowSettings
    frames = materialised(frame_positions(B.track(spark, d).select("swing_id", "image_stem", "frame_idx")))
    longest = frames.agg(F.max("n")).first()[0]

    def message(run) -> str:
        try:
            return run()
        except ValueError as e:
            return str(e)
        except (PySparkException, Py4JJavaError) as e:
            raised = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?)\.? *(SQLSTATE|\n|$)", str(e))
            if not raised:
                raise
            return raised[1]

    def windows(settings=WindowSettings(), val_fraction: float = 0.2) -> str:
        starts = explode_windows(frames, settings).filter("idx = 0").select("swing_id", "win_start")
        return f"{trainable(starts.join(K.holdout_split(frames, val_fraction, 7), 'swing_id'), frames, settings).count()} windows"
    rows = [("no windows", message(lambda: windows(WindowSettings(size=longest + 1)))), ("no training windows", message(lambda: windows(val_fraction=1.0))),
            ("accepted", message(windows)), ("window size", message(lambda: WindowSettings(size=0))), ("flow clip", message(lambda: WindowSettings(flow_clip_px=float("inf"))))]
    return spark.createDataFrame(rows, "guard string, message string")


@query("missing_flow_counts", "select count(*) filter (l.image_stem is null) as missing_local, count(*) filter (g.frame_idx is null) as missing_global from track t left join (select image_stem from local_flow where frame_idx % 5 <> 0) l using (image_stem) "
       "left join (select swing_id, frame_idx from global_flow where frame_idx % 7 <> 0) g on g.swing_id = t.swing_id and g.frame_idx = t.frame_idx", "track", "local_flow", "global_flow")
def missing_flow_counts(spark, d):
    """Rows of a merge that found no local or no global partner, where some partners are taken away."""
    from trackloom.plans.flow import missing_flow
    wide = pivot_wide(B.details(spark, d), F.col("keypoint"))
    merged = W.merge_local(wide, local_rows(spark, d).filter("frame_idx % 5 <> 0").drop("frame_idx"))
    keyed = merged.join(B.track(spark, d).select("image_stem", "frame_idx"), "image_stem")
    return missing_flow(W.merge_global(keyed, global_rows(spark, d).filter("frame_idx % 7 <> 0")))


@query("leakage_guard", "select count(*) as rows, 0::bigint as changed from features", "features")
def leakage_guard(spark, d):
    """Feature rows that annotations can change: the original rows beside rows with overwritten annotations, by key and column."""
    from trackloom.operators.windows import observation_windows
    from trackloom.schemas import FEATURES_25
    t = X.tracked(spark, d)
    bad = t.withColumns({"head_gt_x": F.lit(9999.0), "tail_gt_y": F.lit(-9999.0), "head_visibility": F.lit("ignore"), "tail_visibility": F.lit("ignore")})
    out = K.column_differences(observation_windows(t), observation_windows(bad), ["swing_id", "win_start", "idx"], FEATURES_25)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("differing") > 0).alias("changed"))


@query("assert_required_columns", "select count(*) as rows from track", "track")
def assert_required_columns(spark, d):
    from trackloom.schemas import DETAIL_COLUMNS
    det = K.require_columns(B.details(spark, d), DETAIL_COLUMNS, "detail rows")
    return det.filter("keypoint = 'head'").agg(F.count(F.lit(1)).alias("rows"))


@query("feature_contract", "select 25 as width, count(*) as rows from features", "features")
def feature_contract(spark, d):
    """The feature table is stamped, stored, read back and checked."""
    from trackloom.operators.windows import observation_windows
    from trackloom.session import checkpoint_folder
    facts = K.feature_facts(False, "given", window_size=31)
    where = f"{checkpoint_folder(spark)}/features-{uuid.uuid4().hex}"
    K.stamped(observation_windows(X.tracked(spark, d)), facts).write.parquet(where)
    stored = K.require_contract(K.require_feature_order(spark.read.parquet(where), False), facts)
    return stored.agg(F.count(F.lit(1)).alias("rows")).withColumn("width", F.lit(len(facts["columns"].split(","))))
