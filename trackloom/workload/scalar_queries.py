"""Queries over scalar functions, filters and reshapes of track and detail rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import projection as P
from trackloom.operators import reshape as Z
from trackloom.schemas import DETAIL_COLUMNS, KEYPOINTS
from trackloom.workload import bindings as B
from trackloom.workload import frames as X
from trackloom.workload.bindings import cte
from trackloom.workload.registry import R, query, r, rounded, rs

_TEXT = ("case event_id % 7 when 0 then cast(value as {s}) when 1 then concat(' ', cast(event_id as {s}), ' ') when 2 then '' when 3 then 'bad' "
         "when 4 then 'NaN' when 5 then '-1.5e2' end")


@query("parse_lenient_number", "select event_id, case when bad then null when lower(trim(t)) = 'nan' then null else try_cast(trim(t) as double) end as x, "
       "case when bad then 7e0 when lower(trim(t)) = 'nan' then null else try_cast(trim(t) as double) end as x_default, "
       "cast(coalesce(case when bad or lower(trim(t)) = 'nan' then null else trunc(try_cast(trim(t) as double)) end, 0) as bigint) as i "
       f"from (select event_id, t, t is null or try_cast(trim(t) as double) is null as bad from (select event_id, {_TEXT.format(s='varchar')} as t from events))")
def parse_lenient_number(spark, d):
    t = B.table(spark, d, "events").selectExpr("event_id", _TEXT.format(s="string") + " as t")
    return t.select("event_id", S.parse_number(F.col("t")).alias("x"), S.parse_number(F.col("t"), 7.0).alias("x_default"), S.parse_integer(F.col("t")).alias("i"))


_NAME = ("case event_id % 5 when 0 then concat('run/swing_', cast(user_id as {s}), '_', lpad(cast(event_id as {s}), cast(greatest(6, length(cast(event_id as {s}))) as int), '0'), '.jpg') when 1 then concat(cast(event_id as {s}), '.png') "
         "when 2 then concat('frame_', cast(event_id as {s})) when 3 then 'nodigits' else concat('swing_042_', cast(event_id % 10 as {s}), '.mp4') end")
_STEM = "regexp_replace(regexp_replace(t, '^.*/', ''), '\\.[^.]*$', '')"


@query("parse_frame_index", "select event_id, cast(case when g = '' then 0 else cast(right(g, 6) as int) end as int) as last6, "
       "cast(case when len(l) > 0 then l[-1] end as bigint) as last_group, cast(nullif(regexp_extract(s, '([0-9]+)$', 1), '') as bigint) as trailing, "
       "cast(coalesce(trunc(try_cast(coalesce(nullif(f, ''), t) as double)), 0) as bigint) as field "
       f"from (select event_id, t, f, regexp_replace(t, '[^0-9]', '', 'g') as g, {_STEM} as s, regexp_extract_all({_STEM}, '[0-9]+') as l "
       f"from (select event_id, {_NAME.format(s='varchar')} as t, case when event_id % 2 = 0 then cast(event_id as varchar) else '' end as f from events))")
def parse_frame_index(spark, d):
    t = B.table(spark, d, "events").selectExpr("event_id", _NAME.format(s="string") + " as t", "case when event_id % 2 = 0 then cast(event_id as string) else '' end as f")
    c = F.col("t")
    return t.select("event_id", S.frame_index_last6(c).alias("last6"), S.frame_index_last_group(c).alias("last_group"),
                    S.frame_index_trailing(c).alias("trailing"), S.frame_index_field(F.col("f"), F.lit(""), c).alias("field"))


@query("parse_entity_and_frame", "select event_id, case when m then regexp_extract(t, '^(swing_[0-9]+)_(.+)$', 1) else g end as entity, "
       "case when m then regexp_extract(t, '^(swing_[0-9]+)_(.+)$', 2) else t end as frame, case when m or g is null then t else g || '_' || t end as image_stem "
       f"from (select *, regexp_matches(t, '^swing_[0-9]+_.+$') as m from (select event_id, {_STEM} as t, g from (select event_id, {_NAME.format(s='varchar')} as t, case when event_id % 3 = 0 then 'swing_7' end as g from events)))")
def parse_entity_and_frame(spark, d):
    t = B.table(spark, d, "events").selectExpr("event_id", _NAME.format(s="string") + " as p", "case when event_id % 3 = 0 then 'swing_7' end as g")
    t = t.withColumn("t", S.file_stem(F.col("p")))
    return t.select("event_id", S.entity_of(F.col("t"), F.col("g")).alias("entity"), S.frame_of(F.col("t")).alias("frame"), S.image_stem_of(F.col("t"), F.col("g")).alias("image_stem"))


@query("entity_key", "select o_orderkey, coalesce(nullif(a, ''), nullif(b, ''), c) as entity, coalesce(nullif(v, ''), nullif(w, ''), 'view_0') || case when m not in ('', 'none') then '__' || m else '' end as view_key from "
       "(select o_orderkey, case when o_orderkey % 3 = 0 then '' else 's' || o_custkey end as a, case when o_orderkey % 2 = 0 then '' else 'q' || o_custkey end as b, 'src' as c, "
       "case when o_orderkey % 5 = 0 then 'v' || o_orderkey % 4 else '' end as v, case when o_orderkey % 7 <> 0 then 'cam' else '' end as w, case o_orderkey % 4 when 0 then 'none' when 1 then 'horizontal' else '' end as m from orders)")
def entity_key(spark, d):
    o = B.table(spark, d, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 3 = 0 then '' else concat('s', o_custkey) end as a", "case when o_orderkey % 2 = 0 then '' else concat('q', o_custkey) end as b",
        "case when o_orderkey % 5 = 0 then concat('v', o_orderkey % 4) else '' end as v", "case when o_orderkey % 7 <> 0 then 'cam' else '' end as w",
        "case o_orderkey % 4 when 0 then 'none' when 1 then 'horizontal' else '' end as m")
    return o.select("o_orderkey", S.first_text(F.col("a"), F.col("b"), F.lit("src")).alias("entity"),
                    S.view_key(F.col("v"), F.col("w"), F.lit(""), F.col("m")).alias("view_key"))


cte("cand", "select c.*, r.swing_id, r.frame_no, r.frame_name, r.image_stem from candidates c join records r on l_orderkey = o_orderkey", "candidates", "records")


def candidate_rows(spark, d):
    """One row per (frame, detection)."""
    return B.records(spark, d).select("image_stem", "swing_id", F.explode("detections").alias("det")).select(
        "image_stem", "swing_id", "det.*")


@query("denormalise_points", f"select image_stem, cast(rank as int) as detection_rank, {rs('hx hy')}, " + ", ".join(
    f"{r(e)} as {n}" for n, e in (("x1", "cx - bw * 960"), ("y1", "cy - bh * 540"), ("x2", "cx + bw * 960"), ("y2", "cy + bh * 540"))) + " from cand", "cand")
def denormalise_points(spark, d):
    b = F.col("bbox")
    return candidate_rows(spark, d).select(
        "image_stem", "detection_rank", R(F.col("head.x") * 1920.0).alias("hx"), R(F.col("head.y") * 1080.0).alias("hy"),
        R((b["xc"] - b["w"] / 2) * 1920.0).alias("x1"), R((b["yc"] - b["h"] / 2) * 1080.0).alias("y1"),
        R((b["xc"] + b["w"] / 2) * 1920.0).alias("x2"), R((b["yc"] + b["h"] / 2) * 1080.0).alias("y2"))


@query("point_distance", f"select image_stem, {r('sqrt((head_pred_x - tail_pred_x)**2 + (head_pred_y - tail_pred_y)**2)')} as length, {r('sqrt((tail_pred_x - tail_gt_x)**2 + (tail_pred_y - tail_gt_y)**2)')} as error_px from track", "track")
def point_distance(spark, d):
    c = F.col
    return B.track(spark, d).select("image_stem", R(S.distance(c("head_pred_x"), c("head_pred_y"), c("tail_pred_x"), c("tail_pred_y"))).alias("length"),
                                    R(S.distance(c("tail_pred_x"), c("tail_pred_y"), c("tail_gt_x"), c("tail_gt_y"))).alias("error_px"))


@query("direction_degrees", f"select image_stem, {r('p')} as predicted, {r('g')} as truth, {r('coalesce(least(abs(p - g) % 360, 360 - abs(p - g) % 360), 0)')} as delta from (select image_stem, "
       "degrees(atan2(head_pred_y - tail_pred_y, head_pred_x - tail_pred_x)) as p, degrees(atan2(head_gt_y - tail_gt_y, head_gt_x - tail_gt_x)) as g from track)", "track")
def direction_degrees(spark, d):
    c = F.col
    t = B.track(spark, d).select("image_stem", S.direction_degrees(*[c(f"{k}_pred_{a}") for k in KEYPOINTS for a in "xy"]).alias("p"),
                                 S.direction_degrees(*[c(f"{k}_gt_{a}") for k in KEYPOINTS for a in "xy"]).alias("g"))
    return t.select("image_stem", R("p").alias("predicted"), R("g").alias("truth"), R(S.angle_delta(c("p"), c("g"))).alias("delta"))


@query("observation_validity", "select image_stem, coalesce(head_pred_x is not null and head_pred_conf > 0, false) as head_seen, coalesce(tail_pred_x is not null and tail_pred_conf > 0 and event_id % 3 <> 0, false) as tail_seen from track", "track")
def observation_validity(spark, d):
    c = F.col
    return B.track(spark, d).select("image_stem", S.observed(c("head_pred_x"), c("head_pred_y"), c("head_pred_conf")).alias("head_seen"),
                                    S.observed(c("tail_pred_x"), c("tail_pred_y"), c("tail_pred_conf"), c("event_id") % 3 != 0).alias("tail_seen"))


@query("normalise_batter_side", "select name, case when lower(trim(batter_side)) like 'l%' then 'left' else 'right' end as side, case when lower(trim(batter_side)) like 'l%' then 'L' else 'R' end as hand from clips", "clips")
def normalise_batter_side(spark, d):
    return B.clips(spark, d).select("name", S.batter_side(F.col("batter_side")).alias("side"), S.batter_hand(F.col("batter_side")).alias("hand"))


@query("canonical_view_label", f"select name, {X._canon(X._T, X._L)} as view_label from clips", "clips")
def canonical_view_label(spark, d):
    return B.clips(spark, d).select("name", S.canonical_view(F.col("view"), F.col("batter_side")).alias("view_label"))


@query("view_one_hot", "select name, " + ", ".join(f'cast(v = \'{v}\' as double) as "view_{v}"' for v in ("1b_side", "front", "3b_side", "home_side", "random"))
       + f" from (select name, {X._canon(X._T, X._L)} as v from clips)", "clips")
def view_one_hot(spark, d):
    label = S.canonical_view(F.col("view"), F.col("batter_side"))
    return B.clips(spark, d).withColumn("v", label).select("name", *[c.alias(n) for n, c in S.view_one_hot(F.col("v")).items()])


@query("mirror_normalised", f"select image_stem, {r('case when flip then 1 - head_pred_x / 1920 else head_pred_x / 1920 end')} as hx, {r('case when flip then 1 - tail_gt_x / 1920 else tail_gt_x / 1920 end')} as gx from tracked", "tracked")
def mirror_normalised(spark, d):
    t = X.tracked(spark, d)
    return t.select("image_stem", R(S.mirrored_x(F.col("head_pred_x") / 1920.0, F.col("flip"))).alias("hx"), R(S.mirrored_x(F.col("tail_gt_x") / 1920.0, F.col("flip"))).alias("gx"))


@query("clip01", f"select event_id, {r('least(greatest(value / 300, 0), 1)')} as unit, {r('least(greatest(value - 200, -50), 50)')} as symmetric, {r('least(greatest(value - 200, 0), 50)')} as positive from events")
def clip01(spark, d):
    v = F.col("value")
    return B.table(spark, d, "events").select("event_id", R(S.clamp(v / 300, 0.0, 1.0)).alias("unit"), R(S.clamp(v - 200, -50.0, 50.0)).alias("symmetric"), R(S.clamp(v - 200, 0.0, 50.0)).alias("positive"))


@query("status_from_visibility", "select image_stem, keypoint, status from details", "details")
def status_from_visibility(spark, d):
    return B.details(spark, d).select("image_stem", "keypoint", S.status_from_visibility(F.col("visibility"), F.col("pred_x").isNotNull()).alias("status"))


_bucket = "case when error_px is null then -1 when error_px < 5 then 0 when error_px < 10 then 1 when error_px < 20 then 2 else 3 end"


@query("error_bucket", f"select image_stem, keypoint, {_bucket} as bucket from details", "details")
def error_bucket(spark, d):
    return B.details(spark, d).select("image_stem", "keypoint", S.error_bucket(F.col("error_px")).alias("bucket"))


@query("error_frame_weight", "select image_stem, keypoint, case when visibility <> 'fully_visible' or pred_x is null then 4e0 when error_px < 5 then 0.3e0 when error_px < 10 then 1e0 when error_px < 20 then 2e0 else 4e0 end "
       "* cast(gt_x is not null and visibility <> 'ignore' as int) as weight from details", "details")
def error_frame_weight(spark, d):
    c = F.col
    return B.details(spark, d).select("image_stem", "keypoint", S.error_frame_weight(
        c("error_px"), c("visibility"), c("pred_x").isNotNull(), c("gt_x").isNotNull() & (c("visibility") != "ignore")).alias("weight"))


@query("quality_target", f"select image_stem, keypoint, {r('case when error_px is not null then least(greatest((10 - error_px) / 5, 0), 1) end')} as quality from details", "details")
def quality_target(spark, d):
    return B.details(spark, d).select("image_stem", "keypoint", R(S.quality_target(F.col("error_px"))).alias("quality"))


@query("visibility_weight", "select image_stem, keypoint, case visibility when 'partially_occluded' then 2e0 when 'fully_occluded' then 3e0 when 'ignore' then 4e0 else 0.75e0 end as weight from details", "details")
def visibility_weight(spark, d):
    return B.details(spark, d).select("image_stem", "keypoint", S.visibility_weight(F.col("visibility"), (0.75, 2.0, 3.0, 4.0)).alias("weight"))


@query("bat_vector", "select image_stem, " + ", ".join(f"{r(e)} as {n}" for n, e in (
    ("dx", "(tail_pred_x - head_pred_x) / 1920"), ("dy", "(tail_pred_y - head_pred_y) / 1080"), ("bbox_w", "bbox_x2 - bbox_x1"), ("bbox_h", "bbox_y2 - bbox_y1"),
    ("pred_bat_length", "sqrt((head_pred_x - tail_pred_x)**2 + (head_pred_y - tail_pred_y)**2)"), ("gt_bat_length", "sqrt((head_gt_x - tail_gt_x)**2 + (head_gt_y - tail_gt_y)**2)"))) + " from track", "track")
def bat_vector(spark, d):
    from trackloom.operators.flow import sanity_columns
    c = F.col
    t = sanity_columns(B.track(spark, d)).withColumns({"dx": (c("tail_pred_x") - c("head_pred_x")) / 1920.0, "dy": (c("tail_pred_y") - c("head_pred_y")) / 1080.0})
    return rounded(t.select("image_stem", "dx", "dy", "bbox_w", "bbox_h", "pred_bat_length", "gt_bat_length"))


@query("trust_target", f"select image_stem, {r('''case when ox is null and nn >= 0.25 then null when nn >= 0.25 then t * least(greatest((sqrt(ox**2 + oy**2) - sqrt((t * dx - ox)**2 + (t * dy - oy)**2) - 0.5) / 2.5, 0), 1) when nn is not null then 0e0 end''')} as trust from "
       "(select *, least(greatest((ox * dx + oy * dy) / greatest(nn, 1e-6), 0), 1) as t from (select *, dx**2 + dy**2 as nn from (select image_stem, event_id % 9 - 4e0 as dx, event_id % 7 - 3e0 as dy, tail_gt_x - tail_pred_x as ox, tail_gt_y - tail_pred_y as oy from track)))", "track")
def trust_target(spark, d):
    c = F.col
    return B.track(spark, d).select("image_stem", R(S.trust_target((c("event_id") % 9 - 4).cast("double"), (c("event_id") % 7 - 3).cast("double"),
                                                   c("tail_gt_x") - c("tail_pred_x"), c("tail_gt_y") - c("tail_pred_y"))).alias("trust"))


@query("safe_name", "select doc_id, coalesce(nullif(trim(regexp_replace(t, '[^\\p{L}\\p{N}_-]', '_', 'g'), '_'), ''), 'view') as name from (select doc_id, case when doc_id % 5 = 0 then '!!' else source || ' / ' || lang || '.' || doc_id % 7 || '?' end as t from documents)")
def safe_name(spark, d):
    t = B.table(spark, d, "documents").selectExpr("doc_id", "case when doc_id % 5 = 0 then '!!' else concat(source, ' / ', lang, '.', cast(doc_id % 7 as string), '?') end as t")
    return t.select("doc_id", S.safe_name(F.col("t")).alias("name"))


@query("parse_hand_from_name", "select user_id, event_id, case event_id % 4 when 0 then 'R' when 1 then 'L' else '' end as hand from events")
def parse_hand_from_name(spark, d):
    t = B.table(spark, d, "events").selectExpr("user_id", "event_id", "case event_id % 4 when 0 then concat('take_r_', event_id) when 1 then concat('take_L_', event_id) when 2 then 'takeR' else concat('R_', event_id) end as t")
    return t.select("user_id", "event_id", S.hand_from_name(F.col("t")).alias("hand"))


# --- filters ---------------------------------------------------------------------

_mixed = ("select *, case when detection_rank = 3 then '' else image_stem end as stem2, case when detection_rank = 3 and swing_id like '%7' then '' else frame end as frame2, "
          "case when bbox_conf > 0.9 then 'box' else keypoint end as kp2 from details")


def _mixed_rows(spark, d):
    return B.details(spark, d).withColumns({
        "stem2": F.expr("case when detection_rank = 3 then '' else image_stem end"),
        "frame2": F.expr("case when detection_rank = 3 and swing_id like '%7' then '' else frame end"),
        "kp2": F.expr("case when bbox_conf > 0.9 then 'box' else keypoint end")})


@query("filter_keypoint_rows", f"select swing_id, image_stem as id, kp2 as keypoint from ({_mixed}) where kp2 in ('head', 'tail') and coalesce(nullif(stem2, ''), nullif(frame2, '')) is not null", "details")
def filter_keypoint_rows(spark, d):
    m = _mixed_rows(spark, d).withColumn("id", F.col("image_stem")).drop("keypoint", "image_stem", "frame").withColumnsRenamed({"kp2": "keypoint", "stem2": "image_stem", "frame2": "frame"})
    return Z.keypoint_filter(m).select("swing_id", "id", "keypoint")


@query("filter_eligible_candidates", "select image_stem, cast(rank as int) as detection_rank from cand where hc >= 0.1 and tc >= 0.1", "cand")
def filter_eligible_candidates(spark, d):
    from trackloom.operators.selection import eligible, pixel_candidates
    rec = B.records(spark, d)
    return rec.select("image_stem", F.explode(eligible(pixel_candidates(F.col("detections"), 1920.0, 1080.0))).alias("c")).select("image_stem", F.col("c.rank").alias("detection_rank"))


@query("target_valid", "select image_stem, coalesce(head_gt_x is not null and tail_gt_x is not null and tail_visibility <> 'ignore', false) as target_valid from track", "track")
def target_valid(spark, d):
    c = F.col
    ok = c("tail_visibility") != "ignore"
    for k in KEYPOINTS:
        for a in "xy":
            ok = ok & S.finite(c(f"{k}_gt_{a}")).isNotNull()
    return B.track(spark, d).select("image_stem", ok.alias("target_valid"))


@query("valid_xyz", "select sequence_id, frame_idx, marker, coalesce(sqrt(x**2 + y**2 + z**2) > 1e-9, false) as ok from markers", "markers")
def valid_xyz(spark, d):
    return B.markers(spark, d).select("sequence_id", "frame_idx", "marker", P.valid_xyz(F.col("x"), F.col("y"), F.col("z")).alias("ok"))


@query("filter_sources", "select distinct source from markers where lower(source) not like '%model%' order by source", "markers")
def filter_sources(spark, d):
    return P.usable_sources(B.markers(spark, d).select("source").distinct(), "source")


@query("sorted_top_n", "select source, frames from (select source, count(*) as frames from markers group by source) order by source limit 5", "markers")
def sorted_top_n(spark, d):
    return B.markers(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("frames")).orderBy("source").limit(5)


# --- reshape ----------------------------------------------------------------------

@query("pivot_keypoints_frame", f"select image_stem, swing_id, frame, frame_idx, {rs('bbox_conf bbox_x1 bbox_y1 bbox_x2 bbox_y2 head_pred_x head_pred_y head_pred_conf tail_pred_x tail_pred_y tail_pred_conf')} from track", "track")
def pivot_keypoints_frame(spark, d):
    return rounded(Z.pivot_frames(B.details(spark, d), F.col("keypoint")))


_wide_cols = [f"{k}_{f}" for k in KEYPOINTS for f in ("gt_x", "gt_y", "pred_x", "pred_y", "pred_conf")]


@query("pivot_keypoints_wide", f"select image_stem, swing_id, view, batter_side, frame, detection_rank, head_visibility, tail_visibility, {rs(['bbox_conf', 'bbox_x1', *_wide_cols])}, "
       + ", ".join(f"{r(f'{k}_pred_{a} - {k}_gt_{a}')} as {k}_d{a}" for k in KEYPOINTS for a in "xy")
       + ", case when head_visibility = 'ignore' then 'ignore' when head_pred_x is null then 'missing_prediction' else 'matched' end as status from track", "track")
def pivot_keypoints_wide(spark, d):
    w = Z.pivot_wide(B.details(spark, d), F.col("keypoint"))
    return rounded(w.select("image_stem", "swing_id", "view", "batter_side", "frame", "detection_rank", "head_visibility", "tail_visibility", "bbox_conf", "bbox_x1",
                            *_wide_cols, *[f"{k}_d{a}" for k in KEYPOINTS for a in "xy"], "status"))


@query("distinct_entities", "select distinct swing_id from details", "details")
def distinct_entities(spark, d):
    return B.details(spark, d).select("swing_id").distinct()


@query("scan_long_details", f"select swing_id, image_stem, frame_idx, {rs(_wide_cols)}, head_visibility, tail_visibility, h.status as head_status, t.status as tail_status from track "
       "join (select image_stem, status from details where keypoint = 'head') h using (image_stem) join (select image_stem, status from details where keypoint = 'tail') t using (image_stem)", "track", "details")
def scan_long_details(spark, d):
    return rounded(Z.frames_with_both_points(B.details(spark, d)))


@query("scan_wide_details", "select image_stem, " + ", ".join(
    f"coalesce({k}_pred_x is not null and {k}_pred_conf > 0, false) as {k}_seen, {r(f'case when {k}_pred_x is not null and {k}_pred_conf > 0 then {k}_pred_conf else 0e0 end')} as {k}_pred_conf" for k in KEYPOINTS)
       + " from track", "track")
def scan_wide_details(spark, d):
    t = B.track(spark, d).withColumn("status", F.lit(""))
    return rounded(Z.wide_observations(t).select("image_stem", "head_seen", "head_pred_conf", "tail_seen", "tail_pred_conf"))


@query("scan_clip_metadata", "select swing_id, side, hand, flip, source_view, view_label from meta", "meta")
def scan_clip_metadata(spark, d):
    return X.metadata(spark, d)


cte("meta2", "select 'swing_' || s_suppkey as swing_id, 'left' as side, 'L' as hand, true as flip, s_name as source_view, 'front' as view_label from supplier")


@query("combine_metadata", "select * from meta2 union all select * from meta where swing_id not in (select swing_id from meta2)", "meta", "meta2")
def combine_metadata(spark, d):
    later = B.table(spark, d, "supplier").selectExpr("concat('swing_', s_suppkey) as swing_id", "'left' as side", "'L' as hand", "true as flip", "s_name as source_view", "'front' as view_label")
    return Z.combine_metadata(X.metadata(spark, d), later)


@query("join_clip_metadata", "select image_stem, swing_id, side, hand, flip, source_view, view_label from tracked", "tracked")
def join_clip_metadata(spark, d):
    return X.tracked(spark, d).select("image_stem", "swing_id", "side", "hand", "flip", "source_view", "view_label")


@query("metadata_histogram", "select side, null::varchar as view_label, count(*) as sequences from meta group by side union all select null, view_label, count(*) from meta group by view_label", "meta")
def metadata_histogram(spark, d):
    from trackloom.operators.metrics import metadata_histogram as hist
    return hist(X.metadata(spark, d))


@query("scan_annotations", "select image_stem, head_visibility, tail_visibility, head_x, tail_x from (select swing_id || '_' || regexp_replace(frame, '\\.[^.]*$', '') as image_stem, * from annotations)", "annotations")
def scan_annotations(spark, d):
    from trackloom.sources.readers import annotation_rows
    raw = B.annotations(spark, d)
    old = raw.withColumns({"head_visibility": F.lit("stale"), "line_no": F.lit(0)})
    return annotation_rows(old.unionByName(raw.withColumn("line_no", F.lit(1)))).select("image_stem", "head_visibility", "tail_visibility", "head_x", "tail_x")


@query("scan_visibility_labels", "select swing_id, frame_idx, tail_visibility as visibility, 'labels' as source from track union all select swing_id, frame_idx, tail_visibility, 'details' from track", "track")
def scan_visibility_labels(spark, d):
    labels = B.track(spark, d).select("swing_id", "frame", "image_stem", "tail_visibility", F.lit(0).alias("line_no"))
    a = Z.visibility_from_labels(labels, "line_no").withColumn("source", F.lit("labels"))
    b = Z.visibility_from_details(B.details(spark, d).withColumn("line_no", F.lit(0)), "line_no").withColumn("source", F.lit("details"))
    return a.unionByName(b)


@query("union_details", "select image_stem, keypoint, visibility, status from details union all select image_stem, 'tail_visible_aux', '', 'gt_only' from track where tail_visibility = 'ignore' and event_id % 2 = 0", "details", "track")
def union_details(spark, d):
    from trackloom.operators.evaluation_rows import auxiliary_rows, detail_order
    aux = auxiliary_rows(B.track(spark, d).withColumns({"bat_visible_aux_x": F.when(F.col("event_id") % 2 == 0, 1.0), "bat_visible_aux_y": F.lit(1.0)}))
    return B.details(spark, d).unionByName(aux).orderBy(*detail_order()).select("image_stem", "keypoint", "visibility", "status")


@query("sink_detail_rows", "select image_stem, keypoint, coalesce(printf('%.6f', gt_x), '') as gt_x, coalesce(printf('%.6f', pred_conf), '') as pred_conf, cast(detection_rank as varchar) as detection_rank, coalesce(printf('%.6f', bbox_x1), '') as bbox_x1, status from details", "details")
def sink_detail_rows(spark, d):
    """Detail rows written as sorted CSV text and read back."""
    from trackloom.session import shared_folder
    from trackloom.sources.sinks import write_details
    where = shared_folder(spark, "details")
    write_details(B.details(spark, d), where)
    text = spark.read.option("header", True).csv(where)
    assert tuple(text.columns) == DETAIL_COLUMNS
    return text.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("image_stem", "keypoint", "gt_x", "pred_conf", "detection_rank", "bbox_x1", "status")])


@query("sequence_profile", "select swing_id, count(*) as frames, count(*) filter (head_gt_x is not null and tail_gt_x is not null and tail_visibility <> 'ignore') as target_frames, count(*) filter (tail_pred_x is not null and tail_pred_conf > 0) as tail_predictions, "
       "count(*) filter (tail_visibility = 'ignore') as tail_ignored, coalesce(count(*) filter (tail_visibility <> 'ignore' and tail_pred_x is not null), 0) as matched from track group by swing_id", "track")
def sequence_profile(spark, d):
    from trackloom.operators.metrics import sequence_profile as profile
    c = F.col
    t = B.track(spark, d)
    rows = t.select("swing_id", "tail_visibility", S.status_from_visibility(c("tail_visibility"), c("tail_pred_x").isNotNull()).alias("tail_status"),
                    S.observed(c("tail_pred_x"), c("tail_pred_y"), c("tail_pred_conf")).alias("tail_seen"),
                    (c("head_gt_x").isNotNull() & c("tail_gt_x").isNotNull() & (c("tail_visibility") != "ignore")).alias("target_valid"))
    p = profile(rows)
    return p.withColumn("matched", F.coalesce(F.try_element_at("tail_status", F.lit("matched")), F.lit(0))).drop("tail_status")


@query("envelope_crop", "select swing_id, cast(round_even(l, 0) as int) as \"left\", cast(round_even(t, 0) as int) as top, cast(round_even(l + w2, 0) as int) as \"right\", cast(round_even(t + h2, 0) as int) as bottom from "
       "(select *, greatest(0, least((lx + hx) / 2 - w2 / 2, 1920 - w2)) as l, greatest(0, least((ly + hy) / 2 - h2 / 2, 1080 - h2)) as t from (select *, least(case when w * 3 < h * 4 then h * 4 / 3 else w end, 1920) as w2, "
       "least(case when w * 3 < h * 4 then h else w * 3 / 4 end, 1080) as h2 from (select swing_id, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy, (max(x) - min(x)) * 1.6e0 as w, (max(y) - min(y)) * 1.6e0 as h from "
       "(select swing_id, tail_gt_x as x, tail_gt_y as y from track where head_gt_x is not null and tail_gt_x is not null and tail_visibility <> 'ignore') group by swing_id)))", "track")
def envelope_crop(spark, d):
    from trackloom.operators.metrics import envelope_crop as crop
    c = F.col
    t = B.track(spark, d).select("swing_id", c("tail_gt_x").alias("gt_tail_px"), c("tail_gt_y").alias("gt_tail_py"),
                                 (c("head_gt_x").isNotNull() & c("tail_gt_x").isNotNull() & (c("tail_visibility") != "ignore")).alias("target_valid"))
    return crop(t)
