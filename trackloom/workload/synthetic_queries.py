"""Queries over projected marker tracks and synthetic windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import augment as A
from trackloom.operators import projection as P
from trackloom.operators.sequence import frame_positions
from trackloom.plans.synthetic import pool_sampler, pooled_frames, projected_tracks, sample_rows, synthetic_windows
from trackloom.schemas import BODY_MARKERS, FEATURES_25, WindowSettings
from trackloom.session import materialised, shared_folder
from trackloom.sources.files import read_folders, read_quarantine, read_shards, write_exact_shards, write_folders
from trackloom.workload import bindings as B
from trackloom.workload import frames as X
from trackloom.workload.bindings import cte
from trackloom.workload.registry import R, query, r, rounded, rounded_small, rs

SEED = 7
U = lambda purpose, key: f"(('0x' || substr(md5('{SEED}|{purpose}|' || {key}), 1, 13))::bigint / 4503599627370496e0)"
_bad = lambda k: f"sqrt({k}_x**2 + {k}_y**2 + {k}_z**2) > 1e-9"
cte("bat", "select source, sequence_id, frame_idx, " + ", ".join(f"max({a}) filter (upper(marker) = 'MARKER1') as tail_{a}" for a in "xyz") + ", "
    + ", ".join(f"(max({a}) filter (upper(marker) = 'MARKER2') + max({a}) filter (upper(marker) = 'MARKER3')) / 2 as head_{a}" for a in "xyz")
    + " from markers where upper(marker) in ('MARKER1', 'MARKER2', 'MARKER3') group by all", "markers")
cte("units", f"select sequence_id, case when m > 10 then 0.001e0 else 1e0 end as scale, case when m > 10 then 'mm_to_m' when m is not null then 'already_m' else 'unknown' end as unit_mode from (select sequence_id, median(case when {_bad('head')} and {_bad('tail')} then sqrt((head_x - tail_x)**2 + (head_y - tail_y)**2 + (head_z - tail_z)**2) end) as m from bat group by 1)", "bat")
cte("mtrack", "select source, sequence_id, frame_idx, unit_mode, " + ", ".join(f"{k}_{a} * scale as {k}_{a}" for k in ("head", "tail") for a in "xyz") + " from bat join units using (sequence_id)", "bat", "units")
cte("bounds", "select sequence_id, " + ", ".join(f"avg({a}) as center_{a}" for a in "xyz") + ", sqrt((max(x) - min(x))**2 + (max(y) - min(y))**2 + (max(z) - min(z))**2) * 0.5e0 as radius from (select sequence_id, head_x as x, head_y as y, head_z as z from mtrack union all select sequence_id, tail_x, tail_y, tail_z from mtrack) where sqrt(x**2 + y**2 + z**2) > 1e-9 group by sequence_id", "mtrack")
_f = ("yaw", "pitch", "roll", "zoom", "pan_x", "pan_y")
cte("cams", "select sequence_id, camera_id, camera_type, camera_name, " + ", ".join(f"""{f}_lo + {U(f, "sequence_id || '|' || camera_id")} * ({f}_hi - {f}_lo) as {f}""" for f in _f) + " from (select distinct sequence_id, cast(regexp_extract(sequence_id, '([0-9]+)$', 1) as int) % 5 as rig from mtrack) join cameras using (rig)", "mtrack", "cameras")
cte("basis0", "select *, greatest(radius, 1) * 5 as distance, -cos(radians(pitch)) * cos(radians(yaw)) as fx, -cos(radians(pitch)) * sin(radians(yaw)) as fy, -sin(radians(pitch)) as fz from cams join bounds using (sequence_id)", "cams", "bounds")
cte("basis1", "select *, sqrt(fx * fx + fy * fy) as rn from basis0", "basis0")  # fixed pitches never reach the steep case
cte("basis2", "select *, fy / rn as rx, -fx / rn as ry, 0e0 as rz, center_x - fx * distance as eye_x, center_y - fy * distance as eye_y, center_z - fz * distance as eye_z from basis1", "basis1")
cte("basis3", "select *, ry * fz - rz * fy as ux, rz * fx - rx * fz as uy, rx * fy - ry * fx as uz, cos(radians(roll)) as cr, sin(radians(roll)) as sr from basis2", "basis2")
cte("basis", "select *, " + ", ".join(f"cr * r{a} + sr * u{a} as right_{a}, -sr * r{a} + cr * u{a} as up_{a}, f{a} as fwd_{a}" for a in "xyz") + " from basis3", "basis3")
_rel = lambda k, n: " + ".join(f"(t.{k}_{a} - b.eye_{a}) * b.{n}_{a}" for a in "xyz")
cte("proj0", "select t.source, t.sequence_id, t.frame_idx, b.camera_id, b.camera_name, b.zoom, b.pan_x, b.pan_y, b.distance, " + ", ".join(f"{_rel(k, n)} as {k}_{v}" for k in ("head", "tail") for n, v in (("right", "px"), ("up", "py"), ("fwd", "depth")))
    + f" from (select * from mtrack where {_bad('head')} and {_bad('tail')}) t join basis b using (sequence_id)", "mtrack", "basis")
cte("proj1", "select *, " + ", ".join(f"case when {k}_depth > 1e-6 then zoom * (35 / 36e0 * 1920) * {k}_px / {k}_depth + 1920 * (0.5 + pan_x) end as {k}_u, case when {k}_depth > 1e-6 then 1080 * (0.5 + pan_y) - zoom * (35 / 36e0 * 1920) * {k}_py / {k}_depth end as {k}_v" for k in ("head", "tail")) + " from proj0", "proj0")
cte("proj", "select *, " + ", ".join(f"coalesce({k}_u >= 0 and {k}_u < 1920 and {k}_v >= 0 and {k}_v < 1080, false) as {k}_in_frame" for k in ("head", "tail")) + ", case when sequence_id like 'take_R%' then 'R' else 'L' end as batter_hand from proj1", "proj1")
_name = "case when m and camera_name like '%1B_side%' then replace(camera_name, '1B_side', '3B_side') when m and camera_name like '%3B_side%' then replace(camera_name, '3B_side', '1B_side') else camera_name end"
cte("projm", f"select * replace (case when m then 1919 - head_u else head_u end as head_u, case when m then 1919 - tail_u else tail_u end as tail_u, {_name} as camera_name, case when m then case batter_hand when 'R' then 'L' else 'R' end else batter_hand end as batter_hand), case when m then 'horizontal' else 'none' end as mirror from (select proj.*, unnest([false, true]) as m from proj)", "proj")

_h = "row_number() over (order by md5('7|' || swing_id), swing_id) - 1 as pos, count(*) over () as n"
cte("syn_split", f"select swing_id, case when pos < round_even(n * 0.8e0, 0) then 'train' when pos < round_even(n * 0.8e0, 0) + round_even(n * 0.1e0, 0) then 'val' else 'test' end as split from (select *, {_h} from (select distinct sequence_id as swing_id from markers))", "markers")


_PK = "sequence_id, camera_id, frame_idx"


def _rigs(spark, d):
    return B.markers(spark, d).select("sequence_id").distinct().withColumn("rig", (F.regexp_extract("sequence_id", "([0-9]+)$", 1).cast("int") % 5).cast("int"))


def _projected(spark, d, **kw):
    return projected_tracks(B.markers(spark, d), P.sequence_cameras(_rigs(spark, d), B.cameras(spark, d)), SEED, **kw)


@query("marker_track_to_bat", f"select source, sequence_id, frame_idx, {rs([f'{k}_{a}' for k in ('tail', 'head') for a in 'xyz'])} from bat", "bat")
def marker_track_to_bat(spark, d):
    return rounded(P.bat_track(B.markers(spark, d)).drop("fps"))


@query("estimate_unit_scale", "select * from units", "units")
def estimate_unit_scale(spark, d):
    return P.unit_scales(P.bat_track(B.markers(spark, d)))


@query("scene_bounds", f"select sequence_id, {rs('center_x center_y center_z radius')} from bounds", "bounds")
def scene_bounds(spark, d):
    return rounded(P.scene_bounds(P.scaled_track(P.bat_track(B.markers(spark, d)))))


@query("sample_cameras", f"select sequence_id, camera_id, camera_type, camera_name, {rs(list(_f))} from cams", "cams")
def sample_cameras(spark, d):
    return rounded(P.sample_cameras(P.sequence_cameras(_rigs(spark, d), B.cameras(spark, d)), SEED))


_vec = [f"{n}_{a}" for n in ("eye", "fwd", "right", "up") for a in "xyz"]


@query("camera_basis", f"select sequence_id, camera_id, {rs(['distance', *_vec])} from basis", "basis")
def camera_basis(spark, d):
    bounds = P.scene_bounds(P.scaled_track(P.bat_track(B.markers(spark, d))))
    cams = P.sample_cameras(P.sequence_cameras(_rigs(spark, d), B.cameras(spark, d)), SEED)
    return rounded(P.camera_basis(cams, bounds).select("sequence_id", "camera_id", "distance", *_vec))


@query("camera_cross_join", f"select {_PK} from proj", "proj")
def camera_cross_join(spark, d):
    return _projected(spark, d).select("sequence_id", "camera_id", "frame_idx")


_pcols = "head_u head_v head_depth tail_u tail_v tail_depth"


@query("project_points", f"select {_PK}, head_in_frame, tail_in_frame, {rs(_pcols)}, {r('sqrt((tail_u - head_u)**2 + (tail_v - head_v)**2)')} as bat_pixel_length, {r('frame_idx / 120e0')} as time_sec from proj", "proj")
def project_points(spark, d):
    return rounded(_projected(spark, d).select("sequence_id", "camera_id", "frame_idx", "head_in_frame", "tail_in_frame", *_pcols.split(), "bat_pixel_length", "time_sec"))


@query("filter_in_frame", f"select {_PK} from proj where head_in_frame and tail_in_frame", "proj")
def filter_in_frame(spark, d):
    return _projected(spark, d).filter(P.in_frame()).select("sequence_id", "camera_id", "frame_idx")


@query("mirror_pixel_rows", f"select {_PK}, mirror, camera_name, batter_hand, {rs('head_u tail_u')}, {r('tail_u - head_u')} as dx from projm", "projm")
def mirror_pixel_rows(spark, d):
    m = P.mirror_rows(_projected(spark, d))
    return rounded(m.select("sequence_id", "camera_id", "frame_idx", "mirror", "camera_name", "batter_hand", "head_u", "tail_u", F.col("tail_from_head_dx").alias("dx")))


_skrel = lambda m, n: " + ".join(f"({m}_{a} - b.eye_{a}) * b.{n}_{a}" for a in "xyz")
cte("skel0", "select s.sequence_id, camera_id, s.frame_idx, zoom, pan_x, pan_y, " + ", ".join(f"{_skrel(m, n)} as {m}_{v}" for m in BODY_MARKERS for n, v in (("right", "px"), ("up", "py"), ("fwd", "depth"))) + " from body s join basis b using (sequence_id) "
    "where " + " or ".join(f"{m}_x is not null" for m in BODY_MARKERS), "body", "basis")
cte("skel", "select sequence_id, camera_id, frame_idx, " + ", ".join(
    f"case when {m}_depth > 1e-6 then zoom * (35 / 36e0 * 1920) * {m}_px / {m}_depth + 1920 * (0.5 + pan_x) end as {m}_u, case when {m}_depth > 1e-6 then 1080 * (0.5 + pan_y) - zoom * (35 / 36e0 * 1920) * {m}_py / {m}_depth end as {m}_v, {m}_depth" for m in BODY_MARKERS) + " from skel0", "skel0")


@query("project_skeleton", f"select {_PK}, " + ", ".join(
    f"{r(f'{m}_u', 4)} as skel_{m}_u, {r(f'{m}_v', 4)} as skel_{m}_v, {r(f'{m}_depth', 4)} as skel_{m}_depth, coalesce({m}_u >= 0 and {m}_u < 1920 and {m}_v >= 0 and {m}_v < 1080, false) as skel_{m}_in_frame" for m in BODY_MARKERS) + " from skel", "skel")
def project_skeleton(spark, d):
    """All 26 body markers of every frame in every camera of its sequence."""
    track = P.scaled_track(P.bat_track(B.markers(spark, d)))
    cams = P.sample_cameras(P.sequence_cameras(_rigs(spark, d), B.cameras(spark, d)), SEED)
    s = P.skeleton(B.body_markers(spark, d), P.camera_basis(cams, P.scene_bounds(track)))
    return rounded_small(P.skeleton_columns(s), digits=4, limit=1e9)


#: A configured list of views: single values and ranges; two random ones come on top.
VIEWS = (
    {"name": "view_1B_side", "yaw": (80.0, 100.0), "pitch": 6.0, "zoom": (0.9, 1.1)},
    {"name": "view_front", "yaw": 0.0, "pan_x": (-0.1, 0.1), "pan_y": (-0.05, 0.05)},
    {"name": "high", "type": "fixed", "yaw": 200.0, "pitch": (20.0, 25.0), "roll": (-2.0, 2.0)})


def _view_sql() -> str:
    default = {"yaw": 0.0, "pitch": 8.0, "roll": 0.0, "zoom": 1.0, "pan_x": 0.0, "pan_y": 0.0}
    free = {"yaw": (0.0, 360.0), "pitch": (-12.0, 28.0), "roll": (-4.0, 4.0), "zoom": (0.7, 1.4), "pan_x": (-0.18, 0.18), "pan_y": (-0.14, 0.14)}
    rows = []
    for i, v in enumerate([*VIEWS, *[{"type": "random", "name": "random", **free}] * 2]):
        ends = [x for f in _f for x in ((v.get(f, default[f]),) * 2 if isinstance(v.get(f, default[f]), float) else v[f])]
        rows.append(f"('cam_{i:03d}', '{v.get('type', 'configured')}', '{v['name']}', " + ", ".join(f"{x}e0" for x in ends) + ")")
    return f"(values {', '.join(rows)}) v(camera_id, camera_type, camera_name, " + ", ".join(f"{f}_lo, {f}_hi" for f in _f) + ")"


@query("configured_views", "select sequence_id, camera_id, camera_type, camera_name, " + ", ".join(
    r(f"""{f}_lo + {U(f, "sequence_id || '|' || camera_id")} * ({f}_hi - {f}_lo)""") + f" as {f}" for f in _f) + f" from (select distinct sequence_id from mtrack), {_view_sql()}", "mtrack")
def configured_views(spark, d):
    """Every sequence with the configured views and two random ones, each field drawn in its range."""
    seqs = P.bat_track(B.markers(spark, d)).select("sequence_id").distinct()
    return rounded(P.sample_cameras(P.configured_views(seqs, VIEWS, random_views=2), SEED))


@query("project_tracks", f"select {_PK}, mirror, camera_name, {rs('head_u tail_u')} from projm where head_in_frame and tail_in_frame", "projm")
def project_tracks(spark, d):
    t = _projected(spark, d, keep_only_visible=True, horizontal_flip=True)
    return rounded(t.select("sequence_id", "camera_id", "frame_idx", "mirror", "camera_name", "head_u", "tail_u"))


# Some inputs can't be read: their bat markers have unknown names or their numbers are no numbers.
_unread = "case when cast(regexp_extract(sequence_id, '([0-9]+)$', 1) as int) % 11 = 3 then 'unknown marker names' when cast(regexp_extract(sequence_id, '([0-9]+)$', 1) as int) % 13 = 5 then 'broken numbers' end"
cte("folder_inputs", f"select source, split_part(source, '/', 1) as folder, {_unread} as problem from (select distinct source, sequence_id from markers)", "markers")
cte("folder_rows", "select folder, source, count(p.sequence_id) as rows, any_value(case when problem is null then null else problem end) as problem from folder_inputs i left join (select p.* from proj p join folder_inputs j using (source) where j.problem is null) p using (source) group by folder, source", "folder_inputs", "proj")


@query("sink_by_folder", "select folder, count(*) filter (rows > 0) as files, cast(sum(rows) as bigint) as rows, count(*) filter (rows = 0) as skipped, count(*) filter (problem = 'broken numbers') as broken, "
       "count(*) filter (rows = 0 and problem is null) as without_rows, cast(sum(rows) as bigint) as read_back from folder_rows group by folder", "folder_rows")
def sink_by_folder(spark, d):
    """CSV by folder of the readable inputs, the others in quarantine; counts from the sink, its files and its quarantine."""
    markers = B.markers(spark, d)
    inputs = markers.select(F.col("source").alias("source_c3d"), "sequence_id").distinct().withColumn("problem", F.expr(_unread))
    good = inputs.filter("problem is null").select("sequence_id")
    rows = materialised(_projected(spark, d).join(good, "sequence_id", "left_semi"))
    where = shared_folder(spark, "by-folder")
    counts = write_folders(rows, inputs, where)
    read = read_folders(spark, where, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    back = read.groupBy("folder").agg(F.count("sequence_id").alias("read_back"))
    bad = read_quarantine(spark, where).groupBy("folder").agg(
        F.count_if(F.col("problem") == "broken numbers").alias("broken"), F.count_if(F.col("problem") == "no rows").alias("without_rows"))
    out = counts.join(back, "folder", "left").join(bad, "folder", "left")
    return out.select("folder", "files", "rows", "skipped", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("broken", "without_rows", "read_back")])


# --- synthetic windows --------------------------------------------------------------

cte("syn_rows", "select sequence_id as swing_id, camera_id || case when mirror = 'none' then '' else '__' || mirror end as view_id, frame_idx, frame_idx / 120e0 as time_sec, camera_name, head_u, head_v, tail_u, tail_v from projm where batter_hand = 'R'", "projm")
cte("syn_step", "select *, row_number() over (partition by swing_id, view_id order by frame_idx) - 1 as rn, count(*) over (partition by swing_id, view_id) as n0 from syn_rows", "syn_rows")
cte("syn_gap", "select swing_id, view_id, count(*) as nt, median(g) filter (g > 0) as g from (select *, time_sec - lag(time_sec) over (partition by swing_id, view_id order by rn) as g from syn_step) group by all", "syn_step")
cte("syn_steps", "select swing_id, view_id, cast(case when nt >= 3 and g is not null then greatest(1, round_even((1 / g) / 60e0, 0)) else 6 end as int) as step from syn_gap", "syn_gap")
cte("syn_clean", "select swing_id, view_id, frame_idx, camera_name, head_u / 1920 as head_x, head_v / 1080 as head_y, tail_u / 1920 as tail_x, tail_v / 1080 as tail_y, row_number() over (partition by swing_id, view_id order by frame_idx) - 1 as pos, count(*) over (partition by swing_id, view_id) as n "
    "from syn_step join syn_steps using (swing_id, view_id) where rn % step = 0 and ceil(n0 / cast(step as double)) >= 31 and head_u is not null and tail_u is not null", "syn_step", "syn_steps")
cte("syn_starts", "select swing_id, view_id, unnest(list_concat(range(n - 31, -1, -5), case when (n - 31) % 5 <> 0 then [0] else [] end)) as win_start from (select distinct swing_id, view_id, n from syn_clean where n >= 31)", "syn_clean")
cte("syn_win", "select c.*, win_start, cast(pos - win_start as int) as idx from syn_clean c join syn_starts using (swing_id, view_id) where pos between win_start and win_start + 30", "syn_clean", "syn_starts")
_wk = "swing_id || '|' || view_id || '|' || win_start"
_rk = _wk + " || '|' || idx"
N = lambda purpose, key: f"(sqrt(-2 * ln({U(purpose + '.r', key)} + pow(2e0, -53))) * cos(6.283185307179586e0 * {U(purpose + '.a', key)}))"


def _tracks(spark, d, **kw):
    return A.clean_tracks(syn_source(spark, d), **kw)


def syn_source(spark, d):
    """Projected rows in the layout of stored tracks, both mirror copies."""
    m = P.mirror_rows(_projected(spark, d, part=A.FRAME_PART))
    return m.select(A.FRAME_PART, F.col("sequence_id").alias("swing_id"), S.view_key(F.lit(""), F.col("camera_id"), F.col("camera_name"), F.col("mirror")).alias("view_id"),
                    "frame_idx", "time_sec", "batter_hand", "camera_name", "head_u", "head_v", "tail_u", "tail_v")


cte("both_step", "select sequence_id as swing_id, camera_id || case when mirror = 'none' then '' else '__' || mirror end as view_id, frame_idx / 120e0 as time_sec, "
    "row_number() over (partition by sequence_id, camera_id, mirror order by frame_idx) - 1 as rn from projm", "projm")


@query("downsample_stride", "select swing_id, view_id, cast(case when nt >= 3 and g is not null then greatest(1, round_even((1 / g) / 60e0, 0)) else 6 end as int) as step from "
       "(select swing_id, view_id, count(*) as nt, median(g) filter (g > 0) as g from (select *, time_sec - lag(time_sec) over (partition by swing_id, view_id order by rn) as g from both_step) group by all)", "both_step")
def downsample_stride(spark, d):
    """Steps of all copies of all sequences, right-handed and left-handed."""
    from trackloom.operators.sequence import with_positions
    rows = materialised(syn_source(spark, d))
    numbered = with_positions(rows, ["swing_id", "view_id"], [F.floor(F.col("frame_idx") / 256)], [F.col("frame_idx")])
    return A.time_steps(numbered, ["swing_id", "view_id"], 60.0, 360.0)


@query("filter_usable_tracks", f"select swing_id, view_id, frame_idx, pos, n, {rs('head_x tail_y')} from syn_clean", "syn_clean")
def filter_usable_tracks(spark, d):
    return rounded(_tracks(spark, d).select("swing_id", "view_id", "frame_idx", "pos", "n", "head_x", "tail_y"))


@query("window_majority_label", "select swing_id, view_id, win_start, case when camera_name like '%1B%' then '1b_side' when camera_name like '%3B%' then '3b_side' when camera_name like '%front%' then 'front' else 'home_side' end as view_label from (select distinct swing_id, view_id, win_start, camera_name from syn_win)", "syn_win")
def window_majority_label(spark, d):
    return A.window_view_labels(A.clean_windows(_tracks(spark, d), WindowSettings()))


_WK = "swing_id, view_id, win_start"
cte("noisy", "select *, " + ", ".join(f"least(greatest({c} + {N(f'noise.{c}', _rk)} * (6e0 / {s}), 0), 1) as obs_{c}" for c, s in (("head_x", 1920), ("head_y", 1080), ("tail_x", 1920), ("tail_y", 1080))) + " from syn_win", "syn_win")


def _wins(spark, d):
    return A.clean_windows(_tracks(spark, d), WindowSettings())


@query("gaussian_corrupt", f"select {_WK}, idx, " + ", ".join(f"{r(f'obs_{c}')} as obs_{c}" for c in ("head_x", "head_y", "tail_x", "tail_y")) + " from noisy", "noisy")
def gaussian_corrupt(spark, d):
    return rounded(A.gaussian_corrupt(_wins(spark, d)).select("swing_id", "view_id", "win_start", "idx", "obs_head_x", "obs_head_y", "obs_tail_x", "obs_tail_y"))


_len = lambda b, l: f"least(cast(case when {U(b, _wk)} < 0.75 then 3 + floor({U(l, _wk)} * 8) when {U(b, _wk)} < 0.95 then 10 + floor({U(l, _wk)} * 11) else 20 + floor({U(l, _wk)} * 11) end as int), 31)"
_lab = lambda p: f"case when {U(p, _wk)} < 0.35 then 'partially_occluded' when {U(p, _wk)} < 0.8 then 'fully_occluded' else 'ignore' end"
cte("occ0", f"select {_WK}, case when f then {_len('occ.bucket', 'occ.len')} end as len1, case when f and s then {_len('occ2.bucket', 'occ2.len')} end as len2, f, f and s as second from (select distinct {_WK}, {U('occ.any', _wk)} < 0.8 as f, {U('occ.again', _wk)} < 0.1 as s from syn_win)", "syn_win")
cte("occ1", "select *, greatest(31 - len1, 1) as dd from occ0", "occ0")
cte("occ", f"select {_WK}, case when f then case when len1 = 31 then 0 else cast(least(floor((-(0.5e0 - 0.5e0 / dd) + sqrt((0.5e0 - 0.5e0 / dd)**2 + 2 * {U('occ.start', _wk)} * (32 - len1) / dd)) * dd), 31 - len1) as int) end end as start1, len1, case when f then {_lab('occ.label')} end as label1, "
    f"case when second then cast(floor({U('occ2.start', _wk)} * (32 - len2)) as int) end as start2, len2, case when second then {_lab('occ2.label')} end as label2 from occ1", "occ1")


@query("occlusion_blocks", f"select {_WK}, start1, len1, label1, start2, len2, label2 from occ", "occ")
def occlusion_blocks(spark, d):
    return A.occlusion_draws(_wins(spark, d).filter("idx = 0"))


cte("drawn", "select w.*, case when idx >= start2 and idx < start2 + len2 then label2 when idx >= start1 and idx < start1 + len1 then label1 else 'fully_visible' end as drawn_label from noisy w join occ using (swing_id, view_id, win_start)", "noisy", "occ")
cte("vis_lookup", "select distinct sequence_id as swing_id, frame_idx, case frame_idx % 3 when 0 then 'fully_visible' when 1 then 'partially_occluded' else 'ignore' end as visibility from mtrack where frame_idx % 10 < 9 and sequence_id like 'take_R%'", "mtrack")
cte("labelled", "select * exclude (found, visibility), case when found >= 0.8e0 * 31 then coalesce(visibility, 'fully_visible') else drawn_label end as label, found from (select d.*, visibility, count(visibility) over (partition by swing_id, view_id, win_start) as found from drawn d left join vis_lookup using (swing_id, frame_idx))", "drawn", "vis_lookup")


def _lookup(spark, d):
    t = P.bat_track(B.markers(spark, d)).filter("frame_idx % 10 < 9 and sequence_id like 'take_R%'")
    return t.selectExpr("sequence_id as swing_id", "frame_idx", "case frame_idx % 3 when 0 then 'fully_visible' when 1 then 'partially_occluded' else 'ignore' end as visibility").distinct()


@query("visibility_coverage_join", f"select {_WK}, idx, label, found from labelled", "labelled")
def visibility_coverage_join(spark, d):
    wins = A.clean_windows(A.with_real_labels(_tracks(spark, d), _lookup(spark, d)), WindowSettings())
    return A.gaussian_corrupt(A.visibility_labels(wins, None)).select("swing_id", "view_id", "win_start", "idx", "label", "found")


_lim = "case label when 'partially_occluded' then 0.5e0 when 'fully_occluded' then 0.35e0 else 0.95e0 end"
_cap = "case label when 'partially_occluded' then 0.4e0 when 'fully_occluded' then 0.25e0 else 0.1e0 end"
_ns = "case label when 'partially_occluded' then 4e0 when 'fully_occluded' then 12e0 else 24e0 end"


def _occluded(source: str, conf: str = "0.9e0", seen: str = "true") -> str:
    return (f"select *, case when masked then 0e0 when hidden then least({conf}, {_cap}) else {conf} end as tail_conf, {seen} and not masked as tail_seen, case label when 'partially_occluded' then 2e0 when 'fully_occluded' then 3e0 when 'ignore' then 4e0 else 0.75e0 end as tail_weight, "
            + ", ".join(f"case when hidden and not masked then least(greatest(obs_tail_{a} + {N(f'extra.{a}', _rk)} * ({_ns}) / {s}, 0), 1) else obs_tail_{a} end as pseudo_tail_{a}" for a, s in (("x", 1920), ("y", 1080)))
            + f" from (select *, label <> 'fully_visible' as hidden, label <> 'fully_visible' and (not {seen} or {U('mask', _rk)} < {_lim}) as masked from {source})")


cte("occluded", _occluded("(select * exclude (drawn_label), drawn_label as label from drawn)"), "drawn")


@query("apply_occlusion", f"select {_WK}, idx, label, tail_seen, tail_weight, {rs('tail_conf pseudo_tail_x pseudo_tail_y')}, case when label = 'ignore' then case when tail_seen then 'ignore_with_prediction' else 'ignore_no_prediction' end when tail_seen then 'matched' else 'missing_prediction' end as tail_status from occluded", "occluded")
def apply_occlusion(spark, d):
    out = A.apply_occlusion(A.visibility_labels(A.gaussian_corrupt(_wins(spark, d)), None))
    return rounded(out.select("swing_id", "view_id", "win_start", "idx", "label", "tail_seen", "tail_weight", "tail_conf", "pseudo_tail_x", "pseudo_tail_y", "tail_status"))


# --- pool of real error windows ---------------------------------------------------------

cte("pool_rows", "select *, row_number() over (partition by swing_id order by frame_idx) - 1 as pos, count(*) over (partition by swing_id) as n, "
    + ", ".join(f"coalesce({k}_pred_x is not null and {k}_pred_conf > 0 and {k}_gt_x is not null, false) as {k}_err_seen, ({k}_pred_x - {k}_gt_x) / 1920 as {k}_ex, ({k}_pred_y - {k}_gt_y) / 1080 as {k}_ey" for k in ("head", "tail")) + " from track", "track")
cte("pool_starts", "select swing_id, win_start, row_number() over (order by md5(swing_id || '|' || win_start), swing_id, win_start) - 1 as pool_id, count(*) over () as pool_size from (select swing_id, unnest(list_concat(range(n - 31, -1, -5), case when (n - 31) % 5 <> 0 then [0] else [] end)) as win_start from (select distinct swing_id, n from pool_rows where n >= 31))", "pool_rows")
cte("pool", "select p.*, pool_id, pool_size, win_start, cast(pos - win_start as int) as idx from pool_rows p join pool_starts using (swing_id) where pos between win_start and win_start + 30", "pool_rows", "pool_starts")


def _pool(spark, d):
    return A.error_windows(frame_positions(pooled_frames(B.track(spark, d))), WindowSettings())


@query("scan_error_windows", "select pool_id, idx, head_err_seen, tail_err_seen, " + ", ".join(f"{r(f'case when {k}_err_seen then {k}_ex end')} as {k}_err_x, {r(f'case when {k}_err_seen then {k}_pred_conf else 0e0 end')} as {k}_err_conf" for k in ("head", "tail")) + " from pool", "pool")
def scan_error_windows(spark, d):
    return rounded(_pool(spark, d).select("pool_id", "idx", "head_err_seen", "tail_err_seen", "head_err_x", "head_err_conf", "tail_err_x", "tail_err_conf"))


@query("sampler_summary", f"select tail_visibility, count(distinct pool_id) as windows, count(*) as frames, {r('avg(cast(head_err_seen as int))')} as head_valid_rate, {r('avg(cast(tail_err_seen as int))')} as tail_valid_rate from pool group by tail_visibility", "pool")
def sampler_summary(spark, d):
    p = _pool(spark, d)
    per_win = p.groupBy("tail_visibility", "pool_id").agg(F.count(F.lit(1)).alias("c"), F.count_if("head_err_seen").alias("h"), F.count_if("tail_err_seen").alias("t"))
    return per_win.groupBy("tail_visibility").agg(F.count(F.lit(1)).alias("windows"), F.sum("c").alias("frames"), R(F.sum("h") / F.sum("c")).alias("head_valid_rate"), R(F.sum("t") / F.sum("c")).alias("tail_valid_rate"))


cte("replay", "select w.swing_id, w.view_id, w.win_start, w.idx, w.head_x, w.tail_x, p.head_err_seen, p.tail_err_seen, p.head_ex, p.tail_ex, p.tail_pred_conf, d.pool_id from (select *, cast(floor(" + U("pool", _wk) + " * (select max(pool_size) from pool_starts)) as bigint) as pool_id from syn_win) d "
    "join pool p on p.pool_id = d.pool_id and p.idx = d.idx join syn_win w on w.swing_id = d.swing_id and w.view_id = d.view_id and w.win_start = d.win_start and w.idx = d.idx", "syn_win", "pool", "pool_starts")


@query("replay_corrupt", f"select {_WK}, idx, head_err_seen as obs_head_seen, tail_err_seen as obs_tail_seen, {r('case when head_err_seen then least(greatest(head_x + head_ex, 0), 1) end')} as obs_head_x, {r('case when tail_err_seen then least(greatest(tail_x + tail_ex, 0), 1) end')} as obs_tail_x, {r('case when tail_err_seen then tail_pred_conf else 0e0 end')} as obs_tail_conf from replay", "replay")
def replay_corrupt(spark, d):
    out = A.replay_corrupt(_wins(spark, d), _pool(spark, d))
    return rounded(out.select("swing_id", "view_id", "win_start", "idx", "obs_head_seen", "obs_tail_seen", "obs_head_x", "obs_tail_x", "obs_tail_conf"))


@query("sample_pool_join", f"select {_WK}, idx, pool_id from replay", "replay")
def sample_pool_join(spark, d):
    return A.draw_pool(_wins(spark, d), _pool(spark, d)).select("swing_id", "view_id", "win_start", "idx", "pool_id")


@query("synthetic_windows", f"select split, count(*) as windows, cast(sum(seen) as bigint) as tail_seen_rows, {r('sum(w)', 4)} as weight, cast(sum(ign) as bigint) as ignore_rows from (select swing_id, view_id, win_start, sum(cast(tail_seen as int)) as seen, sum(tail_weight) as w, sum(cast(label = 'ignore' as int)) as ign from ({_occluded('labelled')}) group by all) join syn_split using (swing_id) group by split", "labelled", "syn_split")
def build_synthetic(spark, d):
    s = _synthetic(spark, d)
    n = lambda c: F.aggregate(F.transform(c, lambda v: v.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("windows"), F.sum(n("tail_seen")).cast("bigint").alias("tail_seen_rows"), R(F.sum(n("tail_weight")), 4).alias("weight"),
                                  F.sum(F.size(F.filter("label", lambda x: x == "ignore"))).alias("ignore_rows"))


def _synthetic(spark, d, **kw):
    from trackloom.operators.contracts import entity_split
    ids = B.markers(spark, d).select(F.col("sequence_id").alias("swing_id"))
    return synthetic_windows(syn_source(spark, d), entity_split(ids, 0.8, 0.1, SEED), lookup=_lookup(spark, d), **kw)


@query("dataset_summary", "select split, count(distinct swing_id || view_id) as groups, count(*) as samples, 25 as input_dim from (select distinct swing_id, view_id, win_start from syn_win) join syn_split using (swing_id) group by split", "syn_win", "syn_split")
def dataset_summary(spark, d):
    from trackloom.plans.synthetic import summary
    return summary(_synthetic(spark, d))


cte("sharded", "select split, (pos - 1) // 100 as shard, (pos - 1) % 100 as place, k from (select split, k, row_number() over (partition by split order by md5('7|' || k), swing_id, view_id, win_start) as pos from "
    "(select distinct swing_id, view_id, win_start, swing_id || '|' || view_id || '|' || win_start as k from syn_win) join syn_split using (swing_id))", "syn_win", "syn_split")


@query("sink_dataset_shards", "select split, cast(shard as bigint) as shard, count(*) as samples, cast(min(place) as bigint) as first_place, cast(max(place) as bigint) as last_place, count(*) * 31 as rows, "
       "arg_min(k, place) as first_key, arg_max(k, place) as last_key from sharded group by all", "sharded")
def sink_dataset_shards(spark, d):
    """The built dataset in shards of exactly 100 samples; the manifest beside what the files hold."""
    where = shared_folder(spark, "shards")
    manifest = write_exact_shards(_synthetic(spark, d, shard_size=100, shard_seed=SEED), where, shard_size=100, order=["swing_id", "view_id", "win_start"], seed=SEED)
    key = F.concat_ws("|", "swing_id", "view_id", "win_start")
    held = read_shards(spark, where).groupBy("split", F.col("shard").cast("bigint").alias("shard")).agg(
        F.sum(F.size("x")).cast("bigint").alias("rows"), F.min_by(key, "place").alias("first_key"), F.max_by(key, "place").alias("last_key"))
    return manifest.drop("path").join(held, ["split", "shard"], "full")


@query("scan_projected_tracks", f"select swing_id, view_id, frame_idx, split, {rs('head_u tail_v')} from (select sequence_id as swing_id, camera_id || case when mirror = 'none' then '' else '__' || mirror end as view_id, frame_idx, head_u, tail_v from projm) join syn_split using (swing_id)", "projm", "syn_split")
def scan_projected_tracks(spark, d):
    from trackloom.operators.contracts import entity_split
    from trackloom.sources.readers import projected_rows
    text = P.mirror_rows(_projected(spark, d)).select("sequence_id", "camera_id", "camera_name", "mirror", "batter_hand", *[F.col(c).cast("string").alias(c) for c in ("frame_idx", "time_sec", "head_u", "head_v", "tail_u", "tail_v")])
    ids = B.markers(spark, d).select(F.col("sequence_id").alias("swing_id"))
    rows = projected_rows(text).join(entity_split(ids, 0.8, 0.1, SEED), "swing_id")
    return rounded(rows.select("swing_id", "view_id", F.col("frame_idx").cast("int").alias("frame_idx"), "split", "head_u", "tail_v"))


# --- samples row by row, and a build that replays a weighted pool ---------------------------

_status = "case when label = 'ignore' then case when tail_seen then 'ignore_with_prediction' else 'ignore_no_prediction' end when tail_seen then 'matched' else 'missing_prediction' end"
_view = "case when camera_name like '%1B%' then '1b_side' when camera_name like '%3B%' then '3b_side' when camera_name like '%front%' then 'front' else 'home_side' end"


def _observed(source: str, head_seen: str, head_conf: str) -> str:
    """Corrupted windows as the windows that features are made of."""
    head = f"({head_seen} and obs_head_x is not null and obs_head_y is not null and {head_conf} > 0)"
    tail = "(tail_seen and pseudo_tail_x is not null and pseudo_tail_y is not null and tail_conf > 0)"
    return (f"select swing_id || '|' || view_id as swing_id, swing_id as sid, view_id as vid, win_start, cast(idx as bigint) as pos, idx, frame_idx, {_view} as view_label, label, tail_weight, {_status} as tail_status, "
            f"head_x as target_head_x, head_y as target_head_y, tail_x as target_tail_x, tail_y as target_tail_y, {head} as head_ok, {tail} as tail_ok, obs_head_x as head_x, obs_head_y as head_y, "
            f"pseudo_tail_x as tail_x, pseudo_tail_y as tail_y, case when {head} then {head_conf} else 0e0 end as head_c, case when {tail} then tail_conf else 0e0 end as tail_c from {source}")


def _sample_rows(last: str) -> str:
    frames = "min(frame_idx) over (partition by f.swing_id, win_start) as start_frame_idx, max(frame_idx) over (partition by f.swing_id, win_start) as end_frame_idx"
    return (f"select split, f.sid as swing_id, f.vid as view_id, win_start, {frames}, idx, label, {r('tail_weight')} as tail_weight, tail_status, tail_ok as tail_seen, "
            + rs([f"target_{k}_{a}" for k in ("head", "tail") for a in "xy"]) + f", {X.feature_columns()} from {last} f join syn_split s on s.swing_id = f.sid")


cte("syn_done", _occluded("labelled"), "labelled")
cte("syn_obs", _observed("syn_done", "true", "0.95e0"), "syn_done")


@query("synthetic_rows", _sample_rows(X.features_over("syn_", "syn_obs")), "syn_features0", "syn_split")
def synthetic_rows(spark, d):
    return rounded(sample_rows(_synthetic(spark, d)))


#: Windows that show an occluded tail are replayed more often, those that begin without a usable tail never.
POOL_WEIGHTS = {"fully_visible": "1.5", "partially_occluded": "0.333", "fully_occluded": "4", "ignore": "0"}
_weight_sql = "case tail_visibility " + " ".join(f"when '{v}' then {w}e0" for v, w in POOL_WEIGHTS.items()) + " end"
cte("pool_ranges", f"select pool_id, hi - units as lo, hi from (select *, sum(units) over (order by pool_id) as hi from (select pool_id, cast(round_even(({_weight_sql}) * 1000000, 0) as bigint) as units from pool where idx = 0)) where units > 0", "pool")
cte("pool_draws", "select swing_id, view_id, win_start, pool_id from (select swing_id, view_id, win_start, cast(floor(" + U("pool", _wk) + " * (select max(hi) from pool_ranges)) as bigint) as spot from syn_win where idx = 0) join pool_ranges on spot >= lo and spot < hi", "syn_win", "pool_ranges")
cte("pool_noisy", "select w.*, d.pool_id, p.head_err_seen as obs_head_seen, p.tail_err_seen as obs_tail_seen, "
    + ", ".join(f"case when p.{k}_err_seen then p.{k}_pred_conf else 0e0 end as obs_{k}_conf, " + ", ".join(f"case when p.{k}_err_seen then least(greatest(w.{k}_{a} + p.{k}_e{a}, 0), 1) end as obs_{k}_{a}" for a in "xy") for k in ("head", "tail"))
    + " from syn_win w join pool_draws d using (swing_id, view_id, win_start) join pool p on p.pool_id = d.pool_id and p.idx = w.idx", "syn_win", "pool_draws", "pool")
cte("pool_labelled", "select w.*, case when idx >= start2 and idx < start2 + len2 then label2 when idx >= start1 and idx < start1 + len1 then label1 else 'fully_visible' end as label from pool_noisy w join occ using (swing_id, view_id, win_start)", "pool_noisy", "occ")
cte("pool_done", _occluded("pool_labelled", "obs_tail_conf", "obs_tail_seen"), "pool_labelled")
cte("pool_obs", _observed("pool_done", "obs_head_seen", "obs_head_conf"), "pool_done")


def _pool_weight():
    w = F.lit(None).cast("double")
    for v, x in POOL_WEIGHTS.items():
        w = F.when(F.col("tail_visibility") == v, float(x)).otherwise(w)
    return w


@query("weighted_pool_draw", f"select {_WK}, pool_id from pool_draws", "pool_draws")
def weighted_pool_draw(spark, d):
    keys = A.clean_windows(_tracks(spark, d), WindowSettings()).filter("idx = 0").select("swing_id", "view_id", "win_start")
    return A.draw_weighted(keys, _pool(spark, d), _pool_weight())


@query("pluggable_sampler", _sample_rows(X.features_over("pool_", "pool_obs")), "pool_features0", "syn_split")
def pluggable_sampler(spark, d):
    """The dataset build with windows of real errors, drawn from a weighted pool, in place of noise."""
    from trackloom.operators.contracts import entity_split
    ids = B.markers(spark, d).select(F.col("sequence_id").alias("swing_id"))
    return rounded(sample_rows(synthetic_windows(syn_source(spark, d), entity_split(ids, 0.8, 0.1, SEED), sampler=pool_sampler(_pool(spark, d), _pool_weight()))))
