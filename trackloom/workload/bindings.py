"""Given tables mapped to domain tables: as DataFrames, and as SQL text for checking.

Frames of a sequence are a user's events in time order; candidates are the line
items of an order; flow fields are embedding vectors; cameras are nations.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators.sequence import with_positions
from trackloom.schemas import BODY_MARKERS, DETECTION_TYPE
from trackloom.session import tasks_for_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- track: one row per frame -------------------------------------------------

_TRACK_BASE = {
    "swing_id": "concat('swing_', cast(user_id as string))",
    "view": "case user_id % 6 when 0 then 'side' when 1 then 'back' when 2 then 'front' "
            "when 3 then 'Home plate' when 4 then '1B_side' else '' end",
    "batter_side": "case when user_id % 2 = 0 then 'right' else 'Left' end",
    "ax": "200 + 3 * value",
    "ay": "100 + 8 * k",
    "zx": "260 + 3 * value + event_id % 50",
    "zy": "140 + 8 * k + event_id % 30",
}
_TRACK_COLUMNS = {
    "head_pred_x": "case when event_id % 11 <> 0 then ax end",
    "head_pred_y": "case when event_id % 11 <> 0 then ay end",
    "head_pred_conf": "(event_id % 97) / 97e0",
    "tail_pred_x": "case when event_type <> 'error' then zx end",
    "tail_pred_y": "case when event_type <> 'error' then zy end",
    "tail_pred_conf": "(event_id % 89) / 89e0",
    "head_gt_x": "case when event_id % 23 <> 0 then ax + event_id % 13 - 6 end",
    "head_gt_y": "case when event_id % 23 <> 0 then ay + event_id % 17 - 8 end",
    "tail_gt_x": "case when event_id % 19 <> 0 then zx + (event_id % 29 - 14) * (1 + event_id % 2) end",
    "tail_gt_y": "case when event_id % 19 <> 0 then zy + event_id % 7 - 3 end",
    "head_visibility": "case when event_id % 5 = 0 then 'partially_occluded' else 'fully_visible' end",
    "tail_visibility": "case when event_type in ('view', 'purchase') then 'fully_visible' "
                       "when event_type = 'click' then 'partially_occluded' "
                       "when event_type = 'error' and event_id % 3 = 0 then 'ignore' "
                       "else 'fully_occluded' end",
    "bbox_conf": "(event_id % 83) / 83e0",
    "bbox_x1": "case when event_id % 31 <> 0 then ax - 20e0 end",
    "bbox_y1": "case when event_id % 31 <> 0 then ay - 20e0 end",
    "bbox_x2": "case when event_id % 31 <> 0 then zx + 20e0 end",
    "bbox_y2": "case when event_id % 31 <> 0 then zy + 20e0 end",
}


def frame_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions for steps over the frames of ``track``; the count reads file footers only."""
    return tasks_for_rows(spark, table(spark, sf_dir, "events").count())


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with predictions and annotations; hot users are split by the hour."""
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id", "event_type", "value",
        "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k")
    base = events.selectExpr("event_id", "ts", "event_type", *[f"{e} as {n}" for n, e in _TRACK_BASE.items()])
    numbered = with_positions(
        base, ["swing_id"], [F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)],
        [F.col("ts"), F.col("event_id")], pos="rn", total=None, tasks=frame_tasks(spark, sf_dir))
    frame = S.padded((F.col("rn") + 1).cast("string"), 6)
    return numbered.select(
        F.concat_ws("_", "swing_id", frame).alias("image_stem"), "swing_id", "view", "batter_side",
        F.concat(frame, F.lit(".jpg")).alias("frame"), (F.col("rn") + 1).cast("int").alias("frame_idx"),
        *[F.expr(e).cast("double" if n.split("_")[-1] in ("x", "y", "conf", "x1", "x2", "y1", "y2") else "string").alias(n)
          for n, e in _TRACK_COLUMNS.items()],
        (1 + F.col("event_id") % 3).cast("int").alias("detection_rank"), "event_id")


def _sql_cols(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in cols.items())


CTE: dict[str, tuple[str, tuple[str, ...]]] = {}
"""name -> (select text, names it needs); see ``with_ctes``."""


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (body, needs)


def with_ctes(body: str, *needs: str) -> str:
    """Prefix ``body`` with the WITH list it needs, dependencies first."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for n in CTE[name][1]:
            visit(n)
        done.append(name)

    for n in needs:
        visit(n)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][0]})" for n in done) + "\n" + body


def cte_again(prefix: str, names: tuple[str, ...], swap: dict[str, str]) -> str:
    """Repeat the steps ``names`` over other tables: ``swap`` has the new name of each table that changes. Returns the last step's name."""
    swap = dict(swap)
    for name in names:
        body, needs = CTE[name]
        for old in needs:
            body = re.sub(rf"\b(from|join) {old}\b", rf"\1 {swap.get(old, old)}", body)
        cte(prefix + name, body, *[swap.get(n, n) for n in needs])
        swap[name] = prefix + name
    return swap[names[-1]]


_D = ("x", "y", "conf", "x1", "x2", "y1", "y2")
cte("track_base", "select event_id, ts, event_type, " + _sql_cols(_TRACK_BASE) +
    ", row_number() over (partition by user_id order by ts, event_id) as rn from "
    "(select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events)")
cte("track",
    "select swing_id || '_' || lpad(cast(rn as varchar), cast(greatest(6, length(cast(rn as varchar))) as int), '0') as image_stem, swing_id, view, batter_side, "
    "lpad(cast(rn as varchar), cast(greatest(6, length(cast(rn as varchar))) as int), '0') || '.jpg' as frame, cast(rn as int) as frame_idx, "
    + ", ".join(f"cast({e} as {'double' if n.split('_')[-1] in _D else 'varchar'}) as {n}"
                for n, e in _TRACK_COLUMNS.items())
    + ", cast(1 + event_id % 3 as int) as detection_rank, event_id from track_base", "track_base")


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows (frame, keypoint) in the 22-column layout."""
    from trackloom.schemas import DETAIL_COLUMNS
    t = track(spark, sf_dir)
    both = []
    for k in ("head", "tail"):
        dx = F.col(f"{k}_pred_x") - F.col(f"{k}_gt_x")
        dy = F.col(f"{k}_pred_y") - F.col(f"{k}_gt_y")
        both.append(F.struct(
            F.lit(k).alias("keypoint"), F.col(f"{k}_visibility").alias("visibility"),
            F.col(f"{k}_gt_x").alias("gt_x"), F.col(f"{k}_gt_y").alias("gt_y"),
            F.col(f"{k}_pred_x").alias("pred_x"), F.col(f"{k}_pred_y").alias("pred_y"),
            F.col(f"{k}_pred_conf").alias("pred_conf"), dx.alias("dx"), dy.alias("dy"),
            F.hypot(dx, dy).alias("error_px"),
            S.status_from_visibility(F.col(f"{k}_visibility"), F.col(f"{k}_pred_x").isNotNull()).alias("status")))
    keep = ["image_stem", "swing_id", "view", "batter_side", "frame", "bbox_conf", "detection_rank",
            "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]
    return t.select(*keep, F.inline(F.array(*both))).select(*DETAIL_COLUMNS)


def _details_sql(k: str) -> str:
    return (
        f"select image_stem, swing_id, view, batter_side, frame, '{k}' as keypoint, {k}_visibility as visibility, "
        f"{k}_gt_x as gt_x, {k}_gt_y as gt_y, {k}_pred_x as pred_x, {k}_pred_y as pred_y, {k}_pred_conf as pred_conf, "
        f"bbox_conf, detection_rank, bbox_x1, bbox_y1, bbox_x2, bbox_y2, {k}_pred_x - {k}_gt_x as dx, "
        f"{k}_pred_y - {k}_gt_y as dy, sqrt(({k}_pred_x - {k}_gt_x)**2 + ({k}_pred_y - {k}_gt_y)**2) as error_px, "
        f"case when {k}_visibility = 'ignore' then case when {k}_pred_x is not null then 'ignore_with_prediction' else 'ignore_no_prediction' end "
        f"when {k}_pred_x is not null then 'matched' else 'missing_prediction' end as status from track")


cte("details", _details_sql("head") + " union all " + _details_sql("tail"), "track")

# --- clips: small sequence dimension ------------------------------------------

_CLIP = {
    "name": "concat('swing_', cast(c_custkey as string))",
    "view": "case c_mktsegment when 'BUILDING' then ' side ' when 'AUTOMOBILE' then 'back' "
            "when 'MACHINERY' then 'Front cam' when 'HOUSEHOLD' then 'third base' else '' end",
    "batter_side": "case c_nationkey % 3 when 0 then ' left' when 1 then 'R' else '' end",
}


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {n}" for n, e in _CLIP.items()], "c_custkey as line_no")


cte("clips", "select " + _sql_cols(_CLIP).replace("as string", "as varchar") + ", c_custkey as line_no from customer")

# --- candidates: frames with a detection list ----------------------------------

_NUM = {
    "bbox_conf": "l_quantity / 50e0",
    "hx": "(l_partkey % 1000) / 1000e0",
    "hy": "((l_suppkey * 37) % 1000) / 1000e0",
    "tx": "(l_partkey % 1000) / 1000e0 + (cast(floor(l_extendedprice) as bigint) % 200 - 100) / 1000e0",
    "ty": "((l_suppkey * 37) % 1000) / 1000e0 + (cast(floor(l_extendedprice) as bigint) % 150 - 50) / 1000e0",
    "hc": "round(l_discount * 100) / 10e0",
    "tc": "round(l_tax * 100) / 10e0",
}
_RECORD = {
    "swing_id": "concat('swing_', cast(o_custkey as string))",
    "frame_no": "case when o_orderkey % 29 <> 0 then cast(datediff('day', timestamp '1995-01-01 00:00:00', o_orderdate) as int) end",
    "frame_name": "lpad(cast(o_orderkey as string), cast(greatest(9, length(cast(o_orderkey as string))) as int), '0')",
}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate records: exactly the six inference columns."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{e} as {n}" for n, e in _NUM.items()])
    found = F.struct(
        (-F.col("bbox_conf")).alias("nc"), "hx", "hy", "tx", "ty", "hc", "tc", "l_linenumber")
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(found)).alias("d"))
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", *[f"{e} as {n}".replace("datediff('day', timestamp '1995-01-01 00:00:00', o_orderdate)",
                                             "datediff(o_orderdate, date '1995-01-01')") for n, e in _RECORD.items()])
    joined = o.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")

    def detection(d, i):
        w, h = F.abs(d["hx"] - d["tx"]) + 0.02, F.abs(d["hy"] - d["ty"]) + 0.02
        return F.struct(
            (i + 1).cast("int").alias("detection_rank"), (-d["nc"]).alias("bbox_conf"),
            F.struct(((d["hx"] + d["tx"]) / 2).alias("xc"), ((d["hy"] + d["ty"]) / 2).alias("yc"), w.alias("w"), h.alias("h")).alias("bbox"),
            F.struct(d["hx"].alias("x"), d["hy"].alias("y"), d["hc"].alias("conf")).alias("head"),
            F.struct(d["tx"].alias("x"), d["ty"].alias("y"), d["tc"].alias("conf")).alias("tail"))

    stem = F.concat_ws("_", "swing_id", "frame_name")
    return joined.select(
        stem.alias("prediction_stem"), stem.alias("image_stem"), "swing_id", "frame_no", "frame_name",
        F.coalesce(F.transform("d", detection), F.array().cast(f"array<{DETECTION_TYPE.simpleString()}>")).alias("detections"))


_R = {k: v.replace("as string", "as varchar") for k, v in _RECORD.items()}
cte("candidates",
    "select l_orderkey, row_number() over (partition by l_orderkey order by -bbox_conf, hx, hy, tx, ty, hc, tc, l_linenumber) as rank, "
    "bbox_conf as conf, hc, tc, hx * 1920 as hx, hy * 1080 as hy, tx * 1920 as tx, ty * 1080 as ty, "
    "(hx + tx) / 2 * 1920 as cx, (hy + ty) / 2 * 1080 as cy, abs(hx - tx) + 0.02e0 as bw, abs(hy - ty) + 0.02e0 as bh "
    "from (select l_orderkey, l_linenumber, " + _sql_cols(_NUM) + " from lineitem)")
cte("records", "select o_orderkey, " + _sql_cols(_R) + ", concat('swing_', cast(o_custkey as varchar), '_', lpad(cast(o_orderkey as varchar), cast(greatest(9, length(cast(o_orderkey as varchar))) as int), '0')) as image_stem from orders")

# --- annotations for the candidate frames ---------------------------------------

_GT = {
    "swing_id": "concat('swing_', cast(o_custkey as string))",
    # A seventh of the annotations belong to frames that no record has.
    "frame": "concat(case when o_orderkey % 7 = 0 then 'unlinked_' else '' end, lpad(cast(o_orderkey as string), cast(greatest(9, length(cast(o_orderkey as string))) as int), '0'), '.png')",
    "head_visibility": "case when o_orderkey % 4 = 0 then 'partially_occluded' else 'fully_visible' end",
    "tail_visibility": "case o_orderpriority when '1-URGENT' then 'fully_visible' when '2-HIGH' then 'partially_occluded' "
                       "when '5-LOW' then 'ignore' else 'fully_occluded' end",
    "head_x": "case when o_orderkey % 13 <> 0 then cast((o_custkey * 37 + o_orderkey * 11) % 1920 as double) end",
    "head_y": "case when o_orderkey % 13 <> 0 then cast((o_custkey * 17 + o_orderkey * 7) % 1080 as double) end",
    "tail_x": "case when o_orderkey % 17 <> 0 then cast((o_custkey * 37 + o_orderkey * 11) % 1920 + 50 as double) end",
    "tail_y": "case when o_orderkey % 17 <> 0 then cast((o_custkey * 17 + o_orderkey * 7) % 1080 + 30 as double) end",
    "bat_visible_aux_x": "case when o_orderkey % 2 = 0 then cast(o_orderkey % 1900 as double) end",
    "bat_visible_aux_y": "case when o_orderkey % 2 = 0 then cast(o_orderkey % 1000 as double) end",
}


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {n}" for n, e in _GT.items()])


cte("annotations", "select " + _sql_cols({k: v.replace("as string", "as varchar") for k, v in _GT.items()})
    + " from orders")

# --- flow fields -------------------------------------------------------------------

_FLOW = {
    "swing_id": "concat('swing_', cast(vec_id % 50 as string))",
    "frame_idx": "cast(2 + floor(vec_id / 50e0) as int)",
}


def flow_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 fields, row-major arrays fx and fy, for the step frame_idx-1 -> frame_idx."""
    e = table(spark, sf_dir, "embeddings").selectExpr(*[f"{x} as {n}" for n, x in _FLOW.items()], "embedding")
    return e.select(
        "swing_id", (F.col("frame_idx") - 1).alias("prev_frame_idx"), "frame_idx",
        F.concat(F.lit("flow/"), "swing_id", F.lit("/"), S.padded((F.col("frame_idx") - 1).cast("string"), 6),
                 F.lit("_to_"), S.padded(F.col("frame_idx").cast("string"), 6), F.lit(".npy")).alias("flow_file"),
        F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.transform("embedding", lambda v: v.cast("double") * 10).alias("fx"),
        F.transform(F.reverse("embedding"), lambda v: v.cast("double") * 10).alias("fy"))


#: Rows and columns of the tiles of the 8 x 8 fields, and the pixels that are held in one row: both ways of every statistic are used.
FLOW_TILE, FLOW_ROW_PIXELS = (3, 5), 16


def flow_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.operators.flow import field_tiles
    return field_tiles(flow_fields(spark, sf_dir), *FLOW_TILE)


cte("flow_fields", "select " + _sql_cols(_FLOW).replace("as string", "as varchar") + ", "
    "list_transform(embedding, lambda v: cast(v as double) * 10) as fx, "
    "list_transform(list_reverse(embedding), lambda v: cast(v as double) * 10) as fy from embeddings")
cte("flow_cat", "select *, frame_idx - 1 as prev_frame_idx, 'flow/' || swing_id || '/' || lpad(cast(frame_idx - 1 as varchar), cast(greatest(6, length(cast(frame_idx - 1 as varchar))) as int), '0') || '_to_' || "
    "lpad(cast(frame_idx as varchar), cast(greatest(6, length(cast(frame_idx as varchar))) as int), '0') || '.npy' as flow_file from flow_fields", "flow_fields")
cte("flow_pixels", "select swing_id, frame_idx, unnest(range(64)) as i, unnest(fx) as fx, unnest(fy) as fy from flow_fields", "flow_fields")

# --- markers and cameras ---------------------------------------------------------------

_MARKER = {
    "Marker1": ("3 * value + event_id % 40", "10 * k", "900 + event_id % 70"),
    "MARKER2": ("3 * value + event_id % 40 + 500", "10 * k + 120", "1000 + event_id % 90"),
    "marker3": ("3 * value + event_id % 40 + 520", "10 * k + 140", "1020 + event_id % 90"),
    "LSHO": ("3 * value - 200", "10 * k - 100", "1400 + event_id % 11"),
    "RSHO": ("3 * value - 200", "10 * k + 250", "1410 + event_id % 13"),
    "C7": ("3 * value - 260", "10 * k + 60", "1450 + event_id % 17"),
}


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long marker rows in millimetres; a few markers are missing."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "value", "ts", "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k")
    e = with_positions(e.withColumn("sequence_id", F.expr("concat('take_', case when user_id % 2 = 0 then 'R' else 'L' end, '_', cast(user_id as string))")),
                       ["sequence_id"], [F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)],
                       [F.col("ts"), F.col("event_id")], pos="frame_idx", total=None)
    points = F.array(*[
        F.struct(F.lit(m).alias("marker"),
                 *[F.expr(f"case when event_id % 41 <> {i} then cast({x} as double) end").alias(n) for n, x in zip("xyz", xyz)])
        for i, (m, xyz) in enumerate(_MARKER.items())])
    return e.select(
        F.concat(F.lit("set"), (F.col("user_id") % 4).cast("string"), F.lit("/"), "sequence_id", F.lit(".c3d")).alias("source"),
        "sequence_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.lit(120.0).alias("fps"), F.inline(points))


cte("marker_base", "select event_id, user_id, value, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k, "
    "'take_' || case when user_id % 2 = 0 then 'R' else 'L' end || '_' || user_id as sequence_id, "
    "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame_idx from events")
cte("markers", " union all ".join(
    f"select 'set' || (user_id % 4) || '/' || sequence_id || '.c3d' as source, sequence_id, frame_idx, '{m}' as marker, "
    + ", ".join(f"case when event_id % 41 <> {i} then cast({x} as double) end as {n}" for n, x in zip("xyz", xyz))
    + " from marker_base" for i, (m, xyz) in enumerate(_MARKER.items())), "marker_base")

def _body_point(i: int) -> tuple[str, str, str]:
    """Marker i of the body: beside the bat, each with an offset of its own."""
    return f"3 * value - {200 + 7 * i}", f"10 * k + {13 * i - 100}", f"{1400 - 9 * i} + event_id % {11 + i}"


def body_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows of all body markers in metres; each is missing in some frames, one in every frame of left-handed takes."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "value", "ts", "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k")
    e = with_positions(e.withColumn("sequence_id", F.expr("concat('take_', case when user_id % 2 = 0 then 'R' else 'L' end, '_', cast(user_id as string))")),
                       ["sequence_id"], [F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)],
                       [F.col("ts"), F.col("event_id")], pos="frame_idx", total=None)
    points = F.array(*[
        F.struct(F.lit(m).alias("marker"), *[F.expr(f"case when {_body_seen(i)} then cast({x} as double) * 0.001 end").alias(n) for n, x in zip("xyz", _body_point(i))])
        for i, m in enumerate(BODY_MARKERS)])
    return e.select("sequence_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.inline(points))


def _body_seen(i: int) -> str:
    return f"event_id % 37 <> {i}" + (" and user_id % 2 = 0" if i == len(BODY_MARKERS) - 1 else "")


cte("body", "select sequence_id, frame_idx, " + ", ".join(
    f"case when {_body_seen(i)} then cast({x} as double) * 0.001e0 end as {m}_{n}" for i, m in enumerate(BODY_MARKERS) for n, x in zip("xyz", _body_point(i)))
    + " from marker_base", "marker_base")

_CAMERA = {
    "rig": "n_regionkey",
    "camera_id": "concat('cam_', lpad(cast(n_nationkey as string), cast(greatest(3, length(cast(n_nationkey as string))) as int), '0'))",
    "camera_type": "'configured'",
    "camera_name": "case n_nationkey % 4 when 0 then 'view_1B_side' when 1 then 'view_front' when 2 then 'view_3B_side' else 'view_home' end",
    "yaw_lo": "14.4e0 * n_nationkey", "yaw_hi": "14.4e0 * n_nationkey + 5",
    "pitch_lo": "3e0 * n_regionkey", "pitch_hi": "3e0 * n_regionkey + 4",
    "roll_lo": "-1e0", "roll_hi": "1e0", "zoom_lo": "0.95e0", "zoom_hi": "1.05e0",
    "pan_x_lo": "-0.04e0", "pan_x_hi": "0.04e0", "pan_y_lo": "0e0", "pan_y_hi": "0e0",
}


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(*[f"{e} as {n}" for n, e in _CAMERA.items()])


cte("cameras", "select " + _sql_cols(_CAMERA).replace("as string", "as varchar") + " from nation")


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per frame: detector lines built from line items, plus a prose line."""
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "concat_ws(' ', '0', cast(l_partkey % 1000 / 1000e0 as string), cast(l_suppkey % 100 / 100e0 as string), '0.25', '0.5', "
        "cast(l_discount as string), cast(l_tax as string), '0.75', '0.125', '0.5', "
        "case when l_linenumber = 4 then 'oops' else '0.625' end, cast(l_quantity as string)) as full_line",
        "l_extendedprice")
    line = F.when(F.col("l_linenumber") == 3, F.substring_index("full_line", " ", 11)).when(
        F.col("l_linenumber") == 5, F.substring_index("full_line", " ", 8)).otherwise(F.col("full_line"))
    lists = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(
        F.struct("l_linenumber", "l_extendedprice", line.alias("line")))).alias("l"))
    return lists.select(
        F.concat(F.lit("run/labels/swing_"), (F.col("l_orderkey") % 1000).cast("string"), F.lit("_"),
                 S.padded(F.col("l_orderkey").cast("string"), 9), F.lit(".txt")).alias("path"),
        F.concat(F.array_join("l.line", "\n"), F.lit("\n\n")).alias("text"))


cte("label_lines",
    "select 'swing_' || (l_orderkey % 1000) || '_' || lpad(cast(l_orderkey as varchar), cast(greatest(9, length(cast(l_orderkey as varchar))) as int), '0') as stem, l_partkey, l_suppkey, "
    "l_discount, l_tax, l_quantity, l_linenumber, "
    "row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice, l_partkey) as line_no from lineitem "
    "where l_linenumber not in (4, 5)")
