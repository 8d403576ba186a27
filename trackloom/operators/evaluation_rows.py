"""Evaluation rows: selected detections joined back to annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.schemas import AUX_KEYPOINT, DETAIL_COLUMNS, DETAIL_NUMBERS, IMAGE_HEIGHT, IMAGE_WIDTH, KEYPOINTS


def evaluation_status(
    k: str, conf: Column, kconf: Column, has_pred: Column, drop: Column, visibility: Column,
    gt_x: Column, gt_y: Column, bbox_min: float, kpt_min: float,
) -> Column:
    """Ordered ladder of outcomes for one (frame, keypoint)."""
    return (
        F.when(~has_pred & (visibility == "ignore"), "ignore_no_prediction")
        .when(~has_pred, "missing_prediction")
        .when(drop == "center_outlier", "center_outlier")
        .when(drop == "length_outlier", "length_outlier")
        .when(visibility == "ignore", "ignore_with_prediction")
        .when(conf < bbox_min, "bbox_conf_below_threshold")
        .when(kconf < kpt_min, "kpt_conf_below_threshold")
        .when(gt_x.isNull() | gt_y.isNull(), "missing_gt")
        .otherwise("matched")
    )


def join_annotations(records: DataFrame, annotations: DataFrame) -> DataFrame:
    """Keep the predictions that have an annotation row; drops the rest."""
    gt = annotations.withColumn("image_stem", F.concat_ws("_", "swing_id", S.file_stem(F.col("frame"))))
    return records.join(gt.drop("swing_id"), "image_stem", "inner")


def unmatched_predictions(records: DataFrame, annotations: DataFrame) -> DataFrame:
    gt = annotations.select(F.concat_ws("_", "swing_id", S.file_stem(F.col("frame"))).alias("image_stem"))
    return records.join(gt, "image_stem", "left_anti")


def has_auxiliary() -> Column:
    """The tail is ignored but an auxiliary point exists."""
    return (
        (F.trim(F.coalesce(F.col("tail_visibility"), F.lit(""))) == "ignore")
        & F.col("bat_visible_aux_x").isNotNull() & F.col("bat_visible_aux_y").isNotNull())


def keypoint_rows(
    frames: DataFrame, *, bbox_min: float = 0.0, kpt_min: float = 0.0,
    width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT, auxiliary: bool = False,
) -> DataFrame:
    """Two rows per frame, three with ``auxiliary`` where that point exists.

    Needs chosen, drop_reason, annotation and clip columns. All rows of a frame come
    from one pass, so the selection before it runs once.
    """
    ch, drop = F.col("chosen"), F.col("drop_reason")
    has = ch.isNotNull()
    boxed = has & ~drop.eqNullSafe("center_outlier")
    pointed = boxed & ~drop.eqNullSafe("length_outlier")
    structs = []
    for k in KEYPOINTS:
        vis = F.trim(F.coalesce(F.col(f"{k}_visibility"), F.lit("")))
        gx, gy = F.col(f"{k}_x"), F.col(f"{k}_y")
        px, py, pc = ch[f"{k[0]}x"], ch[f"{k[0]}y"], ch[f"{k}_conf"]
        status = evaluation_status(k, ch["conf"], pc, has, drop, vis, gx, gy, bbox_min, kpt_min)
        hit = status == "matched"
        half_w, half_h = ch["bw"] * width / 2.0, ch["bh"] * height / 2.0
        structs.append(F.struct(
            F.lit(k).alias("keypoint"), vis.alias("visibility"), gx.alias("gt_x"), gy.alias("gt_y"),
            F.when(pointed, px).alias("pred_x"), F.when(pointed, py).alias("pred_y"), F.when(pointed, pc).alias("pred_conf"),
            F.when(boxed, ch["conf"]).alias("bbox_conf"), F.when(boxed, ch["rank"]).alias("detection_rank"),
            F.when(boxed, ch["cx"] - half_w).alias("bbox_x1"), F.when(boxed, ch["cy"] - half_h).alias("bbox_y1"),
            F.when(boxed, ch["cx"] + half_w).alias("bbox_x2"), F.when(boxed, ch["cy"] + half_h).alias("bbox_y2"),
            F.when(hit, px - gx).alias("dx"), F.when(hit, py - gy).alias("dy"),
            F.when(hit, F.hypot(px - gx, py - gy)).alias("error_px"), status.alias("status")))
    rows = F.array(*structs)
    if auxiliary:
        none = F.lit(None)
        extra = F.struct(
            F.lit(AUX_KEYPOINT).alias("keypoint"), F.lit("").alias("visibility"), F.col("bat_visible_aux_x").alias("gt_x"),
            F.col("bat_visible_aux_y").alias("gt_y"), *[none.cast("double").alias(n) for n in ("pred_x", "pred_y", "pred_conf", "bbox_conf")],
            none.cast("int").alias("detection_rank"), *[none.cast("double").alias(n) for n in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "dx", "dy", "error_px")],
            F.lit("gt_only").alias("status"))
        rows = F.array_compact(F.array(*structs, F.when(has_auxiliary(), extra)))
    return frames.select("image_stem", "swing_id", "view", "batter_side", "frame", F.inline(rows)).select(*DETAIL_COLUMNS)


def auxiliary_rows(frames: DataFrame) -> DataFrame:
    """Extra annotation-only row when the tail is ignored but an auxiliary point exists."""
    empty = {c: F.lit(None).cast("double") for c in DETAIL_NUMBERS}
    rows = frames.filter(has_auxiliary()).withColumns({
        **empty, "keypoint": F.lit(AUX_KEYPOINT), "visibility": F.lit(""),
        "gt_x": F.col("bat_visible_aux_x"), "gt_y": F.col("bat_visible_aux_y"),
        "detection_rank": F.lit(None).cast("int"), "status": F.lit("gt_only")})
    return rows.select(*DETAIL_COLUMNS)


def detail_order() -> list[Column]:
    return [F.col("swing_id"), F.col("frame"), F.coalesce(F.col("detection_rank"), F.lit(10 ** 9)), F.col("keypoint")]


COUNTED = ("image_stem", "swing_id", "view", "batter_side", "frame", "n_detections", "drop_reason", "head_visibility", "tail_visibility",
           "head_x", "head_y", "tail_x", "tail_y", "bat_visible_aux_x", "bat_visible_aux_y")


def counted_columns(frames: DataFrame) -> DataFrame:
    """The columns of selected frames that detail rows and ``selection_counters`` read."""
    return frames.select(*COUNTED, "chosen")


def selection_counters(frames: DataFrame, rows: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Counter name and value: what was missing, re-ranked, dropped or ignored."""
    def counts(df: DataFrame, named: dict[str, Column]) -> DataFrame:
        one = df.agg(*[F.count_if(c).alias(n) for n, c in named.items()])
        return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("value")) for n in named])))

    return (
        counts(unmatched, {"missing_gt_frames": F.lit(True)})
        .unionByName(counts(frames, {
            "frames_without_prediction": F.col("n_detections") == 0,
            "rank_not_one": F.coalesce(F.col("chosen.rank") != 1, F.lit(False)),
            "center_drops": F.col("drop_reason").eqNullSafe("center_outlier"),
            "length_drops": F.col("drop_reason").eqNullSafe("length_outlier")}))
        .unionByName(counts(rows, {
            "ignore_with_prediction": F.col("status") == "ignore_with_prediction",
            "ignore_no_prediction": F.col("status") == "ignore_no_prediction",
            "visible_aux_rows": F.col("keypoint") == AUX_KEYPOINT,
            "detail_rows": F.lit(True)}))
    )
