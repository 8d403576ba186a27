"""Long <-> wide keypoint rows and last-row-wins scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.schemas import KEYPOINTS


def last_row_wins(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """One row per key, the one with the highest line number (map-side combined)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(line)).alias("__r")).select(*keys, "__r.*")


def keypoint_filter(df: DataFrame) -> DataFrame:
    """Head/tail rows that name a frame."""
    frame = S.first_text(F.col("image_stem"), F.col("frame"))
    return df.filter(F.col("keypoint").isin(*KEYPOINTS) & frame.isNotNull())


def frames_with_both_points(long: DataFrame, line: str | None = None) -> DataFrame:
    """Long detail rows to one row per frame; frames lacking a point are dropped."""
    rows = keypoint_filter(long).withColumns({
        "swing_id": F.coalesce(S.blank_to_null(F.col("swing_id")), F.lit("unknown")),
        "image_stem": S.first_text(F.col("image_stem"), F.col("frame"))})
    order = F.col(line) if line else F.lit(0)
    fields = ["frame", "visibility", "gt_x", "gt_y", "pred_x", "pred_y", "pred_conf", "status"]
    picked = rows.groupBy("swing_id", "image_stem").agg(*[
        F.max_by(F.when(F.col("keypoint") == k, F.struct(*fields)), F.when(F.col("keypoint") == k, order)).alias(k)
        for k in KEYPOINTS])
    out = picked.filter(F.col("head").isNotNull() & F.col("tail").isNotNull())
    cols: list[Column] = [
        F.col("swing_id"), F.col("image_stem"),
        S.frame_number(S.first_text(F.col("head.frame"), F.col("image_stem"))).alias("frame_idx")]
    for k in KEYPOINTS:
        cols += [F.col(f"{k}.{f}").cast("double").alias(f"{k}_{f}") for f in ("gt_x", "gt_y", "pred_x", "pred_y", "pred_conf")]
        cols += [S.known_visibility(F.col(f"{k}.visibility")).alias(f"{k}_visibility"),
                 F.coalesce(S.blank_to_null(F.col(f"{k}.status")), F.lit("unknown")).alias(f"{k}_status")]
    return out.select(*cols)


def _first(col: str, order: Column, when: Column | None = None) -> Column:
    value = F.struct(F.col(col).alias("v"))
    if when is None:
        return F.min_by(value, order)["v"]
    return F.min_by(F.when(when, value), F.when(when, order))["v"]


def pivot_frames(long: DataFrame, order: Column) -> DataFrame:
    """One row per (image_stem, swing_id, frame): first row's box, both predictions."""
    aggs = [_first(c, order).alias(c) for c in ("bbox_conf", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")]
    for k in KEYPOINTS:
        aggs += [_first(c, order, F.col("keypoint") == k).alias(f"{k}_{c}") for c in ("pred_x", "pred_y", "pred_conf")]
    out = long.groupBy("image_stem", "swing_id", "frame").agg(*aggs)
    return out.withColumn("frame_idx", S.frame_index_last_group(F.col("frame")).cast("int"))


def pivot_wide(long: DataFrame, order: Column, *, drop_null_keys: bool = False) -> DataFrame:
    """Wide evaluation rows; the frame status is that of its first row."""
    keys = ["image_stem", "swing_id", "view", "batter_side", "frame"]
    df = long.dropna(subset=keys) if drop_null_keys else long
    aggs = [_first(c, order).alias(c) for c in
            ("bbox_conf", "detection_rank", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "status")]
    for k in KEYPOINTS:
        hit = F.col("keypoint") == k
        aggs.append(F.coalesce(_first("visibility", order, hit), F.lit("")).alias(f"{k}_visibility"))
        aggs += [_first(c, order, hit).alias(f"{k}_{c}") for c in
                 ("gt_x", "gt_y", "pred_x", "pred_y", "pred_conf", "dx", "dy", "error_px")]
    return df.groupBy(*keys).agg(*aggs)


def wide_observations(wide: DataFrame) -> DataFrame:
    """Wide rows as observations: confidence is zero where the point is invalid."""
    out = {}
    for k in KEYPOINTS:
        ok = S.observed(F.col(f"{k}_pred_x"), F.col(f"{k}_pred_y"), F.col(f"{k}_pred_conf"))
        out[f"{k}_pred_conf"] = F.when(ok, F.col(f"{k}_pred_conf")).otherwise(0.0)
        out[f"{k}_seen"] = ok
        out[f"{k}_visibility"] = S.known_visibility(F.col(f"{k}_visibility"))
        out[f"{k}_status"] = F.coalesce(S.blank_to_null(F.col("status")), F.lit("unknown"))
    return wide.withColumns(out)


def clip_metadata(raw: DataFrame, line: str) -> DataFrame:
    """Sequence dimension from clip rows; the last row of a name wins."""
    name = S.first_text(*[F.col(c) for c in ("name", "swing_id", "clip", "clip_name") if c in raw.columns])
    side = S.batter_side(F.col("batter_side"))
    rows = raw.withColumn("swing_id", name).filter(F.col("swing_id").isNotNull()).select(
        "swing_id", side.alias("side"), F.when(side == "left", "L").otherwise("R").alias("hand"),
        (side == "left").alias("flip"), F.coalesce(S.blank_to_null(F.col("view")), F.lit("random")).alias("source_view"),
        S.canonical_view(F.col("view"), F.col("batter_side")).alias("view_label"), F.col(line).alias("line"))
    return last_row_wins(rows, ["swing_id"], "line").drop("line")


def combine_metadata(*maps: DataFrame) -> DataFrame:
    """Union of metadata maps; a later map overrides an earlier one."""
    tagged = None
    for i, m in enumerate(maps):
        part = m.withColumn("__prio", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    return last_row_wins(tagged, ["swing_id"], "__prio").drop("__prio")


def attach_metadata(df: DataFrame, meta: DataFrame, view: str = "random", hand: str = "R", *, tasks: int | None = None) -> DataFrame:
    """Left join of clip metadata with defaults for unknown sequences.

    Where rows need ``tasks`` of their own, the few columns of a clip are hashed and the frames are not sorted.
    """
    side = "left" if hand.upper().startswith("L") else "right"
    label = S.swap_side(S.view_label(F.lit(view))) if side == "left" else S.view_label(F.lit(view))
    out = df.join(meta.hint("shuffle_hash") if tasks else meta, "swing_id", "left")
    return out.withColumns({
        "side": F.coalesce(F.col("side"), F.lit(side)),
        "hand": F.coalesce(F.col("hand"), F.lit("L" if side == "left" else "R")),
        "flip": F.coalesce(F.col("flip"), F.lit(side == "left")),
        "source_view": F.coalesce(F.col("source_view"), F.lit(view)),
        "view_label": F.coalesce(F.col("view_label"), label)})


def visibility_from_labels(df: DataFrame, line: str) -> DataFrame:
    """(sequence, frame) -> tail visibility; any text is taken as it is."""
    text = S.first_text(F.col("frame"), F.col("image_stem"))
    rows = df.filter(S.blank_to_null(F.col("swing_id")).isNotNull() & text.rlike("[0-9]")).select(
        "swing_id", S.frame_number(text).alias("frame_idx"),
        F.coalesce(S.blank_to_null(F.col("tail_visibility")), F.lit("fully_visible")).alias("visibility"), line)
    return last_row_wins(rows, ["swing_id", "frame_idx"], line).drop(line)


def visibility_from_details(long: DataFrame, line: str) -> DataFrame:
    """Same from tail rows of detail rows; unknown labels are skipped."""
    label = F.coalesce(S.blank_to_null(F.col("visibility")), F.lit("fully_visible"))
    rows = long.filter((F.col("keypoint") == "tail") & S.blank_to_null(F.col("swing_id")).isNotNull()
                       & (label == S.known_visibility(label))).select(
        "swing_id", S.frame_number(S.first_text(F.col("frame"), F.col("image_stem"))).alias("frame_idx"),
        label.alias("visibility"), line)
    return last_row_wins(rows, ["swing_id", "frame_idx"], line).drop(line)
