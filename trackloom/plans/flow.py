"""Detail rows and flow fields to the wide table with flow features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import flow as W
from trackloom.operators.reshape import pivot_wide
from trackloom.schemas import FLOW_SOURCE_COLUMNS
from trackloom.session import materialised

POINTS = {f"{k}_pred_{a}": i for k in ("head", "tail") for i, a in enumerate("xy")}
BOXES = {"bbox_x1": 0, "bbox_y1": 1, "bbox_x2": 0, "bbox_y2": 1}


def scaled_frames(frames: DataFrame, scale: tuple[float, float] = (240.0, 135.0)) -> DataFrame:
    """Points and boxes in pixels of a field smaller than the image by ``scale``."""
    keep = ["image_stem", "swing_id", "frame", "frame_idx", "head_pred_conf", "tail_pred_conf", "bbox_conf"]
    return frames.select(*keep, *[(F.col(c) / scale[i]).alias(c) for c, i in {**POINTS, **BOXES}.items()])


def flow_feature_table(
    details: DataFrame, order: Column, tiles: DataFrame, *, scale: tuple[float, float] = (1.0, 1.0),
    radius: int = 8, pad: int = 5, tile: tuple[int, int] = (W.TILE_ROWS, W.TILE_COLUMNS), row_pixels: int = W.ROW_PIXELS,
) -> DataFrame:
    """Local and global flow statistics merged onto the wide evaluation rows.

    The two merges read the wide rows, which are stored once; ``tiles`` are those of ``flow.field_tiles``.
    """
    wide = materialised(pivot_wide(details, order).withColumn("frame_idx", S.frame_index_last_group(F.col("frame")).cast("int")))
    local = W.region_stats(scaled_frames(wide, scale), tiles, radius=radius, pad=pad, tile=tile, row_pixels=row_pixels)
    names = wide.select("swing_id", "frame_idx", F.col("frame").alias("frame_name"))
    stats = W.attach_global(names, W.global_stats(tiles, row_pixels=row_pixels))
    return W.sanity_columns(W.merge_global(W.merge_local(wide.drop("frame_idx"), local), stats))


def flow_observations(
    frames: DataFrame, tiles: DataFrame, *, scale: tuple[float, float] = (1.0, 1.0),
    radius: int = 8, pad: int = 5, tile: tuple[int, int] = (W.TILE_ROWS, W.TILE_COLUMNS), row_pixels: int = W.ROW_PIXELS,
) -> DataFrame:
    """Frames with the twenty flow columns that the 45-column features read, merged one to one."""
    kept = materialised(frames)
    local = W.region_stats(scaled_frames(kept, scale), tiles, radius=radius, pad=pad, tile=tile, row_pixels=row_pixels)
    names = kept.select("swing_id", "frame_idx", F.col("frame").alias("frame_name"))
    stats = W.attach_global(names, W.global_stats(tiles, row_pixels=row_pixels))
    merged = W.merge_global(W.merge_local(kept, local.drop("frame_idx")), stats)
    return merged.select(*kept.columns, *FLOW_SOURCE_COLUMNS)


def missing_flow(table: DataFrame) -> DataFrame:
    """Rows that found no local or no global partner."""
    return table.agg(F.count_if(F.col("has_prev_flow").isNull()).alias("missing_local"),
                     F.count_if(F.col("global_has_prev_flow").isNull()).alias("missing_global"))
