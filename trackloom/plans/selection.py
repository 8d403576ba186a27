"""Candidate records and annotations to evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import evaluation_rows as V
from trackloom.operators.contracts import require_record_schema
from trackloom.operators.selection import screen_outliers, select_candidates
from trackloom.schemas import RECORD_COLUMNS, ScreenSettings, SelectionSettings


def selected_frames(
    records: DataFrame, annotations: DataFrame, clips: DataFrame | None = None, *,
    settings: SelectionSettings = SelectionSettings(), limits: ScreenSettings = ScreenSettings(),
) -> DataFrame:
    """Choose and screen on inference columns only, then reattach annotations and clips.

    Frames without an annotation are left out before selection.
    """
    known = V.join_annotations(records.select("image_stem", "swing_id"), annotations).select("image_stem", "swing_id")
    picked = screen_outliers(select_candidates(require_record_schema(records.select(*RECORD_COLUMNS)), settings, only=known), limits)
    out = V.join_annotations(picked, annotations)
    if clips is None:
        return out.withColumns({"view": F.lit(""), "batter_side": F.lit("")})
    out = out.join(clips, "swing_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("view", "batter_side")})


def detail_rows(frames: DataFrame, *, bbox_min: float = 0.0, kpt_min: float = 0.0) -> DataFrame:
    """Head, tail and auxiliary rows in the 22-column layout."""
    return V.keypoint_rows(frames, bbox_min=bbox_min, kpt_min=kpt_min, auxiliary=True)
