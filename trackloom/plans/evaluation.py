"""Whole evaluations: scored windows to a metric table with run facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import metrics as M
from trackloom.session import materialised


def evaluate(scored_windows: DataFrame, to_frames: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Error statistics by series and group beside sequence, window and frame counts."""
    frames = materialised(to_frames(scored_windows))
    facts = {
        "swings": frames.groupBy("swing_id").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1))).scalar(),
        "windows": scored_windows.filter(F.col("idx") == 0).agg(F.count(F.lit(1))).scalar(),
        "frames": frames.agg(F.count(F.lit(1))).scalar()}
    return M.error_by_group(frames).withColumns(facts)
