"""Detail frames to split, weighted and packed training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators.contracts import holdout_split, require_rows
from trackloom.operators.windows import pack_windows, supervised_windows
from trackloom.schemas import FEATURES_25, FEATURES_45, WindowSettings
from trackloom.session import materialised

TARGETS = ("gt_head_x", "gt_head_y", "gt_tail_x", "gt_tail_y", "target_valid", "tail_visibility")
WEIGHTS = (0.75, 2.0, 3.0, 4.0)


def training_windows(
    frames: DataFrame, *, settings: WindowSettings = WindowSettings(), use_flow: bool = False,
    val_fraction: float = 0.2, seed: int = 7, val_ids: list[str] | None = None,
    weights: tuple[float, float, float, float] = WEIGHTS,
) -> DataFrame:
    """One row per window: x, targets, tail weight and train/val split by sequence."""
    wins = supervised_windows(frames, settings, use_flow=use_flow).select("*", "ctx.*").drop("ctx")
    wins = wins.withColumn("tail_weight", S.visibility_weight(F.col("tail_visibility"), weights))
    packed = pack_windows(wins, FEATURES_45 if use_flow else FEATURES_25, extra=["tail_weight", "tail_seen", *TARGETS])
    return packed.join(holdout_split(packed, val_fraction, seed, val_ids), "swing_id")


def trainable(windows: DataFrame, frames: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """``windows``; a query over them fails if there are none at all, or none to train on.

    The first message tells how many sequences there are and how long the longest is. The windows are stored once, as the
    guards read them, too.
    """
    windows = materialised(windows)
    longest = frames.groupBy("swing_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("swings"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"))
    none = F.concat(F.lit("no windows: "), F.col("swings").cast("string"), F.lit(" sequences, the longest has "), F.col("longest").cast("string"), F.lit(f" frames of {settings.size}"))
    held = windows.groupBy("split").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"))
    alone = F.when(F.col("all") > 0, F.concat(F.lit("no training windows: all "), F.col("all").cast("string"), F.lit(" are held out")))
    training = require_rows(windows.filter(F.col("split") == "train"), alone, held)
    return require_rows(windows.filter(F.col("split") != "train").unionByName(training), none, longest)
