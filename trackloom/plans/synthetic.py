"""Marker tracks to projected rows, and projected rows to training windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import augment as A
from trackloom.operators import projection as P
from trackloom.operators.windows import features_in_windows, pack_windows
from trackloom.schemas import FEATURES_25, WindowSettings
from trackloom.session import materialised
from trackloom.sources.files import numbered_shards


def projected_tracks(markers: DataFrame, assigned: DataFrame, seed: int, *, keep_only_visible: bool = False,
                     horizontal_flip: bool = False, part: str | None = None) -> DataFrame:
    """Bat track of every sequence through its cameras (and mirrored copies); rows lie by sequence and ``part``, if that is named."""
    track = P.scaled_track(materialised(P.bat_track(markers)))
    basis = P.camera_basis(P.sample_cameras(assigned, seed), P.scene_bounds(track))
    rows = P.project_tracks(track, basis, keep_only_visible=keep_only_visible, part=part)
    return P.mirror_rows(rows) if horizontal_flip else rows


def pooled_frames(track: DataFrame) -> DataFrame:
    """Frames with the error columns the pool reads."""
    out = {}
    for k in ("head", "tail"):
        for a in "xy":
            out[f"{k}_d{a}"] = F.col(f"{k}_pred_{a}") - F.col(f"{k}_gt_{a}")
        out[f"{k}_status"] = F.col(f"{k}_status") if f"{k}_status" in track.columns else F.lit("unknown")
    return track.withColumns(out)


Sampler = Callable[[DataFrame, A.CorruptionSettings, WindowSettings], DataFrame]
"""Adds obs_head_*/obs_tail_* (x, y, conf, seen) to the rows of clean windows."""


def gaussian_sampler(wins: DataFrame, s: A.CorruptionSettings, settings: WindowSettings) -> DataFrame:
    return A.gaussian_corrupt(wins, s, settings.width, settings.height)


def pool_sampler(pool: DataFrame, weight: Column | None = None) -> Sampler:
    """Replays windows of real detector errors, all alike or in proportion to ``weight``, a column of the pool."""
    return lambda wins, s, settings: A.replay_corrupt(wins, pool, s, weight=weight)


def synthetic_windows(
    rows: DataFrame, splits: DataFrame, *, sampler: Sampler = gaussian_sampler, lookup: DataFrame | None = None,
    settings: WindowSettings = WindowSettings(), corruption: A.CorruptionSettings = A.CorruptionSettings(),
    target_fps: float = 60.0, source_fps: float = 360.0, shard_size: int | None = None, shard_seed: int = 0,
) -> DataFrame:
    """One row per window: features of the pseudo detector and clean targets.

    Sequences without a split are dropped. ``sampler`` corrupts the clean windows. Features see the corrupted
    points only; the labels that caused the corruption are kept as supervision. With ``shard_size`` windows have shard and
    place (``numbered_shards``) and lie by (split, shard): the rows are moved there while they are narrow, not the samples.
    """
    tracks = A.clean_tracks(
        rows, target_fps=target_fps, source_fps=source_fps, width=settings.width, height=settings.height, min_rows=settings.size,
        only=splits.select("swing_id")).select("swing_id", "view_id", "frame_idx", "camera_name", "pos", "n", *POINTS)
    if lookup is not None:
        tracks = A.with_real_labels(tracks, lookup)
    wins = A.clean_windows(tracks, settings)
    facts = A.window_view_labels(wins).join(splits, "swing_id")
    if shard_size is not None:
        facts = numbered_shards(facts, shard_size, A.WIN, seed=shard_seed)

    def dealt(labelled: DataFrame) -> DataFrame:
        met = labelled.drop("n", "camera_name").join(facts.select(*A.WIN, "view_label", F.struct(*[c for c in facts.columns if c not in (*A.WIN, "view_label")]).alias("__split")), A.WIN)
        if shard_size is None:
            return met
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return met.withColumns({"split": F.col("__split.split"), "shard": F.col("__split.shard")}).repartition(tasks, "split", "shard")
    # Noise is column arithmetic, so it is added where the rows lie in the end; a sampler that joins moves them and comes first.
    if sampler is gaussian_sampler:
        noisy = sampler(dealt(A.visibility_labels(wins, None, corruption, settings.size)), corruption, settings)
    else:
        noisy = dealt(A.visibility_labels(sampler(wins, corruption, settings), None, corruption, settings.size))
    hidden = A.apply_occlusion(noisy, corruption, settings.width, settings.height)
    return _featurised(hidden, A.WIN if shard_size is None else ["split", "shard", *A.WIN], settings)


POINTS = ("head_x", "head_y", "tail_x", "tail_y")


def _featurised(rows: DataFrame, keys: list[str], settings: WindowSettings) -> DataFrame:
    """Every window is a sequence of its own.

    Rows stay where they are dealt out, by window or by a part of ``keys``: features and packing move them no further.
    """
    ctx = ["label", "tail_weight", "tail_status", *POINTS, "__split"]
    obs = rows.select(
        *keys, "idx", (F.col("win_start") + F.col("idx")).alias("pos"), F.lit(settings.size).cast("bigint").alias("n"), "frame_idx",
        F.lit("").alias("image_stem"), "view_label", F.lit(False).alias("flip"), F.struct(*ctx).alias("ctx"),
        (F.col("obs_head_x") * settings.width).alias("head_pred_x"), (F.col("obs_head_y") * settings.height).alias("head_pred_y"),
        F.when(F.col("obs_head_seen"), F.col("obs_head_conf")).otherwise(0.0).alias("head_pred_conf"),
        (F.col("pseudo_tail_x") * settings.width).alias("tail_pred_x"), (F.col("pseudo_tail_y") * settings.height).alias("tail_pred_y"),
        F.when(F.col("tail_seen"), F.col("tail_conf")).otherwise(0.0).alias("tail_pred_conf"))
    src = F.col("ctx")
    flat = features_in_windows(obs, keys, settings).withColumns({
        **{c: src[c] for c in ("label", "tail_weight", "tail_status")}, "__split": src["__split"],
        **{f"target_{p}": src[p] for p in POINTS}})
    packed = pack_windows(flat, FEATURES_25, extra=["label", "tail_weight", "tail_status", "tail_seen", "target_head_x", "target_head_y", "target_tail_x", "target_tail_y", "__split"], keys=keys)
    facts = [f.name for f in rows.schema["__split"].dataType if f.name not in keys]
    return packed.select("*", F.get("__split", F.lit(0)).alias("__s")).select("*", *[F.col(f"__s.{c}").alias(c) for c in facts]).drop("__split", "__s")


ROW_COLUMNS = ("label", "tail_weight", "tail_status", "tail_seen", "target_head_x", "target_head_y", "target_tail_x", "target_tail_y")


def sample_rows(samples: DataFrame) -> DataFrame:
    """The rows of packed samples: features by name, targets, weight and labels, for checks and for loaders that shuffle rows."""
    each = F.posexplode(F.arrays_zip("x", *ROW_COLUMNS)).alias("idx", "r")
    keys = ["split", "swing_id", "view_id", "win_start", "start_frame_idx", "end_frame_idx"]
    return samples.select(*keys, each).select(*keys, "idx", *[F.col(f"r.{c}").alias(c) for c in ROW_COLUMNS],
                                              *[F.col("r.x")[i].alias(n) for i, n in enumerate(FEATURES_25)])


def summary(samples: DataFrame) -> DataFrame:
    """Groups and samples per split."""
    per_group = samples.groupBy("split", "swing_id", "view_id").agg(F.count(F.lit(1)).alias("c"))
    return per_group.groupBy("split").agg(F.count(F.lit(1)).alias("groups"), F.sum("c").alias("samples")).withColumn("input_dim", F.lit(len(FEATURES_25)))
