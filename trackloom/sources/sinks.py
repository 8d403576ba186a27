"""Writers. Every one writes in parallel; none gathers rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators.evaluation_rows import detail_order
from trackloom.schemas import DETAIL_COLUMNS, DETAIL_NUMBERS, PREDICTION_COLUMNS


def detail_text(rows: DataFrame) -> DataFrame:
    """22 text columns, numbers with six decimals, blank when missing."""
    cols = []
    for c in DETAIL_COLUMNS:
        if c in DETAIL_NUMBERS:
            cols.append(S.fixed6(F.col(c)).alias(c))
        else:
            cols.append(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c))
    return rows.select(*cols)


def write_details(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Globally sorted CSV: files in name order hold rows in key order."""
    detail_text(rows.orderBy(*detail_order())).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def prediction_rows(frames: DataFrame, width: float, height: float) -> DataFrame:
    """Two long rows (head, tail) per scored frame in the 28-column layout."""
    c = F.col
    t, seen = c("target_valid"), c("obs_valid")
    px = {}
    for name in ("raw_head", "raw_tail", "filled", "prior", "final", "corrected", "gt_head", "gt_tail"):
        px[name] = (c(f"{name}_x") * width, c(f"{name}_y") * height)
    head_error = F.when(t, F.hypot(px["raw_head"][0] - px["gt_head"][0], px["raw_head"][1] - px["gt_head"][1]))

    def pair(p, when=None):
        return [F.when(when, v) if when is not None else v for v in p]
    none = F.lit(None).cast("double")
    head = {
        "keypoint": F.lit("head"), "visibility": c("head_visibility"), "obs_valid": F.lit(1),
        "raw": px["raw_head"], "filled": px["raw_head"], "prior": (none, none), "final": px["raw_head"], "corrected": px["raw_head"],
        "gt": pair(px["gt_head"], t), "pred_conf": c("head_conf"), "raw_error_px": head_error, "filled_error_px": head_error,
        "prior_error_px": none, "final_error_px": head_error, "corrected_error_px": head_error, "final_shift_px": F.lit(0.0)}
    tail = {
        "keypoint": F.lit("tail"), "visibility": c("tail_visibility"), "obs_valid": seen.cast("int"),
        "raw": pair(px["raw_tail"], seen), "filled": px["filled"], "prior": px["prior"], "final": px["final"], "corrected": px["corrected"],
        "gt": pair(px["gt_tail"], t), "pred_conf": c("tail_conf"), "raw_error_px": F.when(t & seen, c("raw_error")),
        **{f"{s}_error_px": F.when(t, c(f"{s}_error")) for s in ("filled", "prior", "final", "corrected")},
        "final_shift_px": c("final_shift")}
    items = []
    for row in (head, tail):
        flat = []
        for name, v in row.items():
            if isinstance(v, (tuple, list)):
                flat += [v[0].cast("double").alias(f"{name}_x"), v[1].cast("double").alias(f"{name}_y")]
            else:
                flat.append(v.alias(name))
        items.append(F.struct(*flat))
    return frames.select("swing_id", "image_stem", "frame_idx", t.cast("int").alias("target_valid"), "trust",
                         c("quality").alias("yolo_quality"), F.inline(F.array(*items))).select(*PREDICTION_COLUMNS)


def write_predictions(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.orderBy("swing_id", "frame_idx", "keypoint").write.mode(mode).option("header", True).csv(path)


def write_shards(samples: DataFrame, path: str, *, shard_size: int = 0, compress: bool = True, mode: str = "overwrite") -> None:
    """Parquet per split; at most ``shard_size`` samples per file when positive."""
    w = samples.write.mode(mode).partitionBy("split").option("compression", "zstd" if compress else "none")
    if shard_size > 0:
        w = w.option("maxRecordsPerFile", shard_size)
    w.parquet(path)


def write_by_folder(rows: DataFrame, path: str, *, source: str = "source_c3d", append: bool = False) -> None:
    """One CSV folder per source folder."""
    folder = S.safe_name(F.regexp_extract(F.col(source), r"([^/]+)/[^/]+$", 1))
    rows.withColumn("folder", folder).write.mode("append" if append else "overwrite").partitionBy("folder").option("header", True).csv(path)
