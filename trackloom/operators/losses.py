"""Training-loss terms as evaluation diagnostics over scored windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.schemas import IMAGE_HEIGHT, IMAGE_WIDTH

# Default weights of the terms in the total.
LOSS_WEIGHTS = {
    "position": 1.0, "prior": 0.5, "correction": 1.0, "prior_guidance": 0.05, "length": 0.0,
    "error_bucket": 0.0, "quality": 0.0, "trust": 0.2, "direction": 1.0, "velocity": 0.05,
    "prior_velocity": 0.02, "acceleration": 0.01, "prior_acceleration": 0.005, "observation": 0.05,
    "line": 0.05, "endpoint": 0.02, "damage": 0.01, "good_damage": 0.0,
}


def _scaled(width: float, height: float) -> dict[str, Column]:
    c = F.col
    valid = c("target_valid")
    return {
        "px": c("final_x") * width, "py": c("final_y") * height, "qx": c("prior_x") * width, "qy": c("prior_y") * height,
        "ox": c("tail_x_norm") * width, "oy": c("tail_y_norm") * height,
        "gx": F.when(valid, c("gt_tail_x")).otherwise(c("tail_x_norm")) * width,
        "gy": F.when(valid, c("gt_tail_y")).otherwise(c("tail_y_norm")) * height,
        "hx": F.when(valid, c("gt_head_x")).otherwise(c("head_x_norm")) * width,
        "hy": F.when(valid, c("gt_head_y")).otherwise(c("head_y_norm")) * height,
    }


def with_window_lags(rows: DataFrame, width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT) -> DataFrame:
    """Pixel points, frame weight, and first and second differences inside a window."""
    out = rows.withColumns(_scaled(width, height))
    out = out.withColumn("obs_error", F.hypot(F.col("ox") - F.col("gx"), F.col("oy") - F.col("gy")))
    out = out.withColumn("weight", S.error_frame_weight(
        F.col("obs_error"), F.col("tail_visibility"), F.col("tail_seen"), F.col("target_valid")))
    w = Window.partitionBy("swing_id", "win_start").orderBy("idx")
    now = F.struct("px", "py", "qx", "qy", "gx", "gy", "weight", "target_valid")
    out = out.withColumn("s0", now).withColumns({"s1": F.lag("s0", 1).over(w), "s2": F.lag("s0", 2).over(w)})
    f = {}
    for p in ("px", "py", "qx", "qy", "gx", "gy"):
        a, b, c = F.col(f"s0.{p}"), F.col(f"s1.{p}"), F.col(f"s2.{p}")
        f[f"vel_{p}"] = a - b
        f[f"acc_{p}"] = a - 2.0 * b + c
    t = [F.coalesce(F.col(f"s{i}.target_valid"), F.lit(False)) for i in range(3)]
    wt = [F.col(f"s{i}.weight") for i in range(3)]
    f["pair_ok"] = t[0] & t[1]
    f["triple_ok"] = t[0] & t[1] & t[2]
    f["pair_weight"] = F.when(F.col("idx") >= 1, F.when(t[0] & t[1], (wt[0] + wt[1]) * 0.5).otherwise(0.0))
    f["triple_weight"] = F.when(F.col("idx") >= 2, F.when(t[0] & t[1] & t[2], (wt[0] + wt[1] + wt[2]) / 3.0).otherwise(0.0))
    return out.withColumns(f).drop("s0", "s1", "s2")


def huber(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 1, 0.5 * a * a).otherwise(a - 0.5)


def _bce(logit: Column, target: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def frame_terms(good_error: float = 5.0, good_margin: float = 0.25, margin: float = 1.0,
                line_px: float = 3.0, end_px: float = 10.0) -> dict[str, tuple[Column, Column]]:
    """term -> (loss, weight) per row; score columns s0..s9 hold the raw scores."""
    c = F.col
    w = c("weight")
    vis = c("target_valid").cast("double")
    err = c("obs_error")
    dx, dy = c("delta_x"), c("delta_y")
    fx, fy = c("px") - c("gx"), c("py") - c("gy")
    final_error = F.hypot(fx, fy)
    tx, ty = c("gx") - c("hx"), c("gy") - c("hy")
    tl = F.greatest(F.hypot(tx, ty), F.lit(1e-6))
    pl = F.greatest(F.hypot(c("px") - c("hx"), c("py") - c("hy")), F.lit(1e-6))
    ux, uy = tx / tl, ty / tl
    along = fx * ux + fy * uy
    across = F.hypot(fx - along * ux, fy - along * uy)
    relu = lambda e: F.greatest(e, F.lit(0.0))
    s = [c(f"s{i}") for i in range(10)]
    top = F.greatest(*s[5:9])
    lse = top + F.log(F.exp(s[5] - top) + F.exp(s[6] - top) + F.exp(s[7] - top) + F.exp(s[8] - top))
    hit = F.when(err < 5, s[5]).when(err < 10, s[6]).when(err < 20, s[7]).otherwise(s[8])
    trust = S.trust_target(dx, dy, c("gx") - c("ox"), c("gy") - c("oy"))
    seen = c("tail_seen").cast("double") * vis
    return {
        "position": (huber(fx) + huber(fy), w),
        "prior": (huber(c("qx") - c("gx")) + huber(c("qy") - c("gy")), w),
        "length": (huber(F.hypot(c("px") - c("hx"), c("py") - c("hy")) - F.hypot(tx, ty)), w),
        "correction": (huber(dx - (c("gx") - c("ox"))) + huber(dy - (c("gy") - c("oy"))), w),
        "prior_guidance": (huber(dx - (c("qx") - c("ox"))) + huber(dy - (c("qy") - c("oy"))), w),
        "error_bucket": (lse - hit, w),
        "quality": (_bce(s[9], S.quality_target(err)), w),
        "trust": (_bce(s[4], trust), w * vis),
        "direction": (1.0 - ((c("px") - c("hx")) / pl * ux + (c("py") - c("hy")) / pl * uy), w),
        "line": (relu(across - line_px) ** 2, w),
        "endpoint": (relu(F.abs(along) - end_px) ** 2, w),
        "velocity": (huber(c("vel_px") - c("vel_gx")) + huber(c("vel_py") - c("vel_gy")), c("pair_weight")),
        "prior_velocity": (huber(c("vel_qx") - c("vel_gx")) + huber(c("vel_qy") - c("vel_gy")), c("pair_weight")),
        "acceleration": (huber(c("acc_px") - c("acc_gx")) + huber(c("acc_py") - c("acc_gy")), c("triple_weight")),
        "prior_acceleration": (huber(c("acc_qx") - c("acc_gx")) + huber(c("acc_qy") - c("acc_gy")), c("triple_weight")),
        "observation": (huber(c("px") - c("ox")) + huber(c("py") - c("oy")), seen * S.clamp(c("tail_conf"), 0.0, 1.0)),
        "damage": (relu(final_error - err - margin) ** 2, seen),
        "good_damage": (relu(final_error - err - good_margin) ** 2, F.when(err < good_error, seen).otherwise(0.0)),
    }


def weighted_loss_terms(rows: DataFrame, keys: list[str], weights: Mapping[str, float] = LOSS_WEIGHTS) -> DataFrame:
    """Sum(loss * weight) / max(sum(weight), 1) per term and key, and their total."""
    terms = frame_terms()
    aggs = []
    for name, (loss, w) in terms.items():
        aggs.append((F.coalesce(F.sum(loss * w), F.lit(0.0)) / F.greatest(F.sum(w), F.lit(1.0))).alias(name))
    out = with_window_lags(rows).groupBy(*keys).agg(*aggs)
    total = None
    for name, lam in weights.items():
        part = F.col(name) * lam
        total = part if total is None else total + part
    return out.withColumn("total", total)
