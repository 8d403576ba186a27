"""Synthetic training windows: downsample, corrupt, occlude, featurise.

All randomness is keyed by (seed, purpose, row key), see functions.keyed_random.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import keyed_random as R
from trackloom.functions import scalars as S
from trackloom.operators.quantiles import group_quantiles
from trackloom.operators.sequence import BLOCK_ROWS, number_in_place, with_positions
from trackloom.operators.windows import explode_windows
from trackloom.schemas import IMAGE_HEIGHT, IMAGE_WIDTH, WindowSettings
from trackloom.session import materialised


@dataclass(frozen=True)
class CorruptionSettings:
    """Default probabilities and sizes of the occlusion model."""

    seed: int = 7
    noise_px: float = 6.0
    head_conf: float = 0.95
    tail_conf: float = 0.90
    block_prob: float = 0.8
    second_prob: float = 0.1
    length_probs: tuple[float, float, float] = (0.75, 0.20, 0.05)
    length_ranges: tuple[tuple[int, int], ...] = ((3, 10), (10, 20), (20, 30))
    label_probs: tuple[float, float, float] = (0.35, 0.45, 0.20)
    partial_mask: float = 0.5
    hidden_mask: float = 0.35
    ignore_keep: float = 0.05
    conf_caps: tuple[float, float, float] = (0.4, 0.25, 0.10)
    extra_noise_px: tuple[float, float, float] = (4.0, 12.0, 24.0)
    weights: tuple[float, float, float, float] = (0.75, 2.0, 3.0, 4.0)
    late_bias: bool = True
    min_coverage: float = 0.8

    def __post_init__(self) -> None:
        for name in ("length_probs", "label_probs"):
            p = getattr(self, name)
            object.__setattr__(self, name, tuple(v / sum(p) for v in p))


def time_steps(rows: DataFrame, keys: list[str], target_fps: float, source_fps: float, *,
               part: str | None = None, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Keep-every-n step per group from the median of all positive gaps between its finite times.

    Times follow ``order``. Groups with fewer than three times use ``source_fps``. Gaps are taken inside blocks, between the last
    and the first time of neighbouring blocks from a table with one row per block, and only different gaps with their numbers are
    stored. With ``part``, a block that never decreases along ``order`` and by which rows lie already, no row is moved.
    """
    default = F.lit(1)
    if target_fps > 0 and source_fps > 0:
        default = F.greatest(F.lit(1), F.bround(F.lit(source_fps / target_fps)).cast("int"))
    if target_fps <= 0:
        return rows.select(*keys).distinct().withColumn("step", F.lit(1))
    laid = rows.withColumn("__b", F.col(part) if part else F.floor(F.col(order[0]) / 1024)).select(
        *keys, "__b", *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], S.finite(F.col("time_sec")).alias("__t"))
    if part is None:
        laid = laid.repartition(*keys, "__b")
    by = [f"__o{i}" for i in range(len(order))]
    inside = Window.partitionBy(*keys, "__b").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    gaps = laid.withColumn("gap", F.col("__t") - F.last("__t", ignorenulls=True).over(inside)).select(*keys, "gap")
    at = F.when(F.col("__t").isNotNull(), F.struct(*by, "__t"))
    blocks = materialised(laid.groupBy(*keys, "__b").agg(F.min(at)["__t"].alias("__first"), F.max(at)["__t"].alias("__last"), F.count("__t").alias("__n")))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    across = blocks.withColumn("gap", F.col("__first") - F.last("__last", ignorenulls=True).over(before)).select(*keys, "gap")
    counted = materialised(gaps.unionByName(across).filter("gap > 0").groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("__times")))
    med = group_quantiles(counted, keys, {"gap": F.col("gap")}, {"p50": 0.5}, times="__times")
    inferred = F.greatest(F.lit(1), F.bround((1.0 / F.col("gap_p50")) / target_fps).cast("int"))
    found = blocks.groupBy(*keys).agg(F.sum("__n").alias("n")).join(med, keys, "left")
    return found.select(*keys, F.when((F.col("n") >= 3) & F.col("gap_p50").isNotNull(), inferred).otherwise(default).alias("step"))


#: Column of rows that lie by (swing_id, frame_part) already; see ``plans.synthetic.projected_tracks``.
FRAME_PART = "frame_part"


def clean_tracks(rows: DataFrame, *, target_fps: float = 60.0, source_fps: float = 360.0,
                 width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT, min_rows: int = 31, only: DataFrame | None = None) -> DataFrame:
    """Downsampled usable rows of the right-handed copies, normalised and numbered.

    ``rows``: split, swing_id, view_id, frame_idx, time_sec, batter_hand, camera_name,
    head/tail u and v. Downsampling comes before the filter, so windows may bridge
    dropped rows. Adds pos, n. Sequences that ``only`` (swing_id) lacks are left out. Rows stay where they lie,
    by sequence and ``frame_part``, in both numberings; rows without that column are dealt out and stored first. Only the rows
    that are left in the end are stored.
    """
    keys, order = ["swing_id", "view_id"], ["frame_idx", "time_sec"]
    if FRAME_PART not in rows.columns:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = materialised(rows.withColumn(FRAME_PART, F.floor(F.col("frame_idx") / BLOCK_ROWS)).repartition(tasks, "swing_id", FRAME_PART))
    steps = time_steps(rows, keys, target_fps, source_fps, part=FRAME_PART, order=order)
    if only is not None:
        steps = steps.join(only, "swing_id", "left_semi")
    stepped = number_in_place(rows, *keys, FRAME_PART, [F.col(c) for c in order], facts=steps)
    kept = stepped.filter((F.col("pos") % F.col("step") == 0) & (F.ceil(F.col("n") / F.col("step")) >= min_rows))
    # A row's own image size comes before the default.
    width, height = (F.coalesce(S.finite(F.col(c).cast("double")), F.lit(d)) if c in rows.columns else F.lit(d)
                     for c, d in (("image_width", width), ("image_height", height)))
    pts = {c: S.finite(F.col(c)) for c in ("head_u", "head_v", "tail_u", "tail_v")}
    ok = S.batter_hand(F.col("batter_hand")) == "R"
    for e in pts.values():
        ok = ok & e.isNotNull()
    out = materialised(kept.filter(ok).drop("pos", "n", "step"))
    return number_in_place(out, *keys, FRAME_PART, [F.col(c) for c in order]).drop(FRAME_PART).withColumns({
        "head_x": F.col("head_u") / width, "head_y": F.col("head_v") / height,
        "tail_x": F.col("tail_u") / width, "tail_y": F.col("tail_v") / height})


def clean_windows(tracks: DataFrame, settings: WindowSettings) -> DataFrame:
    return explode_windows(tracks, settings)


WIN = ["swing_id", "view_id", "win_start"]


def window_view_labels(wins: DataFrame) -> DataFrame:
    """Most frequent camera name per window as a view label; ties go to the first name."""
    counts = wins.groupBy(*WIN, "camera_name").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy(*WIN).agg(F.min_by("camera_name", F.struct(-F.col("c"), F.col("camera_name"))).alias("camera_name"))
    return top.select(*WIN, S.view_label(F.col("camera_name")).alias("view_label"))


def gaussian_corrupt(wins: DataFrame, s: CorruptionSettings = CorruptionSettings(),
                     width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT) -> DataFrame:
    """Add pixel noise to all four coordinates; every point stays observed."""
    key = [F.col(c) for c in (*WIN, "idx")]
    out = {}
    for c, size in (("head_x", width), ("head_y", height), ("tail_x", width), ("tail_y", height)):
        out[f"obs_{c}"] = S.clamp(F.col(c) + R.normal(s.seed, f"noise.{c}", *key) * (s.noise_px / size), 0.0, 1.0)
    return wins.withColumns({**out, "obs_head_conf": F.lit(s.head_conf), "obs_tail_conf": F.lit(s.tail_conf),
                             "obs_head_seen": F.lit(True), "obs_tail_seen": F.lit(True)})


def error_windows(frames: DataFrame, settings: WindowSettings) -> DataFrame:
    """Pool of real error sequences, one row per (window, row), numbered by ``pool_id``.

    ``frames``: one row per frame with pos, n, head/tail dx, dy, pred_x, pred_y,
    pred_conf, status and visibility.
    """
    cols = {}
    for k in ("head", "tail"):
        dx, dy = S.finite(F.col(f"{k}_dx")), S.finite(F.col(f"{k}_dy"))
        ok = S.observed(F.col(f"{k}_pred_x"), F.col(f"{k}_pred_y"), F.col(f"{k}_pred_conf")) & dx.isNotNull() & dy.isNotNull()
        cols.update({f"{k}_err_seen": ok, f"{k}_err_x": F.when(ok, dx / settings.width), f"{k}_err_y": F.when(ok, dy / settings.height),
                     f"{k}_err_conf": F.when(ok, F.col(f"{k}_pred_conf")).otherwise(0.0)})
    keep = ["head_status", "tail_status", "head_visibility", "tail_visibility"]
    wins = explode_windows(frames.withColumns(cols).select("swing_id", "frame_idx", "pos", "n", *cols, *keep), settings)
    ids = wins.filter(F.col("idx") == 0).select("swing_id", "win_start", F.lit(0).alias("__all"), F.md5(
        F.concat_ws("|", "swing_id", F.col("win_start").cast("string")).cast("binary")).alias("__h"))
    ids = with_positions(ids, ["__all"], [F.substring("__h", 1, 3)], [F.col("__h"), F.col("swing_id"), F.col("win_start")], pos="pool_id")
    return wins.drop("n").join(ids.select("swing_id", "win_start", "pool_id", F.col("n").alias("pool_size")), ["swing_id", "win_start"])


def draw_pool(wins: DataFrame, pool: DataFrame, s: CorruptionSettings = CorruptionSettings()) -> DataFrame:
    """Add ``pool_id``: a keyed uniform draw per window from 0..pool size - 1."""
    size = pool.agg(F.max("pool_size")).scalar()
    u = R.uniform(s.seed, "pool", *[F.col(c) for c in WIN])
    return wins.withColumn("pool_id", F.floor(u * size).cast("bigint"))


WEIGHT_UNIT = 1_000_000


def weighted_ranges(pool: DataFrame, weight: Column) -> DataFrame:
    """(pool_id, lo, hi): each pool window's share of the whole numbers below the total weight.

    Weights count in millionths, so running sums are whole numbers and do not depend on partitioning. Sums run
    inside bins of 4,096 windows, and over one row per bin. ``weight`` is read from a window's first row; windows
    without a positive weight are never drawn and have no range.
    """
    units = F.greatest(F.bround(F.coalesce(S.finite(weight.cast("double")), F.lit(0.0)) * WEIGHT_UNIT).cast("bigint"), F.lit(0))
    rows = pool.filter(F.col("idx") == 0).select("pool_id", units.alias("units"), F.floor(F.col("pool_id") / 4096).alias("__bin")).filter("units > 0")
    before = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("__bin").agg(F.sum("units").alias("__sum")).select("__bin", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__skip"))
    inside = Window.partitionBy("__bin").orderBy("pool_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("__upto", F.sum("units").over(inside)).join(bins, "__bin")
    hi = F.col("__skip") + F.col("__upto")
    return ranked.select("pool_id", (hi - F.col("units")).alias("lo"), hi.alias("hi"))


def draw_weighted(wins: DataFrame, pool: DataFrame, weight: Column, s: CorruptionSettings = CorruptionSettings(), *, payload: DataFrame | None = None) -> DataFrame:
    """Each window draws a pool window with a chance in proportion to its weight: adds ``pool_id``.

    A keyed whole number below the total weight is looked up in the ranges through an equi-join on bins, as many as there are windows
    in the pool. A heavy window lies in many bins, so also its draws are dealt out. With ``payload`` (rows per pool_id and idx) the
    drawn window's rows come along from the bin. A pool without any weight fails the query.
    """
    ranges = materialised(weighted_ranges(pool, weight))
    facts = ranges.agg(F.max("hi").alias("total"), F.count(F.lit(1)).alias("n"))
    total = F.coalesce(facts.select("total").scalar(), F.raise_error(F.lit("no pool window has a weight")).cast("bigint"))
    size = F.ceil(total / facts.select("n").scalar())
    u = R.uniform(s.seed, "pool", *[F.col(c) for c in WIN])
    drawn = wins.withColumn("__at", F.floor(u * total).cast("bigint")).withColumn("__bin", F.floor(F.col("__at") / size))
    spread = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    keys = ["__bin"]
    if payload is not None:
        spread = spread.join(payload, "pool_id")
        keys = ["__bin", "idx"]
    met = drawn.join(spread, keys)
    return met.filter((F.col("__at") >= F.col("lo")) & (F.col("__at") < F.col("hi"))).drop("__at", "__bin", "lo", "hi")


def replay_corrupt(wins: DataFrame, pool: DataFrame, s: CorruptionSettings = CorruptionSettings(), *, weight: Column | None = None) -> DataFrame:
    """Each clean window draws one pool window and takes over its errors and misses.

    Without ``weight`` every pool window is as likely: the draw is a hash modulo the pool size, then an equi-join on
    (pool_id, idx). With it (a column of the pool) see ``draw_weighted``.
    """
    err = pool.select("pool_id", "idx", *[f"{k}_err_{f}" for k in ("head", "tail") for f in ("seen", "x", "y", "conf")])
    out = draw_pool(wins, pool, s).join(err, ["pool_id", "idx"]) if weight is None else draw_weighted(wins, pool, weight, s, payload=err)
    cols = {}
    for k in ("head", "tail"):
        seen = F.col(f"{k}_err_seen")
        cols[f"obs_{k}_seen"] = seen
        cols[f"obs_{k}_conf"] = F.when(seen, F.col(f"{k}_err_conf")).otherwise(0.0)
        for a in ("x", "y"):
            cols[f"obs_{k}_{a}"] = F.when(seen, S.clamp(F.col(f"{k}_{a}") + F.col(f"{k}_err_{a}"), 0.0, 1.0))
    return out.withColumns(cols).drop(*[f"{k}_err_{f}" for k in ("head", "tail") for f in ("seen", "x", "y", "conf")], "pool_id")


def _block(u_bucket: Column, u_len: Column, s: CorruptionSettings, size: int) -> Column:
    p0, p1, _ = s.length_probs
    (a0, b0), (a1, b1), (a2, b2) = s.length_ranges
    length = F.when(u_bucket < p0, R.integer(u_len, a0, b0)).when(u_bucket < p0 + p1, R.integer(u_len, a1, b1)).otherwise(R.integer(u_len, a2, b2))
    return F.least(length, F.lit(size))


def _label(u: Column, s: CorruptionSettings) -> Column:
    p0, p1, _ = s.label_probs
    return F.when(u < p0, "partially_occluded").when(u < p0 + p1, "fully_occluded").otherwise("ignore")


def late_biased_start(u: Column, m: Column) -> Column:
    """Start in 0..m-1 with weights rising linearly from 0.5 to 1.5.

    The running weight of the first k starts is k/2 + k(k-1)/(2(m-1)); the draw is the
    first k whose running weight exceeds u times the total m.
    """
    d = F.greatest(m - 1, F.lit(1)).cast("double")
    target = u * m
    b = 0.5 - 0.5 / d
    k = (-b + F.sqrt(b * b + 2.0 * target / d)) * d
    return F.when(m <= 1, 0).otherwise(F.least(F.floor(k), m - 1)).cast("int")


def occlusion_draws(keys: DataFrame, s: CorruptionSettings = CorruptionSettings(), size: int = 31) -> DataFrame:
    """Per window: start, length and label of up to two occlusion blocks."""
    key = [F.col(c) for c in WIN]

    def u(name):
        return R.uniform(s.seed, name, *key)
    first = u("occ.any") < s.block_prob
    out = keys.select(*WIN).withColumns({
        "len1": F.when(first, _block(u("occ.bucket"), u("occ.len"), s, size)),
        "second": first & (u("occ.again") < s.second_prob)})
    out = out.withColumn("len2", F.when(F.col("second"), _block(u("occ2.bucket"), u("occ2.len"), s, size)))
    m1, m2 = size - F.col("len1") + 1, size - F.col("len2") + 1
    start1 = late_biased_start(u("occ.start"), m1) if s.late_bias else F.floor(u("occ.start") * m1).cast("int")
    return out.select(
        *WIN, F.when(F.col("len1").isNotNull(), start1).alias("start1"), "len1", F.when(F.col("len1").isNotNull(), _label(u("occ.label"), s)).alias("label1"),
        F.when(F.col("second"), F.floor(u("occ2.start") * m2).cast("int")).alias("start2"), "len2",
        F.when(F.col("second"), _label(u("occ2.label"), s)).alias("label2"))


def synthetic_labels(draws: DataFrame, wins: DataFrame) -> DataFrame:
    """Label every row of a window from its blocks; the second block overrides."""
    out = wins.join(draws, WIN)
    in1 = (F.col("idx") >= F.col("start1")) & (F.col("idx") < F.col("start1") + F.col("len1"))
    in2 = (F.col("idx") >= F.col("start2")) & (F.col("idx") < F.col("start2") + F.col("len2"))
    return out.withColumn("drawn_label", F.when(in2, F.col("label2")).when(in1, F.col("label1")).otherwise("fully_visible")).drop(
        "start1", "len1", "label1", "start2", "len2", "label2")


def with_real_labels(frames: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add ``real_label``, the known visibility of a frame or NULL; fewer rows move before frames are exploded into windows."""
    known = lookup.filter(F.col("visibility").isin("fully_visible", "partially_occluded", "fully_occluded", "ignore"))
    return frames.join(known.withColumnRenamed("visibility", "real_label"), ["swing_id", "frame_idx"], "left")


def visibility_labels(wins: DataFrame, lookup: DataFrame | None, s: CorruptionSettings = CorruptionSettings(), size: int = 31) -> DataFrame:
    """Real labels where a window has enough of them, drawn ones elsewhere.

    Real labels come from ``lookup``, or with the rows (``with_real_labels``). The rows are dealt out by window once, for the drawn
    labels, and counted there.
    """
    if lookup is not None:
        wins = with_real_labels(wins, lookup)
    keys = wins.filter(F.col("idx") == 0)
    labelled = synthetic_labels(occlusion_draws(keys, s, size), wins)
    if "real_label" not in wins.columns:
        return labelled.withColumnRenamed("drawn_label", "label")
    coverage = F.count("real_label").over(Window.partitionBy(*WIN))
    return labelled.withColumn("found", coverage).withColumn(
        "label", F.when(F.col("found") >= s.min_coverage * size, F.coalesce("real_label", F.lit("fully_visible"))).otherwise(F.col("drawn_label"))
    ).drop("real_label", "drawn_label")


def apply_occlusion(wins: DataFrame, s: CorruptionSettings = CorruptionSettings(),
                    width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT) -> DataFrame:
    """Mask the tail, or lower its confidence and add noise, by row label."""
    key = [F.col(c) for c in (*WIN, "idx")]
    label, seen = F.col("label"), F.col("obs_tail_seen")
    hidden = label != "fully_visible"
    u = R.uniform(s.seed, "mask", *key)
    limit = F.when(label == "partially_occluded", s.partial_mask).when(label == "fully_occluded", s.hidden_mask).otherwise(1.0 - s.ignore_keep)
    masked = hidden & (~seen | (u < limit))

    def by_label(v):
        return F.when(label == "partially_occluded", v[0]).when(label == "fully_occluded", v[1]).otherwise(v[2])
    softened = hidden & ~masked
    noise = by_label(s.extra_noise_px)
    out = {
        "tail_conf": F.when(masked, 0.0).when(softened, F.least(F.col("obs_tail_conf"), by_label(s.conf_caps))).otherwise(F.col("obs_tail_conf")),
        "tail_seen": seen & ~masked, "tail_weight": S.visibility_weight(label, s.weights)}
    for a, size in (("x", width), ("y", height)):
        base = F.col(f"obs_tail_{a}")
        out[f"pseudo_tail_{a}"] = F.when(softened, S.clamp(base + R.normal(s.seed, f"extra.{a}", *key) * noise / size, 0.0, 1.0)).otherwise(base)
    rows = wins.withColumns(out)
    return rows.withColumn("tail_status", S.status_from_visibility(label, F.col("tail_seen")))
