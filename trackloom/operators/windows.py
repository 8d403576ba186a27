"""Overlapping row windows and the fixed-order observation features.

The naive plan explodes every frame into its ~6 windows, shuffles the copies and
runs window functions per copy. Here everything that depends on neighbours is
computed once per frame (nearest known row on each side, the two rows before) in
bounded blocks; the explode comes last and only column arithmetic follows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators.sequence import block_window, fill_linear, frame_positions, with_halo
from trackloom.schemas import (
    FEATURES_25, FEATURES_45, FLOW_FEATURES, FLOW_SOURCE_COLUMNS, WindowSettings,
)

OBSERVATION_COLUMNS = tuple(f"{k}_pred_{f}" for k in ("head", "tail") for f in ("x", "y", "conf"))


def window_starts(pos: Column, n: Column, size: int, stride: int, include_first: bool) -> Column:
    """Array of the starts of all tail-aligned windows that cover ``pos``."""
    last = n - size
    k_min = F.greatest(F.ceil((last - pos) / stride), F.lit(0))
    k_max = F.floor((last - F.greatest(pos - (size - 1), F.lit(0))) / stride)
    regular = F.when(k_min <= k_max, F.transform(F.sequence(k_min, k_max), lambda k: last - k * stride)).otherwise(
        F.array().cast("array<bigint>"))
    if include_first:
        extra = F.when((last % stride != 0) & (pos < size), F.array(F.lit(0).cast("bigint")))
        regular = F.concat(regular, F.coalesce(extra, F.array().cast("array<bigint>")))
    return F.when(n >= size, regular).otherwise(F.array().cast("array<bigint>"))


def explode_windows(df: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """One row per (frame, covering window); needs ``pos`` and ``n``."""
    starts = window_starts(F.col("pos"), F.col("n"), settings.size, settings.stride, settings.include_first)
    return (
        df.withColumn("win_start", F.explode(starts))
        .withColumn("idx", (F.col("pos") - F.col("win_start")).cast("int"))
    )


def _neighbours(df: DataFrame, point: str, reach: int, w: WindowSpec) -> DataFrame:
    """Add the nearest known (pos, x, y) at or before and at or after each row, at most ``reach`` rows away.

    A window is no longer than that. Both frames have one order, so a part of ``w`` is sorted once.
    """
    known = F.when(F.col(f"{point}_ok"), F.struct(
        F.col("pos").alias("p"), F.col(f"{point}_x").alias("x"), F.col(f"{point}_y").alias("y")))
    return df.withColumns({
        f"{point}_prev": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        f"{point}_next": F.first(known, ignorenulls=True).over(w.rowsBetween(0, reach))})


def _filled(prev: Column, nxt: Column, pos: Column, start: Column, size: int) -> Column:
    """Nearest known point inside the window; ties go to the earlier row, none is NULL."""
    earlier = F.when(prev["p"] >= start, prev)
    later = F.when(nxt["p"] < start + size, nxt)
    closer = F.coalesce(earlier["p"] + later["p"] < pos * 2, F.lit(False))
    return F.when(closer, later).otherwise(F.coalesce(earlier, later))


def normalised_observations(df: DataFrame, settings: WindowSettings) -> DataFrame:
    """Pixel predictions to normalised points, confidences and validity flags."""
    flip = F.coalesce(F.col("flip"), F.lit(False))
    out = {}
    for k in ("head", "tail"):
        x, y, c = (S.finite(F.col(f"{k}_pred_{f}").cast("double")) for f in ("x", "y", "conf"))
        ok = S.observed(x, y, c)
        out[f"{k}_ok"] = ok
        out[f"{k}_x"] = S.mirrored_x(x / settings.width, flip)
        out[f"{k}_y"] = y / settings.height
        out[f"{k}_c"] = F.when(ok, c).otherwise(0.0)
    return df.withColumns(out)


def observation_windows(
    df: DataFrame, settings: WindowSettings = WindowSettings(), *,
    carry: Sequence[str] = (), use_flow: bool = False, keep_block: bool = False, tasks: int | None = None,
) -> DataFrame:
    """25 (or 45) features per (sequence, window, row).

    Reads only swing_id, image_stem, frame_idx, view_label, flip, the six prediction
    columns and, with ``use_flow``, the twenty flow columns. ``carry`` columns travel
    along unread, so annotation columns cannot influence a feature. With ``keep_block`` the column by
    which rows are dealt out stays, and an aggregate by it and the frame moves no window rows.
    """
    inputs = ["swing_id", "image_stem", "frame_idx", "view_label", "flip", *OBSERVATION_COLUMNS]
    if use_flow:
        inputs += list(FLOW_SOURCE_COLUMNS)
    passed = F.struct(*[F.col(c) for c in carry]).alias("ctx") if carry else F.lit(None).cast("string").alias("ctx")
    has_pos = "pos" in df.columns and "n" in df.columns
    base = df.select(*inputs, *(["pos", "n"] if has_pos else []), passed)
    if not has_pos:
        base = frame_positions(base, tasks=tasks)
    base = normalised_observations(base, settings)
    reach = settings.size - 1
    rows = with_halo(base, before=reach, after=reach, tasks=tasks)
    rows = _with_sides(rows, reach, block_window()).filter(~F.col("is_halo"))
    wins = explode_windows(rows, settings)
    return _features(wins, settings, use_flow, ["block"] if keep_block else [])


def _with_sides(rows: DataFrame, reach: int, w: WindowSpec) -> DataFrame:
    """Nearest known points of a row (``s0``) and of the two rows before it (``s1``, ``s2``)."""
    rows = _neighbours(_neighbours(rows, "head", reach, w), "tail", reach, w)
    sides = F.struct("head_prev", "head_next", "tail_prev", "tail_next")
    return rows.withColumn("s0", sides).withColumns({"s1": F.lag("s0", 1).over(w), "s2": F.lag("s0", 2).over(w)})


def features_in_windows(wins: DataFrame, keys: Sequence[str], settings: WindowSettings = WindowSettings()) -> DataFrame:
    """25 features of rows that already are rows of windows, each with observations of its own.

    ``wins`` has what ``explode_windows`` adds, the inputs of ``observation_windows`` and ``ctx``. ``keys`` name a window and stay as they
    are, so rows that are dealt out by them are not moved again.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = _with_sides(normalised_observations(wins, settings), settings.size - 1, w)
    return _features(rows, settings, False, [k for k in keys if k not in ("swing_id", "win_start")])


def _features(wins: DataFrame, settings: WindowSettings, use_flow: bool, also: Sequence[str] = ()) -> DataFrame:
    size, width, height = settings.size, settings.width, settings.height
    diagonal = (width * width + height * height) ** 0.5
    pos, start = F.col("pos"), F.col("win_start")
    picks = {}
    for lag in (0, 1, 2):
        s = F.col(f"s{lag}")
        for k in ("head", "tail"):
            picks[f"{k[0]}{lag}"] = _filled(s[f"{k}_prev"], s[f"{k}_next"], pos - lag, start, size)
    wins = wins.select(
        "swing_id", *also, "win_start", "idx", "pos", "n", "frame_idx", "image_stem", "view_label", "ctx",
        "head_c", "tail_c", "head_ok", "tail_ok",
        *([c for c in FLOW_SOURCE_COLUMNS] if use_flow else []),
        *(["flip"] if use_flow else []),
        *[e.alias(n) for n, e in picks.items()])
    wins = wins.withColumns({
        f"{k}{axis}{lag}": F.coalesce(F.col(f"{k}{lag}.{axis}"), F.lit(0.0))
        for k in "ht" for axis in "xy" for lag in (0, 1, 2)})
    c = F.col
    geo = {}
    for lag in (0, 1):
        dx = (c(f"tx{lag}") - c(f"hx{lag}")) * width
        dy = (c(f"ty{lag}") - c(f"hy{lag}")) * height
        geo[f"vx{lag}"], geo[f"vy{lag}"] = dx, dy
        geo[f"len{lag}"] = F.hypot(dx, dy)
    wins = wins.withColumns(geo)
    unit = {}
    for lag in (0, 1):
        ok = c(f"len{lag}") > 1e-6
        unit[f"ux{lag}"] = F.when(ok, c(f"vx{lag}") / c(f"len{lag}")).otherwise(0.0)
        unit[f"uy{lag}"] = F.when(ok, c(f"vy{lag}") / c(f"len{lag}")).otherwise(0.0)
    wins = wins.withColumns(unit)
    later, third = c("idx") >= 1, c("idx") >= 2
    dot = S.clamp(c("ux0") * c("ux1") + c("uy0") * c("uy1"), -1.0, 1.0)
    both = (c("len0") > 1e-6) & (c("len1") > 1e-6)

    def speed(k: str) -> Column:
        step = F.hypot((c(f"{k}x0") - c(f"{k}x1")) * width, (c(f"{k}y0") - c(f"{k}y1")) * height)
        return F.when(later, step / diagonal).otherwise(0.0)

    def acceleration(k: str) -> Column:
        ax = (c(f"{k}x0") - 2.0 * c(f"{k}x1") + c(f"{k}x2")) * width
        ay = (c(f"{k}y0") - 2.0 * c(f"{k}y1") + c(f"{k}y2")) * height
        return F.when(third, F.hypot(ax, ay) / diagonal).otherwise(0.0)

    values = [
        c("hx0"), c("hy0"), c("tx0"), c("ty0"), c("head_c"), c("tail_c"),
        c("head_ok").cast("double"), c("tail_ok").cast("double"),
        c("tx0") - c("hx0"), c("ty0") - c("hy0"),
        c("len0") / diagonal,
        F.when(later, (c("len0") - c("len1")) / diagonal).otherwise(0.0),
        c("ux0"), c("uy0"),
        F.when(later & both, 1.0 - dot).otherwise(0.0),
        speed("h"), speed("t"), acceleration("h"), acceleration("t"),
        -1.0 + 2.0 * c("idx") / max(size - 1, 1),
        *S.view_one_hot(c("view_label")).values(),
    ]
    names = list(FEATURES_25)
    if use_flow:
        for source in FLOW_SOURCE_COLUMNS:
            v = S.flow_feature(source, S.finite(c(source).cast("double")), settings.flow_clip_px)
            if "flow_x" in source:
                v = F.when(F.coalesce(c("flip"), F.lit(False)), -v).otherwise(v)
            values.append(v)
        names = list(FEATURES_45)
    keep = ["swing_id", *also, "win_start", "idx", "pos", "n", "frame_idx", "image_stem", "ctx"]
    # the two region flags share names with detector flags, so ids come last in the select
    return wins.select(
        *keep, c("head_ok").alias("head_seen"), c("tail_ok").alias("tail_seen"),
        *[v.cast("double").alias(n) for n, v in zip(names, values)])


def supervised_windows(
    df: DataFrame, settings: WindowSettings = WindowSettings(), *,
    carry: Sequence[str] = (), use_flow: bool = False, keep_block: bool = False, tasks: int | None = None,
) -> DataFrame:
    """Observation windows plus targets: true points filled over the whole sequence.

    Targets are mirrored, marked valid, then gap-filled; they ride along as ``ctx``.
    """
    targets = target_rows(frame_positions(df, tasks=tasks), settings, tasks=tasks)
    extra = ["target_valid", "gt_head_x", "gt_head_y", "gt_tail_x", "gt_tail_y",
             "head_visibility", "tail_visibility", *carry]
    return observation_windows(targets, settings, carry=list(dict.fromkeys(extra)), use_flow=use_flow, keep_block=keep_block, tasks=tasks)


def target_rows(df: DataFrame, settings: WindowSettings = WindowSettings(), *, tasks: int | None = None) -> DataFrame:
    """target_valid and filled normalised true points; needs ``pos``."""
    flip = F.coalesce(F.col("flip"), F.lit(False))
    norm = {}
    for k in ("head", "tail"):
        norm[f"gt_{k}_x"] = S.mirrored_x(S.finite(F.col(f"{k}_gt_x").cast("double")) / settings.width, flip)
        norm[f"gt_{k}_y"] = S.finite(F.col(f"{k}_gt_y").cast("double")) / settings.height
    out = df.withColumns(norm).withColumns({
        "head_visibility": S.known_visibility(F.col("head_visibility")),
        "tail_visibility": S.known_visibility(F.col("tail_visibility")),
    })
    known = F.col("tail_visibility") != "ignore"
    for name in norm:
        known = known & F.col(name).isNotNull()
    out = out.withColumn("target_valid", known)
    return fill_linear(out, list(norm), tasks=tasks)


def pack_windows(wins: DataFrame, features: Sequence[str], extra: Sequence[str] = (), keys: Sequence[str] = ("swing_id", "win_start")) -> DataFrame:
    """One row per window with arrays in row order (at most ``size`` rows each)."""
    row = F.struct(
        F.col("idx"), F.col("frame_idx"), F.array(*[F.col(f) for f in features]).alias("x"),
        *[F.col(c) for c in extra])
    packed = wins.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("r"))
    return packed.select(
        *keys, F.col("r.x").alias("x"),
        *[F.col(f"r.{c}").alias(c) for c in extra],
        F.element_at("r", 1)["frame_idx"].alias("start_frame_idx"),
        F.element_at("r", -1)["frame_idx"].alias("end_frame_idx"))


def legacy_features(df: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Nineteen columns per frame of a sequence, without gap fill (missing is 0)."""
    diagonal = (settings.width ** 2 + settings.height ** 2) ** 0.5
    base = normalised_observations(df, settings)
    if "pos" not in base.columns:
        base = frame_positions(base)
    rows = with_halo(base, before=2, after=0)
    w = block_window()
    pts = ["head_x", "head_y", "tail_x", "tail_y"]
    rows = rows.withColumns({p: F.coalesce(F.col(p), F.lit(0.0)) for p in pts})
    rows = rows.withColumns({f"{p}_{k}": F.lag(p, k).over(w) for p in pts for k in (1, 2)})
    rows = rows.filter(~F.col("is_halo"))
    c = F.col
    geo = {}
    for k, sfx in ((0, ""), (1, "_1")):
        geo[f"vx{k}"] = (c(f"tail_x{sfx}") - c(f"head_x{sfx}")) * settings.width
        geo[f"vy{k}"] = (c(f"tail_y{sfx}") - c(f"head_y{sfx}")) * settings.height
    rows = rows.withColumns(geo).withColumns({f"len{k}": F.hypot(f"vx{k}", f"vy{k}") for k in (0, 1)})
    later, third = c("pos") >= 1, c("pos") >= 2
    ok0, ok1 = c("len0") > 1e-6, c("len1") > 1e-6
    dot = S.clamp((c("vx0") * c("vx1") + c("vy0") * c("vy1")) / (c("len0") * c("len1")), -1.0, 1.0)

    def speed(k):
        return F.when(later, F.hypot((c(f"{k}_x") - c(f"{k}_x_1")) * settings.width,
                                     (c(f"{k}_y") - c(f"{k}_y_1")) * settings.height) / diagonal).otherwise(0.0)

    def acceleration(k):
        return F.when(third, F.hypot(
            (c(f"{k}_x") - 2.0 * c(f"{k}_x_1") + c(f"{k}_x_2")) * settings.width,
            (c(f"{k}_y") - 2.0 * c(f"{k}_y_1") + c(f"{k}_y_2")) * settings.height) / diagonal).otherwise(0.0)

    values = [
        c("head_x"), c("head_y"), c("tail_x"), c("tail_y"), c("head_c"), c("tail_c"),
        c("head_ok").cast("double"), c("tail_ok").cast("double"),
        c("tail_x") - c("head_x"), c("tail_y") - c("head_y"),
        c("len0") / diagonal, F.when(later, (c("len0") - c("len1")) / diagonal).otherwise(0.0),
        F.when(ok0, c("vx0") / c("len0")).otherwise(0.0), F.when(ok0, c("vy0") / c("len0")).otherwise(0.0),
        F.when(later & ok0 & ok1, 1.0 - dot).otherwise(0.0),
        speed("head"), speed("tail"), acceleration("head"), acceleration("tail"),
    ]
    return rows.select("swing_id", "image_stem", "frame_idx", "pos",
                       *[v.cast("double").alias(n) for n, v in zip(FEATURES_25[:19], values)])


def check_finite_flow(df: DataFrame) -> DataFrame:
    """Rows whose normalised flow columns are not finite (must be empty)."""
    bad = None
    for name in FLOW_FEATURES:
        b = S.finite(F.col(name)).isNull()
        bad = b if bad is None else bad | b
    return df.filter(bad)
