"""Error statistics over overlapping groups of frames.

A frame belongs to several groups. Frames are summed by their whole list of groups, of which there are
a few dozen, and only these sums are exploded into groups. Quantiles use
``group_quantiles``. Groups come from a fixed list, so empty ones are reported too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators.quantiles import group_quantiles
from trackloom.schemas import IMAGE_HEIGHT, IMAGE_WIDTH, VISIBILITIES

BASE_GROUPS = ("all", "raw_matched", "raw_missing", "obs_valid", "obs_missing",
               "raw_error_lt5", "raw_error_5_10", "raw_error_10_20", "raw_error_gt20")
GROUPS = BASE_GROUPS + VISIBILITIES
TRUST_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.000001)
TRUST_LABELS = ("0.0_0.2", "0.2_0.4", "0.4_0.6", "0.6_0.8", "0.8_1.0")


def frame_errors(frames: DataFrame, width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT) -> DataFrame:
    """Pixel errors of the tail series, shift and step length; needs scored frames.

    Rounded to 1e-9 px: averaged points differ in the last bit with the order of the
    sum, and error limits (20 px and so on) must not depend on it.
    """
    def err(ax, ay, bx="gt_tail_x", by="gt_tail_y"):
        return F.round(F.hypot((F.col(ax) - F.col(bx)) * width, (F.col(ay) - F.col(by)) * height), 9)
    return frames.withColumns({
        "raw_error": err("raw_tail_x", "raw_tail_y"),
        "filled_error": err("filled_x", "filled_y"),
        "prior_error": err("prior_x", "prior_y"),
        "final_error": err("final_x", "final_y"),
        "corrected_error": err("corrected_x", "corrected_y"),
        "final_shift": err("final_x", "final_y", "filled_x", "filled_y"),
        "delta_mag": F.hypot("delta_x", "delta_y")})


def group_array(families: Sequence[str] = ("base", "visibility")) -> Column:
    """Names of all groups a frame is in (columns raw_valid, obs_valid, target_valid,
    raw_error, head_visibility, tail_visibility)."""
    e = F.when(F.col("raw_valid") & F.col("target_valid"), S.finite(F.col("raw_error")))
    masks = []
    if "base" in families:
        masks += [
            F.lit("all"), F.when(F.col("raw_valid"), "raw_matched").otherwise("raw_missing"),
            F.when(F.col("obs_valid"), "obs_valid").otherwise("obs_missing"),
            F.when(e < 5, "raw_error_lt5").when(e < 10, "raw_error_5_10").when(e < 20, "raw_error_10_20").when(e >= 20, "raw_error_gt20")]
    if "visibility" in families:
        masks.append(F.col("tail_visibility"))
    if "head_visibility" in families:
        masks.append(F.concat(F.lit("head_"), F.col("head_visibility")))
    if "tail_visibility" in families:
        masks.append(F.concat(F.lit("tail_"), F.col("tail_visibility")))
    return F.array_compact(F.array(*masks))


def in_groups(df: DataFrame, groups: Column | None = None) -> DataFrame:
    return df.withColumn("grp", F.explode(groups if groups is not None else group_array()))


def fixed_rows(df: DataFrame, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """All combinations of fixed names as a table, for reporting empty groups."""
    spark = df.sparkSession
    out = spark.range(1).select(*[F.array(*[F.lit(v) for v in vs]).alias(k) for k, vs in lists.items()])
    for k in lists:
        out = out.withColumn(k, F.explode(k))
    return out


def complete(stats: DataFrame, lists: Mapping[str, Sequence[str]], counts: Sequence[str] = ("count",)) -> DataFrame:
    """Left join onto the fixed combinations; missing counts become 0."""
    out = fixed_rows(stats, lists).join(F.broadcast(stats), list(lists), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def moment_stats(x: Column) -> list[Column]:
    """count, rmse, mae, share over 20 and over 40 of non-null values."""
    return [
        F.count(x).alias("count"), F.sqrt(F.avg(x * x)).alias("rmse"), F.avg(F.abs(x)).alias("mae"),
        F.avg((x > 20).cast("double")).alias("gt20"), F.avg((x > 40).cast("double")).alias("gt40")]


def error_stats(df: DataFrame, keys: Sequence[str], value: str, *, few_groups: bool = False) -> DataFrame:
    """count, rmse, mae, p90, gt20, gt40 per key. NULL is absent; NaN poisons its group."""
    keys = list(keys)
    sums = df.groupBy(*keys).agg(*moment_stats(F.col(value)), F.coalesce(F.bool_or(F.isnan(value)), F.lit(False)).alias("__nan"))
    q = group_quantiles(df, keys, {"v": F.col(value)}, {"p90": 0.9}, few_groups=few_groups)
    q = F.broadcast(q) if few_groups else q
    out = sums.join(q, keys, "left").withColumnRenamed("v_p90", "p90")
    return out.select(*keys, "count", "rmse", "mae", F.when(F.col("__nan"), F.lit(float("nan"))).otherwise(F.col("p90")).alias("p90"), "gt20", "gt40")


def scalar_stats(df: DataFrame, keys: Sequence[str], value: str, *, few_groups: bool = False) -> DataFrame:
    """count, mean, median, p10, p90 of the finite values per key."""
    keys = list(keys)
    v = S.finite(F.col(value))
    sums = df.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"))
    q = group_quantiles(df, keys, {"v": F.col(value)}, {"median": .5, "p10": .1, "p90": .9}, few_groups=few_groups)
    q = F.broadcast(q) if few_groups else q
    return sums.join(q, keys, "left").select(
        *keys, "count", "mean", F.col("v_median").alias("median"), F.col("v_p10").alias("p10"), F.col("v_p90").alias("p90"))


def component_stats(df: DataFrame, keys: Sequence[str], value: str, *, few_groups: bool = False) -> DataFrame:
    """Signed component: mean, mae, rmse, median and p90 of |x|, shares over 5/10/20."""
    keys = list(keys)
    v = S.finite(F.col(value))
    a = F.abs(v)
    sums = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean_signed"), F.avg(a).alias("mae"), F.sqrt(F.avg(v * v)).alias("rmse"),
        *[F.avg((a > t).cast("double")).alias(f"gt{t}") for t in (5, 10, 20)])
    q = group_quantiles(df, keys, {"v": F.abs(F.col(value))}, {"median_abs": .5, "p90_abs": .9}, few_groups=few_groups)
    q = F.broadcast(q) if few_groups else q
    return sums.join(q, keys, "left").withColumnsRenamed({"v_median_abs": "median_abs", "v_p90_abs": "p90_abs"})


SERIES = ("raw", "filled", "prior", "final")


def series_rows(frames: DataFrame) -> DataFrame:
    """(series, error) rows: raw needs raw_valid, every series needs target_valid."""
    t = F.col("target_valid")
    pairs = F.array(*[
        F.struct(F.lit(s).alias("series"), F.when(t & F.col("raw_valid") if s == "raw" else t, F.col(f"{s}_error")).alias("error"))
        for s in SERIES])
    return frames.select("*", F.inline(pairs)).filter(F.col("error").isNotNull())


def member_sums(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], groups: str = "groups") -> DataFrame:
    """Sums per (keys, grp) of rows that are in several groups.

    Rows are summed by their whole list of groups, a few dozen lists; only these sums are exploded.
    """
    by_list = rows.groupBy(*keys, groups).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return by_list.withColumn("grp", F.explode(groups)).groupBy(*keys, "grp").agg(*[F.sum(n).alias(n) for n in sums])


def error_by_group(frames: DataFrame) -> DataFrame:
    """``error_stats`` per series and group of frames."""
    rows = series_rows(frames.withColumn("groups", group_array())).select("series", "groups", "error")
    e, n = F.col("error"), F.col("count")
    sums = member_sums(rows, ["series"], {
        "count": F.lit(1), "squares": e * e, "sizes": F.abs(e), "over20": (e > 20).cast("bigint"), "over40": (e > 40).cast("bigint"),
        "nan": F.isnan(e).cast("bigint")})
    q = group_quantiles(rows, ["series"], {"v": e}, {"p90": 0.9}, member="groups")
    stats = sums.join(F.broadcast(q), ["series", "grp"], "left").select(
        "series", "grp", n, F.sqrt(F.col("squares") / n).alias("rmse"), (F.col("sizes") / n).alias("mae"),
        F.when(F.col("nan") > 0, F.lit(float("nan"))).otherwise(F.col("v_p90")).alias("p90"),
        (F.col("over20") / n).alias("gt20"), (F.col("over40") / n).alias("gt40"))
    return complete(stats, {"series": SERIES, "grp": GROUPS})


def mean_and_quantiles(frames: DataFrame, value: str) -> DataFrame:
    """count, mean, p50, p90 per group of rows where ``value`` is not NULL."""
    rows = frames.select(group_array().alias("groups"), F.col(value).alias("v")).filter(F.col("v").isNotNull())
    sums = member_sums(rows, [], {"count": F.lit(1), "total": F.col("v")})
    q = group_quantiles(rows, [], {"v": F.col("v")}, {"p50": .5, "p90": .9}, member="groups")
    out = sums.join(F.broadcast(q), "grp", "left").select(
        "grp", "count", (F.col("total") / F.col("count")).alias("mean"), F.col("v_p50").alias("p50"), F.col("v_p90").alias("p90"))
    return complete(out, {"grp": GROUPS})


def bucket_accuracy(frames: DataFrame) -> DataFrame:
    rows = in_groups(frames.filter(F.col("target_valid") & F.col("raw_valid")).withColumn(
        "true_bucket", S.error_bucket(F.col("raw_error")))).filter(F.col("true_bucket") >= 0)
    names = ("lt5", "5_10", "10_20", "gt20")
    out = rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("count"), F.avg((F.col("bucket_pred") == F.col("true_bucket")).cast("double")).alias("accuracy"),
        *[F.count_if(F.col(c) == i).alias(f"{p}_{n}") for p, c in (("pred", "bucket_pred"), ("true", "true_bucket")) for i, n in enumerate(names)])
    zero = ["count", *[f"{p}_{n}" for p in ("pred", "true") for n in names]]
    return complete(out, {"grp": GROUPS}, zero)


AXIS_FAMILIES = {
    "base": BASE_GROUPS,
    "by_head_visibility": tuple(f"head_{v}" for v in VISIBILITIES),
    "by_tail_visibility": tuple(f"tail_{v}" for v in VISIBILITIES),
}


def axis_rows(frames: DataFrame, width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT) -> DataFrame:
    """u, v, Euclidean head error and quality labels for frames with a usable axis."""
    px = [F.col(c) * s for c, s in (("raw_head_x", width), ("raw_head_y", height), ("gt_head_x", width),
                                    ("gt_head_y", height), ("gt_tail_x", width), ("gt_tail_y", height))]
    u, v, d = S.axis_components(*px)
    out = frames.filter(F.col("target_valid") & F.col("head_valid")).withColumns({"u": u, "v": v, "euclid": d})
    out = out.filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    uq, vq, aq = S.axis_quality(F.col("u"), F.col("v"))
    return out.withColumns({"u_quality": uq, "v_quality": vq, "axis_quality": aq})


def axis_error_summary(frames: DataFrame) -> DataFrame:
    """Per group: u and v statistics, Euclidean statistics, quality counts and rates.

    The unfilled and the filled head are the same point, so one table serves both.
    """
    rows = axis_rows(frames).withColumn("groups", group_array(("base", "head_visibility", "tail_visibility")))
    rows = rows.select("groups", "u", "v", "euclid", "u_quality", "v_quality", "axis_quality")
    labels = {"u": ("ok", "slightly_bad", "bad", "very_bad"), "v": ("ok", "slightly_bad", "bad"),
              "axis": ("ok", "slightly_bad", "bad", "very_bad")}
    e, n = F.col("euclid"), F.col("count")
    sums = {"count": F.lit(1), "__euclid": e, "__euclid2": e * e, "__euclid_gt20": (e > 20).cast("bigint"), "__euclid_gt40": (e > 40).cast("bigint")}
    for c in ("u", "v"):
        x = F.col(c)
        sums |= {f"__{c}": x, f"__{c}_abs": F.abs(x), f"__{c}2": x * x, **{f"__{c}_gt{t}": (F.abs(x) > t).cast("bigint") for t in (5, 10, 20)}}
    counts = ["count"]
    for kind, names in labels.items():
        sums |= {f"{kind}_{name}_count": (F.col(f"{kind}_quality") == name).cast("bigint") for name in names}
        counts += [f"{kind}_{name}_count" for name in names]
    total = member_sums(rows, [], sums)
    out = []
    for c in ("u", "v"):
        out += [(F.col(f"__{c}") / n).alias(f"{c}_mean_signed"), (F.col(f"__{c}_abs") / n).alias(f"{c}_mae"), F.sqrt(F.col(f"__{c}2") / n).alias(f"{c}_rmse"),
                *[(F.col(f"__{c}_gt{t}") / n).alias(f"{c}_gt{t}") for t in (5, 10, 20)]]
    out += [F.sqrt(F.col("__euclid2") / n).alias("euclid_rmse"), (F.col("__euclid") / n).alias("euclid_mae"),
            *[(F.col(f"__euclid_gt{t}") / n).alias(f"euclid_gt{t}") for t in (20, 40)]]
    out += [x for kind, names in labels.items() for name in names for x in (
        F.coalesce(F.col(f"{kind}_{name}_count"), F.lit(0)).alias(f"{kind}_{name}_count"), (F.coalesce(F.col(f"{kind}_{name}_count"), F.lit(0)) / n).alias(f"{kind}_{name}_rate"))]
    q = group_quantiles(rows, [], {"u": F.abs("u"), "v": F.abs("v"), "euclid": e}, {"median_abs": .5, "p90_abs": .9}, member="groups")
    stats = total.select("grp", "count", *out).join(F.broadcast(q), "grp", "left").withColumnRenamed("euclid_p90_abs", "euclid_p90").drop("euclid_median_abs")
    groups = [g for gs in AXIS_FAMILIES.values() for g in gs]
    return complete(stats, {"grp": groups}, counts)


EFFECTS = ("improved", "worsened", "effective", "hurt", "neutral")


def _effects(gain: Column, threshold: float) -> dict[str, Column]:
    """1 or 0 for each kind of effect of a gain; 0 where there is none."""
    kinds = {"improved": gain > 0, "worsened": gain < 0, "effective": gain >= threshold, "hurt": gain <= -threshold,
             "neutral": F.abs(gain) < threshold}
    return {name: F.coalesce(kinds[name], F.lit(False)).cast("bigint") for name in EFFECTS}


def _share(part: str, of: str) -> Column:
    return F.when(F.col(of) > 0, F.col(part) / F.col(of))


def _listed(rows: DataFrame) -> DataFrame:
    """Rows with ``groups``; a single group ``grp`` per row becomes a list of one."""
    return rows if "groups" in rows.columns else rows.withColumn("groups", F.array("grp"))


def gain_rows(frames: DataFrame, after: str) -> DataFrame:
    """gain_raw and gain_filled of a series; NULL where the frame is not eligible."""
    t = F.col("target_valid")
    return frames.withColumns({
        "gain_raw": F.when(t & F.col("raw_valid"), S.finite(F.col("raw_error") - F.col(after))),
        "gain_filled": F.when(t, S.finite(F.col("filled_error") - F.col(after)))})


def effect_by_group(rows: DataFrame, groups: Sequence[str], *, threshold: float = 1.0,
                    shift_threshold: float | None = None) -> DataFrame:
    """Improved / worsened / effective / hurt / neutral counts and rates of two gains.

    ``rows`` has groups (or grp), gain_raw, gain_filled; with ``shift_threshold`` also final_shift
    and delta_mag.
    """
    sums, out, counts = {}, [], []
    values = {"gain_raw": F.col("gain_raw"), "gain_filled": F.col("gain_filled")}
    keep = ["groups", "gain_raw", "gain_filled"]
    for base in ("raw", "filled"):
        g, n = F.col(f"gain_{base}"), f"eligible_{base}"
        sums |= {n: g.isNotNull().cast("bigint"), f"__gain_{base}": g, **{f"{base}_{k}_count": hit for k, hit in _effects(g, threshold).items()}}
        out += [F.col(n), _share(f"__gain_{base}", n).alias(f"mean_gain_{base}")]
        out += [x for k in EFFECTS for x in (F.col(f"{base}_{k}_count"), _share(f"{base}_{k}_count", n).alias(f"{base}_{k}_rate"))]
        counts += [n, *[f"{base}_{k}_count" for k in EFFECTS]]
    if shift_threshold is not None:
        ok = F.col("gain_filled").isNotNull()
        moved = F.coalesce(S.finite(F.col("final_shift")) >= shift_threshold, F.lit(False))
        shift, delta = F.when(ok, F.col("final_shift")), F.when(ok, F.col("delta_mag"))
        sums |= {"moved_count": (ok & moved).cast("bigint"), "__shift": shift, "__shifts": shift.isNotNull().cast("bigint"), "__delta": delta, "__deltas": delta.isNotNull().cast("bigint")}
        out += [F.col("moved_count"), _share("moved_count", "eligible_filled").alias("moved_rate"), _share("__shift", "__shifts").alias("mean_shift"), _share("__delta", "__deltas").alias("mean_delta")]
        counts.append("moved_count")
        values["shift"] = shift
        keep += ["final_shift", "delta_mag"]
    rows = _listed(rows).select(*keep)
    stats = member_sums(rows, [], sums).select("grp", *out)
    q = group_quantiles(rows, [], values, {"median": .5, "p10": .1, "p90": .9}, member="groups")
    if shift_threshold is not None:
        q = q.drop("shift_p10", "shift_p90")
    return complete(stats.join(F.broadcast(q), "grp", "left"), {"grp": groups}, counts)


def grouped_gains(frames: DataFrame, after: str) -> DataFrame:
    return gain_rows(frames, after).withColumn("groups", group_array())


def correction_effect(frames: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    return effect_by_group(grouped_gains(frames, "final_error"), groups, shift_threshold=1.0)


def prior_effect(frames: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Same for the prior; prior minus base statistics are the negated gains."""
    out = effect_by_group(grouped_gains(frames, "prior_error"), groups)
    neg = {}
    for base in ("raw", "filled"):
        neg[f"prior_minus_{base}_mean"] = -F.col(f"mean_gain_{base}")
        neg[f"prior_minus_{base}_median"] = -F.col(f"gain_{base}_median")
        neg[f"prior_minus_{base}_p10"] = -F.col(f"gain_{base}_p90")
        neg[f"prior_minus_{base}_p90"] = -F.col(f"gain_{base}_p10")
    return out.withColumns(neg)


def trust_bucket(trust: Column) -> Column:
    out = None
    for lo, hi, label in zip(TRUST_EDGES, TRUST_EDGES[1:], TRUST_LABELS):
        hit = (trust >= lo) & (trust < hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def trust_effect_rows(rows: DataFrame, groups: Sequence[str], threshold: float = 1.0) -> DataFrame:
    """Gain statistics per (base, group, trust bucket); rows has groups (or grp), trust and gains."""
    bases = ("raw", "filled")
    pairs = F.array(*[F.struct(F.lit(b).alias("base"), F.col(f"gain_{b}").alias("gain")) for b in bases])
    long = _listed(rows).select("groups", "trust", F.inline(pairs)).filter(
        F.col("gain").isNotNull() & S.finite(F.col("trust")).isNotNull()).withColumn("bucket", trust_bucket(F.col("trust")))
    keys, n = ["base", "grp", "bucket"], F.col("count")
    sums = member_sums(long, ["base", "bucket"], {
        "count": F.lit(1), "__trust": F.col("trust"), "__gain": F.col("gain"), **{f"{k}_count": hit for k, hit in _effects(F.col("gain"), threshold).items()}})
    stats = sums.select(*keys, "count", (F.col("__trust") / n).alias("trust_mean"), (F.col("__gain") / n).alias("mean"),
                        *[x for k in EFFECTS for x in (F.col(f"{k}_count"), (F.col(f"{k}_count") / n).alias(f"{k}_rate"))])
    q = group_quantiles(long, ["base", "bucket"], {"gain": F.col("gain")}, {"median": .5, "p10": .1, "p90": .9}, member="groups")
    counts = ["count", *[f"{k}_count" for k in EFFECTS]]
    out = complete(stats.join(F.broadcast(q), keys, "left"), {"base": bases, "grp": groups, "bucket": TRUST_LABELS}, counts)
    total = sums.groupBy("base", "grp").agg(F.sum("count").alias("eligible"))
    out = out.join(F.broadcast(total), ["base", "grp"], "left").withColumn("eligible", F.coalesce("eligible", F.lit(0)))
    return out.withColumn("frame_rate", F.when(F.col("eligible") > 0, F.col("count") / F.col("eligible")))


def trust_effect(frames: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    return trust_effect_rows(grouped_gains(frames, "final_error"), groups)


def rmse_improvement(by_group: DataFrame) -> DataFrame:
    """Four rmse differences per group from the ``error_by_group`` table."""
    wide = by_group.groupBy("grp").agg(*[F.max(F.when(F.col("series") == s, F.col("rmse"))).alias(s) for s in SERIES])
    return wide.select("grp", *[
        (F.col(b) - F.col(a)).alias(f"{a}_vs_{b}") for a in ("final", "prior") for b in ("raw", "filled")])


def with_sequence_scale(frames: DataFrame, length: Column) -> DataFrame:
    """Largest valid true length of the sequence beside every frame.

    An aggregate and a join: the maximum is combined map-side and a huge sequence is
    split by the adaptive skew join, unlike a window over the sequence. The maxima, one row per
    sequence, are hashed; a merge join would sort the frames of a partition.
    """
    scale = frames.groupBy("swing_id").agg(F.max(F.when(F.col("target_valid"), length)).alias("max_length"))
    return frames.join(scale.hint("shuffle_hash"), "swing_id", "inner")


def pck(rows: DataFrame, keys: Sequence[str], ratio: str, alphas: Sequence[float] = (0.025, 0.05)) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(ratio).alias("frames"), *[
        F.avg((F.col(ratio) <= a).cast("double")).alias(f"pck_{str(a * 100).rstrip('0').rstrip('.').replace('.', '_')}") for a in alphas])


def pck_curve(rows: DataFrame, keys: Sequence[str], ratio: str, steps: int = 100, top: float = 0.1) -> DataFrame:
    """Share of ratios at or under each of ``steps + 1`` thresholds.

    Each ratio falls into the first threshold that admits it; the curve is the running
    sum of at most ``steps + 2`` counts per key.
    """
    keys = list(keys)
    r = F.col(ratio)
    guess = F.least(F.greatest(F.ceil(r / top * steps), F.lit(0)), F.lit(steps + 1))
    first = guess
    for shift in (-1, 1):  # the quotient may round across a threshold
        fits = r <= (first + min(shift, 0)).cast("double") / steps * top
        first = F.when(fits & (first > 0), first - 1).otherwise(first) if shift < 0 else F.when(~fits & (first <= steps), first + 1).otherwise(first)
    hist = rows.filter(r.isNotNull()).groupBy(*keys, F.least(first, F.lit(steps + 1)).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("c"))
    one = hist.groupBy(*keys).agg(F.sum("c").alias("frames"), F.map_from_entries(F.collect_list(F.struct("step", "c"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(i.alias("step"), F.coalesce(F.col("m")[i], F.lit(0)).alias("c")))
    exploded = one.select(*keys, "frames", F.inline(grid))
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return exploded.select(*keys, "step", (F.col("step") / steps * top).alias("alpha"), (F.sum("c").over(w) / F.col("frames")).alias("pck"))


def pck_auc(curve: DataFrame, keys: Sequence[str], steps: int = 100) -> DataFrame:
    """Trapezoid over the curve, divided by its range."""
    weight = F.when((F.col("step") == 0) | (F.col("step") == steps), 0.5).otherwise(1.0)
    return curve.groupBy(*keys).agg((F.sum(F.col("pck") * weight) / steps).alias("auc"))


def headline(rows: DataFrame) -> DataFrame:
    """rmse, mean, median, p90, PCK and AUC per series over the same frames."""
    e = F.col("error")
    sums = rows.groupBy("series").agg(
        F.count(e).alias("frames"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean"),
        F.avg((F.col("ratio") <= 0.025).cast("double")).alias("pck_2_5"), F.avg((F.col("ratio") <= 0.05).cast("double")).alias("pck_5"))
    q = group_quantiles(rows, ["series"], {"e": e}, {"median": .5, "p90": .9}, few_groups=True)
    auc = pck_auc(pck_curve(rows, ["series"], "ratio"), ["series"])
    return sums.join(F.broadcast(q), "series").join(F.broadcast(auc), "series").withColumnsRenamed({"e_median": "median", "e_p90": "p90"})


def relative_change(table: DataFrame, base: str) -> DataFrame:
    """Percent change (points for PCK and AUC) of each series against ``base``."""
    cols = ("rmse", "mean", "median", "p90")
    shares = ("pck_2_5", "pck_5", "auc")
    names = [*cols, *shares]
    one = table.filter(F.col("series") == base).select(F.lit(1).alias("__k"), *[F.col(c).alias(f"__{c}") for c in names])
    out = table.filter(F.col("series") != base).withColumn("__k", F.lit(1)).join(F.broadcast(one), "__k")
    return out.select("series", *[((F.col(c) / F.col(f"__{c}") - 1) * 100).alias(f"{c}_change_pct") for c in cols],
                      *[((F.col(c) - F.col(f"__{c}")) * 100).alias(f"{c}_change_points") for c in shares])


def sequence_profile(frames: DataFrame) -> DataFrame:
    """Per sequence: frames, valid targets, predictions, ignores and status counts."""
    by_status = frames.groupBy("swing_id", "tail_status").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("target_valid").alias("targets"), F.count_if("tail_seen").alias("seen"),
        F.count_if(F.col("tail_visibility") == "ignore").alias("ignored"))
    return by_status.groupBy("swing_id").agg(
        F.sum("frames").alias("frames"), F.sum("targets").alias("target_frames"), F.sum("seen").alias("tail_predictions"),
        F.sum("ignored").alias("tail_ignored"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tail_status", "frames")))).alias("tail_status"))


def metadata_histogram(meta: DataFrame) -> DataFrame:
    return meta.groupingSets([["side"], ["view_label"]], "side", "view_label").agg(F.count(F.lit(1)).alias("sequences"))


def valid_rmse(rows: DataFrame, keys: Sequence[str], error: str) -> DataFrame:
    e = F.when(F.col("target_valid"), F.col(error))
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("valid"))


def envelope_crop(frames: DataFrame, width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT) -> DataFrame:
    """Box around the true tail path of a sequence: 1.6 times, grown to 4:3, clamped."""
    ok = F.col("target_valid")
    agg = frames.groupBy("swing_id").agg(*[
        f(F.when(ok, F.col(c))).alias(n) for c, a in (("gt_tail_px", "x"), ("gt_tail_py", "y"))
        for f, n in ((F.min, f"lo_{a}"), (F.max, f"hi_{a}"))]).filter(F.col("lo_x").isNotNull() & F.col("lo_y").isNotNull())
    w, h = (F.col("hi_x") - F.col("lo_x")) * 1.6, (F.col("hi_y") - F.col("lo_y")) * 1.6
    narrow = w * 3 < h * 4
    w2 = F.least(F.when(narrow, h * 4 / 3).otherwise(w), F.lit(width))
    h2 = F.least(F.when(narrow, h).otherwise(w * 3 / 4), F.lit(height))
    left = F.greatest(F.lit(0.0), F.least((F.col("lo_x") + F.col("hi_x")) / 2 - w2 / 2, width - w2))
    top = F.greatest(F.lit(0.0), F.least((F.col("lo_y") + F.col("hi_y")) / 2 - h2 / 2, height - h2))
    return agg.select("swing_id", F.bround(left).cast("int").alias("left"), F.bround(top).cast("int").alias("top"),
                      F.bround(left + w2).cast("int").alias("right"), F.bround(top + h2).cast("int").alias("bottom"))


def epoch_means(history: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Batch-size-weighted mean of metric rows per (run, epoch)."""
    n = F.greatest(F.sum("batch_size"), F.lit(1))
    return history.groupBy("run", "epoch").agg(*[(F.sum(F.col(m) * F.col("batch_size")) / n).alias(m) for m in metrics])


def best_epochs(epochs: DataFrame, patience: int) -> DataFrame:
    """First epoch with the lowest total before patience runs out, and the stop epoch.

    The history of a run is one row per epoch. The run stops at the first epoch that
    lies ``patience`` epochs after the best so far.
    """
    upto = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    seen = epochs.withColumn("best", F.min(F.struct(F.col("total"), F.col("epoch").alias("at"))).over(upto))
    stop = F.min(F.when(F.col("epoch") - F.col("best.at") >= patience, F.col("epoch")))
    stops = seen.groupBy("run").agg(stop.alias("stop_epoch"))
    used = epochs.join(stops, "run").filter(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    return used.groupBy("run").agg(
        F.min_by("epoch", F.struct("total", "epoch")).alias("best_epoch"), F.min("total").alias("best_total"),
        F.first("stop_epoch").alias("stop_epoch"))
