"""Summaries of dense flow fields and their joins to frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators.quantiles import bucket_of, interpolated, values_at, wanted_buckets
from trackloom.schemas import FLOW_REGIONS, GLOBAL_FLOW_STATS, REGION_FLOW_STATS


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def field_stats(fx: Column, fy: Column) -> Column:
    """Struct of eleven statistics of one field (population deviation)."""
    def inner(p: Column) -> Column:
        mx, my, mm = _mean(p["fx"]), _mean(p["fy"]), _mean(p["mag"])

        def dev(a, m):
            return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a))
        q = F.sort_array(p["mag"])
        return F.transform(F.array(F.struct(p["fx"].alias("fx"), p["fy"].alias("fy"), p["mag"].alias("mag"), q.alias("q"),
                                            mx.alias("mx"), my.alias("my"), mm.alias("mm"))), lambda z: F.struct(
            z["mx"].alias("flow_x_mean"), z["my"].alias("flow_y_mean"),
            dev(z["fx"], z["mx"]).alias("flow_x_std"), dev(z["fy"], z["my"]).alias("flow_y_std"),
            z["mm"].alias("flow_mag_mean"), dev(z["mag"], z["mm"]).alias("flow_mag_std"),
            F.element_at(z["q"], -1).alias("flow_mag_max"),
            *[S.array_quantile(z["q"], p_).alias(n) for n, p_ in
              (("flow_mag_p50", .5), ("flow_mag_p90", .9), ("flow_mag_p95", .95), ("flow_mag_p99", .99))]))[0]
    mag = F.transform(F.arrays_zip(fx.alias("a"), fy.alias("b")), lambda v: F.sqrt(v["a"] * v["a"] + v["b"] * v["b"]))
    return F.transform(F.array(F.struct(fx.alias("fx"), fy.alias("fy"), mag.alias("mag"))), inner)[0]


def catalogue_indices(files: DataFrame, path: str = "path") -> DataFrame:
    """(prev, target) frame index from the last two digit groups of a file name."""
    groups = F.regexp_extract_all(S.file_stem(F.col(path)), F.lit("([0-9]+)"), 1)
    return files.withColumns({
        "prev_frame_idx": F.try_element_at(groups, F.lit(-2)).try_cast("int"),
        "frame_idx": F.when(F.size(groups) >= 2, F.try_element_at(groups, F.lit(-1)).try_cast("int"))})


TILE_ROWS, TILE_COLUMNS = 64, 1024
ROW_PIXELS = 65_536
FIELD = ["swing_id", "frame_idx"]


def field_tiles(fields: DataFrame, rows: int = TILE_ROWS, columns: int = TILE_COLUMNS) -> DataFrame:
    """Fields cut into tiles of at most ``rows`` x ``columns`` pixels, the only form in which operators hold them.

    For sources that deliver a whole row-major field (fx, fy, width, height); a reader of larger
    images yields tiles itself: ty and tx count tiles, y1 and x1 are a tile's first pixel, w its width.
    """
    w, h = F.col("width"), F.col("height")
    across = F.ceil(w / columns).cast("int")
    place = F.posexplode(F.sequence(F.lit(0), F.ceil(h / rows).cast("int") * across - 1)).alias("at", "tile")
    out = fields.select("swing_id", "frame_idx", "prev_frame_idx", "flow_file", "width", "height", "fx", "fy", place)
    out = out.withColumns({"ty": F.floor(F.col("tile") / across).cast("int"), "tx": (F.col("tile") % across).cast("int")})
    out = out.withColumns({"y1": F.col("ty") * rows, "x1": F.col("tx") * columns}).withColumns({
        "w": F.least(F.lit(columns), w - F.col("x1")), "h": F.least(F.lit(rows), h - F.col("y1"))})

    def cut(field: str) -> Column:
        return F.flatten(F.transform(F.sequence(F.col("y1"), F.col("y1") + F.col("h") - 1), lambda y: F.slice(field, y * w + F.col("x1") + 1, F.col("w"))))
    return out.select("swing_id", "frame_idx", "prev_frame_idx", "flow_file", "width", "height", "ty", "tx", "y1", "x1", "w",
                      cut("fx").alias("fx"), cut("fy").alias("fy"))


def field_catalogue(tiles: DataFrame) -> DataFrame:
    """One row per field, from its first tile."""
    return tiles.filter((F.col("ty") == 0) & (F.col("tx") == 0)).select("swing_id", "frame_idx", "prev_frame_idx", "flow_file", "width", "height")


def _pixels(pieces: DataFrame, *keep: str | Column) -> DataFrame:
    px = pieces.select(*keep, F.inline(F.arrays_zip(F.col("fx"), F.col("fy"))))
    return px.withColumn("mag", F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy")))


def _small_stats(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of groups whose pixels fit in one row."""
    parts = pieces.groupBy(*keys).agg(F.collect_list(F.struct("fx", "fy")).alias("p"))
    stats = parts.select(*keys, field_stats(F.flatten("p.fx"), F.flatten("p.fy")).alias("g"))
    return stats.select(*keys, *[F.col(f"g.{s}").alias(s) for s in GLOBAL_FLOW_STATS])


def _large_stats(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The same for groups of any size: moments per magnitude bucket, then the exact values at the wanted ranks.

    The first pass sums map-side; the second explodes only tiles again and keeps the pixels of wanted buckets.
    """
    n = F.col("__c")
    px = _pixels(pieces, *keys).withColumn("__b", bucket_of(F.col("mag")))
    axes = {"fx": "flow_x", "fy": "flow_y", "mag": "flow_mag"}
    hist = px.groupBy(*keys, "__b").agg(
        F.count(F.lit(1)).alias("__c"), F.min("mag").alias("__lo"), F.max("mag").alias("__hi"),
        *[f(a).alias(f"__{f.__name__}_{a}") for a in axes for f in (F.avg, F.var_pop)])
    whole = Window.partitionBy(*keys)
    centred = hist.withColumns({f"__mean_{a}": F.sum(n * F.col(f"__avg_{a}")).over(whole) / F.sum(n).over(whole) for a in axes})

    def spread(a: str) -> Column:
        off = F.col(f"__avg_{a}") - F.col(f"__mean_{a}")
        return F.sqrt(F.sum(n * (F.col(f"__var_pop_{a}") + off * off)) / F.sum(n))
    moments = centred.groupBy(*keys).agg(
        *[F.first(f"__mean_{a}").alias(f"{s}_mean") for a, s in axes.items()], *[spread(a).alias(f"{s}_std") for a, s in axes.items()],
        F.max("__hi").alias("flow_mag_max"))
    probs = {"p50": .5, "p90": .9, "p95": .95, "p99": .99}
    facts = ["__b", "__skip", "__n", "__c", "__lo", "__hi"]
    wanted = wanted_buckets(hist.select(*keys, "__b", "__c", "__lo", "__hi"), keys, probs)
    wanted = wanted.groupBy(*keys).agg(F.collect_list(F.struct(*facts)).alias("__want"))
    again = _pixels(pieces.join(wanted, keys), *keys, "__want").withColumn("__b", bucket_of(F.col("mag")))
    rows = again.filter(F.array_contains("__want.__b", F.col("__b"))).select(*keys, F.col("mag").alias("__v"), F.filter(
        "__want", lambda t: t["__b"] == F.col("__b"))[0].alias("__t")).select(*keys, "__v", "__t.*")
    spans = values_at(rows, keys, probs).withColumn("__m", F.lit("flow_mag"))
    return moments.join(interpolated(spans, keys, ["flow_mag"], probs), keys).select(*keys, *GLOBAL_FLOW_STATS)


def piece_stats(pieces: DataFrame, keys: list[str], pixels: Column, row_pixels: int = ROW_PIXELS) -> DataFrame:
    """Eleven statistics per group of pieces (arrays fx, fy); ``pixels`` is the size of the whole group."""
    few = pixels <= row_pixels
    return _small_stats(pieces.filter(few), keys).unionByName(_large_stats(pieces.filter(~few), keys))


def global_stats(tiles: DataFrame, *, row_pixels: int = ROW_PIXELS) -> DataFrame:
    keys = ["swing_id", "frame_idx", "prev_frame_idx", "flow_file"]
    return piece_stats(tiles, keys, F.col("width") * F.col("height"), row_pixels).select(*keys, *GLOBAL_FLOW_STATS)


def attach_global(frames: DataFrame, stats: DataFrame) -> DataFrame:
    """Every frame with the flow that ends at it; frames without one get zeros."""
    out = frames.join(stats, ["swing_id", "frame_idx"], "left")
    zeros = {s: F.coalesce(F.col(s), F.lit(0.0)) for s in GLOBAL_FLOW_STATS}
    return out.withColumns({"has_prev_flow": F.col("flow_file").isNotNull().cast("int"), **zeros})


def region_bounds(cx: Column, cy: Column, radius: int, width: Column, height: Column) -> Column:
    """Clamped square around a rounded centre; NULL when the centre is outside."""
    x, y = F.bround(cx).cast("int"), F.bround(cy).cast("int")
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    return F.when(inside, F.struct(
        F.greatest(x - radius, F.lit(0)).alias("x1"), F.least(x + radius + 1, width).alias("x2"),
        F.greatest(y - radius, F.lit(0)).alias("y1"), F.least(y + radius + 1, height).alias("y2")))


def box_bounds(x1, y1, x2, y2, pad: int, width: Column, height: Column) -> Column:
    def clip(v, hi):
        return F.greatest(F.least(v, hi), F.lit(0))
    a, b = clip(F.bround(x1).cast("int") - pad, width), clip(F.bround(x2).cast("int") + pad, width)
    c, d = clip(F.bround(y1).cast("int") - pad, height), clip(F.bround(y2).cast("int") + pad, height)
    known = x1.isNotNull() & x2.isNotNull() & y1.isNotNull() & y2.isNotNull()
    return F.when(known & (b > a) & (d > c), F.struct(a.alias("x1"), b.alias("x2"), c.alias("y1"), d.alias("y2")))


def _regions(frames: DataFrame, tiles: DataFrame, radius: int, pad: int) -> DataFrame:
    """Frames with the facts of their field and the three boxes, NULL where a region is not valid."""
    out = frames.join(field_catalogue(tiles).drop("prev_frame_idx"), FIELD, "left")
    usable = F.col("flow_file").isNotNull() & (F.col("frame_idx") > 1)
    w, h = F.col("width"), F.col("height")
    boxes = {
        "head": region_bounds(F.col("head_pred_x"), F.col("head_pred_y"), radius, w, h),
        "tail": region_bounds(F.col("tail_pred_x"), F.col("tail_pred_y"), radius, w, h),
        "bbox": box_bounds(F.col("bbox_x1"), F.col("bbox_y1"), F.col("bbox_x2"), F.col("bbox_y2"), pad, w, h)}
    return out.withColumns({
        "has_prev_flow": usable.cast("int"),
        "prev_frame_idx": F.when(F.col("frame_idx") > 1, F.col("frame_idx") - 1),
        **{f"{r}_box": F.when(usable, b) for r, b in boxes.items()}})


def box_pieces(boxes: DataFrame, tiles: DataFrame, rows: int, columns: int) -> DataFrame:
    """The part of every tile that a box touches: (swing_id, frame_idx, box, fx, fy).

    An equi-join on (field, tile): a box reads the tiles under it, not the field.
    """
    box = F.col("box")

    def tile_of(edge: str, size: int, last: bool = False) -> Column:
        return F.floor((box[edge] - int(last)) / size).cast("int")
    each = boxes.withColumn("ty", F.explode(F.sequence(tile_of("y1", rows), tile_of("y2", rows, True)))).withColumn(
        "tx", F.explode(F.sequence(tile_of("x1", columns), tile_of("x2", columns, True))))
    grid = tiles.select(*FIELD, "ty", "tx", F.col("y1").alias("top"), F.col("x1").alias("left"), "w", "fx", "fy")
    met = each.join(grid, [*FIELD, "ty", "tx"])
    y1, y2 = F.greatest(box["y1"] - F.col("top"), F.lit(0)), F.least(box["y2"] - F.col("top"), F.lit(rows))
    x1 = F.greatest(box["x1"] - F.col("left"), F.lit(0))
    x2 = F.least(box["x2"] - F.col("left"), F.col("w"))

    def cut(field: str) -> Column:
        return F.flatten(F.transform(F.sequence(y1, y2 - 1), lambda y: F.slice(field, y * F.col("w") + x1 + 1, x2 - x1)))
    return met.select(*FIELD, "box", cut("fx").alias("fx"), cut("fy").alias("fy"))


def region_stats(frames: DataFrame, tiles: DataFrame, *, radius: int = 8, pad: int = 5, tile: tuple[int, int] = (TILE_ROWS, TILE_COLUMNS),
                 row_pixels: int = ROW_PIXELS) -> DataFrame:
    """Flow statistics around head, around tail and inside the box of each frame.

    Frame index 1 or less, or a missing field, gives zeros. ``frames`` has head/tail
    predictions and a box in pixels of the field; ``tile`` is the size ``tiles`` were cut to. A statistic
    depends on the field and the box alone, so equal boxes of a field are computed once.
    """
    out = _regions(frames, tiles, radius, pad)
    boxes = out.select(*FIELD, F.explode(F.array(*[F.col(f"{r}_box") for r in FLOW_REGIONS])).alias("box")).filter("box is not null").distinct()
    box = F.col("box")
    stats = piece_stats(box_pieces(boxes, tiles, *tile), [*FIELD, "box"], (box["x2"] - box["x1"]) * (box["y2"] - box["y1"]), row_pixels)
    # At most three boxes for each frame row of a field.
    found = stats.groupBy(*FIELD).agg(F.collect_list(F.struct("box", *REGION_FLOW_STATS)).alias("found"))
    out = out.join(found, FIELD, "left").withColumns({
        f"{r}_stats": F.try_element_at(F.filter("found", _same_box(f"{r}_box")), F.lit(1)) for r in FLOW_REGIONS})
    cols = {}
    for r in FLOW_REGIONS:
        cols[f"{r}_valid"] = F.col(f"{r}_box").isNotNull().cast("int")
        for s in REGION_FLOW_STATS:
            cols[f"{r}_{s}"] = F.coalesce(F.col(f"{r}_stats.{s}"), F.lit(0.0))
    return out.withColumns(cols).drop("found", "width", "height", *[f"{r}_{x}" for r in FLOW_REGIONS for x in ("box", "stats")])


def _same_box(name: str):
    return lambda found: found["box"] == F.col(name)


def single_keys(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``; a query over it fails when a key occurs twice, as a merge on it would multiply rows.

    The check is a part of the plan: rows meet by key, which the merge needs anyway, and are counted there, so it
    costs no job and no further exchange. Keys with NULL count as equal.
    """
    text = F.concat_ws(", ", *[F.concat_ws("=", F.lit(k), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in keys])
    counted = df.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    refused = F.raise_error(F.concat(F.lit(f"{what}: repeated key "), text)).cast("boolean")
    return counted.filter(F.when(F.col("__rows") > 1, refused).otherwise(F.lit(True))).drop("__rows")


def merge_local(wide: DataFrame, local: DataFrame) -> DataFrame:
    """One-to-one left join on (image_stem, swing_id, frame); echoes of the detector are left out."""
    keys = ["image_stem", "swing_id", "frame"]
    echo = ["head_pred_x", "head_pred_y", "head_pred_conf", "tail_pred_x", "tail_pred_y", "tail_pred_conf",
            "bbox_conf", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "flow_file"]
    return single_keys(wide, keys, "observations").join(single_keys(local.drop(*echo), keys, "local flow"), keys, "left")


def merge_global(wide: DataFrame, stats: DataFrame) -> DataFrame:
    """One-to-one left join of prefixed global statistics on (swing_id, frame_idx)."""
    names = ["has_prev_flow", "prev_frame_idx", "flow_file", *GLOBAL_FLOW_STATS]
    g = stats.withColumnsRenamed({n: f"global_{n}" for n in names})
    keep = [*FIELD, "frame_name", *[f"global_{n}" for n in names]]
    return single_keys(wide, FIELD, "observations").join(single_keys(g.select(*keep), FIELD, "global flow"), FIELD, "left")


def sanity_columns(wide: DataFrame) -> DataFrame:
    c = F.col
    return wide.withColumns({
        "bbox_w": c("bbox_x2") - c("bbox_x1"), "bbox_h": c("bbox_y2") - c("bbox_y1"),
        "pred_bat_length": F.hypot(c("head_pred_x") - c("tail_pred_x"), c("head_pred_y") - c("tail_pred_y")),
        "gt_bat_length": F.hypot(c("head_gt_x") - c("tail_gt_x"), c("head_gt_y") - c("tail_gt_y"))})


def completeness(frames: DataFrame, fields: DataFrame) -> DataFrame:
    """Expected (frames - 1) against existing fields per sequence; ``fields`` has one row per field."""
    expected = frames.groupBy("swing_id").agg(F.count(F.lit(1)).alias("n_frames"))
    existing = fields.groupBy("swing_id").agg(F.count(F.lit(1)).alias("existing_flows"))
    out = expected.join(existing, "swing_id", "left").withColumn("existing_flows", F.coalesce("existing_flows", F.lit(0)))
    return out.withColumn("expected_flows", F.greatest(F.col("n_frames") - 1, F.lit(0))).withColumn(
        "complete", (F.col("n_frames") >= 2) & (F.col("existing_flows") == F.col("expected_flows")))


def region_pixels(frames: DataFrame, tiles: DataFrame, *, radius: int = 8, pad: int = 5, tile: tuple[int, int] = (TILE_ROWS, TILE_COLUMNS)) -> DataFrame:
    """Pixels (x, y, fx, fy) of every region, cut from the tiles before they are exploded."""
    out = _regions(frames, tiles, radius, pad)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("region"), F.col(f"{r}_box").alias("box")) for r in FLOW_REGIONS]))
    named = out.select("image_stem", *FIELD, each.alias("e")).filter("e.box is not null").select("image_stem", *FIELD, "e.region", "e.box")
    pieces = box_pieces(named.select(*FIELD, "box").distinct(), tiles, *tile)
    return named.join(pieces, [*FIELD, "box"]).select("image_stem", *FIELD, "region", F.inline(F.arrays_zip("fx", "fy")))
