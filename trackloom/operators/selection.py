"""Choice of one detection per frame, and the screen that follows it.

The choice is sequential: the cost of a candidate depends on the one chosen in the
last frame that had an eligible candidate. Which frame that is does not depend on
the choices, so every frame's answer for each possible predecessor is a small
table, computed for all frames at once. Only the table look-ups remain sequential
(``follow_states``), and they are composed block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators.quantiles import group_quantiles
from trackloom.operators.sequence import (
    FOLD_FAN, FOLD_ROWS, block_window, fold_levels, follow_states, with_halo, with_positions,
)
from trackloom.schemas import ScreenSettings, SelectionSettings
from trackloom.session import filed, materialised

MIN_KEYPOINT_CONF = 0.1
CANDIDATE = ("rank", "conf", "hx", "hy", "tx", "ty", "cx", "cy", "length", "angle", "head_conf", "tail_conf")


def pixel_candidates(detections: Column, width: float, height: float) -> Column:
    """Detections as pixel points with length, direction and box centre."""
    def one(d: Column) -> Column:
        hx, hy = d["head"]["x"] * width, d["head"]["y"] * height
        tx, ty = d["tail"]["x"] * width, d["tail"]["y"] * height
        return F.struct(
            d["detection_rank"].alias("rank"), d["bbox_conf"].alias("conf"),
            hx.alias("hx"), hy.alias("hy"), tx.alias("tx"), ty.alias("ty"),
            (d["bbox"]["xc"] * width).alias("cx"), (d["bbox"]["yc"] * height).alias("cy"),
            F.hypot(hx - tx, hy - ty).alias("length"),
            S.direction_degrees(hx, hy, tx, ty).alias("angle"),
            d["head"]["conf"].alias("head_conf"), d["tail"]["conf"].alias("tail_conf"),
            d["bbox"]["w"].alias("bw"), d["bbox"]["h"].alias("bh"))
    return F.transform(detections, one)


def eligible(candidates: Column) -> Column:
    return F.filter(candidates, lambda c: (c["head_conf"] >= MIN_KEYPOINT_CONF) & (c["tail_conf"] >= MIN_KEYPOINT_CONF))


def score_parts(c: Column, p: Column, gap: Column, ax: Column, ay: Column, s: SelectionSettings) -> dict[str, Column]:
    """Seven cost parts of candidate ``c`` after ``p`` (NULL: no predecessor)."""
    def zero(e: Column) -> Column:
        return F.coalesce(e, F.lit(0.0))
    off = F.hypot(c["cx"] - ax, c["cy"] - ay) - s.anchor_radius
    return {
        "bbox_conf_score": c["conf"] * -s.bbox_conf_weight,
        "temporal_tail_jump": zero(F.hypot(c["tx"] - p["tx"], c["ty"] - p["ty"]) / gap),
        "temporal_head_jump": zero(F.hypot(c["hx"] - p["hx"], c["hy"] - p["hy"]) / gap),
        "length_jump": zero(F.abs(c["length"] - p["length"])),
        "direction_change": S.angle_delta(c["angle"], p["angle"]),
        "bbox_center_jump": zero(F.hypot(c["cx"] - p["cx"], c["cy"] - p["cy"]) / gap),
        "anchor_cost": F.when(off > 0, off * s.anchor_weight).otherwise(0.0),
    }


def total_score(parts: dict[str, Column]) -> Column:
    total = None
    for part in parts.values():
        total = part if total is None else total + part
    return total


def first_box(records: DataFrame, settings: SelectionSettings) -> dict[str, Column]:
    """Pixel centre of the first-ranked box, whatever its confidence; NULL without one."""
    first = F.get(F.col("detections"), F.lit(0))
    return {"first_x": first["bbox"]["xc"] * settings.width, "first_y": first["bbox"]["yc"] * settings.height}


def sequence_anchors(records: DataFrame, settings: SelectionSettings = SelectionSettings()) -> DataFrame:
    """Median centre of the first-ranked boxes per sequence."""
    points = records if "first_x" in records.columns else records.withColumns(first_box(records, settings))
    return group_quantiles(
        points, ["swing_id"], {"anchor_x": F.col("first_x"), "anchor_y": F.col("first_y")}, {"p50": 0.5}
    ).select("swing_id", F.col("anchor_x_p50").alias("anchor_x"), F.col("anchor_y_p50").alias("anchor_y"))


def ordered_records(records: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Positions along (frame number or last, frame name, stem); ``turn`` counts the frames with an
    eligible candidate (``n_eligible``). ``facts`` has one row per sequence."""
    number, last = F.coalesce(F.col("frame_no"), F.lit(0)), F.col("frame_no").isNull()
    unnumbered = F.when(last, F.substring("frame_name", 1, 8)).otherwise("")
    return with_positions(
        records, ["swing_id"], [last, F.floor(number / 256), unnumbered],
        [last, number, F.col("frame_name"), F.col("prediction_stem")],
        flag=F.col("n_eligible") > 0, flag_pos="turn", total=None, facts=facts)


KEYS = ("prediction_stem", "image_stem", "swing_id", "frame_no", "frame_name")

#: Frames of a sequence that are chosen in one group; longer sequences are cut into blocks.
SHORT_ROWS = 1024


def _step(settings: SelectionSettings) -> Column:
    """The best candidate of a frame (``eligible``) for each candidate of the frame before (``earlier``), or for none."""
    def best(p: Column) -> Column:
        ranked = F.transform(F.col("eligible"), lambda c, i: F.struct(
            total_score(score_parts(c, p, F.col("gap"), F.col("anchor_x"), F.col("anchor_y"), settings)).alias("score"),
            c["rank"].alias("rank"), i.alias("i")))
        return F.array_min(ranked)["i"]

    nobody = F.slice(F.col("eligible"), 1, 1)
    return F.transform(F.coalesce(F.col("earlier"), F.transform(nobody, lambda c: F.when(F.lit(False), c))), best)


def select_candidates(records: DataFrame, settings: SelectionSettings = SelectionSettings(), *,
                      only: DataFrame | None = None, short_rows: int = SHORT_ROWS) -> DataFrame:
    """Add ``pos``, ``chosen`` (NULL when nothing was eligible) and ``parts``.

    ``records`` has exactly the six inference columns (see contracts.require_record_schema); ``only`` (image_stem, swing_id)
    names the frames to choose on, else all. The prepared frames are stored once, as files. Candidate lists are wide: those of a
    sequence of at most ``short_rows`` frames are dealt out once, by sequence, and its frames are filtered, numbered, scored
    and walked there. Longer sequences are cut (``_cut_sequences``); no more than one in ``short_rows`` frames is named as such.
    """
    box = first_box(records, settings)
    prepared = filed(records.select(
        *KEYS, F.size("detections").alias("n_detections"), *[e.alias(n) for n, e in box.items()],
        eligible(pixel_candidates(F.col("detections"), settings.width, settings.height)).alias("eligible")).withColumn(
        "n_eligible", F.size("eligible")), "candidates")
    lists = prepared.drop("first_x", "first_y")
    boxes = prepared.select("image_stem", "swing_id", "first_x", "first_y")
    anchors = sequence_anchors(boxes if only is None else boxes.join(only.select("image_stem").distinct(), "image_stem", "left_semi"), settings)
    sizes = prepared.groupBy("swing_id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > short_rows).select("swing_id")
    if sizes.isEmpty():
        return _whole_sequences(lists, anchors, only, settings)
    sizes = F.broadcast(materialised(sizes))
    cut = lists.join(sizes, "swing_id", "left_semi")
    if only is not None:
        cut = cut.join(only.select("image_stem").distinct(), "image_stem", "left_semi")
        only = only.join(sizes, "swing_id", "left_anti")
    return _whole_sequences(lists.join(sizes, "swing_id", "left_anti"), anchors, only, settings).unionByName(
        _cut_sequences(cut, anchors, settings))


def _whole_sequences(prepared: DataFrame, anchors: DataFrame, only: DataFrame | None, settings: SelectionSettings) -> DataFrame:
    """Choices of sequences that one group holds: every step after the exchange by sequence finds the rows in place."""
    tasks = int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prepared.filter(F.col("swing_id").isNotNull()).repartition(tasks, "swing_id")
    if only is not None:
        names = only.groupBy("swing_id").agg(F.collect_set("image_stem").alias("__names"))
        rows = rows.join(names.hint("shuffle_hash"), "swing_id").filter(F.array_contains("__names", F.col("image_stem"))).drop("__names")
    rows = rows.join(anchors.hint("shuffle_hash"), "swing_id", "left")
    last = F.col("frame_no").isNull()
    w = Window.partitionBy("swing_id").orderBy(last, F.coalesce(F.col("frame_no"), F.lit(0)), "frame_name", "prediction_stem")
    has = F.col("n_eligible") > 0
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "pos": (F.row_number().over(w) - 1).cast("bigint"),
        "__before": F.last(F.when(has, F.struct("frame_no", "eligible")), ignorenulls=True).over(ahead)})
    rows = rows.withColumns({
        "earlier": F.col("__before.eligible"),
        "gap": F.greatest(F.lit(1), F.coalesce(F.col("frame_no") - F.col("__before.frame_no"), F.lit(1)))})
    rows = rows.withColumn("step", F.when(has, _step(settings)))
    rest = [*[k for k in KEYS if k != "swing_id"], "n_detections", "eligible", "gap", "anchor_x", "anchor_y"]
    groups = rows.groupBy("swing_id").agg(F.sort_array(F.collect_list(F.struct("pos", "step", *rest))).alias("items"))
    walked = F.aggregate(
        "items", F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("path")),
        lambda acc, item: F.struct(
            F.when(item["step"].isNull(), acc["s"]).otherwise(F.get(item["step"], acc["s"])).alias("s"),
            F.concat(acc["path"], F.array(F.when(item["step"].isNotNull(), F.get(item["step"], acc["s"])))).alias("path")))["path"]
    each = groups.select("swing_id", F.inline(F.arrays_zip(F.col("items").alias("f"), walked.alias("at"))))
    each = each.select("swing_id", "f.*", F.get("f.eligible", F.col("at")).alias("chosen")).drop("step", "eligible")
    each = each.withColumn("before_c", F.last("chosen", ignorenulls=True).over(
        Window.partitionBy("swing_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    parts = score_parts(F.col("chosen"), F.col("before_c"), F.col("gap"), F.col("anchor_x"), F.col("anchor_y"), settings)
    scored = F.when(F.col("chosen").isNotNull(), F.struct(*[e.alias(n) for n, e in parts.items()]))
    return each.select(*KEYS, "n_detections", "pos", "chosen", scored.alias("parts"))


def _cut_sequences(prepared: DataFrame, anchors: DataFrame, settings: SelectionSettings) -> DataFrame:
    """Choices of sequences of any length.

    The scored tables are stored, since the composition and the walk read them. Candidate lists are dealt out by frame bin and by
    block: the anchor comes with the numbering, the states of a block come to its frames where they lie, and frames
    without an eligible candidate are numbered without the lists.
    """
    keys = list(KEYS)
    frames = ordered_records(prepared, anchors)
    payload = ["prediction_stem", "image_stem", "frame_no", "frame_name", "n_detections", "pos",
               "eligible", "earlier", "gap", "anchor_x", "anchor_y"]

    tasks = int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = with_halo(frames.filter(F.col("n_eligible") > 0), before=1, after=0, pos="turn", rows=FOLD_ROWS, tasks=tasks)
    w = block_window(pos="turn")
    gap = F.greatest(F.lit(1), F.coalesce(F.col("frame_no") - F.lag("frame_no").over(w), F.lit(1)))
    turns = turns.withColumns({"earlier": F.lag("eligible").over(w), "gap": gap}).filter(~F.col("is_halo"))

    turns = materialised(turns.withColumn("step", _step(settings)))
    # Only numbers and tables go through the fold; the frames meet their states by turn.
    longest = turns.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    paths = follow_states(turns, "swing_id", "turn", "step", [], block="block", levels=fold_levels(longest, FOLD_FAN), fan=FOLD_FAN, by_block=True)
    walked = turns.select("swing_id", "block", "turn", *payload).join(paths.hint("shuffle_hash"), ["swing_id", "block"])
    walked = walked.withColumn("state", F.get("path", (F.col("turn") - F.col("first")).cast("int"))).drop("path", "first")
    chosen = F.get(F.col("eligible"), F.col("state.after"))
    before = F.get(F.col("earlier"), F.col("state.before"))
    parts = score_parts(F.col("chosen"), F.col("before_c"), F.col("gap"), F.col("anchor_x"), F.col("anchor_y"), settings)
    picked = walked.withColumns({"chosen": chosen, "before_c": before}).select(
        *keys, "n_detections", "pos", "chosen", F.struct(*[e.alias(n) for n, e in parts.items()]).alias("parts"))
    empty = ordered_records(prepared.drop("eligible")).filter(F.col("n_eligible") == 0).select(*keys, "n_detections", "pos")
    return picked.unionByName(empty, allowMissingColumns=True)


def screen_outliers(selected: DataFrame, limits: ScreenSettings = ScreenSettings(), *, digits: int | None = None) -> DataFrame:
    """Compare each choice with its neighbouring rows; needs ``pos`` and ``chosen``.

    Adds length_ratio, center_dist, center_threshold, length_outlier, center_outlier,
    outlier_reason and drop_reason (center_outlier, length_outlier or NULL). With ``digits`` the three
    numbers are rounded before limits and text, so that neither depends on the last bit of a double.
    """
    def number(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)
    k = limits.window
    rows = with_halo(selected, before=k, after=k)
    w = block_window()
    item = F.when(F.col("chosen").isNotNull(), F.struct(
        F.col("chosen.length").alias("length"), F.col("chosen.cx").alias("cx"), F.col("chosen.cy").alias("cy")))
    rows = rows.withColumn("__i", item)
    near = F.concat(
        F.collect_list("__i").over(w.rowsBetween(-k, -1)), F.collect_list("__i").over(w.rowsBetween(1, k)))
    rows = rows.withColumn("near", near).filter(~F.col("is_halo"))
    rows = rows.withColumns({
        "__ml": S.array_median(F.sort_array(F.col("near.length"))),
        "__mx": S.array_median(F.sort_array(F.col("near.cx"))),
        "__my": S.array_median(F.sort_array(F.col("near.cy"))),
    })
    spread = S.array_median(F.sort_array(F.transform(
        "near", lambda o: F.hypot(o["cx"] - F.col("__mx"), o["cy"] - F.col("__my")))))
    rows = rows.withColumns({
        "neighbors": F.size("near"),
        "enough": F.col("chosen").isNotNull() & (F.size("near") >= limits.min_neighbors),
        "length_ratio": number(F.when(F.col("__ml") > 1, F.col("chosen.length") / F.col("__ml")).otherwise(1.0)),
        "center_dist": number(F.hypot(F.col("chosen.cx") - F.col("__mx"), F.col("chosen.cy") - F.col("__my"))),
        "center_threshold": number(F.greatest(F.lit(limits.center_base), limits.center_spread_weight * spread)),
    })
    r, d, t = F.col("length_ratio"), F.col("center_dist"), F.col("center_threshold")
    rows = rows.withColumns({
        "length_outlier": F.coalesce(F.col("enough") & ((r < limits.min_length_ratio) | (r > limits.max_length_ratio)), F.lit(False)),
        "center_outlier": F.coalesce(F.col("enough") & (d > t), F.lit(False)),
    })
    lo, co = F.col("length_outlier"), F.col("center_outlier")
    length = F.concat(F.lit("length_ratio="), S.fixed_text(r, 3))
    centre = F.concat(F.lit("center_dist="), S.fixed_text(d, 1), F.lit(",center_threshold="), S.fixed_text(t, 1))
    reason = (
        F.when(lo & co, F.concat(F.lit("length_and_center_outlier:"), length, F.lit(","), centre))
        .when(lo, F.concat(F.lit("length_outlier:"), length))
        .when(co, F.concat(F.lit("center_outlier:"), centre))
        .when(F.col("chosen").isNotNull() & (F.col("neighbors") < limits.min_neighbors), "not_enough_neighbors")
        .otherwise("")
    )
    drop = F.when(co, "center_outlier").when(lo, "length_outlier")
    return rows.withColumns({"outlier_reason": reason, "drop_reason": drop}).drop(
        "__i", "__ml", "__mx", "__my", "near", "block", "is_halo", "enough")
