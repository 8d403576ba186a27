"""3D marker tracks through virtual cameras to pixel tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import keyed_random as R
from trackloom.functions import scalars as S
from trackloom.operators.quantiles import group_quantiles
from trackloom.operators.sequence import BLOCK_ROWS, with_sequence_facts
from trackloom.schemas import BAT_MARKERS, BODY_MARKERS

FOCAL_MM, SENSOR_MM, DISTANCE_SCALE = 35.0, 36.0, 5.0
CAMERA_FIELDS = ("yaw", "pitch", "roll", "zoom", "pan_x", "pan_y")


def valid_xyz(x: Column, y: Column, z: Column) -> Column:
    x, y, z = S.finite(x), S.finite(y), S.finite(z)
    return F.coalesce(F.sqrt(x * x + y * y + z * z) > 1e-9, F.lit(False))


def bat_track(markers: DataFrame) -> DataFrame:
    """Tail is marker 1, head the mean of markers 2 and 3; other sources are skipped."""
    m = F.upper("marker")
    bat = markers.filter(m.isin(*BAT_MARKERS))
    xyz = F.struct(*[S.finite(F.col(a)).alias(a) for a in "xyz"])
    wide = bat.groupBy("source", "sequence_id", "frame_idx", "fps").agg(
        *[F.max(F.when(m == name, xyz)).alias(f"m{i + 1}") for i, name in enumerate(BAT_MARKERS)])
    return wide.filter(F.col("m1").isNotNull() & F.col("m2").isNotNull() & F.col("m3").isNotNull()).select(
        "source", "sequence_id", "frame_idx", "fps",
        *[F.col(f"m1.{a}").alias(f"tail_{a}") for a in "xyz"],
        *[((F.col(f"m2.{a}") + F.col(f"m3.{a}")) / 2).alias(f"head_{a}") for a in "xyz"])


def _ok(k: str) -> Column:
    return valid_xyz(*[F.col(f"{k}_{a}") for a in "xyz"])


def unit_scales(track: DataFrame) -> DataFrame:
    """Per sequence: 0.001 when the median length says millimetres."""
    length = F.sqrt(sum(((F.col(f"head_{a}") - F.col(f"tail_{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    rows = track.select("sequence_id", F.when(_ok("head") & _ok("tail"), length).alias("length"))
    med = group_quantiles(rows, ["sequence_id"], {"length": F.col("length")}, {"p50": 0.5})
    ids = track.select("sequence_id").distinct()
    m = F.col("length_p50")
    return ids.join(med, "sequence_id", "left").select(
        "sequence_id", F.when(m > 10, 0.001).otherwise(1.0).alias("scale"),
        F.when(m > 10, "mm_to_m").when(m.isNotNull(), "already_m").otherwise("unknown").alias("unit_mode"))


def scaled_track(track: DataFrame) -> DataFrame:
    out = with_sequence_facts(track, unit_scales(track))
    return out.withColumns({f"{k}_{a}": F.col(f"{k}_{a}") * F.col("scale") for k in ("head", "tail") for a in "xyz"})


def scene_bounds(track: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """Centre and radius of all valid points of a sequence (scaled units)."""
    pts = track.select("sequence_id", F.inline(F.array(*[
        F.struct(*[F.col(f"{k}_{a}").alias(a) for a in "xyz"]) for k in ("head", "tail")])))
    if body is not None:
        pts = pts.unionByName(body.select("sequence_id", "x", "y", "z"))
    pts = pts.filter(valid_xyz(F.col("x"), F.col("y"), F.col("z")))
    agg = pts.groupBy("sequence_id").agg(*[
        f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.avg, "center"), (F.min, "lo"), (F.max, "hi"))])
    span = sum(((F.col(f"hi_{a}") - F.col(f"lo_{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    return agg.select("sequence_id", *[f"center_{a}" for a in "xyz"], (F.sqrt(span) * 0.5).alias("radius"))


def configured_views(seqs: DataFrame, views: Sequence[dict], random_views: int = 0) -> DataFrame:
    """Attach a configured camera list (plus N random ones) to every sequence.

    The list is configuration, so it is a literal array that is exploded.
    """
    ranges = {"yaw": (0.0, 360.0), "pitch": (-12.0, 28.0), "roll": (-4.0, 4.0), "zoom": (0.7, 1.4),
              "pan_x": (-0.18, 0.18), "pan_y": (-0.14, 0.14)}
    specs = [dict(v) for v in views] + [{"type": "random", "name": "random", **ranges} for _ in range(random_views)]
    defaults = {"yaw": 0.0, "pitch": 8.0, "roll": 0.0, "zoom": 1.0, "pan_x": 0.0, "pan_y": 0.0}
    items = []
    for i, v in enumerate(specs):
        cols = [F.lit(f"cam_{i:03d}").alias("camera_id"), F.lit(v.get("type", "configured")).alias("camera_type"),
                F.lit(v.get("name", f"view_{i + 1:02d}")).alias("camera_name")]
        for f in CAMERA_FIELDS:
            value = v.get(f, defaults[f])
            lo, hi = (value, value) if isinstance(value, (int, float)) else (value[0], value[-1])
            cols += [F.lit(float(lo)).alias(f"{f}_lo"), F.lit(float(hi)).alias(f"{f}_hi")]
        items.append(F.struct(*cols))
    return seqs.select("sequence_id", F.inline(F.array(*items)))


def sequence_cameras(seqs: DataFrame, cameras: DataFrame) -> DataFrame:
    """Cameras of the rig of each sequence (equi-join on ``rig``)."""
    return seqs.select("sequence_id", "rig").join(cameras, "rig")


def sample_cameras(assigned: DataFrame, seed: int) -> DataFrame:
    """Draw each camera field once per (sequence, camera), uniform in its range."""
    out = {f: F.col(f"{f}_lo") + R.uniform(seed, f, F.col("sequence_id"), F.col("camera_id")) * (F.col(f"{f}_hi") - F.col(f"{f}_lo"))
           for f in CAMERA_FIELDS}
    return assigned.select("sequence_id", "camera_id", "camera_type", "camera_name", *[e.alias(f) for f, e in out.items()])


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def camera_basis(cams: DataFrame, bounds: DataFrame) -> DataFrame:
    """eye, right, up, forward per (sequence, camera)."""
    j = cams.join(bounds, "sequence_id")
    c = F.col
    yaw, pitch, roll = (F.radians(c(f)) for f in ("yaw", "pitch", "roll"))
    direction = (F.cos(pitch) * F.cos(yaw), F.cos(pitch) * F.sin(yaw), F.sin(pitch))
    dist = F.greatest(c("radius"), F.lit(1.0)) * DISTANCE_SCALE
    j = j.withColumns({"distance": dist, **{f"f{a}": -d for a, d in zip("xyz", direction)}})
    j = j.withColumns({f"eye_{a}": c(f"center_{a}") - c(f"f{a}") * c("distance") for a in "xyz"})
    f = (c("fx"), c("fy"), c("fz"))
    steep = F.abs(f[2]) > 0.98
    world = (F.lit(0.0), F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0))
    r = _cross(f, world)
    norm = F.sqrt(_dot(r, r))
    j = j.withColumns({f"r{a}": v / norm for a, v in zip("xyz", r)})
    r = (c("rx"), c("ry"), c("rz"))
    j = j.withColumns({f"u{a}": v for a, v in zip("xyz", _cross(r, f))})
    cs, sn = F.cos(roll), F.sin(roll)
    turned = F.abs(roll) > 1e-9
    j = j.withColumns({
        **{f"right_{a}": F.when(turned, cs * c(f"r{a}") + sn * c(f"u{a}")).otherwise(c(f"r{a}")) for a in "xyz"},
        **{f"up_{a}": F.when(turned, -sn * c(f"r{a}") + cs * c(f"u{a}")).otherwise(c(f"u{a}")) for a in "xyz"}})
    return j.withColumnsRenamed({f"f{a}": f"fwd_{a}" for a in "xyz"}).drop(*[f"{p}{a}" for p in "ru" for a in "xyz"])


def project(point: Sequence[Column], width: float, height: float) -> dict[str, Column]:
    """u, v, depth, in_frame of a point for the camera columns of the row."""
    rel = [p - F.col(f"eye_{a}") for p, a in zip(point, "xyz")]
    x, y, z = (sum((r * F.col(f"{n}_{a}") for r, a in zip(rel, "xyz")), F.lit(0.0)) for n in ("right", "up", "fwd"))
    focal = F.col("zoom") * (FOCAL_MM / SENSOR_MM * width)
    front = z > 1e-6
    u = F.when(front, focal * x / z + width * (0.5 + F.col("pan_x")))
    v = F.when(front, height * (0.5 + F.col("pan_y")) - focal * y / z)
    inside = F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))
    return {"u": u, "v": v, "depth": z, "in_frame": inside}


def project_tracks(track: DataFrame, basis: DataFrame, *, width: float = 1920.0, height: float = 1080.0,
                   keep_only_visible: bool = False, part: str | None = None) -> DataFrame:
    """Every valid frame of a sequence seen by each of its cameras; ``part`` see ``with_sequence_facts``."""
    rows = with_sequence_facts(track.filter(_ok("head") & _ok("tail")), basis, fan_out=True, part=part)
    cols = {}
    for k in ("head", "tail"):
        cols.update({f"{k}_{n}": e for n, e in project([F.col(f"{k}_{a}") for a in "xyz"], width, height).items()})
    rows = rows.withColumns(cols)
    if keep_only_visible:
        rows = rows.filter(in_frame())
    dx, dy = F.col("tail_u") - F.col("head_u"), F.col("tail_v") - F.col("head_v")
    return rows.select(
        F.col("source").alias("source_c3d"), "sequence_id", "camera_id", "camera_type", "camera_name",
        F.lit("none").alias("mirror"), S.hand_from_name(S.file_stem(F.col("source"))).alias("batter_hand"), "frame_idx",
        F.when(F.col("fps") > 0, F.col("frame_idx") / F.col("fps")).alias("time_sec"), "unit_mode",
        F.lit(int(width)).alias("image_width"), F.lit(int(height)).alias("image_height"),
        F.col("yaw").alias("camera_yaw_deg"), F.col("pitch").alias("camera_pitch_deg"), F.col("roll").alias("camera_roll_deg"),
        F.col("zoom").alias("camera_zoom"), F.col("pan_x").alias("camera_pan_x"), F.col("pan_y").alias("camera_pan_y"),
        F.col("distance").alias("camera_distance_m"),
        *[f"{k}_{n}" for k in ("head", "tail") for n in ("u", "v", "depth", "in_frame")],
        dx.alias("tail_from_head_dx"), dy.alias("tail_from_head_dy"), F.sqrt(dx * dx + dy * dy).alias("bat_pixel_length"),
        *[F.col(f"{k}_{a}").alias(f"{k}_3d_{a}") for k in ("head", "tail") for a in "xyz"], *([part] if part else []))


def in_frame() -> Column:
    return F.col("head_in_frame") & F.col("tail_in_frame")


def skeleton(body: DataFrame, basis: DataFrame, *, width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """``skeleton``: an array of (marker, u, v, depth, in_frame) in the order of the 26 body markers, for each
    (sequence, camera, frame); NULL values where a marker is absent.

    A frame's markers are gathered once, at most 26, and column arithmetic projects them for each camera.
    """
    names = F.array(*[F.lit(m) for m in BODY_MARKERS])
    known = body.filter(F.col("marker").isin(*BODY_MARKERS) & valid_xyz(F.col("x"), F.col("y"), F.col("z"))).select(
        "sequence_id", F.floor(F.col("frame_idx") / BLOCK_ROWS).alias("__part"), "frame_idx",
        F.array_position(names, F.col("marker")).cast("int").alias("__i"), F.struct("x", "y", "z").alias("p"))
    # Marker rows move once, by (sequence, frame part): frames are gathered and meet their cameras where they lie.
    place = ["sequence_id", "__part"]
    laid = known.repartition(int(body.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place)
    single = laid.groupBy(*place, "frame_idx", "__i").agg(F.max("p").alias("p"))
    frames = single.groupBy(*place, "frame_idx").agg(F.map_from_entries(F.collect_list(F.struct("__i", "p"))).alias("known"))
    points = F.array(*[F.try_element_at("known", F.lit(i + 1)) for i in range(len(BODY_MARKERS))])
    cameras = known.select(*place).distinct().join(basis, "sequence_id")
    rows = frames.select(*place, "frame_idx", points.alias("points")).join(cameras, place)

    def seen(i: int) -> Column:
        values = project([F.col("points")[i][a] for a in "xyz"], width, height)
        return F.struct(F.lit(BODY_MARKERS[i]).alias("marker"), *[e.alias(n) for n, e in values.items()])
    # Spelled out by marker: compiled, and a reader of single values computes only those.
    return rows.select("sequence_id", "camera_id", "frame_idx", F.array(*[seen(i) for i in range(len(BODY_MARKERS))]).alias("skeleton"))


def skeleton_columns(rows: DataFrame, values: Sequence[str] = ("u", "v", "depth", "in_frame")) -> DataFrame:
    """``skel_{marker}_{value}`` columns of a skeleton, for flat files."""
    rest = [c for c in rows.columns if c != "skeleton"]
    return rows.select(*rest, *[F.col("skeleton")[i][v].alias(f"skel_{m}_{v}") for i, m in enumerate(BODY_MARKERS) for v in values])


def mirror_rows(rows: DataFrame, width_col: str = "image_width") -> DataFrame:
    """Each row and its horizontal mirror image, side by side."""
    m = F.col("mirror") == "horizontal"
    out = rows.drop("mirror").withColumn("mirror", F.explode(F.array(F.lit("none"), F.lit("horizontal"))))
    cols = {c: F.when(m, F.col(width_col) - 1 - F.col(c)).otherwise(F.col(c)) for c in rows.columns if c.endswith("_u")}
    name, hand = F.col("camera_name"), F.col("batter_hand")
    cols["tail_from_head_dx"] = F.when(m, -F.col("tail_from_head_dx")).otherwise(F.col("tail_from_head_dx"))
    cols["batter_hand"] = F.when(m & (hand == "R"), "L").when(m & (hand == "L"), "R").otherwise(hand)
    cols["camera_name"] = (
        F.when(m & name.contains("1B_side"), F.replace(name, F.lit("1B_side"), F.lit("3B_side")))
        .when(m & name.contains("3B_side"), F.replace(name, F.lit("3B_side"), F.lit("1B_side"))).otherwise(name))
    return out.withColumns(cols).select(*rows.columns)


def usable_sources(files: DataFrame, path: str = "path", *, include_model: bool = False, max_files: int | None = None) -> DataFrame:
    """Source files without "model" in their name, sorted, at most ``max_files``."""
    name = F.lower(F.regexp_replace(F.col(path), r"^.*/", ""))
    out = files if include_model else files.filter(~name.contains("model"))
    return out.orderBy(path).limit(max_files) if max_files is not None else out


def uppercase_only_sources(markers: DataFrame) -> DataFrame:
    """Sources that have all bat markers, but not all in canonical case."""
    canonical = F.col("marker").isin("Marker1", "Marker2", "Marker3")
    agg = markers.filter(F.upper("marker").isin(*BAT_MARKERS)).groupBy("source").agg(
        F.count_distinct(F.upper("marker")).alias("all_case"),
        F.count_distinct(F.when(canonical, F.col("marker"))).alias("exact_case"))
    return agg.filter((F.col("all_case") == 3) & (F.col("exact_case") < 3)).select("source")
