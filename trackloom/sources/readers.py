"""File scans. CSV is read as text, so blank and broken numbers stay visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators.contracts import require_columns
from trackloom.schemas import DETAIL_COLUMNS, DETAIL_NUMBERS, DETECTION_TYPE, IMAGE_EXTENSIONS, KEYPOINTS


def read_csv_text(spark: SparkSession, paths: str | list[str], *, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; ``line_no`` follows file order inside a file."""
    df = spark.read.option("header", True).option("encoding", encoding).option("multiLine", False).csv(paths)
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
    return df.withColumn("line_no", F.monotonically_increasing_id())


def typed_details(raw: DataFrame) -> DataFrame:
    require_columns(raw, [c for c in DETAIL_COLUMNS if c not in ("view", "batter_side")], "detail rows")
    out = {c: S.parse_number(F.col(c)) for c in DETAIL_NUMBERS if c in raw.columns}
    out["detection_rank"] = S.parse_number(F.col("detection_rank")).cast("int")
    return raw.withColumns(out)


def read_details(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return typed_details(read_csv_text(spark, paths))


def strict_number(text: Column) -> Column:
    """Blank is NULL, anything else must be a number (ANSI cast raises)."""
    return F.when(F.trim(text) != "", F.trim(text).cast("double"))


def annotation_rows(raw: DataFrame, line: str = "line_no") -> DataFrame:
    """Annotations keyed by sequence and frame stem, the last line wins."""
    from trackloom.operators.reshape import last_row_wins
    keyed = raw.withColumn("image_stem", F.concat_ws("_", "swing_id", S.file_stem(F.col("frame"))))
    num = [c for c in ("head_x", "head_y", "tail_x", "tail_y", "bat_visible_aux_x", "bat_visible_aux_y") if c in raw.columns]
    keyed = keyed.withColumns({c: strict_number(F.col(c).cast("string")) for c in num})
    return last_row_wins(keyed, ["image_stem"], line).drop(line)


def read_annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return annotation_rows(read_csv_text(spark, paths))


def read_clip_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    from trackloom.operators.reshape import clip_metadata
    return clip_metadata(read_csv_text(spark, paths), "line_no")


def export_clip_columns(raw: DataFrame, line: str = "line_no") -> DataFrame | None:
    """view and batter_side by name; None when a required column is missing."""
    from trackloom.operators.reshape import last_row_wins
    if not {"name", "view", "batter_side"} <= set(raw.columns):
        return None
    rows = raw.select(F.trim("name").alias("swing_id"), *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("view", "batter_side")], line)
    return last_row_wins(rows.filter(F.col("swing_id") != ""), ["swing_id"], line).drop(line)


def parse_detections(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per file with its ranked detections (empty array when nothing parses).

    Lines with a non-number or fewer than 11 values are skipped; a 12th value is the
    box confidence. Ties in confidence keep line order.
    """
    words = F.transform(F.split(F.col(text), r"\r\n|\n|\r"), lambda line: F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != ""))
    numbers = F.transform(words, lambda ws: F.transform(ws, lambda w: w.try_cast("double")))
    usable = F.filter(
        F.transform(numbers, lambda v, i: F.struct(i.alias("line"), v.alias("v"))),
        lambda r: (F.size(r["v"]) >= 11) & ~F.exists(r["v"], lambda x: x.isNull()))

    def ranked(r):
        v = r["v"]
        conf = F.when(F.size(v) >= 12, F.element_at(v, -1)).otherwise(1.0)
        return F.struct((-conf).alias("order"), r["line"].alias("line"), v.alias("v"), conf.alias("conf"))

    def detection(r, i):
        v = r["v"]
        pt = lambda at: F.struct(F.get(v, F.lit(at)).alias("x"), F.get(v, F.lit(at + 1)).alias("y"), F.get(v, F.lit(at + 2)).alias("conf"))
        box = F.struct(*[F.get(v, F.lit(n + 1)).alias(c) for n, c in enumerate(("xc", "yc", "w", "h"))])
        return F.struct((i + 1).cast("int").alias("detection_rank"), r["conf"].alias("bbox_conf"), box.alias("bbox"),
                        pt(5).alias("head"), pt(8).alias("tail"))
    lines = F.sort_array(F.transform(usable, ranked))
    return texts.select(S.file_stem(F.col(path)).alias("prediction_stem"), F.transform(lines, detection).cast(
        f"array<{DETECTION_TYPE.simpleString()}>").alias("detections"))


def read_detections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Detector label files; one small file is one frame, so it is read as one text.

    File sources skip files of length zero; ``frame_population`` with the image list
    brings those frames back with an empty array.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(paths, wholetext=True)
    return parse_detections(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def image_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    pattern = r"(?i)\.(" + "|".join(IMAGE_EXTENSIONS) + ")$"
    return paths.filter(F.col(path).rlike(pattern))


def list_files(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """Distinct file paths under folders or wildcards; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths)
    return files.select("path", "length").dropDuplicates(["path"])


def prediction_folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """(run folder, label folder) of label files, each once."""
    folder = F.regexp_replace(F.col(path), r"/[^/]*$", "")
    return paths.select(F.regexp_replace(folder, r"/labels$", "").alias("run_dir"), folder.alias("labels_dir")).distinct()


def frame_population(detections: DataFrame, images: DataFrame | None) -> DataFrame:
    """Label stems and image stems; frames without labels keep an empty list."""
    if images is None:
        return detections
    stems = images.select(S.file_stem(F.col("path")).alias("prediction_stem")).union(detections.select("prediction_stem")).distinct()
    out = stems.join(detections, "prediction_stem", "left")
    return out.withColumn("detections", F.coalesce("detections", F.array().cast(detections.schema["detections"].dataType)))


def fingerprints(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select("path", F.sha2(F.col(content), 256).alias("sha256"))


def read_fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return fingerprints(spark.read.format("binaryFile").load(paths))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Split file {"train": [...], "val": [...], "test": [...]} as two columns."""
    raw = spark.read.option("multiLine", True).json(path)
    names = [c for c in raw.columns]
    return raw.select(F.inline(F.array(*[F.struct(F.lit(n).alias("split"), F.col(n).alias("ids")) for n in names]))).select(
        F.explode("ids").alias("swing_id"), "split")


def projected_rows(raw: DataFrame) -> DataFrame:
    """Canonical names for track rows that use either point naming or any id alias."""
    have = set(raw.columns)
    if {"head_u", "head_v", "tail_u", "tail_v"} <= have:
        pts = {f"{k}_{a}": F.col(f"{k}_{a}") for k in KEYPOINTS for a in "uv"}
    elif {"head_x", "head_y", "tail_x", "tail_y"} <= have:
        pts = {f"{k}_{a}": F.col(f"{k}_{b}") for k in KEYPOINTS for a, b in (("u", "x"), ("v", "y"))}
    else:
        raise ValueError("track rows need head_u/head_v/tail_u/tail_v or head_x/head_y/tail_x/tail_y")

    def text(*names: str) -> Column:
        return S.first_text(*[F.col(n).cast("string") if n in have else F.lit(None).cast("string") for n in names])
    opt = lambda n: F.col(n).cast("string") if n in have else F.lit(None).cast("string")
    return raw.withColumns({
        **{n: S.parse_number(e.cast("string")) for n, e in pts.items()},
        "swing_id": text("swing_id", "sequence_id", "source_c3d"),
        "view_id": S.view_key(opt("view_id"), opt("camera_id"), opt("camera_name"), opt("mirror")),
        "frame_idx": S.parse_integer(text("frame_idx", "frame", "image_stem")),
        "time_sec": S.parse_number(opt("time_sec")),
        "batter_hand": opt("batter_hand"),
        "camera_name": F.coalesce(text("camera_name", "view_id", "camera_id"), F.lit("random"))}).filter(F.col("swing_id").isNotNull())
