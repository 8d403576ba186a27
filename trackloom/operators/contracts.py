"""Data contracts: schema guards, key checks, alignment, splits."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import scalars as S
from trackloom.operators.sequence import with_positions
from trackloom.schemas import (
    DETECTION_FIELDS, FEATURE_SCHEMA_VERSION, FEATURES_25, FEATURES_45, RECORD_COLUMNS, SCORE_PARTS,
)

PREDICTION_FIELDS = ("pred_x", "pred_y", "pred_conf")
BOX_FIELDS = ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def require_record_schema(df: DataFrame) -> DataFrame:
    """Reject any column beyond the inference inputs, at both levels."""
    missing = sorted(set(RECORD_COLUMNS) - set(df.columns))
    extra = sorted(set(df.columns) - set(RECORD_COLUMNS))
    if missing or extra:
        raise ValueError(f"candidate records break the inference-only schema: missing={missing} unexpected={extra}")
    element = df.schema["detections"].dataType
    if not isinstance(element, T.ArrayType) or not isinstance(element.elementType, T.StructType):
        raise ValueError("detections must be an array of structs")
    allowed = set(DETECTION_FIELDS) | set(SCORE_PARTS) | {"score", "is_outlier", "outlier_reason"}
    unknown = sorted(set(element.elementType.names) - allowed)
    if unknown:
        raise ValueError(f"detections contain unsupported fields: {unknown}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def key_differences(selected: DataFrame, flow: DataFrame) -> DataFrame:
    """Frame keys on one side only, with the side they are missing from."""
    keys = ["swing_id", "image_stem"]
    a = selected.select(*keys).distinct().withColumn("in_selected", F.lit(True))
    b = flow.select(*keys).distinct().withColumn("in_flow", F.lit(True))
    both = a.join(b, keys, "full")
    return both.filter(F.col("in_selected").isNull() | F.col("in_flow").isNull()).select(
        *keys, F.when(F.col("in_flow").isNull(), "missing").otherwise("extra").alias("problem"))


def _same(a, b):
    """Both missing, or both finite and equal; an infinity never matches."""
    nan_a, nan_b = a.isNull() | F.isnan(a), b.isNull() | F.isnan(b)
    fa, fb = S.finite(a), S.finite(b)
    return (nan_a & nan_b) | F.coalesce(fa == fb, F.lit(False))


def value_mismatches(selected: DataFrame, flow: DataFrame) -> DataFrame:
    """(frame, keypoint, field) whose prediction differs between long and wide rows."""
    keys = ["swing_id", "image_stem"]
    pts = selected.filter(F.col("keypoint").isin("head", "tail"))
    wide = pts.groupBy(*keys).agg(*[
        F.max(F.when(F.col("keypoint") == k, F.struct(F.col(f).alias("v"))))["v"].alias(f"s_{k}_{f}")
        for k in ("head", "tail") for f in PREDICTION_FIELDS])
    cmp = wide.join(flow.select(*keys, *[f"{k}_{f}" for k in ("head", "tail") for f in PREDICTION_FIELDS]), keys, "inner")
    checks = F.array(*[
        F.struct(F.lit(k).alias("keypoint"), F.lit(f).alias("field"), F.col(f"s_{k}_{f}").alias("selected"),
                 F.col(f"{k}_{f}").alias("flow")) for k in ("head", "tail") for f in PREDICTION_FIELDS])
    return cmp.select(*keys, F.inline(checks)).filter(~_same(F.col("selected"), F.col("flow")))


def box_mismatches(selected: DataFrame, flow: DataFrame) -> DataFrame:
    """Box corners that differ inside a frame, or from the flow table's echo."""
    keys = ["swing_id", "image_stem"]
    pts = selected.filter(F.col("keypoint").isin("head", "tail"))
    agg = pts.groupBy(*keys).agg(*[a for f in BOX_FIELDS for a in (
        F.min(S.finite(F.col(f))).alias(f"lo_{f}"), F.max(S.finite(F.col(f))).alias(f"hi_{f}"))])
    both = agg.join(flow.select(*keys, *BOX_FIELDS), keys, "inner")
    checks = F.array(*[F.struct(
        F.lit(f).alias("field"),
        F.when(F.col(f"lo_{f}") != F.col(f"hi_{f}"), "inconsistent")
        .when(~_same(F.col(f"lo_{f}"), F.col(f)), "mismatch").alias("problem")) for f in BOX_FIELDS])
    return both.select(*keys, F.inline(checks)).filter(F.col("problem").isNotNull())


def alignment_counts(selected: DataFrame, flow: DataFrame) -> DataFrame:
    """Frames, sequences and every kind of violation (0 when aligned), as (measure, value) rows.

    One aggregate of the selected rows, one full join with the flow rows, and sums.
    """
    keys = ["swing_id", "image_stem"]
    points = [(k, f) for k in ("head", "tail") for f in PREDICTION_FIELDS]
    pts = selected.filter(F.col("keypoint").isin("head", "tail"))
    hit = {k: F.col("keypoint") == k for k in ("head", "tail")}
    frames = pts.groupBy(*keys).agg(
        F.lit(True).alias("here"),
        *[F.count(F.when(h, 1)).alias(f"__n_{k}") for k, h in hit.items()],
        *[F.max(F.when(hit[k], F.struct(F.col(f).alias("v"))))["v"].alias(f"__s_{k}_{f}") for k, f in points],
        *[e for f in BOX_FIELDS for e in (F.min(S.finite(F.col(f))).alias(f"__lo_{f}"), F.max(S.finite(F.col(f))).alias(f"__hi_{f}"))])
    other = flow.select(*keys, F.lit(True).alias("there"), *[f"{k}_{f}" for k, f in points], *BOX_FIELDS)

    def times(conditions: list) -> Column:
        total = F.lit(0).cast("bigint")
        for c in conditions:
            total = total + F.coalesce(c, F.lit(False)).cast("bigint")
        return total

    pair = F.col("here").isNotNull() & F.col("there").isNotNull()
    box = [F.coalesce(F.col(f"__lo_{f}") != F.col(f"__hi_{f}"), F.lit(False)) | ~_same(F.col(f"__lo_{f}"), F.col(f)) for f in BOX_FIELDS]
    rows = frames.join(other, keys, "full").select(
        *keys, "here", "there", times([F.col("__n_head") > 1, F.col("__n_tail") > 1]).alias("twice"),
        F.when(pair, times([~_same(F.col(f"__s_{k}_{f}"), F.col(f"{k}_{f}")) for k, f in points])).otherwise(0).alias("value"),
        F.when(pair, times(box)).otherwise(0).alias("box"))
    per_key = rows.groupBy(*keys).agg(
        F.max(F.col("here").isNotNull().cast("int")).alias("frame"), F.count("there").alias("flow"), F.max("twice").alias("twice"),
        F.sum("value").alias("value"), F.sum("box").alias("box"),
        F.max(F.col("there").isNull().cast("int")).alias("missing"), F.max(F.col("here").isNull().cast("int")).alias("extra"))
    per_swing = per_key.groupBy("swing_id").agg(
        F.sum("frame").alias("frames"), F.max("frame").alias("swing"), F.sum("twice").alias("twice"),
        F.sum((F.col("flow") > 1).cast("int")).alias("flow"), F.sum(F.col("missing") + F.col("extra")).alias("keys"),
        F.sum("value").alias("value"), F.sum("box").alias("box"))
    names = {"frame_count": "frames", "swing_count": "swing", "duplicate_selected": "twice", "duplicate_flow": "flow",
             "key_differences": "keys", "value_mismatches": "value", "box_mismatches": "box"}
    total = per_swing.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in names.items()])
    return total.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in names])))


def verify_alignment(selected: DataFrame, flow: DataFrame, *, expected_frames: int | None = None,
                     expected_swings: int | None = None) -> dict[str, int]:
    """The counts of an aligned pair; otherwise an error that names every violation."""
    counts = {r["measure"]: r["value"] for r in alignment_counts(selected, flow).collect()}
    wanted = {"frame_count": expected_frames, "swing_count": expected_swings}
    wrong = [f"{n} = {v} (want {wanted.get(n, 0)})" for n, v in counts.items() if wanted.get(n, 0) is not None and v != wanted.get(n, 0)]
    if wrong:
        raise ValueError("selected rows and flow rows are not aligned: " + "; ".join(wrong))
    return counts


def fingerprinted(df: DataFrame, columns: Sequence[str]) -> Column:
    """A whole number for the content of a row: the first 60 bits of its MD5.

    Numbers count in millionths, rounded half to even, so the text of a number is the same in any engine; NULL and
    not-a-number are told apart from everything else.
    """
    parts = []
    for c in columns:
        kind = df.schema[c].dataType
        value = F.col(c)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = F.bround(S.finite(value.cast("double")) * 1e6).cast("bigint")
        parts.append(F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-")))
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def content_fingerprints(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, fingerprint): the sum of row numbers, whatever the order of rows and partitions.

    Summed map-side as decimals, so the exchange carries a row per key and task.
    """
    keyed = df.select(*by, fingerprinted(df, columns).cast("decimal(38,0)").alias("__f"))
    return keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("__f"), F.lit(0)).cast("decimal(38,0)").alias("fingerprint"))


def split_report(selected: DataFrame, flow: DataFrame, splits: DataFrame, expected: Mapping[str, tuple[int, int]]) -> DataFrame:
    """One row per split: sequences and frames of both tables, their content fingerprints, and whether sizes are as expected.

    ``expected``: split to (sequences, frames); a split named there and absent from the data has zeros. Sequences
    without a split are reported under NULL. ``split_sequences`` has the list of sequences.
    """
    names = [f"{k}_{f}" for k in ("head", "tail") for f in PREDICTION_FIELDS]
    long = ["swing_id", "image_stem", "keypoint", *PREDICTION_FIELDS, *BOX_FIELDS]
    wide = ["swing_id", "image_stem", *names, *BOX_FIELDS]

    def side(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        per_swing = content_fingerprints(df, columns, ["swing_id"]).join(splits, "swing_id", "left")
        return per_swing.groupBy("split").agg(
            F.count(F.lit(1)).alias(f"{name}_swings"), F.sum("rows").alias(f"{name}_rows"), F.sum("fingerprint").cast("decimal(38,0)").alias(f"{name}_fingerprint"))
    frames = selected.select("swing_id", "image_stem").distinct().join(splits, "swing_id", "left").groupBy("split").agg(F.count(F.lit(1)).alias("frames"))
    wanted = df_of(selected.sparkSession, expected)
    known = [side(selected.filter(F.col("keypoint").isin("head", "tail")), long, "selected"), side(flow, wide, "flow"), frames]
    keys = wanted.select("split")
    for table in known:
        keys = keys.union(table.select("split"))
    out = keys.distinct().join(wanted, "split", "left")
    for table in known:
        renamed = table.withColumnRenamed("split", "__s")
        out = out.join(renamed, F.col("split").eqNullSafe(F.col("__s")), "left").drop("__s")
    counts = [c for c in out.columns if c.endswith(("_swings", "_rows", "_fingerprint")) and not c.startswith("expected")] + ["frames"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(out.schema[c].dataType)) for c in counts})
    as_wanted = (F.col("selected_swings") == F.col("expected_swings")) & (F.col("frames") == F.col("expected_frames"))
    return out.withColumn("as_expected", F.coalesce(as_wanted, F.lit(False)))


def df_of(spark, expected: Mapping[str, tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in expected.items()], "split string, expected_swings long, expected_frames long")


def split_sequences(selected: DataFrame, splits: DataFrame) -> DataFrame:
    """The list of sequences: (split, swing_id, frames)."""
    frames = selected.select("swing_id", "image_stem").distinct().groupBy("swing_id").agg(F.count(F.lit(1)).alias("frames"))
    return frames.join(splits, "swing_id", "left").select("split", "swing_id", "frames")


def column_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, differing): the names of the columns in which two tables differ in a row; a row of one table alone differs in all."""
    left = a.select(*keys, F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    right = b.select(*keys, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    alone = F.col("__a").isNull() | F.col("__b").isNull()
    names = F.array(*[F.when(alone | ~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), c) for c in columns])
    return left.join(right, list(keys), "full").select(*keys, F.array_compact(names).alias("differing"))


def require_rows(df: DataFrame, message: Column | str, facts: DataFrame | None = None) -> DataFrame:
    """``df``; a query over it fails with ``message`` if it has no row.

    The check rides in the plan: a second branch, which never yields a row, looks for one row and raises if there is none.
    ``message`` may use the columns of ``facts``, a table of one row; a NULL message lets the empty table pass.
    The second branch has NULL in every column, so a filter put on the result may cut it off: require rows last.
    """
    found = df.select(F.lit(1).alias("__one")).limit(1).agg(F.count(F.lit(1)).alias("__n"))
    if facts is not None:
        found = facts.withColumn("__n", found.scalar())
    text = F.lit(message) if isinstance(message, str) else message
    checked = found.filter(F.when((F.col("__n") == 0) & text.isNotNull(), F.raise_error(text).cast("boolean")).otherwise(F.lit(False)))
    return df.unionByName(checked.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def hash_order(ids: DataFrame, seed: int, col: str = "swing_id") -> DataFrame:
    """Rank ids by md5(seed|id); 4096 hash bins keep every rank window small."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(col)).cast("binary"))
    keyed = ids.withColumns({"__h": h, "__all": F.lit(0)})
    return with_positions(keyed, ["__all"], [F.substring("__h", 1, 3)], [F.col("__h"), F.col(col)]).drop("__h", "__all")


def entity_split(ids: DataFrame, train: float, val: float, seed: int) -> DataFrame:
    """train / val / test by hash order; sizes round half to even."""
    n_train = F.bround(F.col("n") * train).cast("bigint")
    n_val = F.bround(F.col("n") * val).cast("bigint")
    ranked = hash_order(ids.select("swing_id").distinct(), seed)
    return ranked.select("swing_id", F.when(F.col("pos") < n_train, "train").when(
        F.col("pos") < n_train + n_val, "val").otherwise("test").alias("split"))


def holdout_split(ids: DataFrame, fraction: float, seed: int, val_ids: Sequence[str] | None = None) -> DataFrame:
    """train / val: given ids, or at least one id when there are two or more."""
    base = ids.select("swing_id").distinct()
    if val_ids:
        return base.withColumn("split", F.when(F.col("swing_id").isin(*val_ids), "val").otherwise("train"))
    n_val = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.bround(F.col("n") * fraction).cast("bigint"))).otherwise(0)
    ranked = hash_order(base, seed)
    return ranked.select("swing_id", F.when(F.col("pos") < n_val, "val").otherwise("train").alias("split"))


def split_overlaps(assigned: DataFrame) -> DataFrame:
    """Sequences that occur in more than one split."""
    pairs = assigned.select("swing_id", "split").distinct()
    return pairs.groupBy("swing_id").agg(F.count(F.lit(1)).alias("splits")).filter(F.col("splits") > 1)


CONTRACT_KEY = "trackloom.contract"


def feature_facts(use_flow: bool, split: str, **settings: object) -> dict[str, str]:
    """What a reader of a feature table relies on, as flat name-value pairs."""
    names = FEATURES_45 if use_flow else FEATURES_25
    facts = {"version": FEATURE_SCHEMA_VERSION, "columns": ",".join(names), "split": split}
    return facts | {f"setting.{k}": json.dumps(v) for k, v in settings.items()}


def stamped(df: DataFrame, facts: Mapping[str, str]) -> DataFrame:
    """The table with ``facts`` in the metadata of its first column, which Spark's writers store with the schema."""
    first = df.columns[0]
    return df.withMetadata(first, {**df.schema[first].metadata, CONTRACT_KEY: json.dumps(dict(facts))})


def contract_differences(df: DataFrame, facts: Mapping[str, str]) -> list[tuple[str, str | None, str | None]]:
    """(name, expected, found) for each of ``facts`` that the table's own record contradicts or lacks."""
    found = json.loads(df.schema[0].metadata.get(CONTRACT_KEY, "{}"))
    return [(name, want, found.get(name)) for name, want in facts.items() if found.get(name) != want]


def require_contract(df: DataFrame, facts: Mapping[str, str]) -> DataFrame:
    wrong = contract_differences(df, facts)
    if wrong:
        raise ValueError("feature table differs from what is expected: " + "; ".join(f"{n}: {f!r} instead of {w!r}" for n, w, f in wrong))
    return df


def require_feature_order(df: DataFrame, use_flow: bool) -> DataFrame:
    """The table's feature columns must be complete and in contract order."""
    names = list(FEATURES_45 if use_flow else FEATURES_25)
    have = [c for c in df.columns if c in set(names)]
    if have != names:
        raise ValueError(f"feature columns are {have}, expected {names}")
    return df
