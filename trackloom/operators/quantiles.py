"""Exact quantiles per group that never gather or order a group in one task.

Values fall into monotone buckets (fixed relative width). Bucket counts, at most
some 100,000 per group, locate the bucket of each wanted rank. A bucket with more than
``bucket_rows`` rows is cut again between its smallest and largest value, into as many
parts as bring it to that size (65,536 at most; ``levels=2`` cuts the parts once more). Only
the values of the last part are ordered, and equal values count as one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.scalars import finite

STEPS_PER_OCTAVE = 1024
BUCKET_ROWS = 100_000
MOST_PARTS = 65_536


def bucket_of(v: Column) -> Column:
    size = F.floor(F.log2(1.0 + F.abs(v) * 1048576.0) * STEPS_PER_OCTAVE)
    return (F.signum(v) * size).cast("bigint")


def _ranks(probs: Mapping[str, float]) -> dict[str, Column]:
    return {name: (F.col("__n") - 1) * F.lit(float(p)) for name, p in probs.items()}


def _hit(probs: Mapping[str, float], start: Column, end: Column) -> Column:
    """A wanted rank lies in [start, end)."""
    out = F.lit(False)
    for r in _ranks(probs).values():
        for at in (F.floor(r), F.ceil(r)):
            out = out | ((at >= start) & (at < end))
    return out


def wanted_buckets(hist: DataFrame, group: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Buckets (``__b``) that hold a wanted rank, from their counts ``__c``: adds ``__skip``, the values
    before a bucket, and ``__n``, the values of its group. The window is over at most some 100,000 rows."""
    upto = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    located = hist.withColumns({
        "__skip": F.sum("__c").over(upto) - F.col("__c"),
        "__n": F.sum("__c").over(Window.partitionBy(*group))})
    return located.filter(_hit(probs, F.col("__skip"), F.col("__skip") + F.col("__c")))


def values_at(rows: DataFrame, group: Sequence[str], probs: Mapping[str, float], *, bucket_rows: int = BUCKET_ROWS,
              levels: int = 1, few_groups: bool = False, times: Column | None = None) -> DataFrame:
    """(group, __at, __v): the values at the wanted ranks; ``rows`` has group, ``__v`` and the
    facts of its bucket: ``__b, __skip, __n, __c, __lo, __hi``. A row counts ``times`` times, or once."""
    path, facts = [*group, "__b"], ["__skip", "__n", "__c", "__lo", "__hi"]
    same = F.count(F.lit(1)) if times is None else F.sum(times)
    runs = rows.groupBy(*path, "__v").agg(same.alias("__same"), *[F.first(c).alias(c) for c in facts])
    for level in range(levels):
        part = f"__part{level}"
        parts = F.least(F.ceil(F.col("__c") / bucket_rows), F.lit(MOST_PARTS))
        width = F.col("__hi") - F.col("__lo")
        share = F.when(width > 0, (F.col("__v") - F.col("__lo")) / width).otherwise(0.0)
        runs = runs.withColumn(part, F.least(F.floor(share * parts), parts - 1).cast("int"))
        inner = [*path, part]
        sizes = runs.groupBy(*inner).agg(F.sum("__same").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
                                         F.first("__skip").alias("__skip"), F.first("__n").alias("__n"))
        before = Window.partitionBy(*path).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("__skip", F.col("__skip") + F.coalesce(F.sum("__c").over(before), F.lit(0)))
        sizes = sizes.filter(_hit(probs, F.col("__skip"), F.col("__skip") + F.col("__c")))
        runs = runs.drop(*facts).join(F.broadcast(sizes) if few_groups else sizes, inner)
        path = inner
    ordered = Window.partitionBy(*path).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.withColumn("__start", F.col("__skip") + F.coalesce(F.sum("__same").over(ordered), F.lit(0)))
    return spans.withColumn("__end", F.col("__start") + F.col("__same")).filter(_hit(probs, F.col("__start"), F.col("__end")))


def interpolated(spans: DataFrame, keys: Sequence[str], metrics: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """One row per key with ``{metric}_{prob}``, linear between the two values around a rank."""
    def at(metric: str, r: Column) -> Column:
        return F.max(F.when((F.col("__m") == metric) & (r >= F.col("__start")) & (r < F.col("__end")), F.col("__v")))

    ends = []
    for metric in metrics:
        ends.append(F.max(F.when(F.col("__m") == metric, F.col("__n"))).alias(f"__n_{metric}"))
        for name, r in _ranks(probs).items():
            ends.append(at(metric, F.floor(r)).alias(f"__lo_{metric}_{name}"))
            ends.append(at(metric, F.ceil(r)).alias(f"__hi_{metric}_{name}"))
    table = spans.groupBy(*keys).agg(*ends)
    out = []
    for metric in metrics:
        for name, p in probs.items():
            h = (F.col(f"__n_{metric}") - 1) * F.lit(float(p))
            lo, hi = F.col(f"__lo_{metric}_{name}"), F.col(f"__hi_{metric}_{name}")
            out.append((lo + (hi - lo) * (h - F.floor(h))).alias(f"{metric}_{name}"))
    return table.select(*keys, *out)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column],
    probs: Mapping[str, float], *, few_groups: bool = False, member: str | None = None, name: str = "grp",
    bucket_rows: int = BUCKET_ROWS, levels: int = 1, times: str | None = None,
) -> DataFrame:
    """Columns ``{value}_{prob}`` per key, linear interpolation, NULLs skipped.

    ``times`` is a column that says how often a row counts, for values that were counted before.

    ``few_groups=True`` states that ``keys`` come from a fixed vocabulary, so the
    table of wanted buckets is tiny and is broadcast. ``member`` is a column with an array of
    group names of a fixed vocabulary; a row counts in each of them, and ``name`` becomes
    one more key. Rows are counted by their whole array and only the counts are exploded; of
    the rows, those in a wanted bucket.
    """
    keys, sets = list(keys), [c for c in (member, times) if c]
    pairs = F.array(*[F.struct(F.lit(n).alias("m"), finite(c.cast("double")).alias("v")) for n, c in values.items()])
    long = (
        df.select(*keys, *sets, F.explode(pairs).alias("__p"))
        .select(*keys, *sets, F.col("__p.m").alias("__m"), F.col("__p.v").alias("__v"))
        .filter(F.col("__v").isNotNull())
        .withColumn("__b", bucket_of(F.col("__v")))
    )
    place = [*keys, "__m", "__b"]
    rows_of = F.count(F.lit(1)) if times is None else F.sum(times)
    hist = long.groupBy(*place, *([member] if member else [])).agg(rows_of.alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    group = [*keys, "__m"]
    if member:
        hist = hist.withColumn(name, F.explode(member)).groupBy(*place, name).agg(
            F.sum("__c").alias("__c"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
        keys, group = [*keys, name], [*group, name]
    targets = wanted_buckets(hist, group, probs)
    rows = long.join(F.broadcast(targets) if few_groups or member else targets, place)
    if member:
        rows = rows.filter(F.array_contains(member, F.col(name)))
    spans = values_at(rows, group, probs, bucket_rows=bucket_rows, levels=levels, few_groups=few_groups or bool(member), times=F.col(times) if times else None)
    return interpolated(spans, keys, list(values), probs)
