"""Ordered-sequence building blocks that stay bounded when one sequence is huge.

A plain ``Window.partitionBy(sequence)`` puts a whole sequence into one task. Here a
sequence is cut: positions come from per-bin counts, neighbour logic runs per
block with copied edge rows, and state is passed along by composing per-block
transition tables. The largest group any task sees is a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
FOLD_ROWS = 128
FOLD_FAN = 128
FRAME_BIN = 256


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows by ``keys`` in ``tasks`` partitions, or in as many as the session's shuffles have."""
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def with_positions(
    df: DataFrame,
    seq: Sequence[str],
    bins: Sequence[Column],
    order: Sequence[Column],
    *,
    pos: str = "pos",
    total: str | None = "n",
    flag: Column | None = None,
    flag_pos: str = "flag_pos",
    tasks: int | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of every sequence from 0 without one task per sequence.

    ``bins`` are coarse keys that never decrease along ``order``. Rows are ranked
    inside (sequence, bin); the rank of a bin's first row is the running sum of the
    bin counts, a table with one row per bin. ``flag_pos`` numbers the rows where
    ``flag`` holds (for other rows it is the number of flagged rows before them). ``tasks``
    see ``session.tasks_for_rows``; bins may be nearly as many as rows. ``facts``, at most one row
    per sequence, reach the rows by way of their bins, so that rows are not moved for them.
    """
    names = [f"__bin{i}" for i in range(len(bins))]
    keyed = df.withColumns(dict(zip(names, bins)))
    if flag is not None:
        keyed = keyed.withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("bigint"))
    keys = [*seq, *names]
    sizes = [F.count(F.lit(1)).alias("__rows")]
    if flag is not None:
        sizes.append(F.sum("__flag").alias("__flags"))
    before = Window.partitionBy(*seq).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__skip")]
    if flag is not None:
        offsets.append(F.coalesce(F.sum("__flags").over(before), F.lit(0)).alias("__skip_flags"))
    if total:
        offsets.append(F.sum("__rows").over(Window.partitionBy(*seq)).alias(total))
    counted = keyed.groupBy(*keys).agg(*sizes)
    starts = (counted.repartition(tasks, *seq) if tasks else counted).select(*keys, *offsets)
    if facts is not None:
        starts = starts.join(facts, list(seq), "left")

    inside = Window.partitionBy(*keys).orderBy(*order)
    # Dealt out by bin, whatever exchange came before, so that a sequence is no single task.
    ranked = dealt(keyed, tasks, *keys).withColumn("__rank", F.row_number().over(inside) - 1)
    if flag is not None:
        ranked = ranked.withColumn(
            "__rank_flags",
            F.sum("__flag").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__flag"))
    out = ranked.join(starts, keys, "inner").withColumn(pos, (F.col("__skip") + F.col("__rank")).cast("bigint"))
    drop = [*names, "__skip", "__rank"]
    if flag is not None:
        out = out.withColumn(flag_pos, (F.col("__skip_flags") + F.col("__rank_flags")).cast("bigint"))
        drop += ["__flag", "__skip_flags", "__rank_flags"]
    return out.drop(*drop)


def frame_positions(df: DataFrame, seq: str = "swing_id", **kwargs) -> DataFrame:
    """Positions along (frame_idx, image_stem) within a sequence."""
    return with_positions(
        df, [seq], [F.floor(F.col("frame_idx") / FRAME_BIN)],
        [F.col("frame_idx"), F.col("image_stem")], **kwargs)


def with_halo(
    df: DataFrame, *, before: int, after: int, pos: str = "pos", rows: int = BLOCK_ROWS, seq: str = "swing_id",
    tasks: int | None = None,
) -> DataFrame:
    """Assign rows to blocks and copy edge rows into the neighbouring block.

    Adds ``block`` and ``is_halo``. Each block then also holds the ``before`` rows
    that precede it and the ``after`` rows that follow it. Rows are dealt out by
    (sequence, block): a window over blocks would also accept an earlier exchange by
    sequence alone, and then a long sequence would be one task.
    """
    if before > rows or after > rows:
        raise ValueError("halo must not be longer than a block")
    home = F.floor(F.col(pos) / rows)
    offset = F.col(pos) % rows
    targets = F.array_compact(F.array(
        home,
        F.when(offset >= rows - before, home + 1),
        F.when((offset < after) & (home > 0), home - 1)))
    placed = (
        df.withColumn("__home", home)
        .withColumn("block", F.explode(targets))
        .withColumn("is_halo", F.col("block") != F.col("__home"))
        .drop("__home")
    )
    return dealt(placed, tasks, seq, "block")


def with_sequence_facts(rows: DataFrame, facts: DataFrame, *, seq: str = "sequence_id", idx: str = "frame_idx", size: int = BLOCK_ROWS, fan_out: bool = False,
                        part: str | None = None) -> DataFrame:
    """Rows of a sequence beside its facts (any number of rows per sequence).

    Facts go to the frame bins that a sequence has, a table with one row per bin, and rows meet them by
    (sequence, bin): a sequence of any length is dealt out, also in a second such join. With ``fan_out`` facts multiply rows many
    times; the adaptive planner sizes tasks by the few rows before the join, so these go to all shuffle partitions instead.
    ``part`` names a column that keeps the bin by which rows then lie.
    """
    keyed = rows.withColumn("__part", F.floor(F.col(idx) / size))
    parts = keyed.select(seq, "__part").distinct().join(facts, seq)
    if fan_out:
        keyed = keyed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), seq, "__part")
    out = keyed.join(parts, [seq, "__part"])
    return out.withColumnRenamed("__part", part) if part else out.drop("__part")


def number_in_place(
    rows: DataFrame, seq: str, member: str, part: str, order: Sequence[Column], *,
    pos: str = "pos", total: str = "n", facts: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of every (seq, member) from 0; rows that lie by (seq, part) are not moved.

    ``part`` never decreases along ``order``. Counts per (seq, member, part) give the offsets; those of all members of
    a (seq, part) come to its rows in one map, since a join by member would deal the rows out anew. ``facts``, at most
    one row per (seq, member), come the same way; members without a row there are left out.
    """
    keys = [seq, member]
    counted = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        *keys, part, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__skip"),
        F.sum("__rows").over(Window.partitionBy(*keys)).alias(total))
    if facts is not None:
        starts = starts.join(facts, keys)
    names = [c for c in starts.columns if c not in (*keys, part)]
    entry = F.struct(F.col(member), F.struct(*names))
    maps = starts.filter(F.col(member).isNotNull()).groupBy(seq, part).agg(F.map_from_entries(F.collect_list(entry)).alias("__of"))
    rank = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)) - 1
    met = rows.withColumn("__rank", rank).join(maps, [seq, part]).withColumn("__e", F.try_element_at("__of", F.col(member)))
    out = met.filter(F.col("__e").isNotNull()).select(
        *rows.columns, (F.col("__e.__skip") + F.col("__rank")).cast("bigint").alias(pos),
        *[F.col(f"__e.{c}").alias(c) for c in names if c != "__skip"])
    return out


def block_window(seq: str = "swing_id", pos: str = "pos", descending: bool = False):
    key = F.col(pos).desc() if descending else F.col(pos)
    return Window.partitionBy(seq, "block").orderBy(key)


def fill_linear(
    df: DataFrame, cols: Sequence[str], seq: str = "swing_id", pos: str = "pos",
    rows: int = BLOCK_ROWS, tasks: int | None = None,
) -> DataFrame:
    """Linear gap fill per sequence and column; ends are held, no value gives 0.

    A gap may span blocks: each block's first and last known value travel along a
    table with one row per block.
    """
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(c).alias("v"))) for c in cols}
    blocks = df.withColumn("block", F.floor(F.col(pos) / rows))
    edges = blocks.groupBy(seq, "block").agg(*[
        agg for c in cols for agg in (F.min(known[c]).alias(f"__f_{c}"), F.max(known[c]).alias(f"__l_{c}"))])
    ahead = Window.partitionBy(seq).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(seq).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(seq, "block", *[
        e for c in cols for e in (
            F.last(f"__l_{c}", ignorenulls=True).over(ahead).alias(f"__cp_{c}"),
            F.last(f"__f_{c}", ignorenulls=True).over(behind).alias(f"__cn_{c}"))])
    up = block_window(seq, pos).rowsBetween(Window.unboundedPreceding, 0)
    down = block_window(seq, pos, descending=True).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt(blocks, tasks, seq, "block").withColumns({
        **{f"__p_{c}": F.last(known[c], ignorenulls=True).over(up) for c in cols},
    }).withColumns({f"__n_{c}": F.last(known[c], ignorenulls=True).over(down) for c in cols})
    out = out.join(carried, [seq, "block"], "left")
    filled = {}
    for c in cols:
        p = F.coalesce(F.col(f"__p_{c}"), F.col(f"__cp_{c}"))
        n = F.coalesce(F.col(f"__n_{c}"), F.col(f"__cn_{c}"))
        lerp = p["v"] + (n["v"] - p["v"]) * ((F.col(pos) - p["p"]) / F.greatest(n["p"] - p["p"], F.lit(1)))
        filled[c] = F.coalesce(F.col(c), F.when(p.isNotNull() & n.isNotNull(), lerp), p["v"], n["v"], F.lit(0.0))
    helpers = [f"__{k}_{c}" for c in cols for k in ("p", "n", "cp", "cn")]
    return out.withColumns(filled).drop("block", *helpers)


def _compose(items: Column) -> Column:
    """State after the last item for every possible state before the first."""
    return F.aggregate(
        F.slice(items, F.lit(2), F.size(items)),
        F.get(items, F.lit(0))["step"],
        lambda acc, item: F.transform(acc, lambda s: F.get(item["step"], s)))


def _walk(items: Column, entry: Column) -> Column:
    """(state before, state after) of every item, starting from ``entry``."""
    done = F.aggregate(
        items,
        F.struct(entry.cast("int").alias("s"), F.array().cast("array<struct<before:int,after:int>>").alias("path")),
        lambda acc, item: F.struct(
            F.get(item["step"], acc["s"]).alias("s"),
            F.concat(acc["path"], F.array(F.struct(
                acc["s"].alias("before"), F.get(item["step"], acc["s"]).alias("after")))).alias("path")))
    return done["path"]


def fold_levels(blocks: int, fan: int = FOLD_FAN) -> int:
    """Levels of ``follow_states`` after which at most ``fan`` tables of a sequence of ``blocks`` blocks are left."""
    levels = 0
    while blocks > fan:
        blocks, levels = -(-blocks // fan), levels + 1
    return levels


def follow_states(
    df: DataFrame, seq: str, idx: str, step: str, payload: Sequence[str],
    *, block: str, levels: int = 1, fan: int = FOLD_FAN, by_block: bool = False,
) -> DataFrame:
    """Run a small-state machine along every sequence.

    ``step[s]`` is the state after row ``idx`` when the state before was ``s``; the
    first row has one entry. Rows are collected per ``block`` only. Composed block
    tables go through the same step again with blocks of blocks (``levels`` times),
    so the last, per-sequence level sees one entry per ``fan ** levels`` blocks; see ``fold_levels``.
    Returns seq, idx, payload, before, after; or, ``by_block``, one row per (seq, block) with ``first``, the idx of its
    first row, and ``path``, the states (before, after) of its rows in order.
    """
    item = F.struct(F.col(idx).alias("idx"), F.col(step).alias("step"), *[F.col(c) for c in payload])
    groups = df.groupBy(seq, block).agg(F.sort_array(F.collect_list(item)).alias("items"))
    tables = groups.select(seq, F.col(block).alias("idx"), _compose(F.col("items")).alias("step"))
    if levels > 0:
        upper = follow_states(
            tables.withColumn("__up", F.floor(F.col("idx") / fan)), seq, "idx", "step", [],
            block="__up", levels=levels - 1, fan=fan)
    else:
        upper = (
            tables.groupBy(seq)
            .agg(F.sort_array(F.collect_list(F.struct("idx", "step"))).alias("items"))
            .select(seq, F.inline(F.arrays_zip(F.col("items.idx").alias("idx"), _walk(F.col("items"), F.lit(0)).alias("p"))))
            .select(seq, "idx", F.col("p.before").alias("before"))
        )
    entries = upper.select(seq, F.col("idx").alias(block), F.col("before").alias("__entry"))
    met = groups.join(entries, [seq, block], "inner")
    if by_block:
        return met.select(seq, block, F.get("items", F.lit(0))["idx"].alias("first"), _walk(F.col("items"), F.col("__entry")).alias("path"))
    walked = met.select(
        seq, F.explode(F.arrays_zip(
            F.col("items"), _walk(F.col("items"), F.col("__entry")).alias("path"))).alias("z"))
    return walked.select(
        seq, F.col("z.items.idx").alias(idx), *[F.col(f"z.items.{c}").alias(c) for c in payload],
        F.col("z.path.before").alias("before"), F.col("z.path.after").alias("after"))
