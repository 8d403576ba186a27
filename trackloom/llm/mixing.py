"""Mixing sources to target weights by entropy balancing, DataFrame functions only.

Each document gets a rate r = min(cap, exp(lambda_source * size / mean size of the source)): the
solution of entropy balancing with base rate one, an upper bound and one token constraint per source.
Newton steps on the convex dual, one distributed aggregate over (source, size) counts each, find the
lambdas; a bracket keeps each step safe where the bound makes the dual only piecewise smooth. Rates are then
rounded to whole copies: along sizes in falling order the copies of a size are the difference of rounded
running sums, which leaves at most half the largest document as error; the smallest documents' copies then
make up for that rest. Which documents of one size get the extra copy follows a hash order of doc_id.

All sums that decide anything are exact decimals of rounded rates, so that reruns agree.

Defined cases. Null text: size 0, nothing taken. Null source: a source of its own, last in order. Null or
equal doc_ids: each row counts by itself. A source of size 0: target 0. Empty table: an empty result. Only
doc_id, source and text are read, so other columns may have any names. Texts of any length count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import SPACES, stored

#: Rates are kept in millionths.
UNIT = 1_000_000
SALTS = 64
EXACT = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Number of words: white-space runs inside the trimmed text, plus one."""
    spaces = " \t\n\x0b\x0c\r"
    trimmed = F.trim(text, F.lit(spaces))
    return F.when(F.coalesce(F.octet_length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(trimmed, f"[{SPACES}]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes dealt by weight, none above ``cap`` times its size.

    Filling up: sources ordered by size per weight reach their cap first; those before the last full one are full.
    One row per source, so the ordered windows run over a table as long as the list of sources.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    ranked = per.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "i")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.col("total") - F.coalesce(F.sum(F.col("source_size")).over(before), F.lit(0)) * F.lit(cap)) / F.sum("weight").over(after))
    filled = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > F.col("source_size") * F.lit(cap))
    # The level of the first source that is not full holds for all after it.
    first = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("o"), "i", "level"))).over(Window.partitionBy())
    rest = filled.withColumn("level", first["level"])
    return rest.select("source", "source_size", F.coalesce(
        F.least(F.col("level") * F.col("weight"), F.col("source_size") * F.lit(cap)), F.col("source_size") * F.lit(cap)).alias("target"))


def _rate(lam: Column, cap: float) -> Column:
    """The tilted rate in units, at most the cap."""
    return F.round(F.least(F.lit(cap), F.exp(F.least(lam * F.col("x"), F.lit(50.0)))) * UNIT).cast("long")


def balance(histogram: DataFrame, targets: DataFrame, *, cap: float = 2.0, max_steps: int = 40, tolerance: float = 1e-4) -> DataFrame:
    """source, lambda: Newton's method on the dual, all sources in one aggregate a step.

    ``histogram``: source, size, n. A source that must be taken ``cap`` times over has no finite lambda and gets a large one.
    """
    mean = (histogram.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean")))
    t, m, h = targets.alias("t"), mean.alias("m"), histogram.alias("h")
    state = stored(t.join(m, F.col("t.source").eqNullSafe(F.col("m.source"))).select(
        F.col("t.source").alias("source"), "target", "source_size", "mean", F.lit(0.0).alias("lam"),
        F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"),
        (F.col("target") >= F.col("source_size") * F.lit(cap)).alias("done")), "mix-state")
    state = state.withColumn("lam", F.when(F.col("done"), F.lit(1e4)).otherwise(F.col("lam")))
    for _ in range(max_steps):
        s = state.alias("s")
        grid = h.join(s.where("not done"), F.col("h.source").eqNullSafe(F.col("s.source"))).select(
            F.col("s.source").alias("source"), "size", "n", "lam", (F.col("size") / F.col("mean")).alias("x"))
        rate = _rate(F.col("lam"), cap)
        words = F.col("n").cast(EXACT) * F.col("size")
        bent = F.when(rate < int(cap * UNIT), words * rate * F.col("size"))
        sums = grid.groupBy("source").agg(F.sum((words * rate).cast(EXACT)).alias("got"), F.sum(bent.cast(EXACT)).alias("slope")).alias("g")
        gap = F.col("got").cast("double") / UNIT - F.col("s.target")
        slope = F.coalesce(F.col("slope").cast("double"), F.lit(0.0)) / UNIT / F.col("s.mean")
        low = F.when(gap < 0, F.col("s.lam")).otherwise(F.col("s.low"))
        high = F.when(gap > 0, F.col("s.lam")).otherwise(F.col("s.high"))
        newton = F.col("s.lam") - gap / slope
        middle = (low + high) / 2
        step = F.when((slope > 0) & (newton > low) & (newton < high), newton).otherwise(middle)
        ended = F.col("s.done") | F.coalesce(F.abs(gap) <= F.greatest(F.lit(0.5), F.col("s.target") * tolerance), F.lit(True))
        state = stored(s.join(sums, F.col("s.source").eqNullSafe(F.col("g.source")), "left").select(
            F.col("s.source").alias("source"), F.col("s.target").alias("target"), F.col("s.source_size").alias("source_size"),
            F.col("s.mean").alias("mean"), F.when(ended, F.col("s.lam")).otherwise(step).alias("lam"),
            F.coalesce(low, F.col("s.low")).alias("low"), F.coalesce(high, F.col("s.high")).alias("high"), ended.alias("done")), "mix-state")
        if state.where("not done").isEmpty():
            break
    return state.select("source", F.round("lam", 9).alias("lam"), "mean", "target", "source_size")


def copies_by_size(histogram: DataFrame, duals: DataFrame, cap: float) -> DataFrame:
    """source, size, n, copies: whole copies of all documents of one size together.

    Windows run over sizes of a source, not over documents.
    """
    h, d = histogram.alias("h"), duals.alias("d")
    rated = h.join(d, F.col("h.source").eqNullSafe(F.col("d.source"))).select(
        F.col("h.source").alias("source"), "size", "n", "target", "source_size", "lam", (F.col("size") / F.col("mean")).alias("x"))
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("lam"), cap)).otherwise(0))
    falling = Window.partitionBy("source").orderBy(F.desc("size"))
    mass = (F.col("n").cast(EXACT) * F.col("rate")).cast(EXACT)
    run = F.sum(mass).over(falling.rowsBetween(Window.unboundedPreceding, 0)).cast(EXACT)
    rounded = F.floor((run * 2 + UNIT) / (2 * UNIT)).cast(EXACT)
    most = F.col("n") * int(cap)
    first = rated.withColumn("run", rounded)
    first = first.withColumn("copies", (F.col("run") - F.coalesce(F.lag("run").over(falling), F.lit(0))).cast("long"))
    first = first.withColumn("copies", F.least(F.greatest(F.col("copies"), F.lit(0)), most))
    # What is missing (or too much) against the target goes to the smallest documents first. The last size that takes part goes
    # one copy too far, which turns the sign and leaves the rest to smaller documents; three rounds end with the nearest number.
    whole = Window.partitionBy("source")
    rising = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    for last in (False, False, True):
        first = first.withColumn("missing", F.round(F.col("target")).cast("long") - F.sum(F.col("copies") * F.col("size")).over(whole))
        room = F.when(F.col("size") <= 0, F.lit(0)).when(F.col("missing") > 0, most - F.col("copies")).otherwise(F.col("copies"))
        first = first.withColumn("room", room)
        before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(rising), F.lit(0))
        fits = (F.abs("missing") - before) / F.col("size")
        fits = F.round(fits).cast("long") if last else F.ceil(fits)
        moved = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("room"), fits))).otherwise(0)
        first = first.withColumn("moved", moved).withColumn("copies", (F.col("copies") + F.signum(F.col("missing")) * F.col("moved")).cast("long"))
    return first.select("source", "size", "n", "target", "source_size", "copies")


def with_copies(sized: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sized`` with source_size, target and the row's number of copies.

    ``sized`` has doc_id, source, size and possibly the row itself, which travels along: no join on ids is needed.
    """
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    # One row per (source, size, salt): all later tables come from it.
    counts = stored(salted.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("rows")), "mix-counts")
    histogram = stored(counts.groupBy("source", "size").agg(F.sum("rows").alias("n")), "mix-sizes")
    duals = balance(histogram, source_targets(histogram, weights, share, cap), cap=cap)
    plan = copies_by_size(histogram, duals, cap).withColumn("extra", F.col("copies") % F.col("n")).withColumn(
        "base", F.floor(F.col("copies") / F.col("n")).cast("long"))
    # Rank inside (source, size) by hash bucket, so that no group of equal sizes is ordered in one task.
    by_salt = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("rows").over(by_salt), F.lit(0)))
    p, o = plan.alias("p"), offsets.alias("o")
    deal = stored(o.join(p, F.col("o.source").eqNullSafe(F.col("p.source")) & (F.col("o.size") == F.col("p.size"))).select(
        F.col("o.source").alias("source"), F.col("o.size").alias("size"), "salt", "source_size", "target", "base",
        F.least(F.greatest(F.col("extra") - F.col("ahead"), F.lit(0)), F.col("rows")).alias("extra"), "rows"), "mix-deal").alias("e")
    d = salted.alias("d")
    joined = d.join(deal, F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.size") == F.col("e.size")) & (F.col("d.salt") == F.col("e.salt")))
    cols = [F.col(f"d.{c}").alias(c) for c in sized.columns] + [F.col("e.source_size"), F.col("e.target")]
    settled = joined.where("extra = 0 or extra = rows").select(*cols, (F.col("base") + (F.col("extra") > 0).cast("long")).alias("copies"))
    split = joined.where("extra > 0 and extra < rows").select(*cols, F.col("d.salt").alias("salt"), "base", "extra")
    nth = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id"))
    split = split.withColumn("copies", F.col("base") + (nth <= F.col("extra")).cast("long")).select(*settled.columns)
    return settled.unionByName(split)


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (= size * copies), one row per row of ``docs``."""
    sized = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text").cast("string")).alias("size")), "mix-sizes")
    return with_copies(sized, weights=weights, share=share, cap=cap).withColumn("taken", F.col("size") * F.col("copies"))


def mixed_rows(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns kept."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    taken = with_copies(sized, weights=weights, share=share, cap=cap).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
