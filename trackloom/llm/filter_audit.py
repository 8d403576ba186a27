"""What each filter of a chain removes, in every order of the chain.

Five filters: A too few words, B too few distinct words, C too many capitals, D holds a markup sign,
E repeats the text of a smaller doc_id. A document is reduced to the mask of the filters it fails; documents with the same
part and mask form a cell. Each cell, at most 32 a part, folds across the array of all orders with ``aggregate`` and
``transform``, which gives one weighted struct for each order and step, and a part's cells are added element by element.
The documents themselves are never joined to the orders.

Defined cases. Null text: empty; the empty text fails A only (0 is under any share), and E if it is not the first one.
Null source: the part ''. Null doc_id: neither fails E nor makes another row fail it. Rows with equal doc_id and text: no
smaller doc_id among them, so none makes another fail E; each counts. Several labels of one doc_id: good or toxic if any
says so. Empty documents: no rows; empty labels: nothing is lost. Only doc_id, text, source and quality, toxic of the labels
are read, so other columns may have any names. Texts are compared by their SHA-256.

Scale. Whole texts are read once, in the JVM, and never shuffled: rows carry digest, mask and label flags. A text that a third
of the documents share is summed before each exchange, so no task gets its rows, and no join runs on the digest.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
WEIGHTS = ("n", "good", "toxic")


def text_failures(docs: DataFrame, *, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the failed filters A to D (bit k: filter k)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n = F.size("words").cast("long")
    fails = (
        n < min_words,
        100 * F.size(F.array_distinct("words")).cast("long") < distinct_percent * n,
        100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > capital_percent * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    )
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """part, mask of all five filters, and the documents with it: n, good ones, toxic ones."""
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = text_failures(docs, **limits).join(flags, "doc_id", "left")
    sums = [F.sum(F.lit(1)).alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in WEIGHTS[1:])]
    # A text's mask is the same in all its rows. One row for each text, part and doc_id, then for each text and part.
    by_id = rows.groupBy("doc_id", "digest", "part", "mask").agg(*sums)
    unnamed = F.col("doc_id").isNull()
    by_part = by_id.groupBy("digest", "part", "mask").agg(
        *(F.sum(c).alias(c) for c in WEIGHTS), F.min("doc_id").alias("least"),
        *(F.min_by(c, "doc_id").alias(f"least_{c}") for c in WEIGHTS),
        *(F.sum(F.when(unnamed, F.col(c)).otherwise(0)).alias(f"unnamed_{c}") for c in WEIGHTS))
    by_part = by_part.withColumn("first", F.col("least") == F.min("least").over(Window.partitionBy("digest")))
    original = {c: F.col(f"unnamed_{c}") + F.when(F.col("first"), F.col(f"least_{c}")).otherwise(0) for c in WEIGHTS}
    split = by_part.select("part", F.explode(F.array(
        F.struct(F.col("mask"), *(original[c].alias(c) for c in WEIGHTS)),
        F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), *((F.col(c) - original[c]).alias(c) for c in WEIGHTS)))).alias("cell"))
    return split.where("cell.n > 0").groupBy("part", "cell.mask").agg(*(F.sum(f"cell.{c}").alias(c) for c in WEIGHTS))


def folded(fails: Column, n: Column, good: Column, toxic: Column) -> Column:
    """One struct for each order and step of ``ORDERS``, weighted with the counts of a cell that fails ``fails``."""
    orders = F.array(*(F.array(*(F.lit(FILTERS.index(x)) for x in order)) for order in ORDERS))
    n_fails = F.size(F.filter(fails, lambda x: x))
    nothing = F.array().cast("array<struct<filter:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")

    def counted(condition: Column, weight: Column) -> Column:
        return F.when(condition, weight).otherwise(F.lit(0).cast("long"))

    def step(state: Column, k: Column) -> Column:
        here, failing = state["here"], fails[k]
        result = F.struct(
            k.alias("filter"), counted(here & ~failing, n).alias("kept"), counted(here & failing, n).alias("removed"),
            counted(failing & ~here, n).alias("redundant"), counted(failing & (n_fails == 1), n).alias("unique_fails"),
            counted(here & failing, good).alias("good_lost"), counted(here & failing, toxic).alias("toxic_lost"))
        return F.struct((here & ~failing).alias("here"), F.concat(state["steps"], F.array(result)).alias("steps"))

    start = F.struct(F.lit(True).alias("here"), nothing.alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x["filter"].alias("filter"), *((x[c] + y[c]).alias(c) for c in COUNTS)))


def _removed_by(k: int) -> Column:
    return F.aggregate("steps", F.lit(0).cast("long"), lambda total, s: total + F.when(s["filter"] == k, s["removed"]).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """part, filter_order, step, filter and the long counts of ``COUNTS`` and shapley, 600 rows a part."""
    fails = F.array(*(F.col("mask").bitwiseAND(1 << k) != 0 for k in range(len(FILTERS))))
    weighted = cells(docs, labels, **limits).select("part", folded(fails, *(F.col(c) for c in WEIGHTS)).alias("steps"))
    # At most 32 cells a part.
    merged = weighted.groupBy("part").agg(F.collect_list("steps").alias("all")).select(
        "part", F.aggregate(F.slice("all", 2, 1 << len(FILTERS)), F.col("all")[0], _added).alias("steps"))
    removed = F.array(*map(_removed_by, range(len(FILTERS))))
    rows = merged.select("part", removed.alias("by_filter"), F.posexplode("steps").alias("at", "s"))
    order = F.array(*map(F.lit, ORDERS))[F.floor(F.col("at") / len(FILTERS)).cast("int")]
    return rows.select(
        "part", order.alias("filter_order"), (F.col("at") % len(FILTERS) + 1).alias("step"),
        F.array(*map(F.lit, FILTERS))[F.col("s.filter")].alias("filter"), *(F.col(f"s.{c}").alias(c) for c in COUNTS),
        F.col("by_filter")[F.col("s.filter")].alias("shapley"))
