"""Connected components of a large edge list, without a task or the driver ever holding a component.

Edges are first reduced inside each task to the spanning stars of what it has seen, then large-star and
small-star rounds alternate until the forest is made of stars around each component's smallest node. A
node's smallest neighbour is a pre-aggregated minimum; the joins back to the edges are plain equi-joins that adaptive execution splits
when one node has very many edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import stored


class Union:
    """Union-find over hashable nodes; roots are the smallest nodes."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        r = x
        while (p := parent.setdefault(r, r)) != r:
            r = p
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> Iterator[tuple[int, int]]:
        """(root, node) for every node that isn't a root."""
        return ((r, x) for x in list(self.parent) if (r := self.root(x)) != x)


def edge_batch(pairs: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["lo", "hi"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.join(a, b)
        if len(found.parent) > 500_000:
            yield edge_batch(found.stars())
            found = Union()
    yield edge_batch(found.stars())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.least("u", "m").alias("lo"), F.col("v").alias("hi"))
    return moved.where("lo < hi").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return moved.unionAll(least.select(F.col("m").alias("lo"), "hi")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns); component: its smallest node."""
    a, b = edges.columns
    pairs = edges.select(F.col(a).cast("long").alias("lo"), F.col(b).cast("long").alias("hi")).where("lo is not null and hi is not null")
    forest = stored(pairs.mapInArrow(_contract, "lo long, hi long").distinct(), "stars")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
    before = sign(forest)
    while before[0]:
        forest = stored(_small_star(_large_star(forest)), "stars")
        now = sign(forest)
        if now == before:
            break
        before = now
    return forest.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        forest.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
