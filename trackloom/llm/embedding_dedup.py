"""Embedding near-duplicates by sorted projection passes.

In each pass the vectors are ordered lexicographically by 64 concatenated random hashes (signs of projections on
random directions of that pass), and each is compared with the next ``window`` vectors in that order. The number of passes is at
least ``passes`` and grows with the table as ``passes_for`` states, so that the share of links found does not fall. Blocks of
that order have a fixed number of rows and carry the following rows they need, so no bucket exists that could be hot. Pairs
whose cosine reaches the threshold in double precision are united across passes. Links lie inside components only, so
each vector's number of links is then counted exactly inside its component, also where the window was too short.

Components of more than ``chunk`` vectors are counted without all pairs: members within half the threshold's angle of a leader
are linked to each other by the triangle inequality (less a margin for rounding); only the others are compared, in pairs of chunks.

Equal vectors are one node with a weight. Defined cases. Null vector, null or non-finite component, zero
vector: no links. Vectors of different length: no links with each other. Null vec_id: linked, never smallest
unless all are null. Equal vec_ids and repeated rows: each row is a vector of its own. Empty table: an empty result.
Only vec_id and embedding are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from trackloom.llm.common import by_runs, sliced, stored, tasks_for
from trackloom.llm.components import Union, components, edge_batch

HASHES = 64
#: Of isolated pairs exactly at the threshold, the expected share that meets in a window of at least one pass.
RECALL = 0.999
#: Relative to 1: far above the rounding error of a dot product, far below any angle that matters.
MARGIN = 1e-9


def passes_for(n: int, threshold: float, window: int) -> int:
    """Passes after which a pair at the threshold has met with a chance of ``RECALL`` among n vectors.

    Vectors that agree on their first log2(n / window) signs are expected to lie within a window; a sign differs with a chance of
    the angle over pi.
    """
    if n <= window + 1:
        return 1
    same = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    met = max(same ** np.log2(n / window), window / n)
    return 1 if met >= RECALL else int(np.ceil(np.log1p(-RECALL) / np.log1p(-met)))


def _packed(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector's 64-bit numbers as bytes; null where it can't be compared."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                a = np.array(v, np.float64) if v and None not in v else np.empty(0)
                out.append((a + 0.0).tobytes() if len(a) and np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "raw"])
    kind = vectors.schema["embedding"].dataType
    assert isinstance(kind, ArrayType)
    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(work, "vec_id long, raw binary")


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors of packed ones of one length; scaled first so that squares neither overflow nor vanish."""
    a = np.array([np.frombuffer(v, np.float64) for v in column.to_pylist()])
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def _keys(nodes: DataFrame, passes: int, seed: int) -> DataFrame:
    """dim, pass, key (order-preserving signed long) and node for each pass."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.uint64(1) << np.arange(HASHES - 1, -1, -1, dtype=np.uint64)
        for batch in sliced(batches, max(1, 16_000 // passes)):
            dims = np.array(batch.column(1))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * HASHES))
                signs = (_units(part.column(2)) @ planes[dim] > 0).reshape(part.num_rows, passes, HASHES)
                keys = (signs * weights).sum(axis=2, dtype=np.uint64) ^ np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(dims[dims == dim], passes), pa.int32()), pa.array(np.tile(np.arange(passes, dtype=np.int32), part.num_rows)),
                    pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(np.array(part.column(0)), passes))], ["dim", "pass", "key", "node"])
    return nodes.select("node", "dim", "raw").mapInArrow(work, "dim int, pass int, key long, node long")


def _ranked(keys: DataFrame) -> DataFrame:
    """Position of each row in the whole order: a range-partitioned sort plus the rows of all partitions before."""
    order = ["dim", "pass", "key", "node"]
    placed = stored(keys.repartitionByRange(tasks_for(keys.sparkSession), *order).sortWithinPartitions(*order)
                    .withColumn("at", F.monotonically_increasing_id()), "projection-order")
    part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition.
    sizes = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.select("p", ahead.alias("ahead"))), part == F.col("p")).select("dim", "pass", "node", (F.col("ahead") + nth).alias("rank"))


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    return left @ right.T >= threshold


def _window_links(nodes: DataFrame, ranked: DataFrame, threshold: float, window: int, block: int) -> DataFrame:
    """Spanning edges of each block of each pass."""
    def compare(group: pa.Table) -> pa.Table | None:
        # Rows of one block, in order of rank; each is compared with the next ``window`` ranks that the block has.
        group = group.sort_by("rank")
        found = Union()
        rank, node, home = (np.array(group.column(c)) for c in ("rank", "node", "home"))
        kind = np.array(group.column("dim")).astype(np.int64) << 32 | np.array(group.column("pass"))
        for k in np.unique(kind).tolist():
            rows = np.flatnonzero(kind == k)
            unit = _units(group.column("raw").take(pa.array(rows)))
            own = np.flatnonzero(home[rows])
            for at in range(0, len(own), window):
                a = own[at:at + window]
                b = np.arange(a[0], min(a[-1] + window + 1, len(rows)))
                gap = rank[rows[b]][None, :] - rank[rows[a]][:, None]
                x, y = np.nonzero(linked(unit[a], unit[b], threshold) & (gap > 0) & (gap <= window))
                for i, j in zip(node[rows[a[x]]].tolist(), node[rows[b[y]]].tolist(), strict=True):
                    found.join(i, j)
        return pa.Table.from_batches([edge_batch(found.stars())])

    here = F.floor(F.col("rank") / block)
    homes = F.when((F.col("rank") % block < window) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))
    rows = ranked.join(nodes.select("node", "raw"), "node").select("dim", "pass", "node", "rank", "raw", here.alias("h"), F.explode(homes).alias("block"))
    rows = rows.select("block", "dim", "pass", "node", "rank", "raw", (F.col("h") == F.col("block")).alias("home"))
    return by_runs(rows, ["block"], compare, "lo long, hi long")


def _link_counts(nodes: DataFrame, member_of: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """node, links: weight of the other nodes of its component that it is linked to."""
    half = np.cos(np.arccos(threshold) / 2) * (1 + MARGIN) if threshold > -1 else 1.0
    placed = member_of.join(nodes.select("node", "weight", "raw"), "node")
    sizes = member_of.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = stored(placed.join(sizes, "component"), "members")
    leaders = placed.where((F.col("size") > chunk) & (F.col("node") == F.col("component"))).select("component", F.col("raw").alias("leader"))

    def near_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = (_units(batch.column(3)) * _units(batch.column(4))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cos >= half)], ["node", "component", "weight", "raw", "core"])

    fields = "node long, component long, weight long, raw binary, core boolean"
    big = stored(placed.join(leaders, "component").select("node", "component", "weight", "raw", "leader").mapInArrow(near_leader, fields), "core")
    small = placed.where(F.col("size") <= chunk).select("node", "component", "weight", "raw", F.lit(False).alias("core"))
    among = big.where("core").groupBy("component").agg(F.sum("weight").alias("w"))
    core = big.where("core").join(among, "component").select("node", (F.col("w") - F.col("weight")).alias("links"))

    # Chunks of the nodes outside the core, compared with each other and with the chunks of the core.
    rest = big.where("not core").unionAll(small)
    cut = rest.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("outer"))
    inner = big.where("core").groupBy("component").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("inner"))
    dealt = rest.unionAll(big.where("core")).join(cut, "component").join(inner, "component", "left")
    inner_c = F.coalesce("inner", F.lit(0))
    c = F.when(F.col("core"), F.col("outer") + F.pmod(F.xxhash64("node"), inner_c)).otherwise(F.pmod(F.xxhash64("node"), F.col("outer"))).cast("int")
    last = F.when(F.col("core"), F.col("outer")).otherwise(F.col("outer") + inner_c).cast("int") - 1
    dealt = dealt.select("component", "node", "weight", "raw", c.alias("c"), F.explode(F.sequence(F.lit(0), last)).alias("d"))
    pairs = dealt.select("component", F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"), "node", "weight", "raw",
                         F.when(F.col("c") == F.col("d"), 2).when(F.col("c") < F.col("d"), 0).otherwise(1).alias("side"))

    def count(group: pa.Table) -> pa.Table | None:
        side, node, weight = (np.array(group.column(n)) for n in ("side", "node", "weight"))
        unit = _units(group.column("raw"))
        out = np.zeros(len(node), np.int64)
        if (side == 2).any():
            hit = linked(unit, unit, threshold)
            np.fill_diagonal(hit, False)
            out = hit @ weight
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                return None
            hit = linked(unit[left], unit[right], threshold)
            out[left], out[right] = hit @ weight[right], hit.T @ weight[left]
        return pa.table({"node": node, "links": out})

    return core.unionAll(by_runs(pairs, ["component", "a", "b"], count, "node long, links long")).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, passes: int = 16, window: int = 256, block: int = 1024,
                    chunk: int = 1024, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    packed = stored(_packed(vectors), "vectors")
    nodes = packed.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    nodes = stored(nodes.select("raw", "first_id", "weight", (F.octet_length("raw") / 8).cast("int").alias("dim"), F.monotonically_increasing_id().alias("node")), "nodes")
    most = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    passes = max(passes, passes_for(most, threshold, window))
    edges = _window_links(nodes, _ranked(_keys(nodes, passes, seed)), threshold, window, block)
    member_of = stored(components(edges), "components")
    links = _link_counts(nodes, member_of, threshold, chunk)
    placed = nodes.join(member_of, "node", "left").select("node", "raw", "first_id", "weight", F.coalesce("component", "node").alias("c"))
    named = placed.groupBy("c").agg(F.min("first_id").alias("component_id"))
    known = placed.join(named, "c").join(links, "node", "left").select(
        F.col("raw").alias("k"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    alone = packed.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = packed.where("raw is not null").join(known, F.col("raw") == F.col("k")).select("vec_id", "n_links", "component_id").unionAll(alone)
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
