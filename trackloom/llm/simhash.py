"""SimHash near-duplicates: fingerprints of word shingles, searched with BK-trees.

Equal fingerprints collapse into one node first, so copies cost nothing. Two fingerprints that differ in at most
``radius`` bits agree on at least one of radius + 1 slices of their bits; each slice value is a shard, and each shard has a BK-tree (children
keyed by integer Hamming distance to the parent) that is searched along the edges within the radius only. Since all trees together grow
with the corpus, the shuffle carries each tree to its queries rather than a driver broadcast. A shard with
more than ``hot`` nodes is cut again by slices of its remaining bits, which loses no pair; what is still
too large after ``levels`` cuts is compared exactly in pairs of chunks. A shard reports spanning edges only, never all of its pairs.

Defined cases. Null or wordless text: fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence.
Null doc_id: linked like any other, never a component's smallest id unless all are null. Equal doc_ids and repeated rows: a
row each. Empty table: an empty result. Only doc_id and text are read, so other columns may have any names. Texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trackloom.llm.common import by_runs, lowered_words, sliced, stored
from trackloom.llm.components import Union, components, edge_batch

SEED = 42
BITS = 64


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by spaces, repeats included."""
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = map(slice, starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cuts), repeat(SEED)), np.uint64, len(words) - size + 1)


BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes."""
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        counts = np.bincount(octets[:, k], minlength=256) @ BYTE_BITS
        for b in np.flatnonzero(2 * counts > len(hashes)).tolist():
            out |= 1 << (8 * k + b)
    return out


def fingerprint(text: str | None, size: int = 4) -> int:
    return majority(shingle_hashes(lowered_words(text), size))


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fingerprint as a signed long, one row per document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fp long")


class BKTree:
    """Values under integer Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0 if self.values else -1
        while at >= 0:
            d = (value ^ self.values[at]).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values)
                break
            at = nxt
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> Iterator[int]:
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                yield self.values[at]
            todo.extend(child for e, child in self.children[at].items() if d - radius <= e <= d + radius)


def shard_edges(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning edges (signed longs) of the links inside one shard."""
    tree, found = BKTree(), Union()
    for v in values:
        u = v & (1 << BITS) - 1
        for w in tree.near(u, radius):
            found.join(w - (1 << BITS) if w >> BITS - 1 else w, v)
        tree.add(u)
    return list(found.stars())


def chunk_edges(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    found = Union()
    for at in range(0, len(left), 256):
        a, b = np.nonzero(np.bitwise_count(left[at:at + 256, None] ^ right[None, :]) <= radius)
        for x, y in zip(left.view(np.int64)[at + a].tolist(), right.view(np.int64)[b].tolist(), strict=True):
            found.join(x, y)
    return list(found.stars())


def _cut(rows: DataFrame, width: int, slices: int) -> tuple[DataFrame, int]:
    """Each row once per slice: keyed by path, slice and its bits, with the other bits as what remains.

    ``width`` bits remain before the cut; all paths are cut alike, the largest slice decides what may remain.
    """
    bounds = [width * i // slices for i in range(slices + 1)]
    made = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        low = F.col("rest").bitwiseAND(F.lit((1 << a) - 1))
        piece = F.shiftrightunsigned("rest", a).bitwiseAND(F.lit((1 << b - a) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", b), a) if b < BITS else F.lit(0).cast("long")
        made.append(F.struct(F.xxhash64("path", F.lit(i), piece).alias("path"), low.bitwiseOR(high).alias("rest")))
    cut = rows.select("fp", F.explode(F.array(*made)).alias("s")).select("fp", "s.path", "s.rest")
    return cut, width - min(b - a for a, b in zip(bounds, bounds[1:], strict=False))


def links(nodes: DataFrame, *, radius: int = 4, hot: int = 4096, levels: int = 3) -> DataFrame:
    """Spanning edges (lo, hi) among distinct fingerprints ``nodes.fp``."""
    def search(group: pa.Table) -> pa.Table | None:
        values = group.column("fp").to_pylist()
        return pa.Table.from_batches([edge_batch(shard_edges(values, radius))]) if len(values) > 1 else None

    def compare(group: pa.Table) -> pa.Table | None:
        side, fp = np.array(group.column("side")), np.array(group.column("fp")).view(np.uint64)
        left, right = fp[side != 1], fp[side != 0]
        return pa.Table.from_batches([edge_batch(chunk_edges(left, right, radius))])

    rows, width = nodes.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("rest")), BITS
    count = nodes.count()
    edges = None
    for level in range(levels):
        # One cut leaves count / 2**13 nodes a shard; more are made at once until a shard has a few dozen.
        rows, width = _cut(rows, width, radius + 1)
        while level == 0 and count >> (BITS - width) > 128 and width > 32:
            rows, width = _cut(rows, width, radius + 1)
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        large = stored(sizes.where(F.col("n") > hot), "hot-shards")
        any_hot = not large.isEmpty()
        cold = rows.join(large.select("path"), "path", "left_anti") if any_hot else rows
        found = by_runs(cold.select("path", "fp"), ["path"], search, "lo long, hi long")
        edges = found if edges is None else edges.unionAll(found)
        if not any_hot:
            return edges
        rows = rows.join(large.select("path"), "path", "left_semi").select("fp", "path", "rest")
    sizes = rows.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("chunks"))
    mine: Column = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = rows.join(sizes, "path").select("path", "fp", "chunks", mine.alias("c"))
    # Chunk c is the left side of pairs (c, d >= c) and the right side of (d < c, c); both sides in (c, c).
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = dealt.select("path", "fp", "c", other.alias("d")).select(
        "path", F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"), "fp",
        F.when(F.col("c") == F.col("d"), 2).when(F.col("c") < F.col("d"), 0).otherwise(1).alias("side"))
    return edges.unionAll(by_runs(pairs, ["path", "a", "b"], compare, "lo long, hi long"))


def _groups(nodes: DataFrame, radius: int) -> DataFrame:
    """fp and the smallest fingerprint ``c`` of its component."""
    # Stored, so that search and contraction need no two Python workers a task: Spark keeps every worker, with all it holds, for later stages.
    found = components(stored(links(nodes, radius=radius), "links"))
    return nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("c"))


def near_duplicates(docs: DataFrame, *, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable by links."""
    marked = stored(fingerprints(docs, size), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    placed = _groups(nodes.select("fp"), radius).join(nodes, "fp")
    named = placed.groupBy("c").agg(F.min("first_id").alias("component_id"))
    named = placed.join(named, "c").select(F.col("fp").alias("k"), "component_id")
    return marked.join(named, marked.fp == F.col("k")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, size: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, all columns kept: that with the smallest doc_id, then the smallest hash of the row."""
    names, at = docs.columns, docs.columns.index("text")
    own = [f"c{i}" for i in range(len(names))]  # so that the given names may be any
    numbered = docs.toDF(*own)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            found = np.array([fingerprint(t, size) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*own, "fp"])

    found = numbered.mapInArrow(mark, StructType([*numbered.schema.fields, StructField("fp", LongType())]))
    rows = stored(found.select(F.struct(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True)]).alias("row"), "fp",
                               F.monotonically_increasing_id().alias("place")), "marked")
    each = rows.select("fp", F.struct(F.col("row.doc_id").isNull().alias("n"), F.col("row.doc_id").alias("i"), F.xxhash64("row").alias("h"), F.col("place").alias("p")).alias("o"))
    nodes = stored(each.groupBy("fp").agg(F.min("o").alias("o")), "nodes")
    kept = _groups(nodes.select("fp"), radius).join(nodes, "fp").groupBy("c").agg(F.min("o").alias("o")).select(F.col("o.p").alias("place"))
    return rows.join(kept, "place", "left_semi").select("row.*")
