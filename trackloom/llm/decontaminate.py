"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Words are runs of 0-9, a-z (A-Z in lower case) and every non-ASCII character. A window is 13
consecutive words of an item, or all words of a shorter item. The automaton holds each distinct
window between single spaces, so it matches whole words only, and scans each normalised text
once; match ends are mapped to word numbers and, for reported spans, to byte offsets of the original text.

Defined cases. Null or wordless text: no words, not contaminated. Null or wordless item: no
window. Repeated documents or items: a row each; equal item_ids count once. Null item_id: its windows
hit words but it is not listed. Empty tables: an empty result, or no hits. Only doc_id, text and
item_id are read, so other columns may have any names. A text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import open_store, shared_folder, sliced, write_whole

# Byte table: A-Z to lower case, other ASCII that is no digit or letter to a space, the rest unchanged.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "spans array<struct<start:long,end:long>>, items array<long>")


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def window_lists(items: list[tuple[int | None, str | None]], width: int) -> dict[str, tuple[int, list[int]]]:
    """Window text -> (words in it, ids of the items that have it)."""
    found: dict[str, tuple[int, set[int]]] = {}
    for item_id, text in items:
        words = normal_words(text)
        step = min(width, len(words))
        for i in range(len(words) - step + 1 if words else 0):
            key = " " + b" ".join(words[i:i + step]).decode("utf-8", "surrogatepass") + " "
            ids = found.setdefault(key, (step, set()))[1]
            if item_id is not None:
                ids.add(item_id)
    return {k: (n, sorted(ids)) for k, (n, ids) in found.items()}


def automaton(windows: dict[str, tuple[int, list[int]]]) -> ahocorasick.Automaton | None:
    tree = ahocorasick.Automaton()
    for key, value in windows.items():
        tree.add_word(key, value)
    if not windows:
        return None
    tree.make_automaton()
    return tree


def scan(tree: ahocorasick.Automaton | None, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, merged hit word ranges [from, to) and item ids of one text."""
    words = normal_words(text)
    if not words or tree is None:
        return len(words), [], set()
    line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    ends, widths, ids = [], [], set()
    for end, (n, found) in tree.iter(line):
        ends.append(end)
        widths.append(n)
        ids.update(found)
    if not ends:
        return len(words), [], ids
    # The k-th space (from 0) closes word k - 1.
    space_at = np.flatnonzero(np.fromiter(map(ord, line), np.uint32, len(line)) == 32)
    to = np.searchsorted(space_at, ends)
    return len(words), merged_ranges(list(zip((to - np.array(widths)).tolist(), to.tolist(), strict=True))), ids


def merged_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte offsets in the original text of hit word ranges."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(NORMAL), np.uint8)
    inside = np.concatenate(([False], raw != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in ranges]


def _result(doc_ids: list[int | None], counts: list[int], ranges: list[list[tuple[int, int]]], ids: list[set[int]],
            texts: list[str | None], share: int) -> pa.RecordBatch:
    hit = [sum(b - a for a, b in r) for r in ranges]
    digest = [hashlib.sha256(",".join(sorted(map(str, s))).encode()).hexdigest() for s in ids]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([
        pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()),
        pa.array([len(s) for s in ids], pa.int64()), pa.array(digest), pa.array([h > 0 and share * h >= n for h, n in zip(hit, counts, strict=True)]),
        pa.array([original_spans(t, r) if r else [] for t, r in zip(texts, ranges, strict=True)], span),
        pa.array([sorted(s) for s in ids], pa.list_(pa.int64())),
    ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])


class _Parts:
    """The benchmark's windows as parts of bounded size: one broadcast, or files in the shared folder.

    A benchmark of up to ``max_part_bytes`` is one part, whose automaton each task builds once. Beyond
    that each task loads part after part for every batch, so that memory stays bounded.
    """

    def __init__(self, benchmark: DataFrame, width: int, max_part_bytes: int):
        rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.files: list[str] = []
        self.tree = None
        if size <= max_part_bytes:
            items = [(r.item_id, r.text) for r in rows.collect()]
            self.windows = rows.sparkSession.sparkContext.broadcast(window_lists(items, width))
            return
        where = shared_folder(rows.sparkSession, "windows")

        def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = [row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            name = f"{uuid.uuid4().hex}.windows"
            write_whole(where, name, iter([pickle.dumps(window_lists(items, width))]))
            yield pa.RecordBatch.from_arrays([pa.array([f"{where}/{name}"])], ["file"])

        parts = -(-size // max_part_bytes)
        self.files = [r.file for r in rows.repartition(parts, F.xxhash64("item_id", "text")).mapInArrow(save, "file string").collect()]

    def trees(self) -> Iterator[ahocorasick.Automaton | None]:
        if not self.files:
            if self.tree is None:
                self.tree = [automaton(self.windows.value)]
            yield self.tree[0]
        for file in self.files:
            store, path = open_store(file)
            with store.open_input_stream(path, compression=None) as f:
                yield automaton(pickle.loads(f.read()))


def scan_batch(parts: _Parts, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    found = None
    for tree in parts.trees():
        now = [scan(tree, t) for t in texts]
        found = now if found is None else [(n, merged_ranges(a + b), i | j) for (n, a, i), (_, b, j) in zip(found, now, strict=True)]
    return found or []


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, share: int = 20,
                       max_part_bytes: int = 32 << 20) -> DataFrame:
    """One row per document with hit counts, the digest of its items and the hit spans.

    ``contaminated``: at least one word is hit and hits are at least 1/``share`` of the words.
    Documents are read once and never shuffled.
    """
    parts = _Parts(benchmark, width, max_part_bytes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            texts = batch.column(1).to_pylist()
            found = scan_batch(parts, texts)
            yield _result(batch.column(0).to_pylist(), [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], texts, share)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, share: int = 20,
                      max_part_bytes: int = 32 << 20) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns kept; one scan, no join."""
    at = docs.columns.index("text")
    parts = _Parts(benchmark, width, max_part_bytes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            keep = []
            for n, ranges, _ in scan_batch(parts, batch.column(at).to_pylist()):
                hit = sum(b - a for a, b in ranges)
                keep.append(not (hit > 0 and share * hit >= n))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
