"""Removal of long repeated byte strings, decided by sorting suffixes.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else in the corpus too. Sorting a suffix for
every byte of a corpus would move hundreds of times its size, so suffixes are first sieved:

1. Each string of ``length`` bytes has an anchor, the place with the smallest hash among its ``core``-byte strings. Strings with
   one anchor form a stretch of text. Equal strings have equal anchors, so only (anchor hash, stretch hash) pairs are counted,
   each distinct pair once a block: a stretch that occurs twice is repeated as a whole, an anchor that occurs once has no repeated string.
2. What remains are stretches whose anchor occurs elsewhere in another stretch, mostly at the ends of repeats. Each distinct one
   is sent to its anchor's group once, where the suffixes of all of its strings are sorted (suffix_sort) and equal ones found.
   Groups of more than ``hot`` distinct stretches are split by longer cores, ranges of places before the anchor apart.
3. The blocks mark the bytes of both kinds and cut them out. Everything is judged on the input, not on what is left.

Blocks are some 16 MB of whole documents, stored once; answers come back to a block in a folder of its own. Hashes have 64 bits, and a
stretch counts as repeated only where both of its hashes agree.

Defined cases. Null or empty text: nothing to remove. Fewer than ``length`` bytes: kept. Null or equal doc_ids and
repeated rows: each row is a document. Empty table: an empty result. Only doc_id and text are read, so other columns may have any
names. Long texts are treated whole; stretches are also cut every few MB of one text, which costs a few suffixes more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import by_runs, open_store, runs, shared_folder, sliced, tasks_for
from trackloom.llm.packing import bucket_cuts, deflated, inflated, sorted_bytes, sorted_numbers
from trackloom.llm.suffix_sort import repeated

BLOCK_BYTES = 16 << 20
#: Bytes hashed at once.
PIECE = 1 << 21
BASE = 0x9E3779B97F4A7C15
#: Bits that hold a place inside a piece.
PLACE = np.uint64((1 << 22) - 1)
#: Answers to a pair of hashes.
ALONE, REPEATED, SORT, REPEATED_AND_SORT, HOT = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    up = np.cumprod(np.concatenate((one, np.full(2 * PIECE, BASE, np.uint64))), dtype=np.uint64)
    down = np.cumprod(np.concatenate((one, np.full(2 * PIECE, pow(BASE, -1, 1 << 64), np.uint64))), dtype=np.uint64)
    return np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64), up, down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def stretches(data: np.ndarray, valid: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """First and last string start of each stretch, the anchor's place, anchor hash and stretch hash.

    ``valid``: whether the string starting at a place lies within one document.
    """
    table, up, down = _powers()
    n, width = len(data), length - core + 1
    if n < length or not valid.any():
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * up[:n], dtype=np.uint64)))
    hashes = _mixed((sums[core:] - sums[:-core]) * down[:n - core + 1])
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    least, span = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    before = np.concatenate(([False], valid[:-1]))
    change = np.concatenate(([True], least[1:] != least[:-1])) | ~before
    first = np.flatnonzero(change & valid)
    last = np.flatnonzero(np.append(change[1:] | ~valid[1:], True) & valid)
    anchor = (least[first] & PLACE).astype(np.int64)
    whole = _mixed((sums[last + length] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return first, last, anchor, hashes[anchor], whole


def _pieces(raws: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in the block, bytes, valid string starts) of runs of documents, long ones in overlapping parts."""
    at, held, base = 0, [], 0

    def made(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return data, (np.repeat(sizes, sizes) - place >= length)[:max(0, len(data) - length + 1)]

    for raw in raws:
        if len(raw) > PIECE:
            if held:
                yield base, *made(held)
            for cut in range(0, len(raw), PIECE):
                part = raw[cut:cut + PIECE + length - 1]
                yield at + cut, *made([part])
            held, base = [], at + len(raw)
        else:
            held.append(raw)
            if at + len(raw) - base >= PIECE:
                yield base, *made(held)
                held, base = [], at + len(raw)
        at += len(raw)
    if held:
        yield base, *made(held)


class Block:
    """All stretches of a block, and its distinct hash pairs in order."""

    def __init__(self, row: dict, length: int, core: int):
        self.ids, self.data, self.length, self.core = row["ids"], row["data"], length, core
        self.lengths = inflated(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        found = [[] for _ in range(5)]
        raws = [self.data[a:a + n] for a, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=True)]
        for base, data, valid in _pieces(raws, length):
            first, last, anchor, a, b = stretches(data, valid, length, core)
            for to, what in zip(found, (first + base, last + base, anchor + base, a, b), strict=True):
                to.append(what)
        self.first, self.last, self.anchor, self.a, self.b = (np.concatenate(f) if f else np.empty(0, np.int64) for f in found)
        order = np.lexsort((self.b, self.a))
        a, b = self.a[order], self.b[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.pair_a, self.pair_b = a[new], b[new]
        self.pair_of = np.empty(len(order), np.int64)
        self.pair_of[order] = np.cumsum(new) - 1
        self.pair_n = np.bincount(self.pair_of, minlength=len(self.pair_a))


def _pack(docs: DataFrame) -> DataFrame:
    fields = "block long, ids array<long>, lengths binary, data binary"

    def pack(part: int, nth: int, ids: list, raws: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([(part << 24) + nth], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([deflated(np.array([len(r) for r in raws], np.int64))], pa.binary()),
            pa.array([b"".join(raws)], pa.binary())], [f.split()[0] for f in fields.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raws, size, nth = [], [], 0, 0
        for batch in sliced(batches, 500):
            part = batch.column(2)[0].as_py()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                raws.append(text.encode("utf-8", "surrogatepass") if text else b"")
                size += len(raws[-1]) + 16
                if size >= BLOCK_BYTES:
                    yield pack(part, nth, ids, raws)
                    ids, raws, size, nth = [], [], 0, nth + 1
        if ids:
            yield pack(part, nth, ids, raws)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(work, fields)


def _count_pairs(group: pa.Table, hot: int) -> pa.Table:
    """Answers for the pairs of one bucket, as one code for each pair that a block asked about."""
    rows = group.sort_by("block").to_pylist()
    a = np.concatenate([sorted_numbers(r["a"], r["n"]) for r in rows])
    b = np.concatenate([np.frombuffer(r["b"], np.uint64) for r in rows])
    n = np.concatenate([inflated(r["counts"], np.uint8) for r in rows]).astype(np.int64)
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    new_a = np.concatenate(([True], a[1:] != a[:-1]))
    new = new_a | np.concatenate(([True], b[1:] != b[:-1]))
    pair = np.cumsum(new) - 1
    per_pair = np.add.reduceat(n, np.flatnonzero(new))
    anchor_of = np.cumsum(new_a[new]) - 1
    occurrences = np.bincount(anchor_of, per_pair)
    distinct = np.bincount(anchor_of)
    # Something is left to sort where an anchor has several stretches, one of them only once.
    open_anchor = (np.bincount(anchor_of, per_pair == 1) > 0) & (occurrences > 1)
    code = np.where(per_pair > 1, REPEATED, np.where(occurrences[anchor_of] > 1, SORT, ALONE))
    code = code + HOT * (open_anchor & (distinct > hot))[anchor_of]
    each = code[pair]
    # Of a repeated stretch one copy is sent.
    send = new & (per_pair > 1)[pair] & open_anchor[anchor_of[pair]]
    each = each + (REPEATED_AND_SORT - REPEATED) * send
    out = np.empty(len(each), np.uint8)
    out[order] = each
    cuts = np.cumsum([r["n"] for r in rows])[:-1]
    return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                     "codes": pa.array([deflated(c) for c in np.split(out, cuts)], pa.binary())})


def _folder_rows(folder: str, block: int, columns: list[str], order: list[tuple[str, str]]) -> pa.Table | None:
    """Rows answered to a block; none if there is no folder for it."""
    store, path = open_store(f"{folder}/block={block}")
    if store.get_file_info(path).type.name == "NotFound":
        return None
    return ds.dataset(path, filesystem=store, format="parquet").to_table(columns).sort_by(order)


def _codes(folder: str, row: dict) -> np.ndarray:
    found = _folder_rows(folder, row["block"], ["bucket", "codes"], [("bucket", "ascending")])
    return np.concatenate([inflated(c, np.uint8) for c in found.column("codes").to_pylist()]) if found else np.empty(0, np.uint8)


def _answers(df: DataFrame, purpose: str) -> str:
    folder = shared_folder(df.sparkSession, purpose)
    df.repartition(tasks_for(df.sparkSession), "block").write.partitionBy("block").parquet(folder)
    return folder


def remove_repeats(docs: DataFrame, *, length: int = 200, core: int = 100, hot: int = 1000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges) and kept (the bytes that stay)."""
    if not 32 <= core < length:
        raise ValueError("core must be at least 32 bytes and shorter than length")
    spark = docs.sparkSession
    folder = shared_folder(spark, "suffix-blocks")
    _pack(docs).write.option("compression", "zstd").parquet(folder)
    blocks = spark.read.parquet(folder)
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    bits = max(6, (size // (length - core) // (1 << 19)).bit_length())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            block = Block(row, length, core)
            for bucket, x, y in bucket_cuts(block.pair_a, bits):
                yield pa.RecordBatch.from_arrays([
                    pa.array([bucket], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([y - x], pa.int64()), pa.array([sorted_bytes(block.pair_a[x:y])], pa.binary()),
                    pa.array([block.pair_b[x:y].tobytes()], pa.binary()), pa.array([deflated(np.minimum(block.pair_n[x:y], 2).astype(np.uint8))], pa.binary())],
                    ["bucket", "block", "n", "a", "b", "counts"])

    asked = blocks.mapInArrow(ask, "bucket int, block long, n long, a binary, b binary, counts binary")
    codes = _answers(by_runs(asked, ["bucket"], lambda g: _count_pairs(g, hot), "block long, bucket int, codes binary"), "suffix-codes")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            block, code = Block(row, length, core), _codes(codes, row)
            for pairs in np.array_split(np.flatnonzero(code & SORT), max(1, len(code) // 5000)):
                out = []
                one_of = np.full(len(code), -1)
                one_of[block.pair_of] = np.arange(len(block.pair_of))
                for p in pairs.tolist():
                    k = one_of[p]
                    first, last, anchor, wants = int(block.first[k]), int(block.last[k]), int(block.anchor[k]), code[p] & 3 == SORT
                    name = int(block.pair_a[p]).to_bytes(8, "big")
                    if not code[p] & HOT:
                        out.append((name, row["block"], p, 0, wants, block.data[first:last + length]))
                        continue
                    # Ranges of 20 places; the bytes that all strings of a range share become part of the name.
                    for low in range(0, length - core + 1, 20):
                        a, b = max(first, anchor - low - 19), min(last, anchor - low)
                        if a <= b:
                            core_bytes = block.data[anchor - low:anchor - low - 19 + length]
                            out.append((name + bytes([low // 20]) + hashlib.blake2b(core_bytes, digest_size=12).digest(), row["block"], p, a - first, wants, block.data[a:b + length]))
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["name", "block", "pair", "skip", "wants", "text"])

    def sort_batch(groups: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(groups)
        texts = rows.column("text").to_pylist()
        sizes = np.array([len(t) for t in texts])
        counts = sizes - length + 1
        starts = np.repeat(np.cumsum(sizes) - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        hits = np.split(repeated(b"".join(texts), starts, length), np.cumsum(counts)[:-1])
        keep = [w and h.any() for w, h in zip(rows.column("wants").to_pylist(), hits, strict=True)]
        found = rows.select(["block", "pair", "skip"]).filter(pa.array(keep)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in found.columns), pa.array([np.packbits(h).tobytes() for h, k in zip(hits, keep, strict=True) if k], pa.binary())],
                                          ["block", "pair", "skip", "hits"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in runs(batches, ["name"]):
            if group.num_rows > 1:
                held.append(group)
                size += group.num_rows
            if size > 2000:
                yield sort_batch(held)
                held, size = [], 0
        if held:
            yield sort_batch(held)

    sent = blocks.mapInArrow(send, "name binary, block long, pair long, skip int, wants boolean, text binary")
    n = tasks_for(spark)
    ends = _answers(sent.repartition(n, "name").sortWithinPartitions("name").mapInArrow(sort, "block long, pair long, skip int, hits binary"), "suffix-ends")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            block, code = Block(row, length, core), _codes(codes, row)
            step = np.zeros(len(block.data) + 1, np.int32)
            whole = code[block.pair_of] & 1 == REPEATED if len(code) else np.empty(0, bool)
            np.add.at(step, block.first[whole], 1)
            np.add.at(step, block.last[whole] + length, -1)
            found = _folder_rows(ends, row["block"], ["pair", "skip", "hits"], [("pair", "ascending")])
            if found:
                # A pair to be sorted occurs once in the corpus, so it names one stretch.
                one_of = np.zeros(len(code), np.int64)
                one_of[block.pair_of] = np.arange(len(block.pair_of))
                for p, skip, hits in zip(*(c.to_pylist() for c in found.columns), strict=True):
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(hits, np.uint8))) + block.first[one_of[p]] + skip
                    np.add.at(step, at, 1)
                    np.add.at(step, at + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            yield _cut_block(block, gone)

    return blocks.mapInArrow(cut, fields)


def _cut_block(block: Block, gone: np.ndarray) -> pa.RecordBatch:
    data = np.frombuffer(block.data, np.uint8)
    n_removed, spans, kept = [], [], []
    for a, n in zip(block.starts.tolist(), block.lengths.tolist(), strict=True):
        out = gone[a:a + n]
        if not out.any():
            n_removed.append(0)
            spans.append([])
            kept.append(block.data[a:a + n])
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
        n_removed.append(int(out.sum()))
        spans.append([{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
        kept.append(data[a:a + n][~out].tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([
        pa.array(block.ids, pa.int64()), pa.array(block.lengths), pa.array(n_removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
        pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(spans, span), pa.array(kept, pa.binary())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
