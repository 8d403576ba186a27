"""Documents packed into blocks, and questions of blocks that are answered in hash buckets.

A block holds some megabytes of texts in the form its operator wants. What a block must know about the whole corpus it asks:
one packed question for each hash bucket. A bucket's task sees the questions of all blocks, answers each, and the answers
join the block again. So each distinct key crosses the network twice for each block, never once for each occurrence, and a
frequent key costs one entry a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import runs, sliced, tasks_for


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack_array(a: np.ndarray) -> bytes:
    """An integer array by byte planes, so that equal high bytes nearly vanish."""
    return squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack_array(raw: bytes, kind: type | np.dtype) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_strings(parts: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, parts), np.uint32, len(parts))
    return squeeze(np.uint32(len(parts)).tobytes() + lengths.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(parts))


def unpack_strings(raw: bytes) -> list[bytes]:
    data = unsqueeze(raw)
    n = int.from_bytes(data[:4], "little")
    lengths = np.frombuffer(data, np.uint8, 4 * n, 4).reshape(4, n).T.copy().view(np.uint32).reshape(-1)
    cuts = [4 + 4 * n, *(4 + 4 * n + np.cumsum(lengths, dtype=np.int64)).tolist()]
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def joined(parts: list[bytes]) -> bytes:
    return b"".join(x for p in parts for x in (len(p).to_bytes(8, "little"), p))


def parted(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at:at + 8], "little")
        out.append(raw[at + 8:at + 8 + n])
        at += 8 + n
    return out


def pack_ids(ids: list[int | None]) -> bytes:
    missing = np.flatnonzero([i is None for i in ids])
    return joined([pack_array(np.array([i or 0 for i in ids], np.int64)), pack_array(missing.astype(np.int64))])


def unpack_ids(raw: bytes) -> pa.Array:
    values, missing = (unpack_array(x, np.int64) for x in parted(raw))
    mask = np.zeros(len(values), bool)
    mask[missing] = True
    return pa.array(values, pa.int64(), mask=mask)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one pass in the JVM, by which numbers of tasks and buckets are set."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")), F.lit(0))).first()[0]


def pack_blocks(docs: DataFrame, pack: Callable[[list[str]], list[bytes]], *, block_bytes: int) -> DataFrame:
    """(block, payload): the doc_ids and what ``pack`` makes of the texts (null: empty), in one value; see ``parted``.

    A text is never cut: a block is closed when it has reached ``block_bytes`` characters. Blocks are numbered by partition, so they
    must be stored or shuffled before several branches read them.
    """
    def row(part: int, nth: int, ids: list, texts: list[str]) -> pa.RecordBatch:
        payload = joined([pack_ids(ids), *pack(texts)])
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + nth], pa.int64()), pa.array([payload], pa.binary())], ["block", "payload"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, nth, part = [], [], 0, 0, 0
        for batch in sliced(batches, 500):
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1]) + 16
                if size >= block_bytes:
                    yield row(part, nth, ids, texts)
                    ids, texts, size, nth = [], [], 0, nth + 1
        if ids:
            yield row(part, nth, ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(work, "block long, payload binary")


def consult(blocks: DataFrame, n_buckets: int, regions: int, ask: Callable[[list[bytes]], Iterator[tuple[int, bytes]]],
            answer: Callable[[list[bytes]], tuple[list[bytes], bytes | None]]) -> DataFrame:
    """The answers: block, bucket, answer, and note, which ``answer`` may add once a bucket.

    ``ask`` gives a block's question for each bucket below ``n_buckets`` that it needs; ``answer`` gets one bucket's questions
    of all blocks of a region, the only thing that a task holds besides one block. Blocks are dealt to ``regions`` by number: where
    each answer follows from its question alone, more regions keep both the questions of a block and a bucket's size bounded.
    """
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for row in batch.to_pylist():
                found = list(ask(parted(row["payload"])))
                region = [zlib.crc32(row["block"].to_bytes(8, "little")) % regions] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(region, pa.int32()), pa.array([b for b, _ in found], pa.int32()), pa.array([row["block"]] * len(found), pa.int64()),
                                                  pa.array([q for _, q in found], pa.binary())], ["region", "bucket", "block", "question"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["region", "bucket"]):
            answers, note = answer(group.column("question").to_pylist())
            n = len(answers)
            yield pa.RecordBatch.from_arrays([group.column("block").combine_chunks(), group.column("bucket").combine_chunks(), pa.array(answers, pa.binary()),
                                              pa.array([note] + [None] * (n - 1), pa.binary())], ["block", "bucket", "answer", "note"])

    questions = blocks.mapInArrow(asked, "region int, bucket int, block long, question binary")
    tasks = max(1, min(n_buckets * regions, max(tasks_for(blocks.sparkSession), n_buckets * regions // 4)))
    dealt = questions.repartition(tasks, "region", "bucket").sortWithinPartitions("region", "bucket")
    return dealt.mapInArrow(answered, "block long, bucket int, answer binary, note binary")


def finished(blocks: DataFrame, answers: DataFrame, tasks: int, finish: Callable[[list[bytes], dict[int, bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The rows that ``finish`` makes of each block's payload and its answers by bucket, in ``tasks`` tasks.

    Blocks that were dealt out by ``repartition(tasks, "block")`` before aren't shuffled again.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for row in batch.to_pylist():
                yield from finish(parted(row["payload"]), {a["bucket"]: a["answer"] for a in row["answers"] or ()})

    by_block = answers.select("block", "bucket", "answer").repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    return blocks.join(by_block, "block", "left").select("payload", "answers").mapInArrow(work, schema)


MOST_BUCKETS = 1024


def bucket_count(size: int, bucket_size: int) -> tuple[int, int]:
    """(buckets, regions): a bucket of a region gets about ``bucket_size``. Buckets are a power of two; a block has one question for each at most."""
    buckets = min(MOST_BUCKETS, 1 << max(0, (size // bucket_size).bit_length()))
    return buckets, max(1, -(-size // (buckets * bucket_size)))
