"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

Count tables are partitioned by n-gram hash and joined to the n-grams of the documents; the scores of a document's positions
are then summed. Rows are packed: a block is some 10 MB of text as word numbers, and one row of an exchange holds all
distinct n-grams of one block that fall into one hash bucket, sorted and delta-coded, with their counts in the block. So an
n-gram crosses the network once a block however frequent it is; the bucket adds up the counts and answers each block.

n-grams of two and more words that occur fewer than ``min_count`` times are pruned from the model, which is what makes scores back
off. An n-gram can only reach that count if both of its (n-1)-grams do, so orders are counted one after the other and only such n-grams are sent.

    S(w | context) = count(context w) / count(context)        if the n-gram is in the model
                   = alpha * S(w | context without its first word)    else;   S(w) = count(w) / N

Words are A-Z lowered and split at ASCII white space. Defined cases. Null or wordless text: no words, score 0, mean null. Null
or equal doc_ids and repeated rows: a row each, and all count. With another training corpus: words it lacks count as seen once.
Empty table: an empty result. Only doc_id and text are read, so other columns may have any names. Texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import by_runs, lowered_words, open_store, shared_folder, sliced, stored, tasks_for
from trackloom.llm.packing import bucket_cuts, deflated, inflated, sorted_bytes, sorted_numbers

BLOCK = "block long, scored boolean, counted boolean, n_words long, ids binary, lengths binary, vocabulary binary, words binary"
BLOCK_BYTES = 10 << 20
#: About so many distinct n-grams of all blocks meet in a bucket.
BUCKET_WORDS = 2 << 20


def joined_hash(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of all but its last word, and the last word's."""
    x = (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack_blocks(docs: DataFrame, *, scored: bool, counted: bool, first_block: int) -> DataFrame:
    """Blocks of the documents of one input partition, in the order read; nothing is shuffled."""
    def pack(part: int, nth: int, ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        words = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.uint32)
        vocabulary = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        lengths = np.array([len(t) for t in texts], np.uint32)
        named = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, named.schema) as out:
            out.write_batch(named)
        return pa.RecordBatch.from_arrays([
            pa.array([first_block + (part << 24) + nth], pa.int64()), pa.array([scored]), pa.array([counted]), pa.array([len(words)], pa.int64()),
            pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([deflated(lengths)], pa.binary()),
            pa.array([vocabulary.tobytes()], pa.binary()), pa.array([deflated(words)], pa.binary())], [f.split()[0] for f in BLOCK.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, nth = [], [], 0, 0
        for batch in sliced(batches, 500):
            part = batch.column(2)[0].as_py()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(lowered_words(text))
                size += len(text or "") + 16
                if size >= BLOCK_BYTES:
                    yield pack(part, nth, ids, texts)
                    ids, texts, size, nth = [], [], 0, nth + 1
        if ids:
            yield pack(part, nth, ids, texts)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(work, BLOCK)


class Block:
    """The n-grams of one block and the counts that have been answered so far."""

    def __init__(self, row: dict, answers: list[str], bits: int, min_count: int):
        self.bits, self.min_count = bits, min_count
        self.lengths = inflated(row["lengths"], np.uint32).astype(np.int64)
        self.vocabulary, self.words = np.frombuffer(row["vocabulary"], np.uint64), inflated(row["words"], np.uint32)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.grams = self.vocabulary[self.words]
        #: counts[k - 1]: for each position, the count of the k-gram that ends there; 0 if pruned.
        self.counts: list[np.ndarray] = []
        self.order = 1
        for folder in answers:
            unique, at, where = self.wanted()[:3]
            known = self._answer(folder, row["block"], len(unique))
            now = np.zeros(len(self.words), np.uint32)
            now[where] = known[at]
            self.counts.append(now)
            last = self.grams
            self.grams = np.zeros_like(last)
            self.grams[1:] = joined_hash(last[:-1], self.vocabulary[self.words[1:]])
            self.order += 1

    def wanted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct n-grams of the current order, each position's index among them, the positions, and counts."""
        if self.order == 1:
            unique, at, n = np.unique(self.vocabulary, return_inverse=True, return_counts=True)
            return unique, at[self.words], np.arange(len(self.words)), np.bincount(at[self.words], minlength=len(unique))
        kept = self.counts[-1] >= self.min_count
        where = np.flatnonzero(kept & np.concatenate(([False], kept[:-1])) & (self.place >= self.order - 1)) if len(kept) else np.empty(0, np.int64)
        unique, at, n = np.unique(self.grams[where], return_inverse=True, return_counts=True)
        return unique, at, where, n

    def _answer(self, folder: str, block: int, n: int) -> np.ndarray:
        if not n:
            return np.empty(0, np.uint32)
        store, path = open_store(f"{folder}/block={block}")
        found = ds.dataset(path, filesystem=store, format="parquet").to_table(["bucket", "counts"]).sort_by("bucket")
        return np.concatenate([inflated(c, np.uint32) for c in found.column("counts").to_pylist()])

    def requests(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(bucket, number, n-grams, counts) of the current order."""
        unique, _, _, n = self.wanted()
        for bucket, a, b in bucket_cuts(unique, self.bits):
            yield bucket, b - a, sorted_bytes(unique[a:b]), deflated(n[a:b].astype(np.uint32))

    def scores(self, order: int, alpha: float, total: int) -> np.ndarray:
        """log10 score of each document."""
        full = np.minimum(order, self.place + 1)
        log = [np.log10(np.maximum(c, 1)) for c in self.counts]
        out = log[0] - np.log10(max(total, 1)) + (full - 1) * np.log10(alpha)
        for k in range(2, order + 1):
            at = np.flatnonzero((self.counts[k - 1] >= self.min_count) & (self.place >= k - 1))
            out[at] = log[k - 1][at] - log[k - 2][at - 1] + (full[at] - k) * np.log10(alpha)
        sums = np.zeros(len(self.lengths))
        filled = np.flatnonzero(self.lengths)
        if len(filled):
            sums[filled] = np.add.reduceat(out, (np.cumsum(self.lengths) - self.lengths)[filled])
        return sums


def _count(blocks: DataFrame, answers: list[str], bits: int, min_count: int) -> str:
    """One order: ask, add up in the buckets, and store the answers by block. Returns their folder."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            for bucket, n, grams, counts in Block(row, answers, bits, min_count).requests():
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([row["counted"]]), pa.array([n], pa.int64()),
                                                  pa.array([grams], pa.binary()), pa.array([counts], pa.binary())], ["bucket", "block", "counted", "n", "grams", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        grams = np.concatenate([sorted_numbers(r["grams"], r["n"]) for r in rows])
        counts = np.concatenate([inflated(r["counts"], np.uint32) * r["counted"] for r in rows]).astype(np.uint64)
        order = np.argsort(grams, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(grams[order]) != 0)))
        sums = np.add.reduceat(counts[order], first)
        total = np.empty(len(grams), np.uint64)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(grams))))
        if answers:
            total[total < min_count] = 0
        total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        cuts = np.cumsum([r["n"] for r in rows])[:-1]
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                         "counts": pa.array([deflated(c) for c in np.split(total, cuts)], pa.binary())})

    asked = blocks.mapInArrow(ask, "bucket int, block long, counted boolean, n long, grams binary, counts binary")
    answered = by_runs(asked, ["bucket"], answer, "block long, bucket int, counts binary")
    folder = shared_folder(blocks.sparkSession, "answers")
    answered.repartition(tasks_for(blocks.sparkSession), "block").write.partitionBy("block").parquet(folder)
    return folder


def score(docs: DataFrame, train: DataFrame | None = None, *, order: int = 3, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """doc_id, n_words, log10_score, mean_log10: scores of ``docs`` under counts of ``train`` (itself if none is given)."""
    blocks = pack_blocks(docs, scored=True, counted=train is None, first_block=0)
    if train is not None:
        blocks = blocks.unionAll(pack_blocks(train, scored=False, counted=True, first_block=1 << 56))
    blocks = stored(blocks, "lm-blocks")
    facts = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("counted"), F.col("n_words"))), F.lit(0))).first()
    bits = max(3, int(facts[0] // BUCKET_WORDS).bit_length())
    answers: list[str] = []
    for _ in range(order):
        answers.append(_count(blocks, answers, bits, min_count))
    total = facts[1]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            block = Block(row, answers, bits, min_count)
            with pa.ipc.open_stream(row["ids"]) as stream:
                ids = stream.read_all().column(0).combine_chunks()
            sums = block.scores(order, alpha, total)
            n = block.lengths
            mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(sums), mean], ["doc_id", "n_words", "log10_score", "mean_log10"])

    return blocks.where("scored").mapInArrow(finish, "doc_id long, n_words long, log10_score double, mean_log10 double")
