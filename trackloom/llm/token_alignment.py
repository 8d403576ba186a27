"""Alignment of two tokenizers' tokens over the same bytes, and how usual each aligned pair is in the corpus.

A text's tokens of both sides tile the same bytes. Every token points to the farthest-right token of the other side that overlaps it, unless
it ends there itself: then the A token is the end of its group and the B token points to it. Doubling the pointers
(p = p[p], all tokens of a block at once) leads every token to the last one of its component, which names its group. Groups are the
finest parts of the text whose edges both sides share.

Each stretch between neighbouring token edges is one link, an overlapping pair. How many documents hold an id pair is
counted once for the corpus: blocks ask hash buckets of pairs with their own document counts, buckets add up and answer. The
highest count of each A id is a table with at most one row for each id of tokenizer A (``vocabulary``), so its size is
proven and it is broadcast.

Defined cases. Null or empty text, or one whose joined token bytes differ from space + text on either side (a normalised
character, say): no tokens, zeros, ''. Null doc_id: kept. Repeated rows: one result each, each counts as a document.
Empty table: no rows. Special tokens are plain text. Only doc_id and text are read, so other columns may have any names.
A text of any length is encoded as a whole.

Scale. A task holds one block (``block_bytes`` of text, or one longer text) or one bucket of pairs. A pair that stands in all blocks adds
one entry a block to its bucket.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from trackloom.llm.blocks import consult, finished, joined, pack_array, pack_blocks, parted, text_bytes, unpack_array, unpack_ids
from trackloom.llm.common import stored, tasks_for

BLOCK_BYTES = 2_000_000
#: Bytes of text for each bucket of pairs, and for each task that writes results.
BUCKET_BYTES, TASK_BYTES = 8_000_000, 32_000_000


def vocabulary_file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def _byte_level() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _token_bytes(token: str, alphabet: dict[str, int]) -> bytes:
    return bytes(map(alphabet.__getitem__, token))


def same_as_ranks(file: bytes) -> bool:
    """Whether encoding by ranks (merge the leftmost pair whose joined bytes have the lowest id) gives the ids of this tokenizers file.

    It does if the file splits by the usual byte-level pattern, ids rise with the merges, and each token's bytes, merged by the listed
    merges alone, become that token: then no other two tokens that make up its bytes ever stand side by side when its turn comes.
    """
    spec = json.loads(file)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = (spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
             and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("unk_token"))
    if not plain:
        return False
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocabulary, special = model["vocab"], {t["content"] for t in spec["added_tokens"]}
    made = [vocabulary["".join(m)] for m in merges]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        return False
    rank = {m: i for i, m in enumerate(merges)}
    for token in vocabulary.keys() - special:
        parts = list(token)
        while len(parts) > 1:
            low = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(merges)))
            if (parts[low], parts[low + 1]) not in rank:
                return False
            parts[low:low + 2] = [parts[low] + parts[low + 1]]
    return True


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the decimal ids with each separator.

    ``ranks``: tokenizer A is read as ranks by the tiktoken library, which is several times as fast (see ``same_as_ranks``).
    Texts with long runs of white space, on which its pattern overflows, go to the tokenizers library.
    """

    LONG_GAP = re.compile(r"\s{5000}")

    def __init__(self, a: bytes, b: bytes, ranks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        alphabet = _byte_level()
        self.size_a, self.size_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = _token_bytes(token, alphabet) if set(token) <= alphabet.keys() else token.encode("utf-8")
        self.ranked = None
        if ranks:
            table = {_token_bytes(t, alphabet): i for t, i in self.a.get_vocab(with_added_tokens=False).items()}
            self.ranked = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.size_b)]
        self.lengths_a, self.lengths_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # The id's place in these tables: id, or id + size if it is the last one of its group.
        self.names_a = np.array([f"{i}{end}" for end in ",|" for i in range(self.size_a)], object)
        self.names_b = np.array([f"{i}{end}" for end in ",;" for i in range(self.size_b)], object)
        self.kind_a, self.kind_b = (np.dtype("<u2" if n <= 1 << 16 else "<u4") for n in (self.size_a, self.size_b))

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode("utf-8")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none on either side for an empty text or one that a side does not give back."""
        full = [" " + t if t else "" for t in texts]
        a = [self.ranked.encode_ordinary(t) if self.ranked and not self.LONG_GAP.search(t) else self.a.encode(t, add_special_tokens=False).ids for t in full]
        b = self.b.encode(texts, num_threads=1)
        for i, text in enumerate(full):
            raw = text.encode("utf-8")
            if b"".join(map(self.bytes_a.__getitem__, a[i])) != raw or b"".join(map(self.bytes_b.__getitem__, b[i])) != raw:
                a[i], b[i] = [], []
        return a, b


#: Tokenizers of this Python worker by the checksums of their files: workers serve many tasks.
_known: dict[tuple[int, int], Tokenizers] = {}


def tokenizers_of(files: tuple[bytes, bytes, bool]) -> Tokenizers:
    key = (zlib.crc32(files[0]), zlib.crc32(files[1]))
    if key not in _known:
        _known.clear()
        _known[key] = Tokenizers(*files)
    return _known[key]


def ends_before(ends: np.ndarray, size: int) -> np.ndarray:
    """For each byte of ``size`` bytes, how many of ``ends`` lie at or before it: the number of the token that holds it."""
    marks = np.zeros(size + 1, np.int32)
    marks[ends] = 1
    return np.cumsum(marks, dtype=np.int32)[:size]


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The A token that ends each A and each B token's group, by pointer jumping. Both ends rise to the same last byte."""
    n, size = len(ends_a), int(ends_a[-1]) if len(ends_a) else 0
    right_of_a = ends_before(ends_b, size)[ends_a - 1]  # the B token that holds the A token's last byte
    right_of_b = ends_before(ends_a, size)[ends_b - 1]
    pointer = np.concatenate([np.where(ends_b[right_of_a] > ends_a, n + right_of_a, np.arange(n)) if n else right_of_a, right_of_b])
    while True:
        farther = pointer[pointer]
        if np.array_equal(farther, pointer):
            return pointer[:n], pointer[n:]
        pointer = farther


class Aligned:
    """Links and groups of the documents of one block, laid end to end: a document's last byte ends a token on both sides."""

    def __init__(self, n_a: bytes, a: bytes, n_b: bytes, b: bytes, known: Tokenizers):
        self.known = known
        self.n_a, self.n_b = unpack_array(n_a, np.uint32).astype(np.int64), unpack_array(n_b, np.uint32).astype(np.int64)
        self.a, self.b = unpack_array(a, known.kind_a).astype(np.int64), unpack_array(b, known.kind_b).astype(np.int64)
        self.ends_a, self.ends_b = np.cumsum(known.lengths_a[self.a]), np.cumsum(known.lengths_b[self.b])
        size = int(self.ends_a[-1]) if len(self.a) else 0
        last = np.zeros(size, bool)
        last[self.ends_a - 1] = last[self.ends_b - 1] = True
        stretch = np.flatnonzero(last)  # the last byte of each stretch between edges
        at_a, at_b = ends_before(self.ends_a, size)[stretch], ends_before(self.ends_b, size)[stretch]
        self.pair = self.a[at_a] * known.size_b + self.b[at_b]
        self.doc = np.repeat(np.arange(len(self.n_a)), self.n_a)[at_a]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct id pairs and the number of documents that hold each."""
        docs = max(1, len(self.n_a))
        each = np.sort(self.pair * docs + self.doc)
        pairs = each[np.flatnonzero(np.diff(each, prepend=-1))] // docs
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        return pairs[first], np.diff(first, append=len(pairs))

    def groups(self) -> tuple[np.ndarray, list[str]]:
        """Number of groups and their ids in text form, for each document."""
        known = self.known
        end_a, end_b = terminals(self.ends_a, self.ends_b)
        last_a = end_a == np.arange(len(end_a))
        group_a = np.cumsum(last_a) - last_a
        group_b = group_a[end_b]
        last_b = np.diff(group_b, append=-1) != 0
        # A group's B tokens stand behind its A tokens.
        text = np.empty(len(self.a) + len(self.b), object)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        text[np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[group_a]] = known.names_a[self.a + last_a * known.size_a]
        text[np.arange(len(self.b)) + np.cumsum(in_a)[group_b]] = known.names_b[self.b + last_b * known.size_b]
        text = text.tolist()
        cuts = [0, *np.cumsum(self.n_a + self.n_b).tolist()]
        numbers = np.concatenate([[0], np.cumsum(last_a)])[np.concatenate([[0], np.cumsum(self.n_a)])]
        return np.diff(numbers), ["".join(text[x:y]).rstrip(";") for x, y in zip(cuts, cuts[1:], strict=False)]


def _buckets(pairs: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its pairs), in bucket order."""
    if n_buckets == 1 or not len(pairs):
        yield from [(0, np.arange(len(pairs)))] if len(pairs) else []
        return
    bucket = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - n_buckets.bit_length())).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for places in np.split(order, first[1:]):
        yield int(bucket[places[0]]), places


def _pack_numbers(*columns: np.ndarray) -> bytes:
    return joined([pack_array(c.astype(np.int64)) for c in columns])


def _unpack_numbers(raw: bytes) -> list[np.ndarray]:
    return [unpack_array(x, np.int64) for x in parted(raw)]


def align(docs: DataFrame, a: bytes | None = None, b: bytes | None = None, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2,b3``) of each row.

    ``a``: a tokenizers file with a byte-level vocabulary; ``b``: a sentencepiece model that puts a space before the text.
    """
    sc = docs.sparkSession.sparkContext
    a = a or vocabulary_file("byte_bpe_50k.json")
    files = sc.broadcast((a, b or vocabulary_file("piece_bpe_32k.model"), same_as_ranks(a)))

    total = text_bytes(docs)
    n_buckets, tasks = 1 << max(0, (total // BUCKET_BYTES).bit_length()), max(tasks_for(docs.sparkSession), total // TASK_BYTES)

    def pack(texts: list[str]) -> list[bytes]:
        known, sides = tokenizers_of(files.value), ([], [])
        for at in range(0, len(texts), 200):
            for side, ids, kind in zip(sides, known.encode(texts[at:at + 200]), (known.kind_a, known.kind_b), strict=True):
                side += [np.array(i, kind) for i in ids]
        return [x for side in sides for x in (pack_array(np.array([len(i) for i in side], np.uint32)), pack_array(np.concatenate(side)))]

    def ask(payload: list[bytes]) -> Iterator[tuple[int, bytes]]:
        pairs, n = Aligned(*payload[1:], tokenizers_of(files.value)).counted()
        for bucket, places in _buckets(pairs, n_buckets):
            yield bucket, _pack_numbers(np.diff(pairs[places], prepend=0), n[places])

    def answer(questions: list[bytes]) -> tuple[list[bytes], bytes]:
        asked = [(np.cumsum(step), n) for step, n in map(_unpack_numbers, questions)]
        pairs, at = np.unique(np.concatenate([p for p, _ in asked]), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, at, np.concatenate([n for _, n in asked]))
        of_a = pairs // tokenizers_of(files.value).size_b
        first = np.flatnonzero(np.diff(of_a, prepend=-1))
        cuts = np.cumsum([len(p) for p, _ in asked])[:-1]
        return [_pack_numbers(x) for x in np.split(total[at], cuts)], _pack_numbers(of_a[first], np.maximum.reduceat(total, first))

    # Tokenizing takes most of the time: blocks are stored, so that a lost executor doesn't repeat it. So are the answers, which are read twice.
    blocks = stored(pack_blocks(docs, pack, block_bytes=block_bytes), "alignment-blocks")
    answers = stored(consult(blocks, n_buckets, 1, ask, answer), "alignment-answers")

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for note in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _unpack_numbers(note)], ["a", "n"])

    best_rows = answers.where("note is not null").select("note").mapInArrow(highest, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect()
    best = sc.broadcast({r.a: r.n for r in best_rows})  # at most one entry for each id of A

    def finish(payload: list[bytes], found: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        known, doc_ids = tokenizers_of(files.value), unpack_ids(payload[0])
        top = np.zeros(known.size_a, np.int64)
        top[list(best.value)] = list(best.value.values())
        block = Aligned(*payload[1:], known)
        pairs, at_pair = np.unique(block.pair, return_inverse=True)
        count = np.zeros(len(pairs), np.int64)
        for bucket, places in _buckets(pairs, n_buckets):
            count[places] = _unpack_numbers(found[bucket])[0]
        counts = count[at_pair]
        is_best = counts == top[block.pair // known.size_b]
        edges = np.searchsorted(block.doc, np.arange(len(block.n_a) + 1))
        sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[edges]) for x in (is_best, counts)]
        n_groups, texts = block.groups()
        numbers = [block.n_a, block.n_b, n_groups, np.diff(edges), *sums]
        for at in range(0, len(texts), 200):
            to = at + 200
            yield pa.RecordBatch.from_arrays([doc_ids[at:to], *(pa.array(c[at:to], pa.int64()) for c in numbers), pa.array(texts[at:to], pa.string())],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return finished(blocks, answers, tasks, finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
