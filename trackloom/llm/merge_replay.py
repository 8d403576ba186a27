"""Byte-level BPE by replaying the merges over the distinct words of the corpus.

Each text is split by the vocabulary's pattern once. A block of texts keeps its distinct words and the texts as word numbers.
Words that are no tokens themselves go, once for each block, to hash buckets of the corpus. A bucket lays its distinct words end to end as
bytes and builds an inverted index from the rank of a token pair to the positions where the pair stands. Ranks are
replayed in ascending order; each merge touches only its two neighbours, whose new pairs join the index. The ids go back to the blocks that
asked, which then write each text's ids by looking up its word numbers.

The result is that of merging each word's lowest-ranked, leftmost pair first: words do not depend on each other, a rank's positions are
replayed from left to right, and where a merge makes a pair of lower rank than the current one, that pair is merged at
once, before the word's next pair. A word that is itself a token has that one id.

Defined cases. Null or empty text: no ids, decoded to nothing. Null doc_id: kept. Repeated rows: one result each. Empty
table: no rows. Special tokens are plain text. Only doc_id and text are read, so other columns may have any names. A text of
any length is split as a whole. A byte missing in the vocabulary is an error.

Scale. A task holds one block (``block_bytes`` of text, or one longer text) or one bucket, the words asked for by
``BUCKET_BYTES`` of text; a word that every block asks for adds one entry a block to its bucket, but frequent words are mostly tokens
themselves, which are never asked for. Beyond ``MOST_BUCKETS`` * ``BUCKET_BYTES``, some 8 GB of text, the corpus is cut into regions of that size and
a word is replayed once in each region that holds it, so neither buckets nor questions of a block grow further.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.blocks import bucket_count, consult, finished, pack_array, pack_blocks, pack_strings, text_bytes, unpack_array, unpack_ids, unpack_strings
from trackloom.llm.common import sliced, tasks_for

BLOCK_BYTES = 4_000_000
#: Bytes of text for each bucket of words, and for each task that writes ids.
BUCKET_BYTES, TASK_BYTES = 8_000_000, 32_000_000


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


class Vocabulary:
    """Tokens by rank, and the rank that each mergeable pair of tokens has together."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, self.size)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        size, pair_rank, ranks = self.size, self.pairs.get, self.ranks
        single = [ranks.get(bytes([b]), -1) for b in range(256)]
        # One list of symbols for all words; -1 stands for a place that a merge has emptied, or the end of a word.
        at: list[int] = []
        for word in words:
            at.extend(map(single.__getitem__, word))
            at.append(-1)
        if len(at) - at.count(-1) != sum(map(len, words)):
            raise ValueError("a byte of the text is not in the vocabulary")
        after = list(range(1, len(at) + 1))
        before = list(range(-1, len(at) - 1))
        index: dict[int, list[int]] = defaultdict(list)
        for p in range(len(at) - 1):
            if at[p] >= 0 and at[p + 1] >= 0 and (rank := pair_rank(at[p] * size + at[p + 1])) is not None:
                index[rank].append(p)

        def merge(p: int, rank: int) -> list[tuple[int, int]]:
            """Merge the pair at ``p``; returns the new pairs (rank, place) of its two neighbours."""
            q, found = after[p], []
            at[p], at[q] = rank, -1
            behind = after[p] = after[q]
            before[behind] = p
            if at[behind] >= 0 and (new := pair_rank(rank * size + at[behind])) is not None:
                found.append((new, p))
            o = before[p]
            if o >= 0 and at[o] >= 0 and (new := pair_rank(at[o] * size + rank)) is not None:
                found.append((new, o))
            return found

        def stands(p: int, rank: int) -> bool:
            return at[p] >= 0 and at[after[p]] >= 0 and pair_rank(at[p] * size + at[after[p]]) == rank

        for rank in range(size):
            for p in sorted(index.pop(rank, ())):
                if not stands(p, rank):
                    continue
                found = merge(p, rank)
                while found:
                    new, o = low = min(found)
                    found.remove(low)
                    if new > rank:
                        index[new].append(o)
                    elif stands(o, new):
                        found += merge(o, new)

        symbols = np.array(at, np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        symbols[ends] = size
        left = symbols[symbols >= 0]
        cuts = np.flatnonzero(left == size).tolist()
        ids = left.astype(self.kind)
        return [ids[a:b].tobytes() for a, b in zip([0, *(c + 1 for c in cuts)], cuts, strict=False)]

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


#: Vocabularies of this Python worker by the checksum of their file: workers serve many tasks.
_known: dict[int, Vocabulary] = {}


def vocabulary_of(raw: bytes) -> Vocabulary:
    key = zlib.crc32(raw)
    if key not in _known:
        _known.clear()
        _known[key] = Vocabulary(raw)
    return _known[key]


def _ordered(words: list[bytes], known: Vocabulary, n_buckets: int) -> tuple[list[int], list[int], dict[int, list[int]]]:
    """Places of the words that are tokens, their ids, and places of the words to ask for by bucket, each in the order in which they pack best."""
    places, ids, asked = [], [], defaultdict(list)
    rank = known.ranks.get
    for place, word in enumerate(words):
        found = rank(word)
        if found is None:
            asked[zlib.crc32(word) & (n_buckets - 1)].append(place)
        else:
            places.append(place)
            ids.append(found)
    return places, ids, {bucket: sorted(asked[bucket], key=words.__getitem__) for bucket in sorted(asked)}


def encode(docs: DataFrame, ranks: bytes | None = None, *, pattern: str = public_tokenizers.PATTERN, decode: bool = False,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row; with ``decode`` also the bytes they stand for.

    ``ranks``: the text of a rank file, a few megabytes, which is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks or rank_file())
    total = text_bytes(docs)
    (n_buckets, regions), tasks = bucket_count(total, BUCKET_BYTES), max(tasks_for(docs.sparkSession), total // TASK_BYTES)

    def pack(texts: list[str]) -> list[bytes]:
        """Ids of the words that are tokens, the texts as word numbers, and one question for each bucket."""
        known, split = vocabulary_of(shared.value), regex.compile(pattern).findall
        found = [split(text) for text in texts]
        numbers = {word: k for k, word in enumerate(dict.fromkeys(word for words in found for word in words))}
        sequence = np.fromiter((numbers[word] for words in found for word in words), np.uint32)
        words = [w.encode("utf-8") for w in numbers]
        times = np.bincount(sequence, minlength=len(words))
        places, ids, asked = _ordered(words, known, n_buckets)
        frequent = np.argsort(-times[places], kind="stable").tolist()
        order = np.array([places[k] for k in frequent] + [k for part in asked.values() for k in part], np.int64)
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        questions = [x for bucket, part in asked.items() for x in (bucket.to_bytes(4, "little"), pack_strings([words[k] for k in part]))]
        return [pack_array(np.array([len(x) for x in found], np.uint32)), pack_array(place[sequence]), pack_array(np.array([ids[k] for k in frequent], known.kind)), *questions]

    def ask(payload: list[bytes]) -> Iterator[tuple[int, bytes]]:
        for bucket, question in zip(payload[4::2], payload[5::2], strict=True):
            yield int.from_bytes(bucket, "little"), question

    def answer(questions: list[bytes]) -> tuple[list[bytes], None]:
        asked = [unpack_strings(q) for q in questions]
        distinct = list(dict.fromkeys(word for words in asked for word in words))
        ids = dict(zip(distinct, vocabulary_of(shared.value).replay(distinct), strict=True))
        return [pack_strings([ids[word] for word in words]) for words in asked], None

    def finish(payload: list[bytes], answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        known, doc_ids = vocabulary_of(shared.value), unpack_ids(payload[0])
        counts, sequence = unpack_array(payload[1], np.uint32).tolist(), unpack_array(payload[2], np.uint32)
        whole = unpack_array(payload[3], known.kind)
        rest = [ids for bucket in payload[4::2] for ids in unpack_strings(answers[int.from_bytes(bucket, "little")])]
        flat = np.concatenate([whole, np.frombuffer(b"".join(rest), known.kind)])
        lengths = np.concatenate([np.ones(len(whole), np.int64), np.fromiter(map(len, rest), np.int64, len(rest)) // known.kind.itemsize])
        starts, at = np.cumsum(lengths) - lengths, 0
        for a in range(0, len(counts), 200):
            part = counts[a:a + 200]
            words = sequence[at:at + sum(part)]
            at += len(words)
            n = lengths[words]
            ends = np.cumsum(n)
            ids = flat[np.repeat(starts[words] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(part)])].tolist()
            texts = [ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            columns = {"doc_id": doc_ids[a:a + 200], "n_tokens": pa.array(map(len, texts), pa.int64()), "ids": pa.array([i.astype("<u4").tobytes() for i in texts], pa.binary())}
            if decode:
                columns["decoded"] = pa.array(map(known.decoded, texts), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    # Both branches read one exchange: blocks are packed once, and neither stored nor shuffled again.
    blocks = pack_blocks(docs, pack, block_bytes=block_bytes).repartition(tasks, "block")
    answers = consult(blocks, n_buckets, regions, ask, answer)
    return finished(blocks, answers, tasks, finish, "doc_id long, n_tokens long, ids binary" + (", decoded binary" if decode else ""))


def decode(encoded: DataFrame, ranks: bytes | None = None) -> DataFrame:
    """doc_id and the decoded bytes of each row's ``ids`` (null: none)."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks or rank_file())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary_of(shared.value)
        for batch in sliced(batches, 200):
            texts = [known.decoded(np.frombuffer(ids or b"", "<u4")) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(work, "doc_id long, decoded binary")
