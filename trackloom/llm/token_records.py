"""Token ids as length-delimited binary records with checksums and a separate offset index.

Record: length (8 bytes), masked CRC-32C of those 8 bytes (4), data, masked CRC-32C of the data (4),
all little-endian. Data: doc_id (8 bytes, signed; the smallest value stands for null), then the ids, two bytes each if the
vocabulary has at most 65,536 entries, else four. Beside each record file lies an index file:
per record the doc_id, byte offset, byte length and number of ids, so that a loader can
shuffle records and fetch each one with a single ranged read.

Defined cases. Null or empty text: only the end id. Null doc_id: written first. Equal doc_ids: ordered by
a hash of the text, then text. Empty table: no files. Only doc_id and text are read, so other columns may have any
names. A text of any length is one record. A lost task leaves files that the manifest doesn't name.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm.common import open_store, shared_folder, sliced, stored, tasks_for

NULL_ID = -(1 << 63)
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u8"), ("n_tokens", "<u8")])
CASTAGNOLI = 0x82F63B78
MASK_ADD = 0xA282EAD8


def _crc_tables() -> np.ndarray:
    """tables[k][b]: effect of byte b followed by k zero bytes."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(CASTAGNOLI), first >> 1)
    tables = [first]
    for _ in range(3):
        tables.append((tables[-1] >> 8) ^ first[tables[-1] & 0xFF])
    return np.array(tables)


TABLES = _crc_tables()


def _advance_tables() -> list[np.ndarray]:
    """For each power k: 4 tables that carry a CRC over 4 * 2**k zero bytes."""
    step = np.array([TABLES[3], TABLES[2], TABLES[1], TABLES[0]])
    out = [step]
    for _ in range(28):
        step = np.array([_carry(out[-1], row) for row in out[-1]])
        out.append(step)
    return out


def _carry(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return step[0][crc & 0xFF] ^ step[1][(crc >> 8) & 0xFF] ^ step[2][(crc >> 16) & 0xFF] ^ step[3][crc >> 24]


ADVANCE = _advance_tables()


def crc32c(parts: list[bytes]) -> list[int]:
    """CRC-32C of each byte string.

    Strings of like length form the rows of a matrix of 32-bit words, padded in front with zeros, which leave
    a zero register unchanged; neighbouring columns are then joined pairwise, so the work is a few vector look-ups a word.
    """
    out = [0] * len(parts)
    classes: dict[int, list[int]] = {}
    for i, data in enumerate(parts):
        if len(data) < 4:
            out[i] = _short_crc(data)
        else:
            classes.setdefault((len(data) - 1).bit_length(), []).append(i)
    for bits, members in classes.items():
        width = 1 << bits
        rows = max(1, (1 << 22) // width)
        for at in range(0, len(members), rows):
            part = members[at:at + rows]
            # The register starts with ones: they are added to the first four bytes.
            packed = b"".join(parts[i].rjust(width, b"\0") for i in part)
            grid = np.frombuffer(packed, np.uint8).reshape(len(part), width).copy()
            lengths = np.array([len(parts[i]) for i in part])
            grid[np.arange(len(part))[:, None], (width - lengths)[:, None] + np.arange(4)] ^= 0xFF
            level = _carry(ADVANCE[0], grid.view("<u4"))
            k = 0
            while level.shape[1] > 1:
                level = _carry(ADVANCE[k], level[:, ::2]) ^ level[:, 1::2]
                k += 1
            for i, crc in zip(part, level[:, 0].tolist(), strict=True):
                out[i] = crc ^ 0xFFFFFFFF
    return out


def _short_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc >> 8) ^ int(TABLES[0][(crc ^ b) & 0xFF])
    return crc ^ 0xFFFFFFFF


def masked(crc: int) -> bytes:
    return ((((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF).to_bytes(4, "little")


def framed(parts: list[bytes]) -> list[bytes]:
    """One record for each byte string."""
    sizes = [len(p).to_bytes(8, "little") for p in parts]
    return [b"".join((s, masked(a), p, masked(b))) for s, a, p, b in zip(sizes, crc32c(sizes), parts, crc32c(parts), strict=True)]


def unframed(raws: list[bytes]) -> list[bytes]:
    """The data of each record; raises if a length or checksum is wrong."""
    sizes, parts = [r[:8] for r in raws], [r[12:-4] for r in raws]
    for r, s, p, a, b in zip(raws, sizes, parts, crc32c(sizes), crc32c(parts), strict=True):
        if int.from_bytes(s, "little") != len(p) or masked(a) != r[8:12]:
            raise ValueError("damaged record length")
        if masked(b) != r[-4:]:
            raise ValueError("damaged record data")
    return parts


MARKS = b".,;:!?"


class Encoder:
    """Ids of whole texts through the tokenizers library, encoding each distinct word once.

    The tokenizer drops white space and never joins text across it, nor letters or digits with the marks behind
    them, so a text's ids are those of its words, with trailing marks apart, in order. A-Z is lowered first, as the
    tokenizer does. Texts that hold a special token's opening mark, where case counts, are encoded whole.
    Words of letters only are sent to the library 64 to a line; as each yields one piece, its ids end at the first id
    whose token closes a word. ``cache_words`` bounds memory: a full cache is emptied.
    """

    def __init__(self, vocabulary: str, end_id: int, cache_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.closes = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.closes[i] = token.endswith("</w>")
        self.cache: dict[bytes, bytes] = {}
        self.cache_words = cache_words

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        lines = [letters[i:i + 64] for i in range(0, len(letters), 64)]
        for line, packed in zip(lines, self._ids([" ".join(line) for line in lines]), strict=True):
            ends = (np.flatnonzero(self.closes[np.frombuffer(packed, self.kind)]) + 1) * self.kind.itemsize
            if len(ends) != len(line) or ends[-1] != len(packed):
                rest += line
                continue
            cuts = [0, *ends.tolist()]
            self.cache.update((w.encode("utf-8"), packed[a:b]) for w, a, b in zip(line, cuts, cuts[1:], strict=False))
        self.cache.update(zip((w.encode("utf-8") for w in rest), self._ids(rest), strict=True))

    @staticmethod
    def _pieces(text: str) -> list[bytes]:
        pieces = []
        for w in text.encode("utf-8").lower().split():
            if w[-1] in MARKS and (stem := w.rstrip(MARKS)) and stem[-1:].isalnum():
                pieces += (stem, w[len(stem):])
            else:
                pieces.append(w)
        return pieces

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text, the end id included."""
        split = [None if t and "<|" in t else self._pieces(t) if t else [] for t in texts]
        words = {w for pieces in split if pieces for w in pieces}
        fresh = [w for w in words if w not in self.cache]
        if len(self.cache) + len(fresh) > self.cache_words:
            self.cache = {}
            fresh = list(words)
        for at in range(0, len(fresh), 20_000):
            self._learn([w.decode("utf-8") for w in fresh[at:at + 20_000]])
        whole = iter(self._ids([t for t, pieces in zip(texts, split, strict=True) if pieces is None]))
        return [(next(whole) if p is None else b"".join(map(self.cache.__getitem__, p))) + self.end for p in split]


#: Encoders of this Python worker by vocabulary and end id: workers serve many tasks, which share the learnt words.
_known: dict[tuple[int, int], Encoder] = {}


def encoder_of(vocabulary: str, end_id: int) -> Encoder:
    key = (zlib.crc32(vocabulary.encode("utf-8")), end_id)
    if key not in _known:
        _known.clear()
        _known[key] = Encoder(vocabulary, end_id)
    return _known[key]


def write_records(docs: DataFrame, *, vocabulary: str, end_id: int, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write ``docs`` in doc_id order; returns the manifest, one row per record file.

    Documents are range-partitioned by (doc_id, hash of text), which splits even equal ids. The vocabulary text is
    broadcast: its size is that of its file. ``first_token``: ids in all files before.
    """
    spark = docs.sparkSession
    where = shared_folder(spark, "tokens")
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = (rows.withColumn("h", F.xxhash64("text")).repartitionByRange(tasks_for(spark), *keys)
               .sortWithinPartitions(*keys, "text").select("doc_id", "text", F.spark_partition_id().alias("part")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, end_id)
        store, root = open_store(where)
        store.create_dir(root, recursive=True)
        done, out, nth = [], None, 0
        for batch in sliced(batches, 1000):
            part = batch.column(2)[0].as_py()
            names = [NULL_ID if d is None else d for d in batch.column(0).to_pylist()]
            texts = encoder.encode(batch.column(1).to_pylist())
            records = framed([d.to_bytes(8, "little", signed=True) + ids for d, ids in zip(names, texts, strict=True)])
            for doc_id, ids, record in zip(names, texts, records, strict=True):
                if out is None:
                    name, offset, index = f"part-{part:06d}-{nth:04d}-{uuid.uuid4().hex}", 0, []
                    out = store.open_output_stream(f"{root}/{name}.records", compression=None)
                out.write(record)
                index.append((doc_id, offset, len(record), len(ids) // encoder.kind.itemsize))
                offset += len(record)
                if offset >= roll_bytes:
                    _closed(store, root, name, out, index, offset, part, nth, done, encoder)
                    out, nth = None, nth + 1
        if out is not None:
            _closed(store, root, name, out, index, offset, part, nth, done, encoder)
        if done:
            yield pa.RecordBatch.from_pylist([{**d, "file": f"{where}/{d['file']}"} for d in done])

    manifest = stored(ordered.mapInArrow(
        work, "part long, nth long, file string, records long, tokens long, bytes long, id_bytes long"), "token-manifest")
    # One row per file of up to roll_bytes: the only list that is ordered as a whole.
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _closed(store, root: str, name: str, out, index: list, offset: int, part: int, nth: int, done: list, encoder: Encoder) -> None:
    out.close()
    table = np.array(index, INDEX)
    with store.open_output_stream(f"{root}/{name}.index", compression=None) as f:
        f.write(table.tobytes())
    done.append({"part": part, "nth": nth, "file": name, "records": len(index), "tokens": int(table["n_tokens"].sum()),
                 "bytes": offset, "id_bytes": encoder.kind.itemsize})


def read_index(uri: str) -> np.ndarray:
    store, path = open_store(f"{uri}.index")
    with store.open_input_stream(path, compression=None) as f:
        return np.frombuffer(f.read(), INDEX)


def read_records(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Documents of the files in the manifest: doc_id, start, n_tokens, ids_crc32 and optionally the ids."""
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = read_index(row["file"])
                store, path = open_store(f"{row['file']}.records")
                kind = "<u2" if row["id_bytes"] == 2 else "<u4"
                start = row["first_token"] + np.concatenate(([0], np.cumsum(index["n_tokens"].astype(np.int64))))
                with store.open_input_file(path) as f:
                    for at in range(0, len(index), 1000):
                        part = index[at:at + 1000]
                        base = int(part["offset"][0])
                        block = f.read_at(int(part["offset"][-1] + part["bytes"][-1]) - base, base)
                        ends = zip((part["offset"] - np.uint64(base)).tolist(), part["bytes"].tolist(), strict=True)
                        data = unframed([block[at_byte:at_byte + size] for at_byte, size in ends])
                        names = [int.from_bytes(d[:8], "little", signed=True) for d in data]
                        ids = [np.frombuffer(d, kind, offset=8).astype("<u4") for d in data]
                        cols = [pa.array([None if n == NULL_ID else n for n in names], pa.int64()), pa.array(start[at:at + len(part)], pa.int64()),
                                pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())]
                        cols += [pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))] * with_ids
                        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in fields.split(", ")])

    files = manifest.select("file", "first_token", "id_bytes")
    return files.repartition(tasks_for(manifest.sparkSession), "file").mapInArrow(work, fields)


def vocabulary_text(name: str = "word_bpe_49k.json") -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def token_digest(spark: SparkSession, docs: DataFrame, *, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    return read_records(write_records(docs, vocabulary=vocabulary or vocabulary_text(), end_id=end_id))
