import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm import token_records as tr

TEXTS = ["Hello, it's  a test!! (yes). don't 123,456 x", "a<|ENDOFTEXT|>b<|endoftext|>c", None, "", "  \t\n", "é́ ́x İstanbul ΣΑΣ. 한글 ab's. n't 3's x y\x1cz",
         "..,a,..b.. 's.,'s", "long " * 30_000]


def expected(rows):
    tokenizer = Tokenizer.from_str(tr.vocabulary_text())
    start, out = 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_checksum_is_crc32c():
    assert tr.crc32c([b"123456789", b""]) == [0xE3069283, 0]
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 257, 1000]:
        data = rng.bytes(n)
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = (crc >> 1) ^ (tr.CASTAGNOLI if crc & 1 else 0)
        assert tr.crc32c([data]) == [crc ^ 0xFFFFFFFF]


def test_damage_is_found():
    record = tr.framed([b"some data"])[0]
    assert tr.unframed([record]) == [b"some data"]
    for at in (0, 9, 14, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tr.unframed([bytes(bad)])


def test_round_trip_equals_whole_text_encoding(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = tr.token_digest(spark, docs_of(rows, ids=F.lit("clash"), start=F.lit(1))).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_null_and_equal_ids_and_small_cache(spark, docs_of):
    rows = [(None, "b c"), (None, "b c"), (7, "x"), (7, "y z"), (7, "y z")]
    manifest = tr.write_records(docs_of(rows), vocabulary=tr.vocabulary_text(), end_id=2, roll_bytes=20)
    got = tr.read_records(manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 7, 7, 7]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in got)
    small = tr.Encoder(tr.vocabulary_text(), 2, cache_words=2)
    assert small.encode(TEXTS[:1]) == tr.Encoder(tr.vocabulary_text(), 2).encode(TEXTS[:1])


def test_index_gives_each_record_alone(spark, docs_of):
    row = tr.write_records(docs_of([(1, "one two"), (2, "three")]), vocabulary=tr.vocabulary_text(), end_id=2).collect()
    for r in row:
        store, path = tr.open_store(f"{r.file}.records")
        with store.open_input_file(path) as f:
            for doc_id, offset, size, n in reversed(tr.read_index(r.file).tolist()):
                data = tr.unframed([f.read_at(size, offset)])[0]
                assert int.from_bytes(data[:8], "little", signed=True) == doc_id and (len(data) - 8) // r.id_bytes == n


def test_empty_table(spark, docs_of):
    assert tr.token_digest(spark, docs_of([]).limit(0)).count() == 0
