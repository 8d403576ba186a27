"""Merge replay against the tiktoken library."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from trackloom.llm.merge_replay import Vocabulary, decode, encode, rank_file

SF = "/root/testdata/sf0.001"


def library(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in df.collect())


def want(rows, raw):
    enc, out = library(raw), []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((d is None, d or 0, len(ids), ids, (t or "").encode()))
    return sorted(out)


def rank_text(tokens):
    every = [bytes([b]) for b in range(256)] + tokens
    return b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(every))


def lowest_pair_first(word, ranks):
    """The definition itself: merge the leftmost of the lowest-ranked pairs until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_replay_equals_the_definition_for_any_ranks():
    rng = random.Random(3)
    for _ in range(60):
        tokens = list({bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 40))})
        rng.shuffle(tokens)  # also ranks in which a longer token comes before its parts
        vocabulary = Vocabulary(rank_text(tokens))
        words = [bytes(rng.choices(b"abc", k=rng.randint(1, 14))) for _ in range(150)] + [b"a" * 30, b"ab" * 20]
        ids = [np.frombuffer(x, vocabulary.kind).tolist() for x in vocabulary.replay(words)]
        assert [i if w not in vocabulary.ranks else [vocabulary.ranks[w]] for w, i in zip(words, ids, strict=True)] == [lowest_pair_first(w, vocabulary.ranks) for w in words]


def test_missing_byte():
    with pytest.raises(ValueError, match="not in the vocabulary"):
        Vocabulary(base64.b64encode(b"a") + b" 0").replay([b"b"])


def test_equals_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(encode(docs, decode=True, block_bytes=100_000)) == want(rows, rank_file())


def test_defined_cases(spark, docs_of):
    rng = random.Random(5)
    marks = ["a", "é", "日本", "🙂", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "1", "٣", "<|endoftext|>", " ", " ", "\x00", "\x1c", "ſ", "_", "-", "�", "é"]
    rows = [(i, "".join(rng.choices(marks, k=rng.randint(1, 60)))) for i in range(300)]
    rows += [(None, "no id"), (1000, None), (1001, ""), (1002, "same"), (1002, "same"), (1003, "x" * 30_000), (1004, "word and " * 60_000), (1005, " " * 5000)]
    docs = docs_of(rows, ids=F.lit("x"), block=F.lit(1), words=F.lit(2), part=F.lit(3))
    found = encode(docs, decode=True, block_bytes=20_000)
    assert got(found) == want(rows, rank_file())
    again = {(r.doc_id, bytes(r.decoded)) for r in decode(found.select("doc_id", "ids", F.lit(1).alias("decoded"))).collect()}
    assert again == {(d, (t or "").encode()) for d, t in rows}


def test_empty_table(spark, docs_of):
    assert encode(docs_of([]), decode=True).collect() == []


def test_other_ranks(spark, docs_of):
    raw = rank_file("byte_bpe_50k.tiktoken")
    rows = [(1, "Merges of another file."), (2, "naïve 12345")]
    assert got(encode(docs_of(rows), raw, decode=True)) == want(rows, raw)
