"""Cross-tokenizer alignment against a byte-by-byte definition."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from trackloom.llm.token_alignment import align, terminals

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def token_bytes(libraries, text):
    """(ids, bytes) of both sides. A's offsets are of characters, so its bytes come from decoding by the vocabulary's alphabet."""
    a, b = libraries
    decode = {}
    k = 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            decode[chr(x)] = x
        else:
            decode[chr(256 + k)] = x
            k += 1
    e = a.encode(" " + text, add_special_tokens=False)
    pieces = b.encode(text, out_type=str)
    made = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
    return e.ids, [bytes(decode[c] for c in t) for t in e.tokens], b.encode(text), made


def brute(libraries, rows):
    found, pair_docs = [], Counter()
    for d, text in rows:
        a = ab = b = bb = []
        if text:
            a, ab, b, bb = token_bytes(libraries, text)
            if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
                a = ab = b = bb = []
        owner_a = [i for i, x in enumerate(ab) for _ in x]
        owner_b = [j for j, x in enumerate(bb) for _ in x]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        ends = set(np.cumsum([len(x) for x in ab]).tolist()) & set(np.cumsum([len(x) for x in bb]).tolist())
        groups, at = [([], [])], 0
        starts_a = np.concatenate([[0], np.cumsum([len(x) for x in ab])]).astype(int)[:-1].tolist()
        starts_b = np.concatenate([[0], np.cumsum([len(x) for x in bb])]).astype(int)[:-1].tolist()
        by_start = defaultdict(lambda: ([], []))
        for end in sorted(ends):
            for i, s in enumerate(starts_a):
                if at <= s < end:
                    by_start[at][0].append(str(a[i]))
            for j, s in enumerate(starts_b):
                if at <= s < end:
                    by_start[at][1].append(str(b[j]))
            at = end
        groups = [by_start[k] for k in sorted(by_start)]
        pair_docs.update({(a[i], b[j]) for i, j in links})
        found.append((d, a, b, [(a[i], b[j]) for i, j in links], groups))
    top = defaultdict(int)
    for (x, _), n in pair_docs.items():
        top[x] = max(top[x], n)
    return sorted(((d is None, d or 0), len(a), len(b), len(groups), len(links), sum(pair_docs[p] == top[p[0]] for p in links), sum(pair_docs[p] for p in links),
                   ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)) for d, a, b, links, groups in found)


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


def test_equals_definition(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 6000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows) > 100
    assert got(align(docs, block_bytes=50_000)) == brute(libraries, rows)


def test_defined_cases(spark, docs_of, libraries):
    rng = random.Random(11)
    marks = ["a", "the ", "é", "日本", "🙂", " ", "  ", "\n", "\t", "1", "٣", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", "-", "é", "ﬁ", " ", "\x00"]
    rows = [(i, "".join(rng.choices(marks, k=rng.randint(1, 20)))) for i in range(150)]
    rows += [(None, "no id"), (500, None), (501, ""), (502, "the same"), (502, "the same"), (503, " "), (504, "plain <|endoftext|> text"), (505, "gap" + " " * 20_000 + "gap")]
    docs = docs_of(rows, groups=F.lit("x"), block=F.lit(1), a=F.lit(2), n_a=F.lit(3))
    found = got(align(docs, block_bytes=300))
    assert found == brute(libraries, rows)
    assert [x[1:] for x in found if x[0] in ((False, 500), (False, 501))] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert any(x[1] for x in found if x[0] == (False, 504))


def test_long_text(spark, docs_of, libraries):
    docs = docs_of([(1, "longer than any block " * 60_000), (2, "short")])
    long, short = got(align(docs))
    assert long[1] == long[3] + long[4] - long[2] and long[4] > 200_000 and short[3] >= 1


def test_empty_table(spark, docs_of):
    assert align(docs_of([])).collect() == []


def test_ranks_give_the_same_ids_only_if_the_file_allows():
    import json

    from trackloom.llm.token_alignment import same_as_ranks, vocabulary_file
    file = vocabulary_file("byte_bpe_50k.json")
    assert same_as_ranks(file)
    spec = json.loads(file)
    spec["model"]["merges"][40], spec["model"]["merges"][41] = spec["model"]["merges"][41], spec["model"]["merges"][40]
    assert not same_as_ranks(json.dumps(spec).encode())
    spec = json.loads(file)
    spec["model"]["merges"][2] = ["x", "y"]
    spec["model"]["vocab"]["xy"] = spec["model"]["vocab"].pop("he")
    assert not same_as_ranks(json.dumps(spec).encode())
    assert not same_as_ranks(vocabulary_file("word_bpe_49k.json"))


def test_pointers_cross_chains_of_any_length():
    n = 5000  # the sides' edges meet only at the very end
    ends_a = np.append(np.arange(2, 2 * n + 1, 2), 2 * n + 1)
    ends_b = np.append(np.arange(1, 2 * n, 2), 2 * n + 1)
    a, b = terminals(ends_a, ends_b)
    assert set(a) == set(b) == {len(ends_a) - 1}
    a, b = terminals(np.array([1, 3, 6]), np.array([1, 2, 6]))
    assert a.tolist() == [0, 2, 2] and b.tolist() == [0, 2, 2]
