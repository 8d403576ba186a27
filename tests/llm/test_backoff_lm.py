import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import backoff_lm, packing

from .conftest import words


def brute(rows, train, order, least=2, alpha=0.4):
    split = lambda t: (t or "").encode().lower().split()
    counts = [Counter() for _ in range(order + 1)]
    for _, text in train:
        w = split(text)
        for k in range(1, order + 1):
            counts[k].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    total = sum(counts[1].values())
    out = []
    for doc_id, text in rows:
        w, s = split(text), 0.0
        for i in range(len(w)):
            full = min(order, i + 1)
            for k in range(full, 0, -1):
                gram = tuple(w[i - k + 1:i + 1])
                if k == 1:
                    s += math.log10(max(counts[1][gram], 1)) - math.log10(max(total, 1)) + (full - 1) * math.log10(alpha)
                elif counts[k][gram] >= least:
                    s += math.log10(counts[k][gram]) - math.log10(counts[k - 1][gram[:-1]]) + (full - k) * math.log10(alpha)
                    break
        out.append((doc_id, len(w), round(s, 6)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 80), 30))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, "  "), (5, rows[5][1]), (None, rows[6][1].upper()), (63, "of " * 500)]


def test_equals_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 500)
    rows = corpus(1)
    for order in (1, 2, 3, 4):
        got = backoff_lm.score(docs_of(rows, counts=F.lit(1), block=F.lit("b")), order=order).collect()
        assert sorted(((r.doc_id, r.n_words, round(r.log10_score, 6)) for r in got), key=repr) == brute(rows, rows, order)
        assert all((r.mean_log10 is None) == (r.n_words == 0) for r in got)


def test_other_training_corpus(docs_of):
    rows, train = corpus(2), corpus(3)[:40]
    got = backoff_lm.score(docs_of(rows), docs_of(train)).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log10_score, 6)) for r in got), key=repr) == brute(rows, train, 3)


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        a = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (packing.sorted_numbers(packing.sorted_bytes(a), n) == a).all()
        b = rng.integers(0, 1000, n).astype(np.uint32)
        assert (packing.inflated(packing.deflated(b), np.uint32) == b).all()


def test_empty_table(docs_of):
    assert backoff_lm.score(docs_of([]).limit(0)).count() == 0
