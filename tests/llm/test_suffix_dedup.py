import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import suffix_dedup, suffix_sort


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            key = raw[i:i + length]
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc_id, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, length=48):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    shared = [text(n) for n in (length - 1, length, length + 1, 90, 200)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 120)) for _ in range(rng.randrange(4))]
        for s in rng.sample(shared, rng.randrange(3)):
            cut = s[rng.randrange(3):] if rng.random() < 0.4 else s
            parts.insert(rng.randrange(len(parts) + 1), cut)
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "ab" * 200), (103, "z" * 100), (104, "zzz"), (5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1])]
    near = text(300)
    for k in range(40):
        at = rng.randrange(300)
        rows.append((200 + k, near[:at] + "#" + near[at + 1:]))
    return rows


@pytest.mark.parametrize(("seed", "hot", "piece"), [(1, 1000, 1 << 21), (2, 2, 1 << 21), (3, 1000, 150)])
def test_equals_brute_force(docs_of, monkeypatch, seed, hot, piece):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = corpus(seed)
    docs = docs_of(rows, block=F.lit("x"), lengths=F.lit(1), data=F.lit(2))
    got = suffix_dedup.remove_repeats(docs, length=48, core=32, hot=hot).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute(rows, 48)
    by_id = {d: (t or "").encode() for d, t in rows if d is not None}
    for r in got:
        if r.doc_id is not None:
            raw, at, kept = by_id[r.doc_id], 0, b""
            for s in r.spans:
                kept, at = kept + raw[at:s.start], s.end
            assert kept + raw[at:] == bytes(r.kept)


def test_sorting_finds_equal_suffixes_in_order():
    rng = random.Random(7)
    for alphabet in (b"ab", b"abcdefgh"):
        for _ in range(20):
            data = bytes(rng.choice(alphabet) for _ in range(150))
            data += data[20:90] + data[30:110]
            starts = np.arange(len(data) - 40 + 1)
            want = {}
            for i in starts.tolist():
                want.setdefault(data[i:i + 40], []).append(i)
            assert sorted(sorted(g.tolist()) for g in suffix_sort.equal_groups(data, starts, 40)) == sorted(v for v in want.values() if len(v) > 1)
            trie = suffix_sort.BlindTrie([data[i:i + 40] for i in starts.tolist()])
            for k in range(len(starts)):
                trie.add(k)
            assert [trie.texts[leaf[0]] for leaf in trie.ordered()] == sorted(want)


def test_empty_table(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([]).limit(0)).count() == 0
