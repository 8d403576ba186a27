import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from trackloom.llm import simhash
from trackloom.llm.components import components

from .conftest import words


def brute(rows, size=4, radius=4, by_group=False):
    prints = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
        w = [x for part in w for x in part.split()]
        shingles = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        first.setdefault(find(i), []).append(doc_id)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in first.items()}
    if by_group:
        return list(smallest.values())
    return sorted(((d, f"{p:016x}", smallest[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = words(rng, rng.choice([2, 5, 60, 200]))
        rows.append((i, " ".join(w)))
        for k in range(rng.choice([0, 0, 1, 6])):
            v = list(w)
            v[rng.randrange(len(v))] = f"edit{k}"
            rows.append((1000 + len(rows), " ".join(v).upper() if k % 2 else " ".join(v)))
    return rows + [(None, rows[0][1]), (5000, None), (5001, ""), (5002, "  "), (3, rows[3][1]), (3, rows[3][1]), (None, "alone here now then")]


def test_equals_brute_force(docs_of):
    rows = corpus()
    got = simhash.near_duplicates(docs_of(rows, fp=F.lit(1), node=F.lit("x"), component_id=F.lit(2)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_hot_shards_lose_nothing(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) & (1 << 64) - 1 for _ in range(300)}
    values |= {rng.getrandbits(64) for _ in range(100)}
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    plain = {tuple(r) for r in components(simhash.links(nodes, radius=4)).collect()}
    for levels in (1, 2):
        assert {tuple(r) for r in components(simhash.links(nodes, radius=4, hot=20, levels=levels)).collect()} == plain


def test_tree_follows_only_needed_edges():
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(200)]
    values += [v ^ 7 for v in values[:50]]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:60]:
        assert sorted(tree.near(v, 4)) == sorted(w for w in values if (v ^ w).bit_count() <= 4)


def test_one_row_of_each_group_stays(docs_of):
    rows = corpus(4, 25)
    docs = docs_of(rows, fp=F.lit("own"), row=F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(brute(rows, by_group=True), key=repr)


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([]).limit(0)).count() == 0
    assert simhash.keep_one(docs_of([]).limit(0)).count() == 0


def test_links_are_searched_and_contracted_in_separate_stages(spark, monkeypatch):
    # Two Python nodes in one task start two workers a core, and Spark keeps them all, with what they hold, for later stages.
    plans = []
    contract = simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: (plans.append(edges._jdf.queryExecution().executedPlan().toString()), contract(edges))[1])
    nodes = spark.createDataFrame([(5,), (7,), (-1,)], "fp long")
    got = {r.fp: r.c for r in simhash._groups(nodes, 4).collect()}
    assert got == {5: 5, 7: 5, -1: -1}
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
