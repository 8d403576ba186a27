import random
import re

import pytest
from pyspark.sql import functions as F

from trackloom.llm import mixing

from .conftest import words


def filled(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Deal by weight, cut at the caps, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        weight = sum(w[s] for s in order if s not in full)
        now = {s for s in order if s not in full and rest * w[s] / weight > cap * sizes[s]} if weight else set()
        if not now:
            return {s: cap * sizes[s] if s in full else rest * w[s] / weight for s in order}
        full |= now


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.choice([1, 3, 20, 20, 100, 700]))), rng.choice(["a", "a", "a", "b", "c", "d", None, "é"])) for i in range(n)]
    return rows + [(900, None, "a"), (901, "", "b"), (902, " \t\n", "z"), (None, "x y", "c"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_bounds_and_totals(docs_of, seed):
    rows = corpus(seed)
    docs = docs_of(rows, salt=F.lit(1), size=F.lit(2), target=F.lit("t"))
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 10)


def test_rates_are_exponentially_tilted(spark):
    """Without rounding, the rates of a source are min(2, exp(lambda x)) and meet the target."""
    rng = random.Random(3)
    rows = [("a", size, rng.randrange(1, 50)) for size in range(1, 60)] + [("b", size, 3) for size in range(5, 20)]
    hist = spark.createDataFrame(rows, "source string, size long, n long")
    sizes = {s: sum(z * n for t, z, n in rows if t == s) for s in "ab"}
    for ratio in (0.2, 1.0, 1.7):
        targets = spark.createDataFrame([(s, sizes[s], ratio * sizes[s]) for s in "ab"], "source string, source_size long, target double")
        for r in mixing.balance(hist, targets, tolerance=1e-9).collect():
            import math
            got = sum(n * z * min(2.0, math.exp(r.lam * z / r["mean"])) for t, z, n in rows if t == r.source)
            assert abs(got - r.target) <= 0.5 + 1e-4 * r.target


def test_rows_are_repeated_whole(docs_of):
    rows = corpus(4, 80)
    docs = docs_of(rows, copies=F.lit("own"), row=F.lit(1))
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    want = {}
    for r in mixing.mix(docs).where("copies > 0").collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_empty_and_wordless_tables(docs_of):
    assert mixing.mix(docs_of([]).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs_of([(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_no_python_on_the_path(docs_of):
    plan = mixing.mix(docs_of(corpus(5, 20)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
