import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import embedding_dedup as ed


def brute(rows, threshold=0.9):
    units = []
    for _, v in rows:
        a = np.array(v, float) if v and None not in v else np.zeros(1)
        a = a / max(abs(a).max(), 1e-300) if len(a) and np.isfinite(a).all() else a
        n = np.linalg.norm(a) if np.isfinite(a).all() else 0
        units.append(a / n if n else None)
    n = len(rows)
    link = [[i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold
             for j in range(n)] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i]] + [comp[j] for j in range(n) if link[i][j]]) for i in range(n)]
        if new == comp:
            break
        comp = new
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((vec_id, int(sum(link[i])), first, vec_id == first))
    return sorted(out, key=repr)


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            rows.append(base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.35]))
    rows = [(i, list(map(float, v))) for i, v in enumerate(rows)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 2.0]), (906, [2.0, 4.0]),
             (907, rows[0][1]), (907, rows[0][1]), (907, [-x for x in rows[0][1]]), (None, rows[1][1]), (908, [x * 1e-200 for x in rows[2][1]]),
             (909, [float("inf")] + [0.0] * 15)]
    return rows


@pytest.mark.parametrize("kind", ["double", "float"])
def test_equals_brute_force(spark, kind):
    rows = vectors()
    if kind == "float":
        rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("label", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)
    assert sorted(map(tuple, ed.near_duplicates(df).collect()), key=repr) == brute(rows)


def test_short_windows_and_large_components_count_all_links(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    rows = [(i, list(map(float, base + 0.25 * rng.standard_normal(8)))) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ed.near_duplicates(df, window=8, block=32, chunk=16, passes=24)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert ed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_isolated_pairs_in_a_table_far_larger_than_the_window(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(6000):
        a, b = rng.standard_normal((2, 48))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        cos = rng.uniform(0.9001, 0.905)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (cos * a + np.sqrt(1 - cos * cos) * b / np.linalg.norm(b)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ed.near_duplicates(df, window=4, block=256).collect()
    assert sum(r.component_id == r.vec_id - 1 for r in got if r.vec_id % 2) >= 0.997 * 6000
