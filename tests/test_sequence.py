"""Sequence primitives with tiny blocks and one sequence that holds most rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import sequence as Q
from trackloom.operators.quantiles import group_quantiles


def skewed(spark, n=900):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        seq = "hot" if i % 3 else f"s{i % 30}"
        rows.append((seq, rng.randrange(0, 700), f"f{i:05d}", rng.choice([None, rng.uniform(-5, 5)])))
    return rows, spark.createDataFrame(rows, "swing_id string, frame_idx int, image_stem string, v double").repartition(7)


def by_sequence(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in out.items()}


def test_positions_equal_a_sort(spark):
    rows, df = skewed(spark)
    got = {(r.swing_id, r.image_stem): (r.pos, r.n) for r in Q.frame_positions(df).collect()}
    for seq, items in by_sequence(rows).items():
        for i, r in enumerate(items):
            assert got[(seq, r[2])] == (i, len(items))


def test_flag_positions_count_flagged_rows(spark):
    rows, df = skewed(spark)
    out = Q.frame_positions(df, flag=F.col("v").isNotNull()).collect()
    got = {(r.swing_id, r.image_stem): r.flag_pos for r in out}
    for seq, items in by_sequence(rows).items():
        seen = 0
        for r in items:
            assert got[(seq, r[2])] == seen
            seen += r[3] is not None


def test_linear_fill_spans_blocks(spark):
    rows, df = skewed(spark)
    out = Q.fill_linear(Q.frame_positions(df), ["v"], rows=4).collect()
    got = {(r.swing_id, r.image_stem): r.v for r in out}
    for seq, items in by_sequence(rows).items():
        known = [i for i, r in enumerate(items) if r[3] is not None]
        want = np.interp(range(len(items)), known, [items[i][3] for i in known]) if known else np.zeros(len(items))
        for r, w in zip(items, want):
            assert abs(got[(seq, r[2])] - w) < 1e-12


def test_states_follow_tables_over_many_blocks(spark):
    rows, df = skewed(spark)
    p = Q.frame_positions(df)
    step = F.when(F.col("pos") == 0, F.array(F.lit(2))).otherwise(
        F.array((F.col("frame_idx") % 3).cast("int"), F.lit(0), (F.col("frame_idx") % 2).cast("int")))
    p = p.withColumn("step", step).withColumn("block", F.floor(F.col("pos") / 5))
    out = Q.follow_states(p, "swing_id", "pos", "step", ["frame_idx"], block="block", levels=2, fan=3).collect()
    assert len(out) == len(rows)
    seqs = {}
    for r in out:
        seqs.setdefault(r.swing_id, []).append(r)
    for items in seqs.values():
        state = 0
        for i, r in enumerate(sorted(items, key=lambda r: r.pos)):
            table = [2] if i == 0 else [r.frame_idx % 3, 0, r.frame_idx % 2]
            assert r.before == state
            state = table[state]
            assert r.after == state


def test_quantiles_equal_numpy_on_skewed_and_repeated_values(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in np.round(rng.normal(0, 1, 2000), 2)] + [("one", 4.5), ("neg", -1e6), ("neg", 1e-9), ("neg", float("nan"))]
    rows += [("hot", 7.0)] * 1000
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p10": .1, "p50": .5, "p90": .9}
    for few in (False, True):
        got = {r.k: r for r in group_quantiles(df, ["k"], {"v": F.col("v")}, probs, few_groups=few).collect()}
        for k in ("hot", "one", "neg"):
            x = [v for kk, v in rows if kk == k and v == v]
            for name, p in probs.items():
                want = np.percentile(x, p * 100)
                assert abs(got[k][f"v_{name}"] - want) <= 1e-9 * max(1, abs(want))


def test_sequences_shorter_than_a_window_give_none(spark):
    from trackloom.operators.windows import window_starts
    cases = [(3, 5, 2, False, []), (31, 31, 5, True, [0]), (63, 31, 5, True, [32, 27, 22, 17, 12, 7, 2, 0])]
    for n, size, stride, first, want in cases:
        df = spark.range(n).select(F.explode(window_starts(F.col("id"), F.lit(n).cast("bigint"), size, stride, first)).alias("s"))
        assert sorted({r.s for r in df.collect()}, reverse=True) == want
        if want:
            assert df.groupBy("s").count().filter(F.col("count") != size).count() == 0
