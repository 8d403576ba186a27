"""Draws from a weighted pool against a plain table look-up, and the samplers of the dataset build."""

import bisect
import hashlib
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackloom.operators import augment as A

POOL = "pool_id long, idx int, pool_size long, w double"


def pool(spark, weights):
    rows = [(p, i, len(weights), w if i == 0 else None) for p, w in enumerate(weights) for i in range(3)]
    return spark.createDataFrame(rows, POOL)


def windows(spark, n):
    return spark.range(n).select(F.concat(F.lit("s"), F.col("id") % 50).alias("swing_id"), F.lit("v").alias("view_id"), F.col("id").cast("int").alias("win_start"))


def plain(weights, key):
    units = [round(max(w or 0, 0) * A.WEIGHT_UNIT) for w in weights]
    upto = [sum(units[:i + 1]) for i in range(len(units))]
    u = int(hashlib.md5(f"7|pool|{key}".encode()).hexdigest()[:13], 16) / 2 ** 52
    return bisect.bisect_right(upto, int(u * upto[-1]))


@pytest.mark.parametrize("weights", [[1.0, 0.0, 2.5, None, 0.000001, 3.0], [5.0], [1e-6] * 30 + [1000.0], [float(i % 7) for i in range(9000)]])
def test_draws_equal_a_table(spark, weights):
    got = A.draw_weighted(windows(spark, 400), pool(spark, weights), F.col("w")).collect()
    assert len(got) == 400
    for r in got:
        assert r.pool_id == plain(weights, f"{r.swing_id}|{r.view_id}|{r.win_start}")


def test_shares_follow_the_weights(spark):
    weights = [1.0, 0.0, 7.0, -3.0, 2.0]
    n = Counter(r.pool_id for r in A.draw_weighted(windows(spark, 20_000), pool(spark, weights), F.col("w")).collect())
    assert set(n) == {0, 2, 4}
    assert n[2] / 20_000 == pytest.approx(0.7, abs=0.02) and n[4] / 20_000 == pytest.approx(0.2, abs=0.02)


def test_a_heavy_window_is_dealt_out(spark):
    """One pool window takes nearly all draws: they meet it in as many bins as the pool has windows."""
    weights = [0.001] * 99 + [100.0]
    ranges = A.weighted_ranges(pool(spark, weights), F.col("w")).collect()
    heavy = max(ranges, key=lambda r: r.hi - r.lo)
    size = -(-max(r.hi for r in ranges) // len(ranges))
    assert (heavy.hi - 1) // size - heavy.lo // size >= 98


def test_a_pool_without_weight_fails(spark):
    with pytest.raises(PySparkException, match="no pool window has a weight"):
        A.draw_weighted(windows(spark, 3), pool(spark, [0.0, None]), F.col("w")).collect()


def test_replay_takes_the_drawn_rows(spark):
    err = ["seen", "x", "y", "conf"]
    p = pool(spark, [1.0, 4.0, 0.0]).withColumns({f"{k}_err_{e}": (F.col("idx") != 1) if e == "seen" else F.col("pool_id") / 10 + F.col("idx") / 100 for k in ("head", "tail") for e in err})
    wins = windows(spark, 200).withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({f"{k}_{a}": F.lit(0.25) for k in ("head", "tail") for a in "xy"})
    out = A.replay_corrupt(wins, p, weight=F.col("w")).collect()
    assert len(out) == 600
    for r in out:
        drawn = plain([1.0, 4.0, 0.0], f"{r.swing_id}|{r.view_id}|{r.win_start}")
        assert r.obs_head_seen == (r.idx != 1)
        assert r.obs_tail_x == (None if r.idx == 1 else pytest.approx(0.25 + drawn / 10 + r.idx / 100))
    assert A.replay_corrupt(wins, p).count() == 600
