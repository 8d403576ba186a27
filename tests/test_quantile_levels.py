"""Quantiles of one crowded bucket, of groups that overlap, and their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import metrics as M
from trackloom.operators.quantiles import bucket_of, group_quantiles

PROBS = {"p10": .1, "p50": .5, "p90": .9, "p99": .99}


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("shape", ["even", "crowded", "equal", "negative"])
def test_one_bucket_of_many_values(spark, shape, levels):
    rng = np.random.default_rng(2)
    v = 1000.1 + rng.random(20_000) * 0.3
    if shape == "crowded":
        v[1:] = 1000.1 + rng.random(19_999) * 1e-9
    if shape == "equal":
        v[:] = 1000.25
    if shape == "negative":
        v = -v
    df = spark.createDataFrame([(float(x),) for x in v], "v double").withColumn("k", F.lit("one"))
    assert df.select(bucket_of(F.col("v"))).distinct().count() == 1
    got = group_quantiles(df, ["k"], {"v": F.col("v")}, PROBS, bucket_rows=50, levels=levels).first()
    for name, p in PROBS.items():
        assert got[f"v_{name}"] == pytest.approx(np.percentile(v, p * 100), rel=1e-12)


def test_no_task_orders_a_crowded_bucket(spark):
    """A million different values in one bucket: the last ordering sees parts of it only."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.lit(5000.0) + F.rand(3)).alias("v"))
        assert df.select(bucket_of(F.col("v"))).distinct().count() == 1
        out = group_quantiles(df, ["k"], {"v": F.col("v")}, {"p50": .5}, bucket_rows=1000)
        got = out.first().v_p50
        assert got == pytest.approx(df.agg(F.percentile("v", F.lit(.5))).first()[0], rel=1e-12)
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "__part0" in text
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_overlapping_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(["all", "odd"] if i % 2 else ["all"], float(x)) for i, x in enumerate(rng.normal(0, 5, 3000))] + [(["all", "odd", "rare"], 1e9), ([], 5.0)]
    df = spark.createDataFrame(rows, "groups array<string>, v double")
    got = {r.grp: r for r in group_quantiles(df, [], {"v": F.col("v")}, PROBS, member="groups").collect()}
    assert got.keys() == {"all", "odd", "rare"}
    for g in got:
        x = [v for s, v in rows if g in s]
        for name, p in PROBS.items():
            assert got[g][f"v_{name}"] == pytest.approx(np.percentile(x, p * 100), rel=1e-12)
    sums = {r.grp: (r.n, r.s) for r in M.member_sums(df, [], {"n": F.lit(1), "s": F.col("v")}).collect()}
    assert {g: n for g, (n, _) in sums.items()} == {"all": 3001, "odd": 1501, "rare": 1}
    assert sums["odd"][1] == pytest.approx(sum(v for s, v in rows if "odd" in s))
