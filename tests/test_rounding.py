"""Rounding of feature tables in double arithmetic gives the doubles that ``round`` gives."""

import random

from trackloom.workload.registry import rounded, rounded_small


def test_small_numbers_round_as_decimals_do(spark):
    rng = random.Random(5)
    values = [rng.uniform(-2, 2) for _ in range(20_000)] + [rng.uniform(-2e3, 2e3) for _ in range(20_000)]
    values += [rng.randrange(-4000, 4000) / 1920 for _ in range(5_000)] + [k / 16 for k in range(-64, 64)]
    values += [0.0, -0.0, 1.0, -1.0, -2e-7, 5e-7, -5e-7, 1e-300, None, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(4)
    plain, fast = ({r.id: repr(r.v) for r in f(df).collect()} for f in (rounded, rounded_small))
    assert plain == fast and len(fast) == len(values)


def test_feature_tables_are_not_rounded_by_text(spark):
    df = spark.createDataFrame([(1, 0.25)], "id long, v double")
    plan = rounded_small(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rint(" in plan and "round(" not in plan
