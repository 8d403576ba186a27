"""Number text is formatted once per value."""

import random

from pyspark.sql import functions as F

from trackloom.functions import scalars as S


def test_number_text_is_spelled_out_once(spark):
    assert len(str(S.fixed_text(F.col("v"), 6))) < 2000
    rng = random.Random(5)
    values = [rng.uniform(-2000, 2000) for _ in range(500)] + [rng.randrange(-10 ** 7, 10 ** 7) / 2 ** rng.randrange(20) for _ in range(500)]
    values += [float(rng.randrange(2 ** 52, 2 ** 62)) for _ in range(100)] + [999999.9999995, 5e-324, -1e-7]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 3, 6):
        assert [r[0] for r in df.select(S.fixed_text(F.col("v"), digits)).collect()] == [f"{v:.{digits}f}" for v in values]
