"""The screen's limits and text do not depend on the last bit of a double."""

from trackloom.operators.selection import screen_outliers
from trackloom.workload.catalog import ORACLE


def _screen(spark, lengths, far, **kw):
    rows = [("s", i, str(i), (length, far if i == 5 else 0.0, 0.0)) for i, length in enumerate(lengths)]
    df = spark.createDataFrame(rows, "swing_id string, pos long, image_stem string, chosen struct<length:double,cx:double,cy:double>")
    return {r.pos: r for r in screen_outliers(df, **kw).collect()}


def test_limits_and_text_are_of_rounded_numbers(spark):
    lengths = [100.0] * 5 + [34.99999999999999] + [100.0] * 5
    assert _screen(spark, lengths, 0.0)[5].length_outlier
    row = _screen(spark, lengths, 300.00000000000006, digits=9)[5]
    assert (row.length_outlier, row.center_outlier, row.outlier_reason, row.length_ratio) == (False, False, "", 0.35)
    row = _screen(spark, [100.0] * 11, 594.7499999999999, digits=9)[5]
    assert row.outlier_reason == "center_outlier:center_dist=594.8,center_threshold=300.0"


def test_sql_states_the_same_rule():
    for name in ("local_outlier_screen", "drop_propagation", "round_text_reason"):
        assert "round(greatest(300e0, 2.5e0 * spread), 9) as center_threshold" in ORACLE[name]
    assert "round(greatest" not in ORACLE["evaluation_status"]
