"""Candidate choice against a plain loop, and its input contract."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import selection as C
from trackloom.operators.contracts import require_record_schema
from trackloom.schemas import RECORD_TYPE, SelectionSettings

CFG = SelectionSettings(1000.0, 500.0, 100.0, 300.0, 1.0)


def det(rank, conf, hx, hy, tx, ty, hc=0.9, tc=0.9):
    return (rank, conf, ((hx + tx) / 2, (hy + ty) / 2, abs(hx - tx) + .01, abs(hy - ty) + .01), (hx, hy, hc), (tx, ty, tc))


def record(seq, no, dets, name=None):
    name = name or f"{no:06d}"
    return (f"{seq}_{name}", f"{seq}_{name}", seq, no, name, dets)


def hyp(a, b):
    return math.hypot(a[0] - b[0], a[1] - b[1])


def loop(records):
    """Straight re-statement of the choice: keep the last pick, score against it."""
    picks = {}
    for seq in {r[2] for r in records}:
        rows = sorted((r for r in records if r[2] == seq), key=lambda r: (r[3] if r[3] is not None else 10**9, r[4], r[0]))
        px = lambda p: (p[0] * CFG.width, p[1] * CFG.height)
        centers = [px(r[5][0][2]) for r in rows if r[5]]
        med = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
        anchor = (med([c[0] for c in centers]), med([c[1] for c in centers])) if centers else None
        last = None
        for r in rows:
            scored = []
            for d in r[5]:
                if d[3][2] < .1 or d[4][2] < .1:
                    continue
                h, t, b = px(d[3]), px(d[4]), px(d[2])
                score = -CFG.bbox_conf_weight * d[1]
                if last:
                    no, q = last
                    gap = max(1, r[3] - no if r[3] is not None and no is not None else 1)
                    h2, t2, b2 = px(q[3]), px(q[4]), px(q[2])
                    turn = abs(math.degrees(math.atan2(h[1] - t[1], h[0] - t[0])) - math.degrees(math.atan2(h2[1] - t2[1], h2[0] - t2[0]))) % 360
                    score += hyp(t, t2) / gap + hyp(h, h2) / gap + abs(hyp(h, t) - hyp(h2, t2)) + min(turn, 360 - turn) + hyp(b, b2) / gap
                score += CFG.anchor_weight * max(0, hyp(b, anchor) - CFG.anchor_radius)
                scored.append((score, d[0], d))
            if scored:
                best = min(scored)[2]
                last = (r[3], best)
                picks[r[0]] = best[0]
            else:
                picks[r[0]] = None
    return picks


def frames(spark, records, parts):
    return spark.createDataFrame(records, RECORD_TYPE).repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_choice_equals_loop_across_blocks(spark, parts, monkeypatch):
    rng = random.Random(5)
    records = []
    for i in range(260):
        seq = "hot" if i % 4 else f"s{i % 12}"
        no = None if i % 37 == 0 else i
        dets = [det(k + 1, rng.random(), *[rng.random() for _ in range(4)], rng.choice([.05, .9]), .8) for k in range(rng.randrange(0, 4))]
        records.append(record(seq, no, dets, f"{i:06d}"))
    monkeypatch.setattr(C, "FOLD_ROWS", 8)
    monkeypatch.setattr(C, "FOLD_FAN", 3)
    out = C.select_candidates(frames(spark, records, parts), CFG).collect()
    assert {r.prediction_stem: r.chosen.rank if r.chosen else None for r in out} == loop(records)


def test_length_outlier_drops_points_only(spark):
    recs = [record("s", i, [det(1, .9, .30, .4, .31 if i == 3 else .42, .4)]) for i in range(7)]
    out = C.screen_outliers(C.select_candidates(frames(spark, recs, 2), CFG)).orderBy("pos").collect()
    assert [r.drop_reason for r in out] == [None] * 3 + ["length_outlier"] + [None] * 3
    assert out[3].outlier_reason.startswith("length_outlier:length_ratio=0.083")


def test_annotation_columns_are_rejected(spark):
    df = frames(spark, [record("s", 1, [])], 1)
    require_record_schema(df)
    with pytest.raises(ValueError, match="visibility"):
        require_record_schema(df.withColumn("visibility", F.lit("x")))
    with pytest.raises(ValueError, match="unexpected|missing"):
        require_record_schema(df.drop("frame_no"))
