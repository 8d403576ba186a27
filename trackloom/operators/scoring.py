"""Batched window scoring hook, score decoding and overlap averaging."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators.windows import pack_windows
from trackloom.schemas import WindowSettings

N_SCORES = 10
Scorer = Callable[[np.ndarray], np.ndarray]


def score_windows(
    wins: DataFrame, features: Sequence[str], make_scorer: Callable[[], Scorer], *,
    batch_size: int = 2048,
) -> DataFrame:
    """Call a model on ``[batch, rows, features]``; adds ``scores`` (10 numbers) per row.

    ``make_scorer`` runs once per task and returns the callable, so a model file is
    loaded on the executor. Windows stream through in Arrow batches.
    """
    packed = pack_windows(wins, features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at:at + batch_size]
                x = np.stack([np.stack(v) for v in part["x"]])
                y = np.asarray(scorer(x), dtype=np.float64)
                if y.shape != (*x.shape[:2], N_SCORES):
                    raise ValueError(f"scorer returned shape {y.shape}")
                yield pd.DataFrame({"swing_id": part["swing_id"].values, "win_start": part["win_start"].values,
                                    "scores": [list(v) for v in y]})

    scored = packed.select("swing_id", "win_start", "x").mapInPandas(
        run, "swing_id string, win_start bigint, scores array<array<double>>")
    return scored.select("swing_id", "win_start", F.posexplode("scores").alias("idx", "scores"))


def linear_scores(weights: Mapping[str, Mapping[str, float]]) -> list[Column]:
    """Scores of a linear model as column arithmetic (``bias`` is the constant)."""
    out = []
    for terms in weights.values():
        total = F.lit(float(terms.get("bias", 0.0)))
        for name, w in terms.items():
            if name != "bias":
                total = total + F.col(name) * float(w)
        out.append(total)
    return out


def decode_scores(s: Sequence[Column], tail_x: Column, tail_y: Column, settings: WindowSettings) -> dict[str, Column]:
    """Ten raw scores to prior, final, corrected, delta, trust, bucket shares, quality."""
    trust = S.sigmoid(s[4])
    top = F.greatest(*s[5:9])
    e = [F.exp(v - top) for v in s[5:9]]
    total = e[0] + e[1] + e[2] + e[3]
    out = {"prior_x": S.clamp(s[0], 0, 1), "prior_y": S.clamp(s[1], 0, 1)}
    for axis, d, obs, size in (("x", s[2], tail_x, settings.width), ("y", s[3], tail_y, settings.height)):
        out[f"final_{axis}"] = S.clamp(obs + trust * d / size, 0, 1)
        out[f"corrected_{axis}"] = S.clamp(obs + d / size, 0, 1)
        out[f"delta_{axis}"] = d
    out["trust"] = trust
    out.update({f"p{i}": v / total for i, v in enumerate(e)})
    out["quality"] = S.sigmoid(s[9])
    return out


AVERAGED = ("prior_x", "prior_y", "final_x", "final_y", "corrected_x", "corrected_y", "delta_x", "delta_y",
            "trust", "p0", "p1", "p2", "p3", "quality")


def overlap_mean(decoded: DataFrame, *, tasks: int | None = None) -> DataFrame:
    """Average all windows covering (sequence, frame); clipping happened before.

    Other facts of a frame come from the window written last (lowest start). Where ``decoded`` has the
    ``block`` by which its windows were dealt out, the windows of a row are added up where they are.
    """
    means = {**{c: c for c in AVERAGED}, "tail_x_norm": "filled_x", "tail_y_norm": "filled_y"}
    # Rows of a frame first: keys of any type are hashed, while a buffer with text would have every window's row sorted.
    home = [c for c in ("block",) if c in decoded.columns]
    rows = decoded.groupBy("swing_id", *home, "frame_idx", "pos", "image_stem", "tail_seen", "ctx").agg(
        F.min("win_start").alias("win_start"), *[x for c in means for x in (F.sum(c).alias(f"__sum_{c}"), F.count(c).alias(f"__n_{c}"))])
    if tasks:
        rows = rows.repartition(tasks, "swing_id", "frame_idx")
    facts = F.struct("image_stem", "tail_seen", "ctx")
    out = rows.groupBy("swing_id", "frame_idx").agg(
        *[(F.sum(f"__sum_{c}") / F.sum(f"__n_{c}")).alias(n) for c, n in means.items()],
        F.min_by(facts, F.struct(F.col("win_start"), -F.col("pos"))).alias("f"))
    return out.select("swing_id", "frame_idx", "f.image_stem", "f.tail_seen", "f.ctx.*",
                      *AVERAGED, "filled_x", "filled_y").withColumn("bucket_pred", argmax_class(*[F.col(f"p{i}") for i in range(4)]))


def argmax_class(*probs: Column) -> Column:
    """Index of the largest value, the lowest on a tie."""
    a = F.array(*probs)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
