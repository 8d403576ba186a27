"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``words`` words. Each passage is encoded (share of each ASCII byte, word
lengths, capitals, repetitions) and passed through a small network; gated attention, learned from document labels alone, weighs
the passages, and the weighted representation gives the score. Training takes a bounded sample of the labelled rows
(``max_train_docs`` rows with the smallest hashes) on the driver. If these have more than ``max_train_passages`` passages, the longest
are trained on by evenly spaced passages, all by the same largest number that fits. Scoring is one scan of all documents, without
a shuffle, over whole texts.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out of training. Only texts are inputs of a score.

Defined cases. Null or wordless text: one empty passage, scored like any other. Null doc_id: not held out, not trained on. Several
labels of a doc_id: used if they agree. Null label: unused. Labels of one class only: a constant score. No usable
label: a score of 0.5 for all, and nothing is rejected (predicted is 1, ``keep_good`` keeps all rows).
Repeated rows: scored alike. Empty table: an empty result. Only doc_id, text and quality are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import sliced, stored

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
#: 128 ASCII bytes, one class for all others.
CLASS = np.minimum(np.arange(256), 128)
N_BYTES = 129
N_FEATURES = N_BYTES + 7
BATCH_BYTES = 4 << 20


def _packs(texts: list[str | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        held.append(raw)
        size += len(raw)
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def passages(raws: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each document (at least one)."""
    data = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    solid = ~SPACE[data]
    at = np.flatnonzero(solid)
    first = ~solid[at - 1] if len(at) else np.empty(0, bool)
    word_of = np.cumsum(first) - 1
    starts = at[first]
    doc_of = np.searchsorted(ends, starts, side="right") if len(starts) else np.empty(0, np.int64)
    per_doc = np.bincount(doc_of, minlength=len(raws))
    before = np.concatenate(([0], np.cumsum(per_doc)))
    bags = np.maximum(1, -(-per_doc // words))
    first_bag = np.concatenate(([0], np.cumsum(bags)))
    out = np.zeros((first_bag[-1], N_FEATURES), np.float32)
    if not len(starts):
        return out, bags
    bag_of = first_bag[doc_of] + (np.arange(len(starts)) - before[doc_of]) // words
    total = len(out)
    byte_bag = bag_of[word_of]
    hist = np.bincount(byte_bag * N_BYTES + CLASS[data[at]], minlength=total * N_BYTES).reshape(total, N_BYTES)
    in_bag = np.bincount(bag_of, minlength=total)
    n_bytes, n_words = np.maximum(hist.sum(1), 1), np.maximum(in_bag, 1)
    head = np.flatnonzero(first)
    length = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - head[word_of]
    power = np.cumprod(np.full(int(length.max()), 1_099_511_628_211, np.uint64), dtype=np.uint64)
    code = np.add.reduceat((LOWER[data[at]] + np.uint64(1)) * power[place], head)
    same = np.concatenate(([False], (code[1:] == code[:-1]) & (bag_of[1:] == bag_of[:-1])))
    mixed = np.unique(code * np.uint64(0x9E3779B97F4A7C15) + bag_of.astype(np.uint64), return_index=True)[1]
    capital = (data[starts] >= 65) & (data[starts] <= 90)
    upper = (hist[:, 65:91].sum(1) / n_bytes)
    each = lambda v: np.bincount(bag_of, v, minlength=total) / n_words
    mean = each(length)
    out[:, :N_BYTES] = np.sqrt(hist / n_bytes[:, None])
    out[:, N_BYTES:] = np.stack([
        np.log1p(mean), np.sqrt(np.maximum(each(length.astype(float) ** 2) - mean ** 2, 0)) / (1 + mean), each(same), np.bincount(bag_of[mixed], minlength=total) / n_words,
        each(capital), upper, in_bag / words], axis=1)
    return out, bags


class Net:
    """Encoder, gated attention and output layer, trained with Adam on weighted cross-entropy."""

    SHAPES = {"w1": (N_FEATURES, 32), "b1": (32,), "v": (32, 16), "u": (32, 16), "a": (16,), "c": (32,), "c0": (1,)}

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        #: False where there was no label to learn from.
        self.trained = True
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) * (len(s) > 1 or k in "ac")).astype(np.float32) for k, s in self.SHAPES.items()}
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        at = np.concatenate(([0], np.cumsum(bags)[:-1]))
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), bags))
        w = e / np.repeat(np.add.reduceat(e, at), bags)
        z = np.add.reduceat(w[:, None] * h, at)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))
        return score, (x, at, h, t, s, w, z)

    def gradients(self, bags: np.ndarray, kept: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        """``d``: derivative of the loss by each document's logit."""
        p, (x, at, h, t, s, w, z) = self.p, kept
        dz = np.repeat(d[:, None] * p["c"], bags, axis=0)
        dw = (dz * h).sum(1)
        de = w * (dw - np.repeat(np.add.reduceat(w * dw, at), bags))
        dg = de[:, None] * p["a"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (w[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        return {"c": z.T @ d, "c0": d.sum(keepdims=True), "a": (t * s).T @ de, "v": h.T @ dt, "u": h.T @ ds, "w1": x.T @ dh, "b1": dh.sum(0)}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, steps: int, seed: int, rate: float = 3e-3, decay: float = 1e-4) -> None:
        self.mean, self.scale = x.mean(0, dtype=np.float64).astype(np.float32), (x.std(0, dtype=np.float64) + 0.02).astype(np.float32)
        rng, at = np.random.default_rng(seed), np.concatenate(([0], np.cumsum(bags)))
        y = y.astype(np.float32)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        while step < steps:
            order = rng.permutation(len(y))
            for i in range(0, len(y), 128):
                docs = order[i:i + 128]
                rows = np.concatenate([np.arange(at[k], at[k + 1]) for k in docs])
                score, kept = self.forward(x[rows], bags[docs])
                grads = self.gradients(bags[docs], kept, weight[docs] * (score - y[docs]) / len(docs))
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def score_texts(nets: list[Net], texts: list[str | None], words: int) -> np.ndarray:
    out = []
    for raws in _packs(texts):
        x, bags = passages(raws, words)
        out.append(np.mean([net.forward(x, bags)[0] for net in nets], axis=0).astype(np.float64))
    return np.concatenate(out) if out else np.empty(0)


def passages_each(counts: list[int], budget: int) -> int:
    """Largest number of passages a document for which all documents together have at most ``budget`` (one each at least)."""
    left = budget
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) > left:
            return max(1, left // (len(counts) - k))
        left -= n
    return max(counts, default=1)


def accepted(nets: list[Net], score: np.ndarray, threshold: float) -> np.ndarray:
    return (score >= threshold) | (not any(net.trained for net in nets))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, words: int = 64, max_train_docs: int = 6000, max_train_passages: int = 80_000,
          steps: int = 2000, seed: int = 11) -> list[Net]:
    """Networks fitted to a bounded sample of labelled documents that are not held out."""
    agreed = (labels.select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("q")).where("k is not null and q is not null")
              .where(~held_out(F.col("k"))).groupBy("k").agg(F.min("q").alias("q"), F.max("q").alias("q2")).where("q = q2"))
    # At most max_train_docs rows: small enough to send to every task.
    chosen = agreed.select("k", "q", F.xxhash64("k").alias("h")).orderBy("h", "k").limit(max_train_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), texts.doc_id == F.col("k")).select("h", "k", "q", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            xs, counts = [], []
            for raws in _packs(batch.column(3).to_pylist()):
                x, bags = passages(raws, words)
                cuts = np.cumsum(bags)[:-1]
                xs += [part.astype("<f4").tobytes() for part in np.split(x, cuts)]
                counts += bags.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(xs, pa.binary())], ["h", "k", "q", "n", "x"])

    coded = rows.mapInArrow(encode, "h long, k long, q int, n long, x binary")
    # Ordered over at most max_train_docs rows (more only if rows repeat a doc_id, which limit() bounds again).
    coded = stored(coded.orderBy("h", "k", "n", "x").limit(max_train_docs), "training-rows")
    most = passages_each([r.n for r in coded.select("n").collect()], max_train_passages)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 50):
            xs = []
            for n, raw in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                x = np.frombuffer(raw, "<f4").reshape(n, N_FEATURES)
                xs.append(x if n <= most else x[np.arange(most) * n // most])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in xs], pa.int64()), pa.array([x.tobytes() for x in xs], pa.binary())], ["h", "k", "q", "n", "x"])

    sample = coded.mapInArrow(thin, coded.schema).orderBy("h", "k", "n", "x").select("q", "n", "x").collect()
    y = np.array([r.q for r in sample], float)
    if not len(y) or y.min() == y.max():
        net = Net(seed)
        net.trained = bool(len(y))
        net.p = {k: np.zeros_like(v) for k, v in net.p.items()}
        net.p["c0"] = np.array([0.0 if not len(y) else 8.0 * (2 * y[0] - 1)])
        return [net]
    x = np.concatenate([np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES) for r in sample])
    bags = np.array([r.n for r in sample])
    nets = [Net(seed + i) for i in range(2)]
    for i, net in enumerate(nets):
        net.fit(x, bags, y, steps, seed + i)
    return nets


def scored(docs: DataFrame, nets: list[Net], *, words: int = 64, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(nets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            s = score_texts(shared.value, batch.column(2).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s), pa.array(accepted(shared.value, s, threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, nets: list[Net], *, words: int = 64, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` with a score of at least ``threshold``, all columns kept; all rows if there was no label."""
    shared, at = docs.sparkSession.sparkContext.broadcast(nets), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1000):
            yield batch.filter(pa.array(accepted(shared.value, score_texts(shared.value, batch.column(at).to_pylist(), words), threshold)))

    return docs.mapInArrow(work, docs.schema)
