import random
import zlib

from pyspark.sql import functions as F

from trackloom.llm import quality

from .conftest import words


def corpus(n=240):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = words(rng, rng.choice([30, 200]))
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [w[0]] * len(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_rows_are_recognised(spark, docs_of):
    docs, labels = corpus()
    docs += [(900, None), (901, ""), (None, "w1x w2x"), (5, docs[5][1]), (902, "a" * 300_000), (903, "w7x " * 5)]
    labels += [(1, None, None), (None, 1, 0), (2, 0, 0), (2, 1, 0), (5, labels[5][1], 0)]
    frame = docs_of(docs, score=F.lit(1), predicted=F.lit(2), k=F.lit(3))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = quality.scored(frame, quality.train(frame, table, steps=400)).collect()
    assert len(got) == len(docs)
    truth = {d: q for d, q, _ in labels[:240]}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_same_text_same_score_whatever_else(spark, docs_of):
    docs, labels = corpus(90)
    nets = quality.train(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), steps=50)
    a = quality.score_texts(nets, [t for _, t in docs[:10]], 64)
    b = [quality.score_texts(nets, [t], 64)[0] for _, t in docs[:10]]
    assert abs(a - b).max() < 1e-5
    kept = quality.keep_good(docs_of(docs), nets)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.scored(docs_of(docs), nets).where("predicted = 1").collect()}


def test_one_class_or_no_labels(spark, docs_of):
    frame = docs_of([(1, "a b"), (3, "c")])
    ones = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 1 for r in quality.scored(frame, quality.train(frame, ones)).collect())
    nets = quality.train(frame, ones.limit(0))
    assert [r.score for r in quality.scored(frame, nets).collect()] == [0.5, 0.5]
    assert quality.scored(frame.limit(0), nets).count() == 0


def test_passages_cover_whole_texts():
    raws = [b"", b"a b c d e", b"  x  ", ("é " * 7).encode()]
    x, bags = quality.passages(raws, 2)
    assert bags.tolist() == [1, 3, 1, 4] and x.shape == (9, quality.N_FEATURES)
    alone = [quality.passages([r], 2)[0] for r in raws]
    import numpy as np
    assert np.allclose(x, np.concatenate(alone))


def test_long_labelled_text_does_not_end_the_sample(spark, docs_of):
    docs, labels = corpus()
    long = [(1000 + i, " ".join(words(random.Random(i), 1500))) for i in range(60)]
    table = spark.createDataFrame(labels + [(d, 1, 0) for d, _ in long], "doc_id long, quality int, toxic int")
    frame = docs_of(docs + long)
    got = quality.scored(frame, quality.train(frame, table, max_train_passages=400, words=10, steps=300), words=10).where("held_out and doc_id < 1000").collect()
    truth = {d: q for d, q, _ in labels}
    assert len(got) > 20 and sum(r.predicted == truth[r.doc_id] for r in got) >= 0.95 * len(got)
    assert [quality.passages_each(n, 10) for n in ([], [3, 4], [1, 2, 90], [20] * 30)] == [1, 4, 7, 1]


def test_without_labels_nothing_is_rejected(spark, docs_of):
    frame = docs_of([(1, "a b"), (3, "c"), (4, None)])
    labels = spark.createDataFrame([(77, 1, 0)], "doc_id long, quality int, toxic int")
    nets = quality.train(frame, labels)
    assert quality.keep_good(frame, nets).count() == 3
    assert all(r.predicted == 1 and r.score == 0.5 for r in quality.scored(frame, nets).collect())
