"""Filter interaction audit against counting every document in every order."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from trackloom.llm.filter_audit import COUNTS, audit, cells

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        docs.append((s or "", d, {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}))
    out = {}
    for part in {p for p, _, _ in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            here = [(d, f) for p, d, f in docs if p == part]
            gone = []
            for step, k in enumerate(order, 1):
                removed = [d for d, f in here if f[k]]
                redundant = sum(f[k] for _, f in gone)
                gone += [(d, f) for d, f in here if f[k]]
                here = [(d, f) for d, f in here if not f[k]]
                unique = sum(p == part and f[k] and sum(f.values()) == 1 for p, _, f in docs)
                shapley[k] += len(removed)
                out[part, order, step] = [k, len(here), len(removed), redundant, unique, sum(d in good for d in removed), sum(d in toxic for d in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def as_dict(df):
    return {(r.part, r.filter_order, r.step): [r["filter"], *(r[c] for c in COUNTS), r.shapley] for r in df.collect()}


@pytest.fixture(scope="module")
def cases():
    many = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, many, "a"), (2, many, "a"), (3, many, "b"), (4, many.upper(), "b"), (5, "x " * 250, "a"), (6, "short | text", None),
        (7, None, ""), (8, "", "a"), (9, "", "a"), (10, many + " #", "c"), (10, many + " #", "c"), (None, many, "a"), (None, "", "b"),
        (11, many, "c"), (12, "ÄÖ" * 400, "c"), (13, "  lead\tand\x0bother space \n", "c"), (0, many + " é𝒳", "a"), (14, "AB" + "x" * 98, "a"), (15, "AB" + "x" * 97, "a"),
        (16, " ".join(["p", "q"] * 2 + [f"r{i}" for i in range(200)] + ["s"] * 210), "b")]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (5, 1, 0), (5, 0, 1), (9, 1, 0), (10, 1, 1), (99, 1, 1), (None, 1, 1), (8, None, 1), (11, 1, None)]
    return rows, labels


def test_equals_counting_each_document(spark, docs_of, cases):
    rows, labels = cases
    docs = docs_of([(d, t, "s") for d, t, _ in rows]).drop("source")
    named = spark.createDataFrame([(i, s) for i, (_, _, s) in enumerate(rows)], "i int, source string")
    docs = spark.createDataFrame([(i, d, t) for i, (d, t, _) in enumerate(rows)], "i int, doc_id long, text string").join(named, "i")
    got = as_dict(audit(docs, spark.createDataFrame(labels, LABELS)))
    assert got == brute(rows, labels)


def test_clashing_columns_and_no_labels(spark, docs_of):
    rows = [(1, "one", "s"), (2, "one", "s")]
    docs = docs_of(rows, mask=F.lit("x"), digest=F.lit(1), part=F.lit(2), n=F.lit(3), good=F.lit(4), words=F.lit(5), least=F.lit(6))
    assert as_dict(audit(docs, spark.createDataFrame([], LABELS))) == brute(rows, [])


def test_empty_table(spark, docs_of):
    assert audit(docs_of([]), spark.createDataFrame([], LABELS)).collect() == []


def test_cells_add_up_with_one_text_in_most_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"),
                                    (F.col("id") % 7).cast("string").alias("source"))
    got = {(r.part, r.mask): r.n for r in cells(docs, spark.createDataFrame([], LABELS)).collect()}
    assert sum(got.values()) == 3000
    assert sum(n for (_, mask), n in got.items() if not mask & 16) == 1001


def test_long_text(spark, docs_of):
    rows = [(1, "word " * 300_000, "s"), (2, "z" * 2_000_000, "s")]
    assert as_dict(audit(docs_of(rows), spark.createDataFrame([(2, 1, 1)], LABELS))) == brute(rows, [(2, 1, 1)])
