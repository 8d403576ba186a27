"""Registered queries against their SQL, and the pipeline against its stages done plainly."""

import re

import duckdb
import pytest

import corpus_pipeline
from trackloom.llm import quality
from trackloom.llm.queries import ORACLE, QUERIES

from .test_decontaminate import brute as contaminated
from .test_simhash import brute as fingerprints
from .test_token_records import expected

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    assert ours == sorted(repr(r) for r in cur.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, duck):
    labels = dict(duck.execute("select doc_id, quality from labels").fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        seen.append((name, docs, after))
        docs = after
    (_, raw, good), (_, _, alone), (_, _, clean), (_, _, mixed), (_, _, tokens) = seen
    assert all(after.columns == columns for _, _, after in seen[:4])
    kept = {r.doc_id for r in good.collect()}
    known = [(d, q) for d, q in labels.items()]
    assert sum((d in kept) == (q == 1) for d, q in known) >= 0.95 * len(known)
    assert kept == {r.doc_id for r in quality.scored(raw, quality.train(raw, spark.read.parquet(f"{SF}/labels.parquet"))).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in alone.collect()} == {c for _, _, c in fingerprints(rows)}
    rows = [(r.doc_id, r.text) for r in alone.collect()]
    dirty = {d for d, *_, bad in contaminated(rows, duck.execute("select item_id, text from benchmark").fetchall()) if bad}
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - dirty
    size, taken, before, copies = {}, {}, {}, {}
    for r in clean.collect():
        before[r.doc_id] = r
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    for r in mixed.collect():
        assert r == before[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert max(copies.values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 0.05 * sum(size.values())
    want = expected(sorted((r.doc_id, r.text) for r in mixed.collect()))
    assert sorted(map(tuple, tokens.collect())) == want
