import random
import re

from pyspark.sql import functions as F

from trackloom.llm import decontaminate as dc

from .conftest import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = plain(text), set(), set()
        for item_id, item in items:
            q = plain(item)
            n = min(13, len(q))
            windows = {tuple(q[i:i + n]) for i in range(len(q) - n + 1)} if q else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted(i for i in ids if i is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def case():
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, n)) + "?") for i, n in enumerate([1, 4, 13, 14, 40])] + [(9, None), (10, "--"), (None, "null id item"), (4, "again the same id")]
    items.append((11, " ".join(items[4][1].split()[5:20])))
    docs = [(i, " ".join(words(rng, 300))) for i in range(5)]
    for i, (_, text) in enumerate(items):
        body = words(rng, 150)
        body[70:70] = (text or "").upper().split()
        docs.append((20 + i, ", ".join(body)))
    docs += [(40, items[3][1]), (41, None), (42, ""), (43, "!!!"), (40, items[3][1]), (None, items[2][1]), (44, "Élan ÉLAN naïve " + items[2][1])]
    return docs, items


def test_equals_brute_force_with_one_or_many_parts(spark, docs_of):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for part in (1 << 20, 200):
        got = dc.find_contamination(docs_of(docs, items=F.lit(1), spans=F.lit(2)), bench, max_part_bytes=part).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr) == brute(docs, items)


def test_spans_point_into_the_original_text(spark, docs_of):
    docs, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    by_id = {d: t for d, t in docs if d is not None}
    for r in dc.find_contamination(docs_of(docs), bench).where("doc_id is not null").collect():
        raw = (by_id[r.doc_id] or "").encode()
        assert sum(len(plain(raw[s.start:s.end].decode())) for s in r.spans) == r.n_hit


def test_clean_rows_stay_whole(spark, docs_of):
    docs, items = case()
    frame = docs_of(docs, item_id=F.lit(None).cast("long"))
    kept = dc.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((b[0] for b in brute(docs, items) if not b[4]), key=repr)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_contamination(docs_of([]).limit(0), none).count() == 0
    assert dc.find_contamination(docs_of([(1, "a b")]), none).first().n_hit == 0
