import base64
import hashlib
import os
import random

from pyspark.sql import functions as F

from trackloom.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows, least=0):
    groups = {}
    for page_id, url, html in rows:
        groups.setdefault(html or "", []).append((page_id is None, page_id or 0, url is None, url or ""))
    out = []
    for html, members in groups.items():
        raw = html.encode()
        members.sort()
        first = None if members[0][0] else members[0][1]
        for k, (null, page_id, _, _) in enumerate(members):
            again = k > 0 and len(raw) >= least
            out.append((None if null else page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def pages(seed=1):
    rng = random.Random(seed)
    rows = [(i, f"http://x/{i}", f"<p>{rng.randrange(12)} é\r\n\r\nWARC/1.1\r\n</p>" * rng.randrange(4)) for i in range(60)]
    return rows + [(70, None, None), (71, "http://a\r\nb", ""), (3, "http://x/other", rows[3][2]), (3, "http://x/3", rows[3][2]), (None, "u", "only null id"),
                   (None, "v", "only null id"), (80, "big", "x" * 3_000_000), (None, "u", rows[0][2])]


def test_equals_brute_force(spark):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).withColumn("sha", F.lit(1)).withColumn("first_id", F.lit("x")).repartition(4)
    for least in (0, 40):
        assert sorted(map(tuple, warc.page_digest(spark, df, least).collect()), key=repr) == brute(rows, least)


def test_payloads_come_back(spark):
    rows = [(i, "u", f"page {i} ü") for i in range(20)]
    back = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES), roll_bytes=500)).collect()
    assert {(int(r.page_id), bytes(r.payload).decode()) for r in back} == {(i, h) for i, _, h in rows}


def _archive(tmp_path, records, packed):
    raws = [warc._record(i, f"u{i}", f"payload {i} " * 50, None, False) for i in range(records)]
    parts = [warc._member(r, 6) if packed else r for r in raws]
    path = tmp_path / f"a-{packed}.warc"
    path.write_bytes(b"".join(parts))
    return str(path), parts


def test_salvage_after_damage(tmp_path):
    for packed in (True, False):
        path, parts = _archive(tmp_path, 8, packed)
        data = bytearray(b"".join(parts))
        at = [sum(map(len, parts[:i])) for i in range(9)]
        data[at[2] + 4:at[2] + 20] = os.urandom(16)
        data[at[5] + len(parts[5]) // 2] ^= 0xFF
        data = data[:at[7] + 30]
        data = b"junk before the first record" * packed + bytes(data)
        with open(path, "wb") as f:
            f.write(data)
        shift = len(data) - at[7] - 30
        found = list(warc.salvage(path))
        good = [r for r in found if "gap" not in r]
        assert [int(r["page_id"]) for r in good] == [0, 1, 3, 4, 6]
        assert all(r["payload"] == (f"payload {r['page_id']} " * 50).encode() for r in good)
        lost = [(r["record_at"], r["record_end"]) for r in found if "gap" in r]
        want = [(at[2] + shift, at[3] + shift), (at[5] + shift, at[6] + shift), (at[7] + shift, len(data))]
        assert lost == ([(0, shift)] if packed else []) + want
        assert sorted([(r["record_at"], r["record_end"]) for r in found])[0][0] == 0


def test_gap_log(spark, tmp_path):
    path, parts = _archive(tmp_path, 3, True)
    with open(path, "r+b") as f:
        f.seek(len(parts[0]) + 15)
        f.write(b"\0\0\0\0")
    records = warc.read_archives(spark.createDataFrame([(path,)], "file string"))
    assert [tuple(r)[1:3] for r in warc.gaps(records).collect()] == [(len(parts[0]), len(parts[0]) + len(parts[1]))]


def test_empty_table(spark):
    assert warc.page_digest(spark, spark.createDataFrame([], PAGES)).count() == 0
