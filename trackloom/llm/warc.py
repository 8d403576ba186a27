"""WARC archives: a writer that deduplicates payloads, and a reader that salvages damaged files.

Files are sequences of gzip members, one record each. The reader inflates member by member
and checks gzip CRC, version line, block length and payload digest. After a failed check
it searches for the next member start (or version line, in plain files) that yields a valid
record, goes on from there and reports the bytes between as a quarantined gap.

Defined cases. Null payload: an empty one. Null page_id: written with the id ``-``, ranks after
all numbers. Repeated rows: each gets a record; among rows with equal payload and equal
smallest page_id the first by url is the response, the others revisit it. Empty table: no files.
Only page_id, url and html are read, so other columns may have any names. A payload of any
length is one record; a task holds one record at a time, and files are closed at ``roll_bytes``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import open_store, shared_folder, stored, tasks_for

GZIP_START = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
READ_BYTES = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_FIELDS = ("file string, record_at long, record_end long, record_type string, page_id string, uri string, "
                 "payload_bytes long, payload_digest string, refers_to string, payload binary, gap string")


def _clean(value: str) -> str:
    """Header values hold no line breaks."""
    return re.sub(r"[\r\n]+", " ", value)


def _record(page_id: int | None, url: str | None, html: str | None, refers_to: str | None, revisit: bool) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = "-" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_archives(pages: DataFrame, *, min_revisit_bytes: int = 0, roll_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write one record per row; returns the manifest (file, records, bytes).

    Payload groups are found from digests alone, pre-aggregated before the shuffle;
    the join back to the rows is a plain one, which adaptive execution splits if one payload is hot.
    """
    spark = pages.sparkSession
    where = shared_folder(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    # Digests and ids decide; the payloads cross the network once, in the join.
    order = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("i"))
    each = rows.groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = (each.groupBy("sha").agg(F.min(F.struct(order.alias("o"), "n")).alias("first"), F.sum("n").alias("copies"))
              .where("copies > 1").select(F.col("sha").alias("k"), F.col("first.o.i").alias("first_id"), (F.col("first.n") > 1).alias("tied"),
                                          F.lit(True).alias("shared")))
    joined = rows.join(groups, rows.sha == F.col("k"), "left")
    shared = F.coalesce("shared", F.lit(False)) & (F.octet_length("html") >= min_revisit_bytes)
    marked = joined.select("page_id", "url", "html", "sha", "first_id", shared.alias("shared"), F.coalesce("tied", F.lit(False)).alias("tied"),
                           F.coalesce(F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(True)).alias("is_first"))
    target = F.coalesce(F.col("first_id").cast("string"), F.lit("-"))

    def decided(df: DataFrame, revisit: Column) -> DataFrame:
        return df.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, target).alias("refers_to"))

    clash = F.col("tied") & F.col("shared") & F.col("is_first")
    if groups.where("tied").isEmpty():
        final = decided(marked, F.col("shared") & ~F.col("is_first"))
    else:
        # Rows that share both payload and the smallest id: only the first by url is the response.
        nth = F.row_number().over(Window.partitionBy("sha", "page_id").orderBy(F.col("url").asc_nulls_last()))
        final = decided(marked.where(~clash), F.col("shared") & ~F.col("is_first")).unionAll(
            decided(marked.where(clash).withColumn("nth", nth), F.col("nth") > 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(where)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, count, size = None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, url, text, again, target = (v.as_py() for v in row)
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packed = _member(_record(page_id, url, text, target, again), level)
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= roll_bytes:
                    out.close()
                    done.append((f"{where}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{where}/{name}", count, size))
        if done:
            files, records, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
                                             ["file", "records", "bytes"])

    return stored(final.mapInArrow(work, "file string, records long, bytes long"), "warc-manifest")


class _Damaged(Exception):
    pass


class _Source:
    """Random access to one archive through a window of a few read blocks."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""

    def find(self, what: bytes, at: int) -> int:
        """Position of ``what`` at or after ``at``, or -1."""
        keep = len(what) - 1
        while at < self.size:
            block = self.read(at, READ_BYTES)
            hit = block.find(what)
            if hit >= 0:
                return at + hit
            if at + len(block) >= self.size:
                return -1
            at += len(block) - keep
        return -1


def _inflate(src: _Source, at: int) -> tuple[bytes, int]:
    """The member at ``at`` and the position after it; zlib verifies its CRC and length."""
    unpack, parts, pos = zlib.decompressobj(31), [], at
    while not unpack.eof:
        block = src.read(pos, READ_BYTES)
        if not block:
            raise _Damaged("member ends early")
        try:
            parts.append(unpack.decompress(block))
        except zlib.error as e:
            raise _Damaged("bad member") from e
        pos += len(block)
        if len(parts) == 1 and not parts[0].startswith(VERSION[:len(parts[0])]):
            raise _Damaged("no version line")
    return b"".join(parts), pos - len(unpack.unused_data)


def _plain(src: _Source, at: int) -> tuple[bytes, int]:
    """The uncompressed record at ``at`` and the position after it."""
    head = src.read(at, READ_BYTES)
    end = head.find(b"\r\n\r\n")
    found = re.search(rb"\r\nContent-Length: *(\d+)\r\n", head[:end + 2] if end >= 0 else b"", re.IGNORECASE)
    if not found:
        raise _Damaged("no header")
    total = end + 4 + int(found[1]) + 4
    raw = src.read(at, total)
    if len(raw) < total:
        raise _Damaged("record ends early")
    return raw, at + total


def _parsed(raw: bytes) -> dict[str, object]:
    head, cut, rest = raw.partition(b"\r\n\r\n")
    if not cut or not head.startswith(VERSION):
        raise _Damaged("no version line")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise _Damaged("bad header line")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogatepass")
    if not fields.get("content-length", "").isdigit():
        raise _Damaged("no length")
    n = int(fields["content-length"])
    if len(rest) < n or rest[n:] != b"\r\n\r\n":
        raise _Damaged("wrong length")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type", "")
    if kind == "response" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise _Damaged("wrong payload digest")
    told = re.search(rb"\r\nContent-Length: *(\d+)", http, re.IGNORECASE)
    page = lambda v: v.removeprefix("<urn:page:").removesuffix(">") if v else None
    return {
        "record_type": kind, "page_id": page(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"),
        "payload_bytes": int(told[1]) if kind == "revisit" and told else len(payload), "payload_digest": digest or None,
        "refers_to": page(fields.get("warc-refers-to")), "payload": None if kind == "revisit" else payload,
    }


def salvage(uri: str) -> Iterator[dict[str, object]]:
    """Valid records and quarantined gaps of one archive, in file order."""
    src = _Source(uri)
    packed = src.read(0, 2) == GZIP_START[:2] or (src.read(0, len(VERSION)) != VERSION and src.find(GZIP_START, 0) >= 0)
    start_mark, take = (GZIP_START, _inflate) if packed else (VERSION, _plain)
    at, gap_from, why = 0, None, ""
    while at < src.size:
        try:
            raw, end = take(src, at)
            found = _parsed(raw)
        except _Damaged as e:
            if gap_from is None:
                gap_from, why = at, str(e)
            nxt = src.find(start_mark, at + 1)
            at = src.size if nxt < 0 else nxt
            continue
        if gap_from is not None:
            yield {"file": uri, "record_at": gap_from, "record_end": at, "gap": why}
            gap_from = None
        yield {"file": uri, "record_at": at, "record_end": end, **found}
        at = end
    if gap_from is not None:
        yield {"file": uri, "record_at": gap_from, "record_end": src.size, "gap": why}


def read_archives(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Records of the files in ``manifest.file``; rows with ``gap`` set are quarantined bytes."""
    names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD_FIELDS.split(", ")])

    def pack(rows: list[dict[str, object]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, size = [], 0
                for row in salvage(uri):
                    if not payloads:
                        row["payload"] = None
                    held.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size > 8 << 20:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    files = manifest.select("file")
    return files.repartition(tasks_for(manifest.sparkSession), "file").mapInArrow(work, RECORD_FIELDS)


def gaps(records: DataFrame) -> DataFrame:
    """The quarantine log: byte ranges that held no valid record, with the first failed check."""
    return records.where("gap is not null").select("file", F.col("record_at").alias("gap_start"), F.col("record_end").alias("gap_end"),
                                                   F.col("gap").alias("reason"))


def page_digest(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back and return the facts of each record."""
    records = read_archives(write_archives(pages, min_revisit_bytes=min_revisit_bytes), payloads=False).where("gap is null")
    number: Column = F.col("page_id").try_cast("long")
    return records.select(number.alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").try_cast("long").alias("refers_to"))
