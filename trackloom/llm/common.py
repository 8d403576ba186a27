"""Helpers of the corpus operators: tables, shared folders, word bytes, grouped batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from trackloom.session import checkpoint_folder

# ASCII white space that separates words: bytes.split() without arguments uses exactly these.
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder (a URI) below the session's shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a bare path is a local one."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, name: str, chunks: Iterator[bytes]) -> int:
    """Write a file under a name of its own attempt; readers learn the name from the task's row.

    A task that is lost or runs twice leaves a file nobody refers to.
    """
    store, root = open_store(uri)
    store.create_dir(root, recursive=True)
    size = 0
    with store.open_output_stream(f"{root}/{name}") as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return size


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut lineage and known sizes."""
    where = shared_folder(df.sparkSession, purpose)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def tasks_for(spark: SparkSession) -> int:
    """Partitions for Python work after a shuffle, as many as the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def lowered_words(text: str | None) -> list[bytes]:
    """Words of ``text`` with A-Z in lower case; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys``; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        labels = list(zip(*cols, strict=True))
        start = 0
        for i in range(1, len(labels) + 1):
            if i < len(labels) and labels[i] == labels[start]:
                continue
            if held and labels[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, i - start))
            last = labels[start]
            start = i
    if held:
        yield pa.Table.from_batches(held)


def by_runs(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each group of ``keys``: one Python process per task, not one call per group."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            out = fn(group)
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches()
    n = tasks_for(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(work, schema)
