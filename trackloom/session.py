"""Session settings and the one way intermediate results are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Code cache: one metric plan has more than the default 100 generated classes.
# Huge-method limit: larger methods are not compiled by the JVM, so leave them out.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the session.

    A temporary folder stands in only where none is set and everything runs in one
    process; on a cluster, where executors could not see it, a missing folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder (a URI) below the shared folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Rows of a frame table that one task sorts: some 200 MB in the widest step.
TASK_ROWS = 100_000


def tasks_for_rows(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS) -> int | None:
    """Partitions that hold ``rows`` at ``task_rows`` each; None where the session's shuffles have as many anyway.

    A fixed number of shuffle partitions lets the memory of a task grow with the table. Where it is
    high enough, adaptive execution may join small partitions, which it leaves alone after an explicit number.
    """
    wanted = -(-rows // task_rows)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def materialised(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    For results that several branches of a plan read and that took many shuffles.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def filed(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Columns of repeated values take a fraction of what a checkpoint takes, and a reader gets only the columns that it
    names; the partitioning is lost.
    """
    where = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
