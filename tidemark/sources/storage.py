"""Shared storage: where intermediate tables go, and cutting long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Up to so many rows of a loop's table may be sent whole to every executor: some 10 MB once hashed.
SENT_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a
    temporary folder is made and set; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` for joins by sorting and merging, never as a copy for every executor.

    The planner takes the size of a table of cells from its packed files, and
    what ``explode`` makes of it for no larger; a copy sent by that guess goes
    through the driver and can be hundreds of times as large.
    """
    return df.hint("merge")


def cut_cells(df: DataFrame) -> DataFrame:
    """As ``cut``, for tables that grow with the cells: their guessed size is not gone by."""
    return by_merge(cut(df))


def cut_round(df: DataFrame) -> DataFrame:
    """As ``cut``, for one round of a loop.

    A checkpoint keeps the planner's guess of its size, which a join squares:
    over the rounds of a loop that number would grow without end, and planning
    with it.  Here the rows are counted first, so the real size is kept.  That
    size is of packed columns, a tenth of what a copy for every executor takes
    in the driver, so tables of more than ``SENT_ROWS`` rows meet by merging.
    """
    shared_dir(df.sparkSession)
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        rows = held.count()
        kept = held.checkpoint(eager=True)
        return by_merge(kept) if rows > SENT_ROWS else kept
    finally:
        held.unpersist()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def stands(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path``, in any store that Spark reaches."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
