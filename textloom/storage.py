"""Where intermediate tables go, and what is there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir, or, where it is unset and all runs on this machine, a temporary one."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = tempfile.mkdtemp(prefix="textloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read, wherever Spark keeps it."""
    files, place = _place(spark, path)
    files.delete(place, True)


def keep(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read from there on: computed once, kept when executors are lost, and read by column."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: Spark judges a table by its compressed files, which can be a fiftieth of its rows in memory."""
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, already kept or cheap to count, with a broadcast hint if its counted size is small; otherwise for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else shuffled(df)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes with the files under a path: their names, sizes and times."""
    files, place = _place(spark, path)
    parts, walk = [str(path)], files.listFiles(place, True)
    while walk.hasNext():
        f = walk.next()
        parts.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(parts))


@contextmanager
def rows_to_python(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows at a time to Python, for what is run inside the block: long rows must not fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
