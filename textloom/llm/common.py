"""What several operators share: tables, shared storage, grouped streaming, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from textloom.storage import remove, shared_dir  # noqa: F401  operators take them from here

#: A side of a join is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows for each file of a table of so many rows, where their number is known, and the files it has at least.
ROWS_PER_FILE, LEAST_FILES = 50_000, 8


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session, for what runs inside the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Written to the shared folder and read from there on: computed once, and kept when executors are lost.

    With the number of rows to come, narrow ones, in no more files than those are worth, whatever the number of shuffle partitions.
    Nothing that was guessed of the rows is carried on: the planner's size of a join is the product of its sides' sizes, so over the
    rounds of a loop its digits would grow by a power, and the driver would spend its time and memory on them.
    """
    spark = df.sparkSession
    shared_dir(spark)
    few = df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // ROWS_PER_FILE)))
    written = few.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), spark)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df (already cut) with a broadcast hint if its counted size is small; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def batches_in(df: DataFrame, rows: int = 512) -> DataFrame:
    """Sends fewer rows at a time to Python, so that very long texts stay within a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def by_group(keys: list[str], each: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over partitions sorted by keys: calls each with all rows of one key after the other.

    Cheaper than applyInPandas for many small groups. Outputs are gathered to batches of some thousand rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last, out, n = None, [], 0
        for frame in frames:
            if not len(frame):
                continue
            cols = [frame[k].to_numpy() for k in keys]
            change = np.zeros(len(frame), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change), len(frame)]
            for a, b in zip(starts, starts[1:], strict=False):
                key = tuple(c[a] for c in cols)
                if key != last and held:
                    out.append(each(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)))
                    n += len(out[-1])
                    held = []
                last = key
                held.append(frame.iloc[a:b])
            if n > 4000:
                yield pd.concat(out, ignore_index=True)
                out, n = [], 0
        if held:
            out.append(each(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)))
        if out:
            yield pd.concat(out, ignore_index=True)

    return run


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """In place: labels (each an index of a member with the same label) after joining the classes of a[k] and b[k]."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the edges: equal roots exactly within connected components.

    Contraction: each node joins its least neighbour (by id at first, by a hash of the id and the round later, so that
    long chains shrink by a constant factor), edges are renamed and made distinct, until none is left. Each round
    aggregates before it shuffles, and is cut, so that a lost executor costs one round.
    """
    edges = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    found, rounds, n = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), 0, edges.count()
    nodes = 2 * n
    while n:
        both = edges.union(edges.select("b", "a"))
        rank = F.xxhash64("b", F.lit(rounds)) if rounds else F.col("b")
        own = F.xxhash64("a", F.lit(rounds)) if rounds else F.col("a")
        least = both.groupBy("a").agg(F.min(F.struct(rank.alias("r"), F.col("b").alias("p"))).alias("m"))
        step = cut(least.select("a", F.when(F.col("m.r") < own, F.col("m.p")).otherwise(F.col("a")).alias("p")), 2 * n)
        # written with each round: a chain of joins over all rounds would be planned anew after each of its stages
        if rounds:
            found = cut(found.join(step.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), nodes)
        else:
            found = step.select(F.col("a").alias("node"), F.col("p").alias("root"))
        left = edges.join(step, "a").select(F.col("p").alias("u"), F.col("b").alias("a")).join(step, "a")
        edges = cut(left.select(F.col("u").alias("a"), F.col("p").alias("b")).where("a <> b").distinct(), n)
        rounds, n = rounds + 1, edges.count()
    return found


def arrow_rows(spark: SparkSession, rows: int):
    """So many rows at a time to Python, for what runs inside the block."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
