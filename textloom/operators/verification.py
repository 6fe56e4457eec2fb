"""Comparing what was extracted with what is stored: ordinal differences, character spans, multisets, truncated reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import matching


def compare_articles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, kind, seg, line, l, r): all differences of articles (id, title, segments array<array<string>>) that both sides have.

    Kinds: title_mismatch, segment_count, segment_missing_in_left or _right, orig_count, line_missing_in_left or _right, content_diff.
    Segments and lines are compared place by place; places are from 0, null for kinds that have none.
    """
    a, b = left.select("id", F.col("title").alias("lt"), F.col("segments").alias("ls")), right.select("id", F.col("title").alias("rt"), F.col("segments").alias("rs"))
    both = a.join(b, "id")
    none = F.lit(None)

    def row(kind: str, seg: Column = none, line: Column = none, x: Column = none, y: Column = none) -> list[Column]:
        return ["id", F.lit(kind).alias("kind"), seg.cast("int").alias("seg"), line.cast("int").alias("line"), x.cast("string").alias("l"), y.cast("string").alias("r")]

    titles = both.where("lt <> rt").select(*row("title_mismatch", x=F.col("lt"), y=F.col("rt")))
    counts = both.where("size(ls) <> size(rs)").select(*row("segment_count", x=F.size("ls"), y=F.size("rs")))
    segs = both.select("id", F.posexplode(F.arrays_zip(F.col("ls").alias("l"), F.col("rs").alias("r"))).alias("seg", "s")).select("id", "seg", "s.*")
    # arrays_zip fills the shorter side with nulls
    lone = segs.where("l IS NULL").select(*row("segment_missing_in_left", F.col("seg"))).unionByName(segs.where("r IS NULL").select(*row("segment_missing_in_right", F.col("seg"))))
    paired = segs.where("l IS NOT NULL AND r IS NOT NULL")
    sizes = paired.where("size(l) <> size(r)").select(*row("orig_count", F.col("seg"), x=F.size("l"), y=F.size("r")))
    lines = paired.select("id", "seg", F.posexplode(F.arrays_zip(F.col("l"), F.col("r"))).alias("line", "s")).select("id", "seg", "line", "s.*").where("NOT l <=> r")
    what = F.when(F.col("l").isNull(), "line_missing_in_left").when(F.col("r").isNull(), "line_missing_in_right").otherwise("content_diff")
    texts = lines.select("id", what.alias("kind"), "seg", "line", "l", "r")
    return titles.unionByName(counts).unionByName(lone).unionByName(sizes).unionByName(texts)


def missing(expected: DataFrame, have: DataFrame, key: str = "id") -> DataFrame:
    """Expected rows without a row of their key, one for each key."""
    return expected.join(have.select(key), key, "left_anti").dropDuplicates([key])


def opcodes(left: Column | str, right: Column | str) -> Column:
    """array<struct<op, a1, a2, b1, b2>>: the spans to replace, delete or insert that make the one text the other, in order; null texts have none."""

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in frames:
            found = [[] if x is None or y is None or x == y else matching.changes(x, y) for x, y in zip(xs, ys, strict=True)]
            yield pd.Series([[dict(zip(("op", "a1", "a2", "b1", "b2"), c, strict=True)) for c in cs] for cs in found])

    return F.pandas_udf(run, "array<struct<op: string, a1: int, a2: int, b1: int, b2: int>>")(left, right)


def unmatched(expected: DataFrame, matched: DataFrame, key: str = "title") -> DataFrame:
    """(key, n): how many more times each title is expected than matched, a row an occurrence on both sides; only positive ones."""
    count = lambda df, sign: df.groupBy(key).agg((F.count("*") * sign).alias("n"))
    return count(expected, 1).unionByName(count(matched, -1)).groupBy(key).agg(F.sum("n").alias("n")).where("n > 0")


def paragraph_counts(segments: DataFrame) -> DataFrame:
    """(id, n_orig, n_trans, state) of articles (id, plain, orig, trans a segment): plain, no_trans, mismatch or equal.

    mismatch: a segment with a translation has other counts on its two sides.
    """
    differs = (F.size("orig") != F.size("trans")) & (F.size("trans") > 0)
    sums = segments.groupBy("id").agg(F.sum(F.size("orig")).alias("n_orig"), F.sum(F.size("trans")).alias("n_trans"), F.bool_or(differs).alias("d"), F.bool_or("plain").alias("p"))
    state = F.when(F.col("p"), "plain").when(F.col("n_trans") == 0, "no_trans").when(F.col("d"), "mismatch").otherwise("equal")
    return sums.select("id", "n_orig", "n_trans", state.alias("state"))


def report(rows: DataFrame, group: str, order: list[str], value: Column, most: int) -> DataFrame:
    """(group, total, shown): how many rows a group has, and the first values of them, as many as a report lists.

    Each task cuts its rows to as many before they are shuffled.
    """
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= most)
    shown = ranked.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", value.alias("v")))), lambda x: x["v"]).alias("shown"))
    return rows.groupBy(group).agg(F.count("*").alias("total")).join(shown, group)
