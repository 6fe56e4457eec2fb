"""Catalog trees, kept in order: nesting, flattening, insertion at a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.storage import broadcast_if_small


def nest(regions: DataFrame, nations: DataFrame) -> DataFrame:
    """A row for each region with its nations as an ordered array: a catalog's few levels, not its items."""
    inner = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    return regions.join(inner, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", "r_name", "nations")


def flatten(tree: DataFrame) -> DataFrame:
    """One row for each leaf, with its place."""
    return tree.select("r_regionkey", "r_name", F.posexplode("nations").alias("pos", "n")).select("r_regionkey", "r_name", "pos", "n.*")


def upsert_at(catalog: DataFrame, new: DataFrame, key: str, at: int) -> DataFrame:
    """The catalog without rows of new's keys, new inserted at the place, or at the end if it is shorter; pos from 0.

    A catalog holds volumes or chapters, so one window over it is a small one.
    """
    kept = catalog.join(broadcast_if_small(new.select(key), 64), key, "left_anti")
    ranked = kept.withColumn("pos", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1).cast("int"))
    moved = ranked.withColumn("pos", F.when(F.col("pos") >= at, F.col("pos") + 1).otherwise(F.col("pos")))
    n = kept.groupBy().agg(F.least(F.count("*"), F.lit(at)).cast("int").alias("pos"))
    return moved.unionByName(new.crossJoin(F.broadcast(n)))


def with_volume(articles: DataFrame, volumes: DataFrame) -> DataFrame:
    """articles with what their volume is called, its group and its place."""
    named = volumes.select("volume", F.col("name").alias("volume_name"), "group", F.col("pos").alias("volume_pos"))
    return articles.join(broadcast_if_small(named, 512), "volume", "left")


def in_catalog(articles: DataFrame, items: DataFrame) -> DataFrame:
    """articles (id, …) with place: the volume's name before its first separator, and the category, as readers see them; null outside the catalog."""
    named = items.select("id", F.concat_ws(" · ", F.substring_index("juan", "·", 1), F.nullif(F.col("category"), F.lit(""))).alias("place"))
    return articles.join(named, "id", "left")


def merged_marks(marks: list[DataFrame], file: str = "file") -> DataFrame:
    """(file, nth, pos, mark) of marks found in several ways, in the order of their places."""
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    return every.withColumn("nth", F.row_number().over(Window.partitionBy(file).orderBy("pos", "mark"))).select(file, "nth", "pos", "mark")


def preferred(aliases: DataFrame, groups_first: bool) -> DataFrame:
    """Of each alias (file, alias, canon, members, ord) the candidate tried first: for several titles first, or last; then by order."""
    group = F.col("members") > 1
    w = Window.partitionBy("file", "alias").orderBy(F.desc(group) if groups_first else F.asc(group), "ord")
    return aliases.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
