"""Lines and runs: gaps and islands in place of loops with carried state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) from 0, blank lines included."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def islands(df: DataFrame, starts: Column, within: list[str], order: list[str], name: str) -> DataFrame:
    """df with the number of the island that each row lies in: one begins wherever starts holds; 0 before the first."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def runs(df: DataFrame, kind: str, within: list[str], order: list[str], name: str = "run") -> DataFrame:
    """Islands of equal kind: a kind that comes again later begins a new one."""
    before = F.lag(kind).over(Window.partitionBy(*within).orderBy(*order))
    marked = df.withColumn("__new", before.isNull() | ~before.eqNullSafe(F.col(kind)))
    return islands(marked, F.col("__new"), within, order, name).drop("__new")


def line_offsets(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Non-empty lines with the offset of each in its document's text without white space."""
    sized = df.withColumn("n", F.length(T.squash_ws("line"))).where("n > 0")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("start", F.sum("n").over(w) - F.col("n"))


def reconstruct(docs: DataFrame, parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whether each document's parts, in order, give its text again but for white space."""
    joined = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("p"))
    back = joined.select(key, T.squash_ws(F.array_join(F.transform("p", lambda x: x["line"]), "")).alias("back"))
    return docs.join(back, key).select(key, (F.col("back") == T.squash_ws("text")).alias("same"), F.length("back").alias("n"))


def pair_tail_head(left: Column, right: Column) -> Column:
    """The last k of left with the first k of right, k the smaller size; what is left over stays single, left first."""
    k = F.least(F.size(left), F.size(right))
    # slice() takes no zero start, hence the order of the parts
    lone_left = F.transform(F.slice(left, F.lit(1), F.size(left) - k), lambda x: F.struct(x.alias("l"), F.lit(None).cast("string").alias("r")))
    both = F.transform(F.sequence(F.lit(1), k), lambda i: F.struct(F.element_at(left, F.size(left) - k + i).alias("l"), F.element_at(right, i).alias("r")))
    lone_right = F.transform(F.slice(right, k + 1, F.size(right)), lambda x: F.struct(F.lit(None).cast("string").alias("l"), x.alias("r")))
    return F.concat(lone_left, F.when(k > 0, both).otherwise(F.array().cast("array<struct<l:string,r:string>>")), lone_right)


def line_index(segments: DataFrame, article: str = "id") -> DataFrame:
    """(article, nth, start, n, line, other): the source lines of articles (article, seg, orig, trans), squashed, where each begins in its article's
    text put together, and the translation beside it; that is null where a segment's sides differ in number. Lines that are nothing but marks are left out.

    Offsets begin anew with each article, so no stretch is found across two, and no order over all articles is needed.
    """
    paired = F.size("orig") == F.size("trans")
    each = segments.select(article, "seg", F.posexplode("orig").alias("i", "raw"), F.when(paired, F.col("trans")).alias("tr"))
    rows = each.select(article, "seg", "i", T.squash_punct(F.lower("raw")).alias("line"), F.get("tr", F.col("i")).alias("other")).where("line <> ''").withColumn("n", F.length("line"))
    w = Window.partitionBy(article).orderBy("seg", "i")
    start = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows.select(article, (F.row_number().over(w) - 1).alias("nth"), start.alias("start"), "n", "line", "other")


def containing(positions: DataFrame, starts: DataFrame, within: str = "id", at: str = "pos", start: str = "start", value: str = "nth") -> DataFrame:
    """positions with value of the last row of starts that begins at or before each; null before the first.

    One sort of both by place within their group, instead of a join on a range.
    """
    columns = positions.columns
    left = positions.select(*columns, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(starts.schema[value].dataType).alias("__v"))
    right = starts.select(*[F.col(within) if c == within else F.lit(None).cast(positions.schema[c].dataType).alias(c) for c in columns], F.col(start).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(within).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__at", "__side", "__v")
