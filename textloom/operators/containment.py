"""Which texts contain which: as beginnings, as ends, or as characters in order. Nothing is compared pair by pair.

Beginnings and ends are equal to one of the other text's beginnings or ends, so both sides are joined on 128-bit names of those; names
of lengths that the other side doesn't have aren't made. For characters in order, the short texts of a group are a trie, and a long text walks
down it by next occurrences: each node is reached once, at the earliest place, and its children from there. Groups are cut to
blocks of short texts and of long ones, so no task holds more than a block of the first and streams the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.storage import broadcast_if_small, keep, shuffled

#: Short texts in a trie, and long texts that walk one in a task, at most on average.
SHORT_BLOCK, LONG_BLOCK = 8192, 16384
FIRST, ALL, FIRST_LONG = "first short", "all", "first long"


def name_of(x: Column) -> list[Column]:
    return [F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2")]


def longest(df: DataFrame, text: str) -> int:
    return df.agg(F.max(F.length(text))).first()[0] or 0


def parts_named(df: DataFrame, text: str, least: int, most: int, begins: bool, ends: bool) -> DataFrame:
    """df with h1, h2 of each different beginning and end (as asked for) of these lengths of a text."""
    sizes = F.when(F.length(text) >= least, F.sequence(F.lit(least), F.least(F.length(text), F.lit(max(most, least))))).otherwise(F.array().cast("array<int>"))
    sides = [F.transform(sizes, lambda n: F.left(text, n))] * begins + [F.transform(sizes, lambda n: F.right(text, n))] * ends
    return df.withColumn("__p", F.explode(F.array_distinct(F.concat(*sides)))).select(*df.columns, *name_of(F.col("__p")))


def whole_in_parts(inner: DataFrame, outer: DataFrame, least: int, begins: bool, ends: bool) -> DataFrame:
    """(vol, inner, outer_ord) and the rest of both sides: inner (vol, inner, ...) begins or ends outer (vol, outer, ...), both in the same vol."""
    named = inner.select(*inner.columns, *name_of(F.col("inner")))
    return parts_named(outer, "outer", least, longest(inner, "inner"), begins, ends).join(shuffled(named), ["vol", "h1", "h2"]).drop("h1", "h2")


class Trie:
    """Short texts by their characters; each node has the least order number below it and how many texts there are still looked for."""

    def __init__(self):
        self.children: list[dict[str, int]] = [{}]
        self.parent, self.least, self.end, self.open = [-1], [None], [None], [0]
        self.texts: list[str | None] = [None]

    def add(self, path: str, text: str, order: int) -> None:
        at, way = 0, [0]
        for ch in path:
            nxt = self.children[at].get(ch)
            if nxt is None:
                nxt = self.children[at][ch] = len(self.children)
                self.children.append({})
                for column, value in ((self.parent, at), (self.least, None), (self.end, None), (self.open, 0), (self.texts, None)):
                    column.append(value)
            at = nxt
            way.append(at)
        fresh = self.end[at] is None
        self.end[at] = order if fresh else min(order, self.end[at])
        self.texts[at] = text
        for node in way:
            self.least[node] = order if self.least[node] is None else min(order, self.least[node])
            self.open[node] += fresh

    def close(self, node: int) -> None:
        """The text that ends here is found, and isn't looked for any more."""
        self.end[node] = None
        while node >= 0:
            self.open[node] -= 1
            node = self.parent[node]

    def within(self, long: str, first: bool) -> list[int]:
        """Nodes of the texts whose characters long has in order; with first, the one of least order number alone."""
        found, best, todo = [], None, [(0, 0)]
        while todo:
            node, at = todo.pop()
            if not self.open[node] or (best is not None and self.least[node] >= self.end[best]):
                continue
            if self.end[node] is not None:
                if not first:
                    found.append(node)
                elif best is None or self.end[node] < self.end[best]:
                    best = node
            for ch, child in self.children[node].items():
                place = long.find(ch, at)
                if place >= 0:
                    todo.append((child, place + 1))
        return found if not first else [] if best is None else [best]


def in_order(short: DataFrame, long: DataFrame, mode: str) -> DataFrame:
    """(vol, text, ord): which characters of short (vol, text, ord) occur in long (vol, text, ord) in this order, both ending alike.

    FIRST: for each long text the least ord of its short ones; ALL: every ord of them; FIRST_LONG: for each short text the least ord of the long
    ones. Texts are given once for each vol; an ord is a whole number. Null and empty texts have no row.
    """
    end = F.right("text", F.lit(1)).alias("e")
    least = lambda df: df.where(F.length("text") > 0).groupBy("vol", "text").agg(F.min("ord").cast("long").alias("ord")).select("vol", end, "text", "ord")
    every = short.where(F.length("text") > 0).select("vol", end, "text", F.col("ord").cast("long").alias("ord"))
    few, many = keep(every if mode == ALL else least(short)), keep(least(long))
    counts = lambda df, n: df.groupBy("vol", "e").agg(F.count("*").alias(n))
    sizes = counts(few, "s").join(shuffled(counts(many, "l")), ["vol", "e"])
    sizes = sizes.select("vol", "e", F.ceil(F.col("s") / SHORT_BLOCK).cast("int").alias("blocks"), F.ceil(F.col("l") / LONG_BLOCK).cast("int").alias("salts"))
    sizes = broadcast_if_small(keep(sizes), 64)
    own = lambda n: F.pmod(F.xxhash64("text"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = few.join(sizes, ["vol", "e"]).select("vol", "e", own(F.col("blocks")).alias("block"), each("salts").alias("salt"), F.lit(False).alias("walks"), "text", "ord")
    b = many.join(sizes, ["vol", "e"]).select("vol", "e", each("blocks").alias("block"), own(F.col("salts")).alias("salt"), F.lit(True).alias("walks"), "text", "ord")
    keys = ["vol", "e", "block", "salt"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, trie, orders = None, Trie(), {}
        for f in frames:
            out = []
            for *group, walks, text, order in zip(*[f[c] for c in [*keys, "walks", "text", "ord"]], strict=True):
                if group != where:
                    where, trie, orders = group, Trie(), {}
                if not walks:
                    trie.add(text[:-1], text, order)
                    if mode == ALL:
                        orders.setdefault(text, []).append(order)
                    continue
                for node in trie.within(text[:-1], mode == FIRST):
                    if mode == FIRST_LONG:  # long texts come by their order, so the first that has it is the least
                        out.append((group[0], trie.texts[node], order))
                        trie.close(node)
                    elif mode == ALL:
                        out += [(group[0], text, n) for n in orders[trie.texts[node]]]
                    else:
                        out.append((group[0], text, trie.end[node]))
            yield pd.DataFrame(out, columns=["vol", "text", "ord"])

    kind = short.schema["vol"].dataType.simpleString()
    found = a.unionByName(b).repartition(*keys).sortWithinPartitions(*keys, "walks", "ord").mapInPandas(run, f"vol {kind}, text string, ord long")
    return found.distinct() if mode == ALL else found.groupBy("vol", "text").agg(F.min("ord").alias("ord"))


def fitting(names: DataFrame, titles: DataFrame, least_name: int, least_short: int, first: bool = True) -> DataFrame:
    """(vol, name, ord): the titles (vol, title, ord) that a name (vol, name) of least_name characters or more fits.

    One begins with the other, the name ends with the title, or it has the title's characters in order and the same last one, if the title has
    least_short characters. With first, the title of least ord alone; otherwise all of them.
    """
    a = keep(names.where(F.length("name") >= least_name).select("vol", "name").distinct())
    t = keep(titles.where(F.length("title") > 0).select("vol", "title", F.col("ord").cast("long").alias("ord")))
    once = t.groupBy("vol", "title").agg(F.min("ord").alias("ord")) if first else t
    inside = whole_in_parts(once.withColumnRenamed("title", "inner"), a.withColumnRenamed("name", "outer"), 1, True, True).select("vol", F.col("outer").alias("name"), "ord")
    begun = parts_named(once, "title", least_name, longest(a, "name"), True, False)
    if first:
        begun = begun.groupBy("vol", "h1", "h2").agg(F.min("ord").alias("ord"))
    begins = a.select("vol", "name", *name_of(F.col("name"))).join(shuffled(begun), ["vol", "h1", "h2"]).select("vol", "name", "ord")
    walked = in_order(t.where(F.length("title") >= least_short).withColumnRenamed("title", "text"), a.select("vol", F.col("name").alias("text"), F.lit(0).alias("ord")), FIRST if first else ALL)
    both = inside.unionByName(begins).unionByName(walked.withColumnRenamed("text", "name"))
    return both.groupBy("vol", "name").agg(F.min("ord").alias("ord")) if first else both.distinct()


def naming(names: DataFrame, titles: DataFrame, least: int) -> DataFrame:
    """(vol, name, ord): for each name (vol, name) of least characters or more the first title (vol, title, ord) that it may be short for.

    The title ends with the name, the name with the title (of least characters or more), or the title has the name's characters in order and ends alike.
    """
    a = keep(names.where(F.length("name") >= least).select("vol", "name").distinct())
    t = keep(titles.where(F.length("title") > 0).groupBy("vol", "title").agg(F.min("ord").cast("long").alias("ord")))
    ended = parts_named(t, "title", least, longest(a, "name"), False, True).groupBy("vol", "h1", "h2").agg(F.min("ord").alias("ord"))
    ends = a.select("vol", "name", *name_of(F.col("name"))).join(shuffled(ended), ["vol", "h1", "h2"]).select("vol", "name", "ord")
    inside = whole_in_parts(t.where(F.length("title") >= least).withColumnRenamed("title", "inner"), a.withColumnRenamed("name", "outer"), least, False, True).select("vol", F.col("outer").alias("name"), "ord")
    walked = in_order(a.select("vol", F.col("name").alias("text"), F.lit(0).alias("ord")), t.withColumnRenamed("title", "text"), FIRST_LONG)
    return ends.unionByName(inside).unionByName(walked.withColumnRenamed("text", "name")).groupBy("vol", "name").agg(F.min("ord").alias("ord"))
