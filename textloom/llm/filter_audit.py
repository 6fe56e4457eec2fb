"""How filters of a corpus interact, whatever their order, by the Walsh-Hadamard transform of their failure masks.

A document fails some of five filters, which is a mask of five bits. For each part of the corpus and each pair of labels, 32 signed
parity sums are gathered: for each subset of the filters, documents that fail an even number of it less those that fail an odd one.
The transform is its own inverse but for the factor 32, so the sums give back exactly how many documents have each mask; and from
these 32 numbers every order of the filters is evaluated without another look at a text: what a filter removes after others, what it
would have removed but came too late for, and its Shapley value. A document with k failures is removed first by each of its
filters in 120 / k of the 120 orders, so the Shapley sums need no walk through the orders.

What a text fails depends on the text alone, but for E, which is about copies. Its parity sums are first taken as if every document
failed E, and then corrected for those that don't: the ones of the smallest id among identical texts. These are found by a
rank that Spark limits before it shuffles, so of a text that a third of all rows have, each task sends its least id only.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut
from textloom.llm.quality_rules import let

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of A to D: what a text fails by itself."""

    def bits(words: Column) -> Column:
        upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
        fails = [
            F.size(words) < LEAST_WORDS,
            100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
            100 * upper > UPPER_PERCENT * F.length(text),
            text.rlike(SYMBOLS),
        ]
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")

    return let(F.array_remove(F.split(text, SPACES), ""), bits)


def sign(mask: Column, s: int) -> Column:
    """1 if an even number of the mask's bits is in s, else -1."""
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(s))) % 2)


def cells(sums: list[Column]) -> Column:
    """Documents of each mask, exactly, from the signed sums of all subsets: the transform once more, and a 32nd of it."""
    found = list(sums)
    for k in range(len(FILTERS)):
        step = 1 << k
        found = [found[i] + found[i + step] if not i & step else found[i - step] - found[i] for i in range(MASKS)]
    return F.array(*[(x / F.lit(MASKS)).cast("long") for x in found])


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step from 1, the step's filter as a bit, those before it as a mask) of every order."""
    found = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            found.append((order, step, bit, before))
            before |= bit
    return found


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, every, good, toxic): arrays of 32 counts by mask, of all documents, of those with quality 1, and of those with toxic 1."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    facts = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    # rows that agree in all are one with a number; computed once, as two passes read them
    facts = cut(facts.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    every = facts.select("id", "part", "n", "mask", F.lit(False).alias("own"))
    first = facts.where("id IS NOT NULL").withColumn("r", F.rank().over(Window.partitionBy("digest").orderBy("id"))).where("r = 1")
    # what is no copy after all: taken back with E, and counted without
    right = first.drop("r").unionByName(facts.where("id IS NULL")).select("id", "part", "n", "mask", F.lit(True).alias("own"))
    each = every.unionByName(right).groupBy("id", "part", "mask", "own").agg(F.sum("n").alias("n"))
    marked = each.join(marks, "id", "left").select("part", "n", "mask", "own", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    bare, copied = F.col("mask"), F.col("mask") + COPY
    signed = [F.sum(F.col("n") * F.when(F.col("own"), sign(bare, s) - sign(copied, s)).otherwise(sign(copied, s))).alias(f"w{s}") for s in range(MASKS)]
    sums = marked.groupBy("part", "good", "toxic").agg(*signed)
    weights = {"every": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    whole = sums.groupBy("part").agg(*[F.sum(F.col(f"w{s}") * w).alias(f"{name}{s}") for name, w in weights.items() for s in range(MASKS)])
    return whole.select("part", *[cells([F.col(f"{name}{s}") for s in range(MASKS)]).alias(name) for name in weights])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For each part, order of the five filters and step: what that step removes, and what is left of it.

    A null text counts as empty, a null part as the empty string. A row without id is nobody's copy, and none is a copy of it.
    Rows that share an id and a text aren't copies of each other; each counts. Labels of one id count as one: good or toxic if any
    of them says so. A part exists if a document has it, so an empty table gives no rows. Columns of other names aren't read.
    A text of any length is one row's work.
    """
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("f"), F.lit(b).alias("before")) for o, k, f, b in orders()])
    each = mask_cells(docs, labels, id_col, text_col, part_col).withColumn("s", F.explode(steps)).select("part", "every", "good", "toxic", "s.*")
    f, before = F.col("f"), F.col("before")
    masks = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def total(counts: str, of, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: acc + F.when(of(m), F.get(counts, m) * weight(m)).otherwise(0))

    fails = lambda m: m.bitwiseAND(f) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    shares = {k: len(list(permutations(FILTERS))) // k for k in range(1, len(FILTERS) + 1)}
    share = lambda m: sum((F.when(F.bit_count(m) == k, v).otherwise(0) for k, v in shares.items()), F.lit(0))
    return each.select(
        "part",
        "filter_order",
        "step",
        total("every", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("every", removed).alias("removed"),
        total("every", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.get("every", f).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("every", fails, share).alias("shapley"),
    )
