"""Line deduplication by a log-template tree of fixed depth.

A line goes down the tree by its token count, then by its leading tokens (tokens with a digit are the variable field <*>). A leaf holds
groups of lines, each with a template: the tokens that its lines share by place, at least half of them, and <*> in all other places. A line itself is
the narrowest template. Wider ones come from how often a token stands in its place among the leaf's different lines: with each
of the levels LEAST, LEAST * STEP, LEAST * STEP * STEP, ... a line keeps the tokens that as many lines have there, and lines that keep the same form a
group. So a leaf has as many groups as it has kinds of lines, and a field that takes few values in many lines still becomes variable.

A template recurs if two or more documents share it (wider ones: LEAST), unless chance would do as much: of N lines of as many tokens, E =
N * RATIO * (the product of its tokens' shares) would have the template by chance, and N * E ** (d - 1) / d! templates would be met d times. If that is
below DOUBT, the template is no accident. Shares are counted without the template's own lines, so boilerplate isn't its own expectation. The rule
is the same at every length. Lines of recurring templates are dropped everywhere but in the document of the smallest id, so that no passage is lost.

Nothing is compared pair by pair and no leaf is gathered: a template is a key, and counts by key are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import broadcast_if_small
from textloom.llm.quality_rules import let
from textloom.storage import keep

#: Leading tokens on the path to a leaf.
DEPTH = 2
#: Different lines of a leaf, and documents, that a template with variable places needs; and the factor between levels.
LEAST, STEP = 5, 4
#: Levels that there can be: more lines than the last one asks for are in no table.
LEVELS = 25
#: How much likelier than by independent tokens a line may be by chance, and templates that may be taken for no accident by mistake.
RATIO, DOUBT = 50.0, 0.01
#: Up to so many lines to drop are looked up one by one, more by bisection.
FEW = 24


def tokens(line: Column) -> Column:
    """Lower-case tokens of a line; those with a digit are <*>."""
    low = F.lower(line)
    # tried at the beginnings of tokens alone, and only where there is a digit
    masked = F.when(low.rlike(r"\d"), F.regexp_replace(low, r"(?<![^\s])[^\s]*\d[^\s]*", "<*>")).otherwise(low)
    return F.array_remove(F.split(masked, r"\s+"), "")


def parsed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, h, n, k, leaf, t) for each document and different line: hash, token count, key of the line as a template, leaf, hashes of its tokens."""
    lines = F.filter(F.split(text_col, "\n"), lambda x: F.length(x) > 0)
    each = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("d"), F.explode(F.array_distinct(lines)).alias("l"))
    leaf = lambda t: F.xxhash64(F.size(t), F.slice(t, 1, DEPTH))
    hashed = F.transform(tokens(F.col("l")), lambda w: F.xxhash64(w))
    made = let(hashed, lambda t: F.struct(F.size(t).alias("n"), F.xxhash64(t).alias("k"), leaf(t).alias("leaf"), t.alias("t")))
    # computed once, although several joins read it: parsing lines is what costs here; a filter before it is written would parse them twice
    return keep(each.select("d", F.xxhash64("l").alias("h"), made.alias("m")).select("d", "h", "m.*")).where("n > 0")


def shares(parsed: DataFrame) -> DataFrame:
    """(last, w, c, every): how often a token is the last of its line, or another, and how often any is."""
    each = parsed.select("n", F.posexplode("t").alias("i", "w")).groupBy((F.col("i") + 1 == F.col("n")).alias("last"), "w").agg(F.count("*").alias("c"))
    counts = keep(each)
    whole = counts.groupBy("last").agg(F.sum("c").alias("every"))  # two rows
    return counts.join(F.broadcast(whole), "last")


def beyond_chance(found: DataFrame, own: DataFrame, wide: DataFrame, parsed: DataFrame) -> DataFrame:
    """(k, first) of the templates found (k, first, docs, lines, n, f: tokens kept) that chance doesn't account for.

    docs and lines are the documents and rows that have the template. Where as many of the most frequent token would be no accident, that is
    enough; for the others the tokens are looked up: own (k, n, t) has those of lines, wide (k, f) those of wider templates.
    """
    counts = shares(parsed)
    peak = counts.agg(F.max(F.col("c") / F.col("every")).alias("p")).first()["p"]
    totals = F.broadcast(parsed.groupBy("n").agg(F.count("*").alias("total")))  # a row for each token count
    d = F.col("docs").cast("double")

    def unlikely(log_product: Column) -> Column:
        """Whether chance makes less than DOUBT templates of this kind, by Stirling's bound of d!."""
        log_e = F.log("total") + F.log(F.lit(RATIO)) + log_product
        return F.log("total") + (d - 1) * log_e - (d * F.log(d) - d) < F.log(F.lit(DOUBT))

    sized = keep(found.join(totals, "n").withColumn("sure", unlikely(F.col("f") * F.log(F.lit(peak or 1.0)))))
    open_ = sized.where("NOT sure")
    keys = broadcast_if_small(keep(open_.select("k")), 16)
    tokens_of = own.join(keys, "k", "left_semi").dropDuplicates(["k"]).select("k", "n", F.posexplode("t").alias("i", "w")).select("k", (F.col("i") + 1 == F.col("n")).alias("last"), "w")
    tokens_of = tokens_of.unionByName(wide.join(keys, "k", "left_semi").dropDuplicates(["k"]).select("k", F.explode("f").alias("x")).select("k", "x.last", "x.w"))
    spread = open_.select("k", "lines").join(tokens_of, "k").join(counts, ["last", "w"], "left")
    # without the template's own lines; a token that has no other use makes the template impossible by chance
    other = F.greatest(F.col("c") - F.col("lines"), F.lit(0)) / F.greatest(F.col("every") - F.col("lines"), F.lit(1))
    logs = spread.groupBy("k").agg(F.sum(F.when(other > 0, F.log(other))).alias("lp"), F.bool_or(other <= 0).alias("never"))
    judged = open_.join(logs, "k").where(F.col("never") | unlikely(F.col("lp")))
    return sized.where("sure").select("k", "first").unionByName(judged.select("k", "first"))


def leaf_groups(parsed: DataFrame) -> DataFrame:
    """(line, k, n, f): the wider templates of a leaf's lines; line is the key of the line itself, f the tokens kept as array<struct<last, w>>."""
    different = parsed.select("leaf", "k").distinct().groupBy("leaf").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST)
    lines = keep(parsed.join(broadcast_if_small(keep(different.select("leaf")), 16), "leaf").select("leaf", "k", "n", "t").dropDuplicates(["k"]))
    places = lines.select("leaf", "k", "n", F.posexplode("t").alias("i", "w"))
    counts = places.groupBy("leaf", "i", "w").agg(F.count("*").alias("c")).where(F.col("c") >= LEAST)
    common = places.join(counts, ["leaf", "i", "w"]).groupBy("leaf", "k", "n").agg(F.array_sort(F.collect_list(F.struct("i", "w", "c"))).alias("p"))  # no more than a line has tokens
    common = common.where(2 * F.size("p") >= F.col("n"))
    most = F.array_max(F.transform("p", lambda x: x["c"]))
    levels = F.filter(F.array(*[F.lit(LEAST * STEP**j).cast("long") for j in range(LEVELS)]), lambda s: s <= most)
    kept = F.transform(levels, lambda s: F.filter("p", lambda x: x["c"] >= s))
    wide = F.array_distinct(F.filter(kept, lambda p: (2 * F.size(p) >= F.col("n")) & (F.size(p) < F.col("n"))))
    each = common.select(F.col("k").alias("line"), "leaf", "n", F.explode(wide).alias("p"))
    name = F.xxhash64("leaf", F.transform("p", lambda x: F.struct(x["i"], x["w"])))
    return keep(each.select("line", name.alias("k"), "n", F.transform("p", lambda x: F.struct((x["i"] + 1 == F.col("n")).alias("last"), x["w"].alias("w"))).alias("f")))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__d: id, __drop: sorted hashes of the lines to drop), for documents that have any.

    A line is dropped if one of its templates recurs and occurs in a document of smaller id.
    """
    parsed = parsed_lines(docs, id_col, text_col)
    groups = leaf_groups(parsed)
    member = keep(parsed.select("d", "h", F.col("k").alias("line")).join(groups.select("line", "k", "n", F.size("f").alias("f")), "line").drop("line"))
    count = lambda rows, least: rows.groupBy("k").agg(F.min("d").alias("first"), F.count_distinct("d").alias("docs"), F.count("*").alias("lines"), F.first("n").alias("n"), F.first("f").alias("f")).where(F.col("docs") >= least)
    found = count(parsed.select("d", "k", "n", F.col("n").alias("f")), 2).unionByName(count(member, LEAST))
    common = keep(beyond_chance(found, parsed.select("k", "n", "t"), groups.select("k", "f"), parsed))
    # a hot template is one row on the right, and the adaptive planner splits its rows on the left
    hit = parsed.select("d", "h", "k").unionByName(member.select("d", "h", "k")).join(broadcast_if_small(common, 24), "k").where("d <> first")
    return hit.groupBy(F.col("d").alias("__d")).agg(F.array_sort(F.collect_set("h")).alias("__drop"))


def among(value: Column, ordered: Column) -> Column:
    """Whether value is in a sorted array, by bisection: a long text with as many lines to drop takes n log n steps."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ordered) + 1)).cast("int"))
    at = F.struct(F.lit(0).alias("a"), F.size(ordered).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        left = F.get(ordered, middle) > value
        return F.struct(F.when(left, s["a"]).otherwise(middle).alias("a"), F.when(left, middle).otherwise(s["b"]).alias("b"))

    return F.when(F.size(ordered) <= FEW, F.array_contains(ordered, value)).otherwise(F.get(ordered, F.aggregate(steps, at, halve)["a"]) == value)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with recurring lines taken out of the text, and n_dropped_lines (long); no row is dropped.

    Rows with a null id or text stay as they are, count nothing, and have 0. Rows that share an id count as one document. The lines
    that stay keep their order and line feeds; an empty line or one of white space always stays. A text of any length is one row's
    work, in n log n steps of its lines. An empty table stays empty. Other columns are kept, but for one named n_dropped_lines.
    """
    columns = [c for c in docs.columns if c != "n_dropped_lines"]
    found = recurring_lines(docs, id_col, text_col).select(F.struct("__d", "__drop").alias("f"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r"))
    joined = left.join(found, F.col("r")[id_col] == F.col("f.__d"), "left")
    text, drop = F.col("r")[text_col], F.col("f.__drop")
    split = F.split(text, "\n")
    kept = F.filter(split, lambda x: ~among(F.xxhash64(x), drop))
    touched = drop.isNotNull() & text.isNotNull()
    n = F.when(touched, F.size(split) - F.size("k")).otherwise(0).cast("long")
    out = joined.select("r", "f", F.when(touched, kept).alias("k"))
    return out.select(*[F.when(touched, F.array_join("k", "\n")).otherwise(text).alias(c) if c == text_col else F.col("r")[c].alias(c) for c in columns], n.alias("n_dropped_lines"))
