"""From paragraphs to articles: skipping, marking, segmenting, regrouping.

Positions are explicit and every rule is a window within one file; where a rule depends on what it accepted before
(consecutive numbers, expected titles used up), a file's rows are replayed in order by one Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import segments

NOTE = r"^\[?(\d+)\]\s*(?:【(.+?)】)?([\s\S]*)$"


def after_contents(paras: DataFrame, file: str = "file") -> DataFrame:
    """Paragraphs after the last one of a table-of-contents style; all of a file without any."""
    last = F.max(F.when(F.lower("style").contains("toc"), F.col("pos"))).over(Window.partitionBy(file))
    return paras.withColumn("__l", last).where("__l IS NULL OR pos > __l").drop("__l")


def from_second(paras: DataFrame, heading: str, file: str = "file") -> DataFrame:
    """Paragraphs from the second occurrence of a heading on: the first is in the contents."""
    nth = F.sum(F.when(F.col("text") == heading, 1).otherwise(0)).over(Window.partitionBy(file).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return paras.withColumn("__n", nth).where("__n >= 2").drop("__n")


def without_page_fields(paras: DataFrame, field: str = "PAGE") -> DataFrame:
    """Without rows of page number fields."""
    return paras.where(~F.contains("text", F.lit(field)))


def pair_files(left: DataFrame, right: DataFrame, key: str = "entry") -> DataFrame:
    """(key, orig, trans, state) of the numbered entries of two files (key, text): both, orig only or trans only."""
    both = left.select(key, F.col("text").alias("orig")).join(right.select(key, F.col("text").alias("trans")), key, "full_outer")
    return both.withColumn("state", F.when(F.col("trans").isNull(), "orig only").when(F.col("orig").isNull(), "trans only").otherwise("both"))


def is_numbered(text: Column) -> Column:
    """Whether a title begins with a number and its mark."""
    return text.rlike(r"^\d+[、.]")


def without_volumes(articles: DataFrame, volume: str, excluded: list[str]) -> DataFrame:
    return articles.where(~F.col(volume).isin(excluded)) if excluded else articles


def drop_noise(paras: DataFrame, exact: list[str], patterns: list[str] = ()) -> DataFrame:
    """Without rows that equal a phrase, are digits alone, or match a pattern of page furniture."""
    pattern = "|".join(f"(?:{p})" for p in [r"^\d+\s*$", *patterns])
    return paras.where(~F.col("text").isin(exact) & ~F.col("text").rlike(pattern)) if exact else paras.where(~F.col("text").rlike(pattern))


def marker_kind(text: Column, juan: str, categories: list[str]) -> Column:
    """juan, cat or null, for squashed texts of 1 to 14 characters: the pattern first, then the names."""
    s = T.squash_ws(text)
    return F.when(F.length(s).between(1, 14), F.when(s.rlike(juan), "juan").when(s.isin(categories), "cat"))


def fill_forward(paras: DataFrame, marks: dict[str, Column], file: str = "file") -> DataFrame:
    """paras with a column for each mark: its last non-null value so far."""
    w = Window.partitionBy(file).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return paras.withColumns({name: F.last(value, ignorenulls=True).over(w) for name, value in marks.items()})


def excluded_between(paras: DataFrame, is_heading: Column, skipped: Column, file: str = "file") -> DataFrame:
    """Without the rows from each skipped heading up to the next heading."""
    w = Window.partitionBy(file).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(is_heading, skipped), ignorenulls=True).over(w)
    return paras.withColumn("__s", state).where("__s IS NULL OR NOT __s").drop("__s")


def anchored(paras: DataFrame, anchor: Column, witness: Column, within: int = 6, file: str = "file") -> DataFrame:
    """Rows from the first anchor that a witness follows within so many raw rows; none without one."""
    ahead = Window.partitionBy(file).orderBy("pos").rowsBetween(1, within)
    good = paras.withColumn("__a", anchor & F.coalesce(F.bool_or(witness).over(ahead), F.lit(False)))
    start = F.min(F.when(F.col("__a"), F.col("pos"))).over(Window.partitionBy(file))
    return good.withColumn("__p", start).where("pos >= __p").drop("__a", "__p")


def origin_follows(paras: DataFrame, kept: Column, origin: Column, stop: Column, within: int = 6, file: str = "file") -> DataFrame:
    """Kept rows (not empty, not junk) with follows: of the next six, an origin mark comes before any stop."""
    rows = paras.where(kept).withColumn("__k", F.when(origin, "o").when(stop, "s"))
    ahead = Window.partitionBy(file).orderBy("pos").rowsBetween(1, within)
    first = F.first("__k", ignorenulls=True).over(ahead)
    return rows.withColumn("follows", F.coalesce(first == "o", F.lit(False))).drop("__k")


def number_entries(paras: DataFrame, file: str = "file", pattern: str = r"^(\d+)[、.．]") -> DataFrame:
    """paras with entry: unnumbered rows go to the entry of the largest number so far, not the latest."""
    n = F.regexp_extract("text", pattern, 1)
    numbered = paras.withColumn("n", F.when(n != "", n.cast("int")))
    return numbered.withColumn("entry", F.max("n").over(Window.partitionBy(file).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))


def consecutive(paras: DataFrame, number: str = "n", file: str = "file") -> DataFrame:
    """paras with accepted: the number is one more than the last accepted one. Others are body text."""
    out = ", ".join([*(f"{c.name} {c.dataType.simpleString()}" for c in paras.schema), "accepted boolean"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, last = None, 0
        for f in frames:
            took = []
            for name, n in zip(f[file], f[number], strict=True):
                if name != where:
                    where, last = name, 0
                good = n is not None and n == last + 1
                last += good
                took.append(bool(good))
            yield f.assign(accepted=took)

    return paras.repartition(file).sortWithinPartitions(file, "pos").mapInPandas(run, out)


def open_articles(paras: DataFrame, opens: Column, file: str = "file") -> DataFrame:
    """Rows with seq and id (file stem and zero-padded number) of the article that each lies in; rows before the first go."""
    marked = segments.islands(paras, opens, [file], ["pos"], "seq").where("seq > 0")
    return marked.withColumn("id", F.concat(F.regexp_extract(file, r"([^/]+?)(?:\.\w+)?$", 1), F.lit("-"), F.lpad(F.col("seq").cast("string"), 3, "0")))


def segment_sides(rows: DataFrame, article: str = "id") -> DataFrame:
    """(article, seg, orig, trans): a segment begins where a bold row follows a plain one, and at the start.

    Bold rows are the source, plain ones the translation; runs of each are kept in order.
    """
    before = F.lag("bold").over(Window.partitionBy(article).orderBy("pos"))
    marked = segments.islands(rows.withColumn("__b", before), F.col("bold") & F.coalesce(~F.col("__b"), F.lit(True)), [article], ["pos"], "seg")
    side = lambda bold: F.transform(F.array_sort(F.collect_list(F.when(F.col("bold") == bold, F.struct("pos", "text")))), lambda x: x["text"])
    return marked.groupBy(article, "seg").agg(side(True).alias("orig"), side(False).alias("trans"))


def regroup(articles: DataFrame) -> DataFrame:
    """(id, group, orig, trans, src, notes) from intermediate segments {o, t}, {os, ts}, {n, note}.

    A run of equal kind is a group; notes go to the group before them; a block pair stands alone.
    """
    each = articles.select("id", F.posexplode("segments").alias("pos", "s"))
    kind = F.when(F.col("s.note").isNotNull(), "note").when(F.col("s.os").isNotNull() | F.col("s.ts").isNotNull(), "block")
    kind = kind.when(F.col("s.o").isNotNull() & F.col("s.t").isNotNull(), "pair").when(F.col("s.o").isNotNull(), "orig").otherwise("trans")
    rows = each.withColumn("kind", kind)
    before = F.lag("kind").over(Window.partitionBy("id").orderBy("pos"))
    starts = (F.col("kind") != "note") & (F.col("__b").isNull() | (F.col("__b") != F.col("kind")) | (F.col("kind") == "block"))
    marked = segments.islands(rows.withColumn("__b", before), starts, ["id"], ["pos"], "group")
    ordered = lambda value: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"]))
    one = lambda c: F.filter(F.array(F.col(c)), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    orig = F.when(F.col("kind") == "block", F.coalesce("s.os", none)).otherwise(one("s.o"))
    trans = F.when(F.col("kind") == "block", F.coalesce("s.ts", none)).otherwise(one("s.t"))
    note = F.when(F.col("kind") == "note", F.array(F.struct(F.col("s.n").alias("n"), F.regexp_extract("s.note", r"^【(.+?)】", 1).alias("term"), F.regexp_replace("s.note", r"^【(.+?)】", "").alias("text"))))
    notes = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(note.isNotNull(), F.struct("pos", note.alias("v"))))), lambda x: x["v"]))
    return marked.groupBy("id", "group").agg(ordered(orig).alias("orig"), ordered(trans).alias("trans"), F.max("s.src").alias("src"), notes.alias("notes"))


def parse_notes(rows: DataFrame, article: str = "id") -> DataFrame:
    """(article, k, n, term, text): [n]【term】text, with the lines that continue it; a first line without a number has n 0."""
    fits = F.col("text").rlike(r"^\[?\d+\]")
    w = Window.partitionBy(article).orderBy("pos")
    marked = segments.islands(rows.withColumn("__r", F.row_number().over(w)), fits | (F.col("__r") == 1), [article], ["pos"], "k")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    body = marked.groupBy(article, "k").agg(whole.alias("w"))
    number = F.regexp_extract("w", NOTE, 1)
    return body.select(article, "k", F.when(number == "", 0).otherwise(number.cast("int")).alias("n"), F.nullif(F.regexp_extract("w", NOTE, 2), F.lit("")).alias("term"), F.when(number == "", F.col("w")).otherwise(F.regexp_extract("w", NOTE, 3)).alias("text"))


def merge_lines(rows: DataFrame, is_head: Column, numbered: Column, article: str = "id") -> DataFrame:
    """(article, para, text): printed lines joined again; a paragraph begins at a numbered line, at and after a short heading."""
    before = F.lag("__h").over(Window.partitionBy(article).orderBy("pos"))
    flagged = rows.withColumn("__h", is_head).withColumn("__n", numbered).withColumn("__p", before)
    marked = segments.islands(flagged, F.col("__n") | F.col("__h") | F.coalesce("__p", F.lit(True)), [article], ["pos"], "para")
    return marked.groupBy(article, "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))


def split_mixed(runs: Column | str, least: int = 10) -> Column:
    """(bold, rest) of a paragraph that begins bold and goes on plain, each of so many characters; else null."""
    r = F.col(runs) if isinstance(runs, str) else runs
    cut = F.array_position(F.transform(r, lambda x: ~x["bold"] & (T.squash_ws(x["text"]) != "")), True)
    join = lambda part: F.array_join(F.transform(part, lambda x: x["text"]), "")
    bold, rest = join(F.slice(r, F.lit(1), F.greatest(cut - 1, F.lit(0)).cast("int"))), join(F.slice(r, F.greatest(cut, F.lit(1)).cast("int"), F.size(r)))
    return F.when((cut > 1) & (F.length(bold) >= least) & (F.length(rest) >= least), F.struct(bold.alias("bold"), rest.alias("rest")))


def interleaved(rows: DataFrame, article: str = "id", low: float = 0.006) -> DataFrame:
    """(article, layout) by the density of function words: interleaved (odd lines modern), halves, or lines."""
    w = Window.partitionBy(article)
    placed = rows.withColumn("__k", F.row_number().over(w.orderBy("pos"))).withColumn("__n", F.count("*").over(w))
    marks = F.length("text") * T.marker_density("text")

    def density(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, marks)) / F.nullif(F.sum(F.when(which, F.length("text"))), F.lit(0)), F.lit(0.0))

    k, n = F.col("__k"), F.col("__n")
    sums = placed.groupBy(article).agg(density(k % 2 == 0).alias("odd"), density(k % 2 == 1).alias("even"), density(k > n / 2).alias("late"), density(k <= n / 2).alias("early"))
    layout = F.when((F.col("odd") >= low) & (F.col("odd") > 2 * F.col("even")), "interleaved").when((F.col("late") >= low) & (F.col("late") > 2 * F.col("early")), "halves").otherwise("lines")
    return sums.select(article, layout.alias("layout"))


def question_articles(rows: DataFrame, article: str = "id") -> DataFrame:
    """(article, summary, segments): leading bold paragraphs are the summary; a row that is a citation alone goes to the segment before."""
    w = Window.partitionBy(article).orderBy("pos")
    plain = F.min(F.when(~F.col("bold"), F.col("pos"))).over(Window.partitionBy(article))
    body = rows.withColumn("__p", plain).withColumn("lead", F.col("bold") & (F.col("__p").isNull() | (F.col("pos") < F.col("__p"))))
    split = body.withColumn("s", T.strip_source("text")).withColumn("alone", (F.col("s.body") == "") & F.col("s.src").isNotNull())
    after = F.lead(F.when(F.col("alone"), F.col("s.src"))).over(w)
    kept = split.withColumn("src", F.coalesce("s.src", after)).where("NOT alone")
    summary = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("lead"), F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    parts = F.array_sort(F.collect_list(F.when(~F.col("lead"), F.struct("pos", F.col("s.body").alias("orig"), "src"))))
    return kept.groupBy(article).agg(summary.alias("summary"), parts.alias("segments"))


def chapters(rows: DataFrame, file: str = "file") -> DataFrame:
    """(file, chap, sub, orig, with_intro): paragraphs by chapter and sub-section; the intro belongs to a chapter's first block."""
    block = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    made = rows.groupBy(file, "chap", "sub").agg(block.alias("orig"), F.min("pos").alias("__p"))
    return made.withColumn("with_intro", F.row_number().over(Window.partitionBy(file, "chap").orderBy("__p")) == 1).drop("__p")


def pair_blocks(rows: DataFrame, note: Column, mixed: Column, summary: Column, article: str = "id") -> DataFrame:
    """(article, block, kind, os, ts) from rows (article, pos, text, bold, …) in the order of a text that runs on.

    Leading rows for which summary holds are the summary, the last of them counting. A note is a block of its own, with the plain rows after
    it; so is a mixed row, whose sides the caller splits. Other rows gather in a block: a bold row begins the next one where a plain row came
    before it. Of a block the last k sources go with the first k translations, k the smaller number, as a pair or, from two on, as one block
    pair; sources left over stand alone before, translations after. kind: summary, note, mixed, orig, pair, block or trans.
    """
    w = Window.partitionBy(article).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    base = F.when(note, "note").when(mixed, "mixed").when(F.col("bold"), "o").otherwise("t")
    led = rows.withColumn("__k", base).withColumn("__s", F.coalesce(summary, F.lit(False)) & ~note)
    led = led.withColumn("__lead", F.min(F.when(F.col("__s"), 1).otherwise(0)).over(so_far) == 1)
    led = led.withColumn("__k", F.when(F.col("__lead"), "summary").otherwise(F.col("__k")))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.last(F.when(F.col("__k") != "t", F.col("__k")), ignorenulls=True).over(before)
    kinds = led.withColumn("__m", mark).withColumn("__k", F.when((F.col("__k") == "t") & F.coalesce(F.col("__m") == "note", F.lit(False)), "cont").otherwise(F.col("__k")))
    last = F.lag("__k").over(w)
    starts = last.isNull() | F.col("__k").isin("note", "mixed") | (~F.col("__k").isin("cont", "summary") & last.isin("note", "cont", "mixed", "summary")) | ((F.col("__k") == "o") & (last == "t"))
    marked = segments.islands(kinds.withColumn("__new", starts), F.col("__new"), [article], ["pos"], "block")
    texts = lambda *names: F.transform(F.array_sort(F.collect_list(F.when(F.col("__k").isin(*names), F.struct("pos", "text")))), lambda x: x["text"])
    held = marked.groupBy(article, "block").agg(F.min_by("__k", "pos").alias("first"), texts("o").alias("o"), texts("t").alias("t"), texts("note", "cont", "mixed").alias("own"), texts("summary").alias("s"))
    k = F.least(F.size("o"), F.size("t"))
    none = F.array().cast("array<string>")
    part = lambda kind, os, ts: F.struct(F.lit(kind).alias("kind"), os.alias("os"), ts.alias("ts"))
    lone_o = F.transform(F.slice("o", F.lit(1), F.size("o") - k), lambda x: part("orig", F.array(x), none))
    lone_t = F.transform(F.slice("t", k + 1, F.size("t")), lambda x: part("trans", none, F.array(x)))
    both = F.array(part("both", F.slice("o", F.size("o") - k + 1, k), F.slice("t", F.lit(1), k)))
    pairs = F.concat(lone_o, F.when(k > 0, both).otherwise(F.slice(both, F.lit(1), F.lit(0))), lone_t)
    alone = F.when(F.col("first") == "summary", F.array(part("summary", F.slice("s", F.size("s"), F.lit(1)), none))).when(F.col("first").isin("note", "mixed"), F.array(F.struct(F.col("first").alias("kind"), F.array(F.array_join("own", "\n")).alias("os"), none.alias("ts"))))
    each = held.select(article, "block", F.posexplode(F.coalesce(alone, pairs)).alias("i", "p"))
    kind = F.when(F.col("p.kind") != "both", F.col("p.kind")).when(F.size("p.os") > 1, "block").otherwise("pair")
    return each.select(article, "block", "i", kind.alias("kind"), "p.os", "p.ts")


def kind_counts(articles: DataFrame) -> DataFrame:
    """(id, n_orig, n_trans, n_notes, n_blocks) of intermediate articles: paragraphs of each side, a block pair's own included, notes and block pairs."""
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    count = lambda f: F.aggregate("segments", F.lit(0), lambda a, s: a + f(s))
    one = lambda x: F.when(x.isNotNull(), 1).otherwise(0)
    return articles.select(
        "id", count(lambda s: one(s["o"]) + F.greatest(size(s["os"]), F.lit(0))).alias("n_orig"), count(lambda s: one(s["t"]) + F.greatest(size(s["ts"]), F.lit(0))).alias("n_trans"),
        count(lambda s: one(s["note"])).alias("n_notes"), count(lambda s: one(F.coalesce(s["os"], s["ts"]))).alias("n_blocks"),
    )
