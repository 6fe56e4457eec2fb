"""Entry books: sections, entries of source and translation, front and back matter, reading lists; one document replayed in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

ENTRY = "title string, part string, raw boolean, kind string, item int, text string, src string"


class Book:
    """The settings of a book: sections (their headings), sub (pattern of sub-section headings), anchors (heading -> part), front (part name),
    appendix (part name), raw (beginning of a list kept line by line), front_title and back_title (patterns), source (pattern of a citation row)."""

    def __init__(self, sections, sub=r"^[（(][一二三四五六七八九十]+[）)]", anchors=None, front="卷首", appendix="附录", raw=None, front_title=r"(题词|序|跋|语|记)$", back_title=r"(后记|题词|序|跋)$", source=r"^（《[^》]+》[^）]*）$", source_mark="【原文】", translation_mark="【译文】"):
        self.sections, self.sub, self.anchors, self.front, self.appendix, self.raw = set(sections), re.compile(sub), dict(anchors or {}), front, appendix, raw
        self.front_title, self.back_title, self.source = re.compile(front_title), re.compile(back_title), re.compile(source)
        self.source_mark, self.translation_mark = source_mark, translation_mark


def segment(rows: list[dict], book: Book) -> list[tuple]:
    """Rows {text, plain (style), follows} of one document to rows of ENTRY: kind plain (a line of the article), or entry (source, translation).

    A section heading opens an article and a part; a sub-section takes over a section's article that is still empty; a title of front or
    back matter and an anchor open one as well. A source mark begins an entry, a translation mark turns it to its other side; a
    citation row belongs to the open entry. A row equal to its article's title is page furniture. Articles without content are none.
    """
    out: list[tuple] = []
    state = {"title": None, "part": book.front, "own": book.front, "raw": False, "plain": [], "entries": []}  # own: the part when the article was opened
    entry, side, seen = None, "o", set()

    def close() -> None:
        nonlocal entry
        if entry is not None:
            state["entries"].append(entry)
            entry = None

    def open_article(title: str, part: str | None = None, raw: bool = False) -> None:
        close()
        for k, line in enumerate(state["plain"]):
            out.append((state["title"], state["own"], state["raw"], "plain", k, line, None))
        for k, e in enumerate(state["entries"]):
            for kind in ("o", "t"):
                if body := "".join(e[kind]).strip():
                    out.append((state["title"], state["own"], state["raw"], {"o": "source", "t": "translation"}[kind], k, body, e["src"]))
        state.update(title=title, part=part or state["part"], own=part or state["part"], raw=raw, plain=[], entries=[])

    for r in rows:
        t = r["text"]
        if state["title"] is not None and t == state["title"]:
            continue
        short = len(t) <= 24 and r["plain"] and not re.search(r"[。，；：？！】]", t)
        if t in book.sections:
            seen.add(t)
            open_article(t, t)
        elif re.sub(r"\s+", "", t) == book.appendix and len(seen) == len(book.sections):
            state["part"] = book.appendix
        elif book.sub.match(t) and r["plain"] and seen:
            if state["title"] == state["part"] and not state["plain"] and not state["entries"] and entry is None:
                state["title"] = t
            else:
                open_article(t)
        elif t in book.anchors:
            open_article(t, book.anchors[t])
        elif book.source.match(t):
            if entry is not None:
                entry["src"] = t
            elif state["title"] is not None:
                state["plain"].append(t)
        elif t.startswith(book.source_mark):
            close()
            rest = t[len(book.source_mark) :].strip()
            entry, side = {"o": [rest] if rest else [], "t": [], "src": None}, "o"
        elif t.startswith(book.translation_mark):
            entry = entry or {"o": [], "t": [], "src": None}
            side, rest = "t", t[len(book.translation_mark) :].strip()
            entry["t"] += [rest] if rest else []
        elif book.raw and state["part"] == book.front and t.startswith(book.raw):
            open_article(t, raw=True)
        elif state["part"] == book.front and short and book.front_title.search(t) and r["follows"]:
            open_article(t)
        elif state["part"] in (book.appendix, *book.anchors.values()) and short and book.back_title.search(t):
            open_article(t, book.appendix)
        else:
            if state["title"] is None:
                open_article("〔无题〕")
            (state["plain"] if entry is None else entry[side]).append(t)
    open_article("")
    return out


def parse(paras: DataFrame, book: Book, file: str = "file") -> DataFrame:
    """(file, seq, title, part, raw, kind, item, text, src) from paras (file, pos, text, plain, follows): see segment().

    Each file is one task's work, its rows streamed in order; follows comes from ingest.origin_follows.
    """
    kind = paras.schema[file].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, where = [], None

        def done() -> pd.DataFrame:
            made = pd.DataFrame(segment(held, book), columns=[c.split()[0] for c in ENTRY.split(", ")])
            made.insert(0, "seq", range(len(made)))
            made.insert(0, file, where)
            return made

        for f in frames:
            for r in f.to_dict("records"):
                if r[file] != where:
                    if held:
                        yield done()
                    held, where = [], r[file]
                held.append(r)
        if held:
            yield done()

    sorted_ = paras.select(file, "pos", "text", "plain", "follows").repartition(file).sortWithinPartitions(file, "pos")
    return sorted_.mapInPandas(run, f"{file} {kind}, seq int, {ENTRY}")


def list_block(paras: DataFrame, begins: str, ends: str, signed: str, file: str = "file") -> DataFrame:
    """(file, pos, text, preface) between a row that begins with begins and the next that equals ends; preface up to the row that holds signed.

    Empty rows and repeats of the heading are left out.
    """
    w = Window.partitionBy(file)
    start = F.min(F.when(F.col("text").startswith(begins), F.col("pos"))).over(w)
    after = paras.withColumn("__a", start).where("pos > __a")
    stop = F.min(F.when(F.col("text") == ends, F.col("pos"))).over(w)
    inner = after.withColumn("__z", stop).where("__z IS NULL OR pos < __z").where((F.col("text") != "") & ~F.col("text").startswith(begins))
    before = F.max(F.col("text").contains(signed).cast("int")).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return inner.select(file, "pos", "text", (F.coalesce(before, F.lit(0)) == 0).alias("preface"))


def blank_groups(rows: DataFrame, is_note: Column, article: str = "id") -> DataFrame:
    """rows (article, pos, text) without blank ones, with group: it ends at a blank row; a note is a group of its own."""
    w = Window.partitionBy(article).orderBy("pos")
    flagged = rows.withColumn("__n", F.coalesce(is_note, F.lit(False))).withColumn("__e", T.strip("text") == "")
    before = F.lag(F.col("__e") | F.col("__n")).over(w)
    starts = ~F.col("__e") & (F.coalesce(before, F.lit(True)) | F.col("__n"))
    numbered = flagged.withColumn("group", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where(~F.col("__e")).withColumn("is_note", F.col("__n")).drop("__n", "__e")


def is_signed(text: Column | str) -> Column:
    """A row that can only be translation or a sign-off: a translation prefix, a year, an era, a disciple's name."""
    t = F.col(text) if isinstance(text, str) else text
    return t.startswith("译文：") | t.startswith("译文:") | t.rlike(r"^\d{4}年|^[（(]?民国|^[一-鿿]{2,6}弟子$")


def is_note_header(text: Column | str) -> Column:
    """A heading of notes, white space aside."""
    return T.squash_ws(text).isin("【注释】", "注释", "【注释】：", "注释：", "【注：】", "注：", "【注】")


def without_note_headers(segments: Column | str) -> Column:
    """Segments {o, t, …} without sides that are headings of notes, and without those that had nothing else; a note or block stays."""
    s = F.col(segments) if isinstance(segments, str) else segments
    clean = lambda c: F.when(is_note_header(c), F.lit(None).cast("string")).otherwise(c)
    kept = lambda x: x["n"].isNotNull() | x["os"].isNotNull()
    cleaned = F.transform(s, lambda x: F.when(kept(x), x).otherwise(x.withField("o", clean(x["o"])).withField("t", clean(x["t"]))))
    return F.filter(cleaned, lambda x: kept(x) | x["o"].isNotNull() | x["t"].isNotNull())


def active_marks(paras: DataFrame, mark: Column, heading: Column, file: str = "file") -> DataFrame:
    """Marks among ordinary rows that count: those at or after the file's first such heading; all of them in a file without one."""
    start = F.min(F.when(heading, F.col("pos"))).over(Window.partitionBy(file))
    return paras.withColumn("__s", start).where(mark & (F.col("__s").isNull() | (F.col("pos") >= F.col("__s")))).drop("__s")


def content_bold(rows: DataFrame, is_marker: Column, is_note: Column, article: str = "id") -> DataFrame:
    """(article, has_bold): whether a bold row is content, and no marker, note or heading of notes."""
    content = F.col("bold") & (T.strip("text") != "") & ~F.coalesce(is_marker, F.lit(False)) & ~F.coalesce(is_note, F.lit(False)) & ~is_note_header("text")
    return rows.groupBy(article).agg(F.bool_or(content).alias("has_bold"))
