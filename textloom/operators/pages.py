"""What readers and callers see: passages, contexts, marked terms, pages, site maps, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

SOURCES, CONTEXT_JOIN = 8, "\n\n"


def passages(matches: DataFrame) -> DataFrame:
    """matches (…, text, ctx, vol_name, title) with body and place: the parent context, or the chunk itself if there is none."""
    place = F.concat_ws(" · ", F.nullif(F.col("vol_name"), F.lit("")), F.nullif(F.col("title"), F.lit("")))
    return matches.withColumn("body", F.coalesce(F.nullif(F.col("ctx"), F.lit("")), F.col("text"))).withColumn("place", place)


def contexts(found: DataFrame, group: str = "query") -> DataFrame:
    """(group, context): a group's passages as numbered blocks, in the order of rank."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "place", F.lit("\n"), "body")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    return found.groupBy(group).agg(F.array_join(ordered, CONTEXT_JOIN).alias("context"))


def sources(found: DataFrame, group: str = "query", article: str = "aid", most: int = SOURCES) -> DataFrame:
    """(group, article, rank): each article once, by its first passage, at most eight."""
    first = found.groupBy(group, article).agg(F.min("rank").alias("rank"))
    w = Window.partitionBy(group).orderBy("rank")
    return first.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def accept_rewrite(question: Column, rewrite: Column, most: int = 60) -> Column:
    """The rewritten question if it is not empty, differs and is short enough; otherwise the question."""
    r = T.strip(rewrite)
    return F.when(r.isNotNull() & (r != "") & (r != question) & (F.length(r) <= most), r).otherwise(question)


def first_party(origin: Column, referer: Column, sites: list[str]) -> Column:
    """Whether the origin is one of the sites, or the referer begins with one."""
    begins = F.lit(False)
    for s in sites:
        begins = begins | referer.startswith(f"{s}/")
    return F.coalesce(origin.isin(sites), F.lit(False)) | F.coalesce(begins, F.lit(False))


def mark_terms(text: Column, terms: Column) -> Column:
    """The first occurrence of each term between tags, longer terms first; matched in the text itself, never in a tag.

    Where two terms overlap, the longer one is marked.
    """
    longest = F.array_sort(terms, lambda a, b: F.length(b) - F.length(a))

    def place(found: Column, term: Column) -> Column:
        at = F.call_function("locate", term, text)
        free = ~F.exists(found, lambda x: (at < x["at"] + x["n"]) & (x["at"] < at + F.length(term)))
        return F.when((at > 0) & (term != "") & free, F.concat(found, F.array(F.struct(at.alias("at"), F.length(term).alias("n"))))).otherwise(found)

    spans = F.array_sort(F.aggregate(longest, F.array().cast("array<struct<at:int,n:int>>"), place))
    state = F.struct(F.lit("").alias("s"), F.lit(1).alias("at"))

    def step(a: Column, x: Column) -> Column:
        word = F.substr(text, x["at"], x["n"])
        return F.struct(F.concat(a["s"], F.substr(text, a["at"], x["at"] - a["at"]), F.lit("<b>"), word, F.lit("</b>")).alias("s"), (x["at"] + x["n"]).alias("at"))

    return F.aggregate(spans, state, step, lambda a: F.concat(a["s"], F.substr(text, a["at"], F.length(text))))


def slice_by_chars(text: Column, n: int) -> Column:
    """The beginning of the text up to its n-th character that is no white space."""
    return F.regexp_extract(text, rf"^((?U)(?:\s*\S){{0,{n}}})", 1)


def clean_heading(text: Column) -> Column:
    """Runs of two or more spaces become a separator."""
    return F.regexp_replace(T.strip(text), r"(?U)\s{2,}", " · ")


def drop_repeated_titles(rows: DataFrame, title: Column, within: str = "file") -> DataFrame:
    """Without rows that repeat the current title, which is page furniture; the title's own row stays."""
    w = Window.partitionBy(within).orderBy("pos")
    current = F.last(F.when(title, F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__t", current).where("__t IS NULL OR __t <> text").drop("__t")


def split_headings(rows: DataFrame, first: str, second: str, within: str = "file", reach: int = 2) -> DataFrame:
    """A heading printed as two lone glyphs, the second at most two rows after the first, becomes one row in the first's place."""
    w = Window.partitionBy(within).orderBy("pos")
    ahead = F.coalesce(F.bool_or(F.col("text") == second).over(w.rowsBetween(1, reach)), F.lit(False))
    behind = F.coalesce(F.bool_or(F.col("text") == first).over(w.rowsBetween(-reach, -1)), F.lit(False))
    flagged = rows.withColumn("__a", ahead).withColumn("__b", behind)
    kept = flagged.where((F.col("text") != second) | ~F.col("__b"))
    return kept.withColumn("text", F.when((F.col("text") == first) & F.col("__a"), F.lit(first + second)).otherwise(F.col("text"))).drop("__a", "__b")


def first_notes(notes: DataFrame, article: str = "id") -> DataFrame:
    """(article, n, text, duplicates): the first note of each number, and how many more have it."""
    return notes.groupBy(article, "n").agg(F.min_by("text", "k").alias("text"), (F.count("*") - 1).alias("duplicates"))


def unresolved(refs: DataFrame, top: int = 20) -> DataFrame:
    """The names that resolve to nothing, by how often, twenty of them."""
    return refs.where("id IS NULL").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def body_html(articles: DataFrame) -> DataFrame:
    """(id, html): title and segments, escaped, note numbers as superscripts."""
    para = lambda kind: lambda p: F.concat(F.lit(f'<p class="{kind}">'), T.add_refs(T.html_escape(p)), F.lit("</p>"))
    each = F.transform("segments", lambda s: F.array_join(F.concat(F.transform(F.coalesce(s["orig"], F.array()), para("orig")), F.transform(F.coalesce(s["trans"], F.array()), para("trans"))), ""))
    return articles.select("id", F.concat(F.lit("<h1>"), T.html_escape("title"), F.lit("</h1>"), F.array_join(each, "")).alias("html"))


def site_map(articles: DataFrame, base: str) -> DataFrame:
    """(id, entry): an address of a site map for each article, in one line."""
    return articles.select("id", F.concat(F.lit(f"<url><loc>{base}"), T.article_path("id"), F.lit("</loc></url>")).alias("entry"))


def health(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, vectors, and whether both are there."""
    n = chunks.agg(F.count("*").alias("chunks")).crossJoin(vectors.agg(F.count("*").alias("vectors")))
    return n.withColumn("ready", (F.col("chunks") > 0) & (F.col("vectors") > 0))


def description(articles: DataFrame, fallback: str, most: int = 150) -> DataFrame:
    """(id, description): the summary, or the first paragraph that says anything, source before translation within a segment, clipped."""
    sides = F.flatten(F.transform("segments", lambda s: F.concat(F.coalesce(s["orig"], F.array()), F.coalesce(s["trans"], F.array()))))
    first = F.get(F.filter(sides, lambda p: T.clean_text(p) != ""), F.lit(0))
    return articles.select("id", F.when(F.coalesce("summary", F.lit("")) != "", T.clip("summary", most)).when(first.isNotNull(), T.clip(first, most)).otherwise(fallback).alias("description"))


def notes_html(notes: Column) -> Column:
    """A section of notes; empty without any."""
    each = F.transform(notes, lambda n: F.concat(F.lit('<p class="note"><span class="note-n">['), n["n"].cast("string"), F.lit("]</span>"), F.when(F.coalesce(n["term"], F.lit("")) != "", F.concat(F.lit("<b>【"), T.html_escape(n["term"]), F.lit("】</b>"))).otherwise(""), T.html_escape(F.coalesce(n["text"], F.lit(""))), F.lit("</p>")))
    return F.when(F.coalesce(F.size(notes), F.lit(0)) > 0, F.concat(F.lit('<section class="notes-sec"><h3>注 释</h3>'), F.array_join(each, "\n"), F.lit("</section>"))).otherwise("")


def nav_html(prev: Column, nxt: Column) -> Column:
    """Links to the articles before and after: structs of id and title, null at the ends."""
    cell = lambda r, label: F.when(r.isNull(), "<span></span>").otherwise(F.concat(F.lit('<a href="'), T.article_path(r["id"]), F.lit(f'"><small>{label}</small>'), T.html_escape(F.coalesce(r["title"], F.lit(""))), F.lit("</a>")))
    return F.concat(F.lit('<nav class="art-nav">'), cell(prev, "上一篇"), cell(nxt, "下一篇"), F.lit("</nav>"))


def backrefs_html(refs: Column, heading: str) -> Column:
    """Links to the articles that quote this one, with how often if more than once; empty without any."""
    badge = lambda r: F.when(r["n"] > 1, F.concat(F.lit('<span class="br-n">'), r["n"].cast("string"), F.lit(" 则</span>"))).otherwise("")
    each = F.transform(refs, lambda r: F.concat(F.lit('<a class="backref" href="'), T.article_path(r["id"]), F.lit('">'), T.html_escape(F.coalesce(r["title"], F.lit(""))), badge(r), F.lit("</a>")))
    return F.when(F.coalesce(F.size(refs), F.lit(0)) > 0, F.concat(F.lit(f'<section class="backrefs"><h3>{heading}</h3>'), F.array_join(each, ""), F.lit("</section>"))).otherwise("")


def volume_pages(items: DataFrame) -> DataFrame:
    """(volume, html): a list of links to a volume's articles in the order of the catalog."""
    link = F.concat(F.lit('<li><a href="'), T.article_path("id"), F.lit('">'), T.html_escape("title"), F.lit("</a></li>"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("j", "c", "i", link.alias("a")))), lambda x: x["a"])
    return items.groupBy("volume").agg(F.concat(F.lit("<ul>"), F.array_join(ordered, ""), F.lit("</ul>")).alias("html"))


def site_index(articles: DataFrame, volumes: DataFrame, base: str, day: str) -> DataFrame:
    """(ord, entry): the entries of a site map: the site itself, volumes, then articles, each with its address, day and priority."""
    entry = lambda path, priority: F.concat(F.lit(f"<url><loc>{base}"), path, F.lit(f"</loc><lastmod>{day}</lastmod><priority>{priority}</priority></url>"))
    home = volumes.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit("").alias("k"), entry(F.lit("/"), "1.0").alias("entry"))
    vols = volumes.select(F.lit(1), F.col("volume"), entry(F.concat(F.lit("/v/"), T.url_quote("volume"), F.lit("/")), "0.9"))
    return home.union(vols).union(articles.select(F.lit(2), F.col("id"), entry(T.article_path("id"), "0.8")))


def robots(base: str) -> str:
    return f"User-agent: *\nAllow: /\n\nSitemap: {base}/sitemap.xml\n"


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (id, html) as text, a folder for each first letter of the id's hash, so that no folder holds all of them."""
    pages.withColumn("part", F.left(F.md5("id"), F.lit(1))).select("part", F.concat_ws("\t", "id", F.regexp_replace("html", r"[\r\n\t]", " ")).alias("value")).write.partitionBy("part").mode("overwrite").text(path)


def clean_translator(name: Column | str) -> Column:
    """One person's name without a final 译; empty where it names more than one, or anything besides."""
    n = T.strip(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    return F.when(n.contains("校审") | n.contains("、") | n.contains(" "), "").otherwise(F.regexp_replace(n, "译$", ""))


def short_part(name: Column | str) -> Column:
    """A part's name without the collection's; the whole name if nothing else is left."""
    n = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    return F.coalesce(F.nullif(F.regexp_replace(n, "^(增广)?印光法师文钞(续编|三编)?", ""), F.lit("")), n)


def nav_title(title: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")), "（附录于后）$", "")


def selection_key(article: Column, paragraph: Column, text: Column) -> Column:
    """What names a selected passage: article, paragraph, length without white space, beginning and end with white space collapsed."""
    flat = F.regexp_replace(text, r"(?U)\s+", " ")
    parts = [article.cast("string"), F.coalesce(paragraph.cast("string"), F.lit("")), T.clen(text).cast("string"), F.left(flat, F.lit(80)), F.right(flat, F.lit(40))]
    return F.concat_ws("|", *parts)


def _ld(data: Column) -> Column:
    """Structured data as it may stand in a page: no < in it."""
    return F.replace(F.to_json(data), F.lit("<"), F.lit("\\u003c"))


def article_ld(title: Column, description: Column, url: Column, author: str, translator: Column) -> Column:
    """An article; a translator only if one is named."""
    person = lambda n: F.struct(F.lit("Person").alias("@type"), n.alias("name"))
    who = F.when(F.coalesce(translator, F.lit("")) != "", person(translator))
    return _ld(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Article").alias("@type"), title.alias("headline"), description.alias("description"), person(F.lit(author)).alias("author"), who.alias("translator"), url.alias("mainEntityOfPage")))


def breadcrumb_ld(steps: Column) -> Column:
    """The way to a page: array of structs of name and url, the site first."""
    items = F.transform(steps, lambda s, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), s["name"].alias("name"), s["url"].alias("item")))
    return _ld(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement")))


def collection_ld(name: Column, url: Column, n: Column) -> Column:
    return _ld(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("CollectionPage").alias("@type"), name.alias("name"), url.alias("url"), n.alias("numberOfItems")))


def faq_ld(pairs: Column) -> Column:
    """Questions and answers: array of structs of question and answer."""
    items = F.transform(pairs, lambda p: F.struct(F.lit("Question").alias("@type"), p["question"].alias("name"), F.struct(F.lit("Answer").alias("@type"), p["answer"].alias("text")).alias("acceptedAnswer")))
    return _ld(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), items.alias("mainEntity")))


def faq_answer(articles: DataFrame, most: int = 800) -> DataFrame:
    """(id, answer): the summary and, of each segment, its translation or, without one, its source, clipped."""
    side = F.transform("segments", lambda s: F.when(F.coalesce(F.size(s["trans"]), F.lit(0)) > 0, s["trans"]).otherwise(F.coalesce(s["orig"], F.array())))
    parts = F.filter(F.concat(F.array(F.coalesce("summary", F.lit(""))), F.flatten(side)), lambda x: x != "")
    return articles.select("id", T.clip(F.array_join(parts, " "), most).alias("answer"))
