"""Queries over articles: documents stand for articles, their lines, four at a time, for segments of two sides."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import alignment, catalogs, entries, ingest, pages, terms, verification
from textloom.operators import segments as lines
from textloom.plans.base import query, table
from textloom.sources import articles as A
from textloom.sources import docx
from textloom.storage import shared_dir

_LS = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')"
# (id, volume, title, plain, seg, orig, trans, term): a row a segment
_SEG = f"""
d AS (SELECT source || '-' || doc_id AS id, source AS volume, doc_id % 5 = 0 AS plain, {_LS} AS ls FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL)
, s AS (SELECT id, volume, plain, left(coalesce(ls[1], ''), 30) AS title, i AS seg, ls[4 * i + 1:4 * i + 2] AS orig, ls[4 * i + 3:4 * i + 4] AS trans, string_split(trim(ls[4 * i + 1]), ' ')[1] AS term
  FROM (SELECT *, unnest(range(greatest(1, (len(ls) + 3) // 4))) AS i FROM d) WHERE len(ls) > 0)
"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a line, as published articles."""
    own = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND source IS NOT NULL").withColumn("ls", own).where(F.size("ls") > 0)
    none = F.lit(None).cast("string")

    def segment(i):
        term = F.element_at(F.split(F.trim(F.get("ls", 4 * i)), " "), 1)
        note = F.struct((i + 1).cast("int").alias("n"), term.alias("term"), F.get("ls", 4 * i).alias("text"))
        return F.struct(F.slice("ls", 4 * i + 1, F.lit(2)).alias("orig"), F.slice("ls", 4 * i + 3, F.lit(2)).alias("trans"), F.array(note).alias("notes"), none.alias("src"), none.alias("srcId"))

    made = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / 4).cast("int")), segment)
    return docs.select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("volume"), F.left(F.get("ls", F.lit(0)), F.lit(30)).alias("title"), F.lit("").alias("summary"), (F.col("doc_id") % 5 == 0).alias("plain"), made.alias("segments"))


@query(f"""
WITH {_SEG}, r AS (SELECT id, plain, seg, len(orig) = len(trans) AND len(orig) > 0 AND NOT plain AS paired, orig, trans FROM s)
, e AS (SELECT id, seg, paired, unnest(CASE WHEN paired THEN list_transform(range(1, len(orig) + 1), lambda k: {{'k': k, 'kind': 'pair', 'text': orig[k] || chr(10) || '（白话）' || trans[k], 'step': 2}})
  ELSE list_concat(list_transform(range(1, len(orig) + 1), lambda k: {{'k': k, 'kind': 'orig', 'text': orig[k], 'step': 1}}), list_transform(range(1, len(trans) + 1), lambda k: {{'k': k + 10, 'kind': 'trans', 'text': trans[k], 'step': 1}})) END) AS x FROM r)
SELECT id AS aid, seg::INT AS seg, x.kind AS kind, coalesce(sum(x.step) OVER (PARTITION BY id ORDER BY seg, x.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p, md5(x.text) AS body FROM e
""")
def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.chunk_sources(segments(spark, sf_dir)).select("aid", "seg", "kind", "p", F.md5("text").alias("body"))


@query(f"""
WITH {_SEG}, a AS (SELECT id, any_value(plain) AS plain, bool_and(len(trans) = 0 OR len(orig) = len(trans)) AS even, bool_or(len(trans) > 0) AS t, count(*) AS notes FROM s GROUP BY id)
SELECT id, even AND NOT plain AS converted, even AS migrated, t AS aligned, notes::INT AS notes FROM a
""")
def paired_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paired_flags(segments(spark, sf_dir))


@query(f"WITH {_SEG} SELECT term, id AS a, (seg + 1)::INT AS n, (row_number() OVER (PARTITION BY term ORDER BY id, seg))::INT AS ord FROM s WHERE term <> ''")
def article_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.term_dictionary(segments(spark, sf_dir))


@query(f"""
WITH {_SEG}, t AS (SELECT term, id AS a, seg + 1 AS n FROM s WHERE term <> ''), k AS (SELECT term, a, n FROM t WHERE NOT starts_with(a, 'src1-') UNION ALL SELECT term, a, -n FROM t WHERE starts_with(a, 'src1-') AND n % 2 = 0)
SELECT term, count(*) AS n_entries, min(n)::INT AS least, max(n)::INT AS most FROM k GROUP BY term
""")
def dictionary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = A.term_dictionary(segments(spark, sf_dir)).select("term", "a", "n")
    new = terms.where(F.col("a").startswith("src1-") & (F.col("n") % 2 == 0)).withColumn("n", -F.col("n"))
    return A.as_dictionary(A.replace_volume(terms, new, "src1")).select("term", F.size("entries").cast("long").alias("n_entries"), F.array_min(F.transform("entries", lambda e: e["n"])).alias("least"), F.array_max(F.transform("entries", lambda e: e["n"])).alias("most"))


@query(f"""
WITH {_SEG}, b AS (SELECT id, volume, title, list_concat(orig, trans, [ls1]) AS x, seg FROM (SELECT *, orig[1] AS ls1 FROM s)), f AS (SELECT id, volume, title, seg, unnest(x) AS line, unnest(range(len(x))) AS k FROM b)
SELECT id, volume, title, md5(string_agg(line, chr(10) ORDER BY seg, k)) AS body FROM f GROUP BY id, volume, title
""")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search_text(segments(spark, sf_dir)).select("id", "volume", "title", F.md5("body").alias("body"))


@query(f"""
WITH {_SEG}, b AS (SELECT id, volume, title, list_concat(orig, trans, [ls1]) AS x, seg FROM (SELECT *, orig[1] AS ls1 FROM s)), f AS (SELECT id, volume, title, seg, unnest(x) AS line, unnest(range(len(x))) AS k FROM b)
, w AS (SELECT id, volume, title, string_agg(line, chr(10) ORDER BY seg, k) AS body FROM f GROUP BY id, volume, title)
SELECT volume, count(*) AS n, count(DISTINCT md5(body)) AS n_bodies, sum(len(body))::BIGINT AS n_chars FROM w GROUP BY volume
""")
def search_corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search corpus written as JSON lines by volume, read again, kept, and counted twice over."""
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    A.write_search_text(segments(spark, sf_dir), path)
    corpus = A.held(spark.read.schema("id string, title string, body string, volume string").json(path))
    bodies = corpus.groupBy("volume").agg(F.count_distinct(F.md5("body")).alias("n_bodies"))
    return corpus.groupBy("volume").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("n_chars")).join(bodies, "volume").select("volume", "n", "n_bodies", "n_chars")


@query("""
WITH k AS (SELECT doc_id % 7 AS w FROM documents WHERE text IS NOT NULL) SELECT count_if(w NOT IN (1, 2)) AS articles, count_if(w = 1) AS broken, count_if(w = 2) AS no_id FROM k
""")
def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, of which some break off and some have no id: what is read, and what is kept apart."""
    path, k = f"{shared_dir(spark)}/mixed-{uuid.uuid4().hex}", F.col("doc_id") % 7
    line = F.to_json(F.struct(F.when(k != 2, F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("title")))
    table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.when(k == 1, F.left(line, F.length(line) - 2)).otherwise(line).alias("value")).write.text(path)
    found = A.scanned(spark, path, "id string, title string, _corrupt_record string")
    bad = A.quarantined(found).agg(F.count_if(F.col("reason") == "broken").alias("broken"), F.count_if(F.col("reason") == "no id").alias("no_id"))
    return A.sound(found).agg(F.count("id").alias("articles")).crossJoin(bad)  # one row each


@query(f"""
WITH {_SEG}, t AS (SELECT DISTINCT term FROM s WHERE term <> ''), h AS (SELECT doc_id, term, strpos(text, term) AS p FROM documents, t WHERE contains(text, term))
SELECT doc_id, count(*) AS n_terms, sum(p)::BIGINT AS places, max(len(term))::INT AS longest FROM h GROUP BY doc_id
""")
def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each term of the whole dictionary in each document."""
    found = terms.occurrences(table(spark, sf_dir, "documents"), A.term_dictionary(segments(spark, sf_dir)))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("at").alias("places"), F.max(F.length("term")).alias("longest"))


@query()
def dictionary_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the whole dictionary's terms between tags, longer ones first; tests compare with the marking of single texts."""
    docs = table(spark, sf_dir, "documents")
    spans = terms.marks(terms.occurrences(docs, A.term_dictionary(segments(spark, sf_dir))))
    out = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    return out.select("doc_id", F.size(F.coalesce("spans", F.array().cast("array<struct<at:int,n:int>>"))).alias("n_marks"), F.md5(terms.marked(F.col("text"), F.col("spans"))).alias("marked"))


@query(f"""
WITH {_SEG}, t AS (SELECT id, trim(regexp_replace(regexp_replace(orig[1], '\\[[0-9]{{1,3}}\\]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM s WHERE seg = 0) SELECT id, CASE WHEN len(t) <= 150 THEN t ELSE rtrim(left(t, 149)) || '…' END AS description FROM t
""")
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.description(segments(spark, sf_dir), "-")


_ESC = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""
WITH {_SEG}, h AS (SELECT id, string_agg('<p class="note"><span class="note-n">[' || (seg + 1) || ']</span><b>【' || {_ESC('term')} || '】</b>' || {_ESC('orig[1]')} || '</p>', chr(10) ORDER BY seg) AS n,
  string_agg(list_aggregate(list_concat(list_transform(orig, lambda p: '<p class="orig">' || regexp_replace({_ESC('p')}, '\\[([0-9]{{1,3}})\\]', '<sup>\\1</sup>', 'g') || '</p>'), list_transform(trans, lambda p: '<p class="trans">' || regexp_replace({_ESC('p')}, '\\[([0-9]{{1,3}})\\]', '<sup>\\1</sup>', 'g') || '</p>')), 'string_agg', ''), '' ORDER BY seg) AS b, any_value(title) AS title FROM s GROUP BY id)
SELECT id, md5('<section class="notes-sec"><h3>注 释</h3>' || n || '</section>') AS notes, md5('<h1>' || {_ESC('title')} || '</h1>' || b) AS body FROM h
""")
def article_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = segments(spark, sf_dir)
    notes = arts.select("id", F.md5(pages.notes_html(F.flatten(F.transform("segments", lambda s: s["notes"])))).alias("notes"))
    return notes.join(pages.body_html(arts).select("id", F.md5("html").alias("body")), "id")


@query("""
WITH c AS (SELECT c_mktsegment AS volume, c_nationkey AS j, c_custkey AS i, c_custkey::VARCHAR AS id, c_name AS title FROM customer), o AS (SELECT *, lag({'id': id, 'title': title}) OVER w AS p, lead({'id': id, 'title': title}) OVER w AS n FROM c WINDOW w AS (PARTITION BY volume ORDER BY j, i))
SELECT id, '<nav class="art-nav">' || CASE WHEN p IS NULL THEN '<span></span>' ELSE '<a href="/a/' || p.id || '/"><small>上一篇</small>' || p.title || '</a>' END || CASE WHEN n IS NULL THEN '<span></span>' ELSE '<a href="/a/' || n.id || '/"><small>下一篇</small>' || n.title || '</a>' END || '</nav>' AS nav,
  CASE WHEN i % 3 = 0 THEN '<section class="backrefs"><h3>引用</h3><a class="backref" href="/a/' || id || '/">' || title || CASE WHEN i % 2 = 0 THEN '<span class="br-n">2 则</span>' ELSE '' END || '</a></section>' ELSE '' END AS refs FROM o
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("volume"), F.col("c_nationkey").alias("j"), F.col("c_custkey").alias("i"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"))
    w, own = Window.partitionBy("volume").orderBy("j", "i"), F.struct("id", "title")
    refs = F.when(F.col("i") % 3 == 0, F.array(F.struct("id", "title", F.when(F.col("i") % 2 == 0, 2).otherwise(1).alias("n"))))
    placed = rows.withColumn("p", F.lag(own).over(w)).withColumn("x", F.lead(own).over(w))
    return placed.select("id", pages.nav_html(F.col("p"), F.col("x")).alias("nav"), pages.backrefs_html(refs, "引用").alias("refs"))


@query("""
WITH c AS (SELECT c_mktsegment AS volume, c_nationkey AS j, c_custkey AS i, c_custkey::VARCHAR AS id, c_name AS title FROM customer)
SELECT volume, md5('<ul>' || string_agg('<li><a href="/a/' || id || '/">' || title || '</a></li>', '' ORDER BY j, i) || '</ul>') AS html, count(*) AS n FROM c GROUP BY volume
""")
def volume_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("volume"), F.col("c_nationkey").alias("j"), F.lit(0).alias("c"), F.col("c_custkey").alias("i"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"))
    return pages.volume_pages(rows).select("volume", F.md5("html").alias("html")).join(rows.groupBy("volume").agg(F.count("*").alias("n")), "volume")


@query("""
SELECT 0 AS kind, '' AS k, '<url><loc>https://x.org/</loc><lastmod>2024-01-01</lastmod><priority>1.0</priority></url>' AS entry
UNION ALL SELECT DISTINCT 1, c_mktsegment, '<url><loc>https://x.org/v/' || c_mktsegment || '/</loc><lastmod>2024-01-01</lastmod><priority>0.9</priority></url>' FROM customer
UNION ALL SELECT 2, c_custkey::VARCHAR, '<url><loc>https://x.org/a/' || c_custkey || '/</loc><lastmod>2024-01-01</lastmod><priority>0.8</priority></url>' FROM customer
""")
def site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return pages.site_index(customers.select(F.col("c_custkey").cast("string").alias("id")), customers.select(F.col("c_mktsegment").alias("volume")).distinct(), "https://x.org", "2024-01-01")


@query("SELECT item_id::VARCHAR AS id, 'v' || (item_id % 3) AS volume, md5(text) AS body, 1::BIGINT AS n_segments FROM benchmark WHERE NOT (item_id % 3 = 1 AND item_id % 2 = 0)")
def articles_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON by volume, one volume written again without half of its articles, and read back."""
    path = f"{shared_dir(spark)}/articles-{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    segment = F.struct(F.array("text").alias("orig"), F.array().cast("array<string>").alias("trans"), F.array().cast(f"array<{A.NOTE}>").alias("notes"), none.alias("src"), none.alias("srcId"))
    made = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("v"), (F.col("item_id") % 3).cast("string")).alias("volume"), F.array(segment).alias("segments"), "item_id")
    A.write_json(made.drop("item_id"), path)
    A.write_json(made.where("item_id % 3 = 1 AND item_id % 2 = 1").drop("item_id"), path)
    return A.read_by_volume(spark, path).select("id", "volume", F.md5(F.get(F.get("segments", F.lit(0))["orig"], F.lit(0))).alias("body"), F.size("segments").cast("long").alias("n_segments"))


@query("SELECT item_id::VARCHAR AS id, 1::INT AS segs FROM benchmark WHERE item_id % 2 = 0")
def index_driven_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intermediate articles as JSON files by id; an index says which of them are read."""
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    made = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.array(F.struct(F.col("text").alias("o"))).alias("segments"), F.col("item_id").cast("string").alias("key"))
    made.write.partitionBy("key").json(path)
    index = table(spark, sf_dir, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").cast("string").alias("key"))
    return A.read_indexed(spark, path, index).select("id", F.size("segments").alias("segs"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as intermediate articles: the length of a line says what kind of segment it is."""
    each = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    none, no = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def part(x):
        kind = F.length(x) % 5
        o = F.when((kind == 2) | (kind == 3), x).otherwise(none)
        t = F.when((kind == 2) | (kind == 4), x).otherwise(none)
        os, ts = F.when(kind == 1, F.array(x, x)).otherwise(no), F.when(kind == 1, F.array(x)).otherwise(no)
        return F.struct(o.alias("o"), t.alias("t"), os.alias("os"), ts.alias("ts"), none.alias("src"), F.when(kind == 0, 1).alias("n"), F.when(kind == 0, F.concat(F.lit("【词】"), x)).alias("note"))

    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND source IS NOT NULL")
    return docs.select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("id"), F.transform(each, part).alias("segments"))


@query(f"""
WITH {_SEG.split(', s AS')[0]}, e AS (SELECT id, unnest(ls) AS x, unnest(range(len(ls))) AS pos FROM d), k AS (SELECT *, CASE len(x) % 5 WHEN 0 THEN 'note' WHEN 1 THEN 'block' WHEN 2 THEN 'pair' WHEN 3 THEN 'orig' ELSE 'trans' END AS kind FROM e)
, f AS (SELECT *, (kind <> 'note' AND (kind IS DISTINCT FROM lag(kind) OVER w OR kind = 'block'))::INT AS new FROM k WINDOW w AS (PARTITION BY id ORDER BY pos)), g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS grp FROM f)
SELECT id, grp::BIGINT AS grp, (coalesce(sum(CASE kind WHEN 'block' THEN 2 WHEN 'pair' THEN 1 WHEN 'orig' THEN 1 END), 0))::INT AS n_orig, (coalesce(sum(CASE kind WHEN 'block' THEN 1 WHEN 'pair' THEN 1 WHEN 'trans' THEN 1 END), 0))::INT AS n_trans,
  coalesce(string_agg(CASE kind WHEN 'note' THEN x END, '|' ORDER BY pos), '') AS notes FROM g GROUP BY id, grp
""")
def regrouped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.regroup(parts(spark, sf_dir))
    notes = F.array_join(F.transform("notes", lambda x: x["text"]), "|")
    return out.select("id", F.col("group").alias("grp"), F.size("orig").alias("n_orig"), F.size("trans").alias("n_trans"), notes.alias("notes"))


@query(f"""
WITH {_SEG.split(', s AS')[0]}, e AS (SELECT id, unnest(ls) AS x FROM d) SELECT id, count(CASE WHEN NOT (len(x) % 3 = 0) THEN 1 END)::INT AS n_kept, count(*)::INT AS n FROM e GROUP BY id
""")
def note_headers_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    none = F.lit(None).cast("string")
    part = lambda x: F.struct(F.when(F.length(x) % 3 == 0, "【注 释】").otherwise(x).alias("o"), none.alias("t"), F.lit(None).cast("array<string>").alias("os"), F.lit(None).cast("int").alias("n"))
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND source IS NOT NULL").select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("id"), F.transform(each, part).alias("segments"))
    return docs.where(F.size("segments") > 0).select("id", F.size(entries.without_note_headers("segments")).alias("n_kept"), F.size("segments").alias("n"))


@query("WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), e AS (SELECT item_id::VARCHAR AS file, unnest(w) AS text, unnest(range(len(w))) AS pos FROM b) SELECT file, pos::INT AS pos, trim(text) AS text, CASE WHEN pos = 0 THEN 'TOC1' END AS style, pos % 2 = 0 AS first_bold, pos % 2 = 0 AND len(trim(text)) >= 1 AS bold FROM e")
def docx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files made of the words of the benchmark, a paragraph each, and read as such; every other word is bold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.sax.saxutils import escape

        for f in frames:
            files = []
            for text in f["text"]:
                body = ""
                for k, word in enumerate(text.split(" ")):
                    style = '<w:pPr><w:pStyle w:val="TOC1"/></w:pPr>' if k == 0 else ""
                    body += f'<w:p>{style}<w:r>{"<w:rPr><w:b/></w:rPr>" if k % 2 == 0 else ""}<w:t xml:space="preserve">{escape(word)}</w:t></w:r></w:p>'
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{docx.W[1:-1]}"><w:body>{body}</w:body></w:document>')
                files.append(out.getvalue())
            yield pd.DataFrame({"path": f["item_id"].astype(str), "content": files})

    made = table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(run, "path string, content binary")
    return docx.paragraphs_of(made).select("file", "pos", "text", "style", "first_bold", "bold")


@query(f"""
WITH {_SEG}, x AS (SELECT id, title, list({{'o': list_concat(orig, trans), 'k': seg}} ORDER BY seg) AS a FROM s GROUP BY id, title), l AS (SELECT id, title AS lt, list_transform(a, lambda e: e.o) AS ls FROM x)
, r AS (SELECT id, CASE WHEN len(ls) % 3 = 0 THEN lt || '!' ELSE lt END AS rt, list_transform(CASE WHEN len(ls) % 4 = 1 THEN ls[1:len(ls) - 1] WHEN len(ls) % 4 = 2 THEN list_concat(ls, [['new']]) ELSE ls END,
    lambda g: CASE WHEN len(g[1]) % 5 = 0 THEN g[1:len(g) - 1] WHEN len(g[1]) % 5 = 1 THEN list_concat(g, ['more']) ELSE list_transform(g, lambda t: CASE WHEN len(t) % 7 = 0 THEN t || '?' ELSE t END) END) AS rs FROM l)
, b AS (SELECT * FROM l JOIN r USING (id)), z AS (SELECT id, i AS seg, ls[i] AS l, rs[i] AS r FROM (SELECT *, unnest(range(1, greatest(len(ls), len(rs)) + 1)) AS i FROM b))
, y AS (SELECT id, seg, j, l[j] AS l, r[j] AS r FROM (SELECT *, unnest(range(1, greatest(len(l), len(r)) + 1)) AS j FROM z WHERE l IS NOT NULL AND r IS NOT NULL))
, kinds AS (SELECT id, 'title_mismatch' AS kind FROM b WHERE lt <> rt UNION ALL SELECT id, 'segment_count' FROM b WHERE len(ls) <> len(rs) UNION ALL SELECT id, CASE WHEN l IS NULL THEN 'segment_missing_in_left' ELSE 'segment_missing_in_right' END FROM z WHERE l IS NULL OR r IS NULL
  UNION ALL SELECT id, 'orig_count' FROM z WHERE len(l) <> len(r) UNION ALL SELECT id, CASE WHEN l IS NULL THEN 'line_missing_in_left' WHEN r IS NULL THEN 'line_missing_in_right' ELSE 'content_diff' END FROM y WHERE l IS DISTINCT FROM r)
SELECT id, kind, count(*) AS n FROM kinds GROUP BY id, kind
""")
def article_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = segments(spark, sf_dir).select("id", "title", F.transform("segments", lambda s: F.concat(s["orig"], s["trans"])).alias("segments"))
    size = F.size("segments")
    some = F.when(size % 4 == 1, F.slice("segments", F.lit(1), size - 1)).when(size % 4 == 2, F.concat("segments", F.array(F.array(F.lit("new"))))).otherwise(F.col("segments"))
    changed = lambda g: F.when(F.length(F.get(g, F.lit(0))) % 5 == 0, F.slice(g, F.lit(1), F.size(g) - 1)).when(F.length(F.get(g, F.lit(0))) % 5 == 1, F.concat(g, F.array(F.lit("more")))).otherwise(F.transform(g, lambda t: F.when(F.length(t) % 7 == 0, F.concat(t, F.lit("?"))).otherwise(t)))
    right = left.select("id", F.when(size % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"), F.transform(some, changed).alias("segments"))
    return verification.compare_articles(left, right).groupBy("id", "kind").agg(F.count("*").alias("n"))


@query()
def char_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that make the lines of a document those of the next that begins alike, place by place; tests put them together again."""
    docs = table(spark, sf_dir, "documents")
    side = lambda key, line: lines.lines(docs).select(F.col("doc_id").alias(key), "pos", F.col("line").alias(line))
    both = alignment.neighbours(docs).join(side("a", "x"), "a").join(side("b", "y"), ["b", "pos"])
    return both.where("x <> y").select("a", "b", "pos", verification.opcodes("x", "y").alias("ops"))


@query("""
WITH e AS (SELECT doc_id AS id, doc_id FROM documents WHERE doc_id % 2 = 0), m AS (SELECT e.id FROM e LEFT JOIN labels l ON l.doc_id = e.doc_id WHERE l.doc_id IS NULL), t AS (SELECT p_type AS title, count(*) FILTER (WHERE p_size <= 30) - count(*) FILTER (WHERE p_size > 30) AS n FROM part GROUP BY p_type)
SELECT 'missing' AS kind, id::VARCHAR AS what, 1::BIGINT AS n FROM m UNION ALL SELECT 'unmatched', title, n FROM t WHERE n > 0
""")
def missing_and_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    gone = verification.missing(expected, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("title"), "p_size")
    left = verification.unmatched(part.where("p_size <= 30"), part.where("p_size > 30"))
    return gone.select(F.lit("missing").alias("kind"), F.col("id").cast("string").alias("what"), F.lit(1).cast("long").alias("n")).unionByName(left.select(F.lit("unmatched").alias("kind"), F.col("title").alias("what"), "n"))


@query(f"""
WITH {_SEG}, c AS (SELECT id, sum(len(orig)) AS o, sum(len(trans)) AS t, bool_or(len(orig) <> len(trans) AND len(trans) > 0) AS d, any_value(plain) AS p, any_value(volume) AS volume FROM s GROUP BY id)
, k AS (SELECT *, CASE WHEN p THEN 'plain' WHEN t = 0 THEN 'no_trans' WHEN d THEN 'mismatch' ELSE 'equal' END AS state FROM c), r AS (SELECT *, volume || ' ' || state AS g, row_number() OVER (PARTITION BY volume, state ORDER BY id) AS k FROM k)
SELECT g AS grp, count(*) AS total, string_agg(id, '|' ORDER BY id) FILTER (WHERE k <= 12) AS shown FROM r GROUP BY g
""")
def mismatch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = segments(spark, sf_dir).select("id", "volume", "plain", F.explode("segments").alias("s")).select("id", "volume", "plain", "s.orig", "s.trans")
    counted = verification.paragraph_counts(arts).join(arts.select("id", "volume").distinct(), "id").withColumn("grp", F.concat_ws(" ", "volume", "state"))
    out = verification.report(counted, "grp", ["id"], F.col("id"), 12)
    return out.select("grp", "total", F.array_join("shown", "|").alias("shown"))


@query("""
WITH v AS (SELECT n_name AS name, n_nationkey AS k FROM nation), c AS (SELECT c_custkey::VARCHAR AS id, c_nationkey AS volume, c_mktsegment AS category FROM customer)
SELECT id, n_name AS volume_name, 'r' || n_regionkey AS grp, n_nationkey::INT AS volume_pos, split_part(n_name || '·x', '·', 1) || ' · ' || category AS place FROM c JOIN nation ON n_nationkey = volume
""")
def articles_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    volumes = nation.select(F.col("n_nationkey").alias("volume"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("group"), F.col("n_nationkey").cast("int").alias("pos"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("volume"), F.col("c_mktsegment").alias("category"))
    items = rows.join(nation.select(F.col("n_nationkey").alias("volume"), F.concat("n_name", F.lit("·x")).alias("juan")), "volume").select("id", "juan", "category")
    out = catalogs.in_catalog(catalogs.with_volume(rows, volumes), items)
    return out.select("id", "volume_name", F.col("group").alias("grp"), "volume_pos", "place")


@query("""
WITH m AS (SELECT c_nationkey AS file, c_custkey AS pos, 'c' AS mark FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 's' FROM supplier) SELECT file, (row_number() OVER (PARTITION BY file ORDER BY pos, mark))::INT AS nth, pos, mark FROM m
""")
def marks_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("pos"), F.lit("c").alias("mark"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("pos"), F.lit("s").alias("mark"))
    return catalogs.merged_marks([a, b])


@query("""
WITH a AS (SELECT p_size AS file, p_type AS alias, p_name AS canon, p_partkey % 3 + 1 AS members, p_partkey AS ord FROM part) SELECT file, alias, canon, members, ord FROM a QUALIFY row_number() OVER (PARTITION BY file, alias ORDER BY members > 1 DESC, ord) = 1
""")
def preferred_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("file"), F.col("p_type").alias("alias"), F.col("p_name").alias("canon"), (F.col("p_partkey") % 3 + 1).alias("members"), F.col("p_partkey").alias("ord"))
    return catalogs.preferred(part, True)


@query("""
WITH n AS (SELECT user_id AS id, event_id % 7 AS n, md5(event_id::VARCHAR) AS text, event_id AS k FROM events) SELECT id, n, arg_min(text, k) AS text, count(*) - 1 AS duplicates FROM n GROUP BY id, n
""")
def first_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 7).alias("n"), F.col("event_id").alias("k"))
    return pages.first_notes(notes.withColumn("text", F.md5(F.col("k").cast("string"))))


@query(r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS t, list_filter(string_split(regexp_replace(text, '[^\p{L}]+', ' ', 'g'), ' '), lambda x: len(x) >= 6)[1] AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN w IS NOT NULL AND contains(t, w) THEN left(t, strpos(t, w) - 1) || '<b>' || w || '</b>' || substr(t, strpos(t, w) + len(w)) ELSE t END AS marked, md5(replace(t, 'the', '<mark>the</mark>')) AS every FROM d
""")
def marked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.get(F.filter(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " "), lambda x: F.length(x) >= 6), F.lit(0))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("t"), word.alias("w"))
    terms = F.array_compact(F.array("w", "w"))
    return docs.select("doc_id", pages.mark_terms(F.col("t"), terms).alias("marked"), F.md5(T.mark_all("t", "the")).alias("every"))


@query(f"""
WITH {_SEG}, t AS (SELECT id, string_agg(list_aggregate(CASE WHEN len(trans) > 0 THEN trans ELSE orig END, 'string_agg', ' '), ' ' ORDER BY seg) AS t FROM s GROUP BY id)
, c AS (SELECT id, trim(regexp_replace(regexp_replace(t, '\\[[0-9]{{1,3}}\\]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM t) SELECT id, md5(CASE WHEN len(t) <= 800 THEN t ELSE rtrim(left(t, 799)) || '…' END) AS answer FROM c
""")
def faq_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.faq_answer(segments(spark, sf_dir)).select("id", F.md5("answer").alias("answer"))


@query("""
SELECT c_custkey AS id, '{"@context":"https://schema.org","@type":"Article","headline":"' || c_name || ' \\u003cb>","description":"' || c_mktsegment || '","author":{"@type":"Person","name":"A"},' || CASE WHEN c_custkey % 2 = 0 THEN '"translator":{"@type":"Person","name":"' || c_name || '"},' ELSE '' END || '"mainEntityOfPage":"/a/' || c_custkey || '/"}' AS article,
  '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"home","item":"/"},{"@type":"ListItem","position":2,"name":"' || c_name || '","item":"/a/' || c_custkey || '/"}]}' AS crumbs,
  '{"@context":"https://schema.org","@type":"CollectionPage","name":"' || c_mktsegment || '","url":"/v/","numberOfItems":' || c_nationkey || '}' AS collection,
  '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"' || c_name || '?","acceptedAnswer":{"@type":"Answer","text":"' || c_mktsegment || '"}}]}' AS faq FROM customer
""")
def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, name, kind = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    url = T.article_path(k.cast("string"))
    return c.select(
        k.alias("id"), pages.article_ld(F.concat(name, F.lit(" <b>")), kind, url, "A", F.when(k % 2 == 0, name)).alias("article"),
        pages.breadcrumb_ld(F.array(F.struct(F.lit("home").alias("name"), F.lit("/").alias("url")), F.struct(name.alias("name"), url.alias("url")))).alias("crumbs"),
        pages.collection_ld(kind, F.lit("/v/"), F.col("c_nationkey")).alias("collection"), pages.faq_ld(F.array(F.struct(F.concat(name, F.lit("?")).alias("question"), kind.alias("answer")))).alias("faq"),
    )


_SQUASH = r"""regexp_replace(lower(raw), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}，。、；：？！“”‘’"''（）()·．\.,：「」『』《》〈〉—\-–…\[\]【】〇]', '', 'g')"""
_INDEX = f"""
{_SEG}, e AS (SELECT id, seg, unnest(range(len(orig))) AS i, unnest(orig) AS raw, unnest(CASE WHEN len(orig) = len(trans) THEN trans ELSE list_transform(orig, lambda x: NULL::VARCHAR) END) AS other FROM s)
, q AS (SELECT id, seg, i, {_SQUASH} AS line, other FROM e), li AS (SELECT id, row_number() OVER w - 1 AS nth, sum(len(line)) OVER w - len(line) AS start, len(line) AS n, line, other FROM q WHERE line <> '' WINDOW w AS (PARTITION BY id ORDER BY seg, i))
"""


@query(f"WITH {_INDEX} SELECT id, nth::INT AS nth, start::BIGINT AS start, n::INT AS n, md5(line) AS line, md5(coalesce(other, '-')) AS other FROM li")
def corpus_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = segments(spark, sf_dir).select("id", F.posexplode("segments").alias("seg", "s")).select("id", "seg", "s.orig", "s.trans")
    return lines.line_index(arts).select("id", "nth", "start", "n", F.md5("line").alias("line"), F.md5(F.coalesce("other", F.lit("-"))).alias("other"))


@query(f"WITH {_INDEX}, p AS (SELECT DISTINCT id, unnest(range(0, 2000, 97)) AS pos FROM li) SELECT p.id, pos::INT AS pos, max(nth)::INT AS nth FROM p JOIN li ON li.id = p.id AND start <= pos GROUP BY p.id, pos")
def line_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = segments(spark, sf_dir).select("id", F.posexplode("segments").alias("seg", "s")).select("id", "seg", "s.orig", "s.trans")
    index = lines.line_index(arts)
    asked = index.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(1999), F.lit(97))).alias("pos"))
    return lines.containing(asked, index).select("id", "pos", "nth")


@query(f"""
WITH {_SEG.split(', s AS')[0]}, e AS (SELECT id, unnest(ls) AS x FROM d), k AS (SELECT id, len(x) % 5 AS k FROM e)
SELECT id, (2 * count_if(k = 1) + count_if(k IN (2, 3)))::INT AS n_orig, (count_if(k IN (1, 2, 4)))::INT AS n_trans, (count_if(k = 0))::INT AS n_notes, (count_if(k = 1))::INT AS n_blocks FROM k GROUP BY id
""")
def segment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.kind_counts(parts(spark, sf_dir).where(F.size("segments") > 0))


@query("""
WITH a AS (SELECT c_custkey AS entry, c_name AS orig FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey AS entry, c_mktsegment AS trans FROM customer WHERE c_custkey % 4 > 0)
SELECT entry, orig, trans, CASE WHEN trans IS NULL THEN 'orig only' WHEN orig IS NULL THEN 'trans only' ELSE 'both' END AS state FROM a FULL OUTER JOIN b USING (entry)
""")
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return ingest.pair_files(c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("entry"), F.col("c_name").alias("text")), c.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("entry"), F.col("c_mktsegment").alias("text")))


@query("SELECT item_id::VARCHAR AS id, md5(text) AS body FROM benchmark WHERE item_id = 3")
def one_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    return A.one(made, "3").select("id", F.md5("text").alias("body"))
