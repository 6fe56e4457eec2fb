"""Queries over texts: normalisation, tokens, sentences, lines, chunks, snippets, emitted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chunking, segments
from textloom.plans.base import query, table

#: Unicode white space for RE2, which has no mode for it.
SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Marks that may end a chunk in these texts.
MARKS = ".;!?\n"


@query(r"""
SELECT doc_id, substr(text, greatest(strpos(text, 'with') - 22, 1), 1) AS first_char,
  CASE WHEN strpos(text, 'with') - 22 > 1 THEN '…' ELSE '' END ||
  replace(substr(text, greatest(strpos(text, 'with') - 22, 1), strpos(text, 'with') + 38 - greatest(strpos(text, 'with') - 22, 1)), chr(10), ' ') || '…' AS snippet
FROM documents WHERE contains(text, 'with') ORDER BY doc_id LIMIT 100
""")
def fulltext_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("with")).select("doc_id", "text").orderBy("doc_id").limit(100)
    first = F.substring("text", F.greatest(F.instr("text", "with") - 22, F.lit(1)), F.lit(1)).alias("first_char")
    return docs.select("doc_id", first, T.snippet("text", F.lit("with")).alias("snippet"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') ORDER BY p_partkey LIMIT 80")
def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").contains("ring")).select("p_partkey", "p_name").orderBy("p_partkey").limit(80)


@query("""
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, count(*) AS n_turns FROM conversations GROUP BY conv_id
""")
def search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return turns.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("body"), F.count("*").alias("n_turns"))


@query(rf"""
SELECT doc_id, md5(regexp_replace(text, '{SPACES}+', '', 'g')) AS squashed, md5(trim(regexp_replace(regexp_replace(text, '\[\d{{1,3}}\]', '', 'g'), '{SPACES}+', ' ', 'g'))) AS cleaned,
  substr(regexp_replace(text, '{SPACES}+', '', 'g'), 1, 80) AS key,
  len(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}，。、；：！？「」『』“”"''‘’（）()【】\[\]．·—\-…]', '', 'g'))::INT AS n_match
FROM documents
""")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.squash_ws("text")).alias("squashed"), F.md5(T.clean_text("text")).alias("cleaned"), T.clean_key("text").alias("key"), F.length(T.norm_match("text")).alias("n_match"))


@query("""
WITH n AS (SELECT DISTINCT p_size AS n FROM part WHERE p_size BETWEEN 1 AND 99), d AS (SELECT n, string_split('〇,一,二,三,四,五,六,七,八,九', ',') AS c FROM n)
SELECT n, CASE WHEN n = 10 THEN '十' WHEN n < 10 THEN c[n + 1] ELSE (CASE WHEN n // 10 = 1 THEN '' ELSE c[n // 10 + 1] END) || '十' || (CASE WHEN n % 10 = 0 THEN '' ELSE c[n % 10 + 1] END) END AS cn, n AS back
FROM d
""")
def cn_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").where("p_size BETWEEN 1 AND 99").select(F.col("p_size").alias("n")).distinct()
    return n.withColumn("cn", T.num_to_cn("n")).withColumn("back", T.cn_to_num("cn"))


@query(rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?…\n]*[。！？!?…][」』）)】》”’]*|[^。！？!?…\n]+'),
  lambda x: regexp_replace(x, '^{SPACES}+|{SPACES}+$', '', 'g')), lambda x: regexp_matches(x, '[一-鿿A-Za-z0-9]')) AS s FROM documents)
SELECT doc_id, len(s)::INT AS n_units, md5(array_to_string(s, '|')) AS units FROM s
""")
def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(T.sentences("text"))).alias("s"))
    return docs.select("doc_id", F.size("s").alias("n_units"), F.md5(F.array_join("s", "|")).alias("units"))


#: CTEs up to p (doc_id, part, chunk, ctx): chunks of documents; parts count blank ones too.
CHUNKS = rf"""
d AS (SELECT doc_id, regexp_replace(text, '^{SPACES}+|{SPACES}+$', '', 'g') AS t FROM documents), c AS (
  SELECT doc_id, t, 0 AS part, 0 AS s, CASE WHEN len(t) <= 720 THEN len(t) ELSE 0 END AS e0 FROM d WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, part + 1, greatest(s + 1, e - 80), 0 FROM (
    SELECT *, CASE WHEN s + 720 >= len(t) THEN len(t) ELSE s + CASE WHEN cut > 324 THEN cut + 1 ELSE 720 END END AS e FROM (
      SELECT *, len(regexp_extract(substr(t, s + 1, 720), '(?s)^.*[.;!?\n]')) - 1 AS cut FROM c)
  ) WHERE e < len(t)
), x AS (
  SELECT *, CASE WHEN s + 720 >= len(t) THEN len(t) ELSE s + CASE WHEN cut > 324 THEN cut + 1 ELSE 720 END END AS e FROM (
    SELECT *, len(regexp_extract(substr(t, s + 1, 720), '(?s)^.*[.;!?\n]')) - 1 AS cut FROM c)
), p AS (SELECT doc_id, part, regexp_replace(substr(t, s + 1, e - s), '^{SPACES}+|{SPACES}+$', '', 'g') AS chunk, left(t, 1100) AS ctx FROM x)
"""


@query(f"""
WITH RECURSIVE {CHUNKS}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INT AS part, len(chunk)::INT AS n_chars, md5(chunk) AS chunk_md5, md5(ctx) AS ctx_md5 FROM p WHERE chunk <> ''
""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), marks=MARKS)
    return chunks.select("doc_id", "part", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"), F.md5("ctx").alias("ctx_md5"))


@query(r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)
SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM t
""")
def bigram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(T.bigrams("text"))).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


@query(f"""
WITH l AS ({LINES}), h AS (SELECT *, len(list_filter(string_split(trim(line), ' '), lambda x: x <> '')) BETWEEN 1 AND 3 AS head FROM l)
, i AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM h)
SELECT doc_id, no::BIGINT AS section, min(pos)::INT AS start, count(*) AS n_lines, max(CASE WHEN head THEN line END) AS heading FROM i GROUP BY doc_id, no
""")
def heading_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segments.lines(table(spark, sf_dir, "documents"))
    head = F.size(F.array_remove(F.split(F.trim("line"), " "), "")).between(1, 3)
    marked = segments.islands(lines.withColumn("head", head), F.col("head"), ["doc_id"], ["pos"], "section")
    return marked.groupBy("doc_id", "section").agg(F.min("pos").alias("start"), F.count("*").alias("n_lines"), F.max(F.when(F.col("head"), F.col("line"))).alias("heading"))


@query(f"""
WITH l AS ({LINES}), n AS (SELECT *, len(regexp_replace(line, '{SPACES}+', '', 'g')) AS n FROM l)
SELECT doc_id, pos::INT AS pos, (sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n)::BIGINT AS start, n::INT AS n FROM n WHERE n > 0
""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.line_offsets(segments.lines(table(spark, sf_dir, "documents"))).select("doc_id", "pos", "start", "n")


@query(f"""
WITH l AS ({LINES}), c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS back FROM l WHERE doc_id % 3 > 0 OR pos % 5 <> 4 GROUP BY doc_id)
SELECT doc_id, regexp_replace(back, '{SPACES}+', '', 'g') = regexp_replace(text, '{SPACES}+', '', 'g') AS same, len(regexp_replace(back, '{SPACES}+', '', 'g'))::INT AS n FROM documents JOIN c USING (doc_id)
""")
def reconstruct_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against their lines, of which every third document has lost some."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return segments.reconstruct(docs, segments.lines(docs).where("doc_id % 3 > 0 OR pos % 5 <> 4")).select("doc_id", "same", "n")


@query(r"""
WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r\x0B\f')), lambda x: x <> '')) AS l FROM documents)
, k AS (SELECT doc_id, CASE WHEN regexp_matches(l, '^#{1,6}\s+') THEN 'heading' WHEN regexp_matches(l, '^\d+[.、)]\s*') THEN 'num' WHEN regexp_matches(l, '^[-*•]\s+') THEN 'bullet' ELSE 'para' END AS kind, l FROM l)
SELECT doc_id, kind, count(*) AS n, sum(len(l))::BIGINT AS n_chars FROM k GROUP BY doc_id, kind
""")
def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    lines = docs.select("doc_id", T.strip("l").alias("l")).where("l <> ''").withColumn("kind", F.get(T.line_blocks("l"), F.lit(0))["kind"])
    return lines.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("l")).alias("n_chars"))


_WORDS = {"en": ("the", "and", "of"), "fr": ("que", "les", "est"), "de": ("der", "und", "die"), "es": ("que", "los", "una")}
_DENSITY = " ".join(
    f"WHEN lang = '{lang}' THEN ({' + '.join(f'(len(text) - len(replace(text, {chr(39)}{w}{chr(39)}, {chr(39)}{chr(39)}))) / {len(w)}.0' for w in words)}) / greatest(len(text), 1)" for lang, words in _WORDS.items()
)


@query(f"SELECT doc_id, lang, round(CASE {_DENSITY} END, 6) AS density, round(CASE {_DENSITY} END, 6) >= 0.006 AS modern FROM documents")
def function_word_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    density = F.coalesce(*[F.when(F.col("lang") == lang, T.marker_density("text", words)) for lang, words in _WORDS.items()])
    return docs.select("doc_id", "lang", F.round(density, 6).alias("density")).withColumn("modern", F.col("density") >= 0.006)


@query("""
SELECT page_id, '{"@context":"https://schema.org","@type":"WebPage","url":"' || url || '","path":"/a/' || page_id || '/","n_bytes":' || strlen(html) || ',"safe":' || replace(to_json(html)::VARCHAR, '<', '\\u003c') || ',"text":"' || trim(regexp_replace(html, '<[^>]*>|[^A-Za-z0-9]+', ' ', 'g')) || '"}' AS jsonld FROM pages
""".replace("\\\\u", "\\u"))
def jsonld_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    body = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("WebPage").alias("@type"),
        "url",
        T.article_path(F.col("page_id").cast("string")).alias("path"),
        F.octet_length("html").alias("n_bytes"),
        F.col("html").alias("safe"),
        F.trim(F.regexp_replace("html", "<[^>]*>|[^A-Za-z0-9]+", " ")).alias("text"),
    )
    return pages.select("page_id", F.replace(F.to_json(body), F.lit("<"), F.lit("\\u003c")).alias("jsonld"))


@query("""
SELECT page_id, CASE WHEN contains(html, 'data-kind="faq"') THEN 'present' WHEN contains(html, '</head>') THEN 'injected' ELSE 'no head' END AS status,
  md5(CASE WHEN contains(html, 'data-kind="faq"') OR NOT contains(html, '</head>') THEN html ELSE
    substr(html, 1, strpos(html, '</head>') - 1) || '<script data-kind="faq"></script>' || substr(html, strpos(html, '</head>')) END) AS page FROM pages
""")
def html_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    from textloom.operators.documents import inject

    return inject(pages, "html", '<script data-kind="faq"></script>', 'data-kind="faq"').select("page_id", "status", F.md5("html").alias("page"))


@query("""
SELECT event_id, (regexp_extract('noise ' || props || ' tail', '(\\{.*\\})', 1)::JSON->>'k')::INT AS k FROM events
""".replace("\\\\", "\\"))
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("noise "), "props", F.lit(" tail")).alias("raw"))
    return noisy.select("event_id", F.from_json(T.json_body("raw"), "k int")["k"].alias("k"))


@query(rf"""
WITH b AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '\. ', ' （以上 卷.一 ' || doc_id || '） ◎', 'g'), ', ', chr(10) || '◎ ', 'g'), '（以上{SPACES}*([^）]*)）', chr(10) || '§\1' || chr(10), 'g'), chr(10)) AS s FROM documents WHERE text IS NOT NULL)
, e AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS p FROM b)
, t AS (SELECT *, first_value(CASE WHEN starts_with(s, '§') THEN replace(regexp_replace(substr(s, 2), '{SPACES}+', '', 'g'), '.', '·') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sec FROM e)
, n AS (SELECT doc_id, p, coalesce(sec, '其他') AS sec, regexp_replace(s, '^{SPACES}+|{SPACES}+$', '', 'g') AS s FROM t WHERE NOT starts_with(s, '§'))
, w AS (SELECT doc_id, p, sec, starts_with(s, '◎') AS m, list_filter(regexp_split_to_array(regexp_replace(s, '^◎+', ''), '{SPACES}+'), lambda x: x <> '') AS w FROM n), x AS (SELECT doc_id, p, sec, m, unnest(w) AS name, unnest(range(len(w))) AS i FROM w)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p, i) - 1)::INT AS pos, sec, name, m AND i = 0 AS marked FROM x
""")
def reading_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.documents import reading_list

    end = F.concat(F.lit(" （以上 卷.一 "), F.col("doc_id").cast("string"), F.lit("） ◎"))
    body = F.replace(F.replace("text", F.lit(". "), end), F.lit(", "), F.lit("\n◎ "))
    return reading_list(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", body.alias("body")), "doc_id", "body")


@query("""
WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size % 5 >= 2 THEN p_size % 5 ELSE 1 END AS n FROM part), i AS (SELECT *, unnest(range(1, n + 1)) AS i FROM p)
, c AS (SELECT p_partkey, n, i, CASE WHEN n >= 2 THEN p_name || '（' || ['一', '二', '三', '四'][i] || '）' ELSE p_name END AS canon, p_name FROM i)
, a AS (SELECT *, unnest(CASE WHEN n < 2 THEN [canon] WHEN i = 1 THEN [canon, p_name || ['一', '二', '三', '四'][i], p_name] ELSE [canon, p_name || ['一', '二', '三', '四'][i]] END) AS alias FROM c)
SELECT p_partkey, alias, canon, n::INT AS group_size FROM a
""")
def toc_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.documents import expand_titles

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 5 >= 2, F.col("p_size") % 5).otherwise(1).alias("n"))
    return expand_titles(part, "p_name", "n").select("p_partkey", "alias", "canon", F.col("n").alias("group_size"))


@query("""
SELECT l_partkey, l_orderkey, count(*) AS n_refs, min(l_linenumber)::INT AS first_line FROM lineitem GROUP BY l_partkey, l_orderkey
""")
def backrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem")
    return edges.groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("n_refs"), F.min("l_linenumber").alias("first_line"))


@query("""
WITH t AS (SELECT doc_id, unnest(x) AS term, unnest(range(len(x))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS x FROM documents))
SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n, min(doc_id) AS first_doc FROM t GROUP BY term
""".replace("\\\\", "\\"))
def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the documents, with where it is met first; counted within documents before it is shuffled."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.bigrams("text")).alias("term"))
    each = tokens.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""
WITH c AS (SELECT n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey)
SELECT r_name, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INT AS pos, n_name, coalesce(c.n, 0)::BIGINT AS n_items
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN c USING (n_nationkey)
""")
def catalog_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators import catalogs

    tree = catalogs.nest(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"))
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    flat = catalogs.flatten(tree).join(counts, "n_nationkey", "left")
    return flat.select("r_name", "pos", "n_name", F.coalesce("n", F.lit(0)).alias("n_items"))


@query("""
SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"))


@query("""
WITH k AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation WHERE n_nationkey <> 20)
SELECT n_nationkey, n_name, (CASE WHEN p >= 3 THEN p + 1 ELSE p END)::INT AS pos FROM k UNION ALL SELECT 20, 'NATION_20 (new)', 3
""")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators import catalogs

    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = spark.range(1).select(F.lit(20).cast("int").alias("n_nationkey"), F.lit("NATION_20 (new)").alias("n_name"))
    return catalogs.upsert_at(nations, new, "n_nationkey", 3)
