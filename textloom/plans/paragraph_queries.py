"""Queries of ingest: the turns of a conversation stand for the paragraphs of a file, in their order; user turns are bold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import contents, entries, ingest, pages
from textloom.plans.base import query, table

_P = "p AS (SELECT conv_id AS file, turn AS pos, text, role = 'user' AS bold, len(text) AS n FROM conversations)"


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("pos"), "text", (F.col("role") == "user").alias("bold"), F.length("text").alias("n"))


def every(k: int, at: int = 0):
    return F.col("n") % k == at


@query(f"WITH {_P}, m AS (SELECT *, max(CASE WHEN n % 4 = 0 THEN pos END) OVER (PARTITION BY file) AS l FROM p) SELECT file, pos FROM m WHERE l IS NULL OR pos > l")
def toc_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    styled = paras(spark, sf_dir).withColumn("style", F.when(every(4), "TOC 1").otherwise("Normal"))
    return ingest.after_contents(styled).select("file", "pos")


@query(f"""
WITH {_P}, t AS (SELECT *, CASE WHEN n % 3 = 0 THEN '第一章' ELSE text END AS x FROM p WHERE NOT contains(text, 'PAGE'))
, m AS (SELECT *, sum((x = '第一章')::INT) OVER (PARTITION BY file ORDER BY pos) AS k FROM t) SELECT file, pos FROM m WHERE k >= 2
""")
def second_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras(spark, sf_dir).withColumn("text", F.when(every(3), "第一章").otherwise(F.col("text")))
    return ingest.from_second(ingest.without_page_fields(rows), "第一章").select("file", "pos")


@query(rf"""
WITH {_P}, t AS (SELECT file, pos, CASE n % 5 WHEN 0 THEN '版权所有' WHEN 1 THEN pos::VARCHAR || ' ' WHEN 2 THEN '电话：12345' ELSE text END AS x FROM p)
SELECT file, pos FROM t WHERE x NOT IN ('版权所有', '目录') AND NOT regexp_matches(x, '^\d+\s*$|^电话')
""")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(every(5), "版权所有").when(every(5, 1), F.concat(F.col("pos").cast("string"), F.lit(" "))).when(every(5, 2), "电话：12345").otherwise(F.col("text"))
    return ingest.drop_noise(paras(spark, sf_dir).withColumn("text", text), ["版权所有", "目录"], ["^电话"]).select("file", "pos")


@query(f"""
WITH {_P}, a AS (SELECT *, n % 5 = 0 AND coalesce(bool_or(n % 3 = 0) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), false) AS a FROM p)
, s AS (SELECT *, min(CASE WHEN a THEN pos END) OVER (PARTITION BY file) AS s FROM a) SELECT file, pos FROM s WHERE pos >= s
""")
def anchored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.anchored(paras(spark, sf_dir), every(5), every(3)).select("file", "pos")


@query(f"""
WITH {_P}, k AS (SELECT *, CASE WHEN n % 3 = 1 THEN 'o' WHEN n % 4 = 1 THEN 's' END AS k FROM p WHERE n % 7 <> 0)
, f AS (SELECT file, pos, list(k ORDER BY pos) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS l FROM k)
SELECT file, pos, coalesce(list_filter(l, lambda x: x IS NOT NULL)[1] = 'o', false) AS follows FROM f
""")
def origin_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.origin_follows(paras(spark, sf_dir), ~every(7), every(3, 1), every(4, 1)).select("file", "pos", "follows")


@query(f"""
WITH {_P}, h AS (SELECT *, max(CASE WHEN n % 3 = 0 THEN pos END) OVER (PARTITION BY file ORDER BY pos) AS h FROM p)
SELECT h.file, h.pos FROM h LEFT JOIN p q ON q.file = h.file AND q.pos = h.h WHERE h.h IS NULL OR q.n % 2 = 1
""")
def skip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.excluded_between(paras(spark, sf_dir), every(3), every(2)).select("file", "pos")


@query(f"""
WITH {_P}, t AS (SELECT file, pos, CASE WHEN n % 2 = 0 THEN n % 9 + pos END AS k FROM p) SELECT file, pos, k::INT AS n, (max(k) OVER (PARTITION BY file ORDER BY pos))::INT AS entry FROM t
""")
def numbered_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras(spark, sf_dir).withColumn("text", F.when(every(2), F.concat((F.col("n") % 9 + F.col("pos")).cast("string"), F.lit("、text"))).otherwise(F.col("text")))
    return ingest.number_entries(rows).select("file", "pos", "n", "entry")


@query(f"""
WITH RECURSIVE {_P}, t AS (SELECT file, pos, CASE WHEN n % 4 > 0 THEN n % 4 END AS k, row_number() OVER (PARTITION BY file ORDER BY pos) AS r FROM p)
, s AS (SELECT file, pos, r, (k = 1) IS TRUE AS accepted, CASE WHEN k = 1 THEN 1 ELSE 0 END AS last FROM t WHERE r = 1
  UNION ALL SELECT t.file, t.pos, t.r, (t.k = s.last + 1) IS TRUE, CASE WHEN t.k = s.last + 1 THEN t.k ELSE s.last END FROM s JOIN t ON t.file = s.file AND t.r = s.r + 1)
SELECT file, pos, accepted FROM s
""")
def consecutive_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras(spark, sf_dir).withColumn("n", F.when(F.col("n") % 4 > 0, F.col("n") % 4))
    return ingest.consecutive(rows).select("file", "pos", "accepted")


@query(f"""
WITH {_P}, m AS (SELECT *, CASE WHEN n % 7 = 0 THEN '卷' || (n % 3) WHEN n % 7 = 1 THEN '书' END AS k FROM p)
SELECT file, pos, last_value(CASE WHEN n % 7 = 0 THEN k END IGNORE NULLS) OVER w AS juan, last_value(CASE WHEN n % 7 = 1 THEN k END IGNORE NULLS) OVER w AS cat FROM m WINDOW w AS (PARTITION BY file ORDER BY pos)
""")
def filled_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    juan, cat = F.when(every(7), F.concat(F.lit("卷"), (F.col("n") % 3).cast("string"))), F.when(every(7, 1), "书")
    return ingest.fill_forward(paras(spark, sf_dir), {"juan": juan, "cat": cat}).select("file", "pos", "juan", "cat")


@query(f"""
WITH {_P}, s AS (SELECT *, sum((n % 4 = 0)::INT) OVER (PARTITION BY file ORDER BY pos) AS seq FROM p)
SELECT file, pos, seq::BIGINT AS seq, 'vol' || file || '-' || lpad(seq::VARCHAR, 3, '0') AS id FROM s WHERE seq > 0
""")
def opened_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras(spark, sf_dir).withColumn("name", F.concat(F.lit("/in/vol"), F.col("file").cast("string"), F.lit(".docx")))
    return ingest.open_articles(rows, every(4), "name").select("file", "pos", "seq", "id")


@query(f"""
WITH {_P}, b AS (SELECT *, bold AND coalesce(NOT lag(bold) OVER (PARTITION BY file ORDER BY pos), true) AS s FROM p), g AS (SELECT *, sum(s::INT) OVER (PARTITION BY file ORDER BY pos) AS seg FROM b)
SELECT file AS id, seg::BIGINT AS seg, md5(coalesce(string_agg(CASE WHEN bold THEN text END, chr(10) ORDER BY pos), '')) AS orig, md5(coalesce(string_agg(CASE WHEN NOT bold THEN text END, chr(10) ORDER BY pos), '')) AS trans FROM g GROUP BY file, seg
""")
def bold_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = ingest.segment_sides(paras(spark, sf_dir).withColumnRenamed("file", "id"))
    return sides.select("id", "seg", *[F.md5(F.array_join(c, "\n")).alias(c) for c in ("orig", "trans")])


@query(f"""
WITH {_P}, t AS (SELECT file, pos, row_number() OVER (PARTITION BY file ORDER BY pos) AS r, n % 3 = 0 AS fits, n, text FROM p)
, g AS (SELECT *, sum((fits OR r = 1)::INT) OVER (PARTITION BY file ORDER BY pos) AS k FROM t)
SELECT file AS id, k::BIGINT AS k, (CASE WHEN bool_or(fits) THEN max(CASE WHEN fits THEN n END) ELSE 0 END)::INT AS n, CASE WHEN bool_or(fits) THEN '词' END AS term, md5(string_agg(text, chr(10) ORDER BY pos)) AS body FROM g GROUP BY file, k
""")
def note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(every(3), F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]【词】"), "text")).otherwise(F.concat(F.lit("x"), "text"))
    notes = ingest.parse_notes(paras(spark, sf_dir).withColumn("text", text).withColumnRenamed("file", "id"))
    # the x that keeps other lines from looking like notes goes again
    return notes.select("id", "k", "n", "term", F.md5(F.regexp_replace("text", "(^|\n)x", "$1")).alias("body"))


@query(f"""
WITH {_P}, f AS (SELECT *, n % 5 = 0 AS h, n % 7 = 0 AS m FROM p), g AS (SELECT *, sum((m OR h OR coalesce(ph, true))::INT) OVER (PARTITION BY file ORDER BY pos) AS para FROM (SELECT *, lag(h) OVER (PARTITION BY file ORDER BY pos) AS ph FROM f))
SELECT file AS id, para::BIGINT AS para, md5(string_agg(text, '' ORDER BY pos)) AS body FROM g GROUP BY file, para
""")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.merge_lines(paras(spark, sf_dir).withColumnRenamed("file", "id"), every(5), every(7))
    return out.select("id", "para", F.md5("text").alias("body"))


@query(rf"""
WITH {_P}, w AS (SELECT file, pos, n, row_number() OVER (PARTITION BY file ORDER BY pos) AS k, count(*) OVER (PARTITION BY file) AS c, CASE WHEN n % 2 = 0 THEN text || '的这' ELSE text END AS t FROM p)
, d AS (SELECT *, len(t) AS l, {" + ".join(f"(len(t) - len(replace(t, '{w}', ''))) / {len(w)}" for w in T.FUNCTION_WORDS)} AS m FROM w)
, s AS (SELECT file, coalesce(sum(CASE WHEN k % 2 = 0 THEN m END) / nullif(sum(CASE WHEN k % 2 = 0 THEN l END), 0), 0) AS odd, coalesce(sum(CASE WHEN k % 2 = 1 THEN m END) / nullif(sum(CASE WHEN k % 2 = 1 THEN l END), 0), 0) AS even,
  coalesce(sum(CASE WHEN k > c / 2 THEN m END) / nullif(sum(CASE WHEN k > c / 2 THEN l END), 0), 0) AS late, coalesce(sum(CASE WHEN k <= c / 2 THEN m END) / nullif(sum(CASE WHEN k <= c / 2 THEN l END), 0), 0) AS early FROM d GROUP BY file)
SELECT file AS id, CASE WHEN odd >= 0.006 AND odd > 2 * even THEN 'interleaved' WHEN late >= 0.006 AND late > 2 * early THEN 'halves' ELSE 'lines' END AS layout FROM s
""")
def density_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras(spark, sf_dir).withColumn("text", F.when(every(2), F.concat("text", F.lit("的这"))).otherwise(F.col("text")))
    return ingest.interleaved(rows.withColumnRenamed("file", "id"))


@query(f"""
WITH {_P}, b AS (SELECT *, pos < coalesce(min(CASE WHEN NOT bold THEN pos END) OVER (PARTITION BY file), 1e9) AS lead, n % 4 = 0 AND NOT bold AS alone, n % 4 = 1 AS cited FROM p)
, s AS (SELECT *, CASE WHEN cited OR alone THEN '（《书》卷' || n || '）' END AS own FROM b), x AS (SELECT *, coalesce(own, lead(CASE WHEN alone THEN own END) OVER (PARTITION BY file ORDER BY pos)) AS src FROM s)
SELECT file AS id, md5(coalesce(string_agg(CASE WHEN lead THEN text END, chr(10) ORDER BY pos), '')) AS summary, count(CASE WHEN NOT lead THEN 1 END)::INT AS n_segments, string_agg(CASE WHEN NOT lead THEN coalesce(src, '-') END, '|' ORDER BY pos) AS srcs
FROM x WHERE NOT alone GROUP BY file
""")
def question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.concat(F.lit("（《书》卷"), F.col("n").cast("string"), F.lit("）"))
    lead = F.col("pos") < F.coalesce(F.min(F.when(~F.col("bold"), F.col("pos"))).over(Window.partitionBy("file")), F.lit(10**9))
    marked = paras(spark, sf_dir).withColumn("lead", lead)
    # the summary is made of texts as they are, so citations are put to the others only
    text = F.when(F.col("lead"), F.col("text")).when(every(4) & ~F.col("bold"), src).when(every(4, 1), F.concat("text", src)).otherwise(F.col("text"))
    parts = ingest.question_articles(marked.withColumn("text", text).withColumnRenamed("file", "id"))
    srcs = F.array_join(F.transform("segments", lambda s: F.coalesce(s["src"], F.lit("-"))), "|")
    return parts.select("id", F.md5("summary").alias("summary"), F.size("segments").alias("n_segments"), F.nullif(srcs, F.lit("")).alias("srcs"))


@query(f"""
WITH {_P}, c AS (SELECT file, pos, text, n % 3 AS chap, n % 2 AS sub FROM p), g AS (SELECT file, chap, sub, md5(string_agg(text, chr(10) ORDER BY pos)) AS orig, min(pos) AS f FROM c GROUP BY ALL)
SELECT file, chap, sub, orig, row_number() OVER (PARTITION BY file, chap ORDER BY f) = 1 AS with_intro FROM g
""")
def chapter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras(spark, sf_dir).withColumns({"chap": F.col("n") % 3, "sub": F.col("n") % 2})
    return ingest.chapters(rows).select("file", "chap", "sub", F.md5(F.array_join("orig", "\n")).alias("orig"), "with_intro")


@query(f"""
WITH {_P}, t AS (SELECT file, pos, n % 4 = 0 AS head, CASE WHEN n % 4 = 0 THEN '题' || (n % 8) WHEN n % 4 = 1 THEN '题0' ELSE text END AS x FROM p)
, c AS (SELECT *, last_value(CASE WHEN head THEN x END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM t) SELECT file, pos FROM c WHERE cur IS NULL OR cur <> x
""")
def repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(every(4), F.concat(F.lit("题"), (F.col("n") % 8).cast("string"))).when(every(4, 1), "题0").otherwise(F.col("text"))
    return pages.drop_repeated_titles(paras(spark, sf_dir).withColumn("text", text), every(4)).select("file", "pos")


@query(f"""
WITH {_P}, t AS (SELECT file, pos, CASE n % 4 WHEN 0 THEN '附' WHEN 1 THEN '录' ELSE text END AS x FROM p)
, f AS (SELECT *, coalesce(bool_or(x = '录') OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), false) AS a, coalesce(bool_or(x = '附') OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), false) AS b FROM t)
SELECT file, pos, md5(CASE WHEN x = '附' AND a THEN '附录' ELSE x END) AS body FROM f WHERE x <> '录' OR NOT b
""")
def lone_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras(spark, sf_dir).withColumn("text", F.when(every(4), "附").when(every(4, 1), "录").otherwise(F.col("text")))
    return pages.split_headings(rows, "附", "录").select("file", "pos", F.md5("text").alias("body"))


@query(f"""
WITH {_P}, t AS (SELECT *, n % 4 = 0 AS e, n % 5 = 0 AND n % 4 <> 0 AS m FROM p), b AS (SELECT *, coalesce(lag(e OR m) OVER (PARTITION BY file ORDER BY pos), true) AS before FROM t)
, g AS (SELECT *, sum((NOT e AND (before OR m))::INT) OVER (PARTITION BY file ORDER BY pos) AS grp FROM b) SELECT file AS id, pos, grp::BIGINT AS grp, m AS is_note FROM g WHERE NOT e
""")
def blank_line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras(spark, sf_dir).withColumn("text", F.when(every(4), " 　").otherwise(F.concat(F.lit("x"), "text"))).withColumnRenamed("file", "id")
    return entries.blank_groups(rows, every(5) & ~every(4)).select("id", "pos", F.col("group").alias("grp"), "is_note")


@query(f"""
WITH {_P}, s AS (SELECT *, min(CASE WHEN n % 5 = 0 THEN pos END) OVER (PARTITION BY file) AS a FROM p), i AS (SELECT *, min(CASE WHEN n % 6 = 1 AND n % 5 <> 0 THEN pos END) OVER (PARTITION BY file) AS z FROM s WHERE pos > a)
, k AS (SELECT * FROM i WHERE (z IS NULL OR pos < z) AND n % 5 <> 0) SELECT file, pos, coalesce(max((n % 4 = 0)::INT) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS preface FROM k
""")
def list_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(every(5), "《选读》一").when(every(6, 1), "一、终").when(every(4), "某某谨志").otherwise(F.concat(F.lit("x"), F.col("n").cast("string")))
    return entries.list_block(paras(spark, sf_dir).withColumn("text", text), "《选读》", "一、终", "谨志").select("file", "pos", "preface")


@query(f"WITH {_P}, s AS (SELECT *, min(CASE WHEN n % 9 = 0 THEN pos END) OVER (PARTITION BY file) AS s FROM p) SELECT file, pos FROM s WHERE n % 2 = 0 AND (s IS NULL OR pos >= s)")
def marks_after_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.active_marks(paras(spark, sf_dir), every(2), every(9)).select("file", "pos")


@query(f"WITH {_P} SELECT file AS id, bool_or(bold AND n % 4 <> 0 AND n % 5 <> 0 AND n % 7 <> 0) AS has_bold FROM p GROUP BY file")
def bold_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras(spark, sf_dir).withColumn("text", F.when(every(7), "【注 释】：").otherwise(F.concat(F.lit("x"), "text"))).withColumnRenamed("file", "id")
    return entries.content_bold(rows, every(4), every(5))


# texts of every kind that the predicates tell apart, one a row of parts; the SQL writes the patterns out again
_KINDS = [
    "卷第二", "书", "序一", "论", "与某居士书", "复某某先生书（民国二十年）", "挽联", "一、二。三", "【注释】", "注 ：", "1999年春", "（民国三年）", "妙真弟子", "译文：此", "12、问如何", "3.答", "42", "目录", "见[3]云云", "资料中没有相关内容",
]
_LINES = "k AS (SELECT p_partkey AS ref, [" + ", ".join(f"'{x}'" for x in _KINDS) + f"][p_partkey % {len(_KINDS)} + 1] || CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE '' END AS t, p_size % 2 = 0 AS bold FROM part)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.split(F.lit("\t".join(_KINDS)), "\t")
    text = F.concat(F.get(kinds, (F.col("p_partkey") % len(_KINDS)).cast("int")), F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), text.alias("text"), (F.col("p_size") % 2 == 0).alias("bold"))


_N = "replace(replace(regexp_replace(t, '\\s', '', 'g'), '(', '（'), ')', '）')"
_BARE = f"regexp_replace({_N}, '（[^）]*）', '', 'g')"
_BASE = f"regexp_replace({_BARE}, '[一二三四五六七八九十廿卅]+$', '')"


@query(f"""
WITH {_LINES}, a AS (SELECT ref, bold, t, {_N} AS n, {_BARE} AS core, {_BASE} AS base, regexp_replace(t, '\\s', '', 'g') AS s FROM k)
, b AS (SELECT *, base <> '' AND (contains('{T.TITLE_ENDS}', right(base, 1)) OR starts_with(base, '挽') OR regexp_matches(base, '^(书|论|序|记|疏|跋)[一二三四]?$')) AS title FROM a)
SELECT ref, regexp_full_match(n, '{contents.JUAN}') AS juan, bold AND len(n) <= 8 AND regexp_full_match(n, '{contents.CATEGORY}') AS category, title AS titled,
  bold AND len(core) BETWEEN 4 AND 45 AND NOT regexp_matches(core, '[。，；：？！、]') AND NOT regexp_matches(n, '^[0-9【\\[]') AND title AS strict, s IN ('【注释】', '注释', '【注释】：', '注释：', '【注：】', '注：', '【注】') AS note_header,
  starts_with(t, '译文：') OR starts_with(t, '译文:') OR regexp_matches(t, '^[0-9]{{4}}年|^[（(]?民国|^[一-鿿]{{2,6}}弟子$') AS signed, regexp_matches(t, '^[0-9]+[、.]') AS numbered,
  regexp_matches(t, '\\[[0-9]{{1,2}}\\]') AS cited, contains(t, '没有相关') AS refusal, CASE WHEN len(s) BETWEEN 1 AND 14 THEN CASE WHEN regexp_matches(s, '^卷第?[一二三]$') THEN 'juan' WHEN s IN ('书', '论') THEN 'cat' END END AS marker FROM b
""")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators import evaluation

    t, bold = F.col("text"), F.col("bold")
    return lines(spark, sf_dir).select(
        "ref", contents.is_juan(t).alias("juan"), contents.is_category(t, bold).alias("category"), T.looks_like_title(T.norm_title(t)).alias("titled"), contents.could_be_title(t, bold).alias("strict"),
        entries.is_note_header(t).alias("note_header"), entries.is_signed(t).alias("signed"), ingest.is_numbered(t).alias("numbered"), evaluation.has_citation(t).alias("cited"), evaluation.is_refusal(t, "没有相关").alias("refusal"),
        ingest.marker_kind(t, "^卷第?[一二三]$", ["书", "论"]).alias("marker"),
    )


@query("SELECT doc_id, source FROM documents WHERE NOT regexp_matches(source, '^(src1|src3)$')")
def volumes_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.without_volumes(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["src1", "src3"])


@query(rf"""
WITH t AS (SELECT p_partkey AS ref, p_name AS a, reverse(p_name) AS b, '  《' || p_name || '》 序「' || (p_partkey % 7) || '」（注）' AS t, '中 文 ' || p_name || ' 词 语' AS w, p_name || '。（《书名' || p_partkey || '》卷一）' AS c,
  '# 标 [3]' || chr(10) || '- **' || p_name || '**' || chr(10) || '2、x' AS m, '增广印光法师文钞卷第' || p_size AS j, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN '王某译' WHEN 2 THEN '甲、乙译' ELSE '校审某' END AS tr, CASE p_size % 3 WHEN 0 THEN 'jx' WHEN 1 THEN 'jy' ELSE 'zg' END AS v, p_type FROM part)
SELECT ref, regexp_replace(t, '[\s《》「」『』〈〉]+', '', 'g') AS link, replace(replace(regexp_replace(t || '(x)', '\s+', '', 'g'), '(', '（'), ')', '）') AS title, '中文 ' || a || ' 词语' AS tidied, len(a) >= 6 AND right(a, 1) = right(p_type || a, 1) AS sub, a || '。' AS body, '（《书名' || ref || '》卷一）' AS src,
  trim(regexp_replace(regexp_replace(regexp_replace(m, '\[[0-9]{{1,2}}\]', '', 'g'), '[*#`>]+', '', 'g'), '(?m)^\s*(?:[-•]|[0-9]+[.、)])\s*', '', 'g')) AS spoken, '卷第' || regexp_extract(j, '[0-9]+$') AS part,
  CASE WHEN tr LIKE '%校审%' OR tr LIKE '%、%' OR tr LIKE '% %' THEN '' ELSE regexp_replace(tr, '译$', '') END AS translator, a AS nav, CASE v WHEN 'jx' THEN 'selected' WHEN 'jy' THEN 'jiayan' ELSE 'primary' END AS kind, CASE v WHEN 'jx' THEN 2 WHEN 'jy' THEN 1 ELSE 0 END AS priority,
  CASE WHEN a = b THEN NULL ELSE coalesce(list_filter(range(len(a)), lambda i: substr(a, i + 1, 1) <> substr(b, i + 1, 1))[1], len(a)) END AS differs, len(replace(a, ' ', '')) AS clen, a || '|' || ref || '|' || len(replace(a, ' ', '')) || '|' || left(a, 80) || '|' || right(a, 40) AS selection,
  round(len(replace(a, ' ', '')) / (len(replace(a, ' ', '')) + len(replace(p_type, ' ', ''))), 6) AS share, len(a) >= 10 AND len(p_type) >= 10 AS splits, a || ' ' || b AS lex FROM t
""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a, k, size = F.col("p_name"), F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("  《"), a, F.lit("》 序「"), (k % 7).cast("string"), F.lit("」（注）"))
    wide = F.concat(F.lit("中 文 "), a, F.lit(" 词 语"))
    cited = F.concat(a, F.lit("。（《书名"), k.cast("string"), F.lit("》卷一）"))
    marked = F.concat(F.lit("# 标 [3]\n- **"), a, F.lit("**\n2、x"))
    translator = F.when(size % 4 == 0, a).when(size % 4 == 1, "王某译").when(size % 4 == 2, "甲、乙译").otherwise("校审某")
    volume = F.when(size % 3 == 0, "jx").when(size % 3 == 1, "jy").otherwise("zg")
    runs = F.array(F.struct(a.alias("text"), F.lit(True).alias("bold")), F.struct(F.col("p_type").alias("text"), F.lit(False).alias("bold")))
    source = T.strip_source(cited)
    return part.select(
        k.alias("ref"), T.norm_link(text).alias("link"), T.norm_title(F.concat(text, F.lit("(x)"))).alias("title"), T.tidy(wide).alias("tidied"), T.is_subsequence(a, F.concat("p_type", a)).alias("sub"), source["body"].alias("body"), source["src"].alias("src"),
        T.speakable(marked).alias("spoken"), pages.short_part(F.concat(F.lit("增广印光法师文钞卷第"), size.cast("string"))).alias("part"), pages.clean_translator(translator).alias("translator"), pages.nav_title(F.concat(a, F.lit("（附录于后）"))).alias("nav"),
        T.source_type(volume).alias("kind"), T.source_priority(T.source_type(volume)).alias("priority"), T.first_difference(a, F.reverse(a)).alias("differs"), T.clen(a).alias("clen"), pages.selection_key(a, k, a).alias("selection"),
        F.round(T.bold_share(runs), 6).alias("share"), ingest.split_mixed(runs).isNotNull().alias("splits"), T.lex_text(F.concat(F.lit("（白话）"), a, F.lit("\n（白话）"), F.reverse(a))).alias("lex"),
    )


_CN = [("" if t == 0 else "" if t == 1 else T.NUMERALS[t]) + ("十" if t else "") + (T.NUMERALS[o] if o else "") for n in range(1, 100) for t, o in [divmod(n, 10)]]
_CNS = "[" + ", ".join(f"'{x}'" for x in _CN) + "]"


@query(f"""
WITH r AS (SELECT s_nationkey AS file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos, replace(replace(s_name, '#', ''), '0', '') || CASE s_suppkey % 4 WHEN 0 THEN '书（' || {_CNS}[s_suppkey % 30 + 1] || '）' WHEN 1 THEN '（附）' WHEN 2 THEN '记无翻译' ELSE '' END AS t, {_CNS} AS cn, s_suppkey % 30 + 1 AS m0, s_suppkey % 4 = 0 AS many FROM supplier)
, l AS (SELECT file, pos, t, cn, many AND m0 >= 2 AS grp, CASE WHEN many AND m0 >= 2 THEN m0 ELSE 1 END AS m, regexp_replace(t, '（[^）]*）$', '') AS b FROM r)
, e AS (SELECT *, unnest(range(1, m + 1)) AS i FROM l), c AS (SELECT *, CASE WHEN grp THEN b || cn[i] ELSE t END AS canon FROM e)
, a AS (SELECT file, canon, 1 AS members, unnest(CASE WHEN grp THEN [canon, b || '（' || cn[i] || '）', CASE WHEN i >= 20 THEN b || replace(replace(cn[i], '二十', '廿'), '三十', '卅') END, CASE WHEN i = 1 THEN b END]
  ELSE [t, regexp_replace(t, '（[^）]*）', '', 'g'), CASE WHEN starts_with(t, '附') THEN substr(t, 2) END, CASE WHEN ends_with(t, '无翻译') THEN left(t, len(t) - 3) END] END) AS alias FROM c
  UNION ALL SELECT file, b, m, t FROM l WHERE grp)
, u AS (SELECT DISTINCT file, alias, canon, members FROM a WHERE alias IS NOT NULL AND alias <> '')
SELECT file, canon, members::INT AS members, alias, (SELECT count(*) FROM c WHERE c.file = u.file AND c.canon = u.canon)::INT AS count FROM u
""")
def contents_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    many = F.concat(F.lit("书（"), T.num_to_cn(F.col("s_suppkey") % 30 + 1), F.lit("）"))
    end = F.when(F.col("s_suppkey") % 4 == 0, many).when(F.col("s_suppkey") % 4 == 1, "（附）").when(F.col("s_suppkey") % 4 == 2, "记无翻译").otherwise("")
    name = F.regexp_replace("s_name", "[#0]", "")
    made = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), pos.alias("pos"), F.concat(name, end).alias("title"))
    expected, aliases = contents.expected_titles(made)
    return aliases.join(expected.select("file", "canon", "count"), ["file", "canon"], "left").select("file", "canon", "members", "alias", F.coalesce("count", F.lit(0)).alias("count"))


@query()
def parsed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article parsing as a whole: expected titles are among the paragraphs, tests compare it with a plain loop."""
    rows = paras(spark, sf_dir)
    text = F.when(every(9), F.concat(F.lit("复某居士书"), T.num_to_cn(F.col("n") % 5 + 1))).when(every(9, 1), F.concat(F.lit("【译文】"), "text")).when(every(9, 2), "【注释】").when(every(19), "卷第二").otherwise(F.col("text"))
    titled = rows.withColumn("text", text)
    toc = rows.groupBy("file").agg(F.min("pos").alias("pos")).withColumn("title", F.lit("与某居士书（三）"))
    expected, aliases = contents.expected_titles(toc)
    out = contents.parse_articles(titled, expected, aliases)
    return out.select("file", "pos", "article", "seg", "role", F.array_join("canons", "|").alias("canons"), "how", F.md5("body").alias("body"))


@query()
def entry_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry books, one a conversation; tests compare the segmentation with what it is to be on a written-out book."""
    kind = F.when(every(11), "一编").when(every(11, 1), "二编").when(every(11, 2), "（一）小节").when(every(11, 3) | every(11, 4) | every(11, 5), F.concat(F.lit("【原文】"), "text"))
    kind = kind.when(every(11, 6) | every(11, 7), F.concat(F.lit("【译文】"), "text")).when(every(11, 8), "（《书》卷一）").otherwise(F.col("text"))
    rows = paras(spark, sf_dir).withColumn("text", kind).withColumns({"plain": F.lit(True), "follows": F.lit(False)})
    out = entries.parse(rows, entries.Book(["一编", "二编"]))
    return out.select("file", "seq", "title", "part", "raw", "kind", "item", F.md5("text").alias("body"), "src")


@query(f"""
WITH {_P}, b AS (SELECT *, n % 7 = 0 AS note, n % 7 = 1 AS mixed, n % 3 = 0 AND n % 7 <> 0 AS sm FROM p), l AS (SELECT *, bool_and(sm) OVER (PARTITION BY file ORDER BY pos) AS lead FROM b)
, k AS (SELECT *, CASE WHEN lead THEN 'summary' WHEN note THEN 'note' WHEN mixed THEN 'mixed' WHEN bold THEN 'o' ELSE 't' END AS k FROM l), m AS (SELECT *, last_value(CASE WHEN k <> 't' THEN k END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM k)
, c AS (SELECT file, pos, text, CASE WHEN k = 't' AND m = 'note' THEN 'cont' ELSE k END AS k FROM m), v AS (SELECT *, lag(k) OVER (PARTITION BY file ORDER BY pos) AS v FROM c)
, g AS (SELECT *, sum((v IS NULL OR k IN ('note', 'mixed') OR (k NOT IN ('cont', 'summary') AND v IN ('note', 'cont', 'mixed', 'summary')) OR (k = 'o' AND v = 't'))::INT) OVER (PARTITION BY file ORDER BY pos) AS block FROM v)
, h AS (SELECT file, block, arg_min(k, pos) AS first, coalesce(list(text ORDER BY pos) FILTER (WHERE k = 'o'), []) AS o, coalesce(list(text ORDER BY pos) FILTER (WHERE k = 't'), []) AS t, list(text ORDER BY pos) AS own FROM g GROUP BY file, block)
, z AS (SELECT *, least(len(o), len(t)) AS z FROM h), x AS (SELECT file, block, unnest(CASE first WHEN 'summary' THEN [{{'kind': 'summary', 'os': own[len(own):], 'ts': []::VARCHAR[]}}] WHEN 'note' THEN [{{'kind': 'note', 'os': [array_to_string(own, chr(10))], 'ts': []::VARCHAR[]}}]
  WHEN 'mixed' THEN [{{'kind': 'mixed', 'os': [array_to_string(own, chr(10))], 'ts': []::VARCHAR[]}}] ELSE list_concat(list_transform(o[1:len(o) - z], lambda a: {{'kind': 'orig', 'os': [a], 'ts': []::VARCHAR[]}}), CASE WHEN z > 0 THEN [{{'kind': CASE WHEN z > 1 THEN 'block' ELSE 'pair' END, 'os': o[len(o) - z + 1:], 'ts': t[1:z]}}] ELSE [] END,
    list_transform(t[z + 1:], lambda a: {{'kind': 'trans', 'os': []::VARCHAR[], 'ts': [a]}})) END) AS p FROM z)
SELECT file AS id, block::BIGINT AS block, p.kind AS kind, md5(array_to_string(p.os, '|')) AS os, md5(array_to_string(p.ts, '|')) AS ts FROM x
""")
def paired_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paras(spark, sf_dir).withColumnRenamed("file", "id")
    out = ingest.pair_blocks(rows, every(7), every(7, 1), every(3))
    return out.select("id", "block", "kind", F.md5(F.array_join("os", "|")).alias("os"), F.md5(F.array_join("ts", "|")).alias("ts"))
