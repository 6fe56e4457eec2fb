"""Queries of alignment, linking and segmentation by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import alignment as A
from textloom.operators import contents, linking, segments
from textloom.plans.base import query, table

_SQ = r"""regexp_replace(lower(text), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}，。、；：？！“”‘’"''（）()·．\.,：「」『』《》〈〉—\-–…\[\]【】〇]', '', 'g')"""


@query(rf"""
WITH q AS (SELECT item_id, {_SQ} AS q FROM benchmark), s AS (
  SELECT DISTINCT item_id, unnest(list_concat(list_transform(range(0, greatest(len(q) - 14, 0) + 1, greatest(8, len(q) // 8)), lambda i: substr(q, i + 1, 14)), [right(q, 14)])) AS s FROM q WHERE len(q) >= 10)
, u AS (SELECT DISTINCT s FROM s WHERE len(s) >= 10), d AS (SELECT doc_id, {_SQ} AS t FROM documents)
, h AS (SELECT s, doc_id, len(list_filter(range(1, len(t) - len(s) + 2), lambda i: substr(t, i, len(s)) = s)) AS n FROM u JOIN d ON contains(t, s))
, c AS (SELECT s, doc_id, coalesce(sum(n) OVER (PARTITION BY s ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT DISTINCT item_id, doc_id FROM s JOIN c USING (s) WHERE before < 8
""")
def quote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.candidates(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query()
def quote_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest matching blocks are beyond SQL; tests compare with a plain search of all lines of all candidates."""
    return A.align(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")).withColumn("reply", F.md5("reply"))


@query(r"""
WITH d AS (SELECT regexp_replace(text, '\s+', '', 'g') AS t FROM documents), m AS (
  SELECT item_id, EXISTS (SELECT 1 FROM d WHERE contains(t, regexp_replace(b.text, '\s+', '', 'g'))) AS hit FROM benchmark b)
SELECT count(*) AS total, count_if(hit)::BIGINT AS matched, round(100.0::DOUBLE * count_if(hit) / count(*), 6) AS rate FROM m
""")
def quote_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    hit = A.contained(items, table(spark, sf_dir, "documents")).select("item_id").distinct().withColumn("hit", F.lit(True))
    both = items.join(hit, "item_id", "left")
    return both.agg(F.count("*").alias("total"), F.count_if(F.col("hit")).alias("matched")).withColumn("rate", F.round(F.lit(100.0) * F.col("matched") / F.col("total"), 6))


_PAIRS = r"p AS (SELECT lag(doc_id) OVER (PARTITION BY k ORDER BY doc_id) AS a, doc_id AS b FROM (SELECT doc_id, substr(regexp_replace(text, '\s+', '', 'g'), 1, 80) AS k FROM documents) WHERE k <> '' QUALIFY a IS NOT NULL)"


@query(f"""
WITH {_PAIRS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
, x AS (SELECT a, b, pos, line AS x FROM p JOIN l ON a = doc_id), y AS (SELECT a, b, pos, line AS y FROM p JOIN l ON b = doc_id)
SELECT a, b, CASE WHEN y IS NULL THEN 'only_a' WHEN x IS NULL THEN 'only_b' WHEN x = y THEN 'same' ELSE 'content' END AS kind, count(*) AS n
FROM x FULL OUTER JOIN y USING (a, b, pos) GROUP BY ALL
""")
def ordinal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return A.ordinal_diff(A.neighbours(docs), segments.lines(docs))


@query(rf"""
WITH {_PAIRS}, c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\s+', '', 'g'), '')) AS ch FROM documents) GROUP BY ALL)
, u AS (SELECT a, b, ch, n AS d FROM p JOIN c ON a = doc_id UNION ALL SELECT a, b, ch, -n FROM p JOIN c ON b = doc_id), g AS (SELECT a, b, ch, sum(d) AS d FROM u GROUP BY ALL)
SELECT a, b, sum(greatest(d, 0))::BIGINT AS n_more_a, sum(greatest(-d, 0))::BIGINT AS n_more_b FROM g GROUP BY a, b
""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return A.multiset_diff(A.neighbours(docs), docs)


_SWAP = lambda x: f"CASE WHEN starts_with({x}, '复') THEN '与' || substr({x}, 2) WHEN starts_with({x}, '与') THEN '复' || substr({x}, 2) END"
_NORM = lambda x: f"regexp_replace({x}, '[\\s　《》「」『』〈〉]+', '', 'g')"
_BARE = lambda x: f"regexp_replace({x}, '（[^）]*）', '', 'g')"
_LOOSE = lambda x: f"regexp_replace(replace(regexp_replace({x}, '[、，,（）()]', '', 'g'), '居士', ''), '[一二三四五六七八九十]+$', '')"

_TITLES = """
titles AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS vol, p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN '复' || p_name WHEN 1 THEN p_name || '一' WHEN 2 THEN p_name || '（注）' ELSE p_name END AS title, p_partkey AS id FROM part)
"""


def _resolve(refs: str, out: str) -> str:
    """CTEs that resolve refs (ref, vol, name) into out (ref, tier, id), written another way than the code: a search for each tier."""
    whole = _NORM("name")
    ways = [("m", whole), ("m", _SWAP(whole)), ("m", _BARE(whole)), ("m", _SWAP(_BARE(whole))), ("l", _LOOSE(whole)), ("l", f"{_LOOSE(whole)} || '一'"), ("l", f"{_LOOSE(whole)} || '二'")]
    tried = " UNION ALL ".join(f"SELECT ref, vol, {n + 1} AS tier, '{kind}' AS kind, {key} AS key FROM {refs}" for n, (kind, key) in enumerate(ways))
    return f"""
{out}_k AS (SELECT * FROM (SELECT vol, ord, 0 AS i, id, 'm' AS kind, {_NORM('title')} AS key FROM titles UNION ALL SELECT vol, ord, 1, id, 'm', {_NORM(_BARE('title'))} FROM titles
  UNION ALL SELECT vol, ord, 0, id, 'l', {_LOOSE(_NORM('title'))} FROM titles UNION ALL SELECT vol, ord, 1, id, 'l', {_LOOSE(_NORM(_BARE('title')))} FROM titles) QUALIFY row_number() OVER (PARTITION BY vol, kind, key ORDER BY ord, i) = 1)
, {out}_d AS (SELECT ref, tier, k.id FROM ({tried}) t JOIN {out}_k k USING (vol, kind, key) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY tier) = 1)
, {out}_c AS (SELECT ref, 8 AS tier, k.id FROM (SELECT ref, vol, {whole} AS t FROM {refs} WHERE ref NOT IN (SELECT ref FROM {out}_d)) r JOIN {out}_k k USING (vol)
  WHERE k.kind = 'm' AND k.key <> '' AND len(t) >= 6 AND (ends_with(k.key, t) OR (ends_with(t, k.key) AND len(k.key) >= 6) OR (right(t, 1) = right(k.key, 1) AND k.key LIKE '%' || array_to_string(string_split(t, ''), '%') || '%')) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY ord, i) = 1)
, {out} AS (SELECT * FROM {out}_d UNION ALL SELECT * FROM {out}_c)
"""


_REFS = """
refs AS (SELECT p_partkey AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS vol, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_name || '（一注）' WHEN 2 THEN replace(p_name, ' ', '、') WHEN 3 THEN '与' || p_name WHEN 4 THEN substr(p_name, 4) WHEN 5 THEN 'no ' || p_name ELSE '《' || p_name || '》其三' END AS name FROM part)
"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    title = F.when(k % 5 == 0, F.concat(F.lit("复"), "p_name")).when(k % 5 == 1, F.concat("p_name", F.lit("一"))).when(k % 5 == 2, F.concat("p_name", F.lit("（注）"))).otherwise(F.col("p_name"))
    return part.select(F.when(k % 2 == 0, "a").otherwise("b").alias("vol"), k.alias("ord"), title.alias("title"), k.alias("id"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    p = F.col("p_name")
    names = [p, F.concat(p, F.lit("（一注）")), F.replace(p, F.lit(" "), F.lit("、")), F.concat(F.lit("与"), p), F.substr(p, F.lit(4)), F.concat(F.lit("no "), p), F.concat(F.lit("《"), p, F.lit("》其三"))]
    name = names[6]
    for n in range(5, -1, -1):
        name = F.when(k % 7 == n, names[n]).otherwise(name)
    return part.select(k.alias("ref"), F.when(k % 2 == 0, "a").otherwise("b").alias("vol"), name.alias("name"))


@query(f"WITH {_TITLES}, {_REFS}, {_resolve('refs', 'found')} SELECT ref, found.id, tier::INT AS tier FROM refs LEFT JOIN found USING (ref)")
def title_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.resolve(_refs(spark, sf_dir), _titles(spark, sf_dir)).select("ref", "id", "tier")


@query(f"""
WITH {_TITLES}, {_REFS}, base AS (SELECT ref, vol, trim(regexp_replace(name, '其[一二三四五六七八九十、，\\s]+$', '')) AS name FROM refs), other AS (SELECT ref, CASE vol WHEN 'a' THEN 'b' ELSE 'a' END AS vol, name FROM base)
, {_resolve('base', 'f1')}, {_resolve('other', 'f2')}, alone AS (SELECT {_LOOSE(_NORM('title'))} AS k, min(id) AS id FROM titles GROUP BY ALL HAVING count(DISTINCT id) = 1)
SELECT base.ref, coalesce(f1.id, f2.id, alone.id) AS id FROM base LEFT JOIN f1 USING (ref) LEFT JOIN f2 USING (ref) LEFT JOIN alone ON alone.k = {_LOOSE(_NORM('name'))}
""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir).select("ref", "name", F.col("vol").alias("first"), F.when(F.col("vol") == "a", "b").otherwise("a").alias("second"))
    return linking.resolve_names(refs, _titles(spark, sf_dir)).select("ref", "id")


@query(f"""
WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''), t AS (SELECT doc_id AS id, {_LOOSE(_NORM("'t' || doc_id % 40"))} AS k, {_NORM('text')} AS b FROM d), r AS (SELECT doc_id AS ref, {_LOOSE(_NORM("'t' || doc_id % 40 || '、'"))} AS k, left({_NORM('text')}, 20) AS h FROM d)
, m AS (SELECT ref, min(id) AS id FROM r JOIN t ON t.k IN (r.k, r.k || '一', r.k || '二', r.k || '三') WHERE h <> '' AND contains(b, h) GROUP BY ref HAVING count(DISTINCT id) = 1) SELECT ref, m.id FROM r LEFT JOIN m USING (ref)
""")
def content_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''")
    title = F.concat(F.lit("t"), (F.col("doc_id") % 40).cast("string"))
    refs = docs.select(F.col("doc_id").alias("ref"), F.concat(title, F.lit("、")).alias("name"), F.col("text").alias("quote"))
    return linking.unique_by_content(refs, docs.select(F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("body"))).select("ref", "id")


@query("""
WITH s AS (SELECT user_id AS id, event_id AS seg, CASE WHEN event_id % 4 > 0 THEN 'a' || event_id % 50 END AS old, CASE WHEN event_id % 3 > 0 THEN 'a' || (event_id % 50 - event_id % 2) END AS new FROM events)
SELECT id, seg, new AS "srcId", old IS DISTINCT FROM new AS changed FROM s
""")
def link_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, k = table(spark, sf_dir, "events"), F.col("event_id")
    name = lambda n: F.concat(F.lit("a"), n.cast("string"))
    segs = events.select(F.col("user_id").alias("id"), k.alias("seg"), F.lit("src").alias("src"), F.when(k % 4 > 0, name(k % 50)).alias("srcId"))
    found = events.where(k % 3 > 0).select(F.col("user_id").alias("id"), k.alias("seg"), name(k % 50 - k % 2).alias("srcId"))
    return linking.set_links(segs, found).select("id", "seg", "srcId", "changed")


@query("""
WITH n AS (SELECT c_custkey AS ref, 'v' || c_custkey % 3 AS vol, 'short of ' || c_name AS name FROM customer), t AS (SELECT 'v' || c_custkey % 3 AS vol, c_custkey AS ord, CASE c_custkey % 4 WHEN 0 THEN 'short of ' WHEN 1 THEN '' WHEN 2 THEN 'of ' ELSE 'x' END || c_name || CASE WHEN c_custkey % 5 = 0 THEN '（注）' ELSE '' END AS title FROM customer)
, b AS (SELECT ref, vol, replace(name, ' ', '') AS b FROM n), s AS (SELECT vol, ord, title, regexp_replace(replace(title, ' ', ''), '（[^）]*）', '', 'g') AS s FROM t WHERE len(replace(title, ' ', '')) >= 6)
, m AS (SELECT ref, title FROM b JOIN s USING (vol) WHERE starts_with(b, s) OR starts_with(s, b) OR ends_with(b, s) OR (len(s) >= 6 AND right(b, 1) = right(s, 1) AND b LIKE '%' || array_to_string(string_split(s, ''), '%') || '%') QUALIFY row_number() OVER (PARTITION BY ref ORDER BY ord) = 1)
SELECT ref, m.title AS canon FROM n LEFT JOIN m USING (ref)
""")
def contained_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    vol = F.concat(F.lit("v"), (k % 3).cast("string"))
    title = F.concat(F.when(k % 4 == 0, "short of ").when(k % 4 == 1, "").when(k % 4 == 2, "of ").otherwise("x"), "c_name", F.when(k % 5 == 0, "（注）").otherwise(""))
    names = c.select(k.alias("ref"), vol.alias("vol"), F.concat(F.lit("short of "), "c_name").alias("name"))
    return contents.containing_title(names, c.select(vol.alias("vol"), k.alias("ord"), title.alias("title"))).select("ref", "canon")


@query("""
WITH a AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part WHERE p_size <= 20)
, b AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part WHERE p_size > 20)
SELECT b.p_partkey AS body, a.p_partkey AS toc FROM b LEFT JOIN a USING (p_name, k)
""")
def consuming_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators.linking import consume

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    body, toc = part.where("p_size > 20"), part.where("p_size <= 20")
    return consume(body, toc, "p_name", "p_partkey").select(F.col("p_partkey").alias("body"), F.col("__other").alias("toc"))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'text only' WHEN d.doc_id IS NULL THEN 'label only' ELSE 'both' END AS state, quality FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id")
def numbered_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("t"))
    both = docs.join(table(spark, sf_dir, "labels").withColumn("l", F.lit(1)), "doc_id", "full_outer")
    return both.select("doc_id", F.when(F.col("l").isNull(), "text only").when(F.col("t").isNull(), "label only").otherwise("both").alias("state"), "quality")


@query("""
WITH r AS (SELECT *, (role IS DISTINCT FROM lag(role) OVER w)::INT AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
, i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r)
SELECT conv_id, run::BIGINT AS run, role, count(*) AS n_turns, md5(string_agg(text, chr(10) ORDER BY turn)) AS body FROM i GROUP BY conv_id, run, role
""")
def run_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = segments.runs(table(spark, sf_dir, "conversations"), "role", ["conv_id"], ["turn"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return runs.groupBy("conv_id", "run", "role").agg(F.count("*").alias("n_turns"), F.md5(body).alias("body"))


@query("""
WITH l AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations WHERE role = 'user')
, r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations WHERE role = 'assistant')
, s AS (SELECT DISTINCT conv_id FROM conversations)
, k AS (SELECT conv_id, coalesce((SELECT max(c) FROM l WHERE l.conv_id = s.conv_id), 0) AS a, coalesce((SELECT max(c) FROM r WHERE r.conv_id = s.conv_id), 0) AS b FROM s)
, x AS (SELECT l.conv_id, l.n AS pos, md5(l.text) AS l FROM l), y AS (SELECT r.conv_id, CASE WHEN a > b THEN a - b + r.n ELSE CASE WHEN r.n <= a THEN r.n ELSE r.n END END AS pos, md5(r.text) AS r FROM r JOIN k USING (conv_id))
SELECT conv_id, (pos - 1)::INT AS pos, l, r FROM x FULL OUTER JOIN y USING (conv_id, pos)
""")
def tail_head_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    side = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: F.md5(x["text"]))
    both = turns.groupBy("conv_id").agg(side("user").alias("a"), side("assistant").alias("b"))
    return both.select("conv_id", F.posexplode(segments.pair_tail_head(F.col("a"), F.col("b"))).alias("pos", "p")).select("conv_id", "pos", "p.l", "p.r")


@query("""
SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marker FROM events
""")
def asof_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    marker = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before)
    return table(spark, sf_dir, "events").select("event_id", marker.alias("marker"))


@query("""
WITH h AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
, r AS (SELECT event_id, event_type, bool_and(event_type IN ('view', 'click', 'signup')) OVER (PARTITION BY user_id, i ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS clean,
  count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id, i ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS n_views FROM h)
SELECT event_id, clean, n_views FROM r WHERE event_type = 'signup'
""")
def lookahead_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = segments.islands(table(spark, sf_dir, "events"), F.col("event_type") == "purchase", ["user_id"], ["ts", "event_id"], "i")
    w = Window.partitionBy("user_id", "i").orderBy("ts", "event_id")
    clean = F.bool_and(F.col("event_type").isin("view", "click", "signup")).over(w.rowsBetween(0, Window.unboundedFollowing))
    views = F.count(F.when(F.col("event_type") == "view", 1)).over(w.rowsBetween(1, 6))
    return marked.select("event_id", "event_type", clean.alias("clean"), views.alias("n_views")).where("event_type = 'signup'").drop("event_type")


@query("""
WITH f AS (SELECT event_id, user_id, event_type, max(CASE WHEN event_type IN ('error', 'signup') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events)
SELECT event_id FROM f WHERE last IS NULL OR last NOT IN (SELECT event_id FROM events WHERE event_type = 'error')
""")
def interval_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.when(F.col("event_type").isin("error", "signup"), F.col("event_type"))
    state = F.last(heads, ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").withColumn("state", state).where("state IS NULL OR state <> 'error'").select("event_id")
