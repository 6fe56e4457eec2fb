"""The queries of the operators here, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, embedding_dedup, filter_audit, langid, line_dedup, ngram_join, packing, quality_rules, sharding, token_alignment, topk_search, toxicity, warc
from textloom.llm.common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", "text"), langid.fit(docs)).drop("text")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "n_chars"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_dropped_lines")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ledger(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_embedding_dedup, op2_bpe, op3_language_id, op4_best_fit_packing, op5_sharding, op6_line_dedup, op7_ngram_join, op8_quality_rules, op9_toxicity, op10_warc]
    found += [op11_topk_search, op12_filter_audit, op13_token_alignment]
    return {f.__name__: f for f in found}


_COMPONENTS = """
, reach(id, o) AS (SELECT a, a FROM ids UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.o = l.a)
, least AS (SELECT id, min(o) AS m FROM reach GROUP BY id)
"""

OP1 = (
    """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings
), ids AS (SELECT vec_id AS a FROM v)
, links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98
)"""
    + _COMPONENTS
    + """
SELECT vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least.m AS component_id, vec_id = least.m AS kept
FROM v JOIN least ON vec_id = least.id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = vec_id
"""
)

OP7 = (
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN ['<' || array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), ids AS (SELECT doc_id AS a FROM s)
, links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9
)"""
    + _COMPONENTS
    + """
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_links, least.m AS class_id, d.doc_id = least.m AS kept
FROM documents d JOIN least ON d.doc_id = least.id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = d.doc_id
"""
)


def _op5() -> str:
    owners = ",".join(map(str, sharding.lookup_table(sharding.SHARDS)))
    n = sharding.prime_above(len(sharding.SHARDS) * sharding.SLOTS_PER_SHARD)
    return f"""
WITH p AS (SELECT doc_id, n_chars, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {n} AS slot FROM documents),
t AS (SELECT [{owners}] AS owner)
SELECT doc_id, n_chars, slot, 'shard-' || lpad((owner[slot + 1])::VARCHAR, 3, '0') AS shard FROM p, t
"""


_D = line_dedup
OP6 = rf"""
WITH l AS (
  SELECT doc_id, unnest(list_filter(list_distinct(string_split(text, chr(10))), lambda x: len(x) > 0)) AS l FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), t AS (
  SELECT doc_id, l, list_filter(regexp_split_to_array(regexp_replace(lower(l), '[^ \t\n\x0B\f\r]*[0-9][^ \t\n\x0B\f\r]*', '<*>', 'g'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS t FROM l
), p AS (SELECT doc_id, l, t, len(t) AS n, 'line ' || array_to_string(t, ' ') AS k, len(t) || ' ' || array_to_string(t[1:{_D.DEPTH}], ' ') AS leaf FROM t WHERE len(t) > 0)
, various AS (SELECT DISTINCT leaf, k, n, t FROM p), many AS (SELECT leaf FROM various GROUP BY leaf HAVING count(*) >= {_D.LEAST})
, places AS (SELECT leaf, k, n, unnest(t) AS w, unnest(range(n)) AS i FROM various JOIN many USING (leaf))
, often AS (SELECT leaf, i, w, count(*) AS c FROM places GROUP BY ALL HAVING count(*) >= {_D.LEAST})
, common AS (SELECT leaf, k, n, list({{'i': i, 'w': w, 'c': c}} ORDER BY i) AS p FROM places JOIN often USING (leaf, i, w) GROUP BY leaf, k, n HAVING 2 * count(*) >= n)
, levels AS (SELECT leaf, k, n, list_filter(p, lambda x: x.c >= s) AS f FROM common, (SELECT ({_D.LEAST} * {_D.STEP}::BIGINT ** j)::BIGINT AS s FROM range({_D.LEVELS}) r(j)) WHERE len(list_filter(p, lambda x: x.c >= s)) > 0)
, wide AS (SELECT DISTINCT k AS line, n, list_transform(f, lambda x: {{'last': x.i + 1 = n, 'w': x.w}}) AS f, 'leaf ' || leaf || chr(10) || array_to_string(list_transform(f, lambda x: x.i || ' ' || x.w), chr(10)) AS k FROM levels WHERE 2 * len(f) >= n AND len(f) < n)
, member AS (SELECT doc_id, l, wide.k, wide.n, len(f) AS f FROM p JOIN wide ON p.k = wide.line)
, found AS (SELECT k, min(doc_id) AS first, count(DISTINCT doc_id) AS docs, count(*) AS lines, any_value(n) AS n FROM p GROUP BY k HAVING count(DISTINCT doc_id) >= 2
  UNION ALL SELECT k, min(doc_id), count(DISTINCT doc_id), count(*), any_value(n) FROM member GROUP BY k HAVING count(DISTINCT doc_id) >= {_D.LEAST})
, shares AS (SELECT i + 1 = n AS last, w, count(*) AS c FROM (SELECT unnest(t) AS w, unnest(range(n)) AS i, n FROM p) GROUP BY ALL)
, every AS (SELECT last, sum(c) AS s FROM shares GROUP BY last), totals AS (SELECT n, count(*) AS total FROM p GROUP BY n)
, kept AS (SELECT k, i + 1 = n AS last, w FROM (SELECT k, n, unnest(t) AS w, unnest(range(n)) AS i FROM (SELECT DISTINCT k, n, t FROM p))
  UNION ALL SELECT k, x.last, x.w FROM (SELECT k, unnest(f) AS x FROM (SELECT DISTINCT k, f FROM wide)))
, odds AS (SELECT k, first, docs, total, min(greatest(c - lines, 0)) AS least, sum(CASE WHEN c > lines THEN ln((c - lines)::DOUBLE / greatest(s - lines, 1)) END) AS lp
  FROM found JOIN totals USING (n) JOIN kept USING (k) JOIN shares USING (last, w) JOIN every USING (last) GROUP BY k, first, docs, total)
, m AS (SELECT k, first FROM odds WHERE least = 0 OR ln(total) + (docs - 1) * (ln(total) + ln({_D.RATIO}) + lp) - (docs * ln(docs) - docs) < ln({_D.DOUBT}))
, hits AS (SELECT doc_id, l, k FROM p UNION ALL SELECT doc_id, l, k FROM member)
, drops AS (SELECT hits.doc_id, list(DISTINCT l) AS gone FROM hits JOIN m USING (k) WHERE hits.doc_id <> m.first GROUP BY hits.doc_id)
, s AS (SELECT d.doc_id, text, string_split(text, chr(10)) AS a, list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, x)) AS b, gone FROM documents d LEFT JOIN drops USING (doc_id))
SELECT doc_id, md5(CASE WHEN gone IS NULL THEN text ELSE array_to_string(b, chr(10)) END) AS text_md5,
  (CASE WHEN gone IS NULL OR text IS NULL THEN 0 ELSE len(a) - len(b) END)::BIGINT AS n_dropped_lines FROM s
"""

OP8 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
, w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper, len(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters FROM t
), g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5)
, h AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM g)
, r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1)
, c AS (SELECT doc_id, sum(least(5, i - coalesce(p, -5))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r) GROUP BY doc_id)
, m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, n_upper::BIGINT AS n_upper, n_letters::BIGINT AS n_letters FROM w LEFT JOIN c USING (doc_id)
), b AS (SELECT *, ({" | ".join(f"(CASE WHEN {e} THEN {1 << k} ELSE 0 END)" for k, e in quality_rules.RULES.values())})::BIGINT AS fail_bits FROM m)
SELECT *, '{quality_rules.RULESET}' AS ruleset, 'v1' AS policy, (fail_bits & {quality_rules.mask("base")}) <> 0 AS base_failed, (fail_bits & {quality_rules.mask("base") | quality_rules.mask("v1")}) = 0 AS kept FROM b
"""

OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages)
, d AS (SELECT page_id, octet_length(h)::BIGINT AS n, sha1(h) AS x FROM p)
, b AS (
  SELECT page_id, n, x, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS digest FROM d
), f AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS first FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

OP11 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP12 = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents)
, w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t)
, f AS (
  SELECT doc_id, part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * len(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(first < doc_id, false)} AS f FROM w
), n AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), g AS (SELECT part, fails, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM n GROUP BY part, fails)
, l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)
, o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (SELECT o, unnest(range(1, 6)) AS step FROM o)
, p AS (SELECT array_to_string(o, '') AS filter_order, step, o[step] AS x, o[1:step - 1] AS before FROM s)
, r AS (
  SELECT part, filter_order, step, x, n, n_good, n_toxic, list_contains(fails, x) AS hit, list_has_any(fails, before) AS gone, fails FROM p, g
), e AS (
  SELECT part, filter_order, step, x, (coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0))::BIGINT AS kept, (coalesce(sum(n) FILTER (hit AND NOT gone), 0))::BIGINT AS removed,
    (coalesce(sum(n) FILTER (hit AND gone), 0))::BIGINT AS redundant, (coalesce(sum(n) FILTER (hit AND len(fails) = 1), 0))::BIGINT AS unique_fails,
    (coalesce(sum(n_good) FILTER (hit AND NOT gone), 0))::BIGINT AS good_lost, (coalesce(sum(n_toxic) FILTER (hit AND NOT gone), 0))::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM e
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_topk_search": OP11, "op12_filter_audit": OP12, "op1_embedding_dedup": OP1, "op5_sharding": _op5(), "op6_line_dedup": OP6, "op7_ngram_join": OP7, "op8_quality_rules": OP8, "op10_warc": OP10}
