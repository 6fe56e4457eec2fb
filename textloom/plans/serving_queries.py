"""Queries of conversations and the question service."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import serving as S
from textloom.operators import evaluation as E
from textloom.operators import indexing as X
from textloom.operators import pages as P
from textloom.plans.base import query, table
from textloom.plans.text_queries import SPACES
from textloom.storage import shared_dir


@query("""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL QUALIFY b <= 6)
SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS nth FROM b
""")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.history_tail(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "nth")


@query(f"""
WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role = 'user')
, l AS (SELECT *, prev IS NOT NULL AND (len(text) < 12 OR regexp_matches(text, '{T.FOLLOW_UP}')) AS follows FROM u QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
SELECT conv_id, follows, CASE WHEN follows THEN prev || '。' || text ELSE text END AS question FROM l
""")
def followup_condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.condense(table(spark, sf_dir, "conversations"))


@query(f"SELECT conv_id, turn, len(text) >= 24 OR len(regexp_extract_all(text, '[？?]')) >= 2 OR regexp_matches(text, '{T.HARD}') AS hard, regexp_matches(text, '{T.SCOPED}') AS scoped FROM conversations WHERE role = 'user'")
def hard_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", S.is_hard(F.col("text")).alias("hard"), F.col("text").rlike(T.SCOPED).alias("scoped"))


_QUOTE = r"""[「“"]([^」”"\n]{2,40})[」”"]\s*\[(\d{1,2})\]"""
_PLAIN = r"""[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}，。、；：？！「」『』“”"''‘’（）()【】\[\]．·—\-…]"""


@query(rf"""
WITH a AS (SELECT conv_id, turn, '「' || left(text, 12) || '」[' || (turn % 5) || '] and [1] 「' || substr(text, 5, 9) || '」 [1]' AS reply, [text, 'another passage'] AS ctx FROM conversations WHERE role = 'assistant')
, q AS (SELECT *, list_transform(regexp_extract_all(reply, '\[(\d{{1,2}})\]', 1), lambda x: x::INT) AS nums, regexp_extract_all(reply, '{_QUOTE}', 1) AS qs, list_transform(regexp_extract_all(reply, '{_QUOTE}', 2), lambda x: x::INT) AS ks FROM a)
, r AS (SELECT conv_id, turn, len(nums) AS cited, len(list_filter(nums, lambda x: x < 1 OR x > 2)) AS invalid, len(qs) AS quote_checked,
  len(list_filter(range(1, len(qs) + 1), lambda i: ks[i] BETWEEN 1 AND 2 AND contains(regexp_replace(ctx[ks[i]], '{_PLAIN}', '', 'g'), regexp_replace(qs[i], '{_PLAIN}', '', 'g')))) AS quote_ok FROM q)
SELECT conv_id, turn, cited::INT AS cited, invalid::INT AS invalid, quote_checked::INT AS quote_checked, quote_ok::INT AS quote_ok, invalid = 0 AND quote_ok = quote_checked AS faithful FROM r
""")
def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    reply = F.concat(F.lit("「"), F.left("text", F.lit(12)), F.lit("」["), (F.col("turn") % 5).cast("string"), F.lit("] and [1] 「"), F.substr("text", F.lit(5), F.lit(9)), F.lit("」 [1]"))
    made = answers.select("conv_id", "turn", reply.alias("reply"), F.array(F.col("text"), F.lit("another passage")).alias("ctx"))
    return S.validate_citations(made, "reply", "ctx").select("conv_id", "turn", "cited", "invalid", "quote_checked", "quote_ok", "faithful")


@query("""
WITH r AS (SELECT event_id, user_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS nth FROM events)
SELECT event_id, user_id, day::VARCHAR AS day, nth::INT AS nth, nth <= 2 AS accepted FROM r
""")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2)
    return out.select("event_id", "user_id", F.col("day").cast("string").alias("day"), "nth", "accepted")


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
, r AS (SELECT event_id, user_id, event_type, n, ts AS wrote, false AS hit FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.n, CASE WHEN e.ts - r.wrote < INTERVAL 604800 SECOND THEN r.wrote ELSE e.ts END, e.ts - r.wrote < INTERVAL 604800 SECOND
  FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1)
SELECT event_id, sha256(user_id || '|' || event_type) AS key, hit FROM r
""")
def answer_cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    out = S.ttl_cache(events, ["user_id", "event_type"], "ts", "event_id", 7 * 86400)
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256)
    return out.select("event_id", key.alias("key"), "hit")


@query("""
WITH f AS (SELECT event_id, event_type, ts FROM events WHERE event_type IN ('view', 'error') ORDER BY ts DESC, event_id DESC LIMIT 150)
SELECT count(*) AS total, count_if(event_type = 'view')::BIGINT AS up, count_if(event_type = 'error')::BIGINT AS down FROM f
""")
def feedback_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "events").where("event_type IN ('view', 'error')").orderBy(F.desc("ts"), F.desc("event_id")).limit(150)
    return votes.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "view").alias("up"), F.count_if(F.col("event_type") == "error").alias("down"))


@query("""
SELECT c_custkey AS user_id, arg_max(value, event_id) AS pct, count(event_id) > 0 AS visited FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey
""")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("pct"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    seen = last.withColumn("seen", F.lit(True))
    return users.join(seen, "user_id", "left").select("user_id", "pct", F.coalesce("seen", F.lit(False)).alias("visited"))


@query("""
WITH c AS (SELECT conv_id, count_if(role = 'user')::BIGINT AS n_user, count_if(role = 'assistant')::BIGINT AS n_assistant, count_if(role = 'system')::BIGINT AS n_system FROM conversations GROUP BY conv_id)
SELECT *, n_user = n_assistant AND n_system = 0 AS paired_plain, n_user = n_assistant OR n_assistant = 0 AS paired_vacuous, n_assistant > 0 AS paired_any FROM c
""")
def paired_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda role: F.count_if(F.col("role") == role)
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(count("user").alias("n_user"), count("assistant").alias("n_assistant"), count("system").alias("n_system"))
    return c.withColumns({"paired_plain": F.expr("n_user = n_assistant AND n_system = 0"), "paired_vacuous": F.expr("n_user = n_assistant OR n_assistant = 0"), "paired_any": F.expr("n_assistant > 0")})


@query(r"""
WITH g AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn) AS a, string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn) AS u FROM conversations GROUP BY conv_id)
, t AS (SELECT conv_id, trim(regexp_replace(regexp_replace(coalesce(a, u, ''), '\[\d{1,3}\]', '', 'g'), '\s+', ' ', 'g')) AS t FROM g)
SELECT conv_id, CASE WHEN len(t) <= 800 THEN t ELSE rtrim(substr(t, 1, 799)) || '…' END AS answer FROM t
""")
def faq_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda role: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n"), F.lit(""))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(side("assistant").alias("a"), side("user").alias("u"))
    return g.select("conv_id", T.clip(F.coalesce("a", "u", F.lit("")), 800).alias("answer"))


@query("SELECT conv_id * 1000 + turn AS id, text AS reply, len(string_split(text, chr(10)))::BIGINT AS n_deltas, true AS complete FROM conversations WHERE role = 'assistant'")
def ndjson_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return S.assemble(S.event_lines(answers, "id", "text"), "id")


@query("""
WITH k AS (SELECT c_custkey, sha256(c_name) AS t, c_mktsegment = 'HOUSEHOLD' AS disabled FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT c_custkey, '****' || right(t, 6) AS token, disabled FROM k
""")
def key_table_dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    keys = c.select("c_custkey", F.sha2("c_name", 256).alias("token"), F.lit(False).alias("disabled"), "c_mktsegment")
    kept = S.disable_keys(S.delete_keys(keys, F.col("c_mktsegment") == "MACHINERY"), F.col("c_mktsegment") == "HOUSEHOLD")
    return S.mask_keys(kept, "token").select("c_custkey", "token", "disabled")


@query("SELECT 'k' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 END AS lim, true AS fresh FROM nation")
def keys_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New keys with random tokens, which only their form can be checked of."""
    none = spark.createDataFrame([], "token string, name string, limit int, disabled boolean")
    new = table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") * 10).cast("int").alias("limit"))
    return S.add_keys(none, new).select("name", F.col("limit").alias("lim"), (F.col("token").rlike("^[0-9a-f]{64}$") & ~F.col("disabled")).alias("fresh"))


@query(r"""
WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), e AS (SELECT *, [('a' || conv_id % 3), CASE WHEN turn % 2 = 0 THEN 'a' || turn % 3 ELSE '' END] AS x, ['a' || turn % 4] AS s, ['a' || len(text) % 5, 'b'] AS p, CASE turn % 4 WHEN 0 THEN text || ' [1]' WHEN 1 THEN '没有相关内容' ELSE text END AS reply, CASE WHEN len(text) % 9 = 0 THEN 'http_500' ELSE 'ok' END AS status FROM t)
, f AS (SELECT *, list_filter(x, lambda v: v <> '') AS expect FROM e), j AS (SELECT *, len(list_intersect(expect, list_concat(s, p))) > 0 AS hit, regexp_matches(reply, '\[\d{1,2}\]') AS cited, contains(reply, '没有相关') AS refusal, status = 'ok' AS ok, len(text) % 3 AS v FROM f)
SELECT count(*) AS n, count_if(ok)::BIGINT AS n_ok, count_if(ok AND len(expect) > 0)::BIGINT AS n_labelled, count_if(ok AND hit)::BIGINT AS n_hit, round(count_if(ok AND hit) / count_if(ok AND len(expect) > 0), 6) AS recall, round(count_if(ok AND cited) / count_if(ok), 6) AS citation_rate,
  round(count_if(ok AND refusal) / count_if(ok), 6) AS refusal_rate, round(sum(CASE WHEN ok THEN len(s) END) / count_if(ok), 6) AS mean_sources, round(sum(CASE WHEN ok THEN len(p) END) / count_if(ok), 6) AS mean_passages, count_if(ok AND v > 0)::BIGINT AS n_verified,
  round(count_if(ok AND v = 1) / nullif(count_if(ok AND v > 0), 0), 6) AS faithful_rate, round(sum(CASE WHEN ok AND v > 0 THEN v END) / nullif(sum(CASE WHEN ok AND v > 0 THEN 3 END), 0), 6) AS quote_rate, count_if(ok AND v = 2)::BIGINT AS n_out_of_range FROM j
""")
def eval_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question set written as JSON and read back, judged on answers made of the conversations."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    a = lambda c, k: F.concat(F.lit("a"), (c % k).cast("string"))
    made = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.struct(F.col("text").alias("question"), F.array(a(F.col("conv_id"), 3), F.when(F.col("turn") % 2 == 0, a(F.col("turn"), 3)).otherwise("")).alias("expectArticles")).alias("q"))
    path = f"{shared_dir(spark)}/questions-{uuid.uuid4().hex}"
    made.select(F.array("q").alias("questions"), "id").write.json(path)
    asked = E.question_sets(spark, path)
    n = F.length("text")
    verify = F.when(n % 3 > 0, F.struct((n % 3 == 1).alias("faithful"), F.when(n % 3 == 2, 1).otherwise(0).alias("invalid"), F.lit(3).alias("quote_checked"), (n % 3).alias("quote_ok")))
    reply = F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" [1]"))).when(F.col("turn") % 4 == 1, "没有相关内容").otherwise(F.col("text"))
    answers = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), reply.alias("reply"), F.when(n % 9 == 0, "http_500").otherwise("ok").alias("status"), F.array(a(F.col("turn"), 4)).alias("sources"), F.array(a(n, 5), F.lit("b")).alias("passages"), verify.alias("verify"))
    return E.metrics(E.judged(answers.join(asked.select("id", "expect"), "id"), "没有相关"))


@query("""
WITH k AS (SELECT c_custkey, sha256(c_name) AS token, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS lim, c_mktsegment = 'HOUSEHOLD' AS disabled FROM customer WHERE c_custkey % 2 = 0)
, r AS (SELECT c_custkey AS req, CASE WHEN c_custkey % 5 > 0 THEN sha256(c_name) END AS token, c_custkey % 10 = 0 AS first FROM customer)
SELECT req, CASE WHEN r.token IS NOT NULL THEN CASE WHEN NOT coalesce(disabled, true) THEN 'key' END WHEN first THEN 'ip' END AS kind, CASE WHEN r.token IS NOT NULL AND NOT coalesce(disabled, true) THEN left(sha256(r.token), 16) END AS principal,
  CASE WHEN r.token IS NOT NULL AND NOT coalesce(disabled, true) THEN name END AS name, (CASE WHEN r.token IS NOT NULL AND NOT coalesce(disabled, true) THEN coalesce(lim, 2000) END)::BIGINT AS daily_limit,
  CASE WHEN (r.token IS NOT NULL AND NOT coalesce(disabled, true)) OR (r.token IS NULL AND first) THEN 200 ELSE 401 END AS status FROM r LEFT JOIN k ON k.token = r.token
""")
def api_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    keys = c.where("c_custkey % 2 = 0").select(F.sha2("c_name", 256).alias("token"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("long")).alias("limit"), (F.col("c_mktsegment") == "HOUSEHOLD").alias("disabled"))
    site = F.when(F.col("c_custkey") % 10 == 0, "https://x.org")
    requests = c.select(F.col("c_custkey").alias("req"), F.when(F.col("c_custkey") % 5 > 0, F.sha2("c_name", 256)).alias("token"), site.alias("origin"))
    out = X.authenticate(requests, keys, P.first_party(F.col("origin"), F.lit(None).cast("string"), ["https://x.org"]))
    return out.select("req", "kind", "principal", "name", F.col("daily_limit").cast("long").alias("daily_limit"), "status")


@query("""
WITH v AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'up' WHEN 'error' THEN 'down' ELSE 'other' END AS vote, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'q' || event_id END AS question FROM events)
, k AS (SELECT 'fb:' || epoch_ms(ts) || ':' || event_id AS key, vote, ts FROM v WHERE vote <> 'other' AND question <> ''), l AS (SELECT * FROM k WHERE ts + INTERVAL 400 DAY > (SELECT max(ts) FROM events) + INTERVAL 385 DAY ORDER BY key LIMIT 1000)
, n AS (SELECT * FROM l ORDER BY key DESC LIMIT 150) SELECT count_if(vote = 'up')::BIGINT AS up, count_if(vote = 'down')::BIGINT AS down, count(*) AS total FROM n
""")
def feedback_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes kept with their expiry, and the report on what is live at a later time."""
    events = table(spark, sf_dir, "events")
    vote = F.when(F.col("event_type") == "view", "up").when(F.col("event_type") == "error", "down").otherwise("other")
    votes = events.select("event_id", "ts", vote.alias("vote"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("q"), F.col("event_id").cast("string"))).alias("question"), F.lit(None).cast("string").alias("note"), F.lit("reply").alias("reply"))
    now = events.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 385 DAYS")).alias("now"))
    kv = X.feedback(votes, "ts", "event_id").crossJoin(F.broadcast(now))
    return X.feedback_report(kv, F.col("now"))


@query("WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || chr(10) || '（白话）' || 'x' WHEN 1 THEN '（白话）' || text ELSE text END AS t, text FROM conversations) SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN string_split(t, chr(10) || '（白话）')[1] ELSE t END) AS excerpt, t <> text AS marked FROM t")
def citation_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n（白话）x"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("（白话）"), "text")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"), "text")
    return rows.select("conv_id", "turn", X.citation_excerpt("t").alias("excerpt"), (F.col("t") != F.col("text")).alias("marked"))


@query("""
WITH m AS (SELECT conv_id AS query, turn::INT AS rank, 'a' || len(text) % 3 AS aid, text, CASE WHEN turn % 2 = 0 THEN '' ELSE 'ctx ' || text END AS ctx, CASE WHEN turn % 4 = 0 THEN '' ELSE 'V' || turn END AS vol_name, 'T' AS title FROM conversations)
, p AS (SELECT *, CASE WHEN ctx = '' THEN text ELSE ctx END AS body, CASE WHEN vol_name = '' THEN title ELSE vol_name || ' · ' || title END AS place FROM m), c AS (SELECT query, md5(string_agg('[' || rank || '] ' || place || chr(10) || body, chr(10) || chr(10) ORDER BY rank)) AS context FROM p GROUP BY query)
, f AS (SELECT query, aid, min(rank) AS r FROM p GROUP BY query, aid), s AS (SELECT query, string_agg(aid, ',' ORDER BY r) AS sources FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query ORDER BY r) <= 8) GROUP BY query) SELECT query, context, sources FROM c JOIN s USING (query)
""")
def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    found = t.select(F.col("conv_id").alias("query"), F.col("turn").alias("rank"), F.concat(F.lit("a"), (F.length("text") % 3).cast("string")).alias("aid"), "text", F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("ctx "), "text")).alias("ctx"), F.when(F.col("turn") % 4 == 0, "").otherwise(F.concat(F.lit("V"), F.col("turn").cast("string"))).alias("vol_name"), F.lit("T").alias("title"))
    shown = P.passages(found)
    listed = P.sources(shown).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "aid"))), lambda x: x["aid"]), ",").alias("sources"))
    return P.contexts(shown).select("query", F.md5("context").alias("context")).join(listed, "query")


@query(f"""
WITH r AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN '' ELSE regexp_replace('x ' || text, '^{SPACES}+|{SPACES}+$', '', 'g') END AS r FROM conversations)
SELECT conv_id, turn, CASE WHEN r <> '' AND r <> text AND len(r) <= 32 THEN r ELSE text END AS kept FROM r
""")
def rewrite_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    rewrite = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("x "), "text"))
    return t.select("conv_id", "turn", P.accept_rewrite(F.col("text"), rewrite, 32).alias("kept"))


@query("SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) > 0 AND (SELECT count(*) FROM embeddings) > 0 AS ready")
def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.health(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"))


@query("SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 4 < 2 THEN text END AS delta FROM conversations")
def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    line = F.when(F.col("turn") % 4 < 2, data).when(F.col("turn") % 4 == 2, "data: [DONE]").otherwise(": comment")
    lines = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), line.alias("line"))
    return S.sse_deltas(lines, "line").select("id", "delta")


@query("""
WITH u AS (SELECT p_type AS name, p_partkey FROM part WHERE p_size % 3 = 0) SELECT name, count(*) AS n FROM u GROUP BY name ORDER BY n DESC, name LIMIT 20
""")
def unresolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.when(F.col("p_size") % 3 > 0, F.col("p_partkey")).alias("id"))
    return P.unresolved(refs)


@query("""
WITH r AS (SELECT conv_id, turn, text, role FROM conversations), b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM r WHERE role IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, turn, b <= 5 AS condense, b <= 6 AS server, b <= 8 AS client, b <= 30 AS session FROM b WHERE b <= 30
""")
def message_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    tail = lambda name: S.history_tail(t, S.TAILS[name]).select("conv_id", "turn", F.lit(True).alias(name))
    out = tail("session")
    for name in ("condense", "server", "client"):
        out = out.join(tail(name), ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", *[F.coalesce(name, F.lit(False)).alias(name) for name in ("condense", "server", "client", "session")])
