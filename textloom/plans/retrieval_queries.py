"""Queries of ranked retrieval, up to the flagship: hybrid top-k passages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import changing, chunking, embedding, indexing, vectors
from textloom.operators import lexical as L
from textloom.operators import retrieval as R
from textloom.plans.base import query, table
from textloom.plans.text_queries import CHUNKS, MARKS
from textloom.storage import keep, rows_to_python, shared_dir

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

# the content words of a question, distinct in their order, six at most; T.naive_terms
_WORDS = rf"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), '{T.STOP_WORDS}', ' ', 'g'), '\s+'), lambda x: len(x) >= 2)"
_NAIVE = f"(SELECT item_id, text, list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'p': list_position(w, x), 'x': x}})), lambda s: s.x)[1:6] AS k FROM (SELECT item_id, text, {_WORDS} AS w FROM benchmark))"


def _lexical(terms: str = "k", only: str = "true", docs: str = "documents") -> str:
    """CTEs up to lex: BM25 over phrases, for terms of the questions (k: their content words)."""
    return rf"""
q AS (SELECT item_id, {terms} AS terms FROM {_NAIVE})
, dt AS (SELECT doc_id, {_TOKENS} AS t FROM {docs})
, st AS (SELECT count(*) AS n, avg(len(coalesce(t, []))) AS mean FROM dt)
, ex AS (SELECT doc_id, len(t) AS len, unnest(t) AS token, unnest(range(len(t))) AS pos FROM dt)
, tm AS (SELECT item_id, unnest(terms) AS text, unnest(range(len(terms))) AS phrase FROM q)
, pt AS (SELECT item_id, phrase, {_TOKENS} AS t FROM tm), ph AS (SELECT item_id, phrase, len(t) AS size, unnest(t) AS token, unnest(range(len(t))) AS i FROM pt)
, starts AS (SELECT item_id, phrase, size, doc_id, len, pos - i AS s, count(*) AS n FROM ph JOIN ex USING (token) GROUP BY ALL)
, tf AS (SELECT item_id, phrase, doc_id, len, count(*) AS tf FROM starts WHERE n = size GROUP BY ALL)
, df AS (SELECT item_id, phrase, count(*) AS df FROM tf GROUP BY ALL)
, sc AS (SELECT item_id, doc_id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM tf JOIN df USING (item_id, phrase), st GROUP BY item_id, doc_id)
, lex AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE {only} QUALIFY rank <= 30)
"""


_BM25 = _lexical()
_UNIT = "SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_COS = "round(list_dot_product(q.e, v.e) / (q.n * v.n), 6)"


def _near(condition: str) -> str:
    return f"""
u AS ({_UNIT})
, nn AS (SELECT q.vec_id AS query, v.vec_id, {_COS} AS score FROM u q, u v WHERE {condition})
, near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM nn QUALIFY rank <= 40)
"""


@query(f"SELECT token, doc_id, count(*) AS tf, min(pos)::INT AS first_pos FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)) GROUP BY token, doc_id")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(table(spark, sf_dir, "documents"))


def index(spark: SparkSession, sf_dir: str) -> str:
    return L.stored(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "documents"))


def lexical(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """The lexical pool of questions: their content words, since no rewriting model is there."""
    return L.search(spark, index(spark, sf_dir), L.rewritten(items))


@query(f"WITH {_BM25} SELECT item_id, rank::INT AS rank, doc_id, score FROM lex")
def lexical_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, table(spark, sf_dir, "benchmark"))


_FIRST_WORDS = r"[array_to_string(regexp_split_to_array(trim(text), '\s+')[1:3], ' ')]"


@query(f"WITH {_lexical(f'list_concat({_FIRST_WORDS}, k[1:2])')} SELECT item_id, rank::INT AS rank, doc_id, score FROM lex")
def lexical_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three words of a question as a phrase, and its first two content words."""
    phrase = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 3), " ")
    asked = table(spark, sf_dir, "benchmark").withColumn("terms", F.concat(F.array(phrase), F.slice(T.naive_terms("text"), 1, 2)))
    return L.search(spark, index(spark, sf_dir), asked)


@query(f"WITH {_lexical(only='doc_id = 3 * item_id OR item_id % 2 = 1')} SELECT item_id, rank::INT AS rank, doc_id, score FROM lex")
def lexical_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other question is held to one document."""
    asked = L.rewritten(table(spark, sf_dir, "benchmark")).withColumn("only", F.when(F.col("item_id") % 2 == 0, 3 * F.col("item_id")))
    return L.search(spark, index(spark, sf_dir), asked, only="only")


_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN concat_ws(' ', lang, text, 'again') ELSE text END AS text FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 1 AND doc_id % 10 <> 2 OR doc_id % 20 = 2 AND text IS NOT NULL)"


@query(f"WITH {_lexical(docs=_CHANGED)} SELECT item_id, rank::INT AS rank, doc_id, score FROM lex")
def changing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents indexed in two batches, some replaced, some deleted, some of those put back, one batch failing; then searched, after a merge of what was there first."""
    docs, k = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", "text"), F.col("doc_id") % 10
    index = changing.ChangingIndex(spark, f"{shared_dir(spark)}/changing-{uuid.uuid4().hex}")
    plain = docs.select("doc_id", "text")
    index.add(plain.where("doc_id % 2 = 0"), 0)
    index.add(plain.where("doc_id % 2 = 1"), 1)
    index.merge()
    index.add(docs.where(k <= 2).select("doc_id", F.when(k == 0, F.concat_ws(" ", "lang", "text", F.lit("again"))).alias("text")), 2)
    index.add(docs.select("doc_id"), 3)  # has no text to index
    index.add(plain.where("doc_id % 20 = 2"), 4)
    return L.search(spark, index.opened(), L.rewritten(table(spark, sf_dir, "benchmark")))


@query(rf"""
WITH q AS (SELECT item_id, text, k FROM {_NAIVE}), r AS (SELECT item_id, 'new ' || left(text, 20) AS rw, item_id % 4 AS way FROM benchmark)
SELECT item_id, CASE WHEN way = 0 THEN [text, trim(rw)] ELSE [text] END AS queries, CASE WHEN way = 0 THEN ['first word', 'second'] ELSE k END AS terms FROM q JOIN r USING (item_id)
""")
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a rewriting model stand in: good ones, ones that repeat the question, ones that aren't JSON, none."""
    way = F.col("item_id") % 4
    good = F.concat(F.lit("```"), F.to_json(F.struct(F.concat(F.lit(' "new '), F.left("text", F.lit(20)), F.lit('"')).alias("q"), F.array(F.lit(" first word"), F.lit("x"), F.lit("second"), F.lit("second")).alias("kw"))), F.lit("```"))
    model = lambda df: df.withColumn("answer", F.when(way == 0, good).when(way == 1, F.to_json(F.struct(F.col("text").alias("q")))).when(way == 2, "no json {"))
    return L.rewritten(table(spark, sf_dir, "benchmark"), model=model).select("item_id", "queries", "terms")


@query(f"WITH {_near('q.vec_id % 20 = 0')} SELECT query, vec_id, score, rank::INT AS rank FROM near")
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return R.knn(vectors.where("vec_id % 20 = 0"), vectors).select("query", "vec_id", "score", "rank")


@query(f"""
WITH u AS ({_UNIT}), nn AS (SELECT q.vec_id AS query, v.vec_id, {_COS} AS score, 0 AS tier FROM u q JOIN u v ON v.label = q.label * 2 WHERE q.vec_id % 20 = 0
  UNION ALL SELECT q.vec_id, v.vec_id, {_COS}, 1 FROM u q, u v WHERE q.vec_id % 20 = 0)
, r AS (SELECT *, row_number() OVER (PARTITION BY query, tier ORDER BY score DESC, vec_id) AS rank, min(tier) OVER (PARTITION BY query) AS t FROM nn QUALIFY rank <= 40)
SELECT query, tier::INT AS tier, vec_id, score, rank::INT AS rank FROM r WHERE tier = t
""")
def vector_knn_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").withColumn("wanted", F.col("label") * 2)
    return R.knn(asked, vectors, label="label").select("query", "tier", "vec_id", "score", "rank")


@query(f"""
WITH {_near('q.vec_id % 20 <= 1')}
, p AS (SELECT query // 20 AS question, query % 20 AS pool, vec_id, score, rank FROM near)
, b AS (SELECT question, vec_id, max(score) AS score, min(pool * 1000 + rank) AS seen FROM p GROUP BY question, vec_id)
SELECT question, vec_id, score, (row_number() OVER (PARTITION BY question ORDER BY seen))::INT AS rank FROM b
""")
def merge_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    near = R.knn(vectors.where("vec_id % 20 <= 1"), vectors)
    pools = near.select((F.col("query") / 20).cast("long").alias("question"), (F.col("query") % 20).alias("pool"), "rank", "vec_id", "score")
    return R.merge_pools(pools, "question")


_FUSED = f"""
{_BM25}, {_near('q.vec_id IN (SELECT item_id FROM benchmark)')}
, pools AS (SELECT query AS item_id, 0 AS pool, rank, vec_id AS doc_id FROM near UNION ALL SELECT item_id, 1, rank, doc_id FROM lex)
, f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(pool * 1000 + rank) AS seen FROM pools GROUP BY item_id, doc_id)
, fused AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, seen) AS pos FROM f)
"""


@query(f"WITH {_FUSED} SELECT item_id, doc_id, score, pos::INT AS rank FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, vectors = (table(spark, sf_dir, t) for t in ("benchmark", "embeddings"))
    words = lexical(spark, sf_dir, items).select("item_id", F.lit(1).alias("pool"), "rank", "doc_id")
    asked = vectors.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = R.knn(asked, vectors).select(F.col("query").alias("item_id"), F.lit(0).alias("pool"), "rank", F.col("vec_id").alias("doc_id"))
    return R.fuse(near.unionByName(words), "item_id", "doc_id")


@query(r"""
WITH d AS (SELECT doc_id, lang, substr(regexp_replace(text, '\s+', '', 'g'), 1, 80) AS key, (substr(source, 4)::INT % 4) AS priority, n_chars FROM documents)
, k AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY priority, n_chars DESC, doc_id) AS n, min(doc_id) OVER (PARTITION BY lang, key) AS first FROM d WHERE key <> '')
SELECT lang, doc_id, priority, n_chars, (row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, first))::INT AS rank FROM k WHERE n = 1 QUALIFY rank <= 16
""")
def dedupe_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", T.clean_key("text").alias("key"), (F.substr("source", F.lit(4)).cast("int") % 4).alias("priority"), "n_chars")
    return R.dedupe(docs, "lang", "key", "priority", "n_chars", "doc_id").select("lang", "doc_id", "priority", "n_chars", "rank")


#: A chunk's number is its document's times this, and its part; a document of so many chunks would have hundreds of millions of characters.
PARTS = 1 << 20

# the hashing embedder written again: slots of tokens and pairs by md5, their counts over all chunks, signed sums by dimension, unit length
_EMBED = rf"""
{CHUNKS}
, ck AS (SELECT doc_id * {PARTS} + row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS id, chunk AS text FROM p WHERE chunk <> '')
, em AS (SELECT 'c' AS side, id, text FROM ck UNION ALL SELECT 'q', item_id, text FROM benchmark)
, et AS (SELECT side, id, {_TOKENS} AS t FROM em)
, ef AS (SELECT side, id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS x FROM et)
, es AS (SELECT side, id, ('0x' || left(md5(x), 8))::BIGINT % {embedding.SLOTS} AS slot, count(*) AS tf FROM ef GROUP BY ALL)
, en AS (SELECT slot, count(*) AS n FROM es WHERE side = 'c' GROUP BY slot)
, ew AS (SELECT side, id, slot, tf, tf * (ln(((SELECT count(*) FROM ck) + 1)::DOUBLE / (coalesce(n, 0) + 1)) + 1) AS w FROM es LEFT JOIN en USING (slot))
, ed AS (SELECT side, id, slot % {embedding.DIMS} AS d, sum(CASE WHEN (slot // {embedding.DIMS}) % 2 = 0 THEN w ELSE -w END) AS v, sum(tf) AS nf FROM ew GROUP BY ALL)
, el AS (SELECT side, id, sqrt(sum(v * v)) AS l, sum(nf)::INT AS n_features FROM ed GROUP BY side, id), eu AS (SELECT side, id, d, v / l AS v, n_features FROM ed JOIN el USING (side, id) WHERE l > 1e-9)
"""
# a few figures of a vector that tell it from others: a weighted sum, and its greatest component
_FIGURES = "round(sum(v * (d + 1)), 6) AS mix, round(max(abs(v)), 6) AS peak"
_NEAR_CHUNKS = f"""
{_EMBED}
, nc AS (SELECT q.id AS item_id, c.id, round(sum(q.v * c.v), 6) AS score FROM eu q JOIN eu c USING (d) WHERE q.side = 'q' AND c.side = 'c' GROUP BY ALL)
, al AS (SELECT q.id AS item_id, c.id, coalesce(nc.score, 0) AS score FROM (SELECT DISTINCT id FROM eu WHERE side = 'q') q CROSS JOIN (SELECT DISTINCT id FROM eu WHERE side = 'c') c LEFT JOIN nc ON nc.item_id = q.id AND nc.id = c.id)
, nr AS (SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM al QUALIFY rank <= 40)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc_id, part, text) of all chunks of the documents."""
    made = chunking.chunk_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), marks=MARKS)
    return made.select((F.col("doc_id") * PARTS + F.col("part")).alias("id"), "doc_id", "part", F.col("chunk").alias("text"))


def kept_slots(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns named of the chunks, and their slots, kept. Python gets few texts at a time, as they may be long."""
    with rows_to_python(spark, chunking.TEXTS):
        return keep(embedding.with_slots(chunks(spark, sf_dir).select(*columns, "text")))


def figures(vector: str) -> list:
    mix = F.aggregate(F.transform(vector, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return [F.round(mix, 6).alias("mix"), F.round(F.array_max(F.transform(vector, F.abs)), 6).alias("peak")]


@query(f"WITH RECURSIVE {_EMBED} SELECT id // {PARTS} AS doc_id, (id % {PARTS})::INT AS part, n_features, {_FIGURES} FROM eu WHERE side = 'c' GROUP BY id, n_features")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each chunk of each document, by the embedder that is fitted on them."""
    made = kept_slots(spark, sf_dir, "doc_id", "part")
    return embedding.Embedder(made).embed(made).where("vector IS NOT NULL").select("doc_id", "part", "n_features", *figures("vector"))


@query(f"WITH RECURSIVE {_EMBED} SELECT id AS item_id, n_features, {_FIGURES} FROM eu WHERE side = 'q' GROUP BY id, n_features")
def embedded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions' vectors, with what is rare among the chunks."""
    own = embedding.Embedder(kept_slots(spark, sf_dir))
    asked = own.embed(embedding.with_slots(table(spark, sf_dir, "benchmark")))
    return asked.where("vector IS NOT NULL").select("item_id", "n_features", *figures("vector"))


@query("SELECT item_id, CASE WHEN item_id // 10 % 3 = 1 THEN NULL ELSE len(text) END::DOUBLE AS first, CASE WHEN item_id // 10 % 3 = 1 THEN 'refused' END AS error FROM benchmark")
def embedding_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that answers in another order, and refuses every third ten of questions."""

    def model(texts: list[str]) -> list[tuple[int, list[float]]]:
        if any(int(t.split(" ", 1)[0]) // 10 % 3 == 1 for t in texts):
            raise RuntimeError("refused")
        return [(k, [len(t.split(" ", 1)[1])]) for k, t in reversed(list(enumerate(texts)))]

    numbered = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.col("item_id").cast("string"), F.lit(" "), "text").alias("text"))
    # calls are cut from the batch that a task gets, so questions of a call are brought together
    calls = numbered.repartition(F.floor(F.col("item_id") / 10)).sortWithinPartitions("item_id")
    return embedding.embed_with(model, calls, "item_id", call=10).select("item_id", F.get("vector", F.lit(0)).alias("first"), "error")


def near_chunks(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """(item_id, id, score, rank): the 40 chunks nearest to each question, by the corpus's own embedder."""
    made = kept_slots(spark, sf_dir, "id")
    own = embedding.Embedder(made)
    corpus = own.embed(made).select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"))
    asked = own.embed(embedding.with_slots(items)).select(F.col("item_id").alias("vec_id"), F.col("vector").alias("embedding"))
    return R.nearest(asked, corpus).select(F.col("query").alias("item_id"), F.col("vec_id").alias("id"), "score", "rank")


@query(f"WITH RECURSIVE {_NEAR_CHUNKS} SELECT item_id, id // {PARTS} AS doc_id, (id % {PARTS})::INT AS part, score, rank::INT AS rank FROM nr")
def question_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_chunks(spark, sf_dir, table(spark, sf_dir, "benchmark"))
    return near.select("item_id", F.floor(F.col("id") / PARTS).alias("doc_id"), (F.col("id") % PARTS).cast("int").alias("part"), "score", "rank")


@query(rf"""
WITH RECURSIVE {_NEAR_CHUNKS}, {_BM25}
, pools AS (SELECT item_id, 0 AS pool, min(rank) AS rank, id // {PARTS} AS doc_id FROM nr GROUP BY item_id, id // {PARTS} UNION ALL SELECT item_id, 1, rank, doc_id FROM lex)
, f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(pool * 1000 + rank) AS seen FROM pools GROUP BY item_id, doc_id)
, fused AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, seen) AS pos FROM f)
, t AS (SELECT doc_id, substr(regexp_replace(text, '\s+', '', 'g'), 1, 80) AS key, left(text, 1100) AS passage FROM documents)
, k AS (SELECT item_id, doc_id, score, key, passage, min(pos) OVER (PARTITION BY item_id, key) AS first,
    row_number() OVER (PARTITION BY item_id, key ORDER BY score DESC, pos) AS n FROM fused JOIN t USING (doc_id) WHERE key <> '')
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first))::INT AS rank, doc_id, score, passage FROM k WHERE n = 1 QUALIFY rank <= 8
""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: both pools from the documents and questions themselves, chunks by their own vectors and documents by their words."""
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    near = near_chunks(spark, sf_dir, items).select("item_id", "rank", F.floor(F.col("id") / PARTS).alias("doc_id"))
    return R.hybrid(docs, lexical(spark, sf_dir, items), R.best_place(near, "item_id", "doc_id"))


@query("""
WITH v AS (SELECT vec_id, (label % 3)::VARCHAR AS space FROM embeddings), n AS (SELECT space, count(*) AS n FROM v GROUP BY space)
SELECT space, count(*) AS n_queries, sum(least(40, n))::BIGINT AS n_exact, true AS recalled, true AS reads_less FROM v JOIN n USING (space) WHERE vec_id % 20 = 0 GROUP BY space
""")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index against exact search, by namespace: whether 95 per cent of the nearest are found, and less is read than all vectors."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).cast("string").alias("space"), "vec_id", "embedding")
    path = f"{shared_dir(spark)}/vectors-{L.source_name(spark, f'{sf_dir}/embeddings.parquet')}"
    if not L.exists(spark, f"{path}/lists/_SUCCESS"):
        vectors.build(rows.select("space", F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), path)
    asked = rows.where("vec_id % 20 = 0")
    found = vectors.search(spark, path, asked.select("space", F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))).select("query", "key", F.lit(1).alias("hit"))
    exact = R.nearest_within(asked.select("space", F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), rows.select("space", F.col("vec_id").alias("key"), F.col("embedding").alias("vector")))
    both = exact.join(found, ["query", "key"], "left").join(asked.select(F.col("vec_id").alias("query"), "space"), "query")
    recall = both.groupBy("space").agg(F.count_distinct("query").alias("n_queries"), F.count("*").alias("n_exact"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.95).alias("recalled"))
    return recall.join(vectors.share_scanned(spark, path), "space").select("space", "n_queries", "n_exact", "recalled", (F.col("bytes_read") < F.col("bytes_all")).alias("reads_less"))


@query(rf"""
WITH {_BM25}, sq AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS s FROM documents)
, expected AS (SELECT item_id, doc_id FROM benchmark b JOIN sq ON contains(sq.s, regexp_replace(b.text, '\s+', '', 'g')))
, per AS (SELECT e.item_id, bool_or(lex.rank <= 8) AS hit8, bool_or(lex.rank <= 30) AS hit30 FROM expected e LEFT JOIN lex ON lex.item_id = e.item_id AND lex.doc_id = e.doc_id GROUP BY e.item_id)
SELECT (SELECT count(*) FROM benchmark) AS n_questions, count(*) AS n_labelled, round(avg(CASE WHEN hit8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_8,
  round(avg(CASE WHEN hit30 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_30 FROM per
""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.operators import alignment

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = lexical(spark, sf_dir, items).select("item_id", "doc_id", "rank")
    expected = alignment.contained(items, docs)
    per = expected.join(found, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.bool_or(F.coalesce(F.col("rank") <= 8, F.lit(False))).alias("hit8"), F.bool_or(F.col("rank").isNotNull()).alias("hit30"))
    share = lambda c: F.round(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), 6)
    total = items.agg(F.count("*").alias("n_questions"))
    return per.agg(F.count("*").alias("n_labelled"), share("hit8").alias("recall_8"), share("hit30").alias("recall_30")).crossJoin(total).select("n_questions", "n_labelled", "recall_8", "recall_30")


@query("""
WITH v AS (SELECT vec_id, label, label % 2 AS space, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)), q AS (SELECT * FROM v WHERE vec_id % 20 = 0)
, c AS (SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 6) AS score, v.space = 0 AND v.label = q.label * 3 AS a, v.space = 0 AS b FROM q, v)
, t AS (SELECT query, vec_id, score, 0 AS tier FROM c WHERE a UNION ALL SELECT query, vec_id, score, 1 FROM c WHERE b UNION ALL SELECT query, vec_id, score, 2 FROM c)
, r AS (SELECT *, row_number() OVER (PARTITION BY query, tier ORDER BY score DESC, vec_id) AS rank, min(tier) OVER (PARTITION BY query) AS first FROM t QUALIFY rank <= 40)
SELECT query, tier::INT AS tier, vec_id, score, rank::INT AS rank FROM r WHERE tier = first
""")
def vector_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a namespace with the wanted label; without any, of the namespace; without any, all."""
    vectors = table(spark, sf_dir, "embeddings")
    inside = vectors.where("label % 2 = 0")
    asked = vectors.where("vec_id % 20 = 0")
    held = R.knn(asked.withColumn("wanted", F.col("label") * 3), inside, label="label").where("tier = 0").drop("tier")
    return indexing.tiers([held, R.knn(asked, inside).drop("tier"), R.knn(asked, vectors).drop("tier")], "query").select("query", "tier", "vec_id", "score", "rank")


@query("""
WITH s AS (SELECT label AS ns, vec_id % 50 AS id, vec_id AS v, embedding FROM embeddings WHERE vec_id % 3 > 0), n AS (SELECT label AS ns, vec_id % 50 AS id, vec_id AS v, embedding FROM embeddings WHERE vec_id % 3 = 0)
, u AS (SELECT ns, id, v, 0 AS new FROM s UNION ALL SELECT ns, id, v, 1 FROM n), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY ns, id ORDER BY new DESC, v DESC) = 1) SELECT ns, id, v FROM k
""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("ns"), (F.col("vec_id") % 50).alias("id"), F.col("vec_id").alias("v"), "embedding")
    return indexing.upsert(rows.where("v % 3 > 0"), rows.where("v % 3 = 0"), ["ns", "id"], "v").select("ns", "id", "v")


@query("""
WITH s AS (SELECT c_custkey AS id FROM customer WHERE c_custkey BETWEEN 25 AND 49)
SELECT 50::BIGINT AS cursor, 50 >= (SELECT count(*) FROM customer) AS done, (SELECT count(*) FROM customer) AS total, 25 AS limit, (SELECT count(*) FROM s) AS articles, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT id FROM s)) AS chunks
""")
def index_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second step over customers, whose keys are their places; orders stand for chunks."""
    arts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"))
    return indexing.step(arts, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), 25, 1000)


@query("""
WITH p AS (SELECT l_orderkey AS req, l_linenumber AS i, l_partkey AS v FROM lineitem) SELECT req, string_agg(v::VARCHAR, ',' ORDER BY i, v::VARCHAR) AS vs FROM p GROUP BY req
""")
def embeddings_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("req"), F.col("l_linenumber").alias("i"), F.col("l_partkey").cast("string").alias("v"))
    return indexing.by_index(parts, "req", "i", "v").select("req", F.array_join("values", ",").alias("vs"))


@query(f"""
WITH {_FUSED}, k AS (SELECT item_id, doc_id, pos, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 END AS s FROM fused WHERE pos <= 16)
SELECT item_id, doc_id, (row_number() OVER (PARTITION BY item_id ORDER BY s DESC NULLS LAST, pos))::INT AS rank FROM k
""")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen fused candidates in the order of a model's scores, those without one after the others as they were."""
    pool = rrf_fusion(spark, sf_dir).where(F.col("rank") <= R.POOL)
    model = lambda df: df.withColumn("rerank_score", F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 7).cast("double")))
    return R.rerank(pool, "item_id", model).select("item_id", "doc_id", "rank")
