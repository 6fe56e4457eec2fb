"""Ranked retrieval: postings, BM25, exact nearest neighbours in blocks, fusion, de-duplication, top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.storage import BROADCAST_BYTES, broadcast_if_small, keep, rows_to_python

# Fixed values of the retrieval pipeline.
LEXICAL_TOP, VECTOR_TOP, RRF_K, POOL, TOP = 30, 40, 60, 16, 8
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Vectors in a block of the blocked search.
QUERY_BLOCK, DATA_BLOCK = 512, 4096
#: Queries that the blocks of a namespace are sent to together, and those of them that meet a block at once.
GROUP, SLICE = 2048, 256


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(token, key, tf, first_pos); aggregated before it is shuffled."""
    tokens = docs.select(key, F.posexplode(T.bigrams(text)).alias("pos", "token"))
    return tokens.groupBy("token", key).agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def ranked(df: DataFrame, within: list[str], order: list[Column], top: int | None = None) -> DataFrame:
    """df with rank from 1 within its group; only the first top (Spark cuts each task's rows before it shuffles)."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    return out if top is None else out.where(F.col("rank") <= top)


def blocks(vectors: DataFrame, key: str, vector: str, size: int, label: str | None = None) -> DataFrame:
    """(block, ids, labels, v): about size vectors a row, by a hash of the key, so a row's bytes are bounded."""
    n = vectors.count()
    many = max(1, -(-n // size))
    part = F.pmod(F.xxhash64(key), F.lit(many)).alias("block")
    tag = F.col(label).cast("int") if label else F.lit(0)
    each = vectors.where(F.col(vector).isNotNull()).select(part, F.struct(F.col(key).alias("id"), F.coalesce(tag, F.lit(-1)).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v")).alias("r"))
    return each.groupBy("block").agg(F.collect_list("r").alias("rows"))


def knn(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = None, top: int = VECTOR_TOP) -> DataFrame:
    """(query, tier, key, score, rank): the nearest vectors of each query by cosine, ties by key, itself included.

    Exact, in blocks: each pair of a query block and a data block is one matrix product that returns its best top rows
    for each query; Spark ranks those. With a label column in vectors and one named wanted in queries, tier 0 is the rows of the
    wanted label; a query that finds none there gets tier 1, all rows.
    """
    q = blocks(queries, key, vector, QUERY_BLOCK, "wanted" if label else None).select(F.col("block").alias("qblock"), F.col("rows").alias("q"))
    d = blocks(vectors, key, vector, DATA_BLOCK, label).select("block", "rows")
    tiers = [0, 1] if label else [0]

    def unit(rows: pa.StructArray) -> np.ndarray:
        v = rows.field("v")
        dims = np.diff(v.offsets.to_numpy())
        if len(dims) and (dims != dims[0]).any():
            raise ValueError("vectors of a search have different lengths")
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qs, ds = batch.column("q")[i].values, batch.column("rows")[i].values
                qid, did, want, have = (x.to_numpy() for x in (qs.field("id"), ds.field("id"), qs.field("label"), ds.field("label")))
                score = np.round(unit(qs) @ unit(ds).T, 6)
                score[~np.isfinite(score)] = -np.inf
                for tier in tiers:
                    s = np.where(want[:, None] == have[None, :], score, -np.inf) if label and tier == 0 else score
                    least = np.partition(s, -top, axis=1)[:, -top] if s.shape[1] > top else np.full(len(s), -np.inf)
                    r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))  # the first top and what ties with the last of them
                    order = np.lexsort((did[c], -s[r, c], r))
                    r, c = r[order], c[order]
                    first = np.arange(len(r)) - np.searchsorted(r, r) < top
                    r, c = r[first], c[first]
                    yield pa.RecordBatch.from_arrays([pa.array(qid[r], pa.int64()), pa.array(np.full(len(r), tier, np.int32)), pa.array(did[c], pa.int64()), pa.array(s[r, c])], names=["query", "tier", key, "score"])

    found = q.crossJoin(d).mapInArrow(run, f"query long, tier int, {key} long, score double")
    with rows_to_python(queries.sparkSession, 1):  # a pair of blocks is megabytes
        best = keep(ranked(found, ["query", "tier"], [F.desc("score"), F.asc(key)], top))
    lowest = F.min("tier").over(Window.partitionBy("query"))
    return best.withColumn("__t", lowest).where("tier = __t").drop("__t")


def nearest(queries: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = VECTOR_TOP) -> DataFrame:
    """(query, key, score, rank) as of knn, for queries that are few by their count: each task gets them all and meets its vectors as they are computed,
    which are neither written nor shuffled. More queries than that take knn.
    """
    asked = keep(queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")))
    n = asked.count()
    dims = asked.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()["d"]
    if n * 8 * (dims + top) > BROADCAST_BYTES:
        return knn(asked.select(F.col("id").alias(key), F.col("v").alias(vector)), keep(vectors), key, vector, top=top).drop("tier")
    rows = asked.collect()  # counted above
    ids, x = np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], float).reshape(n, dims)
    shared = queries.sparkSession.sparkContext.broadcast((ids, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        bar = np.full(len(ids), -np.inf)  # as many vectors as asked for have reached it
        for batch in batches:
            v = batch.column("v")
            if not len(v) or not len(ids):
                continue
            if (v.value_lengths().to_numpy() != x.shape[1]).any():
                raise ValueError("vectors of a search have different lengths")
            d, did = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), batch.column("id").to_numpy()
            s = np.round(x @ (d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)).T, 6)
            s[~np.isfinite(s)] = -np.inf
            if s.shape[1] > top:
                bar = np.maximum(bar, np.partition(s, -top, axis=1)[:, -top])
            r, c = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
            order = np.lexsort((did[c], -s[r, c], r))
            r, c = r[order], c[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < top
            r, c = r[first], c[first]
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(did[c], pa.int64()), pa.array(s[r, c])], names=["query", key, "score"])

    each = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    with rows_to_python(queries.sparkSession, DATA_BLOCK):
        return keep(ranked(each.mapInArrow(run, f"query long, {key} long, score double"), ["query"], [F.desc("score"), F.asc(key)], top))


class Best:
    """The best of each of n queries among blocks of scores that come one after the other: the highest, of equal ones those of the least key."""

    def __init__(self, n: int, top: int):
        self.top, self.bar, self.tag = top, np.full(n, -np.inf), np.zeros(0, np.int32)
        self.row, self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, score: np.ndarray, key: np.ndarray, digits: int, tag: int = 0) -> None:
        """Takes scores (queries, keys), minus infinity for what isn't met, that are equal when they are in so many digits."""
        room = 10.0**-digits
        if np.count_nonzero(score >= self.bar[:, None] - room) > 4 * self.top * len(score):
            self.bar = np.maximum(self.bar, np.partition(score, -self.top, axis=1)[:, -self.top] - room)
        r, c = np.nonzero((score >= self.bar[:, None] - room) & (score > -np.inf))
        if not len(r):
            return
        row, keys = np.concatenate([self.row, r]), np.concatenate([self.key, key[c]])
        scores, tags = np.concatenate([self.score, np.round(score[r, c], digits)]), np.concatenate([self.tag, np.full(len(r), tag, np.int32)])
        order = np.lexsort((keys, -scores, row))
        nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        kept = order[nth < self.top]
        self.row, self.key, self.score, self.tag = row[kept], keys[kept], scores[kept], tags[kept]
        last = order[nth == self.top - 1]
        self.bar[row[last]] = scores[last]


def grouped(queries: DataFrame, size: int) -> DataFrame:
    """(space, grp, ids, x, dims): queries (space, query, vector) in rows of about so many, ids and vectors as bytes."""
    many = broadcast_if_small(keep(queries.groupBy("space").agg(F.ceil(F.count("*") / size).cast("int").alias("many"))), 64)

    def pack(at: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(f["vector"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"space": [at[0]], "grp": [at[1]], "ids": [f["query"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "dims": [x.shape[1]]})

    each = queries.join(many, "space").select("space", F.pmod(F.xxhash64("query"), "many").cast("int").alias("grp"), "query", "vector")
    return keep(each.groupBy("space", "grp").applyInPandas(pack, "space string, grp int, ids binary, x binary, dims int"))


def in_turn(groups: DataFrame, blocks: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over the rows of groups (space, grp, ...), kept, each with all blocks (space, blk from 0, ...) of its space behind it, a row at a time; its own blk is -1. Kept, so that the number of rows holds."""
    n = groups.count()
    sent = blocks.join(broadcast_if_small(groups.select("space", "grp"), 64), "space").unionByName(groups.withColumn("blk", F.lit(-1)), allowMissingColumns=True)
    with rows_to_python(groups.sparkSession, 4):
        return keep(sent.repartition(min(2000, max(1, 4 * n)), "space", "grp").sortWithinPartitions("space", "grp", "blk").mapInArrow(run, schema))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest_within(queries: DataFrame, vectors: DataFrame, top: int = VECTOR_TOP) -> DataFrame:
    """(query, key, score): the nearest of each query (space, query, vector) among vectors (space, key, vector) of its namespace by cosine, ties by key, itself included.

    Exact: a namespace's blocks of vectors go by groups of its queries, which keep their best so far, so a task holds a block and a group, and rows for each
    query are as many as it asks for. Null vectors are neither asked for nor found.
    """
    sound = lambda df, key: df.where(f"space IS NOT NULL AND {key} IS NOT NULL AND vector IS NOT NULL").select(F.col("space").cast("string").alias("space"), key, "vector")
    wanted, all_rows = sound(queries, "query"), sound(vectors, "key")
    many = broadcast_if_small(keep(all_rows.groupBy("space").agg(F.ceil(F.count("*") / DATA_BLOCK).cast("int").alias("many"))), 64)

    def pack(at: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(f["vector"].to_numpy())  # floats stay floats until they meet
        return pd.DataFrame({"space": [at[0]], "blk": [at[1]], "keys": [f["key"].to_numpy(np.int64).tobytes()], "v": [x.tobytes()]})

    each = all_rows.join(many, "space").select("space", F.pmod(F.xxhash64("key"), "many").cast("int").alias("blk"), "key", "vector")
    packed = keep(each.groupBy("space", "blk").applyInPandas(pack, "space string, blk int, keys binary, v binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None

        def done() -> Iterator[pa.RecordBatch]:
            for a, b in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a * SLICE + b.row]), pa.array(b.key), pa.array(b.score)], names=["query", "key", "score"])

        for r in (r for batch in batches for r in batch.to_pylist()):
            if r["blk"] < 0:
                if ids is not None:
                    yield from done()
                ids, dims = np.frombuffer(r["ids"], np.int64), r["dims"]
                x = unit_rows(np.frombuffer(r["x"]).reshape(-1, dims))
                best = [Best(len(x[a : a + SLICE]), top) for a in range(0, len(x), SLICE)]
                continue
            key = np.frombuffer(r["keys"], np.int64)
            v = np.frombuffer(r["v"], np.float32 if len(r["v"]) == len(key) * dims * 4 else np.float64)
            if len(v) != len(key) * dims:
                raise ValueError("vectors of a search have different lengths")
            v = unit_rows(v.reshape(-1, dims).astype(np.float64)).T
            for a, b in enumerate(best):
                score = x[a * SLICE : (a + 1) * SLICE] @ v
                score[~np.isfinite(score)] = -np.inf
                b.add(score, key, 6)
        if ids is not None:
            yield from done()

    return in_turn(grouped(wanted, GROUP), packed, run, "query long, key long, score double")


def merge_pools(pools: DataFrame, group: str = "query", key: str = "vec_id") -> DataFrame:
    """(group, key, score, rank) from rows (group, pool, rank, key, score): the best score of each key, in the order first seen."""
    seen = F.struct("pool", "rank")
    best = pools.groupBy(group, key).agg(F.max("score").alias("score"), F.min(seen).alias("seen"))
    return ranked(best, [group], [F.asc("seen")]).drop("seen")


def fuse(pools: DataFrame, group: str, key: str, k: int = RRF_K) -> DataFrame:
    """(group, key, score, rank): sum of 1 / (k + rank) over pools (group, pool, rank, key); ties by what was seen first."""
    total = pools.groupBy(group, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("pool", "rank")).alias("seen"))
    return ranked(total, [group], [F.desc("score"), F.asc("seen")]).drop("seen")


def dedupe(matches: DataFrame, group: str, text_key: str, priority: str, score: str, pos: str, top: int | None = POOL) -> DataFrame:
    """One match for each text key: of the lowest priority, then the highest score, then the first. By score; ties where the key was first seen."""
    own = Window.partitionBy(group, text_key)
    kept = matches.where(F.col(text_key) != "").withColumn("__first", F.min(pos).over(own))
    kept = kept.withColumn("__n", F.row_number().over(own.orderBy(F.asc(priority), F.desc(score), F.asc(pos)))).where("__n = 1")
    return ranked(kept, [group], [F.desc(score), F.asc("__first")], top).drop("__n", "__first")


def rerank(matches: DataFrame, group: str, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Reorders by the score that a model adds (rerank_score, null: as before); without a model, as it is. Drops nothing."""
    if model is None:
        return matches
    return ranked(model(matches).withColumnRenamed("rank", "old_rank"), [group], [F.desc_nulls_last("rerank_score"), F.asc("old_rank")])


def best_place(near: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, rank): of several ranked parts of one key the best rank."""
    return near.groupBy(group, key).agg(F.min("rank").alias("rank"))


def hybrid(docs: DataFrame, lexical: DataFrame, near: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score, passage): lexical and vector ranks fused, de-duplicated by text, reranked, the first eight.

    lexical is what a search of the stored index gave, near what one by vectors gave (item_id, rank, doc_id; a document once for an item).
    Either may be empty for an item. Of the texts only those of candidates are fetched.
    """
    pool = lambda df, n: df.select("item_id", F.lit(n).alias("pool"), "rank", "doc_id")
    fused = fuse(pool(near, 0).unionByName(pool(lexical, 1)), "item_id", "doc_id").withColumnRenamed("rank", "pos")
    fused = keep(fused)
    wanted = docs.join(broadcast_if_small(fused.select("doc_id").distinct(), 64), "doc_id", "left_semi")
    # kept, as a condition on the key would be looked up for every document otherwise
    texts = keep(wanted.select("doc_id", T.clean_key("text").alias("key"), F.left("text", F.lit(1100)).alias("passage"), F.lit(0).alias("priority")))
    best = dedupe(fused.join(texts, "doc_id"), "item_id", "key", "priority", "score", "pos")
    return rerank(best, "item_id", model).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score", "passage")
