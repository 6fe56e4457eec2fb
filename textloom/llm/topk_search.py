"""Exact search for the greatest inner products, by branch and bound over ball trees, one for each shard.

Vectors are taken as integers, so scores are exact. Distinct vectors are dealt to cluster shards, large shards to parts of bounded size,
and each part gets a ball tree where it is searched. No inner product of a query q within a ball of centre c and radius r exceeds
q.c + |q| r, so a query opens the nodes of a tree by this bound, greatest first, and ends at the first whose bound is less than
its kth score so far. Shards are balls too: in each wave a query goes to the next shards by bound, and takes the kth score of
the waves before with it, so that trees start from it and shards below it are never opened.

The bounds decide what is skipped and never what is found: without any use of them, as with vectors that point anywhere at random,
each query is compared with every vector, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import broadcast_if_small, by_group, cut

K, EVERY, SCALE = 5, 50, 256
#: Distinct vectors of a shard on average, and bytes of all centres, beyond which shards grow (and are dealt to more parts).
SHARD, CENTRE_BYTES = 4096, 4 << 20
#: Vectors that each centre is fitted on, on average.
PER_CENTRE = 8
#: Bytes of a part's vectors, and of a block of queries that it meets.
PART_BYTES, BLOCK_BYTES = 4 << 20, 4 << 20
LEAF = 64
#: Shards, by rank of their bounds, at which a wave ends; the last wave has all others.
WAVES = (1, 4)
#: What double precision holds of integers without loss; scores that could be greater are computed with whole numbers of any size.
EXACT = float(1 << 53)
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
NONE = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, h1, h2) of the different rows that take part: v the scaled integers as doubles, which hold them exactly."""
    scaled = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double") * SCALE)
    whole = F.transform("v", lambda y: F.when(F.abs(y) < float(1 << 62), F.floor(y).cast("double")).otherwise(y))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled.alias("v")).where(F.coalesce(sound, F.lit(False))).select("id", whole.alias("v"))
    return rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2")).dropDuplicates(["id", "h1", "h2"])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact, as 64-bit integers; beyond their range, its ends."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    exact = whole(q) @ whole(x).T if q.shape[1] else np.zeros((len(q), len(x)), object)
    return np.array([[min(max(int(s), LEAST), GREATEST) for s in row] for row in exact], np.int64).reshape(len(q), len(x))


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What no inner product of a row of q with anything in the balls exceeds, rounding included. centre: (n, d) or (rows, n, d)."""
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((q * q).sum(1))[:, None]
        middle = q @ centre.T if centre.ndim == 2 else np.einsum("qd,qnd->qn", q, centre)
        far = np.sqrt((centre * centre).sum(-1))
        top = middle + length * radius + 1e-9 * length * (far + radius) + 1
    return np.maximum(np.where(np.isnan(top), np.inf, top), float(LEAST))


class BallTree:
    """Nodes in arrays: centre, radius, the range of rows, and the first of two children (-1: a leaf)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order, nodes, todo = np.arange(len(x)), [[0, len(x), -1]], [0]
        while todo:
            at = todo.pop()
            a, b, _ = nodes[at]
            if b - a <= leaf:
                continue
            rows = x[self.order[a:b]]
            with np.errstate(over="ignore", invalid="ignore"):
                one = rows[((rows - rows[0]) ** 2).sum(1).argmax()]
                other = rows[((rows - one) ** 2).sum(1).argmax()]
                along = np.nan_to_num(rows @ (other - one))
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(along, half)]
            nodes[at][2] = len(nodes)
            todo += [len(nodes), len(nodes) + 1]
            nodes += [[a, a + half, -1], [a + half, b, -1]]
        self.first, self.end, self.child = np.array(nodes).T
        self.x = x[self.order]
        with np.errstate(over="ignore", invalid="ignore"):
            self.centre = np.array([self.x[a:b].mean(0) for a, b, _ in nodes])
            far = [np.sqrt(((self.x[a:b] - c) ** 2).sum(1)).max() for (a, b, _), c in zip(nodes, self.centre, strict=True)]
        self.radius = np.array([np.inf if np.isnan(f) else f * (1 + 1e-9) for f in far])


def best_of(query: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query: greatest score, then smallest name; ordered by query."""
    order = np.lexsort((name, ~score, query))
    q = query[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < k]


def search_part(x: np.ndarray, names: np.ndarray, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, names) of the k best rows of x for each query; only those with at least its least score need be there.

    names: up to k + 1 of each row, ascending (NONE: no more); own: the name that a query isn't compared with.
    """
    tree = BallTree(x)
    names = names[tree.order]
    score, name = np.full((len(q), k), LEAST, np.int64), np.full((len(q), k), NONE, np.int64)
    kth = least.astype(np.float64)
    open_at = np.full((len(q), len(tree.child)), -np.inf)
    open_at[:, :1] = bounds(q, tree.centre[:1], tree.radius[:1])
    left = np.arange(len(q))
    while len(left):
        node = open_at[left].argmax(1)
        going = (open_at[left, node] >= kth[left]) & (open_at[left, node] > -np.inf)
        left, node = left[going], node[going]
        open_at[left, node] = -np.inf
        inner = tree.child[node] >= 0
        if inner.any():
            rows, two = left[inner], tree.child[node[inner]][:, None] + np.arange(2)
            open_at[rows[:, None], two] = bounds(q[rows], tree.centre[two], tree.radius[two])
        for leaf in np.unique(node[~inner]).tolist():
            rows, a, b = left[node == leaf], tree.first[leaf], tree.end[leaf]
            found = products(q[rows], tree.x[a:b])
            r, c = np.nonzero(found >= kth[rows][:, None])
            each = names[a:b][c]
            keep = (each != NONE) & (each != own[rows[r]][:, None])
            i, j = np.nonzero(keep)
            if not len(i):
                continue
            hit = np.unique(rows[r[i]])
            held, place = np.nonzero(name[hit] != NONE)
            who = np.concatenate([hit[held], rows[r[i]]])
            scores = np.concatenate([score[hit[held], place], found[r[i], c[i]]])
            what = np.concatenate([name[hit[held], place], each[i, j]])
            best = best_of(who, scores, what, k)
            who = who[best]
            starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
            score[who, rank], name[who, rank] = scores[best], what[best]
            full = hit[name[hit, -1] != NONE]
            kth[full] = np.maximum(kth[full], score[full, -1].astype(np.float64))
    return score, name


def fit_centres(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """k-means on a bounded sample; the centres only decide which vectors share a shard."""
    rng = np.random.default_rng(11)
    centres = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        near = ((centres * centres).sum(1) - 2 * (sample @ centres.T)).argmin(1)
        total, count = np.zeros_like(centres), np.bincount(near, minlength=n)
        np.add.at(total, near, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def sharded(rows: DataFrame, k: int) -> tuple[DataFrame, pd.DataFrame]:
    """The distinct vectors with their k + 1 smallest ids, shard and part; and a row for each shard: centre, radius and parts.

    Shards hold vectors of one length. Clusters are fitted to the most frequent length; the others have one shard each, around zero.
    """
    spark = rows.sparkSession
    same = Window.partitionBy("h1", "h2").orderBy("id")
    # of each vector that many rows have, a task sends k + 1 ids only: Spark limits the rank before it shuffles
    few = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    nodes = cut(few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")).withColumn("d", F.size("v")))
    most = nodes.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    width, count = (most[0]["d"], most[0]["n"]) if most else (0, 0)
    n_centres = max(1, min(-(-count // SHARD), CENTRE_BYTES // (8 * max(1, width))))
    centres = np.zeros((1, width))
    if n_centres > 1:
        sample = nodes.where(F.col("d") == width).orderBy("h1", "h2").limit(n_centres * PER_CENTRE).select("v").toPandas()["v"]
        with np.errstate(over="ignore", invalid="ignore"):
            centres = np.nan_to_num(fit_centres(np.stack(sample.to_numpy()).astype(np.float64), n_centres))
    shared = spark.sparkContext.broadcast(centres)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for f in frames:
            shard, far = np.zeros(len(f), np.int32), np.zeros(len(f))
            size = f["d"].to_numpy()
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = np.stack(f["v"].to_numpy()[at]).reshape(len(at), d).astype(np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    if d == c.shape[1]:
                        shard[at] = np.nan_to_num((c * c).sum(1) - 2 * (x @ c.T), nan=np.inf).argmin(1)
                        x = x - c[shard[at]]
                    far[at] = np.nan_to_num(np.sqrt((x * x).sum(1)), nan=np.inf, posinf=np.inf)
            yield f.assign(shard=shard, far=far)

    placed = cut(nodes.mapInPandas(assign, "h1 long, h2 long, v array<double>, ids array<long>, d int, shard int, far double"))
    # a row for each shard: as many as centres, and one for each further length
    balls = placed.groupBy("d", "shard").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toPandas().sort_values(["d", "shard"], ignore_index=True)
    balls["centre"] = [centres[s] if d == width else np.zeros(d) for d, s in zip(balls["d"], balls["shard"], strict=True)]
    balls["parts"] = [-(-n * 8 * max(1, d) // PART_BYTES) for n, d in zip(balls["n"], balls["d"], strict=True)]
    return placed, balls


def wave(queries: DataFrame, placed: DataFrame, balls: pd.DataFrame, first: int, end: int | None, k: int) -> DataFrame:
    """(id, h1, h2, score, name): what the shards of these ranks have for each query that their bounds don't rule out."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(balls)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for f in frames:
            size, out = f["v"].map(len).to_numpy(), []
            for d in np.unique(size).tolist():
                own, at = table[table["d"] == d], np.flatnonzero(size == d)
                if not len(own):
                    continue
                q = np.stack(f["v"].to_numpy()[at]).reshape(len(at), d).astype(np.float64)
                top = bounds(q, np.stack(own["centre"].to_numpy()).reshape(len(own), d), own["radius"].to_numpy() * (1 + 1e-9))
                order = np.argsort(-top, axis=1, kind="stable")[:, first:end]
                bound = np.take_along_axis(top, order, 1)
                r, c = np.nonzero(bound >= f["kth"].to_numpy()[at][:, None])
                chosen = order[r, c]
                out.append(f.iloc[at[r]].assign(d=np.int32(d), shard=own["shard"].to_numpy()[chosen]))
            if out:
                yield pd.concat(out)

    going = cut(queries.mapInPandas(choose, "id long, h1 long, h2 long, v array<double>, kth double, d int, shard int"))
    sizes = broadcast_if_small(cut(going.groupBy("d", "shard").agg(F.count("*").alias("m"))), 24)
    parts = spark.createDataFrame(balls[["d", "shard", "parts"]].astype({"d": "int32", "shard": "int32", "parts": "int32"}), "d int, shard int, parts int")
    blocks = sizes.join(broadcast_if_small(parts, 24), ["d", "shard"]).withColumn("blocks", F.ceil(F.col("m") * 8 * F.greatest("d", F.lit(1)) / BLOCK_BYTES).cast("int"))
    blocks = broadcast_if_small(cut(blocks.select("d", "shard", "parts", "blocks")), 32)
    at = ["d", "shard", "part", "block"]
    # vectors only of shards that a query goes to, once for each block of its queries; a query to each part of its shards
    vectors = placed.join(blocks, ["d", "shard"]).select(
        "d", "shard", F.pmod("h2", "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(False).alias("asks"), F.lit(0).cast("long").alias("id"), "h1", "h2", "v", "ids", F.lit(0.0).alias("kth"),
    )
    asked = going.join(blocks, ["d", "shard"]).select(
        "d", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id", "h1"), "blocks").cast("int").alias("block"),
        F.lit(True).alias("asks"), "id", "h1", "h2", "v", F.lit(None).cast("array<long>").alias("ids"), "kth",
    )

    def each(g: pd.DataFrame) -> pd.DataFrame:
        is_query, width = g["asks"].to_numpy(bool), int(g["d"].iloc[0])
        v = np.stack(g["v"].to_numpy()).reshape(len(g), width).astype(np.float64)
        mine, theirs = g[is_query], g[~is_query]
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"id": [], "h1": [], "h2": [], "score": [], "name": []}).astype("int64")
        names = np.full((len(theirs), k + 1), NONE, np.int64)
        for i, ids in enumerate(theirs["ids"]):
            names[i, : len(ids)] = ids
        score, name = search_part(v[~is_query], names, v[is_query], mine["id"].to_numpy().astype(np.int64), mine["kth"].to_numpy(), k)
        r, c = np.nonzero(name != NONE)
        keys = {x: mine[x].to_numpy().astype(np.int64)[r] for x in ("id", "h1", "h2")}
        return pd.DataFrame(keys | {"score": score[r, c], "name": name[r, c]})

    both = vectors.unionByName(asked).repartition(*at).sortWithinPartitions(*at)
    return both.mapInPandas(by_group(at, each), "id long, h1 long, h2 long, score long, name long")


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k greatest integer inner products with others.

    A component x counts as floor(256 * x), in double precision. Ties go to the smaller id; a query with fewer than k candidates has all.
    Rows without id, with a null vector, or with components that are null or not finite (256 times them included) are neither queries
    nor candidates. A vector's candidates have its length; the empty vector scores 0 with others such. Repeated rows are one; rows of
    one id and other vectors are each a query and a candidate, but never for their own id. Scores beyond 64 bits count as the greatest or
    least there is. An empty table gives no rows, and columns of other names aren't read.
    """
    rows = cut(usable(vectors, id_col, vec_col))
    placed, balls = sharded(rows, k)
    queries = rows.where(F.col("id") % every == 0)
    key, found = ["id", "h1", "h2"], None
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "name")
    ends = [w for w in WAVES if w < len(balls)]
    for first, end in zip([0, *ends], [*ends, None], strict=True):
        if found is None:
            state = queries.withColumn("kth", F.lit(float("-inf")))
        else:
            # the kth score so far, for queries that have k
            kth = found.groupBy(*key).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
            state = queries.join(kth, key, "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        new = wave(state.select(*key, "v", "kth"), placed, balls, first, end, k)
        both = new if found is None else found.unionByName(new)
        found = cut(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*key, "score", "name"))
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.select(F.col("id").alias("query_id"), "rank", F.col("name").alias("vec_id"), "score")
