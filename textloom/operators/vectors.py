"""A stored index of vectors by namespace: an inverted file of cells, product-quantised residuals, exact re-ranking.

For each namespace, cells and code books are fitted on a bounded sample, where the vectors are read; so many cells are then opened, and so many
candidates re-ranked, as queries of the sample need for the recall asked for among all vectors of the namespace. Lists hold 16 bytes a vector beside the vector itself: a search reads
the codes of the cells it opens, and the vectors of its candidates alone. Namespaces are folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import retrieval
from textloom.storage import BROADCAST_BYTES, broadcast_if_small, keep

#: Vectors of a namespace that its cells and books are fitted on, cells at most, vectors of a cell on average.
SAMPLE, CELLS, PER_CELL = 4096, 512, 64
#: Stretches of a vector with a code each, and codes of a stretch at most.
PARTS, CODES = 16, 256
#: Rows of a block that meets a namespace's books in one task, and queries that its codes are sent to together.
BLOCK, GROUP = 16384, 512
#: Queries whose candidates in a block of vectors are re-ranked in one task.
RANKED = 8192
#: Digits of an inner product with a coded vector.
DIGITS = 9
#: The recall that settings must have before they are taken, and queries of a namespace that are asked for it.
RECALL, ASKED = 0.97, 100
#: Shares of the cells that may be opened; a query takes 2, 4, 8, ... times the places asked for as candidates.
SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1)
BOOK = "space string, dims int, cells int, probes int, more int, coarse binary, books binary"


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


def _means(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        total, count = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(total, at, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Books:
    """A namespace's cells and code books."""

    def __init__(self, coarse: np.ndarray, books: np.ndarray, probes: int, more: int):
        self.coarse, self.books, self.probes, self.more = coarse, books, probes, more  # (cells, d), (parts, codes, width)

    @classmethod
    def fit(cls, x: np.ndarray, n: int) -> Books:
        coarse = _means(x, max(1, min(CELLS, n // PER_CELL)))
        rest = x - coarse[_nearest(x, coarse)]
        width = -(-x.shape[1] // PARTS)
        rest = np.pad(rest, ((0, 0), (0, width * PARTS - x.shape[1])))
        out = cls(coarse, np.zeros((PARTS, min(CODES, len(x)), width)), len(coarse), 1)
        for p in range(PARTS):
            means = _means(rest[:, p * width : (p + 1) * width], CODES)
            out.books[p, : len(means)] = means
        return out

    def met(self, q: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """At which probe of each query vectors of these cells are met."""
        return self.turns(q)[:, cell]

    def turns(self, q: np.ndarray) -> np.ndarray:
        """At which probe of each query each cell is opened."""
        order = np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")
        rank = np.empty(order.shape, np.int16)
        np.put_along_axis(rank, order, np.arange(order.shape[1], dtype=np.int16)[None, :], 1)
        return rank

    def levels(self) -> list[int]:
        """The numbers of cells that may be opened."""
        return sorted({max(1, round(len(self.coarse) * share)) for share in SHARES})

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of unit vectors."""
        cell, width = _nearest(x, self.coarse), self.books.shape[2]
        rest = np.pad(x - self.coarse[cell], ((0, 0), (0, width * PARTS - x.shape[1])))
        return cell, np.stack([_nearest(rest[:, p * width : (p + 1) * width], self.books[p]) for p in range(PARTS)], 1).astype(np.uint8)

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        rest = self.books[np.arange(PARTS), codes].reshape(len(codes), -1)
        return self.coarse[cell] + rest[:, : self.coarse.shape[1]]

    def rough(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with coded vectors, in as many digits as are equal wherever a vector's copies stand."""
        return np.round(q @ self.decoded(cell, codes).T, DIGITS)

    def row(self, space: str) -> dict:
        return {"space": space, "dims": self.coarse.shape[1], "cells": len(self.coarse), "probes": self.probes, "more": self.more, "coarse": self.coarse.tobytes(), "books": self.books.tobytes()}

    @classmethod
    def read(cls, r: dict) -> Books:
        coarse = np.frombuffer(r["coarse"]).reshape(r["cells"], r["dims"])
        width = -(-r["dims"] // PARTS)
        return cls(coarse, np.frombuffer(r["books"]).reshape(PARTS, -1, width), r["probes"], r["more"])


def fit(vectors: DataFrame) -> DataFrame:
    """A row of books for each namespace of vectors (space, key, vector)."""
    nth = F.row_number().over(Window.partitionBy("space").orderBy(F.xxhash64("key"), "key"))
    # keys alone are sorted by namespace, and only those of the sample get their vectors
    keys = keep(vectors.select("space", "key").withColumn("__n", nth).where(F.col("__n") <= SAMPLE).select("space", "key"))
    some = vectors.join(broadcast_if_small(keys, 64), ["space", "key"], "left_semi").join(vectors.groupBy("space").agg(F.count("*").alias("n")), "space")

    def train(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("key")
        return pd.DataFrame([Books.fit(_unit(f["vector"]), int(f["n"].iloc[0])).row(f["space"].iloc[0])])

    return some.groupBy("space").applyInPandas(train, BOOK)


def with_books(rows: DataFrame, books: DataFrame, each, schema: str) -> DataFrame:
    """each(books, frame) over rows (space, key, vector), in blocks that the namespace's books are sent to, before the rows."""
    salts = broadcast_if_small(keep(rows.groupBy("space").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))), 64)
    own = rows.join(salts, "space").select("space", F.pmod(F.xxhash64("key"), "salts").cast("int").alias("salt"), F.lit(True).alias("plain"), "key", "vector")
    own = own.withColumns({c: F.lit(None).cast(t) for c, t in [x.split() for x in BOOK.split(", ")[1:]]})
    theirs = books.join(salts, "space").select("space", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("plain"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("array<double>").alias("vector"), *[x.split()[0] for x in BOOK.split(", ")[1:]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            plain = f["plain"].to_numpy(bool)
            starts = [*np.flatnonzero(~plain).tolist(), len(f)]
            if starts[0] and held is not None:
                yield each(held, f.iloc[: starts[0]])
            for a, b in zip(starts, starts[1:], strict=False):
                r = f.iloc[a]
                held = Books.read({c: r[c] if c in ("coarse", "books") else int(r[c]) for c in ("dims", "cells", "probes", "more", "coarse", "books")})
                if b > a + 1:
                    yield each(held, f.iloc[a + 1 : b])

    return own.unionByName(theirs).repartition("space", "salt").sortWithinPartitions("space", "salt", "plain").mapInPandas(run, schema)


def settled(coded: DataFrame, books: DataFrame, top: int) -> DataFrame:
    """books with the least that queries of each namespace read for the recall asked for, of cells to open and candidates.

    ASKED vectors of a namespace, by least hash, are its queries. Their exact nearest are found among all its vectors; then each block of vectors (space,
    key, cell, codes, vector) counts, for every number of cells, how many of its own come before each of those by their codes.
    """
    nth = F.row_number().over(Window.partitionBy("space").orderBy(F.xxhash64("key", F.lit("asked")), "key"))
    asked = keep(coded.select("space", "key", "vector").withColumn("__n", nth).where(F.col("__n") <= ASKED).select("space", F.col("key").alias("query"), "vector"))
    of_block = [F.col("space"), F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt")]
    salts = broadcast_if_small(keep(coded.groupBy("space").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))), 64)
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    blocks = keep(coded.join(salts, "space").select(*of_block, "key", "cell", "codes", "vector"))
    pairs = lambda df: blocks.groupBy("space", "salt").cogroup(df.join(salts, "space").select("space", every, *[c for c in df.columns if c != "space"]).groupBy("space", "salt"))

    def exact(at: tuple, f: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        score = _unit(qs["vector"]) @ _unit(f["vector"]).T
        key = f["key"].to_numpy(np.int64)
        kept = np.lexsort((np.broadcast_to(key, score.shape), -np.round(score, 6)), axis=1)[:, :top]
        return pd.DataFrame({"space": pd.Series([at[0]] * kept.size, dtype=object), "query": np.repeat(qs["query"].to_numpy(np.int64), kept.shape[1]), "key": key[kept.ravel()], "score": np.round(np.take_along_axis(score, kept, 1), 6).ravel()})

    near = retrieval.ranked(pairs(asked).applyInPandas(exact, "space string, query long, key long, score double"), ["space", "query"], [F.desc("score"), F.asc("key")], top)
    # a row a query: its nearest with their cells and codes
    own = near.join(coded.select("space", "key", "cell", "codes"), ["space", "key"]).groupBy("space", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "cell", "codes"))).alias("near"))
    fields = ["dims", "cells", "probes", "more", "coarse", "books"]
    first = asked.groupBy("space").agg(F.min("query").alias("query"))  # the query that carries a namespace's books, which every block gets once
    carried = first.join(books, "space").select("space", "query", *fields)
    targets = keep(own.join(asked, ["space", "query"]).join(carried, ["space", "query"], "left"))

    def count(at: tuple, f: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        held = qs[qs["coarse"].notna()].iloc[0]
        b = Books.read({c: held[c] if c in ("coarse", "books") else int(held[c]) for c in fields})
        codes = lambda rows: np.frombuffer(b"".join(rows), np.uint8).reshape(-1, PARTS)
        f = f.sort_values("key")
        key, cell, levels, out = f["key"].to_numpy(np.int64), f["cell"].to_numpy(np.int64), b.levels(), []
        vectors = b.decoded(cell, codes(f["codes"])).T
        for query, vector, rows in zip(qs["query"], qs["vector"], qs["near"], strict=True):
            q = _unit(pd.Series([vector]))
            wanted, places = np.array([r["key"] for r in rows], np.int64), np.array([r["cell"] for r in rows], np.int64)
            theirs, mine = b.rough(q, places, codes([r["codes"] for r in rows]))[0], np.round(q @ vectors, DIGITS)[0]
            turns = b.turns(q)[0]
            met_theirs = turns[places]
            order = np.argsort(-mine, kind="stable")  # keys ascend
            rough, keys, met = -mine[order], key[order], turns[cell[order]]
            lo, hi = np.searchsorted(rough, -theirs, "left"), np.searchsorted(rough, -theirs, "right")
            at_all = np.array([i + np.searchsorted(keys[i:j], k) for i, j, k in zip(lo, hi, wanted, strict=True)], np.int64)
            for level in levels:
                before = np.concatenate([[0], np.cumsum(met < level)])[at_all]
                out += [(at[0], level, query, k, n) for k, n, m in zip(wanted.tolist(), before.tolist(), met_theirs.tolist(), strict=True) if m < level]
        return pd.DataFrame(out, columns=["space", "level", "query", "key", "before"])

    counted = pairs(targets).applyInPandas(count, "space string, level int, query long, key long, before long")
    each = counted.groupBy("space", "level", "query", "key").agg(F.sum("before").alias("before"))
    # the least power of two of candidates that takes in a near one, then for each number of cells the least one that takes in enough of them
    fold = F.greatest(F.lit(1), F.ceil(F.log2((F.col("before") + 1) / top))).cast("int")
    hits = each.groupBy("space", "level", fold.alias("fold")).agg(F.count("*").alias("n"))
    hits = hits.withColumn("hits", F.sum("n").over(Window.partitionBy("space", "level").orderBy("fold")))
    all_near = near.groupBy("space").agg(F.count("*").alias("all_near"))
    sizes = coded.groupBy("space").agg(F.count("*").alias("size"), F.max(F.size("vector")).alias("d"))
    good = hits.join(all_near, "space").where(F.col("hits") >= RECALL * F.col("all_near")).join(sizes, "space").join(books.select("space", "cells"), "space")
    more = F.pow(F.lit(2), F.col("fold")).cast("int")
    read = F.col("size") * PARTS * F.col("level") / F.col("cells") + F.least(F.col("size"), more * top) * F.col("d") * 8
    best = good.groupBy("space").agg(F.min(F.struct(read.alias("read"), "level", more.alias("m"))).alias("b")).select("space", "b.level", "b.m")
    return books.join(best, "space", "left").select("space", "dims", "cells", F.coalesce("level", "probes").alias("probes"), F.coalesce("m", "more").alias("more"), "coarse", "books")


def build(vectors: DataFrame, path: str, top: int = retrieval.VECTOR_TOP) -> None:
    """Writes the index of vectors (space, key, vector) under path; rows without key, space, or with a null or zero vector aren't in it.

    Vectors of a namespace have one length.
    """
    sound = vectors.where("space IS NOT NULL AND key IS NOT NULL AND vector IS NOT NULL").select(F.col("space").cast("string").alias("space"), F.col("key").cast("long").alias("key"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    sound = keep(sound.where(F.exists("vector", lambda x: x != 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))))
    books = keep(fit(sound))

    def each(b: Books, f: pd.DataFrame) -> pd.DataFrame:
        cell, codes = b.code(_unit(f["vector"]))
        return pd.DataFrame({"space": pd.Series(f["space"].to_numpy(), dtype=object), "key": f["key"].to_numpy().astype(np.int64), "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes], "vector": f["vector"].to_numpy()})

    lists = with_books(sound, books, each, "space string, key long, cell int, codes binary, vector array<double>")
    lists = keep(lists)
    settled(lists, books, top).write.mode("overwrite").parquet(f"{path}/books")
    lists.hint("rebalance", "space", "cell").sortWithinPartitions("space", "cell", "key").write.partitionBy("space").mode("overwrite").parquet(f"{path}/lists")


def _blocked(spark: SparkSession, path: str) -> DataFrame:
    """The index's lists, with the block that each vector is dealt to."""
    lists = spark.read.parquet(f"{path}/lists").withColumn("space", F.col("space").cast("string"))
    many = broadcast_if_small(keep(lists.groupBy("space").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many"))), 64)
    return lists.join(many, "space").withColumn("blk", F.pmod(F.xxhash64("key"), "many").cast("int")).drop("many")


def candidates(spark: SparkSession, path: str, queries: DataFrame, top: int) -> DataFrame:
    """(space, blk, part, query, vector, keys): the vectors of each block that queries (query, space, vector) must look at, by their codes.

    A namespace's codes go block by block by groups of its queries, which keep their best so far in the cells they open: what leaves a task is their candidates alone.
    """
    books = spark.read.parquet(f"{path}/books")
    asked = queries.where("space IS NOT NULL").select(F.col("space").cast("string").alias("space"), F.col("query").cast("long").alias("query"), F.transform("vector", lambda x: x.cast("double")).alias("vector")).where(F.exists("vector", lambda x: x != 0))
    fields = ["dims", "cells", "probes", "more", "coarse", "books"]
    groups = keep(retrieval.grouped(asked, GROUP).drop("dims").join(books.select("space", *fields), "space"))

    def pack(at: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"space": [at[0]], "blk": [at[1]], "keys": [f["key"].to_numpy(np.int64).tobytes()], "at": [f["cell"].to_numpy(np.int32).tobytes()], "codes": [b"".join(f["codes"])]})

    packed = keep(_blocked(spark, path).select("space", "blk", "key", "cell", "codes").groupBy("space", "blk").applyInPandas(pack, "space string, blk int, keys binary, at binary, codes binary"))
    names = ["space", "blk", "part", "query", "vector", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None

        def done() -> Iterator[pa.RecordBatch]:
            for a, b in enumerate(best):
                order = np.lexsort((b.tag, b.row))
                row, blk = b.row[order], b.tag[order]
                starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (blk[1:] != blk[:-1])])) if len(row) else np.zeros(0, np.int64)
                which = a * retrieval.SLICE + row[starts]
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * x.shape[1]), pa.array(x[which].ravel()))
                keys = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(b.key[order]))
                yield pa.RecordBatch.from_arrays([pa.array([space] * len(which), pa.string()), pa.array(blk[starts]), pa.array(np.full(len(which), part, np.int32)), pa.array(ids[which]), vectors, keys], names=names)

        for r in (r for batch in batches for r in batch.to_pylist()):
            if r["blk"] < 0:
                if ids is not None:
                    yield from done()
                book, ids, space, part = Books.read(r), np.frombuffer(r["ids"], np.int64), r["space"], r["grp"] * GROUP // RANKED
                x = retrieval.unit_rows(np.frombuffer(r["x"]).reshape(len(ids), -1))
                turns = book.turns(x)
                best = [retrieval.Best(len(x[a : a + retrieval.SLICE]), book.more * top) for a in range(0, len(x), retrieval.SLICE)]
                continue
            key, cell = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["at"], np.int32)
            v = book.decoded(cell, np.frombuffer(r["codes"], np.uint8).reshape(-1, PARTS)).T
            for a, b in enumerate(best):
                own = slice(a * retrieval.SLICE, (a + 1) * retrieval.SLICE)
                score = x[own] @ v
                score[(turns[own] >= book.probes)[:, cell]] = -np.inf
                b.add(score, key, DIGITS, r["blk"])
        if ids is not None:
            yield from done()

    return retrieval.in_turn(groups, packed, run, "space string, blk int, part int, query long, vector array<double>, keys array<long>")


def search(spark: SparkSession, path: str, queries: DataFrame, top: int = retrieval.VECTOR_TOP) -> DataFrame:
    """(query, key, score, rank): the nearest of a query's namespace among its candidates, by exact cosine, ties by key.

    Queries (query, space, vector) have different numbers; one whose namespace isn't in the index, or whose vector is null or zero, finds nothing.
    """
    near = candidates(spark, path, queries, top)
    full = _blocked(spark, path).select("space", "blk", "key", F.col("vector").alias("v"))
    pairs = near.agg(F.sum(F.size("keys"))).first()[0] or 0
    if pairs * 40 <= BROADCAST_BYTES:  # of few candidates only their own vectors are sent
        full = full.join(F.broadcast(near.select("space", F.explode("keys").alias("key")).distinct()), ["space", "key"], "left_semi")
    tasks = keep(near.select("space", "blk", "part").distinct())
    full = full.join(broadcast_if_small(tasks, 64), ["space", "blk"])

    def rank(_: tuple, qs: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("key")
        key, v = f["key"].to_numpy(np.int64), _unit(f["v"])
        out = []
        for query, vector, keys in zip(qs["query"].tolist(), qs["vector"], qs["keys"], strict=True):
            at = np.searchsorted(key, keys)
            score = np.round(v[at] @ _unit(pd.Series([vector]))[0], 6)
            first = np.lexsort((keys, -score))[:top]
            out.append((np.full(len(first), query, np.int64), key[at[first]], score[first]))
        return pd.DataFrame(dict(zip(("query", "key", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    by = ["space", "blk", "part"]
    scored = near.groupBy(*by).cogroup(full.groupBy(*by)).applyInPandas(rank, "query long, key long, score double")
    return retrieval.ranked(scored, ["query"], [F.desc("score"), F.asc("key")], top)


def share_scanned(spark: SparkSession, path: str) -> DataFrame:
    """(space, bytes_read, bytes_all): what a query of a namespace reads on average, codes of opened cells and candidates' vectors, and what it would read without the index."""
    books, lists = spark.read.parquet(f"{path}/books"), spark.read.parquet(f"{path}/lists")
    sizes = lists.groupBy(F.col("space").cast("string").alias("space")).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"))
    read = F.col("n") * PARTS * F.col("probes") / F.col("cells") + F.least(F.col("n"), F.col("more") * retrieval.VECTOR_TOP) * F.col("d") * 8
    return books.join(sizes, "space").select("space", read.cast("long").alias("bytes_read"), (F.col("n") * F.col("d") * 8).cast("long").alias("bytes_all"))
