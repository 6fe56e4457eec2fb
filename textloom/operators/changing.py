"""A lexical index that changes: a segment for each batch, tombstones, merges; a batch that fails is left out and counted.

A batch holds documents to be indexed, and keys with a null text to be deleted. It becomes a segment, an index of its own with the keys it has, and
each of these ends what segments before it have of them: a document is looked up in the newest segment that names it. Merging writes the live rows of all
segments as one; blocks stay as they are. A batch is written under its number and written anew if it is repeated, which changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import lexical
from textloom.storage import broadcast_if_small, exists, keep, remove

LOG = "batch long, state string, path string, first_block long, blocks long, error string"


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings without the entries whose keys are in gone; rows of which nothing is left go."""
    for batch in batches:
        own = {c: batch.column(c) for c in batch.schema.names}
        offsets = own["keys"].offsets.to_numpy()
        keys, gone = own["keys"].flatten(), own["gone"].flatten()
        code = pa.concat_arrays([keys, gone]).dictionary_encode()
        code, many = code.indices.to_numpy().astype(np.int64), len(code.dictionary) + 1
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        of = np.repeat(np.arange(batch.num_rows), np.diff(own["gone"].offsets.to_numpy()))
        live = ~np.isin(row * many + code[: len(keys)], of * many + code[len(keys) :])
        lens, tfs, places = (own[c].flatten().to_numpy() for c in ("lens", "tfs", "places"))
        n = np.bincount(row[live], minlength=batch.num_rows)
        left = np.flatnonzero(n)
        first = np.cumsum(n[left]) - n[left]
        lens, kept = lens[live], tfs[live]
        places = places[np.repeat(live, tfs)]
        lists = lambda sizes, x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), x)
        reduced = lambda f, x: f.reduceat(x, first) if len(first) else x[:0]
        made = [own[c].take(pa.array(left)) for c in ("bucket", "token", "block")] + [pa.array(n[left].astype(np.int64)), pa.array(reduced(np.maximum, kept)), pa.array(reduced(np.minimum, lens))]
        made += [lists(n[left], x) for x in (keys.filter(pa.array(live)), pa.array(lens), pa.array(kept))] + [lists(reduced(np.add, kept), pa.array(places))]
        yield pa.RecordBatch.from_arrays(made, names=batch.schema.names[:-1])


class Segments(lexical.Index):
    """The live rows of several segments as one index."""

    def __init__(self, spark: SparkSession, segments: list[dict]):
        self.spark, self.all = spark, segments
        self.ends = self._read("keys", [])
        newest = self.ends.groupBy("key").agg(F.max("batch").alias("newest"))
        docs = self._read("documents", ["block"])
        state = docs.join(newest, "key").withColumn("live", F.col("batch") == F.col("newest"))
        self.docs = keep(state.select("key", "batch", "block", "live"))
        sums = self.docs.where("live").agg(F.count("*").alias("n")).first()
        self.n = sums["n"]
        self.mean = float(self._read("lengths", []).join(self.docs.where("live"), ["key", "batch"]).agg(F.coalesce(F.avg("len"), F.lit(0.0)).alias("m")).first()["m"])

    def _read(self, name: str, blocks: list[str]) -> DataFrame:
        """A table of all segments, with its batch, and block numbers that differ between segments."""
        every = None
        for s in self.all:
            one = lexical.read_postings(self.spark, s["path"]) if name == "postings" else self.spark.read.parquet(f"{s['path']}/{name}")
            one = one.withColumns({c: (F.col(c) + s["first_block"]).cast("int") for c in blocks})
            if "batch" not in one.columns:
                one = one.withColumn("batch", F.lit(s["batch"]))
            every = one if every is None else every.unionByName(one)
        return every

    def live(self, rows: DataFrame) -> DataFrame:
        """Postings without the entries of documents that a later batch has; blocks without such documents pass as they are."""
        gone = self.docs.where("NOT live").groupBy("block").agg(F.collect_list("key").alias("gone"))  # no more than a block has documents
        gone = broadcast_if_small(keep(gone), 8 * lexical.BLOCK)
        names = ["bucket", "token", "block", "n", "most", "shortest", "keys", "lens", "tfs", "places"]
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
        whole = rows.join(gone, "block", "left_anti").select(*names)
        return whole.unionByName(rows.join(gone, "block").select(*names, "gone").mapInArrow(_without, kinds))

    def postings(self, tokens: DataFrame) -> DataFrame:
        return keep(self.live(self._read("postings", ["block"]).drop("batch").join(broadcast_if_small(tokens, 64), ["bucket", "token"], "left_semi")))

    def counts(self, tokens: DataFrame) -> DataFrame:
        return tokens.join(self.postings(tokens.select("bucket", "token").distinct()).groupBy("bucket", "token").agg(F.sum("n").alias("df")), ["bucket", "token"])

    def documents(self) -> DataFrame:
        return self.docs.where("live").select("key", "block")


class ChangingIndex:
    """An index under path that batches are added to."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", text: str = "text"):
        self.spark, self.path, self.key, self.text = spark, path, key, text

    def _log(self, rows: list[tuple], name: str) -> None:
        self.spark.createDataFrame(rows, LOG).write.mode("overwrite").parquet(f"{self.path}/log/entry={name}")

    def _entries(self) -> list[dict]:
        """A row for each batch, few as they are merged."""
        if not exists(self.spark, f"{self.path}/log"):
            return []
        return [r.asDict() for r in self.spark.read.schema(LOG).parquet(f"{self.path}/log/*").orderBy("batch").collect()]

    def segments(self) -> list[dict]:
        return [r for r in self._entries() if r["state"] == "live"]

    def add(self, batch: DataFrame, n: int) -> bool:
        """Indexes a batch with its number, greater than those before it; False if it failed and is left out. The last row of a key within a batch isn't defined: keys are different."""
        at = f"{self.path}/segments/{n}"
        try:
            self._write(batch, at, n)
        except PySparkException as e:
            self._log([(n, "failed", at, 0, 0, str(e)[:300])], str(n))
            return False
        others = [s for s in self.segments() if s["batch"] < n]
        first = max([s["first_block"] + s["blocks"] for s in others], default=0)
        blocks = self.spark.read.parquet(f"{at}/documents").agg(F.coalesce(F.max("block") + 1, F.lit(0)).alias("n")).first()["n"]
        self._log([(n, "live", at, first, blocks, None)], str(n))
        return True

    def _write(self, batch: DataFrame, at: str, n: int) -> None:
        rows = keep(batch.select(F.col(self.key).alias("key"), F.col(self.text).alias("text")).where("key IS NOT NULL"))
        whole = rows.where("text IS NOT NULL")
        lexical.build(whole, at, "key", "text")
        whole.select("key", F.size(lexical.T.bigrams("text")).alias("len")).write.mode("overwrite").parquet(f"{at}/lengths")
        rows.select("key").distinct().write.mode("overwrite").parquet(f"{at}/keys")

    def opened(self) -> Segments:
        return Segments(self.spark, self.segments())

    def report(self) -> dict[str, int]:
        entries = self._entries()
        return {"batches": sum(r["blocks"] if r["state"] == "merged" else 1 for r in entries), "failed": sum(r["state"] == "failed" for r in entries), "documents": self.opened().n}

    def merge(self) -> None:
        """All segments as one, of the greatest of their numbers; what is read goes once the new one is written and named."""
        old = self.segments()
        if len(old) < 2:
            return
        n, at, view = old[-1]["batch"], f"{self.path}/segments/{old[-1]['batch']}-{uuid.uuid4().hex[:8]}", self.opened()
        rows = view.live(view._read("postings", ["block"]).drop("batch"))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{at}/postings")
        view.documents().write.parquet(f"{at}/documents")
        lengths = view._read("lengths", []).join(view.docs.where("live").select("key", "batch"), ["key", "batch"], "left_semi")
        lengths.select("key", "len").write.parquet(f"{at}/lengths")
        view.documents().select("key").write.parquet(f"{at}/keys")
        blocks = max(s["first_block"] + s["blocks"] for s in old)
        self._log([(n, "live", at, 0, blocks, None)], str(n))
        done = [s for s in old if s["batch"] != n]
        for s in done:
            self._log([(s["batch"], "merged", s["path"], 0, 1, None)], str(s["batch"]))
        for s in old:
            remove(self.spark, s["path"])
