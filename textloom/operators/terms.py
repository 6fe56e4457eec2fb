"""The terms of a whole dictionary in texts: a tree of all terms in a hash table of arrays, which a batch of texts is walked through at once.

The tree has a node for each beginning of a term. A node is its place in the table, where its parent and its character stand as one number, so it
takes 13 bytes at a load of a half or less and the table grows with the dictionary alone, not with its letters. From each place of the texts the tree is walked
as far as a term goes on, many places at a time; what a text costs hardly depends on how many terms there are. The tree is made once and
broadcast. A dictionary too large for one tree is dealt to several by hash, each of which sees every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.storage import keep

#: Characters of the terms of one tree, so its size is bounded (about 200 MB).
DICTIONARY_CHARS = 4_000_000
#: Places that are walked together, and characters of texts that are run together.
LANE, TOGETHER = 1 << 17, 1 << 20
#: A character that no text has, and the bits that hold it.
NONE, CHAR_BITS = 0x110000, 21


class Tree:
    """Of different terms, none of them empty."""

    def __init__(self, terms: list[str]):
        self.terms, self.sizes = pa.array(terms, pa.string()), np.array([len(t) for t in terms], np.int64)
        code = np.frombuffer("".join(terms).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begin = np.cumsum(self.sizes) - self.sizes
        # nodes in the order of their depth: the number of the parent (the root: 0) and the character
        levels, own, at, some, n = [], [], np.zeros(len(terms), np.int64), np.arange(len(terms)), 0
        for depth in range(int(self.sizes.max(initial=0))):
            some = some[self.sizes[some] > depth]
            pairs, which = np.unique((at[some] << CHAR_BITS) | code[begin[some] + depth], return_inverse=True)
            at[some] = n + 1 + which
            levels.append(pairs)
            n += len(pairs)
            last = some[self.sizes[some] == depth + 1]
            own.append((at[last], last))
        bits = max(4, int(2 * n).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table, self.own, self.inner = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool)
        place, n = np.zeros(n + 1, np.int64), 1
        for pairs in levels:
            parent = pairs >> CHAR_BITS
            self.inner[place[parent[parent > 0]]] = True
            place[n : n + len(pairs)] = self._put(self._key(np.where(parent > 0, place[parent], -1), pairs & ((1 << CHAR_BITS) - 1)))
            n += len(pairs)
        for nodes, ends in own:
            self.own[place[nodes]] = ends
        self.first = np.full(NONE + 1, -1, np.int32)  # by a term's first character
        if levels:
            self.first[levels[0]] = place[1 : 1 + len(levels[0])]

    @staticmethod
    def _key(parent: np.ndarray, char: np.ndarray) -> np.ndarray:
        return ((parent.astype(np.int64) + 1) << CHAR_BITS) | char

    def _start(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, key: np.ndarray) -> np.ndarray:
        """The places that new keys, all different, take: each the first free one from where it starts."""
        place, todo = self._start(key), np.arange(len(key))
        while len(todo):
            free = todo[self.table[place[todo]] < 0]
            won = free[np.unique(place[free], return_index=True)[1]]
            self.table[place[won]] = key[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            place[todo] = (place[todo] + 1) & self.mask
        return place

    def _get(self, key: np.ndarray) -> np.ndarray:
        """The places of keys, -1 for those that aren't there."""
        place = self._start(key)
        held = self.table[place]
        out = np.where(held == key, place, -1)
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            place[todo] = (place[todo] + 1) & self.mask
            held, own = self.table[place[todo]], key[todo]
            hit = held == own
            out[todo[hit]] = place[todo[hit]]
            todo = todo[~hit & (held >= 0)]
        return out

    def find(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, term) of all occurrences in a stream of code points; those of one term in order."""
        stream = np.append(stream, NONE).astype(np.int64)
        begins, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for lane in range(0, len(stream) - 1, LANE):
            at = np.arange(lane, min(lane + LANE, len(stream) - 1))
            node, depth = self.first[stream[at]], 1
            alive = node >= 0
            while alive.any():
                at, node = at[alive], node[alive]
                term = self.own[node]
                begins.append(at[term >= 0])
                found.append(term[term >= 0])
                on = self.inner[node]
                at, node = at[on], node[on]
                node = self._get(self._key(node, stream[at + depth]))
                alive, depth = node >= 0, depth + 1
        return np.concatenate(begins), np.concatenate(found)


def dealt(terms: DataFrame, term: str) -> list[list[str]]:
    """The different terms, in lists that one tree each can hold."""
    some = keep(terms.where(F.length(term) > 0).select(F.col(term).alias("t")).distinct())
    parts = -(-(some.agg(F.sum(F.length("t"))).first()[0] or 0) // DICTIONARY_CHARS)
    own = F.pmod(F.xxhash64("t"), F.lit(max(parts, 1)))
    return [sorted(r["t"] for r in some.where(own == k).collect()) for k in range(parts)]


def occurrences(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", term: str = "term") -> DataFrame:
    """(key, term, at): the first place (from 1) of each term of the dictionary in each text that holds it.

    Null texts hold nothing, and null and empty terms aren't looked for. A text may be as long as it will.
    """
    spark, kind, every = docs.sparkSession, docs.schema[key].dataType.simpleString(), None
    for own in dealt(terms, term):
        shared = spark.sparkContext.broadcast(Tree(own))  # of DICTIONARY_CHARS at most on average

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            for batch in batches:
                keys, sizes = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
                a = 0
                while a < len(sizes):
                    b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:] + 1), TOGETHER, "right")))
                    stream = np.frombuffer("\0".join([*batch.column(1).slice(a, b - a).to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), "<u4").copy()
                    begin = np.cumsum([0, *(sizes[a:b] + 1)])
                    stream[begin[1:] - 1] = NONE  # a text ends with a character that no term has
                    place, found = tree.find(stream)
                    which = np.searchsorted(begin, place, "right") - 1
                    first = np.unique(which * len(tree.sizes) + found, return_index=True)[1]
                    which, found, place = which[first], found[first], place[first]
                    columns = [keys.take(pa.array(a + which)), tree.terms.take(pa.array(found)), pa.array((place - begin[which] + 1).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "term", "at"])
                    a = b

        held = docs.where(F.length(text) > 0).select(key, F.col(text).alias("__t"), F.length(text).alias("__n"))
        rows = held.mapInArrow(run, f"{key} {kind}, term string, at int")
        every = rows if every is None else every.unionByName(rows)
    return every if every is not None else docs.select(key, F.lit("").alias("term"), F.lit(1).alias("at")).limit(0)


def marks(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, spans): the places (at, n) to mark of occurrences (key, term, at), ascending: longer terms first, then by term, and what overlaps a place already taken isn't marked.

    Occurrences stream by, sorted; of a key only the places taken are held.
    """
    kind = found.schema[key].dataType.simpleString()
    ordered = found.withColumn("n", F.length("term")).repartition(key).sortWithinPartitions(F.asc(key), F.desc("n"), F.asc("term")).select(key, "at", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken, spans, keys, out = None, bytearray(), [], [], []

        def rows() -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32))
            flat = np.array([x for s in out for x in s], np.int32).reshape(-1, 2)
            each = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["at", "n"])
            return pa.RecordBatch.from_arrays([pa.array(keys, key_kind), pa.ListArray.from_arrays(ends, each)], names=[key, "spans"])

        for batch in batches:
            key_kind = batch.schema.field(0).type
            for k, at, n in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if k != last:
                    if spans:
                        keys.append(last)
                        out.append(sorted(spans))
                        if len(out) == 1000:
                            yield rows()
                            keys, out = [], []
                    last, taken, spans = k, bytearray(), []
                if len(taken) < at + n:
                    taken.extend(bytes(at + n - len(taken)))
                if taken.find(1, at, at + n) < 0:
                    taken[at : at + n] = b"\1" * n
                    spans.append((at, n))
        if spans:
            keys.append(last)
            out.append(sorted(spans))
        if out:
            yield rows()

    return ordered.mapInArrow(run, f"{key} {kind}, spans array<struct<at:int,n:int>>")


def marked(text: Column, spans: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """The text with tags around the spans; null spans mark nothing."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, places, sizes in batches:
            out = []
            for t, at, n in zip(texts, places, sizes, strict=True):
                if t is not None and at is not None:
                    pieces, last = [], 0
                    for a, b in zip((at - 1).tolist(), (at - 1 + n).tolist(), strict=True):
                        pieces += [t[last:a], before, t[a:b], after]
                        last = b
                    t = "".join([*pieces, t[last:]])
                out.append(t)
            yield pd.Series(out, dtype=object)

    put = F.pandas_udf(run, "string")
    return put(text, F.transform(spans, lambda s: s["at"]), F.transform(spans, lambda s: s["n"]))
