"""Texts to vectors: a feature-hashing embedder that is fitted on the corpus, and a place for any other model.

Features are tokens and pairs of neighbouring tokens. Each has a slot by its hash; how many texts have a slot is counted over all texts, into a
table of a fixed number of slots, which every task gets. A text's vector is then its own row's work: the sum of its slots' counts times
their rarity, each added to or taken from one of the dimensions, and made one long. No token is shuffled for it: a task counts its own texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Slots that features are hashed to (2 MB of counts), and dimensions of vectors.
SLOTS, DIMS = 1 << 18, 64
#: Texts that a model gets in one call, texts that are embedded together, and features that are hashed together, few enough for a processor's cache.
CALL, TOGETHER, HASHED = 50, 512, 16384
#: Bytes of a text that md5 takes as one block; longer ones are left to hashlib.
ONE_BLOCK = 55

_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
# what a block keeps of the bytes from a text's start, and the mark after its end, by the text's length
_KEPT = np.where(np.arange(56) < np.arange(56)[:, None], 255, 0).astype(np.uint8)
_MARK = np.where(np.arange(56) == np.arange(56)[:, None], 128, 0).astype(np.uint8)


def _one_block(w: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the md5 of blocks w (16 words each, one column a block)."""
    a, b, c, d = (np.full(w.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i, (turn, word) in enumerate(zip(_TURNS[:61], _WORDS[:61], strict=True)):  # the last three steps make the other bytes
        f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
        f += a
        f += w[word]
        f += _SINES[i]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return (b + np.uint32(0x67452301)).byteswap()


def md5_heads(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the md5 of each text data[start : start + size]; thousands at a time."""
    out = np.zeros(len(start), np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(56, np.uint8)]), 56)
    short = np.flatnonzero(size <= ONE_BLOCK)
    for k in range(0, len(short), HASHED):
        own = short[k : k + HASHED]
        n = size[own]
        rows = windows[start[own]].view(np.uint64)
        rows &= _KEPT.view(np.uint64)[n]
        rows |= _MARK.view(np.uint64)[n]
        w = np.zeros((16, len(own)), np.uint32)
        w[:14], w[14] = rows.view(np.uint32).T, n * 8
        out[own] = _one_block(w)
    for k in np.flatnonzero(size > ONE_BLOCK):
        out[k] = int.from_bytes(hashlib.md5(data[start[k] : start[k] + size[k]].tobytes()).digest()[:4], "big")
    return out


def _slots(texts: pa.Array) -> pa.Array:
    """Of texts of tokens with a space between them: a token and a pair of neighbours are both stretches of the text as it lies."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    first, last = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0]
    spaces = np.flatnonzero(data == 32)
    start, end = np.sort(np.concatenate([first, spaces + 1])), np.sort(np.concatenate([spaces, last]))
    n = np.where(np.diff(at) > 0, np.diff(np.searchsorted(spaces, at)) + 1, 0)  # tokens of each text
    row = np.repeat(np.arange(len(n)), n)
    own = np.arange(len(start)) - (np.cumsum(n) - n)[row]
    left = np.flatnonzero(own < n[row] - 1)  # tokens with a next one
    features = n + np.maximum(n - 1, 0)
    ends = np.concatenate([[0], np.cumsum(features)])
    slot = np.empty(ends[-1], np.int32)
    slot[ends[row] + own] = md5_heads(data, start, end - start) % SLOTS
    slot[ends[row[left]] + n[row[left]] + own[left]] = md5_heads(data, start[left], end[left + 1] - start[left]) % SLOTS
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(slot))


def with_slots(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with slots in place of the text: array<int>, those of its tokens and of its pairs of neighbouring tokens, as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                *others, spaced = batch.slice(a, TOGETHER).columns
                yield pa.RecordBatch.from_arrays([*others, _slots(spaced)], names=[*batch.schema.names[:-1], "slots"])

    kept = [f for f in texts.schema.fields if f.name != text]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return texts.select(*[F.col(f"`{f.name}`") for f in kept], T.spaced(text).alias("slots")).mapInArrow(run, f"{kinds}slots array<int>")


def _flat(slots: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slots of lists, one list after the other, and each one's list."""
    return slots.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(slots)), slots.value_lengths().fill_null(0).to_numpy())


class Embedder:
    """Rarity of each slot in the texts (slots) it was fitted on."""

    def __init__(self, texts: DataFrame):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, n = np.zeros(SLOTS, np.int64), 0
            for batch in batches:
                for a in range(0, batch.num_rows, TOGETHER):
                    at, row = _flat(batch.column(0).slice(a, TOGETHER))
                    own = np.sort(row * SLOTS + at)  # sorted, as numpy's unique hashes, which takes far longer
                    count += np.bincount(own[np.diff(own, prepend=-1) > 0] % SLOTS, minlength=SLOTS)
                n += batch.num_rows
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(count[held], n))], names=["slot", "n"])

        each = texts.select("slots").mapInArrow(run, "slot long, n long")  # SLOTS rows of a task and one more at most; slot -1: texts
        held = each.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        slot, of, count = held["slot"].to_numpy(np.int64), held["n"].to_numpy(np.int64), np.zeros(SLOTS)
        count[slot[slot >= 0]] = of[slot >= 0]
        self.shared = texts.sparkSession.sparkContext.broadcast(np.log((of[slot < 0].sum() + 1) / (count + 1)) + 1)

    def embed(self, texts: DataFrame, name: str = "vector") -> DataFrame:
        """texts (slots) with n_features and the vector of each in place of slots; null for a text without a token, or whose features cancel out."""
        shared = self.shared

        def some(slots: pa.Array, signed: np.ndarray) -> pa.Array:
            at, row = _flat(slots)
            v = np.bincount(row * DIMS + at % DIMS, weights=signed[at], minlength=len(slots) * DIMS).astype(float).reshape(-1, DIMS)
            length = np.sqrt((v * v).sum(1))
            good = length > 1e-9
            ends = np.concatenate([[0], np.cumsum(good * DIMS)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array((v[good] / length[good, None]).ravel()), mask=pa.array(~good))

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            signed = np.where((np.arange(SLOTS) // DIMS) % 2 == 0, shared.value, -shared.value)
            for batch in batches:
                parts = [some(batch.slice(a, TOGETHER), signed) for a in range(0, len(batch), TOGETHER)]
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

        made = F.arrow_udf(run, "array<double>")
        return texts.withColumn("n_features", F.size("slots")).withColumn(name, made("slots")).drop("slots")


def embed_with(model: Callable[[list[str]], list[tuple[int, list[float]]]], texts: DataFrame, key: str, text: str = "text", name: str = "vector", call: int = CALL) -> DataFrame:
    """(key, vector, error): what a model gives for each text, so many texts in a call.

    The model returns (index, vector) of the texts it was given, in any order. A text without an answer has a null vector; a call that fails
    leaves its texts without vectors and its message with each of them, so a search with them finds an empty pool instead of ending the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors, errors = [None] * len(f), [None] * len(f)
            given = f["__t"].tolist()
            for a in range(0, len(given), call):
                some = given[a : a + call]
                try:
                    for index, vector in model(some):
                        vectors[a + index] = [float(x) for x in vector]
                except Exception as e:  # noqa: BLE001  whatever the model raises
                    for k in range(a, a + len(some)):
                        vectors[k], errors[k] = None, str(e)[:200]
            yield pd.DataFrame({key: f[key], name: pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.coalesce(text, F.lit("")).alias("__t")).mapInPandas(run, f"{key} {kind}, {name} array<double>, error string")
