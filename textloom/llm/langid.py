"""Language identification by the nearest of several centroids for each language.

A text is a vector of hashed letter trigrams, weighted by TF-IDF and normalised; a language is a few centroids of such
vectors, from spherical k-means; the prediction is the language of the centroid of greatest cosine, and a text that
is far from all of them is rejected. The model is fitted on a bounded sample of labelled rows; every text is classified whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import batches_in

#: Hash buckets of trigrams, centroids for each language, and the bound of the sample that they are fitted on.
BUCKETS, CENTROIDS, SAMPLE = 4096, 4, 4000
#: A text is rejected whose greatest cosine is less than this share of the least one that sample rows have to centroids
#: fitted without them: it is like no language learned.
REJECT_SHARE, FOLDS = 0.5, 4
UNKNOWN = "und"
BLOCK = 1 << 20


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a space for anything else (code points up to U+FFFF)."""
    out = np.full(0x10000, 32, np.uint32)
    for k in range(0x10000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else k
    return out


_table: list[np.ndarray] = []


def trigrams(text: str) -> np.ndarray:
    """How often each bucket's letter trigrams occur; other characters count as one space between words."""
    if not _table:
        _table.append(_letters())
    out = np.zeros(BUCKETS, np.int64)
    tail = np.array([32], np.uint32)
    for a in range(0, len(text), BLOCK):
        code = np.frombuffer(text[a : a + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        mapped = np.concatenate([tail, _table[0][np.where(code < 0x10000, code, 0)]])
        if a + BLOCK >= len(text):
            mapped = np.append(mapped, np.uint32(32))
        kept = np.ones(len(mapped), bool)
        kept[1:] = (mapped[1:] != 32) | (mapped[:-1] != 32)
        m = mapped[kept]
        if len(m) > 2:
            h = (m[:-2] * np.uint32(0x9E3779B1)) ^ (m[1:-1] * np.uint32(0x85EBCA77)) ^ (m[2:] * np.uint32(0xC2B2AE3D))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out += np.bincount(h >> np.uint32(20), minlength=BUCKETS)
        tail = m[-2:]
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of square-rooted counts times idf, of length 1."""
    x = np.sqrt(counts.astype(np.float32)) * idf.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids at most; the first is the mean, each next one starts at the row farthest from those before."""
    c = [x.mean(0) / max(np.linalg.norm(x.mean(0)), 1e-12)]
    while len(c) < min(k, len(x)):
        c.append(x[(x @ np.array(c).T).max(1).argmin()])
    c = np.array(c)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                mean = own.mean(0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text (null: empty), modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def frequencies(learn: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """How many texts have a letter, and in how many each bucket occurs: every task adds up its own, so one short row a task is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, found = 0, np.zeros(BUCKETS, np.int64)
        for f in frames:
            for text in f["__t"]:
                if has_letter(text):
                    n += 1
                    found += trigrams(text) > 0
        yield pd.DataFrame({"bucket": np.arange(-1, BUCKETS), "n": np.concatenate([[n], found])})

    sums = batches_in(learn.selectExpr(f"`{text_col}` AS __t")).mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in sums.collect():  # a row for each bucket
        out[r["bucket"] + 1] = r["n"]
    return int(out[0]), out[1:]


def least_cosine(v: np.ndarray, names: np.ndarray) -> float:
    """REJECT_SHARE of the least cosine of a row to the centroids of its language, fitted on the other folds."""
    fold, least = np.arange(len(v)) % FOLDS, 1.0
    for lang in sorted(set(names.tolist())):
        for k in range(FOLDS):
            rest, own = v[(names == lang) & (fold != k)], v[(names == lang) & (fold == k)]
            if len(rest) and len(own):
                least = min(least, float((own @ spherical_kmeans(rest, CENTROIDS).T).max(1).min()))
    return max(0.0, REJECT_SHARE * least) if least < 1.0 else 0.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """idf, centroids and their languages, and the cosine below which a text is rejected.

    Only rows that are not held out and have a language and a text are learned from. The idf counts all of them. Centroids are
    fitted on about sample rows at most: each language gets an equal share, of ids whose hash is least; rows that share an id and a
    language count as one there, so a repeated id brings one row. Nothing to learn from, or an empty table, gives a model without languages.
    """
    learn = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in learn.groupBy(lang_col).count().collect()}  # a row for each language
    none = {"langs": [], "idf": np.zeros(BUCKETS, np.float32), "centroids": np.zeros((0, BUCKETS), np.float32), "least": 0.0}
    if not counts:
        return none
    share = sample / len(counts)
    cuts = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, share / n))])
    picked = learn.where(F.pmod(F.xxhash64(id_col, F.lit("langid")), F.lit(1 << 30)) < F.element_at(cuts, F.col(lang_col)) * (1 << 30))
    picked = picked.groupBy(F.col(id_col).alias("__i"), F.col(lang_col).alias("__l")).agg(F.min(text_col).alias("__t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for lang, text in zip(f["__l"], f["__t"], strict=True):
                if has_letter(text):
                    c = trigrams(text)
                    at = np.flatnonzero(c)
                    rows.append((lang, at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "at", "n"])

    got = batches_in(picked.select("__l", "__t")).mapInPandas(run, "lang string, at binary, n binary").collect()
    if not got:
        return none
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<u4")
    n, found = frequencies(learn, text_col)
    idf = np.log((1 + n) / (1 + found)).astype(np.float32) + 0.1
    v, names = vectors(x, idf), np.array([r["lang"] for r in got])
    langs, centroids = [], []
    for lang in sorted(set(names.tolist())):
        c = spherical_kmeans(v[names == lang], CENTROIDS)
        langs += [lang] * len(c)
        centroids.append(c)
    return {"langs": langs, "idf": idf, "centroids": np.concatenate(centroids), "least": least_cosine(v, names)}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, lang_pred, score and rejected, in place of columns of such names.

    Only the text decides. lang_pred is und, with score 0, for a null text, one without a letter, or where nothing was learned;
    for all others it is the nearest language. rejected tells that a text is null or has no letter, or that its cosine is below the
    model's least; a model without languages rejects nothing else. Ties go to the language that sorts first. Empty tables and
    repeated rows need no special case; a text of any length is read whole, in blocks. Nothing is shuffled.
    """
    langs, idf, centroids, least = model["langs"], model["idf"], model["centroids"], model["least"]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            good = [k for k, t in enumerate(texts) if has_letter(t)]
            pred, score, rejected = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
            rejected[good] = False
            for a in range(0, len(good) if langs else 0, 256):
                own = good[a : a + 256]
                cosine = vectors(np.array([trigrams(texts[k]) for k in own]), idf) @ centroids.T
                best = cosine.argmax(1)
                pred[own] = [langs[b] for b in best]
                score[own] = np.clip(cosine[np.arange(len(own)), best], 0, 1)
                rejected[own] = score[own] < least
            yield pd.DataFrame({"lang_pred": pred, "score": score, "rejected": rejected})

    # not deterministic only in name: so that the planner doesn't run it once for each use
    named = F.pandas_udf(run, "lang_pred string, score double, rejected boolean").asNondeterministic()
    columns = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score", "rejected")]
    batches_in(docs)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r"), held_out(F.col(id_col)).alias("h"), named(F.col(text_col)).alias("p"))
    return whole.select(*[F.col("r")[c].alias(c) for c in columns], F.col("h").alias("held_out"), "p.lang_pred", "p.score", "p.rejected")
