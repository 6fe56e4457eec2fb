"""Toxicity by a classifier chain: linear models for one category after the other.

Each model sees the words and shape of a text and the probabilities of the categories before it. In training those are
out-of-fold predictions, so a later model learns from probabilities as uncertain as those it will meet. The chain is
fitted on a bounded sample of labelled documents; every text is then scored whole, in one pass and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.bpe import Memo
from textloom.llm.common import batches_in, cut

#: Categories in the order of the chain, each as a condition over the columns of the label table that means yes.
CATEGORIES: dict[str, str] = {"junk": "quality = 0", "toxic": "toxic = 1"}
#: The category whose probability of THRESHOLD or more rejects a document.
DECIDES, THRESHOLD = "toxic", 0.4
#: Bounds of the fit: labelled documents, words of the vocabulary.
SAMPLE, WORDS = 16000, 2000
#: A word enters the vocabulary if it occurs in so many groups of near copies, with such a log-likelihood ratio.
LEAST_GROUPS, LEAST_RATIO = 5, 16.0
FOLDS, PENALTY, STEPS = 4, 1.0, 120
SHAPE = 6
LETTERS = regex.compile(r"\p{L}+")
ENDS = ".,;:!?()[]{}\"|#*$%&"


def shape(text: str) -> list[float]:
    """Shares of symbols, exclamation marks, bars, digits, capitals and repeated words, cut to 0..1."""
    n = len(text) or 1
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    words = text.split()
    return [
        min(1.0, 8 * sum(map(text.count, "#*$%&")) / n),
        min(1.0, 8 * text.count("!") / n),
        min(1.0, 8 * text.count("|") / n),
        float(((raw >= 48) & (raw <= 57)).sum()) / n,
        float(((raw >= 65) & (raw <= 90)).sum()) / n,
        1 - len(set(words)) / (len(words) or 1),
    ]


def marks(text: str) -> set[str]:
    """The words of a lower-case text, and the beginnings of its longer words, which inflected and compound words share."""
    word = text.strip(ENDS)
    words = {word} if word.isalpha() else set(LETTERS.findall(text))
    return words.union([f"{w[:n]}-" for w in words for n in (5, 7) if len(w) > n])


class Features:
    """Places of a text's words in the vocabulary, each once, and its shape."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.known = Memo(lambda chunk: tuple(v for w in marks(chunk) if (v := vocabulary.get(w)) is not None))

    def words(self, text: str) -> list[int]:
        return sorted({v for found in map(self.known.__getitem__, set(text.lower().split())) for v in found})


def logistic(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Weights (words, dense columns, intercept) of the L2-penalised log loss; words present are ones at (rows, cols).

    Gradient descent with momentum and a step for each feature by its curvature at the start.
    """
    n, d = dense.shape
    total = max(weight.sum(), 1e-9)
    prior = np.clip((weight * y).sum() / total, 1e-3, 1 - 1e-3)
    w, v, b, u = np.zeros(size), np.zeros(d), float(np.log(prior / (1 - prior))), np.zeros(size + d + 1)
    cw = 0.25 * np.bincount(cols, weight[rows], size) + PENALTY
    cd = 0.25 * (weight[:, None] * dense**2).sum(0) + PENALTY
    scale = np.concatenate([cw, cd, [0.25 * total + 1e-9]])
    for _ in range(STEPS):
        z = np.bincount(rows, w[cols], n) + dense @ v + b
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.concatenate([np.bincount(cols, r[rows], size) + PENALTY * w, dense.T @ r + PENALTY * v, [r.sum()]])
        u = 0.85 * u - 0.3 * g / scale
        w, v, b = w + u[:size], v + u[size : size + d], b + u[-1]
    return np.concatenate([w, v, [b]])


def probability(rows, cols, dense, model: np.ndarray, size: int) -> np.ndarray:
    z = np.bincount(rows, model[cols], len(dense)) + dense @ model[size:-1] + model[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(rows, cols, dense, labels: list[np.ndarray], weight, fold, size: int) -> list[np.ndarray]:
    """A model for each category; categories before it enter as columns of out-of-fold probabilities."""
    models = []
    for y in labels:
        models.append(logistic(rows, cols, dense, y, weight, size))
        out = np.zeros(len(y))
        for k in range(FOLDS):
            part = logistic(rows, cols, dense, y, weight * (fold != k), size)
            out[fold == k] = probability(rows, cols, dense, part, size)[fold == k]
        dense = np.column_stack([dense, out])
    return models


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: dict[str, str], sample: int) -> DataFrame:
    """group, words (distinct), shape and y of about sample labelled documents: those whose hashed id is least.

    The ids of the sample, bounded like it, are broadcast to the documents. Of rows that share an id one text enters, the least, so
    a repeated id brings one row; labels that share an id count together. Texts with the same two least hashes of neighbouring
    words, near copies for the most part, make a group.
    """
    n = labels.count()
    ids = labels.where(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(id_col, F.lit("toxicity")), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30)))
    ids = ids.groupBy(id_col).agg(F.array(*[F.max(F.coalesce(F.expr(e), F.lit(False)).cast("int")) for e in categories.values()]).alias("__y"))
    train = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("__t")).join(F.broadcast(ids), id_col)
    train = train.groupBy(id_col).agg(F.min("__t").alias("__t"), F.first("__y").alias("__y")).select("__t", "__y")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
        for f in frames:
            rows = []
            for text, y in zip(f["__t"], f["__y"], strict=True):
                h = np.fromiter(map(hashed.__getitem__, text.lower().split()), np.uint64)
                pairs = (h[:-1] ^ (h[1:] >> np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15) if len(h) > 1 else np.append(h, np.uint64(0))
                group = f"{pairs.min()} {(pairs ^ (pairs >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).min()}"
                rows.append((group, sorted(marks(text.lower())), shape(text), y))
            yield pd.DataFrame(rows, columns=["group", "words", "shape", "y"])

    return cut(batches_in(train).mapInPandas(run, "group string, words array<string>, shape array<double>, y array<int>"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: dict[str, str] = CATEGORIES, sample: int = SAMPLE) -> dict:
    """Vocabulary and chain, from a bounded sample of labelled documents. A group of near copies weighs as one document.

    Null ids, null texts and null labels teach nothing; without a labelled document the model is empty.

    Words are chosen by how much more often they occur with a category than without (log-likelihood ratio of weighted
    counts, a word in at least LEAST_GROUPS groups), counted by Spark.
    """
    train = sampled(docs, labels, id_col, text_col, categories, sample)
    weighted = train.join(train.groupBy("group").agg((1 / F.count("*")).alias("weight")), "group")
    ys = list(range(len(categories)))
    sums = weighted.agg(F.sum("weight").alias("n"), *[F.sum(F.col("weight") * F.get("y", F.lit(k))).alias(f"y{k}") for k in ys]).first()
    if not sums["n"]:
        return {"vocabulary": {}, "models": [], "categories": list(categories)}
    words = weighted.select(F.explode("words").alias("w"), "weight", "y")
    found = words.groupBy("w").agg(F.sum("weight").alias("df"), *[F.sum(F.col("weight") * F.get("y", F.lit(k))).alias(f"y{k}") for k in ys])

    def ratio(k: int) -> Column:
        share = sums[f"y{k}"] / sums["n"]
        a, b = F.col(f"y{k}"), F.col("df") - F.col(f"y{k}")
        part = lambda o, e: F.when((o > 1e-9) & (e > 1e-9), o * F.log(o / e)).otherwise(0.0)
        return 2 * (part(a, F.col("df") * share) + part(b, F.col("df") * (1 - share)))

    scored = found.where(F.col("df") >= LEAST_GROUPS).select("w", F.greatest(*[ratio(k) for k in ys], F.lit(0.0)).alias("g"))
    chosen = scored.where(F.col("g") >= LEAST_RATIO).orderBy(F.desc(F.round("g", 6)), "w").limit(WORDS).collect()
    vocabulary = {r["w"]: k for k, r in enumerate(chosen)}

    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda words: np.array(sorted(vocabulary[w] for w in words if w in vocabulary), "<u2").tobytes())

    ids = F.pandas_udf(places, "binary")("words").alias("ids")
    got = weighted.select("group", ids, "shape", "y", "weight").collect()  # two bytes a word: bounded by SAMPLE and WORDS
    got = sorted((r["group"], np.frombuffer(r["ids"], "<u2").tolist(), r["shape"], r["y"], r["weight"]) for r in got)
    codes = pd.Series([g[0] for g in got]).factorize()[0]
    rows = np.repeat(np.arange(len(got)), [len(g[1]) for g in got])
    cols = np.array([w for g in got for w in g[1]], np.int64)
    dense = np.array([g[2] for g in got], float).reshape(len(got), SHAPE)
    y = np.array([g[3] for g in got], float)
    models = fit_chain(rows, cols, dense, list(y.T), np.array([g[4] for g in got]), codes % FOLDS, max(len(vocabulary), 1))
    return {"vocabulary": vocabulary, "models": models, "categories": list(categories)}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with p_<category> for each category (double) and rejected (boolean), in place of columns of such names.

    A null or empty text has probability 0 throughout and is kept; so is everything if nothing could be learned. Repeated
    rows get equal results; an empty table stays empty.
    """
    names = model["categories"]
    size = max(len(model["vocabulary"]), 1)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features(model["vocabulary"])
        for batch in batches:
            texts = [t or "" for t in batch]
            found = [features.words(t) for t in texts]
            rows = np.repeat(np.arange(len(texts)), [len(w) for w in found])
            cols = np.array([w for x in found for w in x], np.int64)
            dense = np.array([shape(t) for t in texts], float).reshape(len(texts), SHAPE)
            empty = np.array([not t for t in texts], bool)
            out = {}
            for k, name in enumerate(names):
                p = np.zeros(len(texts))
                if model["models"]:
                    p = probability(rows, cols, dense, model["models"][k], size)
                    dense = np.column_stack([dense, p])
                out[f"p_{name}"] = np.where(empty, 0.0, p)
            yield pd.DataFrame(out)

    # not deterministic only in name: so that the planner doesn't run it once for each use
    scored = F.pandas_udf(run, ", ".join(f"p_{n} double" for n in names)).asNondeterministic()
    made = {f"p_{n}" for n in names} | {"rejected"}
    columns = [c for c in docs.columns if c not in made]
    batches_in(docs)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r"), scored(F.col(text_col)).alias("p"))
    return whole.select(*[F.col("r")[c].alias(c) for c in columns], *[F.col("p")[f"p_{n}"].alias(f"p_{n}") for n in names], (F.col("p")[f"p_{DECIDES}"] >= THRESHOLD).alias("rejected"))
