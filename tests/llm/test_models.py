"""The fitted models and the shard table against plain computations of the same definitions."""

import math
import random
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import langid, sharding, toxicity

LANGS = {"xx": "the river and stone of cloud garden".split(), "yy": "der fluss über größe und straße im wald".split(), "zz": "la niña corazón mañana río de sol".split()}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(21)
    rows = []
    for k in range(240):
        lang = sorted(LANGS)[k % 3]
        rows.append((k, " ".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 60))), lang if k % 11 else None))
    rows += [(300, None, "xx"), (301, "", "xx"), (302, "123 %% 45", "yy"), (303, "ab", None), (None, "the river", "xx"), (304, "x" * 70_000 + " the river", "xx"), (5, rows[5][1], "zz"), (305, "𝒳𝒴 İstanbul ﬁne", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.lit("clash")).withColumn("p", F.lit("clash")).withColumn("r", F.lit(None).cast("int"))


def plain_trigrams(text):
    """Letter trigrams of a text in lower case, anything else one space, by bucket; a letter whose lower case is several stays as it is."""
    letters = [" "]
    for ch in text:
        low = ch.lower() if ch.isalpha() and ord(ch) < 0x10000 else " "
        letters.append(ch if low != " " and (len(low) != 1 or ord(low) > 0xFFFF) else low)
    letters.append(" ")
    squeezed = [c for k, c in enumerate(letters) if c != " " or k == 0 or letters[k - 1] != " "]
    out, mask = Counter(), 0xFFFFFFFF
    for a, b, c in zip(squeezed, squeezed[1:], squeezed[2:], strict=False):
        h = (ord(a) * 0x9E3779B1 & mask) ^ (ord(b) * 0x85EBCA77 & mask) ^ (ord(c) * 0xC2B2AE3D & mask)
        h = (h ^ h >> 15) * 0x2C1B3C6D & mask
        out[h >> 20] += 1
    return out


def test_language_is_that_of_the_nearest_centroid(labelled):
    model = langid.fit(labelled)
    rows = labelled.collect()
    held = {r["doc_id"]: r["held_out"] for r in labelled.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out")).collect()}
    learn = [r for r in rows if not held[r["doc_id"]] and r["lang"] is not None and r["text"] and any(c.isalpha() for c in r["text"])]
    seen = Counter(b for r in learn for b in plain_trigrams(r["text"]))
    for bucket in range(0, langid.BUCKETS, 7):
        assert abs(model["idf"][bucket] - (math.log((1 + len(learn)) / (1 + seen[bucket])) + 0.1)) < 1e-5
    got = langid.identify(labelled, model).collect()
    assert len(got) == len(rows) and all(r["h"] == r["p"] == "clash" for r in got)
    wrong = 0
    for r in got:
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        v = {b: math.sqrt(n) * float(model["idf"][b]) for b, n in plain_trigrams(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[b]) for b, x in v.items()) / max(size, 1e-12) for c in model["centroids"]]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert abs(max(0.0, cosine[best]) - r["score"]) < 1e-4
        assert r["lang_pred"] == model["langs"][best] or abs(cosine[best] - max(c for c, n in zip(cosine, model["langs"], strict=True) if n == r["lang_pred"])) < 1e-5
        assert r["rejected"] == (r["score"] < model["least"])
        wrong += r["held_out"] and r["lang"] not in (None, r["lang_pred"])
    assert wrong <= 1


def test_language_without_anything_to_learn(labelled):
    model = langid.fit(labelled.withColumn("lang", F.lit(None).cast("string")))
    got = langid.identify(labelled, model).collect()
    assert all(r["lang_pred"] == "und" and r["rejected"] == (not any(c.isalpha() for c in r["text"] or "")) for r in got)


def test_one_id_brings_one_row_to_the_sample(spark):
    df = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("river stone "), F.col("id").cast("string")).alias("text"), F.lit("xx").alias("lang"))
    df = df.union(spark.createDataFrame([(8, "fluss", "yy")], df.schema))
    seen = []
    collect = type(df).collect
    try:
        type(df).collect = lambda self: seen.append(rows := collect(self)) or rows
        langid.fit(df)
    finally:
        type(df).collect = collect
    assert max(len(rows) for rows in seen if rows and "at" in rows[0].__fields__) <= 2


def plain_chain(model, text):
    """p of each category of a text, one sum after the other."""
    place = model["vocabulary"]
    words = {place[w] for chunk in text.lower().split() for w in toxicity.marks(chunk) if w in place}
    dense, out = toxicity.shape(text), []
    size = max(len(place), 1)
    for weights in model["models"]:
        z = weights[-1] + sum(weights[w] for w in words) + sum(x * w for x, w in zip(dense, weights[size:-1], strict=True))
        out.append(1 / (1 + math.exp(-z)))
        dense = [*dense, out[-1]]
    return out


def test_toxicity_is_the_chain_of_its_models(spark):
    rng = random.Random(31)
    good, bad = "river stone garden cloud lamp window paper walks".split(), "idiot scum moron".split()
    rows = [(k, " ".join(rng.choice(good if rng.random() < (0.7 if k % 4 == 0 else 1.0) else bad) for _ in range(rng.randint(5, 50)))) for k in range(400)]
    rows += [(500, None), (501, ""), (None, "idiot scum"), (502, "word " * 30_000 + "idiot"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p", F.lit("clash")).withColumn("__p", F.lit("clash"))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)] + [(0, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model["models"]) == 2 and 3 <= len(model["vocabulary"]) <= toxicity.WORDS
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(r["__p"] == "clash" for r in got)
    for r in got:
        want = plain_chain(model, r["text"]) if r["text"] else [0.0, 0.0]
        assert abs(r["p_junk"] - want[0]) < 1e-9 and abs(r["p_toxic"] - want[1]) < 1e-9
        assert r["rejected"] == (r["p_toxic"] >= toxicity.THRESHOLD)
    caught = [r["rejected"] for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 400 and r["doc_id"] % 4 == 0]
    assert sum(caught) >= 0.9 * len(caught) and not any(r["rejected"] for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4)


def test_models_are_at_the_least_loss_and_learn_from_out_of_fold_probabilities():
    rng = np.random.default_rng(3)
    n, size = 300, 12
    present = rng.random((n, size)) < 0.3
    rows, cols = np.nonzero(present)
    dense, weight, fold = rng.random((n, 2)), rng.random(n) + 0.5, np.arange(n) % toxicity.FOLDS
    first = (present[:, 0] | (rng.random(n) < 0.1)).astype(float)
    second = (first.astype(bool) & present[:, 1]).astype(float)
    whole = np.column_stack([present.astype(float), dense, np.ones(n)])

    def slope(x, y, w, model):
        p = 1 / (1 + np.exp(-x @ model))
        return x.T @ (w * (p - y)) + toxicity.PENALTY * np.append(model[:-1], 0.0)

    models = toxicity.fit_chain(rows, cols, dense, [first, second], weight, fold, size)
    assert np.abs(slope(whole, first, weight, models[0])).max() < 0.05 * weight.sum()
    out = np.zeros(n)
    for k in range(toxicity.FOLDS):
        own = toxicity.logistic(rows, cols, dense, first, weight * (fold != k), size)
        out[fold == k] = 1 / (1 + np.exp(-whole[fold == k] @ own))
    chained = toxicity.logistic(rows, cols, np.column_stack([dense, out]), second, weight, size)
    assert np.allclose(chained, models[1])
    # with the first category's probability the second is told apart better than by chance
    z = np.column_stack([present.astype(float), dense, out, np.ones(n)]) @ models[1]
    assert z[second == 1].mean() > z[second == 0].mean() + 1


@pytest.mark.parametrize(("names", "size"), [(["a", "b", "c"], 7), ([f"s{k}" for k in range(17)], 1709), (["only"], 101)])
def test_shard_table_is_filled_by_turns(names, size):
    """Every shard's whole list of preferences is written out, and turns are taken one slot at a time."""
    wishes = []
    for name in names:
        digest = md5(name.encode()).digest()
        offset, skip = int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1
        wishes.append([(offset + j * skip) % size for j in range(size)])
        assert sorted(wishes[-1]) == list(range(size))
    owner: dict[int, int] = {}
    while len(owner) < size:
        for k, wish in enumerate(wishes):
            free = next((s for s in wish if s not in owner), None)
            if free is not None:
                owner[free] = k
    assert sharding.lookup_table(names, size) == [owner[s] for s in range(size)]
