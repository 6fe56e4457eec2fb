"""The five stages, each against brute force on what its predecessor kept."""

import random

import numpy as np
import pytest
from tests.llm.test_operators import brute_links, closure, sentence

import __spark_entry__
import corpus_pipeline
from textloom.llm import bpe, registry

BAD = "idiot moron scum trash".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for k in range(240):
        words = sentence(rng, rng.randint(30, 90)).split()
        if k % 6 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((k, " ".join(words) + "\nAll rights reserved by the owner of site %d today" % k, "en"))
    rows += [(300 + k, rows[1][1], "en") for k in range(3)] + [(310, rows[7][1].replace("\n", " extra\n"), "en"), (320, "%%% 12", None), (321, None, None), (322, "", "en")]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(k, t, lang, "src0", None if t is None else len(t)) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            rows = docs.collect()
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
            kept.append({r["doc_id"]: r["text"] for r in rows})
    start, calm, named, lined, single = kept
    toxic = {k for k, t in start.items() if t and any(b in t.split() for b in BAD)}
    assert len(toxic & set(calm)) <= 0.05 * len(toxic) and len(set(start) - toxic - set(calm)) <= 4
    assert set(calm) - set(named) == {k for k, t in calm.items() if not t or not any(c.isalpha() for c in t)}
    assert set(lined) == set(named)
    marked = [k for k, t in lined.items() if "All rights reserved" in t]
    assert marked == [min(named)]
    ids = sorted(lined)
    least = closure(brute_links([lined[k] for k in ids]))
    assert set(single) == {ids[j] for j in range(len(ids)) if least[j] == j}
    own, total = bpe.codec(), 0
    rows = docs.collect()
    for k, t in single.items():
        pieces = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == k)
        assert sum(p[2] for p in pieces) == len(own.encode(t)) + 1
        total += len(own.encode(t)) + 1
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(s)] == np.cumsum([0, *[n for _, n in sorted(s)]])[:-1].tolist() for s in spans.values())
    assert len(spans) <= -(-total // 4096) + 1


def test_run_and_registry(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 100
    names = set(__spark_entry__.queries())
    assert set(registry.queries()) | {"pipeline"} <= names and set(__spark_entry__.oracle_sql()) <= names


ODD = "doc_id long, text string, lang string, source string, n_chars long, __drop string, node string, __id string, r string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(14)
    texts = [sentence(rng, 40) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (5, texts[6]), (None, texts[7]), (None, None), (40, None), (41, ""), (42, "\n".join(sentence(rng, 30) for _ in range(3000)))]
    return spark.createDataFrame([(k, t, None, None, None if t is None else len(t), "clash", "clash", "clash", None) for k, t in rows], ODD)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_empty_tables(spark, tables, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got, empty = stage(spark, odd, tables), stage(spark, odd.limit(0), tables)
    assert empty.count() == 0
    if name == "packing":
        assert {(r["doc_id"], r["piece"]) for r in got.collect()} >= {(5, 0), (None, 0), (40, 0), (42, 0), (42, 1)} and got.where("piece = 0").count() == odd.count()
        return
    assert got.columns == empty.columns == odd.columns
    rows = got.collect()
    assert all(r["__drop"] == "clash" and r["r"] is None for r in rows)
    ids = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in rows)
    if name == "line_dedup":
        assert len(rows) == odd.count()
    if name == "toxicity":
        assert len(rows) >= odd.count() - 3
    if name == "language_id":  # no row has a language, so only texts without letters go
        assert len(rows) == odd.count() - 3
    if name == "ngram_join":
        # the text of 6 is in a row of id 5 too, which is the smaller one and stays beside the other text of that id
        assert ids == sorted([*(k for k in range(30) if k != 6), 5, -1, 40, 41, 42]) and sum(r["doc_id"] is None and r["text"] is None for r in rows) == 1


def test_what_stages_read_is_removed(spark, tables, tmp_path):
    import glob

    from textloom.llm.common import shared_dir

    base = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/pipeline-*/*"))
    corpus_pipeline.run(spark, tables).count()
    left = set(glob.glob(f"{base}/pipeline-*/*")) - before
    assert [p.rsplit("/", 1)[1] for p in left] == ["4-packing"]
