"""Operators on small hand-made tables."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import SQUASHED
from textloom.operators import alignment, chunking, documents, linking, retrieval, segments, serving

SQUASH = SQUASHED.replace("(?U)", "")


def test_chunks_rebuild_the_text():
    rng = random.Random(1)
    for n in (0, 1, 720, 721, 5000):
        text = "".join(rng.choice("abc. ") for _ in range(n)).strip()
        parts = chunking.split_text(text, ".\n")
        assert all(len(p) <= 720 for p in parts)
        at = 0
        for p in parts:
            found = text.find(p, max(0, at - 81))
            assert 0 <= found <= at + 1  # overlapping or touching
            at = found + len(p)
        assert at >= len(text.rstrip()) or not parts


def test_rrf_does_not_depend_on_pool_order(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 1, 2, "c")]
    schema = "query int, pool int, rank int, id string"
    one = [r["id"] for r in retrieval.fuse(spark.createDataFrame(rows, schema), "query", "id").orderBy("rank").collect()]
    two = [r["id"] for r in retrieval.fuse(spark.createDataFrame([(q, 1 - p, k, i) for q, p, k, i in rows], schema), "query", "id").orderBy("rank").collect()]
    assert one[0] == two[0] == "b" and set(one) == set(two)


def test_merge_keeps_arrival_order(spark):
    rows = [(1, 0, 1, "a", 0.2), (1, 0, 2, "b", 0.1), (1, 1, 1, "c", 0.9), (1, 1, 2, "b", 0.8)]
    got = retrieval.merge_pools(spark.createDataFrame(rows, "query int, pool int, rank int, id string, score double"), "query", "id").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", 0.2), ("b", 0.8), ("c", 0.9)]


def test_dedupe_is_idempotent(spark):
    rows = [(1, "k", 1, 0.9, 1, "x"), (1, "k", 0, 0.5, 2, "y"), (1, "m", 0, 0.5, 3, "z"), (1, "", 0, 1.0, 4, "w")]
    df = spark.createDataFrame(rows, "q int, k string, p int, s double, pos int, id string")
    once = retrieval.dedupe(df, "q", "k", "p", "s", "pos")
    assert [r["id"] for r in once.orderBy("rank").collect()] == ["y", "z"]
    again = retrieval.dedupe(once.drop("rank"), "q", "k", "p", "s", "pos")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))


def test_rerank_drops_nothing(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "q int, rank int, id string")
    model = lambda m: m.withColumn("rerank_score", F.when(F.col("id") == "c", 1.0))
    assert [r["id"] for r in retrieval.rerank(df, "q", model).orderBy("rank").collect()] == ["c", "a", "b"]
    assert retrieval.rerank(df, "q") is df


def test_knn_falls_back_where_the_filter_finds_nothing(spark):
    vectors = spark.createDataFrame([(k, [float(k), 1.0], k % 3) for k in range(30)], "vec_id long, embedding array<double>, label int")
    asked = vectors.where("vec_id < 4").withColumn("wanted", F.when(F.col("vec_id") == 0, 77).otherwise(F.col("label")))
    got = retrieval.knn(asked, vectors, label="label", top=5).collect()
    assert {r["query"]: r["tier"] for r in got} == {0: 1, 1: 0, 2: 0, 3: 0}
    assert all(r["vec_id"] % 3 == r["query"] % 3 for r in got if r["tier"] == 0)


def test_pairing(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x"]), (["a"], ["x", "y"]), ([], ["x"]), ([], [])], "l array<string>, r array<string>")
    got = [[tuple(p) for p in r[0]] for r in df.select(segments.pair_tail_head(F.col("l"), F.col("r"))).collect()]
    assert got == [[("a", None), ("b", None), ("c", "x")], [("a", "x"), (None, "y")], [(None, "x")], []]


def test_runs_restart(spark):
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate("aabba")], "g int, pos int, kind string")
    assert [r["run"] for r in segments.runs(df, "kind", ["g"], ["pos"]).orderBy("pos").collect()] == [1, 1, 2, 2, 3]


def test_consume_uses_each_once(spark):
    body = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t"), (4, "u")], "id int, key string")
    toc = spark.createDataFrame([(10, "t"), (11, "t")], "id int, key string")
    assert {r["id"]: r["__other"] for r in linking.consume(body, toc, "key", "id").collect()} == {1: 10, 2: 11, 3: None, 4: None}


def test_unique_by_content(spark):
    refs = spark.createDataFrame([("r1", "某书", "甲乙丙"), ("r2", "某书", "无")], "ref string, name string, quote string")
    titles = spark.createDataFrame([("某、书", 1, "前甲乙丙后"), ("某书", 2, "别的")], "title string, id int, body string")
    assert {r["ref"]: r["id"] for r in linking.unique_by_content(refs, titles).collect()} == {"r1": 1, "r2": None}


def brute_align(items, docs, seed_hits=8):
    """The alignment by plain search: all occurrences of all seeds in document order, all lines of each candidate."""
    squash = lambda t: re.sub(SQUASH, "", t.lower())
    out = {}
    for i, quote in items:
        q = squash(quote)
        if len(q) < 10:
            continue
        offs = [0] if len(q) <= 14 else [*range(0, len(q) - 14 + 1, max(8, len(q) // 8)), len(q) - 14]
        near = set()
        for o in offs:
            seed, hits = q[o : o + 14], 0
            for d, text in docs:
                t = squash(text or "")
                p = t.find(seed)
                while len(seed) >= 10 and p >= 0 and hits < seed_hits:
                    near.add(d)
                    hits, p = hits + 1, t.find(seed, p + 1)
        best = None
        for d, text in docs:
            if d not in near:
                continue
            hits, cover, total = [], 0, 0
            for n, line in enumerate(text.split("\n")):
                x = squash(line)
                blocks = SequenceMatcher(None, x, q, autojunk=False).get_matching_blocks() if len(x) >= 8 else []
                m, long = sum(b.size for b in blocks), [b for b in blocks if b.size >= 6]
                if long and m >= 10 and ((long[0].a <= 4 and len(x) <= 2 * m) or m >= 0.75 * len(x)):
                    hits.append((long[0].b, n))
                    cover, total = cover + m, total + len(x)
            if cover >= 0.6 * len(q):
                key = (-round(cover / len(q), 1), round(total / len(q), 2), d)
                if best is None or key < best[0]:
                    best = (key, [n for _, n in sorted(hits, key=lambda h: h[0])])
        if best:
            out[i] = (best[0][2], -best[0][0], best[0][1], best[1])
    return out


def test_alignment_is_a_plain_search(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(8)) for _ in range(30)]
    items = [(k, " ".join(rng.sample(texts[k % 30].replace("\n", " ").split(), 6))) for k in range(5)]
    for k in range(25):  # quotes: some lines of a text, changed a little, and copies of it elsewhere
        lines = texts[k].split("\n")[1:5]
        quote = " ".join(lines)
        items.append((100 + k, "".join(rng.choice("abc") if rng.random() < 0.04 * (k % 4) else ch for ch in quote)))
        texts += [texts[k].replace("a", "b", k % 5)] * (1 + 9 * (k % 7 == 0))
    items += [(300, "abc"), (301, "abcdefghij")]
    docs = [*enumerate(texts), (900, None)]
    got = alignment.align(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r["item_id"]: (r["doc_id"], r["cover"], r["ratio"], list(r["lines"])) for r in got.collect()}
    want = brute_align(items, docs)
    assert rows == want and len(want) >= 20
    some = got.first()
    assert some["reply"] == "".join(texts[some["doc_id"]].split("\n")[n] for n in some["lines"])


def test_alignment_edges(spark):
    quote = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = spark.createDataFrame([(1, "nothing here at all\nreally nothing"), (2, f"intro\n{quote.replace('lazy', 'la-zy')}\nend"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, quote), (8, "tiny")], "item_id long, text string")
    got = alignment.align(items, docs, other=None).collect()
    assert [(r["item_id"], r["doc_id"], r["cover"]) for r in got] == [(7, 2, 1.0)]
    assert alignment.contained(items, docs).count() == 0
    assert alignment.align(items.limit(0), docs).count() == 0
    # a long line that holds a short quote brings more than was quoted
    long = docs.limit(0).union(spark.createDataFrame([(5, f"{'x y z ' * 60}{quote}")], docs.schema))
    assert alignment.align(items, long).count() == 0


def test_pieces_are_found_by_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abcabcabc"), (2, "xabcd"), (3, None), (4, "")], "doc_id long, text string")
    pieces = spark.createDataFrame([("abc",), ("abcd",), ("zzz",)], "piece string")
    want = {("abc", 1, 0), ("abc", 1, 3), ("abc", 1, 6), ("abc", 2, 1), ("abcd", 2, 1)}
    for sent in (alignment.SENT, 0):
        monkeypatch.setattr(alignment, "SENT", sent)
        assert {tuple(r) for r in alignment.find_pieces(pieces, docs, "doc_id", "text").select("piece", "doc_id", "pos").collect()} == want


def test_reading_list(spark):
    df = spark.createDataFrame([(1, "甲 ◎乙 （以上 书.一） ◎丙 戊（以上 序） 丁"), (2, "◎◎己 庚\n辛")], "id int, body string")
    got = [(r["id"], r["sec"], r["name"], r["marked"]) for r in documents.reading_list(df, "id", "body").orderBy("id", "pos").collect()]
    assert got == [(1, "书·一", "甲", False), (1, "书·一", "◎乙", False), (1, "序", "丙", True), (1, "序", "戊", False), (1, "其他", "丁", False), (2, "其他", "己", True), (2, "其他", "庚", False), (2, "其他", "辛", False)]


def test_inject_is_idempotent(spark):
    df = spark.createDataFrame([("<head></head></head>",), ("none",)], "html string")
    once = documents.inject(df, "html", "<s id=q>", "id=q")
    assert [r["html"] for r in once.collect()] == ["<head><s id=q></head></head>", "none"]
    assert [r["status"] for r in documents.inject(once.drop("status"), "html", "<s id=q>", "id=q").collect()] == ["present", "no head"]


def test_citations(spark):
    rows = [("说「甲乙」[1]，又「丙丁」[2]。[9]", ["有甲，乙。", "无"]), ("没有", ["x"]), ("「甲乙」[3]", ["甲乙"])]
    got = serving.validate_citations(spark.createDataFrame(rows, "reply string, ctx array<string>"), "reply", "ctx").collect()
    assert [(r["cited"], r["invalid"], r["quote_checked"], r["quote_ok"], r["faithful"]) for r in got] == [(3, 1, 2, 1, False), (0, 0, 0, 0, True), (1, 1, 1, 0, False)]


def test_ttl_cache_hits_do_not_renew(spark):
    df = spark.createDataFrame([(k, "q") for k in range(8)], "id int, key string").withColumn("ts", F.timestamp_seconds(F.col("id") * 40))
    got = [r["hit"] for r in serving.ttl_cache(df, ["key"], "ts", "id", 100).orderBy("id").collect()]
    assert got == [False, True, True, False, True, True, False, True]


def test_quota(spark):
    df = spark.createDataFrame([(k, 1) for k in range(5)], "id int, user int").withColumn("ts", F.timestamp_seconds(F.lit(1000)))
    assert [r["accepted"] for r in serving.quota(df, "user", "ts", "id", 3).orderBy("id").collect()] == [True] * 3 + [False] * 2


def test_streams_assemble_and_skip_bad_lines(spark):
    lines = serving.event_lines(spark.createDataFrame([(1, "a\n\"b\"")], "id int, text string"), "id", "text")
    bad = spark.createDataFrame([(1, 99, "{broken")], "id int, seq int, line string")
    got = serving.assemble(lines.unionByName(bad), "id").first()
    assert got["reply"] == 'a\n"b"' and got["complete"] and got["n_deltas"] == 2
    sse = spark.createDataFrame([('data: {"choices":[{"delta":{"content":"x"}}]}',), ("data: [DONE]",), (": ping",)], "line string")
    assert [r["delta"] for r in serving.sse_deltas(sse, "line").collect()] == ["x", None, None]


@pytest.mark.parametrize(("text", "hard"), [("短问", False), ("a? b？", True), ("x" * 24, True), ("甲与乙的区别", True)])
def test_hard_questions(spark, text, hard):
    assert spark.range(1).select(serving.is_hard(F.lit(text))).first()[0] is hard
