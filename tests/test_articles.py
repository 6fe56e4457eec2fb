"""Articles and entry books cut out of paragraphs, the stored lexical index, verification, indexing: against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import contents, entries, indexing, lexical, linking, verification

PARAS = "file string, pos int, text string, bold boolean"


def paras(spark, rows, file="f"):
    return spark.createDataFrame([(file, k, t, b) for k, (t, b) in enumerate(rows)], PARAS)


TOC = ["与某甲居士书（三）", "净土决疑论序", "附某寺碑记", "复王生书（附）", "南山大觉莲社记", "续编书（二）", "下文无翻译"]


def test_contents_are_expanded(spark):
    lines = [("印光法师文钞目次", False), ("卷第一", False), ("书", False), *[(t, False) for t in TOC], ("说明，不是题", False), ("1 页", False), ("长" * 61, False), ("某序", False)]
    found = contents.contents_lines(paras(spark, lines))
    assert [r["title"] for r in found.orderBy("pos").collect()] == TOC
    expected, aliases = contents.expected_titles(found)
    counts = {r["canon"]: r["count"] for r in expected.collect()}
    assert counts == {**{f"与某甲居士书{n}": 1 for n in "一二三"}, "续编书一": 1, "续编书二": 1, **dict.fromkeys(["净土决疑论序", "附某寺碑记", "复王生书（附）", "南山大觉莲社记", "下文无翻译"], 1)}
    named = {(r["alias"], r["canon"], r["members"]) for r in aliases.collect()}
    assert {("与某甲居士书（二）", "与某甲居士书二", 1), ("与某甲居士书", "与某甲居士书一", 1), ("与某甲居士书（三）", "与某甲居士书", 3), ("与某甲居士书（三）", "与某甲居士书三", 1), ("某寺碑记", "附某寺碑记", 1), ("复王生书", "复王生书（附）", 1), ("下文", "下文无翻译", 1)} <= named


def test_articles_are_parsed(spark):
    expected, aliases = contents.expected_titles(spark.createDataFrame([("f", k, t) for k, t in enumerate(TOC)], "file string, pos int, title string"))
    body = [
        ("开头没有题", False), ("卷第一", False), ("书", True), ("与某甲居士书", False), ("原文一", True), ("【译文】译一", False), ("译二", False), ("原文二", True), ("【译文】", False), ("译三", False), ("【注释】", False), ("[1]【词】注", False),
        ("这是一句很长很长很长很长很长很长很长很长很长很长很长很长的原文。", True), ("复某甲居士书二（民国十年）", False), ("x", True), ("与某甲居士书（三）", True), ("y", True), ("续编书（二）", False), ("净土决疑论序", False), ("附录 某寺碑记", False), ("陕西南山大觉莲社缘起记", True), ("z", False), ("从未列出之序", True), ("w", False),
    ]
    got = contents.parse_articles(paras(spark, body), expected, aliases).orderBy("pos").collect()
    seen = [(r["article"], r["seg"], r["role"], r["how"]) for r in got]
    assert seen[:4] == [(1, 1, "orig", "untitled"), (None, None, "juan", None), (None, None, "category", None), (2, 1, "title", "listed")]
    assert [s[:3] for s in seen[4:13]] == [(2, 1, "orig"), (2, 1, "trans"), (2, 1, "trans"), (2, 2, "orig"), (2, 2, "trans"), (2, 2, "trans"), (2, 2, "note"), (2, 2, "note"), (2, 3, "orig")]
    assert seen[13] == (3, 1, "title", "swapped") and got[13]["canons"] == ["与某甲居士书二"]
    assert seen[15] == (4, 1, "title", "listed") and got[15]["canons"] == ["与某甲居士书三"]
    assert got[17]["canons"] == ["续编书二"] and got[18]["canons"] == ["净土决疑论序"] and got[19]["canons"] == ["附某寺碑记"]
    assert got[20]["how"] == "contained" and got[20]["canons"] == ["南山大觉莲社记"]
    assert seen[22][2] == "orig"  # an article is open, so a title that nothing lists opens none
    assert [r["body"] for r in got[5:9]] == ["译一", "译二", "原文二", ""]
    groups = contents.parse_articles(paras(spark, body), expected, aliases, groups_first=F.lit(True), loose_files=F.lit(True)).orderBy("pos").collect()
    assert groups[17]["canons"] == ["续编书一", "续编书二"] and groups[22]["how"] == "guessed"
    assert contents.parse_articles(paras(spark, body).limit(0), expected, aliases).count() == 0
    alone = contents.parse_articles(paras(spark, body, "other"), expected, aliases)
    assert {r["how"] for r in alone.where("how IS NOT NULL").collect()} == {"untitled"}


def test_titles_contained(spark):
    refs = spark.createDataFrame([(1, "v", "陕西南山大觉莲社缘起记"), (2, "v", "南山莲社"), (3, "v", "全然不同的一个题"), (4, "w", "陕西南山大觉莲社缘起记")], "ref int, vol string, name string")
    titles = spark.createDataFrame([("v", 2, "南山大觉莲社记"), ("v", 1, "大觉莲社缘起记"), ("v", 0, "短记")], "vol string, ord int, title string")
    assert {r["ref"]: r["canon"] for r in contents.containing_title(refs, titles).collect()} == {1: "大觉莲社缘起记", 2: None, 3: None, 4: None}


def test_entry_book():
    book = entries.Book(["一、赞", "二、劝"], anchors={"后记": "书尾"}, raw="《选读》")
    rows = ["题词", "开卷语", "《选读》", "某序", "一、赞", "（一）小节", "【原文】甲", "乙", "（《书》卷一）", "【译文】A", "B", "（一）小节", "【原文】丙", "【译文】", "二、劝", "散文", "附录", "某后记", "终"]
    got = entries.segment([{"text": t, "plain": True, "follows": t == "题词"} for t in rows], book)
    assert [(g[0], g[1], g[3], g[4], g[5], g[6]) for g in got] == [
        ("题词", "卷首", "plain", 0, "开卷语", None), ("《选读》", "卷首", "plain", 0, "某序", None),
        ("（一）小节", "一、赞", "source", 0, "甲乙", "（《书》卷一）"), ("（一）小节", "一、赞", "translation", 0, "AB", "（《书》卷一）"), ("（一）小节", "一、赞", "source", 1, "丙", None),
        ("二、劝", "二、劝", "plain", 0, "散文", None), ("某后记", "附录", "plain", 0, "终", None),
    ]
    assert [g[2] for g in got[:2]] == [False, True] and entries.segment([], book) == []


def test_phrases_against_a_plain_index(spark, tmp_path):
    rng = random.Random(5)
    words = "of the a cloud river stone 念佛 三昧 念 佛法".split()
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(80)] + [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lexical.build(df, str(tmp_path / "i"))
    asked = [(1, ["cloud river"], None), (2, ["念佛三昧", "stone"], None), (3, ["the of the"], 5), (4, [], None), (5, ["river", "river"], None), (6, ["！"], None)]
    got = lexical.search(spark, str(tmp_path / "i"), spark.createDataFrame(asked, "item_id long, terms array<string>, only long"), only="only", top=500)

    def tokens(t):
        out = []
        for run in re.findall(r"[^\W_]+", t or ""):
            han = re.search("[一-鿿]", run)
            out += [run.lower()] if not han else [run] if len(run) == 1 else [run[k : k + 2] for k in range(len(run) - 1)]
        return out

    texts = {k: tokens(t) for k, t in docs}
    mean = sum(map(len, texts.values())) / len(texts)
    want = {}
    for q, terms, only in asked:
        for term in terms:
            p = tokens(term)
            tf = {d: n for d, t in texts.items() if p and (n := sum(t[k : k + len(p)] == p for k in range(len(t))))}
            idf = max(math.log((len(texts) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6)
            for d, n in tf.items():
                want[q, d] = want.get((q, d), 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(texts[d]) / mean))
        for d in [d for a, d in want if a == q and only is not None and d != only]:
            del want[q, d]
    rows = {(r["item_id"], r["doc_id"]): r["score"] for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-5 for k in want) and len(want) > 40


def test_an_index_is_stored_once_for_the_files_it_was_made_of(spark, tmp_path):
    source = str(tmp_path / "docs")
    make = lambda text: spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(source)
    make("one")
    first = lexical.stored(spark, source, spark.read.parquet(source))
    assert lexical.stored(spark, source, spark.read.parquet(source)) == first
    make("two and more")
    assert lexical.stored(spark, source, spark.read.parquet(source)) != first


def test_rewriting_falls_back(spark):
    asked = spark.createDataFrame([(1, "how clouds form"), (2, "念佛")], "item_id long, text string")
    plain = {r["item_id"]: (r["queries"], r["terms"]) for r in lexical.rewritten(asked).collect()}
    assert plain == {1: (["how clouds form"], ["how", "clouds", "form"]), 2: (["念佛"], ["念佛"])}
    for answer in ("not json", '{"q": ""}', '{"q": "%s"}' % ("x" * 61), None):
        got = lexical.rewritten(asked, model=lambda df, a=answer: df.withColumn("answer", F.lit(a).cast("string")))
        assert {r["item_id"]: (r["queries"], r["terms"]) for r in got.collect()} == plain


def test_opcodes_make_one_text_the_other(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for _ in range(60)] + [("same", "same"), ("", ""), (None, "x")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    for r in df.select("a", "b", verification.opcodes("a", "b").alias("ops")).collect():
        if r["a"] is None:
            assert r["ops"] == []
            continue
        out, at = "", 0
        for op in r["ops"]:
            out, at = out + r["a"][at : op["a1"]] + r["b"][op["b1"] : op["b2"]], op["a2"]
            assert op["op"] in ("replace", "delete", "insert")
        assert out + r["a"][at:] == r["b"]


def test_links_can_be_set_again(spark):
    segs = spark.createDataFrame([("a", 1, "s", "x"), ("a", 2, "s", None), ("a", 3, "s", "y")], "id string, seg int, src string, srcId string")
    found = spark.createDataFrame([("a", 1, "x"), ("a", 2, "z")], "id string, seg int, srcId string")
    once = linking.set_links(segs, found)
    assert {r["seg"]: (r["srcId"], r["changed"]) for r in once.collect()} == {1: ("x", False), 2: ("z", True), 3: (None, True)}
    assert linking.set_links(once.drop("changed"), found).where("changed").count() == 0


def test_steps_and_entries(spark):
    assert [indexing.clamp(n) for n in (None, 0, 7, 99)] == [25, 1, 7, 25]
    arts = spark.range(40).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"))
    steps = [indexing.step(arts, arts.select("id"), c, 30).first() for c in (0, 25)]
    assert [(s["cursor"], s["done"], s["articles"], s["chunks"]) for s in steps] == [(25, False, 25, 25), (50, True, 15, 15)]
    kv = indexing.put(spark.createDataFrame([("a", "1", "2024-01-01"), ("a", "2", "2024-01-02"), ("b", "3", "2023-01-01")], "k string, v string, t string"), F.col("k"), F.col("v"), "t", 86400)
    held = indexing.live(kv, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()
    assert [(r["key"], r["value"]) for r in held] == [("a", "2")]


@pytest.mark.parametrize(("rows", "want"), [(["a", "", "b", "c", "[1]n", "d"], [1, 2, 2, 3, 4]), (["", " ", "x"], [1])])
def test_blank_groups(spark, rows, want):
    df = spark.createDataFrame([("i", k, t) for k, t in enumerate(rows)], "id string, pos int, text string")
    got = entries.blank_groups(df, F.col("text").startswith("[")).orderBy("pos").collect()
    assert [r["group"] for r in got] == want
