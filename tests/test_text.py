"""Text functions on literal rows: wide characters, all kinds of white space, numerals, quirks that must be kept."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T


def value(spark, column, **row):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]) if row else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "x", "want"),
    [
        (T.strip, "　  a b\t　", "a b"),
        (T.squash_ws, "甲　乙 丙\n丁", "甲乙丙丁"),
        (T.norm_title, "书 (一)　", "书（一）"),
        (T.norm_link, "《书》 序「一」", "书序一"),
        (T.squash_punct, "甲，乙。〇 “丙”…", "甲乙丙"),
        (T.norm_match, "甲，乙。〇 “丙”…", "甲乙〇丙"),
        (T.tidy, "甲 乙 a 丙　。", "甲乙 a 丙。"),
        (T.strip_parens, "题（一）名（二）", "题名"),
        (T.loose, "与某居士、书（三）二", "与某书"),
        (T.num_to_cn, 0, "〇"),
        (T.num_to_cn, 10, "十"),
        (T.num_to_cn, 17, "十七"),
        (T.num_to_cn, 40, "四十"),
        (T.num_to_cn, 99, "九十九"),
        (T.cn_to_num, "廿三", 23),
        (T.cn_to_num, "卅", 30),
        (T.cn_to_num, "十", 10),
        (T.cn_to_num, "十一", 11),
        (T.cn_to_num, "七", 7),
        (T.cn_to_num, "奇", 0),
        (T.bigrams, "念佛三昧 Hello World9 佛", ["念佛", "佛三", "三昧", "hello", "world9", "佛"]),
        (T.bigrams, "", []),
        (T.bigrams, "a甲b", ["a甲", "甲b"]),
        (T.lex_text, "（白话）甲\n（白话）乙", "甲 乙"),
        (T.naive_terms, "请问如何念佛，以及持戒？", ["念佛", "持戒"]),
        (T.clean_text, " a[12]　b\n\nc ", "a b c"),
        (T.html_escape, "<a href='x'>&\"", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"),
        (T.add_refs, "a[1]b", "a<sup>1</sup>b"),
        (T.url_quote, "a b/ü", "a%20b%2F%C3%BC"),
        (T.sentences, "甲。」乙！\n丙 …… d? --", ["甲。」", "乙！", "丙 …", "d?"]),
        (T.json_body, "x {\"a\": {\"b\": 1}} y", '{"a": {"b": 1}}'),
        (T.json_body, "none", None),
        (T.speakable, "1. **甲**[2]", "甲"),
        (T.clen, "a 　b", 2),
        (T.looks_like_title, "与某人书（二）一", True),
        (T.looks_like_title, "今日天气", False),
    ],
)
def test_function(spark, f, x, want):
    assert value(spark, f("x"), x=x) == want


def test_subsequence(spark):
    df = spark.createDataFrame([("净土问答书序", "净土法门问答文书小序", True), ("净土答问书序", "净土法门问答文书小序", False), ("净序", "净土序", False), ("净土问答书序", "净土法门问答文书序一", False)], "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.is_subsequence("a", "b")).collect())


def test_snippet(spark):
    text = "a" * 30 + "\nkey" + "b" * 50
    assert value(spark, T.snippet("t", F.lit("key")), t=text) == "…" + "a" * 21 + " key" + "b" * 34 + "…"
    assert value(spark, T.snippet("t", F.lit("zzz")), t=text) == ""
    assert value(spark, T.snippet("t", F.lit("key")), t="key") == "key…"


def test_clip(spark):
    assert value(spark, T.clip("t", 5), t="abcdefgh") == "abcd…"
    assert value(spark, T.clip("t", 5), t="abc  defgh") == "abc…"
    assert value(spark, T.clip("t", 5), t="abcde") == "abcde"


def test_strip_source(spark):
    assert value(spark, T.strip_source("t"), t="正文（《某书》卷一） ").asDict() == {"body": "正文", "src": "（《某书》卷一）"}
    assert value(spark, T.strip_source("t"), t="正文").asDict() == {"body": "正文", "src": None}


def test_first_difference(spark):
    df = spark.createDataFrame([("abc", "abd", 2), ("abc", "abcd", 3), ("a", "a", None), ("", "a", 0)], "a string, b string, want long")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.first_difference("a", "b")).collect())


def test_bold_share(spark):
    df = spark.createDataFrame([([("甲乙", True), (" 丙", False)],), ([("  ", True)],), ([],)], "runs array<struct<text:string,bold:boolean>>")
    assert [round(r[0], 3) for r in df.select(T.bold_share("runs")).collect()] == [0.667, 0.0, 0.0]


def test_line_blocks(spark):
    got = value(spark, T.line_blocks("t"), t="# 标题\n\n1. 甲\n- 乙\n丙")
    assert [tuple(b) for b in got] == [("heading", "标题"), ("num", "甲"), ("bullet", "乙"), ("para", "丙")]


def test_paths_and_kinds(spark):
    assert value(spark, T.article_path("a", "p"), a="x-001", p=3) == "/a/x-001/?p=3"
    assert value(spark, T.article_path("a", "p"), a="x 1", p=-1) == "/a/x%201/"
    assert value(spark, T.source_priority(T.source_type("v")), v="jy") == 1
