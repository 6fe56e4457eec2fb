"""Word files and article JSON made here, read and segmented."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import ingest
from textloom.sources import articles, docx

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def paragraph(*runs, style=None):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    body = "".join(f"<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t>{text}</w:t></w:r>" for text, bold in runs)
    return f"<w:p>{head}{body}</w:p>"


def save(path, *paragraphs):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(paragraphs)}</w:body></w:document>')


def test_word_files(spark, tmp_path):
    save(tmp_path / "a.docx", paragraph(("目录", False), style="TOC1"), paragraph(("甲乙丙", True), ("丁", False)), paragraph(("戊", True), ("己庚辛", False)), paragraph())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = docx.paragraphs(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["text"], r["style"], r["first_bold"], r["bold"]) for r in got] == [(0, "目录", "TOC1", False, False), (1, "甲乙丙丁", None, True, True), (2, "戊己庚辛", None, True, False), (3, "", None, False, False)]
    assert [r["text"] for r in ingest.after_contents(docx.paragraphs(spark, str(tmp_path))).orderBy("pos").collect()] == ["甲乙丙丁", "戊己庚辛", ""]


@pytest.fixture
def published(spark, tmp_path):
    rows = [
        {"id": "v-001", "volume": "v", "title": "一", "summary": "提要", "segments": [{"orig": ["甲", ""], "trans": ["A", ""], "notes": [{"n": 1, "term": "词", "text": "注"}]}, {"orig": ["乙"], "trans": [], "notes": [], "src": "出处"}]},
        {"id": "w-001", "volume": "w", "title": "二", "plain": True, "segments": [{"orig": ["丙", "丁"], "trans": ["C", "D"], "notes": []}]},
    ]
    for r in rows:
        (tmp_path / f"{r['id']}.json").write_text(json.dumps(r, ensure_ascii=False))
    (tmp_path / "bad.json").write_text("{")
    return articles.read(spark, str(tmp_path))


def test_articles(spark, published, tmp_path):
    assert published.count() == 2
    flags = {r["id"]: tuple(r)[1:] for r in articles.paired_flags(published).collect()}
    assert flags == {"v-001": (True, True, True, 1), "w-001": (False, True, True, 0)}
    assert {r["id"]: r["body"] for r in articles.search_text(published).collect()}["v-001"] == "提要\n甲\nA\n注\n乙\n出处"
    chunks = [(r["aid"], r["kind"], r["p"]) for r in articles.chunk_sources(published).orderBy("aid", "p").collect()]
    assert chunks == [("v-001", "pair", 0), ("v-001", "orig", 4), ("w-001", "orig", 0), ("w-001", "orig", 1), ("w-001", "trans", 2), ("w-001", "trans", 3)]
    terms = articles.term_dictionary(published)
    assert [tuple(r) for r in terms.collect()] == [("词", "v-001", 1, 1)]
    assert articles.replace_volume(terms, terms.limit(0), "v").count() == 0
    out = str(tmp_path / "out")
    articles.write(published.drop("file"), out)
    articles.write(published.drop("file").where("volume = 'w'").withColumn("title", F.lit("新")), out)
    assert {r["id"]: r["title"] for r in spark.read.parquet(out).collect()} == {"v-001": "一", "w-001": "新"}


def test_catalog(spark, tmp_path):
    tree = {"id": "v", "name": "卷", "group": "g", "juans": [{"name": "j1", "cats": [{"name": "书", "items": [{"id": "v-001", "title": "一"}, {"id": "v-002", "title": "二"}]}]}, {"name": "j2", "cats": [{"name": "序", "items": [{"id": "v-003", "title": "三"}]}]}]}
    (tmp_path / "books.json").write_text(json.dumps(tree))
    got = articles.catalog_items(articles.read(spark, str(tmp_path), articles.CATALOG)).orderBy("j", "c", "i").collect()
    assert [(r["juan"], r["category"], r["id"]) for r in got] == [("j1", "书", "v-001"), ("j1", "书", "v-002"), ("j2", "序", "v-003")]


def rows(spark, texts, **more):
    made = [("f.docx", k, t, *[v[k] for v in more.values()]) for k, t in enumerate(texts)]
    extra = "".join(f", {name} boolean" for name in more)
    return spark.createDataFrame(made, f"file string, pos int, text string{extra}")


def texts(df):
    return [r["text"] for r in df.orderBy("pos").collect()]


def test_skipping(spark):
    assert texts(ingest.from_second(rows(spark, ["第一章", "目", "第一章", "文"]), "第一章")) == ["第一章", "文"]
    assert texts(ingest.drop_noise(rows(spark, ["目录", "12", "文 1"]), ["目录"])) == ["文 1"]
    df = rows(spark, ["a", "SKIP", "b", "HEAD", "c"])
    assert texts(ingest.excluded_between(df, F.col("text").isin("SKIP", "HEAD"), F.col("text") == "SKIP")) == ["a", "HEAD", "c"]
    df = rows(spark, ["书", "x", "书", "x", "原文"])
    assert texts(ingest.anchored(df, F.col("text") == "书", F.col("text") == "原文", within=2)) == ["书", "x", "原文"]
    df = rows(spark, ["书", "", "x", "原文", "书", "译文", "原文"])
    got = ingest.origin_follows(df, F.col("text") != "", F.col("text") == "原文", F.col("text") == "译文").orderBy("pos").collect()
    assert [r["follows"] for r in got] == [True, True, False, False, True, False]


def test_marks(spark):
    df = rows(spark, ["卷 一", "书", "甲", "跋", "乙"])
    kind = ingest.marker_kind(F.col("text"), "^卷[一二]$", ["书", "跋"])
    filled = ingest.fill_forward(df, {"juan": F.when(kind == "juan", F.col("text")), "cat": F.when(kind == "cat", F.col("text"))}).orderBy("pos").collect()
    assert [(r["juan"], r["cat"]) for r in filled] == [("卷 一", None), ("卷 一", "书"), ("卷 一", "书"), ("卷 一", "跋"), ("卷 一", "跋")]


def test_numbers(spark):
    df = ingest.number_entries(rows(spark, ["1、甲", "续", "3、乙", "2、丙", "尾"]))
    assert [r["entry"] for r in df.orderBy("pos").collect()] == [1, 1, 3, 3, 3]
    got = ingest.consecutive(ingest.number_entries(rows(spark, ["1、", "3、", "2、", "x", "3、"])).withColumn("n", F.col("n").cast("long")))
    assert [r["accepted"] for r in got.orderBy("pos").collect()] == [True, False, True, False, True]


def test_articles_from_rows(spark):
    df = rows(spark, ["前言", "题一", "原", "译", "原二", "译二", "题二", "原"], bold=[False, False, True, False, True, False, False, True])
    opened = ingest.open_articles(df, F.col("text").startswith("题"))
    assert {r["id"] for r in opened.collect()} == {"f-001", "f-002"}
    sides = {(r["id"], r["seg"]): (r["orig"], r["trans"]) for r in ingest.segment_sides(opened.where("NOT text LIKE '题%'")).collect()}
    assert sides == {("f-001", 1): (["原"], ["译"]), ("f-001", 2): (["原二"], ["译二"]), ("f-002", 1): (["原"], [])}


def test_regroup(spark):
    part = articles.PART
    segs = [("甲", "A"), ("乙", "B"), ("丙", None)]
    data = [("x", [(o, t, None, None, None, None, None) for o, t in segs] + [(None, None, None, None, None, 1, "【词】注")] + [(None, None, ["丁", "戊"], ["D"], None, None, None)])]
    got = ingest.regroup(spark.createDataFrame(data, f"id string, segments array<{part}>")).orderBy("group").collect()
    assert [(r["orig"], r["trans"], [(n["term"], n["text"]) for n in r["notes"]]) for r in got] == [(["甲", "乙"], ["A", "B"], []), (["丙"], [], [("词", "注")]), (["丁", "戊"], ["D"], [])]


def test_notes_and_lines(spark):
    df = rows(spark, ["前", "[1]【词】注", "续", "[2] 无词"]).withColumn("id", F.lit("a"))
    assert [(r["n"], r["term"], r["text"]) for r in ingest.parse_notes(df).orderBy("k").collect()] == [(0, None, "前"), (1, "词", "注\n续"), (2, None, "无词")]
    df = rows(spark, ["一、甲", "乙", "小题", "丙", "丁"]).withColumn("id", F.lit("a"))
    got = ingest.merge_lines(df, F.col("text") == "小题", F.col("text").startswith("一、")).orderBy("para").collect()
    assert [r["text"] for r in got] == ["一、甲乙", "小题", "丙丁"]


def test_mixed_and_layout(spark):
    df = spark.createDataFrame([([("黑" * 10, True), ("白" * 10, False)],), ([("黑", True), ("白" * 10, False)],), ([("黑" * 20, True)],)], "runs array<struct<text:string,bold:boolean>>")
    got = [r[0] for r in df.select(ingest.split_mixed("runs")).collect()]
    assert tuple(got[0]) == ("黑" * 10, "白" * 10) and got[1:] == [None, None]
    df = rows(spark, ["古文古文", "这是的的", "古文古文", "因为所以"]).withColumn("id", F.lit("a"))
    assert ingest.interleaved(df).first()["layout"] == "interleaved"


def test_question_articles(spark):
    df = rows(spark, ["问", "答一", "（《书》一）", "答二（《书》二）"], bold=[True, False, False, False]).withColumn("id", F.lit("q"))
    got = ingest.question_articles(df).first()
    assert got["summary"] == "问" and [(s["orig"], s["src"]) for s in got["segments"]] == [("答一", "（《书》一）"), ("答二", "（《书》二）")]


def test_chapters(spark):
    df = rows(spark, ["a", "b", "c"]).withColumn("chap", F.lit(1)).withColumn("sub", F.col("pos") % 2)
    assert {(r["sub"], tuple(r["orig"]), r["with_intro"]) for r in ingest.chapters(df).collect()} == {(0, ("a", "c"), True), (1, ("b",), False)}
