"""Passages, contexts, marks, pages."""

from pyspark.sql import functions as F

from textloom.operators import pages


def one(spark, column, **row):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]).select(column.alias("v")).first()["v"]


def test_passages_and_contexts(spark):
    rows = [(1, 1, "a", "chunk", "parent", "卷", "题"), (1, 2, "a", "second", "", "卷", ""), (1, 3, "b", "third", None, "", "题")]
    found = pages.passages(spark.createDataFrame(rows, "query int, rank int, aid string, text string, ctx string, vol_name string, title string"))
    assert pages.contexts(found).first()["context"] == "[1] 卷 · 题\nparent\n\n[2] 卷\nsecond\n\n[3] 题\nthird"
    assert sorted((r["aid"], r["rank"]) for r in pages.sources(found).collect()) == [("a", 1), ("b", 3)]


def test_marks_are_not_nested(spark):
    df = spark.createDataFrame([("念佛三昧与念佛人", ["念佛", "念佛三昧", "无"])], "t string, w array<string>")
    assert df.select(pages.mark_terms(F.col("t"), F.col("w"))).first()[0] == "<b>念佛三昧</b>与念佛人"
    df = spark.createDataFrame([("甲乙丙甲", ["丙", "甲", ""])], "t string, w array<string>")
    assert df.select(pages.mark_terms(F.col("t"), F.col("w"))).first()[0] == "<b>甲</b>乙<b>丙</b>甲"


def test_small_ones(spark):
    assert one(spark, pages.accept_rewrite(F.col("q"), F.col("r")), q="a", r=" b ") == "b"
    assert one(spark, pages.accept_rewrite(F.col("q"), F.col("r")), q="a", r="x" * 61) == "a"
    assert one(spark, pages.slice_by_chars(F.col("t"), 3), t="甲 乙　丙丁") == "甲 乙　丙"
    assert one(spark, pages.clean_heading(F.col("t")), t=" 卷一  甲 乙 ") == "卷一 · 甲 乙"
    assert one(spark, pages.first_party(F.col("o"), F.col("r"), ["https://a"]), o="https://b", r="https://a/x") is True
    assert one(spark, pages.first_party(F.col("o"), F.col("r"), ["https://a"]), o="https://b", r="https://abc/x") is False


def rows(spark, texts):
    return spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "file string, pos int, text string")


def test_furniture(spark):
    df = pages.drop_repeated_titles(rows(spark, ["题一", "文", "题一", "文二", "题二", "题一"]), F.col("text").startswith("题"))
    assert [r["text"] for r in df.orderBy("pos").collect()] == ["题一", "文", "文二", "题二", "题一"]
    df = pages.split_headings(rows(spark, ["附", "", "录", "文", "录"]), "附", "录")
    assert [r["text"] for r in df.orderBy("pos").collect()] == ["附录", "", "文", "录"]


def test_notes_and_names(spark):
    notes = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 3, 2, "z")], "id string, k int, n int, text string")
    assert {(r["n"], r["text"], r["duplicates"]) for r in pages.first_notes(notes).collect()} == {(1, "x", 1), (2, "z", 0)}
    refs = spark.createDataFrame([("p", None), ("p", None), ("q", None), ("r", 1)], "name string, id int")
    assert [tuple(r) for r in pages.unresolved(refs).collect()] == [("p", 2), ("q", 1)]


def test_pages(spark):
    df = spark.createDataFrame([("a 1", "<题>", [(["甲[1]"], ["A"])])], "id string, title string, segments array<struct<orig:array<string>,trans:array<string>>>")
    assert pages.body_html(df).first()["html"] == '<h1>&lt;题&gt;</h1><p class="orig">甲<sup>1</sup></p><p class="trans">A</p>'
    assert pages.site_map(df, "https://x").first()["entry"] == "<url><loc>https://x/a/a%201/</loc></url>"
    assert tuple(pages.health(df, df.limit(0)).first()) == (1, 0, False)


def test_pages_are_written_by_parts(spark, tmp_path):
    made = spark.createDataFrame([(f"a{k}", f"<p>\n{k}\t</p>") for k in range(40)], "id string, html string")
    pages.write_pages(made, str(tmp_path / "p"))
    back = spark.read.text(str(tmp_path / "p")).collect()
    assert {tuple(r["value"].split("\t")) for r in back} == {(f"a{k}", f"<p> {k} </p>") for k in range(40)} and len({r["part"] for r in back}) > 5
    assert pages.robots("https://x.org").endswith("Sitemap: https://x.org/sitemap.xml\n")


def test_cleanup_rules(spark):
    df = spark.createDataFrame([("王某译", "增广印光法师文钞", "题（附录于后）"), ("甲、乙译", "印光法师文钞三编卷一", "题"), (None, None, None)], "t string, j string, n string")
    got = [tuple(r) for r in df.select(pages.clean_translator("t"), pages.short_part("j"), pages.nav_title("n")).collect()]
    assert got == [("王某", "增广印光法师文钞", "题"), ("", "卷一", "题"), ("", "", "")]


def test_description_falls_back(spark):
    kind = "id string, summary string, segments array<struct<orig:array<string>,trans:array<string>>>"
    df = spark.createDataFrame([("a", "s" * 200, [(["x"], [])]), ("b", None, [([" [1] "], ["译"]), (["原"], [])]), ("c", "", [])], kind)
    assert {r["id"]: r["description"] for r in pages.description(df, "none").collect()} == {"a": "s" * 149 + "…", "b": "译", "c": "none"}
