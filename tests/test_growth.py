"""What grows with its input must not be held whole: joins of long sides, codes of copies, pieces beyond what is sent, texts of many marks."""

import datetime
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import alignment, changing, chunking, containment, contents, documents, embedding, lexical, linking, matching, retrieval, terms, vectors
from textloom.plans import retrieval_queries, streaming_queries
from textloom.storage import keep, rows_to_python, shuffled
from textloom.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_titles_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(containment, "broadcast_if_small", lambda df, _: shuffled(df))
    names = spark.createDataFrame([(1, "v", "short of one name")], "ref long, vol string, name string")
    titles = spark.createDataFrame([("v", 1, "one name")], "vol string, ord int, title string")
    found = contents.containing_title(names, titles)
    assert [r["canon"] for r in found.collect()] == ["one name"]
    assert "Broadcast" not in plan(found)


def test_only_stretches_of_pieces_leave_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SENT", 3)
    monkeypatch.setattr(alignment, "HELD", 2)
    monkeypatch.setattr(alignment, "ONE_BY_ONE", 1)
    texts = [(1, "abcabcabd"), (2, "xyz" * 50), (3, None), (4, "zab")]
    pieces = ["abc", "abd", "bca", "zz", "zx", "yzxy", "a", "nowhere"]
    docs, wanted = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(p,) for p in pieces], "piece string")
    every = sorted((p, k, i) for k, t in texts if t for p in pieces for i in range(len(t)) if t.startswith(p, i))
    for first in (False, True):
        right = [x for x in every if not first or x[2] == min(i for p, k, i in every if (p, k) == x[:2])]
        assert sorted(tuple(r) for r in alignment.near_pieces(wanted, docs, "k", "t", first).collect()) == right
        assert sorted(tuple(r) for r in alignment.find_pieces(wanted, docs, "k", "t", first).collect()) == right


def test_one_body_holds_the_quote(spark):
    refs = spark.createDataFrame([(1, "a", "quote"), (2, "a", "other"), (3, "b", "quote")], "ref long, name string, quote string")
    bodies = spark.createDataFrame([(1, "a", "quote other"), (2, "a一", "other"), (3, "b", "none")], "id long, title string, body string")
    assert {r["ref"]: r["id"] for r in linking.unique_by_content(refs, bodies).collect()} == {1: 1, 2: None, 3: None}


def test_vectors_beyond_the_sample_are_recalled(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vectors, "SAMPLE", 128)
    x = np.random.default_rng(3).normal(size=(2500, 24))
    x[1000:1300] = x[1000]  # copies
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(x.tolist())], "space string, key long, vector array<double>")
    path = str(tmp_path / "v")
    vectors.build(df, path, top=10)
    asked = [*range(0, 2500, 25)]
    found = {}
    for r in vectors.search(spark, path, df.where("key % 25 = 0").withColumnRenamed("key", "query"), top=10).collect():
        found.setdefault(r["query"], set()).add(r["key"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in asked:
        near = np.lexsort((np.arange(2500), -np.round(unit @ unit[q], 6)))[:10]
        hits += len(found[q] & set(near.tolist()))
    assert hits >= 0.95 * 10 * len(asked)
    row = vectors.share_scanned(spark, path).first()
    assert row["bytes_read"] < row["bytes_all"]


def test_texts_are_measured_once_for_their_block(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 1)
    docs = spark.createDataFrame([(k, "x" * k) for k in range(40)], "k long, t string")
    found = docs.select("k", lexical.blocks(docs, "k", "t").alias("block"))
    blocks = [r["block"] for r in found.orderBy("k").collect()]
    assert blocks == sorted(blocks) and len(set(blocks)) > 30
    assert "length(" not in plan(found).split("lambdafunction", 1)[1]


def test_sections_are_found_from_the_last_row(spark):
    body = "a\u3000b（以上 X）c\n◎ d  e（以上 Y.Z）\n f"
    found = documents.reading_list(spark.createDataFrame([(1, body)], "k long, b string"), "k", "b")
    rows = sorted(tuple(r)[1:] for r in found.collect())
    assert rows == [(0, "X", "a", False), (1, "X", "b", False), (2, "Y·Z", "c", False), (3, "Y·Z", "d", True), (4, "Y·Z", "e", False), (5, "其他", "f", False)]
    assert "currentrow$(), unboundedfollowing$()" not in plan(found)


def test_files_of_pieces_do_not_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(streaming_queries, "FILE_CHARS", 2000, raising=False)
    lines = spark.createDataFrame([(k, "abcdefghij" * 100) for k in range(40)], "doc_id long, body string")
    seen = []
    stream = streaming_queries.pieces_of(lines, spark, 7, 2)
    path = streaming_queries.work_dir(spark)
    put = lambda batch, _: seen.append([r["count"] for r in batch.groupBy(F.input_file_name()).count().collect()])
    stream.writeStream.foreachBatch(put).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    assert sum(map(sum, seen)) == 40 * (143 + 1)
    assert max(map(max, seen)) < 1500
    assert 2 <= len(seen) <= 4


def test_a_dictionary_of_many_letters_is_one_tree_and_marks_hold_no_list(spark):
    words = [chr(0x4E00 + k) + chr(0x4E00 + (7 * k) % 9000) + "x" * (k % 3) for k in range(9000)]
    known = spark.createDataFrame([(w,) for w in words], "term string")
    assert [len(x) for x in terms.dealt(known, "term")] == [9000]
    texts = ["-".join(words[k::500]) + "\0" + words[0] for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = terms.occurrences(docs, known)
    want = {(k, w, t.index(w) + 1) for k, t in enumerate(texts) for w in words if w in t}
    assert {tuple(r) for r in found.collect()} == want
    assert "collect_list" not in plan(terms.marks(found))


def test_places_are_not_shuffled_by_phrase_and_document(spark, tmp_path):
    docs = spark.createDataFrame([(k, "of the river the of the " * (1 + k % 3)) for k in range(300)], "doc_id long, text string")
    lexical.build(docs, str(tmp_path / "i"))
    postings = lexical.read_postings(spark, str(tmp_path / "i"))
    assert postings.schema["places"].dataType.simpleString() == "array<int>"
    phrases = spark.createDataFrame([("of the", ["of", "the"]), ("the of the", ["the", "of", "the"]), ("of of", ["of", "of"])], "name string, tokens array<string>")
    found = lexical.phrase_entries(postings, phrases)
    assert "Generate explode(arrays_zip" not in plan(found) and "collect_list" not in plan(found)
    tf = {(r["name"], k): n for r in found.collect() for k, n in zip(r["keys"], r["tfs"], strict=True)}
    assert len(tf) == 600 and all(tf["of the", k] == 2 * (1 + k % 3) and tf["the of the", k] == 1 + 2 * (k % 3) for k in range(300))


def test_postings_of_dead_documents_go_without_a_row_each(spark, tmp_path):
    index = changing.ChangingIndex(spark, str(tmp_path / "c"))
    index.add(spark.createDataFrame([(k, f"a b{k} a c") for k in range(30)], "doc_id long, text string"), 0)
    index.add(spark.createDataFrame([(k, None if k % 2 else "a d") for k in range(0, 30, 3)], "doc_id long, text string"), 1)
    view = index.opened()
    rows = view.live(view._read("postings", ["block"]).drop("batch"))
    assert "collect_list" not in plan(rows)
    got = {}
    for r in rows.collect():
        assert r["n"] == len(r["keys"]) == len(r["tfs"]) == len(r["lens"]) and len(r["places"]) == sum(r["tfs"]) and r["most"] == max(r["tfs"])
        got.setdefault(r["token"], set()).update(r["keys"])
    assert got["a"] == {k for k in range(30) if k % 3 or not k % 2} and got["c"] == {k for k in range(30) if k % 3} and got["d"] == set(range(0, 30, 6)) and "b3" not in got


def test_pairs_of_blocks_reach_python_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "DATA_BLOCK", 8)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    rows = []
    monkeypatch.setattr(retrieval, "keep", lambda df: rows.append(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or keep(df), raising=False)
    x = np.random.default_rng(5).integers(-2, 3, (60, 3)).astype(float)  # many ties, some without a direction
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {}
    for r in retrieval.knn(df.where("vec_id % 5 = 0"), df, top=7).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["vec_id"])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    assert got == {q: np.lexsort((np.arange(60), -np.round(unit @ unit[q], 6)))[:7].tolist() for q in range(0, 60, 5)}
    assert rows == ["1"]


def test_few_texts_at_a_time_are_cut_to_chunks(spark, monkeypatch, tmp_path):
    rows = []
    monkeypatch.setattr(retrieval_queries, "keep", lambda df: rows.append(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or keep(df))
    spark.createDataFrame([(k, f"a text of some words {k}.") for k in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert retrieval_queries.embedded_chunks(spark, str(tmp_path)).count() == 9
    assert rows == [str(chunking.TEXTS)]


def test_scores_are_added_up_where_a_block_lies(spark, tmp_path):
    texts = [(k, " ".join(f"w{k * j % 7}" for j in range(1, 3 + k % 5))) for k in range(60)] + [(60, None), (61, ""), (62, "... "), (63, "般若波羅 Ab٣ ǅ")]
    lexical.build(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, ["w0", "w1"]), (2, ["w3 w6"]), (3, ["若波", "w2"])], "item_id long, terms array<string>")
    search = lambda top: lexical.Search(lexical.Index(spark, str(tmp_path / "i")), asked, "item_id", "terms", None, top)
    some = search(3)
    scores = some.scores(some.bounds().select("item_id", "block"))
    assert "Generate" not in plan(scores)  # no row for each term and document is shuffled
    every = sorted(((r["item_id"], -r["score"], r["doc_id"]) for r in scores.collect()))
    assert {r[2] for r in every if r[0] == 1} == {k for k, t in texts if t and {"w0", "w1"} & set(t.split())} and [r[2] for r in every if r[0] == 3 and r[2] > 59] == [63]
    with rows_to_python(spark, 1):  # blocks go on from batch to batch
        assert sorted(((r["item_id"], -r["score"], r["doc_id"]) for r in some.scores(some.bounds().select("item_id", "block")).collect())) == every
    first = [r for i in (1, 2, 3) for r in [x for x in every if x[0] == i][:3]]
    assert sorted((r["item_id"], -r["score"], r["doc_id"]) for r in some.found().collect()) == first


def test_tokens_as_one_text(spark):
    texts = ["", None, " ,", "One  two_three İ ΣΑΣ", "般若 a般b x", "⺀ 〇 々", "٣ ½ é é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.bigrams("t").alias("a"), T.spaced("t").alias("b"))
    assert all(r["b"] == " ".join(r["a"]) for r in df.collect())


def test_sentences_are_cut_without_steps_back(spark):
    texts = ["", None, "\x1fOne! \x1cTwo…？”） three\n\nfour\x1c\n。。”five's.six", "a.b!」x」。", "……？\n!?", " 　七 。\x85八", "x" * 3000, "”one”? two"]
    space = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    units = lambda t: [s.strip(space) for s in re.findall("[^。！？!?…\n]*[。！？!?…][」』）)】》”’]*|[^。！？!?…\n]+", t or "") if re.search("[一-鿿A-Za-z0-9]", s)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.sentences("t").alias("s"))
    assert all(r["s"] == units(r["t"]) for r in df.collect())
    assert "regexp_extract_all" not in plan(df)


def test_a_name_is_looked_up_once(spark, monkeypatch):
    seen, resolve = [], linking.resolve
    monkeypatch.setattr(linking, "resolve", lambda refs, titles: seen.append((refs.count(), titles.count())) or resolve(refs, titles))
    refs = [(k, *[("复一个名字", "a", "b"), ("other title其三", "b", "a"), ("alone", "x", None), (None, "a", "b"), ("twice", "x", "a"), ("nothing", "a", "b")][k % 6]) for k in range(60)]
    titles = [("a", 3 + k, "与一个名字", 10 + k) for k in range(20)] + [("b", 2, "复一个名字", 2), ("a", 1, "other title", 3), ("c", 1, "alone（注）", 4), ("c", 1, "alone", 4), ("c", 2, "twice", 5), ("d", 2, "twice", 6)]
    found = linking.resolve_names(spark.createDataFrame(refs, "ref long, name string, first string, second string"), spark.createDataFrame(titles, "vol string, ord int, title string, id long"))
    assert sorted((r["ref"], r["id"]) for r in found.collect()) == [(k, [10, 3, 4, None, None, None][k % 6]) for k in range(60)]
    assert seen == [(12, 7)]


def test_streams_keep_groups_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "GROUPS", 2)
    day = lambda n: (datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=5 * n)).isoformat(" ")
    rows = [(k, None if k % 7 == 0 else (1 << 53) + k % 9, "ab"[k % 2] if k % 5 else None, day(k // 3)) for k in range(240)]
    kind = "event_id long, user_id long, event_type string, ts string"
    for n in range(4):
        spark.createDataFrame(rows[60 * n : 60 * n + 60], kind).selectExpr("event_id", "user_id", "event_type", "ts::timestamp AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(kind.replace("ts string", "ts timestamp")).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(made, name):
        q = made.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 8
        return spark.read.parquet(str(tmp_path / name)).collect()

    seen, nth, wrote, hit = {}, {}, {}, {}
    for e, u, t, ts in rows:
        nth[e] = seen[u, ts[:10]] = seen.get((u, ts[:10]), 0) + 1
        at = datetime.datetime.fromisoformat(ts)
        hit[e] = (u, t) in wrote and (at - wrote[u, t]).total_seconds() < 100_000
        if not hit[e]:
            wrote[u, t] = at
    users = {r[0]: r[1] for r in rows}
    assert {(r["event_id"], r["user_id"], r["nth"], r["accepted"]) for r in run(jobs.quota(source, 2), "quota")} == {(e, users[e], n, n <= 2) for e, n in nth.items()}
    assert {(r["event_id"], r["user_id"], r["hit"]) for r in run(jobs.answer_cache(source, ["user_id", "event_type"], seconds=100_000), "cache")} == {(e, users[e], h) for e, h in hit.items()}


def test_lines_are_searched_and_not_made_automata_of(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for letters in ("ab", "abc ", "般若x") for _ in range(40)]
    pairs = [(a, b) for a in texts[::3] for b in texts[::5]]
    with monkeypatch.context() as m:
        m.setattr(matching, "SEARCHED", -1)
        right = [matching.changes(a, b) for a, b in pairs]
    monkeypatch.setattr(matching, "Automaton", None)
    assert [matching.changes(a, b) for a, b in pairs] == right


def test_features_are_hashed_together(spark):
    texts = ["", None, " .", "one", "One two, two", "x" * 55 + " " + "y" * 56, "é " * 700, "般若波羅 a" + "z" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tokens = {r["id"]: r["t"] for r in df.select("id", T.bigrams("text").alias("t")).collect()}
    features = {k: t + [f"{a} {b}" for a, b in zip(t, t[1:], strict=False)] for k, t in tokens.items()}
    got = embedding.with_slots(df)
    assert "md5" not in plan(got)
    assert {r["id"]: r["slots"] for r in got.collect()} == {k: [int(hashlib.md5(f.encode()).hexdigest()[:8], 16) % embedding.SLOTS for f in x] for k, x in features.items()}


def test_vectors_are_not_shuffled_to_few_queries(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(retrieval, "keep", lambda df: kept.append(plan(df)) or keep(df))
    x = np.random.default_rng(7).integers(-2, 3, (90, 3)).astype(float)  # many ties, some without a direction
    df = spark.createDataFrame([(k, v if k % 9 else None) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 5 = 0")
    first = lambda found: sorted((r["query"], r["rank"], r["vec_id"], r["score"]) for r in found.select("query", "rank", "vec_id", "score").collect())
    right = first(retrieval.knn(asked, df, top=7))
    kept.clear()
    assert first(retrieval.nearest(asked, df, top=7)) == right
    assert "collect_list" not in kept[-1] and "CartesianProduct" not in kept[-1] and "NestedLoop" not in kept[-1]
    with rows_to_python(spark, 2):
        monkeypatch.setattr(retrieval, "DATA_BLOCK", 2)
        assert first(retrieval.nearest(asked, df, top=1)) == [r for r in right if r[1] == 1]
    assert retrieval.nearest(asked.where("vec_id < 0"), df).count() == 0
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)  # more queries than are sent
    assert first(retrieval.nearest(asked, df, top=7)) == right


def test_passages_are_made_for_candidates_alone(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(retrieval, "keep", lambda df: kept.append(plan(df)) or keep(df))
    docs = spark.createDataFrame([(k, f"text {k % 3}") for k in range(30)] + [(30, None), (31, " ")], "doc_id long, text string")
    near = spark.createDataFrame([(1, 1, 4), (1, 2, 30), (1, 3, 31)], "item_id long, rank int, doc_id long")
    words = spark.createDataFrame([(1, 1, 7), (1, 2, 5)], "item_id long, rank int, doc_id long")
    found = retrieval.hybrid(docs, words, near)
    assert [(r["rank"], r["doc_id"], r["passage"]) for r in found.orderBy("rank").collect()] == [(1, 4, "text 1"), (2, 5, "text 2")]
    texts = [p for p in kept if "passage" in p]
    assert len(texts) == 1 and "Filter" not in texts[0].split("LeftSemi")[0]  # no condition on a text's key, which would be met for all documents


def test_replies_hold_a_row_for_a_group_and_serve_both_policies_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "GROUPS", 4)
    body = '{"type":"delta","text":"a"}\n{"type":"delta","text":"é b"}\n{"type":"done"}'
    keys = [*range(60), None]
    texts = {k: body + "\n" * ((k or 0) % 2) if (k or 0) % 5 < 4 else body.replace("done", "other") for k in keys}
    rows = [(k, n, p) for k, t in texts.items() for n, p in enumerate([*(t[i : i + 9] for i in range(0, len(t), 9)), None])]
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 3 == n], "id int, seq int, piece string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, seq int, piece string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        held = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
        return spark.read.parquet(str(tmp_path / name)).collect(), max(held)

    one, held = run(jobs.replies(stream, "id", jobs.CLIENT), "one")
    assert held <= 8
    got, held = run(jobs.replies_by(stream, "id", [jobs.BROWSER, jobs.CLIENT]), "both")
    assert held <= 8
    want = {(k, p): ("a\né b", 2, "done" in t and (p == jobs.BROWSER or t.endswith("\n"))) for k, t in texts.items() for p in (jobs.BROWSER, jobs.CLIENT)}
    assert len(got) == len(want) and {(r["id"], r["policy"]): (r["reply"], r["n_deltas"], r["complete"]) for r in got} == want
    assert {r["id"]: (r["reply"], r["n_deltas"], r["complete"]) for r in one} == {k: v for (k, p), v in want.items() if p == jobs.CLIENT}
