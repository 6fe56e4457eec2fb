"""Containment, title matching, the blocked lexical index, embedding, the vector index and matching blocks, against plain computations."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import alignment, changing, containment, contents, embedding, lexical, linking, matching, pages, retrieval, terms, vectors

# containment


def in_order(short, long):
    rest = iter(long)
    return all(ch in rest for ch in short)


def words(rng, n, letters="abc"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(containment, "SHORT_BLOCK", 7)
    monkeypatch.setattr(containment, "LONG_BLOCK", 5)


def test_names_and_titles_fit(spark, small_blocks):
    rng = random.Random(2)
    names = [(v, w) for v in "xy" for w in words(rng, 40)]
    titles = [(v, w, k) for v in "xy" for k, w in enumerate(words(rng, 40))]
    a, t = spark.createDataFrame(names, "vol string, name string"), spark.createDataFrame(titles, "vol string, title string, ord int")
    least, short = 3, 4
    fits = lambda b, s: b.startswith(s) or s.startswith(b) or b.endswith(s) or (len(s) >= short and b[-1] == s[-1] and in_order(s, b))
    every = {(v, b, k) for v, b in names if len(b) >= least for w, s, k in titles if v == w and fits(b, s)}
    assert {tuple(r) for r in containment.fitting(a, t, least, short, first=False).collect()} == every
    first = {}
    for v, b, k in every:
        first[v, b] = min(k, first.get((v, b), k))
    assert {(r["vol"], r["name"]): r["ord"] for r in containment.fitting(a, t, least, short).collect()} == first
    named = {}
    for v, b in names:
        found = [k for w, s, k in titles if v == w and len(b) >= least and (s.endswith(b) or (b.endswith(s) and len(s) >= least) or (b[-1] == s[-1] and in_order(b, s)))]
        if found:
            named[v, b] = min(found)
    assert {(r["vol"], r["name"]): r["ord"] for r in containment.naming(a, t, least).collect()} == named


def test_containment_of_nothing(spark):
    none_a, none_t = spark.createDataFrame([], "vol string, name string"), spark.createDataFrame([], "vol string, title string, ord int")
    one = spark.createDataFrame([("v", None), ("v", ""), (None, "abcdefg")], "vol string, name string")
    title = spark.createDataFrame([("v", None, 1), ("v", "", 2), ("v", "abcdefg", 3)], "vol string, title string, ord int")
    assert containment.fitting(none_a, none_t, 6, 6).count() == containment.fitting(one, title, 6, 6).count() == containment.naming(one, none_t, 6).count() == 0


def test_joined_rows_grow_with_names_and_titles_alone(spark):
    """Names that begin and end alike: twice as many give twice as many joined rows, not four times."""

    def joined(n):
        a = spark.range(n).select(F.lit("v").alias("vol"), F.concat(F.lit("short of Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("outer"))
        t = spark.range(n).select(F.lit("v").alias("vol"), F.concat(F.lit("of Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("inner"), F.col("id").alias("ord"))
        return containment.whole_in_parts(t, a, 1, True, True).count()

    assert joined(400) == 2 * joined(200) == 400


def test_a_trie_is_walked_within_bounds(monkeypatch):
    """Titles that begin alike and end in numbers: a name reaches few nodes of their trie."""
    trie, names = containment.Trie(), [f"of Customer#{k:09d}" for k in range(0, 4000, 10)]
    for k, name in enumerate(names):
        trie.add(name[:-1], name, k)
    reached = []

    class Counted(list):
        def __getitem__(self, k):
            reached.append(k)
            return super().__getitem__(k)

    trie.children = Counted(trie.children)
    assert [trie.texts[n] for n in trie.within("short of Customer#00000123", True)] == ["of Customer#000001230"]
    assert len(reached) < 60


# titles


def plain_choice(title, maybe, left, aliases, expected, groups_first):
    """(canons, how): the first candidate in the order of the rules whose titles are all still expected."""
    base, rest = [title], title
    while rest.endswith("）") and "（" in rest:
        rest = rest[: rest.rindex("（")]
        base.append(rest)
    base.append(re.sub("（[^）]*）", "", title))
    base += [re.sub("^(附录|附)", "", f) for f in base if f.startswith("附")]
    swap = {"复": "与", "与": "复"}
    forms = [(f, "listed") for f in base] + [(swap[f[0]] + f[1:], "swapped") for f in base if f[:1] in ("复", "与")]
    numeral = lambda n: "一二三四五六七八九十"[n - 1]
    options = []
    for rank, (form, how) in enumerate(forms):
        for alias, canon, members, order in aliases:
            if alias == form:
                options.append((rank, (members > 1) != groups_first, order, how, [canon] if members == 1 else [canon + numeral(k) for k in range(1, members + 1)]))
    bare = re.sub("（[^）]*）", "", title)
    for canon, _, order in expected if maybe and len(bare) >= 6 else ():
        s = re.sub("（[^）]*）", "", canon)
        if len(canon) >= 6 and s and (bare.startswith(s) or s.startswith(bare) or bare.endswith(s) or (s[-1] == bare[-1] and in_order(s, bare))):
            options.append((10**9, False, order, "contained", [canon]))
    for _, _, _, how, canons in sorted(options):
        if all(left.get(c, 0) > 0 for c in canons):
            for c in canons:
                left[c] -= 1
            return canons, how
    return None, None


@pytest.mark.parametrize("groups_first", [False, True])
def test_titles_are_used_up_as_by_a_plain_loop(spark, groups_first):
    rng = random.Random(6)
    heads, middles, tails = ["复", "与", "附", "附录", ""], ["某甲居士书", "净土决疑论序", "某寺大殿碑记", "南山莲社缘起序"], ["", "（一）", "（三）", "（附）", "（二）（民国）", "二"]
    make = lambda: rng.choice(heads) + rng.choice(middles) + rng.choice(tails)
    toc = [(f, k, make()) for f in range(6) for k in range(12)]
    rows = [(f, k, make() if rng.random() < 0.7 else "一句普通的话，不是题。", rng.random() < 0.5) for f in range(6) for k in range(40)]
    expected, aliases = contents.expected_titles(spark.createDataFrame(toc, "file int, pos int, title string"))
    paras = spark.createDataFrame(rows, "file int, pos int, text string, bold boolean")
    flags = {(r["file"], r["pos"]): (r["t"], r["m"]) for r in paras.select("file", "pos", contents.T.norm_title("text").alias("t"), contents.could_be_title("text", "bold").alias("m")).collect()}
    got = {(r["file"], r["pos"]): (r["canons"], r["how"]) for r in contents.parse_articles(paras, expected, aliases, groups_first=F.lit(groups_first)).where("role = 'title'").collect()}
    assert {how for _, how in got.values()} >= {"listed", "swapped", "contained"}
    for f in range(6):
        left = {r["canon"]: r["count"] for r in expected.where(F.col("file") == f).collect()}
        own = [(r["alias"], r["canon"], r["members"], r["ord"]) for r in aliases.where(F.col("file") == f).collect()]
        titles = [(r["canon"], r["count"], r["ord"]) for r in expected.where(F.col("file") == f).collect()]
        for k in range(40):
            title, maybe = flags[f, k]
            want = plain_choice(title, maybe, left, own, titles, groups_first)
            if want[1]:
                assert got[f, k] == want
            else:
                assert got.get((f, k), (None, "guessed")) in ((None, "guessed"), ([], "guessed"))


# lexical index


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(150)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 80, 200])))) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lexical.build(df, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, ["w3", "w20"]), (2, ["w0"]), (3, ["w1 w0", "w40"]), (4, ["W7", "w7"]), (5, ["nowhere"]), (6, None)], "item_id long, terms array<string>")
    whole = lexical.search(spark, str(tmp_path / "i"), asked, top=1000)
    best = lexical.search(spark, str(tmp_path / "i"), asked, top=5)
    rows = lambda found: {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()}
    assert rows(best) == {r for r in rows(whole) if r[1] <= 5} and len(rows(best)) == 20
    one = lexical.Search(lexical.Index(spark, str(tmp_path / "i")), asked, "item_id", "terms", None, 5)
    assert one.opened().count() < one.bounds().count()
    tf = {k: t.split().count("w20") for k, t in docs}
    df20, mean = sum(n > 0 for n in tf.values()), sum(len(t.split()) for _, t in docs) / len(docs)
    k, t = next((k, t) for k, t in docs if tf[k])
    idf = max(math.log((400 - df20 + 0.5) / (df20 + 0.5)), retrieval.LEAST_IDF)
    alone = lexical.search(spark, str(tmp_path / "i"), spark.createDataFrame([(1, ["w20"])], "item_id long, terms array<string>"), top=1000)
    assert abs(alone.where(F.col("doc_id") == k).first()["score"] - idf * tf[k] * 2.2 / (tf[k] + 1.2 * (0.25 + 0.75 * len(t.split()) / mean))) < 1e-5


def test_an_index_of_nothing(spark, tmp_path):
    lexical.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "i"))
    assert lexical.search(spark, str(tmp_path / "i"), spark.createDataFrame([(1, ["a"])], "item_id long, terms array<string>")).count() == 0


# embedding


def test_embedder(spark):
    rows = [(1, "the red fox runs"), (2, "the red fox runs"), (3, "the blue whale"), (4, ""), (5, None), (6, "completely different words here")]
    texts = embedding.with_slots(spark.createDataFrame(rows, "id long, text string"))
    got = {r["id"]: r for r in embedding.Embedder(texts).embed(texts).collect()}
    assert got[4]["vector"] is got[5]["vector"] is None and got[4]["n_features"] == 0 and got[1]["n_features"] == 7
    v = {k: np.array(got[k]["vector"]) for k in (1, 2, 3, 6)}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-12 for x in v.values()) and v[1] @ v[2] > 1 - 1e-12 and v[1] @ v[3] > v[1] @ v[6] - 0.3


def test_models_that_answer_out_of_order_or_fail(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("no answer")
        return [(k, [float(len(t)), k]) for k, t in reversed(list(enumerate(texts))) if t]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bb", "", None, "bad", "c", "dd"])], "id long, text string").coalesce(1)
    got = {r["id"]: (r["vector"], r["error"]) for r in embedding.embed_with(model, df, "id", call=2).collect()}
    assert got == {0: ([1.0, 0.0], None), 1: ([2.0, 1.0], None), 2: (None, None), 3: (None, None), 4: (None, "no answer"), 5: (None, "no answer"), 6: ([2.0, 0.0], None)}


# the vector index


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 300)
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 20))
    x = middles[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 20))
    rows = [("even" if k % 2 == 0 else "odd", k, v.tolist()) for k, v in enumerate(x)] + [("even", 2000, None), ("even", 2001, [0.0] * 20), (None, 2002, x[0].tolist()), ("one", 2003, x[3].tolist())]
    df = spark.createDataFrame(rows, "space string, key long, vector array<double>")
    path = str(tmp_path / "v")
    vectors.build(df, path, top=10)
    asked = df.where("key < 100 AND key % 5 = 0 OR key >= 2000").withColumnRenamed("key", "query")
    found = {}
    for r in vectors.search(spark, path, asked.withColumn("space", F.coalesce("space", F.lit("nowhere"))), top=10).collect():
        found.setdefault(r["query"], {})[r["key"]] = r["score"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for k in range(0, 100, 5):
        own = np.arange(k % 2, 1500, 2)
        exact = own[np.argsort(-np.round(unit[own] @ unit[k], 6), kind="stable")[:10]].tolist()
        hits, total = hits + len(set(exact) & found[k].keys()), total + 10
        assert all(key % 2 == k % 2 and abs(score - unit[key] @ unit[k]) < 2e-6 for key, score in found[k].items()) and len(found[k]) == 10
    assert hits >= 0.95 * total
    assert found[2003] == {2003: 1.0} and 2000 not in found and 2002 not in found
    read = {r["space"]: r for r in vectors.share_scanned(spark, path).collect()}
    assert read["even"]["bytes_read"] < 0.6 * read["even"]["bytes_all"] and set(read) == {"even", "odd", "one"}


def test_a_search_keeps_no_row_for_each_query_and_cell(spark, tmp_path, monkeypatch):
    from textloom import storage

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 20))  # point anywhere, so many cells are opened
    df = spark.createDataFrame([("a", k, v.tolist()) for k, v in enumerate(x)], "space string, key long, vector array<double>")
    path, kept = str(tmp_path / "v"), []
    vectors.build(df, path, top=10)

    def keep(frame, *more):
        out = storage.keep(frame, *more)
        kept.append(out.count())
        return out

    for module in (vectors, retrieval):
        monkeypatch.setattr(module, "keep", keep)
    asked = df.where("key % 4 = 0").withColumnRenamed("key", "query")
    found = {(r["query"], r["key"]) for r in vectors.search(spark, path, asked, top=10).collect()}
    assert spark.read.parquet(f"{path}/books").first()["probes"] > 1 and max(kept) <= 300  # a row for each query and block
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, k) for q in range(0, 1200, 4) for k in np.argsort(-np.round(unit @ unit[q], 6), kind="stable")[:10].tolist()}
    assert len(found) == 3000 and len(found & want) >= 0.95 * len(want)


def test_nearest_within_a_namespace_with_copies(spark, monkeypatch):
    for name, n in (("GROUP", 7), ("SLICE", 3), ("DATA_BLOCK", 40)):
        monkeypatch.setattr(retrieval, name, n)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)).astype(np.float32)[rng.integers(0, 60, 400)]  # about seven copies of each
    rows = [("a" if k % 3 else "b", k, v.tolist()) for k, v in enumerate(x)] + [("a", 900, None), (None, 901, x[0].tolist()), ("one", 902, x[1].tolist())]
    df = spark.createDataFrame(rows, "space string, key long, vector array<float>")
    found = {}
    for r in retrieval.nearest_within(df.where("key % 5 = 0 OR key >= 900").withColumnRenamed("key", "query"), df, top=10).collect():
        found.setdefault(r["query"], []).append((-r["score"], r["key"]))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {902: [(-1.0, 902)]}
    for q in range(0, 400, 5):
        want[q] = sorted((-s, k) for k, s in enumerate(np.round(unit @ unit[q], 6).tolist()) if (k % 3 == 0) == (q % 3 == 0))[:10]
    assert {q: sorted(v) for q, v in found.items()} == want


# matching blocks


def plain_blocks(a, b):
    """The longest common stretch by trying all places, then left and right of it."""
    best = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in [next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))] if n), default=None)
    if best is None:
        return []
    n, i, j = best[0], -best[1], -best[2]
    right = [(x + i + n, y + j + n, m) for x, y, m in plain_blocks(a[i + n :], b[j + n :])]
    return [*plain_blocks(a[:i], b[:j]), (i, j, n), *right]


def test_blocks_against_trying_all_places():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        joined = []
        for i, j, n in plain_blocks(a, b):
            if joined and (joined[-1][0] + joined[-1][2], joined[-1][1] + joined[-1][2]) == (i, j):
                joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
            else:
                joined.append((i, j, n))
        assert matching.blocks(a, b) == matching.blocks(a, b, matching.Automaton(b)) == joined
        made, at = "", 0
        for op, i, i2, j, j2 in matching.changes(a, b):
            assert (op == "insert") == (i == i2) and (op == "delete") == (j == j2)
            made, at = made + a[at:i] + b[j:j2], i2
        assert made + a[at:] == b


def test_long_texts_are_matched_in_time():
    rng = random.Random(8)
    a = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    b = a[:5000] + "X" + a[5000:12_000] + a[12_100:]
    assert matching.changes(a, b) == [("insert", 5000, 5000, 5000, 5001), ("delete", 12_000, 12_100, 12_001, 12_001)]


def test_lines_of_a_quote():
    quote = "thequickbrownfoxjumpsoverthelazydog"
    assert alignment.line_hits(quote, ["thequickbrownfox", "unrelatedline", "jumpsoverthelazydog", "short", "xxthequickbrownfoxyyyyyyyyyyyyyyyyyyyyyyyyy"]) == (len(quote), len(quote), [(0, 0), (16, 2)])


def test_pieces_are_found_by_every_way(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(30)] + [None]
    pieces = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {(p, k, i) for k, t in enumerate(texts) if t for p in pieces for i in range(len(t) - len(p) + 1) if t.startswith(p, i)}
    wanted = spark.createDataFrame([(p,) for p in [*pieces, ""]], "piece string")
    rows = lambda **how: {tuple(r) for r in alignment.find_pieces(wanted, docs, "id", "text", **how).collect()}
    first = {(p, k, min(i for q, j, i in want if q == p and j == k)) for p, k, _ in want}
    assert rows() == want and rows(first=True) == first
    monkeypatch.setattr(alignment, "ONE_BY_ONE", 0)
    assert rows(first=True) == first
    monkeypatch.setattr(alignment, "SENT", 0)
    assert rows() == want and rows(first=True) == first


def test_content_that_two_titles_share_resolves_to_none(spark):
    refs = spark.createDataFrame([(1, "甲", "abcdefghij klm"), (2, "甲", "zz"), (3, "乙", "abc"), (4, "甲", None)], "ref int, name string, quote string")
    titles = spark.createDataFrame([(10, "甲", "xx abcdefghijklm yy"), (11, "甲一", "abc zz"), (12, "甲二", "zz"), (13, "乙", "abcabc")], "id int, title string, body string")
    got = {r["ref"]: r["id"] for r in linking.unique_by_content(refs, titles).collect()}
    assert got == {1: 10, 2: None, 3: 13, 4: None}


# terms


def test_terms_of_a_dictionary(spark, monkeypatch):
    monkeypatch.setattr(terms, "LANE", 7)
    rng = random.Random(13)
    dictionary = sorted({"".join(rng.choice("ab é") for _ in range(rng.randint(1, 5))) for _ in range(40)})
    texts = ["".join(rng.choice("ab éx\0\n") for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "🙂ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(t,) for t in [*dictionary, "", None, dictionary[0]]], "term string")
    want = {(k, d, t.index(d) + 1) for k, t in enumerate(texts) if t for d in dictionary if d in t}
    found = terms.occurrences(docs, known)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    monkeypatch.setattr(terms, "DICTIONARY_CHARS", 25)
    assert {tuple(r) for r in terms.occurrences(docs, known).collect()} == want  # several automata
    spans = terms.marks(found)
    marked = docs.join(spans, "doc_id", "left").select("doc_id", terms.marked(F.col("text"), F.col("spans")).alias("m"))
    by_length = sorted(dictionary, key=lambda d: (-len(d), d))
    plain = docs.select("doc_id", pages.mark_terms(F.col("text"), F.array(*[F.lit(d) for d in by_length])).alias("m"))
    assert {r["doc_id"]: r["m"] for r in marked.collect()} == {r["doc_id"]: r["m"] for r in plain.collect()}
    assert terms.occurrences(docs, known.limit(0)).count() == 0 and terms.occurrences(docs.limit(0), known).count() == 0


# replies as streams


def test_replies_of_broken_lines(spark, tmp_path):
    from textloom.plans.streaming_queries import to_end
    from textloom.streaming import jobs

    body = '{"type":"meta"}\n{"type":"delta","text":"a\\nb"}\nno json {\n[1]\n{"type":"delta"}\n{"type":"delta","text":"é"}\n{"type":"done"}'
    streams = {1: body, 2: body + "\n", 3: body.replace("done", "other"), 4: "", 5: body + '\n{"type":"delta","text":"late"}\n'}
    rows = []
    for k, t in streams.items():
        cut = [t[i : i + 5] for i in range(0, len(t), 5)] + [None]
        rows += [(k, i, p) for i, p in enumerate(cut)] + [(k, 0, cut[0])]  # a piece that comes twice
    rng = random.Random(15)
    rng.shuffle(rows)
    for n in range(3):
        spark.createDataFrame(rows[n::3], "id int, seq int, piece string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def read(policy):
        stream = spark.readStream.schema("id int, seq int, piece string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return {r["id"]: (r["reply"], r["n_deltas"], r["complete"]) for r in to_end(jobs.replies(stream, "id", policy), spark).collect()}

    whole = ("a\nb\né", 2)
    assert read(jobs.BROWSER) == {1: (*whole, True), 2: (*whole, True), 3: (*whole, False), 4: ("", 0, False), 5: (*whole, True)}
    assert read(jobs.CLIENT) == {1: (*whole, False), 2: (*whole, True), 3: (*whole, False), 4: ("", 0, False), 5: (*whole, True)}


def test_what_cannot_be_read_is_kept_apart(spark, tmp_path):
    from textloom.sources import articles

    (tmp_path / "a.json").write_text('{"id":"1","title":"x"}\n{"id":"2","ti\n{"title":"y"}\n', encoding="utf-8")
    (tmp_path / "b.json").write_text("", encoding="utf-8")
    found = articles.scanned(spark, str(tmp_path), "id string, title string, _corrupt_record string")
    assert [r["id"] for r in articles.sound(found).collect()] == ["1"]
    assert {tuple(r) for r in articles.quarantined(found).collect()} == {("a.json", "broken", '{"id":"2","ti'), ("a.json", "no id", None)}
    assert tuple(articles.scan_report(found).first()) == (1, 1, 1)


# an index that changes


def test_a_changing_index_is_as_one_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = random.Random(16)
    text = lambda: " ".join(rng.choice("river stone cloud tree of the a".split()) for _ in range(rng.randint(1, 30)))
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index, live = changing.ChangingIndex(spark, str(tmp_path / "c")), {}
    asked = spark.createDataFrame([(1, ["river stone", "tree"], None), (2, ["cloud"], 3), (3, ["of", "the"], None)], "item_id long, terms array<string>, only long")

    def same():
        lexical.build(make(sorted(live.items())), str(tmp_path / "n"))
        rows = lambda where: [tuple(r) for r in lexical.search(spark, where, asked, only="only").orderBy("item_id", "rank").collect()]
        assert rows(index.opened()) == rows(str(tmp_path / "n"))

    for n in range(6):
        batch = {rng.randrange(30): text() if rng.random() < 0.8 else None for _ in range(15)}
        if n == 0:
            batch = {k: text() for k in range(30)}
        assert index.add(make(list(batch.items())), n)
        live = {k: t for k, t in {**live, **batch}.items() if t is not None}
        if n in (1, 5):
            index.add(make(list(batch.items())), n)  # a batch that is sent again
            same()
    assert not index.add(make([(1, "x")]).drop("text"), 6)
    assert index.report() == {"batches": 7, "failed": 1, "documents": len(live)}
    index.merge()
    assert len(index.segments()) == 1 and index.report()["documents"] == len(live)
    same()
    index.add(make([(1, "river stone")]), 7)
    live[1] = "river stone"
    same()
