"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import bpe, embedding_dedup, langid, line_dedup, ngram_join, packing, quality_rules, sharding, toxicity, warc
from textloom.llm.common import components

WORDS = "the of and rabbit lamp window seven orange cloud river stone garden paper green walks talks über naïve über-alles it's 12 a1".split()
DOCS = "doc_id long, text string, lang string, n long, rejected string, score string, word_chars string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [sentence(rng, rng.randint(1, 80)) for _ in range(60)]
    out += [out[0], out[0], out[1].upper(), "", None, "   \n\t ", "one two", "one two", "###", "<|endoftext|> x <|startoftext|>"]
    base = sentence(rng, 300).split()
    for k in range(12):  # near copies
        w = list(base)
        w[5 * k] = "changed"
        out.append(" ".join(w))
    out.append("\n".join(sentence(rng, 50) for _ in range(400)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", None, "clash", "clash", None) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (3, texts[3], "en", 1, "clash", None, None), (None, texts[2], None, 1, None, None, None)], DOCS)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(rng.randint(5000, 5400), rng.randint(5000, 5400)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in got for b in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_agrees_with_the_library(texts):
    reference = Tokenizer.from_file(bpe.default_path())
    reference.no_truncation()
    reference.no_padding()
    own = bpe.Codec()
    rng = random.Random(9)
    letters = "aAbBzéÉΣσ'sdlmtrev 0½²<|>\n\t\x1c\x85　日한́‍🙂İẞǅ#-_."
    noise = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x" * 5000]
    everything = [t or "" for t in texts] + noise
    for text, packed in zip(everything, own.encode_many(everything), strict=True):
        ids = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_bpe_memory_is_bounded():
    memo = bpe.Memo(lambda s: s.upper(), 3)
    assert [memo[c] for c in "abcdabcde" * 3] == list("ABCDABCDE" * 3)
    assert len(memo) <= 3 and len(memo.older) <= 3


def test_word_table_starts_anew_when_full(texts, monkeypatch):
    own = bpe.Codec()
    many = [t for t in texts if t]
    want = [own.encode_bytes(t) for t in many]
    monkeypatch.setattr(bpe.WordTable, "MOST", 30)
    monkeypatch.setattr(bpe.WordTable, "BLOCK", 3000)
    for _ in range(3):
        assert own.encode_many(many) == want
    monkeypatch.setattr(bpe.WordTable, "SLOTS", 1 << 20)
    assert own.encode_many([]) == []


def test_all_pieces_go_through_the_queue(texts, monkeypatch):
    """Every different piece of the texts is merged by the queue, whatever its length, and its entries are skipped when stale."""
    seen, stale = [], []
    real_merge, real_pop = bpe.Codec._merge, bpe.heappop
    monkeypatch.setattr(bpe.Codec, "_merge", lambda self, piece: seen.append(piece) or real_merge(self, piece))
    monkeypatch.setattr(bpe, "heappop", lambda queue: stale.append(1) or real_pop(queue))
    own = bpe.Codec()
    own.encode_many([t or "" for t in texts])
    every = {p for t in texts for w in own.tokens(t or "") for p in own.pieces.findall(w) if not own.any_special.search(t or "")}
    assert every <= set(seen) and len(seen) == len(set(seen)) and len(stale) > len(every)


def test_words_of_one_hash_keep_their_own_ids():
    """A Thue-Morse word and its complement meet in every polynomial hash modulo a power of two."""
    own, word = bpe.Codec(), "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        many = [word, other, f"{other} x {word}", word]
        for _ in range(2):
            assert own.encode_many(many) == [own.encode_bytes(t) for t in many]
    assert own.words.odd


def test_bpe_digests(spark, docs, texts):
    got = bpe.digests(docs).collect()
    assert len(got) == len(texts) + 2
    own = bpe.codec()
    for r in got:
        if r["doc_id"] is not None:
            ids = own.encode(texts[r["doc_id"]] or "")
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(own.decode(ids).encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0
    assert bpe.tokens(docs).where("size(token_ids) > 0").count() > 60


def test_packing_places_every_token_once(docs, texts):
    got = packing.pack(docs).collect()
    own = bpe.codec()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            ids = np.array([*own.encode(texts[r["doc_id"]] or ""), 1], "<u4")[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 4096 * r["piece"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len({(r["doc_id"], r["piece"]) for r in got}) == sum(-(-(len(own.encode(t or "")) + 1) // 4096) for t in texts) + 1
    assert len(sequences) <= -(-total // 4096) + 1
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_uses_each_length_exactly(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 400)))
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    runs, rests = packing.plan(histogram, capacity)
    used = {}
    for pattern, k in runs:
        assert sum(n * m for n, m in pattern.items()) <= capacity and k > 0
        for n, m in pattern.items():
            used[n] = used.get(n, 0) + k * m
    assert used == histogram
    assert rests["sequences"] == sum(k for _, k in runs) <= 1.05 * rests["program"] + 3
    assert rests["bound"] <= rests["program"] + 1e-6 and rests["by_pattern"] <= rests["pieces"] == len(lengths)


def test_packing_program_places_nearly_all():
    """Lengths like those of documents: the patterns of the solved program place them, best fit only what rounding leaves."""
    rng = np.random.default_rng(4)
    lengths = np.minimum(4096, rng.lognormal(6.3, 1.0, 12000).astype(int) + 1)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    _, rests = packing.plan(histogram)
    assert rests["program"] <= (1 + packing.GAP) * rests["bound"] and rests["by_pattern"] >= 0.9 * rests["pieces"]
    assert rests["sequences"] <= 1.002 * -(-int(lengths.sum()) // 4096) + 2


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(2, 12, 4))
        values, limits = rng.random(len(lengths)), rng.integers(1, 5, len(lengths))
        best = [0.0] * 31
        for n, v, m in zip(lengths.tolist(), values.tolist(), limits.tolist(), strict=True):
            best = [max(j * v + best[c - j * n] for j in range(m + 1) if j * n <= c) for c in range(31)]
        pattern, worth = packing.price_pattern(lengths, values, limits, 30)
        assert abs(worth - best[30]) < 1e-9 and abs(sum(m * values[k] for k, m in pattern.items()) - worth) < 1e-9
        assert all(m <= limits[k] for k, m in pattern.items()) and sum(m * int(lengths[k]) for k, m in pattern.items()) <= 30


def brute_links(texts):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    return [[j for j in range(len(sets)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(sets))]


def closure(links):
    least = list(range(len(links)))
    for _ in links:
        for i, near in enumerate(links):
            for j in near:
                least[i] = least[j] = min(least[i], least[j])
    return least


@pytest.mark.parametrize(("block", "members"), [(ngram_join.BLOCK, ngram_join.MEMBERS), (600, 256), (1 << 20, 3)])
def test_ngram_join_is_brute_force(spark, texts, block, members, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # small blocks split the near copies over several tasks
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n string")
    links = brute_links(texts)
    least = closure(links)
    got = {r["doc_id"]: r for r in ngram_join.join_similar(df).collect()}
    assert len(got) == len(texts)
    for k in got:
        assert (got[k]["n_links"], got[k]["class_id"], got[k]["kept"]) == (len(links[k]), least[k], least[k] == k), texts[k]


def test_ngram_join_edges(spark, docs):
    assert ngram_join.join_similar(docs.limit(0)).count() == 0
    got = ngram_join.join_similar(docs)
    assert got.count() == docs.count() and got.where("doc_id IS NULL").first()["kept"]
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** ngram_join.bands_for() >= ngram_join.RECALL


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(9)
    x, y, z, w = (sentence(rng, 60) for _ in range(4))
    rows = [(2, x), (5, x), (5, y), (7, f"{y} end"), (9, z), (9, z), (None, w), (None, w), (None, x), (11, None), (11, None), (12, ""), (13, f"{z} a1")]
    df = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, node string")
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect()), key=str)
    assert got == sorted([(2, x), (5, y), (9, z), (None, w), (11, None), (11, None), (12, "")], key=str)
    assert ngram_join.keep_one(df).columns == df.columns and ngram_join.keep_one(df.limit(0)).count() == 0
    plain = df.where("doc_id in (2, 7, 12)")
    assert ngram_join.keep_one(plain).count() == 3


def dropped(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["n_dropped_lines"]) for r in line_dedup.dedup_lines(df).collect()}


def test_line_dedup(spark):
    boiler = "All rights reserved by the owner of site %d today"
    rows = [
        (1, f"own line of doc one here\n{boiler % 5}\nThe end.", "x"),
        (2, f"{boiler % 77}\nanother line that only two has", "x"),
        (3, "one line alone\n\nbefore", "x"),
        (4, f"before it\n\n{boiler % 8}\n{boiler % 9}\nafter", None),
        (5, None, None),
        (6, "", None),
        (None, boiler % 5, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_dropped_lines string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_dropped_lines"] == 0  # the first keeps its lines
    assert got[2]["text"] == "another line that only two has" and got[2]["n_dropped_lines"] == 1
    assert got[3]["text"] == rows[2][1] and got[4]["text"] == "before it\n\nafter" and got[4]["n_dropped_lines"] == 2
    assert got[5]["text"] is None and got[6]["text"] == "" and got[None]["text"] == boiler % 5
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_boilerplate_that_is_short(spark):
    rng = random.Random(3)
    line, own = "All rights reserved.", lambda: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('klmn')}{rng.choice('aeiou')}{rng.choice('rst')}" for _ in range(rng.randint(2, 4)))
    assert sum(n for _, n in dropped(spark, [(k, line) for k in range(40)]).values()) == 39  # all there is
    assert sum(n for _, n in dropped(spark, [(k, f"{own()}\n{line}") for k in range(40)]).values()) == 39
    assert sum(n for _, n in dropped(spark, [(k, line) for k in range(9)]).values()) == 8


def test_line_dedup_of_two_fields_and_two_templates_in_a_leaf(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    fields = [(k, f"please contact {name()} at our main office in {name()} before the end of the current month to renew") for k in range(60)]
    assert sum(n for _, n in dropped(spark, fields).values()) == 59
    kinds = ["order from {} was shipped to the depot", "order from {} was cancelled by our clerk"]
    assert sum(n for _, n in dropped(spark, [(k, kinds[k % 2].format(name())) for k in range(60)]).values()) == 58


def test_line_dedup_variable_fields_and_short_lines(spark):
    rng = random.Random(8)
    names, days, parts = "Anna Boris Clara Dmitri Eva Farid Grace".split(), "Monday Tuesday Friday Sunday".split(), "News Sports Culture".split()
    rows = []
    for k in range(40):
        lines = [f"{sentence(rng, 7)} {k}", f"Posted by {rng.choice(names)} on {rng.choice(days)} in {rng.choice(parts)}", "Share this article", "   ", *[sentence(rng, rng.randint(2, 4)) for _ in range(12)], "the of"]
        rows.append((k, "\n".join(lines), "clash", "clash"))
    rows += [(2, rows[2][1], "again", "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __drop string, f string")
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == 41 and all(r["__drop"] in ("clash", "again") for r in got)
    for r in got:
        own = r["text"].split("\n")
        assert any(x.startswith("Posted by") for x in own) == ("Share this article" in own) == (r["doc_id"] == 0)
        assert "   " in own


def test_line_dedup_leaves_what_meets_by_chance(spark):
    """Short lines of a few common words recur in prose; few are lost, whatever they are made of."""
    rng = random.Random(12)
    words = ["the", "of", "and", "a", "to", "in", "he", "was", "it", "that"] * 6 + [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    rows = [(k, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(30))) for k in range(80)]
    lines = sum(len(t.split("\n")) for _, t in rows)
    assert sum(n for _, n in dropped(spark, rows).values()) < 0.01 * lines


def test_line_dedup_of_a_very_long_text(spark):
    lines = [f"a line of its own called {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)} here" for k in range(80_000)]
    df = spark.createDataFrame([(1, "\n".join(lines[:40_000])), (2, "\n".join(lines) + "\nlast")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1]["n_dropped_lines"] == 0 and got[2]["n_dropped_lines"] == 40_000
    assert got[2]["text"].split("\n") == [*lines[40_000:], "last"] and time.time() - began < 60


def test_quality_rules(spark, docs, texts):
    import re

    got = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect() if r["doc_id"] is not None}
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[k]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.ledger(docs.limit(0)).count() == 0


def test_repeat_words_overlap(spark):
    body = "a b c d e f g a b c d e f z a b c d e"
    df = spark.createDataFrame([(1, body), (2, "x " * 50), (3, "a b c d e")], "doc_id int, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.ledger(df).collect()} == {1: 6 + 6 + 5, 2: 50, 3: 0}


def test_policies_and_ablation(spark, docs):
    ledger = quality_rules.ledger(docs).cache()
    rows = {r["rule"]: r for r in quality_rules.ablation(ledger, "v1").collect()}
    kept = ledger.where("kept").count()
    for rule, r in rows.items():
        bit = 1 << quality_rules.RULES[rule][0]
        assert r["n_failed"] == ledger.where(f"fail_bits & {bit} <> 0").count()
        assert r["n_kept_without"] == kept + r["n_failed_alone"]


def test_sharding(spark, docs):
    for shards, size in ((["a"], 7), (["a", "b", "c"], 13), ([f"s{k}" for k in range(10)], 1009)):
        owners = sharding.lookup_table(shards, size)
        counts = np.bincount(owners, minlength=len(shards))
        assert len(owners) == size and counts.max() - counts.min() <= 1
    before, after = (sharding.lookup_table([f"s{k}" for k in range(n)], 1009) for n in (10, 9))
    moved = sum(a != b for a, b in zip(before, after, strict=True))
    assert moved < 1009 * 0.25  # a tenth must move
    placed = sharding.place(docs)
    owners = sharding.lookup_table(sharding.SHARDS)
    for r in placed.collect():
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % len(owners)
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[owners[slot]])
    assert placed.count() == docs.count() and sharding.place(docs.limit(0)).count() == 0
    assert sharding.shard_sizes(placed).agg(F.sum("n_rows")).first()[0] == docs.count()
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])


def test_language_id(spark):
    rng = random.Random(4)
    vocabulary = {"en": "the and with other house think that".split(), "de": "der und nicht schön über eine häuser".split(), "fr": "le est très où élève garçon qui".split()}
    rows = [(k, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(3, 60))), lang, "x", "y") for k in range(600) for lang in [rng.choice(list(vocabulary))]]
    rows += [(9001, None, "en", "x", "y"), (9002, "12 %% ..", "en", "x", "y"), (9003, "", None, None, None), (9004, "日本語 中文 汉字", None, None, None), (None, "the house", "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, rejected string")
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    held = [r for r in got.values() if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items() if k is not None)
    assert [got[k]["lang_pred"] for k in (9001, 9002, 9003)] == ["und"] * 3 and got[9001]["rejected"]
    assert got[9004]["lang_pred"] in vocabulary and got[9004]["rejected"] and not got[0]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = langid.identify(df, langid.fit(df.limit(0))).select("lang_pred").distinct().collect()
    assert [r[0] for r in empty] == ["und"] and langid.identify(df.limit(0), model).count() == 0


def test_trigrams_ignore_block_edges(monkeypatch):
    text = " ".join(WORDS * 20)
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.trigrams(text) == whole).all()


def test_toxicity(spark):
    rng = random.Random(8)
    bad = "idiot moron scum trash".split()
    rows, labels = [], []
    for k in range(500):
        words = sentence(rng, rng.randint(20, 80)).split()
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((k, " ".join(words), "x", None))
        if k < 400:
            labels.append((k, 1, int(toxic) if rng.random() > 0.03 else 1 - int(toxic)))
    rows += [(900, None, None, None), (901, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string, rejected string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, table)).collect()}
    truth = {k: any(b in t.split() for b in bad) for k, t, _, _ in rows if t is not None}
    later = [k for k in range(400, 500)]
    assert np.mean([got[k]["rejected"] == truth[k] for k in later]) > 0.95
    assert got[900]["p_toxic"] == 0 and not got[901]["rejected"] and len(got) == len(rows)
    none = toxicity.score(docs, toxicity.fit(docs, table.limit(0)))
    assert none.where("rejected").count() == 0 and toxicity.score(docs.limit(0), toxicity.fit(docs, table)).count() == 0


def test_warc_round_trip(spark):
    fake = "x\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\ny"
    rows = [(1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "http://d\r\nX: y", ""), (5, "http://e", fake), (6, "http://f", "ü日\n" * 300), (7, "http://g", "<p>one</p>"), (8, "", fake), (None, "n", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.archive(pages).collect()}
    assert set(got) == {r[0] for r in rows}
    assert all(r["sound"] for r in got.values())
    import base64

    for k, _, html in rows:
        data = (html or "").encode()
        assert got[k]["payload_bytes"] == len(data) and got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("revisit", 8), 8: ("response", None), 6: ("response", None), None: ("response", None),
    }
    assert warc.archive(pages.limit(0)).count() == 0
    apart = {r["page_id"]: r["record_type"] for r in warc.archive(pages, min_bytes=1).collect()}
    assert apart[3] == apart[4] == "response" and apart[1] == "revisit"


def test_warc_is_read_by_byte_ranges(spark, tmp_path):
    """Ranges of a few hundred bytes begin anywhere: within the magic, headers and payloads that hold the magic."""
    rng = random.Random(6)
    rows = [(k, f"http://{k}", "".join(rng.choice(["WARC/1.0\r\n", "\r\n\r\n", "text ", "WARC/1.0\r\nContent-Length: 5\r\n\r\n"]) for _ in range(rng.randint(0, 200)))) for k in range(60)]
    path = str(tmp_path / "a")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, records_per_file=40)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for size in ("100000000", "777", "10001"):
            spark.conf.set(name, size)
            got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
            assert len(got) == 60 and all(r["sound"] for r in got.values())
            import base64

            for k, _, html in rows:
                assert got[k]["payload_bytes"] == len(html.encode()) and got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    finally:
        spark.conf.set(name, before)
    assert warc.damage(spark, path).count() == 0


def test_warc_damage_is_told(spark, tmp_path):
    path = tmp_path / "a"
    warc.write(spark.createDataFrame([(k, f"http://{k}", f"page {k} " * 50) for k in range(40)], "page_id long, url string, html string").coalesce(1), str(path), records_per_file=1000)
    file = next(path.glob("part-*"))
    whole = file.read_bytes()
    for crc in path.glob(".*.crc"):
        crc.unlink()
    at = whole.index(b"Content-Length: ", 9 * len(whole) // 40) + len(b"Content-Length: ")
    file.write_bytes(whole[:at] + b"7" + whole[at + 1 :])
    with pytest.raises(warc.DamagedArchive, match="records end at byte"):
        warc.read(spark, str(path))
    told = warc.damage(spark, str(path)).first()
    some = warc.read(spark, str(path), strict=False)
    assert 0 < told["read_to"] != told["size"] == len(whole) and 5 < some.count() < 15 and some.where("sound").count() >= some.count() - 1
    for other in (whole[:-7], whole + b"more", b"no record at all", b"x" + whole):
        file.write_bytes(other)
        with pytest.raises(warc.DamagedArchive):
            warc.read(spark, str(path))
    file.write_bytes(whole)
    assert warc.read(spark, str(path)).count() == 40


def test_warc_long_chain(spark):
    jumps = spark.createDataFrame([("f", 10 * k, 10 * k + 10) for k in range(700)] + [("f", 10 * k + 5, 10 * k + 35) for k in range(50)], "file string, off long, next long")
    assert warc.reachable(jumps).where("off % 10 = 5").count() == 0
    assert warc.reachable(jumps).count() == 701  # and the end of the file


def brute_vectors(rows, cosine=0.98):
    links = []
    for i, (_, v, label) in enumerate(rows):
        near = []
        for j, (_, w, other) in enumerate(rows):
            if i != j and label is not None and label == other and v and w and len(v) == len(w) and None not in v and None not in w:
                a, b = np.array(v, float), np.array(w, float)
                if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any() and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    near.append(j)
        links.append(near)
    return links


@pytest.mark.parametrize(("shard", "part"), [(8192, 16384), (60, 40)])
def test_embedding_links_are_brute_force(spark, shard, part, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", part)
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(25):
        centre = rng.normal(size=16)
        vectors += [centre + rng.normal(size=16) * 0.05 * rng.random() for _ in range(rng.integers(1, 12))]
    blob = rng.normal(size=16)
    vectors += [blob + rng.normal(size=16) * 0.06 for _ in range(80)]
    rows = [(k, np.float32(v).tolist(), k % 2) for k, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [None] * 16, 0), (n + 5, [float("nan")] * 16, 0), (n + 6, rows[0][1], None), (n + 7, [1.0, 2.0], 0), (n + 8, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("clash"))
    links = brute_vectors(rows)
    least = closure(links)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, shard=shard).collect()}
    assert len(got) == len(rows)
    found, wanted = sum(r["n_links"] for r in got.values()), sum(map(len, links))
    assert 0.99 * wanted <= found <= wanted
    if shard > 60:
        assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (len(links[k]), least[k], least[k] == k) for k in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", [16384, 100])
def test_embedding_links_over_many_cells_are_exact(spark, part, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", part)
    rng = np.random.default_rng(5)
    blob = rng.normal(size=6)
    blob *= np.sqrt(6) / np.linalg.norm(blob)
    # a dense group, wider than the centres' least distance, so that vectors reach more cells than hold them in their graphs
    vectors = [blob + rng.normal(size=6) * 0.3 for _ in range(700)]
    rows = [(k, np.float32(v).tolist(), 0) for k, v in enumerate(vectors)]
    x = np.float64([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    links = [np.flatnonzero(row).tolist() for row in near]
    least = closure(links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, shard=10).collect()}
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (len(links[k]), least[k], least[k] == k) for k, _, _ in rows)


def test_embedding_links_with_thousands_of_labels(spark):
    rng = np.random.default_rng(9)
    rows = []
    for label in range(3000):
        v = rng.normal(size=4)
        rows += [(3 * label + k, (v + rng.normal(size=4) * (0.01 if k else 0)).tolist(), label if label else None) for k in range(2)]
        rows.append((3 * label + 2, (-v).tolist(), label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    links = {}
    for label in range(1, 3000):
        a, b = (np.array(rows[3 * label + k][1]) for k in range(2))
        links[label] = int(a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98)
    assert len(got) == 9000 and all(got[3 * k]["n_links"] == got[3 * k + 1]["n_links"] == n and got[3 * k + 2]["n_links"] == 0 for k, n in links.items())
    assert got[0]["n_links"] == got[1]["n_links"] == 0 and all(got[3 * k + 1]["component_id"] == 3 * k + 1 - n for k, n in links.items())


def test_embedding_recall_is_audited(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 16))
    rows = [(k, np.float32(centre[k % 20] + rng.normal(size=16) * 0.08).tolist(), 0) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = embedding_dedup.linked_nodes(df, "vec_id", "embedding", "label", 0.98, 200)[2]
    told = embedding_dedup.audit(found).first()
    assert told["audited"] > 100 and told["recall"] >= 0.99
    monkeypatch.setattr(embedding_dedup, "LEAST_RECALL", 1.1)
    with pytest.raises(RuntimeError, match="audited links"):
        embedding_dedup.near_duplicates(df)


def test_graph_search_recall():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, medoid = embedding_dedup.build(x)
    q = x[:200]
    ids, _ = embedding_dedup.beam_search(x, graph, np.array([medoid]), q, 48)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids.tolist(), truth.tolist(), strict=True)]) > 0.85
    assert (ids == np.arange(200)[:, None]).any(1).mean() > 0.97
