"""Exact search, the filter audit and token alignment against brute force, and on odd rows."""

import itertools
import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import filter_audit, token_alignment, topk_search

# exact top-k search


def plain_search(rows, k, every):
    """(query_id, rank, vec_id, score) by whole numbers and sorting."""
    sound = {}
    for name, v in rows:
        if name is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            sound[(name, tuple(math.floor(256 * x) for x in v))] = None
    out = []
    for q, v in sound:
        if q % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), c) for c, w in sound if c != q and len(w) == len(v))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def searched(spark, rows, k=5, every=5, kind="array<float>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    return sorted(tuple(r) for r in topk_search.search(df, k, every).collect())


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", 40)
    monkeypatch.setattr(topk_search, "PART_BYTES", 30 * 8 * 6)
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 7 * 8 * 6)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(5, 6))
    v = (middles[rng.integers(0, 5, 300)] + 0.1 * rng.normal(size=(300, 6))).astype(np.float32)
    v[200:260] = v[200]  # many copies, and so ties
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    assert searched(spark, rows) == plain_search(rows, 5, 5)


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (5, [1.0, 2.0]), (5, None), (10, [None, 1.0]), (15, [float("nan"), 1.0]), (20, [float("inf"), 0.0])]
    rows += [(None, [9.0, 9.0]), (7, [0.0, 0.0]), (25, [0.0, 0.0]), (30, []), (35, []), (40, [1.0, 2.0, 3.0]), (-5, [-1.0, -2.0]), (2**60, [0.001, 0.999])]
    assert searched(spark, rows) == plain_search(rows, 5, 5)
    assert searched(spark, []) == []


def test_search_of_great_numbers(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [1e8, 1e9]), (5, [-1e200, 3.0]), (10, [3e8, 1e8 + 1 / 256]), (11, [3e8, 1e8 + 2 / 256]), (12, [1e308, 0.0]), (15, [2.0**40, 1.0])]
    rows += [(20 + i, [1.0 * i, 2.0**31 + i]) for i in range(9)]
    assert searched(spark, rows, kind="array<double>") == plain_search(rows, 5, 5)


def test_search_ignores_other_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "x"), (1, [2.0], 2, "y")], "vec_id long, embedding array<double>, h1 int, shard string")
    assert [tuple(r) for r in topk_search.search(df).collect()] == [(0, 1, 1, 256 * 512)]


def test_bounds_rule_nodes_out(monkeypatch):
    """In clustered vectors, most leaves are never opened."""
    rng = np.random.default_rng(5)
    middles = np.floor(4000 * rng.normal(size=(40, 8)))
    x = np.repeat(middles, 64, axis=0) + np.floor(20 * rng.normal(size=(2560, 8)))
    opened = []
    real = topk_search.products
    monkeypatch.setattr(topk_search, "products", lambda q, y: opened.append(len(q) * len(y)) or real(q, y))
    names = np.full((len(x), 6), topk_search.NONE)
    names[:, 0] = np.arange(len(x))
    score, name = topk_search.search_part(x, names, x[::50], np.arange(len(x))[::50], np.full(52, -np.inf), 5)
    assert sum(opened) < 0.2 * 52 * len(x)
    exact = (x[::50] @ x.T).astype(np.int64)
    for i in range(52):
        order = sorted((-exact[i, j], j) for j in range(len(x)) if j != 50 * i)[:5]
        assert [(-s, n) for s, n in zip(score[i], name[i], strict=True)] == order


# the filter interaction audit


def plain_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, *m in labels if m[k] == 1 and d is not None} for k in (0, 1))
    seen = []
    for d, t, part in docs:
        t, part = t or "", part or ""
        w = words(t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": d is not None and least.get(t, d) < d,
        }
        seen.append((part, {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, sums = [], Counter()
    for part in {p for p, *_ in seen}:
        rows = [r for r in seen if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                fail = [r for r in rows if x in r[1]]
                sums[part, x] += len(removed)
                out.append((part, order, step, len(left), len(removed), len(fail) - len(removed), sum(r[1] == {x} for r in rows), sum(r[2] for r in removed), sum(r[3] for r in removed)))
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in out)


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.audit(d, m).collect())


def test_audit_equals_walking_all_orders(spark):
    rng = random.Random(4)
    words = ["and", "then", "Some", "UPPER", "a$b", "x", "word", "other", "new", "old"]
    texts = [" ".join(rng.choice(words[: rng.randint(2, 10)]) for _ in range(rng.choice([3, 20, 250]))) for _ in range(25)] + [None, "", "\x0b", " ".join(f"w{i}" for i in range(300))]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for _ in range(120)]
    docs += docs[:7]  # repeated rows
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_little(spark):
    assert audited(spark, [], []) == []
    docs = [(5, "same", "s"), (2, "same", "s"), (2, "same", "s"), (None, "same", "s"), (9, None, "s"), (10, "", "s")]
    assert audited(spark, docs, []) == plain_audit(docs, [])
    assert len(audited(spark, docs, [(2, 1, 1), (2, 0, 0)])) == 600


def test_audit_ignores_clashing_columns(spark):
    d = spark.createDataFrame([(1, "text", "s", 1, 2, "x")], "doc_id long, text string, source string, n int, mask int, part string")
    m = spark.createDataFrame([(1, 1, 0, 5)], "doc_id long, quality int, toxic int, id int")
    assert filter_audit.audit(d, m).count() == 600


# token alignment


def plain_alignment(texts):
    """Rows of digests by whole texts, positions and loops."""
    m = token_alignment.aligner(None)
    a_side, b_side = Tokenizer.from_file(token_alignment.default_paths()[0]), m.b
    a_side.encode_special_tokens = True
    every, counts = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = a_side.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_side.encode(t) if t else []
        if not t or b"".join(m.a_bytes[i] for i in a) != raw or b"".join(m.b_bytes[i] for i in b) != raw:
            every.append(None)
            continue
        owner_a = [k for k, i in enumerate(a) for _ in m.a_bytes[i]]
        owner_b = [k for k, i in enumerate(b) for _ in m.b_bytes[i]]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, ga, gb, at_a, at_b = [], [], [], 0, 0
        for k in range(len(raw)):
            if k + 1 == len(raw) or owner_a[k + 1] != owner_a[k]:
                ga.append(a[owner_a[k]])
                at_a = k + 1
            if k + 1 == len(raw) or owner_b[k + 1] != owner_b[k]:
                gb.append(b[owner_b[k]])
                at_b = k + 1
            if at_a == at_b == k + 1:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        every.append((a, b, links, groups))
        counts.update({(a[i], b[j]) for i, j in links})
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for x in every:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = x
        ns = [(a[i], counts[a[i], b[j]]) for i, j in links]
        out.append((len(a), len(b), len(groups), len(links), sum(n == best[i] for i, n in ns), sum(n for _, n in ns), sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD_TEXTS = [None, "", " ", "  ", "a", "a b", "a  b", " a", "a ", "\n", "a\n b", "a \nb", "\n \n x", "a\n \nb", "a   b", "\t\t a", "x▁y z", "<|endoftext|> <s> <unk> <0x0A>", "naïve façade", "é ́x"]
ODD_TEXTS += ["日本語 の テキスト", "🙂👩‍👩‍👧 ok", "it's we'll I'VE", "12345 678.90 $%&", "\x00 \x01", "a b 　c", "ﬁ ½ Ⅳ", "word " * 300, "  x \x1c y", "don't  stop\r\n\r\n  now", "﻿bom x", "ab" * 5000]


def aligned(spark, texts):
    rows = token_alignment.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r[0])]


def test_alignment_of_odd_texts(spark):
    assert aligned(spark, ODD_TEXTS) == plain_alignment(ODD_TEXTS)


def test_alignment_of_random_texts_in_slices(spark, monkeypatch):
    rng = random.Random(8)
    letters = "aab bc  de\n\t .,é▁日0'́s$ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ODD_TEXTS
    texts += texts[:20]
    want = plain_alignment(texts)
    assert aligned(spark, texts) == want
    monkeypatch.setattr(token_alignment, "SLICE_PAIRS", 100)  # the counts in several broadcasts
    few = texts[:40]
    assert aligned(spark, few) == plain_alignment(few)


def test_alignment_forgets(monkeypatch):
    monkeypatch.setattr(token_alignment.Aligner, "MOST", 10)
    m = token_alignment.Aligner()
    for a in range(0, 200, 20):
        m.number([f"word{i} other" for i in range(a, a + 20)])
        assert m.n == len(m.groups) == len(m.n_a) == len(m.start) - 1 <= 21


def test_token_map(spark):
    df = spark.createDataFrame([(1, "unbelievable things"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in token_alignment.token_map(df).collect()}
    wide = {r["doc_id"]: r for r in token_alignment.token_map(df, products=True).collect()}
    assert list(rows[2])[1:] == [[], [], [], [], [], []]
    narrow, whole = (set(zip(r[1]["link_a"], r[1]["link_b"], strict=True)) for r in (rows, wide))
    assert narrow <= whole
    ends_a, ends_b = rows[1]["group_a"], rows[1]["group_b"]
    assert len(whole) == sum((i - i0) * (j - j0) for i, i0, j, j0 in zip(ends_a, [-1, *ends_a], ends_b, [-1, *ends_b], strict=False))


def test_alignment_ignores_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_a int, t string")
    assert token_alignment.digests(df).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert token_alignment.digests(df).collect()[0]["n_a"] == 2
    assert token_alignment.digests(df.where("false")).collect() == []
    assert token_alignment.pair_counts(token_alignment.linked(df.unionAll(df)), token_alignment.aligner(None).b_ids).agg(F.max("n")).first()[0] == 2


def test_runs_spell_the_text_and_end_at_words():
    m = token_alignment.Aligner()
    for text in [t for t in ODD_TEXTS if t]:
        whole = text + token_alignment.END
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        inside = m.runs(code)
        assert not inside[-1] and [whole[k] for k in np.flatnonzero(~inside[:-1])] == [" "] * int((~inside[:-1]).sum())
        assert all(not whole[k - 1].isspace() and not whole[k + 1].isspace() for k in np.flatnonzero(~inside[:-1]))


def test_another_vocabulary_goes_to_its_library(tmp_path):
    import json

    with open(token_alignment.default_paths()[0], encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][:-1]  # a vocabulary with a token that nothing makes
    own = tmp_path / "v.json"
    own.write_text(json.dumps(spec), encoding="utf-8")
    m = token_alignment.Aligner((str(own), token_alignment.default_paths()[1]))
    text = "It's a test, isn't it?  <|endoftext|>"
    assert m.encode_a([text]) == token_alignment.aligner(None).encode_a([text])
