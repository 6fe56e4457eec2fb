"""Where two tokenizers of one text agree: groups of tokens with common ends, overlapping tokens, and how often ids overlap in a corpus.

Both tokenizers cut the bytes of a text. The ends of all their tokens, united, cut it into elementary intervals, each of which lies in
one token of either side: so each interval is one overlapping pair, found by two searches in sorted ends. Ends that both have
close a group; the products of a group's two sides are its pairs if every token is taken to translate the whole group.

No token of either vocabulary has a space after another character, so a text may be cut before a space between two characters that are no
white space, without a change to its tokens: both tokenizers cut there. What repeats, and so is aligned once and remembered within a
fixed size, is such a run; a text's figures are sums over its runs, and its groups those of its runs one after the other.

Texts are read and encoded once. What a document holds linked is written beside its figures as sorted numbers. Over the corpus, a pair of ids is
counted once for each document that holds it; tasks add up what they find before they shuffle, so that a pair which nearly all documents
hold is one number a task. The counts are then dealt to slices of a fixed number of rows by the first id, each of which is broadcast:
there is one slice unless the vocabularies allow for more pairs.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import WordTable, byte_letters
from textloom.storage import keep

#: Runs, and characters of runs, that a worker remembers; characters of texts that it takes at a time; runs without white space encoded in one call.
RUNS, RUN_CHARS, SLICE_CHARS, TOGETHER = 500_000, 16 << 20, 1 << 20, 64
#: Different pairs that a task adds up before it sends them.
PAIRS_HELD = 1 << 20
#: Rows of a broadcast slice of the counts, of 17 bytes each.
SLICE_PAIRS = 4 << 20
#: What byte-level vocabularies cut a text into before they merge; a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ends each text of a slice; no text can hold it.
END = "\ud800"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Aligner(WordTable):
    """Aligns texts by runs; number() names a text's runs, and arrays by these numbers have what is known of them."""

    MOST, MOST_POINTS = RUNS, RUN_CHARS

    def __init__(self, paths: tuple[str, str] | None = None):
        import sentencepiece

        first, second = paths or default_paths()
        with open(first, encoding="utf-8") as f:
            spec = json.load(f)
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        byte = {letter: b for b, letter in byte_letters().items()}
        entries = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.a_bytes = [self._letters(entries.get(i, ""), byte) for i in range(max(entries) + 1)]
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.encode_a = self._encoder(first, spec)
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_ids, self.b_ids = len(self.a_bytes), len(self.b_bytes)
        # how an id is written within its group, and at the end of its side of it
        self.written = [f"{i}{mark}" for i in range(self.a_ids) for mark in ",|"] + [f"{i}{mark}" for i in range(self.b_ids) for mark in ",;"]
        super().__init__(None)

    @staticmethod
    def _letters(entry: str, byte: dict[str, int]) -> bytes:
        return bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode("utf-8")

    @staticmethod
    def _piece(piece: str) -> bytes:
        return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode("utf-8")

    def _encoder(self, path: str, spec: dict):
        """texts -> ids; special tokens' strings are ordinary text.

        A vocabulary whose merges are in the order of the ids they make, without other steps, is the same as a table of ranks, which is
        encoded several times faster; any other goes to the library that the file is for.
        """
        model, vocab = spec["model"], spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        before = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        first = len(vocab) - len(merges) - sum(t["content"] in vocab for t in spec["added_tokens"])
        if plain and all(vocab.get(a + b) == first + k for k, (a, b) in enumerate(merges)):
            import tiktoken

            special = {t["content"] for t in spec["added_tokens"]}
            ranks = {self.a_bytes[i]: i for t, i in vocab.items() if t not in special}
            encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            return lambda texts: [encode(t) for t in texts]
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task its core
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        whole.no_truncation()
        whole.no_padding()
        return lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]

    def clear(self) -> None:
        super().clear()
        self.sound, self.n_a, self.n_b, self.n_groups = np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(3))
        self.pairs = np.zeros(0, np.int64)  # of run k: from start[k] to start[k + 1]
        self.groups: list[str] = []

    def runs(self, code: np.ndarray) -> np.ndarray:
        """Which characters are in runs: all but the ends of texts and the spaces with other characters than white space on both sides."""
        end = code == ord(END)
        white = self.space[np.minimum(code, 0x3001)] | end
        cut = (code == 0x20) & ~np.roll(white, 1) & ~np.roll(white, -1)  # the last one is an end, so no space is at either edge
        return ~(cut | end)

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, run) numbers of all runs of the texts; what doesn't fit any more is forgotten first."""
        whole = END.join(texts) + END
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        if len(code) > len(self.power):
            self.reach(len(code))
        first, number = self.numbers(whole, code, self.runs(code))
        return np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right"), number

    def encoded(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the first tokenizer, of the second, which runs are sound): a run's ids one after the other, none for those that aren't sound.

        Runs without white space are encoded some at a time with spaces between, where both cut; if the bytes of such a text differ, one by one.
        """
        plain = [r.isprintable() and " " not in r and len(r) > 0 for r in runs]  # no other white space is printable
        texts, held = [], []
        for k, ok in enumerate(plain):
            if ok and held and plain[k - 1] and len(held[-1]) < TOGETHER:
                held[-1].append(k)
            else:
                held.append([k])
        texts = [" ".join([runs[k] for k in ks]) for ks in held]
        spell = lambda side, ids: b"".join(map(side.__getitem__, ids))
        sound = np.ones(len(runs), bool)

        def sides(texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
            return self.encode_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1)

        a, b = sides(texts)
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        raw = (" " + " ".join(texts)).encode("utf-8") if texts else b""
        if spell(self.a_bytes, flat_a) == raw and spell(self.b_bytes, flat_b) == raw and all(map(len, b)):
            # the same bytes in all: the same in each text, as they were cut alike
            if (self.lengths(self.a_size, a, flat_a) == self.lengths(self.b_size, b, flat_b)).all():
                return np.array(flat_a, np.int64), np.array(flat_b, np.int64), sound
        out: list[list[int]] = [[], []]
        for x, y, t, ks in zip(a, b, texts, held, strict=True):
            own = (" " + t).encode("utf-8")
            if spell(self.a_bytes, x) == own and spell(self.b_bytes, y) == own:
                out[0] += x
                out[1] += y
                continue
            for k, x1, y1 in zip(ks, *sides([runs[k] for k in ks]), strict=True):
                own = (" " + runs[k]).encode("utf-8")
                sound[k] = spell(self.a_bytes, x1) == own and spell(self.b_bytes, y1) == own
                if sound[k]:
                    out[0] += x1
                    out[1] += y1
        return np.array(out[0], np.int64), np.array(out[1], np.int64), sound

    @staticmethod
    def lengths(size: np.ndarray, ids: list[list[int]], flat: list[int]) -> np.ndarray:
        """Bytes of each of the texts that have these ids."""
        total = np.concatenate([[0], np.cumsum(size[np.array(flat, np.int64)])])
        return np.diff(total[np.cumsum([0, *map(len, ids)])])

    def learn(self, runs: list[str]) -> None:
        """The next numbers for these runs, and all that is to be known of them."""
        # those without white space side by side, to be encoded together; everything is put back in the order given
        order = np.argsort([not (r.isprintable() and " " not in r) for r in runs], kind="stable")
        back = np.argsort(order, kind="stable")
        runs, given = [runs[k] for k in order.tolist()], runs
        a, b, sound = self.encoded(runs)
        size = np.array([len(r.encode("utf-8")) + 1 for r in runs]) * sound
        ends_a, ends_b, ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(size)
        found = align(ends_a, ends_b)
        stop_a, stop_b = np.searchsorted(ends_a, ends, "right"), np.searchsorted(ends_b, ends, "right")
        codes = np.empty(len(a) + len(b), np.int64)
        codes[found.place_a], codes[found.place_b] = 2 * a + found.last_a, 2 * (self.a_ids + b) + found.last_b
        words = list(map(self.written.__getitem__, codes.tolist()))
        stops = np.concatenate([[0], stop_a + stop_b]).tolist()
        groups = ["".join(words[i:j]) for i, j in zip(stops, stops[1:], strict=False)]
        self.groups += [groups[k] for k in back.tolist()]
        link_stops = np.concatenate([[0], np.searchsorted(found.ends, ends, "right")])
        links, pairs = np.diff(link_stops)[back], a[found.owner_a] * self.b_ids + b[found.owner_b]
        self.pairs = np.concatenate([self.pairs, pairs[spread(link_stops[:-1][back], links)]])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(links)])
        counts = {"sound": sound, "n_a": np.diff(stop_a, prepend=0), "n_b": np.diff(stop_b, prepend=0), "n_groups": np.diff(np.searchsorted(found.shared, ends, "right"), prepend=0)}
        for name, values in counts.items():
            setattr(self, name, np.concatenate([getattr(self, name), values[back]]))
        self.spell(given)

    def links(self) -> np.ndarray:
        return np.diff(self.start)


class align:
    """Two ways of cutting the same bytes, given by the ends of their tokens (ascending, no token is empty).

    ends: of the elementary intervals; owner_a, owner_b: the token of either side that an interval lies in; shared: ends of groups;
    place_a, place_b: a token's place if groups are written one after the other, first side first; last_a, last_b: whether it ends its group.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.ends = np.sort(np.concatenate([a, b]), kind="stable")  # their union: union1d would hash what is sorted already
        self.ends = self.ends[np.diff(self.ends, prepend=0) > 0]
        self.owner_a, self.owner_b = np.searchsorted(a, self.ends), np.searchsorted(b, self.ends)
        self.last_a, self.last_b = np.isin(a, b, assume_unique=True), np.isin(b, a, assume_unique=True)
        self.shared = a[self.last_a]
        self.group_a, self.group_b = np.searchsorted(self.shared, a), np.searchsorted(self.shared, b)
        self.place_a = np.arange(len(a)) + np.searchsorted(self.group_b, self.group_a)
        self.place_b = np.arange(len(b)) + np.searchsorted(self.group_a, self.group_b, "right")

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (token, token) of either side of the same group."""
        n_b = np.bincount(self.group_b, minlength=len(self.shared))
        first_b = np.cumsum(n_b) - n_b
        return np.repeat(np.arange(len(self.group_a)), n_b[self.group_a]), spread(first_b[self.group_a], n_b[self.group_a])


_aligners: dict[tuple[str, str] | None, Aligner] = {}


def aligner(paths: tuple[str, str] | None) -> Aligner:
    """One for each worker process."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(paths)
    return _aligners[paths]


def slices(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    """The texts, some at a time: (place of the first, texts)."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def sound_texts(a: Aligner, texts: list[str], text: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which texts have tokens: none of their runs is cut out of other bytes than the text's."""
    return (np.bincount(text, minlength=len(texts)) > 0) & (np.bincount(text, weights=~a.sound[run], minlength=len(texts)) == 0)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in their order, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def sums(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of the values of each text, whose numbers ascend, in whole numbers."""
    total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    stops = np.searchsorted(text, np.arange(n + 1))
    return total[stops[1:]] - total[stops[:-1]]


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each row.

    pairs: the different linked pairs, a * (ids of the second vocabulary) + b, ascending, as differences of 32 bits; times: how often each is there.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    m = aligner(paths)
    if m.a_ids * m.b_ids >= 1 << 32:
        raise ValueError("pairs of these vocabularies don't fit in 32 bits")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = aligner(paths)
        total = m.a_ids * m.b_ids
        for f in frames:
            for first, texts in slices(f["t"]):
                text, number = m.number(texts)
                sound = sound_texts(m, texts, text, number)
                text, number = text[sound[text]], number[sound[text]]
                n = m.links()[number]
                keys, times = counted(np.repeat(text, n) * total + m.pairs[spread(m.start[number], n)])
                stops = np.searchsorted(keys, np.arange(len(texts) + 1) * total)
                own = keys % total
                steps = np.diff(own, prepend=0)
                steps[stops[:-1][stops[:-1] < len(own)]] = own[stops[:-1][stops[:-1] < len(own)]]  # each text's first pair as it is
                steps, times = steps.astype("<u4").tobytes(), times.astype("<u4").tobytes()
                written, at = list(map(m.groups.__getitem__, number.tolist())), np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
                whole = ["".join(written[i:j])[:-1] for i, j in zip(at, at[1:], strict=False)]
                ranges = [(4 * i, 4 * j) for i, j in zip(stops.tolist(), stops[1:].tolist(), strict=False)]
                figures = {c: sums(text, values[number], len(texts)) for c, values in zip(FIGURES, (m.n_a, m.n_b, m.n_groups, m.links()), strict=False)}
                ids = f["id"].iloc[first : first + len(texts)].to_numpy()
                yield pd.DataFrame({"id": ids} | figures | {"groups_sha256": [sha256(w.encode()).hexdigest() if w else "" for w in whole], "pairs": [steps[i:j] for i, j in ranges], "times": [times[i:j] for i, j in ranges]})

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInPandas(run, schema)


def unpacked(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of all rows, how many each row has)."""
    n = rows.map(len).to_numpy(np.int64) // 4
    steps = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
    total = np.cumsum(steps)
    before = np.concatenate([[0], total])[np.cumsum(n) - n]
    return total - np.repeat(before, n), n


def pair_counts(rows: DataFrame, b_ids: int) -> DataFrame:
    """(a, b, n): how many rows of linked() hold the pair of ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, waiting, waits = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([keys, *[k for k, _ in waiting]])
            order = np.argsort(every, kind="stable")
            n = np.concatenate([[0], np.cumsum(np.concatenate([counts, *[c for _, c in waiting]])[order])])
            out, times = counted(every)
            return out, np.diff(n[np.concatenate([[0], np.cumsum(times)])])

        frame = lambda: pd.DataFrame({"a": (keys // b_ids).astype(np.int32), "b": (keys % b_ids).astype(np.int32), "n": counts})
        for f in frames:
            waiting.append(counted(unpacked(f["pairs"])[0]))
            waits += len(waiting[-1][0])
            if waits > PAIRS_HELD:
                keys, counts = added()
                waiting, waits = [], 0
                if len(keys) > 2 * PAIRS_HELD:
                    yield frame()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = added()
        yield frame()

    return rows.select("pairs").mapInPandas(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def count_slices(pairs: DataFrame) -> list[DataFrame]:
    """(a, b, n, best), sorted by the ids, in slices by a of at most SLICE_PAIRS rows or one id; best: n is the greatest of its a."""
    marked = keep(pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a"))))  # of an id no more rows than the other vocabulary has ids
    sizes = marked.groupBy("a").agg(F.count("*").alias("m")).orderBy("a").toPandas()  # no more rows than a vocabulary has ids
    found, first, held = [], 0, 0
    for a, m in zip(sizes["a"].tolist(), sizes["m"].tolist(), strict=True):
        if held and held + m > SLICE_PAIRS:
            found.append((first, a))
            first, held = a, 0
        held += m
    found.append((first, (1 << 31) - 1))
    return [marked.where((F.col("a") >= x) & (F.col("a") < y)).orderBy("a", "b") for x, y in found]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    A null or empty text has no tokens, and neither has one that either vocabulary can't spell byte for byte: zeros and an empty string.
    Repeated rows are documents each, also for the counts. An empty table gives no rows; other columns aren't read. A very long text is
    one task's work: its tokens are held there as arrays.
    """
    spark, kind, b_ids = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), aligner(paths).b_ids
    rows = keep(linked(docs, id_col, text_col, paths), "zstd")
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, n_best long, count_sum long"

    def with_counts(shared):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, count, best = shared.value
            for f in frames:
                pairs, n = unpacked(f["pairs"])
                times = np.frombuffer(b"".join(f["times"]), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                row = np.repeat(np.arange(len(f)), n)
                values = {"n_best": times * (hit & best[at]), "count_sum": times * np.where(hit, count[at], 0)} if len(keys) else {"n_best": times[:0], "count_sum": times[:0]}
                yield f.assign(**{c: f[c].to_numpy() + sums(row[: len(v)], v, len(f)) for c, v in values.items()})

        return run

    out = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for part in count_slices(pair_counts(rows, b_ids)):
        held = part.toArrow()
        key = held["a"].to_numpy().astype(np.int64) * b_ids + held["b"].to_numpy()
        shared = spark.sparkContext.broadcast((key, held["n"].to_numpy(), held["best"].to_numpy(zero_copy_only=False)))
        out = out.mapInPandas(with_counts(shared), schema)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_map(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, products: bool = False) -> DataFrame:
    """id, a_ids, b_ids, and as arrays the tokens (places from 0) of each link, and the last tokens of each group, of either side.

    With products, links are all pairs of tokens of a group instead of those that overlap, for use where a group is translated as a whole.
    Rows without tokens, as digests tells, have empty arrays.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["a_ids", "b_ids", "link_a", "link_b", "group_a", "group_b"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = aligner(paths)
        for f in frames:
            rows = []
            for t in f["t"]:
                raw = (" " + (t or "")).encode("utf-8")
                a, b = (m.encode_a([" " + t])[0], m.b.encode(t)) if t else ([], [])
                if not t or b"".join([m.a_bytes[i] for i in a]) != raw or b"".join([m.b_bytes[i] for i in b]) != raw:
                    rows.append([[]] * len(names))
                    continue
                found = align(np.cumsum(m.a_size[a]), np.cumsum(m.b_size[b]))
                links = found.products() if products else (found.owner_a, found.owner_b)
                rows.append([a, b, *links, np.flatnonzero(found.last_a), np.flatnonzero(found.last_b)])
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "id", f["id"].to_numpy())
            yield out

    each = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return each.mapInPandas(run, f"id {kind}, " + ", ".join(f"{c} array<int>" for c in names)).withColumnRenamed("id", id_col)
