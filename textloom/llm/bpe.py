"""Byte-pair encoding and decoding with a vocabulary file of the word-end kind (lower case, white space dropped).

Merging keeps the symbols of a word in a doubly linked list and their adjacent pairs in a priority queue by merge rank;
an entry whose symbols have changed since it was pushed is stale and skipped, so a word of n symbols takes O(n log n).
Words repeat, so each worker remembers what it has encoded, up to a fixed number of words.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from textloom.llm.common import batches_in

#: Python's str.split() also splits at these four, which are not white space for the vocabulary's patterns.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACE = regex.compile("[" + re.escape("".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in SEPARATORS)) + "]+")
#: Keys that a worker remembers at a time, in each of two halves; the older half is dropped when the newer one is full.
REMEMBERED = 100_000
TOKENS_REMEMBERED, PIECES_REMEMBERED = 250_000, 150_000
#: A full stop or comma after another mark, which together are one piece.
AFTER_MARK = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,])")
#: Bits for a symbol's place in the queue's numbers: few for all but monstrous pieces, so that the numbers stay small.
SHORT, LONG = 12, 40
#: Bits of an id in a pair's key.
PAIR = 24


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(kept))
    return letters


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class Memo(dict):
    """A bounded memory of a function: a full half becomes the older half, and what is used of it moves back."""

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value


class WordTable:
    """Ids of words, looked up for whole batches of texts at once.

    Words are found, hashed (a polynomial over code points, by prefix sums) and looked up (open addressing) with arrays; only
    words that are not known yet become strings. The hash only names a slot: the code points of every word found are compared with
    those stored there, and a word that differs from its slot's is kept by its string. A full table starts anew.
    """

    SLOTS, MOST, MOST_POINTS, BLOCK = 1 << 20, 400_000, 1 << 24, 1 << 20

    def __init__(self, encode_words):
        self.encode_words = encode_words
        points = np.arange(0x3002)
        self.space = np.array([chr(c).isspace() for c in points.tolist()])
        self.reach(self.BLOCK)
        self.clear()

    def reach(self, n: int) -> None:
        """Powers of the polynomial's base for texts of so many characters."""
        with np.errstate(over="ignore"):
            base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base))])
            self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, inverse))])

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32), 0
        self.start, self.pool = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.spelt, self.points = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.odd: dict[str, int] = {}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the word in each key's slot; -1 if there is none."""
        out, slot = np.full(len(keys), -1, np.int64), (keys >> np.uint64(44)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[slot[left]]
            same = held == keys[left]
            out[left[same]] = self.at[slot[left[same]]]
            left = left[~same & (held != 0)]
            slot[left] = (slot[left] + 1) % self.SLOTS
        return out

    def add(self, keys: np.ndarray) -> None:
        """Slots for new keys, all different, of the words about to be learned in this order."""
        number, slot, left = self.n + np.arange(len(keys)), (keys >> np.uint64(44)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]], self.at[slot[free]] = keys[free], number[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) % self.SLOTS

    def learn(self, words: list[str]) -> None:
        """The next numbers for these words, with their ids and code points."""
        ids = self.encode_words(words)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(b) // 4 for b in ids])])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        self.spell(words)

    def spell(self, words: list[str]) -> None:
        """Remembers how the next words are spelt."""
        self.spelt = np.concatenate([self.spelt, self.spelt[-1] + np.cumsum([len(w) for w in words])])
        self.points = np.concatenate([self.points, np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")])
        self.n += len(words)

    def differing(self, number: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of the words (their code points one after the other in text) that aren't spelt as the numbered words are."""
        long = self.spelt[number + 1] - self.spelt[number] == size
        if not long.all():
            text, size = text[np.repeat(long, size)], size[long]
        own = self.spelt[number[long]] - (np.cumsum(size) - size)
        wrong = np.flatnonzero(text != self.points[np.repeat(own, size) + np.arange(len(text))])
        bad = ~long
        if len(wrong):
            bad[np.flatnonzero(long)[np.searchsorted(np.cumsum(size), wrong, side="right")]] = True
        return np.flatnonzero(bad)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        a = 0
        while a < len(texts):
            b, size = a + 1, len(texts[a]) + 1
            while b < len(texts) and size + len(texts[b]) + 1 <= self.BLOCK:
                size += len(texts[b]) + 1
                b += 1
            out += self.block(texts[a:b]) if size <= self.BLOCK else [b"".join(self.encode_words(texts[a].split()))]
            a = b
        return out

    def hashes(self, code: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (code.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * self.power[: len(code)]
            total = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
            keys = (total[end] - total[first]) * self.back[first] + (end - first).astype(np.uint64)
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return np.maximum(keys ^ (keys >> np.uint64(29)), np.uint64(1))  # 0 marks a free slot

    def numbers(self, whole: str, code: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, number) of each word of a text, whose code points solid tells from what is between words; the last one isn't solid."""
        edge = np.flatnonzero(np.diff(solid, prepend=False))
        first, end = edge[::2], edge[1::2]
        if not len(first):
            return first, first
        word = lambda k: whole[first[k] : end[k]]
        keys = self.hashes(code, first, end)
        number = self.find(keys)
        lost = np.flatnonzero(number < 0)
        if len(lost):
            new, where = np.unique(keys[lost], return_index=True)
            if self.n and (self.n + len(new) > self.MOST or len(self.points) > self.MOST_POINTS):
                self.clear()
                return self.numbers(whole, code, solid)
            self.add(new)
            self.learn([word(k) for k in lost[where].tolist()])
            number[lost] = self.find(keys[lost])
        other = {int(k): word(k) for k in self.differing(number, code[solid], end - first)}
        if other:
            unknown = sorted(set(other.values()) - self.odd.keys())
            self.odd |= {w: self.n + k for k, w in enumerate(unknown)}
            if unknown:
                self.learn(unknown)
            number[list(other)] = [self.odd[w] for w in other.values()]
        return first, number

    def block(self, texts: list[str]) -> list[bytes]:
        whole = "\n".join(texts) + "\n"
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        first, number = self.numbers(whole, code, ~self.space[np.minimum(code, 0x3001)])
        if not len(first):
            return [b""] * len(texts)
        at, size = self.start[number], self.start[number + 1] - self.start[number]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(at - before[:-1], size) + np.arange(before[-1])].astype("<u4").tobytes()
        stops = np.cumsum([len(t) + 1 for t in texts])
        bound = [0, *before[np.searchsorted(first, stops)].tolist()]
        return [ids[4 * i : 4 * j] for i, j in zip(bound, bound[1:], strict=False)]


class Codec:
    """encode: text -> ids; decode: ids -> text, both over whole texts of any length."""

    def __init__(self, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # by rank: the two symbols and what they become
        self.left_of, self.right_of, self.merged_of = ([self.vocab[x] for x in column] for column in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        self.rank_of = {(a << PAIR) | b: rank for rank, (a, b) in enumerate(zip(self.left_of, self.right_of, strict=True))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.any_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        letters = byte_letters()
        self.inner, self.final = ([self.vocab.get(letters[b] + end, -1) for b in range(256)] for end in ("", self.suffix))
        self.merged = Memo(self._merge, PIECES_REMEMBERED)
        self.known = Memo(self._token, TOKENS_REMEMBERED)
        self.words: WordTable | None = None

    def _merge(self, piece: str) -> bytes:
        """Ids of one piece, as bytes, by merging its symbols in the order of rank, the leftmost first among equals."""
        raw = piece.encode("utf-8")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        if -1 in ids:
            ids = [i for i in ids if i >= 0]  # letters that the vocabulary lacks are dropped
        n = len(ids)
        if n < 2:
            return packed(ids)
        # symbols are a doubly linked list; an entry is the rank of a pair, which names it and what it becomes, and its left place, in one number
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank_of, left_of, right_of, merged_of, bits = self.rank_of.get, self.left_of, self.right_of, self.merged_of, SHORT if n < 1 << SHORT else LONG
        queue = [(r << bits) + k for k in range(n - 1) if (r := rank_of((ids[k] << PAIR) | ids[k + 1])) is not None]
        heapify(queue)
        while queue:
            top = heappop(queue)
            rank, k = top >> bits, top & ((1 << bits) - 1)
            if ids[k] != left_of[rank]:
                continue  # stale
            nxt = after[k]
            if nxt < 0 or ids[nxt] != right_of[rank]:
                continue  # stale
            merged = merged_of[rank]
            ids[k], ids[nxt] = merged, -1
            after[k] = nxt = after[nxt]
            if nxt >= 0:
                before[nxt] = k
                if (r := rank_of((merged << PAIR) | ids[nxt])) is not None:
                    heappush(queue, (r << bits) + k)
            prev = before[k]
            if prev >= 0 and (r := rank_of((ids[prev] << PAIR) | merged)) is not None:
                heappush(queue, (r << bits) + prev)
        return packed([i for i in ids if i >= 0])

    def normal(self, chunk: str) -> str:
        """NFC, then each letter in lower case by itself (a final sigma is not special)."""
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def _token(self, token: str) -> bytes:
        """Ids of a normalised run without white space, as little-endian unsigned 32-bit integers."""
        return self.merged[token] if token.isalpha() else b"".join([self.merged[p] for p in self.pieces.findall(token)])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """encode_bytes of each text: known words are found by array operations over all of them; texts out of the ordinary go one by one."""
        plain = [None if self.any_special is not None and self.any_special.search(t) else self.spaced(t) for t in texts]
        if self.words is None:
            self.words = WordTable(self._new_words)
        made = iter(self.words.encode([p for p in plain if p is not None]))
        return [self.encode_bytes(t) if p is None else next(made) for t, p in zip(texts, plain, strict=True)]

    def _new_words(self, words: list[str]) -> list[bytes]:
        parts = [[w] if w.isalpha() else self.pieces.findall(w) for w in words]
        merged = self.merged
        return [merged[ps[0]] if len(ps) == 1 else b"".join([merged[p] for p in ps]) for ps in parts]

    def spaced(self, text: str) -> str | None:
        """A text normalised, with full stops and commas at word ends set apart; None if that takes more than a few passes."""
        if any(s in text for s in SEPARATORS) or "Σ" in text or not unicodedata.is_normalized("NFC", text):
            return None
        low = text.lower()
        if not AFTER_MARK.search(low):
            for mark in ".,":
                low = low.replace(f"{mark} ", f" {mark} ").replace(f"{mark}\n", f" {mark}\n")
        return low

    def tokens(self, text: str) -> list[str]:
        """A text's runs without white space, normalised: NFC, then each letter in lower case by itself (a final sigma is no exception).

        Full stops and commas at the end of words are pieces of their own and split off, so fewer different runs are to be remembered.
        """
        plain = self.spaced(text)
        if plain is not None:
            return plain.split()
        odd = any(s in text for s in SEPARATORS)
        return [self.normal(c) for c in (SPACE.split(text) if odd else text.split()) if c]

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a special token's string stands for that token."""
        if self.any_special is None or not self.any_special.search(text):
            return b"".join(map(self.known.__getitem__, self.tokens(text)))
        out, at = [], 0
        for m in self.any_special.finditer(text):
            out += [*map(self.known.__getitem__, self.tokens(text[at : m.start()])), packed([self.special[m[0]]])]
            at = m.end()
        return b"".join([*out, *map(self.known.__getitem__, self.tokens(text[at:]))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The vocabulary's strings one after the other, with a space between them, as the file names no decoder.

        Ids that are not in the vocabulary are left out.
        """
        strings = self.strings
        return " ".join([s for i in ids if (s := strings.get(i)) is not None])


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """One for each worker process."""
    key = path or ""
    if key not in _codecs:
        _codecs[key] = Codec(path)
    return _codecs[key]


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and token_ids (array<int>) of each row; a null text counts as empty. For use before training."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], "token_ids": [c.encode(t or "") for t in f["__t"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return batches_in(docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS __t")).mapInPandas(run, f"`{id_col}` {kind}, token_ids array<int>")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and round_trip for each row, by encoding the whole text and decoding the ids.

    Null text: empty. Repeated rows: each on its own. Empty table: empty result. Other columns are not read. Nothing is
    shuffled, so no key or source can be hot; a very long text is held by one task, as text, ids and strings.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for f in frames:
            rows = []
            for ids in c.encode_many([t or "" for t in f["__t"]]):
                whole = np.frombuffer(ids, "<u4")
                rows.append((len(whole), sha256(ids).hexdigest(), sha256(c.decode(whole.tolist()).encode("utf-8")).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, id_col, f[id_col].to_numpy())
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return batches_in(docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS __t")).mapInPandas(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
