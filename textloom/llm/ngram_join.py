"""Near-duplicate join: five-word shingles, Jaccard similarity of 0.8 or more, found by MinHash banding.

Copies (equal shingle sets) are one node from the start, with a count. Band hashes of nodes are shuffled; nodes that share
one are candidates and get into one candidate component. A component is split into blocks of a bounded number of nodes, those of
an equal first band together. Two blocks meet in a task only if some band hash occurs in both: pairs of nodes that share
one are verified there on their full shingle sets. Tasks return sums of links and spanning edges for each node, never pairs,
so a group of thousands of near copies gives thousands of rows, and a chain of groups is compared link by link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.bpe import Memo
from textloom.llm.common import batches_in, broadcast_if_small, by_group, components, cut, merge_labels

N, THRESHOLD = 5, 0.8
#: The share of pairs just at the threshold that must meet in a band; more similar pairs are missed far less.
RECALL = 0.9995
ROWS = 7
#: Hashes of words that a worker remembers, in each of two halves: the frequent ones.
WORDS = 20_000
#: Shingles and nodes in a block of a candidate component, on average: a task holds two blocks at a time.
BLOCK, MEMBERS = 1 << 20, 256


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of so many rows for which 1 - (1 - threshold ** rows) ** bands reaches recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _constants(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 32, bands * rows, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, bands * rows, np.uint32)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; words are lower-cased and split at ASCII white space.

    A text of fewer than n words, but one at least, has a single shingle of all its words.
    """

    def __init__(self, n: int = N):
        self.n = n
        self.word = Memo(xxhash.xxh3_64_intdigest, WORDS)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        width = min(self.n, len(h))
        out = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        if width < self.n:
            out += np.uint64(width)
        return np.unique(out)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash for each band, of the minima of its rows' hashes."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):
        x = low[k : k + 512, None] * a
        x += b
        x ^= x >> np.uint32(15)
        np.minimum(least, x.min(0), out=least)
    m = least.reshape(bands, -1).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(m.shape[1]):
        h = (h ^ m[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def node_of(shingles: np.ndarray) -> np.int64 | None:
    """The name of a shingle set; None for an empty one."""
    return np.int64(xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)) if len(shingles) else None


def signatures(docs: DataFrame, id_col: str, text_col: str, rows: int, bands: int) -> DataFrame:
    """(id, node, bands): node is a hash of the shingle set, null where there is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, (a, b) = Shingler(), _constants(bands, rows)
        for f in frames:
            node, found = [], []
            for text in f["__t"]:
                s = shingler(text)
                node.append(node_of(s))
                found.append(signature(s, a, b, bands) if len(s) else None)
            yield pd.DataFrame({"id": f["id"], "node": pd.array(node, "Int64"), "bands": found})

    kind = docs.schema[id_col].dataType.simpleString()
    return batches_in(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t"))).mapInPandas(run, f"id {kind}, node long, bands array<long>")


def shared_counts(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (members, words of 64 bits) of the shingles that more than one member has, and the sets' sizes."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = n > 1
    owner, place = owner[many[code]], (np.cumsum(many) - 1)[code[many[code]]]
    maps = np.zeros((len(sets), int(many.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(maps, (owner, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return maps, sizes


def verify(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks (the same block twice, or two): (comp, node, links, root) of each member with any.

    Members of block i are compared with those of block j. links counts documents; root is one member of the node's class here.
    """
    empty = pd.DataFrame({"comp": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    group = group.sort_values(["block", "node"], ignore_index=True)
    m = len(group)
    block, node, many = group["block"].to_numpy(), group["node"].to_numpy(), group["n"].to_numpy()
    band = np.stack(group["bands"].tolist())
    maps, sizes = shared_counts([np.frombuffer(x, "<u8") for x in group["shingles"]])
    links, labels = np.zeros(m, np.int64), np.arange(m)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    step = max(1, (1 << 21) // (len(right) * band.shape[1] + 1))
    width = max(1, (1 << 21) // maps.shape[1])
    for a in range(0, len(left), step):
        own = left[a : a + step]
        near = np.zeros((len(own), len(right)), bool)
        for k in range(band.shape[1]):
            near |= band[own, k][:, None] == band[right, k][None, :]
        if i == j:
            near &= own[:, None] < right[None, :]
        x, y = np.nonzero(near)
        x, y = own[x], right[y]
        for b in range(0, len(x), width):
            p, q = x[b : b + width], y[b : b + width]
            both = np.bitwise_count(maps[p] & maps[q]).sum(1, dtype=np.int64)
            good = both * 1.0 >= THRESHOLD * (sizes[p] + sizes[q] - both) - 1e-9
            p, q = p[good], q[good]
            np.add.at(links, p, many[q])
            np.add.at(links, q, many[p])
            merge_labels(labels, p, q)
    has = links > 0
    if not has.any():
        return empty
    return pd.DataFrame({"comp": group["comp"][has].to_numpy(), "node": node[has], "links": links[has], "root": node[labels[has]]})


def dealt_to_blocks(members: DataFrame) -> DataFrame:
    """A row (comp, i, j, block, node, n, bands, shingles) of each member for each pair i <= j of blocks of its component to be compared.

    A block is a hash of the first band, so that what is alike lies together; nodes of a crowded first band are spread over
    several. Pairs of blocks come from the band hashes they have in common, by distinct (hash, block), never from pairs of members.
    """
    sums = members.groupBy("comp").agg(F.sum(F.length("shingles") / 8).alias("s"), F.count("*").alias("m"))
    sums = sums.select("comp", F.greatest(F.ceil(F.col("s") / BLOCK), F.ceil(F.col("m") / MEMBERS)).cast("int").alias("nb"))
    small = members.join(sums, "comp")
    large = cut(small.where("nb > 1"))
    zero = F.lit(0).cast("int")
    alone = small.where("nb = 1").select("comp", zero.alias("i"), zero.alias("j"), zero.alias("block"), "node", "n", "bands", "shingles")
    if large.isEmpty():
        return alone
    first = F.get("bands", F.lit(0))
    crowds = large.groupBy("comp", first.alias("first")).agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts"))
    placed = large.withColumn("first", first).join(crowds, ["comp", "first"])
    placed = cut(placed.select("comp", F.pmod(F.xxhash64("first", part), F.col("nb")).cast("int").alias("block"), "node", "n", "bands", "shingles"))
    keyed = cut(placed.select("comp", "block", F.explode("bands").alias("k")).distinct())
    other = keyed.select("comp", F.col("block").alias("j"), "k")
    pairs = cut(keyed.withColumnRenamed("block", "i").join(other, ["comp", "k"]).where("i <= j").select("comp", "i", "j").distinct())
    sides = pairs.select("comp", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return alone.unionByName(sides.join(placed, ["comp", "block"]))


def classes(docs: DataFrame, id_col: str, text_col: str, recall: float, rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, and (node, n_links, root, class_id) of every node; nodes of a class have equal roots."""
    bands = bands_for(THRESHOLD, recall, rows)
    signed = cut(signatures(docs, id_col, text_col, rows, bands))
    nodes = cut(signed.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("bands").alias("bands")))
    keyed = nodes.select("node", F.explode("bands").alias("k"))
    buckets = keyed.groupBy("k").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("k", "low")
    candidates = components(keyed.join(buckets, "k").select(F.col("node").alias("a"), F.col("low").alias("b")))
    active = cut(candidates.withColumnRenamed("root", "comp").join(nodes, "node"))

    wanted = broadcast_if_small(cut(active.select(F.col("least").alias("wanted")).distinct()), 16)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t"))
    shingled = texts.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for f in frames:
            node, found = [], []
            for text in f["__t"]:
                s = shingler(text)
                node.append(node_of(s))
                found.append(s.tobytes())
            yield pd.DataFrame({"node": pd.array(node, "Int64"), "shingles": found})

    full = batches_in(shingled.select("__t")).mapInPandas(sets, "node long, shingles binary").where("node IS NOT NULL").dropDuplicates(["node"])
    members = cut(full.join(active, "node").select("comp", "node", "n", "bands", "shingles"))
    keys = ["comp", "i", "j"]
    grouped = dealt_to_blocks(members).repartition(*keys).sortWithinPartitions(*keys)
    verified = cut(batches_in(grouped).mapInPandas(by_group(keys, verify), "comp long, node long, links long, root long"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(verified.select("node", "root"), "node", "root")
    by_node = nodes.select("node", "n", "least").join(links, "node", "left").join(joined, "node", "left")
    by_node = cut(by_node.select("node", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    least = by_node.groupBy("root").agg(F.min("least").alias("class_id"))
    return signed.select("id", "node"), by_node.join(least, "root").select("node", "n_links", "root", "class_id")


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(id, n_links, class_id, kept) for each row.

    n_links is the number of other rows whose shingle sets have a Jaccard similarity of 0.8 or more with this row's;
    class_id is the smallest id that a chain of links reaches, its own included; kept says that the id is the class_id.
    Null and empty texts, and those of white space, have no shingles and link with nothing. Repeated rows are copies of
    each other. A null id is kept, is nobody's class_id unless all its class has null ids, and counts as a link. Other columns are not read.
    """
    signed, found = classes(docs, id_col, text_col, recall, rows)
    some = signed.where("node IS NOT NULL").join(found, "node").select("id", "n_links", "class_id")
    none = signed.where("node IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), "n_links", "class_id", F.expr("id IS NULL OR id = class_id").alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """docs with one row of each class of near duplicates, that of the smallest id; all columns stay.

    Rows without shingles are in no class and stay, each of them. Of rows that share the smallest id of their class one stays, any
    of them; rows that share an id but have different texts are judged each in its own class. A null id counts as greater than any.
    """
    signed, found = classes(docs, id_col, text_col, recall, rows)
    found = cut(found.select("node", "root", "class_id"))
    other = "__id"
    while other in docs.columns:
        other += "_"
    gone = signed.join(found, "node").where("id IS NOT NULL AND id <> class_id").select(F.col("id").alias(other))
    # ids that say which row is meant, and those that don't
    shared = cut(signed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").select(F.col("id").alias(other)))
    aside = broadcast_if_small(cut(gone.union(shared).where(F.col(other).isNotNull()).distinct()), 16)
    kept = docs.where(F.col(id_col).isNotNull()).join(aside, F.col(id_col) == F.col(other), "left_anti")
    if shared.isEmpty():
        return kept

    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler()
        for batch in batches:
            yield pd.Series(pd.array([node_of(shingler(t)) for t in batch], "Int64"))

    odd = docs.join(broadcast_if_small(shared, 16), F.col(id_col).eqNullSafe(F.col(other)), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    odd = odd.select(whole.alias("row"), F.pandas_udf(named, "long")(F.col(text_col)).alias("node"))
    judged = odd.where("node IS NOT NULL").join(found, "node").where(F.col("row")[id_col].eqNullSafe(F.col("class_id")))
    one = judged.groupBy("root").agg(F.first("row").alias("row")).select("row.*")
    return kept.unionByName(odd.where("node IS NULL").select("row.*")).unionByName(one)
