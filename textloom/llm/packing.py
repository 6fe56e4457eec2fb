"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

The driver sees only the histogram (one count for each length up to the capacity) and returns runs: so many sequences
with this pattern of lengths. Patterns come from multiplicative weights, each priced by a knapsack dynamic program, and
are rounded down; what is left is packed best fit, a whole group of equal lengths at a time. Rows are then numbered within
their length by counting, not sorting, and each finds its place by one search in the runs, whatever the number of rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import codec
from textloom.llm.common import batches_in, cut

CAPACITY = 4096
#: Added after the ids of each document.
END_ID = 1
#: Size classes that the program works with, at most: a length counts as the multiple of capacity / CLASSES nearest to it.
CLASSES = 256
#: Share of a class that one round of multiplicative weights covers, the rate of the weights, and the passes over all classes.
STEP, RATE, PASSES = 0.1, 0.1, 4
#: How often the program is solved for what rounding left over, at most.
ROUNDS = 4
#: The program is solved when its value is within this share of the bound that the weights prove.
GAP = 0.01

Run = tuple[dict[int, int], int]


def price_pattern(sizes: np.ndarray, values: np.ndarray, limits: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The multiset of sizes of greatest value that fits, each at most limits times: place -> how many, and the value.

    Bounded knapsack by dynamic programming; so many copies of a size are a few items of 1, 2, 4, ... copies.
    """
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for k in np.argsort(sizes, kind="stable").tolist():
        size, left, copies = int(sizes[k]), min(int(limits[k]), capacity // int(sizes[k])), 1
        while left > 0:
            n = min(copies, left)
            gain = best[: capacity + 1 - n * size] + n * values[k]
            better = gain > best[n * size :] + 1e-12
            np.copyto(best[n * size :], gain, where=better)
            taken.append((k, n, better))
            left, copies = left - n, copies * 2
    pattern: dict[int, int] = {}
    c = capacity
    for k, n, better in reversed(taken):
        size = n * int(sizes[k])
        if c >= size and better[c - size]:
            pattern[k] = pattern.get(k, 0) + n
            c -= size
    return pattern, float(best[capacity])


def configuration_lp(counts: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], float, float]:
    """(patterns over the places of sizes with fractional counts, in the order found; their sum; a lower bound of any such sum).

    The sum of the counts is least possible up to GAP, and they use each size exactly as often as counts says. A size's weight
    falls by a factor with each share of it that is covered; each round takes the pattern of greatest weight, so often as
    covers STEP of its scarcest size. All weights over that of the best pattern are a solution of the dual program, so
    every round proves a bound. A further pass starts from weights that are raised where sizes went into patterns with room left.
    """
    start, bound, best = sizes.astype(float), 0.0, ([], np.inf)
    for _ in range(PASSES):
        left, weight, found, used = counts.astype(float), start.copy(), {}, np.zeros(len(sizes))
        while (live := np.flatnonzero(left > 1e-9)).size:
            local, value = price_pattern(sizes[live], weight[live], counts[live], capacity)
            bound = max(bound, float(counts[live] @ weight[live]) / value)
            pattern = {int(live[k]): m for k, m in local.items()}
            at, m = np.array(list(pattern)), np.array(list(pattern.values()), float)
            step = float(min((np.maximum(STEP * counts[at], 1.0) / m).min(), (left[at] / m).min()))
            key = tuple(sorted(pattern.items()))
            found[key] = found.get(key, 0.0) + step
            left[at] -= step * m
            weight[at] *= np.exp(-RATE * step * m / counts[at])
            used[at] += step * m * capacity / float(sizes[at] @ m)
        value = sum(found.values())
        if value < best[1]:
            best = [(dict(k), x) for k, x in found.items()], value
        if best[1] <= (1 + GAP) * bound:
            break
        start *= used / counts
    return best[0], best[1], bound


class Rooms:
    """Groups of sequences by the room they have left; the least room that holds a length is found by one search."""

    def __init__(self, capacity: int):
        self.capacity, self.groups, self.sizes = capacity, {}, []

    def add(self, room: int, pattern: dict[int, int], n: int) -> None:
        if room not in self.groups:
            self.groups[room] = []
            insort(self.sizes, room)
        self.groups[room].append((pattern, n))

    def take(self, length: int) -> tuple[int, dict[int, int], int] | None:
        k = bisect_left(self.sizes, length)
        if k == len(self.sizes):
            return None
        room = self.sizes[k]
        pattern, n = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room], self.sizes[k]
        return room, pattern, n

    def fill(self, histogram: dict[int, int]) -> None:
        """Best fit decreasing, a group of equal lengths at a time; new sequences where no room is left."""
        for length in sorted(histogram, reverse=True):
            left = histogram[length]
            while left:
                room, pattern, n = self.take(length) or (self.capacity, {}, left)
                per = min(room // length, left)
                some = min(n, left // per)
                self.add(room - per * length, pattern | {length: pattern.get(length, 0) + per}, some)
                if some < n and pattern:
                    self.add(room, pattern, n - some)
                left -= per * some

    def runs(self) -> list[Run]:
        return [(pattern, n) for groups in self.groups.values() for pattern, n in groups]


class Stock:
    """What is left of each length, and the lengths left in order."""

    def __init__(self, histogram: dict[int, int]):
        self.left, self.lengths = dict(histogram), sorted(histogram)

    def largest(self, low: int, high: int, taken: dict[int, int]) -> int | None:
        """The greatest length from low to high of which there is more than what is taken."""
        k = bisect_right(self.lengths, high) - 1
        while k >= 0 and self.lengths[k] >= low:
            length = self.lengths[k]
            if self.left[length] > taken.get(length, 0):
                return length
            k -= 1
        return None

    def put(self, taken: dict[int, int], times: int) -> None:
        for length, m in taken.items():
            if length not in self.left:
                insort(self.lengths, length)
            self.left[length] = self.left.get(length, 0) + m * times

    def remove(self, taken: dict[int, int], times: int) -> None:
        for length, m in taken.items():
            self.left[length] -= m * times
            if not self.left[length]:
                del self.left[length], self.lengths[bisect_left(self.lengths, length)]


def fill_slots(stock: Stock, slots: list[int], capacity: int, unit: int) -> tuple[dict[int, int], int]:
    """(length -> how many, room left) of a sequence with lengths near these classes, as far as they are in stock."""
    taken: dict[int, int] = {}
    room = capacity
    for j, size in enumerate(slots):
        low, high = (size * unit - unit // 2 if size > 1 else 1), size * unit + unit // 2
        if j == len(slots) - 1:
            low, high = low - len(slots) * unit, high + len(slots) * unit
        if (length := stock.largest(low, min(room, high), taken)) is not None:
            taken[length] = taken.get(length, 0) + 1
            room -= length
    return taken, room


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], dict[str, float]]:
    """Runs (pattern, how many sequences) that use each length exactly as often as the histogram says, and what they rest on.

    The counts of the program's patterns are rounded, what is cut off one being carried to the next. A pattern's places are then
    filled with lengths of their classes, the greatest first, and the last place with the greatest length that still fits: so what
    classes misjudge is made good. Sequences that stay less than full, since rounding used a length up, are dissolved, and the
    program is solved again for what is left, until that is too little to fill any. It goes by best fit, into rooms first.
    """
    rests = {"pieces": sum(histogram.values()), "by_pattern": 0, "program": 0.0, "bound": 0.0, "sequences": 0}
    if not histogram:
        return [], rests
    unit = -(-capacity // CLASSES)
    stock, rooms = Stock(histogram), Rooms(capacity)
    for round_ in range(ROUNDS):
        counts = np.bincount([max(1, (n + unit // 2) // unit) for n in stock.left], list(stock.left.values())).astype(np.int64)
        sizes = np.flatnonzero(counts)
        solution, value, bound = configuration_lp(counts[sizes], sizes, capacity // unit)
        if not round_:
            rests |= {"program": value, "bound": bound}
        full, loose, carried = 0, [], 0.5
        for pattern, x in solution:
            carried += x
            want, carried = int(carried), carried % 1.0
            slots = [int(sizes[k]) for k in sorted(pattern, reverse=True) for _ in range(pattern[k])]
            while want > 0:
                taken, room = fill_slots(stock, slots, capacity, unit)
                if not taken:
                    break
                times = min(want, *(stock.left[n] // m for n, m in taken.items()))
                stock.remove(taken, times)
                want -= times
                if room < unit:
                    rooms.add(room, taken, times)
                    full += times * sum(taken.values())
                else:
                    loose.append((taken, times))
        for taken, times in loose:
            stock.put(taken, times)
        rests["by_pattern"] += full
        if not full or not stock.left:
            break
    rooms.fill(stock.left)
    runs = rooms.runs()
    return runs, rests | {"sequences": sum(n for _, n in runs)}


def places(runs: list[Run]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, how many in each sequence, offset there), by rank."""
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    base = 0
    for pattern, k in runs:
        offset = 0
        for n in sorted(pattern, reverse=True):
            m = pattern[n]
            out.setdefault(n, []).append((seen.get(n, 0), base, m, offset))
            seen[n] = seen.get(n, 0) + k * m
            offset += n * m
        base += k
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32, and where it was made: __part and __rank among its lengths there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, part, made = codec(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for f in frames:
            rows, ids_of = [], f[id_col].tolist()
            for k, ids in enumerate(c.encode_many([t or "" for t in f["__t"]])):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part_ids = ids[4 * start : 4 * (start + capacity)]
                    length = len(part_ids) // 4
                    rows.append((ids_of[k], piece, start, length, zlib.crc32(part_ids), part, made[length]))
                    made[length] += 1
            yield pd.DataFrame(rows, columns=[id_col, "piece", "start", "length", "ids_crc32", "__part", "__rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, __part int, __rank long"
    return batches_in(docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS __t")).mapInPandas(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row.

    A null or empty text is one piece, its end id. A text over the capacity is cut, and only such. Repeated rows are packed each
    on its own; an empty table gives none; other columns are not read. Equal lengths take their places in the order of
    partition and row, any of which is as good as another. Lengths are counted for each partition before anything is
    shuffled, so a length that a third of all rows have makes no large group.
    """
    made = cut(pieces(docs, id_col, text_col, path, capacity))
    counts = cut(made.groupBy("length", "__part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    at = places(plan(histogram, capacity)[0])
    # one row for each partition and length, so a window holds as many rows as there are partitions
    first = counts.select("length", "__part", (F.sum("n").over(Window.partitionBy("length").orderBy("__part")) - F.col("n")).alias("__first"))
    ranked = made.join(first, ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__first"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(), f["__rank"].to_numpy()
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for n in np.unique(length):
                own, runs = np.flatnonzero(length == n), at[int(n)]
                r = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1]
                behind = rank[own] - r[:, 0]
                sequence[own] = r[:, 1] + behind // r[:, 2]
                offset[own] = r[:, 3] + behind % r[:, 2] * n
            yield f.drop(columns=["__part", "__rank", "__first"]).assign(sequence_id=sequence, offset=offset)

    cols = [id_col, "piece", "start", "length", "ids_crc32"]
    kind = docs.schema[id_col].dataType.simpleString()
    ordered = ranked.select(*cols, "__part", "__rank", "__first")
    return ordered.mapInPandas(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
