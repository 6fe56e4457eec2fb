"""Near duplicates among embeddings by a robust-pruned flat graph.

Vectors of a label are dealt to cluster shards that overlap: a vector is in the graphs of the nearest OVERLAP shards whose cells are
within the link radius; the other shards within it get the vector too, and compare it with all their home vectors in blocks. So each
vector's home shard sees all that it links with. Each shard builds a graph (greedy
search for neighbours, robust pruning, reverse edges); adjacency lists of a vector from all its shards are united; then each
shard's home vectors search its part of the united graph from the medoids and expand the range found until nothing new is
in it. Recall is audited on every twentieth query against brute force, and a shard that falls short searches wider. What is
found is verified in double precision. Tasks return counts and spanning edges, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from textloom.llm.common import broadcast_if_small, by_group, components, cut, merge_labels

COSINE = 0.98
#: Vectors of a label for each shard on average. Shards grow only where more than so many centres, of a label or in all, would be needed.
SHARD, LABEL_CENTRES, CENTRES = 512, 4096, 1 << 15
#: Vectors that each centre is fitted on, on average: the sample of a label is so many times its centres.
PER_CENTRE = 8
#: Shards of a vector that hold it in their graphs, the nearest ones. Any others in reach compare it exactly.
OVERLAP = 2
#: Members of a shard in one task: larger shards are dealt to parts, and queries visit each.
PART = 16384
DEGREE, BEAM, ALPHA = 24, 48, 1.2
#: Range expansion passes through vectors up to this many times the link distance.
SLACK = 1.5
TARGET_RECALL = 0.995
AUDIT_EVERY = 20
#: A run whose audit finds less than this of the links raises an error.
LEAST_RECALL = 0.9


def radius(cosine: float) -> float:
    """Euclidean distance of unit vectors of this cosine."""
    return float(np.sqrt(2 - 2 * cosine))


def distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows q[k] from x[ids[k, j]]; infinite where ids is -1."""
    d = ((x[ids] - q[:, None, :]) ** 2).sum(2)
    d[ids < 0] = np.inf
    return d


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q: the beam nearest nodes that greedy search finds, and their squared distances (-1, inf: none).

    It starts at the given nodes, the medoids, and at a row's own node if it has one (own, -1: none).
    """
    n, rows = len(x), len(q)
    ids = np.full((rows, beam + graph.shape[1]), -1, np.int64)
    dist = np.full(ids.shape, np.inf, np.float32)
    done = np.zeros(ids.shape, bool)
    seen = np.zeros((rows, n), bool)
    k = min(len(starts), beam)
    ids[:, :k] = starts[:k]
    dist[:, :k] = distances(x, ids[:, :k], q)
    seen[:, starts[:k]] = True
    if own is not None and k < ids.shape[1]:
        fresh = (own >= 0) & ~seen[np.arange(rows), np.maximum(own, 0)]
        ids[fresh, k], dist[fresh, k] = own[fresh], 0
        seen[np.flatnonzero(fresh), own[fresh]] = True
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    at = np.arange(rows)
    while len(at):
        open_at = np.where(done[at, :beam] | (ids[at, :beam] < 0), np.inf, dist[at, :beam])
        pick = open_at.argmin(1)
        going = np.isfinite(open_at[np.arange(len(at)), pick])
        at, pick = at[going], pick[going]
        if not len(at):
            break
        done[at, pick] = True
        nbr = graph[ids[at, pick]]
        fresh = (nbr >= 0) & ~seen[at[:, None], np.maximum(nbr, 0)]
        nbr = np.where(fresh, nbr, -1)
        r, c = np.nonzero(fresh)
        seen[at[r], nbr[r, c]] = True
        ids[at, beam:], dist[at, beam:], done[at, beam:] = nbr, distances(x, nbr, q[at]), False
        order = np.argsort(dist[at], axis=1, kind="stable")
        ids[at], dist[at], done[at] = (np.take_along_axis(v[at], order, 1) for v in (ids, dist, done))
        ids[at, beam:], dist[at, beam:] = -1, np.inf
    return ids[:, :beam], dist[:, :beam]


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each point: its nearest of the pool, then again and again the nearest that no chosen one is alpha times nearer to."""
    out = np.full((len(points), degree), -1, np.int64)
    for a in range(0, len(points), 256):
        p, c = points[a : a + 256], pool[a : a + 256]
        c = np.sort(np.where(c == p[:, None], -1, c), axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        v = x[c]
        d = ((v - x[p][:, None, :]) ** 2).sum(2)
        d[c < 0] = np.inf
        left = d.copy()
        rows = np.arange(len(p))
        for k in range(degree):
            best = left.argmin(1)
            good = np.isfinite(left[rows, best])
            if not good.any():
                break
            out[a + rows[good], k] = c[rows[good], best[good]]
            to = ((v - v[rows, best][:, None, :]) ** 2).sum(2)
            left[(alpha * alpha * to <= d) & good[:, None]] = np.inf
            left[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """The pruned graph of the rows of x (n, degree; -1: none) and its medoid. Rows enter in batches that double."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    medoid = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    have = 1
    while have < n:
        batch = order[have : have + min(max(have, 16), 512)]
        pool = beam_search(x, graph, np.array([medoid]), x[batch], beam)[0]
        # within a batch, neighbours are taken from it too, as no search can find them yet
        near = ((x[batch][:, None, :] - x[batch][None, :, :]) ** 2).sum(2) if len(batch) <= 64 else 2 - 2 * (x[batch] @ x[batch].T)
        np.fill_diagonal(near, np.inf)
        own = batch[np.argsort(near, axis=1)[:, : min(16, len(batch) - 1)]] if len(batch) > 1 else np.full((1, 1), -1)
        chosen = robust_prune(x, batch, np.concatenate([pool, own], axis=1), degree)
        graph[batch] = chosen
        back: dict[int, list[int]] = {}
        for p, row in zip(batch.tolist(), chosen.tolist(), strict=True):
            for t in row:
                if t >= 0:
                    back.setdefault(t, []).append(p)
        full = []
        for t, more in back.items():
            has = graph[t][graph[t] >= 0].tolist()
            all_of = list(dict.fromkeys([*has, *more]))
            if len(all_of) <= degree:
                graph[t, : len(all_of)] = all_of
            else:
                full.append((t, all_of))
        if full:
            pools = np.full((len(full), max(len(m) for _, m in full)), -1, np.int64)
            for k, (_, m) in enumerate(full):
                pools[k, : len(m)] = m
            t = np.array([t for t, _ in full])
            graph[t] = robust_prune(x, t, pools, degree)
        have += len(batch)
    return connected(graph, medoid), medoid


def connected(graph: np.ndarray, start: int) -> np.ndarray:
    """The graph with edges added until every node can be reached: pruning may have taken all edges to a node.

    Each node out of reach gets one from the nearest of its own neighbours that is in reach, or from the start.
    """
    while True:
        seen = np.zeros(len(graph), bool)
        front = np.array([start])
        while len(front):
            seen[front] = True
            to = graph[front].ravel()
            front = np.unique(to[(to >= 0) & ~seen[np.maximum(to, 0)]])
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return graph
        near = graph[lost]
        good = (near >= 0) & seen[np.maximum(near, 0)]
        source = np.where(good.any(1), near[np.arange(len(lost)), good.argmax(1)], start)
        order = np.argsort(source, kind="stable")
        source, lost = source[order], lost[order]
        column = np.arange(len(source)) - np.searchsorted(source, source)
        more = np.full((len(graph), int(column.max()) + 1), -1, np.int64)
        more[source, column] = lost
        graph = np.concatenate([graph, more], axis=1)


def range_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, r: float, beam: int, slack: float, own: np.ndarray | None = None) -> np.ndarray:
    """(rows of q, nodes) that are within r * slack as far as the search finds: beam search, then expansion of all found."""
    found = np.zeros((len(q), len(x)), bool)
    ids, dist = beam_search(x, graph, starts, q, min(beam, len(x)), own)
    limit = (r * slack) ** 2
    row, col = np.nonzero(dist <= limit)
    front_r, front_n = row, ids[row, col]
    seen = found.copy()
    seen[front_r, front_n] = True
    found[front_r, front_n] = True
    while len(front_r):
        nbr = graph[front_n]
        k, j = np.nonzero(nbr >= 0)
        rr, nn = front_r[k], nbr[k, j]
        new = ~seen[rr, nn]
        pair = np.unique(rr[new] * np.int64(len(x)) + nn[new])
        rr, nn = pair // len(x), pair % len(x)
        seen[rr, nn] = True
        near = np.zeros(len(rr), bool)
        for a in range(0, len(rr), 1 << 16):
            near[a : a + (1 << 16)] = ((x[nn[a : a + (1 << 16)]] - q[rr[a : a + (1 << 16)]]) ** 2).sum(1) <= limit
        front_r, front_n = rr[near], nn[near]
        found[front_r, front_n] = True
    return found


def units(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows of length one, in double precision."""
    x = np.stack(vectors.tolist()).astype(np.float64)
    return x / np.sqrt((x**2).sum(1))[:, None]


def exact_group(cosine: float):
    """For by_group over (label, w, cell, part, qblock): rows with role 0 are vectors beyond the cell's graph, with role 1 the queries."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        members, asked = group[group["role"] == 0], group[group["role"] == 1]
        if not len(members) or not len(asked):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "links", "root", "audited", "missed")})
        x, q, many = units(members["v"]), units(asked["v"]), members["n"].to_numpy()
        links, labels, step = np.zeros(len(q), np.int64), np.arange(len(x) + len(q)), max(1, (1 << 20) // len(x))
        for a in range(0, len(q), step):
            k, j = np.nonzero(q[a : a + step] @ x.T >= cosine - 1e-9)
            for b in range(0, len(k), 1 << 15):
                kk, jj = a + k[b : b + (1 << 15)], j[b : b + (1 << 15)]
                good = (q[kk] * x[jj]).sum(1) >= cosine
                np.add.at(links, kk[good], many[jj[good]])
                merge_labels(labels, len(x) + kk[good], jj[good])
        name = np.concatenate([members["node"].to_numpy(), asked["node"].to_numpy()])
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        edges = pd.DataFrame({"node": name[tied], "links": 0, "root": name[labels[tied]], "audited": 0, "missed": 0})
        counts = pd.DataFrame({"node": asked["node"].to_numpy(), "links": links, "root": asked["node"].to_numpy(), "audited": 0, "missed": 0})
        return pd.concat([counts[links > 0], edges], ignore_index=True)

    return run


def link_group(cosine: float):
    """For by_group over (label, w, cell, part, qblock): rows with role 0 are the part's members, with role 1 the queries."""
    r = radius(cosine)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        members, asked = group[group["role"] == 0].sort_values("node", ignore_index=True), group[group["role"] == 1].sort_values("node", ignore_index=True)
        empty = pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64), "audited": np.zeros(0, np.int64), "missed": np.zeros(0, np.int64)})
        if not len(members) or not len(asked):
            return empty
        node, many = members["node"].to_numpy(), members["n"].to_numpy()
        x64, q64 = units(members["v"]), units(asked["v"])
        x, q = x64.astype(np.float32), q64.astype(np.float32)
        lists = [np.asarray(v, np.int64) for v in members["near"]]
        graph = np.full((len(node), max(1, max(map(len, lists)))), -1, np.int64)
        for k, to in enumerate(lists):
            at = np.searchsorted(node, to)
            at = at[(at < len(node)) & (node[np.minimum(at, len(node) - 1)] == to)]
            graph[k, : len(at)] = at
        starts = np.flatnonzero(members["medoid"].to_numpy())
        starts = starts if len(starts) else np.array([0])
        q_node = asked["node"].to_numpy()
        me = np.searchsorted(node, q_node)
        me = np.where((me < len(node)) & (node[np.minimum(me, len(node) - 1)] == q_node), me, -1)
        sample = np.arange(0, len(q), AUDIT_EVERY)

        def linked(rows: np.ndarray, maybe: np.ndarray) -> np.ndarray:
            """maybe without pairs below the cosine, and without a vector's own."""
            k, j = np.nonzero(maybe)
            for a in range(0, len(k), 1 << 15):
                kk, jj = k[a : a + (1 << 15)], j[a : a + (1 << 15)]
                bad = ((q64[rows[kk]] * x64[jj]).sum(1) < cosine) | (me[rows[kk]] == jj)
                maybe[kk[bad], jj[bad]] = False
            return maybe

        def exact(rows: np.ndarray) -> np.ndarray:
            return linked(rows, q64[rows] @ x64.T >= cosine - 1e-9)

        def search(rows: np.ndarray, beam: int, slack: float) -> np.ndarray:
            return linked(rows, range_search(x, graph, starts, q[rows], r, beam, slack, me[rows]))

        beam, slack, step = BEAM, SLACK, max(1, (1 << 20) // len(x))
        truth = [exact(sample[a : a + step]) for a in range(0, len(sample), step)]
        wanted = sum(int(t.sum()) for t in truth)
        while True:
            got = sum(int((search(sample[k * step : (k + 1) * step], beam, slack) & t).sum()) for k, t in enumerate(truth))
            if got >= TARGET_RECALL * wanted or beam >= len(x):
                break
            beam, slack = min(2 * beam, len(x)), min(2.0, slack * 1.2)
        short = got < TARGET_RECALL * wanted  # a graph that even the widest search fails on is not searched
        got = wanted if short else got
        links = np.zeros(len(q), np.int64)
        size = len(x)
        labels = np.arange(size + len(q))  # a query is one with its own member, if that is in this part
        own = np.flatnonzero(me >= 0)
        merge_labels(labels, me[own], size + own)
        for a in range(0, len(q), step):
            rows = np.arange(a, min(a + step, len(q)))
            hit = exact(rows) if short else search(rows, beam, slack)
            links[rows] = hit @ many
            k, j = np.nonzero(hit)
            merge_labels(labels, size + rows[k], j)
        name = np.concatenate([node, q_node])
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        edges = pd.DataFrame({"node": name[tied], "links": 0, "root": name[labels[tied]], "audited": 0, "missed": 0})
        edges = edges[edges["node"] != edges["root"]].drop_duplicates()
        counts = pd.DataFrame({"node": q_node, "links": links, "root": q_node, "audited": 0, "missed": 0})
        counts.loc[0, ["audited", "missed"]] = [wanted, wanted - got]
        return pd.concat([counts, edges], ignore_index=True)

    return run


def build_group(group: pd.DataFrame) -> pd.DataFrame:
    """For by_group over (label, w, cell, part): adjacency lists of the part's members, by node."""
    group = group.sort_values("node", ignore_index=True)
    node = group["node"].to_numpy()
    graph, medoid = build(units(group["v"]).astype(np.float32))
    near = [node[row[row >= 0]] for row in graph]
    return group[["label", "w", "cell", "part"]].assign(node=node, near=near, medoid=np.arange(len(node)) == medoid)


def centres(vectors: DataFrame, large: DataFrame, apart: float) -> dict[int, np.ndarray]:
    """li -> shard centres of each large label (li, label, w, m, k), by k-means on PER_CENTRE * k of its vectors, whose hashed node is least."""
    wanted = F.pmod(F.xxhash64("node", F.lit("centres")), F.lit(1 << 30)) < F.col("k") * PER_CENTRE / F.col("m") * (1 << 30)
    picked = vectors.join(F.broadcast(large), ["label", "w"]).where(wanted)  # large has CENTRES rows at most

    def packed(frames):
        for f in frames:
            yield pd.DataFrame({"li": f["li"], "k": f["k"], "node": f["node"], "x": [np.asarray(v, np.float32).tobytes() for v in f["v"]]})

    got = picked.select("li", "k", "node", "v").mapInPandas(packed, "li int, k int, node long, x binary").toPandas()  # about PER_CENTRE * CENTRES rows at most
    out = {}
    for li, own in got.sort_values(["li", "node"]).groupby("li"):
        x = np.stack([np.frombuffer(v, np.float32) for v in own["x"]])
        x = x / np.maximum(np.sqrt((x**2).sum(1)), 1e-30)[:, None]
        k = min(int(own["k"].iloc[0]), len(x))
        c = x[np.random.default_rng(11).choice(len(x), k, replace=False)]
        for _ in range(10):
            near = (2 * x @ c.T - (c**2).sum(1)).argmax(1)
            total, size = np.zeros_like(c), np.bincount(near, minlength=k)
            np.add.at(total, near, x)
            c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        # a dense group may have drawn several centres, which would deal it apart: of close ones the largest stays
        size = np.bincount((2 * x @ c.T - (c**2).sum(1)).argmax(1), minlength=k)
        stay: list[int] = []
        for j in np.argsort(-size, kind="stable").tolist():
            if not stay or ((c[stay] - c[j]) ** 2).sum(1).min() > apart * apart:
                stay.append(j)
        out[int(li)] = c[stay]
    return out


def linked_nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, cosine: float, shard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, h1, h2) of every row; the nodes, equal vectors of a label as one; what tasks found: (node, links, root, audited, missed)."""
    # vectors travel as they are, since floats take half the room, and are brought to length one where they are compared
    kind = "float" if vectors.select(vec_col).schema[0].dataType == ArrayType(FloatType()) else "double"
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("e"), F.col(label_col).alias("label"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    good = F.col("e").isNotNull() & F.col("label").isNotNull() & F.coalesce(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    raw = raw.withColumn("ok", F.coalesce(F.when(good, norm) > 0, F.lit(False)))
    # 128 bits, so that no two different vectors of any table are taken for one
    raw = raw.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("label", "e")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit("second"), "e", "label"))})
    rows = cut(raw.select("id", "h1", "h2"))
    merged = raw.where("ok").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first(F.struct("label", "e")).alias("f"))
    nodes = cut(merged.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "least", "f.label", F.size("f.e").alias("w"), F.col("f.e").alias("v")))
    narrow = nodes.select("node", "n", "label", "w", "v")
    counts = cut(nodes.groupBy("label", "w").agg(F.count("*").alias("m")))
    total = counts.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    each = max(shard, -(-total // CENTRES))
    li = F.row_number().over(Window.orderBy("label", "w")).cast("int")  # of CENTRES rows at most
    large = cut(counts.where(F.col("m") > each).select("label", "w", "m", F.least(F.lit(LABEL_CENTRES), F.ceil(F.col("m") / each)).cast("int").alias("k"), li.alias("li")))
    r = radius(cosine)
    middle = centres(narrow, large, 1.5 * r)

    def assign(frames, beyond=False):
        gaps: dict[int, np.ndarray] = {}
        for f in frames:
            for own, whole in f.groupby("li", sort=False):
                c = middle.get(int(own), np.zeros((1, whole["w"].iloc[0]), np.float32))
                if own not in gaps:
                    square = (c**2).sum(1)
                    gaps[own] = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * c @ c.T, 0))
                for a in range(0, len(whole), 1024):
                    g = whole.iloc[a : a + 1024]
                    x = units(g["v"])
                    d = ((c**2).sum(1) - 2 * x @ c.T).astype(np.float64)
                    at = np.arange(len(x))
                    home = d.argmin(1)
                    # how far the vector is from the cell of each other centre
                    far = (d - d[at, home][:, None]) / np.maximum(2 * gaps[own][home], 1e-12)
                    k, j = np.nonzero(far <= r + 1e-5)
                    order = np.lexsort((j, d[k, j], k))
                    k, j = k[order], j[order]
                    rank = np.arange(len(k)) - np.searchsorted(k, k)
                    k, j = k[(rank >= OVERLAP) == beyond], j[(rank >= OVERLAP) == beyond]
                    yield g.iloc[k].drop(columns="li").assign(cell=j, home=home[k] == j)[[*columns, "cell", "home"]]

    columns = ["label", "w", "node", "n", "v"]
    label = nodes.schema["label"].dataType.simpleString()
    member = f"label {label}, w int, node long, n long, v array<{kind}>, cell long, home boolean"
    dealable = narrow.join(F.broadcast(large.select("label", "w", "li")), ["label", "w"]).select(*columns, "li")
    single = narrow.join(F.broadcast(large.select("label", "w")), ["label", "w"], "left_anti").select(*columns, F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"))
    dealt = cut(dealable.mapInPandas(assign, member).unionByName(single))
    # groups are small in bytes and long in work, so their number decides, not their size
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(8192, dealt.count() // SHARD))
    cell = ["label", "w", "cell"]
    sizes = broadcast_if_small(cut(dealt.groupBy(*cell).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.ceil(F.count_if("home") / PART).cast("int").alias("blocks"))), 64)
    placed = cut(dealt.join(sizes, cell).withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int")))
    inner = [*cell, "part"]
    built = placed.select(*inner, "node", "v").repartition(tasks, *inner).sortWithinPartitions(*inner)
    lists = cut(built.mapInPandas(by_group(inner, build_group), f"label {label}, w int, cell long, part int, node long, near array<long>, medoid boolean"))
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    medoids = lists.where("medoid").select(*inner, "node", "medoid")
    held = placed.join(united, "node").join(medoids, [*inner, "node"], "left")
    each_block = F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1))
    each_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = held.select(*inner, each_block.alias("qblock"), F.lit(0).alias("role"), "node", "n", "v", "near", F.coalesce("medoid", F.lit(False)).alias("medoid"))
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    queries = placed.where("home").select(*cell, each_part.alias("part"), block.alias("qblock"), F.lit(1).alias("role"), "node", "n", "v", F.array().cast("array<bigint>").alias("near"), F.lit(False).alias("medoid"))
    keys = [*inner, "qblock"]
    grouped = members.unionByName(queries).repartition(tasks, *keys).sortWithinPartitions(*keys)
    result = "node long, links long, root long, audited long, missed long"
    found = grouped.mapInPandas(by_group(keys, link_group(cosine)), result)
    # pairs of a home vector and one beyond the graph of its shard
    outer = cut(dealable.mapInPandas(lambda frames: assign(frames, True), member))
    if not outer.isEmpty():
        width = outer.groupBy(*cell).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        blocks = broadcast_if_small(cut(width.join(sizes.select(*cell, "blocks"), cell)), 64)
        compared = outer.join(blocks, cell).select(*cell, F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int").alias("part"), each_block.alias("qblock"), F.lit(0).alias("role"), "node", "n", "v")
        asking = placed.where("home").select(*cell, "node", "n", "v").join(blocks, cell).select(*cell, each_part.alias("part"), block.alias("qblock"), F.lit(1).alias("role"), "node", "n", "v")
        pairs = compared.unionByName(asking).repartition(tasks, *keys).sortWithinPartitions(*keys)
        found = found.union(pairs.mapInPandas(by_group(keys, exact_group(cosine)), result))
    return rows, nodes.select("node", "h1", "h2", "n", "least"), cut(found)


def audit(found: DataFrame) -> DataFrame:
    """One row (audited, missed, recall): of the links that brute force within shards finds for every twentieth query, those that searches miss."""
    sums = found.agg(F.coalesce(F.sum("audited"), F.lit(0)).alias("audited"), F.coalesce(F.sum("missed"), F.lit(0)).alias("missed"))
    return sums.withColumn("recall", F.when(F.col("audited") > 0, 1 - F.col("missed") / F.col("audited")).otherwise(1.0))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """id, n_links, component_id and kept for each row; linked rows have equal labels and a cosine of 0.98 or more.

    A vector that is null, empty, zero or holds null or non-finite components, and one with a null label, links with nothing.
    Vectors of different widths never link. Equal vectors of a label are one node with a count; a repeated row counts as another vector. A row
    with a null id has itself as component unless linked. Other columns are not read; an empty table gives an empty result. The
    audit of the searches is checked: a recall below LEAST_RECALL raises an error.
    """
    rows, nodes, found = linked_nodes(vectors, id_col, vec_col, label_col, cosine, shard)
    told = audit(found).first()
    if told["recall"] < LEAST_RECALL:
        raise RuntimeError(f"searches found {told['recall']:.3f} of {told['audited']} audited links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select("node", "root"), "node", "root")
    by_node = nodes.join(links, "node", "left").join(classes, "node", "left")
    by_node = by_node.select("h1", "h2", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    component = by_node.groupBy("root").agg(F.min("least").alias("component_id"))
    result = by_node.join(component, "root").select("h1", "h2", "n_links", "component_id")
    some = rows.where("h1 IS NOT NULL").join(result, ["h1", "h2"]).select("id", "n_links", "component_id")
    none = rows.where("h1 IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), "n_links", "component_id", F.expr("id IS NULL OR id = component_id").alias("kept"))
