"""Approximate nearest neighbours over learned partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.llm.common import importable, written

#: Rows that a router learns from, neighbours of each in the graph, rows that a partition is meant to hold, most partitions of one router.
SAMPLE, NEIGHBOURS, HELD, FAN = 8192, 10, 256, 256
#: Share of the sample's neighbours that a router's most probable partitions must hold. They are farther apart than the table's.
REACH = 0.93
#: Most rows and queries that are compared at once, the rows that blocks of a small table have at least, and blocks that a table is dealt into if it can.
ROWS, QUERIES, FEWEST, BLOCKS = 65_536, 65_536, 1024, 64
#: Distances, places of routes and routed rows that a task holds at once; equal vectors that are listed by hash.
CELLS, PLACES, ROUTED, ALIKE = 1 << 21, 1 << 20, 1 << 14, 50_000
HIDDEN, EPOCHS, SEED = 128, 30, 7


@dataclass
class Router:
    """A small network that gives each vector the partitions it most probably belongs to."""

    weights: list[np.ndarray]
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest others, in blocks."""
    norms, out = (x * x).sum(axis=1), []
    for at in range(0, len(x), 256):
        d = norms[None, :] - 2 * x[at : at + 256] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A partition of the neighbour graph into parts of nearly one size with few edges between them.

    It begins with halves along the direction of most spread, again and again; then vertices
    move to the part with most of their neighbours, those that gain most first, while a part has room.
    """
    label, groups = np.zeros(len(x), dtype=np.int64), [np.arange(len(x))]
    while len(groups) < parts:
        i = max(range(len(groups)), key=lambda j: len(groups[j]))
        own = groups.pop(i)
        z = x[own] - x[own].mean(axis=0)
        v = np.linalg.eigh(z.T @ z)[1][:, -1]
        order = own[np.argsort(z @ v, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for k, own in enumerate(groups):
        label[own] = k
    edges = np.concatenate([np.column_stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])] * 2)
    edges[len(edges) // 2 :] = edges[len(edges) // 2 :, ::-1]
    most = int(np.ceil(1.15 * len(x) / parts))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), dtype=np.int32)
        np.add.at(votes, (edges[:, 0], label[edges[:, 1]]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        room = most - np.bincount(label, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable")[: (gain > 0).sum()].tolist():
            if room[best[v]] > 0:
                room[best[v]] -= 1
                room[label[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


def train(x: np.ndarray, label: np.ndarray, parts: int) -> list[np.ndarray]:
    """A network with one hidden layer, by Adam on the cross-entropy."""
    rng, n = np.random.default_rng(SEED), len(x)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            own = order[at : at + 256]
            a = x[own] @ w[0] + w[1]
            h = np.maximum(a, 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), label[own]] -= 1
            p /= len(own)
            back = (p @ w[2].T) * (a > 0)
            t += 1
            for i, g in enumerate((x[own].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def learn(sample: np.ndarray, rows: int, reach: float = REACH, fan: int = FAN) -> Router:
    """A router for so many rows from a sample of their vectors: a partition for each HELD rows, as far as the sample tells them apart."""
    x = np.unique(sample, axis=0)
    parts = int(min(-(-rows // HELD), fan, max(1, len(x) // 16)))
    if parts < 2:
        return Router([np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    graph = neighbours(x, min(NEIGHBOURS, len(x) - 1))
    router = Router(train(x, balanced(x, graph, parts), parts))
    order = np.argsort(-router.logits(x), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(parts), order.shape), axis=1)
    reached = np.sort(place[np.arange(len(x))[:, None], order[:, 0][graph]].ravel())
    router.probes = parts if reach >= 1 else int(reached[int(np.ceil(reach * len(reached))) - 1]) + 1
    router.weights = [w.astype(np.float32) for w in router.weights]
    return router


@dataclass
class Tree:
    """Routers of one or two levels: the first deals vectors out over partitions, of which large ones have a router of their own.

    Partitions are numbered part * fan + part within the part. Its size is bounded: fan + 1 routers.
    """

    first: Router
    second: dict[int, Router]
    fan: int = FAN

    def home(self, x: np.ndarray) -> np.ndarray:
        out = self.first.home(x) * self.fan
        for p in np.unique(out // self.fan).tolist():
            if p in self.second:
                own = out // self.fan == p
                out[own] += self.second[p].home(x[own])
        return out

    def dense(self, counts: dict[int, int]) -> np.ndarray:
        """Rows by first and second part."""
        out = np.zeros((self.first.parts, self.fan), dtype=np.int64)
        for part, n in counts.items():
            out[part // self.fan, part % self.fan] = n
        return out

    def routes(self, x: np.ndarray, counts: dict[int, int] | np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and partitions that they go to: as many of the most probable as each router probes, and more until these hold over k rows.

        counts: rows by partition, or dense() of them.
        """
        counts = counts if isinstance(counts, np.ndarray) else self.dense(counts)
        rows, parts = [], []
        z = self.first.logits(x)
        order = np.argsort(-z, axis=1, kind="stable")
        held = counts.sum(axis=1)
        need = (np.cumsum(held[order], axis=1) <= k).sum(axis=1) + 1
        goes = np.arange(self.first.parts)[None, :] < np.maximum(self.first.probes, need)[:, None]
        i, j = np.nonzero(goes)
        p = order[i, j]
        for part in np.unique(p).tolist():
            own = i[p == part]
            if part not in self.second:
                if counts[part, 0]:
                    rows.append(own)
                    parts.append(np.full(len(own), part * self.fan))
                continue
            sub = self.second[part]
            inner = np.argsort(-sub.logits(x[own]), axis=1, kind="stable")
            n = counts[part, : sub.parts]
            need = (np.cumsum(n[inner], axis=1) <= k).sum(axis=1) + 1
            a, b = np.nonzero(np.arange(sub.parts)[None, :] < np.maximum(sub.probes, need)[:, None])
            c = inner[a, b]
            some = n[c] > 0
            rows.append(own[a[some]])
            parts.append(part * self.fan + c[some])
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate(rows or [none]), np.concatenate(parts or [none])


@dataclass
class Blocks:
    """Partitions packed into blocks of a bounded number of rows, so that a query goes to a block once, whatever partitions of it it asks.

    A partition of more rows is dealt over several blocks of its own.
    """

    parts: np.ndarray
    block: np.ndarray
    place: np.ndarray
    split: np.ndarray
    starts: np.ndarray
    blocks: np.ndarray

    @staticmethod
    def pack(counts: dict[int, int], most: int) -> Blocks:
        parts = np.array(sorted(counts), dtype=np.int64)
        block, place, split, starts, blocks = [], [], [], [], []
        at, room = 0, 0
        for i, part in enumerate(parts.tolist()):
            n, new = counts[part], counts[part] > room
            if new:
                starts.append(i)
                blocks.append(at)
                split.append(-(-n // most))
                at, room = at + split[-1], most - n if n <= most else 0
            else:
                split.append(1)
                room -= n
            block.append(blocks[-1])
            place.append(i - starts[-1])
        # The end of the last.
        return Blocks(parts, *(np.array(v, dtype=np.int64) for v in (block, place, split, [*starts, len(parts)], [*blocks, at])))

    def step(self) -> int:
        """Queries that are routed at once."""
        return int(max(1, min(PLACES // max(1, len(self.parts)), ROUTED // max(1, self.blocks[-1]))))

    def asked(self, rows: np.ndarray, parts: np.ndarray, n: int):
        """Of routes of n queries: (queries, block, a bit for each of its partitions)."""
        goes = np.zeros((n, len(self.parts)), dtype=bool)
        goes[rows, np.searchsorted(self.parts, parts)] = True
        for a, e, first, end in zip(self.starts[:-1], self.starts[1:], self.blocks[:-1], self.blocks[1:], strict=True):
            own = np.flatnonzero(goes[:, a:e].any(axis=1))
            if len(own):
                bits = np.packbits(goes[own, a:e], axis=1)
                for block in range(first, end):
                    yield own, block, bits


def matrix(vectors) -> np.ndarray:
    """Arrow's lists of one length as rows of doubles."""
    import pyarrow as pa

    one = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if isinstance(one, pa.ChunkedArray):
        one = pa.concat_arrays(one.chunks)
    return one.flatten().to_numpy(zero_copy_only=False).reshape(len(one), -1).astype(float)


def closest(ids: np.ndarray, x: np.ndarray, bounds: np.ndarray, names: np.ndarray, y: np.ndarray, bits: np.ndarray, k: int):
    """Each query's k nearest rows of the partitions that it asks: (places of queries, ids, distances). Rows lie by partition, bits say which a query asks."""
    norms, by_id = (x * x).sum(axis=1), np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[by_id], names, side) for side in ("left", "right"))
    kk, step = min(k, len(x)), max(1, CELLS // len(x))
    for at in range(0, len(y), step):
        z, goes = y[at : at + step], bits[at : at + step]
        own_norms = (z * z).sum(axis=1)
        d = np.full((len(z), len(x)), np.inf)
        for p, (a, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            asks = np.flatnonzero(goes[:, p])
            if a < e and len(asks):
                d[asks, a:e] = norms[None, a:e] + own_norms[asks, None] - 2 * z[asks] @ x[a:e].T
        for i in np.flatnonzero(high[at : at + step] > low[at : at + step]).tolist():
            d[i, by_id[low[at + i] : high[at + i]]] = np.inf
        # All that might tie with the last one, then exactly.
        limit = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        limit = limit + 1e-9 * (1 + np.abs(limit) + own_norms + norms.max())
        i, j = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        exact = np.empty(len(i))
        for b in range(0, len(i), 1 << 16):
            exact[b : b + (1 << 16)] = np.sqrt(((x[j[b : b + (1 << 16)]] - z[i[b : b + (1 << 16)]]) ** 2).sum(axis=1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield at + i[first], ids[j[first]], exact[first]


def usable(vector: Column) -> Column:
    """Whether a vector is there, not all zero, and all its components are finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _fit(vectors: DataFrame, rows: int, reach: float) -> list:
    """Rows (part, size, router) learnt where the sample is: vectors has part and embedding, SAMPLE rows of a part at most."""

    fan = FAN

    def fit(pdf):
        import pickle

        import pandas as pd

        from candela.llm import ann

        sizes = [len(v) for v in pdf["embedding"]]
        size = max(sorted(set(sizes)), key=sizes.count)
        x = np.array([v for v in pdf["embedding"] if len(v) == size], dtype=float)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "size": [size], "router": [pickle.dumps(ann.learn(x, int(pdf["rows"].iloc[0]), reach, fan))]})

    return vectors.groupBy("part").applyInPandas(fit, "part int, size int, router binary").collect()


def _homes(rows: DataFrame, home) -> DataFrame:
    """vec_id, embedding and part, which home() gives for a matrix of vectors."""
    kind = rows.schema["embedding"].dataType.simpleString()

    def homes(batches):
        import pyarrow as pa

        from candela.llm import ann

        for b in batches:
            if b.num_rows:
                part = pa.array(home(ann.matrix(b.column("embedding"))), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), part], ["vec_id", "embedding", "part"])

    return rows.select("vec_id", "embedding").mapInArrow(homes, f"vec_id long, embedding {kind}, part int")


def grow(candidates: DataFrame, reach: float = REACH) -> tuple[Tree, int] | None:
    """The routers of a table (vec_id, embedding) and the length of its vectors; None for an empty table.

    The first is learnt from SAMPLE rows by least hash. Where the table has more rows than FAN partitions should hold, each partition's own router
    is learnt from SAMPLE of its rows, about, in a task of its own.
    """
    import pickle

    total = candidates.count()
    hashed = F.xxhash64("vec_id")
    sample = candidates.orderBy(hashed, "vec_id").limit(SAMPLE).select(F.lit(0).alias("part"), F.lit(total).alias("rows"), "embedding")
    found = _fit(sample, total, reach)
    if not found:
        return None
    size, tree = found[0]["size"], Tree(pickle.loads(found[0]["router"]), {}, FAN)
    if total > FAN * HELD and tree.first.parts > 1:
        # Homes are worked out twice, which is less than to keep all vectors for the second time.
        placed = _homes(candidates.filter(F.size("embedding") == size), tree.first.home)
        sums = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
        large = {p: n for p, n in sums.items() if n > 2 * HELD}
        share = F.create_map(*[x for p, n in large.items() for x in (F.lit(p), F.struct(F.lit(n).alias("n"), F.lit(min(1.0, SAMPLE / n)).alias("f")))]) if large else None
        if large:
            own = F.try_element_at(share, "part")
            picked = placed.withColumn("_own", own).filter((F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) / float(1 << 30)) < F.col("_own.f"))
            tree.second = {r["part"]: pickle.loads(r["router"]) for r in _fit(picked.select("part", F.col("_own.n").alias("rows"), "embedding"), total, reach)}
    return tree, size


def _fewer(candidates: DataFrame, k: int) -> DataFrame:
    """candidates without those that k + 1 of smaller ids equal. Hashes are counted before any vector moves."""
    by = [F.xxhash64(F.lit(i), "embedding").alias(f"_h{i}") for i in (1, 2)]
    many = candidates.select(*by).groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).filter(F.col("_n") > k + 1).select("_h1", "_h2").limit(ALIKE + 1).collect()
    if not many:
        return candidates
    named = candidates.select("*", *by)
    first = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("vec_id"))).filter(F.col("_n") <= k + 1).select("vec_id", "embedding")
    if len(many) > ALIKE:
        return first(named)
    hot = F.broadcast(candidates.sparkSession.createDataFrame(many, "_h1 long, _h2 long"))
    return named.join(hot, ["_h1", "_h2"], "left_anti").select("vec_id", "embedding").unionByName(first(named.join(hot, ["_h1", "_h2"], "left_semi")))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10, reach: float = REACH) -> DataFrame:
    """Each query's k nearest candidates by Euclidean distance: query_id, rank, vec_id, score.

    queries, candidates: vec_id, embedding. A candidate with the query's own id isn't compared. A
    neighbour graph of a sample is cut into balanced partitions and a small network
    learns them, on two levels for large tables (grow()); every candidate goes to its most probable one, every query to as many of the most probable as
    reached `reach` of the sample's neighbours, and to more while they hold k others or fewer; reach=1 compares all, which is exact. Partitions lie in
    blocks of ROWS rows at most, and a query goes to a block once, with a bit for each partition. There
    all distances are computed in double precision on the original vectors; ties go to the smaller
    vec_id. Of candidates with one vector the k + 1 of smallest ids alone can be among a query's k, so the others go first, and a vector that
    a third of all rows share is no large partition.

    Unusable vectors, null ids and vectors of another length than most of the sample take no part. Repeated
    candidates count each; a repeated query is answered once. No candidates: no rows.
    """
    spark = candidates.sparkSession
    importable(spark)
    # Floats move as such and are doubles where they are compared.
    kind = "array<float>" if all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (candidates, queries)) else "array<double>"
    own = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind)).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    candidates, queries = own(candidates), own(queries).dropDuplicates(["vec_id"])
    schema = "query_id long, rank int, vec_id long, score double"
    grown = grow(candidates, reach)
    if grown is None:
        return spark.createDataFrame([], schema)
    tree, size = grown
    candidates, queries = (df.filter(F.size("embedding") == size) for df in (candidates, queries))
    # At most (FAN + 1) routers of some 100 kB.
    shared = spark.sparkContext.broadcast(tree)
    placed = written(_homes(_fewer(candidates, k), lambda x: shared.value.home(x)), "placed")
    # One number for each partition, FAN * FAN at most.
    held = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total, asks = sum(held.values()), queries.count()
    if not total or not asks:
        return spark.createDataFrame([], schema)
    blocks = Blocks.pack(held, int(min(ROWS, max(FEWEST, -(-total // BLOCKS)))))
    dealt = spark.sparkContext.broadcast((blocks, tree.dense(held)))
    chunks = -(-asks // QUERIES)

    def routes(batches):
        import pyarrow as pa

        blocks, counts = dealt.value
        step = blocks.step()
        for b in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            rows, parts = shared.value.routes(matrix(b.column("embedding")), counts, k)
            for own, block, bits in blocks.asked(rows, parts, b.num_rows):
                part = b.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array(np.full(len(own), block), pa.int32()), pa.array([r.tobytes() for r in bits], pa.binary())], ["vec_id", "embedding", "block", "bits"])

    asked = queries.mapInArrow(routes, f"vec_id long, embedding {kind}, block int, bits binary")
    names = spark.createDataFrame(list(zip(blocks.parts.tolist(), blocks.block.tolist(), blocks.place.tolist(), blocks.split.tolist(), strict=True)), "part int, _b int, place int, _n int")
    mine = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id")), n).cast("int")
    left = placed.join(F.broadcast(names), "part").select("vec_id", "embedding", (F.col("_b") + mine(1, F.col("_n"))).alias("block"), F.lit(None).cast("binary").alias("bits"), "place", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("q"))
    right = asked.select("vec_id", "embedding", "block", "bits", F.lit(-1).alias("place"), mine(2, F.lit(chunks)).alias("q"))

    def compare(table):
        import pyarrow as pa

        from candela.llm import ann

        place, out = table.column("place").to_numpy(), []
        rows, asks = table.take(pa.array(np.argsort(place, kind="stable")[(place < 0).sum() :])), table.take(pa.array(np.flatnonzero(place < 0)))
        if rows.num_rows and asks.num_rows:
            bits = np.frombuffer(b"".join(asks.column("bits").to_pylist()), dtype=np.uint8).reshape(asks.num_rows, -1)
            place = rows.column("place").to_numpy()
            bounds = np.searchsorted(place, np.arange(place[-1] + 2))
            names = asks.column("vec_id").to_numpy()
            found = ann.closest(rows.column("vec_id").to_numpy(), ann.matrix(rows.column("embedding")), bounds, names, ann.matrix(asks.column("embedding")), np.unpackbits(bits, axis=1), k)
            out = [(names[i], ids, far) for i, ids, far in found]
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3)]
        return pa.table([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    every = left.unionByName(right).repartition(int(min(4096, blocks.blocks[-1] * chunks)), "block", "q")
    found = every.groupBy("block", "q").applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
