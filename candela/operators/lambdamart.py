"""LambdaMART over a cluster: one barrier stage whose tasks keep their queries and share histograms.

A query's rows are in one task, so gradients need nobody else; for each level of each tree the tasks gather
sums by node, feature and bin, and all grow the same tree. Nothing but those sums moves while trees grow, and a lost task starts
the stage again.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import pickle
import secrets
import socket
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.session import importable

#: Most bins of a feature, and tasks that train: each gathers every task's sums.
BINS, TASKS = 256, 64
#: A pair counts if one of both is among so many first.
TOP = 32
#: Cells, which are places of groups, and rows, that are worked on at once; different values of a feature that are kept as codes.
CELLS, ROWS, CODES = 1 << 16, 1 << 16, 1 << 16
#: Most different rows of bins that features share a code for; cells of a table of those that were met.
MIXED, MET = 512, 1 << 23


@dataclass
class Trees:
    """Grown trees: for each, a list of nodes [feature, threshold, left, right, value, gain]; feature -1 is a leaf, smaller values go left."""

    features: list[str]
    nodes: list[list[list[float]]] = field(default_factory=list)
    history: list[dict[str, float]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, columns = np.zeros(len(x)), np.ascontiguousarray(x.T)
        for tree in self.nodes:
            out += _leaf_values(tree, columns)
        return out

    def column(self) -> Column:
        """The score of a row with these features."""
        trees = self

        @F.pandas_udf("double")
        def score(*columns):
            import pandas as pd

            return pd.Series(trees.predict(np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])))

        return score(*[F.col(f"`{f}`").cast("double") for f in self.features])

    def mean_gains(self) -> dict[str, float]:
        """The mean gain of each feature's splits; features without any are absent."""
        found: dict[str, list[float]] = {}
        for tree in self.nodes:
            for feature, _, _, _, _, gain in tree:
                if feature >= 0:
                    found.setdefault(self.features[int(feature)], []).append(gain)
        return {f: sum(v) / len(v) for f, v in found.items()}

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "nodes": self.nodes, "history": self.history})

    @staticmethod
    def from_json(text: str) -> Trees:
        return Trees(**json.loads(text))


def _leaf_values(tree: list[list[float]], columns: np.ndarray) -> np.ndarray | float:
    """The values of the leaves that rows reach, from the last nodes up, as a node's children come after it."""
    found: dict[int, np.ndarray | float] = {}
    for m in range(len(tree) - 1, -1, -1):
        feature, threshold, left, right, value, _ = tree[m]
        found[m] = value if feature < 0 else np.where(columns[int(feature)] < threshold, found.pop(int(left)), found.pop(int(right)))
    return found[0]


def joined(parts: list[np.ndarray], kind=float) -> np.ndarray:
    """One array of the parts, which go, and their memory with them."""
    out = np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    parts.clear()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    return out


class Values:
    """A feature's values as they come: codes of two bytes while they have CODES different values, else doubles."""

    def __init__(self):
        self.known, self.values, self.parts = {}, [], []

    @staticmethod
    def of(v: np.ndarray) -> Values:
        out = Values()
        for at in range(0, len(v), ROWS):
            out.add(v[at : at + ROWS])
        return out

    def add(self, v: np.ndarray) -> None:
        if self.known is not None:
            found, codes = np.unique(v, return_inverse=True)
            for x in found.tolist():
                if x not in self.known:
                    self.known[x] = len(self.values)
                    self.values.append(x)
            if len(self.values) <= CODES and not np.isnan(found[-1:]).any():
                self.parts.append(np.array([self.known[x] for x in found.tolist()], dtype=np.uint16)[codes])
                return
            table, self.known = np.array(self.values), None
            self.parts = [table[c] for c in self.parts]
        self.parts.append(np.array(v, dtype=float))

    def _joined(self) -> np.ndarray:
        if len(self.parts) != 1:
            self.parts = [joined(self.parts, np.uint16)]
        return self.parts[0]

    def summary(self, own: np.ndarray) -> np.ndarray:
        """The different values of these rows, or 4 * BINS of their quantiles."""
        v = self._joined()[own]
        if self.known is not None:
            table = np.array(self.values, dtype=float)
            found = np.unique(table[np.flatnonzero(np.bincount(v, minlength=len(table)))])
            v = found if len(found) <= 4 * BINS else table[v]
        else:
            found = np.unique(v)
        return found if len(found) <= 4 * BINS else np.quantile(v, np.linspace(0, 1, 4 * BINS), overwrite_input=True)

    def bins(self, cuts: np.ndarray) -> np.ndarray:
        """Each row's bin; the values go."""
        v, self.parts = self._joined(), []
        if self.known is not None:
            return np.searchsorted(cuts, np.array(self.values, dtype=float), side="right").astype(np.uint8)[v]
        out = np.empty(len(v), dtype=np.uint8)
        for at in range(0, len(v), ROWS):
            out[at : at + ROWS] = np.searchsorted(cuts, v[at : at + ROWS], side="right")
        return out


def narrow(v: np.ndarray) -> np.ndarray:
    """The same numbers in four bytes each, if these hold them."""
    with np.errstate(over="ignore"):
        small = v.astype(np.float32)
    return small if (small == v).all() else v


@dataclass
class Chunk:
    """Groups of about one size, beside one another as rows of cells. ideal: each group's best sums of gains by discount, of all places and of the first k."""

    at: int
    most: int
    sizes: np.ndarray
    ideal: np.ndarray

    def cells(self, a: np.ndarray) -> np.ndarray:
        return a[self.at : self.at + len(self.sizes) * self.most]

    def beyond(self) -> np.ndarray | None:
        """By group and place: cells that are beyond the group, if some are."""
        return None if self.sizes.min() == self.most else np.arange(self.most)[None, :] >= self.sizes[:, None]


def chunked(gain: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int = 10, at: int = 0) -> tuple[list[Chunk], np.ndarray, np.ndarray]:
    """The groups in chunks of CELLS cells at most, or of one group, each cell's row and its gain; the first is cell `at`.

    A tenth of a chunk at most is beyond its groups; these cells have a row and the least gain of their group.
    """
    groups, done, out, rows, gains = np.argsort(sizes, kind="stable")[::-1], 0, [], [], []
    while done < len(groups):
        most = max(1, int(sizes[groups[done]]))
        own = groups[done : done + max(1, CELLS // most)]
        own = own[: max(1, int((sizes[own] >= 0.9 * most).sum()))]
        row = starts[own][:, None] + np.minimum(np.arange(most)[None, :], sizes[own][:, None] - 1)
        y, beyond = gain[row], (c := Chunk(at, most, sizes[own], np.zeros((2, len(own))))).beyond()
        best = np.sort(y if beyond is None else np.where(beyond, -np.inf, y), axis=1)[:, ::-1].astype(float)
        if beyond is not None:
            best, y = np.where(beyond, 0.0, best), np.where(beyond, y.min(axis=1, keepdims=True), y)
        best *= _discounts(most)
        c.ideal[:] = best.sum(axis=1), best[:, :k].sum(axis=1)
        out.append(c)
        rows.append(row.reshape(-1).astype(np.int32 if len(gain) < 1 << 31 else np.int64))
        gains.append(y.reshape(-1))
        done, at = done + len(own), at + row.size
    return out, joined(rows, np.int32), joined(gains, gain.dtype)


class Scores:
    """Scores of cells, or of the codes that cells share."""

    def __init__(self, score: np.ndarray, codes: np.ndarray | None):
        self.score, self.codes = score, codes
        if codes is not None:
            # Each code's place among the different scores, the greatest first; cells beyond a group come after all.
            found, rank = np.unique(-score, return_inverse=True)
            self.levels, self.rank = np.append(-found, -np.inf), rank.astype(np.int32)

    def falling(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's cells and their scores by rank and group; equal scores stand in the rows' order."""
        beyond, first = c.beyond(), np.arange(len(c.sizes)) * c.most
        if self.codes is None:
            s = c.cells(self.score).reshape(-1, c.most)
            s = s if beyond is None else np.where(beyond, -np.inf, s)
            cell = np.ascontiguousarray(np.argsort(-s, axis=1, kind="stable").T) + first
            return cell, s.reshape(-1)[cell]
        # Ranks and places as one number sort faster than an argsort does.
        bits = max(1, c.most.bit_length())
        kind = np.int32 if len(self.levels) << bits < 1 << 31 else np.int64
        place = np.arange(c.most, dtype=kind)
        key = self.rank[c.cells(self.codes)].reshape(-1, c.most).astype(kind, copy=False)
        if beyond is not None:
            key[beyond] = len(self.levels) - 1
        key <<= bits
        key |= place
        key.sort(axis=1)
        key = np.ascontiguousarray(key.T)
        return (key & ((1 << bits) - 1)) + first, self.levels[key >> bits]


def _discounts(n: int) -> np.ndarray:
    return 1 / np.log2(np.arange(n) + 2.0)


def _ndcg(c: Chunk, gain: np.ndarray, k: int) -> float:
    """Of gains by rank and group."""
    y = np.where(np.arange(min(k, c.most))[:, None] < c.sizes, gain[:k].astype(float), 0.0)
    best = c.ideal[1]
    return float(np.where(best > 0, (y * _discounts(len(y))[:, None]).sum(axis=0) / np.where(best > 0, best, 1.0), 1.0).sum())


def _push(c: Chunk, s: np.ndarray, gain: np.ndarray, top: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives by rank and group, in floats of this kind, from scores and gains in that order. A rank's pairs are with those after it, and are made for one rank at a time, to the last that counts."""
    n, tiny = len(s), np.finfo(kind).tiny
    # 1 / (1 + exp(difference)) from both powers; 0 beyond a group, which so pushes nobody.
    power = np.exp(np.maximum(s - s[0], 0.9 * np.log(tiny)).astype(kind))
    if c.sizes.min() < n:
        power[~np.isfinite(s)] = 0
    worth = (gain / np.maximum(c.ideal[0], 1e-300)).astype(kind)
    at = _discounts(n)
    gaps = (at[: min(n, top), None] - at).astype(kind)
    g, h, total = np.zeros(s.shape, kind), np.zeros(s.shape, kind), np.zeros(s.shape[1])
    first, second, third = (np.empty(s.shape, kind) for _ in range(3))
    for i in range(min(n - 1, top)):
        push, behind, part = first[i + 1 :], second[i + 1 :], third[i + 1 :]
        # behind: how likely the lower is the better; push is positive where the higher one has more gain, and negative else.
        np.add(power[i + 1 :], power[i] + tiny, out=behind)
        np.divide(power[i + 1 :], behind, out=behind)
        np.subtract(worth[i], worth[i + 1 :], out=push)
        push *= gaps[i, i + 1 :, None]
        np.abs(push, out=part)
        part *= behind
        np.minimum(push, 0, out=push)
        push += part
        g[i] -= push.sum(axis=0)
        g[i + 1 :] += push
        np.abs(push, out=push)
        total += 2 * push.sum(axis=0)
        np.subtract(1, behind, out=behind)
        part *= behind
        h[i] += part.sum(axis=0)
        h[i + 1 :] += part
    scale = np.where(total > 0, np.log2(1 + total) / np.where(total > 0, total, 1.0), 0.0).astype(kind)
    g *= scale
    h *= 2 * scale
    return g, h


def derive(parts: list[Chunk], scores: Scores, gain: np.ndarray, g: np.ndarray | None, h: np.ndarray | None, k: int = 10, top: int = TOP) -> float:
    """Writes the derivatives by cell, if wanted, and returns the sum of NDCG@k over the groups, 1 for a group without gain."""
    total = 0.0
    for c in parts:
        cell, s = scores.falling(c)
        y = c.cells(gain)[cell]
        total += _ndcg(c, y, k)
        if g is not None:
            for out, own in zip((g, h), _push(c, s, y, top, g.dtype), strict=True):
                c.cells(out)[cell] = own
    return total


def gradients(score: np.ndarray, label: np.ndarray, starts: np.ndarray, sizes: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives by row, of pairs of a group with different labels.

    A pair weighs what its exchange would change in NDCG with gains 2**label - 1, and a group's
    sum is scaled to log2(1 + sum). Equal scores stand in the rows' order.
    """
    parts, rows, gain = chunked(2.0**label - 1, starts, sizes)
    g, h = np.zeros(len(rows)), np.zeros(len(rows))
    derive(parts, Scores(score[rows], None), gain, g, h, top=top)
    return tuple(np.bincount(rows, weights=a, minlength=len(score)) for a in (g, h))


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on the row's key and the salt alone."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) / float(1 << 53)


def best_splits(sums: np.ndarray, offsets: np.ndarray, columns: np.ndarray, penalty: float, least: float) -> list[tuple[float, int, int]]:
    """For each node the best (gain, feature, bin): bins up to it go left. sums: [2, nodes, all features' bins]; gain 0: no split."""
    best = [(0.0, -1, -1)] * sums.shape[1]
    score = lambda g, h: g * g / (h + penalty)
    for f in columns.tolist():
        g, h = sums[:, :, offsets[f] : offsets[f + 1]]
        gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        if not gl.shape[1]:
            continue
        gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
        gain = np.where((hl >= least) & (ht - hl >= least), score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht), 0.0)
        for m, (i, won) in enumerate(zip(gain.argmax(axis=1).tolist(), gain.max(axis=1).tolist(), strict=True)):
            if won > max(best[m][0], 1e-6):
                best[m] = (won, f, i)
    return best


@dataclass
class Mix:
    """Some features' bins as one code for each row. tables: the bin of each code, by feature."""

    codes: np.ndarray
    size: int
    tables: dict[int, np.ndarray]

    def add(self, f: int, bins: np.ndarray, count: int) -> bool:
        """Whether the feature is in it now: not if it would have over MIXED codes."""
        met, slices = np.zeros(self.size * count, dtype=bool), [slice(a, a + ROWS) for a in range(0, len(bins), ROWS)]
        for a in slices:
            met[self.codes[a].astype(np.int64) * count + bins[a]] = True
        found = np.flatnonzero(met)
        if len(found) > MIXED:
            return False
        number = (np.cumsum(met) - 1).astype(self.codes.dtype)
        for a in slices:
            self.codes[a] = number[self.codes[a].astype(np.int64) * count + bins[a]]
        self.tables = {k: t[found // count] for k, t in self.tables.items()} | {f: found % count}
        self.size = len(found)
        return True


def mixed(bins: list[np.ndarray], counts: list[int]) -> list[Mix]:
    """The features' bins in as few codes as it finds, those of fewest bins first. The bins go.

    A row's cell in a histogram is so found once for all features that share a code. Codes are a task's own; sums by bin come from those by code.
    """
    out: list[Mix] = []
    for f in np.argsort(counts, kind="stable").tolist():
        own, bins[f] = bins[f], None
        if counts[f] > MIXED // 4 or not len(own):
            out.append(Mix(own, counts[f], {f: np.arange(counts[f])}))
            continue
        shared = out[-1] if out and out[-1].codes.dtype == np.uint16 else None
        if shared is None or not shared.add(f, own, counts[f]):
            out.append(Mix(own.astype(np.uint16), counts[f], {f: np.arange(counts[f])}))
    return out


def shared(bins: list[np.ndarray], counts: list[int]) -> np.ndarray | None:
    """A code for each different row of bins, of which bins then has one each; None, and bins as they were, if over half of the rows are different.

    Rows with equal bins go the same way in every tree, so that their sums and scores are kept once.
    """
    n = len(bins[0])
    codes, size, tables = np.zeros(n, dtype=np.int32), 1, {}
    slices = [slice(a, a + ROWS) for a in range(0, n, ROWS)]
    for f in np.argsort(counts, kind="stable").tolist():
        count = counts[f]
        keys = ((a, codes[a].astype(np.int64) * count + bins[f][a]) for a in slices)
        if small := size * count <= MET:
            met = np.zeros(size * count, dtype=bool)
            for _, key in keys:
                met[key] = True
            found = np.flatnonzero(met)
        else:
            found, fresh, held = np.zeros(0, dtype=np.int64), [], 0
            for a, key in keys:
                fresh.append(np.unique(key))
                held += len(fresh[-1])
                if held >= max(len(found), 4 * ROWS) or a is slices[-1]:
                    found, fresh, held = np.unique(np.concatenate([found, *fresh])), [], 0
        if 2 * len(found) > n:
            return None
        number = np.cumsum(met, dtype=np.int32) - 1 if small else None
        for a in slices:
            key = codes[a].astype(np.int64) * count + bins[f][a]
            codes[a] = number[key] if small else np.searchsorted(found, key)
        tables, size = {k: t[found // count] for k, t in tables.items()} | {f: (found % count).astype(np.uint8)}, len(found)
    for f, t in tables.items():
        bins[f] = t
    return codes


class Peers:
    """What the tasks of a barrier stage exchange: each sends its part to the first, which answers all.

    The stage's own allGather waits a second each time, so it is used once, to tell the first task's port and a key that connections must show.
    """

    def __init__(self, context, wait: float = 600.0):
        infos, self.rank = context.getTaskInfos(), context.partitionId()
        self.count, self.to, server, said = len(infos), [], None, ""
        if not self.rank and self.count > 1:
            server = socket.create_server(("", 0), backlog=self.count)
            server.settimeout(wait)
            said = f"{server.getsockname()[1]}:{secrets.token_hex(16)}"
        port, _, key = context.allGather(said)[0].partition(":")
        if self.count == 1:
            return
        if self.rank:
            link = socket.create_connection((infos[0].address.rsplit(":", 1)[0], int(port)), timeout=wait)
            self.to = [link]
            self._send(link, f"{key}{self.rank}".encode())
            return
        found: dict[int, socket.socket] = {}
        while len(found) < self.count - 1:
            link = server.accept()[0]
            link.settimeout(wait)
            hello = self._receive(link).decode()
            if hello.startswith(key):
                found[int(hello[len(key) :])] = link
            else:
                link.close()
        self.to = [found[i] for i in range(1, self.count)]
        server.close()

    @staticmethod
    def _send(link: socket.socket, data: bytes) -> None:
        link.sendall(struct.pack("<Q", len(data)) + data)

    @staticmethod
    def _receive(link: socket.socket) -> bytes:
        def exactly(n: int) -> bytes:
            parts = []
            while n:
                part = link.recv(min(n, 1 << 20))
                if not part:
                    raise ConnectionError("a task of the stage is gone")
                parts.append(part)
                n -= len(part)
            return b"".join(parts)

        return exactly(struct.unpack("<Q", exactly(8))[0])

    def gather(self, a: np.ndarray) -> list[np.ndarray]:
        """All tasks' arrays, in their order."""
        if self.rank:
            self._send(self.to[0], np.ascontiguousarray(a, dtype=float).tobytes())
            return [np.frombuffer(x) for x in pickle.loads(self._receive(self.to[0]))]
        every = [np.ascontiguousarray(a, dtype=float).tobytes(), *map(self._receive, self.to)]
        for link in self.to:
            self._send(link, pickle.dumps(every))
        return [np.frombuffer(x) for x in every]

    def add(self, a: np.ndarray) -> np.ndarray:
        """The sum of all tasks' arrays."""
        a = np.ascontiguousarray(a, dtype=float)
        if self.rank:
            self._send(self.to[0], a.tobytes())
            return np.frombuffer(self._receive(self.to[0])).reshape(a.shape)
        total = a.copy()
        for link in self.to:
            total += np.frombuffer(self._receive(link)).reshape(a.shape)
        for link in self.to:
            self._send(link, total.tobytes())
        return total

    def close(self) -> None:
        for link in self.to:
            link.close()


class Alone:
    """Peers of a task that has none."""

    def gather(self, a: np.ndarray) -> list[np.ndarray]:
        return [a]

    def add(self, a: np.ndarray) -> np.ndarray:
        return a


def train(x: np.ndarray | list[Values], label: np.ndarray, starts: np.ndarray, sizes: np.ndarray, side: np.ndarray, keys: np.ndarray, peers: Peers | Alone, options: dict) -> Trees:
    """Trees from a task's rows and its peers'. side: 0 train, 1 validation, by group. x: rows of features, or a list of Values, which are used up."""
    return train_each(x, label, starts, sizes, side, keys, peers, options, [list(range(len(options["features"])))])[0]


def train_each(x: np.ndarray | list[Values], label: np.ndarray, starts: np.ndarray, sizes: np.ndarray, side: np.ndarray, keys: np.ndarray, peers: Peers | Alone, options: dict, subsets: list[list[int]]) -> list[Trees]:
    """Trees for each subset of the features, the same as from rows of these alone, since a feature's bins depend on no other.

    Beside a byte for each feature, a row takes some 35 bytes, and some 40 more for each different row of bins; what is worked out of them is made for some ROWS rows or CELLS cells at a time.
    """
    o, own = options, np.repeat(side, sizes) == 0
    x = x if isinstance(x, list) else [Values.of(x[:, f]) for f in range(x.shape[1])]
    bins, counts, cuts = [], [], []
    while x:
        values = x.pop(0)
        v = np.unique(np.concatenate(peers.gather(values.summary(own))))
        cuts.append(v[1:] if len(v) <= BINS else np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])))
        counts.append(len(cuts[-1]) + 1)
        bins.append(values.bins(cuts[-1]))
        del values
    gain = narrow(2.0 ** label.astype(float) - 1)
    del label, own
    # From here on all is by cell, and a chunk's cells are beside one another.
    learns, rows, gains = chunked(gain, starts[side == 0], sizes[side == 0], o["k"])
    held, more, others = chunked(gain, starts[side == 1], sizes[side == 1], o["k"], len(rows))
    rows, gain = joined([rows, more]), joined([gains, others])
    del more, gains, others
    keys = keys[rows]
    for f in range(len(bins)):
        bins[f] = bins[f][rows]
    del rows
    found = []
    for i, of in enumerate(subsets):
        some = [bins[f] for f in of]
        if i + 1 == len(subsets):
            bins.clear()
        found.append(_grown(some, [counts[f] for f in of], [cuts[f] for f in of], gain, learns, held, side, keys, peers, o | {"features": [o["features"][f] for f in of]}))
    return found


def _grown(bins: list[np.ndarray], counts: list[int], cuts: list[np.ndarray], gain: np.ndarray, learns: list[Chunk], held: list[Chunk], side: np.ndarray, keys: np.ndarray, peers: Peers | Alone, o: dict) -> Trees:
    width, codes = len(bins), shared(bins, counts)
    # Trees grow on n different rows of bins, each with the sums of its cells, or on the cells.
    n, cells = len(bins[0]), len(gain)
    offsets, mixes = np.concatenate([[0], np.cumsum(counts)]), mixed(bins, counts)
    # Which of its features' bins each code has, beside one another; None: its only feature's bins are its codes.
    spread = [np.concatenate([t[:, None] == np.arange(counts[f]) for f, t in m.tables.items()], axis=1).astype(float) if len(m.tables) > 1 else None for m in mixes]
    where = [np.concatenate([np.arange(offsets[f], offsets[f + 1]) for f in m.tables]) for m in mixes]
    slices = [slice(a, min(n, a + ROWS)) for a in range(0, n, ROWS)]
    score, trees = np.zeros(n), Trees(list(o["features"]))
    pushed = np.zeros((2, cells), dtype=np.float32)
    weights = pushed if codes is None else np.zeros((2, n))
    derive(learns, Scores(score, codes), gain, *pushed, o["k"])
    for r in range(o["rounds"]):
        # Rows that aren't drawn push nothing; rows of the other side never do.
        if codes is not None:
            weights[:] = 0
        for a in (slice(a, min(cells, a + 4 * ROWS)) for a in range(0, cells, 4 * ROWS)):
            drawn = _uniform(keys[a], o["seed"] * 100_003 + r) < o["subsample"]
            pushed[:, a] *= drawn
            if codes is not None:
                own = codes[a].astype(np.int64)
                for w in range(2):
                    weights[w] += np.bincount(own, weights=pushed[w, a], minlength=n)
        columns = np.sort(np.random.default_rng([o["seed"], r]).permutation(width)[: max(1, int(o["columns"] * width + 1e-9))])
        used = [m for m in range(len(mixes)) if any(f in mixes[m].tables for f in columns.tolist())]
        nodes, node, level, ends = [[-1, 0.0, 0, 0, 0.0, 0.0]], np.zeros(n, dtype=np.uint8 if o["depth"] < 7 else np.int32), [0], None
        for depth in range(o["depth"] + 1):
            splits = [(0.0, -1, -1)] * len(level)
            if depth < o["depth"] or ends is None:
                # Rows whose node is grown are in a slot of their own.
                slot = np.full(len(nodes), len(level))
                slot[level] = np.arange(len(level))
                by_code = [np.zeros((2, len(level) + 1, m.size)) for m in mixes]
                for a in slices:
                    at = slot[node[a]]
                    for m in used:
                        cell = at * mixes[m].size
                        cell += mixes[m].codes[a]
                        for w, weight in enumerate(weights):
                            by_code[m][w] += np.bincount(cell, weights=weight[a], minlength=by_code[m][w].size).reshape(by_code[m][w].shape)
                sums = np.zeros((2, len(level), offsets[-1]))
                for m in used:
                    # No product of matrices: it would start threads beside the tasks.
                    sums[:, :, where[m]] = by_code[m][:, :-1] if spread[m] is None else np.einsum("wlc,cb->wlb", by_code[m][:, :-1], spread[m])
                sums = peers.add(sums)
                if ends is None:
                    ends = sums[:, :, offsets[columns[0]] : offsets[columns[0] + 1]].sum(axis=2)
                if depth < o["depth"]:
                    splits = best_splits(sums, offsets, columns, o["penalty"], o["least"])
            deeper, parted, below = [], [], []
            for i, (m, (won, f, b)) in enumerate(zip(level, splits, strict=True)):
                if f < 0:
                    nodes[m][4] = float(-ends[0, i] / (ends[1, i] + o["penalty"]) * o["rate"])
                    continue
                left, right = len(nodes), len(nodes) + 1
                nodes[m] = [f, float(cuts[f][b]), left, right, 0.0, won]
                nodes += [[-1, 0.0, 0, 0, 0.0, 0.0], [-1, 0.0, 0, 0, 0.0, 0.0]]
                parted.append((i, m, f, b, left))
                deeper += [left, right]
                smaller = sums[:, i, offsets[f] : offsets[f] + b + 1].sum(axis=1)
                below += [smaller, ends[:, i] - smaller]
            if parted:
                below_of, turns = np.arange(len(slot)), {}
                for i, m, f, b, left in parted:
                    below_of[m] = left
                    k = next(k for k in used if f in mixes[k].tables)
                    turns.setdefault(k, np.zeros((len(level) + 1, mixes[k].size), dtype=bool))[i] = mixes[k].tables[f] > b
                for a in slices:
                    at, to = slot[node[a]], below_of[node[a]]
                    for k, turn in turns.items():
                        cell = at * mixes[k].size
                        cell += mixes[k].codes[a]
                        to += turn.reshape(-1)[cell]
                    node[a] = to
            level, ends = deeper, np.array(below).T
            if not level:
                break
        trees.nodes.append(nodes)
        grown = np.array([m[4] for m in nodes])
        for a in slices:
            score[a] += grown[node[a]]
        # The ranks that the metric needs are those of the next round's derivatives.
        scores, out = Scores(score, codes), pushed if r + 1 < o["rounds"] else (None, None)
        sums = peers.add(np.array([[derive(learns, scores, gain, *out, o["k"]), (side == 0).sum()], [derive(held, scores, gain, None, None, o["k"]), (side == 1).sum()]], dtype=float))
        trees.history.append({name: float(sums[i, 0] / sums[i, 1]) for i, name in enumerate(("train", "validation")) if sums[i, 1]})
    return trees


def fit(df: DataFrame, features: list[str], label: str = "relevance_gain", side: str = "_side", tasks: int | None = None, rounds: int = 200, depth: int = 4, rate: float = 0.1, subsample: float = 0.8, columns: float = 0.8, seed: int = 0, penalty: float = 1.0, least: float = 1.0, k: int = 10, subsets: list[list[str]] | None = None) -> Trees | list[Trees]:
    """Trees for df, or those for each subset of the features, for which the rows are dealt once: query_id, example_id, the features, label and side (0: learnt from, 1: evaluated alone).

    Training rows are in `tasks` tasks that run at once (the session's cores, TASKS at most), each with whole queries in memory, as bins and sums.
    Rows are drawn by their example_id, columns by the round, so that nothing depends on the table's order. NaN goes right. A null query_id is a query.
    """
    spark = df.sparkSession
    importable(spark)
    tasks = tasks or max(1, min(TASKS, spark.sparkContext.defaultParallelism))
    chosen = [[features.index(f) for f in of] for of in subsets or [features]]
    options = {"features": list(features), "rounds": rounds, "depth": depth, "rate": rate, "subsample": subsample, "columns": columns, "seed": seed, "penalty": penalty, "least": least, "k": k}
    rows = df.select(
        F.concat(F.col(side).cast("string"), F.lit(":"), F.coalesce(F.col("query_id").cast("string"), F.lit(""))).alias("group"),
        F.xxhash64(F.col("example_id").cast("string")).alias("key"),
        F.col(side).cast("int").alias("side"),
        F.col(label).cast("double").alias("label"),
        *[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)],
    )

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import BarrierTaskContext

        from candela.operators import lambdamart

        context = BarrierTaskContext.get()

        peers = lambdamart.Peers(context)
        x, names, sizes, side = [lambdamart.Values() for _ in options["features"]], [], [], []
        label, keys = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Runs of a group, of which a batch may end in the middle.
            runs = pc.run_end_encode(batch.column("group"))
            ends = runs.run_ends.to_numpy()
            first = np.concatenate([[0], ends[:-1]])
            for name, size, own in zip(runs.values.to_pylist(), (ends - first).tolist(), batch.column("side").to_numpy()[first].tolist(), strict=True):
                if names[-1:] == [name]:
                    sizes[-1] += size
                else:
                    names[-1:] = [name]
                    sizes.append(size)
                    side.append(own)
            label.append(lambdamart.narrow(batch.column("label").to_numpy()))
            keys.append(batch.column("key").to_numpy().copy())
            for f, values in enumerate(x):
                values.add(batch.column(f"x{f}").to_numpy(zero_copy_only=False).astype(float))
        label, keys, sizes = lambdamart.joined(label), lambdamart.joined(keys, np.int64), np.array(sizes, dtype=np.int64)
        try:
            found = lambdamart.train_each(x, label, np.cumsum(sizes) - sizes, sizes, np.array(side, dtype=np.int64), keys, peers, options, chosen)
        finally:
            peers.close()
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"model": [t.to_json() for t in found]})

    dealt = rows.repartition(tasks, "group").sortWithinPartitions("group", "key", "label")
    found = [Trees.from_json(r[0]) for r in dealt.mapInArrow(run, "model string", barrier=True).collect()]
    return found[0] if subsets is None else found
