"""Exact n-gram Jaccard join of whole texts, with set relations to skip work.

Documents with the same set are one class. A class can be linked only if enough of its sets' least hashes
are in other sets too; the few that pass get exact token frequencies, and their rarest tokens make an
inverted index. Its lists are kept in blocks by set size, and a block is compared only with blocks whose
sizes can match. Short blocks are compared whole; in a long block every set meets a few pivots first, sets that the
links found connect need no more, and the others' answers are derived from those of one set that the block's sets
are much like, by what each set lacks of it and has beside it.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.llm.common import cut, importable, row_keys, whole
from candela.llm.components import components
from candela.llm.memory import claim, trim
from candela.llm.urls import BlockedBloom

WORDS = 5
#: Links: PERCENT of 100 * shared / united.
PERCENT = 75
#: Longest block that is compared whole; pivots of a longer one.
WHOLE, PIVOTS = 24, 8
#: Tokens of the sets of a long block that ask, and of all, in one task, and how many such sets.
FEW, ALL, FEW_SETS, ALL_SETS = 200_000, 800_000, 2000, 8000
#: Tokens, and rows, that a worker holds before it deals them out.
HELD, MOST_SETS = 500_000, 60_000
#: Lists that are broadcast by name at most, and sets of the least of them.
HOT, LEAST_HOT = 50_000, 500
#: Parts that the sets of a long list are dealt over.
SALTS = 16
#: Characters of texts whose tokens one task counts at most, about; more shuffle partitions than that asks for are kept.
CHARS = 20_000_000
#: Words that a worker remembers the hashes of.
KNOWN = 200_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()


def _start() -> None:
    """At a task's start: other operators' memory in this worker goes."""
    claim("shingles", _HASHES.clear)


def _end() -> None:
    """At a task's end: this operator's memory goes, too."""
    _HASHES.clear()
    trim()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text: ascending 64-bit hashes of its runs of `words` words, A-Z lower-cased.

    A shorter text is one run; a null one, or one without words, has none.
    """
    hashed = np.array(list(map(_HASHES.__getitem__, (text or "").encode().lower().split())), dtype=np.uint64)
    n = len(hashed)
    if not n:
        return hashed
    wide = min(n, words)
    with np.errstate(over="ignore"):
        out = np.full(n - wide + 1, np.uint64(wide) * _MIX[7], dtype=np.uint64)
        for i in range(wide):
            out = (out ^ hashed[i : n - wide + 1 + i]) * _MIX[i % 5]
            out ^= out >> np.uint64(31)
        out = (out ^ (out >> np.uint64(29))) * _MIX[5]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def needed(n: int | np.ndarray, percent: int = PERCENT):
    """Tokens of n that a linked set shares at least."""
    return -(-percent * n // 100)


def _spare(n):
    """How many shared tokens the least hashes must show beyond the one that any link shows."""
    return 1 + n // 20


#: Who has a token, in two bytes: a set of the block, or several.
_SEVERAL = 0xFFFF


@dataclass
class _Dealer:
    """Sets in a worker's hands: deals their different tokens over `parts` and keeps what names the sets.

    Rows of equal sets are one set, and of each block a token moves once, however many of its sets have it: what a third of all
    documents share comes to one place once for each block, not for each document.
    """

    parts: int
    part: int
    wide: bool

    def __post_init__(self):
        self.block = 0
        self._clear()

    def _clear(self):
        self.sets, self.names, self.known, self.size = [], [], {}, 0

    def add(self, tokens: np.ndarray, key: bytes | None, name: tuple) -> bool:
        """Whether it is time to flush. key: the same for equal sets; None for a set without tokens."""
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.sets)
            self.sets.append(tokens)
            self.size += len(tokens)
        self.names.append((*name, at))
        return self.size >= HELD or len(self.names) >= MOST_SETS

    def flush(self):
        import pandas as pd

        columns = ["p", "blk", "at", "tokens", "counts", "names"]
        if not self.names:
            return pd.DataFrame(columns=columns)
        blk = (self.part << 24) + self.block
        tokens = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets), dtype=np.uint32), [len(s) for s in self.sets])
        order = np.argsort(tokens)
        place = (tokens % np.uint64(self.parts)).astype(np.uint16 if self.parts < 65_536 else np.uint32)
        order = order[np.argsort(place[order], kind="stable")]
        tokens, owner, place = tokens[order], owner[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, dtype=np.int64)
        many = np.diff(np.append(first, len(tokens)))
        several = np.repeat(many > 1, many)
        # Sets that share tokens within the block: how many each shares (narrow), or which sets have each such token (wide).
        if self.wide:
            own = np.where(many > 1, len(self.sets) + np.cumsum(many > 1) - 1, owner[first]).astype(np.uint32)
            within = owner[several].astype(np.uint16).tobytes(), many[many > 1].astype(np.uint32).tobytes()
            kept, counts = tokens[first], many.astype(np.uint32)
        else:
            own = np.where(many > 1, _SEVERAL, owner[first]).astype(np.uint16)
            within = np.bincount(owner[several], minlength=len(self.sets)).astype(np.uint32).tobytes(), b""
            kept, counts = (tokens[first] >> np.uint64(32)).astype(np.uint32), None
        ends, rows = np.searchsorted(place[first], np.arange(self.parts + 1)), []
        for p in range(self.parts):
            a, b = ends[p], ends[p + 1]
            if a < b:
                rows.append((p, blk, own[a:b].tobytes(), kept[a:b].tobytes(), None if counts is None else counts[a:b].tobytes(), None))
        rows.append((self.parts + blk % self.parts, blk, None, None, None, pickle.dumps((self.names, len(self.sets), *within))))
        self._clear()
        self.block += 1
        return pd.DataFrame(rows, columns=columns)


_DEALT = "p int, blk long, at binary, tokens binary, counts binary, names binary"
_COUNTED = "blk long, at binary, tokens binary, counts binary, names binary"


def _counter(wide: bool):
    """Of the tokens dealt to one place: those that two or more sets have, back to the blocks they are from."""
    kind, who = (np.uint64, np.uint32) if wide else (np.uint32, np.uint16)

    def count(pdf):
        import pandas as pd

        names = pdf[pdf["names"].notna()]
        rows = [(blk, None, None, None, x) for blk, x in zip(names["blk"], names["names"], strict=True)]
        pdf = pdf[pdf["names"].isna()]
        if len(pdf):
            parts = [np.frombuffer(x, dtype=kind) for x in pdf["tokens"]]
            owners = [np.frombuffer(x, dtype=who) for x in pdf["at"]]
            _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            mine = [np.frombuffer(x, dtype=np.uint32) for x in pdf["counts"]] if wide else [1 + (x == _SEVERAL) for x in owners]
            each, at = np.bincount(inverse, weights=np.concatenate(mine)).astype(np.int64)[inverse], 0
            for blk, owner, tokens in zip(pdf["blk"], owners, parts, strict=True):
                here = each[at : at + len(tokens)]
                at += len(tokens)
                twice = np.flatnonzero((here >= 2) & (True if wide else owner != _SEVERAL))
                if len(twice):
                    rows.append((blk, owner[twice].tobytes(), tokens[twice].tobytes() if wide else None, here[twice].astype(np.uint32).tobytes() if wide else None, None))
        return pd.DataFrame(rows, columns=["blk", "at", "tokens", "counts", "names"])

    return count


def _candidates(docs: DataFrame, parts: int, words: int, percent: int) -> DataFrame:
    """Every row's key, set size, class and whether its set may be linked: doc_id, _k1, _k2, n, c, open.

    Of a set's hashes in ascending order the first n - needed + s hold s of those it shares with a
    linked set, and the same s are among that set's first; so a set with fewer than s that
    another set's first ones have too is linked with none. Only a tenth more than the least prefix moves, at 6 bytes a token.
    """

    def deal(frames):
        import pandas as pd
        import xxhash
        from pyspark import TaskContext

        from candela.llm import jaccard, tokens

        jaccard._start()
        dealer = jaccard._Dealer(parts, TaskContext.get().partitionId(), False)
        for frame in frames:
            for pdf in tokens.slices(frame):
                for doc, k1, k2, text in zip(pdf["doc_id"], pdf["_k1"], pdf["_k2"], pdf["text"], strict=True):
                    own = jaccard.shingles(text if isinstance(text, str) else None, words)
                    n = len(own)
                    first = own[: n - jaccard.needed(n, percent) + jaccard._spare(n)] if n else own
                    c = xxhash.xxh3_128_digest(own.tobytes()) if n else None
                    if dealer.add(first, c, (None if pd.isna(doc) else int(doc), k1, k2, n, c)):
                        yield dealer.flush()
        yield dealer.flush()
        jaccard._end()

    def gather(pdf):
        import pandas as pd

        from candela.llm import jaccard

        names, sets, within, _ = pickle.loads(pdf["names"].dropna().iloc[0])
        shared = np.frombuffer(within, dtype=np.uint32).astype(np.int64)
        for at in pdf["at"].dropna():
            shared += np.bincount(np.frombuffer(at, dtype=np.uint16), minlength=sets)
        doc, k1, k2, n, c, own = zip(*names, strict=True)
        sizes, shared = np.array(n, dtype=np.int64), shared[np.array(own)]
        return pd.DataFrame({"doc_id": pd.array(doc, dtype="Int64"), "_k1": k1, "_k2": k2, "n": sizes, "c": c, "open": (shared >= jaccard._spare(jaccard.needed(sizes, percent))) & (sizes > 0)})

    keyed = docs.select("doc_id", "text", *row_keys("doc_id", "text"))
    counted = keyed.mapInPandas(deal, _DEALT).groupBy("p").applyInPandas(_counter(False), _COUNTED)
    return cut(counted.groupBy("blk").applyInPandas(gather, "doc_id long, _k1 long, _k2 long, n long, c binary, open boolean"))


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of rows with these keys (_k1, _k2), once for each key.

    A Bloom filter of bounded size keeps most other texts from moving to the join.
    """
    bloom = BlockedBloom(chosen.select(F.col("_k1").alias("_h1"), F.col("_k2").alias("_h2")))
    keyed = docs.select("text", *row_keys("doc_id", "text")).withColumnsRenamed({"_k1": "_h1", "_k2": "_h2"})
    found = bloom.filter(keyed).withColumnsRenamed({"_h1": "_k1", "_h2": "_k2"})
    return found.join(chosen.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("text")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """c, n, tokens of each text."""

    def build(frames):
        import pandas as pd
        import xxhash

        from candela.llm import jaccard, tokens

        jaccard._start()
        for frame in frames:
            for pdf in tokens.slices(frame):
                own = [jaccard.shingles(x, words) for x in pdf["text"]]
                yield pd.DataFrame({"c": [xxhash.xxh3_128_digest(x.tobytes()) for x in own], "n": [len(x) for x in own], "tokens": [x.view(np.int64) for x in own]})
        jaccard._end()

    return cut(texts.mapInPandas(build, "c binary, n long, tokens array<bigint>"))


def _postings(texts: DataFrame, parts: int, words: int, percent: int) -> DataFrame:
    """The index: token, c, n (the set's size), s (its tokens that another set has) and q (the token's place among those, by rising frequency).

    A set's first n - needed + 1 tokens by frequency are listed. Tokens that no other set has come first and need no
    list, so a set with fewer than needed others has none: it is linked with nothing.
    """

    def deal(frames):
        import xxhash
        from pyspark import TaskContext

        from candela.llm import jaccard, tokens

        jaccard._start()
        dealer = jaccard._Dealer(parts, TaskContext.get().partitionId(), True)
        for frame in frames:
            for pdf in tokens.slices(frame):
                for text in pdf["text"]:
                    own = jaccard.shingles(text, words)
                    c = xxhash.xxh3_128_digest(own.tobytes())
                    if dealer.add(own, c, (c, len(own))):
                        yield dealer.flush()
        yield dealer.flush()
        jaccard._end()

    def gather(pdf):
        import pandas as pd

        from candela.llm import jaccard

        names, sets, within, many = pickle.loads(pdf["names"].dropna().iloc[0])
        found = pdf[pdf["at"].notna()]
        join = lambda column, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in found[column]] or [np.zeros(0, dtype=kind)])
        owner, tokens, counts = join("at", np.uint32).astype(np.int64), join("tokens", np.uint64), join("counts", np.uint32)
        # A token of several sets of the block stands for each of them.
        within, many = np.frombuffer(within, dtype=np.uint16), np.frombuffer(many, dtype=np.uint32).astype(np.int64)
        begin, group = np.cumsum(many) - many, np.maximum(owner - sets, 0)
        times = np.where(owner < sets, 1, many[group] if len(many) else 1)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        owner, group = np.repeat(owner, times), np.repeat(group, times)
        tokens, counts = np.repeat(tokens, times), np.repeat(counts, times)
        if len(many):
            owner = np.where(owner < sets, owner, within[np.minimum(begin[group] + nth, len(within) - 1)])
        order = np.lexsort((tokens, counts, owner))
        owner, tokens = owner[order], tokens[order]
        by_set = {at: (c, n) for c, n, at in names}
        classes, sizes = zip(*[by_set[i] for i in range(sets)], strict=True) if sets else ((), ())
        sizes = np.array(sizes, dtype=np.int64)
        shared = np.bincount(owner, minlength=sets)
        q = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
        keep = q <= (shared - jaccard.needed(sizes, percent))[owner]
        owner, tokens, q = owner[keep], tokens[keep], q[keep]
        return pd.DataFrame({"token": tokens.view(np.int64), "c": [classes[i] for i in owner], "n": sizes[owner], "s": shared[owner], "q": q})

    counted = texts.mapInPandas(deal, _DEALT).groupBy("p").applyInPandas(_counter(True), _COUNTED)
    return counted.groupBy("blk").applyInPandas(gather, "token long, c binary, n long, s long, q long")


def _may(x: Column, y: Column, percent: int) -> Column:
    """Whether two sets that share a token, as postings, can be linked: by what each may share before and after it."""
    most = F.least(x["q"], y["q"]) + F.least(x["s"] - x["q"], y["s"] - y["q"])
    return 100 * most >= percent * (x["n"] + y["n"] - most)


def _linked(shared: Column, percent: int) -> Column:
    return 100 * shared >= percent * (F.col("na") + F.col("nb") - shared)


def _ordered(x: Column, y: Column) -> list[Column]:
    swap = x["c"] > y["c"]
    pick = lambda p, q, f: F.when(swap, q[f]).otherwise(p[f])
    return [pick(x, y, "c").alias("a"), pick(y, x, "c").alias("b"), pick(x, y, "n").alias("na"), pick(y, x, "n").alias("nb")]


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb and shared: the exact intersection's size."""
    left, right = sets.select(F.col("c").alias("a"), F.col("tokens").alias("_x")), sets.select(F.col("c").alias("b"), F.col("tokens").alias("_y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", F.size(F.array_intersect("_x", "_y")).cast("long").alias("shared"))


def _dealt_join(index: DataFrame, lists: DataFrame) -> DataFrame:
    """index beside its (token, block)'s row of lists; the sets of a long list are dealt over SALTS places."""
    salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return index.withColumn("_salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")).join(salted, ["token", "block", "_salt"]).drop("_salt")


def links(docs: DataFrame, rows: DataFrame, parts: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links that connect all linked classes: a, b. docs: doc_id, text; rows: as _candidates() gives them."""
    chosen = cut(rows.filter("open").groupBy("c").agg(F.min(F.struct("_k1", "_k2")).alias("k")).select("c", "k._k1", "k._k2"))
    item = F.struct("c", "n", "s", "q", "home")
    # Blocks of a list by size: sets are at home in one and visit the next, which is as far as a link can reach.
    step = float(np.log(100 / percent) * 1.0000001) if percent < 100 else 1.0
    size = F.floor(F.log(F.col("n").cast("double")) / step)
    index = _postings(_texts(docs, chosen), parts, words, percent)
    at = F.array(F.struct(size.alias("block"), F.lit(True).alias("home")), F.struct((size + 1).alias("block"), F.lit(False).alias("home")))
    index = cut(index.select("token", "c", "n", "s", "q", F.inline(at)))
    # Sets with postings are fewer by far than those that were counted, so they are made again and not kept from then.
    sets = _sets(_texts(docs, cut(chosen.join(index.select("c").distinct(), "c", "left_semi"))), words)
    held = index.groupBy("token", "block", F.pmod(F.xxhash64("c"), F.lit(PIVOTS)).alias("g")).agg(F.count("*").alias("k"), F.max("home").alias("home"), F.min(item).alias("pivot"))
    blocks = held.groupBy("token", "block").agg(F.sum("k").alias("k"), F.max("home").alias("home"), F.collect_list("pivot").alias("pivots"))
    blocks = cut(blocks.filter("k > 1 AND home").drop("home"))
    # The rows of the longest lists don't go where the short ones are looked up. There are HOT such lists at most.
    hot = blocks.filter(F.col("k") > max(LEAST_HOT, index.count() // HOT)).select("token", "block")
    lists = index.join(F.broadcast(hot), ["token", "block"], "left_anti").join(blocks.filter(F.col("k") <= WHOLE).select("token", "block"), ["token", "block"], "left_semi").groupBy("token", "block").agg(F.collect_list(item).alias("l"))
    short = lists.select(F.explode(F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: (y["c"] > x["c"]) & (x["home"] | y["home"]) & _may(x, y, percent)), lambda y: F.struct(*_ordered(x, y)))))).alias("p")).select("p.*")
    long = cut(_dealt_join(index, blocks.filter(F.col("k") > WHOLE).select("token", "block", "pivots")))
    # A set meets a pivot once, in however many lists they stand together.
    met = F.transform(F.filter("pivots", lambda y: (y["c"] != F.col("c")) & _may(y, item, percent)), lambda y: F.struct(y["c"].alias("c"), y["n"].alias("n")))
    star = long.groupBy("c", "n").agg(F.array_distinct(F.flatten(F.collect_set(met))).alias("met")).select(F.struct("c", "n").alias("x"), F.explode("met").alias("y")).select(*_ordered(F.col("x"), F.col("y")))
    answers = cut(_overlaps(short.unionByName(star).distinct(), sets))
    found = answers.filter(_linked(F.col("shared"), percent)).select("a", "b")
    groups = components(found)
    # Of long blocks: sets that aren't in the block's largest group meet the others' sets.
    labelled = long.drop("pivots").join(groups.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    labelled = cut(labelled)
    # What a block's sets share at most is told by where the token stands in them; sets that can reach nobody go before any set is read.
    reach = [F.max("q").alias("before"), F.max(F.col("s") - F.col("q")).alias("after"), F.min("n").alias("least")]
    limits = labelled.groupBy("token", "block").agg(*reach)
    shared = F.least("q", "before") + F.least(F.col("s") - F.col("q"), "after")
    labelled = cut(_dealt_join(labelled, limits).filter(100 * shared >= percent * (F.col("n") + F.col("least") - shared)).drop("before", "after", "least"))
    sums = labelled.groupBy("token", "block", "root").agg(F.count("*").alias("k"))
    most = sums.groupBy("token", "block").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("groups"), F.sum("k").alias("all")).filter("groups > 1")
    most = most.select("token", "block", F.col("m.root").alias("main"), "all", (F.col("all") - F.col("m.k")).alias("few"))
    held = _dealt_join(labelled, most)
    # Parts of about so many tokens: every part of the few meets every part of all.
    each = lambda tokens, sets: F.greatest(F.lit(16), F.least(F.lit(sets), F.floor(tokens / F.exp(F.col("block") * step)))).cast("long")
    parts_of = lambda k, tokens, sets: F.greatest(F.lit(1), F.ceil(F.col(k) / each(tokens, sets))).cast("int")
    part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "c"), F.col(n)).cast("int")
    held = held.withColumns({"_i": parts_of("few", FEW, FEW_SETS), "_j": parts_of("all", ALL, ALL_SETS)})
    few = held.filter("root <> main").select("token", "block", "c", "root", "main", part(1, "_i").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_j") - 1)).alias("j"), F.lit(True).alias("asks"))
    every = held.select("token", "block", "c", "root", "main", F.explode(F.sequence(F.lit(0), F.col("_i") - 1)).alias("i"), part(2, "_j").alias("j"), F.lit(False).alias("asks"))
    meet = few.unionByName(every).join(sets, "c")

    def derive(pdf):
        from candela.llm import jaccard

        try:
            return jaccard._derived(pdf, percent)
        finally:
            jaccard._end()

    more = meet.groupBy("token", "block", "i", "j").applyInPandas(derive, "a binary, b binary").distinct()
    return found.unionByName(cut(more))


def _derived(pdf, percent: int):
    """Links between sets that ask and the others of a block, one for each set and group it isn't in: a, b.

    The others are much alike. Of one, r, the overlap with each asking set x is counted; that with another, y, follows
    from what y lacks of r and has beside it: |x & y| = |x & r| - |x & (r - y)| + |x & (y - r)|.
    """
    import pandas as pd

    asks, root, c = pdf["asks"].to_numpy(dtype=bool), pdf["root"].to_numpy(), pdf["c"].to_numpy()
    none = pd.DataFrame({"a": [], "b": []})
    main = np.flatnonzero(~asks & (root == pdf["main"].to_numpy()))
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(x) or not len(y):
        return none
    tokens = [np.asarray(t) for t in pdf["tokens"]]
    sizes = np.array([len(t) for t in tokens])
    r = np.sort(tokens[main[0] if len(main) else y[0]])
    flat = lambda rows: (np.repeat(np.arange(len(rows)), sizes[rows]), np.concatenate([tokens[i] for i in rows]))
    (xi, xt), (yi, yt) = flat(x), flat(y)

    def table(rows: int, owner: np.ndarray, own: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, len(words)), dtype=np.float32)
        if len(words):
            place = np.minimum(np.searchsorted(words, own), len(words) - 1)
            hit = words[place] == own
            out[owner[hit], place[hit]] = 1
        return out

    of_r = table(len(x), xi, xt, r)
    shared = of_r.sum(axis=1)[:, None] - of_r @ (1 - table(len(y), yi, yt, r)).T
    # Of the tokens beside r, only what an asking set and another set have matters: few that many have, as tables, and many that few have, one by one.
    beside = np.setdiff1d(np.intersect1d(xt, yt), r)
    if len(beside):
        place = lambda t: np.minimum(np.searchsorted(beside, t), len(beside) - 1)
        px, py = place(xt), place(yt)
        hx, hy = beside[px] == xt, beside[py] == yt
        px, ox, py, oy = px[hx], xi[hx], py[hy], yi[hy]
        nx, ny = np.bincount(px, minlength=len(beside)), np.bincount(py, minlength=len(beside))
        often = nx * ny * 8 > len(x) * len(y)
        if often.any():
            words = beside[often]
            shared += table(len(x), xi, xt, words) @ table(len(y), yi, yt, words).T
        order = np.argsort(px, kind="stable")
        ox, begin = ox[order], np.cumsum(nx) - nx
        rare = np.flatnonzero(~often[py])
        flat_shared = shared.reshape(-1)
        ends = np.cumsum(nx[py[rare]])
        for part in np.split(rare, np.searchsorted(ends, np.arange(2_000_000, int(ends[-1]) if len(ends) else 0, 2_000_000))):
            times = nx[py[part]]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rows = ox[np.repeat(begin[py[part]], times) + nth]
            np.add.at(flat_shared, rows * len(y) + np.repeat(oy[part], times), np.float32(1))
    groups = np.unique(root[y], return_inverse=True)[1]
    out = []
    for i in range(len(x)):
        n = np.rint(shared[i]).astype(np.int64)
        linked = np.flatnonzero((100 * n >= percent * (sizes[x[i]] + sizes[y] - n)) & (root[y] != root[x[i]]))
        for j in linked[np.unique(groups[linked], return_index=True)[1]].tolist():
            out.append((c[x[i]], c[y[j]]))
    return pd.DataFrame(out, columns=["a", "b"]) if out else none


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row's set size and component: doc_id, n_shingles, component_id, class (16 bytes) and root (a class that names the component), both null without words.

    docs: doc_id, text. Rows whose sets have 100 * shared >= percent * united are linked;
    component_id is the smallest doc_id that links reach. Rows with equal sets are one class and cost one set. A row
    without words is linked with none. Rows that share a doc_id are rows of their own; null ids take part and are passed over
    as smallest, so a component of null ids alone has null. An empty table gives no row. Nothing is capped.
    """
    spark = docs.sparkSession
    importable(spark)
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // CHARS)
    rows = _candidates(docs, parts, words, percent)
    groups = components(links(docs, rows, parts, words, percent))
    classes = rows.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("first"))
    classes = classes.join(groups.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    first = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.select("c", "root").join(first, "root").select("c", "root", "component_id")
    full = rows.filter("c IS NOT NULL").join(named, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("c").alias("class"), "root", "_k1", "_k2")
    empty = rows.filter("c IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("c").alias("class"), F.col("c").alias("root"), "_k1", "_k2")
    return full.unionByName(empty)


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id (null last), of these the one with the least row key, and one of rows equal in doc_id and text.

    Rows without words all stay.
    """
    rows = cut(join(docs.select("doc_id", "text"), words, percent))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    kept = rows.filter("class IS NOT NULL").groupBy("root").agg(F.min(order).alias("k")).select("k._k1", "k._k2", F.lit(True).alias("_one"))
    alone = rows.filter("class IS NULL").select("_k1", "_k2", F.lit(False).alias("_one")).distinct()
    t = whole(docs, *row_keys("doc_id", "text")).join(kept.unionByName(alone), ["_k1", "_k2"])
    t = t.withColumn("_n", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1")))
    return t.filter(~F.col("_one") | (F.col("_n") == 1)).select("_row.*")
