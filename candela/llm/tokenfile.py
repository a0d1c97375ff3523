"""Token-id shards: a grammar-compressed file format with its writer and readers.

A dataset is a Parquet folder whose rows are blocks of consecutive documents in ascending
doc_id order. Columns:

  part, block          place of the block: parts in order, then blocks in order
  first_id, last_id    the least and the largest doc_id in it, null if all are null
  doc_ids              the documents' ids
  n_tokens             each document's ids, in number
  at                   each document's first symbol in `symbols`
  width                bytes of a symbol, 2 or 4
  symbols              little-endian symbols of all documents, one after another
  rules                pairs of symbols; rule k makes symbol `base` + k, of earlier symbols
  lengths              32-bit number of ids that each rule expands to
  base                 number of plain ids; symbols below it stand for themselves

No symbol spans two documents. `lengths` tell where any id of a document is without
expanding what stands before it: see ids_at().
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.llm import memory, tokens
from candela.llm.common import fresh_path, importable  # noqa: F401

END = 1
#: Ids in a block; uses that a rule needs; a round replaces pairs that stand at least 1/SHARE as often as the most frequent one.
BLOCK, LEAST, SHARE = 1_000_000, 8, 3
#: Symbols of two bytes, and plain ids beyond which symbols have four.
TWO, MOST_PLAIN = 1 << 16, 60_000
SCHEMA = "part int, block int, first_id long, last_id long, width int, base int, doc_ids array<bigint>, n_tokens array<bigint>, at array<bigint>, symbols binary, rules binary, lengths binary"


def width_of(base: int) -> int:
    return 2 if base <= MOST_PLAIN else 4


def pair_keys(seq: np.ndarray, ends: np.ndarray, shift: int, spots: np.ndarray | None = None) -> np.ndarray:
    """left << shift | right of all neighbours, or of those at `spots`; all bits are set where left ends a document, which no pair of symbols under 2**shift - 1 is.

    ends: whether a symbol ends a document, or the places of those that do, in order.
    """
    kind = np.uint32 if shift == 16 else np.uint64
    left, right = (seq[:-1], seq[1:]) if spots is None else (seq[spots], seq[spots + 1])
    keys = left.astype(kind)
    keys <<= kind(shift)
    keys |= right
    if ends.dtype == bool:
        ends = np.flatnonzero(ends)
    if spots is not None:
        at = np.searchsorted(spots, ends)
        ends = at[(at < len(spots)) & (spots[np.minimum(at, len(spots) - 1)] == ends)] if len(spots) else ends[:0]
    keys[ends[: np.searchsorted(ends, len(keys))]] = ~kind(0)
    return keys


def pair_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every different pair in ascending order and how often it stands there."""
    keys = np.sort(keys)
    keys = keys[: np.searchsorted(keys, ~keys.dtype.type(0))]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class _Lookup:
    """Which of some pairs a key is, through a table of slots, 32 or more for each pair. Of pairs that meet in a slot the first is known."""

    def __init__(self, pairs: np.ndarray):
        self.bits = min(20, max(10, len(pairs).bit_length() + 5))
        self.pairs, self.table = pairs, np.zeros(1 << self.bits, dtype=np.int32)
        self.table[self.slot(pairs[::-1])] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        wide = keys.dtype.itemsize == 8
        mixed = keys * (np.uint64(0x9E3779B97F4A7C15) if wide else np.uint32(0x9E3779B1))
        return mixed >> keys.dtype.type((64 if wide else 32) - self.bits)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys that are known pairs, and which."""
        which = self.table[self.slot(keys)]
        at = np.flatnonzero(self.pairs[which] == keys)
        return at, which[at]


def compress(ids: np.ndarray, last: np.ndarray, base: int, least: int = LEAST, share: int = SHARE):
    """Re-Pair: (symbols, rules, lengths, each document's first symbol).

    ids: plain ids under base; last: where a document ends. Each round counts pairs exactly and replaces the
    most frequent one, and those at least 1/share as frequent, by new symbols, the more frequent first and from the left; then it counts
    again over what is left, new symbols too, until no pair stands `least` times or symbols of width_of(base) bytes run out. The limit falls by
    `share` at least from round to round. Once it is `least`, only pairs of new symbols can have become frequent, so that rounds
    count around these alone, until a count of everything finds no more.
    """
    shift = 8 * width_of(base)
    seq, ends = ids.astype(np.uint32), np.flatnonzero(last)
    rules, lengths, names, limit, fresh = [], [np.ones(base, dtype=np.int64)], base, np.inf, 0
    while len(seq) > 1 and names < (1 << shift) - 1:
        spots = None
        if fresh:
            new = seq >= fresh
            spots = np.flatnonzero(new[:-1] | new[1:])
        keys = pair_keys(seq, ends, shift, spots)
        pairs, count = pair_counts(keys)
        top = int(count.max()) if len(count) else 0
        if top < least:
            if not fresh:
                break
            fresh = 0
            continue
        limit = max(least, min(-(-top // share), limit // share))
        chosen = np.flatnonzero(count >= limit)
        chosen = chosen[np.argsort(-count[chosen], kind="stable")][: (1 << shift) - 1 - names]
        pairs = pairs[chosen]
        at, which = _Lookup(pairs).find(keys)
        if spots is not None:
            at = spots[at]
        keep = _apart(at, which)
        at, which = at[keep], which[keep]
        # Pairs that overlap more frequent ones may have lost their places; they wait for another round.
        good = np.bincount(which, minlength=len(pairs)) >= 2
        good[0] = True
        at, which = at[good[which]], (np.cumsum(good) - 1)[which[good[which]]]
        pairs = pairs[good]
        seq[at] = names + which
        at += 1
        stay = np.ones(len(seq), dtype=bool)
        stay[at] = False
        seq = seq[stay]
        # Where a pair ended a document, what stands for it ends it.
        ends -= np.searchsorted(at, ends, side="right")
        known = np.concatenate(lengths)
        rules.append(np.column_stack([pairs >> pairs.dtype.type(shift), pairs & pairs.dtype.type((1 << shift) - 1)]).astype(np.int64))
        lengths.append(known[rules[-1]].sum(axis=1))
        fresh = names if limit == least else 0
        names += len(pairs)
    kind = f"<u{shift // 8}"
    flat = np.concatenate(rules) if rules else np.zeros((0, 2))
    return seq.astype(kind), flat.astype(kind), np.concatenate(lengths)[base:].astype("<u4"), np.concatenate([[0], ends[:-1] + 1])


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which matches at ascending places are taken, so that no two overlap: in a run of matches side by side first those that rank before
    both neighbours, then every other one from the left of what is left between."""
    taken = np.ones(len(at), dtype=bool)
    touch = np.diff(at) == 1
    beside = np.zeros(len(at), dtype=bool)
    beside[:-1] |= touch
    beside[1:] |= touch
    some = np.flatnonzero(beside)
    if not len(some):
        return taken
    at, rank, touch = at[some], rank[some], np.diff(at[some]) == 1
    best = np.ones(len(at), dtype=bool)
    best[1:] &= ~touch | (rank[1:] < rank[:-1])
    best[:-1] &= ~touch | (rank[:-1] < rank[1:])
    out = best.copy()
    out[:-1] |= touch & best[1:]
    out[1:] |= touch & best[:-1]
    rest = np.flatnonzero(~out)
    own = at[rest]
    if len(own):
        run = np.concatenate([[0], np.flatnonzero(np.diff(own) > 1) + 1])
        begin = np.repeat(own[run], np.diff(np.append(run, len(own))))
        best[rest[(own - begin) % 2 == 0]] = True
    taken[some] = best
    return taken


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    size = np.concatenate([np.ones(base, dtype=np.int64), np.zeros(len(rules), dtype=np.int64)])
    parts = []
    for k, (a, b) in enumerate(rules.tolist()):
        x = [a] if a < base else parts[a - base]
        y = [b] if b < base else parts[b - base]
        parts.append(x + y)
        size[base + k] = len(parts[-1])
    flat = np.concatenate([np.arange(base), np.fromiter((i for p in parts for i in p), dtype=np.int64)])
    begin = np.cumsum(size) - size
    long = size[symbols]
    ahead = np.cumsum(long) - long
    return flat[np.repeat(begin[symbols] - ahead, long) + np.arange(long.sum())].astype("<u4")


def window(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, n: int) -> tuple[list[int], int]:
    """Ids start .. start + n - 1 of a document whose symbols are given, and how many symbols were opened: those alone that the ids lie in."""
    size = lambda s: 1 if s < base else int(lengths[s - base])
    own = np.where(symbols < base, 1, lengths[np.maximum(symbols.astype(np.int64) - base, 0)].astype(np.int64) if len(lengths) else 1)
    ends = np.cumsum(own)
    first, out, opened = int(np.searchsorted(ends, start, side="right")), [], 0
    skip = start - (int(ends[first - 1]) if first else 0)
    for s in symbols[first:].tolist():
        if len(out) >= n:
            break
        todo = [s]
        while todo and len(out) < n:
            s = todo.pop()
            if skip >= size(s):
                skip -= size(s)
                continue
            opened += 1
            if s < base:
                out.append(s)
            else:
                a, b = rules[s - base].tolist()
                todo += [b, a]
    return out, opened


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each document's."""
    counts = counts + 1
    ends = np.cumsum(counts) - 1
    out, plain = np.empty(len(ids) + len(counts), dtype="<u4"), np.ones(len(ids) + len(counts), dtype=bool)
    plain[ends] = False
    out[plain], out[ends] = ids, end
    return out, counts


def _blocks(part: int, frames, tokenizer: str, end: int, most: int):
    """Rows of the format from frames of (doc_id, text) in order."""
    import pandas as pd

    code = tokens.encoder(tokenizer)
    base = max(code.ids, end + 1)
    docs, held, counted, size, block = [], [], [], 0, 0

    def row():
        counts, ids = np.concatenate(counted), np.concatenate(held)
        final = np.zeros(len(ids), dtype=bool)
        final[np.cumsum(counts) - 1] = True
        symbols, rules, lengths, at = compress(ids, final, base)
        known = [d for d in docs if d is not None]
        values = (part, block, min(known, default=None), max(known, default=None), width_of(base), base, docs, counts, at, symbols.tobytes(), rules.tobytes(), lengths.tobytes())
        return pd.DataFrame([values], columns=["part", "block", "first_id", "last_id", "width", "base", "doc_ids", "n_tokens", "at", "symbols", "rules", "lengths"]).astype({"first_id": "Int64", "last_id": "Int64"})

    for frame in frames:
        for pdf in tokens.slices(frame):
            ids, counts = with_end(*code.arrays([x if isinstance(x, str) else None for x in pdf["text"]]), end)
            names = [None if doc is None or doc != doc else int(doc) for doc in pdf["doc_id"].tolist()]
            ends, first, at = np.cumsum(counts), 0, 0
            while first < len(names):
                # A block ends with the document that fills it.
                stop = min(len(names), int(np.searchsorted(ends, at + most - size)) + 1)
                docs += names[first:stop]
                counted.append(counts[first:stop])
                held.append(ids[at : ends[stop - 1]])
                size += int(ends[stop - 1]) - at
                first, at = stop, int(ends[stop - 1])
                if size >= most:
                    yield row()
                    docs, held, counted, size, block = [], [], [], 0, block + 1
    if docs:
        yield row()
    memory.rest("tokens")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, block: int = BLOCK) -> None:
    """Encode every text, append the end id and write the format in ascending doc_id order.

    docs: doc_id, text; null ids come first, rows that share an id are ordered by text; null texts are
    empty. tokenizer: the path of any file of the tokenizers library. Spark's own writer commits the files, so a lost executor's work is done again.
    """
    importable(docs.sparkSession)
    tokenizer = tokenizer or tokens.path()

    def run(frames):
        from pyspark import TaskContext

        yield from _blocks(TaskContext.get().partitionId(), frames, tokenizer, end, block)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a dataset: doc_id, start (ids of all before it), n_tokens, ids_crc32 and, if asked for, ids."""
    importable(spark)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for r in frame.itertuples(index=False):
                symbols, rules = np.frombuffer(r.symbols, dtype=f"<u{r.width}"), np.frombuffer(r.rules, dtype=f"<u{r.width}").reshape(-1, 2)
                ids, counts = expand(symbols, rules, r.base).tobytes(), np.asarray(r.n_tokens)
                start = np.cumsum(counts) - counts
                parts = [ids[4 * a : 4 * (a + n)] for a, n in zip(start.tolist(), counts.tolist(), strict=True)]
                out = pd.DataFrame({"part": r.part, "block": r.block, "doc_id": pd.array([None if d is None or d != d else int(d) for d in r.doc_ids], dtype="Int64"), "_in": start, "n_tokens": counts, "ids_crc32": [zlib.crc32(x) for x in parts]})
                yield out.assign(ids=parts) if with_ids else out

    stored = spark.read.schema(SCHEMA).parquet(path)
    held = stored.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    # A part's blocks are counted within the part; only the parts' sums, one row for each task of the writer, are in one place.
    parts = held.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_part"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.select("part", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_block")).join(parts, "part")
    rows = stored.mapInPandas(run, "part int, block int, doc_id long, _in long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    out = rows.join(blocks, ["part", "block"])
    return out.select("doc_id", (F.col("_in") + F.col("_block") + F.col("_part")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def ids_at(spark: SparkSession, path: str, doc_id: int, start: int = 0, n: int | None = None) -> DataFrame:
    """n ids of a document from its start-th on, the end id too: doc_id, part, block, place (in the block), ids (binary) and opened.

    Only blocks whose range of ids holds doc_id are read, and only the symbols opened in which the asked ids lie. A row for each document
    of that id; ids beyond the end are left out.
    """
    importable(spark)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for r in frame.itertuples(index=False):
                kind, rows = f"<u{r.width}", []
                symbols, rules, lengths = np.frombuffer(r.symbols, dtype=kind), np.frombuffer(r.rules, dtype=kind).reshape(-1, 2), np.frombuffer(r.lengths, dtype="<u4")
                for i in np.flatnonzero(np.array([d == doc_id for d in r.doc_ids])).tolist():
                    stop = r.at[i + 1] if i + 1 < len(r.at) else len(symbols)
                    many = max(0, int(r.n_tokens[i]) - start) if n is None else min(n, max(0, int(r.n_tokens[i]) - start))
                    ids, opened = window(symbols[r.at[i] : stop], rules, lengths, r.base, start, many)
                    rows.append((doc_id, r.part, r.block, i, np.array(ids, dtype="<u4").tobytes(), opened))
                yield pd.DataFrame(rows, columns=["doc_id", "part", "block", "place", "ids", "opened"])

    stored = spark.read.schema(SCHEMA).parquet(path).filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return stored.mapInPandas(run, "doc_id long, part int, block int, place int, ids binary, opened long")
