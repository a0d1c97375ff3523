"""Best-fit packing of token sequences with several capacities."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.llm.common import cut, importable
from candela.llm import tokens

LENGTH = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Limits:
    """What a sequence holds: tokens, documents, and the sum of squared lengths that attention costs.

    The defaults for documents and cost never stop a sequence before its tokens do.
    """

    tokens: int = LENGTH
    documents: int = LENGTH
    cost: int = LENGTH * LENGTH
    #: Weights of the three in the choice of a bin; "dot" or "norm".
    weights: tuple[float, float, float] = (1.0, 0.05, 0.25)
    choice: str = "norm"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of `length`; the last may be shorter."""
    importable(docs.sparkSession)

    def cut_up(frames):
        import pandas as pd

        from candela.llm import memory

        code, last = tokens.encoder(tokenizer), np.array([end], dtype="<u4").tobytes()
        for frame in frames:
            for pdf in tokens.slices(frame):
                rows = []
                for doc, ids in zip(pdf["doc_id"], code.encode([x if isinstance(x, str) else None for x in pdf["text"]]), strict=True):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})
        memory.rest("tokens")

    return docs.select("doc_id", "text").mapInPandas(cut_up, PIECES + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], limits: Limits = Limits()) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sequences for counts[length] pieces of each length: (first sequence, how many alike, [(length, pieces of it)]).

    Vector best-fit, longest pieces first: a piece goes to an open bin with room for its tokens,
    its one document and its squared length, to the one whose residual is nearest ("norm") or best aligned ("dot")
    in the weighted capacities; a new bin is opened only if none has room. Bins alike are one entry
    with a count and pieces of one length are placed many at a time, so that work and memory follow the number of different
    lengths (at most limits.tokens), not that of documents.
    """
    size = np.array([limits.tokens, limits.documents, limits.cost], dtype=float)
    weights = np.array(limits.weights) / size**2
    room = np.zeros((0, 3))
    many = np.zeros(0, dtype=np.int64)
    held: list[list[tuple[int, int]]] = []

    def add(left, n, what):
        nonlocal room, many
        same = np.flatnonzero((room == left).all(axis=1)) if len(room) else ()
        for i in same:
            if held[i] == what:
                many[i] += n
                return
        room, many = np.vstack([room, left]), np.append(many, n)
        held.append(what)

    for length in sorted(counts, reverse=True):
        need, left = np.array([length, 1, length * length], dtype=float), counts[length]
        if not (need <= size).all():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((room >= need).all(axis=1) & (many > 0)) if len(room) else np.zeros(0, dtype=int)
            if not len(fits):
                each = int(min(size // need))
                if left >= each:
                    add(size - each * need, left // each, [(length, each)])
                    left %= each
                else:
                    add(size - left * need, 1, [(length, left)])
                    left = 0
                continue
            after = room[fits] - need
            score = (weights * after**2).sum(axis=1) if limits.choice == "norm" else -(weights * room[fits] * need).sum(axis=1)
            i = fits[np.argmin(score)]
            each = int(min(room[i] // need)) if limits.choice == "norm" else 1
            each = min(each, left)
            n = min(int(many[i]), left // each)
            many[i] -= n
            add(room[i] - each * need, n, [*held[i], (length, each)])
            left -= n * each
        alive = np.flatnonzero(many > 0)
        if len(alive) < len(many) // 2:
            room, many, held = room[alive], many[alive], [held[i] for i in alive]
    out, first = [], 0
    for n, what in zip(many.tolist(), held, strict=True):
        if n:
            out.append((first, n, what))
            first += n
    return out


def pack(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32, any others) with sequence_id and offset.

    Pieces are known by their lengths alone, so their counts (one for each length) plan all
    sequences at once, and each piece takes the place of its number among those of its length. Numbers come
    from two levels of counts over hash groups: no task sees all pieces of a length. Equal rows get places
    of their own; an empty table gives no row.
    """
    spark, order = rows.sparkSession, [F.col(c).asc_nulls_last() for c in ("doc_id", "piece", "ids_crc32")]
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1024)))
    groups = rows.groupBy("length", "_g").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = []
    for first, n, what in plan(counts, limits):
        offset = 0
        for length, each in what:
            for _ in range(each):
                table.append((length, n, first, offset))
                offset += length
    done: dict[int, int] = {}
    places = []
    for length, n, first, offset in table:
        low = done.get(length, 0)
        done[length] = low + n
        places.append((length, low, low + n, first, offset))
    places = spark.createDataFrame(places, "length long, low long, high long, first long, offset long")
    ahead = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_g", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    # Each hash group of a length covers consecutive numbers, so it meets few of the places.
    spans = groups.join(places, (groups["length"] == places["length"]) & (groups["_ahead"] < places["high"]) & (groups["_ahead"] + groups["n"] > places["low"])).select(groups["length"], "_g", "_ahead", "low", "high", "first", "offset")
    spans = spans.groupBy("length", "_g").agg(F.min("_ahead").alias("_ahead"), F.sort_array(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("_spans"))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_g").orderBy(*order)) - 1)
    out = numbered.join(spans, ["length", "_g"]).withColumn("_n", F.col("_n") + F.col("_ahead"))
    mine = F.get(F.filter("_spans", lambda s: (s["low"] <= F.col("_n")) & (F.col("_n") < s["high"])), F.lit(0))
    out = out.withColumn("_s", mine).withColumns({"sequence_id": F.col("_s.first") + F.col("_n") - F.col("_s.low"), "offset": F.col("_s.offset")})
    return out.select(*[c for c in rows.columns if c != "_g"], "sequence_id", "offset")


def best_fit(docs: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), end: int = END, with_ids: bool = False) -> DataFrame:
    """Every document's pieces in sequences of at most limits.tokens.

    docs: doc_id, text. A null or empty text is the end id alone. Repeated rows are packed once each.
    """
    tokenizer = tokenizer or tokens.path()
    return pack(cut(pieces(docs, tokenizer, limits.tokens, end, with_ids)), limits)
