"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import fixed, let, row_keys, whole, written

WINDOW = 3
#: Windows that are broadcast at most, and the least occurrences of such a one.
HOT, LEAST_HOT = 50_000, 500
#: A line with a word; windows without one aren't compared.
SOME = r"[^\x20\x09-\x0D]"


def _windows(text: Column, width: int) -> Column:
    """Two 64-bit hashes of each window of lines; a text of fewer lines is one window."""

    def of(lines: Column) -> Column:
        n = F.size(lines)
        count = F.greatest(n - width + 1, F.lit(1))
        part = lambda i, seed: F.xxhash64(F.lit(seed), F.least(n, F.lit(width)), *[F.get(lines, i + k) for k in range(width)])
        some = lambda i: F.exists(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.get(lines, i + k).rlike(SOME), F.lit(False)))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(some(i), F.struct(i.alias("at"), part(i, 1).alias("h1"), part(i, 2).alias("h2"))))

    return let(F.split(text, "\n", -1), of)


def covered(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """The places where later occurrences of repeated windows begin: _k1, _k2, starts (lines from 0).

    Occurrences are ordered by doc_id (null last), the row's key and place. The first of each
    window stays. All windows are counted, in sums that are made before they move; then windows are made again from the texts and
    only repeated ones are written, with their places. A window of more than 1/HOT of all windows (HOT of them at most) meets its
    count and its first place by broadcast, so that its occurrences stay where they are; the others are joined.
    Null texts have no window; rows alike in doc_id and text are one document; an empty table gives no row.
    """
    texts = docs.filter(F.col("text").isNotNull())

    def windows(*more: Column | str) -> DataFrame:
        t = texts.select(*more, F.explode(_windows(F.col("text"), width)).alias("w")).filter(F.col("w").isNotNull())
        return t.select(*[c for c in t.columns if c != "w"], "w.at", "w.h1", "w.h2")

    counted = windows().groupBy("h1", "h2").agg(F.count("*").alias("n"))
    sums = written(counted.filter("n > 1").select("h1", "h2", "n"), "windows")
    limit = max(LEAST_HOT, (sums.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot, cold = sums.filter(F.col("n") > limit).select("h1", "h2"), sums.filter(F.col("n") <= limit).select("h1", "h2")
    key, place = ["h1", "h2"], F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2", "at")
    every = windows(*row_keys("doc_id", "text"), "doc_id").join(F.broadcast(hot.withColumn("hot", F.lit(True))), key, "left")
    # Hot windows' rows go to the join by their own places, where they find nothing and don't meet.
    aside = lambda c, k: F.when(F.col("hot").isNull(), F.col(c)).otherwise(F.xxhash64(F.lit(k), "_k1", "_k2", "at")).alias(f"j{k}")
    every = every.select("*", aside("h1", 1), aside("h2", 2))
    held = every.join(cold.select(F.col("h1").alias("j1"), F.col("h2").alias("j2"), F.lit(True).alias("cold")), ["j1", "j2"], "left").filter("hot OR cold").withColumn("hot", F.coalesce("hot", F.lit(False)))
    held = written(held.select("_k1", "_k2", "doc_id", "at", "h1", "h2", "hot"), "repeated")
    first = lambda t: t.groupBy(*key).agg(F.min(place).alias("first"))
    many, few = held.filter("hot").drop("hot"), held.filter("NOT hot").drop("hot")
    later = many.join(F.broadcast(first(many)), key).unionByName(few.join(first(few), key)).filter(place > F.col("first")).select("_k1", "_k2", "at")
    return later.groupBy("_k1", "_k2").agg(F.collect_set("at").alias("starts"))


def dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with the texts that remain, and n_lines and n_removed.

    The covered places of a document's later occurrences merge, and those lines go; each
    removed line has an earlier copy within the same lines around it, so that nothing is lost.
    Null texts stay null, with no lines; rows that are alike in doc_id and text are one document;
    an empty table gives no row. Columns of docs named n_lines or n_removed are replaced.
    """
    gone = covered(docs.select("doc_id", "text"), width)

    def rest(lines: Column, starts: Column) -> Column:
        out = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, F.least(s + width, F.size(lines)) - 1))))
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
        return let(keep, lambda k: F.struct(F.array_join(F.transform(k, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(k)).cast("long").alias("removed")))

    keyed = whole(docs, *row_keys("doc_id", "text")).join(gone, ["_k1", "_k2"], "left")
    text = F.col("_row.text")
    lines = lambda: F.split(text, "\n", -1)
    keyed = fixed(keyed, "_new", F.when(F.col("starts").isNotNull(), let(lines(), lambda x: rest(x, F.col("starts")))))
    count = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines())).cast("long")
    kept = [F.coalesce("_new.text", text).alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return keyed.select(*kept, count.alias("n_lines"), F.coalesce("_new.removed", F.lit(0).cast("long")).alias("n_removed"))
