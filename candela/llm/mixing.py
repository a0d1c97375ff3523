"""Mixing sources to target weights with a low-discrepancy schedule of equal blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.llm.common import WORD, cut, fixed, row_keys, whole, words_of

#: Words in a block, slots that one row of the schedule's first stage stands for, and rows of one of its tasks.
BLOCK, CHUNK, EACH = 512, 4096, 16
#: Documents of a group whose order one task sees, about.
GROUP = 50_000
MOST = 3
#: Bits of a slot's index; a table has fewer than 2**BITS blocks.
BITS = 46


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Each source's target, from a table (source, source_size) with a row for each source.

    Sources in code point order, null last, weigh as in `weights`, repeating. They share
    all sizes by weight; a target stops at `most` times its source's size, and what
    is over goes to the others by weight, until none is above. Sources are filled by
    rising ratio of limit to weight, so one pass finds those that stop.

    The table has one row for each source, so it is small beside the documents;
    this is the only step that sees it in one task.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    t = sizes.withColumn("place", F.row_number().over(ordered)).withColumn("weight", weight)
    t = t.withColumn("limit", F.col("source_size") * most)
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weights"),
        F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("limits_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weights_before"),
    )
    t = t.withColumn("stops", F.col("limit") * (F.col("all_weights") - F.col("weights_before")) <= F.col("weight") * (F.col("total") - F.col("limits_before")))
    spent = F.sum(F.when(F.col("stops"), F.col("limit")).otherwise(0)).over(everything)
    gone = F.sum(F.when(F.col("stops"), F.col("weight")).otherwise(0)).over(everything)
    share = (F.col("weight") * (F.col("total") - spent)).cast("double") / F.when(F.col("stops"), F.lit(1)).otherwise(F.col("all_weights") - gone).cast("double")
    return t.select("source", "source_size", "place", F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def _mirrored(v: Column) -> Column:
    """Bits of v in reverse: the van der Corput point of v, as an integer."""
    return F.conv(F.reverse(F.lpad(F.bin(v), BITS, "0")), 2, 10).cast("long")


def _nth(rank: Column, low: Column, high: Column) -> Column:
    """The point of rank `rank` among low..high-1 in the schedule's order, that of their bits in reverse.

    Bit by bit from the last: of the points that end in the bits found so far, those whose next bit is 0 stand
    first, and how many they are is an arithmetic progression's length. No slot is made, sorted or moved.
    """
    shift = lambda x, j: F.call_function("shiftleft", x, j)
    one = F.lit(1).cast("long")

    def step(acc: Column, j: Column) -> Column:
        # Points under `end` that end in the bits v.
        under = lambda end: F.greatest(F.lit(0).cast("long"), F.call_function("shiftright", end - acc["v"] + shift(one, j + 1) - 1, j + 1))
        zeros = under(high) - under(low)
        return F.when(acc["r"] < zeros, F.struct(acc["v"].alias("v"), acc["r"].alias("r"))).otherwise(F.struct((acc["v"] + shift(one, j)).alias("v"), (acc["r"] - zeros).alias("r")))

    bits = F.sequence(F.lit(0), F.length(F.bin(high)) - 1)
    return F.aggregate(bits, F.struct(F.lit(0).cast("long").alias("v"), rank.cast("long").alias("r")), step)["v"]


def _points(targets: DataFrame, block: int) -> DataFrame:
    """targets with words, and low and high: the source owns the points low..high-1, one for each block."""
    t = targets.withColumn("words", F.round("target").cast("long")).withColumn("_blocks", F.ceil(F.col("words") / block).cast("long"))
    return t.withColumn("high", F.sum("_blocks").over(Window.orderBy("place"))).withColumn("low", F.col("high") - F.col("_blocks")).drop("_blocks")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots: (source_place, rank, slot, begin, end).

    A source owns as many consecutive points as its target has blocks; a point's slot is
    its bits in reverse (van der Corput's sequence), so that slots of all sources interleave evenly at every length of
    the schedule and each source gets its number exactly. rank counts a source's slots in the
    schedule's order; begin and end are the words it takes on the source's axis, which repeats
    after source_size words. The last one is cut at the target.
    """
    t = _points(targets, block).filter("high > low").select("place", "words", "low", "high", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - F.col("low") - 1, F.lit(CHUNK).cast("long"))).alias("at"))
    many = t.agg(F.count("*")).first()[0]
    t = t.repartition(max(1, many // EACH), "place", "at")
    t = t.select("place", "words", "low", "high", F.explode(F.sequence("at", F.least(F.col("at") + CHUNK, F.col("high") - F.col("low")) - 1)).alias("rank"))
    begin = F.col("rank") * block
    slot = _mirrored(_nth(F.col("rank"), F.col("low"), F.col("high")))
    return t.select(F.col("place").alias("source_place"), "rank", slot.alias("slot"), begin.alias("begin"), F.least(begin + block, F.col("words")).alias("end"))


def axis(docs: DataFrame, block: int = BLOCK, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Every document's place in its source's shuffled order, counted in words.

    Returns doc_id, size, source, source_size, source_place, target, words, low, high, bucket, pos and start. The order is that of
    md5(seed:doc_id); its first digits, three at least and more for more documents, deal a source out over groups
    whose sizes are summed first, so a source with a third of all rows is never in one task.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    keys = [c for c in ("_k1", "_k2") if c in docs.columns]
    sized = cut(docs.select("doc_id", "source", size.alias("size"), order.alias("order"), *keys))
    digits = max(3, len(f"{sized.count() // GROUP:x}"))
    sized = sized.withColumn("bucket", F.substring("order", 1, digits))
    parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    targets = _points(source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, most), block)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part").over(ahead), F.lit(0)))
    key = lambda c: F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(c)))
    parts = parts.withColumn("_key", key("source")).drop("part").join(targets.withColumn("_key", key("source")).drop("source"), "_key")
    within = Window.partitionBy("_key", "bucket").orderBy("order", F.col("doc_id").asc_nulls_last(), "size")
    rows = sized.withColumn("_key", key("source")).select(
        "*", F.row_number().over(within).alias("pos"), (F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_in")
    )
    rows = rows.join(parts.drop("source"), ["_key", "bucket"])
    return rows.select("doc_id", "size", "source", "source_size", F.col("place").alias("source_place"), "target", "words", "low", "high", "bucket", "pos", (F.col("_in") + F.col("ahead")).alias("start"), *keys)


def mix(docs: DataFrame, block: int = BLOCK, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """What the mix takes: a row for each block's share of a document.

    docs: doc_id, text, source. Returns doc_id, size, source, source_size, source_place,
    target, bucket, pos (with source_place and bucket they name the input's row), slot, pass
    (0, 1, 2: how often the source was used up before), first (word of the document, from 0)
    and length. A share that no slot takes has slot null and length 0; every document has a row.

    Null texts and texts without words have size 0; a null source is a source; rows that
    share a doc_id are documents of their own; an empty table gives no row.
    """
    rows = axis(docs, block, seed, weights, most)
    size, turn, rank = F.col("source_size"), F.col("pass"), F.col("rank")
    passes = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("target") / F.greatest(size, F.lit(1))).cast("long") - 1))
    held = rows.filter("size > 0").withColumn("pass", F.explode(passes)).withColumn("from", turn * size + F.col("start")).withColumn("to", F.col("from") + F.col("size"))
    held = held.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    none = rows.filter("size = 0").selectExpr("*", "0L AS pass", "0L AS `from`", "0L AS to", "-1L AS rank")
    # A block meets the slot of its rank by arithmetic: the rank-th of the source's points, if it has so many.
    begin = F.greatest("from", rank * block)
    slot = F.when((rank >= 0) & (rank < F.col("high") - F.col("low")), _mirrored(_nth(rank, F.col("low"), F.col("high"))))
    out = fixed(held.unionByName(none), "slot", slot)
    end = F.least("to", rank * block + block, "words")
    length = F.when(F.col("slot").isNull(), F.lit(0)).otherwise(F.greatest(end - begin, F.lit(0))).cast("long")
    return out.select("doc_id", "size", "source", "source_size", "source_place", "target", "bucket", "pos", "slot", "pass", (begin - F.col("from")).alias("first"), length.alias("length"), *[c for c in ("_k1", "_k2") if c in rows.columns])


def taken(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot and last_slot of every input row, these null if nothing is taken."""
    used = F.when(F.col("length") > 0, F.col("slot"))
    t = mixed.groupBy("source_place", "bucket", "pos", "doc_id", "size", "source_size", "target").agg(F.sum("length").alias("taken"), F.min(used).alias("first_slot"), F.max(used).alias("last_slot"))
    return t.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with docs' columns, in the schedule's order: a document once for each time that it is taken, with the words taken as its text.

    Rows are dealt by ranges of their first slot and sorted within, so files of the result, in their order, mix the sources evenly from any
    place on. Where a source's target ends within a document, its first words are left, with one space between them;
    whole texts stay as they are; nulls, ties, repeated rows and empty tables are as mix() says. n_chars, if there, follows the text. Documents of which nothing is taken go.
    """
    keyed = whole(docs, "doc_id", "text", "source", *row_keys(*docs.columns))
    takes = mix(keyed, **options).filter("length > 0").groupBy("_k1", "_k2", "source_place", "bucket", "pos", "pass", "size").agg(F.sum("length").alias("_words"), F.min("slot").alias("_slot"))
    texts = keyed.select("_row", "_k1", "_k2").dropDuplicates(["_k1", "_k2"])
    out = texts.join(takes.select("_k1", "_k2", "_words", "_slot", F.col("size").alias("_size")), ["_k1", "_k2"])
    part = F.array_join(F.slice(words_of(F.col("_row.text")), F.lit(1), F.col("_words").cast("int")), " ")
    out = fixed(out, "_text", F.when(F.col("_words") < F.col("_size"), part).otherwise(F.col("_row.text")))
    value = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    ordered = out.select("_slot", F.struct(*[value.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]).alias("_row"))
    return ordered.repartitionByRange("_slot").sortWithinPartitions("_slot").select("_row.*")
