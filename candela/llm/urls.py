"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import importable, row_keys

#: (host, path, verdict) of the rules.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Canonical URLs that are blocked, with what they are the beginning of, where no rule fits. The list is the query's own; judge() takes any.
LISTED = ("adult-x.example.net/", "casino-win.example.com/", "cheap-pills.example.com/", "spam-farm.example.com/")
#: Bits for each listed URL; words of 64 bits in a block; bits set in a block for a URL; most blocks (64 bytes each).
BITS, WORDS, TESTS, MOST_BLOCKS = 16, 8, 6, 1 << 17
#: Characters of a listed path that are looked up; what is longer is compared after the join.
HEAD = 4096


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; none: empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.instr(url, "://") > 0, found).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; none: empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _hashes(host: str, path: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), F.col(host), F.col(path)).alias(f"_h{k}") for k in (1, 2)]


class BlockedBloom:
    """A Bloom filter whose bits for a key are all in one block of 512 bits.

    Its size follows the list's, at most MOST_BLOCKS blocks (8 MiB); beyond that only the share of false
    positives grows, and the exact join removes those.
    """

    def __init__(self, keys: DataFrame):
        """keys: _h1, _h2. Bits meet in sums by word, so only the filter comes to the driver."""
        need = max(1, keys.count() * BITS // (WORDS * 64))
        self.blocks = min(MOST_BLOCKS, 1 << (need - 1).bit_length())
        bit = lambda k: F.call_function("shiftrightunsigned", F.col("_h2"), F.lit(9 * k)).bitwiseAND(F.lit(511).cast("long"))
        rows = keys.select(self.block(), F.explode(F.array(*map(bit, range(TESTS)))).alias("bit"))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
        words = rows.groupBy((F.col("_block") * WORDS + F.floor(F.col("bit") / 64)).alias("word")).agg(F.bit_or(mask).alias("bits"))
        self.words = np.zeros(self.blocks * WORDS, dtype=np.int64)
        for r in words.collect():
            self.words[r["word"]] = r["bits"]

    def block(self) -> Column:
        return F.pmod("_h1", F.lit(self.blocks)).alias("_block")

    def filter(self, rows: DataFrame) -> DataFrame:
        """The rows (with _h1, _h2) whose key may be in the list."""
        importable(rows.sparkSession)
        shared = rows.sparkSession.sparkContext.broadcast(self.words)

        @F.pandas_udf("boolean")
        def may_be(block, h2):
            import pandas as pd

            words, at, h2 = shared.value.view(np.uint64), block.to_numpy() * WORDS, h2.to_numpy().view(np.uint64)
            hit = np.ones(len(at), dtype=bool)
            for k in range(TESTS):
                bit = (h2 >> np.uint64(9 * k)) & np.uint64(511)
                hit &= (words[at + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            return pd.Series(hit)

        return rows.withColumn("_block", self.block()).filter(may_be("_block", "_h2")).drop("_block")


def rules_table(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    """Rules and listed URLs as one list of canonical URLs: rule_host, rule_path, verdict, is_rule."""
    rows = [(h, p, v, True) for h, p, v in rules] + [(u.partition("/")[0], "/" + u.partition("/")[2], "block", False) for u in listed]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, verdict string, is_rule boolean")


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """A verdict on each URL: page_id, host, path, rule, verdict, listed_url.

    pages: page_id, url. listed: rules_table(). An entry fits its host and all
    subdomains if the URL's path starts with the entry's. Rules go before listed URLs; of
    each the longest host and path wins, then the longer path, then the first by code points. A listed URL blocks
    where no rule fits; what nothing fits is allowed. Each URL's possible entries are its host's suffixes
    with its path cut to the lengths that the list has; those that pass the Bloom filter are joined with the list exactly.

    A URL's possible entries have as many labels and as long a path as some entry of the list, so that very long hosts and paths
    cost what their own length does; a list may have entries of any number and length.

    Null URLs and those without :// have an empty host and path and are allowed; repeated rows are judged
    each; empty tables give no row. An entry given twice counts once, as block if both are there; an entry without host fits nothing.
    """
    pages = pages.select("page_id", "url")
    listed = listed.filter("rule_host <> '' AND rule_path IS NOT NULL").groupBy("rule_host", "rule_path", "is_rule").agg(F.max("verdict").alias("_verdict"))
    listed = listed.withColumn("_head", F.substring("rule_path", 1, HEAD))
    shapes = listed.select(F.size(F.split("rule_host", r"\.", -1)).alias("labels"), F.length("_head").alias("long"))
    lengths, labels = (sorted(r[0] for r in shapes.select(c).distinct().collect()) for c in ("long", "labels"))
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("listed_url"))
    bloom = BlockedBloom(listed.select(*_hashes("rule_host", "_head")))
    # A host has as many labels as dots, and one more.
    own = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    tails = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.col("_labels")), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = parsed.filter("host <> ''").withColumn("_labels", own).select(*row_keys("page_id", "url"), "path", F.explode(tails).alias("rule_host"), heads.alias("heads"))
    tried = tried.select("_k1", "_k2", "path", "rule_host", F.explode("heads").alias("_head"))
    tried = bloom.filter(tried.select("*", *_hashes("rule_host", "_head"))).drop("_h1", "_h2")
    hits = tried.join(listed, ["rule_host", "_head"]).filter(F.startswith("path", "rule_path"))
    url = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(url).alias("a"), F.length("rule_path").alias("b"), url.alias("url"), F.col("_verdict").alias("v"))
    best = hits.groupBy("_k1", "_k2").agg(F.max(F.when(F.col("is_rule"), rank)).alias("rule"), F.max(F.when(~F.col("is_rule"), rank)).alias("plain"))
    out = parsed.select("*", *row_keys("page_id", "url")).join(best, ["_k1", "_k2"], "left")
    return out.select("page_id", "host", "path", F.col("rule.url").alias("rule"), F.coalesce("rule.v", "plain.v", F.lit("allow")).alias("verdict"), F.col("plain.url").alias("listed_url"))
