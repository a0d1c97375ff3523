"""What the corpus operators share: row keys, word patterns, lineage cuts and tokenizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.plans.lineage import cut, fresh_path, written  # noqa: F401
from candela.session import importable  # noqa: F401

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row.

    The optimizer copies a column into every place that names it, also into
    lambdas that run once for each element; a lambda's own variable isn't copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row, whatever is made of it.

    A projection's expression is copied into filters and projections above it; what a
    generator gives isn't.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def words_of(text: Column) -> Column:
    """The words of a text, in order; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def row_keys(*columns: str) -> list[Column]:
    """128 bits that name a row by these columns, null-safe, for joins back to it."""
    parts = [F.when(F.col(f"`{c}`").isNull(), F.lit(1)).otherwise(F.lit(0)) for c in columns] + [F.col(f"`{c}`") for c in columns]
    return [F.xxhash64(F.lit(1), *parts).alias("_k1"), F.xxhash64(F.lit(2), *parts).alias("_k2")]


def whole(docs: DataFrame, *more: Column | str) -> DataFrame:
    """The whole row as one column _row, so that columns of any name can't clash, and what else is asked for."""
    return docs.select(F.struct("*").alias("_row"), *more)
