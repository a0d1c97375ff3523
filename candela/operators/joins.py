"""Joins with checked cardinality, filters and profiles of examples and products."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.constants import EXAMPLE_COLUMNS, PRODUCT_COLUMNS
from candela.errors import DataIntegrityError
from candela.functions.text import strip
from candela.operators.contracts import require_columns, require_unique

PRODUCT_KEYS = ["product_id", "product_locale"]


def filter_examples(df: DataFrame, locale: str = "us", small: bool = True, check: bool = True) -> DataFrame:
    """small_version = 1 and the locale; nothing left raises."""
    t = df.filter(F.col("product_locale") == locale)
    t = t.filter("small_version = 1") if small else t
    if check and t.isEmpty():
        raise DataIntegrityError("no example is left")
    return t


def filter_products(df: DataFrame, locale: str = "us", check: bool = True) -> DataFrame:
    """F2."""
    t = df.filter(F.col("product_locale") == locale)
    if check and t.isEmpty():
        raise DataIntegrityError("no product is left")
    return t


def select_queries(df: DataFrame, ids: DataFrame, key: str = "query_id") -> DataFrame:
    """rows of the given queries, by a semi join whose side Spark broadcasts if its size allows."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def queries_named(df: DataFrame, text: str, ignore_case: bool = False) -> DataFrame:
    """rows of the query with this text; none raises."""
    t = df.filter(F.lower("query") == text.lower()) if ignore_case else df.filter(F.col("query") == text)
    if t.isEmpty():
        raise DataIntegrityError(f"no query {text!r}")
    return t


def merge_products(examples: DataFrame, products: DataFrame, check: bool = True, null_keys: bool = False) -> DataFrame:
    """Examples with their products' columns and product_matched; unmatched rows stay.

    Products must be unique by id and locale, so rows can't multiply. null_keys: null keys match each other.
    """
    require_columns(examples, PRODUCT_KEYS, "examples")
    require_columns(products, PRODUCT_KEYS, "products")
    if check:
        require_unique(products, PRODUCT_KEYS, "products")
    right = products.select(*[F.col(k).alias(f"_{k}") for k in PRODUCT_KEYS], *[c for c in products.columns if c not in PRODUCT_KEYS], F.lit(True).alias("_m"))
    same = lambda k: examples[k].eqNullSafe(right[f"_{k}"]) if null_keys else examples[k] == right[f"_{k}"]
    t = examples.join(right, same(PRODUCT_KEYS[0]) & same(PRODUCT_KEYS[1]), "left")
    return t.withColumn("product_matched", F.col("_m").isNotNull()).drop("_m", *[f"_{k}" for k in PRODUCT_KEYS])


def merge_report(merged: DataFrame) -> DataFrame:
    """One row: n_rows, n_matched, n_unmatched."""
    m = F.col("product_matched")
    return merged.agg(F.count("*").alias("n_rows"), F.count(F.when(m, 1)).alias("n_matched"), F.count(F.when(~m, 1)).alias("n_unmatched"))


def unmatched(examples: DataFrame, products: DataFrame) -> DataFrame:
    """examples without a product."""
    return examples.join(products.select(*PRODUCT_KEYS), PRODUCT_KEYS, "left_anti")


def dataset_statistics(df: DataFrame) -> DataFrame:
    """G1: one row of counts, and of candidates for each query."""
    per = df.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("query").alias("texts"))
    at = lambda p: F.percentile("n", F.lit(p))
    a = per.agg(
        F.sum("n").alias("n_rows"), F.count("query_id").alias("n_query_ids"), F.count(F.when(F.col("texts") > 1, 1)).alias("n_ids_with_several_texts"), F.min("n").alias("min_candidates"), F.max("n").alias("max_candidates"),
        F.avg("n").alias("mean_candidates"), F.median("n").alias("median_candidates"), at(0.25).alias("p25_candidates"), at(0.75).alias("p75_candidates"),
    )
    b = df.agg(F.countDistinct("query").alias("n_queries"), F.countDistinct("product_id").alias("n_products"))
    return a.join(b, F.lit(True))  # one row each


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """G1: column, value, n, with nulls."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return stacked.groupBy("column", "value").agg(F.count("*").alias("n"))


def missingness(df: DataFrame, *columns: str) -> DataFrame:
    """Column, n_missing, n_missing_or_blank, in one pass over all columns."""
    kinds = dict(df.dtypes)

    def counts(c: str) -> Column:
        null = F.col(c).isNull()
        blank = null | (strip(c) == "") if kinds[c] == "string" else null
        return F.struct(F.lit(c).alias("column"), F.count(F.when(null, 1)).alias("n_missing"), F.count(F.when(blank, 1)).alias("n_missing_or_blank"))

    return df.agg(F.array(*map(counts, columns or df.columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def wide_metrics(tables: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """Per-query metrics of several models side by side, as {model}_{metric}; queries that all have."""
    out = None
    for model, t in tables.items():
        own = t.select("query_id", *[F.col(f"`{m}`").alias(f"{model}_{m}") for m in metrics])
        out = own if out is None else out.join(own, "query_id")
    return out


def outer_examples(tables: dict[str, DataFrame], key: str | list[str] = "example_id") -> DataFrame:
    """Candidates under several rankings, full outer by key (of many queries: query_id and example_id): {model}_score, {model}_rank."""
    keys = [key] if isinstance(key, str) else key
    out = None
    for model, t in tables.items():
        own = t.select(*keys, F.col("score").alias(f"{model}_score"), F.col("predicted_rank").alias(f"{model}_rank"))
        out = own if out is None else out.join(own, keys, "full_outer")
    return out


def outer_ranked(df: DataFrame, models: Iterable[str], keys: Iterable[str] = ("query_id", "example_id")) -> DataFrame:
    """J8 for whole rankings of one table, which has {model}_score and {model}_rank: what outer_examples() makes of the lists, where they lie.

    Every row is in every list, so nothing moves that a window by the first key hasn't moved. A key of several rows gives all their combinations, and
    rows with a null in their key meet no other, as in the joins.
    """
    models, keys = list(models), list(keys)
    entry = {m: F.struct(F.col(f"{m}_score").alias("score"), F.col(f"{m}_rank").alias("rank")) for m in models}
    none = {m: F.struct(*[F.lit(None).cast(df.schema[f"{m}_{c}"].dataType).alias(c) for c in ("score", "rank")]) for m in models}
    df = df.withColumns({f"_{m}": F.collect_list(entry[m]).over(Window.partitionBy(*keys)) for m in models[1:]})

    def with_next(found: Column, before: list[str], m: str) -> Column:
        return F.flatten(F.transform(found, lambda x: F.transform(F.col(f"_{m}"), lambda y: F.struct(*[x[k].alias(k) for k in before], y.alias(m)))))

    met = F.array(F.struct(entry[models[0]].alias(models[0])))
    for i, m in enumerate(models[1:], 1):
        met = with_next(met, models[:i], m)
    alone = F.array(*[F.struct(*[(entry if k == m else none)[k].alias(k) for k in models]) for m in models])
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    t = df.select(*keys, F.explode(F.when(missing, alone).otherwise(met)).alias("_x"))
    return t.select(*keys, *[F.col(f"_x.{m}.{c}").alias(f"{m}_{c}") for m in models for c in ("score", "rank")])
