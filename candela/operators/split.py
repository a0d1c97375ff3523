"""Query-level splits without leaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.constants import SEED, TRAIN_FRACTION
from candela.errors import SplitError
from candela.operators.contracts import require_disjoint, require_pure_split, require_together


def hash_split(df: DataFrame, seed: int = SEED, fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Rows of the train split with partition: train for the first int(n * fraction) queries by hash, validation for the others.

    Queries are counted in 1024 hash groups in the order of the hash; only the groups' counts are
    summed in one place, and only the group at the boundary is ranked.
    """
    if not 0 < fraction < 1:
        raise SplitError("the fraction must be between 0 and 1")
    ids = df.filter("split = 'train'").select("query_id").distinct().withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"))))
    ids = ids.withColumn("g", F.substring("h", 1, 2))
    groups = ids.groupBy("g").agg(F.count("*").alias("k"))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    groups = groups.select("g", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"), F.floor(F.sum("k").over(whole) * F.lit(fraction)).alias("cut"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("h", "query_id"))
    ids = ids.withColumn("place", place).join(groups, "g").select("query_id", F.when(F.col("before") + F.col("place") <= F.col("cut"), "train").otherwise("validation").alias("partition"))
    return df.filter("split = 'train'").join(ids, "query_id")


def split_official(df: DataFrame, seed: int = SEED, fraction: float = TRAIN_FRACTION, exact: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SP1: (train, validation, test), each with its name in the column partition.

    exact: the sorted ids of the train split are shuffled by NumPy's generator on the driver, one id for each
    query, as published results have it; else hash_split().
    """
    if not 0 < fraction < 1:
        raise SplitError("the fraction must be between 0 and 1")
    require_pure_split(df)
    test = df.filter("split = 'test'").withColumn("partition", F.lit("test"))
    if exact:
        ids = np.array(sorted(r[0] for r in df.filter("split = 'train'").select("query_id").distinct().collect()))
        np.random.default_rng(seed).shuffle(ids)
        n = int(len(ids) * fraction)
        if not 0 < n < len(ids):
            raise SplitError("a side of the split is empty")
        spark, kind = df.sparkSession, df.schema["query_id"].dataType.simpleString()
        named = spark.createDataFrame([(i.item(), "train" if k < n else "validation") for k, i in enumerate(ids)], f"query_id {kind}, partition string")
        own = df.filter("split = 'train'").join(named, "query_id")
    else:
        own = hash_split(df, seed, fraction)
    train, validation = own.filter("partition = 'train'"), own.filter("partition = 'validation'")
    for name, t in (("train", train), ("validation", validation)):
        if t.isEmpty():
            raise SplitError(f"{name} is empty")
    require_disjoint(train, validation, test)
    require_together(train, validation, test)
    return train, validation, test


def partition_counts(*frames: DataFrame) -> DataFrame:
    """Partition, n_rows, n_queries."""
    t = frames[0].select("partition", "query_id")
    for f in frames[1:]:
        t = t.unionByName(f.select("partition", "query_id"))
    return t.groupBy("partition").agg(F.count("*").alias("n_rows"), F.countDistinct("query_id").alias("n_queries"))
