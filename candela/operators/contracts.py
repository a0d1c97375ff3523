"""Contracts on tables. Each is one aggregate over its input, run at once: a lazy check that nothing reads is never made."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.constants import FEATURES, IDENTIFIERS, RELEVANT, SEMANTIC_FEATURES  # noqa: F401
from candela.errors import DataIntegrityError, RankerEvalError, RankingGroupError, SchemaError, SplitError


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "table", error: type[Exception] = SchemaError) -> None:
    """Looks at the schema alone."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise error(f"{name} lacks the columns {', '.join(missing)}")


def key_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_rows, n_keys, n_duplicate_rows (rows of keys that occur twice or more) and n_duplicate_keys."""
    n = F.col("_n")
    t = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return t.agg(zero(F.sum(n)).alias("n_rows"), F.count("*").alias("n_keys"), zero(F.sum(F.when(n > 1, n))).alias("n_duplicate_rows"), F.count(F.when(n > 1, 1)).alias("n_duplicate_keys"))


def duplicate_keys(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """A sample of keys that occur twice or more, in order."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1").orderBy(*keys).limit(n)


def require_unique(df: DataFrame, keys: list[str], name: str = "table", sample: int = 5) -> dict:
    """A1, A2: the report, or DataIntegrityError."""
    report = key_report(df, keys).first().asDict()
    if report["n_duplicate_keys"]:
        shown = [r.asDict() for r in duplicate_keys(df, keys, sample).collect()]
        raise DataIntegrityError(f"{name} has {report['n_duplicate_keys']} duplicate keys, such as {shown}")
    return report


def duplicate_pairs(df: DataFrame) -> DataFrame:
    """query_id, product_id, n_rows and n_labels of pairs that occur twice or more."""
    return df.groupBy("query_id", "product_id").agg(F.count("*").alias("n_rows"), F.countDistinct("esci_label").alias("n_labels")).filter("n_rows > 1")


def check_duplicate_pairs(df: DataFrame, sample: int = 5) -> dict:
    """Counts of duplicate pairs; those with different labels raise."""
    pairs = duplicate_pairs(df)
    r = pairs.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count(F.when(F.col("n_labels") > 1, 1)).alias("n_conflicts")).first().asDict()
    if r["n_conflicts"]:
        shown = [x.asDict() for x in pairs.filter("n_labels > 1").orderBy("query_id", "product_id").limit(sample).collect()]
        raise DataIntegrityError(f"{r['n_conflicts']} pairs have different labels, such as {shown}")
    return r


def shared_queries(left: DataFrame, right: DataFrame, key: str = "query_id") -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def require_disjoint(*frames: DataFrame, key: str = "query_id", error: type[Exception] = SplitError) -> None:
    """A3: no query in two frames."""
    for i, left in enumerate(frames):
        for right in frames[i + 1 :]:
            if not shared_queries(left, right, key).isEmpty():
                raise error(f"frames share values of {key}")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Values of key on one side alone: key, in_left."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(True)), right.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").filter("_a IS NULL OR _b IS NULL").select(key, F.col("_a").isNotNull().alias("in_left"))


def require_same(left: DataFrame, right: DataFrame, key: str = "query_id", rows: bool = False, error: type[Exception] = RankerEvalError) -> None:
    """A4: equal sets of key, and equal row counts if asked for."""
    if not set_difference(left, right, key).isEmpty():
        raise error(f"the sides have different values of {key}")
    if rows and left.count() != right.count():
        raise error("the sides have different numbers of rows")


def require_no_test_rows(df: DataFrame, error: type[Exception] = DataIntegrityError) -> None:
    """A5: looks if there is a column split."""
    if "split" in df.columns and not df.filter("split = 'test'").isEmpty():
        raise error("rows of the test split")


def require_sizes(df: DataFrame, rows: int | None, queries: int | None) -> None:
    """A7."""
    r = df.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("q")).first()
    if (rows is not None and r["n"] != rows) or (queries is not None and r["q"] != queries):
        raise DataIntegrityError(f"expected {rows} rows of {queries} queries, found {r['n']} of {r['q']}")


def require_finite(df: DataFrame, columns: Iterable[str], error: type[Exception] = DataIntegrityError) -> None:
    """No null, NaN or infinity, all columns in one pass."""
    columns = list(columns)
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    r = df.agg(*[F.count(F.when(bad(c), 1)).alias(c) for c in columns]).first().asDict()
    if found := {c: n for c, n in r.items() if n}:
        raise error(f"values that aren't finite: {found}")


def require_kept(before: DataFrame, after: DataFrame, k: int | None = None) -> None:
    """A ranking has every candidate of its input, or min(k, n) of each query."""
    most = F.col("count") if k is None else F.least(F.col("count"), F.lit(k))
    a = before.groupBy("query_id").count().select("query_id", most.alias("_a"))
    b = after.groupBy("query_id").count().withColumnRenamed("count", "_b")
    if not a.join(b, a["query_id"].eqNullSafe(b["query_id"]), "full_outer").filter("NOT (coalesce(_a, 0) <=> coalesce(_b, 0))").isEmpty():
        raise RankerEvalError("the ranking adds or drops candidates")


def require_together(*frames: DataFrame) -> None:
    """A10: all rows of a query are in one frame."""
    rows = [f.select("query_id", F.lit(i).alias("_f")) for i, f in enumerate(frames)]
    t = rows[0]
    for r in rows[1:]:
        t = t.unionByName(r)
    if not t.groupBy("query_id").agg(F.countDistinct("_f").alias("n")).filter("n > 1").isEmpty():
        raise SplitError("a query's rows are in several frames")


def require_pure_split(df: DataFrame) -> None:
    """Split is train or test, no query has both, and train isn't empty."""
    t = df.groupBy("query_id").agg(F.countDistinct("split").alias("n"), F.max((F.col("split") == "train").cast("int")).alias("train"), F.max((~F.coalesce(F.col("split").isin("train", "test"), F.lit(False))).cast("int")).alias("other"))
    r = t.agg(F.sum((F.col("n") > 1).cast("int")).alias("both"), F.sum("train").alias("train"), F.sum("other").alias("other")).first()
    if r["other"]:
        raise SplitError("split has values other than train and test")
    if r["both"]:
        raise SplitError(f"{r['both']} queries are in both splits")
    if not r["train"]:
        raise SplitError("no query is in train")


def check_features(features: Iterable[str]) -> tuple[str, ...]:
    """Exactly one of the two feature lists."""
    features = tuple(features)
    if features not in (FEATURES, SEMANTIC_FEATURES):
        raise RankingGroupError("the features must be the 10 or the 11 of the model, in order")
    return features


def check_feature_subset(features: Iterable[str], among: tuple[str, ...] = SEMANTIC_FEATURES) -> tuple[str, ...]:
    """A non-empty subset without identifiers, in the model's order."""
    asked = set(features)
    if not asked or asked & set(IDENTIFIERS) or asked - set(among):
        raise RankingGroupError(f"not a feature subset: {sorted(asked)}")
    return tuple(f for f in among if f in asked)


def require_real_data(df: DataFrame, least: int = 1000) -> None:
    """Refuses a table that looks like a fixture."""
    n = df.select("query_id").distinct().count()
    if n < least:
        raise DataIntegrityError(f"only {n} queries; real data has {least} at least")
