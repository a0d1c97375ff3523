"""Scans of raw and prepared tables, and sinks. Columns and filters reach the Parquet reader."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from candela.constants import EXAMPLE_COLUMNS, PRODUCT_COLUMNS, SEMANTIC_COLUMNS
from candela.errors import DataIntegrityError, MissingRawDataError
from candela.operators.contracts import require_columns, require_disjoint, require_no_test_rows, require_sizes

EXAMPLES, PRODUCTS = "shopping_queries_dataset_examples.parquet", "shopping_queries_dataset_products.parquet"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_raw_files(spark: SparkSession, raw_dir: str, names: Iterable[str] = (EXAMPLES, PRODUCTS)) -> None:
    """SC1."""
    missing = [n for n in names if not exists(spark, f"{raw_dir}/{n}")]
    if missing:
        raise MissingRawDataError(f"{raw_dir} lacks {', '.join(missing)}")


def scan(spark: SparkSession, path: str, columns: Iterable[str], name: str = "table") -> DataFrame:
    """SC2, SC3: the columns, after a look at the footer's schema; no row is read here."""
    t = spark.read.parquet(path)
    require_columns(t, columns, name)
    return t.select(*columns)


def load_examples(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, EXAMPLE_COLUMNS, "examples")


def load_products(spark: SparkSession, path: str, locale: str | None = "us") -> DataFrame:
    """SC4: the locale's products; the filter is pushed into the scan."""
    t = scan(spark, path, PRODUCT_COLUMNS, "products")
    return t if locale is None else t.filter(F.col("product_locale") == locale)


def load_cached_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """SC6: None if the file isn't there."""
    return scan(spark, path, ("example_id", "bm25_score", "tfidf_score"), "scores") if exists(spark, path) else None


def load_development(spark: SparkSession, path: str, columns: Iterable[str] = (), rows: int | None = None, queries: int | None = None) -> DataFrame:
    """SC7: a table of the development splits; rows of the test split and unexpected sizes raise."""
    t = spark.read.parquet(path)
    require_columns(t, columns)
    require_no_test_rows(t)
    if rows is not None or queries is not None:
        require_sizes(t, rows, queries)
    return t


def load_semantic_sources(spark: SparkSession, folder: str, sizes: dict[str, tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """SC5: five columns (and split, for the guard) of train and validation, disjoint, of the expected sizes if given."""
    out = []
    for name in ("train", "validation"):
        t = load_development(spark, f"{folder}/{name}.parquet", SEMANTIC_COLUMNS, *(sizes or {}).get(name, (None, None)))
        out.append(t.select(*SEMANTIC_COLUMNS))
    require_disjoint(*out)
    return out[0], out[1]


def load_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SC8: with a header and a given schema."""
    return spark.read.csv(path, header=True, schema=schema)


def load_json(spark: SparkSession, path: str) -> dict:
    """SC9: one document, by Spark's reader, so from any file system."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect()))


def load_baselines(spark: SparkSession, csv: str, summary: str, schema: str, metrics: dict[str, tuple[str, ...]], tolerance: float = 1e-9) -> tuple[DataFrame, dict]:
    """SC10: per-query metrics whose means are those of the summary. metrics: {column: keys of its mean in the summary}."""
    t, doc = load_csv(spark, csv, schema), load_json(spark, summary)
    means = t.agg(*[F.avg(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(metrics)]).first()
    for i, (column, keys) in enumerate(metrics.items()):
        want = doc
        for k in keys:
            want = want[k]
        if abs(means[i] - want) > tolerance:
            raise DataIntegrityError(f"{column}: mean {means[i]}, in the summary {want}")
    return t, doc


def load_mixed(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """SC11: CSV, Parquet and JSON files by their endings as one table with _source_file; others are passed over."""
    out = None
    for p in paths:
        kind = p.rsplit(".", 1)[-1].lower()
        if kind not in ("csv", "parquet", "json"):
            continue
        t = spark.read.csv(p, header=True, inferSchema=True) if kind == "csv" else spark.read.json(p, multiLine=True) if kind == "json" else spark.read.parquet(p)
        t = t.withColumn("_source_file", F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise MissingRawDataError("no file to read")
    return out


def write_parquet(df: DataFrame, path: str) -> None:
    """SK1, SK2: overwrites."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SK3: one file with a header, for results of a bounded size."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_sample(df: DataFrame, path: str, order: list[str], n: int = 50) -> bool:
    """SK4: the first n rows by `order`, if there are any."""
    t = df.orderBy(*order).limit(n)
    if t.isEmpty():
        return False
    write_csv(t, path)
    return True


def json_ready(value):
    """SK5: rows and NumPy values as plain ones, anything else as text."""
    if hasattr(value, "asDict"):
        return json_ready(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_ready(v) for v in value]
    if hasattr(value, "item"):
        return value.item()
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def write_json(spark: SparkSession, path: str, payload) -> None:
    """SK5: a folder with one text file, in any file system that Spark writes."""
    spark.createDataFrame([(json.dumps(json_ready(payload), indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, n: int = 10) -> str:
    """SK6: the first n rows; | is escaped."""
    cell = lambda v: ("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", "\\|")
    rows = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in df.limit(n).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
