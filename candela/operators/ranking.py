"""Deterministic ranks within a query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.constants import GAINS, K, RELEVANT
from candela.errors import DataIntegrityError
from candela.operators.contracts import require_columns, require_kept

#: A scorer adds a score column to a table of candidates.
Scorer = Callable[[DataFrame], DataFrame]


def nan_last(score: Column) -> Column:
    """NaN as null: it stands last in a descending order, where Spark would put it first."""
    return F.nanvl(score.cast("double"), F.lit(None).cast("double"))


def rank_order(df: DataFrame, score: str, id_column: str = "product_id") -> list[Column]:
    """Score descending, then ids in ascending order as strings ("10" before "9")."""
    ids = [F.col(id_column).cast("string").asc(), *([F.col("example_id").cast("string").asc()] if "example_id" in df.columns else [])]
    return [nan_last(F.col(score)).desc_nulls_last(), *ids]


def sort_and_rank(df: DataFrame, score: str, k: int | None = None, id_column: str = "product_id", rank: str = "predicted_rank") -> DataFrame:
    """Df with 1-based ranks by query; k keeps the first k. One shuffle by query_id, which later ranks share."""
    if k is not None and k < 0:
        raise ValueError("k is negative")
    require_columns(df, ("query_id", id_column, score), error=KeyError)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(*rank_order(df, score, id_column))))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)


def rank_scored(df: DataFrame, score: str, k: int | None = None, check: bool = False) -> DataFrame:
    """sort_and_rank, and A8 if asked for."""
    ranked = sort_and_rank(df, score, k)
    if check:
        require_kept(df, ranked, k)
    return ranked


def rerank(df: DataFrame, scorer: Scorer, score: str, k: int | None = None, check: bool = False) -> DataFrame:
    """Score all queries in one plan, then rank."""
    return rank_scored(scorer(df), score, k, check)


def add_ranks(df: DataFrame, scores: dict[str, str], id_column: str = "product_id") -> DataFrame:
    """A rank column for each score column, {score: rank}; absent scores are passed over. All share one shuffle."""
    for score, rank in scores.items():
        if score in df.columns:
            df = sort_and_rank(df, score, id_column=id_column, rank=rank)
    return df


def gain_of(label: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in GAINS.items() for x in (F.lit(k), F.lit(v))]), label)


def add_relevance_gain(df: DataFrame, check: bool = True) -> DataFrame:
    """PR5: relevance_gain of esci_label; unknown labels, then null ones, raise."""
    if check:
        known = F.col("esci_label").isin(*GAINS)
        r = df.agg(F.count(F.when(~known, 1)).alias("unknown"), F.count(F.when(F.col("esci_label").isNull(), 1)).alias("null")).first()
        if r["unknown"]:
            raise DataIntegrityError(f"{r['unknown']} unknown labels")
        if r["null"]:
            raise DataIntegrityError(f"{r['null']} null labels")
    return df.withColumn("relevance_gain", F.when(F.col("esci_label").isin(*GAINS), gain_of(F.col("esci_label"))))


def is_relevant(label: str = "esci_label") -> Column:
    return F.coalesce(F.col(label).isin(*RELEVANT), F.lit(False))


def per_query_metrics(ranked: DataFrame, k: int = K, rank: str = "predicted_rank", with_query: bool = True) -> DataFrame:
    """query_id, query, n_candidates, ndcg@k, recall@k and mrr of every query, the null one too.

    NDCG has linear gains and the ideal order of all candidates, and is 0 without gain or for k < 1;
    MRR has no cutoff. The ideal order is another rank over the partitioning that ranking left.
    """
    t = with_ideal(ranked).groupBy("query_id").agg(
        *([F.min_by("query", F.col("example_id").cast("string")).alias("query")] if with_query and "query" in ranked.columns else []),
        F.count("*").alias("n_candidates"),
        *[m.alias(name) for name, m in zip((f"ndcg@{k}", f"recall@{k}", "mrr"), _metrics(k, rank), strict=True)],
    )
    return t


def with_ideal(df: DataFrame) -> DataFrame:
    return df.withColumn("_ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance_gain").desc())))


def _metrics(k: int, rank: str) -> tuple[Column, Column, Column]:
    """NDCG, recall and MRR as aggregates of a query's rows."""
    discounted = lambda r: F.sum(F.when(F.col(r) <= k, F.col("relevance_gain") / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return (
        zero(F.try_divide(discounted(rank), discounted("_ideal"))),
        zero(F.try_divide(hit(is_relevant() & (F.col(rank) <= k)), hit(is_relevant()))),
        zero(1.0 / F.min(F.when(is_relevant(), F.col(rank)))),
    )


def mean_metrics(df: DataFrame, scores: list[str], k: int = K) -> list[dict[str, float]]:
    """For each score column the means of per_query_metrics() of its ranking: ndcg, recall and mrr. All share one shuffle and one ideal order."""
    ids = [c for c in ("product_id", "example_id") if c in df.columns]
    t = add_ranks(df.select("query_id", *ids, "relevance_gain", "esci_label", *scores), {s: f"{s}_rank" for s in scores})
    names = [(s, m, f"{s}_{m}") for s in scores for m in ("ndcg", "recall", "mrr")]
    t = with_ideal(t).groupBy("query_id").agg(*[m.alias(f"{s}_{name}") for s in scores for name, m in zip(("ndcg", "recall", "mrr"), _metrics(k, f"{s}_rank"), strict=True)])
    r = t.agg(*[F.avg(c).alias(c) for _, _, c in names]).first()
    return [{m: r[c] for s, m, c in names if s == score} for score in scores]


def summarize_metrics(per_query: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """A row for each metric: metric, n, mean, median, std (sample; 0 for one query), p25, p75 (linear)."""
    metrics = metrics or [c for c in per_query.columns if c.startswith(("ndcg", "recall", "mrr"))]
    stacked = per_query.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("v")) for m in metrics])).alias("x")).select("x.*")
    return stacked.groupBy("metric").agg(
        F.count("*").alias("n"),
        F.avg("v").alias("mean"),
        F.median("v").alias("median"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
        F.percentile("v", F.lit(0.25)).alias("p25"),
        F.percentile("v", F.lit(0.75)).alias("p75"),
    )
