"""Paired comparison of rankers: deltas, wins, bootstrap intervals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.constants import REPLICATES, SEED, TIE_TOLERANCE
from candela.errors import RankerEvalError
from candela.operators.contracts import require_same, require_unique
from candela.session import importable


def paired(left: DataFrame, right: DataFrame, metric: str) -> DataFrame:
    """query_id, left, right and diff of queries that both have."""
    pick = lambda t, name: t.select("query_id", F.col(f"`{metric}`").alias(name))
    return pick(left, "left_value").join(pick(right, "right_value"), "query_id").withColumn("diff", F.col("left_value") - F.col("right_value"))


def merge_scores(left: DataFrame, right: DataFrame, score: str) -> DataFrame:
    """Left with another ranker's score by example_id; ids must be unique and the same on both sides, and no column is overwritten."""
    for side, name in ((left, "left"), (right, "right")):
        require_unique(side, ["example_id"], name)
    require_same(left, right, "example_id")
    if score in left.columns:
        raise RankerEvalError(f"both sides have {score}")
    return left.join(right.select("example_id", score), "example_id")


def outcome_counts(diff: Column, tolerance: float = 0.0) -> list[Column]:
    """Wins, losses and ties; a difference up to the tolerance is a tie."""
    count = lambda c: F.count(F.when(c, 1))
    return [count(diff > tolerance).alias("wins"), count(diff < -tolerance).alias("losses"), count(F.abs(diff) <= tolerance).alias("ties")]


def compare_models(left: DataFrame, right: DataFrame, metric: str) -> DataFrame:
    """n_queries, mean_diff, wins, losses, ties (of exactly 0)."""
    return paired(left, right, metric).agg(F.count("*").alias("n_queries"), F.avg("diff").alias("mean_diff"), *outcome_counts(F.col("diff")))


def extreme_deltas(pairs: DataFrame, n: int = 10, column: str = "diff") -> DataFrame:
    """TK2, TK3: the n largest and the n smallest differences, ties by query_id, with side (top or bottom) and place."""

    def side(name: str, order: Column) -> DataFrame:
        rows = pairs.orderBy(order, "query_id").limit(n)
        from pyspark.sql.window import Window

        return rows.select(F.lit(name).alias("side"), F.row_number().over(Window.orderBy(order, "query_id")).alias("place"), *pairs.columns)

    return side("top", F.col(column).desc()).unionByName(side("bottom", F.col(column).asc()))


def paired_summary(left: DataFrame, right: DataFrame, metric: str, tolerance: float = TIE_TOLERANCE, check: bool = True) -> DataFrame:
    """Equal query sets, then n_queries, mean and median of the difference, outcomes and their rates (0 without queries)."""
    if check:
        require_same(left, right)
    t = paired(left, right, metric).agg(F.count("*").alias("n_queries"), F.avg("diff").alias("mean_diff"), F.median("diff").alias("median_diff"), *outcome_counts(F.col("diff"), tolerance))
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_queries").cast("double")), F.lit(0.0))
    return t.withColumns({"win_rate": rate("wins"), "loss_rate": rate("losses"), "tie_rate": rate("ties")})


def paired_metric_table(left: DataFrame, right: DataFrame, left_name: str, right_name: str, k: int = 10, check: bool = True) -> DataFrame:
    """query_id, query, n_candidates, {name}_{metric} of both, and their deltas (left - right)."""
    if check:
        require_same(left, right)
    names = {f"ndcg@{k}": f"ndcg_at_{k}", f"recall@{k}": f"recall_at_{k}", "mrr": "mrr"}
    pick = lambda t, p: [F.col(f"`{m}`").alias(f"{p}_{n}") for m, n in names.items()]
    more = [c for c in ("query", "n_candidates") if c in left.columns]
    t = left.select("query_id", *more, *pick(left, left_name)).join(right.select("query_id", *pick(right, right_name)), "query_id")
    return t.withColumns({f"delta_{n}": F.col(f"{left_name}_{n}") - F.col(f"{right_name}_{n}") for n in names.values()})


def _poisson(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """A Poisson number of mean 1 for each key (row) and replicate (column), which depends on both and the seed alone."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = (keys + np.uint64(seed) * odd)[:, None] ^ ((np.arange(replicates, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))[None, :]
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
        x ^= x >> np.uint64(31)
    shares = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 16.0)])))
    return np.searchsorted(shares, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def bootstrap_mean(deltas: DataFrame, column: str, replicates: int = REPLICATES, seed: int = SEED, level: float = 0.95, method: str = "exact") -> dict:
    """SP2: mean and percentile interval of the mean, resampling queries.

    exact: NumPy's choice with replacement, as published results have it; a double for each query comes to the driver.
    poisson: every query weighs a Poisson number in each replicate, seeded by query and summed where its rows are, so
    that only two sums for each replicate and task move, at any number of queries. deltas needs query_id.
    """
    tails = [(1 - level) / 2, (1 + level) / 2]
    if method == "exact":
        order = ["query_id"] if "query_id" in deltas.columns else [column]
        x = np.array([r[0] for r in deltas.orderBy(*order).select(column).collect()], dtype=float)
        if not len(x):
            raise ValueError("no deltas")
        rng, means = np.random.default_rng(seed), []
        for at in range(0, replicates, 200):
            means.append(rng.choice(x, size=(min(200, replicates - at), len(x)), replace=True).mean(axis=1))
        low, high = np.quantile(np.concatenate(means), tails)
        n, mean = len(x), float(x.mean())
    else:
        importable(deltas.sparkSession)

        def weigh(frames):
            import pandas as pd

            total = np.zeros((2, replicates))
            for pdf in frames:
                q, v = pdf["q"].to_numpy().view(np.uint64), pdf["v"].to_numpy()
                for at in range(0, len(v), 512):
                    w = _poisson(q[at : at + 512], replicates, seed)
                    total += np.stack([v[at : at + 512] @ w, w.sum(axis=0)])
            yield pd.DataFrame({"i": np.arange(replicates), "s": total[0], "n": total[1]})

        rows = deltas.select(F.xxhash64("query_id").alias("q"), F.col(column).cast("double").alias("v"))
        sums = rows.mapInPandas(weigh, "i int, s double, n double").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m"))
        whole = deltas.agg(F.count(column).alias("n"), F.avg(column).alias("m")).first()
        low, high = np.quantile([r["m"] for r in sums.collect()], tails)
        n, mean = whole["n"], whole["m"]
    return {"mean": mean, "ci_low": float(low), "ci_high": float(high), "n": n, "n_replicates": replicates, "level": level, "unit": "query", "method": method}
