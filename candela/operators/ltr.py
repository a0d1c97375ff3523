"""Learning to rank: grouped data, rankers, importance, ablation."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.constants import FEATURES, K, OVERLAP_FEATURES, ROUNDS, SEED, STRUCTURED_FEATURES
from candela.errors import RankingGroupError
from candela.operators import lambdamart
from candela.operators.contracts import check_feature_subset, require_columns
from candela.operators.lambdamart import Trees
from candela.operators.ranking import mean_metrics, per_query_metrics, rank_scored

#: What each ablation trains on.
ABLATIONS = {
    "full": FEATURES,
    "lexical_scores": ("bm25_score", "tfidf_score"),
    "minus_tfidf": tuple(f for f in FEATURES if f != "tfidf_score"),
    "minus_bm25": tuple(f for f in FEATURES if f != "bm25_score"),
    "minus_overlap": tuple(f for f in FEATURES if f not in OVERLAP_FEATURES),
    "minus_structured": tuple(f for f in FEATURES if f not in STRUCTURED_FEATURES),
}


def grouped(df: DataFrame, features: Iterable[str] = FEATURES, label: str = "relevance_gain") -> DataFrame:
    """M1: df with label, features (vector) and, for a query's size, group_size.

    Rows need no order: the key makes the group. Null or non-finite features raise nothing here (see A9).
    """
    features = check_feature_subset(features)
    require_columns(df, ("example_id", "query_id", label, *features), error=RankingGroupError)
    t = df.withColumns({"label": F.col(label).cast("double"), "group_size": F.count("*").over(Window.partitionBy("query_id"))})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(t.drop("features"))


@dataclass
class Ranker:
    """M2-M5: boosted trees over grouped data.

    objective "ndcg": LambdaMART, see candela.operators.lambdamart, with the reference's parameters as defaults; its trees aren't
    those of another library's rank:ndcg. "squares": GBTRegressor on the gains, point by point.
    """

    features: tuple[str, ...] = FEATURES
    objective: str = "ndcg"
    rounds: int = ROUNDS
    depth: int = 4
    rate: float = 0.1
    subsample: float = 0.8
    columns: float = 0.8
    seed: int = SEED
    tasks: int | None = None
    history: list[dict] = field(default_factory=list)
    trees: Trees | None = None
    models: list = field(default_factory=list)

    def fit(self, train: DataFrame | Together, validation: DataFrame | None = None, label: str = "relevance_gain") -> Ranker:
        """No early stopping. With rows that rankers share, it is trained when these are. history has NDCG@10 of both sides after each round, with gains 2**label - 1 and 1 for queries without gain
        ("ndcg"), or after the last one, as per_query_metrics() has it ("squares")."""
        features = check_feature_subset(self.features)
        if isinstance(train, Together):
            train.rankers.append(self)
        elif self.objective == "squares":
            data = grouped(train, features, label)
            self.models = [GBTRegressor(maxIter=self.rounds, maxDepth=self.depth, stepSize=self.rate, subsamplingRate=self.subsample, seed=self.seed).fit(data.select("features", "label"))]
            self.history = [{side: self.ndcg(t) for side, t in (("train", train), ("validation", validation)) if t is not None}]
        elif self.objective == "ndcg":
            Together(train, validation, label, [self]).train_all()
        else:
            raise ValueError(f"unknown objective {self.objective!r}")
        return self

    def history_final(self) -> dict[str, float | None]:
        """M5: the last round's NDCG@10 of both sides; None for a side that wasn't evaluated."""
        last = self.history[-1] if self.history else {}
        return {f"{side}_ndcg@10": last.get(side) for side in ("train", "validation")}

    def transform(self, df: DataFrame, score: str = "xgb_score") -> DataFrame:
        """M4: df with a score for each row."""
        if self.objective == "ndcg":
            return df.withColumn(score, self.trees.column())
        return self.models[0].transform(grouped(df, self.features)).withColumnRenamed("prediction", score).drop("features", "label", "group_size")

    def ndcg(self, df: DataFrame, k: int = K) -> float:
        return per_query_metrics(rank_scored(self.transform(df, "_s"), "_s"), k, with_query=False).agg(F.avg(f"`ndcg@{k}`")).first()[0]

    def importance(self) -> list[dict]:
        """Features by the mean gain of their splits ("ndcg") or Spark's total ("squares"); shares of 1, or 0."""
        if self.objective == "ndcg":
            return importance_table(self.trees.mean_gains(), self.features)
        return importance_table(dict(zip(check_feature_subset(self.features), self.models[0].featureImportances.toArray().tolist(), strict=True)), self.features)

    def save(self, path: str) -> None:
        """SK7."""
        spark = SparkSession.active()
        meta = {k: getattr(self, k) for k in ("features", "objective", "rounds", "depth", "rate", "subsample", "columns", "seed", "history")}
        for i, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/model-{i}")
        lines = [(0, json.dumps(meta)), *([(1, self.trees.to_json())] if self.trees else [])]
        spark.createDataFrame(lines, "i int, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(path: str) -> Ranker:
        lines = {r["i"]: r["value"] for r in SparkSession.active().read.parquet(f"{path}/meta").collect()}
        meta = json.loads(lines[0])
        models = [GBTRegressionModel.load(f"{path}/model-0")] if meta["objective"] == "squares" else []
        return Ranker(**(meta | {"features": tuple(meta["features"])}), models=models, trees=Trees.from_json(lines[1]) if 1 in lines else None)


@dataclass
class Together:
    """Rows that rankers with the objective "ndcg" which differ in their features alone are fitted to, dealt once for all."""

    train: DataFrame
    validation: DataFrame | None = None
    label: str = "relevance_gain"
    rankers: list[Ranker] = field(default_factory=list)

    def train_all(self) -> None:
        first, subsets = self.rankers[0], [check_feature_subset(r.features) for r in self.rankers]
        features = check_feature_subset({f for of in subsets for f in of})
        same = ("objective", "rounds", "depth", "rate", "subsample", "columns", "seed", "tasks")
        if first.objective != "ndcg" or any(getattr(r, k) != getattr(first, k) for r in self.rankers for k in same):
            raise ValueError("rankers that share rows differ in more than their features")
        rows = None
        for i, t in enumerate((self.train, self.validation)):
            if t is not None:
                require_columns(t, ("example_id", "query_id", self.label, *features), error=RankingGroupError)
                t = t.select("example_id", "query_id", F.col(self.label).cast("double").alias("label"), *features, F.lit(i).alias("_side"))
                rows = t if rows is None else rows.unionByName(t)
        found = lambdamart.fit(rows, list(features), "label", "_side", first.tasks, first.rounds, first.depth, first.rate, first.subsample, first.columns, first.seed, subsets=[list(of) for of in subsets])
        for ranker, trees in zip(self.rankers, found, strict=True):
            ranker.trees, ranker.history = trees, trees.history


def xgboost_ranker(features: Iterable[str] = FEATURES, **parameters):
    """XGBoost's own Spark ranker with rank:ndcg, where that library is installed."""
    from xgboost.spark import SparkXGBRanker

    defaults = {"objective": "rank:ndcg", "n_estimators": 200, "max_depth": 4, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "tree_method": "hist", "random_state": SEED}
    return SparkXGBRanker(features_col=list(features), label_col="relevance_gain", qid_col="query_id", **(defaults | parameters))


def importance_table(gains: dict[str, float], features: Iterable[str]) -> list[dict]:
    """Feature, gain (0 if missing), share of the sum (0 if that is 0) and rank by gain, ties in the features' order."""
    rows = [(f, float(gains.get(f, 0.0))) for f in features]
    total = sum(g for _, g in rows)
    rows.sort(key=lambda r: -r[1])
    return [{"feature": f, "gain": g, "normalized_gain": g / total if total else 0.0, "rank": i + 1} for i, (f, g) in enumerate(rows)]


def predictions_equivalent(a: DataFrame, b: DataFrame, score: str = "xgb_score", tolerance: float = 1e-9) -> bool:
    t = a.select("example_id", F.col(score).alias("_a")).join(b.select("example_id", F.col(score).alias("_b")), "example_id", "full_outer")
    return t.filter(F.coalesce(F.abs(F.col("_a") - F.col("_b")) > tolerance, F.lit(True))).isEmpty()


def score_saved(path: str, df: DataFrame, score: str = "xgb_score") -> DataFrame:
    """M6: load, score and rank."""
    return rank_scored(Ranker.load(path).transform(df, score), score)


def ablation(train: DataFrame, validation: DataFrame, subsets: dict[str, tuple[str, ...]] = ABLATIONS, k: int = K, **options) -> list[dict]:
    """M7: name, n_features and mean metrics of a ranker trained on each subset, all from one dealing of the rows where the objective is "ndcg", and evaluated in one pass."""
    models = [Ranker(features=check_feature_subset(features), **options) for features in subsets.values()]
    rows = Together(train) if models and models[0].objective == "ndcg" else train
    models = [model.fit(rows) for model in models]
    if rows is not train:
        rows.train_all()
    if not models:
        return []
    scored, scores = validation, [f"_s{i}" for i in range(len(models))]
    for score, model in zip(scores, models, strict=True):
        scored = model.transform(scored, score)
    means = mean_metrics(scored, scores, k)
    return [{"name": name, "n_features": len(features), **r} for (name, features), r in zip(subsets.items(), means, strict=True)]
