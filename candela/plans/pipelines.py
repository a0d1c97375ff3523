"""Whole runs: preparation, baselines, features, training, evaluation and analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.constants import FEATURES, K, SEED, SEMANTIC_FEATURES, TRAIN_FRACTION
from candela.functions.text import add_product_text
from candela.operators import compare, contracts, diagnostics, features, joins, lexical, ltr, ranking, split
from candela.plans.lineage import cut
from candela.sources import tables

#: Registry of rankers: a scorer and its score column.
MODELS = {
    "random": (lambda t: lexical.add_random(t), "random_score"),
    "tfidf": (lambda t: lexical.add_tfidf(t), "tfidf_score"),
    "bm25": (lambda t: lexical.add_bm25(t), "bm25_score"),
}


def prepare(spark: SparkSession, raw_dir: str, out_dir: str, locale: str = "us", seed: int = SEED, fraction: float = TRAIN_FRACTION, least_queries: int = 0, exact_split: bool = True) -> dict:
    """Scan, filter, checked join, integrity, gains, text, split and sinks; returns the report that it writes.

    The joined table is computed once; its checks and the split read that.
    """
    tables.require_raw_files(spark, raw_dir)
    examples = joins.filter_examples(tables.load_examples(spark, f"{raw_dir}/{tables.EXAMPLES}"), locale)
    if least_queries:
        contracts.require_real_data(examples, least_queries)
    products = joins.filter_products(tables.load_products(spark, f"{raw_dir}/{tables.PRODUCTS}", locale))
    merged = cut(joins.merge_products(examples, products))
    report = {"keys": contracts.require_unique(products, joins.PRODUCT_KEYS, "products"), "merge": joins.merge_report(merged).first(), "duplicates": contracts.check_duplicate_pairs(merged)}
    if report["merge"]["n_rows"] != examples.count():
        raise contracts.DataIntegrityError("the join changed the number of rows")
    full = add_product_text(ranking.add_relevance_gain(merged))
    report |= {"statistics": joins.dataset_statistics(full).first(), "values": joins.value_counts(full, "esci_label", "split").collect(), "missing": joins.missingness(full).collect()}
    parts = split.split_official(full, seed, fraction, exact_split)
    report["partitions"] = split.partition_counts(*parts).collect()
    for name, part in zip(("train", "validation", "test_holdout"), parts, strict=True):
        tables.write_parquet(part, f"{out_dir}/{name}.parquet")
    tables.write_sample(merged.filter("NOT product_matched"), f"{out_dir}/unmatched_sample.csv", ["example_id"])
    pairs = contracts.duplicate_pairs(merged).select("query_id", "product_id")
    tables.write_sample(merged.join(pairs, ["query_id", "product_id"], "left_semi"), f"{out_dir}/duplicate_sample.csv", ["query_id", "product_id", "example_id"])
    tables.write_json(spark, f"{out_dir}/report.json", report)
    return tables.json_ready(report)


def baselines(validation: DataFrame, models: dict = MODELS, k: int = K) -> dict[str, DataFrame]:
    """Per-query metrics of each model; every candidate set stays whole."""
    out = {}
    for name, (scorer, score) in models.items():
        out[name] = cut(ranking.per_query_metrics(ranking.rerank(validation, scorer, score), k))
    return out


def run_baselines(spark: SparkSession, validation: DataFrame, out_dir: str | None = None, k: int = K) -> dict:
    """Summaries of all models and their pairwise comparisons."""
    per = baselines(validation, k=k)
    names, metric = list(per), f"ndcg@{k}"
    report = {"models": {n: {r["metric"]: r for r in ranking.summarize_metrics(t).collect()} for n, t in per.items()}, "comparisons": {}}
    for i, a in enumerate(names):
        for b in names[:i]:
            report["comparisons"][f"{a}_vs_{b}"] = compare.compare_models(per[a], per[b], metric).first()
    if out_dir:
        for n, t in per.items():
            tables.write_csv(t.orderBy("query_id"), f"{out_dir}/{n}_per_query.csv")
        tables.write_csv(joins.wide_metrics(per, [metric, f"recall@{k}", "mrr"]).orderBy("query_id"), f"{out_dir}/per_query_wide.csv")
        tables.write_json(spark, f"{out_dir}/baseline_summary.json", report)
    return tables.json_ready(report)


def build_features(train: DataFrame, validation: DataFrame, out_dir: str, cached: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> tuple[DataFrame, DataFrame]:
    """Feature tables of both sides, written and read again. split stays for later guards."""
    contracts.require_disjoint(train, validation)
    for name, t, scores in (("train", train, cached[0]), ("validation", validation, cached[1])):
        keep = ("split",) if "split" in t.columns else ()
        tables.write_parquet(features.feature_table(t, scores, keep=keep), f"{out_dir}/{name}_features.parquet")
    spark = train.sparkSession
    return tuple(spark.read.parquet(f"{out_dir}/{n}_features.parquet") for n in ("train", "validation"))


def train_ranker(train: DataFrame, validation: DataFrame, path: str, names: tuple[str, ...] = FEATURES, **options) -> dict:
    """Fit, save, load again and check that predictions are the same."""
    contracts.require_no_test_rows(train)
    contracts.require_no_test_rows(validation)
    contracts.require_disjoint(train, validation)
    model = ltr.Ranker(features=contracts.check_feature_subset(names, SEMANTIC_FEATURES), **options).fit(train, validation)
    model.save(path)
    if not ltr.predictions_equivalent(model.transform(validation), ltr.Ranker.load(path).transform(validation)):
        raise contracts.RankerEvalError("the saved ranker predicts something else")
    return {"objective": model.objective, "rounds": model.rounds, "features": list(model.features), "ndcg": model.history[-1], **model.history_final(), "history": model.history, "importance": model.importance()}


def evaluate_ranker(validation: DataFrame, path: str, reference: DataFrame, score: str = "xgb_score", k: int = K, replicates: int = 2000, method: str = "exact") -> dict:
    """A saved ranker against a reference's per-query metrics, with a bootstrap interval of the mean difference."""
    per = cut(ranking.per_query_metrics(ltr.score_saved(path, validation, score), k))
    table = cut(compare.paired_metric_table(per, reference, "ranker", "reference", k))
    delta = f"delta_ndcg_at_{k}"
    report = {
        "summary": {r["metric"]: r for r in ranking.summarize_metrics(per).collect()},
        "paired": compare.paired_summary(per, reference, f"ndcg@{k}").first(),
        "bootstrap": compare.bootstrap_mean(table, delta, replicates, method=method),
        "extremes": compare.extreme_deltas(table.select("query_id", delta), 5, delta).collect(),
        "by_length": diagnostics.delta_by_length(table, delta).orderBy("segment").collect(),
    }
    return tables.json_ready(report)


def analyze(candidates: DataFrame, per_query: DataFrame, least: int = 50, delta: str = "delta_ndcg_at_10", reference: str = "reference_ndcg_at_10", own: str = "ranker_ndcg_at_10") -> dict:
    """Segments of paired metrics and the queries to look at. candidates need features, tfidf_score and a similarity."""
    t = cut(diagnostics.annotate_queries(per_query, candidates))
    values = {"mean_delta": delta, "mean_own": own, "mean_reference": reference}
    families = ("length", "overlap", "disagreement", "identifier")
    report = {f: diagnostics.summarize_segments(t, f"{f}_segment", values, least).orderBy("segment").collect() for f in families}
    chosen = cut(diagnostics.diagnostic_queries(t, delta, reference))
    examples = diagnostics.extract_examples(candidates, t, chosen.select("query_id"), delta, ("tfidf_score", "bm25_score", "semantic_similarity"))
    report |= {"chosen": chosen.select("kind", "place", "query_id", F.col(delta)).collect(), "examples": examples.collect()}
    return tables.json_ready(report)
