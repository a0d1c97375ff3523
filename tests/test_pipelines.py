import pytest

from candela.operators import features, ranking
from candela.plans import pipelines
from candela.sources import tables


@pytest.fixture
def raw(spark, tmp_path):
    rows = [(q * 10 + k, f"red kettle {q}", q, f"p{(q + k) % 7}", "us", "ESCI"[k], 1, 1, "test" if q % 5 == 0 else "train") for q in range(30) for k in range(4)]
    e = spark.createDataFrame(rows, "example_id long, query string, query_id long, product_id string, product_locale string, esci_label string, small_version int, large_version int, split string")
    names = ["red kettle", "blue kettle steel", "lamp", "red lamp xl-40", "kettle", "garden hose"]
    p = spark.createDataFrame([(f"p{i}", n, None, "b", "Red", None, "us") for i, n in enumerate(names)], "product_id string, product_title string, product_description string, product_bullet_point string, product_brand string, product_color string, product_locale string")
    e.write.parquet(str(tmp_path / tables.EXAMPLES))
    p.write.parquet(str(tmp_path / tables.PRODUCTS))
    return str(tmp_path)


def test_from_raw_tables_to_reports(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    report = pipelines.prepare(spark, raw, out)
    assert report["merge"]["n_rows"] == 120 and report["merge"]["n_unmatched"] > 0
    assert {r["partition"]: r["n_queries"] for r in report["partitions"]} == {"train": 20, "validation": 4, "test": 6}
    assert tables.load_json(spark, f"{out}/report.json")["merge"]["n_rows"] == 120
    train, validation = (spark.read.parquet(f"{out}/{n}.parquet") for n in ("train", "validation"))
    base = pipelines.run_baselines(spark, validation, f"{out}/base")
    assert set(base["models"]) == {"random", "tfidf", "bm25"} and base["comparisons"]["bm25_vs_tfidf"]["n_queries"] == 4
    a, b = pipelines.build_features(train, validation, out)
    assert pipelines.train_ranker(a, b, f"{out}/model", rounds=3)["ndcg"]["validation"] > 0
    reference = ranking.per_query_metrics(ranking.rank_scored(b, "tfidf_score"))
    got = pipelines.evaluate_ranker(b, f"{out}/model", reference, replicates=100)
    assert got["paired"]["n_queries"] == 4 and got["bootstrap"]["ci_low"] <= got["bootstrap"]["mean"] <= got["bootstrap"]["ci_high"]
    from candela.operators.compare import paired_metric_table

    own = ranking.per_query_metrics(ranking.rank_scored(b, "bm25_score"))
    x, y = features.semantic_features(a.drop("split"), b.drop("split"), features.HashingEncoder())
    scored = features.join_similarity(b, y)
    report = pipelines.analyze(scored, paired_metric_table(own, reference, "ranker", "reference"), least=1)
    assert sum(r["n_queries"] for r in report["length"]) == 4 and report["examples"]
