import numpy as np
import pytest
from pyspark.sql import functions as F

from candela import errors
from candela.constants import FEATURES, IDENTIFIERS
from candela.operators import features as X
from candela.operators import joins, ranking
from candela.operators import lambdamart
from candela.operators.ltr import Ranker, Together, ablation, importance_table, predictions_equivalent
from candela.sources import tables
from tests import frames


@pytest.fixture
def merged(spark):
    t = joins.merge_products(joins.filter_examples(frames.examples(spark)), joins.filter_products(frames.products(spark)))
    return ranking.add_relevance_gain(t)


def test_basic_features(merged):
    r = {x["example_id"]: x for x in X.add_basic_features(merged).collect()}
    one = r[1]
    assert (one["shared_token_count"], one["query_token_coverage"], one["title_token_count"], one["token_length_difference"]) == (2, 1.0, 6, -4)
    assert (one["exact_query_in_title"], one["brand_match"], one["query_bullet_coverage"]) == (0, 0, 0.5)
    assert (r[5]["exact_query_in_title"], r[5]["brand_match"]) == (1, 1)
    assert r[6]["query_token_coverage"] == 0 and r[7]["title_token_coverage"] == 0
    bare = X.add_basic_features(merged.drop("product_brand", "product_bullet_point")).filter("example_id = 1").first()
    assert (bare["brand_match"], bare["query_bullet_coverage"]) == (0, 0)


def test_feature_table_and_cached_scores(merged):
    t = X.feature_table(merged)
    assert t.columns == [*IDENTIFIERS, *FEATURES] and t.count() == 7
    again = X.feature_table(merged, t.select("example_id", "bm25_score", "tfidf_score"))
    assert sorted(map(str, again.collect())) == sorted(map(str, t.collect()))
    with pytest.raises(errors.DataIntegrityError):
        X.feature_table(merged, t.filter("example_id > 1"))


def test_semantic(spark, merged):
    train, validation = merged.filter("query_id = 10").withColumn("split", F.lit("train")), merged.filter("query_id = 11")
    calls = []

    class Counting(X.HashingEncoder):
        def encode(self, texts, text="text"):
            calls.append(texts.count())
            return super().encode(texts, text)

    a, b = X.semantic_features(train, validation, Counting())
    assert calls == [6]
    values = {r["example_id"]: r["semantic_similarity"] for r in a.unionByName(b).collect()}
    assert all(-1 <= v <= 1 for v in values.values()) and values[1] > values[2] and values[5] == pytest.approx(1)
    joined = X.join_similarity(train, a)
    assert joined.filter("semantic_similarity IS NULL").count() == 0
    for bad in (a.filter("example_id > 1"), a.unionByName(a), a.withColumn("product_id", F.lit("x"))):
        with pytest.raises(errors.SemanticJoinError):
            X.join_similarity(train, bad)
    with pytest.raises(errors.DataIntegrityError):
        X.semantic_input(merged)
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 0.0])], "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b"))).collect()


def test_function_encoder(spark):
    t = spark.createDataFrame([("a",), ("a",), (" b",)], "text string")
    got = X.encode_unique(t, X.FunctionEncoder(lambda texts: [[float(len(x)), 0.0] for x in texts])).collect()
    assert {r["text"]: r["embedding"] for r in got} == {"a": [1.0, 0.0], "b": [1.0, 0.0]}


@pytest.fixture
def ltr(spark):
    rows = [(q * 4 + i, q, f"p{i}", 3 - i, *[float((3 - i) * (k + 1) + (q * 7 + i * k) % 3) for k in range(10)]) for q in range(12) for i in range(4)]
    t = spark.createDataFrame(rows, "example_id long, query_id long, product_id string, relevance_gain int, " + ", ".join(f"{f} double" for f in FEATURES))
    return t.withColumn("esci_label", F.element_at(F.array(*map(F.lit, "ICSE")), F.col("relevance_gain") + 1))


@pytest.mark.parametrize("objective", ["squares", "ndcg"])
def test_ranker(spark, ltr, tmp_path, objective):
    model = Ranker(rounds=3, objective=objective).fit(ltr, ltr)
    assert model.history[-1]["validation"] > 0.95 and len(model.history) == (3 if objective == "ndcg" else 1) and set(model.history_final()) == {"train_ndcg@10", "validation_ndcg@10"}
    model.save(str(tmp_path / "m"))
    assert predictions_equivalent(model.transform(ltr), Ranker.load(str(tmp_path / "m")).transform(ltr.repartition(3)))
    rows = model.importance()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and sum(r["normalized_gain"] for r in rows) == pytest.approx(1)


def test_importance_and_ablation(ltr):
    assert [r["normalized_gain"] for r in importance_table({}, ["a", "b"])] == [0, 0]
    assert [r["name"] for r in ablation(ltr, ltr, {"lexical_scores": ("bm25_score", "tfidf_score")}, rounds=2)] == ["lexical_scores"]


def test_sources(spark, tmp_path):
    with pytest.raises(errors.MissingRawDataError):
        tables.require_raw_files(spark, str(tmp_path))
    frames.examples(spark).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / tables.EXAMPLES))
    frames.products(spark).write.parquet(str(tmp_path / tables.PRODUCTS))
    tables.require_raw_files(spark, str(tmp_path))
    assert len(tables.load_examples(spark, str(tmp_path / tables.EXAMPLES)).columns) == 9
    p = tables.load_products(spark, str(tmp_path / tables.PRODUCTS))
    assert p.count() == 4 and "PushedFilters: [IsNotNull(product_locale), EqualTo(product_locale,us)]" in p._jdf.queryExecution().toString()
    with pytest.raises(errors.SchemaError):
        tables.load_products(spark, str(tmp_path / tables.EXAMPLES))
    with pytest.raises(errors.DataIntegrityError):
        tables.load_development(spark, str(tmp_path / tables.EXAMPLES))
    assert tables.load_cached_scores(spark, str(tmp_path / "none")) is None
    t = spark.createDataFrame([(1, 0.5), (2, 1.0)], "query_id long, mrr double")
    tables.write_csv(t, str(tmp_path / "m.csv"))
    tables.write_json(spark, str(tmp_path / "s.json"), {"x": {"mrr": 0.75}, "n": {1, 2}})
    got, doc = tables.load_baselines(spark, str(tmp_path / "m.csv"), str(tmp_path / "s.json"), "query_id long, mrr double", {"mrr": ("x", "mrr")})
    assert got.count() == 2 and doc["x"]["mrr"] == 0.75
    with pytest.raises(errors.DataIntegrityError):
        tables.load_baselines(spark, str(tmp_path / "m.csv"), str(tmp_path / "s.json"), "query_id long, mrr double", {"query_id": ("x", "mrr")})
    both = tables.load_mixed(spark, [str(tmp_path / "m.csv"), str(tmp_path / tables.PRODUCTS), "x.txt"])
    assert both.count() == 7 and "_source_file" in both.columns
    assert tables.write_sample(t, str(tmp_path / "w"), ["query_id"], 1) and not tables.write_sample(t.limit(0), str(tmp_path / "v"), ["query_id"])
    assert tables.markdown_table(spark.createDataFrame([("a|b", 0.5)], "x string, y double")).splitlines()[2] == "| a\\|b | 0.5000 |"


def test_gradients_by_hand():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 7, 40, 3])
    starts, n = np.cumsum(sizes) - sizes, sizes.sum()
    score, label = rng.normal(size=n).round(1), rng.integers(0, 4, n).astype(float)
    g, h = lambdamart.gradients(score, label, starts, sizes)
    for a, m in zip(starts, sizes, strict=True):
        s, y = score[a : a + m], label[a : a + m]
        rank = {j: i for i, j in enumerate(sorted(range(m), key=lambda j: (-s[j], j)))}
        ideal = sum((2**v - 1) / np.log2(i + 2) for i, v in enumerate(sorted(y, reverse=True)))
        want_g, want_h, total = np.zeros(m), np.zeros(m), 0.0
        for i in range(m):
            for j in range(m):
                if y[i] > y[j] and min(rank[i], rank[j]) < 32:
                    delta = abs(2 ** y[i] - 2 ** y[j]) * abs(1 / np.log2(rank[i] + 2) - 1 / np.log2(rank[j] + 2)) / ideal
                    p = 1 / (1 + np.exp(s[i] - s[j]))
                    want_g[i] -= p * delta
                    want_g[j] += p * delta
                    total += 2 * p * delta
                    want_h[[i, j]] += 2 * p * (1 - p) * delta
        scale = np.log2(1 + total) / total if total else 0
        assert g[a : a + m] == pytest.approx(want_g * scale) and h[a : a + m] == pytest.approx(want_h * scale)


def test_trees_are_the_same_in_one_task_and_in_many(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, i // 12, int(rng.integers(0, 4)), *map(float, rng.normal(size=len(FEATURES)))) for i in range(1200)]
    rows = [(*r[:3], r[3] + r[2], *r[4:]) for r in rows]
    t = spark.createDataFrame(rows, "example_id long, query_id long, relevance_gain int, " + ", ".join(f"{f} double" for f in FEATURES))
    train, held = t.filter("query_id < 80"), t.filter("query_id >= 80")
    one, many = (Ranker(rounds=12, tasks=n).fit(train, held) for n in (1, 4))
    assert [len(x) for x in one.trees.nodes] == [len(x) for x in many.trees.nodes]
    assert predictions_equivalent(one.transform(held), many.transform(held.repartition(3)), tolerance=1e-6)
    assert one.history[-1]["train"] > one.history[0]["train"] and one.history[-1]["validation"] > 0.75
    assert many.history[-1]["validation"] == pytest.approx(one.history[-1]["validation"])
    found = one.importance()
    assert found[0]["feature"] == FEATURES[0] and found[0]["rank"] == 1
    splits = [n for tree in one.trees.nodes for n in tree if n[0] == 0]
    assert found[0]["gain"] == pytest.approx(sum(n[5] for n in splits) / len(splits))


def test_first_split_by_hand():
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 9, (200, 3)).astype(float), rng.integers(0, 4, 200).astype(float)
    y = np.clip(y + (x[:, 1] > 4), 0, 3)
    sizes = np.full(10, 20)
    starts = np.cumsum(sizes) - sizes
    options = {"features": list("abc"), "rounds": 1, "depth": 1, "rate": 0.1, "subsample": 1.0, "columns": 1.0, "seed": 1, "penalty": 1.0, "least": 1.0, "k": 10}
    trees = lambdamart.train(x, y, starts, sizes, np.zeros(10, dtype=int), np.arange(200), lambdamart.Alone(), options)
    g, h = lambdamart.gradients(np.zeros(200), y, starts, sizes)
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max((value(x[:, f] < c) + value(x[:, f] >= c) - value(x[:, f] < 99), f, c) for f in range(3) for c in range(1, 9) if h[x[:, f] < c].sum() >= 1 <= h[x[:, f] >= c].sum())
    root = trees.nodes[0][0]
    assert (root[5], root[0], root[1]) == (pytest.approx(best[0]), best[1], best[2])
    left = x[:, best[1]] < best[2]
    assert trees.predict(x)[left] == pytest.approx(-0.1 * g[left].sum() / (h[left].sum() + 1))


def test_training_keeps_bytes_not_matrices(monkeypatch):
    """What training holds for a row at once, above its input, is some tens of bytes, and parts of a feature give the bins of the whole."""
    import tracemalloc

    monkeypatch.setattr(lambdamart, "ROWS", 4096)
    rng, n = np.random.default_rng(9), 200_000
    x = np.column_stack([rng.normal(size=n).round(9), *[rng.integers(0, 8, n) / 7.0 for _ in range(9)]])
    whole, parts = (lambdamart.Values.of(x[:, 0]) for _ in range(2))
    parts.parts = [p for a in parts.parts for p in np.array_split(a, 3)]
    cuts = np.quantile(x[:, 0], np.linspace(0, 1, 257)[1:-1])
    assert (whole.bins(cuts) == parts.bins(cuts)).all()
    columns = [lambdamart.Values.of(x[:, f]) for f in range(10)]
    sizes = np.full(n // 40, 40)
    options = {"features": list("abcdefghij"), "rounds": 2, "depth": 4, "rate": 0.1, "subsample": 0.8, "columns": 0.8, "seed": 1, "penalty": 1.0, "least": 1.0, "k": 10}
    tracemalloc.start()
    trees = lambdamart.train(columns, rng.integers(0, 4, n).astype(float), np.cumsum(sizes) - sizes, sizes, np.zeros(len(sizes), dtype=int), np.arange(n), lambdamart.Alone(), options)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(trees.nodes) == 2 and peak < 100 * n


def test_features_share_codes():
    rng = np.random.default_rng(9)
    n, counts = 150_000, [256, 4, 9, 2, 40, 1, 7]
    low = rng.integers(0, 4, n)
    bins = [(low % c if c < 10 else rng.integers(0, c, n)).astype(np.uint8) for c in counts]
    mixes = lambdamart.mixed(list(bins), counts)
    assert len(mixes) == 2 and sorted(f for m in mixes for f in m.tables) == list(range(7))
    assert all((t[m.codes] == bins[f]).all() for m in mixes for f, t in m.tables.items())
    # Features whose rows of bins are too many different ones are in several codes.
    bins = [rng.integers(0, c, n).astype(np.uint8) for c in (60, 60, 60)]
    assert [m.size for m in lambdamart.mixed(list(bins), [60] * 3)] == [60] * 3


def test_ablation_deals_rows_once(ltr, monkeypatch):
    subsets, calls, fit = {"lexical": ("bm25_score", "tfidf_score"), "one": ("bm25_score",), "all": FEATURES}, [], lambdamart.fit
    monkeypatch.setattr(lambdamart, "fit", lambda *a, **k: calls.append(1) or fit(*a, **k))
    got = ablation(ltr, ltr, subsets, rounds=3)
    assert len(calls) == 1 and [(r["name"], r["n_features"]) for r in got] == [(k, len(v)) for k, v in subsets.items()]
    for r, features in zip(got, subsets.values(), strict=True):
        assert ablation(ltr, ltr, {"own": features}, rounds=3)[0] | {"name": r["name"]} == pytest.approx(r)


def test_rows_of_equal_bins_share_sums(monkeypatch):
    """Rows with equal bins are one code, and trees are the same as without codes, in groups of several sizes and with a side held out."""
    rng, n, counts = np.random.default_rng(11), 6000, [40, 3, 5, 2]
    bins = [rng.integers(0, c, n).astype(np.uint8) for c in counts]
    for met in (lambdamart.MET, 0):
        monkeypatch.setattr(lambdamart, "MET", met)
        monkeypatch.setattr(lambdamart, "ROWS", 1000)
        tables = list(bins)
        codes = lambdamart.shared(tables, counts)
        assert len(tables[0]) == len(set(zip(*[b.tolist() for b in bins], strict=True))) <= 1200
        assert all((t[codes] == b).all() for t, b in zip(tables, bins, strict=True))
    different = [np.arange(200, dtype=np.uint8), np.zeros(200, dtype=np.uint8)]
    assert lambdamart.shared(different, [200, 1]) is None and len(different[1]) == 200
    sizes = np.concatenate([np.full(100, 10), np.full(40, 45), np.arange(20, 80), [230]])
    n = sizes.sum()
    x = np.column_stack([rng.integers(0, c, n) for c in counts]).astype(float)
    y = np.clip(rng.integers(0, 4, n) + (x[:, 0] > 30) - (x[:, 1] > 1), 0, 3).astype(float)
    side, keys = (np.arange(len(sizes)) % 5 == 0).astype(int), rng.integers(0, 1 << 62, n)
    options = {"features": list("abcd"), "rounds": 8, "depth": 3, "rate": 0.1, "subsample": 0.8, "columns": 0.8, "seed": 3, "penalty": 1.0, "least": 1.0, "k": 10}
    trained = lambda: lambdamart.train(x, y, np.cumsum(sizes) - sizes, sizes, side, keys, lambdamart.Alone(), options)
    one = trained()
    monkeypatch.setattr(lambdamart, "shared", lambda bins, counts: None)
    other = trained()
    assert [[m[:2] for m in t] for t in one.nodes] == [[m[:2] for m in t] for t in other.nodes] and len(one.nodes) == 8
    assert one.predict(x) == pytest.approx(other.predict(x), abs=1e-6) and len(set(one.predict(x).tolist())) > 20
    assert one.history[-1] == pytest.approx(other.history[-1], abs=1e-6)


def test_rankers_fit_to_shared_rows(ltr):
    """Each subset's ranker is fitted by its own fit(), which leaves the training to the rows they share; other parameters can't differ."""
    together = Together(ltr)
    models = [Ranker(features=f, rounds=2, tasks=4).fit(together) for f in (("bm25_score",), FEATURES)]
    assert all(m.trees is None for m in models)
    together.train_all()
    assert [len(m.trees.nodes) for m in models] == [2, 2] and [m.trees.features for m in models] == [["bm25_score"], list(FEATURES)]
    Ranker(rounds=3, tasks=4).fit(together)
    with pytest.raises(ValueError):
        together.train_all()


def test_mean_metrics_in_one_pass(ltr):
    """As per_query_metrics() has them one by one, ties and NaN too; one dealing by query for all scores."""
    from candela.operators import ranking

    t = ltr.withColumns({"a": F.col("bm25_score"), "b": F.round("tfidf_score", 1), "c": F.when(F.col("bm25_score") > 1, float("nan")).otherwise(F.col("tfidf_score"))})
    for score, got in zip("abc", ranking.mean_metrics(t, list("abc"), 5), strict=True):
        want = ranking.per_query_metrics(ranking.rank_scored(t, score), 5).agg(F.avg("`ndcg@5`").alias("ndcg"), F.avg("`recall@5`").alias("recall"), F.avg("mrr").alias("mrr")).first()
        assert got == pytest.approx(want.asDict())


def test_trees_predict_by_node():
    trees = lambdamart.Trees(["a", "b"], [[[0, 0.5, 1, 2, 0.0, 1.0], [-1, 0, 0, 0, 1.0, 0], [1, 2.0, 3, 4, 0.0, 1.0], [-1, 0, 0, 0, 2.0, 0], [-1, 0, 0, 0, 4.0, 0]], [[-1, 0, 0, 0, 0.25, 0]]])
    x = [[0.4, 9.0], [0.5, 1.9], [0.5, 2.0], [float("nan"), float("nan")]]
    assert trees.predict(np.array(x)).tolist() == [1.25, 2.25, 4.25, 4.25] and trees.predict(np.zeros((0, 2))).tolist() == []
