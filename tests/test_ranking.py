import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela import errors
from candela.operators import compare, diagnostics, lexical, ranking
from tests import frames


def order(t):
    return [(r["query_id"], r["product_id"], r["example_id"]) for r in t.orderBy("query_id", "predicted_rank").collect()]


def test_ties_nan_and_null_groups(spark):
    t = frames.scored(spark)
    got = order(ranking.sort_and_rank(t, "xgb_score"))
    # Ids compare as strings ("10" before "9"); NaN and null stand last, by product.
    assert got == [(None, "a", 4), (1, "d", 2), (1, "a", 10), (1, "b", 10), (1, "b", 9), (1, "c", 1), (1, "e", 3), (2, "z", 5)]
    assert order(ranking.sort_and_rank(t.orderBy(F.rand(3)).repartition(5), "xgb_score")) == got
    assert ranking.sort_and_rank(t, "xgb_score", 2).count() == 4
    with pytest.raises(ValueError):
        ranking.sort_and_rank(t, "xgb_score", -1)


def metrics(spark, labels, k):
    gains = dict(E=3, S=2, C=1, I=0)
    rows = [(1, i, f"p{i}", x, gains[x], i + 1) for i, x in enumerate(labels)]
    t = spark.createDataFrame(rows, "query_id long, example_id long, product_id string, esci_label string, relevance_gain int, predicted_rank int")
    r = ranking.per_query_metrics(t, k).first()
    return r[f"ndcg@{k}"], r[f"recall@{k}"], r["mrr"]


def test_metrics_by_hand(spark):
    assert metrics(spark, "ESCI", 4)[0] == pytest.approx(1)
    got = metrics(spark, "CSE", 3)
    assert got[0] == pytest.approx((1 + 2 / math.log2(3) + 3 / 2) / (3 + 2 / math.log2(3) + 1 / 2))
    assert metrics(spark, "III", 10) == (0, 0, 0)
    assert metrics(spark, "EISI", 2)[1] == 0.5 and metrics(spark, "EISI", 3)[1] == 1
    assert metrics(spark, "IICE", 10)[2] == 0.25
    assert metrics(spark, "E", 0)[0] == 0


def test_summary_of_one_query(spark):
    t = spark.createDataFrame([(1, 0.5, 0.25, 1.0)], "query_id long, `ndcg@10` double, `recall@10` double, mrr double")
    r = {x["metric"]: x for x in ranking.summarize_metrics(t).collect()}
    assert r["mrr"]["std"] == 0 and r["ndcg@10"]["p25"] == 0.5


def test_gain_checks(spark):
    e = frames.examples(spark)
    assert ranking.add_relevance_gain(e).filter("esci_label = 'S'").first()["relevance_gain"] == 2
    with pytest.raises(errors.DataIntegrityError, match="unknown"):
        ranking.add_relevance_gain(e.withColumn("esci_label", F.lit("X")))
    with pytest.raises(errors.DataIntegrityError, match="null"):
        ranking.add_relevance_gain(e.withColumn("esci_label", F.lit(None).cast("string")))


def bm25(query, docs):
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf) if idf else 0
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in query) if mean else 0 for d in docs]


def tfidf(query, docs):
    n, vocabulary = len(docs), sorted({t for d in docs for t in d})
    idf = {t: math.log((1 + n) / (1 + sum(t in d for d in docs))) + 1 for t in vocabulary}
    vector = lambda d: np.array([d.count(t) * idf[t] for t in vocabulary] or [0.0])
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    return [float(unit(vector(query)) @ unit(vector(d))) for d in docs]


@pytest.mark.parametrize("long_texts", [False, True])
def test_lexical_scores_by_hand(spark, long_texts):
    rng, words = random.Random(4), "a b c d e f".split()
    groups = {q: ([rng.choice([*words, "zz"]) for _ in range(rng.randint(0, 4))], [[rng.choice(words) for _ in range(rng.randint(0, 6))] for _ in range(rng.choice([1, 2, 7]))]) for q in range(14)}
    groups[20] = (["a"], [[], []])
    rows = [(q, f"{q}-{i}", f"p{i}", " ".join(query), " ".join(d)) for q, (query, docs) in groups.items() for i, d in enumerate(docs)]
    t = spark.createDataFrame(rows, "query_id long, example_id string, product_id string, query string, product_title string")
    t = lexical.add_tfidf(lexical.add_bm25(t, "product_title"), "product_title", long_texts=long_texts)
    got = {r["example_id"]: (r["bm25_score"], r["tfidf_score"]) for r in t.collect()}
    assert len(got) == len(rows)
    for q, (query, docs) in groups.items():
        for i, (a, b) in enumerate(zip(bm25(query, docs), tfidf(query, docs), strict=True)):
            assert got[f"{q}-{i}"] == pytest.approx((a, b), abs=1e-12), (q, i)


def test_equal_bags_tie(spark):
    rows = [(1, str(i), f"p{i}", "c a b a", x) for i, x in enumerate(["a b c d", "d c b a", "b a d c", "x y z"])]
    t = lexical.add_lexical(spark.createDataFrame(rows, "query_id long, example_id string, product_id string, query string, product_title string"))
    assert t.filter("example_id < '3'").select("bm25_score", "tfidf_score").distinct().count() == 1


def test_random_scores(spark):
    t = frames.scored(spark).filter("query_id IS NOT NULL")
    for exact in (False, True):
        a = {(r["query_id"], r["product_id"], r["example_id"]): r["random_score"] for r in lexical.add_random(t, exact=exact).collect()}
        b = {(r["query_id"], r["product_id"], r["example_id"]): r["random_score"] for r in lexical.add_random(t.repartition(7), exact=exact).collect()}
        assert (a.keys() == b.keys()) and all(0 <= v < 1 for v in a.values())
        assert exact or a == b
    one = spark.createDataFrame([(5, f"p{i}", i, 0.0) for i in (3, 1, 2)], "query_id long, product_id string, example_id long, xgb_score double")
    got = [r["random_score"] for r in lexical.add_random(one, exact=True).orderBy("product_id").collect()]
    assert got == list(np.random.default_rng(lexical.query_seed(5)).random(3))


def table(spark, values):
    return spark.createDataFrame([(i, f"q{i}", 3, v, v, v) for i, v in values.items()], "query_id long, query string, n_candidates long, `ndcg@10` double, `recall@10` double, mrr double")


def test_paired(spark):
    a, b = table(spark, {1: 0.9, 2: 0.5, 3: 0.4}), table(spark, {1: 0.8, 2: 0.5, 3: 0.7})
    r = compare.paired_summary(a, b, "ndcg@10").first()
    assert (r["wins"], r["losses"], r["ties"]) == (1, 1, 1) and r["win_rate"] == pytest.approx(1 / 3)
    t = compare.paired_metric_table(a, b, "x", "y").orderBy("query_id").collect()
    assert t[2]["delta_mrr"] == pytest.approx(-0.3)
    with pytest.raises(errors.RankerEvalError):
        compare.paired_summary(a, b.filter("query_id > 1"), "ndcg@10")
    tiny = compare.paired(table(spark, {1: 0.5 + 1e-14}), table(spark, {1: 0.5}), "ndcg@10")
    assert tiny.agg(*compare.outcome_counts(F.col("diff"))).first()["wins"] == 1
    assert tiny.agg(*compare.outcome_counts(F.col("diff"), 1e-12)).first()["ties"] == 1
    e = compare.extreme_deltas(compare.paired(a, b, "ndcg@10"), 1).collect()
    assert [(x["side"], x["query_id"]) for x in e] == [("top", 1), ("bottom", 3)]


@pytest.mark.parametrize("method", ["exact", "poisson"])
def test_bootstrap(spark, method):
    t = spark.createDataFrame([(i, float((-1) ** i)) for i in range(200)], "query_id long, d double")
    a = compare.bootstrap_mean(t, "d", 300, method=method)
    assert a["mean"] == 0 and a["ci_low"] <= 0 <= a["ci_high"] and -0.3 < a["ci_low"] and a["unit"] == "query"
    assert compare.bootstrap_mean(t.repartition(5), "d", 300, method=method)["ci_low"] == pytest.approx(a["ci_low"], abs=1e-9)


def test_spearman(spark):
    import pandas as pd

    rng = random.Random(2)
    rows = [(q, rng.randint(0, 3) / 1.0, rng.randint(0, 3) / 1.0) for q in range(6) for _ in range(8)] + [(9, 1.0, 2.0), (9, 1.0, 3.0), (10, 1.0, 1.0)]
    got = {r["query_id"]: r["spearman"] for r in diagnostics.spearman_by_query(spark.createDataFrame(rows, "query_id long, a double, b double"), "a", "b").collect()}
    for q, g in pd.DataFrame(rows, columns=["q", "a", "b"]).groupby("q"):
        want = g.a.rank().corr(g.b.rank()) if g.a.nunique() > 1 and g.b.nunique() > 1 else None
        assert got[q] is None if want is None else got[q] == pytest.approx(want, abs=1e-12)


def test_segments(spark):
    df = spark.createDataFrame([("", None), ("a", 0.39), ("a b", 0.4), ("a b c", 0.7), ("a b c d1", float("nan"))], "query string, x double")
    t = df.select(diagnostics.length_segment().alias("l"), diagnostics.overlap_segment(F.col("x")).alias("o"), diagnostics.disagreement_segment(F.col("x")).alias("d"), diagnostics.identifier_segment().alias("i"), diagnostics.length_bins().alias("b")).collect()
    assert [r["l"] for r in t] == ["1 token", "1 token", "2–3 tokens", "2–3 tokens", "4+ tokens"]
    assert [r["o"] for r in t] == ["no relevant candidates", "low overlap", "medium overlap", "high overlap", "no relevant candidates"]
    assert [r["d"] for r in t] == ["undefined", "mixed", "mixed", "high agreement", "undefined"]
    assert [r["i"] for r in t] == ["other"] * 4 + ["identifier-style"] and t[0]["b"] is None


def test_diagnostics(spark):
    t = spark.createDataFrame([(1, -0.2, 0.9), (2, -0.4, 0.5), (3, 0.3, 0.1), (4, 0.0, 0.2), (5, 1e-9, 0.8)], "query_id long, d double, r double")
    got = [(x["kind"], x["query_id"]) for x in diagnostics.diagnostic_queries(t, "d", "r", 1).collect()]
    assert got == [("improvement", 3), ("regression", 2), ("tie", 5)]
    h = diagnostics.histogram(t, "d", 7).collect()
    assert sum(r["n"] for r in h) == 5 and max(r["bin"] for r in h) == 7
    assert diagnostics.histogram(t.withColumn("d", F.lit(1.0)), "d", 7).collect()[0]["n"] == 5
