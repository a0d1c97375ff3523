"""Every query with SQL gives DuckDB's rows over the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from candela.constants import REPLICATES
from candela.operators import compare, joins, ltr
from candela.plans import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.sql(Q.SQL[name])
    assert sorted(r.columns) == columns
    want = sorted((tuple(plain(x[r.columns.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0


def test_random_ranks_and_split_against_numpy(spark, duck):
    """What SQL can't express, from NumPy's generator itself."""
    import hashlib

    import numpy as np

    from candela.sources.adapters import CANDIDATES

    rows = duck.sql(f"SELECT query_id, product_id::VARCHAR, example_id, split FROM ({CANDIDATES})").fetchall()
    by: dict = {}
    for q, p, e, _ in rows:
        by.setdefault(q, []).append((p, e))
    got = {r["example_id"]: r for r in Q.QUERIES["rank_random"](spark, DATA).collect()}
    for q, own in by.items():
        seed = int.from_bytes(hashlib.blake2b(f"1234:{q}".encode(), digest_size=8).digest(), "little") % 2**32
        draws = sorted(np.random.default_rng(seed).random(len(own)).tolist())
        mine = sorted(((got[e]["random_score"], got[e]["predicted_rank"]) for _, e in own), reverse=True)
        assert sorted(s for s, _ in mine) == draws and [r for _, r in mine] == list(range(1, len(own) + 1))
        if len({p for p, _ in own}) == len(own):
            assert [got[e]["random_score"] for _, e in sorted(own)] == np.random.default_rng(seed).random(len(own)).tolist()
    ids = np.array(sorted({q for q, _, _, s in rows if s == "train"}))
    np.random.default_rng(1234).shuffle(ids)
    sides = {q: "train" for q in ids[: int(len(ids) * 0.85)].tolist()} | {q: "validation" for q in ids[int(len(ids) * 0.85) :].tolist()}
    want: dict = {}
    for q, *_ in rows:
        n = want.setdefault(sides.get(q, "test"), [0, set()])
        n[0] += 1
        n[1].add(q)
    assert {r["partition"]: (r["n_rows"], r["n_queries"]) for r in Q.QUERIES["query_split_exact"](spark, DATA).collect()} == {k: (n, len(s)) for k, (n, s) in want.items()}


def test_bootstrap_query_against_numpy(spark):
    import numpy as np

    x = np.array([r["diff"] for r in Q.deltas(spark, DATA).collect()])
    means = np.random.default_rng(3).choice(x, size=(4000, len(x))).mean(axis=1)
    r = Q.QUERIES["bootstrap_ci"](spark, DATA).first()
    assert r["n"] == len(x) and r["mean"] == pytest.approx(x.mean())
    for got, want in zip((r["ci_low"], r["ci_high"]), np.quantile(means, [0.025, 0.975]), strict=True):
        assert abs(got - want) < 0.15 * means.std()


def test_learning_queries_are_whole_jobs(spark, monkeypatch):
    fits, drawn, draw = [], [], compare.bootstrap_mean

    class Short(ltr.Ranker):
        def fit(self, train, validation=None):
            fits.append((self.features, self.rounds))
            self.rounds = 1
            return super().fit(train, validation)

    monkeypatch.setattr(ltr, "Ranker", Short)
    monkeypatch.setattr(compare, "bootstrap_mean", lambda *a, **b: drawn.append(draw(*a, **b)) or drawn[-1])
    assert [(r["name"], r["n_features"]) for r in Q.QUERIES["ablation"](spark, DATA).collect()] == [(k, len(v)) for k, v in ltr.ABLATIONS.items()]
    assert fits == [(v, 200) for v in ltr.ABLATIONS.values()]
    for name in ("ltr_train_score", "gain_importance"):
        assert Q.QUERIES[name](spark, DATA).count() > 0
    assert fits[6:] == [(ltr.FEATURES, 200)] * 2
    assert Q.QUERIES["bootstrap_ci"](spark, DATA).count() == 1 and drawn[0]["n_replicates"] == REPLICATES == 2000


def test_outer_merge_has_all_queries_and_models(spark):
    want = {(r["query_id"], r["example_id"]) for r in Q.candidates(spark, DATA).select("query_id", "example_id").collect()}
    rows = Q.QUERIES["example_outer_merge_all"](spark, DATA).collect()
    assert len({q for q, _ in want}) > 1 and len(rows) == len(want) and {(r["query_id"], r["example_id"]) for r in rows} == want
    sizes = {q: sum(q == x for x, _ in want) for q in {q for q, _ in want}}
    for m in ("bm25", "tfidf", "random"):
        assert max(sizes.values()) > 10 and {q: max(r[f"{m}_rank"] for r in rows if r["query_id"] == q) for q in sizes} == sizes


def test_outer_merge_in_place(spark):
    """As the joins have it, also for repeated keys and nulls; the query deals its scored rows out once for all models."""
    rows = [(1, "a", 0.5, 0.1), (1, "b", 0.4, 0.9), (1, "b", 0.3, 0.2), (2, "a", 0.5, 0.5), (None, "c", 0.1, 0.7), (2, None, 0.2, 0.3)]
    t = spark.createDataFrame(rows, "query_id long, example_id string, x_score double, y_score double").withColumn("product_id", F.col("example_id"))
    lists = {m: Q.ranking.sort_and_rank(t, f"{m}_score") for m in "xy"}
    want = joins.outer_examples({m: d.withColumn("score", F.col(f"{m}_score")) for m, d in lists.items()}, ["query_id", "example_id"])
    both = Q.ranking.add_ranks(t, {"x_score": "x_rank", "y_score": "y_rank"})
    got = joins.outer_ranked(both, "xy")
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 10
    plan = Q.QUERIES["example_outer_merge_all"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and plan.count("Relation [l_orderkey") <= Q.QUERIES["multi_model_ranks"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")
