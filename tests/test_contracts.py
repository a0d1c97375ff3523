import pytest
from pyspark.sql import functions as F

from candela import errors
from candela.constants import FEATURES, SEMANTIC_FEATURES
from candela.operators import contracts as C
from candela.operators import joins, split
from tests import frames


def test_keys(spark):
    p = frames.products(spark)
    assert C.require_unique(p, ["product_id", "product_locale"])["n_keys"] == 5
    twice = p.unionByName(p.limit(1))
    with pytest.raises(errors.DataIntegrityError):
        C.require_unique(twice, ["product_id", "product_locale"])
    assert C.key_report(p.limit(0), ["product_id"]).first().asDict() == {"n_rows": 0, "n_keys": 0, "n_duplicate_rows": 0, "n_duplicate_keys": 0}


def test_merge_keeps_unmatched_rows(spark):
    e, p = joins.filter_examples(frames.examples(spark)), joins.filter_products(frames.products(spark))
    m = joins.merge_products(e, p)
    assert e.count() == m.count() == 7
    assert {r["example_id"] for r in m.filter("NOT product_matched").collect()} == {7} == {r["example_id"] for r in joins.unmatched(e, p).collect()}
    assert joins.merge_products(e, p.limit(0)).filter("product_matched").count() == 0
    with pytest.raises(errors.DataIntegrityError):
        joins.merge_products(e, p.unionByName(p))
    assert joins.merge_report(m).first().asDict() == {"n_rows": 7, "n_matched": 6, "n_unmatched": 1}


def test_null_keys(spark):
    e = frames.examples(spark).withColumn("product_id", F.lit(None).cast("string"))
    p = frames.products(spark).limit(1).withColumn("product_id", F.lit(None).cast("string"))
    assert joins.merge_products(e, p).filter("product_matched").count() == 0
    assert joins.merge_products(e, p, null_keys=True).filter("product_matched").count() == 8


def test_duplicate_pairs(spark):
    e = frames.examples(spark)
    again = e.unionByName(e.filter("example_id = 1"))
    assert C.check_duplicate_pairs(again)["n_pairs"] == 1
    with pytest.raises(errors.DataIntegrityError):
        C.check_duplicate_pairs(again.unionByName(e.filter("example_id = 1").withColumn("esci_label", F.lit("C"))))


def test_sets_and_guards(spark):
    e = frames.examples(spark)
    a, b = e.filter("query_id = 10"), e.filter("query_id = 11")
    C.require_disjoint(a, b)
    with pytest.raises(errors.SplitError):
        C.require_disjoint(a, a)
    C.require_same(a, a, rows=True)
    with pytest.raises(errors.RankerEvalError):
        C.require_same(a, b)
    with pytest.raises(errors.DataIntegrityError):
        C.require_no_test_rows(e)
    C.require_sizes(a, 3, 1)
    with pytest.raises(errors.DataIntegrityError):
        C.require_sizes(a, 3, 2)
    with pytest.raises(errors.DataIntegrityError):
        C.require_finite(spark.createDataFrame([(float("inf"),)], "x double"), ["x"])
    with pytest.raises(errors.SchemaError):
        C.require_columns(a, ["nope"])
    with pytest.raises(errors.SplitError):
        C.require_together(a, a)
    with pytest.raises(errors.DataIntegrityError):
        C.require_real_data(e)
    with pytest.raises(errors.RankerEvalError):
        C.require_kept(e, a)
    C.require_kept(e, e)


def test_features():
    assert C.check_features(FEATURES) == FEATURES
    assert C.check_feature_subset(reversed(SEMANTIC_FEATURES)) == SEMANTIC_FEATURES
    for bad in ([], ["query_id"], ["nope"]):
        with pytest.raises(errors.RankingGroupError):
            C.check_feature_subset(bad)
    with pytest.raises(errors.RankingGroupError):
        C.check_features(FEATURES[:3])


@pytest.fixture
def many(spark):
    rows = [(q * 10 + k, f"q{q}", q, f"p{k}", "train" if q < 20 else "test") for q in range(25) for k in range(2 if q < 20 else 1)]
    return spark.createDataFrame(rows, "example_id long, query string, query_id long, product_id string, split string")


@pytest.mark.parametrize("exact", [True, False])
def test_split(many, exact):
    parts = split.split_official(many, exact=exact)
    ids = [{r["query_id"] for r in p.collect()} for p in parts]
    assert list(map(len, ids)) == [17, 3, 5] and not ids[0] & ids[1] and ids[2] == set(range(20, 25))
    again = split.split_official(many.repartition(3), exact=exact)
    assert {r["query_id"] for r in again[0].collect()} == ids[0]
    assert {r["partition"]: r["n_rows"] for r in split.partition_counts(*parts).collect()} == {"train": 34, "validation": 6, "test": 5}


def test_split_refuses(many):
    with pytest.raises(errors.SplitError):
        split.split_official(many.withColumn("split", F.when(F.col("example_id") == 0, "test").otherwise(F.col("split"))))
    with pytest.raises(errors.SplitError):
        split.split_official(many.withColumn("split", F.lit("dev")))
    with pytest.raises(errors.SplitError):
        split.split_official(many, fraction=1.0)


def test_profiles(spark):
    e = frames.examples(spark)
    r = joins.dataset_statistics(e).first()
    assert (r["n_rows"], r["n_query_ids"], r["max_candidates"], r["n_products"]) == (9, 5, 3, 5)
    m = {x["column"]: (x["n_missing"], x["n_missing_or_blank"]) for x in joins.missingness(frames.products(spark)).collect()}
    assert m["product_description"] == (2, 3) and m["product_id"] == (0, 0)
    counts = {(x["column"], x["value"]): x["n"] for x in joins.value_counts(e, "query").collect()}
    assert counts["query", None] == 1


def test_features_are_checked_in_the_published_order():
    published = ("bm25_score", "tfidf_score", "shared_token_count", "query_token_coverage", "title_token_coverage", "exact_query_in_title", "brand_match", "title_token_count", "token_length_difference", "query_bullet_coverage")
    assert C.check_features(published) == published
    with pytest.raises(errors.RankingGroupError):
        C.check_features(published[::-1])
