import re

import pytest
from pyspark.sql import functions as F

from candela.functions import text as T

SAMPLES = [None, "", "  ", "NaN", " nan ", "A  b\tC d", "xbox-one v1.2 and/or", " x ", "None", "<NA>", "KK", "a--b 3.", "ÉCOLE 12"]


def normal(x):
    x = re.sub(r"\s+", " ", (x or "").strip()).lower()
    return "" if x == "nan" else x


def test_normalize_and_tokenize(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(SAMPLES)], "i int, x string")
    for r in df.select("x", T.normalize_text("x").alias("n"), T.tokenize("x").alias("t")).collect():
        assert r["n"] == normal(r["x"])
        assert r["t"] == re.findall(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*", normal(r["x"]))


def test_clean_text_keeps_case(spark):
    df = spark.createDataFrame([(x,) for x in [None, " None", "<NaT>", " A  b "]], "x string")
    assert [r[0] for r in df.select(T.clean_text("x")).collect()] == ["", "", "", "A  b"]


def test_product_text(spark):
    df = spark.createDataFrame([("Tea Pot", None, " A\tb "), (None, "X", "nan"), ("nan", None, None)], "product_title string, product_brand string, product_bullet_point string")
    rows = T.add_product_text(df).select("product_text", "product_text_combined").collect()
    assert [tuple(r) for r in rows] == [("tea pot", "tea pot a b"), ("", "x"), ("", "")]
    assert T.empty_titles(T.add_product_text(df)) == 2


@pytest.mark.parametrize(("needle", "hay", "found"), [("a b", "x a b", True), ("a b", "a x b", False), ("", "a", False), ("a", "ab", False), ("x a", "x a", True)])
def test_phrase(spark, needle, hay, found):
    df = spark.createDataFrame([(needle, hay)], "n string, h string")
    assert df.select(T.contains_phrase(T.tokenize("n"), T.tokenize("h"))).first()[0] is found


def test_digits_and_titles(spark):
    df = spark.createDataFrame([("a1",), ("٣",), ("a",), (None,)], "q string")
    assert [r[0] for r in df.select(T.has_digit("q")).collect()] == [True, True, False, False]
    assert T.shorten_title("a  b " * 40, 20, 2).count("\n") == 1
    assert df.select(T.ratio(F.lit(1), F.lit(0))).first()[0] == 0.0
