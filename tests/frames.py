"""Small literal tables."""

EXAMPLES = "example_id long, query string, query_id long, product_id string, product_locale string, esci_label string, small_version int, large_version int, split string"
PRODUCTS = "product_id string, product_title string, product_description string, product_bullet_point string, product_brand string, product_color string, product_locale string"


def examples(spark):
    rows = [
        (1, "red kettle", 10, "p1", "us", "E", 1, 1, "train"),
        (2, "red kettle", 10, "p2", "us", "I", 1, 1, "train"),
        (3, "red kettle", 10, "p3", "us", "S", 1, 1, "train"),
        (4, "acme x200 cable", 11, "p2", "us", "C", 1, 1, "train"),
        (5, "acme x200 cable", 11, "p4", "us", "E", 1, 1, "train"),
        (6, None, 12, "p1", "us", "I", 1, 1, "test"),
        (7, "lamp", 12, "p9", "us", "S", 1, 1, "test"),
        (8, "ランプ", 13, "p1", "jp", "E", 1, 1, "train"),
        (9, "lamp", 14, "p1", "us", "E", 0, 1, "train"),
    ]
    return spark.createDataFrame(rows, EXAMPLES)


def products(spark):
    rows = [
        ("p1", "Red Steel Kettle 1.5 L red", "boils", "fast  steel\tkettle", "Acme", "red", "us"),
        ("p2", "Garden hose", None, None, None, "green", "us"),
        ("p3", "Red teapot", "", "NaN", "Tea Co", None, "us"),
        ("p4", "ACME X200 cable", "d", "b", "acme", "black", "us"),
        ("p1", "やかん", None, None, None, None, "jp"),
    ]
    return spark.createDataFrame(rows, PRODUCTS)


def scored(spark):
    rows = [(1, "a", 10, 0.5), (1, "b", 9, 0.5), (1, "b", 10, 0.5), (1, "c", 1, float("nan")), (1, "d", 2, 0.9), (1, "e", 3, None), (None, "a", 4, 0.1), (2, "z", 5, -1.0)]
    return spark.createDataFrame(rows, "query_id long, product_id string, example_id long, xgb_score double")
