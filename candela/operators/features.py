"""Row-local features, the feature table and semantic similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.constants import FEATURES, IDENTIFIERS, SEMANTIC_COLUMNS
from candela.errors import DataIntegrityError, SemanticJoinError
from candela.functions.text import clean_text, contains_phrase, ratio, tokenize
from candela.operators.contracts import key_report, require_columns, require_disjoint, require_finite, require_no_test_rows, require_same, require_unique
from candela.operators.lexical import add_lexical
from candela.session import importable


def add_basic_features(df: DataFrame) -> DataFrame:
    """PR9: the eight overlap and length features. No row moves, so it also runs on streams."""
    column = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    t = df.withColumns({"_q": tokenize("query"), "_t": tokenize("product_title"), "_b": tokenize(column("product_brand")), "_u": tokenize(column("product_bullet_point"))})
    q, title = F.array_distinct("_q"), F.array_distinct("_t")
    shared = F.size(F.array_intersect("_q", "_t"))
    return t.withColumns({
        "shared_token_count": shared,
        "query_token_coverage": ratio(shared, F.size(q)),
        "title_token_coverage": ratio(shared, F.size(title)),
        "exact_query_in_title": contains_phrase(F.col("_q"), F.col("_t")).cast("int"),
        "brand_match": contains_phrase(F.col("_b"), F.col("_q")).cast("int"),
        "title_token_count": F.size("_t"),
        "token_length_difference": F.size("_q") - F.size("_t"),
        "query_bullet_coverage": ratio(F.size(F.array_intersect("_q", "_u")), F.size(q)),
    }).drop("_q", "_t", "_b", "_u")


def join_cached_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """bm25_score and tfidf_score by example_id; ids must be unique and the same on both sides."""
    require_unique(df, ["example_id"], "candidates")
    require_unique(scores, ["example_id"], "scores")
    require_same(df, scores, "example_id", error=DataIntegrityError)
    return df.drop("bm25_score", "tfidf_score").join(scores.select("example_id", "bm25_score", "tfidf_score"), "example_id")


def feature_table(df: DataFrame, scores: DataFrame | None = None, check: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Identifiers and the 10 features in their order. keep: further columns, such as split, for later checks."""
    t = add_basic_features(df)
    t = add_lexical(t) if scores is None else join_cached_scores(t, scores)
    require_columns(t, (*IDENTIFIERS, *FEATURES, *keep), error=KeyError)
    t = t.select(*IDENTIFIERS, *FEATURES, *keep)
    if check:
        require_finite(t, FEATURES)
    return t


def feature_tables(train: DataFrame, validation: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """R9 for both sides of a split, after A3."""
    require_disjoint(train, validation)
    return feature_table(train, **options), feature_table(validation, **options)


def semantic_input(df: DataFrame) -> DataFrame:
    """PR7: the five columns that an encoder needs, cleaned; test rows and null or repeated ids raise."""
    require_columns(df, SEMANTIC_COLUMNS)
    require_no_test_rows(df)
    if not df.filter("example_id IS NULL").isEmpty():
        raise DataIntegrityError("null example_id")
    require_unique(df, ["example_id"], "semantic input")
    return df.select("example_id", "query_id", "product_id", clean_text("query").alias("query"), clean_text("product_title").alias("product_title"))


class HashingEncoder:
    """A deterministic encoder: tokens' MD5 picks a dimension, counts are normalised. JVM-side."""

    def __init__(self, dimensions: int = 16):
        self.dimensions = dimensions

    def encode(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """texts with a column embedding (array<double>, unit or zero)."""
        place = lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(self.dimensions))
        places = F.transform(tokenize(text), place)
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), lambda i: F.size(F.filter(F.col("_places"), lambda p: p == i)).cast("double"))
        norm = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x * x))
        return texts.withColumn("_places", places).withColumn("_counts", counts).withColumn("_norm", norm).withColumn("embedding", F.transform("_counts", lambda x: F.coalesce(F.try_divide(x, F.col("_norm")), F.lit(0.0)))).drop("_places", "_counts", "_norm")


def resolve_device(asked: str | None = None) -> str:
    """V5: the device asked for, else the executors' CUDA device where torch finds one, else the CPU."""
    if asked:
        return asked
    try:
        from torch import cuda
    except ImportError:
        return "cpu"
    return "cuda" if cuda.is_available() else "cpu"


def default_batch_size(device: str) -> int:
    """V5. Fixed values."""
    return 256 if device.startswith("cuda") else 32


def runtime_metadata(encoder, device: str, batch_size: int, normalized: bool = True) -> dict:
    """V5: what made the vectors, with the versions of the libraries that are there."""
    import importlib.metadata as installed

    found = {"model_identifier": getattr(encoder, "name", type(encoder).__name__), "model_revision": getattr(encoder, "revision", None), "embedding_dimension": getattr(encoder, "dimensions", None)}
    found |= {"device": device, "batch_size": batch_size, "normalization": "l2" if normalized else "none"}
    for name in ("sentence-transformers", "torch"):
        try:
            found[f"{name.replace('-', '_')}_version"] = installed.version(name)
        except installed.PackageNotFoundError:
            pass
    return found


class FunctionEncoder:
    """encode(list of texts) -> matrix, run on batches of different texts.

    make: called once in each task, with the device, for a function that holds a model; function otherwise.
    """

    def __init__(self, function=None, make=None, device: str | None = None, batch_size: int | None = None, name: str = "function", dimensions: int | None = None):
        self.function, self.make, self.device, self.batch_size, self.name, self.dimensions = function, make, device, batch_size, name, dimensions

    def encode(self, texts: DataFrame, text: str = "text") -> DataFrame:
        function, make, device, batch_size = self.function, self.make, self.device, self.batch_size
        importable(texts.sparkSession)

        def run(frames):
            from candela.operators.features import default_batch_size, resolve_device

            own = resolve_device(device)
            call, most = make(own) if make else function, batch_size or default_batch_size(own)
            for pdf in frames:
                for at in range(0, len(pdf), most):
                    part = pdf.iloc[at : at + most]
                    yield part.assign(embedding=[list(map(float, v)) for v in call(part[text].tolist())])

        return texts.mapInPandas(run, f"{text} string, embedding array<double>")


class SentenceEncoder(FunctionEncoder):
    """V4: a pretrained sentence transformer, loaded once in each task, with unit vectors. Needs the library sentence-transformers on the executors."""

    def __init__(self, name: str, device: str | None = None, batch_size: int | None = None, revision: str | None = None):
        self.revision = revision

        def make(own: str):
            from sentence_transformers import SentenceTransformer

            model = SentenceTransformer(name, device=own, revision=revision)
            return lambda x: model.encode(x, batch_size=len(x), normalize_embeddings=True, show_progress_bar=False)

        super().__init__(make=make, device=device, batch_size=batch_size, name=name)


def encode_unique(texts: DataFrame, encoder, text: str = "text") -> DataFrame:
    """V1: text, embedding of every different cleaned text, encoded once."""
    return encoder.encode(texts.select(clean_text(text).alias(text)).distinct(), text)


def text_statistics(df: DataFrame, *columns: str) -> DataFrame:
    """Column, n_texts, n_unique, n_reused."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), clean_text(c).alias("text")) for c in columns])).alias("x")).select("x.*")
    return stacked.groupBy("column").agg(F.count("*").alias("n_texts"), F.countDistinct("text").alias("n_unique")).withColumn("n_reused", F.col("n_texts") - F.col("n_unique"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """V2: of unit vectors, cut to [-1, 1]. Vectors of different lengths raise."""
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors have different lengths")).cast("double"))


def semantic_features(train: DataFrame, validation: DataFrame, encoder) -> tuple[DataFrame, DataFrame]:
    """V3: example_id, query_id, product_id, semantic_similarity of both sides; each different text is encoded once for both."""
    both = semantic_input(train).withColumn("_s", F.lit(0)).unionByName(semantic_input(validation).withColumn("_s", F.lit(1)))
    texts = both.select(F.explode(F.array("query", "product_title")).alias("text"))
    vectors = encode_unique(texts, encoder)
    t = both.join(vectors.select(F.col("text").alias("query"), F.col("embedding").alias("_x")), "query").join(vectors.select(F.col("text").alias("product_title"), F.col("embedding").alias("_y")), "product_title")
    t = t.select("example_id", "query_id", "product_id", "_s", cosine(F.col("_x"), F.col("_y")).alias("semantic_similarity"))
    return t.filter("_s = 0").drop("_s"), t.filter("_s = 1").drop("_s")


def join_similarity(df: DataFrame, similarity: DataFrame) -> DataFrame:
    """Df with semantic_similarity by example_id.

    Ids must be unique, every row must find a finite value, and query and product must agree.
    """
    for side, name in ((df, "features"), (similarity, "similarities")):
        if key_report(side, ["example_id"]).first()["n_duplicate_keys"]:
            raise SemanticJoinError(f"{name} have duplicate example_id")
    right = similarity.select("example_id", F.col("query_id").alias("_q"), F.col("product_id").alias("_p"), "semantic_similarity")
    t = df.drop("semantic_similarity").join(right, "example_id", "left")
    s = F.col("semantic_similarity")
    bad = t.agg(F.count(F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), 1)).alias("missing"), F.count(F.when(~(F.col("_q").eqNullSafe(F.col("query_id")) & F.col("_p").eqNullSafe(F.col("product_id"))), 1)).alias("other")).first()
    if bad["missing"] or bad["other"]:
        raise SemanticJoinError(f"{bad['missing']} rows without a finite similarity, {bad['other']} of another query or product")
    return t.drop("_q", "_p")


def similarity_distribution(df: DataFrame, column: str = "semantic_similarity") -> DataFrame:
    """N, min, p1, p25, median, mean, p75, p99, max, std (population)."""
    at = lambda p: F.percentile(column, F.lit(p))
    return df.agg(F.count(column).alias("n"), F.min(column).alias("min"), at(0.01).alias("p1"), at(0.25).alias("p25"), at(0.5).alias("median"), F.avg(column).alias("mean"), at(0.75).alias("p75"), at(0.99).alias("p99"), F.max(column).alias("max"), F.stddev_pop(column).alias("std"))
