"""Lexical scores whose statistics are local to a query's candidates: BM25, TF-IDF cosine, random."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.constants import B, EPSILON, K1, SEED
from candela.functions.text import tokenize
from candela.operators.contracts import require_columns
from candela.plans.lineage import written
from candela.session import importable


def _tokens(df: DataFrame, text: str, query: str = "query", spread: bool = False) -> DataFrame:
    """df with _d (tokens), _q (of the query's first row by example_id), _n and _mean (documents and mean length).

    Rows are dealt by query_id, which ranks after it share. With spread a query's few numbers are summed before they move and come
    back by a join, so that queries of very many or very long documents don't meet in a task.
    """
    require_columns(df, ("query_id", query, text), error=KeyError)
    if spread:
        # Long texts are dealt evenly, tokenised and counted once; what is made of them reads that.
        df = df.repartition(F.xxhash64("query_id", "example_id" if "example_id" in df.columns else text))
    t = df.withColumn("_d", tokenize(text))
    if spread:
        t = t.withColumn("_tc", F.explode(F.array(term_counts(F.col("_d")))))
        t = written(t.select(*t.columns[:-1], F.transform("_tc", lambda x: x["term"]).alias("_tl"), F.transform("_tc", lambda x: x["tf"]).alias("_tf")), "tokens")
    values = {
        "_first": F.min_by(F.struct(F.coalesce(F.col(query), F.lit("")).alias("q")), F.col("example_id").cast("string") if "example_id" in df.columns else F.col(query)),
        "_n": F.count("*"),
        "_mean": F.avg(F.size("_d")),
    }
    if spread:
        t = _attach(t, t.groupBy("query_id").agg(*[v.alias(c) for c, v in values.items()]))
    else:
        t = t.withColumns({c: v.over(Window.partitionBy("query_id")) for c, v in values.items()})
    return t.withColumn("_q", tokenize(F.col("_first.q"))).drop("_first")


def document_frequency(df: DataFrame, text: str) -> DataFrame:
    """query_id, term, df and n of every term of a query's candidates. Sums before it shuffles."""
    t = df.select("query_id", tokenize(text).alias("_d"))
    n = t.groupBy("query_id").agg(F.count("*").alias("n"))
    return t.select("query_id", F.explode(F.array_distinct("_d")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df")).join(n, "query_id")


def _look(table: Column, term: Column) -> Column:
    return F.coalesce(F.try_element_at(table, term), F.lit(0).cast("long"))


def _count(tokens: Column, term: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term)).cast("double")


def _listed_count(term: Column) -> Column:
    """As _count() of _d, from its counts."""
    return F.coalesce(F.get("_tf", F.array_position("_tl", term).cast("int") - 1), F.lit(0)).cast("double")


def _frequencies(t: DataFrame, wanted: bool) -> DataFrame:
    """query_id, _df (map of terms to frequencies; of the query's terms alone if wanted), _idf_sum and _terms (over all terms)."""
    # A query's own tokens and its size are one row for each query, beside which its terms are counted without them.
    queries = t.groupBy("query_id").agg(F.first("_q").alias("_q"), F.first("_n").alias("_n"))
    terms = _attach(t.select("query_id", F.explode(F.array_distinct("_d")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df")), queries)
    idf = F.ln(F.col("_n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    entry = F.struct("term", "df")
    kept = F.when(F.array_contains("_q", F.col("term")), entry) if wanted else entry
    return terms.groupBy("query_id").agg(F.map_from_entries(F.collect_list(kept)).alias("_df"), F.sum(idf).alias("_idf_sum"), F.count("*").alias("_terms"))


def _bm25(tf_of) -> Column:
    """Of rows with _q, _d, _n, _mean, _df, _idf_sum and _terms. Contributions are added in the query's order, so equal documents tie exactly."""
    mean = F.coalesce(F.try_divide(F.col("_idf_sum"), F.col("_terms")), F.lit(0.0))

    def add(total: Column, term: Column) -> Column:
        n = _look(F.col("_df"), term).cast("double")
        raw = F.ln(F.col("_n") - n + 0.5) - F.ln(n + 0.5)
        idf = F.when(raw < 0, EPSILON * mean).otherwise(raw)
        tf = tf_of(term)
        long = K1 * (1 - B + B * F.size("_d") / F.greatest(F.col("_mean"), F.lit(1e-300)))
        return F.when(tf > 0, total + idf * tf * (K1 + 1) / (tf + long)).otherwise(total)

    return F.when(F.col("_df").isNull(), F.lit(0.0)).otherwise(F.aggregate("_q", F.lit(0.0), add))


def _weight(n: Column) -> Column:
    return F.ln((1.0 + F.col("_n")) / (1.0 + n)) + 1.0


def _local_norm() -> Column:
    """The norm of a row's own vector from the table of all terms, in their order, so that equal bags tie exactly."""
    part = lambda total, x: total + F.pow(_count(F.col("_d"), x) * _weight(_look(F.col("_df"), x)), F.lit(2.0))
    return F.sqrt(F.aggregate(F.array_sort(F.array_distinct("_d")), F.lit(0.0), part))


def _cosine(tf_of) -> Column:
    """Of rows with _q, _d, _n, _df, _norm and _known (the query's terms that a candidate has)."""
    of_query = lambda x: _count(F.col("_q"), x) * _weight(_look(F.col("_df"), x))
    query_norm = F.sqrt(F.aggregate("_known", F.lit(0.0), lambda a, x: a + F.pow(of_query(x), F.lit(2.0))))
    dot = F.aggregate("_known", F.lit(0.0), lambda a, x: a + of_query(x) * tf_of(x) * _weight(_look(F.col("_df"), x)))
    return F.coalesce(F.try_divide(dot, query_norm * F.col("_norm")), F.lit(0.0))


def _known() -> Column:
    known = F.filter(F.array_sort(F.array_distinct("_q")), lambda x: _look(F.col("_df"), x) > 0)
    return F.when(F.col("_df").isNull(), F.array().cast("array<string>")).otherwise(known)


def _scored(df: DataFrame, text: str, query: str, bm25: str | None, tfidf: str | None, long_texts: bool) -> DataFrame:
    """Both scores, or one, from one tokenisation and one table of frequencies."""
    t = _tokens(df, text, query, long_texts)
    tf_of = _listed_count if long_texts else lambda x: _count(F.col("_d"), x)
    if long_texts and tfidf:
        require_columns(df, ("example_id",), error=KeyError)
        term = t.select("query_id", "example_id", "_n", F.explode(F.arrays_zip(F.col("_tl").alias("term"), F.col("_tf").alias("tf"))).alias("x")).select("query_id", "example_id", "_n", "x.*")
        counts = term.groupBy("query_id", "term").agg(F.count("*").alias("df"))
        parts = _attach_terms(term, counts).groupBy("query_id", "example_id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * _weight(F.col("df")), F.lit(2.0)))).alias("_norm"))
    t = _attach(t, _frequencies(t, long_texts or not tfidf))
    values = {}
    if bm25:
        values[bm25] = _bm25(tf_of)
    if tfidf:
        if long_texts:
            t = t.join(parts.withColumnsRenamed({"query_id": "_pq", "example_id": "_pe"}), F.col("query_id").eqNullSafe(F.col("_pq")) & F.col("example_id").eqNullSafe(F.col("_pe")), "left").drop("_pq", "_pe")
            norm = F.coalesce("_norm", F.lit(0.0))
        else:
            norm = _local_norm()
        t = t.withColumns({"_norm": norm, "_known": _known()})
        values[tfidf] = _cosine(tf_of)
    return t.withColumns(values).select(*[c for c in df.columns if c not in values], *values)


def term_counts(tokens: Column) -> Column:
    """Each different token and how often it stands there: array of (term, tf), in order, from the row alone."""
    ends = lambda s: F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i + 1) != x, F.lit(True)), F.struct(x.alias("term"), (i + 1).alias("end")))), lambda x: x.isNotNull())
    sizes = lambda e: F.transform(e, lambda x, i: F.struct(x["term"].alias("term"), (x["end"] - F.coalesce(F.when(i > 0, F.get(e, i - 1)["end"]), F.lit(0))).alias("tf")))
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    return once(F.array_sort(tokens), lambda s: once(ends(s), sizes))


def _attach_terms(term: DataFrame, counts: DataFrame) -> DataFrame:
    other = counts.withColumnsRenamed({"query_id": "_cq", "term": "_ct"})
    return term.join(other, F.col("query_id").eqNullSafe(F.col("_cq")) & (F.col("term") == F.col("_ct"))).drop("_cq", "_ct")


def add_bm25(df: DataFrame, text: str = "product_text", score: str = "bm25_score", query: str = "query", long_texts: bool = False) -> DataFrame:
    """Okapi BM25 with k1 1.5, b 0.75; weights under 0 become a quarter of all terms' mean weight.

    A query's frequency table holds its own terms only; its other terms matter through
    their mean. 0 for queries without tokens and where no candidate has any. long_texts as in add_tfidf().
    """
    return _scored(df, text, query, score, None, long_texts)


def _attach(t: DataFrame, by_query: DataFrame) -> DataFrame:
    """Left join on query_id that also matches null ids, over the partitioning that both sides have."""
    other = by_query.withColumnRenamed("query_id", "_id")
    return t.join(other, F.col("query_id").eqNullSafe(F.col("_id")), "left").drop("_id")


def add_tfidf(df: DataFrame, text: str = "product_text", score: str = "tfidf_score", query: str = "query", long_texts: bool = False) -> DataFrame:
    """Cosine of raw-count TF-IDF vectors, idf = ln((1 + n) / (1 + df)) + 1 of the candidates alone.

    Query terms that no candidate has are left out; 0 where a vector is. With long_texts, document norms come from a
    join of postings, so that no table of a query's whole vocabulary is made; otherwise from that table, in the order of
    terms, so that equal bags tie exactly.
    """
    return _scored(df, text, query, None, score, long_texts)


def add_lexical(df: DataFrame, text: str = "product_title", long_texts: bool = False) -> DataFrame:
    """bm25_score and tfidf_score over titles, from one tokenisation and one table of frequencies."""
    return _scored(df, text, "query", "bm25_score", "tfidf_score", long_texts)


def query_seed(query_id, seed: int = SEED) -> int:
    """The first 8 bytes of BLAKE2b of "seed:query_id", little-endian, modulo 2**32."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{query_id}".encode(), digest_size=8).digest(), "little") % 2**32


def add_random(df: DataFrame, seed: int = SEED, score: str = "random_score", exact: bool = False) -> DataFrame:
    """Random scores that depend on ids alone.

    Plain: the first 52 bits of MD5 of seed, query and product, JVM-side. exact: NumPy's generator, seeded for each query, over its
    candidates by product_id, as published results have them; a query's candidates meet in one Python task.
    """
    if not exact:
        key = F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("product_id").cast("string"))
        return df.withColumn(score, F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / float(1 << 52))
    from pyspark.sql import types as T

    importable(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name != score]

    def draw(pdf):
        order = pdf["product_id"].astype(str).argsort(kind="stable").to_numpy()
        values = np.empty(len(pdf))
        values[order] = np.random.default_rng(query_seed(pdf["query_id"].iloc[0], seed)).random(len(pdf))
        return pdf.assign(**{score: values})[[f.name for f in fields] + [score]]

    return df.groupBy("query_id").applyInPandas(draw, T.StructType([*fields, T.StructField(score, T.DoubleType())]))
