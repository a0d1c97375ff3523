"""The engine's operators as queries over the test tables, and their SQL.

Doubles are rounded on both sides, and scores before they rank, so that sums in another order can't
change a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.constants import BASIC_FEATURES, K, SEED
from candela.functions.text import contains_phrase, normalize_text, token_overlap, tokenize, has_digit, add_product_text, clean_text  # noqa: F401
from candela.operators import compare, contracts, diagnostics, features, joins, lexical, ranking, split
from candela import errors
from candela.plans.lineage import cut, fresh_path, written
from candela.sources import tables
from candela.sources.adapters import CANDIDATES, LONG_TEXTS, PRODUCTS, VECTORS, candidates, products, select

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
METRICS = ("ndcg", "recall", "mrr")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    # Adding 0 makes -0 plain.
    return (F.round(c, digits) + 0.0).alias(name) if name else F.round(c, digits) + 0.0


def counted(t: DataFrame) -> DataFrame:
    """Integers as bigint, as SQL's counts are."""
    return t.select(*[F.col(f"`{c}`").cast("bigint") if k in ("int", "smallint") else F.col(f"`{c}`") for c, k in t.dtypes])


# --- SQL in steps -------------------------------------------------------------------------------------------------------------

TOKEN = r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN}')"


CAND = f"WITH cand AS ({CANDIDATES})"
_STATS = f"""
tok AS (SELECT *, {tok("query")} AS q, {tok("product_title")} AS d FROM cand),
n AS (SELECT query_id, count(*) AS n, avg(len(d)) AS mean FROM tok GROUP BY query_id),
df AS (SELECT query_id, t, count(*) AS df FROM (SELECT query_id, unnest(list_distinct(d)) AS t FROM tok) GROUP BY query_id, t),
idf AS (SELECT query_id, t, df, n, mean, ln(n - df + 0.5) - ln(df + 0.5) AS raw, ln((1.0 + n) / (1.0 + df)) + 1 AS smooth FROM df JOIN n USING (query_id)),
mean_idf AS (SELECT query_id, avg(raw) AS mean_raw FROM idf GROUP BY query_id)"""
_BM25 = """
bm_part AS (SELECT example_id, query_id, unnest(q) AS t, d FROM tok),
bm AS (SELECT example_id, sum(CASE WHEN raw < 0 THEN 0.25 * mean_raw ELSE raw END * len(list_filter(d, lambda x: x = p.t)) * 2.5 / (len(list_filter(d, lambda x: x = p.t)) + 1.5 * (0.25 + 0.75 * len(d) / mean))) AS s
  FROM bm_part p JOIN idf i ON p.query_id = i.query_id AND p.t = i.t JOIN mean_idf m ON m.query_id = p.query_id GROUP BY example_id)"""
_TFIDF = """
dv AS (SELECT example_id, query_id, t, count(*) AS tf FROM (SELECT example_id, query_id, unnest(d) AS t FROM tok) GROUP BY ALL),
qv AS (SELECT example_id, query_id, t, count(*) AS tf FROM (SELECT example_id, query_id, unnest(q) AS t FROM tok) GROUP BY ALL),
dn AS (SELECT example_id, sqrt(sum(power(tf * smooth, 2))) AS norm FROM dv JOIN idf USING (query_id, t) GROUP BY example_id),
qn AS (SELECT example_id, sqrt(sum(power(tf * smooth, 2))) AS norm FROM qv JOIN idf USING (query_id, t) GROUP BY example_id),
dots AS (SELECT qv.example_id, sum(qv.tf * dv.tf * smooth * smooth) AS s FROM qv JOIN dv ON qv.example_id = dv.example_id AND qv.t = dv.t JOIN idf ON idf.query_id = qv.query_id AND idf.t = qv.t GROUP BY qv.example_id),
tf AS (SELECT example_id, s / (dn.norm * qn.norm) AS s FROM dots JOIN dn USING (example_id) JOIN qn USING (example_id))"""
_RANDOM = f"rnd AS (SELECT example_id, ('0x' || substr(md5('{SEED}:' || query_id::VARCHAR || ':' || product_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS s FROM cand)"
_SCORED = f"""
{_STATS}, {_BM25}, {_TFIDF}, {_RANDOM},
scored AS (SELECT c.*, round(coalesce(bm.s, 0), 9) AS bm25_score, round(coalesce(tf.s, 0), 9) AS tfidf_score, round(rnd.s, 9) AS random_score
  FROM cand c LEFT JOIN bm USING (example_id) LEFT JOIN tf USING (example_id) LEFT JOIN rnd USING (example_id))"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {} DESC, product_id::VARCHAR, example_id)"
_RANKED = f"""{_SCORED},
ranked AS (SELECT *, {_RANK.format("bm25_score")} AS rank_bm25, {_RANK.format("tfidf_score")} AS rank_tfidf, {_RANK.format("random_score")} AS rank_random,
  row_number() OVER (PARTITION BY query_id ORDER BY relevance_gain DESC) AS ideal, esci_label IN ('E', 'S') AS rel FROM scored)"""


def _per(model: str) -> str:
    r = f"rank_{model}"
    return f"""per_{model} AS (SELECT query_id, min(query) AS query, count(*) AS n_candidates,
  coalesce(sum(CASE WHEN {r} <= 10 THEN relevance_gain / log2({r} + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 10 THEN relevance_gain / log2(ideal + 1) ELSE 0 END), 0), 0) AS ndcg,
  coalesce(count(*) FILTER (rel AND {r} <= 10)::DOUBLE / nullif(count(*) FILTER (rel), 0), 0) AS recall, coalesce(1.0::DOUBLE / min({r}) FILTER (rel), 0) AS mrr FROM ranked GROUP BY query_id)"""


_PER = f"{_RANKED}, {_per('bm25')}, {_per('tfidf')}, {_per('random')}"
_DELTA = f"""{_PER}, delta AS (SELECT t.query_id, t.query, round(t.ndcg, 9) AS left_value, round(b.ndcg, 9) AS right_value, round(round(t.ndcg, 9) - round(b.ndcg, 9), 9) AS diff FROM per_tfidf t JOIN per_bm25 b USING (query_id))"""


# --- Spark in steps -----------------------------------------------------------------------------------------------------------


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lexical.add_random(lexical.add_lexical(candidates(spark, sf_dir)))
    return t.withColumns({c: F.round(c, 9) for c in ("bm25_score", "tfidf_score", "random_score")})


def ranked(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    return ranking.add_ranks(scored(spark, sf_dir) if t is None else t, {"bm25_score": "rank_bm25", "tfidf_score": "rank_tfidf", "random_score": "rank_random"})


def per_query(t: DataFrame, model: str) -> DataFrame:
    p = ranking.per_query_metrics(t, K, f"rank_{model}")
    return p.select("query_id", "query", "n_candidates", *[F.col(f"`{a}`").alias(b) for a, b in ((f"ndcg@{K}", "ndcg"), (f"recall@{K}", "recall"), ("mrr", "mrr"))])


def deltas(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    """TF-IDF against BM25 by query, of ranked(); its rows are computed once for both."""
    t = cut(ranked(spark, sf_dir, t).select("query_id", "query", "example_id", "esci_label", "relevance_gain", "rank_bm25", "rank_tfidf"))
    a, b = (per_query(t, m).withColumn("ndcg", F.round("ndcg", 9)) for m in ("tfidf", "bm25"))
    return compare.paired(a, b, "ndcg").withColumn("diff", F.round("diff", 9) + 0.0).join(a.select("query_id", "query"), "query_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of BM25 over all queries."""
    return metric_summary(spark, sf_dir)


# --- Scans, filters, joins ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def scan_pruned_pushdown(spark, sf_dir):
    t = tables.scan(spark, f"{sf_dir}/orders.parquet", ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "orders")
    return t.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"{CAND} SELECT example_id, query_id, product_id FROM cand WHERE product_locale = 'us' AND small_version = 1")
def filter_candidates(spark, sf_dir):
    return joins.filter_examples(candidates(spark, sf_dir), check=False).select("example_id", "query_id", "product_id")


_EXAMPLES = ("example_id", "query_id", "product_id", "product_locale", "esci_label")


@query(f"""{CAND}, prod AS ({PRODUCTS}) SELECT c.example_id, c.query_id, c.product_id, c.product_locale, c.esci_label, p.product_title, p.product_description, p.product_color, p.product_id IS NOT NULL AS product_matched
FROM cand c LEFT JOIN prod p ON c.product_id = p.product_id AND c.product_locale = p.product_locale""")
def merge_many_to_one(spark, sf_dir):
    return joins.merge_products(candidates(spark, sf_dir).select(*_EXAMPLES), products(spark, sf_dir))


@query(f"""{CAND}, prod AS ({PRODUCTS}) SELECT count(*) AS n_rows, count(p.product_id) AS n_matched, count(*) - count(p.product_id) AS n_unmatched
FROM cand c LEFT JOIN prod p ON c.product_id = p.product_id AND c.product_locale = p.product_locale""")
def merge_report(spark, sf_dir):
    return joins.merge_report(joins.merge_products(candidates(spark, sf_dir).select(*_EXAMPLES), products(spark, sf_dir)))


@query(f"{CAND}, prod AS ({PRODUCTS}) SELECT example_id, product_id, product_locale FROM cand c WHERE NOT EXISTS (SELECT 1 FROM prod p WHERE c.product_id = p.product_id AND c.product_locale = p.product_locale)")
def unmatched_anti(spark, sf_dir):
    return joins.unmatched(candidates(spark, sf_dir), products(spark, sf_dir)).select("example_id", "product_id", "product_locale")


@query("""SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_duplicate_rows, count(*) FILTER (n > 1) AS n_duplicate_keys
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def key_uniqueness_report(spark, sf_dir):
    return contracts.key_report(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query(f"{CAND} SELECT query_id, product_id, count(*) AS n_rows, count(DISTINCT esci_label) AS n_labels FROM cand GROUP BY ALL HAVING count(*) > 1")
def duplicate_pair_report(spark, sf_dir):
    return contracts.duplicate_pairs(candidates(spark, sf_dir))


# --- Profiles -----------------------------------------------------------------------------------------------------------------


@query(f"""{CAND}, per AS (SELECT query_id, count(*) AS n, count(DISTINCT query) AS texts FROM cand GROUP BY query_id)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_query_ids, count(*) FILTER (texts > 1) AS n_ids_with_several_texts, min(n) AS min_candidates, max(n) AS max_candidates, round(avg(n), 6) AS mean_candidates,
  median(n)::DOUBLE AS median_candidates, quantile_cont(n, 0.25)::DOUBLE AS p25_candidates, quantile_cont(n, 0.75)::DOUBLE AS p75_candidates,
  (SELECT count(DISTINCT query) FROM cand) AS n_queries, (SELECT count(DISTINCT product_id) FROM cand) AS n_products FROM per""")
def dataset_stats(spark, sf_dir):
    t = joins.dataset_statistics(candidates(spark, sf_dir))
    return t.withColumn("mean_candidates", r6("mean_candidates"))


@query(f"""{CAND} SELECT 'esci_label' AS "column", esci_label AS value, count(*) AS n FROM cand GROUP BY ALL UNION ALL SELECT 'split', split, count(*) FROM cand GROUP BY ALL UNION ALL SELECT 'product_brand', product_brand, count(*) FROM cand GROUP BY ALL""")
def label_and_split_counts(spark, sf_dir):
    return joins.value_counts(candidates(spark, sf_dir), "esci_label", "split", "product_brand")


@query(f"""{CAND} SELECT 'query' AS "column", count(*) FILTER (query IS NULL) AS n_missing, count(*) FILTER (query IS NULL OR trim(query) = '') AS n_missing_or_blank FROM cand
UNION ALL SELECT 'product_brand', count(*) FILTER (product_brand IS NULL), count(*) FILTER (product_brand IS NULL OR trim(product_brand) = '') FROM cand
UNION ALL SELECT 'relevance_gain', count(*) FILTER (relevance_gain IS NULL), count(*) FILTER (relevance_gain IS NULL) FROM cand""")
def missingness(spark, sf_dir):
    return joins.missingness(candidates(spark, sf_dir), "query", "product_brand", "relevance_gain")


@query(f"{CAND} SELECT n AS n_candidates, count(*) AS n_queries FROM (SELECT count(*) AS n FROM cand GROUP BY query_id) GROUP BY n")
def candidate_count_distribution(spark, sf_dir):
    per = candidates(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n_candidates"))
    return per.groupBy("n_candidates").agg(F.count("*").alias("n_queries"))


@query(f"""{CAND} SELECT query_id, count(*) AS n_candidates, round(avg(CASE WHEN esci_label IN ('E', 'S') THEN 1.0 ELSE 0.0 END), 6) AS relevant_share, round(avg(CASE WHEN esci_label = 'E' THEN 1.0 ELSE 0.0 END), 6) AS exact_share FROM cand GROUP BY query_id""")
def query_profile(spark, sf_dir):
    t = diagnostics.query_profile(candidates(spark, sf_dir))
    return t.select("query_id", "n_candidates", r6("relevant_share", "relevant_share"), r6("exact_share", "exact_share"))


@query(f"{CAND} SELECT query_id, count(DISTINCT esci_label) AS labels, bool_or(esci_label IN ('E', 'S')) AS has_relevant FROM cand GROUP BY query_id")
def label_sets(spark, sf_dir):
    return diagnostics.label_sets(candidates(spark, sf_dir))


# --- Text ---------------------------------------------------------------------------------------------------------------------


@query(f"{CAND} SELECT example_id, relevance_gain FROM cand")
def relevance_gain(spark, sf_dir):
    return ranking.add_relevance_gain(candidates(spark, sf_dir).drop("relevance_gain")).select("example_id", "relevance_gain")


@query(r"SELECT doc_id, md5(CASE WHEN x = 'nan' THEN '' ELSE x END) AS normal_md5, len(CASE WHEN x = 'nan' THEN '' ELSE x END)::INTEGER AS normal_chars FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS x FROM documents)")
def normalize_texts(spark, sf_dir):
    x = normalize_text("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(x).alias("normal_md5"), F.length(x).alias("normal_chars"))


@query(f"SELECT page_id, len({tok('url')}) AS n_tokens, array_to_string({tok('url')}, ' ') AS tokens FROM pages")
def tokenize_urls(spark, sf_dir):
    t = tokenize("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"{CAND} SELECT example_id, lower(product_title) AS product_text, lower(concat_ws(' ', product_title, product_brand, product_bullet_point)) AS product_text_combined FROM cand")
def product_text_combined(spark, sf_dir):
    return add_product_text(candidates(spark, sf_dir)).select("example_id", "product_text", "product_text_combined")


def _phrase(needle: str, hay: str) -> str:
    return f"(len({needle}) > 0 AND contains(' ' || array_to_string({hay}, ' ') || ' ', ' ' || array_to_string({needle}, ' ') || ' '))::INTEGER"


_FEATURES = f"""
ft AS (SELECT *, {tok("query")} AS q, {tok("product_title")} AS d, {tok("product_brand")} AS b, {tok("product_bullet_point")} AS u FROM cand),
fx AS (SELECT *, len(list_intersect(list_distinct(q), list_distinct(d))) AS shared FROM ft),
basic AS (SELECT example_id, shared::INTEGER AS shared_token_count, round(coalesce(shared::DOUBLE / nullif(len(list_distinct(q)), 0), 0), 6) AS query_token_coverage, round(coalesce(shared::DOUBLE / nullif(len(list_distinct(d)), 0), 0), 6) AS title_token_coverage,
  {_phrase("q", "d")} AS exact_query_in_title, {_phrase("b", "q")} AS brand_match, len(d)::INTEGER AS title_token_count, (len(q) - len(d))::INTEGER AS token_length_difference,
  round(coalesce(len(list_intersect(list_distinct(q), list_distinct(u)))::DOUBLE / nullif(len(list_distinct(q)), 0), 0), 6) AS query_bullet_coverage FROM fx)"""
_COVERAGES = ("query_token_coverage", "title_token_coverage", "query_bullet_coverage")


@query(f"{CAND}, {_FEATURES} SELECT * FROM basic")
def basic_features(spark, sf_dir):
    t = features.add_basic_features(candidates(spark, sf_dir)).select("example_id", *BASIC_FEATURES)
    return t.withColumns({c: F.round(c, 6) for c in _COVERAGES})


# --- Lexical scores and ranks -------------------------------------------------------------------------------------------------


@query(f"{CAND}, {_STATS} SELECT query_id, t AS term, df, n FROM df JOIN n USING (query_id)")
def doc_frequency(spark, sf_dir):
    return lexical.document_frequency(candidates(spark, sf_dir), "product_title")


@query(f"{CAND}, {_STATS}, {_BM25} SELECT c.example_id, round(coalesce(bm.s, 0), 6) + 0.0 AS bm25_score FROM cand c LEFT JOIN bm USING (example_id)")
def bm25_scores(spark, sf_dir):
    return lexical.add_bm25(candidates(spark, sf_dir), "product_title").select("example_id", r6("bm25_score", "bm25_score"))


@query(f"{CAND}, {_STATS}, {_TFIDF} SELECT c.example_id, round(coalesce(tf.s, 0), 6) AS tfidf_score FROM cand c LEFT JOIN tf USING (example_id)")
def tfidf_scores(spark, sf_dir):
    return lexical.add_tfidf(candidates(spark, sf_dir), "product_title").select("example_id", r6("tfidf_score", "tfidf_score"))


@query(f"WITH cand AS ({LONG_TEXTS}), {_STATS}, {_BM25}, {_TFIDF} SELECT c.product_id, round(coalesce(bm.s, 0), 6) + 0.0 AS bm25_score, round(coalesce(tf.s, 0), 6) AS tfidf_score FROM cand c LEFT JOIN bm USING (example_id) LEFT JOIN tf USING (example_id)")
def lexical_scores_longtext(spark, sf_dir):
    t = lexical.add_lexical(select(spark, sf_dir, LONG_TEXTS), long_texts=True)
    return t.select("product_id", r6("bm25_score", "bm25_score"), r6("tfidf_score", "tfidf_score"))


@query(f"{CAND}, {_RANDOM} SELECT example_id, round(s, 9) AS random_score FROM rnd")
def random_scores(spark, sf_dir):
    return lexical.add_random(candidates(spark, sf_dir)).select("example_id", F.round("random_score", 9).alias("random_score"))


@query(f"{CAND}, {_RANKED} SELECT example_id, query_id, rank_bm25::INTEGER AS predicted_rank FROM ranked")
def sort_and_rank(spark, sf_dir):
    t = lexical.add_bm25(candidates(spark, sf_dir), "product_title").withColumn("bm25_score", F.round("bm25_score", 9))
    return ranking.sort_and_rank(t, "bm25_score").select("example_id", "query_id", "predicted_rank")


@query(f"{CAND}, {_RANKED} SELECT example_id, query_id, rank_tfidf::INTEGER AS predicted_rank FROM ranked WHERE rank_tfidf <= 5")
def rerank_topk(spark, sf_dir):
    scorer = lambda t: lexical.add_tfidf(t, "product_title").withColumn("tfidf_score", F.round("tfidf_score", 9))
    return ranking.rerank(candidates(spark, sf_dir), scorer, "tfidf_score", 5).select("example_id", "query_id", "predicted_rank")


@query(f"{CAND}, {_RANKED} SELECT example_id, rank_bm25::INTEGER AS rank_bm25, rank_tfidf::INTEGER AS rank_tfidf, rank_random::INTEGER AS rank_random FROM ranked")
def multi_model_ranks(spark, sf_dir):
    return ranked(spark, sf_dir).select("example_id", "rank_bm25", "rank_tfidf", "rank_random")


# --- Metrics and comparison ---------------------------------------------------------------------------------------------------


@query(f"{CAND}, {_PER} SELECT query_id, query, n_candidates, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM per_bm25")
def per_query_metrics(spark, sf_dir):
    t = per_query(ranked(spark, sf_dir), "bm25")
    return t.select("query_id", "query", "n_candidates", *[r6(m, m) for m in METRICS])


@query(f"""{CAND}, {_PER}, s AS (SELECT unnest(['ndcg', 'recall', 'mrr']) AS metric, unnest([ndcg, recall, mrr]) AS v FROM per_bm25)
SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(coalesce(stddev_samp(v), 0), 6) AS std, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75 FROM s GROUP BY metric""")
def metric_summary(spark, sf_dir):
    t = ranking.summarize_metrics(per_query(ranked(spark, sf_dir), "bm25"), list(METRICS))
    return t.select("metric", "n", *[r6(c, c) for c in ("mean", "median", "std", "p25", "p75")])


@query(f"{CAND}, {_DELTA} SELECT count(*) AS n_queries, round(avg(diff), 6) AS mean_diff, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff = 0) AS ties FROM delta")
def model_comparison(spark, sf_dir):
    return deltas(spark, sf_dir).agg(F.count("*").alias("n_queries"), r6(F.avg("diff"), "mean_diff"), *compare.outcome_counts(F.col("diff")))


@query(f"""{CAND}, {_PER} SELECT t.query_id, t.query, t.n_candidates, round(t.ndcg, 6) AS tfidf_ndcg_at_10, round(t.recall, 6) AS tfidf_recall_at_10, round(t.mrr, 6) AS tfidf_mrr, round(b.ndcg, 6) AS bm25_ndcg_at_10, round(b.recall, 6) AS bm25_recall_at_10, round(b.mrr, 6) AS bm25_mrr,
  round(t.ndcg - b.ndcg, 6) + 0.0 AS delta_ndcg_at_10, round(t.recall - b.recall, 6) + 0.0 AS delta_recall_at_10, round(t.mrr - b.mrr, 6) + 0.0 AS delta_mrr FROM per_tfidf t JOIN per_bm25 b USING (query_id)""")
def paired_metrics(spark, sf_dir):
    t = ranked(spark, sf_dir)
    a, b = (ranking.per_query_metrics(t, K, f"rank_{m}") for m in ("tfidf", "bm25"))
    t = compare.paired_metric_table(a, b, "tfidf", "bm25", K, check=False)
    return t.select("query_id", "query", "n_candidates", *[r6(c, c) for c in t.columns[3:]])


@query(f"""{CAND}, {_DELTA} SELECT count(*) AS n_queries, round(avg(diff), 6) AS mean_diff, round(median(diff), 6) + 0.0 AS median_diff, count(*) FILTER (diff > 1e-12) AS wins, count(*) FILTER (diff < -1e-12) AS losses, count(*) FILTER (abs(diff) <= 1e-12) AS ties,
  round(count(*) FILTER (diff > 1e-12) / count(*), 6) AS win_rate, round(count(*) FILTER (diff < -1e-12) / count(*), 6) AS loss_rate, round(count(*) FILTER (abs(diff) <= 1e-12) / count(*), 6) AS tie_rate FROM delta""")
def paired_summary(spark, sf_dir):
    t = ranked(spark, sf_dir)
    a, b = (per_query(t, m).withColumn("ndcg", F.round("ndcg", 9)) for m in ("tfidf", "bm25"))
    t = compare.paired_summary(a, b, "ndcg", tolerance=1e-12, check=False)
    return t.select("n_queries", r6("mean_diff", "mean_diff"), r6("median_diff", "median_diff"), "wins", "losses", "ties", *[r6(c, c) for c in ("win_rate", "loss_rate", "tie_rate")])


@query(f"""{CAND}, {_DELTA}, t AS (SELECT 'top' AS side, row_number() OVER (ORDER BY diff DESC, query_id)::INTEGER AS place, query_id, diff FROM delta), b AS (SELECT 'bottom' AS side, row_number() OVER (ORDER BY diff, query_id)::INTEGER AS place, query_id, diff FROM delta)
SELECT * FROM t WHERE place <= 10 UNION ALL SELECT * FROM b WHERE place <= 10""")
def top_bottom_deltas(spark, sf_dir):
    return compare.extreme_deltas(deltas(spark, sf_dir).select("query_id", "diff"), 10)


@query(f"""{CAND}, {_PER} SELECT query_id, {", ".join(f"round({m}.{x}, 6) AS {m}_{x}" for m in ("bm25", "tfidf", "random") for x in METRICS)} FROM per_bm25 bm25 JOIN per_tfidf tfidf USING (query_id) JOIN per_random random USING (query_id)""")
def wide_metrics(spark, sf_dir):
    t = ranked(spark, sf_dir)
    w = joins.wide_metrics({m: per_query(t, m) for m in ("bm25", "tfidf", "random")}, list(METRICS))
    return w.select("query_id", *[r6(c, c) for c in w.columns[1:]])


@query(f"""{CAND}, {_RANKED}, a AS (SELECT * FROM ranked WHERE query_id = 1 AND rank_bm25 <= 10), b AS (SELECT * FROM ranked WHERE query_id = 1 AND rank_tfidf <= 10)
SELECT coalesce(a.example_id, b.example_id) AS example_id, round(a.bm25_score, 6) AS bm25_score, a.rank_bm25::INTEGER AS bm25_rank, round(b.tfidf_score, 6) AS tfidf_score, b.rank_tfidf::INTEGER AS tfidf_rank FROM a FULL JOIN b ON a.example_id = b.example_id""")
def example_outer_merge(spark, sf_dir):
    t = lexical.add_lexical(candidates(spark, sf_dir).filter("query_id = 1")).withColumns({c: F.round(c, 9) for c in ("bm25_score", "tfidf_score")})
    top = lambda s: ranking.sort_and_rank(t, s, 10).select("example_id", F.col(s).alias("score"), "predicted_rank")
    t = joins.outer_examples({"bm25": top("bm25_score"), "tfidf": top("tfidf_score")})
    return t.select("example_id", r6("bm25_score", "bm25_score"), "bm25_rank", r6("tfidf_score", "tfidf_score"), "tfidf_rank")


_LISTS = ", ".join(f"list_{m} AS (SELECT query_id, example_id, round({m}_score, 6) AS {m}_score, rank_{m}::INTEGER AS {m}_rank FROM ranked)" for m in ("bm25", "tfidf", "random"))


@query(f"{CAND}, {_RANKED}, {_LISTS} SELECT query_id, example_id, bm25_score, bm25_rank, tfidf_score, tfidf_rank, random_score, random_rank FROM list_bm25 FULL JOIN list_tfidf USING (query_id, example_id) FULL JOIN list_random USING (query_id, example_id)")
def example_outer_merge_all(spark, sf_dir):
    """Whole ranked lists of all queries under all three models; example_outer_merge shows one query's first ten."""
    models = ("bm25", "tfidf", "random")
    t = joins.outer_ranked(ranked(spark, sf_dir).withColumnsRenamed({f"rank_{m}": f"{m}_rank" for m in models}), models)
    return t.select("query_id", "example_id", *[c for m in models for c in (r6(f"{m}_score", f"{m}_score"), f"{m}_rank")])


# --- Segments and diagnostics -------------------------------------------------------------------------------------------------

_LENGTH = f"CASE WHEN len({tok('query')}) <= 1 THEN '1 token' WHEN len({tok('query')}) <= 3 THEN '2–3 tokens' ELSE '4+ tokens' END"
_IDENTIFIER = f"CASE WHEN len(list_filter({tok('query')}, lambda x: regexp_matches(x, '[0-9]'))) > 0 THEN 'identifier-style' ELSE 'other' END"


@query(f"{CAND}, {_DELTA} SELECT {_LENGTH} AS segment, count(diff) AS n, round(avg(diff), 6) + 0.0 AS mean_delta FROM delta GROUP BY 1")
def query_length_segments(spark, sf_dir):
    t = diagnostics.delta_by_length(deltas(spark, sf_dir), "diff")
    return t.select("segment", "n", r6("mean_delta", "mean_delta"))


_OVERLAP = "overlap AS (SELECT query_id, avg(query_token_coverage) AS relevant_overlap FROM basic JOIN cand USING (example_id) WHERE esci_label IN ('E', 'S') GROUP BY query_id)"
_OVERLAP_CASE = "CASE WHEN relevant_overlap IS NULL THEN 'no relevant candidates' WHEN round(relevant_overlap, 4) < 0.4 THEN 'low overlap' WHEN round(relevant_overlap, 4) < 0.7 THEN 'medium overlap' ELSE 'high overlap' END"


def _overlap(spark, sf_dir) -> DataFrame:
    t = features.add_basic_features(candidates(spark, sf_dir)).withColumn("query_token_coverage", F.round("query_token_coverage", 6))
    return t


@query(f"{CAND}, {_FEATURES}, {_OVERLAP} SELECT query_id, round(relevant_overlap, 4) AS relevant_overlap, {_OVERLAP_CASE} AS segment FROM (SELECT DISTINCT query_id FROM cand) LEFT JOIN overlap USING (query_id)")
def overlap_segments(spark, sf_dir):
    t = _overlap(spark, sf_dir)
    t = t.select("query_id").distinct().join(diagnostics.relevant_overlap(t), "query_id", "left").withColumn("relevant_overlap", F.round("relevant_overlap", 4))
    return t.select("query_id", "relevant_overlap", diagnostics.overlap_segment(F.col("relevant_overlap")).alias("segment"))


_SPEARMAN = f"""sp_rank AS (SELECT query_id, bm25_score AS a, tfidf_score AS b, rank() OVER (PARTITION BY query_id ORDER BY bm25_score) + (count(*) OVER (PARTITION BY query_id, bm25_score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY query_id ORDER BY tfidf_score) + (count(*) OVER (PARTITION BY query_id, tfidf_score) - 1) / 2.0 AS rb FROM scored),
spearman AS (SELECT query_id, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN round(covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)), 6) + 0.0 END AS spearman FROM sp_rank GROUP BY query_id)"""
_DISAGREE = "CASE WHEN spearman IS NULL OR isnan(spearman) THEN 'undefined' WHEN spearman < 0.2 THEN 'high disagreement' WHEN spearman < 0.6 THEN 'mixed' ELSE 'high agreement' END"


@query(f"{CAND}, {_SCORED}, {_SPEARMAN} SELECT query_id, spearman FROM spearman")
def spearman_by_query(spark, sf_dir):
    return diagnostics.spearman_by_query(scored(spark, sf_dir), "bm25_score", "tfidf_score").select("query_id", r6("spearman", "spearman"))


@query(f"{CAND}, {_SCORED}, {_SPEARMAN} SELECT {_DISAGREE} AS segment, count(*) AS n_queries FROM spearman GROUP BY 1")
def disagreement_segments(spark, sf_dir):
    t = spearman_by_query(spark, sf_dir)
    return t.groupBy(diagnostics.disagreement_segment(F.col("spearman")).alias("segment")).agg(F.count("*").alias("n_queries"))


@query(f"{CAND} SELECT DISTINCT query_id, {_IDENTIFIER} AS segment FROM cand")
def identifier_segments(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", diagnostics.identifier_segment().alias("segment")).distinct()


_ANNOTATED = f"""{_DELTA}, {_FEATURES}, {_OVERLAP}, {_SPEARMAN},
annotated AS (SELECT d.*, {_LENGTH} AS length_segment, {_OVERLAP_CASE} AS overlap_segment, {_DISAGREE} AS disagreement_segment, {_IDENTIFIER} AS identifier_segment FROM delta d LEFT JOIN overlap USING (query_id) LEFT JOIN spearman USING (query_id))"""


def annotated(spark, sf_dir) -> DataFrame:
    """All segments of all queries; candidates are scored once."""
    t = scored(spark, sf_dir).withColumn("query_token_coverage", F.round(token_overlap(tokenize("query"), tokenize("product_title")), 6))
    t = cut(t.select("query_id", "query", "example_id", "product_id", "esci_label", "relevance_gain", "query_token_coverage", "bm25_score", "tfidf_score", "random_score"))
    return diagnostics.annotate_queries(deltas(spark, sf_dir, t), t, "bm25_score", "tfidf_score", check=False, digits=(4, 6))


@query(f"""{CAND}, {_ANNOTATED}, s AS (SELECT unnest(['length', 'overlap', 'disagreement', 'identifier']) AS family, unnest([length_segment, overlap_segment, disagreement_segment, identifier_segment]) AS segment, diff, left_value FROM annotated)
SELECT family, segment, count(*) AS n_queries, round(avg(diff), 6) + 0.0 AS mean_diff, round(avg(left_value), 6) AS mean_left FROM s GROUP BY ALL HAVING count(*) >= 5""")
def segment_summary(spark, sf_dir):
    t, out = cut(annotated(spark, sf_dir)), None
    for family in ("length", "overlap", "disagreement", "identifier"):
        own = diagnostics.summarize_segments(t, f"{family}_segment", {"mean_diff": "diff", "mean_left": "left_value"}, 5).select(F.lit(family).alias("family"), "segment", "n_queries", r6("mean_diff", "mean_diff"), r6("mean_left", "mean_left"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""{CAND}, {_DELTA}, w AS (SELECT 'improvement' AS kind, row_number() OVER (ORDER BY diff DESC, query_id)::INTEGER AS place, query_id, diff FROM delta WHERE diff > 0), l AS (SELECT 'regression' AS kind, row_number() OVER (ORDER BY diff, query_id)::INTEGER AS place, query_id, diff FROM delta WHERE diff < 0),
t AS (SELECT 'tie' AS kind, row_number() OVER (ORDER BY right_value DESC, query_id)::INTEGER AS place, query_id, diff FROM delta WHERE abs(diff) <= 1e-8)
SELECT * FROM w WHERE place <= 3 UNION ALL SELECT * FROM l WHERE place <= 3 UNION ALL SELECT * FROM t WHERE place <= 3""")
def diagnostic_selection(spark, sf_dir):
    return diagnostics.diagnostic_queries(deltas(spark, sf_dir), "diff", "right_value").select("kind", "place", "query_id", "diff")


_INSPECT = f"""top AS (SELECT query_id, esci_label AS top_label, coalesce(len(list_intersect(list_distinct({tok("query")}), list_distinct({tok("product_title")})))::DOUBLE / nullif(len(list_distinct({tok("query")})), 0), 0) AS top_overlap FROM ranked WHERE rank_bm25 = 1),
labels AS (SELECT query_id, count(DISTINCT esci_label) AS labels, bool_or(rel) AS has_relevant FROM ranked GROUP BY query_id),
im AS (SELECT b.query_id, b.n_candidates, round(b.ndcg, 9) AS ndcg, abs(round(t.ndcg, 9) - round(b.ndcg, 9)) AS diff, regexp_matches(b.query, '[0-9]') AS digit, len({tok("b.query")}) AS tokens, labels, has_relevant, top_label, top_overlap
  FROM per_bm25 b JOIN per_tfidf t USING (query_id) JOIN labels USING (query_id) JOIN top USING (query_id)),
firsts AS (SELECT 1 AS i, 'strong' AS rule, (SELECT query_id FROM im WHERE labels >= 2 ORDER BY ndcg DESC, query_id LIMIT 1) AS query_id
  UNION ALL SELECT 2, 'weak', (SELECT query_id FROM im WHERE has_relevant ORDER BY ndcg, query_id LIMIT 1)
  UNION ALL SELECT 3, 'brand_or_model', (SELECT query_id FROM im WHERE digit ORDER BY ndcg DESC, query_id LIMIT 1)
  UNION ALL SELECT 4, 'broad', (SELECT query_id FROM im WHERE tokens <= 2 ORDER BY n_candidates DESC, query_id LIMIT 1)
  UNION ALL SELECT 5, 'misleading', (SELECT query_id FROM im WHERE top_label = 'I' AND top_overlap >= 0.5 ORDER BY top_overlap DESC, query_id LIMIT 1)
  UNION ALL SELECT 6, 'disagree', (SELECT query_id FROM im ORDER BY diff DESC, query_id LIMIT 1)),
picked AS (SELECT rule, query_id FROM firsts f WHERE query_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM firsts e WHERE e.i < f.i AND e.query_id = f.query_id)),
rest AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS n FROM im WHERE query_id NOT IN (SELECT query_id FROM picked))"""


@query(f"{CAND}, {_PER}, {_INSPECT} SELECT rule, query_id FROM picked UNION ALL SELECT 'fill', query_id FROM rest WHERE n <= 6 - (SELECT count(*) FROM picked)")
def inspection_selection(spark, sf_dir):
    t = cut(ranked(spark, sf_dir).select("query_id", "query", "example_id", "product_title", "esci_label", "relevance_gain", "rank_bm25", "rank_tfidf"))
    a, b = (per_query(t, m).withColumn("ndcg", F.round("ndcg", 9)) for m in ("bm25", "tfidf"))
    m = cut(a.join(b.select("query_id", F.col("ndcg").alias("other_ndcg")), "query_id"))
    rows = diagnostics.inspection_queries(t, m, t.withColumnRenamed("rank_bm25", "predicted_rank"))
    return spark.createDataFrame(rows, "rule string, query_id long")


@query(f"""{CAND}, {_DELTA}, s AS (SELECT min(diff) AS a, max(diff) AS b FROM delta), h AS (SELECT CASE WHEN b = a THEN 1 ELSE least(floor((diff - a) / ((b - a) / 35))::INTEGER + 1, 35) END AS bin, a, b FROM delta, s)
SELECT bin, count(*) AS n, round(a + (bin - 1) * ((b - a) / 35), 6) + 0.0 AS low, round(a + bin * ((b - a) / 35), 6) + 0.0 AS high FROM h GROUP BY bin, a, b""")
def delta_histogram(spark, sf_dir):
    return diagnostics.histogram(cut(deltas(spark, sf_dir).select("diff")), "diff", 35).select("bin", "n", r6("low", "low"), r6("high", "high"))


@query(f"{CAND}, {_DELTA} SELECT CASE WHEN len({tok('query')}) = 0 THEN NULL WHEN len({tok('query')}) <= 1 THEN '1' WHEN len({tok('query')}) <= 3 THEN '2-3' ELSE '4+' END AS bin, count(*) AS n, round(avg(diff), 6) + 0.0 AS mean_delta FROM delta GROUP BY 1")
def paired_bins_by_length(spark, sf_dir):
    return deltas(spark, sf_dir).groupBy(diagnostics.length_bins().alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("diff"), "mean_delta"))


# --- Splits -------------------------------------------------------------------------------------------------------------------

_SPLIT = f"""ids AS (SELECT DISTINCT query_id FROM cand WHERE split = 'train'), placed AS (SELECT query_id, row_number() OVER (ORDER BY md5('{SEED}:' || query_id::VARCHAR), query_id) AS place, count(*) OVER () AS n FROM ids),
parts AS (SELECT query_id, CASE WHEN place <= floor(n * 0.85) THEN 'train' ELSE 'validation' END AS part FROM placed)"""


@query(f"{CAND}, {_SPLIT} SELECT part AS partition, count(*) AS n_rows, count(DISTINCT query_id) AS n_queries FROM cand JOIN parts USING (query_id) WHERE split = 'train' GROUP BY part")
def query_split_hash(spark, sf_dir):
    return split.partition_counts(split.hash_split(candidates(spark, sf_dir)))


@query(f"{CAND}, {_SPLIT} SELECT count(*) AS n_shared FROM (SELECT query_id FROM parts WHERE part = 'train' INTERSECT SELECT query_id FROM parts WHERE part = 'validation')")
def split_disjointness(spark, sf_dir):
    t = split.hash_split(candidates(spark, sf_dir))
    return contracts.shared_queries(t.filter("partition = 'train'"), t.filter("partition = 'validation'")).agg(F.count("*").alias("n_shared"))


@query()
def query_split_exact(spark, sf_dir):
    return split.partition_counts(*split.split_official(candidates(spark, sf_dir)))


# --- Vectors ------------------------------------------------------------------------------------------------------------------

_COSINE = f"cosines AS (SELECT example_id, query_id, product_id, greatest(-1.0, least(1.0, list_sum(list_transform(list_zip(query_vector, title_vector), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)))) AS s FROM ({VECTORS}))"


def _cosines(spark, sf_dir) -> DataFrame:
    t = select(spark, sf_dir, VECTORS)
    return t.select("example_id", "query_id", "product_id", features.cosine(F.col("query_vector"), F.col("title_vector")).alias("semantic_similarity"))


@query(f"WITH {_COSINE} SELECT example_id, query_id, round(s, 6) + 0.0 AS semantic_similarity FROM cosines")
def cosine_similarity(spark, sf_dir):
    return _cosines(spark, sf_dir).select("example_id", "query_id", r6("semantic_similarity", "semantic_similarity"))


@query(f"""WITH {_COSINE} SELECT count(s) AS n, round(min(s), 6) AS min, round(quantile_cont(s, 0.01), 6) AS p1, round(quantile_cont(s, 0.25), 6) AS p25, round(median(s), 6) AS median, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.75), 6) AS p75, round(quantile_cont(s, 0.99), 6) AS p99, round(max(s), 6) AS max, round(stddev_pop(s), 6) AS std FROM cosines""")
def similarity_distribution(spark, sf_dir):
    t = features.similarity_distribution(_cosines(spark, sf_dir))
    return t.select("n", *[r6(c, c) for c in t.columns[1:]])


@query(f"WITH {_COSINE} SELECT e.vec_id AS example_id, e.label AS query_id, round(c.s, 6) + 0.0 AS semantic_similarity FROM embeddings e JOIN cosines c ON c.example_id = e.vec_id")
def semantic_join(spark, sf_dir):
    s = _cosines(spark, sf_dir)
    base = s.select("example_id", "query_id", "product_id")
    return features.join_similarity(base, s).select("example_id", "query_id", r6("semantic_similarity", "semantic_similarity"))


@query(f"""{CAND}, s AS (SELECT unnest(['query', 'product_title']) AS "column", unnest([query, product_title]) AS text FROM cand) SELECT "column", count(*) AS n_texts, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_reused FROM s GROUP BY 1""")
def unique_text_stats(spark, sf_dir):
    return features.text_statistics(candidates(spark, sf_dir), "query", "product_title")


@query(f"""{CAND}, texts AS (SELECT DISTINCT text, {tok("text")} AS tokens FROM (SELECT query AS text FROM cand WHERE split = 'train' UNION ALL SELECT product_title FROM cand WHERE split = 'train')),
vectors AS (SELECT text, [len(list_filter(tokens, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 16 = i)) FOR i IN range(16)] AS v FROM texts),
norms AS (SELECT text, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vectors)
SELECT example_id, query_id, round(greatest(-1, least(1, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / nullif(a.norm * b.norm, 0), 0))), 6) + 0.0 AS semantic_similarity
FROM cand c JOIN norms a ON a.text = c.query JOIN norms b ON b.text = c.product_title WHERE split = 'train'""")
def encoded_similarity(spark, sf_dir):
    """Texts of both sides of a split encoded once each."""
    t = split.hash_split(candidates(spark, sf_dir))
    a, b = features.semantic_features(t.filter("partition = 'train'").drop("partition"), t.filter("partition = 'validation'").drop("partition"), features.HashingEncoder())
    return a.unionByName(b).select("example_id", "query_id", r6("semantic_similarity", "semantic_similarity"))


# --- Features, learning -------------------------------------------------------------------------------------------------------


@query(f"""{CAND}, {_SCORED}, {_FEATURES} SELECT example_id, s.query_id, s.product_id, s.query, s.product_title, s.esci_label, s.relevance_gain, round(s.bm25_score, 6) + 0.0 AS bm25_score, round(s.tfidf_score, 6) AS tfidf_score, {", ".join(f"b.{f}" for f in BASIC_FEATURES)} FROM scored s JOIN basic b USING (example_id)""")
def feature_table(spark, sf_dir):
    t = features.feature_table(candidates(spark, sf_dir), check=False)
    return t.withColumns({c: F.round(c, 6) for c in _COVERAGES} | {c: r6(F.round(c, 9)) for c in ("tfidf_score", "bm25_score")})


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = features.feature_table(split.hash_split(candidates(spark, sf_dir)), check=False, keep=("partition",))
    # Rankers read neither the texts nor the rows of the other side.
    t = written(t.drop("query", "product_title"), "features")
    return t.filter("partition = 'train'"), t.filter("partition = 'validation'")


@query()
def ltr_train_score(spark, sf_dir):
    from candela.operators.ltr import Ranker

    train, validation = _sides(spark, sf_dir)
    return ranking.rank_scored(Ranker().fit(train, validation).transform(validation), "xgb_score").select("example_id", "query_id", "xgb_score", "predicted_rank")


@query()
def gain_importance(spark, sf_dir):
    from candela.operators.ltr import Ranker

    train, _ = _sides(spark, sf_dir)
    return spark.createDataFrame(Ranker().fit(train).importance(), "feature string, gain double, normalized_gain double, rank int")


@query()
def ablation(spark, sf_dir):
    from candela.operators.ltr import ablation

    train, validation = _sides(spark, sf_dir)
    return spark.createDataFrame(ablation(train, validation), "name string, n_features int, ndcg double, recall double, mrr double")


@query()
def rank_random(spark, sf_dir):
    """The published generator's scores, a query at a time."""
    t = lexical.add_random(candidates(spark, sf_dir), exact=True)
    return ranking.sort_and_rank(t, "random_score").select("example_id", "query_id", "random_score", "predicted_rank")


@query()
def bootstrap_ci(spark, sf_dir):
    r = compare.bootstrap_mean(deltas(spark, sf_dir), "diff", method="poisson")
    return spark.createDataFrame([(r["mean"], r["ci_low"], r["ci_high"], r["n"])], "mean double, ci_low double, ci_high double, n long")


# --- Sources, sinks, contracts ------------------------------------------------------------------------------------------------

_EXAMPLE_COLUMNS = "example_id, query, query_id, product_id, product_locale, esci_label, small_version, 1 AS large_version, split"


def _raw(spark, sf_dir) -> str:
    """A folder with the candidates and products as raw files, in the shared folder."""
    folder = fresh_path(spark, "raw")
    candidates(spark, sf_dir).selectExpr(*_EXAMPLE_COLUMNS.split(", ")).write.parquet(f"{folder}/{tables.EXAMPLES}")
    products(spark, sf_dir).withColumns({"product_bullet_point": F.lit("b"), "product_brand": F.col("product_color")}).write.parquet(f"{folder}/{tables.PRODUCTS}")
    tables.require_raw_files(spark, folder)
    return folder


@query(f"{CAND} SELECT {_EXAMPLE_COLUMNS} FROM cand WHERE product_locale = 'us' AND small_version = 1")
def source_examples(spark, sf_dir):
    return joins.filter_examples(tables.load_examples(spark, f"{_raw(spark, sf_dir)}/{tables.EXAMPLES}"))


@query(f"WITH prod AS ({PRODUCTS}) SELECT product_id, product_title, product_description, 'b' AS product_bullet_point, product_color AS product_brand, product_color, product_locale FROM prod WHERE product_locale = 'us'")
def source_products(spark, sf_dir):
    return joins.filter_products(tables.load_products(spark, f"{_raw(spark, sf_dir)}/{tables.PRODUCTS}"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "csv")
    t = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    tables.write_csv(t, path)
    return tables.load_csv(spark, path, t.schema)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 50")
def sink_sample(spark, sf_dir):
    """The sample that is written has the first 50 rows of an order."""
    path = fresh_path(spark, "sample")
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal").withColumn("_o", -F.col("s_acctbal"))
    tables.write_sample(t, path, ["_o", "s_suppkey"])
    return tables.load_csv(spark, path, t.schema).drop("_o")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name, f AS _source_kind FROM region, (VALUES ('csv'), ('json'), ('parquet')) k(f)")
def source_mixed_files(spark, sf_dir):
    """One table written as CSV, JSON and Parquet and read as one."""
    folder = fresh_path(spark, "mixed")
    t = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name").coalesce(1)
    t.write.option("header", True).csv(f"{folder}/a.csv")
    t.write.parquet(f"{folder}/c.parquet")
    tables.write_json(spark, f"{folder}/b.json", [r.asDict() for r in t.collect()])
    out = None
    for kind, path in (("csv", "a.csv"), ("json", "b.json"), ("parquet", "c.parquet")):
        own = tables.load_mixed(spark, [f"{folder}/{path}"]).select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name", F.lit(kind).alias("_source_kind"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"{CAND}, {_SCORED} SELECT example_id, query_id, round(bm25_score, 6) + 0.0 AS bm25_score, round(tfidf_score, 6) AS tfidf_score FROM scored")
def merged_scores(spark, sf_dir):
    """Two rankers' scores of the same candidates, one to one."""
    t = cut(scored(spark, sf_dir).select("example_id", "query_id", "bm25_score", "tfidf_score"))
    t = compare.merge_scores(t.drop("tfidf_score"), t.select("example_id", "tfidf_score"), "tfidf_score")
    return t.select("example_id", "query_id", r6("bm25_score", "bm25_score"), r6("tfidf_score", "tfidf_score"))


_CHECKS = (
    ("unique_examples", "(SELECT count(*) > count(DISTINCT example_id) FROM cand)"),
    ("unique_pairs", "(SELECT count(*) > count(DISTINCT (query_id, product_id)) FROM cand)"),
    ("no_test_rows", "(SELECT count(*) > 0 FROM cand WHERE split = 'test')"),
    ("no_test_rows_in_train", "false"),
    ("pure_split", "(SELECT count(*) > 0 FROM (SELECT query_id FROM cand GROUP BY query_id HAVING count(DISTINCT split) > 1))"),
    ("sides_together", "(SELECT count(*) > 0 FROM (SELECT query_id FROM cand GROUP BY query_id HAVING count(DISTINCT split) > 1))"),
    ("locales_together", "(SELECT count(*) > 0 FROM (SELECT query_id FROM cand GROUP BY query_id HAVING count(DISTINCT product_locale) > 1))"),
    ("same_queries", "(SELECT count(DISTINCT query_id) > count(DISTINCT query_id) FILTER (split = 'train') FROM cand)"),
    ("sizes", "(SELECT count(*) <> 1000 FROM cand)"),
    ("finite_gains", "(SELECT count(*) > 0 FROM cand WHERE relevance_gain IS NULL)"),
    ("finite_logs", "(SELECT count(*) > 0 FROM cand WHERE relevance_gain = 0)"),
    ("kept_in_top_5", "false"),
    ("kept_whole", "(SELECT count(*) > 0 FROM (SELECT query_id FROM cand GROUP BY query_id HAVING count(*) > 5))"),
    ("real_data", "(SELECT count(DISTINCT query_id) < 1000 FROM cand)"),
    ("label_conflicts", "(SELECT count(*) > 0 FROM (SELECT query_id, product_id FROM cand GROUP BY ALL HAVING count(DISTINCT esci_label) > 1))"),
)


@query(f"{CAND} " + " UNION ALL ".join(f"SELECT '{name}' AS contract, {sql} AS raised" for name, sql in _CHECKS))
def contract_outcomes(spark, sf_dir):
    """Which contracts the candidates break."""
    t = cut(candidates(spark, sf_dir))
    train, top = t.filter("split = 'train'"), ranking.sort_and_rank(lexical.add_random(t), "random_score", 5)
    calls = {
        "unique_examples": lambda: contracts.require_unique(t, ["example_id"]),
        "unique_pairs": lambda: contracts.require_unique(t, ["query_id", "product_id"]),
        "no_test_rows": lambda: contracts.require_no_test_rows(t),
        "no_test_rows_in_train": lambda: contracts.require_no_test_rows(train),
        "pure_split": lambda: contracts.require_pure_split(t),
        "sides_together": lambda: contracts.require_together(train, t.filter("split = 'test'")),
        "locales_together": lambda: contracts.require_together(t.filter("product_locale = 'us'"), t.filter("product_locale = 'jp'")),
        "same_queries": lambda: contracts.require_same(t, train),
        "sizes": lambda: contracts.require_sizes(t, 1000, None),
        "finite_gains": lambda: contracts.require_finite(t, ["relevance_gain"]),
        "finite_logs": lambda: contracts.require_finite(t.withColumn("l", F.ln("relevance_gain")), ["l"]),
        "kept_in_top_5": lambda: contracts.require_kept(t, top, 5),
        "kept_whole": lambda: contracts.require_kept(t, top),
        "real_data": lambda: contracts.require_real_data(t),
        "label_conflicts": lambda: contracts.check_duplicate_pairs(t),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, False))
        except errors.ERRORS:
            rows.append((name, True))
    return spark.createDataFrame(rows, "contract string, raised boolean")
