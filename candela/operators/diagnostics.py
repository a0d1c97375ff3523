"""Segments, agreement of scores, and selection of queries to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candela.constants import LEAST_SEGMENT, OVERLAP_CUTS, SPEARMAN_CUTS
from candela.errors import DataIntegrityError, SemanticDiagnosticError
from candela.functions.text import has_digit, token_overlap, tokenize
from candela.operators.contracts import require_same
from candela.operators.ranking import is_relevant, nan_last


def length_segment(query: str = "query") -> Column:
    """S1. The labels, with an en dash."""
    n = F.size(tokenize(query))
    return F.when(n <= 1, "1 token").when(n <= 3, "2–3 tokens").otherwise("4+ tokens")


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def overlap_segment(overlap: Column) -> Column:
    """S2."""
    return F.when(_missing(overlap), "no relevant candidates").when(overlap < OVERLAP_CUTS[0], "low overlap").when(overlap < OVERLAP_CUTS[1], "medium overlap").otherwise("high overlap")


def disagreement_segment(rho: Column) -> Column:
    """S3."""
    return F.when(_missing(rho), "undefined").when(rho < SPEARMAN_CUTS[0], "high disagreement").when(rho < SPEARMAN_CUTS[1], "mixed").otherwise("high agreement")


def identifier_segment(query: str = "query") -> Column:
    """Whether a token has a digit."""
    return F.when(F.exists(tokenize(query), lambda t: t.rlike("[0-9]")), "identifier-style").otherwise("other")


def relevant_overlap(candidates: DataFrame) -> DataFrame:
    """query_id, relevant_overlap: mean coverage of relevant candidates; queries without any are absent."""
    return candidates.filter(is_relevant()).groupBy("query_id").agg(F.avg("query_token_coverage").alias("relevant_overlap"))


def spearman_by_query(candidates: DataFrame, a: str, b: str, name: str = "spearman") -> DataFrame:
    """Rank correlation with average ranks for ties; null if a side has fewer than two values.

    An average rank is rank() and half of the ties beyond the first; all four windows and the sums share one shuffle by query.
    """

    def average_rank(x: str) -> Column:
        return F.rank().over(Window.partitionBy("query_id").orderBy(x)) + (F.count("*").over(Window.partitionBy("query_id", x)) - 1) / 2.0

    t = candidates.select("query_id", F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).filter("_a IS NOT NULL AND _b IS NOT NULL AND NOT isnan(_a) AND NOT isnan(_b)")
    t = t.withColumns({"_ra": average_rank("_a"), "_rb": average_rank("_b")})
    rho = F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb"))
    several = (F.min("_a") < F.max("_a")) & (F.min("_b") < F.max("_b"))
    return t.groupBy("query_id").agg(F.when(several, rho).alias(name))


def annotate_queries(per_query: DataFrame, candidates: DataFrame, a: str = "semantic_similarity", b: str = "tfidf_score", check: bool = True, digits: tuple[int, int] | None = None) -> DataFrame:
    """Per-query deltas with four segments. digits: those that overlaps and correlations are rounded to before they are segmented."""
    if check:
        require_same(per_query, candidates, error=SemanticDiagnosticError)
    overlap, rho = relevant_overlap(candidates), spearman_by_query(candidates, a, b)
    if digits:
        overlap, rho = overlap.withColumn("relevant_overlap", F.round("relevant_overlap", digits[0])), rho.withColumn("spearman", F.round("spearman", digits[1]))
    t = per_query.join(overlap, "query_id", "left").join(rho, "query_id", "left")
    return t.withColumns({"length_segment": length_segment(), "overlap_segment": overlap_segment(F.col("relevant_overlap")), "disagreement_segment": disagreement_segment(F.col("spearman")), "identifier_segment": identifier_segment()})


def summarize_segments(annotated: DataFrame, segment: str, values: dict[str, str], least: int = LEAST_SEGMENT) -> DataFrame:
    """Segment, n_queries and means ({name: column}); segments with fewer than `least` queries go, the null one stays."""
    return annotated.groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(n) for n, c in values.items()]).filter(F.col("n_queries") >= least)


def delta_by_length(per_query: DataFrame, delta: str) -> DataFrame:
    """Segment, n (of deltas that aren't null), mean_delta; null deltas count for nothing."""
    return per_query.groupBy(length_segment().alias("segment")).agg(F.count(delta).alias("n"), F.avg(delta).alias("mean_delta"))


def length_bins(query: str = "query") -> Column:
    """Bins (0, 1], (1, 3] and over 3 of token counts; a query without tokens has none."""
    n = F.size(tokenize(query))
    return F.when(n == 0, F.lit(None).cast("string")).when(n <= 1, "1").when(n <= 3, "2-3").otherwise("4+")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Bin (from 1), low, high, n of equal-width bins between the least and largest value; empty bins are absent.

    The last bin holds its upper end; equal values are all in bin 1.
    """
    span = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if span["a"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    a, width = float(span["a"]), (float(span["b"]) - float(span["a"])) / bins
    place = F.lit(1) if not width else F.least(F.floor((F.col(column) - a) / width).cast("int") + 1, F.lit(bins))
    t = df.filter(F.col(column).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return t.select("bin", (F.lit(a) + (F.col("bin") - 1) * width).alias("low"), (F.lit(a) + F.col("bin") * width).alias("high"), "n")


def query_profile(df: DataFrame) -> DataFrame:
    """query_id, n_candidates, relevant_share, exact_share."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy("query_id").agg(F.count("*").alias("n_candidates"), share(is_relevant()).alias("relevant_share"), share(F.col("esci_label") == "E").alias("exact_share"))


def label_sets(df: DataFrame) -> DataFrame:
    """query_id, labels (their number), has_relevant."""
    return df.groupBy("query_id").agg(F.countDistinct("esci_label").alias("labels"), F.max(is_relevant()).alias("has_relevant"))


def diagnostic_queries(annotated: DataFrame, delta: str, reference: str, n: int = 3) -> DataFrame:
    """TK4: wins (largest delta over 0), losses (smallest under 0) and ties (within 1e-8, best reference first), n of each, with kind and place."""
    picks = []
    for kind, keep, order in (("improvement", F.col(delta) > 0, F.col(delta).desc()), ("regression", F.col(delta) < 0, F.col(delta).asc()), ("tie", F.abs(F.col(delta)) <= 1e-8, F.col(reference).desc())):
        rows = annotated.filter(keep).orderBy(order, "query_id").limit(n)
        picks.append(rows.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(order, "query_id")).alias("place"), "*"))
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


def inspection_queries(candidates: DataFrame, metrics: DataFrame, ranked: DataFrame, ndcg: str = "ndcg", other: str = "other_ndcg") -> list[tuple[str, object]]:
    """TK5: six queries by six rules in turn, each once: [(rule, query_id)].

    A rule whose first query is taken gives none; what lacks is filled by query_id. metrics:
    query_id, query, and NDCG of two models; ranked: the first model's ranks. Every step is a bounded top-k.
    """
    require_same(candidates, metrics, error=DataIntegrityError)
    top = ranked.filter("predicted_rank = 1").groupBy("query_id").agg(F.min_by("esci_label", "example_id").alias("top_label"), F.min_by(token_overlap(tokenize("query"), tokenize("product_title")), "example_id").alias("top_overlap"))
    t = metrics.join(label_sets(candidates), "query_id", "left").join(top, "query_id", "left").withColumns({"_digit": has_digit("query"), "_tokens": F.size(tokenize("query")), "_diff": F.col(other) - F.col(ndcg)})
    mixed, relevant = F.col("labels") >= 2, F.col("has_relevant")
    rules = [
        ("strong", mixed, F.col(ndcg).desc()),
        ("weak", relevant, F.col(ndcg).asc()),
        ("brand_or_model", F.col("_digit"), F.col(ndcg).desc()),
        ("broad", F.col("_tokens") <= 2, F.col("n_candidates").desc() if "n_candidates" in metrics.columns else F.col(ndcg).desc()),
        ("misleading", (F.col("top_label") == "I") & (F.col("top_overlap") >= 0.5), F.col("top_overlap").desc()),
        ("disagree", F.lit(True), F.abs(F.col("_diff")).desc()),
    ]
    chosen: list[tuple[str, object]] = []
    used: set = set()
    for rule, keep, order in rules:
        first = t.filter(keep).orderBy(order, "query_id").select("query_id").limit(1).collect()
        if first and first[0][0] not in used:
            used.add(first[0][0])
            chosen.append((rule, first[0][0]))
    for r in t.orderBy("query_id").select("query_id").limit(len(rules) + len(used)).collect():
        if len(chosen) < len(rules) and r[0] not in used:
            used.add(r[0])
            chosen.append(("fill", r[0]))
    return chosen


def extract_examples(candidates: DataFrame, per_query: DataFrame, ids: DataFrame, delta: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """The chosen queries' candidates with the query's delta, in order of query and rank; ids that are missing raise."""
    missing = ids.select("query_id").distinct().join(candidates.select("query_id").distinct(), "query_id", "left_anti")
    if not missing.isEmpty():
        raise SemanticDiagnosticError("queries without candidates")
    own = candidates.join(ids.select("query_id").distinct(), "query_id", "left_semi").join(per_query.select("query_id", delta), "query_id", "left")
    base = [c for c in ("query_id", "query", "example_id", "product_id", "product_title", "esci_label", "relevance_gain") if c in own.columns]
    order = ["query_id", *[c for c in ("predicted_rank",) if c in own.columns], "example_id"]
    return own.select(*base, delta, *[c for c in optional if c in own.columns]).orderBy(*[c for c in order if c in (*base, *optional)])


def ranks_of(candidates: DataFrame, score: str) -> Column:
    """The rank by a score within its query, NaN last, ties by product_id and example_id as strings."""
    return F.row_number().over(Window.partitionBy("query_id").orderBy(nan_last(F.col(score)).desc_nulls_last(), F.col("product_id").cast("string"), F.col("example_id").cast("string")))
