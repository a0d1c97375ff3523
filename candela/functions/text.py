"""Text normalisation, tokens and phrases, as columns."""

from __future__ import annotations

import textwrap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a token is letters or digits, with single . - / inside.
TOKEN = r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*"
TITLE_FIELDS = ("product_title",)
COMBINED_FIELDS = ("product_title", "product_brand", "product_bullet_point")
#: What stands for nothing.
NOTHING = ("nan",)
NOTHING_SEMANTIC = ("nan", "none", "<na>", "<nat>")


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without Unicode white space at both ends (trim() takes spaces only)."""
    return F.regexp_replace(_column(x), r"(?U)^\s+|\s+$", "")


def normalize_text(x: Column | str) -> Column:
    """Null, blank and "nan" become empty; white space is one space; lower case."""
    bare = F.lower(F.regexp_replace(strip(F.coalesce(_column(x).cast("string"), F.lit(""))), r"(?U)\s+", " "))
    return F.when(bare.isin(*NOTHING), F.lit("")).otherwise(bare)


def tokenize(x: Column | str) -> Column:
    """Tokens of normalize_text(x): as its white space is in no token, the text needs lower case alone, unless it stands for nothing."""
    low = F.lower(F.coalesce(_column(x).cast("string"), F.lit("")))
    nothing = low.rlike(rf"(?U)^\s*(?:{'|'.join(NOTHING)})\s*$")
    return F.when(nothing, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)))


def clean_text(x: Column | str) -> Column:
    """For encoders: stripped, placeholders empty; case and inner white space stay."""
    bare = strip(F.coalesce(_column(x).cast("string"), F.lit("")))
    return F.when(F.lower(bare).isin(*NOTHING_SEMANTIC), F.lit("")).otherwise(bare)


def join_fields(*fields: str) -> Column:
    """Non-empty normalised fields with a space between them, normalised again as a whole."""
    return normalize_text(F.concat_ws(" ", *[F.nullif(normalize_text(f), F.lit("")) for f in fields]))


def add_product_text(df: DataFrame) -> DataFrame:
    """product_text (title) and product_text_combined (title, brand, bullets); absent columns are passed over."""
    have = lambda fields: [f for f in fields if f in df.columns]
    return df.withColumns({"product_text": join_fields(*have(TITLE_FIELDS)), "product_text_combined": join_fields(*have(COMBINED_FIELDS))})


def empty_titles(df: DataFrame) -> int:
    return df.filter(F.col("product_text") == "").count()


def contains_phrase(needle: Column, haystack: Column) -> Column:
    """Whether the tokens of needle stand in haystack side by side. Tokens have no spaces, so padded strings tell exactly."""
    padded = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(padded(haystack), padded(needle))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def token_overlap(query: Column, title: Column) -> Column:
    """Share of the query's different tokens that the title has."""
    return ratio(F.size(F.array_intersect(query, title)), F.size(F.array_distinct(query)))


def has_digit(x: Column | str) -> Column:
    return F.coalesce(_column(x).rlike(r"\p{Nd}"), F.lit(False))


def shorten_title(title: str, width: int = 40, max_lines: int = 2) -> str:
    """For display: white space squeezed, wrapped, cut with an ellipsis."""
    return "\n".join(textwrap.wrap(" ".join(title.split()), width, max_lines=max_lines, placeholder=" …"))
