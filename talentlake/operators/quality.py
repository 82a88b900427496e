"""Cleaning and filters of the merge and transform stages (F-01..F-07, C-15, C-16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed as V
from ..functions.coerce import null_token, to_bool, to_date_or
from ..functions.regex import any_contains, is_blank, java


def clean_null_tokens(df: DataFrame, cols: Sequence[str] | None = None,
                      tokens: Sequence[str] = tuple(V.NULL_TOKENS)) -> DataFrame:
    """F-01: cells equal to a null token ('nan', 'N/A', '') -> null, in every string column."""
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    targets = [c for c in (cols or df.columns) if c in string_cols]
    return df.withColumns({c: null_token(c, tokens) for c in targets}) if targets else df


def fill_defaults(df: DataFrame) -> DataFrame:
    """F-02 + C-15 (merge variant) + description cut: the merge stage's null handling."""
    out = {
        "entreprise": F.coalesce("entreprise", F.lit(V.DEFAULT_COMPANY)),
        "secteur": F.coalesce("secteur", F.lit(V.DEFAULT_SECTOR)),
        "remote": to_bool(F.coalesce(F.col("remote").cast("string"), F.lit("false")),
                          V.TRUE_TOKENS_MERGE),
        "description": F.when(F.col("description").isNull() | (F.col("description") == ""), F.lit(None))
                        .otherwise(F.substring("description", 1, V.DESCRIPTION_MAX)),
    }
    return df.withColumns({k: v for k, v in out.items() if k in df.columns})


def clean_merged(df: DataFrame) -> DataFrame:
    """Null tokens then defaults (the merge stage's cleaning step)."""
    return fill_defaults(clean_null_tokens(df))


def truncate_fields(df: DataFrame) -> DataFrame:
    """F-03 (transform stage): titre 500, lieu 300 ('' for null), tags 500 ('' for null)."""
    return df.withColumns({
        "titre": F.substring("titre", 1, V.TITLE_MAX),
        "lieu": F.substring(F.coalesce("lieu", F.lit("")), 1, V.PLACE_MAX),
        "tags": F.substring(F.coalesce("tags", F.lit("")), 1, V.TAGS_MAX),
    })


def is_it_title(col: str = "titre"):
    """F-05 predicate: the title matches the IT pattern, whatever its case; null -> false.

    The title is lowered once and matched without case folding: the pattern is
    in lower case, and folding costs at every position of every title."""
    return F.coalesce(F.lower(col).rlike(java(V.IT_TITLE_PATTERN)), F.lit(False))


def it_filter(df: DataFrame, col: str = "titre") -> DataFrame:
    """F-05: keep titles matching the IT pattern; null titles drop."""
    return df.where(is_it_title(col))


def is_it_keyword(col: str = "job_title", keywords: Sequence[str] = tuple(V.IT_KEYWORDS)):
    """F-06 predicate: lowercase title contains any keyword; blank/null -> false."""
    c = F.col(col)
    return F.coalesce(any_contains(F.lower(c), list(keywords)), F.lit(False)) & ~is_blank(c)


def keyword_filter(df: DataFrame, col: str = "job_title",
                   keywords: Sequence[str] = tuple(V.IT_KEYWORDS)) -> DataFrame:
    return df.where(is_it_keyword(col, keywords))


def blank_title_filter(df: DataFrame, col: str = "titre") -> DataFrame:
    """F-07: drop null or whitespace-only titles."""
    return df.where(~is_blank(F.col(col)))


def finalize_transformed(df: DataFrame, run_date: str) -> DataFrame:
    """Transform-stage cleaning: F-07, F-03, C-16 on date_scraping, C-15 (transform variant)."""
    out = truncate_fields(blank_title_filter(df))
    return out.withColumns({
        "date_scraping": to_date_or("date_scraping", run_date),
        "remote": to_bool("remote", V.TRUE_TOKENS_TRANSFORM),
    })
