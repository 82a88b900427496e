"""Small scalar helpers: null tokens, coercions, hashes, list and date helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# F-01
def null_token(col: Column | str, tokens: Sequence[str] = tuple(V.NULL_TOKENS)) -> Column:
    """An exact cell equal to a null token ('nan', 'N/A', '') becomes null."""
    col = _c(col)
    return F.when(col.isin(list(tokens)), F.lit(None)).otherwise(col)


# C-01
def posting_hash(titre: Column | str, entreprise: Column | str, lien: Column | str,
                 missing: str = "nan") -> Column:
    """First 16 hex digits of SHA-1 over 'titre|entreprise|lien' (UTF-8).

    ``missing`` is the text a null field contributes (connectors differ)."""
    parts = [F.coalesce(_c(x), F.lit(missing)) for x in (titre, entreprise, lien)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


# C-10
def to_double(col: Column | str) -> Column:
    """Non-numeric text and NaN -> null (never an error under ANSI mode); numbers pass through."""
    number = _c(col).try_cast("double")
    return F.when(~F.isnan(number), number)


# C-15
def to_bool(col: Column | str, true_tokens: Sequence[str] = tuple(V.TRUE_TOKENS_MERGE)) -> Column:
    """lower(text) in the token set -> true; everything else, null included -> false."""
    return F.coalesce(F.lower(_c(col).cast("string")).isin(list(true_tokens)), F.lit(False))


# C-16
def to_date_or(col: Column | str, run_date: str) -> Column:
    """Text of a date, or of a timestamp (its date) -> date; unparsable or null -> the run date."""
    parsed = _c(col).cast("string").try_cast("timestamp_ntz").cast("date")
    return F.coalesce(parsed, F.lit(run_date).cast("date"))


# C-17
def date_prefix(col: Column | str) -> Column:
    return F.substring(F.coalesce(_c(col), F.lit("")), 1, 10)


# C-18
def list_join(col: Column | str) -> Column:
    return F.array_join(_c(col), ", ")


# C-19
def first_or_default(arr: Column | str, field: str, default: str = "N/A") -> Column:
    """``arr[0].field`` or the default when the array is empty, null, or the field is missing."""
    return F.coalesce(F.get(_c(arr), 0).getField(field), F.lit(default))


# C-21
def embedding_text(*cols: Column | str) -> Column:
    """Fields joined by single spaces; a null field contributes '' (its separator stays)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(" "))
        parts.append(F.coalesce(_c(c), F.lit("")))
    return F.concat(*parts)
