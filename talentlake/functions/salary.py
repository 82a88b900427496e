"""Salary scalars: label parsing, bounds, row mean, per-row estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .regex import java


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# C-09
def parse_salary_label(label: Column | str) -> Column:
    """Salary text -> struct(salaire_min, salaire_max).

    Spaces are dropped, every number (',' or '.' decimal) is read, all are
    multiplied by 12 when the label says 'mensuel'; one number gives (x, x),
    several give (min, max), none gives nulls."""
    lab = F.coalesce(_c(label), F.lit(""))
    tokens = F.regexp_extract_all(F.replace(lab, F.lit(" "), F.lit("")),
                                  F.lit(java(r"([\d]+(?:[,.][\d]+)?)")), 1)
    nums = F.transform(tokens, lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    nums = F.when(F.lower(lab).contains("mensuel"), F.transform(nums, lambda x: x * 12)).otherwise(nums)
    return F.struct(F.array_min(nums).alias("salaire_min"), F.array_max(nums).alias("salaire_max"))


# F-04 (merge stage bounds; inclusive; min above the ceiling is kept)
def bound_min(col: Column | str) -> Column:
    c = _c(col)
    return F.when(c < V.SALARY_FLOOR, F.lit(None)).otherwise(c)


def bound_max(col: Column | str) -> Column:
    c = _c(col)
    return F.when((c < V.SALARY_FLOOR) | (c > V.SALARY_CEILING), F.lit(None)).otherwise(c)


# A-07
def row_mean(a: Column | str, b: Column | str) -> Column:
    """Mean of the non-null values of two columns; null when both are null."""
    a, b = _c(a), _c(b)
    return F.coalesce((a + b) / 2, a, b)


# C-07
def in_open_range(c: Column) -> Column:
    """Strictly between the floor and the ceiling (null and NaN are not)."""
    return (c > V.SALARY_FLOOR) & (c < V.SALARY_CEILING)


def salary_estimate(current: Column | str, smin: Column | str, smax: Column | str) -> Column:
    """Keep a valid current estimate, else the mean of the valid bounds, else null."""
    cur, lo, hi = _c(current), _c(smin), _c(smax)
    vlo = F.when(in_open_range(lo), lo)
    vhi = F.when(in_open_range(hi), hi)
    return F.when(in_open_range(cur), cur).otherwise(row_mean(vlo, vhi))
