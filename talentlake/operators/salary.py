"""Salary cleaning (merge stage) and imputation (transform stage).

Imputation (C-08) = per-row estimate (C-07), then for rows still without one
the exact median of their (secteur, contrat_type) group (A-05), else the
global median (A-06) (J-04). The group medians come from
:func:`talentlake.operators.aggregate.exact_median` (bounded state per group,
however skewed); the result table has one row per group and is written, so that
the planner knows its size and broadcasts it only below its threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_double
from ..functions.salary import bound_max, bound_min, row_mean, salary_estimate
from .aggregate import group_and_overall_medians
from .joins import attach_small


def clean_salaries(df: DataFrame) -> DataFrame:
    """Merge stage: numeric coercion (C-10), bounds (F-04), estimate = row mean (A-07)."""
    out = df.withColumns({"salaire_min": bound_min(to_double("salaire_min")),
                          "salaire_max": bound_max(to_double("salaire_max"))})
    return out.withColumn("salaire_annuel_estime", row_mean("salaire_min", "salaire_max"))


def estimate_salaries(df: DataFrame) -> DataFrame:
    """C-07 on every row (keeps a valid estimate, else mean of the valid bounds)."""
    cur = F.col("salaire_annuel_estime") if "salaire_annuel_estime" in df.columns else F.lit(None).cast("double")
    return df.withColumn("salaire_annuel_estime",
                         salary_estimate(cur.cast("double"), to_double("salaire_min"), to_double("salaire_max")))


def impute_salaries(df: DataFrame, keys: Sequence[str] = ("secteur", "contrat_type"),
                    value: str = "salaire_annuel_estime", **median_kw) -> DataFrame:
    """C-08: estimate, then fill the gaps with the group median, else the global median."""
    keys = list(keys)
    # The medians need keys and values only: the plan is pruned to them, and the
    # fill runs on the rows as they come, without a copy of the whole table.
    est = estimate_salaries(df)
    medians, overall = group_and_overall_medians(est, keys, value, alias="_group_median", **median_kw)
    filled = attach_small(est, medians, keys, how="left")
    fill = F.coalesce(F.col(value), F.col("_group_median"), F.lit(overall).cast("double"))
    return filled.withColumn(value, fill).drop("_group_median").select(*est.columns)
