"""Keep-first deduplication (D-01..D-03).

``row_number() = 1`` over ``partition by key order by <landing order>``.
Spark plans this as a WindowGroupLimit *before* the shuffle (map-side top-1
per key), so a key holding a third of all rows is cut to one row per input
partition before it is exchanged; ``dropDuplicates`` would keep an arbitrary
row instead of the first. Null keys group together (null = null), like the
original pandas ``drop_duplicates``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per ``keys``: the first in ``order_by`` order."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_kf_rank", F.row_number().over(w)).where("_kf_rank = 1").drop("_kf_rank")


def source_rank(source: Column | str, registry: Sequence[str]) -> Column:
    """Position of a source in the registry (unknown sources last)."""
    src = F.col(source) if isinstance(source, str) else source
    rank = F.array_position(F.array(*[F.lit(s) for s in registry]), src)
    return F.when(rank > 0, rank).otherwise(F.lit(len(registry) + 1)).cast("int")


# D-01
def dedup_by_hash(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    return keep_first(df, ["hash_id"], order_by)


# D-02
def dedup_by_title_link(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    return keep_first(df, ["titre", "lien"], order_by)


# D-03
def dedup_by_title_company(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    return keep_first(df, ["titre", "entreprise"], order_by)
