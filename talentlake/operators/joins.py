"""Join helpers: which side is broadcast is decided by measured bytes.

``attach_small`` joins a large table to a table that was written before, so the
planner knows its size in bytes: under ``spark.sql.autoBroadcastJoinThreshold`` it
is broadcast and the large side is never shuffled; beyond it the join is shuffled
and AQE splits hot keys.

``spread_join`` does not wait for a partition to grow large: keys that hold much of
the left side, null among them, are found by one aggregate and dealt out over parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HOT_SHARE = 1000               # a left key is hot from this part of the rows on, so at most so many keys are


def attach_small(big: DataFrame, small: DataFrame, on: Sequence[str] | Column, how: str = "inner") -> DataFrame:
    """Join with a written table, without hints."""
    return big.join(small, on if isinstance(on, Column) else list(on), how)


# J-01
def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Left (or inner) join of ``left_key`` with ``right_key``, where null equals null and a key may fan out.

    A left key may hold a third of all rows. One aggregate counts the rows of each; a key with n of at least 1/HOT_SHARE of
    them is cut into parts of that share, its left rows are dealt over them, and its right rows repeated for each: never
    more than the join's own output, as every part has left rows. So no task gets more than a share of one key. Only the
    hot keys (HOT_SHARE at most) go to every task. ``left`` is read twice; no column may be named ``__hot``, ``__parts``,
    ``__part`` or ``__share``, and no right column like a left one."""
    if how not in ("left", "inner"):
        raise ValueError(f"a {how} join cannot repeat its right side")
    sizes = materialize(left.groupBy(F.col(left_key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")), "key-sizes")
    part = F.lit(max(1, -(-(sizes.agg(F.sum("__n")).first()[0] or 0) // HOT_SHARE)))
    hot = F.broadcast(sizes.where((F.col("__n") >= part) & (F.col("__n") > 1)).select("__hot", F.ceil(F.col("__n") / part).alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1).cast("bigint"))
    dealt = left.join(hot, F.col(left_key).eqNullSafe(F.col("__hot")), "left") \
        .withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts)).drop("__hot", "__parts")
    spread = right.join(hot, F.col(right_key).eqNullSafe(F.col("__hot")), "left") \
        .withColumn("__share", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("__hot", "__parts")
    on = F.col(left_key).eqNullSafe(F.col(right_key)) & (F.col("__part") == F.col("__share"))
    return dealt.join(spread, on, how).drop("__part", "__share")


def map_lookup(key: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """J-02 / J-03: dictionary lookup with a default.

    The dictionary is a fixed literal, so it is inlined as a map literal inside
    the generated code: no join and no exchange at all."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    value = m[key]
    return value if default is None else F.coalesce(value, default)


def classify_by_distinct(df: DataFrame, key: str, outputs: dict) -> DataFrame:
    """Add ``outputs`` (name -> function of the key column), computing each distinct key once.

    Titles and places repeat heavily: the distinct keys are written, classified and
    joined back, whatever their number."""
    keys = df.select(key).distinct()                                  # one pass over the input
    table = materialize(keys.select(F.col(key).alias("_ck"), *[fn(F.col(key)).alias(name) for name, fn in outputs.items()]),
                        "classified")
    base = df.drop(*[o for o in outputs if o in df.columns and o != key])
    return base.join(table, base[key].eqNullSafe(table["_ck"]), "left").drop("_ck")
