"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize, shared_path  # noqa: F401

HOT_KEYS = 1000
"""A key is hot when it holds at least 1/HOT_KEYS of the rows, so at most HOT_KEYS keys are."""


BATCH_ROWS = "arrow.maxRecordsPerBatch"
"""Python tasks take batches of 1000 rows where the session leaves Spark's 10000: whole texts may be long."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    if spark.conf.get(f"spark.sql.execution.{BATCH_ROWS}") == "10000":
        spark.conf.set(f"spark.sql.execution.{BATCH_ROWS}", "1000")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def text_of(name: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(name: str = "text") -> Column:
    """Identity of a text: its SHA-256 in 32 bytes."""
    return F.unhex(F.sha2(text_of(name).cast("binary"), 256))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def attach_by_key(rows: DataFrame, stats: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``stats`` (one row per key; ``count`` is the key's number of rows).

    A key may hold a third of all rows. Keys with at least ``total / HOT_KEYS``
    rows are at most HOT_KEYS many, whatever the data, so they are broadcast and
    their rows never move; after that no key of the shuffled join holds more than
    that share. ``stats`` is read three times: pass a written table."""
    cut = max(1, math.ceil(total / HOT_KEYS))
    hot = stats.filter(F.col(count) >= cut)
    cold = stats.filter(F.col(count) < cut)
    in_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return in_hot.unionByName(rest.join(cold, key).select(in_hot.columns))


def attach_left(rows: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``stats`` (at most one row per key; no key is null).

    A key may hold a third of all rows, also one that ``stats`` lacks. Keys with at least one of HOT_KEYS equal parts of
    the rows are cut into as many parts as they hold, so no part of a key is more than that share; ``stats`` is repeated
    for each, 2 * HOT_KEYS times at most in all. Only the hot keys and their number of parts go to every task. ``rows``
    is read twice: pass a written table or a narrow scan."""
    sizes = materialize(rows.groupBy(key).agg(F.count("*").alias("__n")), "key-sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    part = max(1, math.ceil(total / HOT_KEYS))
    hot = F.broadcast(sizes.filter(F.col("__n") >= part).select(key, F.ceil(F.col("__n") / part).alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1).cast("bigint"))
    dealt = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts)).drop("__parts")
    spread = stats.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return dealt.join(spread.drop("__parts"), [key, "__part"], "left").drop("__part")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], F.lit(True))
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])
