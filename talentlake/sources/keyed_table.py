"""The keyed postings table: typed create-if-absent + insert-ignore (S-14, S-15, J-05).

``INSERT ... ON CONFLICT (hash_id) DO NOTHING`` becomes: keep the first row
per key inside the batch, drop keys already in the table (left anti join),
append. The table is plain Parquet; the append is one Spark job whose output
is committed at job end, so a failed run leaves the table as it was.

Scale: the table only contributes its key column (column pruning), and is probed
with the written batch keys (``table LEFT SEMI JOIN batch keys``): if they are small
in bytes they are broadcast and the table is never shuffled, else the join is
(AQE handles skew).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .. import schema as SC
from ..functions.coerce import null_token
from ..operators.dedup import keep_first
from ..session import materialize, path_exists


# S-14
def to_keyed(df: DataFrame, schema: StructType = SC.KEYED, extra: StructType | None = SC.ENRICHED_EXTRA) -> DataFrame:
    """Project to the typed table schema: null tokens cleared, values try-cast, absent columns null."""
    fields = list(schema.fields) + (list(extra.fields) if extra is not None else [])
    cols = []
    for f in fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        src = df.schema[f.name].dataType
        c = F.col(f.name)
        if isinstance(src, StringType):
            c = null_token(c)
        if src != f.dataType:
            c = c.cast("string").try_cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def table_exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path)


def new_rows(batch: DataFrame, existing_keys: DataFrame | None, keys: list[str]) -> DataFrame:
    """Batch rows whose key is absent from the table (J-05). ``batch`` is a written table."""
    if existing_keys is None:
        return batch
    hits = materialize(existing_keys.join(batch.select(*keys), keys, "left_semi"), "known-keys")
    return batch.join(hits, keys, "left_anti")


# S-15
def insert_ignore(batch: DataFrame, path: str, key: str | Sequence[str] = "hash_id",
                  order_by: Sequence[str | Column] | None = None, typed: bool = True) -> dict:
    """Append the batch's new keys to the table at ``path``.

    Returns ``attempted`` (batch rows), ``inserted`` and ``total`` (table rows after)."""
    spark = batch.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    order_by = list(order_by) if order_by else (["ingest_seq"] if "ingest_seq" in batch.columns else keys)
    seen = Observation("attempted")
    observed = batch.observe(seen, F.count(F.lit(1)).alias("n"))
    not_null = F.lit(True)
    for k in keys:
        not_null = not_null & F.col(k).isNotNull()
    firsts = keep_first(observed.where(not_null), keys, order_by)
    rows = to_keyed(firsts) if typed else firsts
    staged = materialize(rows, "insert-batch")          # one pass over the input
    existing = spark.read.parquet(path).select(*keys) if table_exists(spark, path) else None
    fresh = new_rows(staged, existing, keys)
    added = Observation("inserted")
    fresh.observe(added, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    total = spark.read.parquet(path).count()
    return {"attempted": seen.get["n"], "inserted": added.get["n"], "total": total}

