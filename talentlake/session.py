"""Session helpers.

On a cluster the session is created by the platform; these helpers only fill
in settings that are unset (tests and local runs) and never override what the
cluster chose.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "talentlake") -> SparkSession:
    """A session for local runs and tests (``local[N]``)."""
    master = master or os.environ.get("TALENTLAKE_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    b = b.config("spark.driver.memory", os.environ.get("TALENTLAKE_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent (local runs, tests) is a scratch folder
    chosen; a cluster's own setting is always read and kept.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(intermediate tables and streaming progress are written there)")
        d = tempfile.mkdtemp(prefix="talentlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for this application's intermediate tables (under the shared
    checkpoint folder, in Spark's per-application subfolder)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def durable_path(spark: SparkSession, name: str) -> str:
    """A path for state that must outlive the application (streaming progress),
    directly under the configured ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}"


def write_shared(df, name: str) -> str:
    """Write ``df`` as Parquet to a fresh folder under the shared checkpoint folder."""
    import uuid

    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the
    upstream plan) and gives later passes a columnar, prunable input. The schema is
    known, so no job reads it back from the files."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def path_snapshot(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and modification times of a file or of a folder's files: differs when the data changed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on whatever filesystem the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def set_file_times(spark: SparkSession, path: str, millis: int) -> None:
    """Set the modification time of a folder's files."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(p):
        fs.setTimes(s.getPath(), millis, -1)
