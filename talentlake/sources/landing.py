"""Landed source files -> one conformed DataFrame (S-01, S-02, S-09..S-13, S-16).

Each source is one path (a file or a folder of files). Loading is tolerant
(missing or empty sources and unreadable files are skipped and named in a ledger;
no source at all is an error),
freshness-gated on the file modification date (static dumps exempt), tagged
with its source name, hash-backfilled, conformed to the canonical columns and
unioned by name. Landing order is kept in ``ingest_seq`` so keep-first
deduplication can prefer earlier rows.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import fixed as V
from ..functions.coerce import posting_hash
from ..operators.quality import clean_null_tokens
from ..schema import LANDED
from ..session import materialize, path_exists

log = logging.getLogger(__name__)

# What a file that is no readable CSV fails with; a timeout or a missing right is none of these. A broken connection
# or a dying worker can raise the same classes, but not when the file is read again.
UNREADABLE = ("EOFException", "ZipException", "TextParsingException", "MalformedInputException", "CharConversionException")


def _file_errors(e: Exception) -> set[str]:
    return {name for name in UNREADABLE if name in str(e)}


def _first_line(e: Exception) -> str:
    return str(e).splitlines()[0][:200]


def _read_files(files: list[str], read: Callable[[list[str]], DataFrame], skipped: list[tuple[str, str]]) -> list[DataFrame]:
    """``read`` over ``files`` together or, where a file fails, over halves of them, down to the file that does.

    A file is left out, and named in ``skipped`` with its error, when reading it alone fails twice in the same way;
    any other failure is raised. So b broken files of n cost some b log n reads, and none where all are sound."""
    if not files:
        return []
    try:
        return [read(files)]
    except (AnalysisException, PySparkException, Py4JJavaError) as e:
        if not _file_errors(e):
            raise
        error = e
    if len(files) > 1:
        half = len(files) // 2
        return _read_files(files[:half], read, skipped) + _read_files(files[half:], read, skipped)
    try:
        return [read(files)]
    except (AnalysisException, PySparkException, Py4JJavaError) as again:
        if _file_errors(again) != _file_errors(error):
            raise
    skipped.append((files[0], _first_line(error)))
    return []


# S-01
def read_csv(spark: SparkSession, path: str | list[str], schema=None) -> DataFrame:
    """Header CSV with quoted multi-line cells and doubled quotes; text columns unless a schema is given.

    Cells that stand for a missing value are null from here on, so that hashes,
    joins and deduplication see nulls and not their spellings."""
    r = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
         .option("encoding", "UTF-8"))
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    return clean_null_tokens(df, tokens=V.CSV_NULL_TOKENS)


# S-02
def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV, cells written verbatim (Spark would otherwise trim their edges)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# S-13
def conform(df: DataFrame, keep: tuple[str, ...] = ("ingest_seq",)) -> DataFrame:
    """Canonical 23 columns in order (missing ones null), typed as landed; ``keep`` columns ride along."""
    cols = []
    for f in LANDED.fields:
        if f.name in df.columns:
            same = df.schema[f.name].dataType == f.dataType
            c = F.col(f.name) if same else F.col(f.name).cast("string").try_cast(f.dataType)
            if isinstance(f.dataType, DoubleType):
                c = F.when(~F.isnan(c), c)
            cols.append(c.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    cols += [F.col(c) for c in keep if c in df.columns]
    return df.select(*cols)


# S-11
def tag_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source", F.lit(name))


# S-12
def backfill_hash(df: DataFrame) -> DataFrame:
    """Compute ``hash_id`` when the source has none (missing fields hash as 'nan')."""
    if "hash_id" in df.columns:
        return df
    parts = [F.col(c) if c in df.columns else F.lit("") for c in ("titre", "entreprise", "lien")]
    return df.withColumn("hash_id", posting_hash(*parts, missing="nan"))


# S-09
def fresh_only(df: DataFrame, run_date: str) -> DataFrame:
    """Rows of files modified on or after the run date (file-level metadata filter)."""
    mtime = F.to_date(F.col("_metadata.file_modification_time"))
    return df.where(mtime >= F.lit(run_date).cast("date"))


# S-10 (one source)
def load_source(spark: SparkSession, name: str, path: str, run_date: str, static: bool | None = None,
                skipped: list[tuple[str, str, str]] | None = None) -> DataFrame | None:
    """The rows of a landed source, written once; None if it is missing, empty or stale. An unreadable file loses only
    itself: it is logged, and (source, file, error) is appended to ``skipped``, as is a missing source."""
    static = name in V.STATIC_SOURCES if static is None else static
    ledger: list[tuple[str, str]] = []

    def read(files: list[str]) -> DataFrame:
        df = read_csv(spark, files)
        if not static:
            df = fresh_only(df, run_date)
        # Landing order: file name first (crawlers name files in crawl order), then the
        # row's position, numbered by input split (splits follow file offsets).
        return materialize(df.withColumn("ingest_seq", F.struct(F.col("_metadata.file_path").alias("file"),
                                                                F.monotonically_increasing_id().alias("pos"))), f"source-{name}")

    if path_exists(spark, path):
        # text has a schema of its own, so listing opens no file
        parts = _read_files(sorted(map(unquote, spark.read.text(path).inputFiles())), read, ledger)
    else:
        parts = ledger.append((path, "missing")) or []
    for file, error in ledger:
        log.warning("source %s: %s skipped: %s", name, file, error)
    if skipped is not None:
        skipped.extend((name, file, error) for file, error in ledger)
    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else None
    if df is None or df.isEmpty():
        log.warning("source %s skipped: missing, empty or stale", name)
        return None
    return backfill_hash(tag_source(df, name))


# S-10 + U-01
def load_sources(spark: SparkSession, paths: Mapping[str, str], run_date: str,
                 skipped: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Union of every loadable source, conformed, in registry order; ``skipped`` as in :func:`load_source`."""
    frames = []
    for name, path in paths.items():
        df = load_source(spark, name, path, run_date, skipped=skipped)
        if df is not None:
            frames.append(conform(df))
    if not frames:
        raise RuntimeError("no valid source for this run")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# U-01 (already-loaded frames)
def union_sources(frames: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        c = conform(backfill_hash(tag_source(df, name)))
        out = c if out is None else out.unionByName(c, allowMissingColumns=True)
    if out is None:
        raise RuntimeError("no valid source for this run")
    return out


# S-16
def preferred_input(spark: SparkSession, transformed_path: str, merged_path: str) -> str:
    """The transformed output when it exists, else the merged one."""
    return transformed_path if path_exists(spark, transformed_path) else merged_path
