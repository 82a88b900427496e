"""The daily job end to end, and its reports (A-11, A-12, A-28).

landed CSVs --load/conform/union--> merge stage --write--> transform stage --write--> insert-ignore

Each stage output is written once (Parquet under the run folder), so the
next stage and the reports read files instead of recomputing the plan, and a
lost executor only replays the stage it was in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..operators.dedup import dedup_by_hash, dedup_by_title_link
from ..operators.quality import clean_merged, is_it_title
from ..session import materialize
from ..sources.keyed_table import insert_ignore
from ..sources.landing import conform, load_sources
from .stages import landing_order, merge_stage, transform_stage


# A-12
def merge_report(landed: DataFrame, seq_col: str = "ingest_seq") -> DataFrame:
    """Rows before/after deduplication, removed, before/after the IT filter, and per source.

    The deduplicated rows (the two shuffles) are written once; every count is a
    small aggregate over that file or over the landed scan."""
    order = landing_order(seq_col)
    # the counts rest on the dedup keys, the order and the title
    conformed = conform(landed, keep=(seq_col,)).select("hash_id", "titre", "lien", "source", seq_col)
    deduped = materialize(dedup_by_title_link(dedup_by_hash(conformed, order), order), "merge-deduped")
    flagged = clean_merged(deduped).withColumn("_it", is_it_title("titre"))
    per_source = flagged.groupBy("source").agg(F.count(F.lit(1)).alias("_all"), F.count_if("_it").alias("_kept"))
    before = conformed.agg(F.count(F.lit(1))).scalar()
    totals = per_source.agg(F.sum("_all").alias("a"), F.sum("_kept").alias("k")).select(
        F.explode(F.array(
            F.struct(F.lit("dedup_before").alias("metric"), before.alias("n")),
            F.struct(F.lit("dedup_after").alias("metric"), F.coalesce("a", F.lit(0)).alias("n")),
            F.struct(F.lit("dedup_removed").alias("metric"), (before - F.coalesce("a", F.lit(0))).alias("n")),
            F.struct(F.lit("filter_before").alias("metric"), F.coalesce("a", F.lit(0)).alias("n")),
            F.struct(F.lit("filter_after").alias("metric"), F.coalesce("k", F.lit(0)).alias("n")))).alias("m"))
    by_source = (per_source.where(F.col("source").isNotNull() & (F.col("_kept") > 0))
                 .select(F.concat(F.lit("source:"), "source").alias("metric"), F.col("_kept").alias("n")))
    return totals.select("m.metric", F.col("m.n").cast("long").alias("n")).unionByName(by_source)


# A-28
def connector_counts(landed: DataFrame) -> DataFrame:
    """Rows in and unique keys per connector."""
    return landed.groupBy("source").agg(F.count(F.lit(1)).alias("n_in"),
                                        F.countDistinct("hash_id").alias("n_unique"))


# A-11
def run_report(landed: DataFrame, merged: DataFrame, written: DataFrame | None = None,
               skipped: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """(stage, source, n): raw rows of each registered source (0 when absent), raw total,
    rows after the merge, rows written; for each source with skipped files their number."""
    sources = landed.sparkSession.createDataFrame([(s,) for s in V.SOURCE_ORDER], "source string")
    raw = landed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    per_source = (sources.join(raw, "source", "left")
                  .select(F.lit("raw").alias("stage"), "source", F.coalesce("n", F.lit(0)).alias("n")))
    total = raw.agg(F.sum("n").alias("n")).select(F.lit("raw_total").alias("stage"),
                                                  F.lit(None).cast("string").alias("source"),
                                                  F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    after = merged.agg(F.count(F.lit(1)).alias("n")).select(F.lit("merged").alias("stage"),
                                                           F.lit(None).cast("string").alias("source"), "n")
    out = per_source.unionByName(total).unionByName(after)
    if written is not None:
        out = out.unionByName(written.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("written").alias("stage"), F.lit(None).cast("string").alias("source"), "n"))
    if skipped:
        counts = Counter(source for source, _, _ in skipped)
        out = out.unionByName(landed.sparkSession.createDataFrame([("skipped", s, n) for s, n in counts.items()],
                                                                  "stage string, source string, n bigint"))
    return out


def run_connectors(spark: SparkSession, raw_paths: Mapping[str, str], out_dir: str, run_date: str,
                   linkedin: tuple[str, str | None] | None = None, json_lines: Collection[str] = ()) -> dict[str, str]:
    """Stage 1 of the daily run: every connector flattens its landed payloads and
    writes its per-source CSV (the files the merge stage loads). Returns the paths.

    Sources named in ``json_lines`` landed one response per line; for the others a
    file is one response, and a file with more than that is an error. Files are
    written in landing order (a range sort), which the loader reads back: the
    merge's keep-first prefers what was crawled first."""
    from ..sources.connectors import CONNECTORS, check_one_per_file, flatten_linkedin, read_payloads
    from ..sources.csv_ranges import read_csv_ranges
    from ..sources.landing import write_csv
    from .. import schema as S

    out = {}
    for name, path in raw_paths.items():
        schema, flatten = CONNECTORS[name]
        if name not in json_lines:
            check_one_per_file(spark, path)
        df = flatten(read_payloads(spark, path, schema, one_per_file=name not in json_lines), run_date)
        target = f"{out_dir}/{name}"
        write_csv(df.orderBy("ingest_seq").drop("ingest_seq"), target)
        out[name] = target
    if linkedin is not None:
        posts_path, skills_path = linkedin
        # the dump is one large file of multi-line cells each
        posts = read_csv_ranges(spark, posts_path, S.LINKEDIN_POSTINGS, position="ingest_seq")
        skills = read_csv_ranges(spark, skills_path, S.LINKEDIN_SKILLS, position="skills_seq") if skills_path else None
        target = f"{out_dir}/kaggle_linkedin"
        flat = flatten_linkedin(posts, skills, run_date, skills_order_col="skills_seq" if skills_path else None)
        write_csv(flat.orderBy("ingest_seq").drop("ingest_seq"), target)
        out["kaggle_linkedin"] = target
    return out


def run_daily(spark: SparkSession, landed_paths: Mapping[str, str], run_dir: str, table_path: str,
              run_date: str | None = None) -> dict:
    """One daily run: load every landed source, merge, transform, insert-ignore; returns the run report
    and the ledger of skipped files, (source, file, error)."""
    run_date = run_date or date.today().isoformat()
    skipped: list[tuple[str, str, str]] = []
    landed = load_sources(spark, landed_paths, run_date, skipped)
    landed.write.mode("overwrite").parquet(f"{run_dir}/landed")
    landed = spark.read.parquet(f"{run_dir}/landed")
    merge_stage(landed).write.mode("overwrite").parquet(f"{run_dir}/merged")
    merged = spark.read.parquet(f"{run_dir}/merged")
    transform_stage(merged, run_date=run_date) \
        .write.mode("overwrite").parquet(f"{run_dir}/transformed")
    transformed = spark.read.parquet(f"{run_dir}/transformed")
    written = insert_ignore(transformed, table_path)
    report = {(r.stage, r.source): r.n for r in run_report(landed, merged, transformed, skipped).collect()}
    return {"report": report, "sink": written, "skipped": skipped}
