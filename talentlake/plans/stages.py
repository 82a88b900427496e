"""The daily pipeline's stages as DataFrame plans (the salary medians run while the transform is planned).

merge:     salaries -> keep-first by hash -> keep-first by (titre, lien) -> nulls -> IT filter
transform: title, skills, region, country, contract -> salary imputation -> final cleaning

Order matters and is kept: deduplication runs before null cleaning, the IT
filter runs last, and the salary medians use the *detected* contract type.
Shuffles: the two keep-first windows (map-side top-1 first) and the median
aggregation; everything else is row-local.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T
from ..operators.dedup import dedup_by_hash, dedup_by_title_link, source_rank
from ..operators.quality import clean_merged, finalize_transformed, it_filter
from ..operators.salary import clean_salaries, impute_salaries
from ..operators.joins import classify_by_distinct
from ..sources.landing import conform


def landing_order(seq_col: str = "ingest_seq") -> list[Column]:
    """Registry order of the source, then landing order inside it."""
    return [source_rank("source", V.SOURCE_ORDER), F.col(seq_col)]


def merge_stage(landed: DataFrame, seq_col: str = "ingest_seq") -> DataFrame:
    order = landing_order(seq_col)
    df = clean_salaries(conform(landed, keep=(seq_col,)))
    df = dedup_by_title_link(dedup_by_hash(df, order), order)
    df = clean_merged(df)
    return it_filter(df)


def enrich(df: DataFrame, distinct_first: bool = False) -> DataFrame:
    """C-02..C-06: the five enrichment columns (region is overwritten in place).

    With ``distinct_first`` the title and place rules run once per distinct
    value (see ``classify_by_distinct``); descriptions are mostly unique, so
    skills and contract types are always computed per row."""
    skills = T.extract_skills("description")
    per_row = {
        "competences": skills,
        "competences_extraites": T.skills_text(skills),
        "contrat_type": T.detect_contract("titre", "description", "tags"),
    }
    if not distinct_first:
        return df.withColumns({
            "titre_normalise": T.normalise_title("titre"),
            "region": T.standardise_region("lieu"),
            "pays": T.standardise_country("lieu"),
            **per_row,
        })
    out = classify_by_distinct(df, "titre", {"titre_normalise": T.normalise_title})
    out = classify_by_distinct(out, "lieu", {"region": T.standardise_region, "pays": T.standardise_country})
    return out.withColumns(per_row)


def transform_stage(merged: DataFrame, run_date: str | None = None, distinct_first: bool = False,
                    **median_kw) -> DataFrame:
    """Enrich, impute, clean. ``merged`` should be a written table: the median pass
    (keys and salaries) and the fill both read it."""
    run_date = run_date or date.today().isoformat()
    df = impute_salaries(enrich(merged, distinct_first=distinct_first), **median_kw)
    return finalize_transformed(df, run_date)
