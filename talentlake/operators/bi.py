"""Dashboard measures and reports (A-01..A-29, C-22, J-06, F-11, F-12).

Everything starts from :func:`dashboard_view` (the postings plus publication
date, month, location aliases and skill flags) and ends in a ``groupBy``:
partial aggregation runs map-side, so a dominant source, city or month is
pre-combined before the exchange. Windows only ever run over aggregated rows
(one per month / contract type), never over postings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.regex import py_strip
from .joins import map_lookup


def _pct(num: Column, den: Column) -> Column:
    """DIVIDE(num, den, 0) * 100."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") * 100 / den)


# A-27
def dashboard_view(postings: DataFrame) -> DataFrame:
    """v_offres_dashboard: postings + date_publication, annee_mois, localisation, ville,
    type_contrat and has_* skill flags."""
    pub = F.coalesce(F.try_to_date(F.col("date_creation").cast("string"), "yyyy-MM-dd"),
                     F.col("date_scraping").cast("date"))
    flags = {name: F.arrays_overlap(F.col("competences"), F.array(*[F.lit(s) for s in skills]))
             for name, skills in V.SKILL_FLAGS.items()}
    return (postings.withColumn("date_publication", pub)
            .withColumns({
                "annee_mois": F.date_format("date_publication", "yyyy-MM"),
                "localisation": F.col("region"),
                "ville": F.col("lieu"),
                "type_contrat": F.col("contrat_type"),
                **flags,
            }))


# A-01
def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_offres"))


# A-02 / A-26 (v_stats_sources)
def count_by(df: DataFrame, key: str, out: str = "n", ordered: bool = True) -> DataFrame:
    """value_counts: null keys dropped, count descending (ties by key) when ``ordered``."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(out))
    return counts.orderBy(F.desc(out), key) if ordered else counts


def stats_sources(df: DataFrame) -> DataFrame:
    return count_by(df, "source", "total_offres")


# A-03
def source_label(source: Column) -> Column:
    """J-03: lower/strip raw name -> display label; unknown names stay as they are."""
    return map_lookup(F.lower(py_strip(source)), V.SOURCE_LABELS, source)


def count_by_label(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Counts per source display label, aliases merged (count first, relabel the few groups)."""
    per_source = count_by(df, "source", ordered=False)
    out = (per_source.withColumn("label", source_label(F.col("source")))
           .groupBy("label").agg(F.sum("n").alias("n")))
    return out.orderBy(F.desc("n"), "label") if ordered else out


# A-04
def last_update(df: DataFrame) -> Column:
    """Aggregate expression: latest date_scraping, else latest date_creation, first 10 chars, else 'N/A'."""
    latest = F.coalesce(F.max(F.col("date_scraping").cast("string")),
                        F.max(F.col("date_creation").cast("string")))
    return F.coalesce(F.substring(latest, 1, 10), F.lit(V.NO_DATE))


# A-29
def stats_report(df: DataFrame, model_name: str) -> DataFrame:
    """One row: total, sources (label -> count, as JSON), last_update, model."""
    # The label table has one row per distinct source (a handful), so gathering
    # it into one map is bounded; it enters the report as a scalar subquery.
    labels = count_by_label(df, ordered=False)
    sources = labels.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("label", "n")))))).scalar()
    return df.agg(F.count("*").alias("total"), sources.alias("sources"), last_update(df).alias("last_update"),
                  F.lit(model_name).alias("model"))


# A-08 .. A-10
def profile_stats(df: DataFrame) -> DataFrame:
    """Counts over the table; each distinct count is an aggregate of its own (together they would
    expand every row once per column)."""
    distinct = lambda c: df.select(c).distinct().agg(F.count(c)).scalar()
    return df.agg(
        F.count("*").alias("n_offres"),
        F.count_if(F.col("competences_extraites") != "").alias("n_avec_competences"),
        F.count("salaire_annuel_estime").alias("n_avec_salaire"),
    ).select("n_offres", distinct("titre_normalise").alias("n_titres_normalises"), "n_avec_competences", "n_avec_salaire",
             distinct("region").alias("n_regions"), distinct("source").alias("n_sources"))


def contract_histogram(df: DataFrame) -> DataFrame:
    return count_by(df, "contrat_type")


def contract_histogram_map(df: DataFrame) -> DataFrame:
    """A-10 as one map {contract type: count}. Contract types come from the rule
    table (six labels and the default), so the map has a fixed size bound."""
    counts = count_by(df, "contrat_type", ordered=False)
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("contrat_type", "n"))))
                      .alias("contrats"))


# A-13 (v_top_competences)
def skill_frequency(df: DataFrame) -> DataFrame:
    return (df.select(F.explode("competences").alias("competence"))
            .groupBy("competence").agg(F.count("*").alias("nb_offres"))
            .orderBy(F.desc("nb_offres"), "competence"))


# A-14 / A-15
def skill_shares(view: DataFrame) -> DataFrame:
    """% of postings per dashboard skill bar, sorted descending."""
    aggs = [F.count("*").alias("_n")] + [F.count_if(F.col(flag)).alias(flag) for flag in V.SKILL_SHARE_BARS]
    wide = view.agg(*aggs)
    stack = ", ".join(f"'{label}', `{flag}`" for flag, label in V.SKILL_SHARE_BARS.items())
    long = wide.selectExpr("_n", f"stack({len(V.SKILL_SHARE_BARS)}, {stack}) AS (skill, hits)")
    return (long.select("skill", _pct(F.col("hits"), F.col("_n")).alias("pct"))
            .orderBy(F.desc("pct"), "skill"))


def skill_share(view: DataFrame, flag: str) -> DataFrame:
    """A-14 single measure, e.g. % Python."""
    return view.agg(_pct(F.count_if(F.col(flag)), F.count("*")).alias("pct"))


# A-16
def source_skill_matrix(view: DataFrame) -> DataFrame:
    """% of each source's postings having each skill bar."""
    aggs = [_pct(F.count_if(F.col(flag)), F.count("*")).alias(label)
            for flag, label in V.SKILL_SHARE_BARS.items()]
    return view.where(F.col("source").isNotNull()).groupBy("source").agg(*aggs)


# A-17
def python_gauge(view: DataFrame, target: float = V.PYTHON_SHARE_TARGET) -> DataFrame:
    pct = _pct(F.count_if(F.col("has_python")), F.count("*"))
    return (view.agg(pct.alias("pct_python"))
            .withColumn("target", F.lit(float(target)))
            .withColumn("delta", F.col("pct_python") - F.col("target"))
            .withColumn("met", F.col("pct_python") >= F.col("target")))


# A-18
def monthly_trend(view: DataFrame) -> DataFrame:
    return count_by(view, "annee_mois").orderBy("annee_mois")


# A-19
def location_counts(view: DataFrame) -> DataFrame:
    return (view.groupBy("localisation", "ville").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "localisation", "ville"))


# A-20
def contract_split(view: DataFrame) -> DataFrame:
    """Count and share of each contract type (share over the few aggregated rows)."""
    counts = view.where(F.col("type_contrat").isNotNull()).groupBy("type_contrat").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n") * 100.0 / total).orderBy(F.desc("n"), "type_contrat")


# A-21
def top_cities(view: DataFrame, k: int = V.TOP_CITIES) -> DataFrame:
    """Top-k cities by postings with the % of CDI (a top-k report: the limit is the feature)."""
    return (view.where(F.col("ville").isNotNull()).groupBy("ville")
            .agg(F.count("*").alias("n"),
                 _pct(F.count_if(F.col("type_contrat") == "CDI"), F.count("*")).alias("pct_cdi"))
            .orderBy(F.desc("n"), "ville").limit(k))


# A-22
def contracts_by_source(view: DataFrame, types: Sequence[str] = ("CDI", "CDD")) -> DataFrame:
    return (view.where(F.col("source").isNotNull()).groupBy("source")
            .pivot("type_contrat", list(types)).agg(F.count(F.lit(1)))
            .na.fill(0, list(types)))


# A-23
def source_summary(df: DataFrame) -> DataFrame:
    """'source : n' lines joined by newline, largest first (one row)."""
    per = count_by(df, "source", "total_offres", ordered=False).select(F.concat_ws(" : ", "source", F.col("total_offres").cast("string")).alias("line"),
                                   "total_offres", "source")
    return per.agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY total_offres DESC, source)")
                   .alias("resume_sources"))


# A-24
def month_to_date(view: DataFrame, date_col: str = "date_publication") -> DataFrame:
    """Postings from the first of the latest month through the latest date."""
    d = F.col(date_col)
    latest = view.agg(F.max(d)).scalar()
    return view.where(d.between(F.trunc(latest, "MM"), latest)).agg(F.count("*").alias("offres_ce_mois"))


# A-25
def month_spine(view: DataFrame, date_col: str = "date_publication",
                start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per month between the bounds (default: the data's own first and last month)."""
    d = F.col(date_col)
    lo = F.lit(start).cast("date") if start else F.min(d)
    hi = F.lit(end).cast("date") if end else F.max(d)
    bounds = view.agg(F.trunc(lo, "MM").alias("_lo"), F.trunc(hi, "MM").alias("_hi"))
    return bounds.select(F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("mois"))


def month_over_month(view: DataFrame, date_col: str = "date_publication", **bounds) -> DataFrame:
    """(cur - prev) / prev * 100 per month; null when prev is 0; an empty month counts 0."""
    counts = view.groupBy(F.trunc(date_col, "MM").alias("mois")).agg(F.count("*").alias("n"))
    spine = month_spine(view, date_col, **bounds)
    series = spine.join(counts, "mois", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prev = F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("mois"))
    return (series.withColumn("prev", prev)
            .withColumn("croissance_mom",
                        F.when((F.col("prev") == 0) | F.col("prev").isNull(), F.lit(None).cast("double"))
                         .otherwise((F.col("n") - F.col("prev")) * 100.0 / F.col("prev")))
            .orderBy("mois"))


# C-22
def weeknum(d: Column) -> Column:
    """Sunday-based week number, week 1 holding January 1st."""
    return F.ceil((F.dayofyear(d) + F.dayofweek(F.trunc(d, "YEAR")) - 1) / 7).cast("int")


def calendar(view: DataFrame, date_col: str = "date_publication",
             start: str | None = None, end: str | None = None) -> DataFrame:
    """Day spine with year, month, 'MMMM yyyy', 'T'+quarter, week number.

    Bounds default to the data's own first and last date."""
    d = F.col(date_col)
    lo = F.lit(start).cast("date") if start else F.min(d)
    hi = F.lit(end).cast("date") if end else F.max(d)
    days = view.agg(lo.alias("_lo"), hi.alias("_hi")).select(
        F.explode(F.sequence("_lo", "_hi")).alias("date"))
    return days.select(
        "date",
        F.year("date").alias("annee"),
        F.month("date").alias("mois"),
        F.date_format("date", "MMMM yyyy").alias("nom_mois"),
        F.concat(F.lit("T"), F.quarter("date").cast("string")).alias("trimestre"),
        weeknum(F.col("date")).alias("semaine"),
    )


# J-06
def with_calendar(view: DataFrame, cal: DataFrame) -> DataFrame:
    """Postings -> calendar on the publication date; postings outside the calendar are kept."""
    return view.join(cal, view["date_publication"] == cal["date"], "left")


# F-11
def apply_slicers(view: DataFrame, sources: Sequence[str] | None = None,
                  contracts: Sequence[str] | None = None, location: str | None = None,
                  date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Dashboard slicers, AND-ed; ``None`` leaves a slicer open."""
    cond = F.lit(True)
    if sources is not None:
        cond = cond & F.col("source").isin(list(sources))
    if contracts is not None:
        cond = cond & F.col("type_contrat").isin(list(contracts))
    if location:
        cond = cond & F.lower(F.col("localisation")).contains(location.lower())
    if date_from is not None:
        cond = cond & (F.col("date_publication") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        cond = cond & (F.col("date_publication") <= F.lit(date_to).cast("date"))
    return view.where(cond)


# F-12
def detail_table(view: DataFrame) -> DataFrame:
    return view.select("titre", "entreprise", "ville", F.col("contrat_type").alias("contrat"), "source",
                       F.col("date_publication").alias("date"))
