"""Exact grouped median with bounded per-group state (A-05, A-06).

``F.median`` is exact but keeps every distinct value of a group in one
aggregation buffer, so a group holding a third of a 100 TB table would land
in one task. Here a sketch brackets the median and one exact pass finds it:

1. one partial aggregation keeps, per group, ``n`` and a KLL quantile sketch of
   some ``bins`` values. Sketches merge, so that of all values together comes from
   the groups' and the values are not read for it again. Each sketch gives two
   values between which both middle ranks lie, with twice the sketch's rank error
   to spare on either side;
2. one exact pass counts the values below the bracket, and each distinct value
   inside it (partial aggregations again: a hot group is pre-combined map-side). The
   counts show whether both ranks lie inside; a group where they do not (the sketch
   is right with high probability only) is counted again without a bracket;
3. while a group has more than ``small`` distinct values inside, a sketch of the
   distinct values cuts them into ``SLOTS`` ranges of about equal size, whose exact
   counts say which of them holds the ranks. So values that many rows share
   never hinder progress. At most ``small`` values per group are sorted at the end.

Every step's per-group state is bounded by ``bins`` or ``small`` values, no matter
how large the group, and the path is the same at every size. The median of
an even count is ``0.5*a + 0.5*b``.
Null keys and null/NaN values are ignored, like pandas' ``groupby().median()``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import attach_small

DEFAULT_BINS = 4096
DEFAULT_SMALL = 200_000
SLOTS = 64
LEAST_BINS = 64


def _known(keys: Sequence[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def _rank_error(bins: int) -> float:
    """Rank error of a KLL sketch of size ``bins``, as a share of n, kept with a probability of 99 %."""
    return 2.296 / bins ** 0.9723


def _values(df: DataFrame, keys: Sequence[str], value: str, whole: bool) -> DataFrame:
    """(_g, _v): each value once under its group; rows with a null key only where the whole is asked for, under null."""
    group = F.when(_known(keys), F.struct(F.lit(0).alias("_whole"), *[F.col(k) for k in keys]))
    rows = df.select(group.alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    return rows if whole else rows.where("_g IS NOT NULL")


def _whole_group(vals: DataFrame) -> Column:
    """The group of all values, of the same type as the other groups."""
    keys = vals.schema["_g"].dataType.fields[1:]
    return F.struct(F.lit(1).alias("_whole"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in keys])


def _middle() -> tuple[Column, Column]:
    """The two middle ranks of a group, from 0."""
    return F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)


def _holds(rank: Column, count: str) -> Column:
    """Whether a row with ``count`` rows, the last of which is the ``_upto``-th, holds ``rank``."""
    return (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col(count))


def _brackets(vals: DataFrame, bins: int, whole: bool) -> DataFrame:
    """(_g, _n, _lo, _hi), written: the bracket of each group's two middle values, and of the whole's."""
    size = F.lit(bins)
    sketches = materialize(vals.groupBy("_g").agg(
        F.count("*").alias("_n"), F.kll_sketch_agg_double("_v", size).alias("_sketch")), "median-sketches")
    rows = sketches.where("_g IS NOT NULL")
    if whole:
        merged = sketches.agg(F.sum("_n").alias("_n"), F.kll_merge_agg_double("_sketch", size).alias("_sketch"))
        rows = rows.unionByName(merged.where("_n > 0").select(_whole_group(vals).alias("_g"), "_n", "_sketch"))
    spare = 2 * _rank_error(bins)                   # less than a half, as a sketch has LEAST_BINS values at least
    at = lambda share: F.kll_sketch_get_quantile_double("_sketch", F.lit(share))
    return materialize(rows.select("_g", "_n", at(0.5 - spare).alias("_lo"), at(0.5 + spare).alias("_hi")), "median-brackets")


def _counted(vals: DataFrame, brackets: DataFrame, whole: bool) -> DataFrame:
    """(_g, _n, _v, _c), written: the number of rows of each distinct value inside its group's bracket, and of all below it
    (``_v`` null). Brackets without ends hold every value."""
    groups = F.array_compact(F.array("_g", _whole_group(vals))) if whole else F.array("_g")
    rows = attach_small(vals.select(F.explode(groups).alias("_g"), "_v"), brackets, ["_g"])
    inside = F.coalesce(F.col("_v") >= F.col("_lo"), F.lit(True))
    rows = rows.where(F.coalesce(F.col("_v") <= F.col("_hi"), F.lit(True)))
    return materialize(rows.groupBy("_g", "_n", F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c")),
                       "median-counts")


def _ranges(counts: DataFrame) -> DataFrame:
    """Per group of ``counts``: _n, _below, _inside (rows) and _values (distinct ones inside)."""
    below = F.col("_v").isNull()
    return counts.groupBy("_g", "_n").agg(
        F.coalesce(F.sum(F.when(below, F.col("_c"))), F.lit(0)).alias("_below"),
        F.coalesce(F.sum(F.when(~below, F.col("_c"))), F.lit(0)).alias("_inside"),
        F.count("_v").alias("_values"))


def _narrowed(counts: DataFrame, bins: int) -> DataFrame:
    """``counts`` cut down to the slots of distinct values that hold the middle ranks; all before them is below."""
    inside = counts.where("_v IS NOT NULL")
    cuts = F.array(*[F.lit(i / SLOTS) for i in range(1, SLOTS)])
    cuts = materialize(inside.groupBy("_g").agg(F.kll_sketch_agg_double("_v", F.lit(bins)).alias("_sketch")).select(
        "_g", F.kll_sketch_get_quantile_double("_sketch", cuts).alias("_cuts")), "median-cuts")
    slot = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    placed = attach_small(counts, cuts, ["_g"]).withColumn("_slot", slot)
    before = F.sum("_sum").over(Window.partitionBy("_g").orderBy("_slot"))
    sums = placed.groupBy("_g", "_n", "_slot").agg(F.sum("_c").alias("_sum")).withColumn("_upto", before)
    first, last = _middle()
    held = materialize(sums.where(_holds(first, "_sum") | _holds(last, "_sum")).groupBy("_g").agg(
        F.min("_slot").alias("_from"), F.max("_slot").alias("_to")), "median-slots")
    kept = attach_small(placed, held, ["_g"]).where(F.col("_slot") <= F.col("_to"))
    value = F.when(F.col("_slot") >= F.col("_from"), F.col("_v"))
    return kept.groupBy("_g", "_n", value.alias("_v")).agg(F.sum("_c").alias("_c"))


def _medians(vals: DataFrame, alias: str, bins: int, small: int, whole: bool) -> DataFrame:
    """(_g, alias) for every group of the written table ``vals``, and for the whole if asked for."""
    bins = max(bins, LEAST_BINS)
    brackets = _brackets(vals, bins, whole)
    counts = _counted(vals, brackets, whole)
    first, last = _middle()
    missed = (first < F.col("_below")) | (last >= F.col("_below") + F.col("_inside"))
    state = _ranges(counts).withColumn("_missed", missed)        # every group is there: a bracket's ends are values
    any_missed, most = state.agg(F.max("_missed"), F.max("_values")).first()
    if any_missed:
        again = materialize(state.where("_missed").select("_g", "_n"), "median-missed")
        ends = {end: F.lit(None).cast("double") for end in ("_lo", "_hi")}
        more = _counted(vals, again.withColumns(ends), whole)
        counts = materialize(attach_small(counts, again.select("_g"), ["_g"], "left_anti").unionByName(more), "median-counts")
        most = _ranges(counts).agg(F.max("_values")).first()[0]
    while most is not None and most > small:
        wide = materialize(_ranges(counts).where(F.col("_values") > small).select("_g"), "median-wide")
        narrowed = _narrowed(attach_small(counts, wide, ["_g"], "left_semi"), bins)
        counts = materialize(attach_small(counts, wide, ["_g"], "left_anti").unionByName(narrowed), "median-counts")
        most = _ranges(counts).agg(F.max("_values")).first()[0]
    upto = F.sum("_c").over(Window.partitionBy("_g").orderBy(F.col("_v").asc_nulls_first()))
    rows = counts.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when(_holds(rank, "_c"), F.col("_v")))
    return rows.groupBy("_g").agg((F.lit(0.5) * at(first) + F.lit(0.5) * at(last)).alias(alias))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, alias: str = "median",
                 bins: int = DEFAULT_BINS, small: int = DEFAULT_SMALL) -> DataFrame:
    """DataFrame(keys..., alias): the exact (interpolated) median of ``value`` per group."""
    vals = materialize(_values(df, keys, value, whole=False), "median-values")
    return _medians(vals, alias, bins, small, whole=False).select(*[F.col("_g")[k].alias(k) for k in keys], alias)


def group_and_overall_medians(df: DataFrame, keys: Sequence[str], value: str, alias: str = "median",
                              bins: int = DEFAULT_BINS, small: int = DEFAULT_SMALL) -> tuple[DataFrame, float | None]:
    """Per-group medians (written once) and the median of all values, from one selection.

    Only keys and values are written, once each; the whole's bracket comes from the groups' merged sketches."""
    vals = materialize(_values(df, keys, value, whole=True), "median-values")
    both = materialize(_medians(vals, alias, bins, small, whole=True), "medians")
    row = both.where(F.col("_g._whole") == 1).select(alias).first()
    groups = both.where(F.col("_g._whole") == 0).select(*[F.col("_g")[k].alias(k) for k in keys], alias)
    return groups, (None if row is None else row[0])


def global_median(df: DataFrame, value: str, **kw) -> float | None:
    """Exact median of a whole column, as one scalar."""
    row = exact_median(df.withColumn("_all", F.lit(1)), ["_all"], value, alias="m", **kw).first()
    return None if row is None else row["m"]
