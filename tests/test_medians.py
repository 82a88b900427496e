"""Exact medians: brackets that miss, values that many rows share, infinite and missing values."""

import random
import statistics

from pyspark.sql import functions as F

from talentlake.operators import aggregate as A


def expected(rows):
    groups = {}
    for k, v in rows:
        if v is not None and v == v:
            groups.setdefault(k, []).append(v)
    whole = statistics.median(v for vs in groups.values() for v in vs) if groups else None
    return {k: statistics.median(vs) for k, vs in groups.items() if k is not None}, whole


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, v double")
    groups, whole = A.group_and_overall_medians(df, ["k"], "v", alias="m", **kw)
    want = expected(rows)
    assert {r.k: r.m for r in groups.collect()} == want[0] and whole == want[1]
    assert {r.k: r.m for r in A.exact_median(df, ["k"], "v", alias="m", **kw).collect()} == want[0]


def skewed(n):
    rng = random.Random(2)
    rows = [("hot", rng.choice([1.0, 2.0, rng.gauss(5, 100)])) for _ in range(n)]
    rows += [("two", 1.0)] * 50 + [("two", 2.0)] * 50 + [("one", -0.5), (None, 7.0), (None, 8.0), ("none", None), ("nan", float("nan"))]
    return rows + [("wide", s * 10.0 ** e) for e in range(-300, 300, 7) for s in (1, -1)] + [("ends", float("inf")), ("ends", float("-inf")), ("ends", 3.0)]


def test_shared_values_and_small_states(spark):
    for kw in ({}, {"bins": 64, "small": 5}):
        check(spark, skewed(3000), **kw)


def test_brackets_that_miss_are_counted_again(spark, monkeypatch):
    brackets = A._brackets
    monkeypatch.setattr(A, "_brackets", lambda *a: brackets(*a).withColumn("_lo", F.col("_hi")).where("_g IS NOT NULL"))
    check(spark, skewed(500), small=20)
    monkeypatch.setattr(A, "_brackets", lambda *a: brackets(*a).withColumn("_hi", F.col("_lo")))
    check(spark, skewed(500))


def test_empty(spark):
    check(spark, [])
    check(spark, [(None, None)])
