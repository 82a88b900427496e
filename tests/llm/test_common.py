from collections import Counter

from pyspark.sql import functions as F

from talentlake.llm import common


def test_left_join_with_hot_keys(spark, monkeypatch):
    """Keys with a third of the rows, known and unknown to the other side: all rows stay, and no part of a key is large."""
    keys = ["hot"] * 1000 + ["gone"] * 1000 + [f"k{i}" for i in range(1000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id int, key string").repartition(5)
    stats = spark.createDataFrame([("hot", 1), ("k7", 2), ("other", 3)], "key string, v int")
    for parts in (1000, 10, 1):
        monkeypatch.setattr(common, "HOT_KEYS", parts)
        got = common.attach_left(rows, stats, "key")
        assert got.columns == ["key", "id", "v"]
        assert sorted((r.id, r.key, r.v) for r in got.collect()) == [(i, k, {"hot": 1, "k7": 2}.get(k)) for i, k in enumerate(keys)]
    assert common.attach_left(rows.limit(0), stats, "key").count() == 0
    assert Counter(r.v for r in common.attach_left(rows, stats.limit(0), "key").collect()) == {None: 3000}


def test_parts_of_a_hot_key_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("key"))
    plan = common.attach_left(rows, rows.select("key").distinct(), "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in plan and "Generate" in plan
