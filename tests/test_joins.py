"""The join that deals hot keys out: same rows as the plain one, no task with a whole hot key."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from talentlake.operators.joins import spread_join

LEFT, RIGHT = "id long, key string, value int", "link string, seq int"


def frames(spark):
    left = [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 and i % 2 else "" if i % 50 == 7 else f"k{i}", None) for i in range(3000)]
    right = [(None, 1), (None, 2), ("hot", 3), ("hot", 4), ("hot", 4), ("", 5), ("absent", 6)] + [(f"k{i}", i) for i in range(0, 3000, 7)]
    return spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_equals_the_plain_join(spark, how):
    left, right = frames(spark)
    plain = left.join(right, F.col("key").eqNullSafe(F.col("link")), how)
    got = spread_join(left, right, "key", "link", how)
    assert got.columns == plain.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))
    with pytest.raises(ValueError):
        spread_join(left, right, "key", "link", "full")


def test_empty_sides(spark):
    left, right = frames(spark)
    assert spread_join(left.limit(0), right, "key", "link").count() == 0
    assert spread_join(left, right.limit(0), "key", "link").where("link IS NULL AND seq IS NULL").count() == 3000
    assert spread_join(left, right.limit(0), "key", "link", "inner").count() == 0


def test_no_task_holds_a_hot_key(spark):
    left, right = frames(spark)
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        share = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()) / df.count()
        assert share(left.join(right, F.col("key").eqNullSafe(F.col("link")), "left")) > 0.3
        assert share(spread_join(left, right, "key", "link")) < 0.12
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
