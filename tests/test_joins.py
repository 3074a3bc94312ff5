import pytest
from pyspark.sql import functions as F

from labwave.operators.joins import FANOUT, hot_keys, split_hot_keys_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(spark, how):
    big = spark.range(0, 3000).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50 + 2).alias("k"))
    small = spark.createDataFrame([(k, f"v{k}") for k in range(1, 45)], "k long, v string")
    want = sorted(map(tuple, big.join(small, "k", how).collect()))
    got = sorted(map(tuple, split_hot_keys_join(big, small, ["k"], how, "rid", rows_per_task=100).collect()))
    assert got == want


def test_hot_key_fanout(spark):
    big = spark.range(0, 3000).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50 + 2).alias("k"))
    hot = {r["k"]: r[FANOUT] for r in hot_keys(big, ["k"], 100).collect()}
    assert hot == {1: 10}  # 1000 rows over a 100-row budget -> 10 tasks
    out = split_hot_keys_join(big, spark.createDataFrame([(1, "x")], "k long, v string"), ["k"], "inner",
                              "rid", rows_per_task=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = out.rdd.glom().map(lambda rows: len(rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(parts) == 1000 and max(parts) < 1000  # the hot key is spread over tasks
