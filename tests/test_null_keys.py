"""Null keys and null times are ordinary rows: nothing is lost, results equal plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labwave.operators import attribute as A
from labwave.operators import clean as C
from labwave.operators import sampling as SM
from labwave.operators.joins import split_hot_keys_join
from labwave.operators.sequence import ordered_lag, ordered_row_number, streaks
from labwave import names as N

from .conftest import hours


def table(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 2, None]), rnd.choice(["a", None]), i * 3000, rnd.choice([hours(rnd.random() * 90), None]),
             rnd.choice([True, False, None]), float(i)) for i in range(300)]
    return spark.createDataFrame(rows, "p long, c string, id long, t timestamp_ntz, flag boolean, v double")


@pytest.mark.parametrize("seed", [1, 2])
def test_scans_equal_plain_windows(spark, seed):
    df = table(spark, seed)
    w = Window.partitionBy("p", "c").orderBy(F.col("t").asc_nulls_last(), "id")
    want = df.withColumn("prev", F.lag("v").over(w)).withColumn("rn", F.row_number().over(w))
    got = ordered_lag(df, ["p", "c"], "t", "id", "v", "prev", bucket_hours=5)
    assert {r["id"]: r["prev"] for r in got.collect()} == {r["id"]: r["prev"] for r in want.collect()}
    got = ordered_row_number(df, ["p", "c"], "t", "id", "rn", bucket_hours=5)
    assert {r["id"]: r["rn"] for r in got.collect()} == {r["id"]: r["rn"] for r in want.collect()}
    runs = streaks(df, "flag", ["p", "c"], "t", "id", bucket_hours=5)
    f = F.coalesce("flag", F.lit(False))
    start = (F.lag(F.lit(1)).over(w).isNull() | (f != F.lag(f).over(w))).cast("long")
    plain = df.withColumn("_s", start).withColumn("sid", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert {r["id"]: r["streak_id"] for r in runs.collect()} == {r["id"]: r["sid"] for r in plain.collect()}


def test_global_order_has_bounded_buckets(spark):
    df = spark.createDataFrame([(i * 10**9, f"x{i // 7}") for i in range(500)], "n long, x string")
    got = streaks(df, "x", [], "n", "n", bucket_hours=10.0, numeric=True)
    assert {r["n"]: r["streak_id"] for r in got.collect()} == {i * 10**9: i // 7 + 1 for i in range(500)}


def test_null_keys_of_a_join_spread_over_tasks(spark):
    big = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("k"), "id")
    small = spark.createDataFrame([(i, f"s{i}") for i in range(5)], "k long, s string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = split_hot_keys_join(big, small, ["k"], "left", "id", 100)
        assert out.count() == 4000 and out.filter("k is null and s is null").count() == 2000
        parts = out.filter("k is null").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) >= 6 and max(r["count"] for r in parts) < 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_draws_are_exactly_n(spark):
    df = spark.range(50).select(F.col("id").alias(N.SAMPLE_ID), (F.col("id") * 2).alias("v"))
    got = SM.sample_with_replacement(df, 400, seed=3).collect()
    assert len(got) == 400 and sorted(r["draw_no"] for r in got) == list(range(1, 401))
    assert len({r[N.SAMPLE_ID] for r in got}) > 40 and all(r["v"] == 2 * r[N.SAMPLE_ID] for r in got)
    again = SM.sample_with_replacement(df.repartition(5), 400, seed=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert SM.sample_with_replacement(df.limit(0), 10).count() == 0


def test_null_stop_flag_is_kept(spark, samples, infusions):
    inf = infusions([(1, 1, 1, 1, hours(0)), (1, 1, 1, None, hours(0))])
    got = A.attribute_samples(samples([(1, 5, hours(3), "x", 1.0)]), inf).collect()
    assert sorted((r[N.STOP] for r in got), key=str) == [1, None]


def test_load_rules(spark):
    rows = [(1, "2024-01-02", "1899-12-30 10:30:00", float("nan"), 2.0), (None, "2024-01-02", "1899-12-30 10:30:00", 1.0, None),
            (3, None, "1899-12-30 10:30:00", 1.0, None), (4, "no date", "1899-12-30 10:30:00", 1.0, None)]
    raw = spark.createDataFrame(rows, f"{N.PATIENT} long, {N.PL_DATE} string, {N.PL_TIME} string, {N.CREA_MEASURE} double, {N.MTX_MEASURE} double")
    (row,) = C.clean_samples(raw).collect()
    assert str(row[N.SAMPLE_TIME]) == "2024-01-02 10:30:00" and row[N.CREA_MEASURE] is None and row[N.MTX_MEASURE] == 2.0


def test_trim_takes_all_white_space(spark):
    df = spark.createDataFrame([("   x y　\x1c\n", None)], "a string, b string")
    assert tuple(C.clean_strings(df).first()) == ("x y", "")
