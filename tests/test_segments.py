"""Segmented scans where many rows meet at one time, and over one global order."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labwave.operators import codebook as CB
from labwave.operators import sequence as SEQ
from labwave.operators import text as TX


def _at_one_time(spark, n=200_000):
    """One patient with ``n`` rows at one instant, a few before and after, another patient, rows without a time."""
    t0 = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")
    rows = spark.range(n).select(F.lit(1).cast("long").alias("p"), F.col("id"), t0.alias("t"))
    more = spark.range(n, n + 40).select(F.when(F.col("id") % 2 == 0, F.lit(2)).otherwise(1).cast("long").alias("p"), "id",
                                         F.when(F.col("id") % 5 > 0, F.timestamp_add("HOUR", (F.col("id") % 7 - 3).cast("int"), t0)).alias("t"))
    df = rows.unionByName(more)
    return df.withColumns({"v": F.pmod(F.xxhash64("id"), F.lit(9)), "flag": F.pmod(F.xxhash64("id"), F.lit(3)) == 0})


def test_rows_at_one_instant_spread_over_tasks(spark):
    df = _at_one_time(spark)
    rows, at, _ = SEQ._segments(df, ["p"], "t", "id", 24.0, False, 10_000)
    sizes = [r["count"] for r in rows.groupBy("p", *at).count().collect()]
    assert sum(sizes) == 200_040 and len(sizes) > 15 and max(sizes) <= 30_000


def test_crowded_scans_equal_plain_windows(spark):
    df = _at_one_time(spark, 20_000)
    w = Window.partitionBy("p").orderBy(F.col("t").asc_nulls_last(), "id")
    start = (F.lag(F.lit(1)).over(w).isNull() | (F.col("flag") != F.lag("flag").over(w))).cast("long")
    plain = df.withColumns({"prev": F.lag("v").over(w), "rn": F.row_number().over(w), "s": start})
    plain = plain.withColumn("sid", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy("p", "sid")
    plain = plain.withColumns({"st": F.min("t").over(g), "en": F.max("t").over(g), "timed": F.count("t").over(g) == F.count(F.lit(1)).over(g)})
    want = {r["id"]: (r["prev"], r["rn"], r["sid"], *((r["st"], r["en"]) if r["timed"] else (None, None))) for r in plain.collect()}
    lag = {r["id"]: r["x"] for r in SEQ.ordered_lag(df, ["p"], "t", "id", "v", "x", rows_per_range=700).collect()}
    rn = {r["id"]: r["x"] for r in SEQ.ordered_row_number(df, ["p"], "t", "id", "x", rows_per_range=700).collect()}
    runs = SEQ.streaks(df, "flag", ["p"], "t", "id", rows_per_range=700).collect()
    timed = {i for i, x in want.items() if x[3] is not None}  # a run into the rows without a time has no length
    assert {r["id"]: (lag[r["id"]], rn[r["id"]], r["streak_id"], *((r["streak_start"], r["streak_end"]) if r["id"] in timed else (None, None)))
            for r in runs} == want


@pytest.mark.parametrize("fan", [2, 5, 1024])
def test_tree_of_summaries_equals_plain_windows(spark, monkeypatch, fan):
    """A global order in about 40 ranges, swept in a tree of one, three or six levels."""
    monkeypatch.setattr(SEQ, "FAN", fan)
    df = spark.range(4000).select("id", (F.col("id") * 37 % 4001).alias("n"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    df = df.withColumn("x", F.floor(F.col("n") / 90) + F.when(F.col("n") % 400 < 3, 1000).otherwise(0))
    order = sorted((r["n"], r["id"], r["v"], r["x"]) for r in df.collect())
    total, last, sid, prev, want, starts = 0, None, 0, object(), {}, {}
    for n, i, v, x in order:
        total += v
        sid += x != prev
        starts.setdefault(sid, n)
        want[i] = (total, last, sid, starts[sid])
        last, prev = v, x
    ends = {}
    for n, i, v, x in order:
        ends[want[i][2]] = n
    sums = {r["id"]: r["s"] for r in SEQ.ordered_prefix_sums(df, [], "n", "id", {"s": F.col("v")}, numeric=True, rows_per_range=100).collect()}
    lag = {r["id"]: r["p"] for r in SEQ.ordered_lag(df, [], "n", "id", "v", "p", numeric=True, rows_per_range=100).collect()}
    runs = SEQ.streaks(df, "x", [], "n", "id", numeric=True, rows_per_range=100).collect()
    assert {r["id"]: (sums[r["id"]], lag[r["id"]], r["streak_id"], r["streak_start"]) for r in runs} == want
    assert all(r["streak_end"] == ends[r["streak_id"]] for r in runs)


def test_described_columns_need_no_single_partition(spark):
    sheet = spark.createDataFrame([(f"v{i % 7}", f"q{i}", str(i), i) for i in range(50)], "variable string, question string, detail_value string, row_no long")
    cols = sheet.select(F.col("variable").alias("column_name")).distinct()
    both = CB.merge_descriptions(CB.describe_columns(cols, sheet), cols.select("column_name", F.lit("d").alias("description")))
    for df in (CB.describe_columns(cols, sheet), both):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    plain = spark.createDataFrame([("a", "b")], "column_name string, description string")
    assert "Aggregate" not in CB.merge_descriptions(plain, plain)._jdf.queryExecution().executedPlan().toString()


def test_pieces_have_a_text_budget(spark):
    """5,000 lines without a turn, and 3,000 of one turn: no piece is much longer than the budget."""
    rows = [(1, None, "user", f"line {i:05d}") for i in range(5000)] + [(2, 7, "bot", f"line {i:05d}") for i in range(3000)] + [(3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for limit in (None, 500):
        got = TX.concat_group_text(df, piece_chars=1000, rows_per_range=limit).collect()
        assert max(len(r["joined_text"]) for r in got) <= 1000 + 20
        for conv, role, n in ((1, "user", 5000), (2, "bot", 3000)):
            pieces = [r["joined_text"] for r in sorted(got, key=lambda r: r["piece_no"]) if r["conv_id"] == conv]
            assert "\n".join(pieces) == "\n".join(f"{role}: line {i:05d}" for i in range(n))
        assert [r["joined_text"] for r in got if r["conv_id"] == 3] == [""]
