"""Ordered scans over a patient's series without putting a patient in one task.

Every per-patient sequential computation here (previous value, row number,
streak id, streak start and end) is a prefix scan along (time, id). A plain
``Window.partitionBy(patient)`` would send all of a patient's rows to one task,
so a patient holding a third of the data would hold a third of the work.
Instead each scan runs in two levels:

1. rows are windowed within (keys, segment); every segment also yields a
   one-row summary (first/last values, counts, times) by a grouped aggregate
   that reuses the same hash partitioning;
2. the small summaries are scanned per patient (one row per segment) to get what
   each segment must carry in from its neighbours, and joined back to the rows.

The rows are shuffled once; the summaries are tiny. Segments are

* with keys: time buckets of ``bucket_hours``. Where a bucket of a patient holds
  more than ``ROWS_PER_RANGE`` rows (many samples at one instant, say), its rows are
  cut into ranges of about equal size along (time, id), with boundaries that Spark
  samples, so no number of rows at one time meets in one task. Inputs of less than
  ``LOOK_BYTES`` are not searched for such buckets: one task holds them;
* without keys (one global order): ranges of about equal size from the start. Their
  summaries are swept up and down a tree of ``FAN`` summaries a node, so no task sees
  all of them either.

Rows without a time come last and are bucketed by their id.

Row numbers need neither segments nor summaries where no key has more than
``ROWS_PER_RANGE`` rows: they are a window over the keys, and the rows are shuffled once.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MICROS_PER_HOUR, epoch_micros
from ..session import shared_dir
from .joins import LOOK_BYTES, input_bytes, may_be_crowded

BUCKET, RANGE = "_seq_bucket", "_seq_range"
_NULL_TIME_BUCKET = 2**62  # rows without a time sort last, in buckets of their own
_NULL_TIME_IDS = 4096  # ids in each of these
ROWS_PER_RANGE = 1_000_000
BYTES_PER_RANGE = 16 << 20  # of stored input, for one range of a global order
_UNKNOWN_BYTES = 1 << 60  # Spark's size of rows that are in no table is larger
_INDEX_BITS = 33  # of Spark's increasing ids, the number within the partition
FAN = 1024


def _bucket(df: DataFrame, time_col: str, id_col: str, bucket_hours: float, numeric: bool = False) -> Column:
    """Bucket of the order column: ``bucket_hours`` wide for timestamps, or that
    many units wide for a numeric order column."""
    at = F.col(time_col).cast("double") if numeric else epoch_micros(time_col).cast("double")
    width = F.lit(float(bucket_hours if numeric else int(bucket_hours * MICROS_PER_HOUR)))
    last = F.lit(_NULL_TIME_BUCKET).cast("long")
    if dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        last = last + F.coalesce(F.floor(F.col(id_col) / _NULL_TIME_IDS).cast("long"), F.lit(-(2**61)))
    return F.coalesce(F.floor(at / width).cast("long"), last)


def _ranges(rows: DataFrame, order: list[Column], n: int, out: str) -> DataFrame:
    """``rows`` in ``n`` ranges of about equal size along ``order``, numbered from 0 in
    ``out``. Written, so that a range has one number however often it is read."""
    path = shared_dir(rows.sparkSession, "ranges")
    rows = rows.repartitionByRange(max(1, n), *order).withColumn(out, F.spark_partition_id().cast("long"))
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _segments(df: DataFrame, keys: list[str], time_col: str, id_col: str, bucket_hours: float, numeric: bool,
              rows_per_range: int | None) -> tuple[DataFrame, list[str], int]:
    """``df`` with the columns that number its segments, their names, and the number of
    segments of a scan without keys."""
    order = [F.col(time_col).asc_nulls_last(), F.col(id_col).asc()]
    if not keys:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        if rows_per_range:
            n = max(n, -(-df.count() // rows_per_range))
        return _ranges(df, order, n, BUCKET), [BUCKET], n
    rows = df.withColumn(BUCKET, _bucket(df, time_col, id_col, bucket_hours, numeric))
    if rows_per_range is None and input_bytes(df) < LOOK_BYTES:
        return rows, [BUCKET], 0
    most = rows_per_range or ROWS_PER_RANGE
    path = shared_dir(df.sparkSession, "crowded")
    counts = rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_seq_n"))
    counts.filter(F.col("_seq_n") > most).write.parquet(path)
    crowded = df.sparkSession.read.schema(counts.schema).parquet(path)  # a row for each ``most`` rows at the most
    total = crowded.agg(F.sum("_seq_n")).first()[0]
    if not total:
        return rows, [BUCKET], 0
    crowded, same = _renamed(crowded.drop("_seq_n"), [*keys, BUCKET])
    cut = _ranges(rows.join(crowded, same, "left_semi"), [*[F.col(f"`{k}`") for k in keys], F.col(BUCKET), *order], math.ceil(total / most) + 1, RANGE)
    return rows.join(crowded, same, "left_anti").withColumn(RANGE, F.lit(-1).cast("long")).unionByName(cut), [BUCKET, RANGE], 0


def _renamed(info: DataFrame, on: Sequence[str]) -> tuple[DataFrame, Column]:
    """``info`` with its join columns renamed, and the null-safe condition on them."""
    same = F.lit(True)
    for c in on:
        info = info.withColumnRenamed(c, f"_jb_{c}")
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`_jb_{c}`"))
    return info, same


def _join_back(rows: DataFrame, info: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with their segment's summary. Null-safe on the keys: a null key is a group
    like any other, and every row of ``rows`` stays."""
    info, same = _renamed(info, on)
    return rows.join(info, same, "inner").drop(*[f"_jb_{c}" for c in on])


def _carried(summ: DataFrame, keys: list[str], at: list[str], n: int, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """``summ`` with ``specs`` (output -> (kind, column)) over the summaries in order: the
    value before (``lag``) or after (``lead``), the sum or maximum of all before, the
    minimum of all after. Without keys the summaries are swept in a tree: within groups
    of ``FAN``, over the groups, and down again."""
    group = "_seq_group"
    if not keys:
        summ = summ.withColumn(group, F.floor(F.col(at[0]) / FAN).cast("long"))
    by = keys or [group]
    up = Window.partitionBy(*by).orderBy(*at)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in at]).rowsBetween(Window.unboundedPreceding, -1)
    scan = {"lag": lambda c: F.lag(c).over(up), "lead": lambda c: F.lead(c).over(up), "sum": lambda c: F.sum(c).over(before),
            "max": lambda c: F.max(c).over(before), "min": lambda c: F.min(c).over(after)}
    if keys or n <= FAN:
        return summ.withColumns({out: scan[kind](c) for out, (kind, c) in specs.items()}).drop(group)
    whole = {"lag": F.max_by, "lead": F.min_by, "sum": None, "max": None, "min": None}
    total = {"sum": F.sum, "max": F.max, "min": F.min}
    first, last = "_seq_first_of", "_seq_last_of"
    summ = summ.withColumns({first: F.lag(F.lit(1)).over(up).isNull(), last: F.lead(F.lit(1)).over(up).isNull(),
                             **{out: scan[kind](c) for out, (kind, c) in specs.items()}})
    groups = summ.groupBy(group).agg(*[(whole[kind](F.struct(c), at[0]).getField(c) if whole[kind] else total[kind](c)).alias(f"{out}_g")
                                       for out, (kind, c) in specs.items()])
    groups = _carried(groups.withColumnRenamed(group, at[0]), [], at, -(-n // FAN),
                      {f"{out}_c": (kind, f"{out}_g") for out, (kind, _) in specs.items()})
    groups = groups.select(F.col(at[0]).alias(group), *[f"{out}_c" for out in specs])
    joined = _join_back(summ, groups, [group])
    merged = {}
    for out, (kind, _) in specs.items():
        mine, carry = F.col(out), F.col(f"{out}_c")
        merged[out] = {"lag": F.when(F.col(first), carry).otherwise(mine), "lead": F.when(F.col(last), carry).otherwise(mine),
                       "sum": F.when(mine.isNull(), carry).when(carry.isNull(), mine).otherwise(mine + carry),
                       "max": F.greatest(mine, carry), "min": F.least(mine, carry)}[kind]
    return joined.withColumns(merged).drop(group, first, last, *[f"{out}_c" for out in specs])


def _row_window(keys, at, time_col, id_col):
    return Window.partitionBy(*keys, *at).orderBy(
        F.col(time_col).asc_nulls_last(), F.col(id_col).asc())


def _row_window_desc(keys, at, time_col, id_col):
    """The row order reversed. "Everything after this row" is a running frame
    over this order: Spark computes running frames incrementally, while a frame
    ending at unbounded following is recomputed for every row (quadratic)."""
    return Window.partitionBy(*keys, *at).orderBy(
        F.col(time_col).desc_nulls_first(), F.col(id_col).desc())


def ordered_lag(df: DataFrame, keys: Sequence[str], time_col: str, id_col: str,
                value_col: str, out_col: str, bucket_hours: float = 24.0,
                numeric: bool = False, rows_per_range: int | None = None) -> DataFrame:
    """Previous row's ``value_col`` within ``keys`` ordered by (time, id)."""
    keys = list(keys)
    rows, at, n = _segments(df, keys, time_col, id_col, bucket_hours, numeric, rows_per_range)
    w = _row_window(keys, at, time_col, id_col)
    rows = rows.withColumns({
        "_seq_local_prev": F.lag(value_col).over(w),
        "_seq_first": F.lag(F.lit(1)).over(w).isNull(),
        "_seq_last_row": F.lead(F.lit(1)).over(w).isNull(),
    })
    summ = rows.groupBy(*keys, *at).agg(
        F.max(F.when(F.col("_seq_last_row"), F.col(value_col))).alias("_seq_last"))
    info = _carried(summ, keys, at, n, {"_seq_carry": ("lag", "_seq_last")}).drop("_seq_last")
    out = _join_back(rows, info, [*keys, *at])
    prev = F.when(F.col("_seq_first"), F.col("_seq_carry")).otherwise(F.col("_seq_local_prev"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], prev.alias(out_col))


def ordered_prefix_sums(df: DataFrame, keys: Sequence[str], time_col: str, id_col: str,
                        sums: dict[str, Column], bucket_hours: float = 24.0,
                        numeric: bool = False, rows_per_range: int | None = None) -> DataFrame:
    """Running sums (rows up to and including the current one) within ``keys``
    ordered by (time, id): ``sums`` maps output name -> numeric expression."""
    keys = list(keys)
    vals = {f"_ps_v{i}": e for i, e in enumerate(sums.values())}
    rows, at, n = _segments(df.withColumns(vals), keys, time_col, id_col, bucket_hours, numeric, rows_per_range)
    upto = _row_window(keys, at, time_col, id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_ps_l{i}": F.sum(f"_ps_v{i}").over(upto) for i in range(len(vals))})
    summ = rows.groupBy(*keys, *at).agg(
        *[F.sum(f"_ps_v{i}").alias(f"_ps_b{i}") for i in range(len(vals))])
    info = _carried(summ, keys, at, n, {f"_ps_o{i}": ("sum", f"_ps_b{i}") for i in range(len(vals))})
    out = _join_back(rows, info.drop(*[f"_ps_b{i}" for i in range(len(vals))]), [*keys, *at])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[
        (F.coalesce(F.col(f"_ps_o{i}"), F.lit(0)) + F.col(f"_ps_l{i}")).alias(name) for i, name in enumerate(sums)])


def ordered_row_number(df: DataFrame, keys: Sequence[str], time_col: str, id_col: str,
                       out_col: str, bucket_hours: float = 24.0, numeric: bool = False,
                       rows_per_range: int | None = None) -> DataFrame:
    """1-based position within ``keys`` ordered by (time, id), as int."""
    keys = list(keys)
    if keys and rows_per_range is None and (
            input_bytes(df) < LOOK_BYTES or not may_be_crowded(df, keys, ROWS_PER_RANGE)):
        return df.withColumn(out_col, F.row_number().over(_row_window(keys, [], time_col, id_col)))
    out = ordered_prefix_sums(df, keys, time_col, id_col, {"_seq_rn": F.lit(1).cast("long")},
                              bucket_hours, numeric, rows_per_range)
    return out.withColumnRenamed("_seq_rn", out_col).withColumn(out_col, F.col(out_col).cast("int"))


def ordered_position(df: DataFrame, time_col: str, id_col: str, out_col: str) -> DataFrame:
    """0-based position in the one order of all rows by (time, id), as long.

    The rows are shuffled once, to ranges that are sorted and written with Spark's
    increasing ids; a range's positions start at the number of rows in the ranges before
    it. Neighbours in the order differ by 1, so runs need no window over the ranges."""
    spark = df.sparkSession
    order = [F.col(time_col).asc_nulls_last(), F.col(id_col).asc()]
    size = input_bytes(df)
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if size < _UNKNOWN_BYTES:
        n = max(n, -(-size // BYTES_PER_RANGE))
    path = shared_dir(spark, "positions")
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(out_col, F.monotonically_increasing_id())
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path).withColumns({
        BUCKET: F.shiftright(out_col, _INDEX_BITS),
        out_col: F.col(out_col).bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))})
    counts = rows.groupBy(BUCKET).agg((F.max(out_col) + 1).alias("_seq_n"))
    base = _carried(counts, [], [BUCKET], n, {"_seq_base": ("sum", "_seq_n")}).select(BUCKET, "_seq_base")
    out = rows.join(F.broadcast(base), BUCKET)  # a row for each range
    return out.withColumn(out_col, F.col(out_col) + F.coalesce("_seq_base", F.lit(0))).select(
        *[F.col(f"`{c}`") for c in df.columns], out_col)


def _run_value(df: DataFrame, col: str) -> Column:
    if dict(df.dtypes)[col] == "boolean":
        return F.coalesce(F.col(col), F.lit(False))
    return F.col(col)


def streaks(df: DataFrame, flag_col: str, keys: Sequence[str], time_col: str, id_col: str,
            bucket_hours: float = 24.0, id_out: str = "streak_id",
            start_out: str = "streak_start", end_out: str = "streak_end",
            numeric: bool = False, rows_per_range: int | None = None) -> DataFrame:
    """Gaps and islands: runs of equal ``flag_col`` per ``keys`` along (time, id).

    Adds the 1-based run number (a new run starts at the first row and wherever
    the flag differs from the previous row's) and the time of the run's first
    and last row. A boolean flag that is null counts as false; any other column
    type is compared null-safely, so runs of equal values are found.
    """
    keys = list(keys)
    f = "_seq_flag"
    rows, at, n = _segments(df.withColumn(f, _run_value(df, flag_col)), keys, time_col, id_col, bucket_hours, numeric,
                            rows_per_range)
    w = _row_window(keys, at, time_col, id_col)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = _row_window_desc(keys, at, time_col, id_col).rowsBetween(Window.unboundedPreceding,
                                                                     Window.currentRow)
    t = F.col(time_col)
    has_prev = F.lag(F.lit(1)).over(w).isNotNull()
    has_next = F.lead(F.lit(1)).over(w).isNotNull()
    # Run boundaries strictly inside a segment; a segment's first/last row is
    # settled later from the neighbouring segments' summaries.
    rows = rows.withColumns({
        "_seq_hp": has_prev,
        "_seq_hn": has_next,
        "_seq_ls": has_prev & ~F.col(f).eqNullSafe(F.lag(f).over(w)),
        "_seq_le": has_next & ~F.col(f).eqNullSafe(F.lead(f).over(w)),
    })
    rows = rows.withColumns({
        "_seq_nstart": F.sum(F.col("_seq_ls").cast("long")).over(upto),
        "_seq_st": F.max(F.when(F.col("_seq_ls"), t)).over(upto),
        "_seq_et": F.min(F.when(F.col("_seq_le"), t)).over(after),
    })
    # The segment's first and last value come from the rows the window marked
    # as first and last, so no ordered aggregate is needed.
    summ = rows.groupBy(*keys, *at).agg(
        F.max(F.lit(1)).alias("_b_one"),
        F.max(F.when(~F.col("_seq_hp"), F.col(f))).alias("_b_ff"),
        F.max(F.when(~F.col("_seq_hn"), F.col(f))).alias("_b_lf"),
        F.min(t).alias("_b_ft"), F.max(t).alias("_b_lt"),
        F.sum(F.col("_seq_ls").cast("long")).alias("_b_ns"),
        F.max(F.when(F.col("_seq_ls"), t)).alias("_b_lst"),
        F.min(F.when(F.col("_seq_le"), t)).alias("_b_fet"),
    )
    summ = _carried(summ, keys, at, n, {"_b_hp": ("lag", "_b_one"), "_b_pf": ("lag", "_b_lf"), "_b_hn": ("lead", "_b_one"), "_b_nf": ("lead", "_b_ff")})
    summ = summ.withColumns({"_b_fs": F.col("_b_hp").isNull() | ~F.col("_b_ff").eqNullSafe(F.col("_b_pf")),
                             "_b_le": F.col("_b_hn").isNull() | ~F.col("_b_lf").eqNullSafe(F.col("_b_nf"))})
    summ = summ.withColumns({
        "_b_starts": F.col("_b_ns") + F.col("_b_fs").cast("long"),
        "_b_start": F.greatest("_b_lst", F.when(F.col("_b_fs"), F.col("_b_ft"))),
        "_b_end": F.least("_b_fet", F.when(F.col("_b_le"), F.col("_b_lt")))})
    info = _carried(summ, keys, at, n, {"_b_base": ("sum", "_b_starts"), "_b_cst": ("max", "_b_start"), "_b_cet": ("min", "_b_end")})
    info = info.select(*keys, *at, "_b_fs", "_b_le", "_b_ft", "_b_lt", F.coalesce("_b_base", F.lit(0)).alias("_b_base"), "_b_cst", "_b_cet")
    out = _join_back(rows, info, [*keys, *at])
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_b_base") + F.col("_b_fs").cast("long") + F.col("_seq_nstart")).alias(id_out),
        F.coalesce(F.col("_seq_st"),
                   F.when(F.col("_b_fs"), F.col("_b_ft")).otherwise(F.col("_b_cst"))).alias(start_out),
        F.coalesce(F.col("_seq_et"),
                   F.when(F.col("_b_le"), F.col("_b_lt")).otherwise(F.col("_b_cet"))).alias(end_out),
    )
