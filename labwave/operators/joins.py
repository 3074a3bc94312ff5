"""Joining a large table to a small per-key table when a key may be hot.

Spark's adaptive skew-join split only applies when both join inputs are plain
shuffle stages; a per-key table that comes straight out of an aggregate does
not qualify. So hot keys are split explicitly:

1. rows per key are counted on the large side (a partial aggregate over the
   key columns only);
2. keys with more than ``rows_per_task`` rows are *hot*; the list of them is joined
   without a hint, so the planner broadcasts it only when it has measured it small;
3. a hot key's large-side rows get a salt in ``[0, fanout)`` from a hash of a
   unique row column (deterministic, so a retried task salts identically),
   with ``fanout = ceil(rows / rows_per_task)``; its small-side rows are
   repeated once per salt. Cold keys keep salt 0 and are not repeated;
4. the join runs on (keys, salt).

Inputs of less than ``LOOK_BYTES`` cannot hold much more than ``DEFAULT_ROWS_PER_TASK``
rows, so with that budget they are joined as they are, without a count.

A key holding a third of all rows is thereby spread over ``fanout`` tasks. Rows
with a null key match nothing, so any salt will do: they are spread over
``NULL_FANOUT`` salts.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT, FANOUT = "_hk_salt", "_hk_fanout"
DEFAULT_ROWS_PER_TASK = 4_000_000
NULL_FANOUT = 512
#: Bytes of stored input that are searched for crowded keys.
LOOK_BYTES = 64 << 20
#: Counters of ``may_be_crowded``.
SLOTS = 1 << 16


def input_bytes(df: DataFrame) -> int:
    """Size of the tables that ``df`` reads, as far as Spark knows it (files as stored)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def may_be_crowded(df: DataFrame, keys: Sequence[str], most: int) -> bool:
    """Whether a key may have more than ``most`` rows. Rows are counted by a hash of their
    key, so each task sends ``SLOTS`` counts whatever the number of keys; no crowded key
    is missed. Inputs of less than ``LOOK_BYTES`` hold no more than a task takes."""
    if most >= DEFAULT_ROWS_PER_TASK and input_bytes(df) < LOOK_BYTES:
        return False
    slot = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(SLOTS))
    counts = df.groupBy(slot.alias("_hk_slot")).agg(F.count(F.lit(1)).alias("_hk_n"))
    return not counts.filter(F.col("_hk_n") > most).isEmpty()


def with_least(df: DataFrame, keys: Sequence[str], value: Column, out: str, salt_col: str | None = None,
               rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """``df`` with the least ``value`` of each row's key in ``out``; rows with a null key go.

    Where no key has more rows than a task takes, that is a running window over the keys,
    in whose order the least value comes first: the rows are shuffled once, and not at all if they already lie by key. Else the values
    are aggregated and joined back with hot keys split."""
    for k in keys:
        df = df.filter(F.col(f"`{k}`").isNotNull())
    if not may_be_crowded(df, keys, rows_per_task):
        upto = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(value.asc_nulls_last())
        return df.withColumn(out, F.min(value).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per_key = df.groupBy(*keys).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("_hk_n"))
    hot = hot_from_counts(per_key, keys, "_hk_n", rows_per_task)
    return split_hot_keys_join(df, per_key.drop("_hk_n"), keys, "inner", salt_col, hot=hot)


def hot_keys(big: DataFrame, on: Sequence[str], rows_per_task: int) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows, with their fan-out."""
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_hk_n"))
    return hot_from_counts(counts, on, "_hk_n", rows_per_task)


def hot_from_counts(per_key: DataFrame, on: Sequence[str], count_col: str,
                    rows_per_task: int) -> DataFrame:
    """Hot keys from a per-key aggregate of the large side that already counts
    its rows in ``count_col``: the same table ``hot_keys`` gives, without a
    second pass over the large side (the aggregate is computed for the join
    anyway, and its shuffle is reused)."""
    hot = (per_key.filter(F.col(count_col) > rows_per_task)
                  .select(*on, F.ceil(F.col(count_col) / F.lit(rows_per_task)).cast("int")
                          .alias(FANOUT)))
    hot._rows_per_task = rows_per_task
    return hot


def split_hot_keys_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left",
                        salt_col: str | None = None,
                        rows_per_task: int = DEFAULT_ROWS_PER_TASK,
                        hot: DataFrame | None = None) -> DataFrame:
    """``big.join(small, on, how)`` with hot keys of ``big`` spread over tasks.

    ``how`` is one of inner, left, left_semi, left_anti (``big`` is the
    preserved side). ``salt_col`` is a unique column of ``big``; without one,
    a hash of all of ``big``'s columns is used. ``hot`` may pass a hot-key
    table computed once (``hot_keys``) on a leading subset of ``on``; a key
    that is hot there is split by that fan-out.
    """
    on = list(on)
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    budget = rows_per_task if hot is None else hot.__dict__.get("_rows_per_task", rows_per_task)
    if budget >= DEFAULT_ROWS_PER_TASK and input_bytes(big) < LOOK_BYTES:
        return big.join(small, on=on, how=how)
    hot = hot_keys(big, on, rows_per_task) if hot is None else hot
    hot_on = [c for c in hot.columns if c != FANOUT]
    salt_src = [F.col(salt_col)] if salt_col else [F.col(f"`{c}`") for c in big.columns]
    matchless = F.lit(False)
    for c in on:
        matchless = matchless | F.col(f"`{c}`").isNull()
    spread = F.pmod(F.xxhash64(*salt_src), F.lit(NULL_FANOUT)).cast("int")
    b = big.join(hot, on=hot_on, how="left").withColumn(
        SALT, F.when(matchless, spread).when(F.col(FANOUT).isNull(), F.lit(0))
               .otherwise(F.pmod(F.xxhash64(*salt_src), F.col(FANOUT)).cast("int"))).drop(FANOUT)
    s = small.join(hot, on=hot_on, how="left").withColumn(
        SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(FANOUT), F.lit(1)) - 1))).drop(FANOUT)
    return b.join(s, on=on + [SALT], how=how).drop(SALT)
