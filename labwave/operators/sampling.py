"""Previews: repeatable random rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import names as N


def sample_rows(df: DataFrame, n: int, seed: int = 0, id_col: str = N.SAMPLE_ID) -> DataFrame:
    """``n`` rows without replacement, repeatable: order by a hash of (id, seed).

    Spark plans this as a per-partition top-n followed by one small merge, so
    no partition is sorted in full. Asking for more rows than exist gives all.
    """
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    return df.orderBy(key, F.col(id_col)).limit(int(n))


#: Hash prefixes of three digits: a fixed number of groups to count and number by.
_PREFIX = 3


def sample_with_replacement(df: DataFrame, n: int, seed: int = 0, id_col: str = N.SAMPLE_ID,
                            draw_col: str = "draw_no") -> DataFrame:
    """Exactly ``n`` rows drawn with replacement, repeatable; ``draw_col`` numbers the
    draws from 1. An empty table gives none.

    Rows are numbered along a hash of (id, seed): rows are counted for each of the
    4096 prefixes of the hash, the counts are summed up, and only rows of one prefix
    are numbered together. Draw i takes the row whose number is a hash of (i, seed)
    modulo the row count, so the draws are joined to the numbers and nothing is
    collected.
    """
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))))
    rows = df.withColumn("_h", key).withColumn("_p", F.substring("_h", 1, _PREFIX))
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 rows at most
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    total = counts.agg(F.sum("_c")).scalar()
    inside = Window.partitionBy("_p").orderBy("_h", id_col)
    numbered = (rows.withColumn("_rn", F.row_number().over(inside)).join(starts, "_p")
                    .withColumn("_at", F.col("_start") + F.col("_rn") - 1))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id"), F.lit(str(seed)))), 1, 12), 16, 10)
    draws = df.sparkSession.range(1, int(n) + 1).select(
        F.col("id").alias(draw_col), F.pmod(draw.cast("long"), total).alias("_at"))
    return numbered.join(draws, "_at").drop("_h", "_p", "_rn", "_start", "_at")
