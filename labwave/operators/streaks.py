"""Runs of a boolean flag along each patient's series (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions.scalar import exact_hours
from .sequence import streaks


def streak_id(df: DataFrame, flag: str, patient: str = N.PATIENT, time: str = N.SAMPLE_TIME,
              order_id: str = N.SAMPLE_ID, out: str = "streak_id",
              bucket_hours: float = 24.0) -> DataFrame:
    """Adds the 1-based run number of ``flag`` per patient (null flag counts as false)."""
    return streaks(df, flag, [patient], time, order_id, bucket_hours, id_out=out,
                   start_out="_st", end_out="_et").drop("_st", "_et")


def streak_groups(df: DataFrame, flag: str, patient: str = N.PATIENT, time: str = N.SAMPLE_TIME,
                  order_id: str = N.SAMPLE_ID, bucket_hours: float = 24.0) -> DataFrame:
    """One row per run: first and last time, whether the run is positive, its hours."""
    s = streaks(df, flag, [patient], time, order_id, bucket_hours)
    return (s.groupBy(patient, "streak_id")
             .agg(F.min("streak_start").alias("min_date"),
                  F.max("streak_end").alias("max_date"),
                  F.bool_or(F.coalesce(F.col(flag), F.lit(False))).alias("is_streak_positive"))
             .withColumn("streak_duration", exact_hours("min_date", "max_date")))


def streak_flag(df: DataFrame, flag: str, longer_than_hours: float, patient: str = N.PATIENT,
                time: str = N.SAMPLE_TIME, order_id: str = N.SAMPLE_ID, out: str | None = None,
                bucket_hours: float = 24.0) -> DataFrame:
    """Row flag AND its run lasts strictly longer than ``longer_than_hours``.

    Run length is last minus first sample time, so a one-row run lasts 0 hours.
    The result replaces ``flag`` (or goes to ``out``).
    """
    out = out or flag
    s = streaks(df, flag, [patient], time, order_id, bucket_hours, id_out="_sid",
                start_out="_st", end_out="_et")
    long_run = exact_hours("_st", "_et") > F.lit(float(longer_than_hours))
    res = F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) & F.coalesce(long_run, F.lit(False))
    return s.withColumn(out, res).drop("_sid", "_st", "_et")
