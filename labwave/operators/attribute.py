"""Sample-to-treatment attribution and the per-patient lookups that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions.scalar import floor_hours
from .joins import DEFAULT_ROWS_PER_TASK, split_hot_keys_join

MAX_INFUSION = 8


def duplicate_treatments(infusions: DataFrame, patient: str = N.PATIENT,
                         infno: str = N.INFNO) -> DataFrame:
    """(patient, infno) keys that occur more than once, with their count."""
    return (infusions.groupBy(patient, infno).agg(F.count(F.lit(1)).alias("n_rows"))
                     .filter(F.col("n_rows") > 1))


def drop_duplicate_patients(infusions: DataFrame, patient: str = N.PATIENT,
                            infno: str = N.INFNO) -> DataFrame:
    """Remove every patient that has a repeated (patient, infno); others stay whole."""
    bad = duplicate_treatments(infusions, patient, infno).select(patient).distinct()
    return infusions.join(bad, on=patient, how="left_anti")


def distinct_treatments(infusions: DataFrame) -> DataFrame:
    """One row per (patient, infno, start)."""
    return infusions.dropDuplicates([N.PATIENT, N.INFNO, N.INF_START])


def _per_infusion(infusions: DataFrame, on_duplicate: str) -> DataFrame:
    """One row per (patient, infno): its start, and the stop flags / sexes seen on it."""
    inf = infusions.filter(F.col(N.INF_START).isNotNull())
    if on_duplicate == "drop_patient":
        keyed = inf.dropDuplicates([N.PATIENT, N.INFNO, N.INF_START])
        inf = inf.join(drop_duplicate_patients(keyed).select(N.PATIENT).distinct(),
                       on=N.PATIENT, how="left_semi")
    elif on_duplicate != "error":
        raise ValueError("on_duplicate must be 'error' or 'drop_patient'")
    per = inf.groupBy(N.PATIENT, N.INFNO).agg(
        F.min(N.INF_START).alias("_s_min"), F.max(N.INF_START).alias("_s_max"),
        # Structs, since a set of plain values leaves nulls out.
        F.transform(F.collect_set(F.struct(N.STOP)), lambda x: x[N.STOP]).alias("_stops"),
        F.collect_set(N.SEX).alias("_sexes"))
    # Two different starts for one treatment number cannot be attributed.
    start = F.when(F.col("_s_min") != F.col("_s_max"),
                   F.raise_error(F.concat(F.lit("repeated treatment number for patient "),
                                          F.col(N.PATIENT).cast("string")))
                   ).otherwise(F.col("_s_min"))
    return per.select(N.PATIENT, F.col(N.INFNO).cast("int").alias(N.INFNO),
                      start.cast("timestamp_ntz").alias("_start"), "_stops", "_sexes")


def patient_treatments(infusions: DataFrame, on_duplicate: str = "error",
                       max_infusion: int = MAX_INFUSION) -> DataFrame:
    """One row per patient: starts of infusions 1..max (at most ``max_infusion``
    entries, so the row is bounded), stop flags per infusion number and the
    known sexes (0 is unknown)."""
    per = _per_infusion(infusions, on_duplicate)
    in_range = F.col(N.INFNO).between(1, max_infusion)
    return per.groupBy(N.PATIENT).agg(
        F.collect_list(F.when(in_range, F.struct(F.col(N.INFNO).alias("k"),
                                                 F.col("_start").alias("s")))).alias("_starts"),
        F.collect_list(F.when(F.col(N.INFNO).between(0, max_infusion),
                              F.struct(F.col(N.INFNO).alias("k"),
                                       F.col("_stops").alias("v")))).alias("_stop_by_k"),
        # collect_set keeps distinct sex sets only, so the row stays small however
        # many infusion rows a patient has.
        F.array_distinct(F.flatten(F.collect_set("_sexes"))).alias("_sexes"),
    )


def attribute_samples(samples: DataFrame, infusions: DataFrame, on_duplicate: str = "error",
                      max_infusion: int = MAX_INFUSION, time: str = N.SAMPLE_TIME,
                      rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """Attach to every sample the treatment in force when it was taken.

    The chosen treatment is the highest infusion number k in 1..max whose start
    is at or before the sample time (the highest number, not the latest start).
    A sample before infusion 1 gets 0 (measured against infusion 1); a patient
    without infusions, or without infusion 1 for an early sample, gets null.
    Adds INFNO (int), MTX_INFDATE (chosen start), HOUR_DIFF_SAMPLE_INF (floored
    hours), SEX (each known non-zero sex of the patient) and MP6_POST_STOP.

    One left join on patient to a bounded per-patient row (no fan-out); a
    patient with more than ``rows_per_task`` samples is split over several
    tasks (``joins.split_hot_keys_join``).
    """
    per_patient = patient_treatments(infusions, on_duplicate, max_infusion)
    base = samples.drop(N.INFNO, N.INF_DATE, N.HOURS, N.SEX, N.STOP)
    salt = N.SAMPLE_ID if N.SAMPLE_ID in base.columns else None
    j = split_hot_keys_join(base, per_patient, [N.PATIENT], "left", salt, rows_per_task)
    t = F.col(time)
    chosen = F.array_max(F.filter("_starts", lambda x: x["s"] <= t))
    first = F.array_max(F.filter("_starts", lambda x: x["k"] == 1))
    known = t.isNotNull() & F.col("_starts").isNotNull()
    infno = (F.when(~known, F.lit(None))
              .when(chosen.isNotNull(), chosen["k"])
              .when(first.isNotNull(), F.lit(0)))
    start = (F.when(~known, F.lit(None))
              .when(chosen.isNotNull(), chosen["s"])
              .when(first.isNotNull(), first["s"]))
    j = (j.withColumn(N.INFNO, infno.cast("int"))
          .withColumn(N.INF_DATE, start.cast("timestamp_ntz"))
          .withColumn(N.HOURS, floor_hours(N.INF_DATE, time)))
    stops = F.flatten(F.transform(F.filter("_stop_by_k", lambda x: x["k"] == F.col(N.INFNO)),
                                  lambda x: x["v"]))
    sexes = F.filter("_sexes", lambda x: x != 0)
    j = (j.withColumn(N.SEX, F.explode_outer(sexes)).withColumn(N.SEX, F.col(N.SEX).cast("int")))
    j = j.withColumn(N.STOP, F.explode_outer(stops)).withColumn(N.STOP, F.col(N.STOP).cast("int"))
    return j.drop("_starts", "_stop_by_k", "_sexes")


def attach_sex(samples: DataFrame, infusions: DataFrame) -> DataFrame:
    """Left join the patient's known sexes (0 is unknown); two sexes give two rows."""
    sexes = infusions.filter(F.col(N.SEX) != 0).select(N.PATIENT, N.SEX).distinct()
    base = samples.drop(N.SEX)
    salt = N.SAMPLE_ID if N.SAMPLE_ID in base.columns else None
    return split_hot_keys_join(base, sexes, [N.PATIENT], "left", salt)


def attach_stop_flag(samples: DataFrame, infusions: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Left join the stop flag of the sample's (patient, infusion number). ``hot`` may
    pass patient row counts taken upstream (``joins.hot_keys``)."""
    stops = infusions.select(N.PATIENT, F.col(N.INFNO).cast("int").alias(N.INFNO), N.STOP).distinct()
    base = samples.drop(N.STOP)
    salt = N.SAMPLE_ID if N.SAMPLE_ID in base.columns else None
    return split_hot_keys_join(base, stops, [N.PATIENT, N.INFNO], "left", salt, hot=hot)
