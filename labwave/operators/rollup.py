"""Patient-level roll-ups of detections and the data behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from .joins import DEFAULT_ROWS_PER_TASK, hot_from_counts, split_hot_keys_join

# --- fixed values: labels
POSITIVE = "patients with one positive diagnostic"
NEGATIVE = "patients with all negative diagnostic"
# --- end fixed values


def detected_patients(dx: DataFrame) -> DataFrame:
    """Patients with at least one positive row."""
    return (dx.groupBy(N.PATIENT).agg(F.bool_or(N.DETECTION).alias("_any"))
              .filter(F.col("_any")).select(N.PATIENT))


def patient_phenotype(dx: DataFrame) -> DataFrame:
    """Union of diagnostics -> one row per patient, 1 if any detection, else 0."""
    return dx.groupBy(N.PATIENT).agg(
        F.max(F.col(N.DETECTION).cast("int")).alias(N.PHENOTYPE))


def summary_detection(named_dx: DataFrame, name_col: str = "name") -> DataFrame:
    """Per diagnostic: patients with a positive row and patients with none, long form."""
    per_patient = named_dx.groupBy(name_col, N.PATIENT).agg(F.bool_or(N.DETECTION).alias("_pos"))
    per_dx = per_patient.groupBy(name_col).agg(
        F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("_pos"), 1)).alias(POSITIVE))
    per_dx = per_dx.withColumn(NEGATIVE, F.col("_all") - F.col(POSITIVE)).drop("_all")
    return per_dx.unpivot([name_col], [NEGATIVE, POSITIVE], "type", "number_of_patients")


def phenotype_counts(phenotype: DataFrame) -> DataFrame:
    """All, positive and negative patients of a phenotype table."""
    return phenotype.agg(
        F.count(F.lit(1)).alias("n_patients"),
        F.count(F.when(F.col(N.PHENOTYPE) == 1, 1)).alias("n_positive"),
        F.count(F.when(F.col(N.PHENOTYPE) == 0, 1)).alias("n_negative"))


def patients_in_scope(samples: DataFrame, code: str) -> DataFrame:
    """Distinct patients, and distinct patients having ``code`` (two-phase: by
    patient first, so the distinct count never gathers rows of one patient)."""
    per_patient = samples.groupBy(N.PATIENT).agg(
        F.bool_or(F.col(N.CODE) == code).alias("_has"))
    return per_patient.agg(F.count(F.lit(1)).alias("n_patients"),
                           F.count(F.when(F.col("_has"), 1)).alias("n_patients_with_code"))


CHART_COLS = [N.PATIENT, N.SAMPLE_ID, N.SAMPLE_TIME, N.CODE, N.VALUE, N.INFNO, N.SEX, N.STOP,
              N.DETECTION]


def chart_samples(dx: DataFrame) -> DataFrame:
    """All samples of a diagnostic with their detection (scatter data)."""
    return dx.select(*CHART_COLS)


def detected_samples(dx: DataFrame, rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """Samples of every detected patient (semi join, no id list on the driver).
    The per-patient aggregate also counts rows, which marks hot patients."""
    per = dx.groupBy(N.PATIENT).agg(F.bool_or(N.DETECTION).alias("_any"),
                                    F.count(F.lit(1)).alias("_n"))
    hot = hot_from_counts(per, [N.PATIENT], "_n", rows_per_task)
    detected = per.filter(F.col("_any")).select(N.PATIENT)
    return split_hot_keys_join(dx, detected, [N.PATIENT], "left_semi", N.SAMPLE_ID,
                               hot=hot).select(*CHART_COLS)


def patient_samples(dx: DataFrame, patient) -> DataFrame:
    """Samples of one patient."""
    return dx.filter(F.col(N.PATIENT) == F.lit(patient)).select(*CHART_COLS)


def elimination_curve(samples: DataFrame, patient, code: str) -> DataFrame:
    """One patient's methotrexate values over hours since infusion, by infusion."""
    d = samples.filter((F.col(N.CODE) == code) & (F.col(N.PATIENT) == F.lit(patient))
                       & F.col(N.VALUE).isNotNull() & (F.col(N.VALUE) > 0)
                       & F.col(N.INFNO).isNotNull())
    return d.select(N.PATIENT, F.col(N.INFNO).cast("string").alias(N.INFNO), N.HOURS, N.VALUE,
                    N.SAMPLE_TIME, N.INF_DATE, N.SAMPLE_ID).orderBy(N.INFNO, N.HOURS, N.SAMPLE_ID)
