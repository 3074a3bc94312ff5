"""Phenotype detections on long lab samples.

Each diagnostic is a pure function ``DataFrame -> DataFrame``: it keeps the rows
of its analyte codes and adds a boolean ``detection``. Thresholds and analyte
codes are keyword arguments; their defaults are the clinical defaults.
Comparisons with null count as false, and NaN is null: no measurement.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..session import shared_dir
from ..functions.scalar import coalesce_false, nan_to_null, parse_limit_text, time_then_id
from .joins import DEFAULT_ROWS_PER_TASK, hot_from_counts, split_hot_keys_join
from .sequence import ordered_lag
from .streaks import streak_flag

OUT_COLS = [N.PATIENT, N.SAMPLE_ID, N.SAMPLE_TIME, N.CODE, N.VALUE, N.INFNO, N.SEX, N.STOP]

# --- fixed values: clinical analyte codes and default thresholds -------------
NEUTROPHILS = "NPU02902"
CRP = "NPU19748"
LIVER_ENZYME = "NPU19651"
COAGULATION = "NPU01684"
BILIRUBIN = "NPU01370"
CREATININE = "NPU18016"
METHOTREXATE = "NPU02739"
THROMBOCYTES = "NPU03568"
PANCREAS_LIMITS = {"NPU19652": 120.0, "NPU19653": 36.0, "DNK05451": 190.0}
CREA_RISE_FROM_PREVIOUS = 0.3 * 88.42
CREA_FOLD_OVER_BASELINE = 1.5
MTX_36H, MTX_42H, MTX_48H = 20.0, 10.0, 5.0
# --- end fixed values -----------------------------------------------------------


def _subset(df: DataFrame, codes, extra=()) -> DataFrame:
    cols = [c for c in OUT_COLS + list(extra) if c in df.columns]
    return measured(df.filter(F.col(N.CODE).isin(list(codes))).select(*cols))


def measured(df: DataFrame) -> DataFrame:
    """The samples with NaN values as null."""
    return df.withColumn(N.VALUE, nan_to_null(N.VALUE))


def dx_renal(df: DataFrame, code: str = CREATININE, above: float = 150.0) -> DataFrame:
    """Renal toxicity: creatinine above ``above`` on the row itself."""
    d = _subset(df, [code])
    return d.withColumn(N.DETECTION, coalesce_false(F.col(N.VALUE) > F.lit(float(above))))


def dx_neutropenia(df: DataFrame, code: str = NEUTROPHILS, below: float = 0.5,
                   days: float = 10, bucket_hours: float = 24.0) -> DataFrame:
    """Neutropenia: value below ``below`` throughout a run lasting more than ``days``."""
    d = _subset(df, [code]).withColumn(
        N.DETECTION, coalesce_false(F.col(N.VALUE) < F.lit(float(below))))
    return streak_flag(d, N.DETECTION, 24.0 * days, bucket_hours=bucket_hours)


def dx_thrombocytopenia(df: DataFrame, code: str = THROMBOCYTES, below: float = 10.0,
                        hours: float = 72, bucket_hours: float = 24.0) -> DataFrame:
    """Thrombocytopenia: value below ``below`` in a run lasting more than ``hours``."""
    d = _subset(df, [code]).withColumn(
        N.DETECTION, coalesce_false(F.col(N.VALUE) < F.lit(float(below))))
    return streak_flag(d, N.DETECTION, float(hours), bucket_hours=bucket_hours)


def dx_infection(df: DataFrame, code: str = CRP, above: float = 100.0, days: float = 7,
                 limit_col: str = N.REFTEXT, bucket_hours: float = 24.0) -> DataFrame:
    """Severe infection: value above ``above``, or above the row's own limit text
    in a run lasting more than ``days``. The limit text becomes a number column."""
    d = _subset(df, [code], extra=[limit_col]).withColumn(limit_col, parse_limit_text(limit_col))
    d = d.withColumn("_over_limit", coalesce_false(F.col(N.VALUE) > F.col(limit_col)))
    d = streak_flag(d, "_over_limit", 24.0 * days, bucket_hours=bucket_hours)
    det = coalesce_false(F.col(N.VALUE) > F.lit(float(above))) | F.col("_over_limit")
    return d.withColumn(N.DETECTION, det).drop("_over_limit")


def _coincident(df: DataFrame, key_rule, at: str,
                rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """Evaluate a rule once per (patient, at) and give its result to every row there.

    Grouped aggregate (partial on the map side) plus one join back, so rows of
    a crowded key are never gathered in one task: the aggregate also counts
    each key's rows, and keys over ``rows_per_task`` are split in the join.
    """
    keys = [N.PATIENT, at]
    per_key = df.groupBy(*keys).agg(key_rule.alias(N.DETECTION), F.count(F.lit(1)).alias("_n"))
    hot = hot_from_counts(per_key, keys, "_n", rows_per_task)
    out = split_hot_keys_join(df, per_key.drop("_n"), keys, "left", N.SAMPLE_ID, hot=hot)
    return out.withColumn(N.DETECTION, coalesce_false(F.col(N.DETECTION)))


def _mean_of(code: str):
    return F.avg(F.when(F.col(N.CODE) == code, F.col(N.VALUE)))


def dx_hepatic(df: DataFrame, liver: str = LIVER_ENZYME, coagulation: str = COAGULATION,
               bilirubin: str = BILIRUBIN, liver_above: float = 45.0,
               coagulation_below: float = 0.4, bilirubin_above: float = 40.0,
               at: str = N.SAMPLE_TIME, rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """Hepatic effects: at one (patient, ``at``), liver enzyme above its limit AND
    (mean coagulation ratio below its limit OR mean bilirubin above its limit)."""
    d = _subset(df, [liver, coagulation, bilirubin], extra=[at])
    liver_hit = F.bool_or(F.when(F.col(N.CODE) == liver,
                                 coalesce_false(F.col(N.VALUE) > F.lit(float(liver_above)))))
    other_hit = (coalesce_false(_mean_of(coagulation) < F.lit(float(coagulation_below)))
                 | coalesce_false(_mean_of(bilirubin) > F.lit(float(bilirubin_above))))
    return _coincident(d, coalesce_false(liver_hit) & other_hit, at, rows_per_task)


def dx_pancreatitis(df: DataFrame, limits: dict | None = None, times: float = 3.0,
                    crp: str = CRP, crp_above: float = 100.0,
                    at: str = N.SAMPLE_TIME, rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """Pancreatitis: at one (patient, ``at``), any pancreas enzyme mean above
    ``times`` x its normal limit AND mean CRP above ``crp_above``."""
    limits = dict(PANCREAS_LIMITS if limits is None else limits)
    d = _subset(df, list(limits) + [crp], extra=[at]).filter(F.col(N.VALUE).isNotNull())
    enzyme = None
    for code, limit in limits.items():
        hit = coalesce_false(_mean_of(code) > F.lit(float(limit) * float(times)))
        enzyme = hit if enzyme is None else (enzyme | hit)
    rule = enzyme & coalesce_false(_mean_of(crp) > F.lit(float(crp_above)))
    return _coincident(d, rule, at, rows_per_task)


def _before_treatment(code: str):
    return ((F.col(N.CODE) == code) & (F.col(N.INFNO) == 0) & F.col(N.VALUE).isNotNull()
            & F.col(N.HOURS).isNotNull())


def _closest(rows: DataFrame, extremes: DataFrame) -> DataFrame:
    """Baseline of each patient from the rows at its greatest hour difference (``_h`` of
    ``extremes``): the value of the earliest time, then smallest sample id."""
    at = extremes.filter(F.col("_h").isNotNull()).select(F.col(N.PATIENT).alias("_p"), "_h")
    rows = rows.join(at, rows[N.PATIENT].eqNullSafe(F.col("_p")) & (rows[N.HOURS] == F.col("_h")), "left_semi")
    return rows.groupBy(N.PATIENT).agg(
        F.min_by(N.VALUE, time_then_id(N.SAMPLE_TIME, N.SAMPLE_ID)).alias("baseline_crea"))


def baseline_value(df: DataFrame, code: str = CREATININE) -> DataFrame:
    """Per patient, the value of the pre-treatment (INFNO 0) sample closest to
    infusion 1: greatest hour difference, then earliest time, then sample id.

    Two hash aggregates: the greatest difference, then among the rows that have it
    (semi join) the first by one number made of time and id. No row is sorted."""
    rows = measured(df.filter(F.col(N.CODE) == code)).filter(_before_treatment(code))
    return _closest(rows, rows.groupBy(N.PATIENT).agg(F.max(N.HOURS).alias("_h")))


def value_delta(df: DataFrame, keys=(N.PATIENT, N.INFNO, N.CODE), out: str = "prev_value",
                bucket_hours: float = 24.0) -> DataFrame:
    """Previous sample's value within (patient, infusion, code), by time then id."""
    return ordered_lag(df, list(keys), N.SAMPLE_TIME, N.SAMPLE_ID, N.VALUE, out, bucket_hours)


def dx_delayed_elimination(df: DataFrame, crea: str = CREATININE, mtx: str = METHOTREXATE,
                           crea_rise: float = CREA_RISE_FROM_PREVIOUS,
                           crea_fold: float = CREA_FOLD_OVER_BASELINE,
                           mtx_36h: float = MTX_36H, mtx_42h: float = MTX_42H,
                           mtx_48h: float = MTX_48H, bucket_hours: float = 24.0,
                           rows_per_task: int = DEFAULT_ROWS_PER_TASK,
                           baseline_from: DataFrame | None = None) -> DataFrame:
    """Delayed elimination: per (patient, treatment), some creatinine criterion AND
    some methotrexate criterion; the verdict goes to every row of the treatment.

    Creatinine: rise over the previous sample > ``crea_rise``, or value over the
    patient's baseline > ``crea_fold``. Methotrexate (floored hours): [36,42) >
    ``mtx_36h``, [42,48) > ``mtx_42h``, > 48 > ``mtx_48h``. Treatment 0 never
    counts; patients without a baseline leave the result. ``baseline_from`` gives
    other attributed samples for the baseline, such as those before a choice of
    treatments.
    """
    d = measured(df.filter(F.col(N.CODE).isin(crea, mtx) & F.col(N.INFNO).isNotNull()))
    d = (d.filter(F.col(N.VALUE).isNotNull())
           .select(*[c for c in OUT_COLS + [N.HOURS] if c in df.columns]))
    # One per-patient aggregate gives the baseline's hour and the row count that marks
    # hot patients for the join back.
    before = _before_treatment(crea)
    per_patient = d.groupBy(N.PATIENT).agg(F.max(F.when(before, F.col(N.HOURS))).alias("_h"),
                                           F.count(F.lit(1)).alias("_n"))
    hot = hot_from_counts(per_patient, [N.PATIENT], "_n", rows_per_task)
    if baseline_from is not None:
        per_patient = baseline_value(baseline_from, crea)
    else:
        per_patient = _closest(d.filter(before), per_patient)
    d = value_delta(d, bucket_hours=bucket_hours)
    v, h = F.col(N.VALUE), F.col(N.HOURS)
    treated = F.col(N.INFNO) != 0
    crea_row, mtx_row = treated & (F.col(N.CODE) == crea), treated & (F.col(N.CODE) == mtx)
    rise = F.col("prev_value").isNotNull() & (v - F.col("prev_value") > F.lit(crea_rise))
    c345 = (((h >= 36) & (h < 42) & (v > F.lit(mtx_36h)))
            | ((h >= 42) & (h < 48) & (v > F.lit(mtx_42h)))
            | ((h > 48) & (v > F.lit(mtx_48h))))
    per_treatment = d.groupBy(N.PATIENT, N.INFNO).agg(
        F.bool_or(coalesce_false(crea_row & rise)).alias("_rise"),
        F.max(F.when(crea_row, v)).alias("_vmax"), F.min(F.when(crea_row, v)).alias("_vmin"),
        F.bool_or(coalesce_false(mtx_row & c345)).alias("_mtx"))
    # The baseline joins the small per-treatment table, not the rows. For a
    # fixed baseline, value / baseline is monotonic in the value, so "some row
    # over the fold" is the largest value's test (positive baseline) or the
    # smallest's (negative).
    base = F.col("baseline_crea")
    fold = (F.when(base == 0, F.col("_vmax") > 0)
             .when(base > 0, F.col("_vmax") / base > F.lit(crea_fold))
             .otherwise(F.col("_vmin") / base > F.lit(crea_fold)))
    crea_hit = coalesce_false(F.col("_rise") | coalesce_false(fold))
    verdict = per_treatment.join(
        per_patient.filter(base.isNotNull()).select(N.PATIENT, "baseline_crea"), on=N.PATIENT,
        how="inner").select(N.PATIENT, N.INFNO, "baseline_crea",
                            (crea_hit & coalesce_false(F.col("_mtx"))).alias(N.DETECTION))
    # Inner: patients without a baseline leave. The patient-level hot table
    # serves this join: a treatment holds at most its patient's rows.
    return split_hot_keys_join(d, verdict, [N.PATIENT, N.INFNO], "inner", N.SAMPLE_ID, hot=hot)


# --- fixed values: display names -------------------------------------------------
# Registry: display name -> function (the extension point; add entries to extend).
DIAGNOSTICS: dict[str, Callable[..., DataFrame]] = {
    "Neutropenia (NPU02902) Neutrofilocytter": dx_neutropenia,
    "Severe infection (NPU19748)": dx_infection,
    "Severe hepatic effects elevated liver enzyme (NPU19651)": dx_hepatic,
    "Renal toxicity (NPU18016)": dx_renal,
    "Thrombocytopenia (NPU03568)": dx_thrombocytopenia,
    "Pankreatit": dx_pancreatitis,
    "DME": dx_delayed_elimination,
    "HDM": dx_delayed_elimination,
}
# --- end fixed values -----------------------------------------------------------

COMMON_COLS = [N.PATIENT, N.SAMPLE_ID, N.SAMPLE_TIME, N.CODE, N.VALUE, N.INFNO, N.DETECTION]


def run_diagnostics(df: DataFrame, selected: list[tuple[str, dict]],
                    share_input: bool = True) -> DataFrame:
    """Run the chosen diagnostics on the same samples; one long result with the
    diagnostic's name on each row (UNION ALL of the per-diagnostic results).

    With several diagnostics the input is computed once and written as Parquet,
    sorted by analyte code, to the cluster's shared folder. Every diagnostic then
    reads the row groups of its codes and its own columns from that copy, and a lost
    executor does not force a recompute of the lineage.
    """
    if share_input and len(selected) > 1:
        path = shared_dir(df.sparkSession, "samples-by-code")
        df.sortWithinPartitions(N.CODE).write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    # Names that run the same rule with the same parameters (DME and HDM) are
    # computed once; each result row is emitted once per name.
    groups: dict[tuple, tuple] = {}
    for name, kwargs in selected:
        fn = DIAGNOSTICS[name]
        key = (fn, repr(sorted(kwargs.items())))
        groups.setdefault(key, (fn, kwargs, []))[2].append(name)
    out = None
    for fn, kwargs, names in groups.values():
        name_col = (F.lit(names[0]) if len(names) == 1
                    else F.explode(F.array(*[F.lit(n) for n in names])))
        res = fn(df, **kwargs).select(name_col.alias("name"), *COMMON_COLS)
        out = res if out is None else out.unionByName(res)
    return out
