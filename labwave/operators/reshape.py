"""Long <-> wide reshaping of lab samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions.scalar import TIME_BINS, UNBINNED, exact_hours, nan_to_null, time_bin_label, time_then_id
from .diagnostics import CREATININE, METHOTREXATE
from .joins import split_hot_keys_join

DEFAULT_MEASURES = (N.CREA_MEASURE, N.MTX_MEASURE)
MEASURE_CODES = {N.CREA_MEASURE: CREATININE, N.MTX_MEASURE: METHOTREXATE}


def melt_samples(wide: DataFrame, measures=DEFAULT_MEASURES, code_map: dict | None = None,
                 ids: list[str] | None = None) -> DataFrame:
    """Wide samples to long: one row per (sample, measure) with PL_Type, PL_Value
    and the analyte code of the measure (null when the map has none). Nulls stay."""
    code_map = MEASURE_CODES if code_map is None else code_map
    measures = list(measures)
    ids = ids if ids is not None else [c for c in wide.columns if c not in measures]
    long = wide.unpivot(ids, measures, N.MEASURE, N.VALUE).withColumn(N.VALUE, nan_to_null(N.VALUE))
    code = None
    for m, c in code_map.items():
        code = F.when(F.col(N.MEASURE) == m, F.lit(c)) if code is None \
            else code.when(F.col(N.MEASURE) == m, F.lit(c))
    return long.withColumn(N.CODE, code if code is not None else F.lit(None).cast("string"))


def bin_columns(measures=DEFAULT_MEASURES, bins=TIME_BINS, unbinned: str | None = UNBINNED):
    """Matrix column order: measures by name, each by bin order, the unbinned bin last."""
    labels = [label for _, _, label in bins] + ([unbinned] if unbinned is not None else [])
    return [(m, label, f"{m}_{label}") for m in sorted(measures) for label in labels]


def time_bin_pivot(plasma: DataFrame, infusions: DataFrame, measures=DEFAULT_MEASURES,
                   bins=TIME_BINS, unbinned: str | None = UNBINNED,
                   hot: DataFrame | None = None) -> DataFrame:
    """Time matrix: one row per (patient, infusion), one column per (measure, bin)
    holding the earliest non-null value of that measure in that bin.

    Hours are exact fractions from the start of the sample's own infusion (left
    join on patient and infusion number). Bins are declared, so the pivot needs
    no extra pass to discover its columns; rows with no value at all leave.
    ``hot`` may pass patient row counts taken upstream (``joins.hot_keys`` on
    the samples before attribution), so the join needs no count pass over
    ``plasma`` itself.
    """
    inf = infusions.select(N.PATIENT, N.INFNO, F.col(N.INF_START).alias("_inf_start"))
    rows = plasma.filter(F.col(N.PATIENT).isNotNull() & F.col(N.INFNO).isNotNull())
    salt = N.SAMPLE_ID if N.SAMPLE_ID in rows.columns else None
    m = split_hot_keys_join(rows, inf, [N.PATIENT, N.INFNO], "left", salt, hot=hot)
    m = m.withColumns({c: nan_to_null(c) for c in measures})
    m = m.withColumn("_bin", time_bin_label(exact_hours("_inf_start", N.SAMPLE_TIME), bins, unbinned))
    # A sample without an id keeps its value: it comes before those of its time that have one.
    sample = F.coalesce(F.col(N.SAMPLE_ID).cast("long"), F.lit(-(2**63)))
    m = m.withColumn("_order", time_then_id(N.SAMPLE_TIME, sample))
    aggs, present = [], []
    for meas, label, name in bin_columns(measures, bins, unbinned):
        hit = (F.col("_bin") == label) & F.col(meas).isNotNull()
        aggs.append(F.min_by(F.col(meas), F.when(hit, F.col("_order"))).alias(name))
    for meas in measures:
        present.append(F.count(F.when(F.col("_bin").isNotNull(), F.col(meas))))
    total = present[0]
    for p in present[1:]:
        total = total + p
    out = m.groupBy(N.INFNO, N.PATIENT).agg(*aggs, total.alias("_n_values"))
    return out.filter(F.col("_n_values") > 0).drop("_n_values")


def matrix_join(treatments: DataFrame, matrix: DataFrame,
                on=(N.PATIENT, N.INFNO)) -> DataFrame:
    """Left join each treatment row to its time-matrix row on (patient, infusion)."""
    return treatments.join(matrix, on=list(on), how="left")


def pivot_mean(long: DataFrame, keys, codes, value: str = N.VALUE, code: str = N.CODE,
               digits: int = 6) -> DataFrame:
    """Rows per ``keys``, one column per declared code: mean value, rounded."""
    aggs = [F.round(F.avg(F.when(F.col(code) == c, F.col(value))), digits).alias(c) for c in codes]
    return long.filter(F.col(code).isin(list(codes))).groupBy(*keys).agg(*aggs)
