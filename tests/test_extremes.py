"""Row of the extreme and sums over all rules, by hash aggregates."""

import pytest

from labwave import names as N
from labwave.operators import diagnostics as X
from labwave.operators import reshape as R
from labwave.plans.queries import QUERIES

from .conftest import SF_ORACLE, SF_SMALL, T0, hours


def test_baseline_ties_go_by_time_then_id(spark):
    rows = [(1, 5, hours(-1), "NPU18016", 7.0, 0, -2.0), (1, 4, hours(-1.5), "NPU18016", 6.0, 0, -2.0), (1, 3, hours(-1.5), "NPU18016", 5.0, 0, -2.0),
            (1, 9, hours(-9), "NPU18016", 1.0, 0, -9.0), (1, 1, hours(-1.6), "NPU18016", None, 0, -2.0), (1, 2, hours(3), "NPU18016", 8.0, 1, 3.0),
            (2, 6, hours(-1), "NPU18016", 2.0, 0, None), (None, -3, hours(-3), "NPU18016", 4.0, 0, -3.0), (None, -2, hours(-3), "NPU18016", 3.0, 0, -3.0),
            (3, 2 ** 62, T0, "NPU18016", 1.5, 0, -1.0), (3, -2 ** 62, T0, "NPU18016", 2.5, 0, -1.0)]
    df = spark.createDataFrame(rows, f"{N.PATIENT} long, {N.SAMPLE_ID} long, {N.SAMPLE_TIME} timestamp_ntz, {N.CODE} string, {N.VALUE} double, {N.INFNO} int, {N.HOURS} double")
    got = {r[N.PATIENT]: r["baseline_crea"] for r in X.baseline_value(df).collect()}
    assert got == {1: 5.0, None: 4.0, 3: 2.5}


@pytest.mark.parametrize("key", ["baseline_value", "dx_delayed_elimination"])
def test_no_row_is_sorted_for_an_extreme(spark, key):
    assert "SortAggregate" not in QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_a_sample_without_id_fills_its_cell(spark):
    plasma = spark.createDataFrame([(1, 1, None, hours(1), 5.0, None), (1, 1, 8, hours(1), 6.0, 2.0), (1, 1, 7, hours(2), 4.0, 3.0)],
                                   f"{N.PATIENT} long, {N.INFNO} int, {N.SAMPLE_ID} long, {N.SAMPLE_TIME} timestamp_ntz, {N.CREA_MEASURE} double, {N.MTX_MEASURE} double")
    infusions = spark.createDataFrame([(1, 1, hours(0))], f"{N.PATIENT} long, {N.INFNO} int, {N.INF_START} timestamp_ntz")
    (row,) = R.time_bin_pivot(plasma, infusions).collect()
    assert (row[f"{N.CREA_MEASURE}_Time0"], row[f"{N.MTX_MEASURE}_Time0"]) == (5.0, 2.0)


def test_counts_over_all_rules(spark):
    row = QUERIES["phenotype_counts"](spark, SF_ORACLE).first()
    assert min(row) > 0 and row["n_patients"] == row["n_positive"] + row["n_negative"]
