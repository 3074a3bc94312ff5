"""Plan checks on the registered queries: no Python UDF, no cartesian product,
filters and columns pushed into the Parquet scan."""

import pytest

import __spark_entry__ as E
from labwave.plans.oracle import oracles
from labwave.plans.queries import QUERIES, attributed

from .conftest import SF_SMALL

BAD = ["BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct",
       "BroadcastNestedLoopJoin"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_udf_or_cartesian(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    for bad in BAD:
        assert bad not in plan, (key, bad)
    # A window frame ending at unbounded following is re-evaluated for every
    # row (quadratic per partition); "everything after" uses reversed running frames.
    assert "unboundedfollowing" not in plan.lower(), key


def test_filters_and_columns_pushed_to_scan(spark):
    plan = _plan(attributed(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,signup))]" in plan
    # The treatments' scan leaves out the samples' columns.
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan \
        .replace(",value:double>", ">")


def test_one_patient_is_cut_down_at_the_scan(spark):
    for key in ("patient_samples", "elimination_curve"):
        plan = _plan(QUERIES[key](spark, SF_SMALL))
        scans = [x for x in plan.split("\n") if "FileScan" in x and "event_type" in x]
        assert scans and all("EqualTo(user_id,7)" in x for x in scans), key


def test_rules_read_their_codes_from_the_shared_copy(spark):
    plan = _plan(QUERIES["run_diagnostics"](spark, SF_SMALL))
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert scans and all("samples-by-code" in x and "IUPAC_CODE" in x.split("PushedFilters")[1] for x in scans)
    assert not any("REFTEXT" in x.split("ReadSchema")[1] for x in scans if "error" not in x)


def test_time_matrix_is_a_hash_aggregate(spark):
    for key in ("time_bin_pivot", "matrix_join"):
        plan = _plan(QUERIES[key](spark, SF_SMALL))
        assert "SortAggregate" not in plan and "HashAggregate" in plan, key


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["NOPHO_NR"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(oracles())
