from datetime import datetime

import pytest
from pyspark.sql import functions as F

from labwave import names as N
from labwave.operators.attribute import (attribute_samples, drop_duplicate_patients,
                                         duplicate_treatments)

from .conftest import hours


def _run(samples, infusions, srows, irows, **kw):
    out = attribute_samples(samples(srows), infusions(irows), **kw)
    return {r[N.SAMPLE_ID]: r for r in out.collect()}


def test_attribution_hand_case(samples, infusions):
    irows = [(1, 1, 1, 0, datetime(2024, 1, 1, 10)), (1, 2, 1, 1, datetime(2024, 1, 10, 10))]
    srows = [(1, 0, datetime(2024, 1, 1, 8, 30), "c", 1.0),
             (1, 1, datetime(2024, 1, 1, 10), "c", 1.0),
             (1, 2, datetime(2024, 1, 5, 10), "c", 1.0),
             (1, 3, datetime(2024, 1, 10, 10), "c", 1.0)]
    got = _run(samples, infusions, srows, irows)
    assert [(got[i][N.INFNO], got[i][N.HOURS]) for i in range(4)] == [(0, -2.0), (1, 0.0), (1, 96.0), (2, 0.0)]
    assert got[0][N.INF_DATE] == datetime(2024, 1, 1, 10)
    assert [got[i][N.STOP] for i in range(4)] == [None, 0, 0, 1]
    assert all(got[i][N.SEX] == 1 for i in range(4))


def test_highest_number_not_latest_start(samples, infusions):
    irows = [(1, 1, 0, 0, hours(10)), (1, 2, 0, 0, hours(0))]
    got = _run(samples, infusions, [(1, 0, hours(20), "c", 1.0)], irows)
    assert got[0][N.INFNO] == 2 and got[0][N.HOURS] == 20.0
    assert got[0][N.SEX] is None  # 0 is unknown


def test_no_infusion_one_gives_null_before(samples, infusions):
    got = _run(samples, infusions, [(1, 0, hours(0), "c", 1.0), (1, 1, hours(20), "c", 1.0)],
               [(1, 3, 0, 0, hours(10))])
    assert got[0][N.INFNO] is None and got[1][N.INFNO] == 3


def test_infusion_nine_is_ignored_and_missing_patient(samples, infusions):
    got = _run(samples, infusions, [(1, 0, hours(20), "c", 1.0), (2, 1, hours(20), "c", 1.0)],
               [(1, 9, 0, 0, hours(10))])
    assert got[0][N.INFNO] is None and got[0][N.INF_DATE] is None
    assert got[1][N.INFNO] is None


def test_two_sexes_double_rows(samples, infusions):
    out = attribute_samples(samples([(1, 0, hours(5), "c", 1.0)]),
                            infusions([(1, 1, 1, 0, hours(0)), (1, 2, 2, 0, hours(3))]))
    assert sorted(r[N.SEX] for r in out.collect()) == [1, 2]


def test_repeated_treatment_number(spark, samples, infusions):
    inf = infusions([(1, 1, 1, 0, hours(0)), (1, 1, 1, 0, hours(5)), (2, 1, 1, 0, hours(0))])
    s = samples([(1, 0, hours(6), "c", 1.0), (2, 1, hours(6), "c", 1.0)])
    with pytest.raises(Exception, match="repeated treatment number"):
        attribute_samples(s, inf).collect()
    got = {r[N.SAMPLE_ID]: r[N.INFNO] for r in attribute_samples(s, inf, on_duplicate="drop_patient").collect()}
    assert got == {0: None, 1: 1}
    assert [r[N.PATIENT] for r in duplicate_treatments(inf).collect()] == [1]
    assert sorted(r[N.PATIENT] for r in drop_duplicate_patients(inf).collect()) == [2]


def test_each_sample_attributed_once(spark):
    from labwave.plans.queries import attributed
    from .conftest import SF_SMALL
    a = attributed(spark, SF_SMALL)
    dup = a.groupBy(N.SAMPLE_ID).count().filter(F.col("count") > 1).count()
    assert dup == 0
