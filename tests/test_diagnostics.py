from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from labwave import names as N
from labwave.operators import diagnostics as X
from labwave.operators import rollup as U
from labwave.operators.attribute import attribute_samples

from .conftest import hours


def _det(df):
    return {r[N.SAMPLE_ID]: r[N.DETECTION] for r in df.collect()}


def test_renal(samples):
    d = X.dx_renal(samples([(1, 0, hours(0), X.CREATININE, 151.0), (1, 1, hours(1), X.CREATININE, 150.0),
                            (1, 2, hours(2), "other", 999.0)]))
    assert _det(d) == {0: True, 1: False}


def test_hepatic_needs_same_time(samples):
    same = samples([(1, 0, hours(0), X.LIVER_ENZYME, 46.0), (1, 1, hours(0), X.COAGULATION, 0.3)])
    assert _det(X.dx_hepatic(same)) == {0: True, 1: True}
    apart = samples([(1, 0, hours(0), X.LIVER_ENZYME, 46.0),
                     (1, 1, hours(0) + timedelta(minutes=1), X.COAGULATION, 0.3)])
    assert _det(X.dx_hepatic(apart)) == {0: False, 1: False}


def test_hepatic_null_coagulation_is_false(samples):
    d = X.dx_hepatic(samples([(1, 0, hours(0), X.COAGULATION, None)]))
    assert _det(d) == {0: False}


@pytest.mark.parametrize("crp,want", [(101.0, True), (100.0, False)])
def test_pancreatitis(samples, crp, want):
    d = X.dx_pancreatitis(samples([(1, 0, hours(0), "NPU19652", 361.0), (1, 1, hours(0), X.CRP, crp)]))
    assert set(_det(d).values()) == {want}


def test_infection_limit_streak(samples):
    rows = [(1, 0, hours(0), X.CRP, 9.0, "<8,0"), (1, 1, hours(200), X.CRP, 9.0, "<8,0"),
            (2, 2, hours(0), X.CRP, 101.0, None)]
    assert _det(X.dx_infection(samples(rows))) == {0: True, 1: True, 2: True}
    short = [(1, 0, hours(0), X.CRP, 9.0, "<8,0"), (1, 1, hours(100), X.CRP, 9.0, "<8,0")]
    assert _det(X.dx_infection(samples(short))) == {0: False, 1: False}


def test_neutropenia_and_thrombocytopenia(samples):
    rows = [(1, 0, hours(0), X.NEUTROPHILS, 0.1), (1, 1, hours(241), X.NEUTROPHILS, 0.2)]
    assert _det(X.dx_neutropenia(samples(rows))) == {0: True, 1: True}
    rows = [(1, 0, hours(0), X.THROMBOCYTES, 5.0), (1, 1, hours(72), X.THROMBOCYTES, 5.0)]
    assert _det(X.dx_thrombocytopenia(samples(rows))) == {0: False, 1: False}


def _dme_case(samples, infusions, mtx_infusion_start, mtx_hours, mtx_value):
    inf = infusions([(1, 1, 1, 0, hours(0)), (1, 2, 1, 0, hours(500))])
    rows = [(1, 0, hours(-5), X.CREATININE, 50.0),
            (1, 1, hours(10), X.CREATININE, 76.0),
            (1, 2, hours(mtx_infusion_start + mtx_hours), X.METHOTREXATE, mtx_value)]
    return attribute_samples(samples(rows), inf)


def test_dme_same_infusion(samples, infusions):
    d = X.dx_delayed_elimination(_dme_case(samples, infusions, 0, 36, 21.0))
    got = {r[N.SAMPLE_ID]: (r[N.INFNO], r[N.DETECTION]) for r in d.collect()}
    assert got == {0: (0, False), 1: (1, True), 2: (1, True)}


def test_dme_other_infusion(samples, infusions):
    d = X.dx_delayed_elimination(_dme_case(samples, infusions, 500, 36, 21.0))
    assert not any(_det(d).values())


def test_dme_floored_hours_gap(samples, infusions):
    d = X.dx_delayed_elimination(_dme_case(samples, infusions, 0, 48.5, 6.0))
    assert not any(_det(d).values())


def test_dme_needs_baseline(samples, infusions):
    inf = infusions([(1, 1, 1, 0, hours(0))])
    rows = [(1, 1, hours(10), X.CREATININE, 76.0), (1, 2, hours(36), X.METHOTREXATE, 30.0)]
    assert X.dx_delayed_elimination(attribute_samples(samples(rows), inf)).count() == 0


def test_phenotype_any_positive(samples):
    s = samples([(1, 0, hours(0), X.CREATININE, 200.0), (2, 1, hours(0), X.CREATININE, 1.0),
                 (1, 2, hours(0), X.THROMBOCYTES, 50.0)]).withColumn(N.INFNO, F.lit(None).cast("int")) \
        .withColumn(N.SEX, F.lit(None).cast("int")).withColumn(N.STOP, F.lit(None).cast("int"))
    u = X.run_diagnostics(s, [("Renal toxicity (NPU18016)", {}), ("Thrombocytopenia (NPU03568)", {})])
    ph = {r[N.PATIENT]: r[N.PHENOTYPE] for r in U.patient_phenotype(u).collect()}
    assert ph == {1: 1, 2: 0}
    counts = U.phenotype_counts(U.patient_phenotype(u)).first()
    assert counts["n_patients"] == counts["n_positive"] + counts["n_negative"] == 2
    summ = {(r["name"], r["type"]): r["number_of_patients"] for r in U.summary_detection(u).collect()}
    assert summ[("Renal toxicity (NPU18016)", U.POSITIVE)] == 1
    assert summ[("Thrombocytopenia (NPU03568)", U.NEGATIVE)] == 1


def test_registered_diagnostics_have_both_classes(spark):
    from labwave.plans.queries import DX_PARAMS, dx
    from .conftest import SF_ORACLE
    for key in DX_PARAMS:
        classes = {r[0] for r in dx(spark, SF_ORACLE, key).select(N.DETECTION).distinct().collect()}
        assert classes == {True, False}, key


def test_delayed_elimination_baseline_signs_and_nan(spark):
    """Fold over baseline decided per treatment from its largest / smallest value:
    same verdicts as the per-row rule for negative and zero cases; a NaN is no
    measurement, so its row leaves, as a value and as a baseline."""
    nan = float("nan")
    crea, mtx = X.CREATININE, X.METHOTREXATE
    rows = []

    def add(p, code, value, infno, h):
        rows.append((p, len(rows), hours(h + 100 * infno), code, value, infno, float(h)))

    for p, base, creas, want in [(1, -10.0, [-20.0], True), (2, -10.0, [-12.0, -5.0], False),
                                 (3, 0.0, [0.0], False), (4, 50.0, [nan], False),
                                 (5, -10.0, [nan, -5.0], False), (6, 50.0, [74.0, 76.0], True),
                                 (7, 50.0, [75.0], False)]:
        add(p, crea, base, 0, -5)
        for i, c in enumerate(creas):
            add(p, crea, c, 1, 1 + i)
        add(p, mtx, 25.0, 1, 37)
    add(3, crea, 1.0, 2, 1)
    add(3, mtx, 25.0, 2, 37)
    df = spark.createDataFrame(rows, f"{N.PATIENT} long, {N.SAMPLE_ID} long, {N.SAMPLE_TIME} timestamp_ntz, "
                                     f"{N.CODE} string, {N.VALUE} double, {N.INFNO} int, {N.HOURS} double")
    got = {}
    for r in X.dx_delayed_elimination(df).collect():
        got.setdefault((r[N.PATIENT], r[N.INFNO]), set()).add(r[N.DETECTION])
    assert got == {(1, 0): {False}, (1, 1): {True}, (2, 0): {False}, (2, 1): {False},
                   (3, 0): {False}, (3, 1): {False}, (3, 2): {True}, (4, 0): {False}, (4, 1): {False},
                   (5, 0): {False}, (5, 1): {False}, (6, 0): {False}, (6, 1): {True},
                   (7, 0): {False}, (7, 1): {False}}


def test_nan_is_no_detection(spark, samples):
    nan = float("nan")
    rows = [(p, None, hours(h), code, nan, "<8,0") for p in (1, 2) for h in (0, 100, 400)
            for code in (X.CREATININE, X.NEUTROPHILS, X.THROMBOCYTES, X.CRP, X.LIVER_ENZYME, X.BILIRUBIN, "NPU19652")]
    df = samples(rows).withColumns({N.INFNO: F.lit(0), N.HOURS: F.lit(-1.0)})
    for rule in (X.dx_renal, X.dx_neutropenia, X.dx_thrombocytopenia, X.dx_infection, X.dx_hepatic, X.dx_pancreatitis):
        assert rule(df).filter(N.DETECTION).count() == 0, rule.__name__
    assert X.baseline_value(df).count() == 0


def test_baseline_from_other_samples(spark):
    crea, mtx = X.CREATININE, X.METHOTREXATE
    schema = (f"{N.PATIENT} long, {N.SAMPLE_ID} long, {N.SAMPLE_TIME} timestamp_ntz, {N.CODE} string, "
              f"{N.VALUE} double, {N.INFNO} int, {N.HOURS} double")
    every = spark.createDataFrame([(1, 1, hours(0), crea, 50.0, 0, -5.0), (1, 2, hours(10), crea, 76.0, 1, 1.0),
                                   (1, 3, hours(50), mtx, 25.0, 1, 37.0)], schema)
    chosen = every.filter(F.col(N.INFNO) == 1)
    assert X.dx_delayed_elimination(chosen).count() == 0
    got = X.dx_delayed_elimination(chosen, baseline_from=every).collect()
    assert len(got) == 2 and all(r[N.DETECTION] for r in got)
