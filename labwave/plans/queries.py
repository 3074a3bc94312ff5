"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Each reads whole driver tables through ``plans.driver`` and applies one library
operator with parameters chosen for the driver data's value range (the
functions' own defaults stay the clinical ones).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .. import names as N
from ..functions import scalar as S
from ..operators import attribute as A
from ..operators import codebook as CB
from ..operators import clean as C
from ..operators import diagnostics as X
from ..operators import reshape as R
from ..operators import rollup as U
from ..operators import sampling as SM
from ..operators import streaks as ST
from ..operators import text as T
from ..operators.joins import DEFAULT_ROWS_PER_TASK, hot_keys
from ..operators.sequence import ordered_row_number
from ..sources import catalog as CAT
from ..sources import files as FS
from ..sources import sql as SQ
from . import driver as D

PL_DAY = "PL_DAY"
CHART_PATIENT = 7  # the patient shown by the one-patient chart queries

# Parameters of each diagnostic on the driver data (codes are event types).
DX_PARAMS: dict[str, tuple[str, dict]] = {
    "dx_neutropenia": ("Neutropenia (NPU02902) Neutrofilocytter",
                       dict(code="click", below=100.0, days=2)),
    "dx_infection": ("Severe infection (NPU19748)", dict(code="error", above=200.0, days=1)),
    "dx_hepatic": ("Severe hepatic effects elevated liver enzyme (NPU19651)",
                   dict(liver="view", coagulation="click", bilirubin="purchase",
                        liver_above=45.0, coagulation_below=20.0, bilirubin_above=40.0,
                        at=PL_DAY)),
    "dx_renal": ("Renal toxicity (NPU18016)", dict(code="click", above=150.0)),
    "dx_thrombocytopenia": ("Thrombocytopenia (NPU03568)",
                            dict(code="view", below=30.0, hours=24)),
    "dx_pancreatitis": ("Pankreatit", dict(limits={"view": 20.0, "click": 20.0, "purchase": 20.0},
                                           times=3.0, crp="error", crp_above=50.0, at=PL_DAY)),
    "dx_delayed_elimination": ("DME", dict(crea=D.CREA_EVENT, mtx=D.MTX_EVENT)),
}
#: Stricter limits for the counts over all rules, so that some patients are negative.
STRICT: dict[str, dict] = {
    "dx_neutropenia": dict(below=60.0, days=6),
    "dx_infection": dict(above=450.0, days=4),
    "dx_hepatic": dict(liver_above=200.0, coagulation_below=5.0, bilirubin_above=200.0),
    "dx_renal": dict(above=400.0),
    "dx_thrombocytopenia": dict(below=10.0, hours=60),
    "dx_pancreatitis": dict(times=10.0, crp_above=150.0),
}
#: run_diagnostics also gives the delayed-elimination verdicts under their second name.
ALL_DX = [*DX_PARAMS.values(), ("HDM", dict(crea=D.CREA_EVENT, mtx=D.MTX_EVENT))]


# ---------------------------------------------------------------- shared inputs
def infusions(spark, d) -> DataFrame:
    return C.clean_infusions(D.treatment_table(spark, d))


def attributed(spark, d) -> DataFrame:
    s = D.samples(spark, d).withColumn(PL_DAY, S.day_start(N.SAMPLE_TIME))
    return A.attribute_samples(s, infusions(spark, d))


def block_infusions(spark, d) -> DataFrame:
    """Treatments numbered by the patient's distinct signup hours: two signups in
    one hour share a number, so some patients repeat a (patient, number)."""
    e = D.load(spark, d, "events").filter(F.col("event_type") == D.SIGNUP)
    e = e.select(F.col("user_id").alias(N.PATIENT), F.col("ts").alias(N.INF_START),
                 F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("_hour"))
    hours = e.select(N.PATIENT, "_hour").distinct().withColumn("_hid", F.lit(0))
    hours = ordered_row_number(hours, [N.PATIENT], "_hour", "_hid", N.INFNO)
    return e.join(hours.drop("_hid"), on=[N.PATIENT, "_hour"], how="inner").drop("_hour")


def plasma_attributed(spark, d) -> DataFrame:
    plasma = C.clean_samples(D.plasma_table(spark, d))
    return A.attribute_samples(plasma, infusions(spark, d))


def plasma_hot(spark, d) -> DataFrame:
    """Hot patients of the plasma samples, counted before attribution (the same
    count attribution takes, so Spark reuses it)."""
    return hot_keys(C.clean_samples(D.plasma_table(spark, d)), [N.PATIENT], DEFAULT_ROWS_PER_TASK)


def matrix(spark, d) -> DataFrame:
    return R.time_bin_pivot(plasma_attributed(spark, d), infusions(spark, d), hot=plasma_hot(spark, d))


def dx(spark, d, key) -> DataFrame:
    name, params = DX_PARAMS[key]
    return X.DIAGNOSTICS[name](attributed(spark, d), **params)


def all_dx(spark, d) -> DataFrame:
    return X.run_diagnostics(attributed(spark, d), ALL_DX)


# ---------------------------------------------------------------- queries
def q_scan_uppercase(spark, d):
    return C.normalize_columns(D.load(spark, d, "orders"), "upper")


def q_normalize_columns(spark, d):
    p = D.load(spark, d, "part")
    return C.normalize_columns(p.toDF(*[c.upper().replace("_", "\xa0") for c in p.columns]), "lower")


def _docs_labels(spark, d):
    return D.load(spark, d, "documents") \
        .join(D.load(spark, d, "labels"), on="doc_id", how="left")


def _unused(df: DataFrame) -> DataFrame:
    """A column without any value, as wide clinical exports have them."""
    return df.withColumn("unused", F.lit(None).cast("string"))


def q_drop_null_rows(spark, d):
    return C.drop_null_rows(_docs_labels(spark, d), ["quality", "toxic"])


def q_drop_null_columns(spark, d):
    return C.drop_null_columns(_unused(_docs_labels(spark, d)))


def q_drop_sparse_columns(spark, d):
    return C.drop_sparse_columns(_unused(_docs_labels(spark, d)), min_share=0.5)


def q_declared_casts(spark, d):
    e = D.load(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("props_k"),
        F.col("event_type").alias("kind"))
    return C.declared_casts(e, {"props_k": "int", "kind": "int"})


def q_clean_strings(spark, d):
    c = D.load(spark, d, "conversations")
    return C.clean_strings(c.withColumns({
        "text": F.concat(F.lit("\u00a0 "), "text", F.lit(" \t\u2003")),
        "role": F.when(F.col("turn") > 0, F.concat(F.lit("\n"), "role"))}))


def q_combine_date_time(spark, d):
    o = D.load(spark, d, "orders")
    t = F.timestamp_add("SECOND", F.col("o_orderkey"), F.col("o_orderdate"))
    return o.select("o_orderkey", S.combine_date_time("o_orderdate", t).alias("combined"))


def q_clean_samples(spark, d):
    return C.clean_samples(D.plasma_table(spark, d))


def q_clean_infusions(spark, d):
    return infusions(spark, d)


def q_parse_limit_text(spark, d):
    return D.samples(spark, d).select(N.SAMPLE_ID, N.REFTEXT,
                                      S.parse_limit_text(N.REFTEXT).alias("limit_value"))


def q_concat_values(spark, d):
    dl = _docs_labels(spark, d)
    return dl.select("doc_id", S.concat_values("lang", "source", "quality", "toxic").alias("joined"))


def q_melt_samples(spark, d):
    return R.melt_samples(C.clean_samples(D.plasma_table(spark, d)))


def q_time_bin_label(spark, d):
    a = plasma_attributed(spark, d)
    h = S.exact_hours(N.INF_DATE, N.SAMPLE_TIME)
    return a.select(N.SAMPLE_ID, h.alias("TIME_DIFF"), S.time_bin_label(h).alias("TIME_GROUP"))


def q_time_bin_pivot(spark, d):
    return matrix(spark, d)


def q_matrix_join(spark, d):
    return R.matrix_join(infusions(spark, d), matrix(spark, d))


def q_filter_infusions(spark, d):
    return C.filter_infusions(attributed(spark, d), [1, 2, 3])


def q_attribute_samples(spark, d):
    return attributed(spark, d).drop(PL_DAY)


def q_attach_sex(spark, d):
    return A.attach_sex(D.samples(spark, d), infusions(spark, d))


def q_attach_stop_flag(spark, d):
    a = attributed(spark, d).select(N.PATIENT, N.SAMPLE_ID, N.INFNO)
    # The same count that attribution takes, so Spark reuses it.
    hot = hot_keys(D.samples(spark, d).withColumn(PL_DAY, S.day_start(N.SAMPLE_TIME)), [N.PATIENT], DEFAULT_ROWS_PER_TASK)
    return A.attach_stop_flag(a, infusions(spark, d), hot)


def q_duplicate_treatments(spark, d):
    return A.duplicate_treatments(block_infusions(spark, d))


def q_drop_duplicate_patients(spark, d):
    return A.drop_duplicate_patients(block_infusions(spark, d))


def q_distinct_treatments(spark, d):
    loaded = block_infusions(spark, d)
    return A.distinct_treatments(loaded.unionByName(loaded))  # as from two loads


def _flagged(spark, d, code="click", below=100.0):
    s = D.samples(spark, d).filter(F.col(N.CODE) == code)
    return s.select(N.PATIENT, N.SAMPLE_ID, N.SAMPLE_TIME, N.VALUE,
                    S.coalesce_false(F.col(N.VALUE) < below).alias(N.DETECTION))


def q_streak_id(spark, d):
    return ST.streak_id(_flagged(spark, d), N.DETECTION)


def q_streak_groups(spark, d):
    return ST.streak_groups(_flagged(spark, d), N.DETECTION)


def q_streak_flag(spark, d):
    return ST.streak_flag(_flagged(spark, d), N.DETECTION, 48.0)


def q_value_delta(spark, d):
    a = attributed(spark, d).filter(F.col(N.INFNO).isNotNull())
    return X.value_delta(a.select(N.PATIENT, N.SAMPLE_ID, N.SAMPLE_TIME, N.CODE, N.VALUE, N.INFNO))


def q_baseline_value(spark, d):
    return X.baseline_value(attributed(spark, d), D.CREA_EVENT)


def q_pivot_mean(spark, d):
    s = D.samples(spark, d).withColumn(PL_DAY, S.day_start(N.SAMPLE_TIME))
    return R.pivot_mean(s, [N.PATIENT, PL_DAY], ["click", "purchase", "view", "error"])


def q_detected_patients(spark, d):
    return U.detected_patients(dx(spark, d, "dx_renal"))


def q_run_diagnostics(spark, d):
    return all_dx(spark, d)


def q_patient_phenotype(spark, d):
    return U.patient_phenotype(all_dx(spark, d))


def q_summary_detection(spark, d):
    return U.summary_detection(all_dx(spark, d))


def q_phenotype_counts(spark, d):
    strict = [(name, {**params, **STRICT.get(key, {})}) for key, (name, params) in DX_PARAMS.items()]
    return U.phenotype_counts(U.patient_phenotype(X.run_diagnostics(attributed(spark, d), strict)))


def q_patients_in_scope(spark, d):
    return U.patients_in_scope(C.filter_infusions(attributed(spark, d), [1, 2, 3, 4]), D.MTX_EVENT)


def q_cleaning_report(spark, d):
    raw = D.plasma_table(spark, d)
    return C.cleaning_report(raw, C.SAMPLE_KEYS, len(C.clean_samples(raw).columns))


def q_sorted_samples(spark, d):
    return D.samples(spark, d).orderBy(N.PATIENT, N.SAMPLE_TIME, N.SAMPLE_ID)


def q_sample_rows(spark, d):
    a = attributed(spark, d).filter(F.col(N.INFNO).isNotNull()).drop(PL_DAY)
    return SM.sample_rows(a, 100, seed=42)


def q_sample_with_replacement(spark, d):
    return SM.sample_with_replacement(attributed(spark, d).drop(PL_DAY), 100, seed=42)


def q_chart_samples(spark, d):
    return U.chart_samples(dx(spark, d, "dx_renal"))


def q_detected_samples(spark, d):
    return U.detected_samples(dx(spark, d, "dx_neutropenia"))


def _one_patient(spark, d) -> DataFrame:
    """One patient's attributed samples: both tables are cut down before attribution."""
    one = F.col(N.PATIENT) == CHART_PATIENT
    s = D.samples(spark, d).filter(one).withColumn(PL_DAY, S.day_start(N.SAMPLE_TIME))
    return A.attribute_samples(s, C.clean_infusions(D.treatment_table(spark, d, one)))


def q_patient_samples(spark, d):
    name, params = DX_PARAMS["dx_neutropenia"]
    return U.patient_samples(X.DIAGNOSTICS[name](_one_patient(spark, d), **params), CHART_PATIENT)


def q_elimination_curve(spark, d):
    return U.elimination_curve(_one_patient(spark, d), CHART_PATIENT, D.MTX_EVENT)


def q_chunk_text(spark, d):
    return T.chunk_text(D.load(spark, d, "documents"), "doc_id", "text", 4096)


def q_concat_group_text(spark, d):
    return T.concat_group_text(D.load(spark, d, "conversations"), piece_chars=4096)


# ---------------------------------------------------------------- codebooks
def _json_details(df, col="details", out="details_json"):
    return df.withColumn(out, F.to_json(col)).drop(col)


def codebook_codes(spark, d):
    return CB.codebook_split(D.codebook_sheet(spark, d))


def codebook_maps(spark, d):
    return CB.codebook_maps(codebook_codes(spark, d))


def described_parts(spark, d):
    return CB.describe_columns(D.part_columns(spark, d), D.description_sheet(spark, d),
                               tie="row_tb")


def q_codebook_split(spark, d):
    return codebook_codes(spark, d)


def q_codebook_maps(spark, d):
    return _json_details(codebook_maps(spark, d))


def q_describe_columns(spark, d):
    return _json_details(described_parts(spark, d))


def q_merge_descriptions(spark, d):
    merged = CB.merge_descriptions(described_parts(spark, d), D.part_descriptions(spark, d))
    return _json_details(merged)


def q_descriptions_flatten(spark, d):
    m = codebook_maps(spark, d)
    doc = F.to_json(F.create_map(F.lit("lineitem"), F.create_map(
        F.col("column_name"), F.struct("description", "details"))))
    return _json_details(CB.descriptions_flatten(m.select(doc.alias("value"))))


def q_codebook_write(spark, d):
    path = FS.write_codebook(codebook_maps(spark, d), FS.shared_dir(spark, "codebook"))
    back = FS.read_codebook(spark, path)
    return _json_details(back.withColumn("n_codes", F.size("details").cast("long")))


def q_codebook_scan(spark, d):
    path = FS.write_codebook(codebook_maps(spark, d), FS.shared_dir(spark, "codebook"))
    return CB.codebook_rows(FS.read_codebook(spark, path))


def q_codebook_combine(spark, d):
    a = FS.write_codebook(codebook_maps(spark, d), FS.shared_dir(spark, "codebook-orders"))
    b = FS.write_codebook(described_parts(spark, d), FS.shared_dir(spark, "codebook-parts"))
    out = FS.combine_codebooks(spark, [a, b], FS.shared_dir(spark, "codebook-combined"))
    return out.select("column_name", "description",
                      F.size("details").cast("long").alias("n_details"))


# ---------------------------------------------------------------- catalog, SQL, sinks
def q_key_containment(spark, d):
    # The link list is catalog metadata (a handful of rows), not data.
    linked = CAT.key_links(CAT.list_columns(spark, d, SQ.DRIVER_TABLES))
    links = [(r["column_name"], r["tables"].split(",")) for r in linked.collect()]
    return CAT.key_containment(spark, d, links)


ADHOC_SQL = """SELECT e.event_type, c.c_mktsegment, count(*) AS n_events,
  count(DISTINCT e.user_id) AS n_users, round(avg(e.value), 6) AS avg_value
FROM events e JOIN customer c ON c.c_custkey = e.user_id
GROUP BY e.event_type, c.c_mktsegment"""

PARAM_SQL = """SELECT user_id, count(*) AS n_events, max(value) AS max_value
FROM events WHERE event_type = [event type] AND value > [min value] GROUP BY user_id"""
PARAM_VALUES = {"event type": "click", "min value": 100.0}


def q_sql_adhoc(spark, d):
    SQ.register_tables(spark, d)
    return SQ.sql_adhoc(spark, ADHOC_SQL)


def q_sql_params(spark, d):
    SQ.register_tables(spark, d)
    return SQ.sql_params(spark, PARAM_SQL, PARAM_VALUES)


def q_csv_roundtrip(spark, d):
    docs = D.load(spark, d, "documents")
    return FS.csv_roundtrip(spark, docs, "documents-export")


def q_table_append(spark, d):
    """Two loads, the second of them run twice: its rows are there once."""
    table = f"labwave_load_{uuid.uuid4().hex[:12]}"
    first = F.col(N.INFNO) <= 4
    for batch, rows in (("low", first), ("high", ~first), ("high", ~first)):
        FS.table_append(spark, infusions(spark, d).filter(rows), table, batch=batch)
    return FS.drop_table(spark, table)


def _text_events(spark, d) -> DataFrame:
    """Events as an export of unknown types: all text, one column of mixed values, one
    with gaps, one without any value."""
    e = D.load(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("value").cast("string").alias("value"),
        F.when(F.col("event_type") != D.SIGNUP, F.col("user_id").cast("string")).alias("patient"),
        F.when(F.col("event_type") == D.SIGNUP, F.col("event_type")).otherwise(k).alias("mixed"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(None).cast("string").alias("unused"))


def q_csv_types(spark, d):
    path = FS.write_csv(_text_events(spark, d), FS.shared_dir(spark, "events-export"))
    text = T_.StructType([T_.StructField(c, T_.StringType()) for c in ("event_id", "value", "patient", "mixed", "day", "unused")])
    return FS.type_profile(FS.read_csv(spark, path, text), FS.LADDER + FS.DATES)


def q_csv_inferred(spark, d):
    return FS.read_csv_inferred(spark, FS.write_csv(_text_events(spark, d), FS.shared_dir(spark, "events-export")))


def q_csv_rejects(spark, d):
    path = FS.write_csv(_text_events(spark, d).select("event_id", "mixed"), FS.shared_dir(spark, "events-export"))
    good, bad = FS.read_csv_rejects(spark, path, T_.StructType([T_.StructField("event_id", T_.LongType()), T_.StructField("mixed", T_.IntegerType())]))
    return good.withColumn("record", F.lit(None).cast("string")).unionByName(bad)


def _dx_query(key):
    def run(spark, d):
        return dx(spark, d, key)
    run.__name__ = f"q_{key}"
    return run


QUERIES = {
    "scan_uppercase": q_scan_uppercase,
    "normalize_columns": q_normalize_columns,
    "drop_null_rows": q_drop_null_rows,
    "drop_null_columns": q_drop_null_columns,
    "drop_sparse_columns": q_drop_sparse_columns,
    "declared_casts": q_declared_casts,
    "clean_strings": q_clean_strings,
    "combine_date_time": q_combine_date_time,
    "clean_samples": q_clean_samples,
    "clean_infusions": q_clean_infusions,
    "parse_limit_text": q_parse_limit_text,
    "concat_values": q_concat_values,
    "melt_samples": q_melt_samples,
    "time_bin_label": q_time_bin_label,
    "time_bin_pivot": q_time_bin_pivot,
    "matrix_join": q_matrix_join,
    "filter_infusions": q_filter_infusions,
    "attribute_samples": q_attribute_samples,
    "attach_sex": q_attach_sex,
    "attach_stop_flag": q_attach_stop_flag,
    "duplicate_treatments": q_duplicate_treatments,
    "drop_duplicate_patients": q_drop_duplicate_patients,
    "distinct_treatments": q_distinct_treatments,
    "streak_id": q_streak_id,
    "streak_groups": q_streak_groups,
    "streak_flag": q_streak_flag,
    "value_delta": q_value_delta,
    "baseline_value": q_baseline_value,
    "pivot_mean": q_pivot_mean,
    "detected_patients": q_detected_patients,
    "run_diagnostics": q_run_diagnostics,
    "patient_phenotype": q_patient_phenotype,
    "summary_detection": q_summary_detection,
    "phenotype_counts": q_phenotype_counts,
    "patients_in_scope": q_patients_in_scope,
    "cleaning_report": q_cleaning_report,
    "sorted_samples": q_sorted_samples,
    "sample_rows": q_sample_rows,
    "sample_with_replacement": q_sample_with_replacement,
    "chart_samples": q_chart_samples,
    "detected_samples": q_detected_samples,
    "patient_samples": q_patient_samples,
    "elimination_curve": q_elimination_curve,
    "chunk_text": q_chunk_text,
    "concat_group_text": q_concat_group_text,
    "codebook_split": q_codebook_split,
    "codebook_maps": q_codebook_maps,
    "describe_columns": q_describe_columns,
    "merge_descriptions": q_merge_descriptions,
    "descriptions_flatten": q_descriptions_flatten,
    "codebook_write": q_codebook_write,
    "codebook_scan": q_codebook_scan,
    "codebook_combine": q_codebook_combine,
    "key_containment": q_key_containment,
    "sql_adhoc": q_sql_adhoc,
    "sql_params": q_sql_params,
    "csv_roundtrip": q_csv_roundtrip,
    "table_append": q_table_append,
    "csv_types": q_csv_types,
    "csv_inferred": q_csv_inferred,
    "csv_rejects": q_csv_rejects,
}
for _k in DX_PARAMS:
    QUERIES[_k] = _dx_query(_k)
