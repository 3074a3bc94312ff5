"""Clinical shapes derived from the driver tables.

* samples: every non-signup ``events`` row is one lab sample; the patient is
  ``user_id``, the analyte code is ``event_type``, the value is ``value``, the
  sample id is ``event_id``; the limit text comes from the ``props`` JSON.
* treatments: every ``signup`` event is an infusion start, numbered per patient
  by time; sex comes from ``customer`` (``c_custkey % 3``, 0 unknown), the stop
  flag from the parity of the infusion event's value.

All of it is lazy DataFrame code over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import names as N
from ..functions.scalar import day_start
from ..operators.sequence import ordered_row_number
from ..session import table_path

SIGNUP = "signup"
# The event types that stand in for creatinine and methotrexate.
CREA_EVENT, MTX_EVENT = "click", "purchase"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lab samples: patient, sample id, time, code, value, limit text."""
    e = load(spark, sf_dir, "events")
    return e.filter(F.col("event_type") != SIGNUP).select(
        F.col("user_id").alias(N.PATIENT),
        F.col("event_id").alias(N.SAMPLE_ID),
        F.col("ts").alias(N.SAMPLE_TIME),
        F.col("event_type").alias(N.CODE),
        F.col("value").alias(N.VALUE),
        F.concat(F.lit("<"), F.get_json_object("props", "$.k"), F.lit(",0")).alias(N.REFTEXT),
    )


def treatment_table(spark: SparkSession, sf_dir: str, patients=None) -> DataFrame:
    """Raw per-infusion table (the treatment source's shape): date and a time
    column whose date part is the spreadsheet epoch, as such sources deliver.
    ``patients`` is a condition on the patient column, applied to the scan."""
    e = load(spark, sf_dir, "events").filter(F.col("event_type") == SIGNUP)
    rows = e.select(F.col("user_id").alias(N.PATIENT), F.col("event_id").alias(N.SAMPLE_ID),
                    "ts", "value")
    rows = rows if patients is None else rows.filter(patients)
    rows = ordered_row_number(rows, [N.PATIENT], "ts", N.SAMPLE_ID, N.INFNO)
    cust = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(N.PATIENT), (F.col("c_custkey") % 3).cast("int").alias(N.SEX))
    rows = rows.join(cust, on=N.PATIENT, how="left")
    excel_epoch = F.lit("1899-12-30 00:00:00").cast("timestamp_ntz")
    return rows.select(
        N.PATIENT, N.INFNO, N.SEX,
        (F.floor(F.col("value")) % 2).cast("int").alias(N.STOP),
        F.to_date("ts").alias(N.INF_DATE),
        (excel_epoch + (F.col("ts") - day_start("ts"))).alias(N.INF_TIME),
        F.col(N.SAMPLE_ID).alias("INF_EVENT_ID"),
    )


def plasma_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw wide plasma table: one row per sample with a date and a time column and
    the two measures (creatinine from clicks, methotrexate from purchases). Events
    whose ``k`` is 0 have no time of day, so cleaning has rows to drop."""
    e = load(spark, sf_dir, "events").filter(F.col("event_type").isin(CREA_EVENT, MTX_EVENT))
    excel_epoch = F.lit("1899-12-30 00:00:00").cast("timestamp_ntz")
    return e.select(
        F.col("user_id").alias(N.PATIENT),
        F.col("event_id").alias(N.SAMPLE_ID),
        F.to_date("ts").alias(N.PL_DATE),
        F.when(~F.get_json_object("props", "$.k").eqNullSafe("0"),
               excel_epoch + (F.col("ts") - day_start("ts"))).alias(N.PL_TIME),
        F.when(F.col("event_type") == CREA_EVENT, F.col("value")).alias(N.CREA_MEASURE),
        F.when(F.col("event_type") == MTX_EVENT, F.col("value")).alias(N.MTX_MEASURE),
    )


def codebook_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codebook sheet in long form from ``lineitem``: every order is a coded
    column, every line a ``code | label`` cell (line number | part). A returned
    line leaves its cell empty, which ends that column's code list."""
    li = load(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").cast("string")
    cell = F.concat(F.col("l_linenumber").cast("string"), F.lit(" | part "),
                    F.col("l_partkey").cast("string"))
    rows = li.select(
        F.concat(F.lit("O"), key).alias("column_name"),
        F.concat(F.lit("order "), key).alias("description"),
        "l_linenumber", F.struct("l_partkey", "l_suppkey").alias("_tb"),
        F.when(F.col("l_returnflag") != "R", cell).alias("cell"),
    )
    # Sheet row: position within the column by line, then part and supplier.
    rows = ordered_row_number(rows, ["column_name"], "l_linenumber", "_tb", "row_no",
                              bucket_hours=4, numeric=True)
    return rows.select("column_name", "description", "row_no", "cell")


def description_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description sheet in sheet order from ``lineitem``: the variable is the
    part, the question names the order (empty for returned lines), the detail
    is the line number; rows are ordered by (order, line)."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("variable"),
        F.when(F.col("l_returnflag") != "R",
               F.concat(F.lit("order "), F.col("l_orderkey").cast("string"))).alias("question"),
        F.col("l_linenumber").cast("string").alias("detail_value"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"),
        F.struct("l_partkey", "l_suppkey").alias("row_tb"),
    )


def part_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column list to describe: one column per part."""
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("column_name"))


def part_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second description table (an update file): all parts."""
    p = load(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("column_name"),
        F.col("p_name").alias("description"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("details"))
