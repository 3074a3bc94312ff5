"""Codebooks: code lists to lookup tables, column descriptions, merges.

A codebook *sheet* in long form has one row per cell: (column_name,
description, row_no, cell) where a cell reads ``"code | label"``. A
*description sheet* has (variable, question, detail_value, row_no) in sheet
order. ``codebook_entries`` gives one row per code; ``codebook_maps`` writes a
column's entries as one record, which is what the JSON codebook files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Column

from .joins import DEFAULT_ROWS_PER_TASK, with_least
from .sequence import ordered_position, ordered_row_number

CELL_SEPARATOR = " | "


def codebook_split(sheet: DataFrame, column: str = "column_name", row: str = "row_no",
                   cell: str = "cell", rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """Cells to (code, label); a column's codes stop at its first empty cell, and
    a column whose first cell is empty has no codes; a column without a name has none.
    Cells that lie by column, as a numbered sheet's do, are not shuffled again."""
    empty = F.col(cell).isNull() | (F.trim(cell) == "")
    kept = with_least(sheet, [column], F.when(empty, F.col(row)), "_stop", row, rows_per_task)
    kept = kept.select(column, *[c for c in kept.columns if c != column])
    kept = kept.filter(F.col("_stop").isNull() | (F.col(row) < F.col("_stop"))).drop("_stop")
    parts = F.split(F.col(cell), r" \| ", 2)
    return kept.select(*[c for c in kept.columns if c != cell],
                       F.element_at(parts, 1).alias("code"),
                       F.try_element_at(parts, F.lit(2)).alias("label"))


def _entry(pos: Column, key: str, value: Column) -> Column:
    return F.struct(pos.alias("p"), F.col(key).alias("k"), value.alias("v"))


def _to_map(entries: Column) -> Column:
    """Sorted (position, key, value) entries to an ordered key -> value map."""
    return F.map_from_entries(F.transform(F.array_sort(entries), lambda e: F.struct(e["k"], e["v"])))


def codebook_entries(codes: DataFrame, column: str = "column_name", row: str = "row_no",
                     description: str = "description") -> DataFrame:
    """One row per (column, code): its first row, its last label and the column's
    description there (a repeated code keeps its first place and its last label, as a
    dict update does)."""
    return codes.filter(F.col("code").isNotNull()).groupBy(column, "code").agg(
        F.min(row).alias("_r"),
        F.max(F.struct(F.col(row).alias("p"), F.col("label").alias("v"))).getField("v").alias("_v"),
        F.min(F.struct(F.col(row).alias("p"), F.col(description).alias("d"))).alias("_d"))


def codebook_maps(codes: DataFrame, column: str = "column_name", row: str = "row_no",
                  description: str = "description") -> DataFrame:
    """One row per codebook column: description and its code -> label map in sheet
    order, whatever the number of codes (for rows, see ``codebook_entries``)."""
    per = codebook_entries(codes, column, row, description).groupBy(column).agg(
        F.min("_d").getField("d").alias(description),
        F.count(F.lit(1)).alias("n_codes"),
        F.collect_list(_entry(F.col("_r"), "code", F.col("_v"))).alias("_entries"))
    return per.select(column, description, "n_codes", _to_map(F.col("_entries")).alias("details"))


def codebook_rows(maps: DataFrame, column: str = "column_name") -> DataFrame:
    """Codebook maps back to one row per (column, code, label)."""
    return maps.select(column, F.explode("details").alias("code", "label"))


def describe_columns(columns: DataFrame, sheet: DataFrame, name: str = "column_name",
                     variable: str = "variable", question: str = "question",
                     detail: str = "detail_value", row: str = "row_no",
                     tie: str | None = None, bucket_rows: float = 8192.0,
                     rows_per_task: int = DEFAULT_ROWS_PER_TASK) -> DataFrame:
    """Description of every listed column from a description sheet.

    The description is the question of the variable's first row; the details
    come from its first contiguous run of rows (detail -> question, or the
    detail itself when the question is empty; a repeated detail keeps its first
    place and last value). A variable whose first question is empty, or a
    column with no variable, is described by its own name.

    Sheet order is (``row``, ``tie``). Rows get their position in the sheet, and their
    number within the variable: the difference of the two stays the same along a run and
    grows from run to run, so a variable's first run is where it is least. The sheet is
    shuffled once by position and once by variable, whose few rows of the first run are
    then aggregated where they lie. One join with the column list at the end.
    """
    tie = tie or row
    pos = F.struct(*[F.col(c) for c in ([row] if tie == row else [row, tie])])
    placed = ordered_position(sheet.select(variable, question, detail, *dict.fromkeys([row, tie])), row, tie, "_at")
    runs = ordered_row_number(placed.filter(F.col(variable).isNotNull()), [variable], "_at", "_at", "_k",
                              bucket_hours=bucket_rows, numeric=True)
    runs = runs.withColumn("_run", F.col("_at") - F.col("_k")).drop("_k")
    first = with_least(runs, [variable], F.col("_run"), "_least", "_at", rows_per_task)
    first = first.filter(F.col("_run") == F.col("_least"))
    per_detail = first.groupBy(variable, detail).agg(
        F.min(pos).alias("_first"),
        F.max(F.struct(pos.alias("p"), F.coalesce(F.col(question), F.col(detail)).alias("v")))
         .getField("v").alias("_v"),
        F.min(F.struct(pos.alias("p"), F.col(question).alias("q"))).alias("_fq"))
    per_var = per_detail.groupBy(variable).agg(
        F.min("_fq").getField("q").alias("_q"),
        F.collect_list(F.when(F.col(detail).isNotNull(),
                              _entry(F.col("_first"), detail, F.col("_v")))).alias("_entries"))
    per = per_var.select(
        F.col(variable).alias(name),
        F.trim("_q").alias("_desc"),
        F.when(F.col("_q").isNotNull(), _to_map(F.col("_entries"))).alias("details"))
    out = columns.select(name).join(per, on=name, how="left")
    return out.select(name, F.coalesce(F.col("_desc"), F.col(name)).alias("description"), "details")


def merge_descriptions(first: DataFrame, second: DataFrame, name: str = "column_name") -> DataFrame:
    """Union of two description tables that each name a column once; where both describe
    a column, the second wins: the first table's other columns join the whole second."""
    named = second.select(F.col(f"`{name}`").alias("_named"))
    rest = first.join(named, F.col(f"`{name}`").eqNullSafe(F.col("_named")), "left_anti")
    return rest.unionByName(second, allowMissingColumns=True)


DESCRIPTION_SCHEMA = ("map<string, map<string, struct<description: string, "
                      "details: map<string, string>>>>")


def descriptions_flatten(docs: DataFrame, doc_col: str = "value") -> DataFrame:
    """Nested description documents {table: {column: {description, details}}}
    to one row per (table, column); a missing description reads as ''."""
    parsed = docs.select(F.from_json(doc_col, DESCRIPTION_SCHEMA).alias("_d"))
    tables = parsed.select(F.explode("_d").alias("table_name", "_cols"))
    cols = tables.select("table_name", F.explode("_cols").alias("column_name", "_c"))
    return cols.select("table_name", "column_name",
                       F.coalesce(F.col("_c.description"), F.lit("")).alias("description"),
                       F.col("_c.details").alias("details"))
