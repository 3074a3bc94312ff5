"""Table catalog: column listing, shared-key links and key containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table_path

COLUMNS_SCHEMA = T.StructType([T.StructField("table_name", T.StringType()),
                               T.StructField("column_name", T.StringType())])


def list_columns(spark: SparkSession, sf_dir: str, tables: list[str]) -> DataFrame:
    """(table, column) for every column of the given Parquet tables (schema only)."""
    rows = []
    for t in tables:
        for c in spark.read.parquet(table_path(sf_dir, t)).columns:
            rows.append((t, c))
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def key_links(columns: DataFrame, pattern: str = "%ID%") -> DataFrame:
    """Columns whose name matches ``pattern`` (case-insensitive) and that occur in
    more than one table: one row per column with the sorted list of its tables
    (the link set, without expanding every table pair)."""
    ids = columns.filter(F.upper("column_name").like(pattern.upper()))
    grouped = ids.groupBy("column_name").agg(
        F.array_sort(F.collect_set("table_name")).alias("_tables"))
    return grouped.filter(F.size("_tables") > 1).select(
        "column_name", F.array_join("_tables", ",").alias("tables"),
        F.size("_tables").cast("long").alias("n_tables"))


def key_containment(spark: SparkSession, sf_dir: str, links: list[tuple[str, list[str]]]) -> DataFrame:
    """For each linked column and each of its tables: distinct keys, and how many
    of them also occur in another table of the link.

    One aggregate per key gathers the set of tables holding it (at most the
    link's table count, so bounded; the partial aggregate removes repeats on
    the map side, so a frequent key sends little); the sets are then counted
    per table. No table pairs and no join back."""
    parts = None
    for column, tables in links:
        for t in tables:
            keys = (spark.read.parquet(table_path(sf_dir, t))
                    .select(F.lit(column).alias("column_name"), F.lit(t).alias("table_name"),
                            F.col(column).cast("string").alias("key"))
                    .filter(F.col("key").isNotNull()))
            parts = keys if parts is None else parts.unionByName(keys)
    per_key = parts.groupBy("column_name", "key").agg(F.collect_set("table_name").alias("_tables"))
    tagged = per_key.select("column_name", F.explode("_tables").alias("table_name"),
                            (F.size("_tables") > 1).alias("_shared"))
    return tagged.groupBy("column_name", "table_name").agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count(F.when(F.col("_shared"), 1)).alias("n_shared"))
