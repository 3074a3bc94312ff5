"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, table_path

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def ship_package(spark: SparkSession) -> None:
    """Put the folder that this package was imported from on the path of Python workers.
    A cluster whose machines don't have it there gets it by ``--py-files``."""
    root, workers = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in workers.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        workers["PYTHONPATH"] = os.pathsep.join([root, *paths])


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the cluster's shared folder and read back.

    Cuts the lineage on storage that survives a lost executor, gives the planner
    real sizes, and fixes values (row ids, samples) that must not change between
    two readings.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def deleted(*copies: DataFrame) -> None:
    """Remove copies that ``staged`` wrote, once nothing lazy reads them any more."""
    for df in copies:
        if path := df.__dict__.get("_staged_at"):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(prefix: str) -> str:
    """A column name that no input column has."""
    return f"_{prefix}_{uuid.uuid4().hex[:10]}"


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def may_train(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its 0-based position in ``order`` as ``pos``, without bringing the
    rows to one task: a range partitioning is written once, the rows of each
    partition are numbered, and the partitions' running counts (one row for each
    partition) are added."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // 4)
    parts = staged(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), name)
    counts = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_pid").orderBy(*order)
    return (parts.withColumn("_rn", F.row_number().over(inside))
                 .join(starts, "_pid")
                 .withColumn("pos", (F.col("_start") + F.col("_rn") - 1).cast("long"))
                 .drop("_pid", "_start", "_rn"))
