"""File sources and sinks: CSV with a declared schema, codebook JSON, tables.

Every output goes to a fresh folder under the cluster's shared checkpoint
folder (``session.shared_dir``), never to a machine-local temporary folder.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

CODEBOOK_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
])


# Full microsecond precision both ways (the default pattern keeps milliseconds).
_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str) -> str:
    """CSV export with a header line, UTF-8, written by every task in parallel. Quotes
    are doubled; text may hold line breaks; an empty text is quoted, a null is not."""
    (df.write.mode("errorifexists").option("header", True).option("encoding", "UTF-8")
       .option("escape", '"').option("emptyValue", '""').option("nullValue", "\\N")
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("timestampNTZFormat", _TS_FORMAT).option("timestampFormat", _TS_FORMAT).csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV scan with a declared schema (no inference pass over the data). A file with
    line breaks in a text is read by one task; the writer cuts the files."""
    return _csv_reader(spark, schema).option("mode", "FAILFAST").csv(path)


def _csv_reader(spark: SparkSession, schema: T.StructType):
    return (spark.read.schema(schema).option("header", True)
            .option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "\\N")
            .option("timestampNTZFormat", _TS_FORMAT).option("timestampFormat", _TS_FORMAT))


def csv_roundtrip(spark: SparkSession, df: DataFrame, name: str = "export") -> DataFrame:
    """Write ``df`` as CSV to the shared folder and read it back with its schema."""
    path = shared_dir(spark, name)
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


def write_codebook(maps: DataFrame, path: str) -> str:
    """Codebook entries as JSON records (column_name, description, details).

    One record per codebook column. Files are cut by Spark's writer rather than
    one per column: a file per column would mean a file per key at scale.
    """
    maps.select("column_name", "description", "details").write.mode("errorifexists").json(path)
    return path


def read_codebook(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Scan codebook JSON with the declared schema. ``multi_line`` reads files
    that each hold one (possibly pretty-printed) object."""
    return spark.read.schema(CODEBOOK_SCHEMA).option("multiLine", multi_line).json(path)


def combine_codebooks(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """Scan several codebook folders and write them as one JSON dataset."""
    df = None
    for p in paths:
        part = read_codebook(spark, p)
        df = part if df is None else df.unionByName(part)
    df.write.mode("errorifexists").json(out)
    return read_codebook(spark, out)


_DDL_NAME = re.compile(r"[^A-Za-z0-9_]")


#: Partition column of tables that are loaded in named batches.
BATCH = "load_batch"


def table_append(spark: SparkSession, df: DataFrame, table: str | None = None,
                 location: str | None = None, batch: str | None = None) -> DataFrame:
    """Create the table if it does not exist (types from the DataFrame's schema),
    append ``df`` to it, check it exists, and return the table.

    With ``batch`` the table is partitioned by ``load_batch`` and the rows replace those
    of that batch, so a load that is run again, after a failure or by mistake, leaves its
    rows once; other batches are not touched."""
    table = table or f"labwave_{uuid.uuid4().hex[:12]}"
    table = _DDL_NAME.sub("_", table)
    location = location or shared_dir(spark, table)
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    if batch is not None:
        cols, by = f"{cols}, `{BATCH}` string", f"PARTITIONED BY (`{BATCH}`)"
    else:
        by = ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{table}` ({cols}) USING parquet {by} LOCATION '{location}'")
    if not spark.catalog.tableExists(table):
        raise RuntimeError(f"table {table} was not created")
    if batch is None:
        df.write.insertInto(table)
    else:
        name = batch.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"INSERT OVERWRITE TABLE `{table}` PARTITION (`{BATCH}` = '{name}') SELECT * FROM {{rows}}", rows=df)
    return spark.table(table)


def drop_table(spark: SparkSession, table: str) -> DataFrame:
    """Take a table out of the catalog; its files stay and are what the result reads."""
    schema, location = spark.table(table).schema, _location(spark, table)
    spark.sql(f"DROP TABLE `{table}`")
    return spark.read.schema(schema).parquet(location)


def _location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE EXTENDED `{table}`").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


#: Types that text may turn out to have, in the order in which they are tried.
LADDER = ("bigint", "double")
DATES = ("date", "timestamp_ntz")
#: What a date looks like: a bare number is none, though it could be read as a year.
_LOOKS = {"date": r"^\d{4}-\d{2}-\d{2}$", "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}"}


def type_profile(df: DataFrame, types: tuple[str, ...] = LADDER) -> DataFrame:
    """(column_name, n_rows, n_missing, inferred, and n_<type> for each type): how many
    values of every text column read as each type, from one aggregate over all rows.

    The inferred type is the first of ``types`` that every value has; whole numbers with
    missing values are double; a column of mixed values, or without any, stays text.
    Null, empty and blank texts are missing."""
    names = [c for c, t in df.dtypes if t == "string"]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        value = F.trim(F.col(f"`{c}`"))
        value = F.when(F.length(value) > 0, value)
        aggs.append(F.count(value).alias(f"v{i}"))
        aggs += [F.count(F.when(value.rlike(_LOOKS.get(t, "")), value.try_cast(t))).alias(f"t{i}_{k}") for k, t in enumerate(types)]
    one = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("n_rows"), (F.col("rows") - F.col(f"v{i}")).alias("n_missing"),
                              *[F.col(f"t{i}_{k}").alias(f"n_{t}") for k, t in enumerate(types)]) for i, c in enumerate(names)])
    out = one.select(F.explode(each).alias("c")).select("c.*")
    found, inferred = F.col("n_rows") - F.col("n_missing"), F.lit("string")
    for t in reversed(types):
        fits = (found > 0) & (F.col(f"n_{t}") == found)
        if t == "bigint" and "double" in types:
            fits = fits & (F.col("n_missing") == 0)
        inferred = F.when(fits, F.lit(t)).otherwise(inferred)
    return out.withColumn("inferred", inferred)


def infer_types(df: DataFrame, types: tuple[str, ...] = LADDER) -> DataFrame:
    """``df`` with its text columns cast to their inferred types (one row per column
    reaches the driver)."""
    kinds = {r["column_name"]: r["inferred"] for r in type_profile(df, types).collect()}
    blank = lambda c: F.when(F.length(F.trim(F.col(f"`{c}`"))) > 0, F.trim(F.col(f"`{c}`")))
    return df.select(*[blank(c).try_cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns])


def read_csv_inferred(spark: SparkSession, path: str, types: tuple[str, ...] = LADDER) -> DataFrame:
    """CSV scan whose types come from the data: every column is read as text, whatever the
    file's first rows look like, and cast to the type that all its values have."""
    header = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    return infer_types(read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in header])), types)


def read_csv_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """CSV scan with a declared schema: (rows that fit it, rejected rows). A rejected row
    has the fields that could be read and its ``record`` as it stands in the file. The
    scan is written once, so the two tables are of one reading."""
    record = "record"
    if record in schema.fieldNames():
        raise ValueError(f"a column named {record} is in the way")
    whole = T.StructType([*schema.fields, T.StructField(record, T.StringType())])
    rows = (_csv_reader(spark, whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", record).csv(path))
    copy = shared_dir(spark, "csv-read")
    rows.write.parquet(copy)
    rows = spark.read.schema(whole).parquet(copy)
    return rows.filter(F.col(record).isNull()).drop(record), rows.filter(F.col(record).isNotNull())
