"""Ad-hoc SQL over the registered tables, with parameters bound, never spliced."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

# Literals, quoted names, comments and subscripts, which are skipped, or a placeholder.
_SQL_PART = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?<=[\w\])`])\[[^\]]*\]|\[(?P<name>[^\]]*)\]""", re.S)


def register_tables(spark: SparkSession, sf_dir: str, tables=DRIVER_TABLES) -> list[str]:
    """Expose each Parquet table as a temporary view named after the table."""
    for t in tables:
        spark.read.parquet(table_path(sf_dir, t)).createOrReplaceTempView(t)
    return list(tables)


def sql_adhoc(spark: SparkSession, text: str) -> DataFrame:
    """Run a SQL text; errors surface as exceptions, not as a missing result."""
    return spark.sql(text)


def placeholder_names(text: str) -> list[str]:
    """Names of ``[...]`` placeholders in order of first appearance."""
    return list(dict.fromkeys(m["name"] for m in _SQL_PART.finditer(text) if m["name"] is not None))


def sql_params(spark: SparkSession, text: str, values: dict) -> DataFrame:
    """SQL whose ``[name]`` placeholders become named parameter markers bound to
    ``values`` (keyed by placeholder name): values never enter the SQL text.

    Markers are numbered, so two names never share one. Bracketed text inside a
    quoted literal or comment, and a subscript (brackets after a name, a closing
    bracket or a closing parenthesis), are left as they are; any other bracketed name
    must have a value.
    """
    markers: dict[str, str] = {}

    def bind(m: re.Match) -> str:
        name = m.group("name")
        if name is None:
            return m.group(0)
        if name not in values:
            raise KeyError(f"no value for placeholder [{name}]")
        return ":" + markers.setdefault(name, f"p{len(markers)}")

    bound = _SQL_PART.sub(bind, text)
    return spark.sql(bound, args={marker: values[name] for name, marker in markers.items()})
