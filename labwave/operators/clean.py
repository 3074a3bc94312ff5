"""Cleaning and projection of source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names as N
from ..functions.scalar import combine_date_time, nan_to_null, normalize_name, text_to_timestamp


def normalize_columns(df: DataFrame, case: str = "upper") -> DataFrame:
    """Rename every column: case change, non-breaking space to space."""
    return df.toDF(*[normalize_name(c, case) for c in df.columns])


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows with a null in any of the required columns."""
    return df.dropna(how="any", subset=list(subset))


def column_profile(df: DataFrame) -> DataFrame:
    """One row: total rows and the non-null count of every column (one scan)."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count(F.col(f"`{c}`")).alias(f"nn_{i}") for i, c in enumerate(df.columns)]
    return df.agg(*aggs)


def _sparse_columns(df: DataFrame, min_share: float) -> list[str]:
    # The profile is one row of counts (its size is the column count, not the data).
    prof = column_profile(df).first()
    rows = prof["__rows"]
    out = []
    for i, c in enumerate(df.columns):
        nn = prof[f"nn_{i}"]
        if nn == 0 or (rows and nn / rows < min_share):
            out.append(c)
    return out


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold no value at all."""
    return df.drop(*_sparse_columns(df, 0.0))


def drop_sparse_columns(df: DataFrame, min_share: float = 0.001) -> DataFrame:
    """Drop columns whose non-null share is below ``min_share``."""
    return df.drop(*_sparse_columns(df, min_share))


def declared_casts(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns to a declared type map; text that does not parse becomes null."""
    cols = []
    for c in df.columns:
        if c in types:
            cols.append(F.col(f"`{c}`").try_cast(types[c]).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return df.select(*cols)


# The characters that count as white space at the ends of a text.
EDGE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def clean_strings(df: DataFrame, fill: str | None = "", trim: bool = True) -> DataFrame:
    """Strip leading/trailing whitespace of string columns, fill their nulls with ``fill``."""
    cols = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        if t == "string":
            if trim:
                col = F.btrim(col, F.lit(EDGE_SPACE))
            if fill is not None:
                col = F.coalesce(col, F.lit(fill))
        cols.append(col.alias(c))
    return df.select(*cols)


def cleaning_report(before: DataFrame, required: list[str], cols_after: int) -> DataFrame:
    """Rows and columns before and after dropping the rows that miss a required
    column, as one row from one scan."""
    kept = F.lit(True)
    for c in required:
        kept = kept & F.col(f"`{c}`").isNotNull()
    return before.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.lit(len(before.columns)).cast("long").alias("cols_before"),
        F.count_if(kept).alias("rows_after"),
        F.lit(cols_after).cast("long").alias("cols_after"))


SAMPLE_KEYS = [N.PATIENT, N.PL_DATE, N.PL_TIME]
INFUSION_KEYS = [N.PATIENT, N.INF_DATE, N.INF_TIME]


def _as_times(df: DataFrame, *cols: str) -> DataFrame:
    """Date and time columns that are text become timestamps."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: text_to_timestamp(c) for c in cols if kinds.get(c) == "string"})


def _measured(df: DataFrame) -> DataFrame:
    """NaN in a number column is no measurement."""
    return df.withColumns({c: nan_to_null(c).alias(c) for c, t in df.dtypes if t in ("double", "float")})


def clean_samples(plasma: DataFrame) -> DataFrame:
    """Plasma table: drop rows without patient, date or time, build the sample time
    from the date and the time of day, drop the two source columns. Dates and times
    may be text; a measured NaN becomes null."""
    d = drop_null_rows(_as_times(_measured(plasma), N.PL_DATE, N.PL_TIME), SAMPLE_KEYS)
    d = d.withColumn(N.SAMPLE_TIME, combine_date_time(N.PL_DATE, N.PL_TIME))
    return d.drop(N.PL_DATE, N.PL_TIME)


def clean_infusions(treatments: DataFrame) -> DataFrame:
    """Treatment table: drop rows without patient, start date or time, build the
    start time, keep patient, infusion number, sex, stop flag and start. Dates and
    times may be text."""
    d = drop_null_rows(_as_times(treatments, N.INF_DATE, N.INF_TIME), INFUSION_KEYS)
    d = d.withColumn(N.INF_START, combine_date_time(N.INF_DATE, N.INF_TIME))
    keep = [N.PATIENT, N.INFNO, N.SEX, N.STOP, N.INF_START]
    return d.select(*[c for c in keep if c in d.columns])


def filter_infusions(df: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """Keep the chosen infusion numbers; an empty choice keeps everything."""
    if not chosen:
        return df
    return df.filter(F.col(N.INFNO).isin([int(k) for k in chosen]))
