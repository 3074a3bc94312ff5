"""Column-level building blocks. Every function returns a plain ``Column`` built
from Spark's own expressions, so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(col) -> Column:
    """A number, with NaN as null: no measurement."""
    return F.when(~F.isnan(_c(col)), _c(col))


def text_to_timestamp(col, *formats: str) -> Column:
    """Text to timestamp_ntz by the first format that fits; without formats by the
    usual ISO forms. Text that fits none gives null."""
    if not formats:
        return _c(col).try_cast("timestamp_ntz")
    return F.coalesce(*[F.try_to_timestamp(_c(col), F.lit(f)).cast("timestamp_ntz") for f in formats])


def day_start(ts) -> Column:
    """Midnight of a timestamp_ntz, still timestamp_ntz (date_trunc would give a zoned type)."""
    return F.to_date(_c(ts)).cast("timestamp_ntz")


def combine_date_time(date_col, time_col) -> Column:
    """Date part of ``date_col`` plus the time of day of ``time_col`` (its date part is ignored)."""
    t = _c(time_col)
    return day_start(date_col) + (t - day_start(t))


def diff_micros(start, end) -> Column:
    """end - start in microseconds (bigint); null if either side is null.

    On timestamp_ntz this is wall-clock arithmetic: it does not depend on the
    session time zone or its daylight-saving changes (tested).
    """
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp_ntz (zone-free)."""
    return diff_micros(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def time_then_id(ts, number) -> Column:
    """One number that orders by time, then by a whole number: a buffer of fixed width
    keeps ``min_by`` a hash aggregate, where a struct would have every row sorted first."""
    wide = epoch_micros(ts).cast("decimal(19,0)") * F.lit("2" + "0" * 19).cast("decimal(20,0)")  # more than any two ids differ
    return (wide + _c(number).cast("decimal(19,0)")).cast("decimal(38,0)")


def floor_hours(start, end) -> Column:
    """Whole hours from start to end, floored (-90 min is -2), as double."""
    return F.floor(diff_micros(start, end) / F.lit(MICROS_PER_HOUR)).cast("double")


def exact_hours(start, end) -> Column:
    """Fractional hours from start to end."""
    return diff_micros(start, end) / F.lit(float(MICROS_PER_HOUR))


def parse_limit_text(col) -> Column:
    """Limit text such as ``<8,0`` to 8.0; text that is not a number gives null."""
    cleaned = F.replace(F.replace(_c(col), F.lit("<"), F.lit("")), F.lit(","), F.lit("."))
    return cleaned.try_cast("double")


def normalize_name(name: str, case: str = "upper") -> str:
    """Column-name normaliser (metadata, not data): case change, non-breaking space to space."""
    name = name.replace("\xa0", " ")
    if case == "upper":
        return name.upper()
    if case == "lower":
        return name.lower()
    return name


# --- fixed values: time bins over hours since infusion start -----------------
# Each bin is (lower, upper, label) and holds hours with lower < h <= upper.
# Hours in (30, 36], (96, 102], <= -7, > 306 or null fall in no bin.
TIME_BINS = [
    (-7, 0, "Before"), (0, 18, "Time0"), (18, 30, "Time23"),
    (36, 42, "Time36"), (42, 48, "Time42"), (48, 54, "Time48"), (54, 60, "Time54"),
    (60, 66, "Time60"), (66, 72, "Time66"), (72, 78, "Time72"), (78, 84, "Time78"),
    (84, 90, "Time84"), (90, 96, "Time90"),
    (102, 114, "Time102"), (114, 126, "Time114"), (126, 138, "Time126"),
    (138, 150, "Time138"), (150, 162, "Time150"), (162, 174, "Time162"),
    (174, 186, "Time174"), (186, 198, "Time186"), (198, 210, "Time198"),
    (210, 222, "Time210"), (222, 234, "Time222"), (234, 246, "Time234"),
    (246, 258, "Time246"), (258, 270, "Time258"), (270, 282, "Time270"),
    (282, 294, "Time282"), (294, 306, "Time294"),
]
UNBINNED = "nan"
# --- end fixed values ---------------------------------------------------------

TIME_BIN_LABELS = [label for _, _, label in TIME_BINS]


def time_bin_label(hours, bins=TIME_BINS, unbinned: str | None = UNBINNED) -> Column:
    """First matching half-open bin ``lower < h <= upper``; ``unbinned`` otherwise.

    ``unbinned=None`` gives null for rows outside every bin (what the source's
    comments ask for); the default keeps the literal ``nan`` label it produces.
    """
    h = _c(hours)
    expr = None
    for lo, hi, label in bins:
        cond = (h > F.lit(lo)) & (h <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(unbinned).cast("string"))


def concat_values(*cols, sep: str = ",") -> Column:
    """Join the non-null values of several columns with ``sep`` (nulls are skipped)."""
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


def coalesce_false(col) -> Column:
    """Null comparison results count as false."""
    return F.coalesce(_c(col), F.lit(False))
