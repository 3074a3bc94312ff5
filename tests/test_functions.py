from datetime import date, datetime

from pyspark.sql import types as T

from labwave.functions import scalar as S


def test_time_bins_hand_case(spark):
    hs = [-7, -6.9, 0, 0.1, 18, 30, 30.1, 36, 36.1, 96, 96.1, 102.1, 306, 306.1, None]
    want = ["nan", "Before", "Before", "Time0", "Time0", "Time23", "nan", "nan", "Time36",
            "Time90", "nan", "Time102", "Time294", "nan", "nan"]
    df = spark.createDataFrame([(i, None if h is None else float(h)) for i, h in enumerate(hs)], "i int, h double")
    got = [r[0] for r in df.orderBy("i").select(S.time_bin_label("h")).collect()]
    assert got == want
    none_label = df.orderBy("i").select(S.time_bin_label("h", unbinned=None)).collect()
    assert [r[0] for r in none_label] == [None if w == "nan" else w for w in want]


def test_bins_do_not_overlap_and_are_ordered():
    prev_hi = None
    for lo, hi, _ in S.TIME_BINS:
        assert lo < hi
        if prev_hi is not None:
            assert lo >= prev_hi
        prev_hi = hi
    assert len(S.TIME_BINS) == 30


def test_limit_text(spark):
    df = spark.createDataFrame([("<8,0",), ("10,5",), (None,), ("abc",)], "t string")
    got = [r[0] for r in df.select(S.parse_limit_text("t")).collect()]
    assert got == [8.0, 10.5, None, None]


def test_floor_hours_floors_negatives(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1, 10, 0), datetime(2024, 1, 1, 8, 30))],
        T.StructType([T.StructField("a", T.TimestampNTZType()), T.StructField("b", T.TimestampNTZType())]))
    got = df.select(S.floor_hours("a", "b"), S.exact_hours("a", "b")).first()
    assert got[0] == -2.0 and got[1] == -1.5


def test_combine_date_time_ignores_date_of_time_column(spark):
    schema = T.StructType([T.StructField("d", T.DateType()), T.StructField("t", T.TimestampNTZType())])
    df = spark.createDataFrame([(date(2023, 5, 6), datetime(1899, 12, 30, 13, 45, 7, 123456))], schema)
    assert df.select(S.combine_date_time("d", "t")).first()[0] == datetime(2023, 5, 6, 13, 45, 7, 123456)


def test_concat_values_skips_nulls(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(S.concat_values("x", "y", "z")).first()[0] == "a,c"


def test_normalize_name():
    assert S.normalize_name("pl\xa0date", "upper") == "PL DATE"
    assert S.normalize_name("PL_DATE", "lower") == "pl_date"


def test_hour_difference_ignores_session_dst(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        schema = T.StructType([T.StructField("a", T.TimestampNTZType()),
                               T.StructField("b", T.TimestampNTZType())])
        df = spark.createDataFrame([(datetime(2024, 3, 9, 12), datetime(2024, 3, 11, 12))], schema)
        assert df.select(S.floor_hours("a", "b")).first()[0] == 48.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
