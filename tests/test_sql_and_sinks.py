import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labwave.sources import files as FS
from labwave.sources import sql as SQ

from .conftest import SF_SMALL


def test_placeholders_bind_as_parameters(spark):
    SQ.register_tables(spark, SF_SMALL, ["events"])
    text = "SELECT count(*) AS n FROM events WHERE event_type = [kind]"
    n_click = SQ.sql_params(spark, text, {"kind": "click"}).first()["n"]
    assert n_click > 0
    # A value with a quote is data, not SQL.
    assert SQ.sql_params(spark, text, {"kind": "x' OR '1'='1"}).first()["n"] == 0
    with pytest.raises(KeyError):
        SQ.sql_params(spark, text, {})


def test_placeholder_names_in_order():
    assert SQ.placeholder_names("a [x] b [y] c [x]") == ["x", "y"]


def test_csv_roundtrip_keeps_values(spark):
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    back = FS.csv_roundtrip(spark, df, "test-events")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_table_append_creates_and_appends(spark):
    import uuid
    df = spark.read.parquet(f"{SF_SMALL}/region.parquet")
    name = f"t_{uuid.uuid4().hex[:8]}"
    assert FS.table_append(spark, df, table=name).count() == df.count()
    assert FS.table_append(spark, df, table=name).count() == 2 * df.count()


def test_batches_are_loaded_once(spark):
    import uuid
    name = f"t_{uuid.uuid4().hex[:8]}"
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    for batch, rows in (("b1", df), ("b2", df.filter("id = 1")), ("b1", df), ("b1", df)):
        out = FS.table_append(spark, rows, table=name, batch=batch)
    assert sorted((r["load_batch"], r["id"], r["x"]) for r in out.collect()) == [("b1", 1, "a"), ("b1", 2, None), ("b2", 1, "a")]
    FS.table_append(spark, df.filter("id = 2"), table=name, batch="b1")  # a corrected batch replaces the first
    kept = FS.drop_table(spark, name)
    assert sorted((r["load_batch"], r["id"]) for r in kept.collect()) == [("b1", 2), ("b2", 1)] and not spark.catalog.tableExists(name)


def test_types_come_from_all_values(spark):
    rows = [(str(i), str(i), None if i == 3 else str(i), "x" if i == 999 else str(i), f"{i}.5", " ", "2024-02-30" if i == 5 else "2024-02-28", "1999")
            for i in range(1000)]
    df = spark.createDataFrame(rows, "a string, b string, gaps string, mixed string, real string, blank string, bad_day string, year string")
    df = df.withColumns({"day": F.lit("2024-02-29"), "time": F.lit("2024-02-29 10:00:01"), "n": F.lit(1)})
    kinds = dict(FS.infer_types(df).dtypes)
    assert kinds == {"a": "bigint", "b": "bigint", "gaps": "double", "mixed": "string", "real": "double", "blank": "string", "bad_day": "string",
                     "year": "bigint", "day": "string", "time": "string", "n": "int"}
    dated = dict(FS.infer_types(df, FS.LADDER + FS.DATES).dtypes)
    assert (dated["day"], dated["time"], dated["bad_day"], dated["year"]) == ("date", "timestamp_ntz", "string", "bigint")
    profile = {r["column_name"]: r for r in FS.type_profile(df).collect()}
    assert (profile["mixed"].n_bigint, profile["gaps"].n_missing, profile["blank"].n_missing) == (999, 1, 1000)
    assert dict(FS.infer_types(df.limit(0)).dtypes)["a"] == "string"


def test_rejected_rows_are_kept_apart(spark):
    path = FS.write_csv(spark.createDataFrame([("1", "2.5", "ok"), ("x", "3", "a,b"), ("4", None, "line\nbreak"), ("5", "y", None)], "a string, b string, c string"),
                        FS.shared_dir(spark, "rejects"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    good, bad = FS.read_csv_rejects(spark, path, schema)
    assert sorted(map(tuple, good.collect())) == [(1, 2.5, "ok"), (4, None, "line\nbreak")]
    assert {r.record: (r.a, r.b, r.c) for r in bad.collect()} == {'x,3,"a,b"': (None, 3.0, "a,b"), "5,y,\\N": (5, None, None)}


def test_parameters_keep_apart(spark):
    got = SQ.sql_params(spark, "SELECT [a b] AS x, [a-b] AS y, array(1, 2)[0] AS z, '[a b]' AS q -- [c]", {"a b": 1, "a-b": 2}).first()
    assert tuple(got) == (1, 2, 1, "[a b]")


def test_csv_keeps_any_text(spark):
    rows = [(1, "line\nbreak"), (2, 'a "quoted" word'), (3, "back\\slash\\"), (4, ""), (5, None), (6, " spaces "), (7, "c,omma\r\nx"), (8, '"')]
    df = spark.createDataFrame(rows, "id long, text string")
    assert sorted(map(tuple, FS.csv_roundtrip(spark, df, "texts").collect())) == rows
