import json
import os
import tempfile

from pyspark.sql import functions as F

from labwave.operators import codebook as CB
from labwave.sources import files as FS


def _sheet(spark, rows):
    return spark.createDataFrame(rows, "column_name string, description string, row_no int, cell string")


def test_split_stops_at_first_empty_cell(spark):
    sheet = _sheet(spark, [("a", "A", 1, "1 | one"), ("a", "A", 2, "2 | two"), ("a", "A", 3, None),
                           ("a", "A", 4, "4 | four"), ("b", "B", 1, None), ("b", "B", 2, "9 | x")])
    got = sorted((r["column_name"], r["code"], r["label"]) for r in CB.codebook_split(sheet).collect())
    assert got == [("a", "1", "one"), ("a", "2", "two")]


def test_maps_keep_sheet_order_and_last_value(spark):
    sheet = _sheet(spark, [("a", "A", 1, "2 | two"), ("a", "A", 2, "1 | one"), ("a", "A", 3, "2 | TWO")])
    m = CB.codebook_maps(CB.codebook_split(sheet)).withColumn("j", F.to_json("details")).first()
    assert m["j"] == '{"2":"TWO","1":"one"}'
    assert m["description"] == "A" and m["n_codes"] == 2


def test_maps_of_any_size(spark):
    sheet = _sheet(spark, [("a", "A", i, f"{i} | x") for i in range(1, 12_002)])
    (row,) = CB.codebook_maps(CB.codebook_split(sheet)).collect()
    assert row["n_codes"] == len(row["details"]) == 12_001
    assert CB.codebook_entries(CB.codebook_split(sheet)).count() == 12_001


def test_describe_columns(spark):
    sheet = spark.createDataFrame(
        [("v1", "Question one", "1", 1), ("v1", None, "2", 2), ("v2", "Q2", "x", 3), ("v1", "late", "3", 4),
         ("v3", None, "1", 5)],
        "variable string, question string, detail_value string, row_no long")
    cols = spark.createDataFrame([("v1",), ("v2",), ("v3",), ("nocode",)], "column_name string")
    got = {r["column_name"]: (r["description"], r["details"])
           for r in CB.describe_columns(cols, sheet, bucket_rows=2).collect()}
    assert got["v1"] == ("Question one", {"1": "Question one", "2": "2"})
    assert got["v2"] == ("Q2", {"x": "Q2"})
    assert got["v3"] == ("v3", None)
    assert got["nocode"] == ("nocode", None)


def _described(cols, sheet, **how):
    return {r["column_name"]: (r["description"], r["j"])
            for r in CB.describe_columns(cols, sheet, **how).withColumn("j", F.to_json("details")).collect()}


def _plain_description(rows):
    """First contiguous run of each variable in sheet order, one row after the other."""
    first, done, last = {}, set(), None
    for v, q, x, _ in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0)):
        if last is not None and v != last:
            done.add(last)
        last = v
        if v is not None and v not in done:
            first.setdefault(v, []).append((q, x))
    out = {}
    for v, run in first.items():
        details = {}
        for q, x in run:
            if x is not None:
                details[x] = q if q is not None else x
        out[v] = (v, None) if run[0][0] is None else (run[0][0].strip(), json.dumps(details, separators=(",", ":")))
    return out


def test_described_runs_with_and_without_hot_variables(spark):
    """Runs over the borders of ranges, null variables between rows of one variable, rows without a number:
    the same descriptions whether a variable's rows fit one task or not."""
    names = ["a"] * 40 + ["b", "a", None, "b", "b"] * 30 + ["c"] * 3 + [None, "c"] + ["d"] * 200 + ["e", "d"] * 20
    rows = [(v, None if i % 11 == 3 else f" q{i} ", f"x{i % 5}" if i % 7 else None, i * 3) for i, v in enumerate(names)]
    rows.append(("f", "last", "1", None))
    sheet = spark.createDataFrame(rows, "variable string, question string, detail_value string, row_no long").repartition(5)
    cols = spark.createDataFrame([(v,) for v in "abcdef"], "column_name string")
    want = _plain_description(rows)
    for how in ({}, dict(rows_per_task=7), dict(rows_per_task=7, bucket_rows=3)):
        assert _described(cols, sheet, **how) == want


def test_split_with_and_without_hot_columns(spark):
    rows = [(f"c{i % 9}" if i % 10 else None, "D", i, None if i % 97 == 96 else f"{i} | l{i}") for i in range(600)]
    sheet = _sheet(spark, rows).repartition(4)
    stop = {c: min([r[2] for r in rows if r[0] == c and r[3] is None], default=10**9) for c in {r[0] for r in rows}}
    want = sorted((c, "D", i, str(i), f"l{i}") for c, _, i, x in rows if c is not None and i < stop[c])
    for most in (4_000_000, 10):
        assert sorted(tuple(r) for r in CB.codebook_split(sheet, rows_per_task=most).collect()) == want


def _exchanges(df):
    df.collect()  # so the plan is final
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
            if " Exchange " in line and "RoundRobin" not in line]


def test_sheets_are_shuffled_once_by_key(spark, tmp_path):
    """One shuffle carries the sheet's rows to their variable or column; all else lies there already."""
    path = str(tmp_path / "sheet")
    spark.range(20_000).select(
        F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(3000))).alias("variable"), F.concat(F.lit("q"), "id").alias("question"),
        (F.col("id") % 7).cast("string").alias("detail_value"), F.col("id").alias("row_no")).write.parquet(path)
    sheet = spark.read.parquet(path)
    cols = sheet.select(F.col("variable").alias("column_name")).distinct()
    rows = [x for x in _exchanges(CB.describe_columns(cols, sheet)) if "hashpartitioning(variable" in x]
    assert len(rows) == 1, rows
    cells = sheet.select(F.col("variable").alias("column_name"), F.col("question").alias("description"), "row_no",
                         F.concat("detail_value", F.lit(" | "), "question").alias("cell"))
    rows = [x for x in _exchanges(CB.codebook_maps(CB.codebook_split(cells))) if "hashpartitioning(column_name" in x]
    assert len(rows) == 1, rows


def test_merge_second_wins(spark):
    a = spark.createDataFrame([("x", "old"), ("y", "keep")], "column_name string, description string")
    b = spark.createDataFrame([("x", "new")], "column_name string, description string")
    got = {r["column_name"]: r["description"] for r in CB.merge_descriptions(a, b).collect()}
    assert got == {"x": "new", "y": "keep"}


def test_descriptions_flatten_default(spark):
    doc = json.dumps({"t": {"c1": {"description": "d1", "details": {"1": "a"}}, "c2": {}}})
    got = {r["column_name"]: (r["description"], r["details"])
           for r in CB.descriptions_flatten(spark.createDataFrame([(doc,)], "value string")).collect()}
    assert got == {"c1": ("d1", {"1": "a"}), "c2": ("", None)}


def test_scan_pretty_printed_codebook_files(spark):
    d = tempfile.mkdtemp(prefix="labwave-cb-")
    entries = [{"column_name": "wing", "description": "Part of the building", "details": {"n": "north", "s": "south"}},
               {"column_name": "floor", "description": "Level", "details": {"0": "ground"}}]
    for e in entries:
        with open(os.path.join(d, e["column_name"] + ".json"), "w") as f:
            json.dump(e, f, indent=4)
    got = CB.codebook_rows(FS.read_codebook(spark, d, multi_line=True))
    assert sorted(tuple(r) for r in got.collect()) == [("floor", "0", "ground"), ("wing", "n", "north"), ("wing", "s", "south")]
