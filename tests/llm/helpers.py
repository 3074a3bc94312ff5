"""Small tables with the odd rows that every operator must take."""

from pyspark.sql import types as T

#: Names that operators use inside; here they are columns of the input.
CLASHING = ["size", "row", "class", "h", "uid", "line", "at", "fp", "node", "key", "score", "copies", "n", "count"]

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASH = T.StructType(DOCS.fields + [T.StructField(c, T.StringType()) for c in CLASHING])

LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def documents(spark, rows, clashing=False):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    if clashing:
        return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in full], CLASH)
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    return [(1, "one two three four", "b"), (2, None, "a"), (3, "", None), (None, "no id here", "a"), (5, LONG, "b"),
            (6, "   \n\t ", "c"), (7, "one two three four", "b"), (7, "one two three four", "b"), (9, "x", None)]
