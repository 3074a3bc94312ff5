"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words; a document of source s is expected in
the mix ``rate(s) = target(s) / size(s)`` times. Documents of a source are laid
on a line in a fixed order, each taking ``rate`` of it; one random offset for
the source is added, and a document is emitted once for every integer boundary
its stretch crosses. So a document appears ``floor(rate)`` or ``ceil(rate)``
times and the source's total is hit as closely as whole documents allow. The
order goes by size class, so the sample is spread evenly over short and long
documents and the words taken stay near the target.

Positions in a source are found without sorting it in one task: rows are counted
for each (source, size class, hash bucket), the counts are summed up in two
levels, and only rows of one bucket (about ``BUCKET_ROWS``) are numbered together. The
order within a source is by size class, hash of id, source and text: it depends on the
rows alone, not on where they lie. Equal rows share a hash and take up one stretch of
the line, whatever their number; their numbers within it come from a two-level scan.

Defined cases: a null text has size 0; a null source is a source of its own and
comes last; a source without words has target 0 and none of its documents is
taken; null and repeated ids are told apart by their texts, and equal rows by position
only, so which of them is repeated does not matter; an empty table gives an empty result. Columns of the input that
the operator does not use, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import ordered_row_number
from .common import fresh, n_words, numbered, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-2"
#: Rows numbered together.
BUCKET_ROWS = 512


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> source, source_size, weight, target, rate, offset.

    Sources by code point, null last, have the ``weights`` in turn. All targets
    together are ``share`` of all sizes; a target stops at ``most`` times its
    source's size and the excess goes to the others by weight, again until no
    target is above. Each round is one aggregate over the sources.
    """
    order = [F.col("source").asc_nulls_last()]
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    per = staged(numbered(sizes, order, "mix-sources").withColumn("weight", w)
                 .withColumn("cap", F.col("source_size") * most).drop("pos"), "mix-weights")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    goal, level = total * share, None
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * F.lit(level)
        row = per.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)),
                      F.sum(F.when(~full, F.col("weight")))).first()
        if not row[1]:
            break
        new = float(goal - row[0]) / float(row[1])
        if level is not None and new == level:
            break
        level = new
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float("inf") if level is None else level))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")))), 1, 8), 16, 10)
    return (per.withColumn("target", target)
               .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
               .withColumn("offset", draw.cast("double") / F.lit(4294967296.0))
               .drop("cap"))


def size_class(size):
    """Sizes that agree in bit length and in the three bits after the first."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.floor(size / F.pow(F.lit(2.0), F.greatest(bits - 4, F.lit(0))))).cast("long")


def _with_size(docs: DataFrame, uid: str, id_col: str, text_col: str, source_col: str, size_col: str | None) -> DataFrame:
    """One narrow row for each row: uid, doc_id, source, size, size class and ``h``, which
    only rows of equal id, source and text share."""
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    size = F.col(f"`{size_col}`") if size_col else n_words(text)
    told = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in (F.col(f"`{id_col}`"), source, text)]
    key = F.md5(F.concat_ws("#", F.lit(SEED), *told).cast("binary"))
    rows = docs.select(F.col(f"`{uid}`").alias("uid"), F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"), size.alias("size"), key.alias("h"))
    return rows.withColumn("class", size_class(F.col("size")))


def place(base: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows of ``_with_size``, written, with source_size, weight, target, rate and ``copies``,
    the number of times the mix takes the row."""
    classes = staged(base.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")), "mix-classes")
    plan = staged(targets(classes.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, most), "mix-targets")
    earlier = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = staged(
        classes.withColumn("class_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
               .withColumn("n_buckets", F.ceil(F.col("n") / BUCKET_ROWS).cast("long"))
               .select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), "class_start", "n_buckets")
               .join(plan, F.col("c_source").eqNullSafe(F.col("source"))).drop("source"), "mix-plan")
    # Equal rows are one here, however many there are, and take up a stretch of the line together.
    alike = base.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"), F.first("class").alias("class"), F.first("size").alias("size"))
    # The hash is cut to 32 bits so that another SQL engine can follow it.
    bucket = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("n_buckets")
    alike = alike.join(classes, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")))
    alike = staged(alike.drop("c_source", "c_class").withColumn("bucket", bucket), "mix-alike")
    earlier = Window.partitionBy("source", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(alike.groupBy("source", "class", "bucket").agg(F.sum("n").alias("n"))
                         .withColumn("bucket_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
                         .select(F.col("source").alias("b_source"), F.col("class").alias("b_class"),
                                 F.col("bucket").alias("b_bucket"), "bucket_start"), "mix-buckets")
    here = Window.partitionBy("source", "class", "bucket").orderBy("size", "h").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("inside", F.coalesce(F.sum("n").over(here), F.lit(0)))
    alike = alike.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("class") == F.col("b_class")) & (F.col("bucket") == F.col("b_bucket")))
    alike = staged(alike.select("h", F.col("n").alias("n_alike"), (F.col("class_start") + F.col("bucket_start") + F.col("inside")).alias("before"),
                                "source_size", "weight", "target", "rate", "offset"), "mix-stretches")
    rows = base.join(alike, "h")
    again = ordered_row_number(rows.filter("n_alike > 1"), ["h"], "uid", "uid", "nth", 8192.0, numeric=True)
    rows = rows.filter("n_alike = 1").withColumn("nth", F.lit(1)).unionByName(again)
    rank = F.col("before") + F.col("nth")
    crossed = F.floor(rank * F.col("rate") + F.col("offset")) - F.floor((rank - 1) * F.col("rate") + F.col("offset"))
    return rows.select("uid", "doc_id", "source", "size", "source_size", "weight", "target", "rate", crossed.cast("long").alias("copies"))


def placed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None,
           **options) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, rate and copies of every row; texts are read once."""
    uid = fresh("uid")
    numbered_docs = docs.withColumn(uid, F.monotonically_increasing_id())
    return place(staged(_with_size(numbered_docs, uid, id_col, text_col, source_col, size_col), "mix-rows"), **options).drop("uid")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        size_col: str | None = None, **options) -> DataFrame:
    """All rows of ``docs`` as struct ``row``, with source, size, source_size, weight,
    target, rate and ``copies``, the number of times the mix takes the row.

    The rows are written once with a number; only sizes and hashes are placed, and the
    copies are joined back by the number."""
    uid = fresh("uid")
    copy = staged(docs.withColumn(uid, F.monotonically_increasing_id()), "mix-docs")
    found = staged(place(staged(_with_size(copy, uid, id_col, text_col, source_col, size_col), "mix-rows"), **options).drop("doc_id"), "mix-copies")
    whole = copy.select(F.col(uid).alias("uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # The copies grow with the rows: dealt by number at every size, not sent to all tasks where they are few.
    return whole.join(found.hint("merge"), "uid").drop("uid")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged."""
    return (mix(docs, **options).filter("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
            .select("row.*"))
