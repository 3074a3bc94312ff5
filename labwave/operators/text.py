"""Text helpers: fixed-width chunks and ordered group concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import ordered_prefix_sums


def chunk_text(df: DataFrame, id_col: str, text_col: str, size: int = 4096) -> DataFrame:
    """Every text cut into consecutive pieces of ``size`` characters (the last may
    be shorter); an empty or null text has no piece. Whole texts, row-parallel, cut in
    one pass over each text."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{int(size)}}}"), F.lit(0))
    return df.select(id_col, F.posexplode(pieces).alias("chunk_no", "chunk"))


#: Characters of a group's text in one piece (and its last line).
PIECE_CHARS = 65_536


def concat_group_text(df: DataFrame, group: str = "conv_id", order: str = "turn",
                      role: str = "role", text: str = "text", sep: str = "\n",
                      piece_chars: int = PIECE_CHARS, rows_per_range: int | None = None) -> DataFrame:
    """Each group's ``role: text`` lines in ``order``, joined by ``sep``, as pieces:
    (group, piece_no, joined_text, n_lines). A piece holds the lines that start within
    ``piece_chars`` characters of the group's text, so the text of a group with a huge
    share of the rows is never gathered in one row, whatever its orders are; where the
    lines start is a running sum over the group's rows (a segmented scan). The pieces
    in order, joined by ``sep``, are the whole. A null order comes last; equal orders go
    by role, then text. A number without a line of its own is no piece.
    """
    line = F.concat_ws(": ", F.col(role), F.col(text))
    d = df.select(group, order, role, text, line.alias("_line")).withColumns({
        "_size": F.length("_line").cast("long") + len(sep), "_by": F.struct(role, text)})
    d = ordered_prefix_sums(d, [group], order, "_by", {"_upto": F.col("_size")}, 1024.0, numeric=True, rows_per_range=rows_per_range)
    d = d.withColumn("piece_no", F.floor((F.col("_upto") - F.col("_size")) / F.lit(piece_chars)))
    d = d.withColumn("_last", F.col(order).isNull())
    sep_sql = sep.encode("unicode_escape").decode().replace("'", "\\'")
    return d.groupBy(group, "piece_no").agg(
        F.expr(f"listagg(_line, '{sep_sql}') WITHIN GROUP (ORDER BY struct(_last, `{order}`, `{role}`, `{text}`))").alias("joined_text"),
        F.count(F.lit(1)).alias("n_lines"))
