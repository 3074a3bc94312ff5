"""Cross-site line deduplication by distinct-site spread.

Every line is hashed (128 bits, white space at its ends aside). For each hash a
HyperLogLog sketch of the sites it occurs on is built by a grouped aggregate, whose
partial sketches merge across tasks. A line on at least ``MIN_SITES`` sites is
boilerplate: it stays where it occurs first (smallest document id, then line) and
goes everywhere else. Estimates further from the limit than the sketch's error
decide at once; lines nearer get an exact distinct count.

Only DataFrame functions are used. Lines travel as hashes; texts are cut up and
joined again within their own row. A line that half of all documents share is
combined before the shuffle, and the join back reads written tables on both sides,
so its rows can be split.

Defined cases: a null text stays null and has no lines; an empty or blank line is
never boilerplate; a null site is no site; a null id comes first; a repeated row
(same id, text and site) is the same document, edited alike; a document that loses
all its lines stays with an empty text; an empty table gives an empty result; other
columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh, staged

MIN_SITES = 5
#: Every line that has a word is judged by its spread, however short it is.
MIN_WORDS = 1
LG_K = 12
#: Standard error of a merged sketch, and how many of them count as near.
ERROR, NEAR = 1.04 / (1 << LG_K) ** 0.5, 6.0
_BLANK = " \t\r\x0b\x0c"


def _key(id_col, text_col, site_col):
    row = [F.col(f"`{c}`").cast("string") for c in (id_col, text_col, site_col)]
    return [F.xxhash64(*row), F.xxhash64(F.lit(8), *row)]


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, removed_col: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines gone from the text; ``removed_col`` adds their number."""
    k1, k2 = _key(id_col, text_col, site_col)
    bare = F.btrim("line", F.lit(_BLANK))
    occ = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{site_col}`").cast("string").alias("site"), k1.alias("k1"),
                      k2.alias("k2"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("at", "line"))
    enough = WORD + f"(?:{SPACE}{WORD}){{{min_words - 1}}}"  # that many words
    occ = staged(occ.filter(F.col("line").rlike(enough))
                 .select("id", "site", "k1", "k2", "at", F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2")), "lines")
    spread = (occ.groupBy("h1", "h2")
                 .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("id", "k1", "k2", "at")).alias("first"))
                 .select("h1", "h2", "first", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("sites")))
    band = max(1.0, NEAR * ERROR * min_sites)
    spread = staged(spread.filter(F.col("sites") >= min_sites - band), "line-spread")
    sure = spread.filter(F.col("sites") > min_sites + band)
    near = spread.filter(F.col("sites") <= min_sites + band)
    exact = (occ.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
                .groupBy("h1", "h2").agg(F.count("site").alias("n")).filter(F.col("n") >= min_sites))
    near = near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")
    common = staged(sure.unionByName(near).select("h1", "h2", "first"), "line-common")
    gone = (occ.join(common, ["h1", "h2"]).filter(F.struct("id", "k1", "k2", "at") != F.col("first"))
               .groupBy("k1", "k2").agg(F.collect_set("at").alias("gone")))
    gone = staged(gone, "line-gone")
    a, b, g, lines = fresh("k1"), fresh("k2"), fresh("gone"), fresh("lines")
    gone = gone.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("gone").alias(g))
    out = docs.withColumn(a, k1).withColumn(b, k2).join(gone, [a, b], "left")
    text = F.col(f"`{text_col}`")
    # Kept positions by a hash-based set difference, so a long text takes linear time.
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g))
    picked = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    out = out.withColumn(lines, F.when(F.col(g).isNotNull(), F.split(text, "\n", -1)))
    if removed_col:
        out = out.withColumn(removed_col, F.when(F.col(g).isNull(), F.lit(0)).otherwise(F.size(g)))
    return out.withColumn(text_col, F.when(F.col(g).isNull(), text).otherwise(picked)).drop(a, b, g, lines)
