"""Ranked lexical search by dense blocked matrix multiplication.

The items are dealt to rounds whose terms fill at most ``ROUND_BYTES`` (or are those
of one item). A round's vocabulary is sent to the tasks, which read every whole text
once into sparse rows (document, length, vocabulary numbers, occurrences); corpus
size, lengths and document frequencies are aggregates of all these rows. A task then
multiplies tiles: ``TILE_ITEMS`` items over the compact vocabulary of just these
items, ``TILE_TERMS`` of its terms at a time, times the impacts of ``TILE_DOCS``
documents. All factors are integers and a tile's partial sums stay below 2^53, so the
float64 products are exact in any order; they are summed as 64-bit integers.

From each tile an item keeps every document that reaches its k-th best score, equal
scores included, and only then ties are settled by id; a task returns k rows for
each item, of which the k best remain. Postings never move between machines.

Defined cases: a null or empty text, and one without a term, has no terms and does not
count; an item without terms ranks nothing; a repeated document counts and ranks as
often as it is there; a repeated item is ranked each time; a null document id comes
after all others among equal scores; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import ordered_prefix_sums
from .common import ship_package, staged

# What a term consists of, and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WEIGHT, LENGTH_SHARE, IMPACT, SLOPE, LENGTH_SLOPE = 1000, 90, 1_000_000_000, 1000, 8

K = 10
#: Bytes of the terms whose items are searched in one pass over the texts.
ROUND_BYTES = 4 << 20
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 2048, 1024
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # TERM over the bytes of UTF-8
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_POSTINGS = "none boolean, doc_id long, uid long, n long, terms array<int>, tfs array<int>"
_HITS = "item int, score long, none boolean, doc_id long, uid long"


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces that end between two terms."""
    text, at = text.lower(), 0  # bytes: only A-Z
    while at < len(text):
        cut = _BREAK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield _TERM.findall(text, at, end)
        at = end


def counted(text: str | None, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms; numbers of the terms in the vocabulary, and how often each occurs."""
    n, found = 0, []
    for terms in term_lists((text or "").encode("utf-8", "surrogatepass")):
        n += len(terms)
        found += [x for x in map(vocabulary.get, terms) if x is not None]
    terms, tfs = np.unique(np.array(found, dtype=np.int32), return_counts=True)
    return n, terms, tfs.astype(np.int32)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows of documents with a term: none (the id is null), doc_id, uid, n, and their vocabulary terms."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most ROUND_BYTES, or one item's terms

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, terms, tfs = zip(*[counted(t, sent.value) for t in batch["text"].array]) if len(batch) else ([], [], [])
            out = batch[["none", "doc_id", "uid"]].assign(n=list(n), terms=list(terms), tfs=list(tfs))
            yield out[out["n"] > 0]

    return docs.mapInPandas(read, _POSTINGS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log(float(2 * n_docs + 2) / float(2 * df + 1)))


def impacts(n: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of terms that occur ``tf`` times in documents of ``n`` terms, in 64-bit integers."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms
    return (IMPACT * tf) // (SLOPE * tf + LENGTH_SLOPE * m)


def item_tiles(items: list[np.ndarray], weights: np.ndarray) -> list[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Items, as term numbers -> tiles: first item, its vocabulary, and of each item
    the columns and weights of its terms there."""
    tiles = []
    for at in range(0, len(items), TILE_ITEMS):
        part = items[at:at + TILE_ITEMS]
        words = np.unique(np.concatenate([np.empty(0, np.int32), *part]))
        tiles.append((at, words, [(np.searchsorted(words, x), weights[x]) for x in part]))
    return tiles


def tile_scores(tile, n_words: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
    """(items, documents) scores as integers; ``doc``, ``term`` and ``impact`` are parallel."""
    _, words, items = tile
    column_of = np.full(n_words, -1, np.int32)
    column_of[words] = np.arange(len(words), dtype=np.int32)
    column = column_of[term]
    total = np.zeros((len(items), n_docs), np.int64)
    for low in range(0, len(words), TILE_TERMS):
        width = min(TILE_TERMS, len(words) - low)
        here = (column >= low) & (column < low + width)
        right = np.zeros((n_docs, width))
        right[doc[here], column[here] - low] = impact[here]
        left = np.zeros((len(items), width))
        for i, (columns, weights) in enumerate(items):
            inside = (columns >= low) & (columns < low + width)
            left[i, columns[inside] - low] = weights[inside]
        if left.max(initial=0.0) * right.max(initial=0.0) * width >= 2.0 ** 53:
            raise ValueError("partial sums do not fit in float64; take a smaller TILE_TERMS")
        total += (left @ right.T).astype(np.int64)
    return total


def best(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each item: by score, then id (null last), then uid."""
    hits = hits.sort_values(["item", "score", "none", "doc_id", "uid"], ascending=[True, False, True, True, True])
    return hits[hits.groupby("item").cumcount() < k]


def candidates(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, document) that may be among an item's k best: at least its k-th score of
    these documents and ``least``, all ties included."""
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
    return np.nonzero(scores >= least[:, None])


def searched(rows: DataFrame, tiles, n_words: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, score, none, doc_id, uid): k rows for each item and task."""
    sent = rows.sparkSession.sparkContext.broadcast(tiles)  # one round's items
    n_items = sum(len(t[2]) for t in tiles)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, least = None, np.ones(n_items, np.int64)
        for batch in batches:
            for at in range(0, len(batch), TILE_DOCS):
                part = batch.iloc[at:at + TILE_DOCS]
                lengths = part["terms"].map(len).to_numpy()
                if not lengths.any():
                    continue
                doc = np.repeat(np.arange(len(part)), lengths)
                term, tf = np.concatenate(part["terms"].to_list()), np.concatenate(part["tfs"].to_list()).astype(np.int64)
                impact = impacts(part["n"].to_numpy(np.int64)[doc], tf, n_docs, n_terms)
                found = [] if kept is None else [kept]
                for tile in sent.value:
                    first, size = tile[0], len(tile[2])
                    scores = tile_scores(tile, n_words, doc, term, impact, len(part))
                    item, which = candidates(scores, least[first:first + size], k)
                    found.append(pd.DataFrame({"item": first + item, "score": scores[item, which]}).join(
                        part[["none", "doc_id", "uid"]].iloc[which].reset_index(drop=True)))
                kept = best(pd.concat(found, ignore_index=True), k)
                full = kept.groupby("item")["score"].agg(["size", "min"])
                full = full[full["size"] == k]
                least[full.index.to_numpy()] = full["min"].to_numpy()
        if kept is not None:
            yield kept.astype({"item": "int32"})

    return rows.mapInPandas(run, _HITS)


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = K, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    ship_package(spark)
    doc_id = F.col(f"`{id_col}`").cast("long")
    read = docs.select(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), F.monotonically_increasing_id().alias("uid"),
                       F.col(f"`{text_col}`").alias("text"))
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.col(f"`{item_text_col}`"), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    asked = staged(items.select(F.col(f"`{item_col}`").alias("item_id"), F.monotonically_increasing_id().alias("item_uid"), terms.alias("terms"))
                   .filter(F.size("terms") > 0), "lexical-items")
    size = F.octet_length(F.array_join("terms", " ")).cast("long")
    asked = staged(ordered_prefix_sums(asked.withColumn("size", size), [], "item_uid", "item_uid", {"upto": F.col("size")}, 4096.0, numeric=True)
                   .withColumn("round", F.floor((F.col("upto") - F.col("size")) / round_bytes)), "lexical-rounds")
    corpus, parts = None, []
    for row in asked.select("round").distinct().orderBy("round").toLocalIterator():  # one row for each ROUND_BYTES
        of_round = asked.filter(F.col("round") == row["round"])
        mine = of_round.select("item_uid", "terms").orderBy("item_uid").collect()  # at most ROUND_BYTES, or one item
        vocabulary = {w.encode(): i for i, w in enumerate(sorted({w for r in mine for w in r["terms"]}))}
        rows = staged(postings(read, vocabulary), "lexical-postings")
        if corpus is None:
            corpus = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        n_docs, n_terms = corpus
        if not n_docs:
            break
        weights = np.zeros(len(vocabulary), np.int64)
        counts = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
        for c in counts.collect():  # the round's vocabulary
            weights[c["term"]] = weight(n_docs, c["count"])
        tiles = item_tiles([np.array([vocabulary[w.encode()] for w in r["terms"]], np.int32) for r in mine], weights)
        hits = searched(rows, tiles, len(vocabulary), n_docs, n_terms, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "none", "doc_id", "uid")
        hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        hits = hits.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id")))
        names = spark.createDataFrame([(i, r["item_uid"]) for i, r in enumerate(mine)], "item int, item_uid long")
        parts.append(staged(hits.join(names, "item").join(of_round.select("item_uid", "item_id"), "item_uid")
                            .select("item_id", "rank", "doc_id", "score"), "lexical-hits"))
    if not parts:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"),
                            F.lit(0).cast("long").alias("score")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
