"""Exact top-k search by inner product on a bit-sliced index.

Every component x becomes floor(64 x). The rows are dealt to blocks of about
``BLOCK_ROWS`` at most; a block's index holds, for each component and each binary digit,
one bitmap over the block's rows (the slice), the highest digit being the sign. A
query's scores are again slices: for each digit of each of its components, the
block's slices are added at that weight by carry-save adders on whole bitmaps, once
for positive and once for negative terms. The top rows are then read off from the
most significant score slice downward: rows with the digit stay ahead as long as
at most k are ahead. What is left at the end are rows of one score, and of those
the smallest ids are taken. Scores are exact integers; nothing is estimated.

Every row is sent to the task of its block once, raw; the block's index is built there
when the first query arrives, and the queries, dealt to all blocks, are read after the rows and
answered in the batches they come in. So no index is copied, and a task holds one block
and one batch of queries. It returns k rows for each query, of which the k best over all
blocks remain. A block holds at most ``BLOCK_VALUES`` components.

Defined cases: a vector that is null or has null or non-finite components takes no
part, nor does a row with a null id; an empty vector scores 0; of two vectors of
different length the shorter counts as padded with zeros; a repeated row is a
candidate of its own, and a query of its own (its rows have the same query_id);
components whose floor(64 x) needs more than 62 bits, and scores that need more than
64, are an error; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, staged

SCALE = 64
K = 20
BLOCK_ROWS = 16384
#: Components that a block holds at most: 8 MB as doubles.
BLOCK_VALUES = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def quantised(vectors, dims: int) -> np.ndarray:
    """Rows of floor(64 x), padded with zeros to ``dims``."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    out = np.floor(SCALE * out)
    if out.size and np.abs(out).max() >= 2.0 ** 62:
        raise ValueError("a component is too large for the index")
    return out.astype(np.int64)


def slices_of(values: np.ndarray) -> np.ndarray:
    """(rows, dims) integers -> (dims, digits, words) bitmaps over the rows, two's complement."""
    n, dims = values.shape
    top = max(int(values.max(initial=0)), -1 - int(values.min(initial=0)))
    digits = top.bit_length() + 1
    padded = -(-max(n, 1) // 64) * 64
    out = np.zeros((dims, digits, padded // 64), dtype=np.uint64)
    for b in range(digits):
        bits = np.zeros((dims, padded), np.uint8)
        bits[:, :n] = (values.T >> b) & 1
        out[:, b] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out


def added(planes: dict[int, list[np.ndarray]], width: int, words: int) -> np.ndarray:
    """The sum of bitmaps given by weight (a power of two), as ``width`` slices."""
    out = np.zeros((width, words), np.uint64)
    for k in range(width):
        if not planes.get(k):
            continue
        rows = np.concatenate(planes[k])
        carries = planes.setdefault(k + 1, [])
        while len(rows) > 1:
            if len(rows) == 2:
                a, b = rows[:1], rows[1:]
                carries.append(a & b)
                rows = a ^ b
                break
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m:2 * m], rows[2 * m:3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rows[3 * m:]])
        out[k] = rows[0]
    return out


def score_slices(index: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Two's complement slices of the inner products of ``query`` with all rows."""
    dims, digits, words = index.shape
    size = np.abs(query)
    width = (sum(size.tolist()) << (digits - 1)).bit_length() + 2  # of any length, so not in 64 bits
    plus: dict[int, list] = {}
    minus: dict[int, list] = {}
    for a in range(int(size.max(initial=0)).bit_length()):
        on = (size >> a) & 1 == 1
        for negative in (False, True):
            which = np.flatnonzero(on & ((query < 0) == negative))
            if len(which):
                for b in range(digits):
                    side = minus if negative != (b == digits - 1) else plus
                    side.setdefault(a + b, []).append(index[which, b])
    p, m = added(plus, width, words), added(minus, width, words)
    borrow = np.zeros(words, np.uint64)
    for k in range(width):  # p - m
        x, y = p[k], m[k]
        d = x ^ y
        p[k], borrow = d ^ borrow, (~x & y) | (~d & borrow)
    return p


def best_rows(slices: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores among the rows of a bitmap; equal scores by
    position. The sign slice counts the other way round."""
    ahead, level = np.zeros_like(among), among
    count = lambda x: int(np.bitwise_count(x).sum())
    have = 0
    for d in range(len(slices) - 1, -1, -1):
        digit = ~slices[d] if d == len(slices) - 1 else slices[d]
        up = level & digit
        n = count(up)
        if have + n > k:
            level = up
        else:
            ahead, have, level = ahead | up, have + n, level & ~digit
            if have == k:
                break
    at = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    first = at(ahead)
    return np.concatenate([first, at(level)[:k - len(first)]])


def scores_at(slices: np.ndarray, rows: np.ndarray) -> np.ndarray:
    bits = (slices[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
    weights = [1 << d for d in range(len(slices))]
    weights[-1] = -weights[-1]
    wide = object if len(slices) > 62 else np.int64
    total = (bits.astype(np.int64).astype(wide) * np.array(weights, dtype=wide)[:, None]).sum(axis=0)
    return total.astype(np.int64)  # a score beyond 64 bits is an error


_FOUND = "query_uid long, query_id long, uid long, vec_id long, score long"


def blocks_for(rows: int, dims: int, block_rows: int = BLOCK_ROWS) -> int:
    """Number of blocks: as few as memory allows, since a query has a fixed cost in each."""
    return max(1, -(-rows // max(1, min(block_rows, BLOCK_VALUES // max(1, dims)))))


def _answer(dims: int, k: int):
    """Reads rows sorted by block, the block's own rows before its queries."""
    def answers(block: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        table, uids, ids, every, place = block
        out = []
        queries = quantised(asked["v"].to_list(), dims)
        for query, uid, qid in zip(queries, asked["uid"].tolist(), asked["id"].tolist()):
            among = every.copy()
            if (own := place.get(uid)) is not None:
                among[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
            slices = score_slices(table, query)
            top = best_rows(slices, among, k)
            out.append(pd.DataFrame({"query_uid": uid, "query_id": qid, "uid": uids[top], "vec_id": ids[top],
                                     "score": scores_at(slices, top)}))
        return pd.concat(out)

    def indexed(rows: pd.DataFrame) -> tuple:
        rows = rows.sort_values(["id", "uid"])
        table = slices_of(quantised(rows["v"].to_list(), dims))
        uids, ids = rows["uid"].to_numpy("int64"), rows["id"].to_numpy("int64")
        every = np.packbits(np.arange(table.shape[2] * 64) < len(rows), bitorder="little").view(np.uint64)
        return table, uids, ids, every, {u: i for i, u in enumerate(uids.tolist())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, block = None, [], None
        for batch in batches:
            for here, part in batch.groupby("block", sort=True):
                if here != at:
                    at, held, block = here, [], None
                own = part[~part["asked"]]
                if len(own):
                    held.append(own)
                asked = part[part["asked"]]
                if len(asked) and held:
                    block, held = indexed(pd.concat(held)), []
                if len(asked) and block:
                    yield answers(block, asked)
    return run


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding",
           k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best other rows."""
    ship_package(vectors.sparkSession)
    rows = staged(vectors.filter(usable(F.col(f"`{vector_col}`")) & F.col(f"`{id_col}`").isNotNull())
                  .select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("id"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("v")), "topk-rows")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dims = int(dims or 0)
    blocks = blocks_for(n, dims, block_rows)
    own = rows.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("long").alias("block"), F.lit(False).alias("asked"), "uid", "id", "v")
    asked = rows.filter("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                                       F.lit(True).alias("asked"), "uid", "id", "v")
    dealt = own.unionByName(asked).repartition("block").sortWithinPartitions("block", "asked")
    found = dealt.mapInPandas(_answer(dims, k), _FOUND)
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
