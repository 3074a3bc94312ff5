"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit in one
of their halves. The anchors of a half are the code words of the perfect Hamming
code [31, 26] over its first 31 bits, whose covering radius is 1: every half lies
within 1 bit of exactly one anchor. A fingerprint is sent to every anchor within
covering radius + threshold = 1 + 1 = 2 bits, 16 of 67 million for each half (1 if it
is itself a code word), so two halves that differ in at most 1 bit meet at the
anchor of either. At an anchor, whole fingerprints are compared.

Copies never meet: equal fingerprints are one row from the start. A partition's
rows come sorted by anchor and are compared in one pass; an anchor with many
fingerprints returns a spanning forest of its links, not all pairs. An anchor with
more than ``CROWD`` fingerprints is returned by name only, and its fingerprints meet
again under (anchor, byte of the other half): 3 differing bits leave one of that
half's four bytes equal.

Defined cases: a null text is empty; a text without words has fingerprint zero,
linked like any other; equal texts and repeated rows share a fingerprint and so a
component; texts that share an id are not linked by it; a row with a null id keeps its fingerprint, has a null component and
links nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, fresh, ship_package, staged
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints at one anchor that are compared directly.
CROWD = 4096

_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over word shingles, repeats counted, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[:len(words) - shingle + 1].tolist()
        stops = (ends[shingle - 1:] - 1).tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, stops)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        bits = np.unpackbits(h[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _SHIFTS[2 * ones > len(h)]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, column: str = "fp", text_col: str = "text") -> DataFrame:
    """``docs`` with the fingerprint's 64 bits as a signed long."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts.array], dtype=np.uint64).view(np.int64))

    return docs.withColumn(column, of(F.col(f"`{text_col}`")))


def _ball_masks() -> np.ndarray:
    """By syndrome, what to flip to reach the code words within 2 bits; the first is the
    nearest. Position i (1 to 31) of a half is its bit i - 1."""
    masks = np.zeros((32, 16), dtype=np.uint32)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < (i ^ s) and (i ^ s)]
        masks[s] = [1 << (s - 1)] + [1 << (i - 1) | 1 << (j - 1) for i, j in pairs]
    return masks


_MASKS = _ball_masks()
_PARITY = np.array([sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)], dtype=np.uint32)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 31-bit halves: rows of 16 anchors, and how many of them count (1 or 16)."""
    half = half & np.uint32(0x7FFFFFFF)
    syndrome = np.zeros(len(half), np.uint32)
    for k in range(5):
        syndrome |= (np.bitwise_count(half & _PARITY[k]).astype(np.uint32) & np.uint32(1)) << np.uint32(k)
    return half[:, None] ^ _MASKS[syndrome], np.where(syndrome == 0, 1, 16)


def at_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(fp, node) -> (key, fp, node): one row for each anchor near a half. A key is
    the anchor and, as bit 31, the half."""
    for batch in batches:
        fp, node = batch["fp"].to_numpy(np.int64).view(np.uint64), batch["node"].to_numpy(np.int64)
        for which in (0, 1):
            half = (fp >> np.uint64(32 * which)).astype(np.uint32)
            near, n = anchors(half)
            use = np.arange(16)[None, :] < n[:, None]
            times = use.sum(axis=1)
            yield pd.DataFrame({"key": near[use].astype(np.int64) | which << 31,
                                "fp": np.repeat(fp.view(np.int64), times), "node": np.repeat(node, times)})


def forest(fp: np.ndarray, node: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    left, edges = np.ones(len(fp), bool), []
    for root in range(len(fp)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            i = todo.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return edges
            found = rest[np.bitwise_count(fp[rest] ^ fp[i]) <= max_bits]
            left[found] = False
            todo += found.tolist()
            edges += [(int(node[i]), int(node[j])) for j in found]
    return edges


def _links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, max_bits: int, crowd: int | None) -> pd.DataFrame:
    """Links among rows sorted by key whose keys are all complete; a crowded key is
    returned as (key, null)."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(first, len(key)))
    run = np.repeat(sizes, sizes)
    a, b = [], []
    for d in range(1, min(8, int(sizes.max(initial=0)))):  # small runs, all at once
        same = np.flatnonzero((key[d:] == key[:-d]) & (run[:-d] <= 8))
        same = same[np.bitwise_count(fp[same + d] ^ fp[same]) <= max_bits]
        a.append(node[same])
        b.append(node[same + d])
    out = pd.DataFrame({"a": np.concatenate(a) if a else np.empty(0, np.int64),
                        "b": np.concatenate(b) if b else np.empty(0, np.int64), "crowded": False})
    more = []
    for at, size in zip(first[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
        if crowd and size > crowd:
            more.append((int(key[at]), 0, True))
        else:
            more += [(x, y, False) for x, y in forest(fp[at:at + size], node[at:at + size], max_bits)]
    if more:
        out = pd.concat([out, pd.DataFrame(more, columns=["a", "b", "crowded"])])
    return out.drop_duplicates()


def _compare(max_bits: int, crowd: int | None):
    """Reads rows sorted by key; keeps the rows of the last key until it is complete
    or, with a ``crowd``, has more rows than that."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = np.empty(0, np.int64)
        fp, node, over = np.empty(0, np.uint64), key, None
        for batch in batches:
            key = np.concatenate([key, batch["key"].to_numpy(np.int64)])
            fp = np.concatenate([fp, batch["fp"].to_numpy(np.int64).view(np.uint64)])
            node = np.concatenate([node, batch["node"].to_numpy(np.int64)])
            if over is not None:  # a crowded key's rows are not kept
                rest = key != over
                key, fp, node = key[rest], fp[rest], node[rest]
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield _links(key[:cut], fp[:cut], node[:cut], max_bits, crowd)
                key, fp, node = key[cut:], fp[cut:], node[cut:]
            if crowd and len(key) > crowd:
                over = int(key[0])
                yield pd.DataFrame({"a": [over], "b": [0], "crowded": [True]})
                key, fp, node = key[:0], fp[:0], node[:0]
        if len(key):
            yield _links(key, fp, node, max_bits, crowd)
    return run


def link(distinct: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(fp, node), fingerprints distinct -> edges (a, b) of nodes whose components are
    those of all links."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the two halves cover at most 3 differing bits")
    ship_package(distinct.sparkSession)

    def meet(rows: DataFrame, most: int) -> DataFrame:
        dealt = rows.select("key", "fp", "node").repartition("key").sortWithinPartitions("key")
        return staged(dealt.mapInPandas(_compare(max_bits, most), "a long, b long, crowded boolean"), "simhash-links")

    spread = distinct.select("fp", "node").mapInPandas(at_anchors, "key long, fp long, node long")
    found = meet(spread, crowd)
    edges = found.filter("not crowded").select("a", "b")
    if not found.filter("crowded").isEmpty():
        names = found.filter("crowded").select(F.col("a").alias("key")).distinct()
        rows = spread.join(names, "key", "left_semi").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(3))))
        # The half of the anchor is bit 31 of the key; the other half's bytes deal the rows.
        at = F.when(F.col("key") >= 1 << 31, F.lit(0)).otherwise(F.lit(32)) + F.col("_i") * 8
        byte = F.call_function("shiftrightunsigned", F.col("fp"), at.cast("int")).bitwiseAND(F.lit(255))
        edges = edges.unionByName(meet(rows.withColumn("key", F.xxhash64("key", "_i", byte)), None)
                                  .select("a", "b"))
    return edges


def _groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, fp, component_id (its smallest id), root (its smallest fingerprint)."""
    rows = staged(fingerprints(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                                           F.col(f"`{text_col}`").alias("text"))).drop("text"), "simhash-rows")
    # Fingerprints are the nodes: an id that two texts have must not link them.
    classes = staged(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    linked = components(link(classes.select("fp", F.col("fp").alias("node")), max_bits, crowd), "simhash")
    rooted = staged(classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
                    .select("fp", "low", F.coalesce("component", "fp").alias("root")), "simhash-rooted")
    least = staged(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-least")
    named = staged(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-named")
    of = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return rows.join(named, "fp", "left").select("doc_id", "fp", of("component_id"), of("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id."""
    return _groups(docs, id_col, text_col, max_bits, crowd).drop("root")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id, once
    even if its row is repeated; rows with a null id stay. Columns unchanged. Texts
    that share an id are documents of their own.

    Texts are fingerprinted once and meet only the list of ids that go, which Spark
    sends to all tasks where it has measured it small; ids with several rows are
    taken out, written and fingerprinted anew."""
    groups = _groups(docs, **options)
    stays = F.col("doc_id") == F.col("component_id")
    per_id = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(stays).alias("stays"))
    per_id = staged(per_id.filter("n > 1 or not stays"), "simhash-ids")
    gone = staged(per_id.select("doc_id"), "simhash-gone")
    repeats = staged(per_id.filter("stays").select("doc_id"), "simhash-repeats")
    deleted(per_id)
    fp = fresh("fp")
    picked = (groups.filter(stays).join(repeats, "doc_id", "left_semi").groupBy("doc_id", "root").agg(F.min("fp").alias(fp))
              .select("doc_id", fp))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Written before it is fingerprinted: a filter on the fingerprint would else be tried on all texts.
    repeated = fingerprints(staged(docs.join(repeats, "doc_id", "left_semi"), "simhash-repeated"), fp)
    repeated = repeated.join(staged(picked, "simhash-picked"), ["doc_id", fp], "left_semi")
    repeated = repeated.groupBy("doc_id", fp).agg(F.min_by(F.struct(*columns), F.xxhash64("text")).alias("_row"))
    return docs.join(gone, "doc_id", "left_anti").select(columns).unionByName(repeated.select("_row.*"))
