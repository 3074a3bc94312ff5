"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is rotated at random; the signs of the result, c in {-1, 1}^D / sqrt(D),
are its code, and f = <c, o> is stored with it as correction factor. For another
unit vector q, s = <c, q> gives s / f, an unbiased estimate of the cosine <o, q>, and

    f s - sqrt(1 - f^2) sqrt(1 - s^2)  <=  <o, q>  <=  f s + sqrt(1 - f^2) sqrt(1 - s^2)

holds for certain (what c leaves of o is orthogonal to c). Pairs whose upper bound
stays below the threshold are settled by their codes; every other pair is computed
exactly in double precision, so no link is missed and none is invented.

Equal vectors of a label are one row from the start. A label's vectors are dealt to
blocks, blocks of a label meet in pairs, and a task that compares two blocks
returns link counts and a spanning forest of the links, never the pairs. The number
of block pairs grows with the square of a label's size; that is the price of
losing no link.

Defined cases: a vector that is null, empty, zero or has null or non-finite
components links with nothing, nor does a row with a null label or null id, nor
vectors of different length; a repeated row counts as another vector; a row with
a null id has a null component and is not kept by name; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, staged
from .components import components
from .topk import usable

THRESHOLD = 0.93
BLOCK_ROWS = 2048
SEED = 9
#: Added to bounds for their single-precision arithmetic.
SLACK = 1e-4
_CHUNK = 256


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factors of the rows."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimates(bits: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of coded rows with rotated unit vectors, and upper bounds."""
    dims = turned.shape[1]
    code = (np.unpackbits(bits, axis=1, count=dims).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dims))
    s = np.clip(code @ turned.T, -1, 1)
    f = factor.astype(np.float32)[:, None]
    upper = f * s + np.sqrt(np.maximum(0, 1 - f * f)) * np.sqrt(1 - s * s)
    return s / f, upper + np.float32(SLACK)


def links(a: np.ndarray, bits: np.ndarray, factor: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``threshold``."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    turned = ((b / nb[:, None]) @ turn).astype(np.float32)
    out = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), _CHUNK):
        part = slice(at, at + _CHUNK)
        _, upper = estimates(bits[part], factor[part], turned)
        i, j = np.nonzero(upper >= threshold)
        i += at
        for k in range(0, len(i), 32768):
            x, y = i[k:k + 32768], j[k:k + 32768]
            out[x, y] = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
    return out


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    left, edges = near.any(axis=1), []
    for root in np.flatnonzero(left):
        if not left[root]:
            continue
        left[root], todo = False, [int(root)]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(near[i] & left)
            left[found] = False
            todo += found.tolist()
            edges += [(i, int(j)) for j in found]
    return edges


_BLOCK = "label string, dims int, block long, blocks long, node binary, times binary, vectors binary, bits binary, factor binary"


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    ship_package(vectors.sparkSession)
    v = F.col(f"`{vector_col}`").cast("array<double>")
    links_at_all = usable(F.col(f"`{vector_col}`")) & F.exists(v, lambda x: x != 0) & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(links_at_all, F.col(f"`{label_col}`").cast("string")).alias("label"),
                          F.when(links_at_all, v).alias("v"))
    classes = staged(rows.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("times"))
                         .withColumn("dims", F.size("v")), "vectors-classes")
    sizes = staged(classes.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("blocks")), "vectors-sizes")
    dealt = classes.join(sizes, ["label", "dims"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["v"].to_list(), dtype="<f8")
        bits, factor = encode(x, rotation(x.shape[1]))
        first = part.iloc[0]
        return pd.DataFrame({"label": [first["label"]], "dims": [first["dims"]], "block": [first["block"]], "blocks": [first["blocks"]],
                             "node": [part["node"].to_numpy("<i8").tobytes()], "times": [part["times"].to_numpy("<i8").tobytes()],
                             "vectors": [x.tobytes()], "bits": [bits.tobytes()], "factor": [factor.astype("<f8").tobytes()]})

    blocks = staged(dealt.groupBy("label", "dims", "block").applyInPandas(pack, _BLOCK), "vectors-blocks")
    meeting = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meeting = meeting.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        one, two = part.iloc[0], part.iloc[-1]
        dims = int(one["dims"])
        read = lambda r, c, kind, shape=(-1,): np.frombuffer(r[c], kind).reshape(shape)
        a, b = read(one, "vectors", "<f8", (-1, dims)), read(two, "vectors", "<f8", (-1, dims))
        near = links(a, read(one, "bits", np.uint8, (len(a), -1)), read(one, "factor", "<f8"), b, rotation(dims), threshold)
        if len(part) == 1:
            np.fill_diagonal(near, False)
            near |= near.T
            node, times = read(one, "node", "<i8"), read(one, "times", "<i8")
            linked, whole = near @ times, near
        else:
            node = np.concatenate([read(one, "node", "<i8"), read(two, "node", "<i8")])
            linked = np.concatenate([near @ read(two, "times", "<i8"), near.T @ read(one, "times", "<i8")])
            whole = np.zeros((len(node), len(node)), bool)
            whole[:len(a), len(a):] = near
            whole |= whole.T
        some = linked > 0
        edges = [(int(node[i]), int(node[j]), 0) for i, j in spanning(whole)]
        counts = list(zip(node[some].tolist(), node[some].tolist(), linked[some].tolist()))
        return pd.DataFrame(counts + edges, columns=["a", "b", "n"]).astype("int64")

    found = staged(meeting.groupBy("label", "dims", "low", "high").applyInPandas(compare, "a long, b long, n long"), "vectors-links")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = components(found.filter("n = 0").select("a", "b"), "vectors")
    named = staged(classes.join(counts, "node", "left").join(linked, "node", "left")
                   .select(F.col("label"), F.col("v"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"),
                           F.coalesce("component", "node").alias("component_id")), "vectors-named")
    return rows.join(named, ["label", "v"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
