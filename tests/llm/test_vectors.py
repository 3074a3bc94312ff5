import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labwave.llm import embedding_dedup, topk
from labwave.llm.queries import op2_topk_search, op9_embedding_near_dedup

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("uid", T.StringType()), T.StructField("node", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "y") for i, v, label in rows], SCHEMA)


def odd():
    return [(1000, None, 1), (1001, [0.1, None, 0.2], 1), (1002, [float("nan"), 0.0, 1.0], 1), (1003, [float("inf"), 0.0, 1.0], 1),
            (1004, [0.0, 0.0, 0.0], 1), (1005, [0.5, 0.5, 0.5], None), (None, [0.5, 0.5, 0.5], 1), (1007, [], 1)]


def brute_topk(rows, step, k=20):
    rows = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in rows), default=0)
    rows = [(i, np.pad(v, (0, dims - len(v)))) for i, v in rows]
    want = set()
    for a, (i, v) in enumerate(rows):
        if i % step == 0:
            best = sorted(((-int(v @ w), j) for b, (j, w) in enumerate(rows) if a != b))[:k]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return want


@pytest.mark.parametrize("blocks, batch", [(16384, 10000), (37, 10000), (37, 7)])
def test_topk_equals_brute_force(spark, blocks, batch):
    rng = np.random.default_rng(0)
    rows = [(i, np.round(rng.standard_normal(5), 1), 1) for i in range(300)] + odd() + [(2000, [1.0, -2.0], 1)]
    rows += [(i, [0.25] * 5, 2) for i in range(400, 430)]  # ties
    setting, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(setting, batch)  # blocks and their queries cut anywhere
    try:
        got = topk.search(table(spark, rows), F.col("vec_id") % 20 == 0, block_rows=blocks).collect()
    finally:
        spark.conf.set(setting, before)
    assert {tuple(r) for r in got} == brute_topk(rows, 20) and len(got) == len(set(got))


def test_blocks_fit_memory():
    assert topk.blocks_for(0, 0) == 1 and topk.blocks_for(16384, 64) == 1 and topk.blocks_for(16385, 64) == 2
    assert topk.blocks_for(10 ** 6, 4096) == -(-10 ** 6 // 256)


def test_rows_are_shuffled_once_and_no_index_is_copied(spark):
    rows = [(i, [1.0, float(i)], 1) for i in range(40)]
    found = topk.search(table(spark, rows), F.col("vec_id") % 20 == 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Generate") == 1 and "Join" not in plan


def test_topk_few_rows_and_repeats(spark):
    rows = [(0, [1.0, 0.0], 1), (3, [0.5, 0.5], 1), (0, [1.0, 0.0], 1)]
    got = sorted(map(tuple, topk.search(table(spark, rows), F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 0, 4096), (0, 1, 0, 4096), (0, 2, 3, 2048), (0, 2, 3, 2048)]
    assert topk.search(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    with pytest.raises(Exception, match="too large"):
        topk.search(table(spark, [(0, [1e30], 1), (1, [1.0], 1)]), F.col("vec_id") % 20 == 0).collect()


def test_bit_sliced_sums():
    rng = np.random.default_rng(1)
    for hi in (1, 40, 5000):
        values, query = rng.integers(-hi, hi + 1, (130, 7)), rng.integers(-hi, hi + 1, 7)
        slices = topk.score_slices(topk.slices_of(values), query)
        assert (topk.scores_at(slices, np.arange(130)) == values @ query).all()


def brute_links(rows, threshold=0.93):
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None
            and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = list(range(len(good)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    n = [0] * len(good)
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, v, lv), (j, w, lw) = good[a], good[b]
            if lv == lw and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                n[a] += 1
                n[b] += 1
                root[max(find(a), find(b), key=lambda x: good[x][0])] = min(find(a), find(b), key=lambda x: good[x][0])
    out = {(i, 0, i, i is not None) for i, *_ in rows if i not in {g[0] for g in good}}
    return out | {(good[a][0], n[a], good[find(a)][0], find(a) == a) for a in range(len(good))}


def clusters(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 7)):
            rows.append((len(rows), base + rng.normal(0, rng.choice([0.0, 0.1, 0.25, 0.4]), 16), int(c % 3)))
    return rows


@pytest.mark.parametrize("block", [2048, 20])
def test_links_equal_brute_force(spark, block):
    rows = clusters(4, 60) + odd() + [(3000, [0.3, 0.4], 1), (3001, [0.3, 0.4], 1), (3002, [0.6, 0.8], 1), (3003, [0.3, 0.4], 2)]
    got = {tuple(r) for r in embedding_dedup.near_vectors(table(spark, rows), block_rows=block).collect()}
    assert got == brute_links(rows) and sum(r[1] for r in got) > 100


def test_large_group_of_copies_and_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(500)] + [(900, [1.0, 2.0, 3.01], 1)]
    got = embedding_dedup.near_vectors(table(spark, rows)).collect()
    assert {r.n_links for r in got} == {500} and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert embedding_dedup.near_vectors(table(spark, [])).count() == 0


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((300, 64)), rng.standard_normal((200, 64))
    turn = embedding_dedup.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bits, factor = embedding_dedup.encode(a, turn)
    unit_a, unit_b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    estimate, upper = embedding_dedup.estimates(bits, factor, (unit_b @ turn).astype(np.float32))
    exact = unit_a @ unit_b.T
    assert (upper >= exact).all() and abs((estimate - exact).mean()) < 0.005 and (estimate - exact).std() < 0.15


def test_queries_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op2_topk_search(spark, sf).collect()} == brute_topk(rows, 20)
    assert {tuple(r) for r in op9_embedding_near_dedup(spark, sf).collect()} == brute_links(rows)


def test_large_components_are_searched_exactly(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([(2.0 ** 25, -1.0), (2.0 ** 25 + 1, 3.5), (-2.0 ** 24, 2.0), (0.5, -2.0 ** 23), (1.0, 1.0)])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 0).collect()
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    want = {(q, c): sum(a * b for a, b in zip(ints[q], ints[c])) for q in ints for c in ints if q != c}
    assert {(r.query_id, r.vec_id): r.score for r in got} == want
