import re
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from labwave.llm import simhash
from labwave.llm.components import components
from labwave.llm.queries import op5_simhash_near_dedup

from .helpers import documents, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b) and find(a) != find(b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def by_distance(fps):
    return plain_components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2 ** 64 - 1), st.lists(st.integers(0, 63), max_size=3, unique=True))
def test_close_fingerprints_share_an_anchor(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    keys = []
    for v in (x, y):
        mine = set()
        for which in (0, 1):
            near, n = simhash.anchors(np.array([v >> 32 * which & 0xFFFFFFFF], dtype=np.uint32))
            mine |= {(which, int(a)) for a in near[0, :n[0]]}
        keys.append(mine)
    assert keys[0] & keys[1]


def test_anchors_are_the_code_words_within_two_bits():
    near, n = simhash.anchors(np.array([0, 1, 0x12345678], dtype=np.uint32))
    assert n.tolist() == [1, 16, 16]
    for row, half, k in zip(near, (0, 1, 0x12345678), n):
        assert len(set(row[:k].tolist())) == k
        for a in row[:k].tolist():
            assert (a ^ (half & 0x7FFFFFFF)).bit_count() <= 2
            assert np.bitwise_xor.reduce([i for i in range(1, 32) if a >> (i - 1) & 1] or [0]) == 0


def planted(seed, n):
    rng = np.random.default_rng(seed)
    fps, out = [int(x) for x in rng.integers(0, 2 ** 63, n)], {}
    for i, base in enumerate(fps):
        for k in range(rng.integers(1, 6)):
            y = base
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                y ^= 1 << int(b)
            out[y] = len(out)
    return {i: f for f, i in out.items()}


def check_links(spark, fps, **options):
    rows = spark.createDataFrame([(signed(f), i) for i, f in fps.items()], "fp long, node long")
    got = {i: i for i in fps} | {r.node: r.component for r in components(simhash.link(rows, **options)).collect()}
    assert got == by_distance(fps)


def test_links_equal_all_pairs(spark):
    check_links(spark, planted(1, 120))


def test_crowded_anchors_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = 0x0123456789ABCDEF
    near = {base ^ 1 << int(a) ^ 1 << int(b) ^ 1 << int(c) for a, b, c in rng.integers(0, 64, (250, 3))}
    far = {base ^ (int(x) << 32) for x in rng.integers(0, 2 ** 31, 60)}
    check_links(spark, dict(enumerate(sorted(near | far))), crowd=6)


def test_forest_spans_small_and_large_runs():
    fps = planted(3, 3)
    fp, node = np.array(list(fps.values()), dtype=np.uint64), np.array(list(fps), dtype=np.int64)
    edges = simhash.forest(fp, node, 3)
    got = plain_components(fps, lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))
    assert got == by_distance(fps) and len(edges) < len(fps)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 200), (200, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{100 + i: 100 for i in range(80)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = odd_rows() + [(30, "One TWO three Four"), (31, "É one two"), (32, "é one two")]
    got = simhash.near_duplicates(documents(spark, rows, clashing=True)).collect()
    assert sorted((r.doc_id or -1, r.fp) for r in got) == sorted((r[0] or -1, signed(plain_fingerprint(r[1]))) for r in rows)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[7] == comp[30] == 1 and comp[2] == comp[3] == comp[6] == 2 and comp[None] is None
    kept = simhash.one_of_each(documents(spark, rows, clashing=True))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([-1] + [i for i in set(comp) - {None} if comp[i] == i])
    assert set(kept.columns) == set(documents(spark, rows, clashing=True).columns)
    repeated = simhash.one_of_each(documents(spark, [(7, "a b c"), (7, "a b c"), (8, "a b c")]))
    assert [r.doc_id for r in repeated.collect()] == [7]


def test_texts_that_share_an_id_stay_apart(spark):
    one, other = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = documents(spark, [(7, one), (7, other), (7, other), (8, one), (9, other), (3, "a b c d"), (10, "a b c d"), (10, "k l m n"), (11, "k l m n")])
    got = sorted((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect())
    assert got == sorted([(7, one), (7, other), (3, "a b c d"), (10, "k l m n")])


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    same = defaultdict(list)
    for i, f in fps.items():
        same[f].append(i)
    comp = by_distance({min(ids): f for f, ids in same.items()})
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", comp[min(same[f])]) for i, f in fps.items()}


def test_texts_are_fingerprinted_once_and_not_shuffled_again(spark):
    """Of the plan that returns the documents, only the written rows of repeated ids are fingerprinted."""
    path = "/root/testdata/sf0.01/documents.parquet"
    plan = simhash.one_of_each(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("ArrowEvalPython", 1)
    assert above.count("sf0.01/documents.parquet") == 1 and "sf0.01/documents.parquet" not in below and "simhash-repeated" in below
