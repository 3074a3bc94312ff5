import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labwave.llm import lexical
from labwave.llm.queries import op11_lexical_search

from .helpers import documents, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text) -> (item_id, rank, doc_id, score)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        ranked = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m))
                        for w in set(terms(text)) if w in c)
            if score > 0:
                ranked.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(ranked, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_odd_rows_and_ties(spark):
    rows = odd_rows() + [(10 + i, "one tie here") for i in range(30)] + [(None, "one tie here"), (90, "ÉCOLE école Ünï-çode 42"), (2 ** 60 + 1, "tie two")]
    items = [(1, "Tie HERE one"), (1, "Tie HERE one"), (2, None), (3, "..."), (None, "école 42 ÉCOLE"), (5, "word3 word976 x two"), (6, "absent")]
    docs = documents(spark, [(r[0], r[1]) for r in rows], clashing=True)
    assert got(lexical.search(docs, benchmark(spark, items))) == plain([(r[0], r[1]) for r in rows], items)


def test_rounds_and_tiles_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) if x < 400)
    rows, items = [(i, text(rng.integers(0, 60))) for i in range(150)], [(i, text(12)) for i in range(25)]
    want = plain(rows, items, 3)
    docs = documents(spark, rows)
    assert got(lexical.search(docs, benchmark(spark, items), k=3)) == want
    monkeypatch.setattr(lexical, "TILE_TERMS", 5)
    monkeypatch.setattr(lexical, "TILE_DOCS", 7)
    monkeypatch.setattr(lexical, "TILE_ITEMS", 4)
    monkeypatch.setattr(lexical, "PIECE", 9)
    assert got(lexical.search(docs, benchmark(spark, items), k=3, round_bytes=200)) == want


def test_products_stay_exact():
    # The largest weight and impact: a tile's sum of them fits in float64, and a wider tile is refused.
    most_weight, most_impact = lexical.weight(10 ** 12, 0), int(lexical.impacts(np.array([0]), np.array([10 ** 6]), 1, 1)[0])
    assert most_weight * most_impact * lexical.TILE_TERMS < 2 ** 53
    tile = lexical.item_tiles([np.arange(3, dtype=np.int32)], np.full(3, 2 ** 30))[0]
    with pytest.raises(ValueError):
        lexical.tile_scores(tile, 3, np.zeros(3, np.int64), np.arange(3), np.full(3, 2 ** 22), 1)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZ9é. \n世-", max_size=40))
def test_pieces_cut_no_term(text):
    data = text.encode()
    old, lexical.PIECE = lexical.PIECE, 3
    try:
        assert [t.decode() for piece in lexical.term_lists(data) for t in piece] == terms(text)
    finally:
        lexical.PIECE = old


def test_empty_tables(spark):
    docs, items = documents(spark, [(1, "one two")]), benchmark(spark, [(1, "one")])
    for out in (lexical.search(documents(spark, []), items), lexical.search(docs, benchmark(spark, [])), lexical.search(documents(spark, [(1, None), (2, "--")]), items)):
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_query_types(spark):
    out = op11_lexical_search(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
