from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from labwave.llm import mixing
from labwave.llm.oracle import OP1
from labwave.llm.queries import op1_mix_sources

from .helpers import CLASHING, documents, odd_rows


def goals(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by the literal rule: share out, cut what is above, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, full = sum(sizes.values()) * share, set()
    while len(full) < len(names):
        left = goal - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] >= most * sizes[s]}
        if not over:
            return {**{s: most * sizes[s] for s in full}, **part}
        full |= over
    return {s: most * sizes[s] for s in names}


def test_targets_and_words_taken(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), f"s{i % 5}" if i % 3 else "hot") for i in range(3000)]
    got = mixing.mix(documents(spark, rows)).select("row.doc_id", "source", "size", "source_size", "target", "copies").collect()
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = goals(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 90


def test_one_source_and_reruns(spark):
    docs = documents(spark, [(i, "a b c d", "only") for i in range(1000)])
    one = mixing.mix(docs).select("row.doc_id", "copies").collect()
    two = mixing.mix(docs.repartition(7)).select("row.doc_id", "copies").collect()
    assert sum(r.copies for r in one) == 1500 and sorted(one) == sorted(two)


def test_odd_rows(spark):
    docs = documents(spark, odd_rows(), clashing=True)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert {(r.row.doc_id, r.size) for r in got} >= {(2, 0), (3, 0), (6, 0), (9, 1), (5, 30000)}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and "size" in CLASHING
    assert {r["size"] for r in mixed.collect()} == {"x"}
    assert all(r.copies == 0 for r in got if r.source_size == 0)


def test_empty_table(spark):
    docs = documents(spark, [])
    assert mixing.mix(docs).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cur = con.execute(f"SELECT doc_id, taken, target FROM ({OP1})")
    want = sorted(cur.fetchall())
    assert sorted(map(tuple, op1_mix_sources(spark, sf).select("doc_id", "taken", "target").collect())) == want


def test_size_class_orders_sizes(spark):
    sizes = spark.range(0, 5000).select("id", mixing.size_class(F.col("id")).alias("c")).orderBy("id").collect()
    assert all(a.c <= b.c for a, b in zip(sizes, sizes[1:]))



def test_reruns_agree_where_ids_repeat(spark):
    rows = [(7, f"text {i} of a b c", "s") for i in range(40)] + [(None, f"other {i} a b c", "s") for i in range(40)] + [(9, "same text", "t")] * 30
    texts = [Counter(r.text for r in mixing.mixed_documents(documents(spark, rows).repartition(n)).collect()) for n in (1, 3, 7)]
    assert texts[0] == texts[1] == texts[2] and sum(texts[0].values()) > 60


def test_equal_ids_and_equal_rows_meet_in_no_one_bucket(spark, monkeypatch):
    """Texts without an id spread over many buckets; a row repeated 5,000 times is one row of its bucket."""
    seen, staged = {}, mixing.staged
    monkeypatch.setattr(mixing, "staged", lambda df, name: seen.setdefault(name, staged(df, name)) if name == "mix-alike" else staged(df, name))
    rows = [(None, f"words of text {i}", "s") for i in range(20_000)] + [(1, "five words in this row", "s")] * 5000
    got = mixing.mix(documents(spark, rows)).groupBy("row.text").agg(F.sum("copies").alias("n"), F.min("copies").alias("low"), F.max("copies").alias("high"))
    repeated = got.filter("text = 'five words in this row'").first()
    assert repeated.high - repeated.low <= 1 and abs(repeated.n - 7500) <= 1
    buckets = seen["mix-alike"].groupBy("class", "bucket").count().collect()
    assert len(buckets) >= 30 and max(r["count"] for r in buckets) < 2000
