from collections import Counter

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from labwave.llm import line_dedup, mixing, quality
from labwave.llm.common import staged

from .helpers import documents, odd_rows
from .test_line_dedup import plain
from .test_packing import check_pieces
from .test_simhash import by_distance, plain_fingerprint

SF = "/root/testdata/sf0.01"


def test_each_stage_on_its_own_input(spark):
    from tokenizers import Tokenizer
    (_, q), (_, lines), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = staged(q(spark, docs, SF), "t")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    good = [i for i, y in labels.items() if y == 1]
    bad = [i for i, y in labels.items() if y == 0]
    assert kept.dtypes == docs.dtypes and sum(i in ids for i in good) >= 0.98 * len(good) and sum(i in ids for i in bad) <= 0.1 * len(bad)

    rows = [(r.doc_id, r.text, r.source) for r in kept.orderBy("doc_id").collect()]
    cut = staged(lines(spark, kept, SF), "t")
    assert cut.dtypes == docs.dtypes and {r.doc_id: r.text for r in cut.collect()} == plain(rows, line_dedup.MIN_SITES)
    assert cut.filter(F.length("text") != F.col("n_chars")).count() == 0

    fps = {r.doc_id: plain_fingerprint(r.text) for r in cut.collect()}
    one = staged(near(spark, cut, SF), "t")
    comp = by_distance(fps)
    assert one.dtypes == docs.dtypes and sorted(r.doc_id for r in one.collect()) == sorted(set(comp.values()))

    mixed = staged(mix(spark, one, SF), "t")
    want = {r.row.doc_id: r.copies for r in mixing.mix(one).collect() if r.copies}
    assert mixed.dtypes == docs.dtypes and Counter(r.doc_id for r in mixed.collect()) == want

    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    check_pieces(pack(spark, mixed, SF).collect(), rows, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_stages_take_odd_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        docs = documents(spark, odd_rows(), clashing=True)
        out = stage(spark, docs, SF)
        out.collect()
        assert name == "packing" or set(out.columns) == set(docs.columns)
        assert stage(spark, documents(spark, []), SF).count() == 0
    assert quality.THRESHOLD == 0.5


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
