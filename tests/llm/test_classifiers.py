import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labwave.llm import quality, toxicity
from labwave.llm.common import held_out, may_train
from labwave.llm.queries import op3_quality_classifier, op4_toxicity
from labwave.llm.training import Ftrl, labelled_texts

from .helpers import documents, odd_rows

SF = "/root/testdata/sf0.1"


def test_held_out_rule(spark):
    got = {r.id: r.h for r in spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)}
    assert spark.sql("select cast(null as bigint) id").select(held_out(F.col("id"))).first()[0] is False


@pytest.mark.parametrize("query, label, least", [(op3_quality_classifier, "quality", 0.99), (op4_toxicity, "toxic", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    got = query(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all()
    known = got[got["held_out"]].merge(labels, on="doc_id")
    assert (known["predicted"] == known[label]).mean() >= least
    clean = known[known[label] == (1 if label == "quality" else 0)]
    assert (clean["predicted"] == clean[label]).mean() >= 0.99


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    model = Ftrl(20, alpha=0.5, beta=1.0, l1=2.0, l2=0.0)
    for _ in range(2000):
        ids = np.unique(rng.integers(0, 20, 4))
        w = model.weights(ids)
        p = 1 / (1 + np.exp(-w.sum()))
        model.update(ids, w, np.full(len(ids), p - (3 in ids)))
    w = model.weights()
    assert w[3] > 1 and w[3] > 3 * np.abs(np.delete(w, 3)).max()
    assert (Ftrl(5, 1, 1, 0, 0, positive=True).weights() == 0).all()


def test_quality_shape_reads_the_whole_word():
    """Words alike in 64 characters, different after, have different shapes."""
    one, other = (quality.Words()["a" * 64 + end] & 0xFFFFFFFF for end in ("A9!b", "b"))
    assert one != other and one == quality.Words()["b" * 100 + "C0!d"] & 0xFFFFFFFF


def test_quality_features():
    assert quality.shape("Thend,") == "Aa," and quality.shape("THE!!") == "A!" and quality.shape("ab12$$$") == "a0$"
    ids, values = quality.features("a b a b")
    assert len(ids) == len(set(ids.tolist())) and np.isclose((values[:-1] ** 2).sum(), 1)
    assert quality.features(None)[0].tolist() == quality.features(" \n")[0].tolist() == [0]


def small_labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_odd_rows(spark):
    docs = documents(spark, odd_rows(), clashing=True)
    labels = small_labels(spark, [(1, 1, 0), (7, 1, 0), (7, 0, 1), (5, 0, 1), (None, 1, 1), (9, None, None), (99, 0, 1)])
    sample = labelled_texts(docs, labels, "quality", may_train(F.col("doc_id"))).collect()
    assert len({r.doc_id for r in sample}) == len(sample)
    weights = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, weights, "q").collect()
    assert len(scored) == 9 and all(0 <= r.q <= 1 for r in scored) and scored[0]["score"] == "x"
    assert len({round(r.q, 12) for r in scored if not (r.text or "").strip()}) == 1
    kept = quality.keep_quality(docs, weights)
    assert kept.columns == docs.columns


def test_nothing_learned_rejects_nothing(spark):
    docs, none = documents(spark, odd_rows()), small_labels(spark, [])
    assert quality.keep_quality(docs, quality.fit_quality(docs, none)).count() == 9
    judged = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).select("toxicity.score").collect()
    assert max(r.score for r in judged) < 0.7
    assert quality.score_quality(documents(spark, []), np.zeros(quality.BINS, np.float32)).count() == 0
    assert toxicity.score_toxicity(documents(spark, []), np.zeros(toxicity.BINS, np.float32)).count() == 0


def mil_rows(n, seed):
    rng = np.random.default_rng(seed)
    words = ["tree", "river", "stone", "cloud", "bird", "lamp", "road", "leaf", "sand", "wind"]
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice(words, 6)) for _ in range(rng.integers(2, 9))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            k = rng.integers(len(sentences))
            sentences[k] += " you blockhead" if rng.random() < 0.5 else " utter nitwits"
        rows.append((". ".join(sentences) + ".", toxic))
    return pd.DataFrame(rows, columns=["text", "label"])


def test_multiple_instances_find_the_sentence():
    weights = toxicity.train(mil_rows(1500, 1)).astype(np.float32)
    known = toxicity.WordWeights(weights)
    test = mil_rows(400, 2)
    odds = [toxicity.sentence_odds(toxicity.TOKEN.findall(t.lower()), known)[0] for t in test["text"]]
    score = np.array([toxicity.noisy_or(o) for o in odds])
    assert ((score >= 0.7) == (test["label"] == 1)).mean() > 0.98
    text = "River tree stone.\nBird lamp, you Blockhead! Road leaf sand."
    (span,) = toxicity.offending(text, known, 0.5)
    assert text[span["start"]:span["end"]] == "Bird lamp, you Blockhead"


def test_noisy_or_is_the_formula():
    odds = np.array([-2.0, 0.5, -7.0])
    p = 1 / (1 + np.exp(-odds))
    assert np.isclose(toxicity.noisy_or(odds), 1 - np.prod(1 - p)) and toxicity.noisy_or(np.empty(0)) == 0


def test_repeated_insults_and_long_texts(spark):
    weights = toxicity.train(mil_rows(1500, 1)).astype(np.float32)
    docs = documents(spark, [(1, "river " * 50_000), (2, "Tree. " * 5_000), (3, "tree " * 20_000 + "you blockhead"), (4, None), (5, "")], clashing=True)
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, weights).collect()}
    assert got[1].score < 0.7 and got[3].score > 0.7 and len(got[3].sentences) == 1
    assert got[4].score == got[5].score == 0 and got[4].sentences == []
