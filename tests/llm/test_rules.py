import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labwave.llm import rules
from labwave.llm.queries import op12_quality_rules

from .helpers import documents, odd_rows

GOOD = " ".join(f"plain word{i} stands" for i in range(40))


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "<c>", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "a b c", "\r"]), max_size=60))
def test_measures(parts):
    text = " ".join(parts) if len(parts) % 2 else "".join(parts)
    assert rules.measured(text) == plain(text)


def test_long_text():
    text = " ".join(f"w{i % 9973}" for i in range(60_000))
    assert rules.measured(text)[5] == 60_000 and rules.measured(text) == plain(text)


def test_prior_by_hand():
    # Two hosts of 100 documents, 10 and 30 failures: variance between 2.0, within 30 / 198.
    a, b = rules.beta_prior(2, 200, 20_000.0, 40, 1.0 + 9.0)
    share = (2.0 - 30 / 198) / (2.0 + 99 * 30 / 198)
    assert a == pytest.approx(0.2 * (1 - share) / share) and a / (a + b) == pytest.approx(0.2)
    assert rules.beta_prior(1, 50, 2500.0, 5, 0.5) == (100.0, 900.0)      # a single host
    assert rules.beta_prior(3, 3, 3.0, 1, 1.0)[0] == pytest.approx(1000 / 3)  # one document each
    assert rules.beta_prior(0, 0, 0.0, 0, 0.0) == (0.0, 1000.0)


def judged(spark, rows):
    return {r.doc_id: r for r in rules.judge(documents(spark, rows, clashing=True)).collect()}


def test_hosts(spark):
    junk = " ".join("#### $$ %% <b> |" for _ in range(4)) + " " + GOOD
    rows = [(i, GOOD, f"good{i % 40}") for i in range(4000)]
    rows += [(10_000 + i, "short", "bad") for i in range(180)] + [(10_180 + i, GOOD, "bad") for i in range(20)]
    rows += [(20_000 + i, junk if i < 60 else GOOD, "mixed") for i in range(200)]
    rows += [(30_000, "short", "tiny"), (30_001, GOOD, "tiny"), (30_002, junk, "good1")]
    out = judged(spark, rows)
    assert all(out[i].kept for i in range(4000))                                    # clean hosts
    assert not any(out[10_000 + i].kept for i in range(200))                        # nine in ten fail: the host goes
    assert out[10_190].host_rejects == ["short"] and not out[10_190].base_failed
    assert [out[20_000 + i].kept for i in range(200)] == [False] * 60 + [True] * 140  # three in ten: those that fail go
    assert not out[30_000].kept and out[30_001].kept                                # two documents say little about a host
    assert out[30_002].kept and out[30_002].failed == ["symbols"]                   # a good host's slip


def test_odd_rows(spark):
    rows = odd_rows()
    out = rules.judge(documents(spark, rows, clashing=True)).collect()
    measures = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)
    assert sorted((r.doc_id or -1, measures(r)) for r in out) == sorted((r[0] or -1, plain(r[1])) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out)
    assert not any(r.kept for r in out if r.base_failed)
    assert rules.judge(documents(spark, [])).count() == 0


def test_query_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = op12_quality_rules(spark, sf)
    assert out.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    clean = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id").join(out, "doc_id").filter(~F.col("base_failed"))
    assert clean.filter(~F.col("kept")).count() == 0 < clean.count()
