import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labwave.llm import packing

from .helpers import documents, odd_rows

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_pieces(rows, docs, tokenizer):
    """Every row's ids in order, each once; sequences without gaps or overlap."""
    got, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        seqs[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, text, *_ in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want[i] += [(s, min(2048, len(ids) - s), zlib.crc32(ids[s:s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return seqs


def test_round_trip_with_odd_rows(spark, tokenizer):
    docs = odd_rows() + [(20, "a  b\n\n c <|endoftext|> d's", "s"), (21, " lead and trail ", "s"), (22, "x y 　z 日本 ½ ²a.", "s")]
    check_pieces(packing.pack(documents(spark, docs, clashing=True)).collect(), docs, tokenizer)


def test_many_documents_leave_little_padding(spark, tokenizer):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], rng.integers(1, 900)))) for i in range(600)]
    seqs = check_pieces(packing.pack(documents(spark, docs), group_docs=200).collect(), docs, tokenizer)
    used = [sum(n for _, n in parts) for parts in seqs.values()]
    assert sum(2048 - u for u in used if u & (u - 1)) < 0.03 * sum(used)


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_tree_gives_first_fit(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths), 50)
    free = []
    for i in np.argsort(-np.array(lengths), kind="stable"):
        at = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if at == len(free):
            free.append(50)
        assert (bins[i], offsets[i]) == (at, 50 - free[at])
        free[at] -= lengths[i]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\x1c\x85  aéß1½²_.,'!sS<|$日ſ", max_size=40))
def test_words_encode_as_whole_text(text):
    encode = packing.encoder(None)
    want = np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert encode(text) == want
