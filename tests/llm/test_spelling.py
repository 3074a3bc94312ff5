import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from labwave.llm import spelling
from labwave.llm.queries import op13_spelling_variants

from .helpers import documents, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, least_length=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def plain_near(words):
    """word -> near words; words that share a text with one letter left out are compared."""
    at, out = defaultdict(set), {w: set() for w in words}
    for w in words:
        for key in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            at[key].add(w)
    for group in at.values():
        for a in group:
            out[a] |= {b for b in group if near(a, b)}
    return out


def plain(counts, ratio=5):
    neighbours, form = plain_near(counts), {}
    for w, n in counts.items():
        best = min(neighbours[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(neighbours[w]), counts.get(form[w])))
    return sorted(rows, key=repr)


def got(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def check_neighbours(spark, words):
    pairs = {(r.word, r.near) for r in spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert pairs == {(a, b) for a, near_ones in plain_near(words).items() for b in near_ones}


def test_neighbours_of_all_shapes(spark):
    words = {"", "a", "ab", "b", "abc", "abcd", "abxd", "abcde", "xabcd", "bcd", "aaaa", "aaaaa", "aaaaaa", "aaabaa", "baaaaa", "éclair", "eclair",
             "clair", "éclairs", "ÿ", "ÿé", "é"} - {""}
    words |= {"x" * 3000 + "y" + "x" * 3000, "x" * 6001, "x" * 6000, "x" * 5999 + "z"}
    check_neighbours(spark, words)


@settings(max_examples=4, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), max_size=60))
def test_neighbours_of_crowded_words(spark, words):
    check_neighbours(spark, words)


def test_collisions_of_prefixes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_PRIME", 61)  # nearly every node is shared
    check_neighbours(spark, {"ab", "abc", "abd", "bbc", "cab", "cabd", "dcab", "abab", "baba", "babab"})


def test_forms_and_roots(spark):
    rows = [(i, "colour " * 40 + "color " * 200 + "colours") for i in range(7)] + [(9, "Colouur COLOUUR colouur colouur colouur lonely " + "lonely " * 8)]
    df = spelling.variants(documents(spark, rows), least_length=5)
    assert got(df) == plain(plain_counts(rows, least_length=5))
    of = {r.word: r for r in df.collect()}
    assert (of["colour"].form, of["colouur"].form, of["colouur"].root) == ("color", "colour", "color")
    assert (of["lonely"].form, of["lonely"].root, of["lonely"].n_near) == (None, "lonely", 0)


def test_odd_rows(spark):
    rows = odd_rows() + [(None, "Straße straße straßen " * 9), (None, None), (4, "ÀÉÎÕÜß×÷ " * 6), (4, "ab cd " * 20)]
    docs = documents(spark, [(r[0], r[1]) for r in rows], clashing=True)
    assert got(spelling.variants(docs)) == plain(plain_counts([(r[0], r[1]) for r in rows]))
    empty = spelling.variants(documents(spark, []))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = op13_spelling_variants(spark, sf)
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = plain(plain_counts(rows))
    assert got(out) == want and sum(r[1] is not None for r in want) > 10
