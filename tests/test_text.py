"""Text operators: fixed-width chunks and ordered group concatenation."""

import random

from labwave.operators import text as TX


def test_chunks_cover_whole_text(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "xyz")],
                               "doc_id long, text string")
    got = {(r["doc_id"], r["chunk_no"]): r["chunk"] for r in TX.chunk_text(df, "doc_id", "text", 4).collect()}
    assert got == {(1, 0): "abcd", (1, 1): "efgh", (1, 2): "ij", (4, 0): "xyz"}


def test_group_text_in_order_across_pieces(spark):
    """A conversation with most of the turns, shuffled input, pieces of 25 characters:
    the pieces in order equal a plain ordered join of all its lines."""
    rnd = random.Random(3)
    rows = [(1, t, "user" if t % 2 else "bot", f"line {t}") for t in range(300)]
    rows += [(c, t, "user", None if t == 1 else f"c{c} t{t}") for c in range(2, 6) for t in range(5)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {}
    for r in sorted(TX.concat_group_text(df, piece_chars=25).collect(), key=lambda r: r["piece_no"]):
        text, n = got.get(r["conv_id"], (None, 0))
        got[r["conv_id"]] = (r["joined_text"] if text is None else text + "\n" + r["joined_text"], n + r["n_lines"])
        assert len(r["joined_text"]) <= 25 + 20
    want = {}
    for c in {r[0] for r in rows}:
        lines = [": ".join(x for x in (r[2], r[3]) if x is not None) for r in sorted(rows) if r[0] == c]
        want[c] = ("\n".join(lines), len(lines))
    assert got == want
