import re
from collections import defaultdict

import duckdb
import numpy as np

from labwave.llm import line_dedup
from labwave.llm.oracle import OP8
from labwave.llm.queries import op8_line_dedup

from .helpers import LONG, documents, odd_rows

BLANK = " \t\r\x0b\x0c"


def plain(rows, least, words=line_dedup.MIN_WORDS):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(BLANK):
                sites[line.strip(BLANK)].add(site)
                first.setdefault(line.strip(BLANK), (i, at))
                first[line.strip(BLANK)] = min(first[line.strip(BLANK)], (i, at))
    gone = {x for x in sites if len(sites[x] - {None}) >= least and len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= words}
    out = {}
    for i, text, site in rows:
        keep = [x for at, x in enumerate((text or "").split("\n")) if x.strip(BLANK) not in gone or first[x.strip(BLANK)] == (i, at)]
        out[i] = None if text is None else "\n".join(keep)
    return out


def test_sites_around_the_limit(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        lines = [f"own line {i}", ""] + [f" shared {k} \r" if i % 2 else f"shared {k}" for k in rng.choice(25, 4) if i % 20 < k]
        rows.append((i, "\n".join(lines), f"site{i % 20}" if i % 7 else None))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, rows), min_words=1).collect()}
    assert got == plain(rows, line_dedup.MIN_SITES, 1)


def test_many_sites_need_sketches(spark):
    rows = [(i, f"boiler\nline {i}\n" + ("rare" if i < 60 else "common"), f"w{i}") for i in range(400)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, rows), min_sites=61, min_words=1).collect()}
    assert got == plain(rows, 61, 1) and got[3] == "line 3\nrare"


def test_odd_rows(spark):
    rows = odd_rows() + [(40 + k, "All rights are reserved.\n" + LONG[:50 * k], f"z{k}") for k in range(6)]
    docs = documents(spark, rows, clashing=True)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[2] is None and got[3] == "" and got[6] == "   \n\t " and got[5] == LONG and got[None] == "no id here"
    assert got[40].startswith("All rights") and not got[41].startswith("All rights") and got[41] == LONG[:50]


def test_repeated_line_in_a_document_and_emptied_document(spark):
    rows = [(1, "x\nx", "a")] + [(i, "x", f"s{i}") for i in range(2, 8)]
    got = {r.doc_id: (r.text, r.gone) for r in line_dedup.dedup_lines(documents(spark, rows), removed_col="gone", min_words=1).collect()}
    assert got == {1: ("x", 1), **{i: ("", 1) for i in range(2, 8)}}


def test_short_lines_stay_if_asked_for(spark):
    """Lines of one to three words meet on all sites; with a least number of words a planted line of four goes, and only that."""
    rng = np.random.default_rng(4)
    vocabulary = ["the", "of", "and", "to.", "with"]
    for n in (200, 2000):
        short = [[" ".join(rng.choice(vocabulary, rng.integers(1, 4))) for _ in range(3)] for _ in range(n)]
        rows = [(i, "\n".join([*short[i], f"a line of its own {i}"] + ["planted line of words"] * (i % 4 == 0)), f"s{i % 20}") for i in range(n)]
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, rows), min_words=4).collect()}
        assert got == {i: t if i == 0 else t.replace("\nplanted line of words", "") for i, t, _ in rows}


def test_short_lines_go_too(spark, tmp_path):
    """The query, its SQL and the operator judge lines of one to three words like any other."""
    rows = [(i, f"Home\n own line {i}\nAll rights reserved.\nSee also" + "\nfour sites" * (i < 4), f"s{i % 6}") for i in range(30)]
    want = {i: rows[0][1] if i == 0 else f" own line {i}" + "\nfour sites" * (i < 4) for i in range(30)}
    docs = documents(spark, rows)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.n_removed) for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == {i: (t, 0 if i == 0 else 3) for i, t in want.items()} == {i: (t, n) for i, t, n in con.execute(OP8).fetchall()}


def test_empty_table(spark):
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(OP8).fetchall())
    got = sorted(map(tuple, op8_line_dedup(spark, sf).select("doc_id", "text", "n_removed").collect()))
    assert got == want and any(r[2] for r in got)


def test_no_python_in_the_plan(spark, capsys):
    line_dedup.dedup_lines(documents(spark, odd_rows())).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("EvalPython|InPandas|InArrow|PythonUDF|Pandas", plan)
