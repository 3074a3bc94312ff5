"""Quality rules judged by host.

Each document is measured over its whole text and fails or passes each rule. The
failures of a rule are summed for each host (a grouped aggregate), a beta prior for
the hosts' failure rates is fitted to all hosts (mean and spread between hosts, by
analysis of variance), and every host's rate is shrunk towards it:
(failures + a) / (documents + a + b). So a host with few documents is judged by the
corpus, one with many by itself. A host whose shrunk rate of a rule is at least
``REJECT`` goes with all its documents; from ``STRICT`` on, its documents that fail
that rule go; elsewhere a document goes only by the base rules. The verdicts are
joined back to the documents; hosts without one take no part in the join.

Defined cases: a null text has no words and fails the base rules; a null host is a
host of its own; a repeated row counts as often as it is there; with a single host,
or one document for each, there is no spread to measure and hosts are judged by the
corpus; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package, staged

# The base rules and the symbols that are counted.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3

#: Shrunk failure rates from which a host goes, or its failing documents go.
REJECT, STRICT = 0.5, 0.2
#: Documents' worth of belief that the prior may have.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0

_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = SYMBOLS.encode()
_MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of neighbouring words found twice or more."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:len(ids) - window + 1]
    for k in range(1, window):  # renumbered each time, so the product stays small
        key = np.unique(key, return_inverse=True)[1] * len(number) + ids[k:len(ids) - window + 1 + k]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words) + 1, np.int64)
    first = np.flatnonzero(count[at] > 1)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def measured(text: str | None) -> tuple[int, int, int, int, int, int]:
    """words, their code points, symbols, lines with a word, such lines equal to an
    earlier one, words in repeated windows."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes: ASCII white space only
    white = len(data) - sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return (len(words), len(text) - white, len(data) - len(data.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)),
            repeated_words(words))


def rules() -> dict[str, Column]:
    """Rule -> whether a measured document fails it. The first two are the base rules."""
    c = F.col
    return {
        "short": c("n_words") < LEAST_WORDS,
        "repeated": 100 * c("n_repeat_words") > MOST_REPEATED * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "dup_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words")),
    }


BASE = ("short", "repeated")


def beta_prior(hosts: int, docs: int, squares: float, failed: int, failed_squares: float) -> tuple[float, float]:
    """(a, b) from the number of hosts, sum n, sum n^2, sum k and sum k^2 / n over hosts
    of n documents and k failures. The share r of variance that lies between hosts
    makes the prior worth (1 - r) / r documents."""
    if not docs:
        return 0.0, MOST_PRIOR
    mean, worth = failed / docs, MOST_PRIOR
    if hosts > 1 and docs > hosts:
        between = max(0.0, failed_squares - failed * mean) / (hosts - 1)
        within = max(0.0, failed - failed_squares) / (docs - hosts)
        typical = (docs - squares / docs) / (hosts - 1)
        if between > within:
            share = (between - within) / (between + (typical - 1) * within)
            worth = min(MOST_PRIOR, max(LEAST_PRIOR, (1 - share) / share))
    return mean * worth, (1 - mean) * worth


def host_verdicts(docs: DataFrame) -> DataFrame:
    """(host, one boolean for each rule) -> host, n, and of each rule its shrunk rate."""
    names = list(rules())
    per = staged(docs.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(r).alias(r) for r in names]), "rules-hosts")
    sums = [F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))]
    for r in names:
        sums += [F.sum(r), F.sum(F.col(r).cast("double") * F.col(r) / F.col("n"))]
    total = [x or 0 for x in per.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    out = per.select("host", "n", *[((F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias(r)
                                    for i, r in enumerate(names) for a, b in [beta_prior(*total[:3], *total[3 + 2 * i:5 + 2 * i])]])
    return out


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: doc_id, host, the measures, ``failed`` (the rules it fails),
    base_failed, kept, ``host_rejects`` and ``host_strict`` (the rules of its host's verdict)."""
    ship_package(docs.sparkSession)

    @F.pandas_udf(_MEASURES)
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measured(t) for t in texts.array], columns=[f.split()[0] for f in _MEASURES.split(", ")])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"), measure(F.col(f"`{text_col}`")).alias("m"))
    rows = staged(rows.select("doc_id", "host", "m.*").withColumns(rules()), "rules-docs")  # measures only: texts are read once
    names = list(rules())
    shrunk = host_verdicts(rows)
    of = lambda least: F.array_compact(F.array(*[F.when(F.col(r) >= least, F.lit(r)) for r in names]))
    verdicts = staged(shrunk.select(F.col("host").alias("_host"), of(REJECT).alias("host_rejects"), of(STRICT).alias("host_strict"))
                      .filter(F.size("host_strict") > 0), "rules-verdicts")
    none = F.array().cast("array<string>")
    out = rows.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host").withColumns({
        "failed": F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in names])),
        "base_failed": F.col(BASE[0]) | F.col(BASE[1]),
        "host_rejects": F.coalesce("host_rejects", none), "host_strict": F.coalesce("host_strict", none)})
    goes = F.col("base_failed") | (F.size("host_rejects") > 0) | F.arrays_overlap("failed", "host_strict")
    return out.withColumn("kept", ~goes).drop(*names)
