"""Secret scan: fixed patterns, and random strings found by character Markov models.

The patterns give the base spans. Two models of which character follows which are
counted from labelled samples: random strings are the values that the patterns
found in all documents, ordinary identifiers are the words that at least two
documents have, alone, in capitals and joined by signs, with separators and dates. A run of token characters outside the base spans whose log-likelihood
ratio between the two models is high, in sum and for each character, is a span of
kind ``random``.

Only DataFrame functions are used. A pattern's positions follow from the text's
parts between matches: the k-th match starts where the parts and matches before it
end. The models are one table with an entry for each pair of characters of a fixed
alphabet, so its size does not depend on the data.

Defined cases: a null text is empty and has no spans; without a base match in the
table there is no model of random strings and only base spans are given; repeated
rows are scanned one by one; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds, in order, with pattern, group that is measured, least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

#: Runs that the models judge, and the characters they know (others count as one).
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Signs that ordinary text repeats as separators, and joins words with.
SIGNS = "-_=+/"
#: Least log-likelihood ratio of a run, in all and for each character, in nats.
LEAST_SUM, LEAST_MEAN = 12.0, 0.5
#: Pairs' worth of belief in a character's overall frequency.
PRIOR_PAIRS = 8.0

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_SIZE = len(ALPHABET) + 1
#: Matches whose spans are gathered before they join those of the text.
_CHUNK = 256


def _pairs(token: Column) -> Column:
    """The token's neighbouring characters, as numbers below _SIZE * _SIZE. The token is
    cut into characters once, so a long one takes linear time."""
    symbols = F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    return F.zip_with(F.slice(symbols, 1, F.length(token) - 1), F.slice(symbols, 2, F.length(token) - 1), lambda a, b: a * _SIZE + b)


def found(text: Column, pattern: str, keep, kind: int, measured: int = 0) -> Column:
    """Spans of the pattern's matches, leftmost and without overlap, for which
    ``keep(measured group)`` holds."""
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    value = F.regexp_extract_all(text, regex, F.lit(measured))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(whole), F.lit(0))).alias("gap"),
                         whole.alias("whole"), value.alias("value"))
    none = F.array().cast(_SPANS)

    def step(at, x):
        start = at + F.length(x["gap"])
        end = start + F.length(x["whole"])
        span = F.array(F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end")))
        return end.cast("long"), F.when(keep(x["value"]), span).otherwise(none)

    return F.when(text.rlike(pattern), _emitted(parts, F.lit(0).cast("long"), step)).otherwise(none)


def _emitted(items: Column, start: Column, step) -> Column:
    """The spans that ``step(state, item) -> (state, spans)`` emits along an array. They are
    gathered by chunks: one list that grows with every item would be copied each time."""
    none = F.array().cast(_SPANS)
    state = lambda at, spans: F.struct(at.alias("at"), spans.alias("spans"))

    def one(s, x):
        at, spans = step(s["at"], x)
        return state(at, F.concat(s["spans"], spans))

    def scan(all_items):
        chunk = lambda s, k: F.aggregate(F.slice(all_items, k * _CHUNK + 1, _CHUNK), state(s["at"], none), one,
                                         lambda e: state(e["at"], F.concat(s["spans"], e["spans"])))
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_items) - 1, F.lit(0)) / _CHUNK).cast("int"))
        return F.aggregate(numbers, state(start, none), chunk, lambda s: s["spans"])

    # In a list of one, so that the items are computed once and not for each chunk.
    return F.get(F.transform(F.array(items), scan), F.lit(0))


def apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base`` (kinds below it), in time linear in
    both but for the sort: forwards against the furthest end of a base span before, backwards
    against the nearest start of one behind."""
    kind, none = len(KINDS), F.array().cast(_SPANS)

    def forwards(reach, x):
        is_base = x["kind"] < kind
        return F.when(is_base, F.greatest(reach, x["end"])).otherwise(reach), F.when(is_base | (reach <= x["start"]), F.array(x)).otherwise(none)

    def backwards(least, x):
        is_base = x["kind"] < kind
        return F.when(is_base, x["start"]).otherwise(least), F.when(~is_base & (least >= x["end"]), F.array(x)).otherwise(none)

    first = _emitted(F.array_sort(F.concat(base, more)), F.lit(0).cast("long"), forwards)
    return F.reverse(_emitted(F.reverse(first), F.lit(2 ** 62).cast("long"), backwards))


def base_spans(text: Column) -> list[Column]:
    return [found(text, pattern, lambda v, n=least: F.length(v) >= n, k, group)
            for k, (_, pattern, group, least) in enumerate(KINDS)]


def _counts(tokens: DataFrame) -> dict[int, int]:
    """Pair counts: at most _SIZE * _SIZE numbers."""
    pairs = tokens.filter(F.length("token") > 1).select(F.explode(_pairs(F.col("token"))).alias("pair"))
    return {r["pair"]: r["count"] for r in pairs.groupBy("pair").count().collect()}


def identifiers(words: DataFrame) -> DataFrame:
    """(token): what ordinary text makes of its words (in capitals, joined by signs), its
    separators and its dates, as samples of ordinary identifiers."""
    token, capitals = F.col("token"), F.upper("token")
    forms = [token, capitals, *[F.concat(F.lit(s), x, F.lit(s)) for s in "_-/=" for x in (token, capitals)]]
    spark = words.sparkSession
    signs = spark.range(1).select(F.explode(F.array(*[F.lit(s * 64) for s in SIGNS], F.lit("+-----" * 8 + "+"))).alias("token"))
    day = F.timestamp_seconds(F.col("id") * 86_413 * 23)  # every 23 days and some minutes, from 1970
    dates = spark.range(0, 1200).select(F.explode(F.array(*[F.date_format(day, f) for f in ("yyyy-MM-dd'T'HH-mm-ss'Z'", "yyyy/MM/dd/HHmm", "yyyyMMdd'T'HHmmss'Z'",
                                                                                           "yyyy_MM_dd")])).alias("token"))
    return words.select(F.explode(F.array(*forms)).alias("token")).unionByName(signs).unionByName(dates)


def train(docs: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of each pair: random strings against ordinary identifiers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    values = [F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda v, n=n: F.length(v) >= n) for _, p, g, n in KINDS]
    values = [F.when(text.rlike(p), v).otherwise(F.array().cast("array<string>")) for v, (_, p, _, _) in zip(values, KINDS)]
    random = _counts(docs.select(F.explode(F.concat(*values)).alias("token")))
    if not random:
        return None
    plain = text
    for _, pattern, _, _ in KINDS:
        plain = F.regexp_replace(plain, pattern, " ")
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0)))
    # Two hashes are enough to tell whether a word is in two documents, repeated rows being one.
    words = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.explode(words).alias("token"))
    words = words.groupBy("token").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    words = words.filter("low < high").select("token")  # a random string hardly occurs in two documents
    ordinary = _counts(identifiers(words))

    def logs(counts: dict[int, int]) -> list[float]:
        """log P(b after a), drawn towards P(b) where a is rare."""
        rows = [sum(counts.get(a * _SIZE + b, 0) for b in range(_SIZE)) for a in range(_SIZE)]
        columns = [sum(counts.get(a * _SIZE + b, 0) for a in range(_SIZE)) + 0.5 for b in range(_SIZE)]
        alone = [c / sum(columns) for c in columns]
        return [math.log((counts.get(a * _SIZE + b, 0) + PRIOR_PAIRS * alone[b]) / (rows[a] + PRIOR_PAIRS))
                for a in range(_SIZE) for b in range(_SIZE)]

    return [x - y for x, y in zip(logs(random), logs(ordinary))]


def random_spans(text: Column, model: list[float], kind: int) -> Column:
    ratio = F.array(*[F.lit(x) for x in model])
    total = lambda v: F.aggregate(_pairs(v), F.lit(0.0), lambda s, p: s + F.get(ratio, p))
    high = lambda v: total(v) >= F.greatest(F.lit(LEAST_SUM), LEAST_MEAN * F.length(v))
    return found(text, RUN, high, kind)


def scan(docs: DataFrame, model: list[float] | None) -> DataFrame:
    """doc_id, ``base`` (a list of spans for each kind) and ``more`` (spans of random
    strings that overlap no base span)."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[c.alias(f"s{k}") for k, c in enumerate(base_spans(text))])
    base = F.concat(*[F.col(f"s{k}") for k in range(len(KINDS))])
    rows = rows.withColumn("base", F.array_sort(base))
    more = random_spans(text, model, len(KINDS)) if model else F.array().cast(_SPANS)
    rows = rows.withColumn("more", more)
    return rows.withColumn("more", F.when(F.size("more") > 0, apart(F.col("more"), F.col("base"))).otherwise(F.col("more"))).drop("text")


def written(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(x) for x in [k[0] for k in KINDS] + ["random"]])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")
