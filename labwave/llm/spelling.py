"""Grouping spelling variants by walking a relational trie with a frontier of states.

The words, and the words read backwards, form two tries kept as one edge table
(node, first letter, letters, child, first letters below the child, word that ends
there); a node is the hash of the prefix that leads to it, and prefixes with a single
way on are drawn together into one edge. Two words one edit apart agree in the first
half of the one or, backwards, in its second half. So a word starts at the last node
inside that half, where it lies by itself, and from there its states (word, position,
node, edits) are joined with the edge table level by level: a state without an edit
goes on along the edge it agrees with and branches where an edge differs from the
word (a letter replaced, added or left out, at the first difference only, so every
neighbour has one way); a state with its edit has one edge to follow. States that end
where a word ends are neighbours. A look at the first letters below a child drops
states that could not go on, so the frontier stays small. Each level is written, and
the one before it deleted.

Prefix hashes have 61 bits; prefixes that share one would only add ways, and every
neighbour is checked by its distance, so the result is exact.

A word's form is its near word of largest count, if that is ``RATIO`` times its own or
more; forms are followed to the last by pointer jumping. Counts grow along them, so
there are no cycles.

Defined cases: a null or empty text has no words; a null id counts as an empty one in
the hash that garbles; repeated rows count each; words of any length are whole (a
long word is one edge where nothing branches off); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, ship_package, staged
from .lexical import LOWER, UPPER

# What a word is, and which runs lose a letter.
LETTERS = r"A-Za-zÀ-ÿ"
GARBLE = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5

_PRIME, _BASES = (1 << 61) - 1, (0x1F3D5B79A2C4E688 % ((1 << 61) - 1), 0x0B7E151628AED2A6 % ((1 << 61) - 1))


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, garble: int = GARBLE) -> DataFrame:
    """(word, n): the words that occur at least ``least_count`` times."""
    run = F.col("run")
    # A run of fewer letters than a word needs cannot match: from its start it is too short, and so from later.
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`"), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    each = each.select(F.when(h % garble == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run).alias("word"))
    counts = each.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least_count)


def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(uid, word) -> (uid, back, depth, node, letter): every prefix of the word, forwards
    and backwards, with the code point that follows it (-1: the word ends)."""
    for batch in batches:
        uids, backs, depths, nodes, letters = [], [], [], [], []
        for uid, word in zip(batch["uid"].tolist(), batch["word"].array):
            for back in (False, True):
                node, base = 1 + back, _BASES[back]
                points = [ord(x) for x in (word[::-1] if back else word)]
                for point in points:
                    nodes.append(node)
                    node = (node * base + point) % _PRIME
                nodes.append(node)
                letters += points
                letters.append(-1)
                uids += [uid] * (len(points) + 1)
                backs += [back] * (len(points) + 1)
                depths += range(len(points) + 1)
            if len(uids) > 200_000:
                yield pd.DataFrame({"uid": uids, "back": backs, "depth": depths, "node": nodes, "letter": letters})
                uids, backs, depths, nodes, letters = [], [], [], [], []
        yield pd.DataFrame({"uid": uids, "back": backs, "depth": depths, "node": nodes, "letter": letters})


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word) -> edges (node, first, letters, child, below, ends) and the paths of all words,
    (read, back, depth, node): the nodes where a word ends or ways part."""
    ship_package(words.sparkSession)
    words = staged(words.select(F.monotonically_increasing_id().alias("uid"), "word"), "spelling-numbered")
    steps = staged(words.mapInPandas(prefixes, "uid long, back boolean, depth int, node long, letter int"), "spelling-steps")
    nodes = steps.groupBy("node").agg(F.min("letter").alias("low"), F.max("letter").alias("high"), F.min("depth").alias("depth"))
    nodes = staged(nodes.filter("low = -1 or low <> high or depth = 0").select("node"), "spelling-nodes")
    read = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    paths = steps.drop("letter").join(nodes, "node", "left_semi").join(words, "uid")
    paths = staged(paths.select("uid", "back", "depth", "node", read.alias("read")), "spelling-paths")
    along = Window.partitionBy("uid", "back").orderBy("depth")
    edges = paths.withColumns({"child": F.lead("node").over(along), "to": F.lead("depth").over(along)}).filter("child is not null")
    edges = edges.withColumn("letters", F.substring("read", F.col("depth") + 1, F.col("to") - F.col("depth")))
    ends = F.when(F.col("to") == F.length("read"), F.when(F.col("back"), F.reverse("read")).otherwise(F.col("read")))
    edges = edges.groupBy("node", "letters", "child").agg(F.max(ends).alias("ends"))
    edges = staged(edges.withColumn("first", F.substring("letters", 1, 1)), "spelling-edges")
    below = edges.groupBy("node").agg(F.array_join(F.collect_set("first"), "").alias("below"))  # at most the alphabet
    full = staged(edges.join(below.select(F.col("node").alias("child"), "below"), "child", "left")
                  .select("node", "first", "letters", "child", F.coalesce("below", F.lit("")).alias("below"), "ends"), "spelling-trie")
    deleted(words, steps, nodes, edges)
    return full, paths


def _states(joined: DataFrame, kinds) -> DataFrame:
    """Of states with an edge each: the states (position, edits) it leads to, as far as they can
    go on; ``near`` is the word of a state that ends."""
    options = F.array(*[F.when(holds, F.struct(F.lit(edits).alias("edits"), pos.cast("int").alias("pos"))) for holds, edits, pos in kinds])
    out = joined.withColumn("to", F.explode(options)).filter("to is not null")
    pos, edits, size = F.col("to.pos"), F.col("to.edits"), F.length("read")
    goes_on = F.when(pos < size, F.instr(F.col("below"), F.substring("read", pos + 1, F.lit(1))) > 0).otherwise(F.lit(False))
    goes_on = goes_on | ((edits == 0) & (F.col("below") != ""))
    near = F.when((edits == 1) & (pos == size), F.col("ends")).when((edits == 0) & (pos == size - 1), F.col("ends"))
    return out.select("read", "back", pos.alias("pos"), F.col("child").alias("node"), edits.alias("edits"), goes_on.alias("goes_on"), near.alias("near")) \
              .filter(F.col("goes_on") | F.col("near").isNotNull())


def neighbours(words: DataFrame) -> DataFrame:
    """(word) distinct -> (word, near): all ordered pairs one edit apart."""
    edges, paths = trie(words)
    size = F.length("read")
    half = F.when(F.col("back"), size - F.floor(size / 2)).otherwise(F.floor(size / 2)).cast("int")
    # Before the last letter but one, so that leaving out the last is a step of its own.
    inside = paths.filter((F.col("depth") == 0) | (F.col("depth") <= F.least(half, size - 2)))
    start = (inside.groupBy("uid", "back").agg(F.max("depth").alias("pos"), F.max_by("node", "depth").alias("node"))
             .join(paths.filter("depth = 0").select("uid", "back", "read"), ["uid", "back"])
             .select("read", "back", "pos", "node", F.lit(0).alias("edits"), F.lit(True).alias("goes_on"), F.lit(None).cast("string").alias("near")))
    frontier, hits = staged(start, "spelling-frontier"), []
    deleted(paths)
    m, rest = F.length("letters"), lambda more: F.substring("read", F.col("pos") + 1, F.length("letters") + more)
    apart = lambda more: (F.length(rest(more)) == m + more) & (F.levenshtein(F.col("letters"), rest(more), 1) == 1)
    while not frontier.filter("goes_on").isEmpty():
        free = frontier.filter("goes_on and edits = 0").drop("goes_on", "near", "edits")
        bound = frontier.filter("goes_on and edits = 1").drop("goes_on", "near", "edits")
        same, differs = rest(0) == F.col("letters"), (rest(0) != F.col("letters")) & (F.col("pos") + m > half)
        moved = _states(free.join(edges, "node").drop("node"), [
            (same, 0, F.col("pos") + m),
            (differs & apart(0), 1, F.col("pos") + m),        # a letter replaced
            (differs & apart(-1), 1, F.col("pos") + m - 1),   # the trie has one more
            (differs & apart(1), 1, F.col("pos") + m + 1)])   # the word has one more
        follow = bound.withColumn("first", F.substring("read", F.col("pos") + 1, F.lit(1))).join(edges, ["node", "first"]).drop("node")
        moved = moved.unionByName(_states(follow, [(same, 1, F.col("pos") + m)]))
        after = staged(moved, "spelling-frontier")
        hits.append(staged(after.filter("near is not null").select(F.when(F.col("back"), F.reverse("read")).otherwise(F.col("read")).alias("word"), "near"),
                           "spelling-hits"))
        deleted(frontier)
        frontier = after
    deleted(frontier, edges)
    if not hits:
        return words.select("word", F.col("word").alias("near")).limit(0)
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out.filter(F.levenshtein("word", "near", 1) == 1).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, form), forms being words -> (word, root): what the forms lead to at last."""
    last = staged(forms.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        hop = last.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(last.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        deleted(last)
        last, done = moved.select("word", "root"), moved.filter("moved").isEmpty()
        if done:
            return last


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = staged(word_counts(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_count=least_count), "spelling-words")
    pairs = staged(neighbours(words), "spelling-pairs")
    near = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # Largest count, then smallest word: the least of (-count, word).
    per = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("top"))
    strong = -F.col("top.minus") >= ratio * F.col("n")
    forms = staged(words.join(per, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                          F.when(strong, F.col("top.near")).alias("form"),
                                                          F.when(strong, -F.col("top.minus")).alias("form_n")), "spelling-forms")
    deleted(words, pairs)
    return (forms.join(roots(forms), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
