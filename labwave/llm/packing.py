"""Packing documents into sequences of a fixed length.

A document's tokens are cut into whole sequences and a rest. The rests are dealt
at random into groups of about ``GROUP_DOCS``, and each group is packed by
first-fit decreasing: bins are the leaves of a tournament tree that holds the
largest free capacity below each node, so the first bin that fits is found in
log2(bins) steps. Groups are independent and of bounded size, whatever the
number of documents, their length, source or repetition.

Defined cases: a null text is empty and has only the end token; a row that
occurs twice is packed twice, each with its own pieces; a null id stays null; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, staged

SEQUENCE = 2048
END_TOKEN = 1
GROUP_DOCS = 2048
#: Entries of a worker's memory of encoded words; when full it becomes the older half.
MEMO = 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """Encodes a text as the tokenizer does, with a memory of words already encoded.

    The tokenizer's pre-tokenization always begins a new piece at a space whose
    next character is not white space, so the parts of a text between such
    spaces can be encoded one by one; signs at the end of a word are a piece of
    their own. A text with other white space next to a space, or with a special
    token's opening, is encoded whole. New words are merged by the same vocabulary
    in rank form where there is one, which costs a third.
    """

    TAIL = re.compile(r"([^\W\d_]+)([.,;:!?]+)")

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}  # words, each after a space
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.merge = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if ranks:
            import tiktoken
            with open(ranks, "rb") as lines:
                vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})._core_bpe.encode_ordinary

    def _merged(self, text: str) -> bytes:
        ids = self.merge(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _new(self, word: str) -> bytes:
        """Ids of a word that is not in the memory; an empty word or white space at its
        ends raises ValueError."""
        known = self.older.get(word)
        if known is None:
            tail = self.TAIL.fullmatch(word)
            if tail:
                if tail[2] not in self.tails:
                    if len(self.tails) > 10_000:
                        self.tails.clear()
                    self.tails[tail[2]] = self._merged(tail[2])
                known = (self.memo.get(tail[1]) or self._new(tail[1])) + self.tails[tail[2]]
            elif not word or word[0].isspace() or word[-1].isspace():
                raise ValueError(word)
            else:
                known = self._merged(" " + word)
        if len(self.memo) >= MEMO:
            self.older, self.memo = self.memo, {}
        self.memo[word] = known
        return known

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            if "<|" in text or not first or first[0].isspace() or first[-1].isspace():
                raise ValueError(first)
            get, new = self.memo.get, self._new
            return b"".join([self._merged(first), *[get(w) or new(w) for w in rest]])
        except ValueError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers
        return WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN)
    return WordEncoder(path)


def pieces_of(ids: bytes, sequence: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document."""
    n = len(ids) // 4
    for start in range(0, n, sequence):
        piece = ids[4 * start:4 * (start + sequence)]
        yield start, len(piece) // 4, zlib.crc32(piece)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items go longest first, each into the first
    bin that has room, found by a tournament tree over the free capacities."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         sequence: int = SEQUENCE, end_token: int = END_TOKEN, group_docs: int = GROUP_DOCS, seed: int = 6) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship_package(docs.sparkSession)
    end = np.array([end_token], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array):
                ids = encode(text or "") + end
                rows += [(doc_id, *piece, len(ids) // 4) for piece in pieces_of(ids, sequence)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = staged(narrow.mapInPandas(cut, PIECES).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    whole = pieces.filter(F.col("length") == sequence)
    rest = pieces.filter(F.col("length") < sequence)
    groups = max(1, -(-rest.count() // group_docs))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), sequence)
        group["sequence_id"] = (group["grp"].to_numpy(np.int64) * (1 << 24) + bins) * 2 + 1
        group["offset"] = offsets
        return group.drop(columns=["uid", "grp"])

    columns = [*PIECES.replace(" long", "").split(", "), "sequence_id", "offset"]
    packed = rest.groupBy("grp").applyInPandas(fit, PIECES + ", sequence_id long, offset long")
    return whole.withColumn("sequence_id", F.col("uid") * 2).withColumn("offset", F.lit(0).cast("long")).select(columns).unionByName(packed.select(columns))
