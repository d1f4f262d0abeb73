"""Byte-level BPE encoding of whole texts with a public vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every query through this environment variable.
FOLDER = os.environ.get("SPANLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the vocabulary's rule for cutting a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose ids a worker remembers; when they are more, it starts anew.
REMEMBERED = 100_000

_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: bytes of each token -> its rank, which is its id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: adjacent parts are merged, always the leftmost pair of the lowest rank.

    A segment tree over the byte positions holds, for each live part, the rank of the pair it forms with the next
    live part; an inner node holds the smaller of its children, so walking down from the root, left on ties, leads to
    the leftmost minimum. A merge changes the ranks at three positions, each in logarithmic time, so a piece of n
    bytes takes O(n log n), also where it is a whole text without blanks.
    """
    n = len(piece)
    if n == 0:
        return []
    width = 1
    while width < n:
        width *= 2
    tree = [_NONE] * (2 * width)
    nxt = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    for i in range(n - 1):
        tree[width + i] = ranks.get(piece[i : i + 2], _NONE)
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(at: int, rank: int) -> None:
        k = width + at
        tree[k] = rank
        k //= 2
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                break
            tree[k] = least
            k //= 2

    while tree[1] < _NONE:
        k = 1
        while k < width:
            k *= 2
            if tree[k] > tree[k + 1]:
                k += 1
        i = k - width
        j = nxt[i]
        nxt[i] = end = nxt[j]
        if end < n:
            before[end] = i
        put(j, _NONE)
        put(i, ranks.get(piece[i : nxt[end]], _NONE) if end < n else _NONE)
        if (p := before[i]) >= 0:
            put(p, ranks.get(piece[p:end], _NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : nxt[i]]])
        i = nxt[i]
    return ids


class Encoder:
    """Encodes texts, remembering the pieces met so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pieces, self.known = ranks, regex.compile(PIECES), {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces.findall(text or ""):
            found = self.known.get(piece)
            if found is None:
                data = piece.encode("utf-8", "surrogatepass")
                whole = self.ranks.get(data)
                found = [whole] if whole is not None else merge_piece(data, self.ranks)
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                if len(piece) <= 64:
                    self.known[piece] = found
            ids.extend(found)
        return ids


def _encoder(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """The vocabulary, of fixed size, sent once to each executor; an encoder of it for each Python worker."""
    shared = spark.sparkContext.broadcast(read_ranks(path))
    kept: list[Encoder] = []

    def get() -> Encoder:
        if not kept:
            kept.append(Encoder(shared.value))
        return kept[0]

    return get


def token_ids(spark: SparkSession, text: str, path: str | None = None) -> Column:
    """Ids of column ``text`` without special tokens; an empty list for empty and for null text."""
    get = _encoder(spark, path or os.path.join(FOLDER, VOCABULARY))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encode = get().encode
        return pd.Series([encode(t) for t in texts], dtype=object)

    return ids(F.col(text))


def token_count(spark: SparkSession, text: str, path: str | None = None) -> Column:
    """Number of tokens of column ``text``; 0 for empty and for null text."""
    get = _encoder(spark, path or os.path.join(FOLDER, VOCABULARY))

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = get().encode
        return pd.Series([len(encode(t)) for t in texts], dtype="int64")

    return count(F.col(text))


def decoded(spark: SparkSession, ids: str, path: str | None = None) -> Column:
    """The text of a list of ids; null for null. Bytes that are no text on their own come out as U+FFFD."""
    get = _encoder(spark, path or os.path.join(FOLDER, VOCABULARY))
    kept: list[dict[int, bytes]] = []

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        if not kept:
            kept.append({i: b for b, i in get().ranks.items()})
        return pd.Series([None if x is None else b"".join([kept[0][int(i)] for i in x]).decode("utf-8", "replace") for x in lists], dtype=object)

    return text(F.col(ids))


def encode_corpus(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of each row; no shuffle, so ties, repeated rows and null keys stay as they are.

    Extra columns are dropped. Very long texts take time in proportion to n log n of their longest piece.
    """
    return docs.select(F.col(key), token_ids(docs.sparkSession, text, path).alias("ids"))
