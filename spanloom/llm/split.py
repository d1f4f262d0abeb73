"""Cutting oversized texts into pieces at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a cut costs at each kind of boundary; the kinds from the most natural to the least.
PENALTY = {"part": 0.0, "line": 0.2, "sentence": 0.5, "pause": 1.0, "clause": 2.0, "word": 5.0, "hard": 40.0}
KINDS = list(PENALTY)
#: A silence between words of this many seconds or more is a natural place.
PAUSE_S = 0.45
#: A word stands for its first place within so many characters; further on, the next words must follow within GAP.
NEAR, GAP = 400, 40

_ENDS = regex.compile(r"(?P<line>[^\S\n]*\n\s*)|(?P<sentence>[.!?…؟。！？۔]+[\"'”’»)\]]*\s+|[。！？]+)|(?P<clause>[,;:،؛、–—]+[\"'”’»)\]]*\s+)|(?P<word>\s+)")


@dataclass(frozen=True)
class Limits:
    """A piece has at most ``longest`` code points, of which ``overlap`` repeat the end of the piece before it."""

    longest: int
    overlap: int
    balance: float = 20.0

    def __post_init__(self):
        if not 0 <= self.overlap < self.longest // 2 or self.longest < 2:
            raise ValueError("the overlap must be less than half of the longest piece")


def boundaries(text: str, marks: dict[int, str], step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``text`` may be cut, in order, and what a cut costs there; the last is the end of the text.

    A cut stands after the blank that follows a line, sentence, clause or word; ``marks`` has further natural places
    (parts, pauses). Where two places are more than ``step`` apart, cuts between characters are allowed from then on,
    but never before a combining mark or next to a joiner.
    """
    costs: dict[int, float] = {}
    n = len(text)
    for m in _ENDS.finditer(text):
        if 0 < m.end() < n:
            costs[m.end()] = PENALTY[m.lastgroup]
    for at, kind in marks.items():
        if 0 < at < n:
            costs[at] = min(PENALTY[kind], costs.get(at, PENALTY[kind]))
    places, out = sorted(costs), []
    last = 0
    for at in [*places, n]:
        if at - last > step:
            stride = max(1, step // 8)
            for x in range(last + stride, at, stride):
                while last < x and (regex.match(r"[\p{M}\u200d]", text[x]) or text[x - 1] == "\u200d"):
                    x -= 1
                if last < x and x not in costs:
                    costs[x] = PENALTY["hard"]
                    out.append(x)
        out.append(at)
        last = at
    costs[n] = 0.0
    at = np.array(sorted(set(out)), dtype=np.int64)
    return at, np.array([costs[int(x)] for x in at])


def cut_places(text: str, marks: dict[int, str], limits: Limits) -> list[int]:
    """Ends of the pieces, the last one the length of the text; a text within the limit is one piece.

    Dynamic programming over the boundaries: the cost of ending a piece at one is the least, over the ends of the
    piece before that keep it within the limit, of that one's cost plus the cut's own plus the squared deviation from
    equal sizes. The first piece is longer than the overlap, so that the next can repeat as much as is asked for.
    """
    n = len(text)
    if n <= limits.longest:
        return [n]
    fresh = limits.longest - limits.overlap
    at, cost = boundaries(text, marks, max(1, fresh // 2))
    count = -(-(n - limits.overlap) // fresh)
    target = (n + (count - 1) * limits.overlap) / count
    best = np.full(len(at), np.inf)
    back = np.full(len(at), -1, dtype=np.int64)
    first = np.searchsorted(at, at - fresh, "left")
    for k in range(len(at)):
        if at[k] <= limits.overlap:
            continue
        if at[k] <= limits.longest:
            best[k] = cost[k] + limits.balance * ((at[k] - target) / target) ** 2
        lo = int(first[k])
        if lo < k:
            sizes = at[k] - at[lo:k] + limits.overlap
            total = best[lo:k] + limits.balance * ((sizes - target) / target) ** 2
            j = int(np.argmin(total))
            if total[j] + cost[k] < best[k]:
                best[k], back[k] = total[j] + cost[k], lo + j
    if not np.isfinite(best[-1]):  # only marks or joiners as far as a piece reaches: cut at the limit itself
        return [*range(limits.longest, n, fresh), n]
    ends, k = [], len(at) - 1
    while k >= 0:
        ends.append(int(at[k]))
        k = int(back[k])
    return ends[::-1]


def _place(text: str, tokens: list[str], k: int, at: int) -> int:
    """Where the k-th of ``tokens`` stands in ``text`` from ``at`` on, or -1.

    Near ``at`` its first place counts. Further on, where words were left out in between, it counts if the next token
    (and the one after it) follows there too, else any word that isn't in the text would skip all up to a like one.
    """
    token = tokens[k]
    i = text.find(token, at)
    if i < 0 or i <= at + NEAR:
        return i
    while i >= 0:
        end = i + len(token)
        for after in tokens[k + 1 : k + 3]:
            j = text.find(after, end, end + len(after) + GAP)
            if j < 0:
                break
            end = j + len(after)
        else:
            return i
        i = text.find(token, i + 1)
    return -1


def word_times(text: str, words) -> tuple[list[tuple[int, int, float | None, float | None]], dict[int, str]]:
    """Words found in ``text`` in their order, as (from, to, start, end), and the pauses between them as marks.

    Words that are null, blank or not in the text are passed over, and what stands in the text but not among the words
    is skipped, however long it is; a pause needs the times of the two words next to it.
    """
    spoken = [(t, w) for w in (words if words is not None else []) if w is not None and (t := (w["text"] or "").strip())]
    tokens, found, marks, at, before = [t for t, _ in spoken], [], {}, 0, None
    for k, (token, w) in enumerate(spoken):
        i = _place(text, tokens, k, at)
        if i < 0:
            before = None
            continue
        if any(c.isalnum() for c in text[at:i]):  # words in between have no times
            before = None
        s, e = (None if x is None or x != x else float(x) for x in (w["start"], w["end"]))
        if before is not None and s is not None and s - before >= PAUSE_S:
            marks[i] = "pause"
        at, before = i + len(token), e
        found.append((i, at, s, e))
    return found, marks


def _pieces(limits_of: dict[str, Limits]):
    columns = ["item_kind", "source_id", "item_no", "piece_no", "pieces", "from_char", "to_char", "overlap", "start_s", "end_s", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, source, item, text, parts, words in zip(*[batch[c] for c in ("item_kind", "source_id", "item_no", "text", "parts", "words")]):
                limits = limits_of[kind]
                timed, marks = word_times(text, words)
                marks |= {int(p): "part" for p in np.cumsum(parts)} if parts is not None else {}
                ends = cut_places(text, marks, limits)
                begin = 0
                for k, end in enumerate(ends):
                    spoken = [w for w in timed if w[0] >= begin and w[1] <= end]
                    start_s = next((w[2] for w in spoken if w[2] is not None), None)
                    end_s = next((w[3] for w in reversed(spoken) if w[3] is not None), None)
                    rows.append((kind, source, item, k, len(ends), begin, end, limits.overlap if k else 0, start_s, end_s, text[begin:end]))
                    begin = end - limits.overlap
            yield pd.DataFrame(rows, columns=columns).astype({c: object for c in ("item_kind", "source_id", "text")} | {"start_s": "float64", "end_s": "float64"})

    return run


PIECE_SCHEMA = (
    "item_kind string, source_id string, item_no bigint, piece_no int, pieces int, from_char int, to_char int, overlap int, start_s double, end_s double, text string"
)


def split_items(items: DataFrame, limits_of: dict[str, Limits]) -> DataFrame:
    """Ordered pieces of each item: piece_no from 0, pieces, from_char and to_char in the item's text, overlap, text.

    ``items`` has item_kind, source_id, item_no, text, parts (array<int>: sizes of the parts that the text is joined from, in order) and
    words (array of start, end, text). Without the first ``overlap`` code points of each but the first piece, the
    pieces joined are the text. Times of a piece are those of the first and last timed word wholly in it, else null.
    Items with null or empty text have no piece; parts and words may be null, empty or incomplete. Items within the
    limit stay in the JVM as one piece without times; only longer ones go through the search. No shuffle, so repeated rows
    stay; extra columns are dropped.
    """
    limit = F.lit(None).cast("int")
    for kind, limits in limits_of.items():
        limit = F.when(F.col("item_kind") == kind, F.lit(limits.longest)).otherwise(limit)
    items = items.select("item_kind", "source_id", "item_no", "text", "parts", "words", F.length("text").alias("n")).filter(F.col("n") > 0)
    none = F.lit(None).cast("double")
    short = items.filter(F.col("n") <= limit).select(
        "item_kind", "source_id", F.col("item_no").cast("bigint").alias("item_no"), F.lit(0).alias("piece_no"), F.lit(1).alias("pieces"),
        F.lit(0).alias("from_char"), F.col("n").alias("to_char"), F.lit(0).alias("overlap"), none.alias("start_s"), none.alias("end_s"), "text",
    )
    return short.unionByName(long_pieces(items.filter(F.col("n") > limit), limits_of))


def long_pieces(items: DataFrame, limits_of: dict[str, Limits]) -> DataFrame:
    """Pieces of items that are all over their limit (see split_items)."""
    columns = ("item_kind", "source_id", F.col("item_no").cast("bigint").alias("item_no"), "text", "parts", "words")
    return items.select(*columns).mapInPandas(_pieces(limits_of), PIECE_SCHEMA)
