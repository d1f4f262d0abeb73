"""Sequential operators with a small state: caption groups and budgeted chunks.

A fold streams over the ordered rows of its sources in Arrow batches and keeps only its state, so a source of any
length takes bounded memory; sources run side by side.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ENDS = re.compile(r"[.!?؟…]$")


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], make: Callable, schema: str) -> DataFrame:
    """Runs ``make()`` for each entity: an object with ``add(row) -> rows`` and ``end() -> rows``, fed in order.

    Result rows are tuples; the entity's keys come before them in ``schema``.
    """
    columns = [part.strip().split(" ")[0] for part in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if fold is None or key != now:
                    if fold is not None:
                        out += [(*now, *x) for x in fold.end()]
                    now, fold = key, make()
                out += [(*key, *x) for x in fold.add(row)]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if fold is not None and (rest := [(*now, *x) for x in fold.end()]):
            yield pd.DataFrame(rest, columns=columns)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


#: Seconds of the slices in which words are ordered before they are folded.
SLICE_S = 60.0


class _Captions:
    def __init__(self, most: int, chars: int, gap_s: float):
        self.most, self.chars, self.gap_s, self.words, self.no = max(1, most), chars, gap_s, [], 0

    def _flush(self) -> list[tuple]:
        if not self.words:
            return []
        found = [(self.no, self.words[0][0], self.words[-1][1], " ".join(w[2] for w in self.words))]
        self.no, self.words = self.no + 1, []
        return found

    def add(self, row) -> list[tuple]:
        out, word = [], row.word
        size = len(" ".join(w[2] for w in self.words))
        if self.words and (row.w_start - self.words[-1][1] >= self.gap_s or len(self.words) >= self.most or size + len(word) > self.chars):
            out += self._flush()
        self.words.append((row.w_start, row.w_end, word))
        return out + (self._flush() if _ENDS.search(word) else [])

    def end(self) -> list[tuple]:
        return self._flush()


def caption_groups(words: DataFrame, keys: list[str], key_schema: str, most: int = 5, chars: int = 42, gap_s: float = 0.45) -> DataFrame:
    """keys, caption_no, start, end, text: words (keys, w_start, w_end, word; blank ones left out before) in short groups.

    A group ends before a silence of ``gap_s``, after ``most`` words, before it would pass ``chars``, and after the end
    of a sentence. Equal starts are ordered by end and text. Null keys are an entity like any other.

    Nothing of a group is carried over a silence or the end of a sentence. So the words from the first such place of a
    slice of a minute up to that of a later slice are folded on their own, beside all others; what a slice has to know
    of those before it, and the numbers of the groups, come from one row for each slice.
    """
    rows = words.select(F.struct(*keys).alias("_k"), "w_start", "w_end", "word", F.floor(F.col("w_start") / SLICE_S).alias("_slice"), F.col("word").rlike(_ENDS.pattern).alias("_ends"))
    own, earlier = Window.partitionBy("_k", "_slice").orderBy("w_start", "w_end", "word"), (Window.unboundedPreceding, -1)
    before = F.lag(F.struct("w_end", "_ends")).over(own)
    rows = rows.withColumn("_b", before).withColumn("_last", F.lead("w_end").over(own).isNull())
    rows = rows.withColumn("_opens", (F.col("w_start") - F.col("_b.w_end") >= gap_s) | F.col("_b._ends"))
    slices = rows.groupBy("_k", "_slice").agg(F.min("w_start").alias("_first"), F.max(F.when(F.col("_last"), F.col("w_end"))).alias("_e"), F.max(F.when(F.col("_last"), F.col("_ends"))).alias("_s"), F.max("_opens").alias("_some"))
    over = Window.partitionBy("_k").orderBy("_slice")
    at_first = F.lag("_e").over(over).isNull() | (F.col("_first") - F.lag("_e").over(over) >= gap_s) | F.lag("_s").over(over)
    slices = slices.withColumn("_at_first", at_first)
    home = F.max(F.when(F.col("_at_first") | F.coalesce("_some", F.lit(False)), F.col("_slice"))).over(over.rowsBetween(*earlier))
    rows = rows.join(slices.select("_k", "_slice", "_at_first", home.alias("_home")), ["_k", "_slice"])
    opened = F.max(F.coalesce("_opens", "_at_first")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*[F.col("_k")[k].alias(k) for k in keys], F.when(opened, F.col("_slice")).otherwise(F.col("_home")).alias("home"), "w_start", "w_end", "word")
    schema = f"{key_schema}, home bigint, place int, start double, end double, text string"
    made = ordered_fold(rows, [*keys, "home"], ["w_start", "w_end", "word"], lambda: _Captions(most, chars, gap_s), schema).withColumn("_k", F.struct(*keys))
    counts = made.groupBy("_k", "home").agg(F.count("*").alias("_n")).select("_k", "home", F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("home").rowsBetween(*earlier)), F.lit(0)).alias("_base"))
    made = made.join(counts, ["_k", "home"])
    return made.select(*keys, (F.col("_base") + F.col("place")).cast("int").alias("caption_no"), "start", "end", "text")


class _Chunks:
    def __init__(self, budget: int, overlap: int):
        self.budget, self.overlap, self.rows, self.size, self.no, self.begin, self.fresh = budget, overlap, [], 0, 0, 0, False

    def add(self, row) -> list[tuple]:
        out = []
        if self.rows and self.size + len(row.line) > self.budget:
            out.append(self._chunk())
            first, last = self.rows[0][0], self.rows[-1][0]
            start = max(first + 1, last + 1 - self.overlap)
            self.rows = [x for x in self.rows if x[0] >= start]
            self.size = sum(len(t) + 1 for _, t in self.rows)
            # What is repeated may leave no room: then the next chunk starts later, as it would if it were tried.
            while self.rows and self.size + len(row.line) > self.budget:
                out.append(self._chunk())
                start = max(self.rows[0][0] + 1, self.rows[-1][0] + 1 - self.overlap)
                self.rows = [x for x in self.rows if x[0] >= start]
                self.size = sum(len(t) + 1 for _, t in self.rows)
        self.rows.append((row.place, row.line))
        self.size += len(row.line) + 1
        return out

    def _chunk(self) -> tuple:
        self.no += 1
        return self.no - 1, self.rows[0][0], self.rows[-1][0] + 1, "\n".join(t for _, t in self.rows)

    def end(self) -> list[tuple]:
        return [self._chunk()] if self.rows else []


def budget_chunks(segments: DataFrame, budget: int = 4_500, overlap: int = 2) -> DataFrame:
    """source_id, chunk_no, first, last, text: numbered rows packed into requests of at most ``budget`` characters.

    ``segments``: source_id, place (from 0 without holes), text. A row that is longer than 1,800 characters is shortened
    to its beginning and end; each chunk repeats the last ``overlap`` rows of the one before; ``last`` is exclusive.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    t = F.when(F.length(t) > 1_800, F.concat(F.substring(t, 1, 1_400), F.lit(" [excerpt shortened] "), F.right(t, F.lit(350)))).otherwise(t)
    rows = segments.select("source_id", "place", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), t).alias("line"))
    return ordered_fold(rows, ["source_id"], ["place"], lambda: _Chunks(budget, overlap), "source_id string, chunk_no int, first int, last int, text string")
