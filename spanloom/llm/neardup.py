"""Near-duplicate texts: a similarity join by signature trees over word shingles."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.lineage import cut
from spanloom.sources.tables import latest_by

#: Shingles and threshold a caller gets who names none; the threshold is a fraction, so that no float decides a tie.
WORDS, THRESHOLD = 5, (4, 5)
LEAST_WORDS = 40
#: Entries of one token that a task joins with each other; larger groups are split into blocks.
BLOCK = 16_384
#: Entries of one tree and of one task on average, and entries whose trees are traversed together.
TREE, TASK, CHUNK = 8_192, 250_000, 65_536
FANOUT = 8
#: Node pairs of one traversal step.
STEP = 100_000
#: Bits of a signature, and of that of sets of more than LONG shingles, however long the text is.
BITS, WIDE, LONG = 384, 1_536, 240
#: Counters, of a fixed number, from which the order of the shingles is taken; the first bits of a hash choose one.
COUNTERS, SLICE = 20, 1_024
#: Texts whose shingles are made, and pairs that are compared, at once.
AT_ONCE = 2_000
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000


class _Hashes(dict):
    """64 bits of each word, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_hashes = _Hashes()


def shingles(groups: list[str], said: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word n-gram of texts of single-blank separated words, repeated ones too.

    The group is part of what is hashed, so that the shingles of different groups are different.
    """
    parts = [t.split(" ") for t in said]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(parts)), dtype=np.uint64, count=int(lengths.sum()))
    many = np.maximum(0, lengths - words + 1)
    row = np.repeat(np.arange(len(said)), many)
    at = np.arange(len(row)) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(many) - many), many)
    h = np.array([_hashes["\0" + g] for g in groups], dtype=np.uint64)[row]
    for k in range(words):
        h = (h ^ flat[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return row, h


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(a, AT_ONCE)


def _texts_of(batch: pa.RecordBatch) -> tuple[list[str], list[str]]:
    return batch.column("grp").to_pylist(), batch.column("said").to_pylist()


def shingle_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all texts (grp, said) fall to each of the fixed number of counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in _slices(batches):
            _, h = shingles(*_texts_of(batch), words)
            total += np.bincount((h >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
        parts = [total[a : a + SLICE] for a in range(0, len(total), SLICE)]
        some = [k for k, p in enumerate(parts) if p.any()]
        small = [parts[k].astype(np.uint32 if parts[k].max() < 2**32 else np.uint64) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([p.tobytes() for p in small], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(*[c.to_pylist() for c in batch.columns]):
                total[part] = total.get(part, 0) + np.frombuffer(data, np.uint32 if len(data) == 4 * SLICE else np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([p.tobytes() for p in total.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    out = np.zeros(1 << COUNTERS, np.int64)
    for r in texts.select("grp", "said").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():
        out[r["part"] * SLICE : (r["part"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return out


def _signatures(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of all sets, one after the other, and how many bytes each has."""
    width = np.where(n > LONG, WIDE, BITS)
    starts = np.cumsum(width) - width
    bits = np.zeros(int(width.sum()), np.uint8)
    bits[starts[row] + (h % width[row].astype(np.uint64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little"), width // 8


def _gathered(data: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes]:
    """Offsets and bytes of the bitmaps of ``rows``."""
    many = sizes[rows]
    ends = np.cumsum(many)
    at = np.repeat((np.cumsum(sizes) - sizes)[rows] - (ends - many), many) + np.arange(int(many.sum()))
    return np.r_[0, ends].astype(np.int32).tobytes(), data[at].tobytes()


def _entries(counts, words: int, num: int, den: int, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text, once for each task that it goes to: its size, signature and the tokens by which it goes there."""
        table = counts.value
        for batch in _slices(batches):
            row, h = shingles(*_texts_of(batch), words)
            often = table[(h >> np.uint64(64 - COUNTERS)).astype(np.int64)]
            order = np.lexsort((h, often, row))
            row, h = row[order], h[order]
            first = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
            row, h = row[first], h[first]
            n = np.bincount(row, minlength=batch.num_rows)
            sig, sizes = _signatures(row, h, n)
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            routed = np.flatnonzero(place < (n + (-n * num) // den + 1)[row])
            task = ((h[routed] >> np.uint64(16)) % np.uint64(tasks)).astype(np.int64)
            routed = routed[order := np.lexsort((task, row[routed]))]
            task, owner = task[order], row[routed]
            begins = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (task[1:] != task[:-1])])
            own = owner[begins]
            sigs = pa.Array.from_buffers(pa.binary(), len(own), [None, *map(pa.py_buffer, _gathered(sig, sizes, own))])
            take = lambda name: batch.column(name).take(pa.array(own))  # noqa: B023, E731
            ends = pa.array(np.r_[begins, len(owner)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h[routed].view(np.int64), place[routed].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(task[begins].astype(np.int32)), take("grp"), take("id"), pa.array(n[own].astype(np.int32)), sigs, *lists], names=["task", "grp", "id", "n", "sig", "sh", "place"]
            )

    return run


ENTRIES = "task int, grp string, id bigint, n int, sig binary, sh array<bigint>, place array<int>"


@dataclass
class Level:
    """Nodes of one level: OR-combined bitmaps of tokens and of signatures, ranges of size, the most slack and reach, and where the children are."""

    tokens: np.ndarray
    sig: np.ndarray
    low: np.ndarray
    high: np.ndarray
    slack: np.ndarray
    reach: np.ndarray
    tree: np.ndarray
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _parents(level: Level) -> Level:
    """Up to FANOUT neighbours of one tree under a node."""
    starts = np.flatnonzero(np.r_[True, level.tree[1:] != level.tree[:-1]])
    within = np.arange(len(level.tree)) - np.repeat(starts, np.diff(np.r_[starts, len(level.tree)]))
    first = np.flatnonzero(within % FANOUT == 0)
    over = lambda f, x: f.reduceat(x, first)
    return Level(
        np.bitwise_or.reduceat(level.tokens, first, axis=0), np.bitwise_or.reduceat(level.sig, first, axis=0), over(np.minimum, level.low), over(np.maximum, level.high),
        over(np.maximum, level.slack), over(np.maximum, level.reach), level.tree[first], first, np.diff(np.r_[first, len(level.tree)]),
    )


def _possible(level: Level, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of nodes can have alike records below them: sizes fit, and the maximum possible overlap is enough.

    That overlap is nothing where the nodes have no token in common, and else the least of what the first common token
    can leave (reach) and the bits that the signatures share plus the shingles that share a bit (slack).
    """
    la, lb = level.low[a], level.low[b]
    need = -(-num * (la + lb) // (num + den))
    at = np.flatnonzero((level.high[a] * den >= lb * num) & (level.high[b] * den >= la * num) & (np.minimum(level.reach[a], level.reach[b]) >= need))
    at = at[(level.tokens[a[at]] & level.tokens[b[at]]).any(axis=1)]
    shared = np.bitwise_count(level.sig[a[at]] & level.sig[b[at]]).sum(axis=1, dtype=np.int64)
    return at[shared + np.minimum(level.slack[a[at]], level.slack[b[at]]) >= need[at]]


def forest_pairs(tree: np.ndarray, token: np.ndarray, size: np.ndarray, place: np.ndarray, sig: np.ndarray, num: int, den: int, met: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one tree, with the same token, whose likeness may reach num/den, by dual traversal.

    Rows are ordered by tree, token and size. A leaf is one record by one of its tokens, ``place`` is where that stands
    in the record's own order: as the first token that two sets share, it leaves at most size - place of them. Pairs of
    nodes below the overlap that their least sizes need are dropped with all that is under them. ``met`` counts, by
    level, the node pairs that were looked at, and by (level, "kept") those that were not dropped.
    """
    none = np.zeros(0, np.int64)
    if len(tree) < 2:
        return none, none
    # Tokens are numbered in their tree, so that a bitmap has a bit for each.
    new = np.r_[True, (tree[1:] != tree[:-1]) | (token[1:] != token[:-1])]
    number = np.cumsum(new) - 1
    begins = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    number = number - np.repeat(number[begins], np.diff(np.r_[begins, len(tree)]))
    tokens = np.zeros((len(tree), int(number.max()) // 64 + 1), np.uint64)
    tokens[np.arange(len(tree)), number >> 6] = np.uint64(1) << (number & 63).astype(np.uint64)
    slack = size - np.bitwise_count(sig).sum(axis=1, dtype=np.int64)
    levels = [Level(tokens, sig, size, size, slack, size - place, tree)]
    while len(levels[-1].tree) > len(begins):
        levels.append(_parents(levels[-1]))
    if len(levels) == 1:
        return none, none
    todo = [(len(levels) - 1, np.arange(len(levels[-1].tree)), np.arange(len(levels[-1].tree)))]
    left, right = [], []
    while todo:
        at, a, b = todo.pop()
        keep = _possible(levels[at], a, b, num, den)
        if met is not None:
            met[at] += len(a)
            met[at, "kept"] += len(keep)
        a, b = a[keep], b[keep]
        if at == 0:
            left.append(a)
            right.append(b)
            continue
        level = levels[at]
        many = level.count[a] * level.count[b]
        ends = np.cumsum(many)
        begin = 0
        while begin < len(a):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + STEP, "right")))
            x, y, m = a[begin:stop], b[begin:stop], many[begin:stop]
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wide = np.repeat(level.count[y], m)
            ca, cb = np.repeat(level.first[x], m) + k // wide, np.repeat(level.first[y], m) + k % wide
            # Below one node, each pair of children counts once, and no record meets itself.
            good = (np.repeat(x != y, m)) | (ca < cb if at == 1 else ca <= cb)
            todo.append((at - 1, ca[good], cb[good]))
            begin = stop
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _bitmaps(sig: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of BITS bits of all rows, the wider ones folded; those of WIDE bits, and each row's place among these (-1: none)."""
    ends = np.frombuffer(sig.buffers()[1], np.int32)[sig.offset : sig.offset + len(sig) + 1].astype(np.int64)
    data = np.frombuffer(sig.buffers()[2], np.uint8)
    long = np.diff(ends) > BITS // 8
    at = lambda rows, bits: np.ascontiguousarray(data[ends[:-1][rows][:, None] + np.arange(bits // 8)]).view(np.uint64)
    wide = at(long, WIDE)
    narrow = np.empty((len(sig), BITS // 64), np.uint64)
    narrow[~long] = at(~long, BITS)
    narrow[long] = np.bitwise_or.reduce(wide.reshape(len(wide), WIDE // BITS, BITS // 64), axis=1)
    return narrow, wide, np.where(long, np.cumsum(long) - 1, -1)


def _join_chunk(table: pa.Table, num: int, den: int, met: Counter | None) -> pa.RecordBatch:
    """Pairs within the trees of ``table``; in a tree of two blocks only across the two."""
    sig, wide, place_wide = _bitmaps(table.column("sig").combine_chunks())
    _, tree = np.unique(_column(table, "tree"), return_inverse=True)
    token, size, place, ids = (_column(table, c).astype(np.int64) for c in ("sh", "n", "place", "id"))
    order = np.lexsort((size, token, tree))
    a, b = forest_pairs(tree[order], token[order], size[order], place[order], sig[order], num, den, met)
    a, b = order[a], order[b]
    both = np.flatnonzero((place_wide[a] >= 0) & (place_wide[b] >= 0))
    x, y = place_wide[a[both]], place_wide[b[both]]
    slack = size[place_wide >= 0] - np.bitwise_count(wide).sum(axis=1, dtype=np.int64)
    enough = np.ones(len(a), bool)
    shared = np.bitwise_count(wide[x] & wide[y]).sum(axis=1, dtype=np.int64) + np.minimum(slack[x], slack[y])
    enough[both] = shared * (num + den) >= (size[a[both]] + size[b[both]]) * num
    a, b = a[enough], b[enough]
    cross, block = _column(table, "cross"), _column(table, "b")
    ok = (ids[a] != ids[b]) & (~cross[a] | (block[a] != block[b]))
    a, b = a[ok], b[ok]
    group = table.column("grp").combine_chunks().dictionary_encode()
    found = np.unique(np.stack([group.indices.to_numpy()[a], np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]), axis=1)
    return pa.RecordBatch.from_arrays([group.dictionary.take(pa.array(found[0])).cast(pa.string()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names=["grp", "a", "b"])


def _joiner(num: int, den: int, report: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come ordered by tree; whole trees are joined as soon as there are enough rows."""
        met: Counter | None = Counter() if report else None
        kept: list[pa.RecordBatch] = []
        n = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                kept.append(batch)
                n += batch.num_rows
                if n < CHUNK:
                    continue
            if not kept:
                continue
            table = pa.Table.from_batches(kept)
            ready = n
            if batch is not None:
                trees = _column(table, "tree")
                ready = int(np.argmax(trees == trees[-1]))  # the last tree may go on
                kept, n = table.slice(ready).to_batches(), n - ready
            if ready:
                out = _join_chunk(table.slice(0, ready), num, den, met)
                if not report:
                    yield out
        if report:
            levels = sorted(k for k in met if not isinstance(k, tuple))
            yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array([met[k] for k in levels], pa.int64()), pa.array([met[k, "kept"] for k in levels], pa.int64())], names=["level", "met", "kept"])

    return run


def _routed(reps: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """tree, sh, cross, b, grp, id, n, place, sig: every text by each of its tokens, in the tasks and order of the trees."""
    num, den = threshold
    counts = shingle_counts(reps, words)
    total = int(counts.sum()) * (den - num) // den
    cores = reps.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // TASK), min(2 * cores, total // (TASK // 16)))
    shared = reps.sparkSession.sparkContext.broadcast(counts)
    entries = reps.select("grp", "id", "said").mapInArrow(_entries(shared, words, num, den, tasks), ENTRIES)
    flat = lambda df: df.select("task", "grp", "id", "n", "sig", F.inline(F.arrays_zip("sh", "place")))
    trees = max(1, -(-total // (tasks * TREE)))
    large = None
    if (counts > BLOCK).any():
        # A counter is at least as high as each of its shingles' counts, so only these can be those of more than a block.
        bound = reps.sparkSession.sparkContext.broadcast(np.flatnonzero(counts > BLOCK))

        def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = (batch.column("sh").to_numpy().view(np.uint64) >> np.uint64(64 - COUNTERS)).astype(np.int64)
                yield batch.filter(pa.array(np.isin(at, bound.value)))

        found = flat(entries).select("sh").mapInArrow(hot, "sh bigint")
        large = cut(found.groupBy("sh").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK))
        large = None if large.isEmpty() else large
    number = lambda sh: F.pmod(sh, F.lit(trees))
    if large is None:
        rows = flat(entries.repartitionById(tasks, F.col("task")))
        rows = rows.select(number(F.col("sh")).alias("tree"), "sh", F.lit(False).alias("cross"), F.lit(0).alias("b"), "grp", "id", "n", "place", "sig")
        return rows.sortWithinPartitions("tree")
    rows = flat(entries).join(large, "sh", "left")
    blocks = F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
    # Two blocks of a large token have a tree of their own; that two such trees may get one number does no harm.
    tree = F.when(F.col("m").isNull(), F.col("task") * F.lit(trees) + number(F.col("sh"))).otherwise(F.xxhash64("sh", "i", "j"))
    rows = rows.select(tree.cast("long").alias("tree"), "sh", (F.col("i") != F.col("j")).alias("cross"), "b", "grp", "id", "n", "place", "sig")
    return rows.repartition(tasks, "tree").sortWithinPartitions("tree")


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.r_[np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
    return row[first], h[first]


def _exact(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many shingles the two texts of each row have, and how many they share."""
        for batch in (b.iloc[a : a + AT_ONCE] for b in batches for a in range(0, len(b), AT_ONCE)):
            groups = batch["grp"].tolist()
            row, h = zip(*[_distinct(*shingles(groups, batch[side].tolist(), words)) for side in ("said_a", "said_b")])
            many = [np.bincount(r, minlength=len(batch)).astype(np.int32) for r in row]
            either, _ = _distinct(np.concatenate(row), np.concatenate(h))
            shared = many[0] + many[1] - np.bincount(either, minlength=len(batch)).astype(np.int32)
            yield batch[["grp", "id_a", "id_b"]].assign(shared=shared, na=many[0], nb=many[1])

    return run


def class_links(reps: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """grp, id_a, id_b (id_a < id_b), shared, na, nb of all pairs of texts whose Jaccard likeness is at least num/den.

    ``reps`` has grp, id, said (the words with one blank between), and is read several times. Every pair is found: two
    alike sets share a shingle among the first n - ceil(n * num/den) + 1 of each in one order of all shingles, here that
    of rising counts, so each text is sent to the tasks of these of its shingles, its tokens. The counts only order the
    shingles; they are kept in a fixed number of counters. In a task, the texts by their tokens form signature trees
    that are traversed against themselves. What survives the bound is compared exactly.
    """
    num, den = threshold
    pairs = _routed(reps, words, threshold).mapInArrow(_joiner(num, den), "grp string, a bigint, b bigint").distinct()
    side = lambda s: reps.select("grp", F.col("id").alias(s), F.col("said").alias(f"said_{s}"))
    pairs = pairs.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"])
    pairs = pairs.select("grp", F.col("a").alias("id_a"), F.col("b").alias("id_b"), "said_a", "said_b")
    found = pairs.mapInPandas(_exact(words), "grp string, id_a bigint, id_b bigint, shared int, na int, nb int")
    return found.filter(F.col("shared") * (num + den) >= (F.col("na") + F.col("nb")) * num)


def pruning(reps: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """level, met, kept: node pairs that the traversal looked at on each level (0: records), and those it didn't drop."""
    rows = _routed(reps, words, threshold).mapInArrow(_joiner(*threshold, report=True), "level int, met bigint, kept bigint")
    return rows.groupBy("level").agg(F.sum("met").alias("met"), F.sum("kept").alias("kept"))


@dataclass
class NearDuplicates:
    """members: grp, id, class_id (least id of the records with the same words); links: between classes, as of class_links."""

    members: DataFrame
    links: DataFrame


def classes(rows: DataFrame, group: str, key: str, text: str, words: int, least_words: int = 0, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (grp, id, cls, class_id) and one text for each class (grp, id, said); see near_duplicates."""
    w = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))
    when = F.lit(None).cast("int") if version is None else F.col(version)
    rows = rows.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("bigint").alias("id"), when.alias("_v"), w.alias("w")).filter(F.col("id").isNotNull() & F.col("grp").isNotNull())
    said = F.when(F.size("w") >= max(least_words, words), F.array_join("w", " "))
    rows = rows.select("grp", "id", "_v", said.alias("said"), F.md5(said).alias("cls"))
    # Digests decide which version counts and what is a copy; a text is shuffled once for each class.
    one = latest_by(rows.select("grp", "id", "_v", "cls"), ["grp", "id"], ["cls"], "_v").filter(F.col("cls").isNotNull())
    members = cut(one.join(one.groupBy("grp", "cls").agg(F.min("id").alias("class_id")), ["grp", "cls"]).select("grp", "id", "cls", "class_id"))
    # Rows without a class fall to one row of each group and out of the join; a filter would make all words twice.
    texts = rows.groupBy("grp", "cls").agg(F.first("said").alias("said"))
    reps = cut(texts.join(members.filter("id = class_id").select("grp", "cls", "id"), ["grp", "cls"]).select("grp", "id", "said"))
    return members, reps


def near_duplicates(
    rows: DataFrame, group: str, key: str, text: str, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, least_words: int = 0, version: str | None = None
) -> NearDuplicates:
    """Records whose texts are alike, over the whole table; only records with the same ``group`` are compared.

    Likeness: distinct word n-grams in both, divided by those in either; words are maximal runs of letters, marks and
    numbers of the lower-cased text. Records with the same words make a class, however many they are, and only its least
    id is joined. ``key`` is a whole number; a key that is delivered more than once counts with the text of the greatest
    ``version`` (a tie is decided by a digest of the words). Null keys and groups, null texts, empty texts and those of
    fewer than ``least_words`` words, or too few for a shingle, are in no class. Extra columns are dropped.
    """
    members, reps = classes(rows, group, key, text, words, least_words, version)
    return NearDuplicates(members.select("grp", "id", "class_id"), cut(class_links(reps, words, threshold)))


def all_pairs(found: NearDuplicates) -> DataFrame:
    """grp, id_a, id_b of all alike records, copies included; its size is that of the result."""
    m = found.members
    one = lambda s: m.select("grp", F.col("class_id").alias(f"id_{s}"), F.col("id").alias(s))
    across = found.links.select("grp", "id_a", "id_b").join(one("a"), ["grp", "id_a"]).join(one("b"), ["grp", "id_b"]).select("grp", "a", "b")
    within = one("a").withColumnRenamed("id_a", "c").join(one("b").withColumnRenamed("id_b", "c"), ["grp", "c"]).filter("a < b").select("grp", "a", "b")
    both = across.unionByName(within)
    return both.select("grp", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def components(links: DataFrame) -> DataFrame:
    """grp, id, root: the least id that a chain of links (grp, id_a, id_b) reaches from each linked id.

    Alternating star contraction: each round joins every record's neighbours to the least of them, first the larger
    and then the smaller ones, until nothing changes; the rounds grow with the logarithm of the chain length. Each
    round is written to the checkpoint folder.
    """
    edges = cut(links.select("grp", F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).filter("u > v").distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("grp", "u", "v").cast("decimal(38,0)"))).first()

    now = state(edges)
    while True:
        both = edges.unionByName(edges.select("grp", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("grp", "u").agg(F.min("v").alias("m")).select("grp", "u", F.least("u", "m").alias("m"))
        large = both.join(least, ["grp", "u"]).filter("v > u").select("grp", F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("grp", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["grp", "u"])
        small = small.select("grp", F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        edges = cut(small.filter("u > v").distinct())
        before, now = now, state(edges)
        if before == now:
            break
    roots = edges.select("grp", F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select("grp", F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def groups(found: NearDuplicates) -> DataFrame:
    """grp, id, class_id, links (of its class to other classes), group_id: one row for each record that was compared."""
    ends = found.links.select("grp", F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("grp", "class_id").agg(F.count("*").alias("links"))
    roots = components(found.links).select("grp", F.col("id").alias("class_id"), "root")
    rows = found.members.join(ends, ["grp", "class_id"], "left").join(roots, ["grp", "class_id"], "left")
    return rows.select("grp", "id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.coalesce("root", "class_id").alias("group_id"))
