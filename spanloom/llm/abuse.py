"""Scores for abusive, hateful and sexual language: a linear classifier of character n-grams scaled by naive Bayes."""

from __future__ import annotations

import re
import unicodedata as U
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.langid import readable
from spanloom.llm.lookalike import Table, plain_forms
from spanloom.sources.tables import hashed_share

#: Features are hashes of the n-grams of these lengths; a binary feature counts once a sentence.
BITS, LENGTHS = 18, (3, 4, 5)
#: Labelled clips, those with the least hashes of their ids, that the classifier is fitted on.
SAMPLE = 5_000
#: Sentences of more words are also scored in windows of so many, at this distance, as full stops may be missing.
WINDOW, STRIDE = 9, 5
#: Texts whose features are made at once.
AT_ONCE = 4_000
#: Clips of a batch that are scored together.
CLIPS_AT_ONCE = 500
#: Parts of the texts that a step of a fit is taken on, rounds over all, of which the last ones' weights count, and the penalty on weights.
PARTS, ROUNDS, MEAN, PENALTY, RATE, SEED = 10, 7, 2, 2e-4, 0.06, 4_711
#: The weight of a chosen sentence until a fit on other clips gives it the score of CONFIRM or more.
DOUBT, CONFIRM = 0.1, 0.05
#: Added to the counts of each class before their ratio is taken.
SMOOTH = 0.5
#: A clip whose best sentence scores this much or more is a case.
CUT = 0.8

# Signs that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "€": "e", "!": "i", "|": "i", "+": "t"})

_SENTENCE = re.compile(r"(?<=[.!?؟。！？…])[\"'”’»)\]]*\s+|[\n\r|]+")
_SIGN = re.compile("[" + re.escape("".join(map(chr, DISGUISE))) + "]")
_TOKEN = re.compile(r"\S+")
#: Two single letters, or signs for them, with a sign or blank between: only then may a word be spelled out.
_SINGLE = re.compile(r"(?:^|[\W_])[^\W_2]\W?[-_.*~+ ]\S\W?(?:[-_.*~+ ]|$)|[$@!][-_.*~+ ]")
_SPELLED = regex.compile(r"(?<![\p{L}\p{M}\p{N}])(?:[\p{L}0134578$@!][\p{M}]*[-_.*~+ ]){2,}[\p{L}0134578$@!][\p{M}]*(?![\p{L}\p{M}\p{N}])")
_JOINTS = str.maketrans("", "", "-_.*~+ ")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_MARKS = dict.fromkeys([*range(0x64B, 0x660), 0x670, 0x640])


def _read(c: str) -> str:
    kind = U.category(c)[0]
    return c if kind in "LM" or c == "*" else "0" if kind == "N" else " "


_READ = Table(_read)
_ZEROS = re.compile("00+")


def sentences(title: str | None, text: str | None) -> list[str]:
    """The title's parts and the text's sentences, trimmed, without empty ones."""
    found = []
    for part in (title, text):
        if part:
            found += [s for x in _SENTENCE.split(plain_forms(readable(part))) if (s := x.strip())]
    return found


def _undisguised(m) -> str:
    """One token: signs for letters are read as such where the token also has letters and isn't a plain number."""
    token = m[0]
    if token.isalpha() or not _SIGN.search(token) or not any(c.isalpha() for c in token):
        return token
    core = token.rstrip(".,;:!?\"')]؟،")
    return core.translate(DISGUISE) + token[len(core) :]


def folded(sentence: str) -> str:
    """Lower case, Arabic vowel signs gone, spelled-out words joined, disguised letters read, numbers made alike."""
    text = sentence.lower()
    if not text.isascii():
        text = text.translate(_MARKS)
    if _SINGLE.search(text):
        text = _SPELLED.sub(lambda m: m[0].translate(_JOINTS), text)
    if _SIGN.search(text):
        text = _TOKEN.sub(_undisguised, text)
    text = _REPEATED.sub(r"\1", text).translate(_READ)
    return " " + " ".join((_ZEROS.sub("0", text) if "00" in text else text).split()) + " "


def windows(words: int) -> list[int]:
    """The first words of the windows of a sentence; each word of a long one is in a window."""
    last = words - WINDOW
    return [*range(0, last, STRIDE), last] if words > WINDOW + STRIDE else []


def units(found: list[str]) -> list[str]:
    """Folded sentences, and the windows of long ones."""
    out = []
    for sentence in found:
        out.append(sentence)
        words = sentence.split()
        out += [" " + " ".join(words[a : a + WINDOW]) + " " for a in windows(len(words))]
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each folded text, one after the other, and how many each text has."""
    if len(texts) > AT_ONCE:
        parts = [features(texts[a : a + AT_ONCE]) for a in range(0, len(texts), AT_ONCE)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    joined = "".join(texts)
    if not joined:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # AT_ONCE texts leave room for a feature beside the text's number in 32 bits.
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32) << np.uint32(BITS), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # letters from here to the text's end
    h = np.full(len(points), 1469598103934665603, np.uint64)
    parts = []
    with np.errstate(over="ignore"):
        for k in range(min(max(LENGTHS), len(points))):
            h = h.copy()
            h[: len(points) - k] = (h[: len(points) - k] ^ points[k:]) * np.uint64(1099511628211)
            if k + 1 in LENGTHS:
                at = np.flatnonzero(left > k)
                mixed = (h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
                parts.append(owner[at] | (mixed >> np.uint64(64 - BITS)).astype(np.uint32))
    both = np.sort(np.concatenate(parts or [np.zeros(0, np.uint32)]))
    both = both[np.r_[np.ones(min(1, len(both)), bool), both[1:] != both[:-1]]]
    return (both & ((1 << BITS) - 1)).astype(np.int32), np.bincount(both >> BITS, minlength=len(texts))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each text's values; a text may have none."""
    out = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], dtype=np.float64)
    return out


@dataclass
class Classifier:
    """weights already hold the log-count ratios; a sentence's features are divided by the root of their number."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Between 0 and 1 for each folded text."""
        at, sizes = features(texts)
        return self._scores(at, sizes)

    def _scores(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        z = _sums(self.weights[at], sizes) / np.sqrt(np.maximum(1, sizes)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, clips: list[tuple[list[str], int]], words: list[str]) -> Classifier:
        """From labelled clips (folded sentences, label) and listed words, which count as abusive sentences.

        A clip's label says that one of its sentences is abusive, not which, and isn't always right. Of each abusive
        clip the sentence or window with the greatest mean log-count ratio is taken, unless as many clean clips hold it,
        and weighs little. A fit on one half of the clips then chooses anew in the other half; what it finds there has
        full weight. The classifier is the fit on all. The steps are the same for any number of clips.
        """
        texts: list[str] = []
        index: dict[str, int] = {}

        def number(t: str) -> int:
            if t not in index:
                index[t] = len(texts)
                texts.append(t)
            return index[t]

        bags = [(np.array([number(s) for s in dict.fromkeys(units(found))], dtype=np.int64), label) for found, label in clips if found]
        listed = np.array([number(f" {w.strip()} ") for w in words], dtype=np.int64)
        if not len(listed) and not any(label for _, label in bags):
            return cls(np.zeros(1 << BITS, np.float32), -5.0)
        at, sizes = features(texts)
        ends = np.cumsum(sizes)
        clean, foul = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
        for bag, label in bags:
            (foul if label else clean)[bag] += 1
        ratio = cls._ratio(at, np.repeat(((foul > 0) & (clean == 0)).astype(np.float32), sizes), np.repeat((clean > 0).astype(np.float32), sizes))
        score = _sums(ratio[at], sizes) / np.maximum(1, sizes)
        trust = np.zeros(len(texts), np.float32)

        def fitted(which: list[int]) -> Classifier:
            """The fit on some of the clips, by what is chosen of the abusive ones."""
            weight, seen = np.zeros(len(texts), np.float32), np.zeros(len(texts), bool)
            weight[listed] = 1.0
            for k in which:
                bag, label = bags[k]
                if not label:
                    seen[bag] = True
                elif chosen[k] >= 0:
                    weight[chosen[k]] = np.maximum(weight[chosen[k]], trust[chosen[k]])
            use = np.flatnonzero((weight > 0) | seen)
            rows = np.concatenate([at[ends[i] - sizes[i] : ends[i]] for i in use])
            return cls._fit_rows(rows, sizes[use], weight[use])

        def choose(which: list[int], score: np.ndarray, least: float, then: float) -> None:
            for k in which:
                bag, label = bags[k]
                best = int(bag[np.argmax(score[bag])])
                if label and score[best] > least and foul[best] > clean[best]:
                    chosen[k], trust[best] = best, then

        everything = list(range(len(bags)))
        chosen = [-1] * len(bags)
        choose(everything, score, 0.0, DOUBT)
        halves = [everything[h::2] for h in (0, 1)]
        models = [fitted(half) for half in halves]
        for half, model in zip(halves, models[::-1]):
            choose(half, model._scores(at, sizes), CONFIRM, 1.0)
        return fitted(everything)

    @staticmethod
    def _ratio(at: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        """Log-count ratios of features, of which at least one occurrence counts for either class."""
        p = SMOOTH + np.bincount(at[pos > 0], minlength=1 << BITS)
        q = SMOOTH + np.bincount(at[neg > 0], minlength=1 << BITS)
        ratio = np.log((p / p.sum()) / (q / q.sum()))
        ratio[(p <= SMOOTH) & (q <= SMOOTH)] = 0.0
        return ratio

    @classmethod
    def _fit_rows(cls, at: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> Classifier:
        """Logistic regression on binary features times their log-count ratios. ``weight`` is that of an abusive text, 0 for others; together the abusive ones weigh a quarter."""
        n, y = 1 << BITS, (weight > 0).astype(np.float32)
        ratio = cls._ratio(at, np.repeat(y, sizes), np.repeat(1 - y, sizes)).astype(np.float32)
        root = (1.0 / np.sqrt(np.maximum(1, sizes))).astype(np.float32)
        balance = np.where(y > 0, 0.25 * weight / max(1.0, weight.sum()), 0.75 / max(1.0, (1 - y).sum()))
        # Steps over parts of the texts, in an order of their own; the weights are the mean over the last rounds.
        edges = np.r_[0, np.cumsum(sizes)]
        order = np.random.default_rng(SEED).permutation(len(sizes))
        parts = [np.sort(order[k::PARTS]) for k in range(PARTS)]
        gathered = [np.concatenate([at[edges[i] : edges[i + 1]] for i in part]) if len(part) else at[:0] for part in parts]
        w, m, v, bias, mb, vb = np.zeros(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0, 0.0, 0.0
        mean, mean_bias, step = np.zeros(n, np.float64), 0.0, 0
        for turn in range(ROUNDS):
            for part, own in zip(parts, gathered):
                step += 1
                many = sizes[part]
                z = _sums((w * ratio)[own], many) * root[part] + bias
                g = PARTS * balance[part] * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[part])
                grad = np.bincount(own, weights=np.repeat(g * root[part], many), minlength=n).astype(np.float32) * ratio + PENALTY * w
                gb = float(g.sum())
                m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
                mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
                rate = RATE / (1 + step / 40)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
                bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
                if turn >= ROUNDS - MEAN:
                    mean += w
                    mean_bias += bias
        w, bias = (mean / (MEAN * PARTS)).astype(np.float32), mean_bias / (MEAN * PARTS)
        return cls((w * ratio).astype(np.float32), float(bias))


def fit_classifier(clips: DataFrame, labels: DataFrame, blocklist: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The classifier from at most ``sample`` labelled clips (clip_id, title, text; clip_id, toxic; entry).

    A clip's label is that of most of its raters; clips on which they are split, and null labels, are left out. The
    block list is of fixed size; comments and blank lines in it don't count.
    """
    votes = labels.filter(F.col("toxic").isin(0, 1)).groupBy("clip_id").agg(F.avg("toxic").alias("mean")).filter(F.col("mean") != 0.5)
    votes = hashed_share(votes, "clip_id", sample, votes.count())
    rows = clips.join(votes, "clip_id").orderBy(F.pmod(F.xxhash64("clip_id"), F.lit(1 << 40)), "clip_id").limit(sample).select("title", "text", "mean").collect()
    known = [([folded(s) for s in sentences(r["title"], r["text"])], int(r["mean"] > 0.5)) for r in rows]
    listed = {folded(r["entry"].split("#", 1)[0]).strip() for r in blocklist.select("entry").filter(F.col("entry").isNotNull()).collect()}
    return Classifier.fit(known, sorted(listed - {""}))


def score_clips(clips: DataFrame, classifier: Classifier) -> DataFrame:
    """clip_id, source_id, score (0 without text), worst: the sentence that the score comes from, as the classifier reads it.

    A clip's score is that of its worst sentence or window of one. Nothing is shuffled; repeated rows and null ids
    stay, null and empty titles and texts count as absent, extra columns are dropped. The weights, of fixed size, are
    broadcast.
    """
    shared = clips.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[a : a + CLIPS_AT_ONCE] for b in batches for a in range(0, len(b), CLIPS_AT_ONCE)):
            parts = [list(dict.fromkeys(units([folded(s) for s in sentences(a, b)]))) for a, b in zip(batch["title"], batch["text"])]
            scores, begin, best = shared.value.scores([u for p in parts for u in p]), 0, []
            for p in parts:
                own = scores[begin : begin + len(p)]
                begin += len(p)
                k = int(own.argmax()) if p else -1
                best.append((round(float(own[k]), 6), p[k].strip()) if p else (0.0, None))
            yield pd.DataFrame({"clip_id": batch["clip_id"], "source_id": batch["source_id"], "score": [s for s, _ in best], "worst": pd.Series([w for _, w in best], dtype=object, index=batch.index)})

    return clips.select("clip_id", "source_id", "title", "text").mapInPandas(run, "clip_id bigint, source_id string, score double, worst string")
