"""Languages of documents and of their passages by hyperdimensional profiles."""

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

from spanloom.llm.lookalike import Table, plain_forms
from spanloom.sources.tables import hashed_share

# How labels name each language: codes, English name, own name.
LABELS = """
en eng english
ar ara arabic العربية عربي
es spa spanish español espanol castellano
fr fra fre french français francais
de deu ger german deutsch
pt por portuguese português portugues
it ita italian italiano
tr tur turkish türkçe turkce
ru rus russian русский
nl nld dut dutch nederlands
"""
# Labels that name no language.
NO_LABEL = {"", "und", "unknown", "n/a", "na", "xx", "xxx", "mul", "mis", "zxx", "unk", "none", "null", "undefined", "undetermined", "other", "?", "-", "??"}
NAMES = {name: line.split()[0] for line in LABELS.strip().splitlines() for name in line.split()}
LANGUAGES = list(dict.fromkeys(NAMES.values()))

#: GRAM letters are packed into 64 bits, 16 for each; letters beyond the basic plane fold onto it.
SEED, DIM, GRAM = 31_337, 4_096, 4
#: Labelled documents, taken in the order of a hash of their id, that the profiles are made from.
SAMPLE = 5_000
#: Letter n-grams whose products with the profiles a worker remembers.
REMEMBERED = 200_000
#: Texts whose n-grams are held at once, and documents of a batch that are worked on together.
AT_ONCE, DOCS_AT_ONCE = 8_000, 1_000
#: A passage speaks for a language of its own with this many words and letters, and this lead over the next language.
WHOLE_WORDS, WHOLE_LETTERS, LEAD = 3, 14, 0.02

_BREAK = re.compile(r"(?<=[.!?؟。！？…۔])[\"'”’»)\]]*\s+|[\n\r\u2028\u2029{}\[\]|<>\"“”«»#*=♪]+")
_LATIN_TWINS = str.maketrans("АВЕКМНОРСТУХІЅЈаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXISJaeopcyxsijABEZHIKMNOPTYXo")
_MIXED = regex.compile(r"\p{Latin}\p{M}*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{M}*\p{Latin}")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_SOME = re.compile(r"[^\W\d_]")
_NUMBERED = regex.compile(r"\S*\p{N}\S*")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")


def label_language(label: str | None) -> str:
    """The language that a label names, whatever its spelling; "" if it names none, "other" for one we don't know."""
    text = U.normalize("NFC", label or "").strip().casefold()
    if text in NO_LABEL:
        return ""
    if text in NAMES:
        return NAMES[text]
    first = regex.split(r"[-_ (]", text, maxsplit=1)[0]
    return NAMES.get(first, "" if first in NO_LABEL else "other")


def _letter(c: str) -> str:
    """Letters, marks and apostrophes as they are, numbers as 0, all else as a blank."""
    kind = U.category(c)[0]
    return c if kind in "LM" or c in "'’" else "0" if kind == "N" else " "


_letters = Table(_letter)


def letters_of(passage: str) -> tuple[str, int]:
    """The words of a passage in lower case with one blank between and around them, and their number.
    Tokens that hold a digit (file names, codes, times) are no words."""
    shown = passage.translate(_letters)
    if "0" in shown:
        shown = _NUMBERED.sub(" ", passage).translate(_letters)
    words = shown.split() if "'" not in shown and "’" not in shown else _WORD.findall(shown)
    return (" " + " ".join(words).lower() + " " if words else ""), len(words)


def passages(text: str) -> list[tuple[int, int]]:
    """Where the sentences, lines and fields of a text begin and end, without those that hold no letter."""
    found, begin = [], 0
    for m in _BREAK.finditer(text):
        end = m.start()
        if end > begin and _SOME.search(text, begin, end):
            found.append((begin, end))
        begin = m.end()
    if _SOME.search(text, begin):
        found.append((begin, len(text)))
    return found


def _single(c: str) -> str:
    """The form of a character where that is one character too."""
    form = plain_forms(c)
    return form if len(form) == 1 and c not in "یک" else " " if form.isspace() else c


_singles = Table(_single)


def readable(text: str) -> str:
    """Look-alike letters within words of mixed script as Latin ones; every code point keeps its place."""
    if text.isascii():
        return text
    shown = text.translate(_singles)
    if _MIXED.search(shown) is None:
        return shown
    return _LETTERS.sub(lambda m: m[0].translate(_LATIN_TWINS) if _MIXED.search(m[0]) else m[0], shown)


class Space:
    """Random vectors of +1 and -1 for letters; an n-gram's is the product of its letters' vectors, each rotated by its place."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.rotated: list[dict[int, np.ndarray]] = [{} for _ in range(GRAM)]

    def letter(self, code: int, place: int) -> np.ndarray:
        found = self.rotated[place].get(code)
        if found is None:
            bits = np.random.default_rng([SEED, code]).integers(0, 2, self.dim, dtype=np.int8)
            found = self.rotated[place][code] = np.roll(bits * 2 - 1, GRAM - 1 - place)
        return found

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of packed n-grams, one a row."""
        out = np.ones((len(codes), self.dim), dtype=np.int8)
        for place in range(GRAM):
            letters, at = np.unique((codes >> np.uint64(16 * (GRAM - 1 - place))) & np.uint64(0xFFFF), return_inverse=True)
            out *= np.stack([self.letter(int(c), place) for c in letters])[at]
        return out


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter n-grams of all texts as numbers, and how many each text has."""
    sizes = np.array([max(0, len(t) - GRAM + 1) for t in texts], dtype=np.int64)
    joined = "".join(texts)
    if not joined:
        return np.zeros(0, np.uint64), sizes
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) & np.uint64(0xFFFF)
    grams = np.zeros(max(0, len(points) - GRAM + 1), np.uint64)
    for place in range(GRAM):
        grams = (grams << np.uint64(16)) | points[place : place + len(grams)]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return grams[at], sizes


@dataclass
class Profiles:
    """Unit vectors of the languages: the bundle of a language's n-grams, weighted by the root of their share so that
    the commonest don't drown the rest, less what all languages have in common."""

    languages: list[str]
    vectors: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], rounds: int = 2) -> Profiles:
        """Profiles of labelled documents. Each further round leaves out passages that the last profiles assign to
        another language than their document's label, so that wrong labels and foreign passages lose their weight."""
        pieces, owner = [], []
        for text, label in zip(texts, labels):
            shown = readable(text)
            for a, b in passages(shown):
                letters, words = letters_of(shown[a:b])
                if words >= WHOLE_WORDS:
                    pieces.append(letters)
                    owner.append(label)
        languages = [x for x in LANGUAGES if x in set(owner)]
        if not languages:
            return cls([], np.zeros((0, DIM), np.float32))
        number = np.array([languages.index(x) for x in owner])
        grams, sizes = packed(pieces)
        distinct, at = np.unique(grams, return_inverse=True)
        del grams
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        at, keep = at.astype(np.int32), np.ones(len(pieces), bool)
        found = cls(languages, np.zeros((len(languages), DIM), np.float32))
        for again in range(rounds):
            use = keep[piece]
            counts = np.bincount(number[piece[use]] * len(distinct) + at[use], minlength=len(languages) * len(distinct)).reshape(len(languages), -1).astype(np.float32)
            found = cls(languages, cls._bundle(counts, distinct))
            if again < rounds - 1:
                cosines = Scorer(found).cosines(pieces)
                keep = cosines.argmax(axis=1) == number
        return found

    @staticmethod
    def _bundle(counts: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        space, total = Space(), np.zeros((len(counts), DIM), np.float64)
        shares = np.sqrt(counts / np.maximum(1.0, counts.sum(axis=1, keepdims=True)))
        if len(counts) > 1:
            shares = shares - shares.mean(axis=0)
        for a in range(0, len(distinct), 2_000):
            total += shares[:, a : a + 2_000] @ space.grams(distinct[a : a + 2_000]).astype(np.float32)
        norms = np.linalg.norm(total, axis=1, keepdims=True)
        return (total / np.where(norms > 0, norms, 1.0)).astype(np.float32)


class Scorer:
    """Cosines of texts with the profiles.

    A text's vector is the sum of its n-grams' vectors, so its product with a profile is the sum of theirs, which are
    remembered; its length is taken from the counts, as different n-grams' vectors are all but orthogonal.
    """

    def __init__(self, profiles: Profiles):
        self.profiles, self.space = profiles, Space()
        self.codes = np.zeros(0, np.uint64)
        self.products = np.zeros((0, len(profiles.languages)), np.float32)

    def _lookup(self, codes: np.ndarray) -> np.ndarray:
        """Products of sorted distinct n-grams."""
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        new = codes[self.codes[at] != codes] if len(self.codes) else codes
        if len(new):
            if len(self.codes) + len(new) > REMEMBERED:
                self.codes, self.products, new = self.codes[:0], self.products[:0], codes
            made = [self.space.grams(new[a : a + 2_000]).astype(np.float32) @ self.profiles.vectors.T for a in range(0, len(new), 2_000)]
            all_ = np.concatenate([self.codes, new])
            order = np.argsort(all_)
            self.codes, self.products = all_[order], np.concatenate([self.products, *made])[order]
            at = np.searchsorted(self.codes, codes)
        return self.products[at]

    def cosines(self, texts: list[str]) -> np.ndarray:
        """One row a text, one column a language; a bounded number of texts at a time."""
        if len(texts) > AT_ONCE:
            return np.concatenate([self.cosines(texts[a : a + AT_ONCE]) for a in range(0, len(texts), AT_ONCE)])
        out = np.zeros((len(texts), len(self.profiles.languages)), np.float32)
        grams, sizes = packed(texts)
        if not len(grams) or not out.shape[1]:
            return out
        distinct, at = np.unique(grams, return_inverse=True)
        products = self._lookup(distinct)
        pair = np.sort(np.repeat(np.arange(len(texts)), sizes) * len(distinct) + at)
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        count = np.diff(np.r_[first, len(pair)])
        owner, at = np.divmod(pair[first], len(distinct))
        begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[begins]] = np.add.reduceat(products[at] * count[:, None].astype(np.float32), begins, axis=0)
        square = np.bincount(owner, weights=count.astype(float) ** 2, minlength=len(texts))
        return out / np.sqrt(np.maximum(1.0, square) * self.space.dim)[:, None].astype(np.float32)


SCHEMA = "doc_id bigint, label string, languages array<string>, confidences array<double>, passages array<struct<from_char: int, to_char: int, lang: string, confidence: double>>"


def _confidence(cosines: np.ndarray) -> np.ndarray:
    """Of each row, the share of the best in the exponentials of the scaled cosines."""
    x = np.exp(40.0 * (cosines - cosines.max(axis=1, keepdims=True)))
    return (x.max(axis=1) / x.sum(axis=1)).astype(float)


def _judged(words: list[int], texts: list[str], cosines: np.ndarray):
    """Of each passage: its two likeliest languages, whether it is whole, whether it speaks for a language, its confidence."""
    order = np.argsort(-cosines, axis=1, kind="stable")[:, :2]
    n = np.arange(len(order))
    first = cosines[n, order[:, 0]]
    lead = first - (cosines[n, order[:, 1]] if cosines.shape[1] > 1 else -1.0)
    many = np.array(words, dtype=np.int64)
    whole = (many >= WHOLE_WORDS) & (np.array([len(t) for t in texts], dtype=np.int64) - many - 1 >= WHOLE_LETTERS)
    return order, whole, whole & (lead >= LEAD) & (first > 0), _confidence(cosines)


def _document(spans: list[tuple[int, int]], words: list[int], texts: list[str], cosines: np.ndarray, names: list[str]):
    """Languages of a document, with confidences, and its passages; both empty where it has no sentence (see _settled)."""
    return _settled(spans, texts, cosines, *_judged(words, texts, cosines), names)


def _mean(xs: list) -> float:
    ys = [x for x in xs if x is not None]
    return round(sum(ys) / len(ys), 6) if ys else 0.0


def _settled(spans: list[tuple[int, int]], texts: list[str], cosines: np.ndarray, order: np.ndarray, whole: np.ndarray, clear: np.ndarray, confidence: np.ndarray, names: list[str]):
    """Passages that are whole and lead clearly speak for their language. The others take the language of the last clear
    one before, or of the first one after, if that is among the two likeliest for them; what is left takes its own."""
    best = order[:, 0]
    if clear.all() and (best == best[0]).all():
        name, sure = names[best[0]], _mean(confidence.tolist())
        return [name], [sure], [{"from_char": int(spans[0][0]), "to_char": int(spans[-1][1]), "lang": name, "confidence": sure}]
    if not whole.any():
        return [], [], []
    if not clear.any():
        total = (cosines * np.array([len(t) for t in texts])[:, None])[whole].sum(axis=0)
        clear = whole & (best == total.argmax())
        if not clear.any():
            best = np.full(len(best), total.argmax())
            clear = whole
    lang, places = best.copy(), np.flatnonzero(clear)
    for k in np.flatnonzero(~clear):
        near = best[places[places < k][-1] if (places < k).any() else places[0]]
        if near in order[k]:
            lang[k] = near
    found: dict[int, list[float]] = {}
    for k in places:
        found.setdefault(int(lang[k]), []).append(float(confidence[k]))
    merged: list[list] = []
    for k, (a, b) in enumerate(spans):
        if merged and merged[-1][2] == lang[k]:
            merged[-1][1] = b
            merged[-1][3].append(float(confidence[k]) if clear[k] else None)
        else:
            merged.append([a, b, lang[k], [float(confidence[k]) if clear[k] else None]])
    rows = [{"from_char": int(a), "to_char": int(b), "lang": names[l], "confidence": _mean(c)} for a, b, l, c in merged]
    ordered = sorted(found, key=lambda l: (-len(found[l]), l))
    return [names[l] for l in ordered], [_mean(found[l]) for l in ordered], rows


def detect(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, label (see label_language), languages (each with a whole sentence, the most frequent first), their
    confidences and the passages of each document.

    ``docs`` has doc_id, text, lang. Null, empty and wordless texts have no language and no passage. The profiles, of
    fixed size, are broadcast; nothing is shuffled, so repeated rows and null ids stay. Extra columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept: list[Scorer] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not kept:
            kept.append(Scorer(shared.value))
        scorer = kept[0]
        for batch in (b.iloc[a : a + DOCS_AT_ONCE] for b in batches for a in range(0, len(b), DOCS_AT_ONCE)):
            spans, texts, words, ends = [], [], [], []
            for text in batch["text"]:
                shown = readable(text) if text else ""
                for a, b in passages(shown):
                    letters, n = letters_of(shown[a:b])
                    if n:
                        spans.append((a, b))
                        texts.append(letters)
                        words.append(n)
                ends.append(len(texts))
            cosines, begin, rows = scorer.cosines(texts), 0, []
            known = bool(scorer.profiles.languages and texts)
            judged = _judged(words, texts, cosines) if known else ()
            for doc_id, label, end in zip(batch["doc_id"], batch["lang"], ends):
                found = ([], [], [])
                if end > begin and known:
                    found = _settled(spans[begin:end], texts[begin:end], cosines[begin:end], *[x[begin:end] for x in judged], scorer.profiles.languages)
                rows.append((doc_id, label_language(label), *found))
                begin = end
            yield pd.DataFrame(rows, columns=["doc_id", "label", "languages", "confidences", "passages"]).astype({"label": object})

    return docs.select("doc_id", "text", "lang").mapInPandas(run, SCHEMA)


def fit_profiles(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages from at most ``sample`` labelled documents, those with the least hashes of their ids."""
    names = [n for n in NAMES]
    first = F.split(F.lower(F.trim("lang")), "[-_ (]").getItem(0)
    labelled = docs.filter(first.isin(names))
    some = hashed_share(labelled, "doc_id", sample, labelled.select("lang").count()).filter(F.length("text") >= 20)
    order = [F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), F.col("doc_id"), F.col("text")]
    rows = some.select("doc_id", "text", "lang").orderBy(*order).limit(sample).collect()
    pairs = [(r["text"], label_language(r["lang"])) for r in rows]
    return Profiles.fit([t for t, l in pairs if l in LANGUAGES], [l for _, l in pairs if l in LANGUAGES])
