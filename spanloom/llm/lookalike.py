"""One consistent form for texts that look the same but are stored in different characters."""

from __future__ import annotations

import math
import unicodedata as U
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters and digits of other scripts or alphabets that look like the first of their line.
CLASSES = """
AΑА BΒВ CϹС EΕЕ HΗН IΙІӀ JЈ KΚК MΜМ NΝ OΟОՕ PΡР SЅ TΤТ XΧХ YΥУҮ ZΖ QԚ WԜ
aаɑ cсϲ dԁ eе gɡ hһ iі jј kκ lӏ nո oоοօ pрρ qԛ sѕ uսυ vνѵ wԝ xх yуү
ΓГ ΛЛ ΠП ΦФ
٠۰ ١۱ ٢۲ ٣۳ ٧۷ ٨۸ ٩۹
"""
# Fixed value: kinds of compatibility mapping that change the form of a letter but not what is read. Mappings of
# <compat> count for letters and letter numbers only, those to a raised, lowered, circled or squared form never.
FORMS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
# Fixed value: the mapping of these is <compat> although they don't look like what they map to (long s, lunate sigma).
DISTINCT = "ſẛϲϹ"
#: Characters that have no glyph of their own: all of category Cf but for the visible signs that enclose numbers, and
#: the fillers and variation selectors.
VISIBLE_CF = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
FILLERS = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

#: Cost of passing from one script to another within a word, and of a pair of letters that the corpus never has.
SWITCH, UNSEEN = 12.0, 1e-3
#: Words whose form a worker remembers; when they are more, it starts anew.
REMEMBERED = 200_000

_TWINS = {c: group for group in CLASSES.split() for c in group}
_ORDER = {c: i for group in CLASSES.split() for i, c in enumerate(group)}
_JOINS = regex.compile(r"[\p{Script=Arabic}&&\p{L}]", regex.V1)
_SCRIPT = regex.compile(r"(\p{Latin})|(\p{Greek})|(\p{Cyrillic})|(\p{Armenian})|(\p{Arabic})")
_SPLIT = regex.compile(r"[^ \n]+")


def _form(c: str) -> str:
    """The form of one character: its compatibility mapping where it looks the same, nothing where it has no glyph."""
    code = ord(c)
    if code in FILLERS or (U.category(c) == "Cf" and code not in VISIBLE_CF and c != "\u200d"):
        return ""
    if U.category(c) == "Zs" or c in "\t\v\f":
        return " "
    if c in "\u2028\u2029\x85\r":
        return "\n"
    mapping = U.decomposition(c)
    kind = mapping.split(" ", 1)[0] if mapping.startswith("<") else ""
    if kind in FORMS or (kind == "<compat>" and U.category(c) in ("Ll", "Lu", "Lt", "Lo", "Lm", "Nl") and c not in DISTINCT):
        mapped = U.normalize("NFKC", c)
        return c if " " in mapped and kind == "<compat>" else mapped
    return c


class Table(dict):
    """A table for str.translate that asks for each character once."""

    def __init__(self, form):
        super().__init__()
        self.form = form

    def __missing__(self, code: int) -> str:
        self[code] = found = self.form(chr(code))
        return found


_forms = Table(_form)


def _pictograph(c: str) -> bool:
    return U.category(c) in ("So", "Sk") or c == "\ufe0f"


def plain_forms(text: str) -> str:
    """Compatibility normalization and deletion of ignorable characters; a joiner stays within a composed pictograph."""
    if text.isascii():
        return text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ").replace("\v", " ").replace("\f", " ")
    text = text.replace("\r\n", "\n")
    if "\u200d" in text:
        n = len(text)
        text = "".join(c for i, c in enumerate(text) if c != "\u200d" or (0 < i < n - 1 and _pictograph(text[i - 1]) and _pictograph(text[i + 1])))
    text = text.translate(_forms)
    if "ی" in text or "ک" in text:
        text = _persian(text)
    return U.normalize("NFC", text)


def _persian(text: str) -> str:
    """Letters of the Persian alphabet as the Arabic ones with the same shape at that place: before a letter that
    they join they look like yeh and kaf, elsewhere yeh has no dots (and final kaf differs, so it stays)."""
    out = list(text)
    for i, c in enumerate(out):
        if c in "یک":
            j = i + 1
            while j < len(out) and U.category(out[j]) == "Mn":
                j += 1
            joined = j < len(out) and _JOINS.match(out[j]) is not None
            if c == "ی":
                out[i] = "ي" if joined else "ى"
            elif joined:
                out[i] = "ك"
    return "".join(out)


def script(c: str) -> int:
    """A number for each script of the look-alike letters; 0 for all else."""
    m = _SCRIPT.match(c)
    return m.lastindex or 0 if m else 0


def script_pairs(words: Counter) -> Counter:
    """Adjacent letters of one script, and word beginnings ("^"), in words that hold letters of one script only."""
    pairs: Counter = Counter()
    for word, n in words.items():
        letters = U.normalize("NFD", word)
        scripts = {script(c) for c in letters} - {0}
        if len(scripts) != 1:
            continue
        last = "^"
        for c in letters:
            if script(c):
                pairs[last + c] += n
                last = c
            elif not U.combining(c):
                last = "^"
    return pairs


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter = Counter()
    total: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            if text:
                words.update(_SPLIT.findall(plain_forms(text)))
        if len(words) > REMEMBERED:
            total.update(script_pairs(words))
            words.clear()
    total.update(script_pairs(words))
    yield pd.DataFrame({"pair": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})


def letter_scores(texts: DataFrame) -> dict[str, int]:
    """Counts of letter pairs by script over all of column text; at most the square of the scripts' few hundred letters."""
    counts = texts.select("text").filter(F.col("text").isNotNull()).mapInPandas(_count_pairs, "pair string, n bigint")
    return {r["pair"]: r["n"] for r in counts.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


class Speller:
    """Spells each word in the letters whose script-consistent pairs are the likeliest of all that look like it.

    A word's lattice has, at each letter, the letters of its look-alike class; the best path is found with Viterbi
    under log probabilities of letter pairs within a script and a cost for changing scripts. Words that look the same
    have the same lattice and so get the same path, whichever letters they came in; ties fall to the first letter of a
    class. Marks stay with their letter and are composed afterwards.
    """

    def __init__(self, pairs: dict[str, int]):
        self.pairs = pairs
        self.firsts: Counter = Counter()
        for pair, n in pairs.items():
            self.firsts[(pair[0], script(pair[1]))] += n
        self.scripts = Counter()
        for (first, s), n in self.firsts.items():
            if first == "^":
                self.scripts[s] += n
        self.known: dict[str, str] = {}

    def cost(self, last: str, c: str) -> float:
        s = script(c)
        n, all_ = self.pairs.get(last + c, 0), self.firsts.get((last, s), 0)
        cost = -math.log((n + UNSEEN) / (all_ + 1.0))
        if last == "^":
            cost -= math.log((self.scripts.get(s, 0) + UNSEEN) / (sum(self.scripts.values()) + 1.0))
        return cost

    def word(self, word: str) -> str:
        found = self.known.get(word)
        if found is None:
            found = self._search(word)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = found
        return found

    def _search(self, word: str) -> str:
        letters = U.normalize("NFD", word)
        if not any(c in _TWINS for c in letters):
            return U.normalize("NFC", letters)
        # paths: of each letter a path may end with, its cost and the way there
        paths: dict[str, tuple[float, int]] = {"^": (0.0, 0)}
        trail: list[dict[str, str]] = []
        for c in letters:
            choices = _TWINS.get(c, c)
            step: dict[str, tuple[float, int]] = {}
            back: dict[str, str] = {}
            for x in choices:
                s = script(x)
                best = None
                for last, (cost, at) in paths.items():
                    if not s:
                        new, state = cost, at  # a sign or mark keeps the script
                    else:
                        new = cost + (self.cost(last if at == s else "^", x)) + (SWITCH if at and at != s else 0.0)
                        state = s
                    if best is None or new < best[0] - 1e-12:
                        best = (new, state, last)
                key = x if s else x + str(best[1])
                step[key], back[key] = (best[0], best[1]), best[2]
                if not s and len(paths) > 1:  # keep one path for each script before a sign
                    for last, (cost, at) in paths.items():
                        key = x + str(at)
                        if key not in step or cost < step[key][0] - 1e-12:
                            step[key], back[key] = (cost, at), last
            paths = step
            trail.append(back)
        end = min(paths, key=lambda k: paths[k][0])
        out = []
        for back in reversed(trail):
            out.append(end[0])
            end = back[end]
        return U.normalize("NFC", "".join(reversed(out)))

    def text(self, text: str) -> str:
        """The consistent form of a whole text, without blanks at its ends."""
        return _SPLIT.sub(lambda m: self.word(m[0]), plain_forms(text)).strip(" ")


def consistent_text(texts: DataFrame, text: Column, pairs: dict[str, int]) -> Column:
    """The consistent form of ``text``; null stays null. ``pairs`` is of bounded size (see letter_scores)."""
    shared = texts.sparkSession.sparkContext.broadcast(pairs)
    kept: list[Speller] = []

    @F.pandas_udf("string")
    def form(column: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Speller(shared.value))
        spell = kept[0].text
        return pd.Series([None if t is None else spell(t) for t in column], dtype=object)

    return form(text)


def look_alike_pairs(forms: DataFrame) -> DataFrame:
    """grp, id_a, id_b (id_a < id_b) of records whose texts read the same but aren't the same characters.

    ``forms`` has grp, id, seen (digest of the consistent form) and kept (digest of the stored text), one row for each
    record. Only texts that are kept in more than one way are joined, the distinct ways first and then their records,
    so copies of one text meet only the records of other ways. Null digests take no part.
    """
    ways = forms.groupBy("grp", "seen", "kept").agg(F.count("*").alias("n"))
    many = ways.groupBy("grp", "seen").agg(F.min("kept").alias("a"), F.max("kept").alias("b")).filter("a < b").select("grp", "seen")
    ways = ways.join(many, ["grp", "seen"]).select("grp", "seen", "kept")
    side = lambda k: F.col("kept").alias(k)
    pairs = ways.select("grp", "seen", side("ka")).join(ways.select("grp", "seen", side("kb")), ["grp", "seen"]).filter("ka < kb")
    one = lambda k, i: forms.select("grp", "seen", side(k), F.col("id").alias(i))
    pairs = pairs.join(one("ka", "a"), ["grp", "seen", "ka"]).join(one("kb", "b"), ["grp", "seen", "kb"])
    return pairs.select("grp", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
