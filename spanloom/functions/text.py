"""Column expressions on text; all stay in the JVM.

Null text counts as empty unless a function says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that don't count when words are compared, and the alphabet of tokens.
DIACRITICS = "[\\u0610-\\u061a\\u064b-\\u065f\\u0670\\u06d6-\\u06ed\\u0640]"
TOKEN = "[0-9A-Za-z\\u0600-\\u06FF]+"
# Hesitations; those of several words never equal a single token.
FILLERS = ("um", "uh", "like", "you know", "i mean", "so yeah", "اه", "امم", "يعني بس", "امم يعني")
# What may stand before and after a listed Arabic word, and after a Latin one.
ARABIC_BEFORE, ARABIC_AFTER, LATIN_AFTER = "و|ف|ب|ل|ال|وال|فال|بال|لل", "ه|ها|هم|ك|كم|نا|ي|يه|ات", "s|ing|ed"
BLANK = "[\\t-\\r\\x85\\p{Z}]"
SHINGLE = 8
#: Stands between the tokens of a shingle; not part of the token alphabet.
GLUE = "\x1f"


def _some(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def stripped(text: Column) -> Column:
    """Text without blanks of any kind, line ends included, at its ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def tokens(text: Column | str) -> Column:
    """Lower-case tokens of two or more letters or digits, without diacritics; accented Latin letters split a word."""
    plain = F.lower(F.regexp_replace(_some(text), DIACRITICS, ""))
    return F.filter(F.regexp_extract_all(plain, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.length(t) > 1)


def shingles(text: Column | str, size: int = SHINGLE) -> Column:
    """Distinct runs of ``size`` tokens; of a shorter text all its tokens as one; none of a text without tokens."""

    def made(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.array_join(F.slice(t, i, size), GLUE))
        whole = F.when(F.size(t) > 0, F.array(F.array_join(t, GLUE))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(t) >= size, F.array_distinct(runs)).otherwise(whole)

    # The tokens are bound once as a lambda's argument; as an expression they would be made anew for every run.
    return F.get(F.transform(F.array(tokens(text)), made), F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """Shared shingles by the smaller set; 0 where either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def filler_only(text: Column | str) -> Column:
    """No word at all, or at most three words of which all but one are hesitations."""
    words = F.regexp_extract_all(F.lower(F.trim(_some(text))), F.lit("((?U)\\w+)"), F.lit(1))
    n = F.size(words)
    fillers = F.size(F.filter(words, lambda w: w.isin(*FILLERS)))
    return (n == 0) | ((n <= 3) & (fillers >= F.greatest(F.lit(1), n - 1)))


def ends_mid_idea(text: Column | str) -> Column:
    """Empty, or with full stops inside but none at the end."""
    t = stripped(_some(text))
    return (t == "") | (t.rlike("[.!?؟]") & ~t.rlike("[.!?؟…]$"))


def ends_sentence(text: Column | str) -> Column:
    return _some(text).rlike("[.!?؟…]\\s*$")


def normal_word(word: Column | str) -> Column:
    """A word without diacritics, invisible signs and anything but letters and digits, in lower case."""
    plain = F.regexp_replace(F.regexp_replace(_some(word), DIACRITICS, ""), "[\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f]", "")
    return F.lower(F.regexp_replace(plain, "(?U)[^\\w]|_", ""))


def canonical_letters(word: Column | str) -> Column:
    """Variants of Arabic letters as one."""
    return F.translate(_some(word), "أإآىة", "ااايه")


def _canonical(word: str) -> str:
    return word.translate(str.maketrans("أإآىة", "ااايه"))


def blocked_pattern(words) -> str:
    """Pattern that a whole canonical word must match: a listed one with the affixes of its script. Driver side."""
    cores = sorted({_canonical(re.sub(r"[^\w]|_", "", re.sub(DIACRITICS.replace("\\\\", "\\"), "", w)).lower()) for w in words if w} - {""})
    arabic = [re.escape(w) for w in cores if re.fullmatch("[؀-ۿ]+", w)]
    other = [re.escape(w) for w in cores if not re.fullmatch("[؀-ۿ]+", w)]
    parts = []
    if arabic:
        parts.append(f"(?:{ARABIC_BEFORE})?(?:{'|'.join(arabic)})(?:{ARABIC_AFTER})?")
    if other:
        parts.append(f"(?:{'|'.join(other)})(?:{LATIN_AFTER})?")
    return f"^(?:{'|'.join(parts)})$" if parts else "(?!)"


def blocklist_words(lines) -> list[str]:
    """Words of a list's raw lines: what follows # is a comment, blank lines don't count, repeats count once."""
    words = ((line or "").split("#", 1)[0].strip() for line in lines)
    return list(dict.fromkeys(w for w in words if w))


def blocked_word(word: Column | str, pattern: str) -> Column:
    return canonical_letters(normal_word(word)).rlike(pattern)


def masked(text: Column | str, pattern: str) -> Column:
    """Each letter and digit of a blocked word as *, all else as it was; null stays null.

    A run without blanks is tested as a whole first, so signs inside a word don't hide it, then each of its words.
    """
    column = F.col(text) if isinstance(text, str) else text
    stars = lambda x: F.regexp_replace(x, "(?U)\\w", "*")

    def run(part: Column) -> Column:
        inner = F.regexp_extract_all(part, F.lit("((?U)[^\\W_]+|(?U)[\\W_]+)"), F.lit(1))
        words = F.transform(inner, lambda w: F.when(blocked_word(w, pattern), stars(w)).otherwise(w))
        return F.when(part.rlike("^\\s"), part).when(blocked_word(part, pattern), stars(part)).otherwise(F.array_join(words, ""))

    parts = F.regexp_extract_all(column, F.lit("(\\s+|\\S+)"), F.lit(1))
    return F.array_join(F.transform(parts, run), "")


def contains_blocked(text: Column | str, pattern: str) -> Column:
    """Whether any run without blanks, or any word in one, is blocked."""
    t = _some(text)
    runs = F.filter(F.split(t, "\\s+"), lambda x: x != "")
    words = F.regexp_extract_all(t, F.lit("((?U)[^\\W_]+)"), F.lit(1))
    return F.exists(runs, lambda x: blocked_word(x, pattern)) | F.exists(words, lambda x: blocked_word(x, pattern))


def prompt_excerpt(text: Column | str, limit: int = 1_200, head: int = 850, tail: int = 350) -> Column:
    """A long text's beginning and end with a mark between them."""
    t = stripped(_some(text))
    cut = F.concat(F.substring(t, 1, head), F.lit(" [...] "), F.right(t, F.lit(tail)))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def placeholder_title(text: Column | str) -> Column:
    """A title that only numbers a clip."""
    return _some(text).rlike("(?i)^\\s*(?:clip|part|segment|video|مقطع|كليب|جزء)[ _#:-]*[0-9٠-٩]+\\s*$")


def valid_title(text: Column | str, pattern: str) -> Column:
    """Not blank, at most 100 code points and 8 words, no placeholder, nothing blocked, no break or brace."""
    t = _some(text)
    words = F.size(F.filter(F.split(F.trim(t), "\\s+"), lambda x: x != ""))
    return (words > 0) & (F.length(t) <= 100) & (words <= 8) & ~placeholder_title(t) & ~contains_blocked(t, pattern) & ~t.rlike("[\\n\\r{}<>]")


def escape_ass(text: Column | str) -> Column:
    t = F.replace(_some(text), F.lit("\\"), F.lit("\\\\"))
    t = F.replace(F.replace(t, F.lit("\n"), F.lit("\\N")), F.lit("{"), F.lit("\\{"))
    return F.replace(t, F.lit("}"), F.lit("\\}"))


def escape_xml(text: Column | str) -> Column:
    """Text for an XML element: characters that XML forbids are dropped."""
    t = F.regexp_replace(_some(text), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(plain), F.lit(name))
    return t


def safe_seconds(value: Column | str) -> Column:
    """A number from anything: 0 where it is null, junk, negative or not finite."""
    x = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)
    return F.when(bad, F.lit(0.0)).otherwise(x)


def clock(seconds: Column | str) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; fractions are cut off."""
    s = F.floor(safe_seconds(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    short = F.format_string("%02d:%02d", m.cast("long"), r)
    return F.when(h > 0, F.concat(F.format_string("%02d", h.cast("long")), F.lit(":"), short)).otherwise(short)


def srt_time(ms: Column | str) -> Column:
    """HH:MM:SS,mmm of whole milliseconds."""
    t = F.greatest(F.lit(0), F.col(ms) if isinstance(ms, str) else ms).cast("long")
    div = lambda x, y: F.floor(x / y).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", div(t, 3_600_000), div(F.pmod(t, F.lit(3_600_000)), 60_000), div(F.pmod(t, F.lit(60_000)), 1_000), F.pmod(t, F.lit(1_000)))


def ass_time(seconds: Column | str) -> Column:
    """H:MM:SS.cc, hundredths rounded half to even."""
    t = F.bround(F.greatest(F.lit(0.0), F.col(seconds) if isinstance(seconds, str) else seconds) * 100).cast("long")
    div = lambda x, y: F.floor(x / y).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", div(t, 360_000), div(F.pmod(t, F.lit(360_000)), 6_000), div(F.pmod(t, F.lit(6_000)), 100), F.pmod(t, F.lit(100)))


def fingerprint(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, joined by |; a null part counts as empty."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 16)


def joined_filters(*parts: Column | str) -> Column:
    """Parts joined by commas without null and blank ones; null if none is left."""
    kept = F.filter(F.array(*[F.trim(F.col(p) if isinstance(p, str) else p) for p in parts]), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, ","))


def extracted_json(text: Column | str) -> Column:
    """The JSON object in a model's answer: without code fences, else from the first brace to the last; null if none parses."""
    t = stripped(F.regexp_replace(stripped(_some(text)), "^```(json)?", ""))
    t = stripped(F.regexp_replace(t, "```$", ""))
    inner = F.regexp_extract(t, "(?s)\\{.*\\}", 0)
    good = lambda x: F.try_parse_json(x).isNotNull() & (x != "")
    return F.when(good(t), t).when(good(inner), inner)
