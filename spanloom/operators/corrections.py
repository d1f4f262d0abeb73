"""Rules that correct heard words: parsing them, applying them to text and words, counting what they changed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of a rule, its limits, and the letters that may stand before an Arabic word.
SEPARATORS, MOST_RULES, MOST_CHARS, HOTWORD_CHARS, PREFIXES = ("=>", "→", "="), 500, 60, 220, "وفبلك"
# Fixed value: what may not touch a corrected word.
LETTER = "\\u0621-\\u064A\\u0660-\\u0669A-Za-z0-9_"


#: One way to write a rule for each separator; the first that fits counts, whatever else stands in the line.
_FORMS = [re.compile(rf"(?P<wrong>.*?){re.escape(sign)}(?P<right>.*)") for sign in SEPARATORS]
_NO_RULE = re.compile(r"\s*(?:#.*|//.*)?")


class RuleError(ValueError):
    """Lines of the rules can't be read; the message names each of them."""


def _fault(wrong: str, right: str) -> str | None:
    if not (wrong and right):
        return "a side is empty"
    if wrong == right:
        return "both sides are the same"
    return f"a side is longer than {MOST_CHARS} characters" if len(wrong) > MOST_CHARS or len(right) > MOST_CHARS else None


def parse_rules(text: str | None) -> list[tuple[str, str]]:
    """(wrong, right) of each line that is no comment (# or //); of rules for one word the last counts.

    All lines are read before anything is raised, so one message tells all that is wrong.
    """
    rules, faults = {}, []
    for place, line in enumerate((text or "").splitlines(), 1):
        if _NO_RULE.fullmatch(line):
            continue
        form = next(filter(None, (f.fullmatch(line.strip()) for f in _FORMS)), None)
        sides = [" ".join(form[name].split()) for name in ("wrong", "right")] if form else []
        if fault := _fault(*sides) if sides else f"none of {', '.join(SEPARATORS)} in it":
            faults.append(f"line {place}: {fault}")
        else:
            rules[sides[0]] = sides[1]
    if faults:
        raise RuleError("; ".join(faults))
    return list(rules.items())[:MOST_RULES]


def hotwords(rules: list[tuple[str, str]], extra: str = "", limit: int = HOTWORD_CHARS) -> str:
    """Right sides and further terms of at most five words, as many as fit."""
    terms = [right for _, right in rules] + [" ".join(x.split()) for x in re.split(r"[,،;\n]+", extra or "")]
    kept: list[str] = []
    for term in dict.fromkeys(t for t in terms if t):
        if len(term.split()) <= 5 and len("، ".join([*kept, term])) <= limit:
            kept.append(term)
    return "، ".join(kept)


def rule_pattern(wrong: str) -> str:
    return f"(?<![{LETTER}])([{PREFIXES}]{{0,2}}){re.escape(wrong)}(?![{LETTER}])"


def corrected(text: Column, rules: list[tuple[str, str]]) -> Column:
    """``text`` after each rule in order, whole words only; up to two Arabic prefix letters stay."""
    for wrong, right in rules:
        text = F.regexp_replace(text, rule_pattern(wrong), "$1" + right.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def _hits(text: Column, rules: list[tuple[str, str]]) -> Column:
    """How often each rule changes ``text``, after the rules before it."""
    counts = []
    for wrong, right in rules:
        counts.append(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rule_pattern(wrong)), F.lit(0))))
        text = corrected(text, [(wrong, right)])
    return F.array(*counts)


def corrected_segments(segments: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Segments with text and every word corrected."""
    words = F.transform("words", lambda w: w.withField("text", corrected(w["text"], rules)))
    return segments.withColumn("text", corrected(F.col("text"), rules)).withColumn("words", words)


def correction_counts(segments: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rule, hits: how often each rule changed a text or a word (both count), for rules that did."""
    add = lambda acc, w: F.zip_with(acc, _hits(w["text"], rules), lambda a, b: a + b)
    none = F.array(*[F.lit(0) for _ in rules])
    words = F.aggregate(F.coalesce("words", F.array().cast(segments.schema["words"].dataType)), none, add)
    both = F.zip_with(_hits(F.col("text"), rules), words, lambda a, b: a + b)
    rows = segments.select(F.posexplode(both).alias("rule_no", "n")).groupBy("rule_no").agg(F.sum("n").alias("hits")).filter("hits > 0")
    names = F.array(*[F.lit(f"{a} => {b}") for a, b in rules])
    return rows.select(F.get(names, F.col("rule_no")).alias("rule"), "hits")
