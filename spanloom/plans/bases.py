"""What the queries start from: one valid row for each key, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.periods import milliseconds, sound_span
from spanloom.sources.tables import latest_by, table


def segments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The valid version of each segment."""
    return latest_by(table(spark, sf_dir, "segments"), ["source_id", "seg_idx"], list(columns))


def sound_segments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return segments(spark, sf_dir, "start", "end", *columns).filter(sound_span("start", "end"))


def candidates(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest_by(table(spark, sf_dir, "candidates"), ["cand_id"], list(columns))


def clips(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest_by(table(spark, sf_dir, "scored"), ["clip_id"], list(columns))


def in_ms(rows: DataFrame) -> DataFrame:
    return rows.withColumn("s", milliseconds("start")).withColumn("e", milliseconds("end"))


def _latest(name: str, source: str, key: str, columns: str) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in columns.split(", ") if c != "words")
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY written_at DESC NULLS LAST, {order}) AS k_ FROM {source}) WHERE k_ = 1)"


#: Not NaN is asked of the text, as statistics of the files, which know no NaN, may decide a comparison of numbers.
SOUND = "CAST(start AS VARCHAR) <> 'nan' AND CAST(\"end\" AS VARCHAR) <> 'nan' AND \"end\" > start"
SEGS = _latest("segs", "segments", "source_id, seg_idx", 'start, "end", text')
CANDS = _latest("cands", "candidates", "cand_id", 'source_id, start, "end", text')
CLIPS = _latest("clips", "scored", "clip_id", 'source_id, start, "end", text')
MS = "TRY_CAST(floor(start * 1000 + 0.5) AS BIGINT) AS s, TRY_CAST(floor(\"end\" * 1000 + 0.5) AS BIGINT) AS e"
#: Timed words of valid segments.
WORDS = SEGS + """,
flat AS (SELECT source_id, seg_idx, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS word_idx FROM segs),
spoken AS (
  SELECT source_id, seg_idx, word_idx, w.start AS w_start, w."end" AS w_end, trim(w.text, ' ') AS word FROM flat
  WHERE trim(w.text, ' ') <> '' AND w."end" > w.start AND CAST(w.start AS VARCHAR) <> 'nan' AND CAST(w."end" AS VARCHAR) <> 'nan')"""


def strip_sql(text: str) -> str:
    """Text without blanks of any kind at its ends."""
    return rf"regexp_replace({text}, '^[\t-\r\x{{85}}\p{{Z}}]+|[\t-\r\x{{85}}\p{{Z}}]+$', '', 'g')"


def islands_sql(source: str, key: str) -> str:
    """Periods of rows (key, s, e) in SQL: touching spans belong together."""
    return f"""
seen AS (SELECT {key}, s, e, max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
labelled AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen),
periods AS (SELECT {key}, island, min(s) AS from_ms, max(e) AS to_ms FROM labelled GROUP BY ALL)"""


#: Letters, marks, digits and joining signs that words are made of, as the inside of a class.
WORD_SIGNS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"
_HIDDEN = r"[\x{0610}-\x{061a}\x{064b}-\x{065f}\x{0670}\x{06d6}-\x{06ed}\x{0640}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}]"


def normal_sql(word: str) -> str:
    """A word in the form in which words are compared."""
    return f"translate(lower(regexp_replace(regexp_replace({word}, '{_HIDDEN}', '', 'g'), '[^{WORD_SIGNS}]|_', '', 'g')), 'أإآىة', 'ااايه')"


#: All forms of the listed words, in one list.
BLOCKED = rf"""cores AS (SELECT DISTINCT {normal_sql(strip_sql("split_part(entry, '#', 1)"))} AS w FROM blocklist WHERE entry IS NOT NULL),
shaped AS (
  SELECT b || w || a AS form FROM cores, (SELECT unnest(['', 'و', 'ف', 'ب', 'ل', 'ال', 'وال', 'فال', 'بال', 'لل']) AS b), (SELECT unnest(['', 'ه', 'ها', 'هم', 'ك', 'كم', 'نا', 'ي', 'يه', 'ات']) AS a) WHERE regexp_full_match(w, '[\x{{0600}}-\x{{06FF}}]+')
  UNION ALL SELECT w || a FROM cores, (SELECT unnest(['', 's', 'ing', 'ed']) AS a) WHERE w <> '' AND NOT regexp_full_match(w, '[\x{{0600}}-\x{{06FF}}]+')),
blocked AS (SELECT list(DISTINCT form) AS forms FROM shaped)"""


def masked_sql(text: str) -> str:
    """``text`` with blocked words as stars; the list stands in column forms."""
    stars = lambda x: f"regexp_replace({x}, '[{WORD_SIGNS}]', '*', 'g')"
    inner = f"list_transform(regexp_extract_all(p, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\x{{200c}}\\x{{200d}}]+|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\x{{200c}}\\x{{200d}}]+'), lambda w: CASE WHEN list_contains(forms, {normal_sql('w')}) THEN {stars('w')} ELSE w END)"
    part = f"CASE WHEN regexp_matches(p, '^[\t-\r ]') THEN p WHEN list_contains(forms, {normal_sql('p')}) THEN {stars('p')} ELSE coalesce(array_to_string({inner}, ''), '') END"
    return f"CASE WHEN {text} IS NOT NULL THEN coalesce(array_to_string(list_transform(regexp_extract_all({text}, '[\t-\r ]+|[^\t-\r ]+'), lambda p: {part}), ''), '') END"


def blocked_sql(text: str) -> str:
    """Whether ``text`` holds a blocked word; the list stands in column forms."""
    some = lambda pattern: f"len(list_filter(regexp_extract_all(coalesce({text}, ''), '{pattern}'), lambda w: list_contains(forms, {normal_sql('w')}))) > 0"
    return f"({some('[^\t-\r ]+')} OR {some('[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\x{200c}\\x{200d}]+')})"
