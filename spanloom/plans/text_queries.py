"""Queries on text: tokens and shingles, masks, corrections, fingerprints, time codes, records in text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import (
    blocked_pattern, blocklist_words, canonical_letters, contains_blocked, ends_mid_idea, escape_xml, filler_only, fingerprint, masked, normal_word, placeholder_title, shingles, srt_time, tokens, valid_title,
)
from spanloom.operators.corrections import correction_counts, corrected_segments
from spanloom.operators.match import layered_match
from spanloom.operators.periods import milliseconds, sound_span
from spanloom.operators.windows import batches
from spanloom.plans.bases import BLOCKED, CANDS, CLIPS, MS, SEGS, SOUND, blocked_sql, candidates, clips, masked_sql, normal_sql, segments, sound_segments, strip_sql
from spanloom.sources.records import docx_paragraphs, transcript_lines
from spanloom.sources.tables import table

#: Rules that glossary_corrections applies.
RULES = [("host", "presenter"), ("camera operator", "camera crew"), ("jardin", "potager"), ("المقدم", "المذيع")]


def _pattern(spark: SparkSession, sf_dir: str) -> str:
    """The pattern of the block list, a table of fixed size."""
    return blocked_pattern(blocklist_words(r["entry"] for r in table(spark, sf_dir, "blocklist").select("entry").collect()))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens("text")).alias("tokens"), F.size(shingles("text")).alias("shingles"))


def filler_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that hold nothing but hesitations."""
    return segments(spark, sf_dir, "text").filter(filler_only("text")).select("source_id", "seg_idx")


def mid_idea_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(ends_mid_idea("text")).select("doc_id")


def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and texts of clips with blocked words as stars."""
    p = _pattern(spark, sf_dir)
    return clips(spark, sf_dir, "title", "text").select("clip_id", masked("title", p).alias("title"), masked("text", p).alias("text"))


def masked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each segment, blocked ones as stars, one after the other."""
    p = _pattern(spark, sf_dir)
    words = F.transform("words", lambda w: F.coalesce(masked(w["text"], p), F.lit("")))
    return segments(spark, sf_dir, "words").filter(F.size("words") > 0).select("source_id", "seg_idx", F.array_join(words, "|").alias("masked"))


def blocked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that hold a blocked word."""
    return segments(spark, sf_dir, "text").filter(contains_blocked("text", _pattern(spark, sf_dir))).select("source_id", "seg_idx")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which titles only number a clip, and which may be shown."""
    p = _pattern(spark, sf_dir)
    return clips(spark, sf_dir, "title").select("clip_id", placeholder_title("title").alias("placeholder"), valid_title("title", p).alias("valid"))


def canonical_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each normal form of a word occurs in segments."""
    words = segments(spark, sf_dir, "text").select(F.explode(F.split(F.col("text"), "\\s+")).alias("w"))
    rows = words.select(canonical_letters(normal_word("w")).alias("word")).filter("word <> ''")
    return rows.groupBy("word").agg(F.count("*").alias("n"))


def glossary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrected_segments(segments(spark, sf_dir, "text", "words"), RULES).select("source_id", "seg_idx", "text")


def glossary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule changes a text or a word."""
    return correction_counts(segments(spark, sf_dir, "text", "words"), RULES)


def srt_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sound_segments(spark, sf_dir)
    return rows.select("source_id", "seg_idx", F.concat(srt_time(milliseconds("start")), F.lit(" --> "), srt_time(milliseconds("end"))).alias("cue"))


def stamped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the plain-text transcript, with the time of each."""
    return transcript_lines(segments(spark, sf_dir, "start", "text"), stamps=True)


def escaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript_lines(segments(spark, sf_dir, "start", "text")).select("source_id", "seg_idx", escape_xml("line").alias("xml"))


def word_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docx_paragraphs(segments(spark, sf_dir, "start", "text"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short digest of what a document is."""
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint("source", "lang", "text").alias("fingerprint"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each run in batches of 16 in order of cand_idx; an index that occurs twice counts for the lower key."""
    pool = candidates(spark, sf_dir, "run_id", "cand_idx", "start", "end").filter(sound_span("start", "end") & F.col("cand_idx").isNotNull())
    pool = pool.groupBy("run_id", "cand_idx").agg(F.min(F.struct("cand_id", "start", "end")).alias("c"))
    pool = batches(pool.select(F.col("run_id").alias("source_id"), "cand_idx", F.col("c.cand_id").alias("ordinal"), milliseconds("c.start").cast("double").alias("ms"), milliseconds("c.end").cast("double").alias("me")), ["source_id"], "cand_idx", 16)
    return pool.select("source_id", "ordinal", "batch_no", "place", (F.col("ms") / 1000).alias("c_start"), (F.col("me") / 1000).alias("c_end"))


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which layer each clip finds its candidate: clips as the answers to batches of 16 candidates of their run.

    A clip whose candidate isn't known is in no batch: it is found by its exact span or dropped.
    """
    pool = _pool(spark, sf_dir)
    entries = clips(spark, sf_dir, "run_id", "cand_id", "start", "end").filter(sound_span("start", "end"))
    entries = entries.select(F.col("run_id").alias("source_id"), "clip_id", "cand_id", (milliseconds("start") / 1000).alias("e_start"), (milliseconds("end") / 1000).alias("e_end"))
    home = pool.select("source_id", F.col("ordinal").alias("cand_id"), "batch_no")
    rows = entries.join(home, ["source_id", "cand_id"], "left").select("source_id", "batch_no", F.col("clip_id").alias("entry_no"), "e_start", "e_end", F.lit(None).cast("string").alias("echoed"))
    return layered_match(rows, pool).groupBy("method").agg(F.count("*").alias("entries"))


def echoed_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the batches whose times are made up in most runs, so that the named places and the order count.

    Each candidate is an entry of its batch. By its run's number (of the least key), times are as they are, a little
    moved, or far off; far off, places are named in one run, junk in the next, and in the last an entry is missing too.
    """
    pool = _pool(spark, sf_dir)
    kind = pool.groupBy("source_id").agg((F.min("ordinal") % 5).alias("kind"))
    rows = pool.join(kind, "source_id").filter((F.col("kind") != 4) | (F.col("place") != 0))
    moved = F.element_at(F.array(*[F.lit(x) for x in (0.0, 1.5, 1e6, 1e6, 1e6)]), (F.col("kind") + 1).cast("int"))
    named = F.when(F.col("kind") == 2, F.when(F.col("place") % 2 == 0, F.col("place").cast("string")).otherwise(F.lit("no place"))).when(F.col("kind") == 3, F.lit("99"))
    rows = rows.select("source_id", "batch_no", F.col("place").alias("entry_no"), (F.col("c_start") + moved).alias("e_start"), (F.col("c_end") + moved).alias("e_end"), named.alias("echoed"))
    return layered_match(rows, pool).select(F.col("source_id").alias("run_id"), "batch_no", "entry_no", F.col("ordinal").alias("cand_id"), "method")


QUERIES = {
    "doc_shingles": doc_tokens, "filler_segments": filler_segments, "mid_idea_docs": mid_idea_docs, "masked_text": masked_text, "masked_words": masked_words, "blocked_segments": blocked_segments, "title_gate": titles,
    "canonical_words": canonical_words, "glossary_texts": glossary_texts, "glossary_corrections": glossary_counts, "srt_times": srt_times, "stamped_lines": stamped_lines,
    "escaped_lines": escaped_lines, "word_paragraphs": word_paragraphs, "fingerprints": fingerprints, "layered_match": layered, "echoed_match": echoed_match,
}
_WORD_CHAR = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"
_CLOCK = "lpad(CAST({0} AS VARCHAR), 2, '0')"
_SRT = lambda c: "concat(" + ", ':', ".join(_CLOCK.format(x) for x in (f"({c} // 3600000)", f"({c} // 60000 % 60)", f"({c} // 1000 % 60)")) + f", ',', lpad(CAST({c} % 1000 AS VARCHAR), 3, '0'))"
_LINES = f"WITH {SEGS}, l AS (SELECT source_id, seg_idx, start, {strip_sql('text')} AS t FROM segs WHERE {strip_sql('text')} <> '')"
_TOKENS = r"list_filter(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[\x{0610}-\x{061a}\x{064b}-\x{065f}\x{0670}\x{06d6}-\x{06ed}\x{0640}]', '', 'g')), '[0-9A-Za-z\x{0600}-\x{06FF}]+'), lambda x: length(x) > 1)"
_POOL = f"""{CANDS}, pool0 AS (SELECT run_id, cand_idx, min(cand_id) AS cand_id, arg_min(start, cand_id) AS start, arg_min("end", cand_id) AS "end" FROM cands WHERE {SOUND} AND cand_idx IS NOT NULL GROUP BY ALL),
pool AS (SELECT run_id, cand_id, CAST(cand_idx // 16 AS INTEGER) AS batch_no, CAST(cand_idx % 16 AS INTEGER) AS place, s / 1000 AS c_start, e / 1000 AS c_end FROM (SELECT *, {MS} FROM pool0))"""
#: Entries (run_id, batch_no, no, e_start, e_end, echoed) through the layers.
_LAYERS = """same AS (SELECT run_id, c_start, c_end, min(cand_id) AS exact FROM pool GROUP BY ALL),
near AS (SELECT e.run_id, e.batch_no, e.no, arg_min(p.cand_id, {'d': abs(e_start - c_start) + abs(e_end - c_end), 'o': p.cand_id}) AS near FROM entries e JOIN pool p ON p.run_id = e.run_id AND p.batch_no = e.batch_no
  WHERE abs(e_start - c_start) + abs(e_end - c_end) <= 5 GROUP BY ALL),
timed AS (SELECT e.*, s.exact, n.near FROM entries e LEFT JOIN same s ON s.run_id = e.run_id AND s.c_start = e.e_start AND s.c_end = e.e_end LEFT JOIN near n ON n.run_id = e.run_id AND n.batch_no = e.batch_no AND n.no = e.no),
sent AS (SELECT run_id, batch_no, count(*) AS sent FROM pool GROUP BY ALL),
came AS (SELECT run_id, batch_no, count(*) AS came, count(coalesce(exact, near)) AS hits FROM timed GROUP BY ALL),
placed AS (SELECT t.*, CASE WHEN TRY_CAST(echoed AS DOUBLE) = floor(TRY_CAST(echoed AS DOUBLE)) AND TRY_CAST(echoed AS DOUBLE) >= 0 AND TRY_CAST(echoed AS DOUBLE) < sent THEN CAST(TRY_CAST(echoed AS DOUBLE) AS INTEGER) END AS named,
  CASE WHEN hits = 0 AND came = sent THEN no END AS own FROM timed t LEFT JOIN sent USING (run_id, batch_no) LEFT JOIN came USING (run_id, batch_no)),
found AS (SELECT p.*, a.cand_id AS at_ FROM placed p LEFT JOIN pool a ON a.run_id = p.run_id AND a.batch_no = p.batch_no AND a.place = coalesce(named, own)),
result AS (SELECT *, coalesce(exact, near, at_) AS cand_id_, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'nearest' WHEN at_ IS NOT NULL THEN CASE WHEN named IS NOT NULL THEN 'index' ELSE 'position' END ELSE 'dropped' END AS method FROM found)"""
_NOT = r"[^\x{0621}-\x{064A}\x{0660}-\x{0669}A-Za-z0-9_]"


def _rule_sql(text: str, wrong: str, right: str) -> str:
    """One rule: twice, as a sign between two hits belongs to the first only."""
    one = lambda x: f"regexp_replace({x}, '(^|{_NOT})([وفبلك]{{0,2}}){wrong}($|{_NOT})', '\\1\\2{right}\\3', 'g')"
    return one(one(text))


def _rules_sql(text: str, many: int = len(RULES)) -> str:
    for wrong, right in RULES[:many]:
        text = _rule_sql(text, wrong, right)
    return text


#: Of each rule, a letter behind the word instead of the right one shows by the length how often it was put in.
_HITS = " UNION ALL ".join(f"SELECT '{w} => {r}' AS rule, length({_rule_sql('t', w, w + 'Z')}) - length(t) AS n FROM (SELECT {_rules_sql('t', k)} AS t FROM said)" for k, (w, r) in enumerate(RULES))
SQL = {
    "masked_text": f"WITH {CLIPS}, {BLOCKED} SELECT clip_id, {masked_sql('title')} AS title, {masked_sql('text')} AS text FROM clips, blocked",
    "masked_words": f"WITH {SEGS}, {BLOCKED}, w AS (SELECT source_id, seg_idx, list_transform(words, lambda x: coalesce(x.text, '')) AS ws, forms FROM segs, blocked WHERE len(words) > 0), u AS (SELECT source_id, seg_idx, forms, unnest(ws) AS t, generate_subscripts(ws, 1) AS k FROM w)\nSELECT source_id, seg_idx, string_agg({masked_sql('t')}, '|' ORDER BY k) AS masked FROM u GROUP BY ALL",
    "blocked_segments": f"WITH {SEGS}, {BLOCKED} SELECT source_id, seg_idx FROM segs, blocked WHERE {blocked_sql('text')}",
    "title_gate": rf"""WITH {CLIPS}, {BLOCKED}, t AS (SELECT clip_id, coalesce(title, '') AS t, forms FROM clips, blocked),
p AS (SELECT *, regexp_matches(t, '(?i)^[\t-\r ]*(?:clip|part|segment|video|مقطع|كليب|جزء)[ _#:-]*[0-9٠-٩]+[\t-\r ]*$') AS placeholder, len(regexp_extract_all(t, '[^\t-\r ]+')) AS n FROM t)
SELECT clip_id, placeholder, n > 0 AND n <= 8 AND length(t) <= 100 AND NOT placeholder AND NOT {blocked_sql('t')} AND NOT regexp_matches(t, '[\n\r{{}}<>]') AS valid FROM p""",
    "canonical_words": rf"WITH {SEGS}, w AS (SELECT unnest(regexp_extract_all(text, '[^\t-\r ]+')) AS w FROM segs), n AS (SELECT {normal_sql('w')} AS word FROM w) SELECT word, count(*) AS n FROM n WHERE word <> '' GROUP BY ALL",
    "glossary_texts": f"WITH {SEGS} SELECT source_id, seg_idx, {_rules_sql('text')} AS text FROM segs",
    "glossary_corrections": f"WITH {SEGS}, said AS (SELECT text AS t FROM segs WHERE text IS NOT NULL UNION ALL SELECT w.text FROM (SELECT unnest(words) AS w FROM segs) WHERE w.text IS NOT NULL), h AS ({_HITS})\nSELECT rule, CAST(sum(n) AS BIGINT) AS hits FROM h GROUP BY rule HAVING sum(n) > 0",
    "word_paragraphs": _LINES + r""" SELECT source_id, seg_idx, '<w:p><w:pPr><w:bidi/></w:pPr><w:r><w:rPr><w:rtl/></w:rPr><w:t xml:space="preserve">' ||
  replace(replace(replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</w:t></w:r></w:p>' AS paragraph FROM l""",
    "layered_match": f"""WITH {_POOL}, {CLIPS}, entries AS (SELECT c.run_id, p.batch_no, c.clip_id AS no, c.s / 1000 AS e_start, c.e / 1000 AS e_end, NULL::VARCHAR AS echoed
  FROM (SELECT *, {MS} FROM clips WHERE {SOUND}) c LEFT JOIN pool p ON p.run_id = c.run_id AND p.cand_id = c.cand_id), {_LAYERS}
SELECT method, count(*) AS entries FROM result GROUP BY ALL""",
    "echoed_match": f"""WITH {_POOL}, kinds AS (SELECT run_id, min(cand_id) % 5 AS kind FROM pool GROUP BY ALL), entries AS (SELECT p.run_id, batch_no, place AS no, c_start + m AS e_start, c_end + m AS e_end,
  CASE WHEN kind = 2 THEN CASE WHEN place % 2 = 0 THEN CAST(place AS VARCHAR) ELSE 'no place' END WHEN kind = 3 THEN '99' END AS echoed
  FROM (SELECT *, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1.5 ELSE 1e6 END AS m FROM pool JOIN kinds USING (run_id)) p WHERE kind <> 4 OR place <> 0), {_LAYERS}
SELECT run_id, batch_no, no AS entry_no, cand_id_ AS cand_id, method FROM result""",
    "doc_shingles": f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, CAST(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) < 8 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i : i + 7], ' ')))) END AS INTEGER) AS shingles FROM t""",
    "filler_segments": f"""WITH {SEGS}, w AS (SELECT source_id, seg_idx, regexp_extract_all(lower(trim(coalesce(text, ''), ' ')), '{_WORD_CHAR}') AS words FROM segs),
f AS (SELECT *, len(words) AS n, len(list_filter(words, lambda x: x IN ('um', 'uh', 'like', 'اه', 'امم'))) AS fillers FROM w)
SELECT source_id, seg_idx FROM f WHERE n = 0 OR (n <= 3 AND fillers >= greatest(1, n - 1))""",
    "mid_idea_docs": f"""WITH t AS (SELECT doc_id, {strip_sql("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id FROM t WHERE t = '' OR (regexp_matches(t, '[.!?؟]') AND NOT regexp_matches(t, '[.!?؟…]$'))""",
    "srt_times": f"WITH {SEGS}, t AS (SELECT source_id, seg_idx, {MS} FROM segs WHERE {SOUND}) SELECT source_id, seg_idx, {_SRT('s')} || ' --> ' || {_SRT('e')} AS cue FROM t",
    "stamped_lines": _LINES + f""", s AS (SELECT *, CASE WHEN start IS NULL OR CAST(start AS VARCHAR) IN ('nan', 'inf', '-inf') OR start < 0 THEN 0 ELSE TRY_CAST(floor(start) AS BIGINT) END AS x FROM l)
SELECT source_id, seg_idx, '[' || CASE WHEN x >= 3600 THEN {_CLOCK.format('(x // 3600)')} || ':' ELSE '' END || {_CLOCK.format('(x // 60 % 60)')} || ':' || {_CLOCK.format('(x % 60)')} || '] ' || t AS line FROM s""",
    "escaped_lines": _LINES + r" SELECT source_id, seg_idx, replace(replace(replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml FROM l",
    "fingerprints": "SELECT doc_id, left(sha256(concat_ws('|', coalesce(source, ''), coalesce(lang, ''), coalesce(text, ''))), 16) AS fingerprint FROM documents",
}
