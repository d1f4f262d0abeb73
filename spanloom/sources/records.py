"""Records of transcripts, candidates, scores and results: schemas, tolerant scans, and text sinks.

Scans read text first and cast field by field, so "7" counts as 7.0, extra keys are ignored, and a record without the
fields it needs is dropped (and can be counted) instead of failing the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import ass_time, clock, escape_ass, escape_xml, extracted_json, safe_seconds, srt_time, stripped

WORD = "struct<start: double, end: double, text: string>"
SEGMENT = f"source_id string, seg_idx int, start double, end double, text string, words array<{WORD}>"
CANDIDATE = "source_id string, ordinal int, start double, end double, text string, segment_indices array<int>, source string, context_before string, context_after string"
SUBSCORES = ("hook_score", "content_score", "story_score", "emotion_score", "standalone_score", "ending_score")
SCORED = "source_id string, ordinal int, start double, end double, score double, " + ", ".join(f"{c} double" for c in SUBSCORES) + ", reason string, text string, title string"
FINAL = "source_id string, index int, start double, end double, duration double, score double, reason string, text string, title string, output_path string"

_LOOSE_WORD = "struct<start: string, end: string, text: string>"
_LOOSE = {
    "segments": f"array<struct<start: string, end: string, text: string, words: array<{_LOOSE_WORD}>>>",
    "candidates": "array<struct<start: string, end: string, text: string, segment_indices: array<int>, source: string, context_before: string, context_after: string>>",
    "clips": "array<struct<start: string, end: string, score: string, " + ", ".join(f"{c}: string" for c in SUBSCORES) + ", reason: string, text: string, title: string>>",
    "finals": "array<struct<index: string, start: string, end: string, score: string, reason: string, text: string, title: string, output_path: string>>",
}


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """source_id (the file's name without ending) and text of each JSON document; one file is one source."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    return rows.select(F.regexp_replace("f", "\\.[^.]*$", "").alias("source_id"), "value")


def _number(name: str) -> Column:
    return F.col(f"r.{name}").try_cast("double")


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(f"r.{name}"), F.lit(default)).alias(name)


def _items(spark: SparkSession, path: str, kind: str, field: str | None) -> DataFrame:
    docs = _documents(spark, path)
    if field:
        parsed = F.from_json("value", f"struct<{field}: {_LOOSE[kind]}>")[field]
    else:
        parsed = F.from_json("value", _LOOSE[kind])
    rows = docs.select("source_id", F.posexplode(parsed).alias("ordinal", "r"))
    return rows.withColumn("start", _number("start")).withColumn("end", _number("end")).filter("start IS NOT NULL AND end IS NOT NULL")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Segments of JSON arrays, one file for each source."""
    words = F.transform(F.coalesce("r.words", F.array().cast(f"array<{_LOOSE_WORD}>")), lambda w: F.struct(w["start"].try_cast("double").alias("start"), w["end"].try_cast("double").alias("end"), F.coalesce(w["text"], F.lit("")).alias("text")))
    return _items(spark, path, "segments", None).select("source_id", F.col("ordinal").alias("seg_idx"), "start", "end", _text("text"), words.alias("words"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    indices = F.coalesce("r.segment_indices", F.array().cast("array<int>")).alias("segment_indices")
    return _items(spark, path, "candidates", None).select("source_id", "ordinal", "start", "end", _text("text"), indices, _text("source", "window"), _text("context_before"), _text("context_after"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Clips of {"clips": [...]} documents."""
    scores = [F.coalesce(_number(c), F.lit(0.0)).alias(c) for c in ("score", *SUBSCORES)]
    return _items(spark, path, "clips", "clips").select("source_id", "ordinal", "start", "end", *scores, _text("reason"), _text("text"), _text("title"))


def read_finals(spark: SparkSession, path: str) -> DataFrame:
    """Hand-edited results: an index where there is none is the place in the list."""
    rows = _items(spark, path, "finals", None)
    index = F.coalesce(F.col("r.index").try_cast("int"), F.col("ordinal") + 1).alias("index")
    return rows.select("source_id", index, "start", "end", (F.col("end") - F.col("start")).alias("duration"), F.coalesce(_number("score"), F.lit(0.0)).alias("score"), _text("reason"), _text("text"), _text("title"), F.col("r.output_path").alias("output_path"))


def write_json(rows: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines; Spark's committer makes the output appear at once."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def media_files(spark: SparkSession, folder: str, endings: tuple[str, ...]) -> DataFrame:
    """path, length, modified of the files of a folder with one of ``endings``; contents aren't read."""
    rows = spark.read.format("binaryFile").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return rows.filter(F.lower(F.regexp_extract("path", "(\\.[^./]*)$", 1)).isin(*endings)).orderBy("path")


def batch_targets(spark: SparkSession, file: str | None = None, folder: str | None = None, endings: tuple[str, ...] = (".mp4", ".mkv", ".mov", ".avi", ".webm")) -> list[str]:
    """The media files of a run: one that is named, or all of a folder in order of their paths. Names only are read.

    Raises ValueError where both or neither are named, where nothing is there, and for files of another ending.
    """
    if (file is None) == (folder is None):
        raise ValueError("name either a file or a folder")
    from pyspark.errors import AnalysisException

    try:
        found = [r["path"] for r in spark.read.format("binaryFile").load(file or folder).select("path").collect()]
    except AnalysisException as e:
        raise ValueError(f"nothing at {file or folder}") from e
    fit = sorted(p for p in found if p.lower().endswith(endings))
    if not fit:
        raise ValueError(f"no file with one of {', '.join(endings)} at {file or folder}")
    return fit


def write_lines(rows: DataFrame, path: str, key: str, order: list[str], line: str, head: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """One text for each ``key``: the ``head`` and column ``line`` in order of ``order``, in folders key=... of ``path``.

    The lines of a key are written by one task as they come, sorted outside its memory; nothing is collected.
    """
    first = rows.select(key).distinct().select(key, F.lit(0).alias("_part"), F.posexplode(F.array(*[F.lit(h) for h in head])).alias("_no", "_line")) if head else None
    place = F.struct(*order)
    body = rows.select(key, F.lit(1).alias("_part"), F.lit(0).alias("_no"), F.col(line).alias("_line"), place.alias("_o"))
    both = body if first is None else body.unionByName(first.withColumn("_o", F.lit(None).cast(body.schema["_o"].dataType)))
    both.repartition(key).sortWithinPartitions(key, "_part", "_no", "_o").select(key, F.col("_line").alias("value")).write.mode(mode).partitionBy(key).text(path)


#: Begins a file of styled captions; fixed values of the format, with one style for captions.
ASS_HEAD = (
    "[Script Info]", "ScriptType: v4.00+", "PlayResX: {width}", "PlayResY: {height}", "", "[V4+ Styles]",
    "Format: Name, Fontname, Fontsize, PrimaryColour, Bold, BorderStyle, Outline, Alignment, MarginL, MarginR, MarginV",
    "Style: Caption,Arial,{size},&H00FFFFFF,-1,1,3,2,40,40,{margin}", "", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
)


def ass_head(width: int, height: int) -> tuple[str, ...]:
    """The head for frames of a size: letters of 4.5 % of the height, 12 % above its lower edge."""
    values = {"width": width, "height": height, "size": max(18, int(height * 0.045)), "margin": int(height * 0.12)}
    return tuple(line.format(**values) for line in ASS_HEAD)


def parsed_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Entries of a model's answers ({"clips": [...]} in whatever wrapping), one row each, with entry_no and numbers cast.

    Answers that hold no such object have no entry; an entry without start or end is kept, with nulls, to be counted.
    """
    entry = "struct<i: string, start: string, end: string, score: string, " + ", ".join(f"{c}: string" for c in SUBSCORES) + ", reason: string, title: string>"
    others = [c for c in answers.columns if c != answer]
    clips = F.from_json(extracted_json(answer), f"struct<clips: array<{entry}>>")["clips"]
    rows = answers.select(*others, F.posexplode(clips).alias("entry_no", "r"))
    return rows.select(*others, "entry_no", F.col("r.i").alias("echoed"), _number("start").alias("e_start"), _number("end").alias("e_end"), _number("score").alias("score"), *[_number(c).alias(c) for c in SUBSCORES], F.col("r.reason").alias("reason"), F.col("r.title").alias("title"))


def valid_proposals(answers: DataFrame, segments: DataFrame, shortest: float, longest: float, most: int = 12) -> DataFrame:
    """source_id, first_idx, last_idx, start, end of a model's proposals that name whole segments of their excerpt.

    ``answers``: source_id, first, last (exclusive), answer ({"clips": [{"start_segment": int, "end_segment": int}]}).
    Only the first ``most`` of an answer count; a number with a fraction, in quotes or a boolean is none; the length
    must be from max(3, half of shortest) to 1.5 x longest. The same pair counts once.
    """
    raw = F.from_json(extracted_json("answer"), "struct<clips: array<string>>")["clips"]
    rows = answers.select("source_id", "first", "last", F.explode(F.slice(raw, 1, most)).alias("j"))
    whole = lambda name: F.regexp_extract("j", f'"{name}"\\s*:\\s*(-?\\d+)\\s*[,}}]', 1).try_cast("int")
    rows = rows.select("source_id", "first", "last", whole("start_segment").alias("first_idx"), whole("end_segment").alias("last_idx"))
    rows = rows.filter("first <= first_idx AND first_idx <= last_idx AND last_idx < last").select("source_id", "first_idx", "last_idx").distinct()
    a = segments.select("source_id", F.col("seg_idx").alias("first_idx"), "start")
    b = segments.select("source_id", F.col("seg_idx").alias("last_idx"), "end")
    length = F.col("end") - F.col("start")
    return rows.join(a, ["source_id", "first_idx"]).join(b, ["source_id", "last_idx"]).filter((length >= max(3.0, shortest * 0.5)) & (length <= longest * 1.5))


def transcript_lines(segments: DataFrame, stamps: bool = False) -> DataFrame:
    """source_id, seg_idx, line of segments that aren't blank, with [MM:SS] before them if asked for."""
    rows = segments.withColumn("_t", stripped(F.coalesce("text", F.lit("")))).filter("_t <> ''")
    line = F.concat(F.lit("["), clock("start"), F.lit("] "), F.col("_t")) if stamps else F.col("_t")
    return rows.select("source_id", "seg_idx", line.alias("line"))


def srt_cues(captions: DataFrame) -> DataFrame:
    """source_id, caption_no, cue: captions (start, end, text; caption_no from 0) as numbered cues."""
    ms = lambda c: F.bround(safe_seconds(c) * 1000).cast("long")
    cue = F.concat((F.col("caption_no") + 1).cast("string"), F.lit("\n"), srt_time(ms("start")), F.lit(" --> "), srt_time(ms("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return captions.select("source_id", "caption_no", cue.alias("cue"))


def ass_events(captions: DataFrame) -> DataFrame:
    """clip_id, caption_no, event: captions (start, end, text, clip_start, clip_end) in the clip's own time, a tenth of a second at least."""
    start = F.greatest(F.lit(0.0), F.col("start") - F.col("clip_start"))
    end = F.least(F.col("clip_end") - F.col("clip_start"), F.greatest(start + 0.1, F.col("end") - F.col("clip_start")))
    event = F.concat(F.lit("Dialogue: 0,"), ass_time(start), F.lit(","), ass_time(end), F.lit(",Caption,,0,0,0,,"), escape_ass("text"))
    return captions.filter(end > start).select("clip_id", "caption_no", event.alias("event"))


def docx_paragraphs(segments: DataFrame) -> DataFrame:
    """source_id, seg_idx, paragraph: lines as right-to-left paragraphs of a word-processing document."""
    p = F.concat(F.lit('<w:p><w:pPr><w:bidi/></w:pPr><w:r><w:rPr><w:rtl/></w:rPr><w:t xml:space="preserve">'), escape_xml("line"), F.lit("</w:t></w:r></w:p>"))
    return transcript_lines(segments).select("source_id", "seg_idx", p.alias("paragraph"))
