"""Queries on numbers of frames, sound, files, addresses and runs, for which columns of the tables stand in.

There are no tables of frames or addresses; each query says which columns it takes for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.planning import crop, light_correction
from spanloom.functions.text import ass_time, containment, escape_ass, extracted_json, joined_filters, safe_seconds, shingles, srt_time
from spanloom.functions.urls import PLATFORMS, needs_sign_in, normal_url, platform, single_video, stream_plan
from spanloom.operators.corrections import hotwords, parse_rules
from spanloom.operators.frames import face_in_person, holds_box, loudness, luma_stats, median_faces, two_largest
from spanloom.operators.match import distinct_names, edit_faults, edited_segments
from spanloom.operators.periods import sound_span
from spanloom.operators.queue import expired, slice_findings, stalled, verdict
from spanloom.operators.review import before_failures, unsure_languages
from spanloom.operators.select import accepted, dropped, finals, reject_counts, shortfall
from spanloom.operators.tracking import followed, smoothed
from spanloom.operators.windows import batches
from spanloom.plans.bases import CANDS, CLIPS, SEGS, SOUND, candidates, clips, segments
from spanloom.sources.records import srt_cues
from spanloom.sources.tables import table

HOSTS = ("www.YouTube.com", "youtu.be", "m.facebook.com", "fb.watch", "x.com", "notx.com", "vm.tiktok.com", "instagram.com:443", "example.org", "user@example.org", "", "files.example.org")
ENDS = ("/watch?v=1#t=5", "/clip.MP4", "/a/b.mkv?q=1", "", "/page.html", "/talk.mp3#x")
#: Descriptions of streams, one for each remainder of a key.
STREAMS = (
    '{"url": "u1", "acodec": "mp4a"}', '{"requested_formats": [{"url": "v", "vcodec": "h264", "acodec": "none"}, {"url": "a", "vcodec": "none", "acodec": "opus"}]}',
    '{"_type": "playlist", "entries": [null, {"url": "u2", "acodec": "none"}]}', '{"entries": []}', '{"url": "u3", "is_live": true, "age_limit": 18}', 'no json',
)
_MODES = (("http", True), ("mux", True), ("http", False), (None, False), ("http", False), (None, False))
_SINGLE = (True, True, False, True, False, False)
ANSWERS = ('{"clips": []}', '```json\n{"clips": [1]}\n```', 'Sure: {"a": {"b": 2}} done', "none", "", "{broken")


def _pick(values: tuple, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, platform and need of a sign-in of addresses made of hosts and endings."""
    d = F.col("doc_id")
    url = F.concat(F.when(d % 7 == 0, F.lit("HTTPS://")).when(d % 11 == 0, F.lit("ftp://")).otherwise(F.lit("http://")), _pick(HOSTS, d), _pick(ENDS, d))
    rows = _docs(spark, sf_dir).withColumn("url", url)
    return rows.select("doc_id", normal_url("url").alias("normal"), platform("url").alias("platform"), needs_sign_in(platform("url")).alias("sign_in"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the streams of a few kinds of descriptions are played, and which are of one open video."""
    plan = stream_plan(_pick(STREAMS, F.col("doc_id")))
    return _docs(spark, sf_dir).select("doc_id", plan["mode"].alias("mode"), plan["has_audio"].alias("sound"), single_video(_pick(STREAMS, F.col("doc_id"))).alias("single"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON objects in answers of a few kinds."""
    return _docs(spark, sf_dir).select("doc_id", extracted_json(_pick(ANSWERS, F.col("doc_id"))).alias("json"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of their user's clip: a value's hundredths give the luma."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return rows.filter("v IS NOT NULL").withColumn("yavg", (F.col("v") % 256).cast("double"))


def light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma of each clip, and the correction that it needs."""
    rows = _frames(spark, sf_dir).select("user_id", "yavg", F.least(F.col("yavg"), F.col("v") % 40).cast("double").alias("ymin"), F.greatest(F.col("yavg"), F.col("v") % 250).cast("double").alias("ymax"), F.lit(128.0).alias("uavg"), F.lit(127.0).alias("vavg"))
    stats = light_correction(luma_stats(rows, ["user_id"]))
    return stats.select("user_id", "samples", F.round("avg", 6).alias("avg"), F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), F.round("gamma", 6).alias("gamma"), F.round("contrast", 6).alias("contrast"), F.round("brightness", 6).alias("brightness"), "kind")


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of the face centres of a clip."""
    return median_faces(_frames(spark, sf_dir).withColumn("center", F.col("v") % 1000 / 1000), ["user_id"]).select("user_id", F.round("center", 9).alias("center"))


def sound_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudness of windows of ten samples."""
    rows = _frames(spark, sf_dir).withColumn("time", F.col("event_id").cast("double")).withColumn("value", F.col("yavg") - 128)
    return loudness(rows, ["user_id"], 1_000.0).select("user_id", "window_no", F.round("rms", 6).alias("rms"))


def _box(n: Column, shift: int) -> Column:
    return F.struct((n % 97 + shift).cast("double").alias("x"), (n % 41).cast("double").alias("y"), (n % 13 + 1 + shift).cast("double").alias("w"), (n % 17 + 1).cast("double").alias("h"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three boxes the two largest from left to right, whether the first holds the third, and whether its centre lies in the others."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.array(_box(n, 3), _box(n * 7, 1), _box(n * 3, 2)).alias("b"))
    two = two_largest(F.col("b"))
    return rows.select("event_id", two[0]["x"].alias("left_x"), two[1]["x"].alias("right_x"), holds_box(F.col("b")[0], F.col("b")[2]).alias("holds"), face_in_person(F.col("b")[0], F.slice("b", 2, 2)).alias("within"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upright rectangles of frames whose sizes are numbers of parts."""
    k = F.col("p_partkey")
    c = crop(k % 1900 + 100, k % 1000 + 80, (k % 13) / 10, F.lit(1.0) + k % 3)
    return table(spark, sf_dir, "part").select("p_partkey", c["left"].alias("left"), c["top"].alias("top"), c["width"].alias("width"), c["height"].alias("height"))


def seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds and times from what may be no number, and filters joined."""
    d = F.col("doc_id")
    raw = _pick(("7", "-1", "nan", "1e3", "x", "", "inf", "59.999"), d)
    s = safe_seconds(raw)
    return _docs(spark, sf_dir).select("doc_id", s.alias("seconds"), ass_time(s).alias("ass"), srt_time((s * 1000).cast("bigint")).alias("srt"), joined_filters(_pick((" a ", "", "b"), d), _pick((None, "c"), d), F.lit(" ")).alias("filters"), escape_ass(_pick(("a{b}", "c\\d", "e\nf"), d)).alias("escaped"))


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line of the block list: what it would mean as a rule for heard words."""
    rules = parse_rules("\n".join(f"{r['entry'].strip()} => {r['entry'].strip()}!" for r in table(spark, sf_dir, "blocklist").select("line_no", "entry").filter("entry NOT LIKE '%#%' AND trim(entry) <> ''").orderBy("line_no").collect()))
    return spark.createDataFrame([(a, b, len(hotwords(rules).split("، "))) for a, b in rules], "wrong string, right string, terms int")


def smooth_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential averages of the frames' luma."""
    rows = _frames(spark, sf_dir).select("user_id", F.col("event_id").alias("place"), F.col("yavg").alias("value"))
    return smoothed(rows, ["user_id"], "user_id bigint").select("user_id", "place", F.round("smooth", 6).alias("smooth"))


def follow_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera that follows a target across a frame of 256."""
    rows = _frames(spark, sf_dir).select("user_id", F.col("event_id").alias("place"), F.col("yavg").alias("value"))
    return followed(rows, ["user_id"], "user_id bigint", 80.0, 256.0, 0.25, 4.0, 16.0).select("user_id", "place", F.round("center", 6).alias("center"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each source: loud events are findings, sources with any event of type 'error' have no sound."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), (F.col("event_id") % 5_000).cast("double").alias("time"), (F.col("event_id") * 37 % 101).cast("double").alias("score"), "event_type")
    found = slice_findings(rows, "loud", 97.0, 500.0)
    scanned = rows.groupBy("source_id").agg((F.count_if(F.col("event_type") == "error") == 0).alias("has_audio"))
    return verdict(found, scanned)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first loud event of each slice."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), (F.col("event_id") % 5_000).cast("double").alias("time"), (F.col("event_id") * 37 % 101).cast("double").alias("score"))
    return slice_findings(rows, "loud", 97.0, 500.0)


def dead_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running items that were not heard of for a day, and items that may be forgotten, by a clock of their own."""
    rows = table(spark, sf_dir, "queue_items").dropDuplicates(["id"])
    now = 1_740_900_000.0
    late = stalled(rows.withColumn("heartbeat", F.when(F.col("folder").isNotNull(), F.col("added"))), now, 86_400.0).select("id", F.lit("stalled").alias("what"))
    return late.unionByName(expired(rows.withColumn("touched", F.coalesce("finished", "added")), now).select("id", F.lit("expired").alias("what")))


def stopped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each run, as the answers to its chunks, up to two failures in a row; null texts are failures, and every fourth key."""
    rows = candidates(spark, sf_dir, "run_id", "cand_idx", "text").filter("cand_idx IS NOT NULL").groupBy("run_id", "cand_idx").agg(F.max(F.col("text").isNotNull() & (F.col("cand_id") % 4 != 0)).alias("ok"))
    return before_failures(rows.withColumnsRenamed({"run_id": "source_id", "cand_idx": "chunk_no"})).select(F.col("source_id").alias("run_id"), F.col("chunk_no").alias("cand_idx"), "ok")


def unsure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label whose made-up probability is under 0.6."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.trim("lang"), F.lit("")).alias("asked"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 10 / 10).alias("probability"))
    return unsure_languages(rows).select("doc_id")


def rejected_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted clips that are not among the three best of their source."""
    rows = accepted(clips(spark, sf_dir, "source_id", "start", "end", "score", "text").filter(sound_span("start", "end")).withColumn("ordinal", F.col("clip_id")))
    return dropped(rows, finals(rows, 3), ["source_id", "ordinal"]).select("clip_id")


def shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why sources have fewer than eight accepted clips."""
    rows = clips(spark, sf_dir, "source_id", "start", "end", "score", "text")
    counts = reject_counts(rows, ["source_id"])
    wide = counts.groupBy("source_id").agg(*[F.sum(F.when(F.col("reason") == r, F.col("clips"))).alias(r if r != "accepted" else "final") for r in ("accepted", "below_threshold", "filler", "too_short", "invalid_span")])
    return shortfall(wide.withColumn("requested", F.lit(8)))


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run: its batches of four candidates, and how many are in each."""
    rows = candidates(spark, sf_dir, "run_id", "cand_idx").filter("cand_idx IS NOT NULL").select("run_id", "cand_idx").distinct()
    return batches(rows, ["run_id"], "cand_idx", 4).groupBy("run_id", "batch_no").agg(F.count("*").alias("candidates"), F.max("place").alias("last_place"))


def alike_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of clips of one source of which one holds half of the other's runs of eight tokens, or more.

    Clips meet by a run that both have; the share is taken from the sizes and the number of runs they meet by.
    """
    from spanloom.operators.select import alike_pairs

    rows = clips(spark, sf_dir, "source_id", "text").filter(F.col("source_id").isNotNull())
    return alike_pairs(rows.withColumnRenamed("clip_id", "ordinal"), ["source_id"], 0.5).select("source_id", F.col("a").alias("clip_a"), F.col("b").alias("clip_b"), "shared")


def context_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a candidate's text the text after it repeats."""
    rows = candidates(spark, sf_dir, "text", "context_after")
    return rows.select("cand_id", F.round(containment(shingles("text"), shingles("context_after")), 6).alias("share"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments after edits of every seventh one's text and every fifth one's end; an edited segment has no words."""
    rows = segments(spark, sf_dir, "start", "end", "text", "words").filter(sound_span("start", "end"))
    i = F.col("seg_idx")
    changed = rows.filter((i % 7 == 0) | (i % 5 == 0)).select("source_id", "seg_idx", "start", F.when(i % 5 == 0, F.col("end") + 1).otherwise(F.col("end")).alias("end"), F.when(i % 7 == 0, F.concat(F.lit("* "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
    return edited_segments(rows, changed).select("source_id", "seg_idx", "start", "end", "text", F.coalesce(F.size("words"), F.lit(0)).alias("words"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of each source as numbered cues."""
    from spanloom.plans.candidate_queries import captions

    return srt_cues(captions(spark, sf_dir))


def edit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, taken as edits, that are out of order or out of a source's time, which here ends where most segments do."""
    rows = segments(spark, sf_dir, "start", "end")
    ends = rows.groupBy("source_id").agg(F.percentile(F.when(~F.isnan("end"), F.col("end")), F.lit(0.95)).alias("duration"))
    return edit_faults(rows.withColumn("start", F.when(F.col("seg_idx") % 11 == 0, F.col("start") - 30).otherwise(F.col("start"))), ends)


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in an archive of the sources' files: the first of a name keeps it."""
    rows = table(spark, sf_dir, "queue_items").dropDuplicates(["id"])
    rows = rows.select("id", F.lower(F.regexp_extract("source", r"(\.[^./]*)$", 1)).alias("name"))
    return distinct_names(rows, [], "id", "name").select("id", "entry_name")


QUERIES = {
    "addresses": addresses, "streams": streams, "answers": answers, "light": light, "median_faces": medians, "sound_levels": sound_levels, "boxes": boxes, "crops": crops, "seconds": seconds,
    "glossary_rules": glossary, "smooth_frames": smooth_frames, "follow_frames": follow_frames, "verdicts": verdicts, "findings": findings, "dead_jobs": dead_jobs, "stopped_chunks": stopped_chunks,
    "unsure_languages": unsure, "rejected_clips": rejected_clips, "request_batches": request_batches, "shortfalls": shortfalls, "alike_clips": alike_clips, "context_shares": context_shares, "edited_segments": edits, "file_names": file_names, "srt_cues": cues, "edit_checks": edit_checks,
}


def _quoted(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


def _choice(values: tuple, number: str = "doc_id") -> str:
    return "(CASE " + f"{number} % {len(values)} " + " ".join(f"WHEN {k} THEN {_quoted(v)}" for k, v in enumerate(values)) + " END)"


_HOST = " ".join(f"WHEN host = '{h}' OR ends_with(host, '.{h}') THEN '{name}'" for name, hosts in PLATFORMS.items() for h in hosts)
_FRAMES = "frames AS (SELECT event_id, user_id, v, CAST(v % 256 AS DOUBLE) AS yavg FROM (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE value IS NOT NULL))"
_BOX = lambda n, shift: f"{{'x': CAST({n} % 97 + {shift} AS DOUBLE), 'y': CAST({n} % 41 AS DOUBLE), 'w': CAST({n} % 13 + 1 + {shift} AS DOUBLE), 'h': CAST({n} % 17 + 1 AS DOUBLE)}}"
_IN = "cx >= p.x - p.w * 0.05::DOUBLE AND cx <= p.x + p.w * 1.05::DOUBLE AND cy >= p.y - p.h * 0.05::DOUBLE AND cy <= p.y + p.h * 1.05::DOUBLE"
_LOUD = "loud AS (SELECT CAST(user_id AS VARCHAR) AS source_id, CAST(event_id % 5000 AS DOUBLE) AS time, CAST(event_id * 37 % 101 AS DOUBLE) AS score, event_type FROM events)"
_FOUND = "found AS (SELECT source_id, 'loud' AS kind, b.t AS time, b.s AS score FROM (SELECT source_id, floor(time / 500) AS k, min({'t': time, 's': score}) AS b FROM loud WHERE score >= 97 GROUP BY ALL))"
_EQ = "least(1::DOUBLE, greatest(0::DOUBLE, contrast * (m - 0.5::DOUBLE) + 0.5::DOUBLE + {b}))"
_GAMMA = "least(1.8::DOUBLE, greatest(0.45::DOUBLE, ln(least(1::DOUBLE, greatest(0.0001::DOUBLE, contrast * (m - 0.5::DOUBLE) + 0.5::DOUBLE + {b}))) / ln(118 / 255::DOUBLE)))"
SQL = {
    "addresses": f"""WITH u AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'HTTPS://' WHEN doc_id % 11 = 0 THEN 'ftp://' ELSE 'http://' END || {_choice(HOSTS)} || {_choice(ENDS)} AS url FROM documents),
p AS (SELECT doc_id, lower(split_part(url, '://', 1)) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS auth, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS rest FROM u),
n AS (SELECT *, CASE WHEN scheme IN ('http', 'https') AND auth <> '' AND NOT contains(auth, '@') THEN scheme || '://' || auth || rest END AS normal, lower(regexp_replace(auth, ':[0-9]*$', '')) AS host FROM p),
q AS (SELECT doc_id, normal, CASE WHEN normal IS NULL THEN 'other' {_HOST} WHEN regexp_matches(lower(split_part(rest, '?', 1)), '\\.(mp4|webm|mkv|mov|m4v|m4a|mp3)$') THEN 'direct' ELSE 'other' END AS platform FROM n)
SELECT doc_id, normal, platform, platform IN ('facebook', 'x', 'instagram') AS sign_in FROM q""",
    "streams": f"SELECT doc_id, {_choice(tuple(m for m, _ in _MODES))} AS mode, {_choice(tuple(s for _, s in _MODES))} AS sound, {_choice(_SINGLE)} AS single FROM documents",
    "answers": f"SELECT doc_id, {_choice((ANSWERS[0], '{\"clips\": [1]}', '{\"a\": {\"b\": 2}}', None, None, None))} AS json FROM documents",
    "light": f"""WITH {_FRAMES}, s AS (SELECT user_id, count(*) AS samples, avg(yavg) AS avg, avg(least(yavg, v % 40)) AS min, avg(greatest(yavg, v % 250)) AS max FROM frames GROUP BY ALL),
a AS (SELECT *, avg / 255 AS m, CASE WHEN avg < 118 AND (max - min) / 255 < 0.25 THEN least(1.2::DOUBLE, 1 + (0.25::DOUBLE - (max - min) / 255) * 0.6::DOUBLE) ELSE 1::DOUBLE END AS contrast FROM s),
b AS (SELECT *, 255 * pow({_EQ.format(b='0::DOUBLE')}, 1 / {_GAMMA.format(b='0::DOUBLE')}) AS first FROM a),
c AS (SELECT *, CASE WHEN avg < 118 AND first < 116 AND max < 230 THEN least(0.08::DOUBLE, greatest(0::DOUBLE, (118 - first) / 255 * 0.5::DOUBLE)) ELSE 0::DOUBLE END AS lift FROM b),
g AS (SELECT *, {_GAMMA.format(b='lift')} AS gam FROM c), f AS (SELECT *, abs(avg - 118) > 6 AND avg > 1 AND NOT (abs(gam - 1) < 0.001 AND abs(contrast - 1) < 0.001 AND lift <= 0.0001) AS needs FROM g)
SELECT user_id, samples, round(avg, 6) AS avg, round(min, 6) AS min, round(max, 6) AS max, CASE WHEN needs THEN round(gam, 6) END AS gamma, CASE WHEN needs THEN round(contrast, 6) END AS contrast, CASE WHEN needs THEN round(lift, 6) END AS brightness,
  CASE WHEN needs THEN CASE WHEN avg < 118 THEN 'dark' ELSE 'over-bright' END END AS kind FROM f""",
    "median_faces": f"WITH {_FRAMES} SELECT user_id, round(median(v % 1000 / 1000::DOUBLE), 9) AS center FROM frames GROUP BY ALL",
    "sound_levels": f"WITH {_FRAMES} SELECT user_id, CAST(event_id // 1000 AS INTEGER) AS window_no, round(sqrt(avg((yavg - 128) * (yavg - 128))), 6) AS rms FROM frames GROUP BY ALL",
    "boxes": f"""WITH e AS (SELECT event_id, [{_BOX('event_id', 3)}, {_BOX('(event_id * 7)', 1)}, {_BOX('(event_id * 3)', 2)}] AS b FROM events),
r AS (SELECT event_id, b, list_transform(list_sort(list_transform(range(1, 4), lambda i: {{'a': -(b[i].w * b[i].h), 'i': i}})), lambda y: y.i) AS o, b[1].x + b[1].w / 2 AS cx, b[1].y + b[1].h / 2 AS cy FROM e)
SELECT event_id, least(b[o[1]].x, b[o[2]].x) AS left_x, greatest(b[o[1]].x, b[o[2]].x) AS right_x, b[1].x <= b[3].x AND b[1].y <= b[3].y AND b[1].x + b[1].w >= b[3].x + b[3].w AND b[1].y + b[1].h >= b[3].y + b[3].h AS holds,
  len(list_filter(b[2:3], lambda p: {_IN})) > 0 AS within FROM r""",
    "crops": """WITH s AS (SELECT p_partkey, CAST(p_partkey % 1900 + 100 AS INTEGER) AS w, CAST(p_partkey % 1000 + 80 AS INTEGER) AS h, CASE WHEN p_partkey % 13 > 10 THEN 0.5::DOUBLE ELSE (p_partkey % 13) / 10::DOUBLE END AS c, 1::DOUBLE + p_partkey % 3 AS z FROM part),
a AS (SELECT *, CAST(round_even(h * 9 / 16::DOUBLE, 0) AS INTEGER) AS wide FROM s),
b AS (SELECT *, least(wide, w) AS cw0, CASE WHEN wide > w THEN CAST(round_even(w * 16 / 9::DOUBLE, 0) AS INTEGER) ELSE h END AS ch0 FROM a),
d AS (SELECT *, CASE WHEN z > 1 THEN greatest(2, CAST(round_even(cw0 / z, 0) AS INTEGER)) ELSE cw0 END AS cw, CASE WHEN z > 1 THEN greatest(2, CAST(round_even(ch0 / z, 0) AS INTEGER)) ELSE ch0 END AS ch FROM b)
SELECT p_partkey, CAST(round_even(greatest(0::DOUBLE, least(CAST(w - cw AS DOUBLE), c * w - cw / 2::DOUBLE)), 0) AS INTEGER) AS "left", CAST(round_even(greatest(0::DOUBLE, least(CAST(h - ch AS DOUBLE), (h - ch) / 2::DOUBLE)), 0) AS INTEGER) AS top, cw AS width, ch AS height FROM d""",
    "seconds": f"""SELECT doc_id, CAST({_choice(('7', '0', '0', '1000', '0', '0', '0', '59.999'))} AS DOUBLE) AS seconds, {_choice(('0:00:07.00', '0:00:00.00', '0:00:00.00', '0:16:40.00', '0:00:00.00', '0:00:00.00', '0:00:00.00', '0:01:00.00'))} AS ass,
  {_choice(('00:00:07,000', '00:00:00,000', '00:00:00,000', '00:16:40,000', '00:00:00,000', '00:00:00,000', '00:00:00,000', '00:00:59,999'))} AS srt,
  {_choice(('a', 'c', 'b', 'a,c', None, 'b,c'))} AS filters, {_choice(('a\\{b\\}', 'c\\\\d', 'e\\Nf'))} AS escaped FROM documents""",
    "glossary_rules": """WITH l AS (SELECT line_no, array_to_string(list_filter(regexp_split_to_array(trim(entry), '\\s+'), lambda x: x <> ''), ' ') AS w FROM blocklist WHERE entry NOT LIKE '%#%' AND trim(entry) <> ''),
r AS (SELECT w AS wrong, w || '!' AS right_, min(line_no) AS k FROM l GROUP BY ALL), o AS (SELECT *, length(right_) + 2 AS size, row_number() OVER (ORDER BY k) AS rn FROM r),
s AS (SELECT *, sum(size) OVER (ORDER BY rn) - 2 AS total FROM o) SELECT wrong, right_ AS "right", CAST((SELECT count(*) FROM s WHERE total <= 220) AS INTEGER) AS terms FROM s""",
    "smooth_frames": f"""WITH RECURSIVE {_FRAMES}, o AS (SELECT user_id, event_id AS place, yavg, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM frames),
walk AS (SELECT user_id, place, rn, yavg AS smooth FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.place, o.rn, 0.7::DOUBLE * w.smooth + (1 - 0.7::DOUBLE) * o.yavg FROM walk w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT user_id, place, round(smooth, 6) AS smooth FROM walk""",
    "follow_frames": f"""WITH RECURSIVE {_FRAMES}, o AS (SELECT user_id, event_id AS place, yavg AS aim, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM frames),
walk AS (SELECT DISTINCT user_id, 0::BIGINT AS place, 0::BIGINT AS rn, 128::DOUBLE AS at_ FROM o
  UNION ALL SELECT o.user_id, o.place, o.rn, least(216::DOUBLE, greatest(40::DOUBLE, CASE WHEN abs(aim - at_) <= 20 THEN at_ WHEN abs(aim - at_) <= CASE WHEN abs(aim - at_) > 40 THEN 16 ELSE 4 END THEN aim ELSE at_ + CASE WHEN abs(aim - at_) > 40 THEN 16 ELSE 4 END * sign(aim - at_) END))
  FROM walk w JOIN o ON o.user_id = w.user_id AND o.rn = w.rn + 1)
SELECT user_id, place, round(at_, 6) AS center FROM walk WHERE rn > 0""",
    "verdicts": f"""WITH {_LOUD}, {_FOUND}, n AS (SELECT source_id, count(*) AS n FROM found GROUP BY ALL), s AS (SELECT source_id, count(*) FILTER (event_type = 'error') = 0 AS has_audio FROM loud GROUP BY ALL)
SELECT source_id, CASE WHEN n > 0 THEN 'review_required' WHEN NOT has_audio THEN 'degraded' ELSE 'clear' END AS verdict, coalesce(n, 0) AS findings FROM s LEFT JOIN n USING (source_id)""",
    "findings": f"WITH {_LOUD}, {_FOUND} SELECT * FROM found",
    "dead_jobs": """WITH items AS (SELECT DISTINCT ON (id) * FROM queue_items)
SELECT id, 'stalled' AS what FROM items WHERE state = 'running' AND 1740900000 - coalesce(CASE WHEN folder IS NOT NULL THEN added END, 0) >= 86400
UNION ALL SELECT id, 'expired' FROM items WHERE 1740900000 - coalesce(finished, added, 0) > 86400""",
    "stopped_chunks": f"""WITH {CANDS}, a AS (SELECT run_id, cand_idx, bool_or(text IS NOT NULL AND cand_id % 4 <> 0) AS ok FROM cands WHERE cand_idx IS NOT NULL GROUP BY ALL),
s AS (SELECT a.run_id, min(b.cand_idx) AS stop FROM a JOIN a b ON b.run_id = a.run_id AND b.cand_idx = a.cand_idx + 1 WHERE NOT a.ok AND NOT b.ok GROUP BY ALL)
SELECT a.* FROM a LEFT JOIN s USING (run_id) WHERE stop IS NULL OR cand_idx <= stop""",
    "unsure_languages": "SELECT doc_id FROM documents WHERE nullif(trim(lang, ' '), '') IS NULL AND coalesce(CASE WHEN doc_id % 3 > 0 THEN doc_id % 10 / 10::DOUBLE END, 0) < 0.6::DOUBLE",
    "request_batches": f"WITH {CANDS}, d AS (SELECT DISTINCT run_id, cand_idx FROM cands WHERE cand_idx IS NOT NULL) SELECT run_id, CAST(cand_idx // 4 AS INTEGER) AS batch_no, count(*) AS candidates, CAST(max(cand_idx % 4) AS INTEGER) AS last_place FROM d GROUP BY ALL",
    "edited_segments": f"""WITH {SEGS} SELECT source_id, seg_idx, start, CASE WHEN seg_idx % 5 = 0 THEN "end" + 1 ELSE "end" END AS "end", CASE WHEN seg_idx % 7 = 0 THEN '* ' || coalesce(text, '') ELSE text END AS text,
  CASE WHEN seg_idx % 5 = 0 OR seg_idx % 7 = 0 THEN 0 ELSE CAST(coalesce(len(words), 0) AS INTEGER) END AS words FROM segs WHERE {SOUND}""",
    "edit_checks": f"""WITH {SEGS}, e AS (SELECT source_id, quantile_cont("end", 0.95) FILTER (CAST("end" AS VARCHAR) <> 'nan') AS d FROM segs GROUP BY ALL),
r AS (SELECT source_id, seg_idx, CASE WHEN seg_idx % 11 = 0 THEN start - 30 ELSE start END AS s, "end" AS e, d FROM segs JOIN e USING (source_id)),
b AS (SELECT *, max(s) OVER (PARTITION BY source_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT source_id, seg_idx, fault FROM (SELECT *, CASE WHEN NOT coalesce(s >= 0 AND s < e AND e <= d AND CAST(s AS VARCHAR) <> 'nan' AND CAST(e AS VARCHAR) <> 'nan', false) THEN 'times' WHEN before > s THEN 'order' END AS fault FROM b) WHERE fault IS NOT NULL""",
    "file_names": r"""WITH f AS (SELECT id, lower(regexp_extract(source, '(\.[^./]*)$', 1)) AS name FROM (SELECT DISTINCT ON (id) * FROM queue_items))
SELECT id, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY id) > 1 THEN id || '_' || name ELSE name END AS entry_name FROM f""",
}


def _shared_sql() -> dict[str, str]:
    """SQL that uses shingles and accepted clips."""
    from spanloom.plans.fold_sql import _ACCEPTED, CAPTIONS, shingles_sql, tokens_sql

    time = lambda c: "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)".format(f"CAST(round_even(greatest(0::DOUBLE, {c}) * 1000, 0) AS BIGINT)")

    from spanloom.plans.candidate_queries import SQL as CANDIDATE

    one = f"t AS (SELECT *, {tokens_sql('text')} AS tok FROM clips), s AS (SELECT source_id, clip_id, {shingles_sql('tok')} AS sh FROM t WHERE source_id IS NOT NULL)"
    return {
        "srt_cues": f"""SELECT source_id, caption_no, CAST(caption_no + 1 AS VARCHAR) || chr(10) || {time('start')} || ' --> ' || {time('"end"')} || chr(10) || text || chr(10) AS cue FROM ({CAPTIONS})""",
        "shortfalls": f"""WITH r AS ({CANDIDATE['quality_rejects']}), s AS (SELECT source_id, coalesce(sum(clips) FILTER (reason = 'accepted'), 0) AS final FROM r GROUP BY ALL), few AS (SELECT * FROM s WHERE final < 8)
SELECT source_id, 'missing' AS reason, CAST(8 - final AS BIGINT) AS clips, NULL::DOUBLE AS bound FROM few
UNION ALL SELECT r.source_id, reason, clips, CASE reason WHEN 'below_threshold' THEN 40 WHEN 'too_short' THEN 3 END FROM r JOIN few ON few.source_id IS NOT DISTINCT FROM r.source_id WHERE reason <> 'accepted'""",
        "rejected_clips": f"WITH {_ACCEPTED}, r AS (SELECT o, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, o) AS k FROM acc) SELECT o AS clip_id FROM r WHERE k > 3",
        "alike_clips": f"""WITH {CLIPS}, {one} SELECT a.source_id, a.clip_id AS clip_a, b.clip_id AS clip_b, len(list_intersect(a.sh, b.sh)) AS shared
FROM s a JOIN s b ON a.source_id = b.source_id AND a.clip_id < b.clip_id WHERE len(a.sh) > 0 AND len(b.sh) > 0 AND len(list_intersect(a.sh, b.sh)) * 2 >= least(len(a.sh), len(b.sh))""",
        "context_shares": f"""WITH {CANDS}, t AS (SELECT cand_id, {tokens_sql('text')} AS a, {tokens_sql('context_after')} AS b FROM cands), s AS (SELECT cand_id, {shingles_sql('a')} AS x, {shingles_sql('b')} AS y FROM t)
SELECT cand_id, CASE WHEN least(len(x), len(y)) > 0 THEN round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) ELSE 0::DOUBLE END AS share FROM s""",
    }


SQL |= _shared_sql()
