import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.functions import planning as P
from spanloom.functions import text as T
from spanloom.functions import urls as U
from spanloom.operators.corrections import RuleError, corrected, correction_counts, hotwords, parse_rules


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_tokens_and_shingles(spark):
    assert one(spark, T.tokens(F.lit("Hé, a Word’s 12 كِتاب"))) == ["word", "12", "كتاب"]
    assert one(spark, T.shingles(F.lit("one two three"))) == ["one\x1ftwo\x1fthree"]
    assert one(spark, F.size(T.shingles(F.lit(" ".join(f"w{i}" for i in range(10)))))) == 3
    assert one(spark, T.shingles(F.lit(None).cast("string"))) == []
    assert one(spark, T.containment(T.shingles(F.lit("")), T.shingles(F.lit("a b")))) == 0.0


@pytest.mark.parametrize("text,filler", [("", True), (None, True), ("um", True), ("um uh", True), ("um yes", True), ("yes", False), ("um uh like", True), ("um well yes", False), ("...", True)])
def test_filler(spark, text, filler):
    assert one(spark, T.filler_only(F.lit(text).cast("string"))) is filler


@pytest.mark.parametrize("text,mid", [("", True), ("No end", False), ("One. Two", True), ("One. Two.", False), ("Really… ", False), ("سؤال؟ ثم", True)])
def test_mid_idea(spark, text, mid):
    assert one(spark, T.ends_mid_idea(F.lit(text))) is mid


def test_masking(spark):
    p = T.blocked_pattern(["badword", "كلمه"])
    cases = {"a badword, b": "a *******, b", "b.a.d.w.o.r.d": "*.*.*.*.*.*.*", "badwords badwordy": "******** badwordy", "x-badword": "x-*******", "والكلمة": "*******", "": "", "  two  spaces ": "  two  spaces "}
    for text, wanted in cases.items():
        assert one(spark, T.masked(F.lit(text), p)) == wanted
        assert one(spark, T.contains_blocked(F.lit(text), p)) is ("*" in wanted)
    assert one(spark, T.masked(F.lit(None).cast("string"), p)) is None
    assert one(spark, T.masked(F.lit("a badword"), T.blocked_pattern([]))) == "a badword"
    assert T.blocklist_words(["# note", " a # b", "", None, "a"]) == ["a"]


def test_titles(spark):
    p = T.blocked_pattern(["badword"])
    for title, good in (("A fine title", True), ("Clip 12", False), ("جزء ٣", False), ("", False), (None, False), ("x" * 101, False), ("one two three four five six seven eight nine", False), ("a {b}", False), ("my badword", False)):
        assert one(spark, T.valid_title(F.lit(title).cast("string"), p)) is good


def test_times_and_escapes(spark):
    assert one(spark, T.clock(F.lit("83.9"))) == "01:23"
    assert one(spark, T.clock(F.lit(3_725.0))) == "01:02:05"
    assert one(spark, T.clock(F.lit("junk"))) == "00:00"
    assert one(spark, T.srt_time(F.lit(60_000))) == "00:01:00,000"
    assert one(spark, T.ass_time(F.lit(61.239))) == "0:01:01.24"
    assert one(spark, T.escape_ass(F.lit("a{b}\n\\"))) == "a\\{b\\}\\N\\\\"
    assert one(spark, T.escape_xml(F.lit("<a & \x01b>"))) == "&lt;a &amp; b&gt;"
    assert one(spark, T.joined_filters(F.lit("a"), F.lit(" "), F.lit(None).cast("string"), F.lit("b"))) == "a,b"


def test_json_in_answers(spark):
    for text, wanted in (('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure: {"a": 1} done', '{"a": 1}'), ("nothing", None), ("", None), (None, None)):
        assert one(spark, T.extracted_json(F.lit(text).cast("string"))) == wanted


def test_fingerprint(spark):
    import hashlib

    assert one(spark, T.fingerprint(F.lit("a"), F.lit("b"))) == hashlib.sha256(b"a|b").hexdigest()[:16]


def test_excerpt(spark):
    text = "".join(chr(97 + i % 26) for i in range(2_000))
    assert one(spark, T.prompt_excerpt(F.lit(text))) == text[:850] + " [...] " + text[-350:]
    assert one(spark, T.prompt_excerpt(F.lit(" ab "))) == "ab"


@pytest.mark.parametrize("url,name", [
    ("https://www.youtube.com/watch?v=1", "youtube"), ("https://youtu.be/1", "youtube"), ("http://m.facebook.com/x", "facebook"), ("https://x.com/a/1", "x"), ("https://notx.com/a", "other"),
    ("https://vm.tiktok.com/z", "tiktok"), ("https://example.org/v.MP4", "direct"), ("ftp://youtube.com/a", "other"), ("https://u:p@youtube.com/a", "other"), ("", "other"), (None, "other"),
])
def test_platform(spark, url, name):
    assert one(spark, U.platform(F.lit(url).cast("string"))) == name


def test_urls(spark):
    assert one(spark, U.normal_url(F.lit(" HTTPS://a.b/c?d=e#f "))) == "https://a.b/c?d=e"
    assert one(spark, U.failure_kind(F.lit("ERROR: Sign in to confirm your age"))) == "sign_in"
    assert one(spark, U.failure_kind(F.lit("This video is not available in your country"))) == "geo"
    assert one(spark, U.failure_kind(F.lit(None).cast("string"))) == "generic"
    mux = '{"requested_formats": [{"url": "v", "vcodec": "h", "acodec": "none"}, {"url": "a", "vcodec": "none", "acodec": "m"}]}'
    assert one(spark, U.stream_plan(F.lit(mux))).asDict() == {"mode": "mux", "url": "", "video_url": "v", "audio_url": "a", "has_audio": True}
    assert one(spark, U.stream_plan(F.lit('{"_type": "playlist", "entries": [null, {"url": "u"}]}')))["url"] == "u"
    assert one(spark, U.stream_plan(F.lit("{}")))["mode"] is None
    assert one(spark, U.single_video(F.lit('{"url": "u", "age_limit": 18}'))) is False
    assert one(spark, U.single_video(F.lit('{"url": "u"}'))) is True


@pytest.mark.parametrize("d,l,r,n", [(60, 60, 0.3, 1), (60, 30, 0.3, 2), (30, 60, 0.3, 0), (30, 8, 0.3, 4), (0, 8, 0.3, 0)])
def test_capacity(spark, d, l, r, n):
    assert one(spark, P.capacity(d, l, r)) == n


@pytest.mark.parametrize("d,n", [(3057, 51), (1800, 30), (40, 1), (0, 0)])
def test_full_coverage(spark, d, n):
    assert one(spark, P.full_coverage(d, 60))["count"] == n


@pytest.mark.parametrize("d,n,lo,hi,wanted", [(3057, 30, 20, 110, (20.0, 101.9, True)), (3057, 13, 20, 60, (20.0, 60.0, False)), (56, 5, 20, 60, (8.0, 11.2, True))])
def test_band(spark, d, n, lo, hi, wanted):
    df = spark.createDataFrame([(float(d),)], "d double")
    r = P.band_plan(df, "d", P.Band(n, float(lo), float(hi))).first()
    assert (round(r.min_s, 6), round(r.max_s, 6), r.adapted) == wanted and r.feasible
    if d == 56:
        assert r.clips_that_fit == 5


def test_feasibility(spark):
    plan = P.band_plan(spark.createDataFrame([(100.0,), (3000.0,)], "d double"), "d", P.Band(20, 20.0, 60.0))
    found = [r[0] for r in plan.orderBy("d").select(P.feasibility("d", 20, 60.0, "clips_that_fit", "max_s")).collect()]
    assert tuple(found[0]) == (20, 14, 100.0, 8.0, True) and found[1] is None


def test_counts_and_batches(spark):
    assert one(spark, P.suggested_clips(59 * 60)) == 15
    assert (one(spark, P.batch_size(None, 60.0)), one(spark, P.batch_size(None, 110.0))) == (16, 9)
    assert tuple(one(spark, P.crop(1920, 1080))) == (656, 0, 608, 1080)
    assert tuple(one(spark, P.crop(1920, 1080, 0.5, 2.0))) == (808, 270, 304, 540)
    assert tuple(one(spark, P.crop(400, 1000))) == (0, 144, 400, 711)


def test_parts(spark):
    df = spark.createDataFrame([(9.0,)], "d double")
    assert [(r.part_start, r.part_end) for r in P.part_plan(df, "d", count=3).orderBy("part_no").collect()] == [(0, 3), (3, 6), (6, 9)]
    assert [(r.part_start, r.part_end) for r in P.part_plan(df, "d", length=4.0).orderBy("part_no").collect()] == [(0, 4), (4, 9)]
    assert P.part_plan(df, "d", count=4).count() == 0
    for bad in ({}, {"count": 0}, {"length": 1.0}, {"count": 1, "length": 4.0}):
        with pytest.raises(ValueError):
            P.part_plan(df, "d", **bad)


def test_light(spark):
    df = spark.createDataFrame([(60.0, 20.0, 200.0, 5), (118.0, 0.0, 255.0, 5), (0.5, 0.0, 3.0, 5), (60.0, 20.0, 200.0, 0)], "avg double, min double, max double, samples int")
    found = P.light_correction(df).collect()
    assert found[0].kind == "dark" and 1.0 < found[0].gamma <= P.MAX_GAMMA and abs(found[0].predicted - 118) < 8
    assert [r.kind for r in found[1:]] == [None, None, None]


def test_rules(spark):
    assert parse_rules("# c\na => b\n// d\nx = y\na => c") == [("a", "c"), ("x", "y")]
    for bad in ("word", "a =>", "a => a", "a => " + "b" * 61):
        with pytest.raises(RuleError, match="line 2"):
            parse_rules("x => y\n" + bad)
    assert parse_rules(" a = b  =>  c   d ") == [("a = b", "c d")] and parse_rules(None) == []
    with pytest.raises(RuleError, match="line 1: .*line 3: "):
        parse_rules("no rule\na => b\n=> c")
    rules = [("word", "term")]
    assert one(spark, corrected(F.lit("word, (word) xword word2"), rules)) == "term, (term) xword word2"
    seg = spark.createDataFrame([("word word", [(0.0, 1.0, "word")]), (None, None)], "text string, words array<struct<start: double, end: double, text: string>>")
    assert rows(correction_counts(seg, rules)) == [("word => term", 3)]
    assert hotwords([("a", "one two"), ("b", "a b c d e f")], "three; one two") == "one two، three"


def test_hashed_share(spark):
    from spanloom.sources.tables import hashed_share

    df = spark.range(20_000)
    assert hashed_share(df, "id", 10_000, 20_000).count() == 20_000
    assert 1_800 < hashed_share(df, "id", 1_000, 20_000).count() < 2_200


def test_spread(spark):
    from spanloom.sources.tables import spread

    assert spread(spark.range(100), "id").rdd.getNumPartitions() >= 8 and spread(spark.range(0), "id").count() == 0
