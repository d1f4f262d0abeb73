import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import review, windows
from spanloom.operators.spans import spoken_words
from spanloom.plans.options import Options, preset_name
from spanloom.plans.pipeline import cover_completely, find_highlights, make_candidates, plan_bands, run, scored_by_answers, select_highlights

SUB = ("hook_score", "content_score", "story_score", "emotion_score", "standalone_score", "ending_score")
SEGMENT = "source_id string, seg_idx int, start double, end double, text string, words array<struct<start: double, end: double, text: string>>"


def transcript(source, n):
    out = []
    for i in range(n):
        text = f"{source} says sentence number {i}."
        words = text.split()
        out.append((source, i, i * 4.0, i * 4.0 + 3.5, text, [(i * 4.0 + 0.5 * k, i * 4.0 + 0.5 * k + 0.4, w) for k, w in enumerate(words)]))
    return out


def scorer(candidates):
    value = F.pmod(F.xxhash64("source_id", "ordinal"), F.lit(60)).cast("double") + 40
    return candidates.select("source_id", "ordinal", *[value.alias(c) for c in SUB])


def test_highlights_hold_the_rules(spark):
    seg = spark.createDataFrame(transcript("a", 60) + transcript("b", 20), SEGMENT)
    options = Options(clips=4, shortest=10, longest=30, strategy="windows")
    found = select_highlights(seg, scorer, options).orderBy("source_id", "index").collect()
    assert {r.source_id for r in found} == {"a", "b"}
    for source in "ab":
        own = [r for r in found if r.source_id == source]
        assert [r["index"] for r in own] == list(range(1, len(own) + 1)) and len(own) <= 4 and [r.start for r in own] == sorted(r.start for r in own)
        for x, a in enumerate(own):
            for b in own[x + 1 :]:
                assert max(0, min(a.end, b.end) - max(a.start, b.start)) <= 0.15 * min(a.end - a.start, b.end - b.start) + 1e-9
    asked = []
    already = make_candidates(seg, options)
    already = already.join(scorer(already), ["source_id", "ordinal"]).select("source_id", "start", "end", *SUB)
    again = select_highlights(seg, lambda c: asked.append(c.count()) or scorer(c), options, already=already)
    assert rows(again) == sorted(tuple(r) for r in found) and asked == [0]


def test_full_coverage(spark):
    seg = spark.createDataFrame(transcript("a", 60), SEGMENT)
    parts = cover_completely(seg, spark.createDataFrame([("a", 240.0), ("silent", 100.0)], "source_id string, duration double"), Options(cover=True, part_length=60)).orderBy("source_id", "part_no").collect()
    own = [p for p in parts if p.source_id == "a"]
    assert len(own) == 4 and own[0].start == 0 and own[-1].end == 240 and all(x.end == y.start for x, y in zip(own, own[1:])) and "number 0." in own[0].text
    assert [p.text for p in parts if p.source_id == "silent"] == ["", ""]


def test_options():
    assert Options(platform="reels").band == (15.0, 90.0) and Options(platform="reels", longest=30).band == (15.0, 30.0)
    assert Options.of({"clips": 3, "unknown": 1}).clips == 3
    for bad in ({"shortest": 70}, {"top_share": 0.8}, {"strategy": "x"}, {"platform": "y"}, {"clips": 0}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert preset_name("  my   name ") == "my name"
    for bad in ("", "a" * 41, "a/b"):
        with pytest.raises(ValueError):
            preset_name(bad)


def test_review(spark):
    finals = spark.createDataFrame([("s", 1, 0.0, 10.0, 5.0), ("s", 2, 20.0, 30.0, 6.0)], "source_id string, index int, start double, end double, score double")
    d = spark.createDataFrame([("s", 25.0)], "source_id string, duration double")
    rv = spark.createDataFrame([("s", 1, 0.0, 10.0, False, None, None), ("s", 2, 20.0, 25.03, True, "t", None)], "source_id string, index int, start double, end double, selected boolean, title string, focus string")
    assert rows(review.chosen_clips(finals, rv, d)) == [("s", 2, 20.0, 25.0, "t", "largest", 6.0)]
    for bad in ({"index": 9}, {"end": 26.0}, {"end": 1.0}):
        with pytest.raises(Exception, match="check the times"):
            review.chosen_clips(finals, rv.withColumns({k: F.lit(v) for k, v in bad.items()}), d).collect()
    lang = spark.createDataFrame([("a", None, "ar", 0.5), ("b", "ar", "ar", 0.1), ("c", None, "en", 0.6)], "source_id string, asked string, detected string, probability double")
    assert rows(review.unsure_languages(lang).select("source_id")) == [("a",)]


def test_library(spark):
    lib = spark.createDataFrame([("k1", "/p/a/analysis.json", "/p/a"), ("k2", "/p/b/analysis.json", "/w/b"), ("k3", None, None)], "key string, snapshot string, work_dir string")
    left = lambda *paths: [r[0] for r in rows(review.unregistered(lib, spark.createDataFrame([(p,) for p in paths], "path string")).select("key"))]
    assert left("/p/a/analysis.json") == ["k2", "k3"] and left("/p/b") == ["k1", "k3"] and left("/w/b/x.json") == ["k1", "k3"] and left("/none") == ["k1", "k2", "k3"]
    folders = spark.createDataFrame([("/w/b",), ("/h",), ("/free",)], "path string")
    assert rows(review.protected_folders(folders, lib, spark.createDataFrame([("/h/analysis.json",)], "path string"))) == [("/h",), ("/w/b",)]


def test_prompts_and_proposals(spark):
    c = spark.createDataFrame([("s", 0, 1, 5.0, 9.0, "b", "", None), ("s", 0, 0, 1.0, 4.0, "a", "x" * 300, "")], "source_id string, batch_no int, place int, start double, end double, text string, context_before string, context_after string")
    p = review.prompts(c, "Answer.").first().prompt
    assert p.startswith("[0] start=1.00 end=4.00\ntext: a\nbefore: " + "x" * 200 + "\n") and p.endswith("Answer.") and "[1]" in p
    chunks = spark.createDataFrame([("s", 0, 5, "t"), ("s", 3, 9, "u")], "source_id string, first int, last int, text string")
    cached = spark.createDataFrame([("s", 0, 5, "old")], "source_id string, first int, last int, answer string")
    assert rows(review.proposals_with_cache(chunks, cached, lambda df: df.withColumn("answer", F.lit("new"))).select("first", "answer")) == [(0, "old"), (3, "new")]
    a = spark.createDataFrame([("s", i, ok) for i, ok in enumerate((True, False, True, False, False, True))] + [("t", 0, False), ("t", 1, True)], "source_id string, chunk_no int, ok boolean")
    assert rows(review.before_failures(a).groupBy("source_id").count()) == [("s", 5), ("t", 2)]
    counts = spark.createDataFrame([("a", 3), ("b", 9), ("c", 1)], "rule string, hits long")
    assert [(r.rule, r.total) for r in review.most_frequent(counts, 2).collect()] == [("b", 13), ("a", 13)]


def test_words_where_there_are_no_windows(spark):
    words = [(float(i), i + 0.9, f"w{i}") for i in range(100)]
    seg = spark.createDataFrame([("long", 0, 0.0, 60.0, "x", words[:60]), ("long", 1, 60.0, 100.0, "x", words[60:])], SEGMENT)
    numbers = windows.numbered_words(spoken_words(seg), 1)
    assert [(r.word_no, r.word) for r in numbers.orderBy("word_no").collect()] == [(i, f"w{i}") for i in range(100)]
    found = make_candidates(seg, Options(clips=5, shortest=8, longest=10, strategy="windows")).collect()
    assert found and all(8 <= r.end - r.start <= 10 and r.text.startswith(f"w{int(r.start)} ") for r in found)


def test_candidates_grow_from_anchors(spark):
    seg = spark.createDataFrame(transcript("a", 12) + [("long", 0, 0.0, 25.0, "One.", []), ("long", 1, 25.0, 70.0, "Two.", [])], SEGMENT)
    found = {(r.source_id, r.ordinal // 1_000_000, r.ordinal % 1_000_000 + 1): r for r in make_candidates(seg, Options(clips=1, shortest=10, longest=20, strategy="windows")).collect()}
    slid = {("a", a, n) for a in range(0, 12, 2) for n in (3, 5, 7) if a + n <= 12}
    grown = {("a", a, n) for a in range(0, 12, 2) for n in range(1, 13 - a) if 10 <= 4 * n - 0.5 <= 30}
    assert set(found) == slid | grown | {("long", 0, 1)} and len(grown - slid) > 5
    assert found["a", 2, 4].text == " ".join(f"a says sentence number {i}." for i in range(2, 6)) and found["long", 0, 1].text == "One."
    assert (found["a", 2, 4].start, found["a", 2, 4].end, found["a", 2, 4].context_after) == (8.0, 23.5, "a says sentence number 6.")


def test_trimmed_clips_are_compared_and_returned_as_cut(spark):
    from spanloom.operators import select

    words = lambda a, n: [f"{a}{i}" for i in range(n)]
    shared = words("shared", 40)
    data = [("s", 0, 0.0, 20.0, 90.0, " ".join(shared)), ("s", 1, 100.0, 140.0, 80.0, " ".join(words("own", 30) + shared[:30])), ("s", 2, 200.0, 210.0, 70.0, "short   text stays")]
    df = spark.createDataFrame(data, "source_id string, ordinal long, start double, end double, score double, text string")
    found = select.greedy_select(df, most_alike=0.4, target=3, longest=20.0)
    assert rows(found.select("ordinal", "kept_end", "kept")) == [(0, 20.0, True), (1, 120.0, True), (2, 210.0, True)]
    texts = rows(df.join(found, ["source_id", "ordinal"]).select("ordinal", select.kept_text(20.0)))
    assert texts == [(0, data[0][5]), (1, " ".join(words("own", 30))), (2, data[2][5])]
    assert {r.ordinal: r.kept for r in select.greedy_select(df, most_alike=0.4).collect()}[1] is False
    parts = [(text, share, " ".join(text.split()[: max(1, round(len(text.split()) * share))]) if text.split() else text) for text in ("a b c d e", "a　b c", " ", "x") for share in (0.1, 0.5, 0.9)]
    assert all(r[0] == r[1] for r in spark.createDataFrame(parts, "text string, share double, wanted string").select(select.shortened("text", F.col("share")), "wanted").collect())


def test_sources_without_words_are_widened(spark):
    seg = spark.createDataFrame([r if r[0] == "a" else (*r[:5], []) for r in transcript("a", 8) + transcript("mute", 8)] + [("mute", 8, float("nan"), 40.0, "x", [])], SEGMENT)
    options = Options(clips=1, shortest=10, longest=30, strategy="windows", sizes=(3,))
    only = lambda c: scorer(c).withColumns({x: F.when(F.col("ordinal") == 2_000_002, 99.0).otherwise(45.0) for x in SUB})
    found = {r.source_id: (r.start, r.end) for r in select_highlights(seg, only, options).collect()}
    assert found["mute"] == (4.0, 23.5) and found["a"][0] == 8.0


def test_bands_follow_the_durations(spark):
    seg = spark.createDataFrame(transcript("long", 80) + transcript("short", 12), SEGMENT)
    options = Options(clips=6, shortest=10, longest=30, strategy="windows")
    bands = {r.source_id: (r.min_s, r.max_s, r.stride) for r in plan_bands(seg, options).collect()}
    assert bands["long"] == (10.0, 30.0, 2) and bands["short"][1] == 8.0 and bands["short"][2] == 1
    made = make_candidates(seg, options).collect()
    assert max(r.end - r.start for r in made if r.source_id == "short") <= 12.0 and {r.ordinal // 1_000_000 % 2 for r in made if r.source_id == "short"} == {0, 1}
    assert {r.ordinal // 1_000_000 % 2 for r in made if r.source_id == "long"} == {0}
    even = {r.source_id: (r.min_s, r.max_s) for r in plan_bands(seg, options.but(evenly=True)).collect()}
    assert even["short"] == (8.0, 8.0) and even["long"] == (10.0, 30.0)


def test_answers_find_their_candidates(spark):
    """A model that echoes places but makes up the times of one batch, and leaves one entry out."""
    seg = spark.createDataFrame(transcript("a", 40), SEGMENT)
    options = Options(clips=3, shortest=10, longest=30, strategy="windows")

    def answer(asked):
        rows = asked.filter("NOT (batch_no = 0 AND place = 1)").withColumn("entry_no", F.col("place"))
        shift = F.when(F.col("batch_no") == 1, F.lit(1e6)).otherwise(F.lit(0.4))
        rows = rows.withColumns({"e_start": F.col("start") + shift, "e_end": F.col("end") + shift, "echoed": F.when(F.col("batch_no") == 1, F.col("place").cast("string"))})
        return rows.select("source_id", "batch_no", "entry_no", "e_start", "e_end", "echoed", *[F.lit(70.0 + i).alias(c) for i, c in enumerate(SUB)])

    made = make_candidates(seg, options)
    found = scored_by_answers(made, answer, 4)
    methods = {r.method: r.n for r in found.groupBy("method").agg(F.count("*").alias("n")).collect()}
    assert methods["index"] == 4 and methods["nearest"] == made.count() - 5
    result = find_highlights(seg, lambda c: scored_by_answers(c, answer, 4), options.but(clips=40))
    why = {r.reason: r.clips for r in result.why.collect()}
    assert why["unmatched"] == 1 and why["matched_by_index"] == 4 and why["missing"] == 40 - result.clips.count() and why["overlapping"] > 0 and why["room"] > 0


def test_run_covers_or_selects(spark):
    seg = spark.createDataFrame(transcript("a", 60), SEGMENT)
    parts = run(seg, scorer, Options(cover=True, part_length=60)).orderBy("index").collect()
    assert [p["index"] for p in parts] == [1, 2, 3, 4] and parts[0].start == 0.0 and parts[-1].end == 239.5 and parts[0].score is None
    assert run(seg, scorer, Options(clips=2, shortest=10, longest=30, strategy="windows")).count() == 2
