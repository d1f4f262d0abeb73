import math
import random
from collections import namedtuple

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import folds, frames, match, queue, select, snap, tracking, windows
from spanloom.operators.spans import progress_marks
from spanloom.sources import records

CLIP = "source_id string, ordinal long, start double, end double, score double, text string"
WORDS = "source_id string, seg_idx int, word_idx int, w_start double, w_end double, word string"


def kept(spark, data, **options):
    df = spark.createDataFrame(data, CLIP)
    return {r.ordinal: (r.kept, r.conflict) for r in select.greedy_select(df, **options).collect()}


def test_greedy_by_time(spark):
    data = [("s", 0, 509.0, 551.6, 88.2, ""), ("s", 1, 544.5, 587.7, 88.2, "")]
    assert kept(spark, data) == {0: (True, None), 1: (False, "time")}
    assert kept(spark, data, most_overlap=0.30) == {0: (True, None), 1: (True, None)}


def test_greedy_by_text(spark):
    text = " ".join(f"token{i}" for i in range(30))
    back = " ".join(reversed(text.split()))
    assert kept(spark, [("s", 0, 0.0, 30.0, 80.0, text), ("s", 1, 1800.0, 1830.0, 70.0, text)]) == {0: (True, None), 1: (False, "text")}
    assert kept(spark, [("s", 0, 0.0, 30.0, 80.0, text), ("s", 1, 1800.0, 1830.0, 70.0, back)])[1] == (True, None)
    assert kept(spark, [("s", 0, 0.0, 30.0, 80.0, None), ("s", 1, 1800.0, 1830.0, 70.0, "")])[1] == (True, None)


def test_trimming_is_taken_only_if_more_stay(spark):
    data = [("s", 0, 0.0, 100.0, 90.0, ""), ("s", 1, 50.0, 90.0, 80.0, "")]
    assert kept(spark, data, target=2, longest=40.0) == {0: (True, None), 1: (True, None)}
    assert kept(spark, data, target=2)[1] == (False, "time")


def test_rejection_order_and_penalty(spark):
    data = [("s", 0, 5.0, 5.0, 10.0, ""), ("s", 1, 0.0, 2.0, 10.0, ""), ("s", 2, 0.0, 20.0, 39.0, "um"), ("s", 3, 0.0, 20.0, 50.0, "um"), ("s", 4, 0.0, 20.0, 41.0, "One. Two"), ("s", 5, 0.0, float("nan"), 90.0, "a b")]
    df = spark.createDataFrame(data, CLIP)
    assert [r[0] for r in df.orderBy("ordinal").select(select.reject_reason()).collect()] == ["invalid_span", "too_short", "below_threshold", "filler", None, "invalid_span"]
    assert rows(select.accepted(df).select("ordinal", "score")) == [(4, 41.0 * 0.85)]
    assert rows(select.reject_counts(df.limit(0), ["source_id"])) == []


def test_finals_and_dropped(spark):
    data = [("s", i, float(10 - i), float(12 - i), s, "") for i, s in enumerate([5.0, 9.0, 9.0, 1.0])]
    df = spark.createDataFrame(data, CLIP)
    best = select.finals(df, 2)
    assert rows(best.select("index", "ordinal")) == [(1, 2), (2, 1)]
    assert rows(select.dropped(df, best, ["source_id", "ordinal"]).select("ordinal")) == [(0,), (3,)]


def test_shortfall(spark):
    df = spark.createDataFrame([("s", 5, 2, 3, None, 4), ("t", 2, 2, 1, 1, 0), ("u", 3, None, None, 1, 9)], "source_id string, requested int, final int, below_threshold int, overlapping int, fit int")
    assert rows(select.shortfall(df)) == [("s", "below_threshold", 3, 40.0), ("s", "missing", 3, None), ("s", "room", 1, None), ("u", "missing", 3, None), ("u", "overlapping", 1, 0.15)]


def test_cover(spark):
    df = spark.createDataFrame([("s", 0, 0.0, 30.0, 1.0, 90.0), ("s", 1, 1.0, 40.0, 9.0, 90.0), ("s", 2, 41.0, 90.0, 1.0, 90.0), ("s", 3, 60.0, 70.0, 9.0, 90.0)], "source_id string, ordinal long, start double, end double, score double, duration double")
    assert rows(select.covering_clips(df).select("place", "ordinal")) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("d", [1, 40, 60, 61, 120, 121, 3057])
def test_complete_parts_cover_all(spark, d):
    none_p = spark.createDataFrame([], "source_id string, moment double, gap double")
    none_w = spark.createDataFrame([], "source_id string, w_start double, w_end double")
    found = snap.complete_parts(spark.createDataFrame([("s", float(d))], "source_id string, duration double"), none_p, none_w, 60.0).orderBy("part_no").collect()
    assert len(found) == max(1, math.ceil(d / 60)) and found[0].start == 0 and found[-1].end == d
    assert all(a.end == b.start for a, b in zip(found, found[1:]))


def test_part_edges():
    assert snap.part_edges(120, 2, [], [(59.0, 61.0)])[1] in (59.0, 61.0)
    assert snap.part_edges(20.0, 2, [(10.0, 2.0)], [(8.0, 9.0), (11.0, 12.0)], targets=[9.5]) == [0.0, 10.0, 20.0]


def run_words(start, n):
    return [("s", 0, i, start + 0.45 * i, start + 0.45 * i + 0.4, f"w{i}") for i in range(n)]


@pytest.mark.parametrize("span,wanted", [((1.2, 8.0), (0.0, 8.15)), ((5.5, 7.0), (5.5, 8.15)), ((5.5, 9.4), (5.5, 8.15))])
def test_snap_to_speech(spark, span, wanted):
    runs = spark.createDataFrame([("s", 0.0, 3.55), ("s", 5.5, 8.15)], "source_id string, r_start double, r_end double")
    df = spark.createDataFrame([("s", 1, *span)], "source_id string, span_id int, start double, end double")
    r = snap.to_speech(df, runs, F.lit(100.0), 60.0).first()
    assert (r.start, r.end) == wanted


def test_snap_to_pause(spark):
    pauses = spark.createDataFrame([("s", 0.95, 0.3), ("s", 2.15, 0.5)], "source_id string, moment double, gap double")
    df = spark.createDataFrame([("s", 1, 2.0, 9.0)], "source_id string, span_id int, start double, end double")
    assert snap.to_pauses(df, pauses).first().start == 2.15
    deep = spark.createDataFrame([("s", 1.85, 0.1), ("s", 2.05, 0.7)], "source_id string, moment double, gap double")
    assert snap.to_pauses(df.withColumn("start", F.lit(1.9)), deep).first().start == 2.05


def test_snap_to_words(spark):
    w = spark.createDataFrame([("s", 0, 0, 1.0, 2.0, "a"), ("s", 0, 1, 5.0, 6.0, "b")], WORDS)
    df = spark.createDataFrame([("s", 1, 1.5, 5.5), ("s", 2, 2.0, 5.0), ("t", 3, 1.5, 5.5)], "source_id string, span_id int, start double, end double")
    assert rows(snap.to_word_edges(df, w, F.lit(5.8)).select("span_id", "start", "end")) == [(1, 1.0, 5.8), (2, 2.0, 5.0), (3, 1.5, 5.5)]


def test_expand_without_words(spark):
    s = spark.createDataFrame([("s", 0.0, 4.0), ("s", 5.0, 9.0), ("s", 10.0, 14.0)], "source_id string, start double, end double")
    df = spark.createDataFrame([("s", 1, 5.0, 9.0)], "source_id string, span_id int, start double, end double")
    assert tuple(snap.with_neighbours(df, s, 60.0).select("start", "end").first()) == (0.0, 14.0)


def test_captions(spark):
    w = spark.createDataFrame([("s", 0.0, 1.0, "Hello."), ("s", 1.0, 2.0, "Next"), ("s", 4.0, 5.0, "later")], "source_id string, w_start double, w_end double, word string")
    found = folds.caption_groups(w, ["source_id"], "source_id string").orderBy("caption_no").collect()
    assert [r.text for r in found] == ["Hello.", "Next", "later"]
    cue = records.srt_cues(spark.createDataFrame([("s", 0, 59.9999, 61.0, "x")], "source_id string, caption_no int, start double, end double, text string")).first().cue
    assert cue == "1\n00:01:00,000 --> 00:01:01,000\nx\n"


def test_captions_over_slices(spark):
    """Against one fold over a whole source; words run on over slices, pause and end sentences."""
    random.seed(4)
    data, t = [], 0.0
    for i in range(900):
        t += random.choice([0.3, 0.3, 0.31, 0.9] if i % 300 < 200 else [0.3])
        data.append(("s" if i % 2 else None, round(t, 2), round(t + random.choice([0.1, 0.3]), 2), random.choice(["a", "bb", "ccc", "dddddddddd", "end.", "so?"][: 6 if i % 300 < 200 else 4])))
    df = spark.createDataFrame(data + data[:5], "source_id string, w_start double, w_end double, word string")
    found = folds.caption_groups(df, ["source_id"], "source_id string").collect()
    row = namedtuple("row", "w_start w_end word")
    for source in ("s", None):
        fold, wanted = folds._Captions(5, 42, 0.45), []
        for r in sorted(row(*r[1:]) for r in data + data[:5] if r[0] == source):
            wanted += fold.add(r)
        wanted += fold.end()
        assert sorted((r.caption_no, r.start, r.end, r.text) for r in found if r.source_id == source) == wanted


def test_chunks(spark):
    df = spark.createDataFrame([("s", i, "x" * 2000) for i in range(21)], "source_id string, place int, text string")
    found = folds.budget_chunks(df).orderBy("chunk_no").collect()
    assert {i for r in found for i in range(r.first, r.last)} == set(range(21)) and max(len(r.text) for r in found) <= 4_500
    assert all(b.first == max(a.first + 1, a.last - 2) for a, b in zip(found, found[1:]))


def test_windows(spark):
    df = spark.createDataFrame([("s", i, i * 4.0, i * 4.0 + 4, f" t{i} ") for i in range(10) if i != 7], "source_id string, seg_idx int, start double, end double, text string")
    found = {(r.first_idx, r.last_idx): r.text for r in windows.sliding_windows(df).collect()}
    assert sorted(found) == [(0, 2), (0, 4), (0, 6), (2, 4), (2, 6), (4, 6)] and found[0, 2] == "t0 t1 t2"
    grown = {(r.first_idx, r.last_idx) for r in windows.anchored_windows(df, 10.0, 20.0).collect()}
    assert grown == {(a, b) for a in (0, 2, 4, 6, 8) for b in range(a, 10) if b != 7 and 10.0 <= (b - a + 1) * 4 <= 30}


def test_anchored_windows_end_at_the_first_row_too_far(spark):
    """Against brute force, with ends out of order, by little and by much."""
    random.seed(8)
    rows_ = [(s, i, i * 3.0, i * 3.0 + random.choice([2.0, *[3.0] * 12, 25.0, 70.0, 4e9])) for s, n in (("a", 120), ("b", 3)) for i in range(n)] + [("b", 3, 9.0, 1.0), ("b", 4, 12.0, 21.0), ("b", 6, None, 30.0)]
    wanted = set()
    for source in "ab":
        own = sorted((i, s, e) for x, i, s, e in rows_ if x == source and s is not None and e > s)
        for first, start, _ in own:
            for i, _, end in [r for r in own if r[0] >= first] if first % 2 == 0 else []:
                if end - start > 30.0:
                    break
                if end - start >= 10.0:
                    wanted.add((source, first, i))
    df = spark.createDataFrame(rows_, "source_id string, seg_idx int, start double, end double")
    found = windows.anchored_windows(df, 10.0, 20.0).collect()
    assert sorted((r.source_id, r.first_idx, r.last_idx) for r in found) == sorted(wanted) and len(wanted) > 60


def test_word_windows_stay_in_the_band(spark):
    df = spark.createDataFrame([("s", i, float(i), i + 1.0) for i in range(40)], "source_id string, word_no int, w_start double, w_end double")
    found = windows.word_windows(df, 8.0, 10.0).collect()
    assert found and all(8 <= r.end - r.start <= 10 for r in found)


@pytest.mark.parametrize("n", [5, 6, 7, 50])
def test_cap(spark, n):
    random.seed(n)
    df = spark.createDataFrame([("s", i, s := random.random() * 100, s + 5, random.choice([1.0, 2.0])) for i in range(n)], "source_id string, ordinal int, start double, end double, p double")
    assert windows.capped(df, F.col("p"), 6).count() == min(n, 6)


def test_merged_and_context(spark):
    w = spark.createDataFrame([("s", 0.0, 5.0, 7, "window"), ("s", 1.0, 5.0, 8, "window")], "source_id string, start double, end double, ordinal int, kind string")
    p = spark.createDataFrame([("s", 0.0, 5.0, 20, "semantic"), ("s", 3.0, 5.0, 21, "semantic")], w.schema)
    assert rows(windows.merged(w, p).select("ordinal", "kind")) == [(7, "semantic"), (8, "window"), (21, "semantic")]
    seg = spark.createDataFrame([("s", i, f"t{i}") for i in range(4)], "source_id string, seg_idx int, text string")
    c = spark.createDataFrame([("s", 0, 1), ("s", 2, 3)], "source_id string, first_idx int, last_idx int")
    assert rows(windows.with_context(c, seg).select("context_before", "context_after")) == [("", "t2"), ("t1", "")]


def candidates(spark, n, batch=16):
    return spark.createDataFrame([("s", i, i // batch, i % batch, i * 50.0, i * 50.0 + 40) for i in range(n)], "source_id string, ordinal int, batch_no int, place int, c_start double, c_end double")


ENTRY = "source_id string, batch_no int, entry_no int, e_start double, e_end double, echoed string"


def methods(spark, n, entries):
    return {r.entry_no: (r.ordinal, r.method) for r in match.layered_match(spark.createDataFrame(entries, ENTRY), candidates(spark, n)).collect()}


def test_layers(spark):
    assert methods(spark, 4, [("s", 0, i, i * 50.0, i * 50.0 + 40, None) for i in range(4)]) == {i: (i, "exact") for i in range(4)}
    assert methods(spark, 4, [("s", 0, 0, 51.0, 92.0, None), ("s", 0, 1, 700.0, 800.0, None)]) == {0: (1, "nearest"), 1: (None, "dropped")}
    assert methods(spark, 4, [("s", 0, i, 900.0 + i, 950.0, str(3 - i)) for i in range(4)]) == {i: (3 - i, "index") for i in range(4)}
    assert methods(spark, 4, [("s", 0, i, 900.0 + i, 950.0, "true") for i in range(4)]) == {i: (i, "position") for i in range(4)}
    assert methods(spark, 4, [("s", 0, i, 900.0 + i, 950.0, None) for i in range(3)]) == {i: (None, "dropped") for i in range(3)}


def test_sixteen_invented_stamps(spark):
    assert all(m == "index" for _, m in methods(spark, 16, [("s", 0, i, i * 100.0 + 7, i * 100.0 + 100, str(float(i))) for i in range(16) if i % 2]).values())


def test_resume_retry_overlay(spark):
    c = spark.createDataFrame([("s", 1, 0.00001, 1.0), ("s", 2, 5.0, 6.0)], "source_id string, ordinal int, start double, end double")
    done = spark.createDataFrame([("s", 0.0, 1.0)], "source_id string, start double, end double")
    assert rows(match.pending(c, done).select("ordinal")) == [(2,)]
    edits = spark.createDataFrame([("s", 2, 9.0)], "source_id string, ordinal int, end double")
    assert rows(match.overlaid(c, edits, ["source_id", "ordinal"], ["end"]).select("ordinal", "end")) == [(1, 1.0), (2, 9.0)]
    assert rows(match.retried(c, edits, edits, ["source_id", "ordinal"], ["end"]).select("ordinal", "end")) == [(2, 9.0)]
    names = spark.createDataFrame([("z", 1, "a"), ("z", 2, "a"), ("z", 3, "b")], "k string, i int, name string")
    assert rows(match.distinct_names(names, ["k"], "i", "name").select("i", "entry_name")) == [(1, "a"), (2, "2_a"), (3, "b")]


def test_edited_segments(spark):
    s = spark.createDataFrame([("s", 0, 0.0, 1.0, "a", [(0.0, 1.0, "a")]), ("s", 1, 1.0, 2.0, "b", [(1.0, 2.0, "b")])], "source_id string, seg_idx int, start double, end double, text string, words array<struct<start: double, end: double, text: string>>")
    e = spark.createDataFrame([("s", 0, 0.0, 1.0, "changed"), ("s", 1, 1.0, 2.0, "b")], "source_id string, seg_idx int, start double, end double, text string")
    assert [(r.text, len(r.words)) for r in match.edited_segments(s, e).orderBy("seg_idx").collect()] == [("changed", 0), ("b", 1)]
    with pytest.raises(Exception, match="ends before"):
        match.edited_segments(s, e.withColumn("end", F.lit(-1.0))).collect()


def test_proposals(spark):
    seg = spark.createDataFrame([("s", i, i * 5.0, i * 5.0 + 5) for i in range(12)], "source_id string, seg_idx int, start double, end double")
    clips = [(2, 5), ("2", 5), (True, 5), (5, 2), (2.0, 5), (2, 12)]
    import json

    answer = json.dumps({"clips": [{"start_segment": a, "end_segment": b} for a, b in clips]})
    df = spark.createDataFrame([("s", 0, 12, f"```json\n{answer}```")], "source_id string, first int, last int, answer string")
    assert rows(records.valid_proposals(df, seg, 10.0, 40.0).select("first_idx", "last_idx", "start", "end")) == [(2, 5, 10.0, 30.0)]


def test_queue(spark):
    items = spark.createDataFrame([("a", "failed", "e", 1.0, 2.0), ("b", "running", "e", 2.0, None), ("c", "pending", "", 3.0, None)], "id string, state string, error string, added double, finished double")
    assert rows(queue.state_counts(items)) == [("done", 0), ("failed", 1), ("pending", 1), ("running", 1), ("skipped", 0)]
    assert queue.next_pending(queue.failures_reset(items)).first().id == "a"
    assert queue.next_pending(items.limit(0)).count() == 0
    assert rows(queue.recovered(items).select("id", "state"))[1] == ("b", "pending")
    jobs = spark.createDataFrame([("a", "running", 95.0), ("b", "running", 70.0), ("c", "done", 0.0)], "id string, state string, heartbeat double")
    assert rows(queue.stalled(jobs, 100.0).select("id")) == [("b",)]
    f = spark.createDataFrame([("s", 1.0, 0.5), ("s", 2.0, 0.9), ("s", 15.0, 0.4)], "source_id string, time double, score double")
    found = queue.slice_findings(f, "music", 0.35, 10.0)
    assert rows(found) == [("s", "music", 1.0, 0.5), ("s", "music", 15.0, 0.4)]
    scanned = spark.createDataFrame([("s", True), ("t", False), ("u", True)], "source_id string, has_audio boolean")
    assert rows(queue.verdict(found, scanned)) == [("s", "review_required", 2), ("t", "degraded", 0), ("u", "clear", 0)]


def test_frames(spark):
    df = spark.createDataFrame([("c", 1.0, 0.0, 9.0, 1.0, 1.0), ("c", 3.0, 2.0, 11.0, 1.0, 1.0)], "clip string, yavg double, ymin double, ymax double, uavg double, vavg double")
    assert rows(frames.luma_stats(df, ["clip"])) == [("c", 2.0, 1.0, 10.0, 1.0, 1.0, 2)]
    boxes = spark.createDataFrame([([(9.0, 0.0, 5.0, 5.0), (0.0, 0.0, 1.0, 1.0), (3.0, 0.0, 4.0, 4.0)],)], "b array<struct<x: double, y: double, w: double, h: double>>")
    assert [b.x for b in boxes.select(frames.two_largest(F.col("b"))).first()[0]] == [3.0, 9.0]


def test_tracking(spark):
    v = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate((0, 10, 10))], "clip string, place long, value double")
    assert [round(r.smooth, 3) for r in tracking.smoothed(v, ["clip"], "clip string").orderBy("place").collect()] == [0.0, 3.0, 5.1]
    v = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate((50, 52, 58, 90, 90))], "clip string, place long, value double")
    assert [r.center for r in tracking.followed(v, ["clip"], "clip string", 20.0, 100.0).orderBy("place").collect()] == [50.0, 50.0, 53.0, 68.0, 83.0]
    face = lambda x, s: (float(x), 0.0, 10.0, 10.0, s)
    data = [("c", 0, [face(10, 100.0), face(80, 90.0)]), ("c", 1, [face(11, 100.0), face(80, 200.0)]), ("c", 2, [face(80, 5000.0), face(12, 1.0)]), ("c", 3, []), ("c", 40, [face(80, 1.0)])]
    f = spark.createDataFrame(data, "clip string, place long, faces array<struct<x: double, y: double, w: double, h: double, score: double>>")
    assert [r.face for r in tracking.speaking_face(f, ["clip"], "clip string", 100.0).orderBy("place").collect()] == [0, 0, 0, None, 2]
    data = [("c", i / 10, [20.0, 0.0] if i < 15 else [0.0, 20.0], 0.1) for i in range(40)] + [("c", 9.0, None, 0.1)]
    m = spark.createDataFrame(data, "clip string, place double, moves array<double>, rms double")
    sides = [r.side for r in tracking.moving_mouth(m, ["clip"], "clip string").orderBy("place").collect()]
    assert sides[0] is None and sides[10] == 0 and sides[-2] == 1 and sides[-1] is None


def test_progress(spark):
    s = spark.createDataFrame([("s", i, float(e)) for i, e in enumerate((4, 6, 7, 30, 28, 100))] + [("t", i, 1.0) for i in range(60)], "source_id string, seg_idx int, end double")
    d = spark.createDataFrame([("s", 100.0)], "source_id string, duration double")
    assert rows(progress_marks(s, d)) == [("s", 1, 6), ("s", 3, 30), ("s", 5, 100), ("t", 49, None)]


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "talk.json").write_text('[{"start": "0", "end": 4, "text": "a", "extra": 1, "words": [{"start": 0, "end": 1, "text": "a"}]}, {"end": 2}]', encoding="utf-8")
    df = records.read_transcripts(spark, str(tmp_path / "talk.json"))
    assert [(r.source_id, r.seg_idx, r.start, r.end, r.text, len(r.words)) for r in df.collect()] == [("talk", 0, 0.0, 4.0, "a", 1)]
    (tmp_path / "s.json").write_text('{"clips": [{"start": 1, "end": 2, "score": "7"}]}', encoding="utf-8")
    r = records.read_scores(spark, str(tmp_path / "s.json")).first()
    assert (r.score, r.hook_score, r.title) == (7.0, 0.0, "")
    records.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    answers = spark.createDataFrame([("s", 'x {"clips": [{"i": "1", "start": "1.5", "end": 2}, {"start": "junk"}]} y'), ("t", "none")], "source_id string, answer string")
    assert rows(records.parsed_answers(answers).select("source_id", "entry_no", "echoed", "e_start")) == [("s", 0, "1", 1.5), ("s", 1, None, None)]
    (tmp_path / "v.MP4").write_bytes(b"12")
    assert [r.length for r in records.media_files(spark, str(tmp_path), (".mp4",)).collect()] == [2]


def _plain_greedy(clips, order, kept, most_overlap, most_alike):
    """Each clip against each kept one, in keep order."""
    dropped = {}
    for i in order:
        for k in kept:
            (s, e, x), (t, f, y) = clips[i], clips[k]
            if max(0.0, min(e, f) - max(s, t)) / min(e - s, f - t) > most_overlap:
                dropped[i] = "time"
                break
            if most_alike < 1 and x and y and len(x & y) / min(len(x), len(y)) >= most_alike:
                dropped[i] = "text"
                break
        else:
            kept.append(i)
    return dropped


@pytest.mark.parametrize("most_overlap,most_alike", [(0.15, 0.5), (0.0, 0.9), (0.6, 0.2), (1.0, 0.5), (0.15, 1.0), (0.3, 0.0), (-1.0, 0.5)])
def test_greedy_as_all_pairs(most_overlap, most_alike):
    for seed in range(40):
        r = random.Random(seed)
        clips = [(s := float(r.randint(0, 300)), s + r.choice((3.0, 10.0, 30.0, 90.0)), frozenset(r.sample("abcdefghijklmnopqrst", r.randint(0, 5)))) for _ in range(60)]
        order, kept, plain = r.sample(range(60), 60), [], []
        dropped = select.greedy(clips, order, kept, most_overlap, most_alike)
        assert dropped == _plain_greedy(clips, order, plain, most_overlap, most_alike) and kept == plain


def _plain_cover(clips, duration):
    left, at, order = list(range(len(clips))), 0.0, []
    while at < duration - 0.5:
        reach = [i for i in left if clips[i][1] > at + 0.5]
        near = [i for i in reach if at - 2.5 <= clips[i][0] <= at + 2.5] or [i for i in reach if at - 6 <= clips[i][0] < at - 2.5]
        later = [i for i in reach if clips[i][0] > at + 2.5]
        if not near and not later:
            break
        pick = max(near, key=lambda i: (min(clips[i][1], duration), clips[i][2])) if near else min(later, key=lambda i: (clips[i][0], -min(clips[i][1], duration)))
        left.remove(pick)
        order.append(pick)
        at = min(clips[pick][1], duration)
    return order


def test_cover_as_all_clips():
    for seed in range(60):
        r = random.Random(seed)
        clips = [(s := r.randint(0, 400) / 2, s + r.choice((1.0, 5.0, 30.0)), float(r.randint(1, 3))) for _ in range(r.randint(1, 80))]
        group = pd.DataFrame([("s", i, *c, 190.0) for i, c in enumerate(clips)], columns=["source_id", "ordinal", "start", "end", "score", "duration"])
        assert list(select._cover()(group)["ordinal"]) == _plain_cover(clips, 190.0)


def test_queries_decide_all_clips_of_a_source(spark, monkeypatch):
    from spanloom.plans import candidate_queries as q

    data = [("s", i, i * 10.0, i * 10.0 + 10, 50.0 + i % 7, f"clip number{i} of many.") for i in range(700)]
    monkeypatch.setattr(q, "_scored", lambda *_: spark.createDataFrame(data, CLIP).withColumn("clip_id", F.col("ordinal")))
    monkeypatch.setattr(q, "sound_segments", lambda *_: spark.createDataFrame([("s", 7000.0)], "source_id string, end double"))
    assert q.greedy(spark, "").filter("kept").count() == 700
    assert [r.clip_id for r in q.timeline_cover(spark, "").orderBy("place").collect()] == list(range(700))
    assert rows(q.final_clips(spark, "").select("clip_id")) == [(i,) for i in (6, 13, 20, 27, 34)]


def test_entries_without_a_batch(spark, monkeypatch):
    from spanloom.plans import text_queries as q

    entries = [("s", 0, i, 900.0 + i, 950.0, str(3 - i)) for i in range(4)] + [("s", None, 8, 50.0, 90.0, None), ("s", None, 9, 51.0, 90.0, "1")]
    assert methods(spark, 4, entries) == {i: (3 - i, "index") for i in range(4)} | {8: (1, "exact"), 9: (None, "dropped")}
    pool = [(1, "r", 0, 0.0, 10.0), (2, "r", 1, 20.0, 30.0)]
    clips = [(1, "r", 1, 0.0, 10.0), (2, "r", None, 20.0, 30.0), (3, "r", 99, 0.0, 10.0), (4, "r", None, 50.0, 60.0), (5, "other", 1, 0.0, 10.0)]
    monkeypatch.setattr(q, "candidates", lambda *_: spark.createDataFrame(pool, "cand_id long, run_id string, cand_idx int, start double, end double"))
    monkeypatch.setattr(q, "clips", lambda *_: spark.createDataFrame(clips, "clip_id long, run_id string, cand_id long, start double, end double"))
    assert rows(q.layered(spark, "")) == [("dropped", 2), ("exact", 3)]


def test_snapped_parts(spark):
    parts = spark.createDataFrame([("s", 0, 0.0, 9.5), ("s", 1, 9.5, 20.0), ("t", 0, 5.0, 30.0), ("v", 0, 7.0, 9.0), ("v", 1, 9.0, 30.0), ("u", 0, 0.0, 10.0), ("u", 1, 10.0, 20.0)], "source_id string, part_no int, start double, end double")
    words = spark.createDataFrame([("s", 8.0, 9.0), ("s", 11.0, 12.0), ("u", 9.5, 14.0)], "source_id string, w_start double, w_end double")
    pauses = spark.createDataFrame([("s", 10.0, 2.0)], "source_id string, moment double, gap double")
    found = snap.snapped_parts(parts, pauses, words)
    assert rows(found.select("source_id", "part_no", "start", "end")) == [("s", 0, 0.0, 10.0), ("s", 1, 10.0, 20.0), ("t", 0, 5.0, 30.0), ("u", 0, 0.0, 9.5), ("u", 1, 9.5, 20.0), ("v", 0, 7.0, 10.0), ("v", 1, 10.0, 30.0)]
    assert snap.snapped_parts(parts.limit(0), pauses, words).count() == 0


def test_edit_faults(spark):
    edits = spark.createDataFrame([("s", 0, 0.0, 5.0), ("s", 1, 9.0, 12.0), ("s", 1_500, 8.0, 9.0), ("s", 2_000, 9.0, 99.0), ("s", 2_001, None, 9.0), ("x", 0, 0.0, 1.0)], "source_id string, seg_idx int, start double, end double")
    d = spark.createDataFrame([("s", 50.0)], "source_id string, duration double")
    assert rows(match.edit_faults(edits, d)) == [("s", 1_500, "order"), ("s", 2_000, "times"), ("s", 2_001, "times"), ("x", 0, "times")]


def test_texts_of_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", i, f"line {i}") for i in (10, 2, 1)] + [("b", 0, "only")], "source_id string, seg_idx int, line string")
    records.write_lines(df, str(tmp_path / "out"), "source_id", ["seg_idx"], "line", head=records.ass_head(1080, 1920)[:2])
    read = lambda k: "".join(p.read_text() for p in sorted((tmp_path / "out" / f"source_id={k}").glob("part*"))).splitlines()
    assert read("a") == ["[Script Info]", "ScriptType: v4.00+", "line 1", "line 2", "line 10"] and read("b")[-1] == "only"
    assert "Style: Caption,Arial,86," in "\n".join(records.ass_head(1080, 1920))


def test_targets_of_a_run(spark, tmp_path):
    for name in ("b.MP4", "a.mkv", "c.txt"):
        (tmp_path / name).write_text("x")
    assert [p.rsplit("/", 1)[1] for p in records.batch_targets(spark, folder=str(tmp_path))] == ["a.mkv", "b.MP4"]
    (tmp_path / "none").mkdir()
    for bad in ({}, {"file": "x", "folder": "y"}, {"folder": str(tmp_path / "missing")}, {"file": str(tmp_path / "c.txt")}, {"folder": str(tmp_path / "none")}):
        with pytest.raises(ValueError):
            records.batch_targets(spark, **bad)
