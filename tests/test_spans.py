import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators.periods import milliseconds, periods_and_gaps, sound_span
from spanloom.operators.spans import containing, coverage, micro_pauses, nearest_edges, overlap_join, overlap_ratio, speech_runs


def brute(spans):
    """Periods and gaps of (s, e)."""
    out, now = [], None
    for s, e in sorted(spans):
        if now and s <= now[1]:
            now[1] = max(now[1], e)
        else:
            if now:
                out += [("period", *now), ("gap", now[1], s)]
            now = [s, e]
    return sorted(out + ([("period", *now)] if now else []))


@pytest.mark.parametrize("slice_ms", [7, 50, 600_000])
def test_periods_against_brute_force(spark, slice_ms):
    random.seed(slice_ms)
    data = {k: [(s := random.randint(-200, 20_000), s + random.choice([0, 1, 5, 40, 300])) for _ in range(n)] for k, n in (("a", 300), ("b", 5), ("c", 60), (None, 40))}
    df = spark.createDataFrame([(k, s, e, "x") for k, v in data.items() for s, e in v + v[:3]], "k string, s long, e long, kind string")
    found = rows(periods_and_gaps(df, ["k"], "s", "e", slice_ms))
    assert found == sorted([(k, *x) for k, v in data.items() for x in brute(v)], key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def test_periods_of_bad_and_no_rows(spark):
    df = spark.createDataFrame([("a", None, 5), ("a", 5, None), ("a", 9, 3)], "k string, s long, e long")
    assert rows(periods_and_gaps(df, ["k"], "s", "e")) == []
    assert rows(periods_and_gaps(df.limit(0), ["k"], "s", "e")) == []


def test_sound_span_and_rounding(spark):
    df = spark.createDataFrame([(0.0005, 1.0), (float("nan"), 2.0), (None, 1.0), (2.0, 1.0), (1.0, float("inf")), (-3e12, 4e12)], "start double, end double")
    assert [r[0] for r in df.select(sound_span("start", "end")).collect()] == [True, False, False, False, True, True]
    assert df.limit(1).select(milliseconds("start")).first()[0] == 1


def test_spans_of_any_length_count(spark):
    """Spans of millions of years, beside others of a second, and infinite ones, whose ends are the last that there are."""
    df = spark.createDataFrame([("a", -3e12, 4e12), ("a", 5e12, 5e12 + 1.0), ("b", 0.0, float("inf"))], "k string, start double, end double")
    df = df.filter(sound_span("start", "end")).select("k", milliseconds("start").alias("s"), milliseconds("end").alias("e"))
    assert rows(periods_and_gaps(df, ["k"], "s", "e")) == [("a", "gap", 4 * 10**15, 5 * 10**15), ("a", "period", -3 * 10**15, 4 * 10**15), ("a", "period", 5 * 10**15, 5 * 10**15 + 1000), ("b", "period", 0, 2**61)]
    a = spark.createDataFrame([("s", 1, 0.0, 3e9), ("s", 2, 10.0, 20.0), ("s", 3, 1e6, 1e6 + 5.0)], "source_id string, i int, s double, e double")
    b = a.select("source_id", F.col("i").alias("j"), F.col("s").alias("t"), F.col("e").alias("f"))
    assert rows(overlap_join(a, b, ["source_id"], ("s", "e"), ("t", "f"), 0.5).select("i", "j")) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 3)]


def test_coverage_golden(spark):
    spans = spark.createDataFrame([("a", 0, 60_000), ("a", 58_000, 118_000)], "source_id string, s long, e long")
    d = spark.createDataFrame([("a", 120_000), ("none", 10), ("zero", 0)], "source_id string, duration_ms long")
    assert rows(coverage(spans, d, ["source_id"])) == [("a", 120_000, 118_000, 1, 2_000), ("none", 10, 0, 1, 10), ("zero", 0, 0, 0, 0)]


def words(start, n, source="s", seg=0):
    return [(source, seg, i, start + 0.45 * i, start + 0.45 * i + 0.4, f"w{i}") for i in range(n)]


WORDS = "source_id string, seg_idx int, word_idx int, w_start double, w_end double, word string"


def test_runs_split_at_the_threshold(spark):
    df = spark.createDataFrame(words(0.0, 8) + words(5.5, 6), WORDS)
    assert rows(speech_runs(df)) == [("s", 0, 3_550), ("s", 5_500, 8_150)]
    exact = spark.createDataFrame([("s", 0, 0, 0.0, 1.0, "a"), ("s", 0, 1, 1.449, 2.0, "b"), ("s", 0, 2, 2.45, 3.0, "c")], WORDS)
    assert rows(speech_runs(exact)) == [("s", 0, 2_000), ("s", 2_450, 3_000)]


def test_pauses_stay_within_a_segment(spark):
    df = spark.createDataFrame([("s", 0, 0, 0.0, 1.0, "a"), ("s", 0, 1, 1.5, 2.0, "b"), ("s", 1, 0, 9.0, 9.5, "c")], WORDS)
    assert rows(micro_pauses(df)) == [("s", 0, 1.25, 0.5)]


def test_overlap_join_against_brute_force(spark):
    random.seed(1)
    a = [(random.choice("xy"), i, s := random.random() * 500, s + random.random() * 90) for i in range(120)]
    b = [(random.choice("xy"), i, s := random.random() * 500, s + random.random() * 200) for i in range(90)]
    l, r = spark.createDataFrame(a, "k string, i int, s double, e double"), spark.createDataFrame(b, "k string, j int, s2 double, e2 double")
    found = {(x.i, x.j) for x in overlap_join(l, r, ["k"], ("s", "e"), ("s2", "e2"), 30.0).collect()}
    assert found == {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[3] > x[2] and y[2] < x[3]}
    assert overlap_join(l, r, ["k"], ("s", "e"), ("s2", "e2"), 30.0).count() == len(found)


def test_ratio_of_no_length_is_zero(spark):
    c = [F.lit(float(x)) for x in (1, 1, 0, 5)]
    assert spark.range(1).select(overlap_ratio(*c)).first()[0] == 0.0


def test_nearest_edges_and_containing(spark):
    random.seed(2)
    spans = [("s", x := random.randint(0, 5_000) * 1.0, x + random.randint(1, 400)) for _ in range(60)]
    points = [("s", i, random.randint(0, 5_500) * 1.0) for i in range(80)]
    g, p = spark.createDataFrame(spans, "source_id string, start double, end double"), spark.createDataFrame(points, "source_id string, point_id long, x double")
    for r in nearest_edges(p, g, "x", ("start", "end")).collect():
        assert r.prev_end == max((e for _, _, e in spans if e <= r.x), default=None)
        assert r.next_start == min((s for _, s, _ in spans if s >= r.x), default=None)
    for r in containing(p, g, "x", ("start", "end")).collect():
        assert (r.start, r.end) == min(((s, e) for _, s, e in spans if s <= r.x <= e), default=(None, None))


def test_word_windows_cross_segments(spark, monkeypatch):
    from spanloom.plans import candidate_queries as q

    r = random.Random(3)
    times = {s: [(float(i) + r.random() / 4, i + 0.5 + r.random() / 4) for i in range(n)] for s, n in (("a", 130), ("b", 45), ("c", 15))}
    data = [(s, k, [(x, y, "w") for x, y in ws[a : a + 7]]) for s, ws in times.items() for k, a in enumerate(range(0, len(ws), 7))]
    monkeypatch.setattr(q, "segments", lambda *_: spark.createDataFrame(data, "source_id string, seg_idx int, words array<struct<start: double, end: double, text: string>>"))
    wanted = set()
    for s, ws in times.items():
        for i in range(0, len(ws), max(1, len(ws) // 40)):
            last = max(k for k in range(i, len(ws)) if ws[k][1] - ws[i][0] <= 60)
            if ws[last][1] - ws[i][0] >= 20:
                wanted.add((s, i, last))
    found = {(x.source_id, x.first_word, x.last_word) for x in q.QUERIES["source_word_windows"](spark, "").collect()}
    assert found == wanted and len(found) > 20 and not q.word_fallback(spark, "").count()
