"""SQL of the sequential queries: recursive CTEs that carry what a fold would keep."""

from __future__ import annotations

from spanloom.plans.bases import CLIPS, SEGS, SOUND, WORDS, strip_sql

_MS = lambda c, name: f"TRY_CAST(floor({c} * 1000 + 0.5) AS BIGINT) AS {name}"
_DURATIONS = f'd AS (SELECT source_id, max(TRY_CAST(floor("end" * 1000 + 0.5) AS BIGINT)) / 1000 AS duration FROM segs WHERE {SOUND} GROUP BY ALL)'
_MARKS = r"[\x{0610}-\x{061a}\x{064b}-\x{065f}\x{0670}\x{06d6}-\x{06ed}\x{0640}]"
_WORD_CHAR = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"


def tokens_sql(text: str) -> str:
    plain = f"lower(regexp_replace(coalesce({text}, ''), '{_MARKS}', '', 'g'))"
    return rf"list_filter(regexp_extract_all({plain}, '[0-9A-Za-z\x{{0600}}-\x{{06FF}}]+'), lambda x: length(x) > 1)"


def shingles_sql(t: str) -> str:
    """Distinct runs of eight of the list ``t``, or all of a shorter one as one."""
    return f"CASE WHEN len({t}) = 0 THEN []::VARCHAR[] WHEN len({t}) < 8 THEN [array_to_string({t}, ' ')] ELSE list_distinct(list_transform(range(1, len({t}) - 6), lambda i: array_to_string({t}[i : i + 7], ' '))) END"


# Accepted clips with their shingles, whole (sh) and of the part that is left of those over a minute (sh_cut).
_BLANKS = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]+"
_ACCEPTED = f"""{CLIPS}, w0 AS (SELECT *, regexp_extract_all(lower(trim(coalesce(text, ''), ' ')), '{_WORD_CHAR}') AS words, {strip_sql("coalesce(text, '')")} AS t FROM clips
  WHERE {SOUND} AND score IS NOT NULL AND "end" - start >= 3 AND score >= 40),
w1 AS (SELECT *, len(list_filter(words, lambda x: x IN ('um', 'uh', 'like', 'اه', 'امم'))) AS fillers, len(words) AS n, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') AS said FROM w0),
acc0 AS (SELECT source_id, clip_id AS o, start AS s, "end" AS e, score * CASE WHEN t = '' OR (regexp_matches(t, '[.!?؟]') AND NOT regexp_matches(t, '[.!?؟…]$')) THEN 0.85::DOUBLE ELSE 1::DOUBLE END AS score,
  {tokens_sql('text')} AS tok, {tokens_sql("array_to_string(said[1 : greatest(1, CAST(round_even(len(said) * (60::DOUBLE / (\"end\" - start)), 0) AS INTEGER))], ' ')")} AS tok_cut
  FROM w1 WHERE NOT (n = 0 OR (n <= 3 AND fillers >= greatest(1, n - 1)))),
acc AS (SELECT source_id, o, s, e, score, {shingles_sql('tok')} AS sh, CASE WHEN e - s > 60 THEN s + 60 ELSE e END AS e_cut, CASE WHEN e - s > 60 THEN {shingles_sql('tok_cut')} ELSE {shingles_sql('tok')} END AS sh_cut FROM acc0)"""


def _passes(p: str, end: str, sh: str) -> str:
    """Two recursions: by falling score, then, short of five, by time; {p}2 has kept and why of each source."""
    time = "least(c.{e}, k.e) - greatest(c.s, k.s) > 0 AND least(c.{e} - c.s, k.e - k.s) > 0 AND (least(c.{e}, k.e) - greatest(c.s, k.s)) / least(c.{e} - c.s, k.e - k.s) > 0.15::DOUBLE".replace("{e}", end)
    text = f"len(c.{sh}) > 0 AND len(k.sh) > 0 AND len(list_intersect(c.{sh}, k.sh)) / least(len(c.{sh}), len(k.sh)) >= 0.5"
    why = f"list_transform(list_filter(r.kept, lambda k: ({time}) OR ({text})), lambda k: CASE WHEN {time} THEN 'time' ELSE 'text' END)[1]"
    mine = f"[{{'o': c.o, 's': c.s, 'e': c.{end}, 'sh': c.{sh}}}]"
    return f"""{p}o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, o) AS rn, count(*) OVER (PARTITION BY source_id) AS all_ FROM acc),
{p}1 AS (
  SELECT DISTINCT source_id, 0::BIGINT AS rn, []::STRUCT(o BIGINT, s DOUBLE, e DOUBLE, sh VARCHAR[])[] AS kept, []::STRUCT(o BIGINT, why VARCHAR)[] AS why FROM acc
  UNION ALL SELECT r.source_id, c.rn, CASE WHEN x.why IS NULL THEN list_concat(r.kept, {mine}) ELSE r.kept END, CASE WHEN x.why IS NULL THEN r.why ELSE list_concat(r.why, [{{'o': c.o, 'why': x.why}}]) END
  FROM {p}1 r JOIN {p}o c ON c.source_id = r.source_id AND c.rn = r.rn + 1, LATERAL (SELECT {why} AS why) x),
{p}e AS (SELECT source_id, kept, why FROM {p}1 r WHERE rn = (SELECT max(rn) FROM {p}o c WHERE c.source_id = r.source_id)),
{p}r AS (SELECT c.*, row_number() OVER (PARTITION BY source_id ORDER BY s, o) AS n2 FROM acc c JOIN {p}e e USING (source_id) WHERE NOT list_contains(list_transform(e.kept, lambda k: k.o), c.o)),
{p}2 AS (
  SELECT source_id, 0::BIGINT AS n2, kept, why FROM {p}e
  UNION ALL SELECT r.source_id, c.n2, CASE WHEN x.why IS NULL AND len(r.kept) < 5 THEN list_concat(r.kept, {mine}) ELSE r.kept END, r.why
  FROM {p}2 r JOIN {p}r c ON c.source_id = r.source_id AND c.n2 = r.n2 + 1, LATERAL (SELECT {why} AS why) x),
{p}f AS (SELECT source_id, arg_max(kept, n2) AS kept, arg_max(why, n2) AS why FROM {p}2 GROUP BY source_id)"""


GREEDY = f"""WITH RECURSIVE {_ACCEPTED}, {_passes('a', 'e', 'sh')}, {_passes('b', 'e_cut', 'sh_cut')},
chosen AS (SELECT source_id, CASE WHEN len(a.kept) < 5 AND len(b.kept) > len(a.kept) THEN b.kept ELSE a.kept END AS kept, CASE WHEN len(a.kept) < 5 AND len(b.kept) > len(a.kept) THEN b.why ELSE a.why END AS why FROM af a JOIN bf b USING (source_id))"""
_KEPT = "list_contains(list_transform(kept, lambda k: k.o), c.o)"

CAPTIONS = rf"""WITH RECURSIVE {WORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY w_start, w_end, word) AS rn FROM spoken),
p AS (SELECT *, lag(w_end) OVER w AS e0, lag(word) OVER w AS word0 FROM o WINDOW w AS (PARTITION BY source_id ORDER BY rn)),
i AS (SELECT *, sum(CASE WHEN e0 IS NULL OR w_start - e0 >= 0.45::DOUBLE OR regexp_matches(word0, '[.!?؟…]$') THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY rn) AS island FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id, island ORDER BY rn) AS k FROM i),
walk AS (
  SELECT source_id, island, k, rn, 1 AS words, length(word) AS size, rn AS first FROM n WHERE k = 1
  UNION ALL SELECT n.source_id, n.island, n.k, n.rn, CASE WHEN x.full_ THEN 1 ELSE r.words + 1 END, CASE WHEN x.full_ THEN length(n.word) ELSE r.size + 1 + length(n.word) END, CASE WHEN x.full_ THEN n.rn ELSE r.first END
  FROM walk r JOIN n ON n.source_id = r.source_id AND n.island = r.island AND n.k = r.k + 1, LATERAL (SELECT r.words >= 5 OR r.size + length(n.word) > 42 AS full_) x)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY first) - 1 AS INTEGER) AS caption_no, arg_min(w_start, n.rn) AS start, arg_max(w_end, n.rn) AS "end", string_agg(word, ' ' ORDER BY n.rn) AS text
FROM walk JOIN n USING (source_id, island, k) GROUP BY source_id, first"""

CHUNKS = f"""WITH RECURSIVE {SEGS}, t AS (SELECT source_id, seg_idx, trim(coalesce(text, ''), ' ') AS t FROM segs),
l AS (SELECT source_id, seg_idx AS place, '[' || CAST(seg_idx AS VARCHAR) || '] ' || CASE WHEN length(t) > 1800 THEN substr(t, 1, 1400) || ' [excerpt shortened] ' || right(t, 350) ELSE t END AS line,
  row_number() OVER (PARTITION BY source_id ORDER BY seg_idx) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM t),
walk AS (
  SELECT source_id, 0 AS step, 0::BIGINT AS rn, []::STRUCT(p INTEGER, line VARCHAR)[] AS rows_, NULL::STRUCT(p INTEGER, line VARCHAR)[] AS sent, false AS over_ FROM l WHERE rn = 1
  UNION ALL SELECT r.source_id, r.step + 1, CASE WHEN x.full_ THEN r.rn ELSE r.rn + 1 END,
    CASE WHEN l.line IS NULL THEN [] WHEN x.full_ THEN list_filter(r.rows_, lambda y: y.p >= greatest(r.rows_[1].p + 1, r.rows_[-1].p - 1)) ELSE list_concat(r.rows_, [{{'p': l.place, 'line': l.line}}]) END,
    CASE WHEN l.line IS NULL OR x.full_ THEN r.rows_ END, l.line IS NULL
  FROM walk r LEFT JOIN l ON l.source_id = r.source_id AND l.rn = r.rn + 1,
    LATERAL (SELECT coalesce(len(r.rows_) > 0 AND coalesce(list_sum(list_transform(r.rows_, lambda y: length(y.line) + 1)), 0) + length(l.line) > 4500, false) AS full_) x WHERE NOT r.over_)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY step) - 1 AS INTEGER) AS chunk_no, sent[1].p AS first, sent[-1].p + 1 AS last, array_to_string(list_transform(sent, lambda y: y.line), chr(10)) AS text
FROM walk WHERE len(sent) > 0"""

PARTS = f"""WITH RECURSIVE {WORDS}, {_DURATIONS},
gaps AS (SELECT source_id, w_start, lag(w_end) OVER (PARTITION BY source_id, seg_idx ORDER BY w_start, w_end, word_idx) AS before FROM spoken),
p AS (SELECT source_id, list({{'m': before + (w_start - before) / 2, 'g': w_start - before}}) AS pauses FROM gaps WHERE w_start - before >= 0.25 GROUP BY ALL),
w AS (SELECT source_id, list({{'s': w_start, 'e': w_end}} ORDER BY w_start, w_end) AS said FROM spoken GROUP BY ALL),
c AS (SELECT source_id, duration, least(greatest(1, CAST(ceil(duration / 60) AS INTEGER)), greatest(1, CAST(floor(duration / 3) AS INTEGER))) AS n, coalesce(pauses, []) AS pauses, coalesce(said, []) AS said FROM d LEFT JOIN p USING (source_id) LEFT JOIN w USING (source_id) WHERE duration > 0),
walk AS (
  SELECT source_id, 1 AS i, [0::DOUBLE] AS edges FROM c
  UNION ALL SELECT r.source_id, r.i + 1, CASE WHEN z.at_ > r.edges[-1] THEN list_concat(r.edges, [z.at_]) ELSE r.edges END
  FROM walk r JOIN c USING (source_id), LATERAL (SELECT r.i * c.duration / c.n AS target, r.edges[-1] + 3 AS low, c.duration - 3::DOUBLE * (c.n - r.i) AS high) b,
    LATERAL (SELECT list_sort(list_transform(list_filter(c.pauses, lambda y: abs(y.m - b.target) <= 2.5 AND y.m >= b.low AND y.m <= b.high), lambda y: {{'g': y.g, 'd': -abs(y.m - b.target), 'n': -y.m}}))[-1].n AS best, least(greatest(b.target, b.low), b.high) AS plain) x,
    LATERAL (SELECT list_filter(c.said, lambda y: y.s < x.plain AND x.plain < y.e)[1] AS word) v,
    LATERAL (SELECT list_filter([v.word.s, v.word.e], lambda y: y >= b.low AND y <= b.high) AS fits) u,
    LATERAL (SELECT CASE WHEN x.best IS NOT NULL THEN -x.best WHEN v.word IS NULL OR len(u.fits) = 0 THEN x.plain WHEN len(u.fits) = 1 OR abs(u.fits[1] - x.plain) <= abs(u.fits[2] - x.plain) THEN u.fits[1] ELSE u.fits[2] END AS at_) z
  WHERE r.i < c.n),
ends AS (SELECT source_id, list_concat(arg_max(edges, i), [any_value(duration)]) AS edges FROM walk JOIN c USING (source_id) GROUP BY source_id),
cuts AS (SELECT source_id, unnest(range(1, len(edges))) AS k, edges FROM ends)
SELECT source_id, CAST(k - 1 AS INTEGER) AS part_no, {_MS('edges[k]', 'start_ms')}, {_MS('edges[k + 1]', 'end_ms')} FROM cuts"""

COVER = f"""WITH RECURSIVE {SEGS}, {CLIPS}, d AS (SELECT source_id, max("end") AS duration FROM segs WHERE {SOUND} GROUP BY ALL),
c AS (SELECT source_id, clip_id AS o, start AS s, least("end", duration) AS e, "end" AS raw, score, duration FROM clips JOIN d USING (source_id) WHERE {SOUND} AND score IS NOT NULL),
g AS (SELECT source_id, any_value(duration) AS duration, list({{'e': e, 'score': score, 'n': -o, 's': s, 'raw': raw}}) AS cs FROM c GROUP BY source_id),
walk AS (
  SELECT source_id, 0 AS place, 0::DOUBLE AS at_, NULL::BIGINT AS o FROM g
  UNION ALL SELECT r.source_id, r.place + 1, z.pick.e, -z.pick.n
  FROM walk r JOIN g USING (source_id), LATERAL (SELECT list_filter(g.cs, lambda y: y.raw > r.at_ + 0.5) AS reach) a,
    LATERAL (SELECT list_sort(list_filter(a.reach, lambda y: y.s >= r.at_ - 2.5 AND y.s <= r.at_ + 2.5))[-1] AS near, list_sort(list_filter(a.reach, lambda y: y.s >= r.at_ - 6 AND y.s < r.at_ - 2.5))[-1] AS behind,
      list_sort(list_transform(list_filter(g.cs, lambda y: y.s > r.at_ + 2.5), lambda y: {{'s': -y.s, 'e': y.e, 'n': y.n}}))[-1] AS further) b,
    LATERAL (SELECT CASE WHEN b.near IS NOT NULL THEN {{'e': b.near.e, 'n': b.near.n}} WHEN b.behind IS NOT NULL THEN {{'e': b.behind.e, 'n': b.behind.n}} ELSE {{'e': b.further.e, 'n': b.further.n}} END AS pick) z
  WHERE r.at_ < g.duration - 0.5 AND z.pick.n IS NOT NULL)
SELECT source_id, o AS clip_id, CAST(place - 1 AS INTEGER) AS place FROM walk WHERE place > 0"""

_MOVED = "SELECT *, lag(w_end) OVER (PARTITION BY source_id, seg_idx ORDER BY w_start, w_end, word_idx) AS before FROM spoken"


def _edge(name: str, point: str, runs: str, start: bool) -> str:
    """Where a point of table ``name`` goes: the edges of the run that holds it, else of the nearest ones."""
    inner, outer = ("own_s, own_e", "next_s, prev_e") if start else ("own_e, own_s", "prev_e, next_s")
    near = lambda c, ok: f"CASE WHEN {ok} AND abs({c} - x.{point}) <= 2.5 THEN {c} END"
    holds = f"(a <= x.{point} AND b >= x.{point})"
    return f"""SELECT clip_id, CASE WHEN NOT on_edge THEN CASE WHEN within_ THEN coalesce({inner}) ELSE coalesce({outer}) END END AS moved FROM (
  SELECT x.clip_id, bool_or(abs(a - x.{point}) <= 1e-6 OR abs(b - x.{point}) <= 1e-6) AS on_edge, bool_or({holds}) AS within_, min({near('a', holds)}) AS own_s, min({near('b', holds)}) AS own_e,
    min({near('a', f'NOT {holds} AND a > x.{point}')}) AS next_s, max({near('b', f'NOT {holds} AND b < x.{point}')}) AS prev_e
  FROM {name} x JOIN {runs} USING (source_id) WHERE b >= x.{point} - 2.5 AND a <= x.{point} + 2.5 GROUP BY x.clip_id)"""


def _pause(name: str, point: str) -> str:
    return f"""SELECT x.clip_id, arg_max(m, {{'g': g, 'd': -abs(m - x.{point}), 'n': -m}}) AS moved FROM {name} x JOIN pauses USING (source_id)
  WHERE abs(m - x.{point}) > 1e-9 AND abs(m - x.{point}) <= 1.25 GROUP BY x.clip_id"""


def _inside(point: str, side: str) -> str:
    return f"""SELECT clip_id, b.{side} AS moved FROM (SELECT x.clip_id, x.{point} AS p, max({{'s': w_start, 'e': w_end}}) AS b FROM c0 x JOIN spoken w USING (source_id)
  WHERE w_end >= x.{point} AND w_start <= x.{point} GROUP BY ALL) WHERE b.s < p AND b.e > p"""


SNAPPED = f"""WITH {WORDS}, {CLIPS}, moved AS (SELECT source_id, CAST(floor(w_start * 1000 + 0.5) AS BIGINT) AS s, CAST(floor(w_end * 1000 + 0.5) AS BIGINT) + 449 AS e FROM spoken),
seen AS (SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM moved),
lab AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen),
runs AS (SELECT source_id, min(s) / 1000 AS a, (max(e) - 449) / 1000 AS b FROM lab GROUP BY source_id, island),
pauses AS (SELECT source_id, before + (w_start - before) / 2 AS m, w_start - before AS g FROM ({_MOVED}) WHERE w_start - before >= 0.25),
ends AS (SELECT source_id, max(w_end) AS lim FROM spoken GROUP BY ALL),
c0 AS (SELECT clip_id, source_id, start AS s, "end" AS e, lim FROM clips JOIN ends USING (source_id) WHERE {SOUND}),
ws AS ({_inside('s', 's')}), we AS ({_inside('e', 'e')}),
c1 AS (SELECT clip_id, source_id, coalesce(ws.moved, s) AS s, CASE WHEN least(we.moved, lim) > coalesce(ws.moved, s) AND we.moved IS NOT NULL THEN least(we.moved, lim) ELSE e END AS e, lim FROM c0 LEFT JOIN ws USING (clip_id) LEFT JOIN we USING (clip_id)),
ps AS ({_pause('c1', 's')}), pe AS ({_pause('c1', 'e')}),
c2a AS (SELECT clip_id, source_id, CASE WHEN ps.moved < e - 0.5 THEN ps.moved ELSE s END AS s, e, lim, pe.moved AS pe FROM c1 LEFT JOIN ps USING (clip_id) LEFT JOIN pe USING (clip_id)),
c2 AS (SELECT clip_id, source_id, s, CASE WHEN pe > s + 0.5 THEN pe ELSE e END AS e, lim FROM c2a),
rs AS ({_edge('c2', 's', 'runs', True)}), re AS ({_edge('c2', 'e', 'runs', False)}),
c3 AS (SELECT clip_id, CASE WHEN rs.moved < e THEN rs.moved ELSE s END AS s, e, lim, re.moved AS r FROM c2 LEFT JOIN rs USING (clip_id) LEFT JOIN re USING (clip_id))
SELECT clip_id, {_MS('s', 'start_ms')}, TRY_CAST(floor(CASE WHEN r > s AND r <= least(lim, s + 90) THEN r ELSE e END * 1000 + 0.5) AS BIGINT) AS end_ms FROM c3"""

SQL = {
    "greedy_select": GREEDY + f"""
SELECT source_id, o AS clip_id, {_KEPT} AS kept, CASE WHEN NOT {_KEPT} THEN list_filter(why, lambda x: x.o = c.o)[1].why END AS conflict FROM acc c JOIN chosen USING (source_id)""",
    "final_clips": GREEDY + f""",
best AS (SELECT source_id, o, s, list_filter(kept, lambda k: k.o = c.o)[1].e AS e, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, o) AS k FROM acc c JOIN chosen USING (source_id) WHERE {_KEPT})
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY s, o) AS INTEGER) AS index, o AS clip_id, {_MS('s', 'start_ms')}, {_MS('e', 'end_ms')} FROM best WHERE k <= 5""",
    "caption_groups": CAPTIONS, "budget_chunks": CHUNKS, "complete_parts": PARTS, "timeline_cover": COVER, "snapped_clips": SNAPPED,
}
