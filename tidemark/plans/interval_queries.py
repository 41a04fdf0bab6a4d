"""Interval queries over ``events`` and their SQL."""

from __future__ import annotations

from tidemark.operators import intervals as ops
from tidemark.sources.frames import intervals

GAP, EDGE, LONGEST, CONTEXT = 300, 300, 600, 600


def _regions(spark, d):
    return ops.merge(intervals(spark, d, "view"), GAP)


def _claims(spark, d):
    return intervals(spark, d, "click")


def interval_merge(spark, d):
    return ops.merge(intervals(spark, d), GAP)


def interval_merge_inclusive(spark, d):
    return ops.merge(intervals(spark, d), 0, inclusive=True)


def interval_intersect(spark, d):
    return ops.intersect(_regions(spark, d), _claims(spark, d))


def interval_unclaimed(spark, d):
    return ops.unclaimed(_regions(spark, d), _claims(spark, d))


def interval_unclaimed_edges(spark, d):
    return ops.unclaimed_edges(_regions(spark, d), _claims(spark, d), EDGE)


def interval_covered_amount(spark, d):
    return ops.covered(_regions(spark, d), _claims(spark, d))


def interval_split_max(spark, d):
    return ops.split_max(intervals(spark, d), LONGEST).select("stream", "id", "s", "e")


def interval_split_boundaries(spark, d):
    return ops.split_at(_regions(spark, d), intervals(spark, d, "error").selectExpr("stream", "s AS t"), LONGEST)


def interval_max_overlap_gap(spark, d):
    found = ops.max_overlap(ops.gaps(_regions(spark, d)), ops.merge(intervals(spark, d, "purchase"), GAP))
    return found.selectExpr("stream", "s", "e", "longest", "longest >= 300 AS evidence", "longest >= 3000 AS forced")


def interval_diagnostics(spark, d):
    return ops.diagnostics(intervals(spark, d), 1_706_000_000)


def interval_containment(spark, d):
    return ops.contained(_regions(spark, d), ops.merge(intervals(spark, d, "signup"), GAP))


def interval_context_clip(spark, d):
    return ops.with_context(_regions(spark, d), ops.merge(intervals(spark, d, "error"), GAP), CONTEXT)


def interval_remaining_holes(spark, d):
    """Speech inside the cores that stayed unclaimed, merged."""
    cores = ops.unclaimed(_regions(spark, d), _claims(spark, d))
    return ops.merge(ops.intersect(cores, intervals(spark, d, "signup")), GAP)


def remove_gaps(spark, d):
    return ops.remove_gaps(intervals(spark, d))


def frame_snap(spark, d):
    return ops.snap(intervals(spark, d), 30000, 1001, unit=1)


def anchor_boundaries(spark, d):
    return ops.anchors(intervals(spark, d), 10, 1_900_000_000)


def pause_score(spark, d):
    return ops.pauses(intervals(spark, d))


QUERIES = {f.__name__: f for f in (interval_merge, interval_merge_inclusive, interval_intersect, interval_unclaimed, interval_unclaimed_edges, interval_covered_amount, interval_split_max, interval_split_boundaries, interval_max_overlap_gap, interval_diagnostics, interval_containment, interval_context_clip, interval_remaining_holes, remove_gaps, frame_snap, anchor_boundaries, pause_score)}

IV = "iv AS (SELECT user_id AS stream, event_id AS id, event_type AS kind, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) AS s, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) + 1 + cast(floor(value * 300) AS bigint) AS e FROM events)"


def _merged(name: str, source: str, gap: int = GAP, op: str = ">=") -> str:
    return f"""{name} AS (SELECT stream, min(s) AS s, max(e) AS e, count(*) AS n FROM (
      SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN reach IS NULL OR s {op} reach + {gap} THEN 1 ELSE 0 END AS new FROM (
          SELECT stream, s, e, max(e) OVER (PARTITION BY stream ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source})))
      GROUP BY stream, island)"""


_R = f"WITH {IV}, v AS (SELECT * FROM iv WHERE kind = 'view'), c AS (SELECT * FROM iv WHERE kind = 'click'), {_merged('r', 'v')}"
_OVER = "c.stream = r.stream AND c.s < r.e AND r.s < c.e"

ORACLE = {
    "interval_merge": f"WITH {IV}, {_merged('m', 'iv')} SELECT stream, s, e, n FROM m",
    "interval_merge_inclusive": f"WITH {IV}, {_merged('m', 'iv', 0, '>')} SELECT stream, s, e, n FROM m",
    "interval_intersect": f"{_R} SELECT r.stream, r.s AS region_s, c.id, greatest(r.s, c.s) AS s, least(r.e, c.e) AS e FROM r JOIN c ON {_OVER}",
    "interval_unclaimed": f"{_R} SELECT stream, s, e FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE {_OVER})",
    "interval_unclaimed_edges": f"{_R}, x AS (SELECT r.stream, r.s, r.e, max(least(c.e, r.e)) FILTER (c.s IS NOT NULL) AS l FROM r LEFT JOIN c ON {_OVER} GROUP BY ALL) SELECT stream, coalesce(l, s) AS s, e FROM x WHERE l IS NULL OR e - l >= {EDGE}",
    "interval_covered_amount": f"{_R} SELECT r.stream, r.s, r.e, coalesce(sum(least(c.e, r.e) - greatest(c.s, r.s)) FILTER (c.s IS NOT NULL), 0)::bigint AS covered FROM r LEFT JOIN c ON {_OVER} GROUP BY ALL",
    "interval_split_max": f"WITH {IV}, k AS (SELECT *, unnest(range(0, e - s, {LONGEST})) AS o FROM iv) SELECT stream, id, s + o AS s, least(e, s + o + {LONGEST}) AS e FROM k",
    "interval_split_boundaries": f"""{_R}, b AS (SELECT DISTINCT stream, s AS t FROM iv WHERE kind = 'error'),
      p AS (SELECT stream, s AS rs, e AS re, s AS x FROM r UNION ALL SELECT r.stream, r.s, r.e, t FROM r JOIN b ON b.stream = r.stream AND t > r.s AND t < r.e),
      q AS (SELECT stream, x AS s, coalesce(lead(x) OVER (PARTITION BY stream, rs, re ORDER BY x), re) AS e FROM p), k AS (SELECT *, unnest(range(0, e - s, {LONGEST})) AS o FROM q)
      SELECT stream, s + o AS s, least(e, s + o + {LONGEST}) AS e FROM k""",
    "interval_max_overlap_gap": f"""{_R}, p AS (SELECT * FROM iv WHERE kind = 'purchase'), {_merged('m', 'p')},
      g AS (SELECT stream, e AS s, lead(s) OVER (PARTITION BY stream ORDER BY s, e) AS e FROM r),
      x AS (SELECT g.stream, g.s, g.e, coalesce(max(least(m.e, g.e) - greatest(m.s, g.s)) FILTER (m.s IS NOT NULL), 0) AS longest FROM g LEFT JOIN m ON m.stream = g.stream AND m.s < g.e AND g.s < m.e WHERE g.e > g.s GROUP BY ALL)
      SELECT *, longest >= 300 AS evidence, longest >= 3000 AS forced FROM x""",
    "interval_diagnostics": f"""WITH {IV}, x AS (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM iv WINDOW w AS (PARTITION BY stream ORDER BY id))
      SELECT stream, count_if(e <= s)::bigint AS invalid, count_if(s < 0 OR e > 1706000000)::bigint AS out_of_bounds, count_if(s < ps)::bigint AS non_monotonic, count_if(s < pe)::bigint AS overlapping, count(*) AS n FROM x GROUP BY stream""",
    "interval_containment": f"{_R}, t AS (SELECT * FROM iv WHERE kind = 'signup'), {_merged('m', 't')} SELECT stream, s, e FROM r WHERE EXISTS (SELECT 1 FROM m WHERE m.stream = r.stream AND m.s < r.s AND m.e >= r.e)",
    "interval_context_clip": f"""{_R}, t AS (SELECT * FROM iv WHERE kind = 'error'), {_merged('m', 't')}
      SELECT r.stream, r.s, r.e, greatest(r.s - {CONTEXT}, coalesce(max(m.e) FILTER (m.e <= r.s), r.s - {CONTEXT})) AS input_s, least(r.e + {CONTEXT}, coalesce(min(m.s) FILTER (m.s >= r.e), r.e + {CONTEXT})) AS input_e
      FROM r LEFT JOIN m ON m.stream = r.stream GROUP BY r.stream, r.s, r.e""",
    "interval_remaining_holes": f"""{_R}, u AS (SELECT stream, s, e FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE {_OVER})),
      h AS (SELECT u.stream, greatest(u.s, i.s) AS s, least(u.e, i.e) AS e FROM u JOIN iv i ON i.kind = 'signup' AND i.stream = u.stream AND i.s < u.e AND u.s < i.e), {_merged('m', 'h')} SELECT stream, s, e, n FROM m""",
    "remove_gaps": f"WITH {IV}, x AS (SELECT *, lead(s) OVER (PARTITION BY stream ORDER BY s, e, id) AS nx FROM iv) SELECT stream, id, s, CASE WHEN nx > s THEN nx ELSE e END AS e FROM x",
    "frame_snap": f"""WITH {IV}, a AS (SELECT stream, id, s, e, cast(floor(s * 30000 / 1001.0) AS bigint) AS fs, cast(ceil(e * 30000 / 1001.0) AS bigint) AS fe, row_number() OVER w AS i FROM iv WINDOW w AS (PARTITION BY stream ORDER BY s, e, id)),
      b AS (SELECT *, i + max(greatest(fe, fs + 1) - i) OVER (PARTITION BY stream ORDER BY i ROWS UNBOUNDED PRECEDING) AS end_frame FROM a)
      SELECT stream, id, greatest(fs, coalesce(lag(end_frame) OVER (PARTITION BY stream ORDER BY i), fs)) AS start_frame, end_frame FROM b""",
    "anchor_boundaries": f"""WITH {IV}, a AS (SELECT stream, id, row_number() OVER w AS p, count(*) OVER (PARTITION BY stream) AS n, (e + lead(s) OVER w) // 2 AS middle FROM iv WINDOW w AS (PARTITION BY stream ORDER BY s, e, id))
      SELECT stream, id, p, p * 10 + least(1900000000 - n * 10, greatest(0, max(middle - p * 10) OVER (PARTITION BY stream ORDER BY p ROWS UNBOUNDED PRECEDING))) AS boundary FROM a WHERE middle IS NOT NULL""",
    "pause_score": f"""WITH {IV}, x AS (SELECT stream, id, coalesce(greatest(0, lead(s) OVER (PARTITION BY stream ORDER BY s, e, id) - e), 0) AS pause FROM iv)
      SELECT stream, id, pause, CASE WHEN pause >= 800 THEN 100 WHEN pause >= 500 THEN 40 WHEN pause >= 300 THEN 8 ELSE 0 END AS score FROM x""",
}
