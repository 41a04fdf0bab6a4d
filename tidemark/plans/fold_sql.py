"""SQL of queries whose operators are folds: one recursive step for each row."""

from __future__ import annotations

from tidemark.plans.signal_queries import _VALLEY
from tidemark.plans.text_queries import _ABN, _prep

_IV = "iv AS (SELECT user_id AS stream, event_id AS id, event_type AS kind, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) AS s, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) + 1 + cast(floor(value * 300) AS bigint) AS e FROM events)"
_COST = "round(0.65 * abs(v.center - {target}) / greatest(1e-6, {soft} - {low}) + 0.20 * v.mean + 0.10 * v.p95 - 0.05 * least(1.0, v.\"end\" - v.start), 9)"

ORACLE = {
    "stabilize_blocks": f"""WITH RECURSIVE {_IV}, a AS (SELECT stream, id, s::double AS s, e::double AS e, row_number() OVER (PARTITION BY stream ORDER BY s, e, id) AS n, lag(e::double) OVER (PARTITION BY stream ORDER BY s, e, id) AS pe FROM iv),
      t AS (SELECT stream, id, n, s AS moved, NULL::double AS meet, e FROM a WHERE n = 1 UNION ALL
        SELECT a.stream, a.id, a.n, CASE WHEN a.s + 1e-9 < a.pe AND t.moved + 1e-6 < a.e - 1e-6 THEN least(greatest((a.pe + a.s) / 2, t.moved + 1e-6), a.e - 1e-6) ELSE a.s END,
          CASE WHEN a.s + 1e-9 < a.pe AND t.moved + 1e-6 < a.e - 1e-6 THEN least(greatest((a.pe + a.s) / 2, t.moved + 1e-6), a.e - 1e-6) END, a.e FROM t JOIN a ON a.stream = t.stream AND a.n = t.n + 1)
      SELECT stream, id, round(moved, 3) AS s, round(coalesce(lead(meet) OVER (PARTITION BY stream ORDER BY n), e), 3) AS e FROM t""",
    "dedup_reconcile": f"""WITH RECURSIVE {_IV}, a AS (SELECT stream, kind, id, id % 3 AS win, s, e, round(greatest(0, least(id % 50, id % 70)), 6) AS edge, row_number() OVER (PARTITION BY stream, kind ORDER BY s, e, id % 3, id) AS n FROM iv),
      t AS (SELECT stream, kind, n, 0 AS grp, id, win, s, e, edge, 0 AS dup FROM a WHERE n = 1 UNION ALL
        SELECT stream, kind, n, grp + 1 - same, CASE WHEN same = 1 AND NOT better THEN tid ELSE id END, CASE WHEN same = 1 AND NOT better THEN twin ELSE win END, CASE WHEN same = 1 AND NOT better THEN ts ELSE s END, CASE WHEN same = 1 AND NOT better THEN te ELSE e END, CASE WHEN same = 1 AND NOT better THEN tedge ELSE edge END, CASE WHEN same = 1 THEN dup + 1 ELSE 0 END FROM (
          SELECT a.*, t.grp, t.id AS tid, t.win AS twin, t.s AS ts, t.e AS te, t.edge AS tedge, t.dup, CASE WHEN t.win != a.win AND least(t.e, a.e) > greatest(t.s, a.s) AND 2 * (least(t.e, a.e) - greatest(t.s, a.s)) >= least(t.e - t.s, a.e - a.s) THEN 1 ELSE 0 END AS same,
            (a.edge, -a.win) > (t.edge, -t.win) AS better FROM t JOIN a ON a.stream = t.stream AND a.kind = t.kind AND a.n = t.n + 1))
      SELECT stream, kind AS norm, arg_max(id, n) AS id, arg_max(dup, n)::bigint AS duplicates FROM t GROUP BY stream, kind, grp""",
    "download_speed": f"""WITH RECURSIVE {_IV}, a AS (SELECT stream, id, CASE WHEN kind = 'error' THEN 0 ELSE e - s END::double AS amount, row_number() OVER (PARTITION BY stream ORDER BY id) AS n FROM iv),
      t AS (SELECT stream, id, amount, n, amount AS speed FROM a WHERE n = 1 UNION ALL SELECT a.stream, a.id, a.amount, a.n, CASE WHEN a.amount > 0 THEN CASE WHEN t.speed <= 0 THEN a.amount ELSE 0.65::double * t.speed + 0.35::double * a.amount END WHEN t.speed * 0.5 < 1 THEN 0 ELSE t.speed * 0.5 END FROM t JOIN a ON a.stream = t.stream AND a.n = t.n + 1)
      SELECT stream, id, amount, floor(speed * 1000)::bigint AS speed FROM t""",
    "best_valley": f"""WITH {_VALLEY}, v AS (SELECT stream, center, start, "end", round(mean, 6) AS mean, round(p95, 6) AS p95 FROM val), q AS (SELECT stream, frame AS ask, frame + 15 AS low, frame + 60 AS soft, frame + 90 AS up, frame + 45 AS target FROM sig),
      r AS (SELECT q.stream, ask, v.center, row_number() OVER (PARTITION BY q.stream, ask ORDER BY v.center > soft, {_COST.format(target='target', soft='soft', low='low')}, v.center) AS n FROM q JOIN v ON v.stream = q.stream AND v.center BETWEEN low AND up) SELECT stream, ask, center FROM r WHERE n = 1""",
    "abnormal_share": f"WITH {_prep('documents')} SELECT source, count(*) AS n, round(avg(CASE WHEN {_ABN} THEN 1 ELSE 0 END), 6) AS share FROM p GROUP BY source",
    "normalize_text": r"SELECT doc_id, md5(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')) AS digest FROM documents",
}
