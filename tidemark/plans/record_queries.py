"""Queries of the smaller operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import intervals as iv
from tidemark.operators import records as ops
from tidemark.operators import segment
from tidemark.operators import signal as sg
from tidemark.sources.frames import intervals, signal, table

LONGEST = 7200


def _windows(spark, d):
    cores = iv.split_max(iv.merge(intervals(spark, d, "view"), 300).select("stream", "s", "e"), LONGEST)
    return cores.select("stream", F.col("s").alias("win"), "s", "e", (F.col("s") - 90).alias("in_s"), (F.col("e") + 90).alias("in_e"))


def token_candidates(spark, d):
    return ops.token_candidates(_windows(spark, d), intervals(spark, d, "click").select("stream", "id", "s", "e"))


def core_claimed(spark, d):
    return ops.claimed(_windows(spark, d), token_candidates(spark, d))


def same_occurrence(spark, d):
    return ops.same_occurrence(intervals(spark, d).select("stream", F.col("kind").alias("norm"), "id", (F.col("id") % 3).alias("win"), "s", "e"))


def best_valley(spark, d):
    """The best valley for a window that begins at each frame of the signal."""
    track = sg.smooth_centered(signal(spark, d), 5).withColumn("smooth", F.round("smooth", 6))
    found = sg.valleys(track, 0.3, 2).selectExpr("stream", "center", "end - start AS width", "round(mean, 6) AS mean", "round(p95, 6) AS p95")
    asks = signal(spark, d).select("stream", F.col("frame").alias("ask"), (F.col("frame") + 15).alias("low"), (F.col("frame") + 60).alias("soft"), (F.col("frame") + 90).alias("up"), (F.col("frame") + 45).alias("target"))
    return ops.best_valley(asks, found, 64)


def interval_ratios(spark, d):
    return ops.interval_ratios(intervals(spark, d), 2_678_400).withColumns({c: F.round(c, 6) for c in ("unique_ratio", "span_ratio")})


def manifest_verify(spark, d):
    """Suppliers as expected files, customers as those present."""
    made = lambda t, k: table(spark, d, t).select(F.concat(F.lit("f"), F.col(f"{k}_{t[:4]}key" if t == "supplier" else f"{k}_custkey").cast("string")).alias("name"), F.col(f"{k}_nationkey").cast("long").alias("size"), F.sha2((F.col(f"{k}_{t[:4]}key" if t == "supplier" else f"{k}_custkey") % (3 if t == "supplier" else 9)).cast("string"), 256).alias("sha"))
    return ops.verified_files(made("supplier", "s"), made("customer", "c"))


def comparison_report(spark, d):
    body = F.format_string('{"%s": [[%d.5, %d.75], [%d.0, %d.25]], "all": [[0.5, %d.5]]}', "lang", F.col("doc_id"), F.col("doc_id") + 1, F.col("n_chars"), F.col("n_chars") + 2, F.col("doc_id"))
    return ops.report_rows(table(spark, d, "documents").select(F.col("doc_id").alias("report_id"), body.alias("body")), "body")


def subtitle_track(spark, d):
    items = intervals(spark, d).select("stream", "id", F.when(F.col("kind") == "view", 1).when(F.col("kind") == "click", 2).otherwise(3).alias("track"), (F.col("stream") % 2 == F.when(F.col("kind") == "view", 0).otherwise(F.col("stream") % 2)).alias("enabled"), (F.col("s") * 25).alias("start_frame"), (F.col("e") * 25).alias("end_frame"), F.lit(1_704_067_200 * 25 + 1000).cast("long").alias("base_frame"))
    return ops.track_items(items, F.lit(25.0))


def render_range(spark, d):
    n = F.col("o_orderkey")
    mark = lambda k, m: F.when(n % m == k, n * m)
    marks = table(spark, d, "orders").select(n.alias("id"), mark(0, 5).alias("video_in"), mark(0, 5).alias("video_out"), mark(1, 7).alias("audio_in"), mark(1, 7).alias("audio_out"), mark(2, 3).alias("both_in"), F.when((n % 3 == 2) & (n % 11 != 0), n * 3).alias("both_out"))
    return ops.render_range(marks)


def error_class(spark, d):
    e = F.col("event_id")
    said = F.concat(F.when(e % 5 == 0, "CUDA error: ").when(e % 5 == 1, "RuntimeError: Out of Memory ").when(e % 5 == 2, "MPS backend ").otherwise("ValueError "), F.col("event_type"))
    return table(spark, d, "events").select("event_id", ops.error_class(said).alias("cls"), F.concat(F.col("event_type"), F.when(e % 4 == 0, "!").otherwise("-1")).rlike(r"^[A-Za-z0-9_-]+\z").alias("valid_id"))


def paging(spark, d):
    return ops.pages(intervals(spark, d), 150)


def find_next(spark, d):
    return ops.next_match(intervals(spark, d), F.col("kind") == "error")


def download_speed(spark, d):
    return ops.speeds(intervals(spark, d).select("stream", "id", F.when(F.col("kind") == "error", 0).otherwise(F.col("e") - F.col("s")).alias("amount"))).withColumn("speed", F.floor(F.col("speed") * 1000))


def global_totals(spark, d):
    return intervals(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("seconds"), F.bool_and(F.col("e") > F.col("s")).alias("all_valid"), F.max(F.col("e") - F.col("s")).alias("peak"))


def text_statistics(spark, d):
    """Letters and digits, numeric continuations across blanks, and characters of CJK scripts."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")).cast("long").alias("lexical"), F.regexp_count(t, F.lit(r"\d[.,] \d")).cast("long").alias("continued"), F.length(F.regexp_replace(t, r"[^\x{1100}-\x{11FF}\x{2E80}-\x{2FFF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]", "")).cast("long").alias("cjk"))


def block_scores(spark, d):
    """Fill score and fragment width of each line of documents at 42 columns."""
    n = F.length(F.col("t")).cast("long")
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return lines.select("doc_id", F.col("i").cast("long").alias("line"), n.alias("units"), segment.fragment_column(n).alias("fragment"), segment.fill_column(n, 42).alias("fill"))


def union_recovered(spark, d):
    """Views and, of the errors, those that no click of the stream overlaps."""
    first = intervals(spark, d, "view").select("stream", "s", "e")
    return first.unionByName(iv.unclaimed(intervals(spark, d, "error"), intervals(spark, d, "click")))


def reason_list(spark, d):
    """Different kinds of a stream in the order of first sight."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "kind"))), lambda x: x.kind)
    return intervals(spark, d).groupBy("stream").agg(F.array_join(F.array_distinct(ordered), ",").alias("kinds"))


def abnormal_share(spark, d):
    """Share of abnormal texts by source."""
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(tx.abnormal(F.col("text")).cast("int")), 6).alias("share"))


QUERIES = {f.__name__: f for f in (token_candidates, core_claimed, same_occurrence, best_valley, interval_ratios, manifest_verify, comparison_report, subtitle_track, render_range, error_class, paging, find_next, download_speed, global_totals, text_statistics, block_scores, union_recovered, reason_list, abnormal_share)}

_IV = "iv AS (SELECT user_id AS stream, event_id AS id, event_type AS kind, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) AS s, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) + 1 + cast(floor(value * 300) AS bigint) AS e FROM events)"
_WIN = f"""WITH {_IV}, v AS (SELECT * FROM iv WHERE kind = 'view'), m AS (SELECT stream, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN reach IS NULL OR s >= reach + 300 THEN 1 ELSE 0 END AS new FROM (SELECT stream, s, e, max(e) OVER (PARTITION BY stream ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v))) GROUP BY stream, island),
  k AS (SELECT *, unnest(range(0, e - s, {LONGEST})) AS o FROM m), w AS (SELECT stream, s + o AS win, s + o AS s, least(e, s + o + {LONGEST}) AS e FROM k),
  cand AS (SELECT w.stream, w.win, c.id, greatest(0, least(c.s - w.s + 90, w.e + 90 - c.e)) AS edge_distance FROM w JOIN iv c ON c.kind = 'click' AND c.stream = w.stream AND c.s < w.e AND w.s < c.e)"""
_LETTERS = r"[^\p{L}\p{N}]"

ORACLE = {
    "token_candidates": f"{_WIN} SELECT * FROM cand",
    "core_claimed": f"{_WIN} SELECT stream, win, EXISTS (SELECT 1 FROM cand c WHERE c.stream = w.stream AND c.win = w.win) AS claimed FROM w",
    "same_occurrence": f"WITH {_IV} SELECT a.id AS a, b.id AS b FROM iv a JOIN iv b ON a.stream = b.stream AND a.kind = b.kind AND a.id < b.id AND a.id % 3 != b.id % 3 AND a.s < b.e AND b.s < a.e WHERE 2 * (least(a.e, b.e) - greatest(a.s, b.s)) >= least(a.e - a.s, b.e - b.s)",
    "interval_ratios": f"WITH {_IV} SELECT stream, round(count(DISTINCT (s, e)) / count(*), 6) AS unique_ratio, round((max(e) - min(s)) / 2678400, 6) AS span_ratio FROM iv GROUP BY stream",
    "manifest_verify": "SELECT 'f' || s_suppkey AS name, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN s_nationkey != c_nationkey THEN 'size' WHEN s_suppkey % 3 != c_custkey % 9 THEN 'hash' ELSE 'ok' END AS state FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey",
    "comparison_report": """SELECT doc_id AS report_id, lang AS language, 1 AS idx, doc_id + 0.5::double AS start, doc_id + 1.75::double AS "end" FROM documents UNION ALL SELECT doc_id, lang, 2, n_chars::double, n_chars + 2.25::double FROM documents UNION ALL SELECT doc_id, 'all', 1, 0.5::double, doc_id + 0.5::double FROM documents""",
    "subtitle_track": f"""WITH {_IV}, t AS (SELECT *, CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS track, kind != 'view' OR stream % 2 = 0 AS enabled FROM iv), f AS (SELECT *, min(track) FILTER (enabled) OVER (PARTITION BY stream) AS first FROM t)
      SELECT stream, id, round(greatest(0.0, (s * 25 - 42601681000) / 25.0), 6)::double AS start, round(greatest(0.0, (e * 25 - 42601681000) / 25.0), 6)::double AS "end" FROM f WHERE enabled AND track = first""",
    "render_range": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 11 = 0 THEN 'partial' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 1 OR o_orderkey % 3 = 2 THEN 'marked' ELSE 'whole' END AS kind,
      CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_orderkey * 5 WHEN o_orderkey % 7 = 1 THEN o_orderkey * 7 WHEN o_orderkey % 3 = 2 THEN o_orderkey * 3 END AS start,
      CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_orderkey * 5 WHEN o_orderkey % 7 = 1 THEN o_orderkey * 7 WHEN o_orderkey % 3 = 2 THEN o_orderkey * 3 END AS "end" FROM orders""",
    "error_class": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'cuda' WHEN 1 THEN 'memory' WHEN 2 THEN 'mps' ELSE 'other' END AS cls, event_id % 4 != 0 AS valid_id FROM events",
    "paging": f"WITH {_IV}, a AS (SELECT stream, id, row_number() OVER (PARTITION BY stream ORDER BY id) - 1 AS n FROM iv) SELECT stream, id, n // 150 AS page, n % 150 AS place FROM a",
    "find_next": f"WITH {_IV}, a AS (SELECT stream, id, CASE WHEN kind = 'error' THEN id END AS hit FROM iv) SELECT stream, id, coalesce(min(hit) OVER (PARTITION BY stream ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(hit) OVER (PARTITION BY stream)) AS next FROM a",
    "global_totals": f"WITH {_IV} SELECT count(*) AS n, sum(e - s)::bigint AS seconds, bool_and(e > s) AS all_valid, max(e - s) AS peak FROM iv",
    "text_statistics": f"SELECT doc_id, length(regexp_replace(text, '{_LETTERS}', '', 'g')) AS lexical, len(regexp_extract_all(text, '\\d[.,] \\d')) AS continued, length(regexp_replace(text, '[^\\x{{1100}}-\\x{{11FF}}\\x{{2E80}}-\\x{{2FFF}}\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}]', '', 'g')) AS cjk FROM documents",
    "union_recovered": f"WITH {_IV} SELECT stream, s, e FROM iv WHERE kind = 'view' UNION ALL SELECT DISTINCT stream, s, e FROM iv r WHERE kind = 'error' AND NOT EXISTS (SELECT 1 FROM iv c WHERE c.kind = 'click' AND c.stream = r.stream AND c.s < r.e AND r.s < c.e)",
    "reason_list": f"WITH {_IV}, f AS (SELECT stream, kind, min(id) AS id FROM iv GROUP BY stream, kind) SELECT stream, string_agg(kind, ',' ORDER BY id) AS kinds FROM f GROUP BY stream",
    "block_scores": """WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS line FROM a), c AS (SELECT doc_id, line, length(t) AS n FROM b)
      SELECT doc_id, line, n AS units, CASE WHEN n <= 2 THEN 1 ELSE least(8, greatest(4, n // 4)) END AS fragment, cast(round_even(30 * least(1.0, n / 42), 0) - round_even(20 * (1 - least(1.0, n / 42)) ** 2, 0) AS bigint) AS fill FROM c""",
}
