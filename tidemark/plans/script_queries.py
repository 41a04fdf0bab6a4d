"""Queries of recovery and of matching a given script, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import text as tx
from tidemark.operators import intervals as iv
from tidemark.operators import match, recovery, script
from tidemark.sources.frames import intervals, table

_DAYS = 2_678_400


def _regions(spark, d):
    return iv.merge(intervals(spark, d, "view"), 300).select("stream", "s", "e")


def auditable_spans(spark, d):
    """Speech cut at the ends of windows and by length."""
    ends = intervals(spark, d, "error").selectExpr("stream", "e AS t")
    return script.auditable(_regions(spark, d), ends, 900)


def recovery_holes(spark, d):
    """What recovery looks at: uncovered edges of auditable pieces, joined, cut by length."""
    ends = intervals(spark, d, "error").selectExpr("stream", "e AS t")
    return script.holes(_regions(spark, d), intervals(spark, d, "click"), ends, 900, 120, 300)


def recovery_context(spark, d):
    """Regions widened by 600 s, not into other speech, and by 30 s into speech that an edge lies in; with the speech inside."""
    base = F.lit(1_704_067_200)
    moved = lambda df: df.select("stream", (F.col("s") - base).alias("s"), (F.col("e") - base).alias("e"))
    return recovery.context_windows(moved(_regions(spark, d)), moved(iv.merge(intervals(spark, d, "error"), 300)), _DAYS, 600, 30)


def first_match(spark, d):
    """For each error the earliest unclaimed click or view of equal digit sum that overlaps it."""
    norm = (F.col("id") % 3).cast("string")
    records = intervals(spark, d, "click", "view").select("stream", F.col("id").alias("idx"), "s", "e", norm.alias("norm"), F.col("kind").alias("text"), (F.col("id") % 5 == 0).alias("claimed"))
    return recovery.first_match(intervals(spark, d, "error").select("stream", F.col("id").alias("win"), "s", (F.col("e") + 40_000).alias("e"), norm.alias("norm")), records)


def _lines(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("line"), "text")


def recovery_match(spark, d):
    """Later turns as recovery windows over the words of a conversation, 0.4 s each; some say something else."""
    words = _lines(spark, d).select("stream", "line", F.posexplode(tx.split_blank(F.col("text"))).alias("i", "text"))
    at = (F.row_number().over(W.partitionBy("stream").orderBy("line", "i")) - 1).cast("long")
    tokens = words.select("stream", at.alias("id"), "text").select("stream", "id", (F.col("id") * 4).alias("s"), (F.col("id") * 4 + 3).alias("e"), "text")
    span = tokens.select("stream", F.floor(F.col("id") / 6).alias("win"), "id", "text")
    windows = span.groupBy("stream", "win").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x.text), " ").alias("text"))
    windows = windows.select("stream", "win", (F.col("win") * 24).alias("s"), (F.col("win") * 24 + 24).alias("e"), F.when(F.col("win") % 4 == 3, "quite other words").otherwise(F.col("text")).alias("text"))
    anchors = windows.where("win % 8 = 3").select("stream", "win", F.col("text").alias("anchor_text"))
    return recovery.supported(windows, tokens, anchors, 10.0).select("stream", "win", "state", F.size("ids").alias("n"), F.array_min("ids").alias("first"))


def recovered_union(spark, d):
    """First and recovered tokens together: of accepted windows the recovered ones come and the first ones they took go."""
    first = intervals(spark, d, "view").select("stream", "id", "s", "e")
    new = intervals(spark, d, "click").select("stream", "id", "s", "e", (F.col("id") % 10).alias("win"))
    plan = first.select("stream", (F.col("id") % 10).alias("win"), "id").where("id % 3 = 0").groupBy("stream", "win").agg(F.collect_list("id").alias("ids"))
    accepted = new.select("stream", "win").distinct().where("win % 2 = 0")
    return recovery.moved(first, new, plan, accepted)


def prefix_removal(spark, d):
    """Words of a turn behind its first two words; where the prefix is a letter short no word ends there."""
    words = _lines(spark, d).select((F.col("stream") * 1000 + F.col("line")).alias("stream"), tx.split_blank(F.col("text")).alias("w"))
    size = F.length(F.regexp_replace(F.concat(F.get("w", F.lit(0)), F.coalesce(F.get("w", F.lit(1)), F.lit(""))), r"[^\p{L}\p{N}]", ""))
    tokens = words.where("size(w) > 2").select("stream", F.when(F.col("stream") % 5 == 0, 0).otherwise(size - F.when(F.col("stream") % 3 == 0, 1).otherwise(0)).alias("prefix"), F.posexplode("w").alias("ord", "text"))
    return recovery.without_prefix(tokens, F.regexp_replace("text", r"[^\p{L}\p{N}]", "")).select("stream", "ord", "text", "valid")


def _blocks(spark, d):
    order = W.partitionBy("stream").orderBy("s", "e", "id")
    base = F.min("s").over(W.partitionBy("stream"))
    return intervals(spark, d).select("stream", (F.row_number().over(order) - 1).cast("long").alias("id"), (F.col("s") - base).alias("s"), (F.col("e") - base).alias("e"))


def quality_gate(spark, d):
    """Why a direct alignment of each stream is not taken, with the rule's own thresholds: events in hours as blocks, some crushed."""
    blocks = _blocks(spark, d).select("stream", "id", (F.col("s") / 3600.0).alias("s"), F.when(F.col("id") % 97 == 5, F.col("s") / 3600.0 + 0.25).otherwise(F.col("s") / 3600.0 + 0.5 + F.col("id") % 3).alias("e"), (F.col("id") % 20).alias("units"))
    k = F.col("stream")
    tokens = blocks.select("stream", F.when(k % 4 == 1, F.floor(F.col("s") / 24)).otherwise(F.col("s")).alias("s"), F.when(k % 4 == 1, F.floor(F.col("s") / 24) + 1).otherwise(F.col("e")).alias("e"))
    n = blocks.groupBy("stream").agg(F.count(F.lit(1)).alias("n"))
    streams = n.select("stream", (k % 9 != 8).alias("valid"), F.when(k % 9 == 8, F.when(k % 2 == 0, "TOKEN_OUT_OF_BOUNDS:3")).alias("error"), (F.lit(1.0) - (k % 5) * 0.01).alias("coverage"), (F.lit(0.97) + (k % 4) * 0.01).alias("mapped"), (k % 6 == 5).cast("int").alias("unmapped"), (F.col("n") + (k % 11 == 10).cast("int")).alias("n_lines"), F.lit(500).alias("n_characters"), (F.lit(700.0) + (k % 3) * 1000).alias("duration"))
    got = script.direct_quality(streams, tokens, blocks)
    return got.select("stream", F.array_join("reasons", ",").alias("reasons"), "passed", F.round("unique_ratio", 6).alias("unique_ratio"), F.round("span_ratio", 6).alias("span_ratio"), F.size("collapsed").alias("n_collapsed"))


def script_frames(spark, d):
    """Events of a stream, a tenth as long, on frames of 29.97 a second, cut to the stream's length."""
    blocks = _blocks(spark, d).select("stream", "id", (F.col("s") * 100).alias("s"), (F.col("e") * 100 - 9).alias("e"))
    durations = blocks.groupBy("stream").agg((F.max("e") / 1000.0 - F.when(F.col("stream") % 4 == 0, 0.01).otherwise(-1.0)).alias("duration"))
    return script.on_frames(blocks, durations, 30000, 1001).select("stream", "id", "start_frame", "end_frame", F.round("e", 6).alias("e"), "fault")


def frames_without_gaps(spark, d):
    frames = iv.snap(intervals(spark, d), 30000, 1001, unit=1)
    return script.without_gaps(frames)


def lines_preserved(spark, d):
    """Whether the lines of a conversation came through; some lost their last, some were trimmed."""
    lines = _lines(spark, d)
    last = F.max("line").over(W.partitionBy("stream"))
    blocks = lines.withColumn("last", last).where("stream % 5 != 1 OR line < last").select("stream", F.col("line").alias("id"), F.when(F.col("stream") % 7 == 2, F.substring("text", 1, 10)).otherwise(F.col("text")).alias("text"))
    return script.preserved(blocks, lines)


def run_metrics(spark, d):
    """Counts and sums of windows by why they end, their lengths, and the real-time factor; a run of no length has none."""
    w = _blocks(spark, d).select("stream", F.col("id").alias("idx"), "s", "e", F.element_at(F.array(F.lit("probability_valley"), F.lit("hard_max"), F.lit("end_of_audio")), (F.col("id") % 3 + 1).cast("int")).alias("reason"))
    elapsed = w.select("stream").distinct().select("stream", F.lit(1000.0).alias("elapsed"), F.when(F.col("stream") % 4 == 0, 0).otherwise(F.col("stream") * 7).cast("double").alias("duration"))
    return script.metrics(w, elapsed)


def coverage_total(spark, d):
    """Coverage of whole documents, from that of their lines: words without k and q."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("stream"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("stream", F.col("line").cast("long").alias("line"), tx.split_blank(F.lower("t")).alias("w")).where("size(w) > 0")
    return match.total_coverage(match.word_coverage(words, lambda w: ~w.rlike("[kq]"))).select("stream", "complete", "total", F.round("coverage", 6).alias("coverage"))


def anchor_plan(spark, d):
    """Windows of a conversation's lines, from rough times that overlap, go back, or lie outside; some lines of some are not mapped."""
    k, i = F.col("stream"), F.col("line")
    lines = _lines(spark, d).select("stream", F.col("line").cast("long").alias("line"), F.lit(1.0).alias("coverage"), F.when((k % 9 != 4) | (i != 1), i * 0.5 + (k * 7 + i * 13) % 10 / 4 - 0.5).alias("start"))
    lines = lines.withColumn("end", F.col("start") + 0.25 + (k + i) % 4 / 2)
    durations = lines.groupBy("stream").agg((F.count(F.lit(1)) * 0.5 + 0.75).alias("duration"))
    out = script.anchor_plan(lines, durations)
    return out.select("stream", "line", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def alignment_validity(spark, d):
    """Whether the words of turns, in order in even times, are an alignment of the turn; some are late, some say something else."""
    turns = _lines(spark, d).select((F.col("stream") * 1000 + F.col("line")).alias("stream"), F.col("text").alias("transcript"), F.lit(0.0).alias("low"), F.lit(1000.0).alias("high"))
    k = F.col("stream")
    words = turns.select("stream", F.posexplode(tx.split_blank(F.col("transcript"))).alias("id", "text"))
    tokens = words.select("stream", F.col("id").cast("long").alias("id"), (F.col("id") * 0.4 - F.when((k % 7 == 2) & (F.col("id") == 3), 2).otherwise(0)).alias("s"), (F.col("id") * 0.4 + F.when((k % 5 == 1) & (F.col("id") == 2), 5000).otherwise(0.35)).alias("e"), F.when((k % 3 == 0) & (F.col("id") % 2 == 1), "zzzz").otherwise(F.col("text")).alias("text"))
    return match.validated(turns, tokens).select("stream", F.round("coverage", 6).alias("coverage"), "error")


def alignment_window(spark, d):
    """What recovery windows are aligned on: events as cores in a wider input."""
    e = intervals(spark, d).select("stream", "id", F.col("s").alias("core_s"), F.col("e").alias("core_e"), (F.col("s") - 50).alias("in_s"), (F.col("e") + 70).alias("in_e"), (F.col("id") % 900).alias("speech"), (F.col("id") % 2 == 0).alias("recovery"), F.when(F.col("id") % 3 == 0, "recovery_suffix").otherwise("recovery").alias("reason"), (F.col("id") % 5).alias("prefix"))
    return recovery.alignment_windows(e).select("id", "in_s", "in_e", "speech")


def repair_alignment(spark, d):
    """Words of a turn decoded on a coarse time grid: every third has no length, some begin or end outside, some go back."""
    rows = _lines(spark, d).select((F.col("stream") * 1000 + F.col("line")).alias("stream"), F.posexplode(tx.split_blank(F.col("text"))).alias("ord", "text"))
    k, i = F.col("stream"), F.col("ord")
    start = F.floor(i / 3) * 0.24 + F.when(i % 3 > 0, 0.16).otherwise(0.0)
    end = F.floor(i / 3) * 0.24 + F.when(i % 3 == 2, 0.24).otherwise(0.16)
    n = F.count(F.lit(1)).over(W.partitionBy("stream"))
    first = F.when((i == 0) & (k % 4 == 1), -0.1).when((i == 0) & (k % 7 == 3), -0.3).when((i == 5) & (k % 11 == 4), 0.0).otherwise(start)
    tokens = rows.select("stream", F.col("ord").cast("long").alias("ord"), "text", first.alias("start"), end.alias("end"), F.lit(0.0).alias("in_s"), (F.floor((n - 1) / 3) * 0.24 + 0.16).alias("in_e"))
    return match.repaired(tokens).select("stream", "ord", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "fault")


def restore_punctuation(spark, d):
    """Bare words of a turn with the marks of its text."""
    rows = _lines(spark, d).select((F.col("stream") * 1000 + F.col("line")).alias("stream"), F.concat(F.lit("«"), "text", F.lit("».,")).alias("text"), F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    return match.with_punctuation(rows).select("stream", F.array_join("restored", " ").alias("restored"))


QUERIES = {f.__name__: f for f in (auditable_spans, recovery_holes, recovery_context, first_match, recovery_match, recovered_union, prefix_removal, quality_gate, script_frames, frames_without_gaps, lines_preserved, run_metrics, coverage_total, anchor_plan, alignment_validity, alignment_window, repair_alignment, restore_punctuation)}

_TOK = r"list_filter(string_split_regex({x}, '[ \t\n\x0B\f\r]+'), lambda t: t != '')"
_IV = "iv AS (SELECT user_id AS stream, event_id AS id, event_type AS kind, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) AS s, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) + 1 + cast(floor(value * 300) AS bigint) AS e FROM events)"


def _merged(source: str, gap: int, name: str) -> str:
    return f"""{name}_r AS (SELECT *, max(e) OVER (PARTITION BY stream ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({source})), {name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_r),
      {name} AS (SELECT stream, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY stream, island)"""


_REG = f"{_IV}, {_merged('''SELECT stream, s, e FROM iv WHERE kind = 'view' ''', 300, 'reg')}"
_PIECES = f"""{_REG}, cut AS (SELECT DISTINCT r.stream, r.s AS rs, r.e AS re, x.e AS t FROM reg r JOIN iv x ON x.kind = 'error' AND x.stream = r.stream AND x.e > r.s AND x.e < r.e UNION SELECT stream, s, e, s FROM reg),
      seg AS (SELECT stream, t AS s, coalesce(lead(t) OVER (PARTITION BY stream, rs, re ORDER BY t), re) AS e FROM cut), pc AS (SELECT stream, s + o AS s, least(e, s + o + 900) AS e FROM (SELECT *, unnest(range(0, e - s, 900)) AS o FROM seg))"""
_NUMBERED = f"{_IV}, bl AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY s, e, id) - 1 AS id, s - min(s) OVER (PARTITION BY stream) AS s, e - min(s) OVER (PARTITION BY stream) AS e FROM iv)"
_FAULTS = """ft AS (SELECT stream, count_if(e <= s + 1e-6) AS invalid, count_if(s < -1e-6 OR e > duration + 1e-6) AS oob, count_if(s + 1e-6 < ps) AS nonmono, count_if(s + 1e-6 < pe) AS over_ FROM (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM {src} WINDOW w AS (PARTITION BY stream ORDER BY id)) GROUP BY stream)"""

ORACLE = {
    "frames_without_gaps": f"""WITH RECURSIVE {_IV}, a AS (SELECT stream, id, s * 30000 // 1001 AS fs, (e * 30000 + 1000) // 1001 AS fe, row_number() OVER (PARTITION BY stream ORDER BY s, e, id) AS n FROM iv),
      t AS (SELECT stream, id, n, fs AS a, greatest(fe, fs + 1) AS b FROM a WHERE n = 1 UNION ALL SELECT a.stream, a.id, a.n, greatest(fs, t.b), greatest(fe, greatest(fs, t.b) + 1) FROM t JOIN a ON a.stream = t.stream AND a.n = t.n + 1)
      SELECT stream, id, a AS start_frame, coalesce(lead(a) OVER (PARTITION BY stream ORDER BY n), b) AS end_frame FROM t""",
    "anchor_plan": """WITH RECURSIVE a AS (SELECT conv_id AS stream, turn AS line, CASE WHEN conv_id % 9 != 4 OR turn != 1 THEN turn * 0.5::double + (conv_id * 7 + turn * 13) % 10 / 4::double - 0.5 END AS st, 0.25::double + (conv_id + turn) % 4 / 2::double AS len, count(*) OVER w * 0.5::double + 0.75 AS d, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WINDOW w AS (PARTITION BY conv_id)),
      b AS (SELECT *, greatest(0, st) AS s, least(d, st + len) AS e, bool_or(st IS NULL) OVER (PARTITION BY stream) AS lost FROM a), c AS (SELECT *, (e + lead(s) OVER (PARTITION BY stream ORDER BY p)) / 2 AS mid FROM b WHERE NOT lost),
      t AS (SELECT stream, line, p, n, d, 0::double AS a, CASE WHEN n = 1 THEN d ELSE least(greatest(mid, 0.01), d - (n - 1) * 0.01) END AS b FROM c WHERE p = 1 UNION ALL
        SELECT c.stream, c.line, c.p, c.n, c.d, t.b, CASE WHEN c.p = c.n THEN c.d ELSE least(greatest(mid, t.b + 0.01), c.d - (c.n - c.p) * 0.01) END FROM t JOIN c ON c.stream = t.stream AND c.p = t.p + 1)
      SELECT stream, line::bigint AS line, round(a, 6) AS start, round(b, 6) AS "end" FROM t""",
    "alignment_window": f"WITH {_IV}, a AS (SELECT *, id % 2 = 0 AND id % 3 = 0 AND id % 5 = 0 AS alone FROM iv) SELECT id, CASE WHEN alone THEN s ELSE s - 50 END AS in_s, CASE WHEN alone THEN e ELSE e + 70 END AS in_e, CASE WHEN alone THEN least(id % 900, e - s) ELSE id % 900 END AS speech FROM a",
    "auditable_spans": f"WITH {_PIECES} SELECT * FROM pc",
    "recovery_holes": f"""WITH {_PIECES}, cl AS (SELECT p.stream, p.s, p.e, max(CASE WHEN c.e IS NOT NULL THEN least(c.e, p.e) END) AS last_ FROM pc p LEFT JOIN iv c ON c.kind = 'click' AND c.stream = p.stream AND c.s < p.e AND p.s < c.e GROUP BY ALL), op AS (SELECT stream, coalesce(last_, s) AS s, e FROM cl WHERE last_ IS NULL OR e - last_ >= 120),
      {_merged('SELECT * FROM op', 300, 'h')} SELECT stream, s + o AS s, least(e, s + o + 900) AS e FROM (SELECT *, unnest(range(0, e - s, 900)) AS o FROM h)""",
    "recovery_context": f"""WITH {_REG}, {_merged("SELECT stream, s, e FROM iv WHERE kind = 'error'", 300, 'sp')}, r AS (SELECT stream, s - 1704067200 AS s, e - 1704067200 AS e FROM reg), p AS (SELECT stream, s - 1704067200 AS s, e - 1704067200 AS e FROM sp)
      SELECT r.stream, r.s, r.e, greatest(0, r.s - 600, coalesce(max(CASE WHEN p.e <= r.s AND p.e > r.s - 600 THEN p.e WHEN p.s < r.s AND p.e > r.s THEN r.s - 30 END), 0)) AS input_s,
        least({_DAYS}, r.e + 600, coalesce(min(CASE WHEN p.s >= r.e AND p.s < r.e + 600 THEN p.s WHEN p.s < r.e AND p.e > r.e THEN r.e + 30 END), {_DAYS})) AS input_e, coalesce(sum(greatest(0, least(r.e, p.e) - greatest(r.s, p.s))), 0)::bigint AS speech FROM r LEFT JOIN p ON p.stream = r.stream GROUP BY r.stream, r.s, r.e""",
    "first_match": f"WITH {_IV}, m AS (SELECT w.stream, w.id AS win, c.id AS anchor, c.kind AS anchor_text, row_number() OVER (PARTITION BY w.stream, w.id ORDER BY c.id) AS n FROM iv w JOIN iv c ON c.kind IN ('click', 'view') AND c.id % 5 != 0 AND c.stream = w.stream AND c.id % 3 = w.id % 3 AND c.s < w.e + 40000 AND w.s < c.e WHERE w.kind = 'error') SELECT stream, win, anchor, anchor_text FROM m WHERE n = 1",
    "recovered_union": f"""WITH {_IV}, acc AS (SELECT DISTINCT stream, id % 10 AS win FROM iv WHERE kind = 'click' AND id % 10 % 2 = 0) SELECT stream, id, s, e, false AS recovered FROM iv WHERE kind = 'view' AND NOT (id % 3 = 0 AND EXISTS (SELECT 1 FROM acc WHERE acc.stream = iv.stream AND acc.win = id % 10))
      UNION ALL SELECT stream, id, s, e, true FROM iv WHERE kind = 'click' AND id % 10 % 2 = 0""",
    "prefix_removal": rf"""WITH a AS (SELECT conv_id * 1000 + turn AS stream, {_TOK.format(x='text')} AS w FROM conversations), b AS (SELECT stream, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS ord, length(regexp_replace(w[1] || w[2], '[^\p{{L}}\p{{N}}]', '', 'g')) AS size FROM a WHERE len(w) > 2),
      c AS (SELECT *, CASE WHEN stream % 5 = 0 THEN 0 ELSE size - CASE WHEN stream % 3 = 0 THEN 1 ELSE 0 END END AS prefix, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS n FROM b), e AS (SELECT *, sum(n) OVER (PARTITION BY stream ORDER BY ord) AS so_far FROM c),
      f AS (SELECT *, max(CASE WHEN so_far = prefix AND n > 0 THEN ord END) OVER (PARTITION BY stream) AS met FROM e) SELECT stream, ord, text, prefix = 0 OR met IS NOT NULL AS valid FROM f WHERE prefix = 0 OR met IS NULL OR ord > met""",
    "quality_gate": f"""WITH {_NUMBERED}, b AS (SELECT stream, id, s / 3600.0 AS s, CASE WHEN id % 97 = 5 THEN s / 3600.0 + 0.25 ELSE s / 3600.0 + 0.5 + id % 3 END AS e, id % 20 AS units, 700.0 + (stream % 3) * 1000 AS duration FROM bl),
      t AS (SELECT stream, CASE WHEN stream % 4 = 1 THEN floor(s / 24) ELSE s END AS s, CASE WHEN stream % 4 = 1 THEN floor(s / 24) + 1 ELSE e END AS e FROM b), u AS (SELECT stream, count(*) AS n, count(DISTINCT (round(s, 6), round(e, 6))) AS n_diff, max(e) - min(s) AS span FROM t GROUP BY stream),
      c AS (SELECT stream, count_if(e - s < 0.5 AND units / (e - s) > 24) AS n_collapsed FROM b GROUP BY stream), {_FAULTS.format(src='b')}, g AS (SELECT *, n_diff / n AS unique_ratio, greatest(0.0, span) / (700.0 + (stream % 3) * 1000) AS span_ratio FROM u JOIN c USING (stream) JOIN ft USING (stream)),
      r AS (SELECT *, concat_ws(',', CASE WHEN stream % 9 = 8 THEN CASE WHEN stream % 2 = 0 THEN 'TOKEN_OUT_OF_BOUNDS:3' ELSE 'ALIGNMENT_INVALID' END END, CASE WHEN 1.0 - (stream % 5) * 0.01 + 1e-9 < 0.98 THEN 'LOW_ALIGNMENT_COVERAGE' END, CASE WHEN 0.97 + (stream % 4) * 0.01 + 1e-9 < 0.98 THEN 'LOW_SCRIPT_MAPPING_COVERAGE' END,
        CASE WHEN stream % 6 = 5 OR stream % 11 = 10 THEN 'UNMAPPED_SCRIPT_LINES' END, CASE WHEN n >= 10 AND unique_ratio + 1e-9 < 0.8 THEN 'COLLAPSED_ALIGNMENT_INTERVALS' END, CASE WHEN span_ratio + 1e-9 < 0.35 THEN 'COMPRESSED_ALIGNMENT_SPAN' END, CASE WHEN n_collapsed > 0 THEN 'LOCALLY_COLLAPSED_SCRIPT_INTERVALS' END,
        CASE WHEN invalid > 0 THEN 'INVALID_SCRIPT_INTERVALS' END, CASE WHEN nonmono > 0 THEN 'NON_MONOTONIC_SCRIPT_INTERVALS' END, CASE WHEN over_ > 0 THEN 'OVERLAPPING_SCRIPT_INTERVALS' END, CASE WHEN oob > 0 THEN 'SCRIPT_INTERVAL_OUT_OF_BOUNDS' END) AS reasons FROM g)
      SELECT stream, reasons, reasons = '' AS passed, round(unique_ratio, 6) AS unique_ratio, round(span_ratio, 6)::double AS span_ratio, n_collapsed::int AS n_collapsed FROM r""",
    "script_frames": f"""WITH RECURSIVE {_NUMBERED}, a AS (SELECT stream, id, s * 100 AS s, e * 100 - 9 AS e, s * 3000000 // 1001000 AS fs, -(-(e * 100 - 9) * 30000 // 1001000) AS fe0, ((e * 100 - 9) * 30000) % 1001000 AS rem FROM bl), x AS (SELECT stream, id, s, e, fs, ((e * 30000) // 1001000) + CASE WHEN rem > 0 THEN 1 ELSE 0 END AS fe FROM a),
      du AS (SELECT stream, max(e) / 1000.0::double - CASE WHEN stream % 4 = 0 THEN 0.01 ELSE -1.0 END AS duration FROM a GROUP BY stream),
      t AS (SELECT stream, id, fs AS start_frame, greatest(fe, fs + 1) AS end_frame FROM x WHERE id = 0 UNION ALL SELECT x.stream, x.id, greatest(x.fs, t.end_frame), greatest(x.fe, greatest(x.fs, t.end_frame) + 1) FROM t JOIN x ON x.stream = t.stream AND x.id = t.id + 1),
      q AS (SELECT t.stream, t.id, start_frame, end_frame, start_frame * 1001 / 30000.0::double AS s, least(end_frame * 1001 / 30000.0::double, duration) AS e, duration FROM t JOIN du ON du.stream = t.stream), {_FAULTS.format(src='q')}
      SELECT stream, id, start_frame, end_frame, round(e, 6) AS e, CASE WHEN invalid > 0 THEN 'SCRIPT_MATCH_FRAME_QUANTIZATION_FAILED' WHEN nonmono + over_ + oob > 0 THEN 'SCRIPT_MATCH_QUANTIZED_INTERVALS_INVALID' ELSE '' END AS fault FROM q JOIN ft USING (stream)""",
    "lines_preserved": """WITH a AS (SELECT conv_id AS stream, turn, text, max(turn) OVER (PARTITION BY conv_id) AS last_, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), b AS (SELECT *, stream % 5 != 1 OR turn < last_ AS has, CASE WHEN stream % 7 = 2 THEN substr(text, 1, 10) ELSE text END AS shown FROM a)
      SELECT stream, count_if(has)::bigint AS n_blocks, count(*) AS n_lines, count_if(has AND shown = text)::bigint AS n_preserved, count_if(has) = count(*) AND count_if(has AND shown = text) = count(*) AS preserved FROM b GROUP BY stream""",
    "run_metrics": f"""WITH {_NUMBERED}, w AS (SELECT stream, id, e - s AS n FROM bl) SELECT stream, count(*) AS n_windows, count_if(id % 3 = 0)::bigint AS probability_valley, count_if(id % 3 = 1)::bigint AS hard_max, count_if(id % 3 = 2)::bigint AS end_of_audio, sum(n)::bigint AS seconds, max(n) AS longest,
      '[' || string_agg(n || '.0', ',' ORDER BY id) || ']' AS window_seconds, CASE WHEN stream % 4 != 0 THEN round(1000.0::double / (stream * 7), 6) END AS real_time_factor FROM w GROUP BY stream""",
    "coverage_total": rf"""WITH a AS (SELECT doc_id AS stream, unnest({_TOK.format(x='lower(text)')}) AS w FROM documents) SELECT stream, count_if(NOT regexp_matches(w, '[kq]'))::bigint AS complete, count(*) AS total, round(count_if(NOT regexp_matches(w, '[kq]')) / count(*), 6) AS coverage FROM a GROUP BY stream""",
}
