"""Signal queries over ``events`` and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import rates
from tidemark.operators import audio
from tidemark.operators import signal as ops
from tidemark.sources.frames import intervals, signal, table

THRESHOLD, FRAMES, SPEECH, SILENCE = 0.4, 5, 2, 3


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def smooth_causal(spark, d):
    return _rounded(ops.smooth_causal(signal(spark, d), FRAMES), "smooth").select("stream", "frame", "smooth")


def smooth_centered(spark, d):
    return _rounded(ops.smooth_centered(signal(spark, d), FRAMES), "smooth").select("stream", "frame", "smooth")


def threshold_runs(spark, d):
    return _rounded(ops.valleys(_rounded(ops.smooth_centered(signal(spark, d), FRAMES), "smooth"), 0.3, 2), "at_center", "mean", "p95")


def hysteresis_regions(spark, d):
    return ops.hysteresis(_rounded(ops.smooth_causal(signal(spark, d), FRAMES), "smooth"), THRESHOLD, SPEECH, SILENCE, FRAMES)


def hysteresis_padded(spark, d):
    return ops.hysteresis(_rounded(ops.smooth_causal(signal(spark, d), FRAMES), "smooth"), THRESHOLD, SPEECH, SILENCE, FRAMES, padded=True)


def hysteresis_limited(spark, d):
    """Regions of at most 20 frames, which most would pass: counting starts anew after each cut."""
    return ops.hysteresis_limited(_rounded(ops.smooth_causal(signal(spark, d), FRAMES), "smooth"), THRESHOLD, SPEECH, SILENCE, FRAMES, 20)


def block_average(spark, d):
    """Blocks of 300 frames that overlap by 100, each frame's value lowered by its place in the block; no block has an answer for frames 700 to 999."""
    track = signal(spark, d).select("stream", "frame", F.col("p").alias("v"))
    values = audio.blocks(track, 300, 100).where("frame NOT BETWEEN 700 AND 999").select("stream", "frame", (F.col("v") - (F.col("frame") - F.col("block_start")) / 10000.0).alias("value"))
    return _rounded(audio.averaged(values, track.groupBy("stream").agg((F.max("frame") + 1).alias("total"))), "value")


def block_analysis(spark, d):
    """A model that answers with the values and one region, the block's first half: tracks averaged, regions merged."""
    track = signal(spark, d).select("stream", "frame", F.col("p").alias("v"))
    return audio.analysed(track, 300, 100, lambda v: (v, [(0, len(v) // 2, 0.5 + len(v) / 1000)]), 30, 20)[1]


def hysteresis_finished(spark, d):
    """Padded regions as samples of a 16 kHz stream: widened, rounded by single precision, joined."""
    totals = signal(spark, d).groupBy("stream").agg(((F.max("frame") + 1) * 160 - 37).alias("total"))
    return audio.finished(hysteresis_padded(spark, d), totals, 16_000, 100, FRAMES, 2, 4, lambda c: rates.native_sample(c, 16_000))


def valley_lengths(spark, d):
    """Valleys of at least 0.3 s at 10 frames a second."""
    return _rounded(ops.valleys(_rounded(ops.smooth_centered(signal(spark, d), FRAMES), "smooth"), 0.3, ops.valley_frames(0.3, 16_000, 1600)), "at_center", "mean", "p95")


def audio_peaks(spark, d):
    """Peak of each stream, which one of three has a value without number in."""
    v = F.when((F.col("frame") == 5) & (F.length("stream") % 3 == 0), F.lit(float("nan"))).otherwise(F.col("p") * 3 - 2)
    return audio.peaks(signal(spark, d).select("stream", "frame", v.alias("v")))


def audio_prepared(spark, d):
    """Customers' balances as two channels of a stream for each nation; some files are ready as they are."""
    c = table(spark, d, "customer")
    order = W.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = c.select(F.col("c_nationkey").cast("long").alias("stream"), (F.row_number().over(order) - 1).cast("long").alias("n"), (F.col("c_acctbal").cast("double") / 4001).alias("v"))
    samples = rows.select("stream", F.floor(F.col("n") / 2).alias("frame"), (F.col("n") % 2).alias("channel"), "v")
    files = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("path"), F.lit("WAV").alias("format"), F.when(F.col("n_nationkey") % 4 == 0, "PCM_16").otherwise("FLOAT").alias("subtype"), F.when(F.col("n_nationkey") % 7 == 6, 8000).otherwise(16000).alias("rate"), F.lit(1).alias("channels"), F.lit(10).alias("frames"))
    ready_rows = samples.where("channel = 0")  # one channel is what a ready file has
    out = audio.prepared(files, samples.where("stream % 4 != 0").unionByName(ready_rows.where("stream % 4 = 0")), 16000)
    return out.select("stream", "frame", F.round("v", 6).alias("v"))


def audio_ranges(spark, d):
    """Ranges of each signal that begin before it, end behind it, or are empty."""
    track = signal(spark, d).select("stream", "frame", F.col("p").alias("v"))
    asks = spark.range(1, 40).select(F.col("id").alias("ask"), (F.col("id") * 37 - 200).alias("start"), (F.col("id") * 37 - 200 + F.col("id") % 7 * 5).alias("end"))
    return _rounded(audio.ranges(track, track.select("stream").distinct().join(asks)), "v")


def throttle(spark, d):
    return ops.throttle(intervals(spark, d).selectExpr("kind AS signature", "id", "s"), "signature", "s", 3600)


def _planned(spark, d):
    track = _rounded(ops.smooth_centered(signal(spark, d), FRAMES), "smooth")
    ends = track.groupBy("stream").agg((F.max("frame") + 1).alias("total"))
    cuts = ops.valleys(track, 0.3, 2).selectExpr("stream", "center", "end - start AS width", "mean", "p95")
    return ops.plan_windows(ends, cuts, 45, 60, 90, 15, 2, 1.0), ends


def plan_windows(spark, d):
    """Windows cut at the best valley in reach, with the speech inside of their input."""
    return ops.window_speech(_planned(spark, d)[0], hysteresis_regions(spark, d).selectExpr("stream", "start AS s", "end AS e"))


def windows_cover(spark, d):
    return ops.covered_exactly(*_planned(spark, d))


def window_expansion(spark, d):
    """Errors of a user as windows that follow each other, in minutes; the short ones are widened where there are any."""
    order = W.partitionBy("stream").orderBy("id")
    rows = intervals(spark, d, "error").select("stream", "id", ((F.col("e") - F.col("s")) / 60.0).alias("n"), (F.row_number().over(order) - 1).cast("long").alias("i"))
    rows = rows.withColumn("n", F.when(F.col("stream") % 3 == 0, F.col("n") + 60).when(F.col("i") % 4 == 1, F.col("n") / 1000).otherwise(F.col("n"))).withColumn("e", F.sum("n").over(order))
    durations = rows.groupBy("stream").agg(F.max("e").alias("duration"))
    out = ops.isotonic_expansion(rows.select("stream", "i", (F.col("e") - F.col("n")).alias("s"), "e"), durations, 50.0)
    return out.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.bool_or("moved").alias("moved"), F.round(F.sum(F.col("e") - F.col("s")), 3).alias("total"), F.round(F.min(F.col("e") - F.col("s")), 3).alias("least"))


def isotonic_windows(spark, d):
    """Times at least 100 apart, nearest to those of all events of a user, which are 600 apart but for their length."""
    n = F.row_number().over(W.partitionBy("stream").orderBy("id")) - 1
    rows = intervals(spark, d).select("stream", n.cast("long").alias("i"), ((F.col("e") - F.col("s")) * 10 + n * 600).cast("long").alias("x"))
    return _rounded(ops.isotonic(rows, 100), "fitted")


def normalize_range(spark, d):
    """Values over the stream's peak where that is above one, clipped to [-1, 1]."""
    track = intervals(spark, d).select("stream", F.col("id").alias("frame"), ((F.col("e") - F.col("s")) / 30000.0).alias("v"))
    return _rounded(audio.normalised(track), "v").withColumnRenamed("frame", "id")


def group_report(spark, d):
    """For each kind: count, seconds, root mean square, its level in dB, and peak."""
    v = F.col("p")
    rms = F.sqrt(F.avg(v * v))
    return signal(spark, d).groupBy(F.col("stream").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(rms, 6).alias("rms"), F.round(F.when(rms > 0, 20 * F.log10(rms)), 4).alias("dbfs"), F.max(F.abs(v)).alias("peak"))


def progress_monotone(spark, d):
    """Progress that never falls: the running maximum of a stream's values, at most 100."""
    order = W.partitionBy("stream").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    return intervals(spark, d).select("stream", "id", F.least(F.lit(100), F.max(F.floor((F.col("e") - F.col("s")) / 600)).over(order)).alias("progress"))


QUERIES = {f.__name__: f for f in (smooth_causal, smooth_centered, threshold_runs, hysteresis_regions, hysteresis_padded, hysteresis_limited, hysteresis_finished, valley_lengths, block_average, block_analysis, audio_peaks, audio_prepared, audio_ranges, throttle, plan_windows, windows_cover, window_expansion, isotonic_windows, normalize_range, group_report, progress_monotone)}

_SIG = "sig AS (SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame, least(1.0, value / 100.0) AS p FROM events)"
_CAUSAL = f"{_SIG}, sm AS (SELECT stream, frame, p, round(sum(p) OVER (PARTITION BY stream ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5, 6) AS smooth FROM sig)"
_CENTER = f"""{_SIG}, sm AS (SELECT stream, frame, p, round((coalesce(lag(p, 2) OVER w, first_value(p) OVER a) + coalesce(lag(p, 1) OVER w, first_value(p) OVER a) + p + coalesce(lead(p, 1) OVER w, last_value(p) OVER a) + coalesce(lead(p, 2) OVER w, last_value(p) OVER a)) / 5, 6) AS smooth
  FROM sig WINDOW w AS (PARTITION BY stream ORDER BY frame), a AS (PARTITION BY stream ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_VALLEY = f"""{_CENTER}, f AS (SELECT *, smooth <= 0.3 AS low FROM sm), g AS (SELECT *, CASE WHEN lag(low) OVER w IS NOT DISTINCT FROM low THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY stream ORDER BY frame)),
  h AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY frame) AS run FROM g),
  val AS (SELECT stream, min(frame) AS start, max(frame) + 1 AS "end", (min(frame) + max(frame) + 1) // 2 AS center, avg(smooth) AS mean, quantile_cont(smooth, 0.95) AS p95, run FROM h WHERE low GROUP BY stream, run HAVING count(*) >= 2)"""
_HYST = f"""WITH {_CAUSAL}, f AS (SELECT *, smooth >= 0.4 AS on_ FROM sm), g AS (SELECT *, CASE WHEN lag(on_) OVER w IS NOT DISTINCT FROM on_ THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY stream ORDER BY frame)),
  h AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY frame) AS run FROM g), r AS (SELECT stream, on_, min(frame) AS st, count(*) AS len FROM h GROUP BY stream, run, on_),
  ev AS (SELECT * FROM r WHERE (on_ AND len > 2) OR (NOT on_ AND len >= 3)), sw AS (SELECT *, lag(on_) OVER (PARTITION BY stream ORDER BY st) AS b FROM ev),
  s2 AS (SELECT *, lead(st) OVER (PARTITION BY stream ORDER BY st) AS off FROM sw WHERE (b IS NULL AND on_) OR b != on_), n AS (SELECT stream, max(frame) + 1 AS n FROM sig GROUP BY stream)
  SELECT stream, greatest(0, st - 5) AS start, least(coalesce(off + {{pad}}, n), n) AS "end" FROM s2 JOIN n USING (stream) WHERE on_"""
_IV = "iv AS (SELECT user_id AS stream, event_id AS id, event_type AS kind, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) AS s, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) + 1 + cast(floor(value * 300) AS bigint) AS e FROM events)"

ORACLE = {
    "smooth_causal": f"WITH {_CAUSAL} SELECT stream, frame, smooth FROM sm",
    "smooth_centered": f"WITH {_CENTER} SELECT stream, frame, smooth FROM sm",
    "threshold_runs": f'WITH {_VALLEY} SELECT v.stream, start, "end", center, round(sm.smooth, 6) AS at_center, round(mean, 6) AS mean, round(p95, 6) AS p95 FROM val v JOIN sm ON sm.stream = v.stream AND sm.frame = v.center',
    "hysteresis_regions": _HYST.format(pad=0),
    "hysteresis_padded": _HYST.format(pad=3),
    "hysteresis_limited": f"""WITH RECURSIVE {_CAUSAL}, f AS (SELECT stream, frame, smooth >= 0.4 AS on_ FROM sm), n AS (SELECT stream, max(frame) + 1 AS n FROM f GROUP BY stream),
      t AS (SELECT stream, 0::bigint AS frame, 0::bigint AS speech, 0::bigint AS quiet, NULL::bigint AS begin_, NULL::bigint AS out_s, NULL::bigint AS out_e FROM n
        UNION ALL SELECT t.stream, t.frame + 1, CASE WHEN t.begin_ IS NOT NULL THEN 0 WHEN f.on_ AND t.speech + 1 <= 2 THEN t.speech + 1 ELSE 0 END,
          CASE WHEN t.begin_ IS NULL OR f.on_ THEN 0 WHEN t.quiet + 1 >= 3 OR t.frame + 1 - t.begin_ >= 20 THEN 0 ELSE t.quiet + 1 END,
          CASE WHEN t.begin_ IS NULL THEN CASE WHEN f.on_ AND t.speech + 1 > 2 THEN greatest(0, t.frame - t.speech - 5) END WHEN (NOT f.on_ AND t.quiet + 1 >= 3) OR t.frame + 1 - t.begin_ >= 20 THEN NULL ELSE t.begin_ END,
          CASE WHEN t.begin_ IS NOT NULL AND ((NOT f.on_ AND t.quiet + 1 >= 3) OR t.frame + 1 - t.begin_ >= 20) THEN t.begin_ END,
          CASE WHEN t.begin_ IS NOT NULL AND NOT f.on_ AND t.quiet + 1 >= 3 THEN t.frame - t.quiet WHEN t.begin_ IS NOT NULL AND t.frame + 1 - t.begin_ >= 20 THEN t.frame + 1 END
        FROM t JOIN f ON f.stream = t.stream AND f.frame = t.frame)
      SELECT stream, out_s AS start, out_e AS "end" FROM t WHERE out_s IS NOT NULL UNION ALL SELECT t.stream, begin_, n FROM t JOIN n ON n.stream = t.stream AND t.frame = n.n WHERE begin_ IS NOT NULL""",
    "hysteresis_finished": f"""WITH raw AS ({_HYST.format(pad=3)}), q AS (SELECT event_type AS stream, count(*) * 160 - 37 AS total FROM events GROUP BY event_type),
      a AS (SELECT stream, total, greatest(0, (start - 2) * 160) AS s, least(total, ("end" + 2) * 160) AS e, start = max(start) OVER (PARTITION BY stream) AS last_ FROM raw JOIN q USING (stream)),
      b AS (SELECT stream, total, s, CASE WHEN last_ AND total - e <= 800 THEN total ELSE e END AS e FROM a),
      c AS (SELECT stream, greatest(0, least(cast(round_even(round_even(cast(cast(s / 16000.0 AS float) AS double), 3) * 16000, 0) AS bigint), total)) AS s, greatest(0, least(cast(round_even(round_even(cast(cast(e / 16000.0 AS float) AS double), 3) * 16000, 0) AS bigint), total)) AS e FROM b),
      d AS (SELECT *, max(e) OVER (PARTITION BY stream ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE e > s), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 640 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM d)
      SELECT stream, min(s) AS s, max(e) AS e FROM i GROUP BY stream, island""",
    "valley_lengths": f'WITH {_VALLEY.replace(">= 2)", ">= 3)")} SELECT v.stream, start, "end", center, round(sm.smooth, 6) AS at_center, round(mean, 6) AS mean, round(p95, 6) AS p95 FROM val v JOIN sm ON sm.stream = v.stream AND sm.frame = v.center',
    "block_average": f"""WITH {_SIG}, t AS (SELECT stream, max(frame) + 1 AS total FROM sig GROUP BY stream), k AS (SELECT *, unnest(range(greatest(0, cast(floor((frame - 300) / 200.0) AS bigint) + 1), frame // 200 + 1)) AS k FROM sig JOIN t USING (stream)),
      m AS (SELECT stream, frame, avg(p - (frame - k * 200) / 10000.0) AS value, count(*) AS n FROM k WHERE (k = 0 OR (k - 1) * 200 + 300 < total) AND frame NOT BETWEEN 700 AND 999 GROUP BY stream, frame)
      SELECT s.stream, s.frame, round(coalesce(value, 1.0), 6) AS value, coalesce(n, 0) AS n_blocks FROM sig s LEFT JOIN m USING (stream, frame)""",
    "block_analysis": f"""WITH {_SIG}, t AS (SELECT stream, max(frame) + 1 AS total FROM sig GROUP BY stream), k AS (SELECT stream, total, unnest(range(0, total, 200)) AS st FROM t), b AS (SELECT stream, st AS s, st + least(300, total - st) // 2 AS e, 0.5 + least(300, total - st) / 1000.0 AS c, total FROM k WHERE st = 0 OR st - 200 + 300 < total),
      d AS (SELECT *, max(e) OVER (PARTITION BY stream ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b WHERE e > s), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM d)
      SELECT stream, min(s) AS s, max(e) AS e, max(c)::double AS confidence FROM i GROUP BY stream, island HAVING max(e) - min(s) >= 20""",
    "audio_peaks": f"WITH {_SIG} SELECT stream, count(*) AS n, CASE WHEN length(stream) % 3 = 0 THEN NULL ELSE max(abs(p * 3 - 2)) END AS peak, CASE WHEN length(stream) % 3 = 0 THEN 'AUDIO_NOT_FINITE' END AS error FROM sig GROUP BY stream",
    "audio_prepared": """WITH a AS (SELECT c_nationkey::bigint AS stream, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, c_acctbal::double / 4001 AS v FROM customer), b AS (SELECT stream, n // 2 AS frame, n % 2 AS channel, v FROM a WHERE stream % 7 != 6),
      m AS (SELECT stream, frame, avg(v) AS v FROM b WHERE stream % 4 != 0 GROUP BY stream, frame)
      SELECT stream, frame, round(v, 6) AS v FROM b WHERE stream % 4 = 0 AND channel = 0 UNION ALL SELECT stream, frame, round(greatest(-1.0, least(1.0, v / greatest(1.0, max(abs(v)) OVER (PARTITION BY stream)))), 6) FROM m""",
    "audio_ranges": f"""WITH {_SIG}, t AS (SELECT stream, max(frame) + 1 AS n FROM sig GROUP BY stream), q AS (SELECT i AS ask, i * 37 - 200 AS a, i * 37 - 200 + i % 7 * 5 AS b FROM range(1, 40) r(i)), c AS (SELECT stream, ask, greatest(0, least(n, a)) AS a, greatest(0, least(n, b)) AS b FROM t, q)
      SELECT c.stream, ask, frame - a AS at, round(p, 6) AS v FROM c JOIN sig ON sig.stream = c.stream AND frame >= a AND frame < b""",
    "throttle": f"""WITH RECURSIVE {_IV}, a AS (SELECT kind AS signature, id, s, row_number() OVER (PARTITION BY kind ORDER BY s, id) AS n FROM iv),
      t AS (SELECT signature, id, s, n, s AS last, true AS through FROM a WHERE n = 1 UNION ALL SELECT a.signature, a.id, a.s, a.n, CASE WHEN a.s - t.last >= 3600 THEN a.s ELSE t.last END, a.s - t.last >= 3600 FROM t JOIN a ON a.signature = t.signature AND a.n = t.n + 1)
      SELECT signature, id, s FROM t WHERE through""",
    "windows_cover": "SELECT DISTINCT event_type AS stream, true AS exact FROM events",
    "plan_windows": f"""WITH RECURSIVE {_VALLEY}, vs AS (SELECT stream, list({{'c': center, 'w': "end" - start, 'm': mean, 'p': p95}} ORDER BY center) AS v FROM val GROUP BY stream), n AS (SELECT sig.stream, max(frame) + 1 AS total, coalesce(any_value(v), []) AS v FROM sig LEFT JOIN vs ON vs.stream = sig.stream GROUP BY sig.stream),
      t AS (SELECT stream, total, v, 0::bigint AS a, 0::bigint AS b, '' AS why, -1 AS idx FROM n UNION ALL
        SELECT stream, total, v, b, CASE WHEN pick IS NOT NULL THEN pick WHEN total - b > 90 THEN least(b + 90, total - 15) ELSE total END, CASE WHEN pick IS NOT NULL THEN 'probability_valley' WHEN total - b > 90 THEN 'hard_max' ELSE 'end_of_audio' END, idx + 1 FROM (
          SELECT *, CASE WHEN total - b > 45 AND b + 15 <= least(b + 90, total - 15) THEN list_sort(list_transform(list_filter(v, lambda x: x.c >= b + 15 AND x.c <= least(b + 90, total - 15)),
            lambda x: {{'far': x.c > least(b + 60, total - 15), 'cost': 0.65::double * abs(x.c - (b + 45)) / greatest(1e-6::double, least(b + 60, total - 15) - (b + 15)) + 0.20::double * x.m + 0.10::double * x.p - 0.05::double * least(1.0::double, x.w), 'c': x.c}}))[1].c END AS pick FROM t WHERE b < total)),
      u AS (SELECT *, lead(b) OVER w AS nb, lead(why) OVER w AS nwhy, lead(idx) OVER (PARTITION BY stream ORDER BY idx) AS ni, max(idx) OVER (PARTITION BY stream) AS last_ FROM t WHERE idx >= 0 WINDOW w AS (PARTITION BY stream ORDER BY idx)),
      x AS (SELECT stream, total, idx, a, CASE WHEN idx = last_ - 1 AND nb - b < 15 THEN nb ELSE b END AS b, CASE WHEN idx = last_ - 1 AND nb - b < 15 THEN nwhy ELSE why END AS why FROM u WHERE NOT (idx = last_ AND idx > 0 AND b - a < 15)),
      y AS (SELECT stream, idx::bigint AS idx, a AS core_start, b AS core_end, greatest(0, a - 2) AS input_start, least(total, b + 2) AS input_end, why AS reason FROM x), sp AS ({_HYST.replace(_CAUSAL, _CAUSAL.replace('sig AS', 'sig2 AS', 1).replace('FROM sig)', 'FROM sig2)')).replace('FROM sig GROUP', 'FROM sig2 GROUP').format(pad=0)})
      SELECT y.*, coalesce((SELECT sum(least(input_end, sp."end") - greatest(input_start, sp.start)) FROM sp WHERE sp.stream = y.stream AND sp.start < input_end AND input_start < sp."end"), 0)::bigint AS speech FROM y""",
    "isotonic_windows": f"""WITH {_IV}, a AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY id) - 1 AS i, (e - s) * 10 + (row_number() OVER (PARTITION BY stream ORDER BY id) - 1) * 600 AS x FROM iv),
      b AS (SELECT *, sum(x - i * 100) OVER (PARTITION BY stream ORDER BY i) AS c FROM a), m AS (SELECT j.stream, j.i AS j, k.i AS k, (k.c - j.c + j.x - j.i * 100) / (k.i - j.i + 1) AS mean FROM b j JOIN b k ON k.stream = j.stream AND k.i >= j.i),
      lo AS (SELECT stream, j, k, min(mean) OVER (PARTITION BY stream, j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS v FROM m), hi AS (SELECT stream, k AS i, max(v) AS v FROM lo GROUP BY stream, k)
      SELECT b.stream, b.i, b.x, round(hi.v + b.i * 100, 6) AS fitted FROM b JOIN hi ON hi.stream = b.stream AND hi.i = b.i""",
    "window_expansion": f"""WITH {_IV}, a AS (SELECT stream, id, (e - s) / 60.0::double AS n, row_number() OVER (PARTITION BY stream ORDER BY id) - 1 AS i FROM iv WHERE kind = 'error'), b AS (SELECT stream, id, i, CASE WHEN stream % 3 = 0 THEN n + 60 WHEN i % 4 = 1 THEN n / 1000 ELSE n END AS n FROM a),
      c AS (SELECT *, sum(n) OVER (PARTITION BY stream ORDER BY id) AS e FROM b), g AS (SELECT stream, count(*) AS cnt, max(e) AS d, min(n) AS least_, least(50.0::double, max(e) / count(*)) AS target FROM c GROUP BY stream),
      x AS (SELECT stream, i + 1 AS i, least(greatest(0, d - cnt * target), greatest(0, e - (i + 1) * target)) AS x, d, target, cnt FROM c JOIN g USING (stream) WHERE least_ < target - 1e-9 AND i < cnt - 1), y AS (SELECT *, sum(x) OVER (PARTITION BY stream ORDER BY i) AS c FROM x),
      m AS (SELECT j.stream, j.i AS j, k.i AS k, (k.c - j.c + j.x) / (k.i - j.i + 1) AS mean FROM y j JOIN y k ON k.stream = j.stream AND k.i >= j.i), lo AS (SELECT stream, j, k, min(mean) OVER (PARTITION BY stream, j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS v FROM m), hi AS (SELECT stream, k AS i, max(v) AS v FROM lo GROUP BY stream, k),
      cut AS (SELECT y.stream, y.i, hi.v + y.i * target AS t FROM y JOIN hi ON hi.stream = y.stream AND hi.i = y.i UNION ALL SELECT stream, 0, 0 FROM g WHERE least_ < target - 1e-9 UNION ALL SELECT stream, cnt, d FROM g WHERE least_ < target - 1e-9),
      w AS (SELECT stream, lead(t) OVER (PARTITION BY stream ORDER BY i) - t AS n, true AS moved FROM cut UNION ALL SELECT c.stream, n, false FROM c JOIN g USING (stream) WHERE least_ >= target - 1e-9)
      SELECT stream, count(*) AS n, bool_or(moved) AS moved, round(sum(n), 3) AS total, round(min(n), 3) AS least FROM w WHERE n IS NOT NULL GROUP BY stream""",
    "normalize_range": f"WITH {_IV}, t AS (SELECT stream, id, (e - s) / 30000.0 AS v FROM iv) SELECT stream, id, round(greatest(-1.0, least(1.0, v / greatest(1.0, max(abs(v)) OVER (PARTITION BY stream)))), 6) AS v FROM t",
    "group_report": f"WITH {_SIG} SELECT stream AS kind, count(*) AS n, round(sum(p), 4) AS total, round(sqrt(avg(p * p)), 6) AS rms, round(20 * log10(sqrt(avg(p * p))), 4) AS dbfs, max(abs(p)) AS peak FROM sig GROUP BY stream",
    "progress_monotone": f"WITH {_IV} SELECT stream, id, least(100, max((e - s) // 600) OVER (PARTITION BY stream ORDER BY id ROWS UNBOUNDED PRECEDING)) AS progress FROM iv",
}
