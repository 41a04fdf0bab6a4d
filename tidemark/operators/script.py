"""Matching a given script: quality of a direct alignment, blocks on frames, what must be preserved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import intervals as iv

#: Shares that a direct alignment must reach, and what counts as collapsed (seconds, display units a second).
ALIGNED, MAPPED, UNIQUE, SPAN, COLLAPSED_SECONDS, COLLAPSED_RATE = 0.98, 0.98, 0.80, 0.35, 0.5, 24.0


def faults(blocks: DataFrame, durations: DataFrame) -> DataFrame:
    """Faults of blocks (stream, id, s, e in seconds), taken in the order of their ids, within 1e-6: counts by stream."""
    order = W.partitionBy("stream").orderBy("id")
    at = blocks.withColumns({"ps": F.lag("s").over(order), "pe": F.lag("e").over(order)}).join(durations, "stream")
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    s, e = F.col("s"), F.col("e")
    return at.groupBy("stream").agg(count(e <= s + 1e-6, "invalid"), count((s < -1e-6) | (e > F.col("duration") + 1e-6), "out_of_bounds"), count(s + 1e-6 < F.col("ps"), "non_monotonic"), count(s + 1e-6 < F.col("pe"), "overlapping"))


def direct_quality(streams: DataFrame, tokens: DataFrame, blocks: DataFrame) -> DataFrame:
    """Why a direct alignment is not taken: stream, reasons (in order, each once), passed, unique_ratio, span_ratio, collapsed (block ids).

    ``streams``: stream, valid, error, coverage, mapped, unmapped, n_lines, n_characters, duration; ``tokens``: stream, s, e; ``blocks``:
    stream, id, s, e, units (display width)."""
    spread = tokens.groupBy("stream").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct(F.bround("s", 6), F.bround("e", 6)).alias("n_different"), (F.max("e") - F.min("s")).alias("span"))
    length = F.col("e") - F.col("s")
    short = (length < COLLAPSED_SECONDS) & (length > 0) & (F.col("units") > COLLAPSED_RATE * length)
    made = blocks.groupBy("stream").agg(F.count(F.lit(1)).alias("n_blocks"), F.array_sort(F.collect_list(F.when(short, F.col("id")))).alias("collapsed"))
    bad = faults(blocks, streams.select("stream", "duration"))
    at = streams.join(spread, "stream", "left").join(made, "stream", "left").join(bad, "stream", "left")
    at = at.withColumns({"n_tokens": F.coalesce("n_tokens", F.lit(0)), "n_blocks": F.coalesce("n_blocks", F.lit(0)), "collapsed": F.coalesce("collapsed", F.array().cast("array<long>"))})
    unique = F.when(F.col("n_tokens") > 0, F.col("n_different") / F.col("n_tokens")).otherwise(0.0)
    span = F.when((F.col("n_tokens") > 0) & (F.col("duration") > 0), F.greatest(F.lit(0.0), "span") / F.col("duration")).otherwise(0.0)
    at = at.withColumns({"unique_ratio": unique, "span_ratio": span})
    checks = [
        (F.when(F.coalesce("error", F.lit("")) == "", "ALIGNMENT_INVALID").otherwise(F.col("error")), ~F.col("valid")),
        (F.lit("LOW_ALIGNMENT_COVERAGE"), F.col("coverage") + 1e-9 < ALIGNED),
        (F.lit("LOW_SCRIPT_MAPPING_COVERAGE"), F.col("mapped") + 1e-9 < MAPPED),
        (F.lit("UNMAPPED_SCRIPT_LINES"), (F.col("unmapped") > 0) | (F.col("n_blocks") != F.col("n_lines"))),
        (F.lit("COLLAPSED_ALIGNMENT_INTERVALS"), (F.col("n_tokens") >= 10) & (F.col("unique_ratio") + 1e-9 < UNIQUE)),
        (F.lit("COMPRESSED_ALIGNMENT_SPAN"), (F.col("duration") >= 10) & (F.col("n_characters") >= 10) & (F.col("span_ratio") + 1e-9 < SPAN)),
        (F.lit("LOCALLY_COLLAPSED_SCRIPT_INTERVALS"), F.size("collapsed") > 0),
        (F.lit("INVALID_SCRIPT_INTERVALS"), F.coalesce(F.col("invalid") > 0, F.lit(False))),
        (F.lit("NON_MONOTONIC_SCRIPT_INTERVALS"), F.coalesce(F.col("non_monotonic") > 0, F.lit(False))),
        (F.lit("OVERLAPPING_SCRIPT_INTERVALS"), F.coalesce(F.col("overlapping") > 0, F.lit(False))),
        (F.lit("SCRIPT_INTERVAL_OUT_OF_BOUNDS"), F.coalesce(F.col("out_of_bounds") > 0, F.lit(False))),
    ]
    reasons = F.array_distinct(F.array_compact(F.array(*[F.when(test, name) for name, test in checks])))
    return at.select("stream", reasons.alias("reasons"), (F.size(reasons) == 0).alias("passed"), "unique_ratio", "span_ratio", "collapsed")


def on_frames(blocks: DataFrame, durations: DataFrame, numerator: int, denominator: int, unit: int = 1000) -> DataFrame:
    """Blocks (stream, id, s, e in 1/``unit`` s) on whole frames, no end behind the stream's ``duration`` (seconds), and the stream's first fault."""
    snapped = iv.snap(blocks, numerator, denominator, unit).join(durations, "stream")
    second = lambda f: F.col(f) * denominator / numerator
    at = snapped.select("stream", "id", "start_frame", "end_frame", second("start_frame").alias("s"), F.least(second("end_frame"), F.col("duration")).alias("e"))
    bad = faults(at.select("stream", "id", "s", "e"), durations)
    code = F.when(F.col("invalid") > 0, "SCRIPT_MATCH_FRAME_QUANTIZATION_FAILED").when(F.col("non_monotonic") + F.col("overlapping") + F.col("out_of_bounds") > 0, "SCRIPT_MATCH_QUANTIZED_INTERVALS_INVALID").otherwise("")
    return at.join(bad.select("stream", code.alias("fault")), "stream")


def anchor_plan(lines: DataFrame, durations: DataFrame, least: float = 0.01) -> DataFrame:
    """A window for each line (stream, line, coverage, start, end in seconds; null times where a line is not mapped), for streams all of whose
    lines are mapped: windows meet in the middle between neighbours, are ``least`` long, and fill 0 to the stream's duration."""
    by = W.partitionBy("stream")
    order = by.orderBy("line")
    us = lambda c: F.round(c * 1_000_000).cast("long")  # noqa: E731  # whole microseconds, so that the closed form is exact
    at = lines.join(durations, "stream").withColumns({"s": us(F.greatest(F.lit(0.0), F.col("start"))), "e": us(F.least(F.col("duration"), F.col("end"))), "d": us(F.col("duration")), "n": F.count(F.lit(1)).over(by), "p": F.row_number().over(order).cast("long"), "lost": F.max((F.col("start").isNull()).cast("int")).over(by)})
    m = round(least * 1_000_000)
    at = at.where("lost = 0").withColumn("middle", F.floor((F.col("e") + F.lead("s").over(order)) / 2))
    run = F.max(F.col("middle") - F.col("p") * m).over(order.rowsBetween(W.unboundedPreceding, 0))
    at = at.withColumn("cut", F.when(F.col("p") < F.col("n"), F.col("p") * m + F.least(F.col("d") - F.col("n") * m, F.greatest(F.lit(0), run))).otherwise(F.col("d")))
    return at.select("stream", "line", "coverage", (F.coalesce(F.lag("cut").over(order), F.lit(0)) / 1e6).alias("start"), (F.col("cut") / 1e6).alias("end"))


def without_gaps(frames: DataFrame) -> DataFrame:
    """Each block on frames ends where the next begins; the last is unchanged."""
    after = F.lead("start_frame").over(W.partitionBy("stream").orderBy("start_frame", "id"))
    return frames.withColumn("end_frame", F.coalesce(after, F.col("end_frame")))


def preserved(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether a stream's blocks (stream, id, text) are its script's lines (stream, line, text): as many, in order, unchanged."""
    numbered = lambda df, key: df.select("stream", (F.row_number().over(W.partitionBy("stream").orderBy(key)) - 1).alias("i"), F.col("text"))
    both = numbered(blocks, "id").withColumnRenamed("text", "a").join(numbered(lines, "line").withColumnRenamed("text", "b"), ["stream", "i"], "full")
    return both.groupBy("stream").agg(F.count("a").alias("n_blocks"), F.count("b").alias("n_lines"), F.count_if(F.col("a") == F.col("b")).alias("n_preserved")).withColumn("preserved", (F.col("n_blocks") == F.col("n_lines")) & (F.col("n_preserved") == F.col("n_lines")))


def auditable(regions: DataFrame, window_ends: DataFrame, longest: int) -> DataFrame:
    """Speech regions cut at the ends of windows (stream, t) and by length, so that each piece is one window's to answer for."""
    return iv.split_at(regions, window_ends, longest)


def holes(regions: DataFrame, claims: DataFrame, window_ends: DataFrame, longest: int, least: int, gap: int) -> DataFrame:
    """What recovery looks at: uncovered edges of auditable pieces, joined across short gaps, cut by length."""
    open_ = iv.unclaimed_edges(auditable(regions, window_ends, longest), claims, least)
    return iv.split_max(iv.merge(open_, gap).select("stream", "s", "e"), longest)


def metrics(windows: DataFrame, elapsed: DataFrame) -> DataFrame:
    """Counts and sums of windows (stream, idx, s, e in seconds, reason) and the real-time factor of each run (stream, elapsed, duration)."""
    seconds = F.col("e") - F.col("s")
    why = lambda name: F.count_if(F.col("reason") == name).alias(name)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.bround(seconds.cast("double"), 3).alias("x")))), lambda r: r.x)
    run = windows.groupBy("stream").agg(F.count(F.lit(1)).alias("n_windows"), why("probability_valley"), why("hard_max"), why("end_of_audio"), F.sum(seconds).alias("seconds"), F.max(seconds).alias("longest"), F.to_json(listed).alias("window_seconds"))
    return run.join(elapsed, "stream").withColumn("real_time_factor", F.when(F.col("duration") > 0, F.bround(F.col("elapsed") / F.col("duration"), 6))).drop("elapsed", "duration")
