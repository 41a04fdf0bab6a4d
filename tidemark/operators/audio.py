"""Samples of streams (stream, frame, channel, v): preparation for a model, ranges, blockwise analysis.

The model itself is a slot: ``analysed`` runs any function on blocks of samples and puts its tracks and regions together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv


def ready(files: DataFrame, rate: int) -> DataFrame:
    """Whether a file (path, format, subtype, rate, channels, frames) can be used as it is: PCM WAV, one channel, the rate, not empty."""
    same = F.col("format").isin("WAV", "WAVEX") & F.col("subtype").startswith("PCM_") & (F.col("rate") == rate) & (F.col("channels") == 1) & (F.col("frames") > 0)
    return files.withColumn("ready", F.coalesce(same, F.lit(False)))


def mono(samples: DataFrame) -> DataFrame:
    """The mean of a frame's channels."""
    return samples.groupBy("stream", "frame").agg(F.avg("v").alias("v"))


def peaks(track: DataFrame) -> DataFrame:
    """stream, n, peak and error: the largest magnitude, or that the stream is empty or has a value that is no finite number."""
    odd = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    found = track.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(~odd, F.abs("v"))).alias("peak"), F.count_if(odd).alias("odd"))
    error = F.when(F.col("odd") > 0, "AUDIO_NOT_FINITE").when(F.col("peak").isNull(), "AUDIO_EMPTY")
    return found.select("stream", "n", F.when(error.isNull(), F.col("peak")).alias("peak"), error.alias("error"))


def normalised(track: DataFrame) -> DataFrame:
    """Values divided by their stream's peak where that is above 1, and clipped to -1..1. A stream with an error has no rows.

    The peaks, one row for each stream, are aggregated and joined: no window holds a stream."""
    level = peaks(track).where("error IS NULL").select("stream", F.greatest(F.lit(1.0), "peak").alias("level"))
    scaled = F.col("v") / F.col("level")
    return track.join(level, "stream").select("stream", "frame", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled)).alias("v"))


def prepared(files: DataFrame, samples: DataFrame, rate: int) -> DataFrame:
    """One channel of each stream in -1..1: as it is where its file is ready; else scaled by its peak, mixed, and scaled again where the
    mix is still above 1. Rates must agree, resampling is not done here. Files' ``path`` is the stream."""
    marked = ready(files, rate).select(F.col("path").alias("stream"), "ready", F.col("rate").alias("rate_"))
    rows = samples.join(marked.where(F.col("rate_") == rate), "stream")
    as_is = rows.where("ready").select("stream", "frame", "v")
    return as_is.unionByName(normalised(mono(rows.where("NOT ready"))))


def ranges(track: DataFrame, asked: DataFrame) -> DataFrame:
    """The values of asked ranges (stream, ask, start, end), cut to what the stream (frames from 0) has; ``at`` counts from the range's begin."""
    n = track.groupBy("stream").agg((F.max("frame") + 1).alias("n"))
    cut = lambda c: F.greatest(F.lit(0), F.least(F.col("n"), F.col(c)))
    clamped = asked.join(n, "stream").select("stream", "ask", cut("start").alias("s"), cut("end").alias("e")).where("e > s")
    points = track.select("stream", F.col("frame").alias("s"), (F.col("frame") + 1).alias("e"), "v")
    pairs = iv.overlap_join(clamped, points, 4096)
    return pairs.select(F.col("l_stream").alias("stream"), F.col("l_ask").alias("ask"), (F.col("r_s") - F.col("l_s")).alias("at"), F.col("r_v").alias("v"))


def blocks(track: DataFrame, block: int, overlap: int) -> DataFrame:
    """Each value in every block that holds it: stream, block, block_start, frame, v."""
    step = block - overlap
    first = F.greatest(F.lit(0), F.floor((F.col("frame") - block) / step) + 1)
    held = track.withColumn("block", F.explode(F.sequence(first, F.floor(F.col("frame") / step))))
    last = track.groupBy("stream").agg((F.max("frame") + 1).alias("total"))
    # The block that reaches the end is the last: a later one would lie within it.
    held = held.join(last, "stream").where((F.col("block") == 0) | ((F.col("block") - 1) * step + block < F.col("total")))
    return held.select("stream", "block", (F.col("block") * step).alias("block_start"), "frame", "v")


def averaged(values: DataFrame, totals: DataFrame, uncovered: float = 1.0) -> DataFrame:
    """Mean over the blocks that give a frame a value (stream, frame, value); frames of ``totals`` (stream, total) without one get ``uncovered``."""
    mean = values.groupBy("stream", "frame").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_blocks"))
    every = totals.where("total > 0").select("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("frame"))
    return every.join(mean, ["stream", "frame"], "left").select("stream", "frame", F.coalesce("value", F.lit(uncovered)).alias("value"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def analysed(track: DataFrame, block: int, overlap: int, model: Callable[[list[float]], tuple[list[float], list[tuple[int, int, float]]]], gap: int, minimum: int) -> tuple[DataFrame, DataFrame]:
    """A model's probabilities and regions over whole streams: it runs on overlapping blocks (one call each, in Arrow batches), its tracks
    are averaged, its regions moved to the stream, cut to their block and merged. Returns (stream, frame, value, n_blocks) and
    (stream, s, e, confidence)."""
    rows = blocks(track, block, overlap).groupBy("stream", "block", "block_start").agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("held"))
    vectors = rows.select("stream", "block_start", F.transform("held", lambda x: x.v).alias("v"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [model(list(v)) for v in pdf["v"]]
            yield pd.DataFrame({"stream": pdf["stream"], "block_start": pdf["block_start"], "n": pdf["v"].map(len), "track": [list(t) for t, _ in out], "found": [[(int(a), int(b), float(c)) for a, b, c in r] for _, r in out]})

    done = vectors.mapInPandas(run, f"stream {dict(track.dtypes)['stream']}, block_start long, n long, track array<double>, found array<struct<s:long,e:long,c:double>>")
    values = done.select("stream", "block_start", F.posexplode("track").alias("i", "value")).select("stream", (F.col("block_start") + F.col("i")).alias("frame"), "value")
    totals = track.groupBy("stream").agg((F.max("frame") + 1).alias("total"))
    within = lambda c: F.col("block_start") + F.greatest(F.lit(0), F.least(F.col("n"), c))
    found = done.select("stream", "block_start", "n", F.explode("found").alias("r")).select("stream", within(F.col("r.s")).alias("s"), within(F.col("r.e")).alias("e"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "r.c")).alias("confidence"))
    return averaged(values, totals), iv.merge_regions(found, totals, gap, minimum)


def finished(regions: DataFrame, totals: DataFrame, rate: int, per_second: int, smooth: int, extend: int, gap: int, native: Callable[[Column], Column]) -> DataFrame:
    """Raw regions in frames (stream, start, end; a null end means the stream's) as samples: widened, the last drawn to a near end,
    rounded by ``native``, joined across gaps of up to ``gap`` frames."""
    hop = rate // per_second
    from pyspark.sql.window import Window as W

    last = F.col("start") == F.max("start").over(W.partitionBy("stream"))
    total = F.col("total")
    at = regions.join(totals, "stream")
    e = F.coalesce(F.least(total, (F.col("end") + extend) * hop), total)
    at = at.select("stream", "total", F.greatest(F.lit(0), (F.col("start") - extend) * hop).alias("s"), F.when(last & (total - e <= smooth * hop), total).otherwise(e).alias("e"))
    s = F.greatest(F.lit(0), F.least(native(F.col("s")), total))
    rounded = at.select("stream", s.alias("s"), F.greatest(s, F.least(native(F.col("e")), total)).alias("e"))
    return iv.merge(rounded, gap * hop, inclusive=True).select("stream", "s", "e")
