"""Dense signals on frames (stream, frame, p): smoothing, threshold runs, hysteresis regions, window planning.

Everything but the planner and the length-limited state machine is a window expression over a stream. Smoothing
works on blocks of frames with a copied margin, so a long track is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.intervals import overlap_join
from tidemark.operators.scan import ordered_scan

BLOCK = 65_536


def _blocks(track: DataFrame, before: int, after: int) -> DataFrame:
    """Rows dealt to blocks, with the rows that windows at a block's ends need copied in (``own`` false)."""
    home = F.floor(F.col("frame") / BLOCK)
    first, last = F.floor((F.col("frame") - after) / BLOCK), F.floor((F.col("frame") + before) / BLOCK)
    return track.withColumn("block", F.explode(F.sequence(first, last))).withColumn("own", F.col("block") == home)


def smooth_causal(track: DataFrame, frames: int) -> DataFrame:
    """Mean of the last ``frames`` values, missing ones counted as zero."""
    w = W.partitionBy("stream", "block").orderBy("frame").rowsBetween(1 - frames, 0)
    return _blocks(track, frames - 1, 0).withColumn("smooth", F.sum("p").over(w) / frames).where("own").select("stream", "frame", "p", "smooth")


def smooth_centered(track: DataFrame, frames: int) -> DataFrame:
    """Mean of ``frames`` values around each, the end values repeated beyond the ends."""
    left, right = frames // 2, frames - frames // 2 - 1
    ends = track.groupBy("stream").agg(F.min_by("p", "frame").alias("p0"), F.max_by("p", "frame").alias("p1"), F.max("frame").alias("last"))
    w = W.partitionBy("stream", "block").orderBy("frame").rowsBetween(-left, right)
    beyond = F.greatest(F.lit(0), left - F.col("frame")) * F.col("p0") + F.greatest(F.lit(0), F.col("frame") + right - F.col("last")) * F.col("p1")
    summed = _blocks(track, left, right).withColumn("inside", F.sum("p").over(w)).where("own")
    return summed.join(ends, "stream").select("stream", "frame", "p", ((F.col("inside") + beyond) / frames).alias("smooth"))


def _numbered(track: DataFrame, flag: Column) -> DataFrame:
    """``track`` with ``flag`` and ``run``, the first frame of the maximal run of equal flags that a frame is in.

    Runs are found within blocks of frames; only those that touch a block's edge, two a block at most, are joined across blocks in one
    window over the stream. Frames count up without gaps."""
    w = W.partitionBy("stream", "block").orderBy("frame")
    marked = track.withColumns({"flag": flag, "block": F.floor(F.col("frame") / BLOCK)})
    begins = F.when(~F.lag("flag").over(w).eqNullSafe(F.col("flag")), F.col("frame"))
    local = marked.withColumn("begin", begins).withColumn("begin", F.max("begin").over(w.rowsBetween(W.unboundedPreceding, 0)))
    pieces = local.groupBy("stream", "block", "begin", "flag").agg((F.max("frame") + 1).alias("end"))
    edges = pieces.where((F.col("begin") % BLOCK == 0) | (F.col("end") % BLOCK == 0))
    order = W.partitionBy("stream").orderBy("begin")
    goes_on = (F.lag("end").over(order) == F.col("begin")) & F.lag("flag").over(order).eqNullSafe(F.col("flag"))
    first = F.max(F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("begin"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    moved = edges.select("stream", "begin", first.alias("run")).where("run != begin")
    return local.join(moved, ["stream", "begin"], "left").withColumn("run", F.coalesce("run", "begin")).drop("block", "begin")


def runs(track: DataFrame, flag: Column) -> DataFrame:
    """Maximal runs of equal ``flag``: stream, flag, start, end (exclusive)."""
    numbered = _numbered(track, flag)
    return numbered.groupBy("stream", "flag", F.col("run").alias("start")).agg((F.max("frame") + 1).alias("end")).select("stream", "flag", "start", "end")


def valley_frames(seconds: float, rate: int, hop: int) -> int:
    """The least number of frames of a valley of so many seconds: two at least."""
    return max(2, -(-round(seconds * rate * 1_000_000) // (hop * 1_000_000)))


def valleys(track: DataFrame, threshold: float, minimum: int) -> DataFrame:
    """Runs of smoothed values at or below ``threshold`` of at least ``minimum`` frames, with their statistics."""
    low = _numbered(track, F.col("smooth") <= threshold).where("flag")
    found = low.groupBy("stream", F.col("run").alias("start")).agg((F.max("frame") + 1).alias("end"), F.avg("smooth").alias("mean"), F.expr("percentile(smooth, 0.95)").alias("p95"))
    found = found.where(F.col("end") - F.col("start") >= minimum).withColumn("center", F.floor((F.col("start") + F.col("end")) / 2))
    # Of two frames or more, the middle one is in the run.
    at = track.select("stream", F.col("frame").alias("center"), F.col("smooth").alias("at_center"))
    return found.join(at, ["stream", "center"]).select("stream", "start", "end", "center", "at_center", "mean", "p95")


def hysteresis(track: DataFrame, threshold: float, min_speech: int, min_silence: int, shift: int, padded: bool = False) -> DataFrame:
    """Regions that begin with more than ``min_speech`` frames above the threshold and end with ``min_silence`` below.

    Two passes of gaps and islands: of the runs that can switch, the first on after each off and the first off after each on.
    """
    events = runs(track, F.col("smooth") >= threshold)
    length = F.col("end") - F.col("start")
    events = events.where(F.when(F.col("flag"), length > min_speech).otherwise(length >= min_silence))
    w = W.partitionBy("stream").orderBy("start")
    switches = events.withColumn("before", F.lag("flag").over(w)).where("before IS NULL AND flag OR before != flag")
    stop = F.lead("start").over(w)
    last = track.groupBy("stream").agg((F.max("frame") + 1).alias("n"))
    paired = switches.withColumn("off", stop).where("flag").join(last, "stream")
    end = F.coalesce(F.col("off") + (min_silence if padded else 0), F.col("n"))
    return paired.select("stream", F.greatest(F.lit(0), F.col("start") - shift).alias("start"), F.least(end, F.col("n")).alias("end"))


def hysteresis_limited(track: DataFrame, threshold: float, min_speech: int, min_silence: int, shift: int, longest: int) -> DataFrame:
    """The same with a longest region, where counting starts anew after a cut: a fold over one stream's frames."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = (pdf.sort_values("frame")["smooth"] >= threshold).tolist()
        out, at, n = [], 0, len(flags)
        while at < n:
            # Look for a confirmed start from here on.
            run = 0
            while at < n and run <= min_speech:
                run = run + 1 if flags[at] else 0
                at += 1
            if run <= min_speech:
                break
            begin, quiet = max(0, at - run - shift), 0
            end = None
            while at < n and end is None:
                quiet = 0 if flags[at] else quiet + 1
                at += 1
                if quiet >= min_silence:
                    end = at - quiet
                elif at - begin >= longest:
                    end = at
            out.append((pdf["stream"].iloc[0], begin, n if end is None else end))
        return pd.DataFrame(out, columns=["stream", "start", "end"])

    return track.select("stream", "frame", "smooth").groupBy("stream").applyInPandas(fold, "stream string, start long, end long")


class _Quiet:
    """The time of a key's last row that was let through; others do not move it."""

    def __init__(self, at: int, quiet: int):
        self.at, self.quiet, self.last = at, quiet, None

    def row(self, r) -> list:
        if self.last is None or r[self.at] - self.last >= self.quiet:
            self.last = r[self.at]
            return [r]
        return []

    def end(self) -> list:
        return []


def throttle(df: DataFrame, key: str, time: str, quiet: int) -> DataFrame:
    """Rows of each key that come at least ``quiet`` after the last row that was let through."""
    rows = df.select(key, "id", time)
    return ordered_scan(rows, [key], [time, "id"], lambda: _Quiet(2, quiet), rows.schema)


def plan_windows(ends: DataFrame, cuts: DataFrame, target: int, soft: int, hard: int, minimum: int, context: int, unit: float) -> DataFrame:
    """Cut each stream (stream, total) into windows at the best valley in reach (cuts: stream, center, width, mean, p95)."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        total, stream = int(pdf["total"].iloc[0]), pdf["stream"].iloc[0]
        at = pdf.dropna(subset=["center"]).sort_values("center")
        windows, start = [], 0
        while total - start > target:
            low, soft_up, up = start + minimum, min(start + soft, total - minimum), min(start + hard, total - minimum)
            pool = at[(at["center"] >= low) & (at["center"] <= up)]
            near = pool[pool["center"] <= soft_up]
            pool = near if len(near) else pool
            if low <= up and len(pool):
                away = (pool["center"] - (start + target)).abs() / unit / max(1e-6, (soft_up - low) / unit)
                cost = 0.65 * away + 0.20 * pool["mean"] + 0.10 * pool["p95"] - 0.05 * (pool["width"] / unit).clip(upper=1.0)
                end, why = int(pool.loc[cost.idxmin(), "center"]), "probability_valley"  # the earlier of equal ones: sorted by center
            elif total - start > hard:
                end, why = up, "hard_max"
            else:
                break
            windows.append((start, end, why))
            start = end
        if start < total:
            windows.append((start, total, "end_of_audio"))
        if len(windows) > 1 and windows[-1][1] - windows[-1][0] < minimum:
            tail, before = windows.pop(), windows.pop()
            windows.append((before[0], tail[1], tail[2]))
        return pd.DataFrame([(stream, i, s, e, max(0, s - context), min(total, e + context), why) for i, (s, e, why) in enumerate(windows)], columns=["stream", "idx", "core_start", "core_end", "input_start", "input_end", "reason"])

    rows = ends.join(cuts, "stream", "left").select("stream", "total", "center", "width", "mean", "p95")
    return rows.groupBy("stream").applyInPandas(plan, "stream string, idx long, core_start long, core_end long, input_start long, input_end long, reason string")


def window_speech(windows: DataFrame, speech: DataFrame) -> DataFrame:
    """Planned windows with the speech (stream, s, e) inside of their input."""
    spans = windows.select("stream", F.col("input_start").alias("s"), F.col("input_end").alias("e"), "idx")
    pairs = overlap_join(spans, speech.select("stream", "s", "e"), BLOCK)
    inside = pairs.groupBy(F.col("l_stream").alias("stream"), F.col("l_idx").alias("idx")).agg(F.sum(F.least("l_e", "r_e") - F.greatest("l_s", "r_s")).alias("speech"))
    return windows.join(inside, ["stream", "idx"], "left").withColumn("speech", F.coalesce("speech", F.lit(0)))


def covered_exactly(windows: DataFrame, ends: DataFrame) -> DataFrame:
    """Whether the cores of each stream's windows follow each other from 0 to its total."""
    order = W.partitionBy("stream").orderBy("idx")
    at = windows.withColumn("before", F.coalesce(F.lag("core_end").over(order), F.lit(0)))
    whole = at.groupBy("stream").agg(F.bool_and((F.col("core_start") == F.col("before")) & (F.col("core_end") > F.col("core_start"))).alias("joined"), F.max("core_end").alias("last"))
    return ends.join(whole, "stream", "left").select("stream", F.when(F.col("total") > 0, F.coalesce(F.col("joined") & (F.col("last") == F.col("total")), F.lit(False))).otherwise(F.col("joined").isNull()).alias("exact"))


def isotonic_expansion(df: DataFrame, durations: DataFrame, minimum: float = 1.0) -> DataFrame:
    """Windows (stream, i, s, e in seconds, in order) at least ``minimum`` (or an even share of the stream's duration) long: only where one is
    shorter, boundaries move by least squares, and stay within the stream."""
    per = df.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("e") - F.col("s")).alias("least")).join(durations, "stream")
    target = per.select("stream", "n", "duration", F.least(F.lit(minimum), F.col("duration") / F.col("n")).alias("target"), "least")
    rows = df.join(target, "stream")
    calm = rows.where("least >= target - 1e-9").select("stream", "i", "s", "e", F.lit(False).alias("moved"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n, target_, end = len(pdf), float(pdf["target"].iloc[0]), float(pdf["duration"].iloc[0])
        room = max(0.0, end - target_ * n)
        inner = np.clip(pdf["e"].iloc[:-1].to_numpy(float) - target_ * np.arange(1, n), 0.0, room)  # inner boundaries, their spacing taken off
        pools: list[list[float]] = []
        for x in inner:
            pools.append([float(x), 1])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
                top = pools.pop()
                pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1]]
        level = np.repeat([a / b for a, b in pools], [int(b) for _, b in pools]) if pools else np.zeros(0)
        cuts = level + target_ * np.arange(1, n)
        return pd.DataFrame({"stream": pdf["stream"], "i": pdf["i"], "s": [0.0, *cuts], "e": [*cuts, end], "moved": True})

    tight = rows.where("least < target - 1e-9").select("stream", "i", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"), "target", "duration")
    return calm.unionByName(tight.groupBy("stream").applyInPandas(fit, "stream long, i long, s double, e double, moved boolean"))


def isotonic(df: DataFrame, spacing: int) -> DataFrame:
    """Least-squares times at least ``spacing`` apart, in order (pool adjacent violators), for rows (stream, i, x)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        pools: list[list[float]] = []
        for x in pdf["x"] - pdf["i"] * spacing:
            pools.append([float(x), 1])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
                top = pools.pop()
                pools[-1][0] += top[0]
                pools[-1][1] += top[1]
        level = [s / n for s, n in pools for _ in range(int(n))]
        return pdf.assign(fitted=[v + i * spacing for v, i in zip(level, pdf["i"])])[["stream", "i", "x", "fitted"]]

    return df.groupBy("stream").applyInPandas(fit, "stream long, i long, x long, fitted double")
