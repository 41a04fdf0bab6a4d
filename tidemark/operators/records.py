"""Smaller operators on timed records: candidates, choice, report and table scans, checks, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.intervals import overlap_join
from tidemark.operators.scan import ordered_scan


def token_candidates(windows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens that overlap a window's core, with the distance to the nearer edge of the window's input (in_s, in_e)."""
    pairs = overlap_join(windows, tokens)
    edge = F.greatest(F.lit(0), F.least(F.col("r_s") - F.col("l_in_s"), F.col("l_in_e") - F.col("r_e")))
    return pairs.select(F.col("l_stream").alias("stream"), F.col("l_win").alias("win"), F.col("r_id").alias("id"), edge.alias("edge_distance"))


def claimed(windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Whether each window has a candidate."""
    owners = candidates.select(F.col("stream").alias("s_"), F.col("win").alias("w_")).distinct()
    return windows.join(owners, (F.col("stream") == F.col("s_")) & (F.col("win") == F.col("w_")), "left").select("stream", "win", F.col("w_").isNotNull().alias("claimed"))


def same_occurrence(df: DataFrame) -> DataFrame:
    """Pairs of different windows with one text that overlap at least half of the shorter: equality on (stream, norm), then time."""
    keyed = df.select(F.concat_ws("\x01", F.col("stream").cast("string"), "norm").alias("stream"), "id", "win", "s", "e")
    pairs = overlap_join(keyed, keyed).where("l_id < r_id AND l_win != r_win")
    both = F.least("l_e", "r_e") - F.greatest("l_s", "r_s")
    shorter = F.least(F.col("l_e") - F.col("l_s"), F.col("r_e") - F.col("r_s"))
    return pairs.where((both * 2 >= shorter) & (shorter > 0)).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def best_valley(asks: DataFrame, valleys: DataFrame, bucket: int) -> DataFrame:
    """The cheapest valley in each ask's reach (stream, ask, low, soft, up, target): those up to ``soft`` first, then the earlier of equal ones."""
    points = valleys.select("stream", F.col("center").alias("s"), (F.col("center") + 1).alias("e"), "center", "width", "mean", "p95")
    reach = asks.select("stream", "ask", F.col("low").alias("s"), (F.col("up") + 1).alias("e"), "low", "soft", "target")
    pairs = overlap_join(reach, points, bucket)
    cost = 0.65 * F.abs(F.col("r_center") - F.col("l_target")) / F.greatest(F.lit(1e-6), F.col("l_soft") - F.col("l_low")) + 0.20 * F.col("r_mean") + 0.10 * F.col("r_p95") - 0.05 * F.least(F.lit(1.0), F.col("r_width"))
    order = F.struct((F.col("r_center") > F.col("l_soft")).alias("far"), F.round(cost, 9).alias("cost"), F.col("r_center").alias("c"))
    return pairs.groupBy(F.col("l_stream").alias("stream"), F.col("l_ask").alias("ask")).agg(F.min(order).alias("m")).select("stream", "ask", F.col("m.c").alias("center"))


def interval_ratios(df: DataFrame, duration: Column | float) -> DataFrame:
    """Share of different intervals, and share of the stream's ``duration`` between the first start and the last end."""
    whole = F.lit(duration) if isinstance(duration, (int, float)) else F.max(duration)
    return df.groupBy("stream").agg((F.count_distinct("s", "e") / F.count(F.lit(1))).alias("unique_ratio"), F.when(whole > 0, F.greatest(F.lit(0), F.max("e") - F.min("s")) / whole).otherwise(0.0).alias("span_ratio"))


def verified_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """What is wrong with each expected file (name, size, sha): missing, size, hash or nothing."""
    other = present.select(F.col("name").alias("n_"), F.col("size").alias("z_"), F.col("sha").alias("h_"))
    fault = F.when(F.col("n_").isNull(), "missing").when(F.col("size") != F.col("z_"), "size").when(F.col("sha") != F.col("h_"), "hash").otherwise("ok")
    return expected.join(other, F.col("name") == F.col("n_"), "left").select("name", fault.alias("state"))


def report_rows(reports: DataFrame, column: str) -> DataFrame:
    """Intervals of a report (a JSON object of language to list of [start, end]): language, index from 1, start, end."""
    kinds = "map<string,array<array<double>>>"
    by_language = reports.select("report_id", F.explode(F.from_json(column, kinds)).alias("language", "spans"))
    each = by_language.select("report_id", "language", F.posexplode("spans").alias("i", "span"))
    return each.select("report_id", "language", (F.col("i") + 1).cast("long").alias("idx"), F.col("span")[0].alias("start"), F.col("span")[1].alias("end"))


def track_items(items: DataFrame, rate: Column) -> DataFrame:
    """Items of the first enabled track that has any (stream, track, enabled, start_frame, end_frame), as seconds from the stream's start, not below 0."""
    first = F.min(F.when(F.col("enabled"), F.col("track"))).over(W.partitionBy("stream"))
    base = F.col("base_frame")
    chosen = items.withColumn("first", first).where("enabled AND track = first")
    second = lambda f: F.greatest(F.lit(0.0), (F.col(f) - base) / rate)
    return chosen.select("stream", "id", F.round(second("start_frame"), 6).alias("start"), F.round(second("end_frame"), 6).alias("end"))


def render_range(marks: DataFrame) -> DataFrame:
    """The first of video, audio and all marks that is complete; half a mark is an error; without marks the whole timeline."""
    half = F.lit(False)
    for k in ("video", "audio", "both"):
        half = half | (F.col(f"{k}_in").isNull() != F.col(f"{k}_out").isNull())
    full = F.coalesce(*[F.when(F.col(f"{k}_in").isNotNull() & F.col(f"{k}_out").isNotNull(), F.struct(F.col(f"{k}_in").alias("a"), F.col(f"{k}_out").alias("b"))) for k in ("video", "audio", "both")])
    return marks.select("id", F.when(half, "partial").when(full.isNull(), "whole").otherwise("marked").alias("kind"), F.when(~half, full["a"]).alias("start"), F.when(~half, full["b"]).alias("end"))


def error_class(text: Column) -> Column:
    """A backend fault by what its message says."""
    low = F.lower(text)
    return F.when(low.rlike("outofmemory|out of memory"), "memory").when(low.rlike("mps backend|mps runtime|metal command buffer"), "mps").when(low.rlike("cuda error|cudnn|cublas"), "cuda").otherwise("other")


def pages(df: DataFrame, size: int) -> DataFrame:
    """Page and place of each row of a stream, in the order of ids."""
    n = F.row_number().over(W.partitionBy("stream").orderBy("id")) - 1
    return df.select("stream", "id", F.floor(n / size).alias("page"), (n % size).cast("long").alias("place"))


def next_match(df: DataFrame, hit: Column) -> DataFrame:
    """For each row the id of the next one that matches, from the first again after the last."""
    order = W.partitionBy("stream").orderBy("id")
    marked = df.select("stream", "id", F.when(hit, F.col("id")).alias("hit"))
    after = F.first("hit", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    first = F.min("hit").over(W.partitionBy("stream"))
    return marked.select("stream", "id", F.coalesce(after, first).alias("next"))


class _Speed:
    """A speed that follows new amounts and falls by half while there are none."""

    def __init__(self, keep: float):
        self.keep, self.speed = keep, 0.0

    def row(self, r) -> list:
        amount = max(0.0, r[2])
        if amount > 0:
            self.speed = self.keep * self.speed + (1 - self.keep) * amount if self.speed > 0 else amount
        else:
            self.speed = self.speed / 2 if self.speed >= 2 else 0.0
        return [(*r, self.speed)]

    def end(self) -> list:
        return []


def speeds(df: DataFrame, keep: float = 0.65) -> DataFrame:
    """Smoothed speed of a stream's amounts (stream, id, amount): 0.65 of the old and 0.35 of the new, the new alone after a
    standstill; without an amount half of the old, nothing below 1."""
    rows = df.select("stream", "id", F.col("amount").cast("double").alias("amount"))
    return ordered_scan(rows, ["stream"], ["id"], lambda: _Speed(keep), "stream long, id long, amount double, speed double")
