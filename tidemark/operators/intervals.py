"""Interval algebra on frames (stream, s, e): half-open integer intervals, partitioned by stream.

Joins carry the stream and a coarse time bucket as equality keys, so a long stream spreads over many tasks and no
plan is a nested loop. Order-dependent operators are window expressions over a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET = 86_400


def merge(df: DataFrame, gap: int = 0, inclusive: bool = False, minimum: int = 1, partition: tuple[str, ...] = ("stream",)) -> DataFrame:
    """Union of intervals, joined across gaps below ``gap`` (``inclusive``: up to it); pieces shorter than ``minimum`` go."""
    order = W.partitionBy(*partition).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = (F.col("s") > reach + gap) if inclusive else (F.col("s") >= reach + gap)
    flagged = df.where("e > s").select(*partition, "s", "e", F.when(reach.isNull() | apart, 1).otherwise(0).alias("new"))
    island = flagged.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = island.groupBy(*partition, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))
    return merged.where(F.col("e") - F.col("s") >= minimum).drop("island")


def merge_regions(df: DataFrame, totals: DataFrame, gap: int, minimum: int) -> DataFrame:
    """Union of regions (stream, s, e, confidence) cut to their stream's 0..``total``, with the highest confidence of what is joined."""
    cut = lambda c: F.greatest(F.lit(0), F.least(F.col("total"), F.col(c)))
    rows = df.join(totals, "stream").select("stream", cut("s").alias("s"), cut("e").alias("e"), "confidence").where("e > s")
    order = W.partitionBy("stream").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    flagged = rows.withColumn("new", F.when(reach.isNull() | (F.col("s") - reach >= gap), 1).otherwise(0))
    island = flagged.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("stream", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("confidence").alias("confidence")).where(F.col("e") - F.col("s") >= minimum).drop("island")


def _bucketed(df: DataFrame, prefix: str, bucket: int) -> DataFrame:
    named = df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
    span = F.sequence(F.floor(F.col(prefix + "s") / bucket), F.floor((F.col(prefix + "e") - 1) / bucket))
    return named.where(F.col(prefix + "e") > F.col(prefix + "s")).withColumn(prefix + "bucket", F.explode(span))


def overlap_join(left: DataFrame, right: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All overlapping pairs of one stream, each once; columns get the prefixes l_ and r_."""
    a, b = _bucketed(left, "l_", bucket), _bucketed(right, "r_", bucket)
    meet = (F.col("l_stream") == F.col("r_stream")) & (F.col("l_bucket") == F.col("r_bucket")) & (F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e"))
    first = F.floor(F.greatest("l_s", "r_s") / bucket)
    return a.join(b, meet & (F.col("l_bucket") == first)).drop("l_bucket", "r_bucket", "r_stream")


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Clipped intersections of overlapping pairs, with the left interval's start and confidence (if it has one) and the right one's id."""
    more = [F.col("l_confidence").alias("confidence")] if "confidence" in left.columns else []
    return overlap_join(left, right).select(F.col("l_stream").alias("stream"), F.col("l_s").alias("region_s"), F.col("r_id").alias("id"), F.greatest("l_s", "r_s").alias("s"), F.least("l_e", "r_e").alias("e"), *more)


def _per_region(regions: DataFrame, claims: DataFrame, value: Column) -> DataFrame:
    """Regions with the aggregate ``value`` over their overlapping claims (null without any)."""
    found = overlap_join(regions.select("stream", "s", "e"), claims.select("stream", "s", "e")).groupBy(F.col("l_stream").alias("stream"), F.col("l_s").alias("s"), F.col("l_e").alias("e")).agg(value.alias("value"))
    return regions.select("stream", "s", "e").distinct().join(found, ["stream", "s", "e"], "left")


def unclaimed(regions: DataFrame, claims: DataFrame) -> DataFrame:
    """Regions that no claim overlaps."""
    return _per_region(regions, claims, F.count(F.lit(1))).where("value IS NULL").drop("value")


def unclaimed_edges(regions: DataFrame, claims: DataFrame, minimum: int) -> DataFrame:
    """Whole regions without a claim, and what follows the last claim where it is long enough."""
    last = _per_region(regions, claims, F.max(F.least("l_e", "r_e")))
    kept = last.where(F.col("value").isNull() | (F.col("e") - F.col("value") >= minimum))
    return kept.select("stream", F.coalesce("value", "s").alias("s"), "e")


def covered(regions: DataFrame, claims: DataFrame) -> DataFrame:
    """Sum of the overlaps of each region with claims."""
    return _per_region(regions, claims, F.sum(F.least("l_e", "r_e") - F.greatest("l_s", "r_s"))).select("stream", "s", "e", F.coalesce("value", F.lit(0)).alias("covered"))


def split_max(df: DataFrame, longest: int) -> DataFrame:
    """Pieces of at most ``longest``, from the start."""
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("e") - F.col("s") - 1) / longest)))
    rest = [c for c in df.columns if c not in ("s", "e")]
    pieces = df.where("e > s").select(*rest, "s", "e", steps.alias("k"))
    return pieces.select(*rest, (F.col("s") + F.col("k") * longest).alias("s"), F.least(F.col("e"), F.col("s") + (F.col("k") + 1) * longest).alias("e"))


def split_at(regions: DataFrame, boundaries: DataFrame, longest: int) -> DataFrame:
    """Regions cut at boundaries (stream, t) strictly inside them, then by length."""
    points = boundaries.select("stream", F.col("t").alias("s"), (F.col("t") + 1).alias("e")).distinct()
    inner = overlap_join(regions.select("stream", "s", "e"), points).where("r_s > l_s").select(F.col("l_stream").alias("stream"), F.col("l_s").alias("rs"), F.col("l_e").alias("re"), F.col("r_s").alias("s"))
    starts = regions.select("stream", F.col("s").alias("rs"), F.col("e").alias("re"), "s").unionByName(inner)
    after = F.lead("s").over(W.partitionBy("stream", "rs", "re").orderBy("s"))
    return split_max(starts.select("stream", "s", F.coalesce(after, "re").alias("e")), longest)


def gaps(df: DataFrame) -> DataFrame:
    """What lies between consecutive intervals of a stream."""
    after = F.lead("s").over(W.partitionBy("stream").orderBy("s", "e"))
    return df.select("stream", F.col("e").alias("s"), after.alias("e")).where("e > s")


def max_overlap(pieces: DataFrame, others: DataFrame) -> DataFrame:
    """The longest overlap of each piece with one of the others."""
    return _per_region(pieces, others, F.max(F.least("l_e", "r_e") - F.greatest("l_s", "r_s"))).select("stream", "s", "e", F.coalesce("value", F.lit(0)).alias("longest"))


def diagnostics(df: DataFrame, duration: int) -> DataFrame:
    """Counts of faults of each stream's intervals, taken in the order of their ids."""
    order = W.partitionBy("stream").orderBy("id")
    seen = df.withColumn("ps", F.lag("s").over(order)).withColumn("pe", F.lag("e").over(order))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    s, e = F.col("s"), F.col("e")
    return seen.groupBy("stream").agg(count(e <= s).alias("invalid"), count((s < 0) | (e > duration)).alias("out_of_bounds"), count(s < F.col("ps")).alias("non_monotonic"), count(s < F.col("pe")).alias("overlapping"), F.count(F.lit(1)).alias("n"))


def contained(regions: DataFrame, speech: DataFrame) -> DataFrame:
    """Regions that begin inside, and end no later than, one interval of ``speech``."""
    pairs = overlap_join(regions.select("stream", "s", "e"), speech.select("stream", "s", "e")).where("r_s < l_s AND r_e >= l_e")
    return pairs.select(F.col("l_stream").alias("stream"), F.col("l_s").alias("s"), F.col("l_e").alias("e")).distinct()


def with_context(regions: DataFrame, speech: DataFrame, context: int) -> DataFrame:
    """Regions widened by ``context`` on both sides, but not into neighbouring speech: as-of look-ups by window, no range join."""
    one = lambda df, t, kind, *more: df.select("stream", t.alias("t"), F.lit(kind).alias("kind"), *more)
    blank = [F.lit(None).cast("long").alias(c) for c in ("s", "e")]
    own = [F.col("s"), F.col("e")]
    before = one(speech, F.col("e"), 0, *blank).unionByName(one(regions, F.col("s"), 1, *own))
    latest = F.max(F.when(F.col("kind") == 0, F.col("t"))).over(W.partitionBy("stream").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0))
    left = before.withColumn("previous", latest).where("kind = 1").select("stream", "s", "e", "previous")
    after = one(speech, F.col("s"), 1, *blank, F.lit(None).cast("long").alias("previous")).unionByName(one(left, F.col("e"), 0, *own, F.col("previous")))
    soonest = F.min(F.when(F.col("kind") == 1, F.col("t"))).over(W.partitionBy("stream").orderBy("t", "kind").rowsBetween(0, W.unboundedFollowing))
    both = after.withColumn("following", soonest).where("kind = 0")
    lo = F.greatest(F.col("s") - context, F.coalesce("previous", F.col("s") - context))
    hi = F.least(F.col("e") + context, F.coalesce("following", F.col("e") + context))
    return both.select("stream", "s", "e", lo.alias("input_s"), hi.alias("input_e"))


def remove_gaps(df: DataFrame) -> DataFrame:
    """Each interval ends where the next begins, if that is later than its own start; the last is unchanged."""
    after = F.lead("s").over(W.partitionBy("stream").orderBy("s", "e", "id"))
    return df.select("stream", "id", "s", F.when(after > F.col("s"), after).otherwise(F.col("e")).alias("e"))


def snap(df: DataFrame, numerator: int, denominator: int = 1, unit: int = 1000) -> DataFrame:
    """Times in 1/``unit`` s to whole frames, in order, each at least a frame long and none overlapping.

    Closed form of the left-to-right rule: with f(i) = greatest(end frame, start frame + 1) - i, the end is
    i plus the running maximum of f, and a start is not before the previous end.
    """
    order = W.partitionBy("stream").orderBy("s", "e", "id")
    # Whole numbers throughout: a product of milliseconds since 1970 is beyond what a double holds exactly.
    each = denominator * unit
    fs = F.expr(f"(s * {numerator}L - pmod(s * {numerator}L, {each}L)) div {each}L")
    fe = F.expr(f"(e * {numerator}L + pmod(-(e * {numerator}L), {each}L)) div {each}L")
    at = df.select("stream", "id", "s", "e", fs.alias("fs"), fe.alias("fe"), F.row_number().over(order).cast("long").alias("i"))
    end = (F.col("i") + F.max(F.greatest(F.col("fe"), F.col("fs") + 1) - F.col("i")).over(order.rowsBetween(W.unboundedPreceding, 0))).alias("end_frame")
    ended = at.select("stream", "id", "s", "e", "fs", end)
    start = F.greatest(F.col("fs"), F.coalesce(F.lag("end_frame").over(order), F.col("fs")))
    return ended.select("stream", "id", start.alias("start_frame"), "end_frame")


def anchors(df: DataFrame, least: int, duration: Column | int) -> DataFrame:
    """Boundaries at midpoints between neighbours, at least ``least`` apart and leaving as much for each that follows."""
    order = W.partitionBy("stream").orderBy("s", "e", "id")
    n = F.count(F.lit(1)).over(W.partitionBy("stream"))
    at = df.select("stream", "id", F.row_number().over(order).cast("long").alias("p"), n.alias("n"), F.floor((F.col("e") + F.lead("s").over(order)) / 2).alias("middle"), (F.lit(duration) if isinstance(duration, int) else duration).alias("duration")).where("middle IS NOT NULL")
    run = F.max(F.col("middle") - F.col("p") * least).over(W.partitionBy("stream").orderBy("p").rowsBetween(W.unboundedPreceding, 0))
    return at.select("stream", "id", "p", (F.col("p") * least + F.least(F.col("duration") - F.col("n") * least, F.greatest(F.lit(0), run))).alias("boundary"))


def pauses(df: DataFrame) -> DataFrame:
    """Pause before the next interval, and its score in tiers of 0.3, 0.5 and 0.8 of a unit of 1000."""
    after = F.lead("s").over(W.partitionBy("stream").orderBy("s", "e", "id"))
    pause = F.coalesce(F.greatest(F.lit(0), after - F.col("e")), F.lit(0))
    return df.select("stream", "id", pause.alias("pause")).withColumn("score", F.when(F.col("pause") >= 800, 100).when(F.col("pause") >= 500, 40).when(F.col("pause") >= 300, 8).otherwise(0))
