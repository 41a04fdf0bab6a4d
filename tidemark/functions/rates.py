"""Frame rates, frame counts, progress and freshness, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import fixed
from tidemark.functions.timecode import RATES


def nominal(numerator: Column, denominator: Column) -> Column:
    """The whole number of frames a second that a rate is counted by; halves go to the even one."""
    return F.bround(numerator / denominator).cast("long")


def rate_of(name: Column) -> Column:
    """What a timeline's setting says: numerator, denominator, nominal, drop (only at 30 and 60), error."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    bare = F.regexp_replace(upper, r"\s*DF|\s+", "")
    pairs = [F.lit(x) for k, (n, d) in RATES.items() for x in (k, f"{n} {d}")]
    parts = F.split(F.try_element_at(F.create_map(*pairs), bare), " ")
    n, d = F.get(parts, F.lit(0)).cast("long"), F.get(parts, F.lit(1)).cast("long")
    whole = nominal(n, d)
    drop = upper.contains("DF") & whole.isin(30, 60)
    return F.struct(n.alias("numerator"), d.alias("denominator"), whole.alias("nominal"), F.coalesce(drop, F.lit(False)).alias("drop"), F.when(n.isNull(), F.concat(F.lit("Unsupported timeline frame rate: "), F.coalesce(name, F.lit("")))).alias("error"))


def request_rate(name: Column) -> Column:
    """The rate of a job request, as numerator/denominator: a table's name, `` DF`` ignored, or one of its fractions spelt out; null otherwise."""
    text = F.regexp_replace(F.upper(F.trim(name)), " DF", "")
    known = {k: f"{n}/{d}" for k, (n, d) in RATES.items()} | {f"{n}/{d}": f"{n}/{d}" for n, d in RATES.values() if d > 1}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), text)


def ms_to_frames(ms: Column, per_second: int = 100) -> Column:
    """Frames of a length in milliseconds, one at least; halves go to the even one."""
    return F.greatest(F.lit(1), F.bround(ms * per_second / 1000.0).cast("long"))


def native_sample(sample: Column, rate: int) -> Column:
    """A sample's place after a trip through single-precision seconds, rounded to milliseconds."""
    seconds = F.bround((sample / F.lit(float(rate))).cast("float").cast("double"), 3)
    return F.bround(seconds * rate).cast("long")


def percent(value: Column, first: float = 0.0, span: float = 100.0) -> Column:
    """A progress clamped to 0..100 and laid into a part of the whole."""
    return F.lit(first) + F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(value.cast("double"), F.lit(0.0)))) * span / 100.0


def fresh(now: Column, heartbeat: Column, running: Column, limit: int = 10) -> Column:
    """Whether a process that is not known to have stopped gave a sign of life lately."""
    return F.coalesce(running, F.lit(True)) & (now - F.coalesce(heartbeat, F.lit(0)) <= limit)


def speed_shown(n: Column) -> Column:
    """Bytes a second in units of 1000."""
    n = F.greatest(F.lit(0.0), F.coalesce(n.cast("double"), F.lit(0.0)))
    shown = lambda x, pattern, unit: F.concat(fixed(x, pattern), F.lit(unit))
    return F.when(n >= 1e9, shown(n / 1e9, "0.00", " GB/s")).when(n >= 1e6, shown(n / 1e6, "0.0", " MB/s")).when(n >= 1e3, shown(n / 1e3, "0.0", " KB/s")).otherwise(F.format_string("%d B/s", F.floor(n)))
