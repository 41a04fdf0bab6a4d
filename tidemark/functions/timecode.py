"""Subtitle timestamps and frame timecodes, as Column expressions on integers where exactness counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frame rates by name, as exact fractions.
RATES = {"23.976": (24000, 1001), "29.97": (30000, 1001), "59.94": (60000, 1001), "24": (24, 1), "25": (25, 1), "30": (30, 1), "50": (50, 1), "60": (60, 1)}


def parse_rate(name: str) -> tuple[int, int]:
    """The fraction of a rate's name; `` DF`` is ignored; one of the three fractions may be spelt out."""
    text = name.strip().upper().replace(" DF", "")
    by_fraction = {f"{n}/{d}": (n, d) for n, d in RATES.values() if d > 1}
    found = RATES.get(text) or by_fraction.get(text)
    if found is None:
        raise ValueError(f"unsupported frame rate: {name}")
    return found


def _clock(ms: Column) -> Column:
    two = lambda c, n=2: F.lpad(c.cast("long").cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000)
    shown = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    return F.concat(shown, F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), two(ms % 1000, 3))


def srt_timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm; halves of a millisecond go to the even one; hours may pass 99."""
    return _clock(F.greatest(F.lit(0), F.bround(seconds * 1000.0)).cast("long"))


def srt_timestamp_half_up(seconds: Column) -> Column:
    """The same with halves going up."""
    return _clock(F.greatest(F.lit(0), F.floor(seconds * 1000.0 + 0.5)).cast("long"))


def timecode(frames: Column, nominal: int, drop: bool = False) -> Column:
    """HH:MM:SS:FF, or with ``;`` and dropped frame numbers."""
    n = F.greatest(F.lit(0), frames)
    if drop:
        d = 4 if nominal == 60 else 2
        ten, one = nominal * 600 - d * 9, nominal * 60 - d
        n = n % ((nominal * 3600 - d * 54) * 24)
        rest = n % ten
        n = n + d * 9 * F.floor(n / ten) + F.when(rest >= d, d * F.floor((rest - d) / one)).otherwise(0)
    two = lambda c: F.when(c < 100, F.lpad(c.cast("long").cast("string"), 2, "0")).otherwise(c.cast("long").cast("string"))
    return F.concat(two(F.floor(n / (nominal * 3600))), F.lit(":"), two(F.floor(n / (nominal * 60)) % 60), F.lit(":"), two(F.floor(n / nominal) % 60), F.lit(";" if drop else ":"), two(n % nominal))


def seconds_to_frames(seconds: Column, numerator: int, denominator: int) -> Column:
    return F.floor(seconds * numerator / denominator + 0.5)


def srt_block(index: Column, start: Column, end: Column, text: Column, preserve: bool = False) -> Column:
    """One numbered subtitle."""
    body = F.regexp_replace(text, "\r\n?", "\n")
    body = body if preserve else F.regexp_replace(body, r"^\s+|\s+\z", "")
    return F.concat(index.cast("string"), F.lit("\n"), srt_timestamp(start), F.lit(" --> "), srt_timestamp(end), F.lit("\n"), body, F.lit("\n"))
