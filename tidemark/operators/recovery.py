"""Recovery of uncovered speech: recovered transcripts are only believed where the first transcript supports them.

``supported`` gives each recovery window (stream, win, s, e, text) the run of first tokens (stream, id, s, e, text) that its text ends
with; a token serves one window. The table of candidates, tokens near each window, comes from an interval join; what is left for a
fold by stream is the choice, in the order of windows, of those not yet taken.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import text as tx
from tidemark.operators.intervals import overlap_join

#: Seconds ahead of a window, tokens looked at, shares that count as alike.
AHEAD, MOST, SHORT_ALIKE, ALIKE, SINGLE_CORE, SINGLE_AHEAD = 5.0, 24, 2 / 3, 0.45, 1.5, 2.0


def likeness(recovered: str, first: str) -> float | None:
    """How well normalised first text agrees with the end of a recovered one; None if that is too little."""
    if not first or len(first) > len(recovered):
        return None
    tail = recovered[-len(first) :]
    if tail == first:
        return 1.0
    ratio = SequenceMatcher(None, tail, first, autojunk=False).ratio()
    return ratio if len(first) > 1 and ratio >= (SHORT_ALIKE if len(first) <= 3 else ALIKE) else None


def first_match(windows: DataFrame, records: DataFrame) -> DataFrame:
    """For each window (stream, win, s, e, norm) the earliest unclaimed record (stream, idx, s, e, norm, text, claimed) of equal text that overlaps it."""
    keyed = lambda df, *more: df.where("norm != ''").select(F.concat_ws("\x01", F.col("stream").cast("string"), "norm").alias("stream"), F.col("stream").alias("own"), "s", "e", *more)
    pairs = overlap_join(keyed(windows, "win"), keyed(records.where("NOT claimed"), "idx", "text"))
    return pairs.groupBy(F.col("l_own").alias("stream"), F.col("l_win").alias("win")).agg(F.min(F.struct(F.col("r_idx").alias("idx"), F.col("r_text").alias("text"))).alias("m")).select("stream", "win", F.col("m.idx").alias("anchor"), F.col("m.text").alias("anchor_text"))


def candidates(windows: DataFrame, tokens: DataFrame, unit: float = 1.0, bucket: int = 3600) -> DataFrame:
    """Tokens with text that end after a window's start and begin up to ``AHEAD`` seconds behind its end (times in 1/``unit`` s)."""
    wide = windows.select("stream", "win", "s", (F.col("e") + F.lit(AHEAD * unit).cast("long") + 1).alias("e"))
    near = overlap_join(wide, tokens.select("stream", "id", "s", "e", "text"), bucket)
    return near.select(F.col("l_stream").alias("stream"), F.col("l_win").alias("win"), F.col("r_id").alias("id"), F.col("r_s").alias("token_s"), F.col("r_e").alias("token_e"), F.col("r_text").alias("token_text"), tx.normalize(F.col("r_text")).alias("token_norm")).where("token_norm != ''")


def supported(windows: DataFrame, tokens: DataFrame, anchors: DataFrame | None = None, unit: float = 1.0) -> DataFrame:
    """stream, win, state, ids: ``matched`` with its tokens; ``anchored`` where an unclaimed first record has the same text
    (``anchors``: stream, win, anchor_text); else ``rejected``. Of runs that agree the longest wins, then the closest, then the first."""
    near = candidates(windows, tokens, unit)
    listed = near.groupBy("stream", "win").agg(F.array_sort(F.collect_list(F.struct("token_s", "token_e", "id", "token_norm", "token_text"))).alias("near"))
    rows = windows.select("stream", "win", "s", "e", "text", tx.normalize(F.col("text")).alias("norm")).join(listed, ["stream", "win"], "left")
    rows = rows.join(anchors.select("stream", "win", "anchor_text"), ["stream", "win"], "left") if anchors is not None else rows.withColumn("anchor_text", F.lit(None).cast("string"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        out = []
        for r in pdf.sort_values(["s", "e", "win"]).itertuples(index=False):
            free = [t for t in (r.near if r.near is not None else []) if t["id"] not in taken][:MOST]
            runs = list(accumulate((t["token_norm"] for t in free)))
            scores = [(len(text), how, -n) for n, text in enumerate(runs, 1) if (how := likeness(r.norm or "", text)) is not None and _single(text, r, free[0], unit)]
            if scores:
                ids = [t["id"] for t in free[: -max(scores)[2]]]
            else:
                ids = [free[0]["id"]] if free and _lone(r, free[0], unit) else []
            taken.update(ids)
            out.append((r.stream, r.win, "matched" if ids else "anchored" if isinstance(r.anchor_text, str) else "rejected", ids))
        return pd.DataFrame(out, columns=["stream", "win", "state", "ids"])

    return rows.groupBy("stream").applyInPandas(choose, "stream long, win long, state string, ids array<long>")


def _close(window, token, unit: float) -> bool:
    return window.e - window.s <= SINGLE_CORE * unit and token["token_s"] <= window.e + SINGLE_AHEAD * unit


def _marked(text: str | None) -> bool:
    import unicodedata

    return any(unicodedata.category(c)[0] == "P" for c in text or "")


def _single(run: str, window, token, unit: float) -> bool:
    """A run of one character needs a short window, a near token and marks beside it."""
    return len(run) > 1 or (_close(window, token, unit) and _marked(token["token_text"]))


def _lone(window, token, unit: float) -> bool:
    """One character for one character, both with marks."""
    return len(window.norm or "") == 1 and len(token["token_norm"]) == 1 and _close(window, token, unit) and _marked(window.text) and _marked(token["token_text"])


def moved(initial: DataFrame, recovered: DataFrame, plan: DataFrame, accepted: DataFrame) -> DataFrame:
    """First and recovered tokens together: of accepted windows (stream, win) the recovered tokens come and the first tokens that they took (``plan``) go."""
    taken = plan.join(accepted, ["stream", "win"], "left_semi").select("stream", F.explode("ids").alias("id"))
    kept = initial.join(taken, ["stream", "id"], "left_anti")
    new = recovered.join(accepted, ["stream", "win"], "left_semi").select(*initial.columns)
    return kept.withColumn("recovered", F.lit(False)).unionByName(new.withColumn("recovered", F.lit(True)))


def without_prefix(tokens: DataFrame, norm: Column) -> DataFrame:
    """Tokens (stream, ord, text, prefix) behind the first ``prefix`` normalised characters of their stream; ``valid`` is false, and the
    stream keeps its tokens, where no token ends exactly there."""
    w = W.partitionBy("stream").orderBy("ord")
    size = F.length(norm)
    at = tokens.withColumn("so_far", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("n_", size)
    met = F.max(F.when((F.col("so_far") == F.col("prefix")) & (F.col("n_") > 0), F.col("ord"))).over(W.partitionBy("stream"))
    at = at.withColumn("met", met).withColumn("valid", (F.col("prefix") == 0) | F.col("met").isNotNull())
    return at.where((F.col("prefix") == 0) | F.col("met").isNull() | (F.col("ord") > F.col("met"))).drop("so_far", "n_", "met")


def context_windows(regions: DataFrame, speech: DataFrame, total: Column | int, context: int, speech_context: int) -> DataFrame:
    """Recovery windows: regions (stream, s, e) widened by ``context``, not into neighbouring speech, and by ``speech_context`` at most into
    speech that a region's edge lies in."""
    total = F.lit(total) if isinstance(total, int) else total
    wide = regions.select("stream", (F.col("s") - context).alias("s"), (F.col("e") + context).alias("e"), F.col("s").alias("cs"), F.col("e").alias("ce"))
    near = overlap_join(wide, speech.select("stream", "s", "e"))
    low = F.when(F.col("r_e") <= F.col("l_cs"), F.col("r_e")).when((F.col("r_s") < F.col("l_cs")) & (F.col("r_e") > F.col("l_cs")), F.col("l_cs") - speech_context)
    high = F.when(F.col("r_s") >= F.col("l_ce"), F.col("r_s")).when((F.col("r_s") < F.col("l_ce")) & (F.col("r_e") > F.col("l_ce")), F.col("l_ce") + speech_context)
    found = near.groupBy(F.col("l_stream").alias("stream"), F.col("l_cs").alias("s"), F.col("l_ce").alias("e")).agg(F.max(low).alias("low"), F.min(high).alias("high"), F.sum(F.greatest(F.lit(0), F.least("l_ce", "r_e") - F.greatest("l_cs", "r_s"))).alias("speech"))
    out = regions.select("stream", "s", "e").join(found, ["stream", "s", "e"], "left")
    return out.select("stream", "s", "e", F.greatest(F.lit(0), F.col("s") - context, F.coalesce("low", F.lit(0))).alias("input_s"), F.least(total, F.col("e") + context, F.coalesce("high", total)).alias("input_e"), F.coalesce("speech", F.lit(0)).alias("speech"))


def alignment_windows(windows: DataFrame) -> DataFrame:
    """What a window (core_s, core_e, in_s, in_e, speech, recovery, reason, prefix) is aligned on: its input; but its core alone where it is the
    rest of a region and no prefix of known tokens was put before it."""
    alone = F.col("recovery") & (F.col("reason") == "recovery_suffix") & (F.col("prefix") == 0)
    pick = lambda inner, outer: F.when(alone, F.col(inner)).otherwise(F.col(outer))
    speech = F.when(alone, F.least("speech", F.col("core_e") - F.col("core_s"))).otherwise(F.col("speech"))
    return windows.withColumns({"in_s": pick("core_s", "in_s"), "in_e": pick("core_e", "in_e"), "speech": speech})
