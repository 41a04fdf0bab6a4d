"""Slots for models: any callable over windows of samples, loaded once in each Python worker, called on Arrow batches.

A slot takes ``load``, a function without arguments that returns the model (a callable); it is called once in a task, before its first
batch. Models are not part of the engine: these operators define what goes in and what comes out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import jobs
from tidemark.operators.audio import ranges

Recogniser = Callable[[list[float], str, str], dict]
Aligner = Callable[[list[float], str, str], list[tuple[str, float, float]]]


def window_samples(track: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows (stream, win, start, end, ...) with their samples (stream, frame, v), in order."""
    asked = windows.select("stream", F.col("win").alias("ask"), "start", "end")
    held = ranges(track, asked).groupBy("stream", F.col("ask").alias("win")).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("x"))
    return windows.join(held.select("stream", "win", F.transform("x", lambda s: s.v).alias("samples")), ["stream", "win"], "left")


def transcribed(windows: DataFrame, load: Callable[[], Recogniser], budget: int = 80, language: str = "Auto") -> DataFrame:
    """What a recogniser says of each window (stream, win, samples, prompt, speech_ms): language, text, error and valid, judged by ``jobs.outcome``.

    The model answers a dictionary as ``jobs.response`` reads it; an answer that is none is a fault of its window, not of the job."""
    import json

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            said = [json.dumps(model(list(v) if v is not None else [], language, p or "")) for v, p in zip(pdf["samples"], pdf["prompt"])]
            yield pdf[["stream", "win", "speech_ms"]].assign(said=said)

    kinds = dict(windows.dtypes)
    answers = windows.select("stream", "win", "samples", "prompt", "speech_ms").mapInPandas(run, f"stream {kinds['stream']}, win {kinds['win']}, speech_ms {kinds['speech_ms']}, said string")
    r = jobs.response(F.col("said"), budget)
    read = answers.select("stream", "win", "speech_ms", r.alias("r"))
    error = F.coalesce(F.col("r.fault"), jobs.outcome(F.col("r.text"), F.col("r.repetition"), F.col("r.hit_limit"), F.col("speech_ms")))
    return read.select("stream", "win", F.col("r.language").alias("language"), F.when(error == "", F.col("r.text")).otherwise("").alias("text"), error.alias("error"), (error == "").alias("valid"))


def aligned(windows: DataFrame, load: Callable[[], Aligner]) -> DataFrame:
    """The tokens a forced aligner finds (stream, win, ord, text, start, end in seconds of the stream) for windows (stream, win, offset, samples, text, language)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            rows = [(r.stream, r.win, i, t, r.offset + a, r.offset + b) for r in pdf.itertuples(index=False) for i, (t, a, b) in enumerate(model(list(r.samples), r.text, r.language))]
            yield pd.DataFrame(rows, columns=["stream", "win", "ord", "text", "start", "end"])

    kinds = dict(windows.dtypes)
    return windows.select("stream", "win", "offset", "samples", "text", "language").mapInPandas(run, f"stream {kinds['stream']}, win {kinds['win']}, ord long, text string, start double, end double")
