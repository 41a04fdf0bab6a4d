"""Canonical frames over the driver's tables: timed intervals, signal tracks, text lines, jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """stream, id, kind, s, e (seconds): one interval for each event, of the given kinds."""
    events = table(spark, sf_dir, "events")
    if kinds:
        events = events.where(F.col("event_type").isin(*kinds))
    s = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return events.select(F.col("user_id").alias("stream"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), s.alias("s"), (s + 1 + F.floor(F.col("value") * 300)).alias("e"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, frame, p: a probability track for each kind of event, in time order."""
    order = W.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("p"))


#: Bytes of text that are split at once, if they are of more than one row.
TEXT = 1 << 20
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _words(text: pa.StringArray) -> pa.ListArray:
    """What stands between the blanks of each text; none in a null."""
    off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    shown = ~_BLANK[data]
    if text.null_count:
        shown &= np.repeat(np.asarray(text.is_valid()), np.diff(off))
    begins = shown.copy()
    begins[1:] &= ~shown[:-1]
    inner = off[1:-1][off[1:-1] < len(data)]
    begins[inner] = shown[inner]
    begins = np.flatnonzero(begins)
    places = np.concatenate([[0], np.cumsum(shown, dtype=np.int32)]).astype(np.int32)  # of each byte among those shown
    flat = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(places[begins], places[-1])), pa.py_buffer(data[shown]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, off), pa.int32()), flat)


def timed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """stream, lang, texts, starts, ends of rows (stream, lang, text), some rows at a time: see ``token_rows``."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0), np.int64)) if len(batch) else np.zeros(0, np.int64)
    x = 0
    while x < len(batch):
        y = max(x + 1, int(np.searchsorted(sizes, (sizes[x - 1] if x else 0) + TEXT, side="right")))
        yield _timed(batch.slice(x, y - x))
        x = y


def _timed(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = _words(batch.column(2).cast(pa.string()))
    at, flat = np.asarray(texts.offsets, np.int64), texts.flatten()
    size = np.diff(at)
    ended = np.asarray(pc.match_substring_regex(flat, "[.!?]$"), bool) if len(flat) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(ended)])[: len(flat)]
    base = np.concatenate([before, [0]])[np.minimum(at[:-1], len(before))] if len(size) else np.zeros(0, np.int64)
    starts = (np.arange(len(flat)) - np.repeat(at[:-1], size)) * 400 + (before - np.repeat(base, size)) * 900
    listed = lambda v: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v.astype(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, listed(starts), listed(starts + 350)], ["stream", "lang", "texts", "starts", "ends"])


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, lang, text: what ``timed`` takes."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream"), "lang", "text")


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, lang, texts, starts, ends: words of documents with even times (ms) and a pause after each sentence end, one row for each document."""
    return document_texts(spark, sf_dir).mapInArrow(lambda batches: (part for batch in batches for part in timed(batch)), "stream long, lang string, texts array<string>, starts array<long>, ends array<long>")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, lang, ord, text, ms_start, ms_end: the same, one row for each word."""
    each = token_rows(spark, sf_dir).select("stream", "lang", F.posexplode(F.arrays_zip("texts", "starts", "ends")).alias("ord", "t"))
    return each.select("stream", "lang", F.col("ord").cast("long").alias("ord"), F.col("t.texts").alias("text"), F.col("t.starts").alias("ms_start"), F.col("t.ends").alias("ms_end"))
