"""Readers and writers: SRT, JSON documents, job requests, CSV and JSON reports, PCM WAV."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import timecode as tc
from tidemark.operators.jobs import checked_request


def parse_requests(rows: DataFrame, column: str = "value") -> DataFrame:
    """Job requests from JSON text, with defaults, and what is wrong with them in ``error`` (null: nothing)."""
    return rows.select(checked_request(F.col(column)).alias("r")).select("r.*")


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row for each file that holds a JSON object."""
    return spark.read.schema(schema).json(path, multiLine=True)


def parse_srt(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """idx, ms_start, ms_end, text of the subtitles in whole SRT texts."""
    blocks = rows.select(*keys, F.explode(F.split(F.regexp_replace(column, "\r\n?", "\n"), r"\n\n+(?=\d+\n)")).alias("block"))
    rx = r"(?s)^\s*(\d+)\n(\d+):(\d\d):(\d\d),(\d{3}) --> (\d+):(\d\d):(\d\d),(\d{3})\n(.*?)\n*\z"
    n = lambda i: F.regexp_extract("block", rx, i).cast("long")
    ms = lambda i: ((n(i) * 60 + n(i + 1)) * 60 + n(i + 2)) * 1000 + n(i + 3)
    return blocks.where(F.col("block").rlike(rx)).select(*keys, n(1).alias("idx"), ms(2).alias("ms_start"), ms(6).alias("ms_end"), F.regexp_extract("block", rx, 10).alias("text"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, ms_start, ms_end, text of the subtitles in the files under ``path``."""
    return parse_srt(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), "value", "file")


def rendered(blocks: DataFrame, key: str = "stream", preserve: bool = False) -> DataFrame:
    """``key`` and its subtitles (idx, ms_start, ms_end, text) in order as one SRT text; ``preserve`` keeps blanks around texts."""
    block = tc.srt_block(F.col("idx") + 1, F.col("ms_start") / 1000.0, F.col("ms_end") / 1000.0, F.col("text"), preserve)
    return blocks.select(key, F.struct("idx", block.alias("block")).alias("b")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x.block), "\n").alias("srt"))


def write_srt(blocks: DataFrame, path: str, key: str = "stream", preserve: bool = False) -> None:
    """Keyed rows (JSON lines of ``key`` and ``srt``): as many files as tasks, however many streams there are."""
    rendered(blocks, key, preserve).write.mode("overwrite").json(path)


def export_srt(blocks: DataFrame, path: str, key: str = "stream", preserve: bool = False) -> None:
    """One folder with one SRT file for each key: for the streams of a job, not for a corpus."""
    rendered(blocks, key, preserve).withColumnRenamed("srt", "value").write.partitionBy(key).mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, group: str, amount: Column) -> None:
    """CSV rows, and JSON and Markdown totals by group."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    totals = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), 6).alias("total"))
    totals.write.mode("overwrite").json(f"{path}/totals")
    totals.select(F.format_string("| %s | %d | %s |", F.col(group).cast("string"), "n", F.col("total").cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/markdown")


def read_wav(spark: SparkSession, path: str, block: int = 480_000) -> DataFrame:
    """path, rate, at, values: mono samples of 16-bit PCM files in blocks, channels averaged."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    at = 0
                    while data := w.readframes(block):
                        values = np.frombuffer(data, "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768.0
                        yield pd.DataFrame({"path": [name], "rate": [w.getframerate()], "at": [at], "values": [values.astype(np.float32)]})
                        at += len(values)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, rate int, at long, values array<float>")
