import json

from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import live


def test_srt_round_trip(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 0, 0, 1500, "Hi\nthere"), (1, 1, 1600, 4_000_000, "End")], "stream long, idx long, ms_start long, ms_end long, text string")
    files.export_srt(blocks, f"{tmp_path}/srt")
    got = files.read_srt(spark, f"{tmp_path}/srt/*").orderBy("idx").collect()
    assert [(r.idx, r.ms_start, r.ms_end, r.text) for r in got] == [(1, 0, 1500, "Hi\nthere"), (2, 1600, 4_000_000, "End")]


def test_srt_rows_keep_blanks(spark, tmp_path):
    blocks = spark.createDataFrame([(k, i, 1000 * i, 1000 * i + 500, " a \n") for k in (1, 2) for i in range(3)], "stream long, idx long, ms_start long, ms_end long, text string")
    files.write_srt(blocks, f"{tmp_path}/rows", preserve=True)
    rows = spark.read.json(f"{tmp_path}/rows")
    assert sorted(r.srt.count(" a \n") for r in rows.collect()) == [3, 3]
    files.write_srt(blocks, f"{tmp_path}/rows")
    assert sorted((r.stream, r.idx, r.ms_start, r.text) for r in files.parse_srt(spark.read.json(f"{tmp_path}/rows"), "srt", "stream").collect()) == [(k, i + 1, 1000 * i, "a") for k in (1, 2) for i in range(3)]


def test_requests(spark):
    good = {"protocol": 1, "job_id": "a-1", "mode": "auto_subtitle", "audio_path": "x"}
    rows = [good, good | {"job_id": "a b"}, good | {"protocol": 2}, good | {"mode": "script_match"}, good | {"subtitle": {"max_chars": 0}}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    assert [r.error for r in files.parse_requests(df).collect()] == [None, "job_id", "protocol", "reference_text", "max_chars"]


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("de", 1.5), ("de", 2.0), ("en", 1.0)], "lang string, seconds double")
    files.write_report(rows, str(tmp_path / "r"), "lang", F.col("seconds"))
    assert sorted((r.lang, r.n, r.total) for r in spark.read.json(str(tmp_path / "r/totals")).collect()) == [("de", 2, 3.5), ("en", 1, 1.0)]


def test_wav(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(b"\x00\x40\x00\x00" * 10)
    got = files.read_wav(spark, str(tmp_path / "a.wav"), block=4).orderBy("at").collect()
    assert [len(r["values"]) for r in got] == [4, 4, 2] and got[0]["values"][0] == 0.25


def run(query, name, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)


def test_sessions(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/events").schema).parquet(f"{tmp_path}/events")
    run(live.interval_sessions(stream), "sessions", "complete")
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tmp_path}/events").count()


def test_throttle_and_progress(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1000 + t) for t in (0, 10, 29, 30, 45, 60, 61)] + [("b", 1005)], "signature string, s long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/log")
    run(live.throttle(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/log")), "log")
    assert sorted(map(tuple, spark.table("log").collect())) == [("a", 1000), ("a", 1030), ("a", 1060), ("b", 1005)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # a key's rows in several batches, out of order
    try:
        rows = spark.createDataFrame([("a", 1000 + t) for t in (61, 45, 60, 10, 0, 29, 30)], "signature string, s long")
        rows.coalesce(1).write.parquet(f"{tmp_path}/mixed")
        run(live.throttle(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/mixed")), "mixed")
        assert sorted(map(tuple, spark.table("mixed").collect())) == [("a", 1000), ("a", 1030), ("a", 1060)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.createDataFrame([("j", 10), ("j", 140), ("k", 5)], "job string, progress long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/status")
    run(live.job_progress(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/status")), "status", "update")
    assert sorted(map(tuple, spark.table("status").collect())) == [("j", 100, 2), ("k", 5, 1)]
