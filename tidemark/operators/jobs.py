"""Jobs and their documents: requests, settings, queue, retention, manifests, status rows, diagnostic and row forms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import text as tx

#: What a request may say.
LANGUAGES = ("Auto", "Chinese", "Cantonese", "English", "French", "German", "Italian", "Japanese", "Korean", "Portuguese", "Russian", "Spanish")
INTERFACES, ACTIONS, MODES = ("cn", "en"), ("transcribe", "download_models", "self_test", "cleanup_temp", "shutdown"), ("auto_subtitle", "script_match")
TERMINAL = ("done", "cancelled", "error")


def _is_object(body: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))


def checked_request(body: Column, protocol: int = 1) -> Column:
    """A job request's JSON as a struct with defaults filled in and ``error``, the first rule that it breaks; null if none."""
    raw = F.from_json(body, "protocol string, job_id string, language string, ui_language string, action string, audio_path string, mode string, reference_text string, download_source string, subtitle struct<max_chars:string, remove_gaps:boolean, trim_end_punctuation:boolean>, timeline struct<fps:string, start_frame:string>")
    text = lambda c, default="": F.coalesce(raw[c], F.lit(default))
    job, mode, action, source = F.trim(text("job_id")), F.trim(text("mode", MODES[0])), text("action", ACTIONS[0]), F.trim(text("download_source"))
    width = F.coalesce(raw["subtitle"]["max_chars"].try_cast("int"), F.when(raw["subtitle"]["max_chars"].isNull(), 42))
    written = raw["reference_text"].rlike(r"(?U)[^\s\x1C-\x1F]")
    error = (
        F.when(~_is_object(body), "not an object")
        .when(F.coalesce(raw["protocol"].try_cast("int"), F.lit(0)) != protocol, "protocol")
        .when(~job.rlike(r"^[A-Za-z0-9_-]+\z"), "job_id")
        .when(~text("language", "Auto").isin(*LANGUAGES), "language")
        .when(~text("ui_language", "cn").isin(*INTERFACES), "ui_language")
        .when(~action.isin(*ACTIONS), "action")
        .when((action == "transcribe") & (text("audio_path") == ""), "audio_path")
        .when(~mode.isin(*MODES), "mode")
        .when((action == "transcribe") & (mode == "script_match") & ~F.coalesce(written, F.lit(False)), "reference_text")
        .when((action == "download_models") & ~source.isin("huggingface", "modelscope"), "download_source")
        .when(width.isNull() | ~width.between(1, 500), "max_chars")
    )
    flag = lambda c: F.coalesce(raw["subtitle"][c], F.lit(False))
    return F.struct(job.alias("job_id"), action.alias("action"), mode.alias("mode"), text("language", "Auto").alias("language"), width.alias("max_chars"), flag("remove_gaps").alias("remove_gaps"), flag("trim_end_punctuation").alias("trim_end_punctuation"), F.coalesce(raw["timeline"]["fps"], F.lit("24")).alias("fps"), F.coalesce(raw["timeline"]["start_frame"].try_cast("long"), F.lit(0)).cast("long").alias("start_frame"), error.alias("error"))


def typed_settings(stored: Column, defaults: dict) -> Column:
    """Stored settings (JSON) laid over defaults: a value counts only if it is of its default's type."""
    fields = []
    for name, default in defaults.items():
        kind = {bool: "boolean", int: "double", float: "double", str: "string"}[type(default)]
        value = F.try_variant_get(F.try_parse_json(stored), f"$.{name}", "variant")
        shape = F.schema_of_variant(value)
        same = shape.rlike({"boolean": "^BOOLEAN$", "string": "^STRING$", "double": "^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"}[kind])
        fields.append(F.coalesce(F.when(same, F.try_variant_get(value, "$", kind)), F.lit(default).cast(kind)).alias(name))
    return F.struct(*fields)


def queue(jobs: DataFrame, busy: DataFrame, key: str, day: str, order: str) -> DataFrame:
    """All jobs that no row of ``busy`` has the key of, with their rank from the oldest: the rank within a day behind the jobs of earlier days."""
    waiting = jobs.join(busy.select(key).distinct(), key, "left_anti").select(F.col(day).alias("day"), F.col(order).alias("job"))
    earlier = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)  # one row for each day
    days = waiting.groupBy("day").agg(F.count(F.lit(1)).alias("n")).select("day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return waiting.join(days, "day").select("job", (F.col("before") + F.row_number().over(W.partitionBy("day").orderBy("job"))).alias("rank"))


def retained(jobs: DataFrame, done_ttl: int, other_ttl: int, most: int = 100) -> DataFrame:
    """What happens to finished jobs (job, state, age, acked): acknowledged and old ones go, of the rest all but the ``most`` youngest."""
    gone = F.when(F.col("acked"), "acknowledged").when(F.col("age") >= F.when(F.col("state") == "done", done_ttl).otherwise(other_ttl), "expired")
    marked = jobs.select("job", "age", gone.alias("gone"))
    young = marked.where("gone IS NULL").orderBy("age", "job").limit(most).select(F.col("job").alias("kept"))  # ``most`` rows
    joined = marked.join(F.broadcast(young), F.col("job") == F.col("kept"), "left")
    return joined.select("job", F.coalesce("gone", F.when(F.col("kept").isNotNull(), "kept").otherwise("over_limit")).alias("action"))


def entries(manifests: DataFrame, asked: DataFrame) -> DataFrame:
    """The entry for each asked key (manifest, key) of manifests (manifest, models array<struct<key, ...>>): the first with that key, or an error."""
    listed = manifests.select(F.col("manifest").alias("m"), F.posexplode("models").alias("at", "entry")).groupBy("m", F.col("entry.key").alias("k")).agg(F.min_by("entry", "at").alias("entry"))
    found = asked.join(listed, (F.col("manifest") == F.col("m")) & (F.col("key") == F.col("k")), "left")
    return found.select("manifest", "key", "entry", F.when(F.col("entry").isNull(), F.concat(F.lit("Unknown model key: "), F.col("key"))).alias("error"))


def status_rows(events: DataFrame, protocol: int = 1) -> DataFrame:
    """Status rows (job_id, state, progress, message, error, at) ready to append: progress 0 to 100 and never falling, nothing after a terminal state."""
    w = W.partitionBy("job_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    over = F.coalesce(F.max(F.col("state").isin(*TERMINAL)).over(W.partitionBy("job_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    progress = F.max(F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress")))).over(w)
    rows = events.withColumn("over_", over).withColumn("progress", progress).where("NOT over_")
    return rows.select(F.lit(protocol).alias("protocol"), "job_id", "state", "progress", F.coalesce("message", F.lit("")).alias("message"), F.coalesce("error", F.lit("")).alias("error"), "at")


def append_rows(rows: DataFrame, path: str) -> None:
    """The sink of status, result and request rows: one table that is appended to; Spark's commit makes a batch visible as a whole."""
    rows.write.mode("append").parquet(path)


def latest_status(rows: DataFrame) -> DataFrame:
    """The last status of each job, and whether it is terminal."""
    return rows.groupBy("job_id").agg(F.max_by(F.struct("state", "progress", "message", "error"), "at").alias("s")).select("job_id", "s.*").withColumn("terminal", F.col("state").isin(*TERMINAL))


def region_form(s: Column, e: Column, confidence: Column, rate: float) -> Column:
    """A region in seconds, as reports show it."""
    return F.struct(F.bround(s / rate, 3).alias("start"), F.bround(e / rate, 3).alias("end"), F.bround(confidence.cast("double"), 4).alias("confidence"))


def window_form(rate: float, index: Column, core: tuple[Column, Column], held: tuple[Column, Column], speech: Column, reason: Column) -> Column:
    """A window in seconds, as reports show it."""
    at = lambda c, name: F.bround(c / rate, 3).alias(name)
    return F.struct(index.alias("index"), at(core[0], "core_start"), at(core[1], "core_end"), at(held[0], "input_start"), at(held[1], "input_end"), at(speech, "speech_seconds"), reason.alias("boundary_reason"))


def chunks(speech: DataFrame, windows: DataFrame, recovery: DataFrame, holes: DataFrame, rate: float = 1.0) -> DataFrame:
    """One diagnostic document for each stream: its speech regions, windows, recovery regions and remaining holes, in order."""

    def listed(df: DataFrame, name: str, form: Column) -> DataFrame:
        rows = df.select("stream", F.struct(F.col("s"), F.col("e"), form.alias("form")).alias("x"))
        return rows.groupBy("stream").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(F.col("stream"), F.transform("xs", lambda x: x.form).alias(name))

    region = region_form(F.col("s"), F.col("e"), F.lit(1.0), rate)
    window = window_form(rate, F.col("idx"), (F.col("s"), F.col("e")), (F.col("in_s"), F.col("in_e")), F.col("speech"), F.col("reason"))
    parts = {"speech_regions": listed(speech, "speech_regions", region), "windows": listed(windows, "windows", window), "recovery_regions": listed(recovery, "recovery_regions", region), "remaining_coverage_holes": listed(holes, "remaining_coverage_holes", region)}
    out = parts["speech_regions"]
    for name in ("windows", "recovery_regions", "remaining_coverage_holes"):
        out = out.join(parts[name], "stream", "full")
    return out.select("stream", F.to_json(F.struct(*[F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)).alias(n) for n in parts])).alias("document"))


def match_rows(rows: DataFrame, find: str) -> DataFrame:
    """Rows (stream, id, text) with the literal ``find``: occurrences, place among the stream's matches, and the stream's totals."""
    if not find:
        raise ValueError("a search needs a text")
    hits = rows.select("stream", "id", tx.occurrences(F.coalesce("text", F.lit("")), find).cast("long").alias("n")).where("n > 0")
    by = W.partitionBy("stream")
    return hits.select("stream", "id", "n", F.row_number().over(by.orderBy("id")).cast("long").alias("place"), F.count(F.lit(1)).over(by).alias("n_rows"), F.sum("n").over(by).alias("n_occurrences"))


def response(body: Column, budget: int) -> Column:
    """A recogniser's JSON answer: language, text, generated, budget, hit_limit, repetition, fault."""
    raw = F.from_json(body, "protocol_ok boolean, language string, text string, generated_tokens string, max_new_tokens string, ended_normally boolean, repetition_detected boolean")
    number = lambda c, default: F.when(raw[c].isNull(), F.lit(default)).otherwise(raw[c].try_cast("long"))
    generated, reported = number("generated_tokens", 0), number("max_new_tokens", budget)
    fault = F.when(~_is_object(body) | ~F.coalesce(raw["protocol_ok"], F.lit(True)), "ASR_PROTOCOL_PARSE_FAILED").when(generated.isNull() | reported.isNull() | (generated < 0) | (reported <= 0), "ASR_DIAGNOSTIC_PARSE_FAILED")
    limit = (generated >= budget) & ~F.coalesce(raw["ended_normally"], F.lit(False))
    return F.struct(F.trim(F.coalesce(raw["language"], F.lit(""))).alias("language"), F.trim(F.coalesce(raw["text"], F.lit(""))).alias("text"), F.coalesce(generated, F.lit(0)).cast("long").alias("generated"), F.coalesce(reported, F.lit(budget)).cast("long").alias("budget"), F.coalesce(limit, F.lit(False)).alias("hit_limit"), F.coalesce(raw["repetition_detected"], F.lit(False)).alias("repetition"), fault.alias("fault"))


def outcome(text: Column, repetition: Column, hit_limit: Column, speech_ms: Column, least_speech: int = 180) -> Column:
    """The first fault of a transcript, or an empty code."""
    silent = (F.trim(text) == "") & (speech_ms >= least_speech)
    return F.when(tx.abnormal(text), "ABNORMAL_TRANSCRIPT").when(repetition, "ASR_REPETITION_DETECTED").when(hit_limit, "ASR_TOKEN_LIMIT_REACHED").when(silent, "EMPTY_TRANSCRIPT_FOR_SPEECH").otherwise("")


def trusted(rows: DataFrame, known: tuple[str, ...] = LANGUAGES[1:]) -> DataFrame:
    """The language that holds for each row of a stream (stream, id, language, text): the first that a row with text names; an error if it is none that is known."""
    w = W.partitionBy("stream").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    named = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.trim(F.coalesce("language", F.lit(""))))
    first = F.first(named, ignorenulls=True).over(w)
    ok = first.isin(*known)
    return rows.select("stream", "id", F.when(ok, first).otherwise("").alias("trusted"), F.when(first.isNotNull() & ~ok, "UNSUPPORTED_ALIGNMENT_LANGUAGE").otherwise("").alias("error"))


def tails(rows: DataFrame, most: int = 160) -> DataFrame:
    """What each row (stream, id, text, valid) is prompted with: the end of the row before, if that is valid."""
    w = W.partitionBy("stream").orderBy("id")
    tail = F.right(F.trim(F.lag("text").over(w)), F.lit(most))
    return rows.select("stream", "id", F.when(F.lag("valid").over(w), F.coalesce(tail, F.lit(""))).otherwise("").alias("tail"))


def alignable(rows: DataFrame) -> DataFrame:
    """Valid rows with text."""
    return rows.where(F.col("valid") & (F.coalesce("text", F.lit("")) != ""))


def document(value: dict) -> str:
    """A JSON document with its keys in order, as files hold it."""
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True)
