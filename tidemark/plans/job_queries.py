"""Queries of jobs, their documents, rates and rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import joining, rates
from tidemark.functions import text as tx
from tidemark.operators import jobs as ops
from tidemark.sources.frames import intervals, table, tokens

_NAMES = ("23.976", "29.97 DF", "59.94DF", "24", "25", "30 df", "50", "60 DF", "48", "29.97", "30000/1001")


def _picked(n, names):
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def _events(spark, d):
    return table(spark, d, "events")


def frame_rates(spark, d):
    """What timelines' and requests' rate names mean."""
    name = _picked(F.col("event_id"), _NAMES)
    rate = rates.rate_of(name)
    return _events(spark, d).select("event_id", *[rate[c].alias(c) for c in ("numerator", "denominator", "nominal", "drop", "error")], rates.request_rate(name).alias("request"))


def ms_frames(spark, d):
    ms = F.col("event_id") * 7 - 50
    return _events(spark, d).select("event_id", rates.ms_to_frames(ms).alias("frames"))


def native_samples(spark, d):
    n = F.col("event_id") * 7919
    return _events(spark, d).select("event_id", rates.native_sample(n, 16000).alias("sample"))


def progress_parts(spark, d):
    """Progress of rendering and of running, each a part of the whole."""
    v = F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 130 - 10)
    return _events(spark, d).select("event_id", rates.percent(v).alias("plain"), rates.percent(v, 0, 15).alias("render"), rates.percent(v, 15, 84).alias("run"))


def heartbeat_fresh(spark, d):
    e = F.col("event_id")
    running = F.when(e % 3 == 0, F.lit(None).cast("boolean")).otherwise(e % 3 == 1)
    return _events(spark, d).select("event_id", rates.fresh(F.lit(1000), F.when(e % 5 != 0, 1000 - e % 20), running).alias("fresh"))


def humanize_rate(spark, d):
    n = (F.col("n_chars") * F.col("n_chars") * 37).cast("double")
    return table(spark, d, "documents").select("doc_id", rates.speed_shown(F.when(F.col("doc_id") % 9 != 0, n)).alias("shown"))


_REQUESTS = (
    '{"protocol":1,"job_id":"a-%d","audio_path":"x.wav","subtitle":{"max_chars":30,"remove_gaps":true},"timeline":{"fps":"25","start_frame":90000}}',
    '{"protocol":2,"job_id":"a"}', '{"protocol":1,"job_id":"a b","audio_path":"x"}', '{"protocol":1,"job_id":"j%d","language":"Klingon"}', '{"protocol":1,"job_id":"j","ui_language":"xx"}',
    '{"protocol":1,"job_id":"j","action":"fly"}', '{"protocol":1,"job_id":"j"}', '{"protocol":1,"job_id":"j","audio_path":"x","mode":"none"}',
    '{"protocol":1,"job_id":"j","audio_path":"x","mode":"script_match","reference_text":" \\n "}', '{"protocol":1,"job_id":"k%d","audio_path":"x","mode":"script_match","reference_text":"a\\nb"}',
    '{"protocol":1,"job_id":"j","action":"download_models","download_source":"nowhere"}', '{"protocol":1,"job_id":"j","audio_path":"x","subtitle":{"max_chars":501}}', '[1]', '{"protocol":1,"job_id":"d","action":"download_models","download_source":"modelscope"}',
)
_FAULTS = (None, "protocol", "job_id", "language", "ui_language", "action", "audio_path", "mode", "reference_text", None, "download_source", "max_chars", "not an object", None)


def request_checks(spark, d):
    body = F.replace(_picked(F.col("event_id"), _REQUESTS), F.lit("%d"), F.col("event_id").cast("string"))
    r = ops.checked_request(body)
    good = r["error"].isNull()
    return _events(spark, d).select("event_id", r["error"].alias("error"), F.when(good, r["job_id"]).alias("job_id"), F.when(good, r["max_chars"]).alias("max_chars"), F.when(good, r["start_frame"]).alias("start_frame"), F.when(good, r["mode"]).alias("mode"))


_STORED = ('{"width":30,"gaps":true,"name":"x"}', '{"width":"30","gaps":1,"name":7}', '{"width":12.5}', "not json", '{"gaps":"yes","name":"y","more":1}')


def settings_typed(spark, d):
    s = ops.typed_settings(_picked(F.col("event_id"), _STORED), {"width": 42, "gaps": False, "name": "default"})
    return _events(spark, d).select("event_id", s["width"].alias("width"), s["gaps"].alias("gaps"), s["name"].alias("name"))


def manifest_lookup(spark, d):
    """Parts as manifests of 20 entries, some keys twice; each is asked for the keys of all nations."""
    n = F.col("p_partkey").cast("long")
    parts = table(spark, d, "part").select(F.floor(n / 20).alias("manifest"), n.alias("n"), F.struct((n * 7 % 15).cast("string").alias("key"), n.alias("size")).alias("x"))
    manifests = parts.groupBy("manifest").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda r: r.x).alias("models"))
    asked = manifests.select("manifest").join(F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"))))  # 25 keys
    return ops.entries(manifests, asked).select("manifest", "key", F.col("entry.size").alias("size"), "error")


def retention(spark, d):
    """What happens to finished jobs: acknowledged, expired (after 300 days done, after 900 otherwise), over the 100 youngest, or kept."""
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("error").alias("state"), F.datediff(F.lit("2001-09-01").cast("date"), F.col("o_orderdate").cast("date")).alias("age"), (F.col("o_orderkey") % 4 == 0).alias("acked"))
    return ops.retained(jobs, 300, 900)


def _open(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")


def job_queue(spark, d):
    """All open jobs of customers that have no running one, with their rank from the oldest."""
    waiting, busy = _open(spark, d)
    return ops.queue(waiting, busy, "o_custkey", "o_orderdate", "o_orderkey")


def status_log(spark, d):
    """Events as reports of a job for each user; the last status of each."""
    e = _events(spark, d)
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") * 1000 + F.col("event_id") % 1000
    rows = e.select(F.col("user_id").cast("string").alias("job_id"), F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), "error").otherwise("running").alias("state"), F.floor(F.col("value")).cast("long").alias("progress"), F.col("event_type").alias("message"), F.lit(None).cast("string").alias("error"), at.alias("at"))
    return ops.latest_status(ops.status_rows(rows))


def diagnostic_chunks(spark, d):
    """One document for each stream: views as speech, clicks as windows, errors as recovery regions, signups as holes."""
    base = intervals(spark, d).withColumns({"s": F.col("s") % 100_000, "e": F.col("s") % 100_000 + (F.col("e") - F.col("s"))})
    part = lambda k: base.where(F.col("kind") == k)
    order = W.partitionBy("stream").orderBy("s", "e", "id")
    windows = part("click").select("stream", "s", "e", (F.row_number().over(order) - 1).alias("idx"), (F.col("s") - 2).alias("in_s"), (F.col("e") + 2).alias("in_e"), F.lit(7).alias("speech"), F.lit("hard_max").alias("reason"))
    return ops.chunks(part("view"), windows, part("error"), part("signup"), 3.0).select("stream", F.md5("document").alias("digest"), F.length("document").alias("size"))


def match_rows(spark, d):
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("id"), "text")
    return ops.match_rows(talk, "an")


def _responses():
    k = F.col("event_id")
    said = F.format_string('{"protocol_ok":%s,"language":" English ","text":" t%d ","generated_tokens":%s,"max_new_tokens":%d,"ended_normally":%s}', F.when(k % 11 == 0, "false").otherwise("true"), k, F.when(k % 7 == 0, '"many"').when(k % 13 == 0, "-1").otherwise((k % 120).cast("string")), 80 - k % 3, F.when(k % 2 == 0, "true").otherwise("false"))
    return F.when(k % 17 == 0, "no json").otherwise(said)


def response_parse(spark, d):
    """Fields of a recogniser's JSON answers; those that are no answer, or say a number that is none, are faults."""
    r = ops.response(_responses(), 80)
    return _events(spark, d).select("event_id", *[r[c].alias(c) for c in ("language", "text", "generated", "budget", "hit_limit", "fault")])


def asr_outcome(spark, d):
    """First fault of a turn as a transcript: abnormal, repeating, over its budget, empty for 180 ms of speech."""
    text = F.when(F.col("turn") % 5 == 4, F.lit(" ")).when(F.col("conv_id") % 9 == 3, F.repeat(F.lit("na "), 20 + F.col("turn").cast("int") % 3)).otherwise(F.col("text"))
    talk = table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    words = tx.split_blank(F.col("text"))
    out = ops.outcome(F.col("text"), tx.repeated_suffix(words), F.size(words) >= 80, F.col("conv_id") % 3 * 100)
    return talk.select("conv_id", "turn", out.alias("error"), (out == "").alias("valid"))


def trusted_language(spark, d):
    """The first language that a turn with text names holds for its conversation; one that is unknown is an error."""
    k = F.col("conv_id") + F.col("turn")
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("id"), F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text")).alias("text"), _picked(k, ("English", " French ", "Latin", "German")).alias("language"))
    return ops.trusted(talk)


def previous_tail(spark, d):
    """The end of the turn before, if that is valid."""
    talk = table(spark, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("id"), "text", (F.col("turn") % 4 != 2).alias("valid"))
    return ops.tails(talk)


def alignable_rows(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("text"), (F.col("turn") % 4 != 2).alias("valid"))
    return ops.alignable(talk).select("conv_id", "turn")


def token_joiner(spark, d):
    """What stands between the words of a turn, for a language with blanks and one without."""
    parts = F.regexp_extract_all(F.regexp_replace(F.col("text"), "ou", " 字 1,000. "), F.lit(r"[\p{L}]+|\p{N}+[.,]?|[^\s\p{L}\p{N}]"), F.lit(0))
    talk = table(spark, d, "conversations").select("conv_id", "turn", parts.alias("p"))
    return talk.select("conv_id", "turn", F.md5(joining.joined(F.col("p"), F.lit("en"))).alias("spaced"), F.md5(joining.joined(F.col("p"), F.lit("ja"))).alias("dense"))


def numeric_continuation(spark, d):
    """Numbers that go on behind a word's end, and ordinals before a unit."""
    t = tokens(spark, d).select("stream", "ord", F.concat("text", F.when(F.col("ord") % 4 == 0, F.lit("3.")).otherwise("")).alias("text"))
    after = F.lead("text").over(W.partitionBy("stream").orderBy("ord"))
    right = F.when(F.col("ord") % 8 == 0, F.concat(F.lit("14"), after)).otherwise(after)
    return t.select("stream", "ord", joining.continues_number(F.col("text"), right).alias("decimal"), joining.continues_number(F.col("text"), right, F.col("ord") % 3 == 0).alias("any")).where("any")


def word_groups(spark, d):
    """Mapping groups of each turn, its words in two of three and its letters and digits in the third; one word became characters of a CJK script."""
    folded = tx.folded(F.regexp_replace(F.col("text"), "the", "漢字かな"))
    groups = joining.mapping_groups(folded, F.when(F.col("turn") % 3 == 2, "zh").otherwise("en"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(groups).cast("long").alias("n"), F.md5(F.array_join(groups, " ")).alias("digest"))


def lexical_unit(spark, d):
    """Words as word lists know them: compatibility forms resolved, case folded, without blanks around."""
    return table(spark, d, "documents").select("doc_id", F.md5(tx.unit(F.concat(F.lit("  "), F.col("text"), F.lit("ﬁ ２ ")))).alias("digest"))


def cjk_share(spark, d):
    """Characters of CJK scripts, as joining and as mapping see them."""
    t = F.concat(F.col("text"), F.lit("漢ㄅｱ"))
    n = lambda ranges: F.length(F.regexp_replace(t, f"[^{ranges}]", "")).cast("long")
    return table(spark, d, "documents").select("doc_id", n(joining.CJK).alias("joining"), n(joining.MAPPED_CJK).alias("mapping"))


def file_names(spark, d):
    """Names of temporary files, and messages without the home folder's name."""
    said = F.concat(F.lit("/home/ann/x: "), F.col("url"))
    return table(spark, d, "pages").select("page_id", tx.file_name(F.col("url"), F.col("page_id").cast("string")).alias("name"), tx.without_paths(said, {"/home/ann": "<home>"}, 40).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (frame_rates, ms_frames, native_samples, progress_parts, heartbeat_fresh, humanize_rate, request_checks, settings_typed, manifest_lookup, retention, job_queue, status_log, diagnostic_chunks, match_rows, response_parse, asr_outcome, trusted_language, previous_tail, alignable_rows)
    + (token_joiner, numeric_continuation, word_groups, lexical_unit, cjk_share, file_names)
}


def _listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


_TOK = r"list_filter(string_split_regex({x}, '[ \t\n\x0B\f\r]+'), lambda t: t != '')"
_IV = "iv AS (SELECT user_id AS stream, event_id AS id, event_type AS kind, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) AS s, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) + 1 + cast(floor(value * 300) AS bigint) AS e FROM events)"
_BY_RATE = {"23.976": (24000, 1001, 24), "29.97": (30000, 1001, 30), "59.94": (60000, 1001, 60), "24": (24, 1, 24), "25": (25, 1, 25), "30": (30, 1, 30), "50": (50, 1, 50), "60": (60, 1, 60)}
_RATE = ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in _BY_RATE.items())
_CASE = lambda column: "CASE k " + " ".join(f"WHEN '{k}' THEN {v[column]}" for k, v in _BY_RATE.items()) + " END"
_CJK, _MAPPED = joining.CJK, joining.MAPPED_CJK
_SHOWN = "(" + " OR ".join(f"contains(text, '{m}')" for m in tx.PROTOCOL_MARKERS) + ")"
_JOIN = r"""list_reduce(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = 1 THEN p[i] ELSE (CASE WHEN regexp_matches(p[i], '^[.?!。？！…,;:，；：、\p{{Pe}}\p{{Pf}}]') OR regexp_matches(p[i - 1], '[\p{{Ps}}\p{{Pi}}]$') THEN '' {rule} END) || p[i] END), lambda a, b: a || b)"""
_SINGLE = rf"regexp_matches({{x}}, '^[\p{{{{L}}}}\p{{{{N}}}}]$') AND NOT regexp_matches({{x}}, '[{_CJK.replace('{', '{{').replace('}', '}}')}]')"
_FOREIGN = rf"regexp_matches({{x}}, '[\p{{{{L}}}}\p{{{{N}}}}]') AND NOT regexp_matches({{x}}, '[{_CJK.replace('{', '{{').replace('}', '}}')}]')"
_DENSE = (
    "WHEN (" + _SINGLE.replace("{x}", "p[i - 1]") + " AND " + _SINGLE.replace("{x}", "p[i]") + r") OR (regexp_matches(p[i - 1], '^\p{{N}}+[.．]$') AND regexp_matches(p[i], '^\p{{N}}')) OR (regexp_matches(p[i - 1], '^\p{{N}}+,$') AND regexp_matches(p[i], '^\p{{N}}{{3}}([^\p{{N}}]|$)')) THEN ''"
    + " WHEN " + _FOREIGN.replace("{x}", "p[i - 1]") + " AND " + _FOREIGN.replace("{x}", "p[i]") + " THEN ' ' ELSE ''"
).replace("{{", "{").replace("}}", "}")
_FOLD = "replace(lower({x}), 'ß', 'ss')"
_OPEN = "FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'P' AND b.o_orderpriority = '1-URGENT' AND b.o_custkey = o.o_custkey)"
_ABN0 = "p0 AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' ' WHEN conv_id % 9 = 3 THEN repeat('na ', 20 + turn % 3) ELSE text END AS text FROM conversations)"
_REP = " OR ".join(f"(len(tok) >= {k * 20} AND tok[len(tok) - {k * 20} + 1 : len(tok) - {k}] = tok[len(tok) - {k * 20} + 1 + {k} : len(tok)])" for k in range(1, 21))

ORACLE = {
    "frame_rates": f"""WITH a AS (SELECT event_id, {_listed(_NAMES)}[event_id % {len(_NAMES)} + 1] AS name FROM events), b AS (SELECT *, replace(replace(upper(name), 'DF', ''), ' ', '') AS k, contains(upper(name), 'DF') AS df FROM a)
      SELECT event_id, {_CASE(0)}::bigint AS numerator, {_CASE(1)}::bigint AS denominator, {_CASE(2)}::bigint AS nominal, coalesce(df AND {_CASE(2)} IN (30, 60), false) AS "drop", CASE WHEN {_CASE(0)} IS NULL THEN 'Unsupported timeline frame rate: ' || name END AS error,
        CASE WHEN name = '30000/1001' THEN name WHEN name = '59.94DF' THEN NULL ELSE {_CASE(0)} || '/' || {_CASE(1)} END AS request FROM b""",
    "ms_frames": "SELECT event_id, greatest(1, cast(round_even((event_id * 7 - 50) * 100 / 1000.0, 0) AS bigint)) AS frames FROM events",
    "native_samples": "SELECT event_id, cast(round_even(round_even(cast(cast(event_id * 7919 / 16000.0 AS float) AS double), 3) * 16000, 0) AS bigint) AS sample FROM events",
    "progress_parts": "WITH a AS (SELECT event_id, greatest(0.0, least(100.0, coalesce(CASE WHEN event_id % 10 != 0 THEN event_id % 130 - 10 END, 0)))::double AS v FROM events) SELECT event_id, v * 100.0::double / 100 AS plain, v * 15.0::double / 100 AS render, 15 + v * 84.0::double / 100 AS run FROM a",
    "heartbeat_fresh": "SELECT event_id, event_id % 3 != 2 AND event_id % 5 != 0 AND event_id % 20 <= 10 AS fresh FROM events",
    "humanize_rate": "WITH a AS (SELECT doc_id, CASE WHEN doc_id % 9 != 0 THEN cast(n_chars * n_chars * 37 AS double) ELSE 0 END AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1e9 THEN printf('%.2f GB/s', n / 1e9) WHEN n >= 1e6 THEN printf('%.1f MB/s', n / 1e6) WHEN n >= 1e3 THEN printf('%.1f KB/s', n / 1e3) ELSE printf('%d B/s', cast(floor(n) AS bigint)) END AS shown FROM a",
    "request_checks": f"""WITH a AS (SELECT event_id, event_id % {len(_FAULTS)} AS k, {_listed(_FAULTS)}[event_id % {len(_FAULTS)} + 1] AS error FROM events)
      SELECT event_id, error, CASE k WHEN 0 THEN 'a-' || event_id WHEN 9 THEN 'k' || event_id WHEN 13 THEN 'd' END AS job_id, CASE k WHEN 0 THEN 30 WHEN 9 THEN 42 WHEN 13 THEN 42 END AS max_chars, CASE k WHEN 0 THEN 90000 WHEN 9 THEN 0 WHEN 13 THEN 0 END::bigint AS start_frame, CASE k WHEN 0 THEN 'auto_subtitle' WHEN 9 THEN 'script_match' WHEN 13 THEN 'auto_subtitle' END AS mode FROM a""",
    "settings_typed": "SELECT event_id, [30.0, 42.0, 12.5, 42.0, 42.0][event_id % 5 + 1]::double AS width, event_id % 5 = 0 AS gaps, ['x', 'default', 'default', 'default', 'y'][event_id % 5 + 1] AS name FROM events",
    "manifest_lookup": "WITH m AS (SELECT p_partkey // 20 AS manifest, p_partkey * 7 % 15 AS k, min(p_partkey)::bigint AS size FROM part GROUP BY 1, 2), q AS (SELECT DISTINCT manifest, n_nationkey AS k FROM m, nation) SELECT q.manifest::bigint AS manifest, q.k::varchar AS key, size, CASE WHEN size IS NULL THEN 'Unknown model key: ' || q.k END AS error FROM q LEFT JOIN m ON m.manifest = q.manifest AND m.k = q.k",
    "retention": """WITH a AS (SELECT o_orderkey AS job, o_orderstatus AS state, date_diff('day', cast(o_orderdate AS date), date '2001-09-01') AS age FROM orders), b AS (SELECT *, CASE WHEN job % 4 = 0 THEN 'acknowledged' WHEN age >= CASE WHEN state = 'F' THEN 300 ELSE 900 END THEN 'expired' END AS gone FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY gone IS NULL ORDER BY age, job) AS rank FROM b) SELECT job, CASE WHEN gone IS NOT NULL THEN gone WHEN rank <= 100 THEN 'kept' ELSE 'over_limit' END AS action FROM c""",
    "job_queue": f"SELECT o_orderkey AS job, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rank {_OPEN}",
    "status_log": """WITH a AS (SELECT user_id::varchar AS job_id, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'error' ELSE 'running' END AS state, cast(floor(value) AS bigint) AS progress, event_type AS message, epoch_us(ts) * 1000 + event_id % 1000 AS tick FROM events),
      b AS (SELECT *, max(greatest(0, least(100, progress))) OVER w AS p, max(state = 'error') OVER (PARTITION BY job_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_ FROM a WINDOW w AS (PARTITION BY job_id ORDER BY tick ROWS UNBOUNDED PRECEDING))
      SELECT job_id, arg_max(state, tick) AS state, arg_max(p, tick) AS progress, arg_max(message, tick) AS message, '' AS error, arg_max(state, tick) = 'error' AS terminal FROM b WHERE NOT coalesce(over_, false) GROUP BY job_id""",
    "diagnostic_chunks": f"""WITH {_IV}, b AS (SELECT stream, id, kind, s % 100000 AS s, s % 100000 + (e - s) AS e FROM iv), t AS (SELECT DISTINCT stream FROM b WHERE kind IN ('view', 'click', 'error', 'signup')),
      r AS (SELECT stream, kind, list({{'start': round_even(s / 3.0::double, 3), 'end': round_even(e / 3.0::double, 3), 'confidence': 1.0::double}} ORDER BY s, e) AS l FROM b GROUP BY stream, kind),
      n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY s, e, id) - 1 AS idx FROM b WHERE kind = 'click'),
      w AS (SELECT stream, list({{'index': idx, 'core_start': round_even(s / 3.0::double, 3), 'core_end': round_even(e / 3.0::double, 3), 'input_start': round_even((s - 2) / 3.0::double, 3), 'input_end': round_even((e + 2) / 3.0::double, 3), 'speech_seconds': round_even(7 / 3.0::double, 3), 'boundary_reason': 'hard_max'}} ORDER BY s, e, idx) AS l FROM n GROUP BY stream),
      d AS (SELECT t.stream, to_json({{'speech_regions': coalesce((SELECT l FROM r WHERE r.stream = t.stream AND kind = 'view'), []), 'windows': coalesce((SELECT l FROM w WHERE w.stream = t.stream), []), 'recovery_regions': coalesce((SELECT l FROM r WHERE r.stream = t.stream AND kind = 'error'), []), 'remaining_coverage_holes': coalesce((SELECT l FROM r WHERE r.stream = t.stream AND kind = 'signup'), [])}})::varchar AS document FROM t)
      SELECT stream, md5(document) AS digest, length(document) AS size FROM d""",
    "match_rows": "WITH a AS (SELECT conv_id AS stream, turn AS id, cast(list_sum(list_transform(regexp_extract_all(text, '(?:an)+'), lambda x: length(x) // 2)) AS bigint) AS n FROM conversations) SELECT stream, id, n, row_number() OVER (PARTITION BY stream ORDER BY id) AS place, count(*) OVER (PARTITION BY stream) AS n_rows, sum(n) OVER (PARTITION BY stream)::bigint AS n_occurrences FROM a WHERE n > 0",
    "response_parse": """WITH a AS (SELECT event_id AS k FROM events), b AS (SELECT *, k % 7 = 0 AS odd, CASE WHEN k % 13 = 0 THEN -1 ELSE k % 120 END AS g FROM a)
      SELECT k AS event_id, CASE WHEN k % 17 = 0 THEN '' ELSE 'English' END AS language, CASE WHEN k % 17 = 0 THEN '' ELSE 't' || k END AS text, CASE WHEN k % 17 = 0 OR odd THEN 0 ELSE g END::bigint AS generated, CASE WHEN k % 17 = 0 THEN 80 ELSE 80 - k % 3 END::bigint AS budget,
        k % 17 != 0 AND NOT odd AND g >= 80 AND k % 2 != 0 AS hit_limit, CASE WHEN k % 17 = 0 OR k % 11 = 0 THEN 'ASR_PROTOCOL_PARSE_FAILED' WHEN odd OR g < 0 THEN 'ASR_DIAGNOSTIC_PARSE_FAILED' END AS fault FROM b""",
    "asr_outcome": rf"""WITH {_ABN0}, p1 AS (SELECT *, list_filter(string_split(regexp_replace(text, '\s', '', 'g'), ''), lambda x: x != '') AS c, {_TOK.format(x='lower(text)')} AS w, {_TOK.format(x='text')} AS tok FROM p0), p AS (SELECT *, list_sort(c)[len(c) // 2 + 1] AS cm, list_sort(w)[len(w) // 2 + 1] AS wm FROM p1),
      a AS (SELECT conv_id, turn, CASE WHEN list_contains(['language', 'transcription', 'transcript', 'text'], regexp_replace(lower(trim(text)), '^[ :.!。！]+|[ :.!。！]+$', '', 'g')) OR {_SHOWN} OR (length(trim(text)) >= 128 AND len(c) > 0 AND len(list_filter(c, lambda x: x = cm)) >= 0.9 * len(c)) OR (length(trim(text)) >= 128 AND len(w) >= 16 AND len(list_filter(w, lambda x: x = wm)) >= 0.8 * len(w)) THEN 'ABNORMAL_TRANSCRIPT'
        WHEN {_REP} THEN 'ASR_REPETITION_DETECTED' WHEN len(tok) >= 80 THEN 'ASR_TOKEN_LIMIT_REACHED' WHEN trim(text) = '' AND conv_id % 3 = 2 THEN 'EMPTY_TRANSCRIPT_FOR_SPEECH' ELSE '' END AS error FROM p) SELECT *, error = '' AS valid FROM a""",
    "trusted_language": """WITH a AS (SELECT conv_id AS stream, turn AS id, CASE WHEN turn % 3 != 0 AND trim(text) != '' THEN ['English', 'French', 'Latin', 'German'][(conv_id + turn) % 4 + 1] END AS said FROM conversations),
      b AS (SELECT *, first_value(said IGNORE NULLS) OVER (PARTITION BY stream ORDER BY id ROWS UNBOUNDED PRECEDING) AS f FROM a) SELECT stream, id, CASE WHEN f IN ('English', 'French', 'German') THEN f ELSE '' END AS trusted, CASE WHEN f = 'Latin' THEN 'UNSUPPORTED_ALIGNMENT_LANGUAGE' ELSE '' END AS error FROM b""",
    "previous_tail": "SELECT conv_id AS stream, turn AS id, CASE WHEN lag(turn % 4 != 2) OVER w THEN coalesce(right(trim(lag(text) OVER w), 160), '') ELSE '' END AS tail FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "alignable_rows": "SELECT conv_id, turn FROM conversations WHERE turn % 3 != 0 AND text != '' AND turn % 4 != 2",
    "token_joiner": "WITH a AS (SELECT conv_id, turn, regexp_extract_all(replace(text, 'ou', ' 字 1,000. '), '[\\p{L}]+|\\p{N}+[.,]?|[^\\s\\p{L}\\p{N}]') AS p FROM conversations) SELECT conv_id, turn, md5(coalesce(" + _JOIN.replace("{rule}", "ELSE ' '").replace("{{", "{").replace("}}", "}") + ", '')) AS spaced, md5(coalesce(" + _JOIN.replace("{rule}", _DENSE).replace("{{", "{").replace("}}", "}") + ", '')) AS dense FROM a",
    "numeric_continuation": rf"""WITH a AS (SELECT doc_id AS stream, {_TOK.format(x='text')} AS l FROM documents), b AS (SELECT stream, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS ord FROM a), c AS (SELECT stream, ord, text || CASE WHEN ord % 4 = 0 THEN '3.' ELSE '' END AS text FROM b),
      e AS (SELECT *, CASE WHEN ord % 8 = 0 THEN '14' || lead(text) OVER w ELSE lead(text) OVER w END AS nxt FROM c WINDOW w AS (PARTITION BY stream ORDER BY ord)), f AS (SELECT stream, ord, regexp_matches(text, '\d[.,，．]$') AND regexp_matches(nxt, '^\d') AS decimal, regexp_matches(text, '\d[.．]$') AND ord % 3 = 0 AS unit FROM e)
      SELECT stream, ord, decimal, decimal OR unit AS "any" FROM f WHERE decimal OR unit""",
    "word_groups": rf"""WITH a AS (SELECT conv_id, turn, {_FOLD.format(x="replace(text, 'the', '漢字かな')")} AS t FROM conversations), b AS (SELECT *, CASE WHEN turn % 3 = 2 THEN list_filter(string_split(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g'), ''), lambda c: c != '')
        ELSE regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, '([\p{{L}}\p{{N}}])[''’.-]([\p{{L}}\p{{N}}])', '\1\2', 'g'), '([\p{{L}}\p{{N}}])[''’.-]([\p{{L}}\p{{N}}])', '\1\2', 'g'), '([{_MAPPED}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') END AS g FROM a)
      SELECT conv_id, turn, len(g) AS n, md5(array_to_string(g, ' ')) AS digest FROM b""",
    "lexical_unit": rf"SELECT doc_id, md5(regexp_replace({_FOLD.format(x='text')}, '^\s+', '') || 'fi 2') AS digest FROM documents",
    "cjk_share": rf"SELECT doc_id, length(regexp_replace(text || '漢ㄅｱ', '[^{_CJK}]', '', 'g')) AS joining, length(regexp_replace(text || '漢ㄅｱ', '[^{_MAPPED}]', '', 'g')) AS mapping FROM documents",
    "file_names": "SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9-]+', '_', 'g'), 64) || '_' || page_id || '_audio_temp' AS name, left('<home>/x: ' || url, 40) AS shown FROM pages",
}
