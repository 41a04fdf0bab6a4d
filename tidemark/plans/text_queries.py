"""Text, timecode and job queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import text as tx
from tidemark.functions import timecode as tc
from tidemark.sources.frames import intervals, table

def T():
    """The text column."""
    return F.col("text")


def _docs(spark, d):
    return table(spark, d, "documents")


def _talk(spark, d):
    return table(spark, d, "conversations")


def visible_punctuation(spark, d):
    return _docs(spark, d).select("doc_id", tx.visible_punctuation(T()).alias("has_mark"), F.length(tx.only_punctuation(T())).cast("long").alias("n_marks"))


def closing_collapse(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.collapse_closing(F.replace(T(), F.lit("."), F.lit(".,")))).alias("digest"))


def trim_punctuation(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.trim_end_punctuation(T())).alias("digest"), F.length(tx.trim_end_punctuation(T())).cast("long").alias("n"))


def ends_with_class(spark, d):
    return _docs(spark, d).select("doc_id", tx.ends_with(T(), tx.SENTENCE_END).alias("sentence"), tx.ends_with(T(), tx.CLAUSE_END).alias("clause"))


def lexical_words(spark, d):
    return _docs(spark, d).select("doc_id", F.size(tx.words(T())).cast("long").alias("n_words"), F.md5(F.array_join(tx.words(T()), " ")).alias("digest"))


def lexical_edges(spark, d):
    found = F.regexp_extract_all(T(), F.lit(tx.EDGE), F.lit(0))
    return _docs(spark, d).select("doc_id", F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("first_word"), F.coalesce(F.get(F.reverse(found), F.lit(0)), F.lit("")).alias("last_word"))


def parse_lines(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split(T(), tx.LINE_END)).alias("at", "line")).where(F.trim("line") != "")
    idx = F.row_number().over(W.partitionBy("doc_id").orderBy("at")) - 1
    return rows.select("doc_id", idx.cast("long").alias("idx"), F.format_string("line_%06d", idx + 1).alias("line_id"), (F.col("at") + 1).cast("long").alias("source_line"), "line")


def abnormal_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.abnormal(T()).alias("abnormal"))


def repeated_suffix(spark, d):
    return _docs(spark, d).select("doc_id", tx.repeated_suffix(tx.split_blank(T())).alias("repeats"))


def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.normalize(T())).alias("digest"))


def display_units(spark, d):
    return _docs(spark, d).select("doc_id", tx.display_units(T()).alias("units"))


def find_count(spark, d):
    n = tx.occurrences(T(), "anan").cast("long")
    return _docs(spark, d).select("doc_id", n.alias("n")).where("n > 0")


def replace_all(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(F.replace(T(), F.lit("the"), F.lit("THE"))).alias("digest"), tx.replacements(T(), "the").alias("n"))


def join_tokens(spark, d):
    tokens = F.regexp_extract_all(T(), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))
    return _talk(spark, d).select("conv_id", "turn", tx.joined(tokens).alias("joined"))


def redact(spark, d):
    secret = F.concat(T(), F.lit(" Bearer abc.def hf_12ab sk-zz9 sb_q"))
    return _talk(spark, d).select("conv_id", "turn", tx.redacted(secret).alias("shown"), tx.log_field(T()).alias("field"))


def url_encode(spark, d):
    return table(spark, d, "pages").select("page_id", tx.url_encoded(F.concat(F.col("url"), F.lit(" ~*é"))).alias("encoded"))


def humanize_bytes(spark, d):
    return _docs(spark, d).select("doc_id", tx.bytes_shown((F.col("n_chars") * F.col("n_chars") * 37).cast("double")).alias("shown"))


def version_compare(spark, d):
    made = F.concat(F.lit("v"), (F.col("doc_id") % 4).cast("string"), F.lit("."), (F.col("n_chars") % 13).cast("string"), F.lit("."), (F.col("doc_id") % 11).cast("string"))
    odd = F.when(F.col("doc_id") % 7 == 0, F.lit("1.2")).when(F.col("doc_id") % 5 == 0, F.concat(made, F.lit("-rc1"))).otherwise(made)
    return _docs(spark, d).select("doc_id", tx.version_newer(odd, F.lit("1.10.3")).alias("newer"))


def sha256_fingerprint(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(F.to_json(F.struct("lang", "n_chars", "source")), 256).alias("fingerprint"), F.sha2(T(), 256).alias("content"))


def srt_timestamp(spark, d):
    s = F.col("id") / 2000.0
    return intervals(spark, d).select("id", tc.srt_timestamp(s).alias("even"), tc.srt_timestamp_half_up(s).alias("half_up"))


def srt_render(spark, d):
    """One subtitle file for each stream."""
    order = W.partitionBy("stream").orderBy("s", "e", "id")
    base = F.min("s").over(W.partitionBy("stream"))
    numbered = intervals(spark, d).select("stream", F.row_number().over(order).alias("i"), ((F.col("s") - base) * 1.0).alias("a"), ((F.col("e") - base) * 1.0).alias("b"), F.concat(F.lit(" "), F.col("kind"), F.lit("\r\n")).alias("body"))
    block = numbered.select("stream", "i", tc.srt_block(F.col("i"), F.col("a"), F.col("b"), F.col("body")).alias("block"))
    return block.groupBy("stream").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "block"))), lambda x: x.block), "\n")).alias("digest"), F.count(F.lit(1)).alias("n"))


def timecode(spark, d):
    n = F.col("id") * 997
    return intervals(spark, d).select("id", tc.timecode(n, 25).alias("plain"), tc.timecode(n, 30, drop=True).alias("drop30"), tc.timecode(n, 60, drop=True).alias("drop60"), tc.seconds_to_frames(F.col("id") * 1.0, 30000, 1001).alias("frames"))


QUERIES = {
    f.__name__: f
    for f in (visible_punctuation, closing_collapse, trim_punctuation, ends_with_class, lexical_words, lexical_edges, parse_lines, abnormal_text, repeated_suffix, normalize_text, display_units, find_count, replace_all, join_tokens, redact, url_encode, humanize_bytes, version_compare, sha256_fingerprint)
    + (srt_timestamp, srt_render, timecode)
}

_WORD = tx.WORD.replace("'", "''")
_EDGE = tx.EDGE.replace("'", "''")
_TOK = r"list_filter(string_split_regex({x}, '[ \t\n\x0B\f\r]+'), lambda t: t != '')"
_ABN = rf"""(list_contains(['language', 'transcription', 'transcript', 'text'], regexp_replace(lower(trim(text)), '^[ :.!。！]+|[ :.!。！]+$', '', 'g'))
  OR contains(text, '<|audio|>') OR contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR contains(text, '<|endoftext|>')
  OR (length(trim(text)) >= 128 AND len(c) > 0 AND len(list_filter(c, lambda x: x = cm)) >= 0.9 * len(c))
  OR (length(trim(text)) >= 128 AND len(w) >= 16 AND len(list_filter(w, lambda x: x = wm)) >= 0.8 * len(w)))"""


def _prep(source: str) -> str:
    return rf"p0 AS (SELECT *, list_filter(string_split(regexp_replace(text, '\s', '', 'g'), ''), lambda x: x != '') AS c, {_TOK.format(x='lower(text)')} AS w, {_TOK.format(x='text')} AS tok FROM {source}), p AS (SELECT *, list_sort(c)[len(c) // 2 + 1] AS cm, list_sort(w)[len(w) // 2 + 1] AS wm FROM p0)"


def _rep(times: int, longest: int) -> str:
    one = " OR ".join(f"(len(tok) >= {k * times} AND tok[len(tok) - {k * times} + 1 : len(tok) - {k}] = tok[len(tok) - {k * times} + 1 + {k} : len(tok)])" for k in range(1, longest + 1))
    return f"({one})"


def _clock(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _code(n: str, nominal: int, drop: int = 0) -> str:
    if drop:
        ten, one = nominal * 600 - drop * 9, nominal * 60 - drop
        m = f"({n} % {(nominal * 3600 - drop * 54) * 24})"
        n = f"({m} + {drop * 9} * ({m} // {ten}) + CASE WHEN {m} % {ten} >= {drop} THEN {drop} * (({m} % {ten} - {drop}) // {one}) ELSE 0 END)"
    return f"printf('%02d:%02d:%02d{';' if drop else ':'}%02d', {n} // {nominal * 3600}, {n} // {nominal * 60} % 60, {n} // {nominal} % 60, {n} % {nominal})"


_IV = "iv AS (SELECT user_id AS stream, event_id AS id, event_type AS kind, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) AS s, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) + 1 + cast(floor(value * 300) AS bigint) AS e FROM events)"

ORACLE = {
    "visible_punctuation": r"SELECT doc_id, regexp_matches(text, '\p{P}') AS has_mark, length(regexp_replace(text, '[^\p{P}]', '', 'g')) AS n_marks FROM documents",
    "closing_collapse": "SELECT doc_id, md5(regexp_replace(replace(text, '.', '.,'), '([.。!！?？:：;；])[,，、]+', '\\1', 'g')) AS digest FROM documents",
    "trim_punctuation": r"SELECT doc_id, md5(regexp_replace(text, '[\p{P}\s]+\z', '')) AS digest, length(regexp_replace(text, '[\p{P}\s]+\z', '')) AS n FROM documents",
    "ends_with_class": r"SELECT doc_id, regexp_matches(text, '[.?!。？！…][\s\p{Pe}\p{Pf}]*\z') AS sentence, regexp_matches(text, '[,;:，；：、][\s\p{Pe}\p{Pf}]*\z') AS clause FROM documents",
    "lexical_words": f"SELECT doc_id, len(regexp_extract_all(text, '{_WORD}')) AS n_words, md5(array_to_string(regexp_extract_all(text, '{_WORD}'), ' ')) AS digest FROM documents",
    "lexical_edges": f"SELECT doc_id, coalesce(regexp_extract_all(text, '{_EDGE}')[1], '') AS first_word, coalesce(regexp_extract_all(text, '{_EDGE}')[-1], '') AS last_word FROM documents",
    "parse_lines": r"""WITH a AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS l FROM documents), b AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx FROM b WHERE trim(line) != '') SELECT doc_id, idx, printf('line_%06d', idx + 1) AS line_id, pos AS source_line, line FROM c""",
    "abnormal_text": f"WITH {_prep('documents')} SELECT doc_id, {_ABN} AS abnormal FROM p",
    "repeated_suffix": f"WITH {_prep('documents')} SELECT doc_id, {_rep(20, 20)} AS repeats FROM p",
    "display_units": r"SELECT doc_id, length(regexp_replace(text, '[\p{M}\p{C}]', '', 'g')) AS units FROM documents",
    "find_count": "SELECT doc_id, n FROM (SELECT doc_id, cast(list_sum(list_transform(regexp_extract_all(text, '(?:an)+'), lambda x: length(x) // 2 - 1)) AS bigint) AS n FROM documents) WHERE n > 0",
    "replace_all": "SELECT doc_id, md5(replace(text, 'the', 'THE')) AS digest, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents",
    "join_tokens": r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'), ' '), ' ([.?!。？！…,;:，；：、\p{Pe}\p{Pf}])', '\1', 'g'), '([\p{Ps}\p{Pi}]) ', '\1', 'g')) AS joined FROM conversations",
    "redact": r"""WITH a AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' Bearer abc.def hf_12ab sk-zz9 sb_q', '\s+', ' ', 'g'), 'Bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [redacted]', 'g'), 'sb_[A-Za-z0-9_-]+', 'sb_[redacted]', 'g'), 'hf_[A-Za-z0-9_-]+', 'hf_[redacted]', 'g'), 'sk-[A-Za-z0-9_-]+', 'sk-[redacted]', 'g') AS r,
      regexp_replace(regexp_replace(regexp_replace(text, '[\r\n\t]+', ' ', 'g'), '\s+', '_', 'g'), '[^A-Za-z0-9._-]', '_', 'g') AS f FROM conversations)
      SELECT conv_id, turn, CASE WHEN length(r) > 500 THEN substr(r, 1, 497) || '...' ELSE r END AS shown, CASE WHEN f = '' THEN 'unknown' WHEN length(f) > 64 THEN substr(f, 1, 61) || '...' ELSE f END AS field FROM a""",
    "url_encode": "SELECT page_id, url_encode(url || ' ~*é') AS encoded FROM pages",
    "humanize_bytes": "WITH a AS (SELECT doc_id, cast(n_chars * n_chars * 37 AS double) AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1e9 THEN printf('%.2f GB', n / 1e9) WHEN n >= 1e6 THEN printf('%.0f MB', n / 1e6) WHEN n >= 1e3 THEN printf('%.0f KB', n / 1e3) ELSE printf('%d B', cast(floor(n) AS bigint)) END AS shown FROM a",
    "version_compare": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN false ELSE (doc_id % 4, n_chars % 13, doc_id % 11) > (1, 10, 3) END AS newer FROM documents",
    "sha256_fingerprint": """SELECT doc_id, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS fingerprint, sha256(text) AS content FROM documents""",
    "srt_timestamp": f"WITH a AS (SELECT event_id AS id, cast(round_even(event_id / 2000.0 * 1000.0, 0) AS bigint) AS m, cast(floor(event_id / 2000.0 * 1000.0 + 0.5) AS bigint) AS u FROM events) SELECT id, {_clock('m')} AS even, {_clock('u')} AS half_up FROM a",
    "srt_render": f"""WITH {_IV}, a AS (SELECT stream, kind, row_number() OVER (PARTITION BY stream ORDER BY s, e, id) AS i, (s - min(s) OVER (PARTITION BY stream)) * 1000 AS a, (e - min(s) OVER (PARTITION BY stream)) * 1000 AS b FROM iv),
      b AS (SELECT stream, i, i || chr(10) || {_clock('a')} || ' --> ' || {_clock('b')} || chr(10) || kind || chr(10) AS block FROM a) SELECT stream, md5(string_agg(block, chr(10) ORDER BY i)) AS digest, count(*) AS n FROM b GROUP BY stream""",
    "timecode": f"WITH a AS (SELECT event_id AS id, event_id * 997 AS n FROM events) SELECT id, {_code('n', 25)} AS plain, {_code('n', 30, 2)} AS drop30, {_code('n', 60, 4)} AS drop60, cast(floor(id * 1.0 * 30000 / 1001 + 0.5) AS bigint) AS frames FROM a",
}
