"""Segmentation and matching queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import text as tx
from tidemark.functions import timecode as tc
from tidemark.functions.lexicon import BY_CODE
from tidemark.operators import intervals as iv
from tidemark.operators import lockstep, match, segment
from tidemark.sources.frames import document_texts, intervals, table, timed, token_rows


def _talk(spark, d):
    return table(spark, d, "conversations")


def boundary_features(spark, d):
    """What stands at each boundary between words: all features, the phrases, and the reasons against a cut, in order."""
    f = segment.boundary_frame(token_rows(spark, d)).drop("preferred", "score")
    return f.withColumn("reasons", F.array_join("reasons", ","))


def boundary_score(spark, d):
    return segment.boundary_frame(token_rows(spark, d)).select("stream", "ord", "preferred", "protected_boundary", "score")


def segment_blocks(spark, d):
    return segment.segment(token_rows(spark, d))


def _low(spark, d):
    """Low stretches of a track for each document: from its third word on, each seventh gap and half of a word behind it."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("stream"), F.explode(F.expr("sequence(1150L, 100000L, 2800L)")).alias("s")).withColumn("e", F.col("s") + 100 + F.col("s") % 1900)


def acoustic_gaps(spark, d):
    """The longest low stretch in the gap before each word."""
    rows = segment.heard(token_rows(spark, d), _low(spark, d))
    return rows.select("stream", F.posexplode("acoustic").alias("ord", "ms")).where("ms > 0").withColumn("ord", F.col("ord").cast("long"))


def segment_acoustic(spark, d):
    """Blocks of 30 columns with a probability track's pauses, end marks off, no gaps."""
    return segment.segment(segment.heard(token_rows(spark, d), _low(spark, d)), 30, trim=True, remove_gaps=True)


def block_postprocess(spark, d):
    """Lines of documents as blocks: end marks off, empty ones out, up to the next start."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("stream"), F.posexplode(F.split("text", "\n")).alias("id", "text"))
    blocks = lines.select("stream", F.col("id").cast("long").alias("id"), (F.col("id") * 1000).cast("long").alias("s"), (F.col("id") * 1000 + 700).cast("long").alias("e"), F.when(F.col("id") % 5 == 3, F.lit("...")).otherwise(F.col("text")).alias("text"))
    return segment.postprocessed(blocks).select("stream", "id", "s", "e", F.md5("text").alias("digest"))


def subtitle_files(spark, d):
    """Documents to tokens to blocks, snapped to frames, rendered: one subtitle text for each document that has words, in one pass."""
    return lockstep.subtitles(document_texts(spark, d), timed, width=42, rate=25)


def timed_units(spark, d):
    rows = _talk(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream"), F.posexplode(tx.split_blank(F.col("text"))).alias("ord", "text"))
    timed = rows.select("stream", F.col("ord").cast("long").alias("ord"), "text", (F.col("ord") * 400).cast("long").alias("ms_start"), (F.col("ord") * 400 + 350).cast("long").alias("ms_end"))
    units = match.timed_units(timed, F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", ""))
    return units.select("stream", "ord", "i", "unit", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def group_coverage(spark, d):
    """Words all of whose letters a transcript without k and q has, by line."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("stream"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("stream", F.col("line").cast("long").alias("line"), tx.split_blank(F.lower("t")).alias("w")).where("size(w) > 0")
    return match.word_coverage(words, lambda w: ~w.rlike("[kq]")).select("stream", "line", "complete", "total", F.round("coverage", 6).alias("coverage"))


def coverage_ratio(spark, d):
    """Likeness of each turn and the one before."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = _talk(spark, d).withColumn("before", before).where("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(tx.match_ratio(F.col("before"), F.col("text")), 6).alias("ratio"))


def line_mapping(spark, d):
    """Lines of turns timed by a transcript that lacks each seventh word."""
    words = F.filter(tx.split_blank(F.col("text")), lambda w, i: i % 7 != 6)
    at = F.transform(words, lambda w, i: (i * 400).cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = _talk(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream"), lines.alias("lines"), words.alias("words"), at.alias("starts"), F.transform(at, lambda t: t + 350).alias("ends"))
    return match.map_lines(rows, 0.5)


def dedup_reconcile(spark, d):
    """Events of a user of one kind as candidates of three overlapping windows."""
    c = intervals(spark, d).select("stream", F.col("kind").alias("norm"), "id", (F.col("id") % 3).alias("win"), F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"), (F.col("s") - F.col("id") % 50).cast("double").alias("in_s"), (F.col("e") + F.col("id") % 70).cast("double").alias("in_e"), F.lit(1.0).alias("coverage"))
    return match.reconcile(c).select("stream", "norm", "id", "duplicates")


def stabilize_blocks(spark, d):
    return match.stabilized(intervals(spark, d)).select("stream", "id", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


def validate_alignment(spark, d):
    return match.first_fault(intervals(spark, d), 0, 1_706_500_000)


QUERIES = {f.__name__: f for f in (boundary_features, boundary_score, segment_blocks, acoustic_gaps, segment_acoustic, block_postprocess, subtitle_files, timed_units, group_coverage, coverage_ratio, line_mapping, dedup_reconcile, stabilize_blocks, validate_alignment)}

_TOK = r"list_filter(string_split_regex({x}, '[ \t\n\x0B\f\r]+'), lambda t: t != '')"
_EDGE = tx.EDGE.replace("'", "''")


_IV = "iv AS (SELECT user_id AS stream, event_id AS id, event_type AS kind, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) AS s, cast(floor(epoch_us(ts) / 1000000.0) AS bigint) + 1 + cast(floor(value * 300) AS bigint) AS e FROM events)"
_LANGS = ("en", "fr", "de", "es")  # those of the documents
_FOLDED = "replace(lower(text), 'ß', 'ss')"
_WORDS = tx.WORD.replace("'", "''")


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _member(kind: str, column: str) -> str:
    return "(" + " OR ".join(f"(lang = '{c}' AND {column} IN ({', '.join(map(_quoted, sorted(getattr(BY_CODE[c], kind))))}))" for c in _LANGS) + ")"


def _pair() -> str:
    return "(" + " OR ".join(f"(lang = '{c}' AND (l0, r1) IN ({', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in sorted(BY_CODE[c].pairs))}))" for c in _LANGS) + ")"


def _phrase(kind: str, columns: list[list[str]]) -> str:
    """The first listed phrase that one of the runs of columns (by length) spells."""
    tests = []
    for c in _LANGS:
        for phrase in getattr(BY_CODE[c], kind):
            for run in columns:
                if len(run) >= len(phrase):
                    tests.append(f"WHEN lang = '{c}' AND " + " AND ".join(f"{col} = {_quoted(w)}" for col, w in zip(run, phrase)) + f" THEN {_quoted(' '.join(phrase))}")
    return "CASE " + " ".join(tests) + " ELSE '' END"


def _across() -> str:
    """The first listed phrase that goes across the boundary: each phrase at each of its inner places."""
    before, tests = ["l0", "l1", "l2"], []
    for c in _LANGS:
        for phrase in BY_CODE[c].protected_phrases:
            for cut in range(1, len(phrase)):
                columns = [*reversed(before[:cut]), *(f"r{i}" for i in range(1, len(phrase) - cut + 1))]
                tests.append(f"WHEN lang = '{c}' AND " + " AND ".join(f"{col} = {_quoted(w)}" for col, w in zip(columns, phrase)) + f" THEN {_quoted(' '.join(phrase))}")
    return "CASE " + " ".join(tests) + " ELSE '' END"


_FEATURES = rf"""a AS (SELECT doc_id AS stream, lang, {_TOK.format(x='text')} AS l FROM documents), b AS (SELECT stream, lang, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS ord FROM a),
  c AS (SELECT *, regexp_extract_all({_FOLDED}, '{_WORDS}') AS ws, coalesce(sum(CASE WHEN regexp_matches(text, '[.!?]$') THEN 900 ELSE 0 END) OVER (PARTITION BY stream ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + ord * 400 AS st FROM b),
  t AS (SELECT *, sum(len(ws)) OVER w AS done, lead(st) OVER w AS ns, lead(text) OVER w AS nt FROM c WINDOW w AS (PARTITION BY stream ORDER BY ord)),
  w0 AS (SELECT stream, done - len(ws) + generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM t UNION ALL SELECT DISTINCT stream, 0, '' FROM t),
  w1 AS (SELECT stream, k, w AS l0, lag(w, 1, '') OVER o AS l1, lag(w, 2, '') OVER o AS l2, lead(w, 1, '') OVER o AS r1, lead(w, 2, '') OVER o AS r2, lead(w, 3, '') OVER o AS r3, lead(w, 4, '') OVER o AS r4 FROM w0 WINDOW o AS (PARTITION BY stream ORDER BY k)),
  x AS (SELECT t.stream, t.lang, t.ord, t.text, t.nt, t.st, t.ns, w1.* EXCLUDE (stream, k), regexp_full_match(l0, '[+-]?\d+([.,]\d+)*') AND {_member('protected_right', 'r1')} AS unit, regexp_matches(text, '\d[.,，．]$') AND regexp_matches(nt, '^\d') AS num FROM t JOIN w1 ON w1.stream = t.stream AND w1.k = t.done WHERE ns IS NOT NULL),
  y AS (SELECT *, num OR (unit AND regexp_matches(text, '\d[.．]$')) AS cont, {_phrase('boundary_phrases', [['r1', 'r2', 'r3', 'r4']])} AS matched_boundary, {_across()} AS matched_protected FROM x),
  f AS (SELECT stream, ord, regexp_matches(text, '[.?!。？！…][\s\p{{Pe}}\p{{Pf}}]*\z') AND NOT cont AS sentence_end, regexp_matches(text, '[,;:，；：、][\s\p{{Pe}}\p{{Pf}}]*\z') AND NOT cont AS clause_end, cast(greatest(0, ns - st - 350) AS bigint) AS pause,
    {_member('conjunctions', 'r1')} AS before_conjunction, {_member('subordinates', 'r1')} AS before_subordinate, {_member('prepositions', 'r1')} AS before_preposition, matched_boundary != '' AS boundary_phrase, matched_protected != '' AS protected_phrase, matched_boundary, matched_protected,
    concat_ws(',', CASE WHEN {_member('protected_left', 'l0')} THEN 'protected_left' END, CASE WHEN {_member('prepositions', 'l0')} THEN 'preposition_object' END, CASE WHEN {_member('subordinates', 'l0')} THEN 'subordinate_clause' END, CASE WHEN {_member('conjunctions', 'l0')} THEN 'conjunction_complement' END,
      CASE WHEN {_member('protected_right', 'r1')} THEN 'protected_right' END, CASE WHEN {_pair()} THEN 'protected_pair' END, CASE WHEN matched_protected != '' THEN 'protected_phrase' END, CASE WHEN unit THEN 'number_unit' END, CASE WHEN cont THEN 'numeric_continuation' END) AS reasons FROM y),
  g AS (SELECT *, reasons != '' AS protected_boundary FROM f)"""

ORACLE = {
    "boundary_features": f"WITH {_FEATURES} SELECT * FROM g",
    "boundary_score": f"""WITH {_FEATURES}, h AS (SELECT *, sentence_end OR clause_end OR pause >= 300 OR before_conjunction OR before_subordinate OR before_preposition OR boundary_phrase AS preferred FROM g)
      SELECT stream, ord, preferred, protected_boundary, (CASE WHEN preferred THEN 30 ELSE 0 END + CASE WHEN sentence_end THEN 1000 WHEN clause_end THEN 80 ELSE 0 END + CASE WHEN before_conjunction THEN 50 ELSE 0 END + CASE WHEN before_subordinate THEN 40 ELSE 0 END + CASE WHEN before_preposition THEN 45 ELSE 0 END
        + CASE WHEN boundary_phrase THEN 65 ELSE 0 END + CASE WHEN pause >= 800 THEN 100 WHEN pause >= 500 THEN 40 WHEN pause >= 300 THEN 8 ELSE 0 END - CASE WHEN sentence_end THEN 0 ELSE CASE WHEN protected_boundary THEN 600 ELSE 0 END + CASE WHEN protected_phrase THEN 300 ELSE 0 END END)::bigint AS score FROM h""",
    "acoustic_gaps": rf"""WITH a AS (SELECT doc_id AS stream, {_TOK.format(x='text')} AS l FROM documents), b AS (SELECT stream, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS ord FROM a), c AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(text, '[.!?]$') THEN 900 ELSE 0 END) OVER (PARTITION BY stream ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + ord * 400 AS st FROM b),
      g AS (SELECT stream, ord, lag(st) OVER (PARTITION BY stream ORDER BY ord) + 350 AS s, st AS e FROM c), v AS (SELECT i AS s, i + 100 + i % 1900 AS e FROM range(1150, 100001, 2800) r(i))
      SELECT g.stream, g.ord, max(least(g.e, v.e) - greatest(g.s, v.s))::bigint AS ms FROM g JOIN v ON v.s < g.e AND g.s < v.e GROUP BY g.stream, g.ord""",
    "block_postprocess": r"""WITH a AS (SELECT doc_id AS stream, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT stream, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS id FROM a), c AS (SELECT stream, id, id * 1000 AS s, id * 1000 + 700 AS e, regexp_replace(CASE WHEN id % 5 = 3 THEN '...' ELSE t END, '[\p{P}\s]+\z', '') AS t FROM b)
      SELECT stream, id, s, coalesce(lead(s) OVER (PARTITION BY stream ORDER BY id), e) AS e, md5(t) AS digest FROM c WHERE t != ''""",
    "timed_units": rf"""WITH a AS (SELECT conv_id * 1000 + turn AS stream, {_TOK.format(x='text')} AS l FROM conversations), b AS (SELECT stream, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS ord FROM a),
      c AS (SELECT stream, ord, string_split(regexp_replace(lower(w), '[^\p{{L}}\p{{N}}]', '', 'g'), '') AS u FROM b), e AS (SELECT stream, ord, unnest(u) AS unit, generate_subscripts(u, 1) - 1 AS i, len(u) AS n FROM c)
      SELECT stream, ord, i, unit, round(ord * 400 + 350 * i / n, 3) AS start, round(ord * 400 + 350 * (i + 1) / n, 3) AS "end" FROM e WHERE unit != ''""",
    "group_coverage": rf"""WITH a AS (SELECT doc_id AS stream, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT stream, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS line FROM a), c AS (SELECT stream, line, unnest({_TOK.format(x='lower(t)')}) AS w FROM b)
      SELECT stream, line, count_if(NOT regexp_matches(w, '[kq]'))::bigint AS complete, count(*) AS total, round(count_if(NOT regexp_matches(w, '[kq]')) / count(*), 6) AS coverage FROM c GROUP BY stream, line""",
    "validate_alignment": f"""WITH {_IV}, a AS (SELECT *, row_number() OVER w - 1 AS i, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM iv WINDOW w AS (PARTITION BY stream ORDER BY id)),
      b AS (SELECT stream, i, CASE WHEN s < 0 OR e > 1706500000 THEN 'TOKEN_OUT_OF_BOUNDS' WHEN e <= s THEN 'INVALID_INTERVAL' WHEN s < ps OR e < pe THEN 'NON_MONOTONIC_TIME' END AS code FROM a)
      SELECT stream, coalesce(arg_min(code, i) FILTER (code IS NOT NULL) || ':' || min(i) FILTER (code IS NOT NULL), '') AS error FROM b GROUP BY stream""",
}
