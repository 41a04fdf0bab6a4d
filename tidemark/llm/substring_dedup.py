"""Substring dedup: words in a window of 50 that also starts in a document with a smaller id are removed.

Windows are grouped into blocks by recompression (``recompression``), about nine windows each. One table holds every
document's block names and contents. Names that occur in two documents or more are found by aggregation, and
only their blocks are looked at again: a block whose name and content occur in an earlier document is removed whole; where one name
has several contents, one document for each (the smallest id) lists the windows of its block, and windows are
compared. Names are hashes and only propose; a content is a BLAKE2b digest of the words' bytes, joined by one blank, under a key
drawn for the run: 64 bits beside the name for a block, 128 bits for a window. Nothing depends on how many documents share a
passage: copies are reduced in partial aggregates and joins are split by adaptive execution. Texts travel for the documents
that are touched only; their ids are broadcast up to ``SMALL_IDS``, 8 bytes each.

Defined results: null reads as empty; texts of fewer words than a window lose none; a row with a null id is neither a
source nor changed; texts of any length are read whole; rows that repeat an id are one document for "smaller id" and are each treated alike; an empty
table gives none; other columns are ignored or carried along.
"""

from __future__ import annotations

import hashlib
import secrets
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, materialise, text_of
from tidemark.llm.recompression import blocks
from tidemark.llm.wordhash import word_hashes

WINDOW = 50
#: Up to this many ids are sent to every task instead of dealing all texts out by id (8 bytes each).
SMALL_IDS = 500_000


def _contents(words: list[bytes], first: np.ndarray, end: np.ndarray, key: bytes, size: int) -> tuple[bytes, bytes]:
    """All words joined by one blank, and the digests of the runs of words from ``first`` up to ``end``, one after another."""
    joined = b" ".join(words)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    digests = [blake2b(joined[a:b], digest_size=size, key=key).digest() for a, b in zip(at[first].tolist(), (at[end] - 1).tolist())]
    return joined, b"".join(digests)


def _parsed(docs: DataFrame, window: int, key: bytes) -> DataFrame:
    """doc_id, n_words, sha256 of all words, block names and contents."""

    def run(frames):
        for batch in batches(frames):
            n, sha, names, hashes = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                first, name, end = blocks(word_hashes(data), window)
                joined, content = _contents(words, first, end, key, 8)
                n.append(len(words))
                sha.append(hashlib.sha256(joined).hexdigest())
                names.append(name.view(np.int64))
                hashes.append(np.frombuffer(content, np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(names, longs), pa.array(hashes, longs)], ["doc_id", "n_words", "sha", "names", "hashes"])

    return docs.mapInArrow(run, "doc_id long, n_words long, sha string, names array<long>, hashes array<long>")


def _touched(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) joined to ``lists`` (d, ...): only their texts are dealt out."""
    ids = lists.select("d")
    if ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS:
        docs = docs.join(F.broadcast(ids), docs.doc_id == F.col("d"), "left_semi")
    return docs.join(lists, docs.doc_id == F.col("d")).drop("d")


def _windows(rows: DataFrame, window: int, key: bytes) -> DataFrame:
    """doc_id, at and content of each window of the listed blocks."""

    def run(frames):
        for batch in batches(frames):
            ids, at, both = [], [], []
            for doc, text, listed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode("utf-8", "surrogatepass")
                h = word_hashes(data)
                first = blocks(h, window)[0]
                end = np.append(first[1:], len(h) - window + 1)
                mine = np.concatenate([np.arange(first[k], end[k]) for k in sorted(set(listed))])
                ids.append(np.full(len(mine), doc, np.int64)), at.append(mine)
                both.append(_contents(data.split(), mine, mine + window, key, 16)[1])
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            digests = np.frombuffer(b"".join(both), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([join(ids), join(at), pa.array(digests[:, 0]), pa.array(digests[:, 1])], ["doc_id", "at", "w1", "w2"])

    return rows.select("doc_id", "text", "listed").mapInArrow(run, "doc_id long, at long, w1 long, w2 long")


def _cut(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Remove the words of the listed blocks and windows."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def run(frames):
        for batch in batches(frames):
            out = []
            for doc, text, whole, single in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode("utf-8", "surrogatepass")
                words, h = data.split(), word_hashes(data)
                first = blocks(h, window)[0]
                end = np.append(first[1:], len(h) - window + 1)
                edge = np.zeros(len(words) + 1, np.int64)  # +1 where a removed stretch begins, -1 behind it
                for k in whole or ():
                    edge[first[k]] += 1
                    edge[end[k] - 1 + window] -= 1
                for i in single or ():
                    edge[i] += 1
                    edge[i + window] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([w for w, s in zip(words, stay.tolist()) if s])
                out.append((doc, len(words), int((~stay).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 5 if with_text else 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(types)])

    return rows.select("doc_id", "text", "whole", "single").mapInArrow(run, schema)


def removed(docs: DataFrame, window: int = WINDOW, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; with ``with_text`` also kept_text (null where nothing was removed)."""
    key = secrets.token_bytes(32)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    parsed = materialise(_parsed(docs, window, key), "blocks")
    each = parsed.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.arrays_zip("names", "hashes")).alias("k", "b")).select("doc_id", "k", F.col("b.names").alias("name"), F.col("b.hashes").alias("hash"))
    by_name = each.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), (F.min("hash") != F.max("hash")).alias("several"))
    shared = materialise(by_name.where("least < most").select(F.col("name").alias("n"), "several"), "shared-names")
    mine = materialise(each.join(shared, F.col("name") == F.col("n")).drop("n"), "shared-blocks")
    owner = mine.groupBy("name", "hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    owner = materialise(owner.select(F.col("name").alias("n"), F.col("hash").alias("h"), "owner", "last"), "block-owners")
    owned = mine.join(owner.where("owner < last"), (F.col("name") == F.col("n")) & (F.col("hash") == F.col("h")) & (F.col("doc_id") > F.col("owner"))).select("doc_id", "k")
    several = mine.where("several").join(owner.select("n", "h", "owner"), (F.col("name") == F.col("n")) & (F.col("hash") == F.col("h")) & (F.col("doc_id") == F.col("owner"))).select("doc_id", "k")
    listed = materialise(several.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list("k").alias("listed")), "listed-blocks")
    windows = materialise(_windows(_touched(docs, listed), window, key), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    twice = materialise(twice.select(F.col("w1").alias("x1"), F.col("w2").alias("x2"), "least"), "twice")  # read again, its join can be split
    single = windows.join(twice, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2")) & (F.col("doc_id") > F.col("least"))).select("doc_id", F.col("at").alias("i"))
    marks = owned.select("doc_id", F.col("k").cast("long").alias("k"), F.lit(None).cast("long").alias("i")).unionByName(single.select("doc_id", F.lit(None).cast("long").alias("k"), "i"))
    marks = materialise(marks.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set("k").alias("whole"), F.collect_set("i").alias("single")), "marks")
    cut = _cut(_touched(docs, marks), window, with_text)
    rest = parsed.join(marks.select("d"), F.col("doc_id") == F.col("d"), "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return rest.unionByName(cut, allowMissingColumns=True)


SQL = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM l),
v AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS run FROM u),
k AS (SELECT doc_id, pos, word, CASE WHEN pos + 49 <= n THEN array_to_string(run, ' ') END AS run FROM v),
f AS (SELECT *, coalesce(run IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY run), false) AS again FROM k),
g AS (SELECT *, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
r AS (SELECT doc_id, count(*) AS n_words, count_if(gone)::bigint AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT l.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN r ON r.doc_id = l.doc_id
"""
