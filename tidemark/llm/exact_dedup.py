"""Exact dedup: a 128-bit content hash finds groups, bytes decide inside them.

Plan: each row's id and hashes of its normalised text (A-Z to a-z only) are written as a small table; hashes that occur twice are
found by aggregation, without texts. Only rows with such a hash move their bytes: they are aggregated by (hash, bytes), so
two texts that collide on the hash never share a group. Partial aggregation collapses copies before the shuffle: a
group that holds a third of all rows crosses as one row for each map task. Where all bytes of a hash agree, rows find their group
by the hash alone; rows of a hash with several texts find it by hash and bytes. The hashes that occur twice are sent to every task
up to ``BROADCAST`` bytes, which are counted first, and beyond that joined by a shuffle.

Defined results: a null text counts as empty; texts of any length are hashed and compared whole; a null id never wins against another;
rows that repeat the kept id with the same text are all ``kept`` in ``classes`` and become
one row in ``deduplicate``; an empty table gives an empty result; other
columns are ignored by ``classes`` and carried along by ``deduplicate`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Hashes are sent to every task up to so many bytes.
BROADCAST = 16 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null reads as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


def _free(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name in taken:
        name += "_"
    return name


def _twice(hashes: DataFrame, name: str) -> DataFrame:
    """The hashes (column h128, as ``name``) of more than one row; to be broadcast if their bytes, 64 a row, are within the bound."""
    hot = materialise(hashes.groupBy("h128").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h128").alias(name)), "exact-twice")
    return F.broadcast(hot) if hot.count() * 64 <= BROADCAST else hot


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "min" (the smallest stable id stays) or "max". Groups of one never meet a join partner.
    """
    pick = F.max if keep == "max" else F.min
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("h128", F.md5("norm"))
    keys = materialise(texts.select("doc_id", "h128", F.sha2("norm", 256).alias("text_sha256")), "exact-keys")
    members = texts.join(_twice(keys, "hot"), F.col("h128") == F.col("hot"), "left_semi")
    groups = members.groupBy("h128", "norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = groups.groupBy(F.col("h128").alias("h")).agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("k"), F.min("group_size").alias("n"))
    by_hash = materialise(by_hash, "exact-groups")
    joined = keys.join(by_hash.where("texts = 1").select("h", "k", "n"), F.col("h128") == F.col("h"), "left").drop("h")
    several = by_hash.where("texts > 1").select("h")
    if several.limit(1).count():  # never met but by construction: these rows are joined by their bytes
        bytes_of = texts.join(F.broadcast(several) if several.count() * 64 <= BROADCAST else several, F.col("h128") == F.col("h"), "left_semi")
        own = bytes_of.groupBy("norm").agg(pick("doc_id").alias("k"), F.count(F.lit(1)).alias("n")).withColumnRenamed("norm", "b")
        rest = bytes_of.join(own, F.col("norm") == F.col("b")).select("doc_id", "h128", F.sha2("norm", 256).alias("text_sha256"), "k", "n")
        joined = joined.join(several, F.col("h128") == F.col("h"), "left_anti").unionByName(rest)
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("k"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, with their own columns: of equal texts, the smallest (or largest) id. Rows without a copy do not move."""
    pick = F.max_by if keep == "max" else F.min_by
    norm = normalised(F.col(f"`{text_col}`"))
    name = _free("hot", docs)
    hot = _twice(docs.select(F.md5(norm).alias("h128")), name)
    same = F.md5(norm) == F.col(name)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rank = F.struct(F.col(f"`{id_col}`"), text)
    if keep != "max":  # nulls sort first; they must not win
        rank = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), text)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    copies = docs.join(hot, same, "left_semi").select(norm.alias("norm"), row.alias("whole"), rank.alias("rank"))
    kept = copies.groupBy(F.md5("norm").alias("h128"), "norm").agg(pick("whole", "rank").alias("whole"))
    return docs.join(hot, same, "left_anti").unionAll(kept.select("whole.*"))


SQL = """
WITH keyed AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM keyed
"""
