"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as a table that was written and read again. All but the last return the columns of
``documents``, others that the table has included. Nulls, empty texts and repeated rows are treated as each operator's docstring
says; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, order_minhash, packing, pii_surrogates, toxicity
from tidemark.llm.common import materialise, table, tidy

#: Documents that score as high are rejected.
THRESHOLD = 0.7


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the network learns from ``documents`` and ``labels``."""
    scorer = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_harmless(docs, scorer, THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.deduplicate(docs, keep="min")


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the document with the smallest id."""
    tidy(spark)
    return order_minhash.deduplicate(docs, at_least=0.8)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` is that of the new text."""
    tidy(spark)
    out = pii_surrogates.replaced(docs, pii_surrogates.key_of(spark))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    tidy(spark)
    return packing.packed(docs)


STAGES = [("toxicity", harmless), ("exact_dedup", distinct), ("near_dedup", unlike), ("pii", without_pii), ("packing", packed)]

#: A trained network and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
