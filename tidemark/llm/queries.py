"""Registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from tidemark.llm import byte_bpe, exact_dedup, order_minhash, packing, pii_surrogates, quality_rules, substring_dedup, token_counts, toxicity, warc
from tidemark.llm.common import materialise, shared_path, table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.classes(table(spark, sf_dir, "documents"), keep="max")


def op2_warc_derivatives(spark, sf_dir):
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.removed(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.replaced(docs, pii_surrogates.key_of(spark), count_col="n_entities")


def op6_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    """Load every document, delete those whose text another keeps, then count the rest of other languages than English anew under
    a tokenizer for many languages, which replaces their former counts; each batch is sent twice."""
    docs = table(spark, sf_dir, "documents")
    counts = materialise(token_counts.counted(docs), "token-counts")
    dropped = materialise(exact_dedup.classes(docs, keep="min").where("NOT kept").select("doc_id"), "dropped")
    foreign = lambda rows: rows.where("lang IS NULL OR lang != 'en'").join(dropped, "doc_id", "left_anti")
    store = token_counts.RollupStore(spark, shared_path(spark, "rollup"))
    for _ in range(2):
        store.commit("load", token_counts.signed(counts, 1))
        store.commit("dedup", token_counts.signed(counts.join(dropped, "doc_id", "left_semi"), -1))
        store.commit("many languages", token_counts.revised(foreign(counts), token_counts.counted(foreign(docs), "byte_bpe_multi_50k.tiktoken")))
    return store.totals()


def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op9_order_minhash(spark, sf_dir):
    return order_minhash.classes(table(spark, sf_dir, "documents"), at_least=0.8)


def op10_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_warc_derivatives, op3_toxicity, op4_substring_dedup, op5_pii_surrogates, op6_byte_bpe, op7_token_counts, op8_quality_rules, op9_order_minhash, op10_packing)}
ORACLE = {"op1_exact_dedup": exact_dedup.SQL, "op4_substring_dedup": substring_dedup.SQL}
