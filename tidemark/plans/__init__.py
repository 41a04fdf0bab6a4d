"""Registered queries over the driver's tables, and their SQL."""

from tidemark.plans import fold_sql, interval_queries, job_queries, match_queries, record_queries, script_queries, signal_queries, text_queries

_MODULES = (interval_queries, signal_queries, text_queries, match_queries, record_queries, job_queries, script_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict = {k: v for m in _MODULES for k, v in m.ORACLE.items()} | fold_sql.ORACLE


def flagship(spark, sf_dir):
    """Documents to timed words to subtitle blocks to rendered subtitles."""
    return match_queries.subtitle_files(spark, sf_dir)
