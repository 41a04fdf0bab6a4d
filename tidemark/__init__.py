"""Tidemark: analytics on ordered, timed records and text, expressed as Spark plans."""
