"""Structured Streaming forms of the interval and job operators."""
