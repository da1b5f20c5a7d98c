"""Structured Streaming forms of the log and dedup operators."""
