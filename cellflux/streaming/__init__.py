"""Structured Streaming twin of the batch standardisation."""
